"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as assistant, all others as users
with their names, and a mask that trains only on the assistant's words. `system` speaks in every rendering and is no
participant. A rendering is the segments of one (conversation, perspective) in order; each segment carries its text,
its place in the rendering (code points) and its trainable span, so a conversation of any length is never put together
in one task. `assemble` joins the segments of short stretches of messages into strings.

At scale: only built-in functions. Messages get their place in their conversation by a sort over range partitions, and
lengths are summed in two levels, within runs of RUN messages (by place) and over the runs, so a conversation that holds
a third of all rows is spread over tasks, whatever its turns are; the join with the participants has one row for each
participant on its small side and can be split by adaptive execution.

Defined results: null text is empty, a null role is the speaker `unknown`, null turns come last, null conversation ids
form one conversation. Ties in turn are ordered by speaker, then text. Repeated rows stay. "<|" in texts and names is
rendered as "< |", so texts can't forge a marker. A conversation without participants (system only) has no rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sorted_rows

RUN = 256
#: Messages of a range partition.
PART_ROWS = 1 << 17
END = "<|end|>\n"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _placed(m: DataFrame) -> DataFrame:
    """m with message: the place in the conversation by turn (null last), speaker and text."""
    held = sorted_rows(m, F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text"), rows=m.count(), per=PART_ROWS, name="messages")
    counts = held.groupBy("conv_id", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first_at"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition that has some of it
    starts = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first_at")).alias("start"))
    out = held.join(starts, held["conv_id"].eqNullSafe(starts["c"]) & (held["part"] == starts["p"]))
    return materialize(out.select("conv_id", "turn", "speaker", "text", (F.col("at") + F.col("start")).alias("message")), "placed")


def rotate(messages: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, message, speaker, chat_role, segment, start, train_start, train_end."""
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    m = _placed(m)
    people = m.where("speaker <> 'system'").groupBy("conv_id", "speaker").agg(F.count("*").alias("own")).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective"))
    r = m.join(people, m["conv_id"].eqNullSafe(people["c"])).drop("c")
    role = F.when(F.col("speaker") == "system", "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    r = r.withColumn("chat_role", role)
    head = F.concat(F.lit("<|"), "chat_role", F.when(F.col("chat_role") == "user", F.concat(F.lit(":"), _plain(F.col("speaker")))).otherwise(""), F.lit("|>\n"))
    r = r.withColumn("head", head).withColumn("segment", F.concat("head", _plain(F.col("text")), F.lit(END)))
    r = r.withColumn("run", F.floor(F.col("message") / RUN))
    size = F.char_length("segment").cast("long")
    runs = r.groupBy("conv_id", "perspective", "run").agg(F.sum(size).alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row for each run
    runs = runs.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("run").alias("u"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    inside = Window.partitionBy("conv_id", "perspective", "run").orderBy("message")
    r = r.withColumn("upto", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.join(runs, r["conv_id"].eqNullSafe(runs["c"]) & (r["perspective"] == runs["p"]) & (r["run"] == runs["u"]))
    start = F.col("chars_before") + F.col("upto") - size
    own = F.col("chat_role") == "assistant"
    return r.select(
        "conv_id", "perspective", "turn", "message", "speaker", "chat_role", "segment", start.alias("start"),
        F.when(own, start + F.char_length("head")).alias("train_start"), F.when(own, start + size).alias("train_end"),
    )


def assemble(segments: DataFrame, messages: int = RUN) -> DataFrame:
    """One row for each stretch of so many messages: rendered text, its start and the trainable spans."""
    stretch = segments.withColumn("stretch", F.floor(F.col("message") / messages)).groupBy("conv_id", "perspective", "stretch")
    parts = stretch.agg(F.array_sort(F.collect_list(F.struct("message", "segment", "start", "train_start", "train_end"))).alias("s"))
    spans = F.transform(F.filter("s", lambda x: x["train_start"].isNotNull()), lambda x: F.struct(x["train_start"].alias("start"), x["train_end"].alias("end")))
    return parts.select("conv_id", "perspective", "stretch", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), F.col("s")[0]["start"].alias("start"), spans.alias("train_spans"))
