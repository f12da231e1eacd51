"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

Terms are the distinct lower-case runs of letters, marks and digits of a text. The lexicon holds the terms whose share
of documents lies within BAND (so their inverse document frequency lies between ln 10 and ln 1000); document
frequencies are counted over all documents. PARTS random parts of the lexicon are drawn by a hash of the term, PER_RATE
of each of the rates 1/16 to 1/512, so that texts of some ten to some thousand terms of the lexicon all have many parts in
which about one of their terms lies: a part of which one term changes is lost, so parts must be small to survive an edit.
A fingerprint is one 8-digit hash for each part: of the sorted distinct terms of the text in that part, or dots if it has
none there. Likeness of two fingerprints: the share of equal hashes among the parts where at least one of them has terms.

At scale: a term of the lexicon is in at least N / 1000 documents, so the lexicon has at most 1000 times the mean number
of distinct terms of a document, whatever N is; it is broadcast up to BROADCAST_TERMS and joined by shuffle beyond.
Texts are shuffled once, by range of the order, to meet the next text; everything after that stays in the same
partitions. Ranges have about RANGE_ROWS rows (more where that would make over MOST_RANGES of them), are cut by id and
then by how a text begins, so rows of one id or without any are spread as well, and the first row of a range is also
sent to the range before it: no task looks over all rows.

Defined results: a null text is empty; texts of any length are taken whole. A text without a term of the lexicon has the
hash of its whole text in every part, so it is like its exact copies only. Null ids come last; rows of equal id are
ordered by text. Repeated rows have equal fingerprints. Where only one row exists, it is its own next document. An empty
table gives an empty result. Columns besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, order_ranges

#: Least and most share of documents, as 1 / x.
BAND = (1000, 10)
#: Rates of the parts as powers of one half, and parts of each.
RATE_BITS, PER_RATE = (4, 5, 6, 7, 8, 9), 10
BROADCAST_TERMS = 400_000
RANGE_ROWS, MOST_RANGES = 1024, 1 << 18
NONE = "........"
TERM = r"[\p{L}\p{M}\p{N}]+"


def _parts() -> list[tuple[int, int, int]]:
    """shift, mask and value of each part: it holds the terms that have this value in a field of their hash. Every rate has fields of its own."""
    out, at = [], 0
    for bits in RATE_BITS:
        for k in range(PER_RATE):
            if k and k % (1 << bits) == 0:
                at += bits
            out.append((at, (1 << bits) - 1, k % (1 << bits)))
        at += bits
    return out


PARTS = _parts()


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, code: 60 bits of its hash, of which fields decide about its parts."""
    rows = docs.count()
    held = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))
    band = held.where((F.col("docs") * BAND[0] >= rows) & (F.col("docs") * BAND[1] <= rows))
    return band.select("term", F.conv(F.substring(F.md5("term"), 1, 15), 16, 10).cast("long").alias("code"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the columns range, nth (in it), ghost and next (the text of the next row by descending id).

    Ghosts are copies of a range's first row at the end of the range before it.
    """
    rows = docs.count()
    begin = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")  # orders as the text does
    keys = {"none": F.col("doc_id").isNull().cast("long"), "id": F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")), "begin": begin}
    per = max(RANGE_ROWS, -(-rows // MOST_RANGES))
    docs = docs.withColumn("range", order_ranges(docs, keys, rows, per)).withColumn("key", F.struct(*[c.alias(k) for k, c in keys.items()]))
    heads = sorted(docs.groupBy("range").agg(F.min("key").alias("head")).collect())  # one row for each range
    before = [(r["range"], tuple(r["head"]), heads[i - 1]["range"]) for i, r in enumerate(heads)]
    heads = docs.sparkSession.createDataFrame(before, "r int, head struct<none: long, id: long, begin: long>, before int")
    same = (docs["range"] == heads["r"]) & (docs["key"] == heads["head"])
    both = docs.join(F.broadcast(heads), same, "left")
    here = F.struct(F.col("range"), F.lit(0).alias("ghost"))
    places = F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("before").alias("range"), F.lit(1).alias("ghost"))))
    rows = both.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.*")
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return rows.withColumn("nth", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))


def _field(c: Column, shift: int, mask: int) -> Column:
    return F.shiftright(c, shift).bitwiseAND(F.lit(mask))


def _below(codes: str, at: tuple[int, int], count: int) -> Column:
    return F.filter(codes, lambda c: _field(c, *at) < count) if count <= at[1] else F.col(codes)


def _field_hashes(some: str, shift: int, mask: int, count: int) -> Column:
    """The hashes of the parts with values 0 to count - 1 of a field; some: the codes that are in any of them."""

    def joined(k: Column) -> Column:
        return F.array_join(F.transform(F.filter(some, lambda c: _field(c, shift, mask) == k), lambda c: c.cast("string")), ",")

    texts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")), joined)
    hashes = F.transform(texts, lambda t: F.when(t == "", NONE).otherwise(F.substring(F.md5(t), 1, 8)))
    return F.when(F.size(some) == 0, F.array_repeat(F.lit(NONE), count)).otherwise(hashes)


def with_part_hashes(sets: DataFrame, codes: str, plain: str, name: str) -> DataFrame:
    """sets with the hash of each part of a text's codes (sorted and distinct); plain: the hash for a text without any.

    The codes of a field are looked up in a step of their own, which stays one as long as each is used more than once.
    """
    counts = Counter(p[:2] for p in PARTS)
    names = {at: f"_{name}_{at[0]}" for at in counts}
    sets = sets.withColumns({names[at]: _below(codes, at, n) for at, n in counts.items()})
    fields = [_field_hashes(names[at], *at, n) for at, n in counts.items()]
    whole = F.when(F.size(codes) == 0, F.array_repeat(F.substring(plain, 1, 8), len(PARTS))).otherwise(F.concat(*fields))
    return sets.withColumn(name, whole).drop(*names.values())


def compared(a: str, b: str) -> Column:
    """Of two arrays of part hashes, in one number: the parts where at least one has terms, and 1,000 times those of them that are equal."""
    each = F.zip_with(a, b, lambda x, y: F.when(x != y, 1).when(x == NONE, 0).otherwise(1001))
    return F.aggregate(each, F.lit(0), lambda n, v: n + v)


def likeness(n: str) -> Column:
    """The share of equal parts, from compared; fingerprints of dots alone are equal."""
    return F.coalesce(F.try_divide(F.floor(F.col(n) / 1000), F.col(n) % 1000), F.lit(1.0))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = materialize(lexicon(docs), "lexicon")
    words = words.union(words.sparkSession.createDataFrame([("", None)], "term string, code long"))  # "" keeps texts without terms
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    of = lambda k, c: F.transform(F.array_append(terms(F.col(c)), F.lit("")), lambda t: F.struct(F.lit(k).alias("kind"), t.alias("term")))
    keys = ["range", "nth", "ghost", "doc_id", "n_chars", "edited_sha256", "plain", "edited_plain"]
    rows = rows.select(
        "range", "nth", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.when(F.col("ghost") == 0, F.sha2("edited", 256)).alias("edited_sha256"), F.md5("text").alias("plain"), F.md5("edited").alias("edited_plain"),
        F.when(F.col("ghost") == 1, of(0, "text")).otherwise(F.concat(of(0, "text"), of(1, "edited"))).alias("held"),
    )
    # exploded in a select of its own: expressions beside an explode are evaluated for every row that it makes
    rows = rows.select(*keys, F.explode_outer("held").alias("t"))  # of an inner one Spark would make the terms twice, once to see that there are any
    small = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    found = rows.select(*keys, "t.kind", "t.term").join(small, "term")
    sets = found.groupBy(*keys).agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("code")))).alias(c) for k, c in enumerate(("codes", "edited_codes"))])
    prints = with_part_hashes(with_part_hashes(sets, "codes", "plain", "own"), "edited_codes", "edited_plain", "other").select(*keys[:6], "own", "other")
    follow = F.lead("own").over(Window.partitionBy("range").orderBy("nth"))
    out = prints.withColumn("follow", follow).where("ghost = 0").withColumns({"to_edited": compared("own", "other"), "to_next": compared("own", "follow")})
    text = lambda c: F.array_join(c, "")
    return out.select("doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("other").alias("edited_fingerprint"), likeness("to_edited").alias("near_edited"), likeness("to_next").alias("near_next"))
