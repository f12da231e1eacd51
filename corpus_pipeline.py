"""The corpus pipeline: language ID, toxicity, near duplicates, source mixing and packing, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents, and any others, whatever their names. What the stages do with nulls,
empty and very long texts, ties and repeated rows is what their operators define; in short:

    language ID       null and empty texts, and texts without a letter, go; null ids are judged as all others
    toxicity          texts without a known word have the score of such examples; labels of null ids aren't used
    near duplicates   texts without a word stay, equal ones of one id once; of equal rows one stays; rows without an id
                      go where a row with one is like them
    source mixing     a null source is a source; documents without words give no rows; n_chars is that of the new text
    packing           a null or empty text is the single id 0; null ids stay null

An empty table passes through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flicker.llm import langid, mixing, ngram_join, packing, toxicity
from flicker.llm.common import discard, id_mod, materialize, read
from flicker.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language isn't clear, go."""
    model = langid.train(docs.select("text"), docs.where(id_mod("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    return langid.keep_identified(docs, model)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    model = toxicity.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each round that takes some."""
    return mixing.mix_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their place."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: The models and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is deleted as soon as the next one is written."""
    docs = read(spark, sf_dir, "documents")
    last = None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
