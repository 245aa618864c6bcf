"""From raw documents to packed sequences in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import jaccard_join, langid, mixing, packing, pii
from tramline.llm.common import fresh, table, written
from tramline.llm.queries import arrow, vocabulary

#: A text goes if its entropy in its best language is this many times that of other texts of the language. Texts in a taught
#: language lie about 1, real texts in another one of the alphabet from 3.5 upward.
MOST_MISFIT = 2.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language that the labelled ones teach: texts that fit none of them (``MOST_MISFIT``), and
    null and empty texts and those without a letter. Short texts with a letter and ties between languages stay. A missing
    ``lang`` becomes the prediction; a given one stays. Repeated rows stay or go together."""
    arrow(spark)
    name = fresh(docs, "misfit")
    pred, value = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = langid.identify(docs, langid.fit(docs), pred=pred, value=value, misfit=name).where((F.col(pred) != "und") & (F.col(name) <= MOST_MISFIT))
    return found.select(*[F.coalesce("lang", pred).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the lowest doc_id of each group of near duplicates (five words, similarity 0.8 or more). Texts without a word
    are in no group and stay; a null doc_id is below all others; rows that repeat a doc_id stay or go together."""
    arrow(spark)
    return jaccard_join.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values; n_chars is that of the new text. Null and empty texts and all other columns stay."""
    out = pii.pseudonymise(docs, found=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in order of training position. Null sources are one source;
    texts without a word have no position and go; each row that repeats a doc_id has a plan of its own."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens; sequence ids follow the order in which the mixture was written. A null or empty
    text is its end token alone."""
    return packing.pack(docs, vocabulary(), in_order=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
    ("packed", packed),
]

#: SQL cannot express automata, tokens and keyed permutations; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(arrow(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
