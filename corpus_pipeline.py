"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept. The first four return
the columns of ``documents``; the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm import langid, mixing, neardup, packing, pii
from latticework.llm.common import cut, fresh, light, table

#: No stage but the mix is expressible in SQL: a fitted model, a hash sketch and a tokenizer decide.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``lang`` becomes the predicted one.

    Null texts, texts without a letter and texts far from every language go.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    judged = langid.identify(docs, model).where("not rejected")
    return judged.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id.

    Only what goes is looked up. Rows of one doc_id are one document; of rows
    that repeat a doc_id and its text one stays, the least by the other columns.
    Rows without doc_id, and those without words, are in no group and stay.
    """
    found = neardup.near_duplicates(docs)
    names = [F.col(f"`{c}`") for c in docs.columns]
    ident, mark, many = fresh(docs, "_id"), fresh(docs, "_hash"), fresh(docs, "_rows")
    pair = [F.col("doc_id").alias(ident), F.col("text_hash").alias(mark)]
    same = lambda side: (F.col("doc_id") == side[ident]) & F.xxhash64("text").eqNullSafe(side[mark])
    gone = cut(found.where("not kept").select(*pair).distinct(), "gone")
    held = docs.join(light(gone, gone.count()), same(gone), "left_anti")
    repeated = cut(found.where("kept and doc_id is not null").groupBy(*pair).agg(F.count("*").alias(many)).where(F.col(many) > 1).drop(many), "repeated")
    if not (n := repeated.count()):
        return held
    place = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*names)
    first = held.join(light(repeated, n), same(repeated), "left_semi").withColumn(many, F.row_number().over(place)).where(F.col(many) == 1).select(*names)
    return held.join(light(repeated, n), same(repeated), "left_anti").unionByName(first)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data and secrets; n_chars follows."""
    new = pii.pseudonymise(docs)
    return new.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for.

    Null, empty and wordless texts are asked for by no target and go; a null
    source is a source of its own; equal rows are taken each for itself; an empty
    table stays empty.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 tokens.

    A null or empty text is one end token; equal rows, such as the copies of the
    mix, are packed each for itself; an empty table gives none.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
