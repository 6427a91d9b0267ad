"""A corpus pipeline of five stages over `documents`; each stage's result is written and read again as the next one's
input. All stages but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriscope.llm import bpe, exact_dedup, langid, mixing, ngram_join
from oriscope.llm._shared import Scratch, unused
from oriscope.llm.queries import tokenizer_path

#: Texts whose n-grams are further than this from every profile are in no known language.
LEAST_SCORE = 0.02


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Python gets five hundred rows at a time: of long documents that fits a small executor. What runs in here is written
    before it ends, and the session is then as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "500")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like no language that was learnt, go; lang becomes the predicted one.

    A null or empty text has no letter and goes. Rows are judged one by one, so repeated and null ids are safe, and
    other columns are carried along whatever their names. If no row has a known lang, nothing can be predicted and
    all rows go; an empty table stays empty.
    """
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    with _small_batches(spark):
        profiles = langid.learn_profiles(docs.filter(~langid.held_out()))
        kept = langid.identify(docs, profiles, keep=tuple(docs.columns), text_col="text", names=(lang, score))
        kept = kept.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).withColumn("lang", F.col(lang))
        return Scratch(spark, "language").table(kept.select(*(F.col(f"`{c}`") for c in docs.columns)), "kept")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that with the largest doc_id, null ids last; of rows with that id the one with the
    largest hash over all columns. A null text counts as empty. An empty table stays empty."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of five-word shingles at 0.8 connect, that with the smallest doc_id stays, null ids last and
    ties by the text's hash. Each row is judged by its own text, whether its doc_id repeats or is null. Rows without
    words (null and empty texts too) link with nothing and stay. An empty table stays empty."""
    scratch = Scratch(spark, "near-copies")
    row_id = unused(docs, "row_id")
    rows = scratch.table(docs.withColumn(row_id, F.monotonically_increasing_id()), "rows")
    keys = rows.select(F.col(row_id).alias("row_id"), "doc_id", F.xxhash64("text").alias("text_hash"))
    with _small_batches(spark):
        sets, classes = ngram_join.link_rows(rows.select(F.col(row_id).alias("row_id"), "text"), 5, 0.8, scratch)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row_id")
    first = sets.filter("n > 0").join(keys, "row_id").groupBy("n", "one", "two").agg(F.min(order).alias("first"))
    first = classes.join(first, ["n", "one", "two"]).groupBy("component").agg(F.min("first")["row_id"].alias("row_id"))
    stay = scratch.table(first.select("row_id").unionByName(sets.filter("n = 0").select("row_id")).withColumnRenamed("row_id", row_id), "stay")
    return rows.join(stay, row_id, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, once or twice. Rows without words are taken no
    times. Null sources are a source; null and repeated ids and repeated rows are rows of their own."""
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, repeated ones too; a null text counts as empty."""
    with _small_batches(spark):
        coded = bpe.encode_texts(docs, tokenizer_path(), fields=("n_tokens", "ids_sha256", "decoded_sha256"))
        return Scratch(spark, "bpe").table(coded, "coded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: The mix and the profiles aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        with Scratch.of_run(spark):  # what the stage writes on its way
            before, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(before)
    return docs
