"""The corpus pipeline: five stages, each a table in and a table out.

Each stage gets all that its predecessor kept, as written to Parquet, and returns the columns of documents (the last one
also rate and domain).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelframe.llm import decontam, jaccard, langid, mixing, pii
from panelframe.llm.common import staged

#: A text goes if no language holds this share of it.
MIN_LANGUAGE_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (`und`, so null and empty ones too) or without one that holds half of them; others stay unchanged.
    Each row, repeated or not, is judged by its own text. No column but doc_id, text and lang is looked at; an empty table stays empty."""
    columns = docs.columns
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    others = F.struct(*[c for c in columns if c != "text"]).alias("others")
    found = langid.language_mixture(docs.select("doc_id", "text", F.lit(False).alias("held_out"), others), model, also=("text", "others"))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.select(*["text" if c == "text" else f"others.{c}" for c in columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar documents stays: the one with the least doc_id (null comes last), then the least hash of
    its text; of equal rows one. Texts without words, null ones too, are similar to nothing and stay. Columns of any name go along."""
    found = jaccard.jaccard_components(docs).where("root is not null")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("k"))
    kept = least.select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_key").alias("kept_key"))
    rows = docs.where(jaccard.has_words()).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), F.struct(*docs.columns).alias("row"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    one = rows.join(kept, same, "leftsemi").dropDuplicates(["id", "key"])
    return one.select("row.*").unionByName(docs.where(~jaccard.has_words()))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; repeated rows go or stay together, rows without words stay. Columns of any name go along."""
    found = decontam.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select("row_key").distinct()
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.struct(*docs.columns).alias("row"))
    return rows.join(bad, "row_key", "leftanti").select("row.*")


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets; n_chars follows the text. A null text stays null; every row, repeated or
    empty, stays. Columns of any name go along."""
    found = pii.personal_data(docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("others")))
    out = found.withColumn("new_text", pii.redact(found))
    length = F.coalesce(F.length("new_text").cast("long"), F.col("others.n_chars")).alias("n_chars")
    return out.select(*[{"text": F.col("new_text").alias("text"), "n_chars": length}.get(c, F.col(f"others.{c}")) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds domain and rate; documents whose most likely domain has no target (the toxic ones) go, others stay with their rate, empty and
    null ones by the prior. Columns of any name go along, but for older ones named domain or rate."""
    boxed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = mixing.mixed(boxed, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    wanted = [d for d, share in mixing.TARGETS.items() if share > 0]
    columns = [F.col(f"row.{c}") for c in docs.columns if c not in ("domain", "rate")]
    return found.where(F.col("domain").isin(*wanted, "all")).select(*columns, "domain", F.round("rate", 6).alias("rate"))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("PII", personal_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: Stages 1, 4 and 5 learn from the data; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
