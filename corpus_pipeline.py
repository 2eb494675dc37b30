"""Corpus preparation as a chain of stages, registered as the query ``pipeline``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that the one
before it kept; ``run`` writes every stage's result as Parquet to the session's
shared folder and reads it back as the next one's documents.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.llm import decontaminate, lines, neardup, pieces, toxicity
from vendorlytics.llm.storage import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _rows(docs: DataFrame) -> DataFrame:
    """A key for each row, that the operators' results carry beside ``doc_id``: rows
    that share id and text share it too and fare alike."""
    return docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))


def _same(a: str, b: str) -> list:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in ("doc_id", "text_hash")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    tagger = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.tag(docs, tagger, keep=COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier go, and documents of which nothing else is left
    (all their lines stand in others)."""
    out = lines.deduplicate(docs.select(*COLUMNS))
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where((F.col("n_removed") == 0) | left).select(
        "doc_id", "text", "lang", "source",
        F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest
    id; equal rows become one, and a row without id stays."""
    kept = neardup.link(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = docs.select(*COLUMNS)
    without_id = one.where("doc_id IS NULL")
    return one.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS).unionByName(without_id)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")).where("contaminated") \
        .select("doc_id", "text_hash").distinct()
    return _rows(docs).alias("d").join(found.alias("f"), _same("d", "f"), "left_anti").select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the whole texts, their number, and whether they decode to the text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(docs.select(*COLUMNS), path, decoded="decoded")
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_neardup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

# Toxicity learns a model, MinHash hashes and SentencePiece merges: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
