"""The corpus pipeline: stages applied in order to ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm import decontam, neardup, pieces, quality, secrets
from curatorium.llm.registry import table
from curatorium.llm.store import name, settle, ship


def _others(docs: DataFrame):
    """All columns but the text as one, so that none can clash with what a stage adds."""
    return F.struct(*[F.col(name(c)) for c in docs.columns if c != "text"]).alias("others")


def _columns(docs: DataFrame, **replaced):
    return [replaced.get(c, F.col("text") if c == "text" else F.col(f"others.{name(c)}")).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality(docs.select(_others(docs), "text")).where("kept").select(*_columns(docs))


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _same(docs: DataFrame, found: DataFrame):
    """Rows of ``found`` (doc, key) meet the rows of their id and text; references by table, as docs may have columns of these names."""
    return docs["doc_id"].cast("long").eqNullSafe(found["doc"]) & (F.xxhash64(docs["text"]) == found["key"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of repeated rows one."""
    ship(spark)
    found = neardup.near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("doc"), F.col("text_key").alias("key"))
    found = settle(found.agg((F.count(F.lit(1)) > 1).alias("again")), "kept")
    once, again = found.where("not again"), found.where("again")
    kept = docs.join(once, _same(docs, once), "left_semi")
    # repeated rows: few texts pass the broadcast slots of their keys (a bounded number), so few are shuffled
    slot = lambda key: F.pmod(key, F.lit(1 << 20))
    slots = F.broadcast(again.select(slot(F.col("key")).alias("slot")).distinct())
    repeated = docs.join(slots, slot(F.xxhash64(docs["text"])) == slots["slot"], "left_semi").join(again, _same(docs, again), "left_semi")
    key = _unused(docs, "text_key")
    repeated = repeated.withColumn(key, F.xxhash64(docs["text"])).dropDuplicates(["doc_id", key]).drop(key)
    return kept.unionByName(repeated)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    ship(spark)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("doc"), F.col("text_key").alias("key")).distinct()
    return docs.join(found, _same(docs, found), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets masked; n_chars follows the new text."""
    ship(spark)
    masked = secrets.find_secrets(docs.select(_others(docs), "text"), redact=True).withColumnRenamed("redacted", "text")
    replaced = {}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        replaced["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(F.col("others.n_chars"))
    return masked.select(*_columns(docs, **replaced))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the ids of the text and their number."""
    ship(spark)
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.vocabulary())
    return coded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (label, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, label)
    return docs


#: Links of near copies, alignments and the automaton can't be said in SQL.
ORACLE_SQL = None
