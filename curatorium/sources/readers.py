"""Readers for the frozen JSON inputs; each parses a DataFrame of text so tests and jobs share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatorium.schemas import CATALOGUE, CORPUS_PAGE


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Curated rows from JSON lines or parquet with an explicit schema."""
    reader = spark.read.schema(CATALOGUE)
    return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)


def parse_keyed_map(texts: DataFrame, text: str, value_schema: T.StructType, key: str = "id") -> DataFrame:
    """One row per entry of a JSON object stored as text; the entry key becomes a column."""
    entries = F.from_json(F.col(text), T.MapType(T.StringType(), value_schema))
    return texts.select(F.explode(entries).alias(key, "v")).select(key, "v.*")


def read_keyed_map(spark: SparkSession, path: str, value_schema: T.StructType) -> DataFrame:
    return parse_keyed_map(spark.read.text(path, wholetext=True), "value", value_schema)


def explode_corpus(pages: DataFrame) -> DataFrame:
    """One row per result with its cell and page."""
    return pages.select(
        "cell_id",
        "requested_page",
        F.col("response.total_pages").alias("total_pages"),
        F.explode("response.results").alias("r"),
    ).select("cell_id", "requested_page", "total_pages", "r.*")


def read_paged_corpus(spark: SparkSession, path: str) -> DataFrame:
    return explode_corpus(spark.read.schema(CORPUS_PAGE).json(path))


def with_file_identity(df: DataFrame, pattern: str, out: str) -> DataFrame:
    """Identity carried by the file path, as the first group of ``pattern``."""
    return df.withColumn(out, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def is_strict_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else, with no member name twice in an object, escapes resolved.

    The parser behind ``try_parse_json`` refuses repeated names but ignores what follows a value.  A text that parses both as
    the only element of an array and as the only member of an object can hold nothing more: what would close one of them
    early is an error in the other.
    """
    alone = lambda before, after: F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull()
    return F.coalesce(alone("[", "]") & alone('{"v":', "}"), F.lit(False))


def read_artifact_files(spark: SparkSession, path: str, pattern: str = r"([^/]+)/[^/]+$", skip: str | None = None, names: str = "*.json") -> DataFrame:
    """(identity, file, text): every JSON file below a run folder as it is, identity from the path.

    Files are small and many: Spark packs them into tasks by size, no file is opened on the driver.  ``skip`` is a pattern of
    paths to leave out.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(path, wholetext=True)
    found = with_file_identity(files.select("value", "_metadata"), pattern, "identity").select("identity", F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return found.where(~F.col("file").rlike(skip)) if skip else found


def parse_artifacts(files: DataFrame, schema: T.StructType | str, named: str) -> DataFrame:
    """identity, file, problem, record: one row per file.

    problem is BAD_JSON (not one strict JSON value), IDENTITY_MISMATCH (the member ``named`` differs from the path), else null;
    the record is null where there is a problem.
    """
    record = F.from_json("text", schema)
    parsed = files.withColumn("record", F.when(is_strict_json(F.col("text")), record))
    problem = F.when(F.col("record").isNull(), "BAD_JSON").when(~F.col(f"record.{named}").cast("string").eqNullSafe(F.col("identity")), "IDENTITY_MISMATCH")
    parsed = parsed.withColumn("problem", problem)
    return parsed.select("identity", "file", "problem", F.when(F.col("problem").isNull(), F.col("record")).alias("record"))


def artifact_summary(parsed: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Per known identity with a file: artifacts, unusable ones, status (MATERIALIZED, REPEATED or UNUSABLE) and the first path.

    Files of unknown identities are left out, as an index of identities decides what counts.
    """
    held = parsed.join(known.select(F.col(key).cast("string").alias("identity")).distinct(), "identity", "left_semi")
    found = held.groupBy("identity").agg(F.count(F.lit(1)).alias("artifacts"), F.count("problem").alias("unusable"), F.min("file").alias("provenance"))
    status = F.when(F.col("unusable") == F.col("artifacts"), "UNUSABLE").when(F.col("artifacts") > 1, "REPEATED").otherwise("MATERIALIZED")
    return found.withColumn("status", status)


def read_artifact_directory(
    spark: SparkSession, path: str, schema: T.StructType | str, named: str, pattern: str = r"([^/]+)/[^/]+$", skip: str | None = None, names: str = "*.json"
) -> DataFrame:
    """All JSON artifacts below a run folder, one row per file: identity, file, problem, record."""
    return parse_artifacts(read_artifact_files(spark, path, pattern, skip, names), schema, named)


def is_incomplete(line: Column) -> Column:
    """Whether a JSON line stops inside a string or before its brackets close; a complete but wrong line does not."""
    bare = F.regexp_replace(F.regexp_replace(line, r"\\.", ""), r'"[^"]*"', "")
    outside = F.regexp_replace(bare, r'"[\s\S]*$', "")
    depth = F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))
    return bare.contains('"') | (depth > 0)


def ledger_status(
    lines: DataFrame, ledger: str, position: str, line: str, parsed: Column, ledgers: DataFrame | None = None, broken: DataFrame | None = None
) -> DataFrame:
    """Per ledger: VALID, EMPTY, TORN_TRAILING_RECORD or WAL_CORRUPTION.

    Torn means that only the last line is bad and that it is incomplete.  ``ledgers`` lists all ledgers, so that those
    without a line are EMPTY; ``broken`` lists those whose readable records fail the chain or the transitions.
    """
    marked = lines.withColumn("__bad", parsed.isNull())
    cut = F.col("__bad") & is_incomplete(F.col(line))
    summary = marked.groupBy(ledger).agg(
        F.count(position).alias("lines"),
        F.count_if("__bad").alias("bad"),
        F.max_by(cut, position).alias("torn"),
    )
    if ledgers is not None:
        summary = ledgers.select(ledger).distinct().join(summary, ledger, "left").na.fill(0, ["lines", "bad"])
    wrong = F.lit(False)
    if broken is not None:
        summary = summary.join(broken.select(ledger).distinct().withColumn("__broken", F.lit(True)), ledger, "left")
        wrong = F.coalesce("__broken", F.lit(False))
    status = (
        F.when(F.col("lines") == 0, "EMPTY")
        .when(wrong, "WAL_CORRUPTION")
        .when(F.col("bad") == 0, "VALID")
        .when((F.col("bad") == 1) & F.col("torn"), "TORN_TRAILING_RECORD")
        .otherwise("WAL_CORRUPTION")
    )
    return summary.select(ledger, "lines", "bad", status.alias("status"))


# the only names an identity reader may decode
IDENTITY_FIELDS = ["id", "candidateId", "canonicalId", "tmdbId", "title", "year", "imdbId", "wikidataId"]


def parse_identity(texts: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """Decode identity keys only; label fields are never parsed into columns."""
    unknown = set(fields) - set(IDENTITY_FIELDS)
    if unknown:
        raise ValueError(f"not identity fields: {sorted(unknown)}")
    schema = ", ".join(f"{name} {kind}" for name, kind in fields.items())
    return texts.select(F.from_json(F.col(text), schema).alias("i")).select("i.*")


def read_identity_only(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    return parse_identity(spark.read.text(path), "value", fields)
