"""Derived bands, eligibility with reasons, normalization and routing decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatorium.functions.columns import digest, hard, reasons, word_count

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def year_of(date_text: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(date_text, F.lit("")), r"^([0-9]{4})", 1)
    return F.when(digits != "", digits.cast("int"))


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def popularity_band(votes: Column) -> Column:
    return F.when(votes >= 1000, "mainstream").when(votes >= 500, "familiar").otherwise("discovery")


def era(year: Column) -> Column:
    return (
        F.when(year < 1970, "pre-1970").when(year < 1990, "1970-1989").when(year < 2010, "1990-2009").otherwise("2010-present")
    )


def runtime_band(minutes: Column) -> Column:
    return F.when(minutes < 90, "under-90").when(minutes <= 120, "90-120").otherwise("over-120")


def vote_coverage_band(votes: Column) -> Column:
    return F.when(votes < 200, "lt-200").when(votes <= 800, "200-800").otherwise("gt-800")


def discovery_eligible(decades: Sequence[str], minimum_votes: int = 200) -> Column:
    """Poster and usable overview present, neither adult nor softcore, a wanted decade, enough votes."""
    return F.coalesce(
        ~F.coalesce(F.col("adult"), F.lit(False))
        & ~F.coalesce(F.col("softcore"), F.lit(False))
        & (F.coalesce(F.col("poster_path"), F.lit("")) != "")
        & (F.length(F.trim("overview")) >= 30)
        & decade(F.col("year")).isin(*decades)
        & (F.col("votes") >= minimum_votes),
        F.lit(False),
    )


def eligibility_reasons(votes: Column, date: Column, low=200, high=2000, first="1980-01-01", last="2024-12-31") -> Column:
    """Why a row may not enter selection; empty means eligible."""
    dated = F.coalesce(date.rlike(ISO_DATE), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(votes.isNull(), "MISSING_OR_NON_NUMERIC_VOTE_COUNT").when(
                ~votes.between(low, high), F.concat(F.lit("VOTE_COUNT_OUT_OF_BOUNDS: "), votes.cast("string"))
            ),
            F.when(~dated, "MISSING_OR_INVALID_RELEASE_DATE_FORMAT")
            .when(date > last, F.concat(F.lit("RELEASE_DATE_EXCEEDS_MAX: "), date))
            .when(date < first, F.concat(F.lit("RELEASE_DATE_BEFORE_MIN: "), date)),
        )
    )


def normalize_search_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") > 0).select(
        "id",
        F.coalesce("title", F.lit("")).alias("title"),
        year_of(F.col("release_date")).alias("year"),
        F.coalesce("overview", F.lit("")).alias("overview"),
    )


def _clean(names: Column) -> Column:
    """Trimmed, non-empty, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda v: F.trim(v)), lambda v: v != "")))


def normalize_facts(api: DataFrame) -> DataFrame:
    """API rows to fact rows; ``rejected`` names the missing required fields."""
    directors = F.array_distinct(
        F.filter(F.transform(F.filter("crew", lambda c: c["job"] == "Director"), lambda c: F.trim(c["name"])), lambda n: n != "")
    )
    facts = api.select(
        F.col("id").alias("tmdb_id"),
        F.trim("title").alias("title"),
        year_of(F.col("release_date")).alias("year"),
        F.array_join(directors, " & ").alias("director"),
        _clean(F.col("production_countries")).alias("countries"),
        _clean(F.transform("spoken_languages", lambda s: F.coalesce(F.nullif(F.trim(s["english_name"]), F.lit("")), s["name"]))).alias("spoken_languages"),
        _clean(F.col("genres")).alias("genres"),
        F.col("runtime").alias("runtime_minutes"),
        F.col("poster_path"),
    )
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return facts.withColumn(
        "rejected",
        reasons(
            (blank("title"), "title"),
            (F.col("year").isNull(), "year"),
            (blank("director"), "director"),
            (none("countries"), "countries"),
            (none("spoken_languages"), "spoken_languages"),
            (none("genres"), "genres"),
            (F.coalesce(F.col("runtime_minutes"), F.lit(0)) <= 0, "runtime_minutes"),
        ),
    )


def project_whitelist(df: DataFrame, spec: dict[str, tuple[str, Column]], out: str = "packet") -> DataFrame:
    """Struct of named fields only, each with a default for missing values."""
    fields = [F.coalesce(F.col(source), default).alias(name) for name, (source, default) in spec.items()]
    return df.withColumn(out, F.struct(*fields))


def forbidden_schema_paths(schema: T.DataType, forbidden: set[str], path: str = "") -> list[str]:
    """Paths of a schema whose field name is forbidden, at any depth."""
    if isinstance(schema, T.StructType):
        found = []
        for field in schema.fields:
            here = f"{path}.{field.name}" if path else field.name
            if field.name in forbidden:
                found.append(here)
            found += forbidden_schema_paths(field.dataType, forbidden, here)
        return found
    if isinstance(schema, T.ArrayType):
        return forbidden_schema_paths(schema.elementType, forbidden, f"{path}[]")
    if isinstance(schema, T.MapType):
        return forbidden_schema_paths(schema.valueType, forbidden, f"{path}{{}}")
    return []


def assert_no_forbidden_columns(df: DataFrame, forbidden: set[str]) -> DataFrame:
    bad = forbidden_schema_paths(df.schema, forbidden)
    if bad:
        raise ValueError(f"forbidden fields: {', '.join(bad)}")
    return df


def forbidden_json_keys(df: DataFrame, text: str, pattern: str, key: str) -> DataFrame:
    """(row key, object key) for JSON texts with a key matching the pattern, at any depth."""
    keys = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1))
    return df.select(key, F.explode(keys).alias("forbidden_key")).where(F.col("forbidden_key").rlike(pattern))


def classify_readiness(hard_failures: Column, review_flags: Column) -> Column:
    return (
        F.when(F.size(hard_failures) > 0, "BLOCKED")
        .when(F.size(review_flags) > 0, "NEEDS_TARGETED_REVIEW")
        .otherwise("AUTOMATICALLY_READY")
    )


def route_record(structural: Column, repair: Column, provenance: Column, risk: Column, production: Column, conflict: Column) -> Column:
    """Quarantine failures first, then human review, then auto-eligible; all else is quarantined."""
    sound = (structural == "PASS") | (repair == "PASS")
    return (
        F.when((repair == "FAILED") | (production == "UNSAFE_TO_EVALUATE"), "QUARANTINED")
        .when((risk == "HIGH_RISK") | conflict, "HUMAN_REVIEW_REQUIRED")
        .when(sound & (provenance == "COMPLETE") & (risk == "LOW_RISK") & (production == "PASS"), "AUTO_ELIGIBLE")
        .otherwise("QUARANTINED")
    )


CRITICAL_CODES = ["POSTER_UNAVAILABLE", "SPOILER_HARD_FAILURE", "LAYOUT_HARD_FAILURE"]


def review_priority(issue_array: Column) -> Column:
    flags = F.filter(issue_array, lambda i: i["severity"] != "hard_fail")
    return (
        F.when(F.size(hard(issue_array)) > 0, "P0")
        .when(F.exists(flags, lambda i: i["code"].isin(*CRITICAL_CODES)), "P1")
        .when(F.size(flags) > 0, "P2")
        .otherwise("P4")
    )


def review_status(priority: Column) -> Column:
    return F.when(priority == "P0", "blocked").when(priority == "P4", "candidate_for_batch_approval").otherwise("needs_review")


SUBSTANTIVE_FAILURES = ["IDENTITY_UNRESOLVED", "NO_MATCHING_SECTION", "EMPTY_SECTION"]


def evidence_viability(text: Column, failure: Column, minimum: int = 150) -> Column:
    """VIABLE / NON_VIABLE; a technical failure is neither and stops the job."""
    return (
        F.when(text.isNotNull(), F.when(word_count(text) >= minimum, "VIABLE").otherwise("NON_VIABLE"))
        .when(failure.isin(*SUBSTANTIVE_FAILURES), "NON_VIABLE")
        .otherwise(F.raise_error(F.concat(F.lit("technical result cannot be classified: "), F.coalesce(failure, F.lit("unknown")))))
    )


# Fixed blocklist of keywords that say nothing about a work.
BLOCKED_KEYWORDS = ["woman director", "duringcreditsstinger", "aftercreditsstinger", "based on novel or book"]


def useful_keywords(keywords: Column, limit: int = 12) -> Column:
    trimmed = F.transform(keywords, lambda k: F.trim(k))
    return F.slice(F.filter(trimmed, lambda k: (k != "") & ~F.lower(k).isin(*BLOCKED_KEYWORDS)), 1, limit)


PACKET_FACTS = ["title", "year", "director", "genres", "runtime_minutes", "countries", "spoken_languages"]


def build_evidence_packet(facts: DataFrame, version: str = "facts_hash") -> DataFrame:
    """Facts, usable overview, provenance, grounding flag and content hash per record."""
    overview = F.when(F.length(F.trim("overview")) >= 30, F.trim("overview"))
    return (
        facts.withColumn("overview", overview)
        .withColumn(version, digest(*PACKET_FACTS))
        .withColumn(
            "provenance",
            F.array_compact(F.array(F.lit("facts"), F.when(F.col("overview").isNotNull(), F.lit("overview")))),
        )
        .withColumn("insufficient_grounding", F.col("overview").isNull())
        .withColumn("input_hash", digest("tmdb_id", "overview", *PACKET_FACTS))
    )
