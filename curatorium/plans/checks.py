"""Rule checks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import hard, issue_text, joined, settle
from curatorium.operators import rules
from curatorium.plans.predicates import judged, readiness
from curatorium.plans.registry import query
from curatorium.sources.projections import CTES, Tables

ANOMALY_SQL = """CASE WHEN list_contains(moods, 'funny') AND emotional_weight = 'heavy' THEN 'FUNNY_HEAVY:moods' END,
  CASE WHEN list_contains(moods, 'relaxing') AND attention_demand = 'immersive' THEN 'RELAXING_IMMERSIVE:moods' END,
  CASE WHEN list_contains(moods, 'exciting') AND pace = 'slow' THEN 'SLOW_EXCITING:moods' END,
  CASE WHEN list_contains(moods, 'suspenseful') AND list_contains(situations, 'family') THEN 'SUSPENSEFUL_FAMILY:moods' END,
  CASE WHEN list_contains(situations, 'easy-watch') AND emotional_weight = 'heavy' THEN 'EASY_WATCH_HEAVY:situations' END"""


def _copy_sql(alias: str = "") -> str:
    parts = []
    for field, (low, high) in rules.COPY_LIMITS.items():
        parts.append(f"CASE WHEN length({field}) < {low} THEN 'COPY_TOO_SHORT:{field}' END")
        parts.append(f"CASE WHEN length({field}) > {high} THEN 'COPY_TOO_LONG:{field}' END")
    return ",\n  ".join(parts)


@query(
    "check_catalogue_row",
    ["catalogue"],
    f"""SELECT id, issues, regexp_matches(issues, 'COPY_|MALFORMED|INVALID') AS failed FROM (SELECT id, concat_ws('|',
     CASE WHEN tmdb_id < 1 THEN 'INVALID_NUMBER:tmdb_id' END, CASE WHEN palette[2] = '#zz0000' THEN 'MALFORMED_PALETTE:palette' END, {_copy_sql()}, {ANOMALY_SQL}) AS issues FROM catalogue)""",
)
def _(t):
    checked = settle(t.catalogue, issues=rules.check_catalogue_row())
    return checked.select("id", issue_text("issues").alias("issues"), (F.size(hard("issues")) > 0).alias("failed"))


@query(
    "check_facts_row",
    ["facts"],
    """SELECT id, concat_ws('|', CASE WHEN tmdb_id < 1 THEN 'INVALID_NUMBER:tmdb_id' END, CASE WHEN runtime_minutes < 1 THEN 'INVALID_NUMBER:runtime_minutes' END, CASE WHEN poster_path IS NULL THEN 'POSTER_UNAVAILABLE:poster_path' END) AS issues FROM facts""",
)
def _(t):
    return t.facts.select("id", issue_text(rules.check_facts_row()).alias("issues"))


@query(
    "check_batch",
    (),
    """SELECT batch_ord, 'DUPLICATE_CANDIDATE_ID' AS code, candidate AS value FROM (SELECT o_orderkey AS batch_ord, 'c' || o_custkey AS candidate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1
       UNION ALL SELECT batch_ord, 'DUPLICATE_TMDB_ID', CAST(tmdb AS VARCHAR) FROM (SELECT o_orderkey AS batch_ord, CAST(floor(o_totalprice) AS BIGINT) AS tmdb, row_number() OVER (PARTITION BY CAST(floor(o_totalprice) AS BIGINT) ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1""",
)
def _(t):
    batch = t.raw("orders").select(
        F.col("o_orderkey").alias("batch_ord"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("candidate"),
        F.floor("o_totalprice").cast("bigint").alias("tmdb"),
    )
    return rules.check_batch(batch, {"candidate": "DUPLICATE_CANDIDATE_ID", "tmdb": "DUPLICATE_TMDB_ID"}, "batch_ord")


@query("semantic_anomalies", ["catalogue"], f"SELECT id, concat_ws('|', {ANOMALY_SQL}) AS flags FROM catalogue")
def _(t):
    return t.catalogue.select("id", issue_text(rules.semantic_anomalies()).alias("flags"))


CARDINALITY_SQL = "CASE WHEN len(moods) IN (1, 3) THEN 'MOOD_CARDINALITY_REVIEW:moods' END, CASE WHEN len(situations) IN (1, 4) THEN 'SITUATION_CARDINALITY_REVIEW:situations' END"


@query("cardinality_flags", ["catalogue"], f"SELECT id, concat_ws('|', {CARDINALITY_SQL}) AS flags FROM catalogue")
def _(t):
    return t.catalogue.select("id", issue_text(rules.cardinality_flags()).alias("flags"))


def classifications(t: Tables) -> DataFrame:
    """Classification outputs whose evidence is weakened by runtime, title and year."""
    minutes = F.col("runtime_minutes")
    entry = F.struct(
        F.when(minutes >= 160, "too short").otherwise("a rationale long enough").alias("rationale"),
        F.when(minutes == 158, F.array().cast("array<string>")).otherwise(F.array(F.lit("overview"))).alias("source_refs"),
        F.when(minutes >= 100, "direct").when(minutes == 98, "guess").otherwise("supported-inference").alias("mode"),
        F.when(minutes == 96, F.array(F.lit("only one cue"))).when(minutes == 156, F.array().cast("array<string>")).when(minutes == 154, F.array(F.lit("tiny")))
        .otherwise(F.array(F.lit("first factual cue"), F.lit("second factual cue"))).alias("cues"),
        F.when(minutes == 94, F.lit(None)).otherwise("a bridge to the judgment").alias("bridge"),
    )
    tags = F.concat(
        F.col("moods"), F.col("situations"),
        F.when(F.col("pace") == "medium", F.array(*[F.lit(f) for f in ("pace", "emotional_weight", "attention_demand")]))
        .otherwise(F.array(*[F.lit(f) for f in ("pace", "emotional_weight", "attention_demand", "discovery_style")])),
    )
    return t.catalogue.withColumns(
        {
            "schema_version": F.when(F.col("year") == 1980, "semantic-output.v0").otherwise("semantic-output.v2"),
            "evidence": F.map_from_entries(F.transform(tags, lambda g: F.named_struct(F.lit("key"), g, F.lit("value"), entry))),
            "confidence": F.create_map(F.lit("pace"), F.when(F.col("year") == 1981, 1.5).otherwise(0.5)),
        }
    )


@query(
    "check_classification",
    ["catalogue"],
    f"""SELECT id, concat_ws('|', CASE WHEN year = 1980 THEN 'INVALID_SCHEMA_VERSION:schema_version' END, CASE WHEN pace = 'medium' THEN 'INVALID_SEMANTIC_EVIDENCE:evidence' END,
    CASE WHEN runtime_minutes >= 160 THEN 'EVIDENCE_RATIONALE_TOO_SHORT:evidence' END, CASE WHEN runtime_minutes = 158 THEN 'MISSING_SOURCE_REFS:evidence' END,
    CASE WHEN runtime_minutes = 98 THEN 'INVALID_GROUNDING_MODE:evidence' END, CASE WHEN runtime_minutes = 154 THEN 'EVIDENCE_CUE_TOO_SHORT:evidence' END,
    CASE WHEN runtime_minutes = 156 THEN 'TOO_FEW_DIRECT_EVIDENCE_CUES:evidence' END, CASE WHEN runtime_minutes = 96 THEN 'TOO_FEW_SUPPORTED_INFERENCE_CUES:evidence' END,
    CASE WHEN runtime_minutes = 94 THEN 'MISSING_SUPPORTED_INFERENCE_BRIDGE:evidence' END, CASE WHEN year = 1981 THEN 'INVALID_SELF_CONFIDENCE:confidence' END,
    {ANOMALY_SQL}, {CARDINALITY_SQL}) AS issues FROM catalogue""",
)
def _(t):
    return classifications(t).select("id", issue_text(rules.check_classification(["semantic-output.v1", "semantic-output.v2"])).alias("issues"))


@query(
    "check_json_schema",
    ["review"],
    "SELECT candidate_id, CASE WHEN disposition = 'SCHEMA_INVALID' THEN '$.riskLevel: enum' ELSE '' END AS errors FROM review WHERE disposition NOT IN ('PROVIDER_FAILURE', 'MALFORMED_JSON')",
)
def _(t):
    return judged(t).where(F.col("doc").isNotNull()).select("candidate_id", joined("schema_errors").alias("errors"))


@query(
    "check_risk_payload",
    ["review"],
    """SELECT candidate_id, CASE disposition WHEN 'SEMANTICALLY_INVALID' THEN 'LOW_RISK_REQUIRES_EMPTY_CATEGORIES' WHEN 'SCHEMA_INVALID' THEN 'INVALID_RISK_LEVEL'
       WHEN 'PROVIDER_FAILURE' THEN 'MALFORMED_PAYLOAD' WHEN 'MALFORMED_JSON' THEN 'MALFORMED_PAYLOAD' ELSE '' END AS failures FROM review""",
)
def _(t):
    return judged(t).select("candidate_id", joined("failures").alias("failures"))


def _rx(phrases: list[str]) -> str:
    return r"(?i)\b(?:" + "|".join(phrases).replace("'", "''") + r")\b"


def _editorial_sql(text: dict[str, str]) -> str:
    parts = []
    for field, (low, high) in rules.COPY_LIMITS.items():
        v = text[field]
        parts += [
            f"CASE WHEN {v} = '' THEN 'MISSING_REQUIRED_FIELD:{field}' END",
            f"CASE WHEN length({v}) < {low} THEN 'COPY_TOO_SHORT:{field}' END",
            f"CASE WHEN length({v}) > {high} THEN 'COPY_TOO_LONG:{field}' END",
            rf"CASE WHEN regexp_matches({v}, '(?i)\bTODO\b|placeholder') THEN 'PLACEHOLDER_COPY:{field}' END",
            f"CASE WHEN regexp_matches({v}, '{_rx(rules.META_PHRASES)}') THEN 'MODEL_OR_META_LANGUAGE:{field}' END",
            f"CASE WHEN regexp_matches({v}, '{_rx(rules.SPOILER_PHRASES)}') THEN 'SPOILER_PATTERN_REVIEW:{field}' END",
            f"CASE WHEN regexp_matches({v}, '{_rx(rules.GENERIC_PHRASES)}') THEN 'GENERIC_LANGUAGE_REVIEW:{field}' END",
        ]
    return ",\n".join(parts)


# editorial copy cut from catalogue texts, with phrases planted by pace, weight and style
CTES["editorial"] = (
    ("catalogue",),
    """SELECT id, ord, title, languages[1] AS language, genres, year,
  description || CASE WHEN pace = 'slow' THEN ', a tour de force that delves into quiet corners of the workshop' WHEN pace = 'fast' THEN ' and as an AI I cannot say more about it, TODO' ELSE '' END AS description,
  why_watch || CASE WHEN emotional_weight = 'heavy' THEN ', and in the end the final twist lands with warm, slow, and steady care' ELSE '' END AS why_watch,
  CASE WHEN discovery_style = 'familiar' THEN description || '?' ELSE curiosity_hook END AS curiosity_hook, vibe_summary FROM catalogue""",
)


def editorial(t: Tables) -> DataFrame:
    c = t.catalogue
    return c.select(
        "id", "ord", "title", F.element_at("languages", 1).alias("language"), "genres", "year",
        F.concat(
            "description",
            F.when(F.col("pace") == "slow", ", a tour de force that delves into quiet corners of the workshop")
            .when(F.col("pace") == "fast", " and as an AI I cannot say more about it, TODO").otherwise(""),
        ).alias("description"),
        F.concat(
            "why_watch",
            F.when(F.col("emotional_weight") == "heavy", ", and in the end the final twist lands with warm, slow, and steady care").otherwise(""),
        ).alias("why_watch"),
        F.when(F.col("discovery_style") == "familiar", F.concat("description", F.lit("?"))).otherwise(F.col("curiosity_hook")).alias("curiosity_hook"),
        "vibe_summary",
    )


DUPLICATE_SQL = """(SELECT len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) FROM (SELECT list_distinct(regexp_extract_all(lower(description), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(curiosity_hook), '[a-z0-9]+')) AS b)) >= 0.72"""


@query(
    "check_editorial",
    ["editorial"],
    f"""SELECT id, concat_ws('|', {_editorial_sql({f: f for f in rules.COPY_LIMITS})}, CASE WHEN {DUPLICATE_SQL} THEN 'DESCRIPTION_HOOK_DUPLICATION:curiosity_hook' END) AS issues FROM editorial""",
)
def _(t):
    return editorial(t).select("id", issue_text(rules.check_editorial()).alias("issues"))


@query(
    "check_critic",
    ["review"],
    """SELECT candidate_id, concat_ws('|', CASE WHEN lang = 'fr' THEN 'INVALID_ENUM:verdict' END, CASE WHEN n_chars < 400 THEN 'INVALID_ENUM:specificity' END,
       CASE WHEN severity = 'SEVERE' THEN 'INVALID_ENUM:layoutFit' END, CASE WHEN source = 'src5' THEN 'CRITIC_DEPENDS_ON_WRITER_REASONING:writerReasoning' END) AS issues FROM review""",
)
def _(t):
    grades = F.create_map(
        *[
            v
            for a in rules.ASSESSMENTS
            for v in (
                F.lit(a),
                F.when((F.col("n_chars") < 400) if a == "specificity" else F.lit(False), "great")
                .when((F.col("severity") == "SEVERE") if a == "layoutFit" else F.lit(False), F.lit(None).cast("string"))
                .otherwise("pass"),
            )
        ]
    )
    verdict = F.when(F.col("lang") == "fr", "fine").otherwise("needs_review")
    keys = F.when(F.col("source") == "src5", F.array(F.lit("verdict"), F.lit("writerNotes"))).otherwise(F.array(F.lit("verdict")))
    return t.review.select("candidate_id", issue_text(rules.check_critic(verdict, grades, keys)).alias("issues"))


@query(
    "summarize_validation",
    ["catalogue", "readiness"],
    f"""per AS (SELECT id, issues, len(list_filter(string_split(issues, '|'), lambda i: i <> '' AND regexp_matches(i, 'COPY_|MALFORMED|INVALID'))) AS h, len(list_filter(string_split(issues, '|'), lambda i: i <> '' AND NOT regexp_matches(i, 'COPY_|MALFORMED|INVALID'))) AS f
        FROM (SELECT id, concat_ws('|', CASE WHEN tmdb_id < 1 THEN 'INVALID_NUMBER:tmdb_id' END, CASE WHEN palette[2] = '#zz0000' THEN 'MALFORMED_PALETTE:palette' END, {_copy_sql()}, {ANOMALY_SQL}) AS issues FROM catalogue)
        UNION ALL SELECT id, '', hard_n, flag_n FROM readiness)
     SELECT id, sum(h)::BIGINT AS hard_failures, sum(f)::BIGINT AS review_flags, sum(h) = 0 AS ok FROM per GROUP BY id""",
)
def _(t):
    rows = settle(t.catalogue, issues=rules.check_catalogue_row()).select("id", "issues")
    return rules.summarize_validation(rows.unionByName(readiness(t).select("id", "issues")), "id")
