"""Bands, eligibility, normalization, packets and routing over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import joined, settle
from curatorium.operators import predicates as P
from curatorium.operators import rules
from curatorium.plans.registry import query
from curatorium.sources.projections import CTES, Tables

DECADES = ["1980s", "1990s", "2000s", "2010s", "2020s"]

CTES["pool_facts"] = (
    ("facts", "exclusions"),
    """SELECT f.* FROM facts f WHERE NOT COALESCE(adult, false) AND NOT COALESCE(softcore, false) AND COALESCE(poster_path, '') <> '' AND length(trim(overview)) >= 30
       AND year BETWEEN 1980 AND 2029 AND votes >= 200 AND NOT EXISTS (SELECT 1 FROM exclusions e WHERE e.id = f.tmdb_id)""",
)


def pool_facts(t: Tables) -> DataFrame:
    held = t.exclusions.select(F.col("id").alias("tmdb_id")).distinct()
    return t.facts.where(P.discovery_eligible(DECADES)).join(held, "tmdb_id", "left_anti")


@query("filter_discovery_eligible", ["pool_facts"], "SELECT tmdb_id, title, votes FROM pool_facts")
def _(t):
    return pool_facts(t).select("tmdb_id", "title", "votes")


# votes and dates stretched so that all reasons occur
CTES["eligibility"] = (
    ("facts",),
    """SELECT tmdb_id, CASE WHEN runtime_minutes = 0 THEN NULL WHEN pmod_size < 8 THEN votes // 10 ELSE votes * 2 END AS votes,
      CASE WHEN poster_path IS NULL THEN 'unknown' WHEN year < 1983 THEN (year - 10) || '-05-01' WHEN year > 2022 THEN (year + 5) || '-05-01' ELSE release_date END AS release_date
      FROM (SELECT *, tmdb_id % 40 AS pmod_size FROM facts)""",
)


@query(
    "eligibility_with_reasons",
    ["eligibility"],
    """SELECT tmdb_id, reasons = '' AS eligible, reasons FROM (SELECT tmdb_id, concat_ws('|',
     CASE WHEN votes IS NULL THEN 'MISSING_OR_NON_NUMERIC_VOTE_COUNT' WHEN votes NOT BETWEEN 200 AND 2000 THEN 'VOTE_COUNT_OUT_OF_BOUNDS: ' || votes END,
     CASE WHEN release_date = 'unknown' THEN 'MISSING_OR_INVALID_RELEASE_DATE_FORMAT' WHEN release_date > '2024-12-31' THEN 'RELEASE_DATE_EXCEEDS_MAX: ' || release_date
          WHEN release_date < '1980-01-01' THEN 'RELEASE_DATE_BEFORE_MIN: ' || release_date END) AS reasons FROM eligibility)""",
)
def _(t):
    rows = eligibility(t)
    found = P.eligibility_reasons(F.col("votes"), F.col("release_date"))
    return rows.select("tmdb_id", (F.size(found) == 0).alias("eligible"), joined(found).alias("reasons"))


def eligibility(t: Tables) -> DataFrame:
    year = F.col("year")
    return t.facts.select(
        "tmdb_id",
        F.when(F.col("runtime_minutes") == 0, F.lit(None))
        .when(F.col("tmdb_id") % 40 < 8, F.floor(F.col("votes") / 10).cast("bigint"))
        .otherwise(F.col("votes") * 2)
        .alias("votes"),
        F.when(F.col("poster_path").isNull(), "unknown")
        .when(year < 1983, F.concat((year - 10).cast("string"), F.lit("-05-01")))
        .when(year > 2022, F.concat((year + 5).cast("string"), F.lit("-05-01")))
        .otherwise(F.col("release_date"))
        .alias("release_date"),
    )


@query(
    "normalize_search_rows",
    (),
    """SELECT p_partkey - 3 AS id, CASE WHEN p_size < 5 THEN '' ELSE p_name END AS title,
      CAST(CASE WHEN p_size < 40 THEN 1980 + p_partkey % 45 END AS INT) AS year, CASE WHEN p_type = 'LARGE' THEN '' ELSE p_brand END AS overview
      FROM part WHERE p_partkey - 3 > 0""",
)
def _(t):
    size = F.col("p_size")
    raw = t.raw("part").select(
        (F.col("p_partkey") - 3).alias("id"),
        F.when(size >= 5, F.col("p_name")).alias("title"),
        F.when(size < 40, F.concat((F.lit(1980) + F.col("p_partkey") % 45).cast("string"), F.lit("-07"))).otherwise("soon").alias("release_date"),
        F.when(F.col("p_type") != "LARGE", F.col("p_brand")).alias("overview"),
    )
    return P.normalize_search_rows(raw)


@query(
    "normalize_facts",
    (),
    """SELECT p_partkey AS tmdb_id, p_name AS title, CAST(CASE WHEN p_size <> 44 THEN 1980 + p_partkey % 45 END AS INT) AS year,
      CASE WHEN p_size = 45 THEN '' WHEN p_size % 2 = 0 THEN 'Ann ' || p_partkey % 9 || ' & Bob' ELSE 'Ann ' || p_partkey % 9 END AS director,
      CASE WHEN p_type = 'PROMO' THEN 'Chile|Peru' ELSE 'Peru' END AS countries, CASE WHEN p_size = 43 THEN '' ELSE 'English|Suomi' END AS spoken_languages,
      array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') AS genres, 70 + 2 * p_size AS runtime_minutes,
      CASE WHEN p_size = 43 THEN 'spoken_languages' WHEN p_size = 44 THEN 'year' WHEN p_size = 45 THEN 'director' ELSE '' END AS rejected FROM part""",
)
def _(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    member = lambda job, name: F.struct(F.lit(job).alias("job"), name.alias("name"))
    ann = F.concat(F.lit(" Ann "), (key % 9).cast("string"))
    crew = F.when(size == 45, F.array(member("Writer", F.lit("Cy")))).when(
        size % 2 == 0, F.array(member("Director", ann), member("Writer", F.lit("Cy")), member("Director", F.lit("Bob ")), member("Director", ann))
    ).otherwise(F.array(member("Director", ann), member("Producer", F.lit("Di"))))
    spoken = lambda english, name: F.struct(F.lit(english).alias("english_name"), F.lit(name).alias("name"))
    api = t.raw("part").select(
        key.alias("id"),
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("title"),
        F.when(size != 44, F.concat((F.lit(1980) + key % 45).cast("string"), F.lit("-02-03"))).alias("release_date"),
        crew.alias("crew"),
        F.when(F.col("p_type") == "PROMO", F.array(F.lit("Peru"), F.lit(" Chile "), F.lit("Peru"))).otherwise(F.array(F.lit("Peru "))).alias("production_countries"),
        F.when(size == 43, F.array(spoken(" ", " "))).otherwise(F.array(spoken("", "Suomi"), spoken("English", "English"))).alias("spoken_languages"),
        F.split("p_name", " ").alias("genres"),
        (F.lit(70) + size * 2).alias("runtime"),
        F.lit(None).cast("string").alias("poster_path"),
    )
    out = P.normalize_facts(api).drop("poster_path")
    return out.withColumns({c: joined(c) for c in ("countries", "spoken_languages", "genres", "rejected")})


def _blind_spec() -> dict[str, tuple[str, Column]]:
    return {
        "candidateId": ("candidate_id", F.lit("")),
        "tmdbId": ("tmdb_id", F.lit(0).cast("bigint")),
        "language": ("lang", F.lit("unknown")),
        "length": ("n_chars", F.lit(0).cast("bigint")),
    }


@query(
    "project_blind_packet",
    ["review"],
    """SELECT candidate_id, '{"candidateId":"' || candidate_id || '","tmdbId":' || tmdb_id || ',"language":"' || lang || '","length":' || n_chars || '}' AS packet FROM review""",
)
def _(t):
    packets = P.project_whitelist(t.review, _blind_spec())
    P.assert_no_forbidden_columns(packets.select("packet"), {"human_decision", "severity", "disposition", "model_fields"})
    return packets.select("candidate_id", F.to_json("packet").alias("packet"))


@query(
    "assert_no_forbidden_columns",
    ["review"],
    "SELECT candidate_id, unnest(['humanDecision', 'riskLevel']) AS forbidden_key FROM review WHERE severity = 'MINOR' UNION ALL SELECT candidate_id, 'riskLevel' FROM review WHERE severity = 'SEVERE'",
)
def _(t):
    nested = F.when(F.col("severity") == "MINOR", F.to_json(F.named_struct(F.lit("id"), F.col("candidate_id"), F.lit("x"), F.array(F.named_struct(F.lit("humanDecision"), F.lit("a"), F.lit("riskLevel"), F.lit("b")))))).when(
        F.col("severity") == "SEVERE", F.to_json(F.named_struct(F.lit("riskLevel"), F.lit("humanDecision")))
    ).otherwise(F.to_json(F.named_struct(F.lit("id"), F.col("candidate_id"))))
    return P.forbidden_json_keys(t.review.select("candidate_id", nested.alias("text")), "text", "^(humanDecision|riskLevel|severity)$", "candidate_id")


@query("band_decade", ["facts"], "SELECT (year // 10 * 10) || 's' AS band, count(*) AS n FROM facts GROUP BY 1")
def _(t):
    return t.facts.groupBy(P.decade(F.col("year")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("band_popularity", ["facts"], "SELECT tmdb_id, CASE WHEN votes >= 1000 THEN 'mainstream' WHEN votes >= 500 THEN 'familiar' ELSE 'discovery' END AS band FROM facts")
def _(t):
    return t.facts.select("tmdb_id", P.popularity_band(F.col("votes")).alias("band"))


@query("band_era", ["facts"], "SELECT tmdb_id, CASE WHEN year - 25 < 1970 THEN 'pre-1970' WHEN year - 25 < 1990 THEN '1970-1989' WHEN year - 25 < 2010 THEN '1990-2009' ELSE '2010-present' END AS band FROM facts")
def _(t):
    return t.facts.select("tmdb_id", P.era(F.col("year") - 25).alias("band"))


@query("band_runtime", ["facts"], "SELECT tmdb_id, CASE WHEN runtime_minutes < 90 THEN 'under-90' WHEN runtime_minutes <= 120 THEN '90-120' ELSE 'over-120' END AS band FROM facts")
def _(t):
    return t.facts.select("tmdb_id", P.runtime_band(F.col("runtime_minutes")).alias("band"))


@query("band_vote_coverage", ["facts"], "SELECT tmdb_id, CASE WHEN votes < 200 THEN 'lt-200' WHEN votes <= 800 THEN '200-800' ELSE 'gt-800' END AS band FROM facts")
def _(t):
    return t.facts.select("tmdb_id", P.vote_coverage_band(F.col("votes")).alias("band"))


CTES["readiness"] = (
    ("facts",),
    """SELECT *, CASE WHEN runtime_minutes < 1 THEN 1 ELSE 0 END + CASE WHEN tmdb_id < 1 THEN 1 ELSE 0 END AS hard_n,
      CASE WHEN poster_path IS NULL THEN 1 ELSE 0 END + CASE WHEN length(trim(overview)) < 30 THEN 1 ELSE 0 END AS flag_n FROM facts""",
)
READINESS_SQL = "CASE WHEN hard_n > 0 THEN 'BLOCKED' WHEN flag_n > 0 THEN 'NEEDS_TARGETED_REVIEW' ELSE 'AUTOMATICALLY_READY' END"


def readiness(t: Tables) -> DataFrame:
    """Facts with their rule results, grounding flag and readiness."""
    grounding = rules.issues(rules.issue("review", "INSUFFICIENT_GROUNDING", "evidence_packet", F.length(F.trim("overview")) < 30))
    checked = settle(t.facts, issues=F.concat(rules.check_facts_row(), grounding))
    flags = F.filter("issues", lambda i: i["severity"] != "hard_fail")
    return checked.withColumn("readiness", P.classify_readiness(F.filter("issues", lambda i: i["severity"] == "hard_fail"), flags))


@query("classify_readiness", ["readiness"], f"SELECT tmdb_id, {READINESS_SQL} AS readiness FROM readiness")
def _(t):
    return readiness(t).select("tmdb_id", "readiness")


@query(
    "review_priority",
    ["readiness"],
    """SELECT tmdb_id, priority, CASE priority WHEN 'P0' THEN 'blocked' WHEN 'P4' THEN 'candidate_for_batch_approval' ELSE 'needs_review' END AS status
       FROM (SELECT tmdb_id, CASE WHEN hard_n > 0 THEN 'P0' WHEN poster_path IS NULL THEN 'P1' WHEN flag_n > 0 THEN 'P2' ELSE 'P4' END AS priority FROM readiness)""",
)
def _(t):
    ranked = readiness(t).withColumn("priority", P.review_priority(F.col("issues")))
    return ranked.select("tmdb_id", "priority", P.review_status(F.col("priority")).alias("status"))


CTES["routing"] = (
    ("review",),
    """SELECT *, CASE WHEN repair = 'FAILED' OR production = 'UNSAFE_TO_EVALUATE' THEN 'QUARANTINED' WHEN risk = 'HIGH_RISK' OR conflict THEN 'HUMAN_REVIEW_REQUIRED'
       WHEN (structural = 'PASS' OR repair = 'PASS') AND provenance = 'COMPLETE' AND risk = 'LOW_RISK' AND production = 'PASS' THEN 'AUTO_ELIGIBLE' ELSE 'QUARANTINED' END AS route
       FROM (SELECT *, CASE WHEN disposition = 'SCHEMA_INVALID' THEN 'FAIL' ELSE 'PASS' END AS structural,
        CASE WHEN disposition = 'MALFORMED_JSON' THEN 'FAILED' WHEN disposition = 'SCHEMA_INVALID' AND n_chars > 100 THEN 'PASS' ELSE 'NOT_NEEDED' END AS repair,
        CASE WHEN source = 'src3' THEN 'PARTIAL' ELSE 'COMPLETE' END AS provenance,
        CASE WHEN disposition = 'VALID_HIGH_RISK' THEN 'HIGH_RISK' WHEN disposition = 'PROVIDER_FAILURE' THEN 'NONE' ELSE 'LOW_RISK' END AS risk,
        CASE WHEN disposition = 'PROVIDER_FAILURE' THEN 'UNSAFE_TO_EVALUATE' ELSE 'PASS' END AS production,
        (lang = 'es' AND n_chars > 5000) AS conflict FROM review)""",
)


def routing(t: Tables) -> DataFrame:
    d = F.col("disposition")
    inputs = t.review.withColumns(
        {
            "structural": F.when(d == "SCHEMA_INVALID", "FAIL").otherwise("PASS"),
            "repair": F.when(d == "MALFORMED_JSON", "FAILED").when((d == "SCHEMA_INVALID") & (F.col("n_chars") > 100), "PASS").otherwise("NOT_NEEDED"),
            "provenance": F.when(F.col("source") == "src3", "PARTIAL").otherwise("COMPLETE"),
            "risk": F.when(d == "VALID_HIGH_RISK", "HIGH_RISK").when(d == "PROVIDER_FAILURE", "NONE").otherwise("LOW_RISK"),
            "production": F.when(d == "PROVIDER_FAILURE", "UNSAFE_TO_EVALUATE").otherwise("PASS"),
            "conflict": (F.col("lang") == "es") & (F.col("n_chars") > 5000),
        }
    )
    c = F.col
    return inputs.withColumn("route", P.route_record(c("structural"), c("repair"), c("provenance"), c("risk"), c("production"), c("conflict")))


@query("route_record", ["routing"], "SELECT candidate_id, route FROM routing")
def _(t):
    return routing(t).select("candidate_id", "route")


def payloads(t: Tables) -> DataFrame:
    """One raw model output per review case, broken in the way its disposition says."""
    coverage = F.create_map(*[v for k in rules.COVERAGE_FIELDS for v in (F.lit(k), F.lit(True).cast("string"))], F.lit("summaryRationale"), F.lit("checked all fields"))
    evidence = F.named_struct(F.lit("source"), F.lit("facts"), F.lit("supportFound"), F.lit(False), F.lit("conflictingValue"), F.lit("other"))
    defect = F.named_struct(
        F.lit("category"), F.lit("MATERIAL_FACTUAL_CONFLICT"), F.lit("field"), F.lit("description"), F.lit("claimSpan"), F.col("candidate_id"),
        F.lit("checkedAuthoritySources"), F.array(F.lit("facts")), F.lit("authorityResolution"), F.lit("CONTRADICTED_BY_AUTHORITY"), F.lit("sourceEvidence"), F.array(evidence),
    )
    d = F.col("disposition")
    high = d == "VALID_HIGH_RISK"
    body = F.to_json(
        F.struct(
            F.when(d == "SCHEMA_INVALID", "UNKNOWN").when(high, "HIGH_RISK").otherwise("LOW_RISK").alias("riskLevel"),
            (~high).alias("sourceBoundarySatisfied"),
            F.when(high | (d == "SEMANTICALLY_INVALID"), F.array(F.lit("MATERIAL_FACTUAL_CONFLICT"))).otherwise(F.array().cast("array<string>")).alias("riskCategories"),
            F.when(high, F.array(defect)).otherwise(F.filter(F.array(defect), lambda _: F.lit(False))).alias("issues"),
            F.when(~high, coverage).alias("lowRiskCoverage"),
        )
    )
    raw = F.when(d == "PROVIDER_FAILURE", F.lit(None)).when(d == "MALFORMED_JSON", F.substring(body, 1, 25)).otherwise(body)
    return t.review.select("candidate_id", "n_chars", (d == "PROVIDER_FAILURE").alias("provider_error"), raw.alias("raw"))


def judged(t: Tables) -> DataFrame:
    parsed = settle(payloads(t).select("candidate_id", "provider_error", "raw"), doc=F.try_parse_json("raw"))
    parsed = settle(parsed, payload=F.when(F.col("doc").isNotNull(), F.from_json("raw", rules.RISK_PAYLOAD)))
    errors = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules.schema_errors(F.col("doc"), rules.RISK_SCHEMA)]))
    return settle(parsed, failures=rules.check_risk_payload("payload"), schema_errors=errors)


@query(
    "simulate_routing",
    ["review"],
    """SELECT candidate_id, CASE disposition WHEN 'VALID_HIGH_RISK' THEN 'HUMAN_REVIEW_REQUIRED' WHEN 'VALID_LOW_RISK' THEN 'AUTO_ELIGIBLE' ELSE 'REJECTED_BEFORE_ROUTING' END AS route FROM review""",
)
def _(t):
    return judged(t).select("candidate_id", rules.simulate_routing().alias("route"))


@query("classify_output_disposition", ["review"], "SELECT candidate_id, disposition FROM review")
def _(t):
    c = F.col
    return judged(t).select(
        "candidate_id",
        rules.output_disposition(c("provider_error"), c("doc"), c("schema_errors"), c("failures"), c("payload.riskLevel")).alias("disposition"),
    )


@query(
    "classify_evidence_viability",
    (),
    r"""SELECT doc_id, CASE WHEN lang <> 'es' AND words >= 150 THEN 'VIABLE' ELSE 'NON_VIABLE' END AS status
        FROM (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')) AS words FROM documents)""",
)
def _(t):
    text = F.when(F.col("lang") != "es", F.col("text"))
    failure = F.when(F.col("lang") == "es", "NO_MATCHING_SECTION")
    return t.texts("documents").select("doc_id", P.evidence_viability(text, failure).alias("status"))


KEYWORDS_SQL = "list_concat(['  ' || p_name, 'Woman Director', p_brand || ' ', ' ', 'aftercreditsstinger'], list_transform(range(CAST(p_size AS BIGINT)), lambda i: 'kw' || i))"


@query(
    "select_useful_keywords",
    (),
    f"""SELECT p_partkey AS id, array_to_string(list_filter(list_transform({KEYWORDS_SQL}, lambda k: trim(k)), lambda k: k <> '' AND lower(k) NOT IN ('woman director','duringcreditsstinger','aftercreditsstinger','based on novel or book'))[1:12], '|') AS keywords FROM part""",
)
def _(t):
    words = F.concat(
        F.array(F.concat(F.lit("  "), "p_name"), F.lit("Woman Director"), F.concat("p_brand", F.lit(" ")), F.lit(" "), F.lit("aftercreditsstinger")),
        F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.concat(F.lit("kw"), i.cast("string"))),
    )
    return t.raw("part").select(F.col("p_partkey").alias("id"), joined(P.useful_keywords(words)).alias("keywords"))


@query(
    "build_evidence_packet",
    ["facts"],
    """SELECT tmdb_id, CASE WHEN length(trim(overview)) >= 30 THEN trim(overview) END AS overview,
       CASE WHEN length(trim(overview)) >= 30 THEN 'facts|overview' ELSE 'facts' END AS provenance, length(trim(overview)) < 30 AS insufficient_grounding, 64 AS hash_length FROM facts""",
)
def _(t):
    packet = P.build_evidence_packet(t.facts)
    return packet.select("tmdb_id", "overview", joined("provenance").alias("provenance"), "insufficient_grounding", F.length("input_hash").alias("hash_length"))
