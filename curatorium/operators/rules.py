"""Row validators: each yields an array of (severity, code, field) issues."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import (
    EDGE_L,
    EDGE_R,
    issue,
    issues,
    jaccard,
    same_set,
    word_set,
)
from curatorium.schemas import MOODS, ORDINALS, SITUATIONS

# Fixed limits (minimum, maximum characters) of the editorial fields.
COPY_LIMITS = {
    "description": (80, 220),
    "why_watch": (60, 180),
    "curiosity_hook": (50, 170),
    "vibe_summary": (45, 150),
}

# Fixed phrase lists of the editorial rules, as regular expressions.
META_PHRASES = [
    "as an ai",
    "language model",
    "I (?:cannot|can't|generated|was asked)",
    "confidence (?:score|level)",
]
CLICHE_PHRASES = [
    "tour de force",
    "rich tapestry",
    "masterful blend",
    "stellar ensemble",
    "heartwarming tale",
    "a love letter to",
    "deeply moving",
    "breathtaking cinematography",
    "keeps you on the edge of your seat",
]
GENERIC_PHRASES = [
    *CLICHE_PHRASES,
    "must[- ]watch",
    "for fans of cinema",
    "rollercoaster of emotions",
    "delves into",
    "explores themes of",
    "at its core",
    "testament to",
    "will leave you",
]
SPOILER_PHRASES = ["ending reveals", "final twist", "turns out", "in the end"]


def phrase_pattern(phrases: list[str]) -> str:
    return f"(?i){EDGE_L}(?:{'|'.join(phrases)}){EDGE_R}"


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _no_items(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def copy_rules(field: str, text: Column | None = None) -> list[Column]:
    """Length, placeholder, meta-language, spoiler and cliche rules of one editorial field."""
    text = F.trim(F.col(field) if text is None else text)
    low, high = COPY_LIMITS[field]
    return [
        issue("hard_fail", "MISSING_REQUIRED_FIELD", field, F.coalesce(text, F.lit("")) == ""),
        issue("hard_fail", "COPY_TOO_SHORT", field, F.length(text) < low),
        issue("hard_fail", "COPY_TOO_LONG", field, F.length(text) > high),
        issue("hard_fail", "PLACEHOLDER_COPY", field, text.rlike(f"(?i)(?:{EDGE_L}TODO{EDGE_R}|placeholder)")),
        issue("hard_fail", "MODEL_OR_META_LANGUAGE", field, text.rlike(phrase_pattern(META_PHRASES))),
        issue("review", "SPOILER_PATTERN_REVIEW", field, text.rlike(phrase_pattern(SPOILER_PHRASES))),
        issue("review", "GENERIC_LANGUAGE_REVIEW", field, text.rlike(phrase_pattern(GENERIC_PHRASES))),
    ]


def duplicate_hook(description: Column, hook: Column, threshold: float = 0.72) -> Column:
    a, b = word_set(description), word_set(hook)
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (jaccard(a, b) >= threshold), F.lit(False))


def _tags(field: str, allowed: list[str]) -> list[Column]:
    return [
        issue("hard_fail", "MISSING_REQUIRED_FIELD", field, _no_items(field)),
        issue("hard_fail", "INVALID_ENUM", field, F.exists(field, lambda v: ~v.isin(*allowed))),
    ]


def semantic_anomalies() -> Column:
    """Tag pairs that contradict each other and call for a look."""
    has = lambda c, v: F.array_contains(c, v)
    heavy = F.col("emotional_weight") == "heavy"
    return issues(
        issue("review", "FUNNY_HEAVY", "moods", has("moods", "funny") & heavy),
        issue("review", "RELAXING_IMMERSIVE", "moods", has("moods", "relaxing") & (F.col("attention_demand") == "immersive")),
        issue("review", "SLOW_EXCITING", "moods", has("moods", "exciting") & (F.col("pace") == "slow")),
        issue("review", "SUSPENSEFUL_FAMILY", "moods", has("moods", "suspenseful") & has("situations", "family")),
        issue("review", "EASY_WATCH_HEAVY", "situations", has("situations", "easy-watch") & heavy),
    )


def cardinality_flags() -> Column:
    moods, places = F.size("moods"), F.size("situations")
    return issues(
        issue("review", "MOOD_CARDINALITY_REVIEW", "moods", moods.isin(1, 3)),
        issue("review", "MOOD_CARDINALITY_UNUSUAL", "moods", moods > 3),
        issue("review", "SITUATION_CARDINALITY_REVIEW", "situations", places.isin(1, 4)),
        issue("review", "SITUATION_CARDINALITY_UNUSUAL", "situations", places > 4),
    )


def check_catalogue_row() -> Column:
    rules = [
        issue("hard_fail", "MISSING_REQUIRED_FIELD", "id", _blank("id")),
        issue("hard_fail", "INVALID_NUMBER", "tmdb_id", F.coalesce(F.col("tmdb_id"), F.lit(0)) < 1),
        *_tags("moods", MOODS),
        *_tags("situations", SITUATIONS),
        issue("hard_fail", "MISSING_REQUIRED_FIELD", "languages", _no_items("languages")),
        *[
            issue("hard_fail", "INVALID_ENUM", f, ~F.coalesce(F.col(f).isin(*allowed), F.lit(False)))
            for f, allowed in ORDINALS.items()
        ],
        issue(
            "hard_fail",
            "MALFORMED_PALETTE",
            "palette",
            (F.coalesce(F.size("palette"), F.lit(0)) != 2) | F.exists("palette", lambda c: ~c.rlike("(?i)^#[0-9a-f]{6}$")),
        ),
    ]
    for field in COPY_LIMITS:
        rules += copy_rules(field)
    return F.concat(issues(*rules), semantic_anomalies())


def check_facts_row() -> Column:
    return issues(
        issue("hard_fail", "INVALID_NUMBER", "tmdb_id", F.coalesce(F.col("tmdb_id"), F.lit(0)) < 1),
        issue("hard_fail", "MISSING_REQUIRED_FIELD", "title", _blank("title")),
        issue("hard_fail", "INVALID_NUMBER", "year", F.coalesce(F.col("year"), F.lit(0)) < 1878),
        issue("hard_fail", "MISSING_REQUIRED_FIELD", "director", _blank("director")),
        *[issue("hard_fail", "MISSING_REQUIRED_FIELD", f, _no_items(f)) for f in ("countries", "spoken_languages", "genres")],
        issue("hard_fail", "INVALID_NUMBER", "runtime_minutes", F.coalesce(F.col("runtime_minutes"), F.lit(0)) < 1),
        issue("review", "POSTER_UNAVAILABLE", "poster_path", F.col("poster_path").isNull()),
    )


def check_batch(batch: DataFrame, keys: dict[str, str], order: str) -> DataFrame:
    """Rows repeating a key of an earlier row of the batch: (order value, code, value)."""
    out = None
    for column, code in keys.items():
        first = batch.groupBy(column).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
        hits = batch.join(first, column).where(F.col(order) > F.col("__first"))
        hits = hits.select(order, F.lit(code).alias("code"), F.col(column).cast("string").alias("value"))
        out = hits if out is None else out.unionByName(hits)
    return out


def check_classification(schema_versions: list[str]) -> Column:
    """Rules over a classification struct, its evidence map and its confidence map.

    Expects columns ``schema_version``, the tag and ordinal columns,
    ``evidence`` (map of tag to struct<rationale, source_refs, mode, cues, bridge>)
    and ``confidence`` (map<string,double>).
    """
    selected = F.concat(F.col("moods"), F.col("situations"), F.array(*[F.lit(f) for f in ORDINALS]))
    item = lambda tag: F.try_element_at(F.col("evidence"), tag)
    bad = lambda cond: F.exists(selected, lambda t: F.coalesce(cond(item(t)), F.lit(False)))
    inference = lambda e: e["mode"] == "supported-inference"
    return F.concat(
        issues(
            issue("hard_fail", "INVALID_SCHEMA_VERSION", "schema_version", ~F.coalesce(F.col("schema_version").isin(*schema_versions), F.lit(False))),
            *_tags("moods", MOODS),
            *_tags("situations", SITUATIONS),
            *[issue("hard_fail", "INVALID_ENUM", f, ~F.coalesce(F.col(f).isin(*a), F.lit(False))) for f, a in ORDINALS.items()],
            issue("hard_fail", "INVALID_SEMANTIC_EVIDENCE", "evidence", F.exists(selected, lambda t: item(t).isNull())),
            issue("hard_fail", "EVIDENCE_RATIONALE_TOO_SHORT", "evidence", bad(lambda e: F.length(F.trim(e["rationale"])) < 12)),
            issue("hard_fail", "MISSING_SOURCE_REFS", "evidence", bad(lambda e: F.size(e["source_refs"]) < 1)),
            issue("hard_fail", "INVALID_GROUNDING_MODE", "evidence", bad(lambda e: ~e["mode"].isin("direct", "supported-inference"))),
            issue("hard_fail", "EVIDENCE_CUE_TOO_SHORT", "evidence", bad(lambda e: F.exists(e["cues"], lambda c: F.length(F.trim(c)) < 8))),
            issue("hard_fail", "TOO_FEW_DIRECT_EVIDENCE_CUES", "evidence", bad(lambda e: (e["mode"] == "direct") & (F.size(e["cues"]) < 1))),
            issue("hard_fail", "TOO_FEW_SUPPORTED_INFERENCE_CUES", "evidence", bad(lambda e: inference(e) & (F.size(e["cues"]) < 2))),
            issue("hard_fail", "MISSING_SUPPORTED_INFERENCE_BRIDGE", "evidence",
                  bad(lambda e: inference(e) & (F.length(F.trim(F.coalesce(e["bridge"], F.lit("")))) < 12))),
            issue("hard_fail", "INVALID_SELF_CONFIDENCE", "confidence", F.exists(F.map_values("confidence"), lambda v: (v < 0) | (v > 1))),
        ),
        semantic_anomalies(),
        cardinality_flags(),
    )


def check_editorial(description: str = "description", hook: str = "curiosity_hook") -> Column:
    rules = [r for field in COPY_LIMITS for r in copy_rules(field)]
    rules.append(issue("review", "DESCRIPTION_HOOK_DUPLICATION", hook, duplicate_hook(F.col(description), F.col(hook))))
    return issues(*rules)


VERDICTS = ["hard_fail", "needs_review", "approve_for_review", "candidate_for_auto_accept"]
# Fixed names of the critic's assessments.
ASSESSMENTS = [
    "taxonomyAlignment",
    "voiceConsistency",
    "specificity",
    "descriptionHookDifferentiation",
    "genericLanguageRisk",
    "syntacticRepetitionRisk",
    "setupOnlySpoilerCompliance",
    "synopsisDrift",
    "distinctiveness",
    "layoutFit",
]


def check_critic(verdict: Column, assessments: Column, keys: Column) -> Column:
    """``assessments`` is a map; ``keys`` the object's own field names."""
    return issues(
        issue("hard_fail", "INVALID_ENUM", "verdict", ~F.coalesce(verdict.isin(*VERDICTS), F.lit(False))),
        *[
            issue("hard_fail", "INVALID_ENUM", a,
                  ~F.coalesce(F.try_element_at(assessments, F.lit(a)).isin("pass", "review", "fail"), F.lit(False)))
            for a in ASSESSMENTS
        ],
        issue("hard_fail", "CRITIC_DEPENDS_ON_WRITER_REASONING", "writerReasoning",
              F.arrays_overlap(keys, F.array(F.lit("writerNotes"), F.lit("writerReasoning")))),
    )


# --- risk payloads -----------------------------------------------------------

# Fixed vocabulary of the risk contract.
RISK_CATEGORIES = [
    "SPOILER_OR_LATER_REVEAL",
    "HIDDEN_IDENTITY_OR_ORIGIN",
    "RELATIONSHIP_OR_CHARACTER_MOTIVE",
    "CONCRETE_STORY_OR_SUPERNATURAL_MECHANISM",
    "FRANCHISE_OR_EXTERNAL_LORE",
    "SCENE_OR_SCRIPT_LEVEL_EXTERNAL_DETAIL",
    "MATERIAL_FACTUAL_CONFLICT",
    "UNRESOLVED_SOURCE_GROUNDING_CONFLICT",
    "UNSUPPORTED_COMPARATIVE_OR_META_CLAIM",
    "SPECULATIVE_HOOK_PREMISE",
    "UNAUTHORIZED_SOURCE_BOUNDARY_CLAIM",
]
RESOLUTIONS = [
    "UNSUPPORTED_MISSING_AUTHORITY",
    "CONTRADICTED_BY_AUTHORITY",
    "DISALLOWED_AUTHORITY_SOURCE",
    "UNRESOLVED",
    "SUPPORTED",
]
PAYLOAD_FIELDS = ["description", "whyWatch", "curiosityHook", "vibeSummary"]
COVERAGE_FIELDS = [
    "allVisibleFieldsAudited",
    "interrogativePremisesAudited",
    "factualModifiersAudited",
    "packetFactsAudited",
    "settingAndLocationAudited",
    "characterMotivesAndRelationshipsAudited",
    "storyMechanismsAndConstraintsAudited",
    "externalLoreAndBackstoryAudited",
    "spoilerAndRevealBoundariesAudited",
    "viewingExperienceInferenceAudited",
]
DEFECT_CATEGORIES = [
    "UNAUTHORIZED_SOURCE_BOUNDARY_CLAIM",
    "MATERIAL_FACTUAL_CONFLICT",
    "UNSUPPORTED_COMPARATIVE_OR_META_CLAIM",
]

RISK_PAYLOAD = (
    "riskLevel string, sourceBoundarySatisfied boolean, riskCategories array<string>, "
    "issues array<struct<category: string, field: string, claimSpan: string, checkedAuthoritySources: array<string>, "
    "authorityResolution: string, sourceEvidence: array<struct<source: string, supportFound: boolean, value: string, conflictingValue: string>>>>, "
    "lowRiskCoverage map<string,string>"
)


def check_risk_payload(payload: str = "payload") -> Column:
    """Failure codes of a parsed risk payload; empty means coherent."""
    p = lambda f: F.col(f"{payload}.{f}")
    low, high = p("riskLevel") == "LOW_RISK", p("riskLevel") == "HIGH_RISK"
    cats, found = p("riskCategories"), p("issues")
    holds = lambda c: F.coalesce(c, F.lit(False))
    any_issue = lambda cond: holds(F.exists(found, lambda i: F.coalesce(cond(i), F.lit(False))))
    ev_all_true = lambda i: F.forall(i["sourceEvidence"], lambda e: F.coalesce(e["supportFound"], F.lit(False)))
    ev_any_true = lambda i: F.exists(i["sourceEvidence"], lambda e: F.coalesce(e["supportFound"], F.lit(False)))
    ev_positive = lambda i: F.exists(i["sourceEvidence"], lambda e: F.coalesce(e["value"].isNotNull() & e["supportFound"], F.lit(False)))
    ev_conflict = lambda i: F.exists(
        i["sourceEvidence"],
        lambda e: e["conflictingValue"].isNotNull() | F.coalesce(e["value"].isNotNull() & ~e["supportFound"], F.lit(False)),
    )
    ev_all_false = lambda i: F.forall(i["sourceEvidence"], lambda e: F.coalesce(~e["supportFound"], F.lit(False)))
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) < 1
    resolved = lambda i, r: i["authorityResolution"] == r
    covered = lambda k: F.coalesce(F.try_element_at(p("lowRiskCoverage"), F.lit(k)) == "true", F.lit(False))
    codes = [
        (F.col(payload).isNull(), "MALFORMED_PAYLOAD"),
        (~holds(low | high), "INVALID_RISK_LEVEL"),
        (p("sourceBoundarySatisfied").isNull(), "INVALID_SOURCE_BOUNDARY_SATISFIED"),
        (cats.isNull(), "INVALID_RISK_CATEGORIES"),
        (holds(F.size(F.array_distinct(cats)) != F.size(cats)), "DUPLICATE_RISK_CATEGORIES"),
        (holds(F.exists(cats, lambda c: ~c.isin(*RISK_CATEGORIES))), "UNKNOWN_RISK_CATEGORY"),
        (found.isNull(), "INVALID_ISSUES"),
        (any_issue(lambda i: ~F.coalesce(i["category"].isin(*RISK_CATEGORIES), F.lit(False))), "INVALID_ISSUE_CATEGORY"),
        (any_issue(lambda i: ~F.coalesce(i["field"].isin(*PAYLOAD_FIELDS), F.lit(False))), "INVALID_ISSUE_FIELD"),
        (any_issue(lambda i: blank(i["claimSpan"])), "INVALID_ISSUE_CLAIM_SPAN"),
        (any_issue(lambda i: F.coalesce(F.size(i["checkedAuthoritySources"]), F.lit(0)) < 1), "INVALID_ISSUE_CHECKED_SOURCES"),
        (any_issue(lambda i: ~F.coalesce(i["authorityResolution"].isin(*RESOLUTIONS), F.lit(False))), "INVALID_ISSUE_AUTHORITY_RESOLUTION"),
        (any_issue(lambda i: F.coalesce(F.size(i["sourceEvidence"]), F.lit(0)) < 1), "INVALID_ISSUE_SOURCE_EVIDENCE"),
        (any_issue(lambda i: F.exists(i["sourceEvidence"], lambda e: blank(e["source"]))), "MISSING_SOURCE_IN_EVIDENCE"),
        (any_issue(lambda i: F.exists(i["sourceEvidence"], lambda e: e["supportFound"].isNull())), "MISSING_SUPPORT_FOUND_IN_EVIDENCE"),
        (any_issue(lambda i: resolved(i, "SUPPORTED") & ~ev_all_true(i)), "SUPPORTED_REQUIRES_TRUE"),
        (any_issue(lambda i: resolved(i, "SUPPORTED") & ~ev_positive(i)), "SUPPORTED_REQUIRES_POSITIVE_EVIDENCE"),
        (any_issue(lambda i: resolved(i, "SUPPORTED") & i["category"].isin(*DEFECT_CATEGORIES)), "SUPPORTED_RESOLUTION_INCOMPATIBLE_WITH_DEFECT_CATEGORY"),
        (any_issue(lambda i: resolved(i, "UNSUPPORTED_MISSING_AUTHORITY") & ~ev_all_false(i)), "UNSUPPORTED_REQUIRES_FALSE"),
        (any_issue(lambda i: resolved(i, "CONTRADICTED_BY_AUTHORITY") & ev_any_true(i)), "CONFLICT_CANNOT_HAVE_TRUE"),
        (any_issue(lambda i: resolved(i, "CONTRADICTED_BY_AUTHORITY") & ~ev_conflict(i)), "CONTRADICTED_REQUIRES_CONFLICTING_EVIDENCE"),
        (holds(low & ~F.coalesce(p("sourceBoundarySatisfied"), F.lit(False))), "LOW_RISK_REQUIRES_SATISFIED_TRUE"),
        (holds(low & (F.size(cats) > 0)), "LOW_RISK_REQUIRES_EMPTY_CATEGORIES"),
        (holds(low & (F.size(found) > 0)), "LOW_RISK_REQUIRES_EMPTY_ISSUES"),
        (holds(low & p("lowRiskCoverage").isNull()), "LOW_RISK_REQUIRES_COVERAGE_OBJECT"),
        *[(holds(low & p("lowRiskCoverage").isNotNull() & ~covered(k)), f"LOW_RISK_COVERAGE_FIELD_NOT_TRUE:{k}") for k in COVERAGE_FIELDS],
        (holds(low & p("lowRiskCoverage").isNotNull() & blank(F.try_element_at(p("lowRiskCoverage"), F.lit("summaryRationale")))), "LOW_RISK_COVERAGE_MISSING_SUMMARY_RATIONALE"),
        (holds(high & F.coalesce(p("sourceBoundarySatisfied"), F.lit(True))), "HIGH_RISK_REQUIRES_SATISFIED_FALSE"),
        (holds(high & (F.coalesce(F.size(cats), F.lit(0)) < 1)), "HIGH_RISK_REQUIRES_NON_EMPTY_CATEGORIES"),
        (holds(high & (F.coalesce(F.size(found), F.lit(0)) < 1)), "HIGH_RISK_REQUIRES_NON_EMPTY_ISSUES"),
        (holds(high & ~same_set(cats, F.filter(F.transform(found, lambda i: i["category"]), lambda c: c.isNotNull()))), "CATEGORY_SET_MISMATCH"),
    ]
    first, rest = codes[0], codes[1:]
    return F.when(first[0], F.array(F.lit(first[1]))).otherwise(
        F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rest]))
    )


def simulate_routing(payload: str = "payload", failures: str = "failures") -> Column:
    """Invalid payloads never reach routing; then conflict or high risk, then low risk."""
    p = lambda f: F.col(f"{payload}.{f}")
    conflict = F.array_contains(p("riskCategories"), "UNRESOLVED_SOURCE_GROUNDING_CONFLICT")
    return (
        F.when(F.size(failures) > 0, "REJECTED_BEFORE_ROUTING")
        .when((p("riskLevel") == "HIGH_RISK") | conflict, "HUMAN_REVIEW_REQUIRED")
        .when((p("riskLevel") == "LOW_RISK") & p("sourceBoundarySatisfied"), "AUTO_ELIGIBLE")
        .otherwise("QUARANTINED")
    )


def output_disposition(provider_error: Column, document: Column, schema_errors: Column, failures: Column, level: Column) -> Column:
    """First failing stage of a model output, or its risk level; ``document`` is the parsed output, null if it isn't JSON."""
    return (
        F.when(provider_error, "PROVIDER_FAILURE")
        .when(document.isNull(), "MALFORMED_JSON")
        .when(F.size(schema_errors) > 0, "SCHEMA_INVALID")
        .when(F.size(failures) > 0, "SEMANTICALLY_INVALID")
        .when(level == "HIGH_RISK", "VALID_HIGH_RISK")
        .otherwise("VALID_LOW_RISK")
    )


# --- JSON schema subset -------------------------------------------------------

SUPPORTED_KEYWORDS = {
    "$schema", "title", "description", "type", "const", "enum", "minLength", "maxLength", "pattern", "required",
    "additionalProperties", "properties", "minItems", "maxItems", "uniqueItems", "items", "allOf", "if", "then", "else",
}

_TYPES = {
    "string": lambda t: t == "STRING",
    "boolean": lambda t: t == "BOOLEAN",
    "integer": lambda t: t == "BIGINT",
    "number": lambda t: t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"),
    "null": lambda t: t == "VOID",
    "array": lambda t: t.startswith("ARRAY"),
    "object": lambda t: t.startswith("OBJECT"),
}


def assert_schema_supported(schema: dict[str, Any], path: str = "$") -> None:
    unknown = set(schema) - SUPPORTED_KEYWORDS
    if unknown:
        raise ValueError(f"unsupported schema keyword {sorted(unknown)} at {path}")
    for name, child in schema.get("properties", {}).items():
        assert_schema_supported(child, f"{path}.{name}")
    for key in ("items", "if", "then", "else"):
        if isinstance(schema.get(key), dict):
            assert_schema_supported(schema[key], f"{path}/{key}")
    for i, child in enumerate(schema.get("allOf", [])):
        assert_schema_supported(child, f"{path}/allOf{i}")


def schema_errors(value: Column, schema: dict[str, Any], path: str = "$") -> list[tuple[Column, str]]:
    """(condition, error) pairs of a schema subset over a VARIANT column."""
    assert_schema_supported(schema, path)
    return _compile(value, schema, path)


def _compile(v: Column, schema: dict[str, Any], path: str) -> list[tuple[Column, str]]:
    kind = F.schema_of_variant(v)
    out: list[tuple[Column, str]] = []
    here = v.isNotNull()
    text = F.try_variant_get(v, "$", "string")
    is_text, is_list = _TYPES["string"](kind), _TYPES["array"](kind)
    items = F.try_variant_get(v, "$", "array<variant>")
    if "type" in schema:
        allowed = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = _TYPES[allowed[0]](kind)
        for name in allowed[1:]:
            ok = ok | _TYPES[name](kind)
        out.append((here & ~ok, f"{path}: type"))
    if "const" in schema:
        out.append((here & ~_equals(v, kind, schema["const"]), f"{path}: const"))
    if "enum" in schema:
        ok = F.lit(False)
        for option in schema["enum"]:
            ok = ok | _equals(v, kind, option)
        out.append((here & ~ok, f"{path}: enum"))
    if "minLength" in schema:
        out.append((is_text & (F.length(text) < schema["minLength"]), f"{path}: minLength"))
    if "maxLength" in schema:
        out.append((is_text & (F.length(text) > schema["maxLength"]), f"{path}: maxLength"))
    if "pattern" in schema:
        out.append((is_text & ~text.rlike(schema["pattern"]), f"{path}: pattern"))
    if "minItems" in schema:
        out.append((is_list & (F.size(items) < schema["minItems"]), f"{path}: minItems"))
    if "maxItems" in schema:
        out.append((is_list & (F.size(items) > schema["maxItems"]), f"{path}: maxItems"))
    if schema.get("uniqueItems"):
        as_text = F.transform(items, lambda i: F.to_json(i))
        out.append((is_list & (F.size(F.array_distinct(as_text)) != F.size(as_text)), f"{path}: uniqueItems"))
    if "items" in schema:
        # one error per item rule; the rule is compiled against the lambda's own item
        def violates(n: int):
            return lambda i: _compile(i, schema["items"], f"{path}[]")[n][0]

        for n, (_, message) in enumerate(_compile(v, schema["items"], f"{path}[]")):
            out.append((is_list & F.exists(items, violates(n)), message))
    properties = schema.get("properties", {})
    is_object = _TYPES["object"](kind)
    if "required" in schema or schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        for name in schema.get("required", []):
            out.append((is_object & ~F.array_contains(keys, name), f"{path}.{name}: required"))
        if schema.get("additionalProperties") is False:
            known = F.array(*[F.lit(n) for n in properties]).cast("array<string>")
            out.append((is_object & (F.size(F.array_except(keys, known)) > 0), f"{path}: additionalProperties"))
    for name, child in properties.items():
        out += _compile(F.try_variant_get(v, f"$.{name}", "variant"), child, f"{path}.{name}")
    for child in schema.get("allOf", []):
        out += _compile(v, child, path)
    if "if" in schema:
        applies = ~_any(_compile(v, schema["if"], path))
        out += [(applies & c, m) for c, m in _compile(v, schema.get("then", {}), path)]
        out += [(~applies & c, m) for c, m in _compile(v, schema.get("else", {}), path)]
    return [(F.coalesce(c, F.lit(False)), m) for c, m in out]


def _any(pairs: list[tuple[Column, str]]) -> Column:
    out = F.lit(False)
    for cond, _ in pairs:
        out = out | cond
    return out


def _equals(v: Column, kind: Column, option: Any) -> Column:
    if option is None:
        return kind == "VOID"
    if isinstance(option, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(option))
    if isinstance(option, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == option)
    return F.coalesce(F.try_variant_get(v, "$", "double") == float(option), F.lit(False))


RISK_SCHEMA = {
    "type": "object",
    "required": ["riskLevel", "sourceBoundarySatisfied", "riskCategories", "issues"],
    "additionalProperties": False,
    "properties": {
        "riskLevel": {"type": "string", "enum": ["LOW_RISK", "HIGH_RISK"]},
        "sourceBoundarySatisfied": {"type": "boolean"},
        "riskCategories": {"type": "array", "uniqueItems": True, "items": {"type": "string", "enum": RISK_CATEGORIES}},
        "issues": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["category", "field"],
                "properties": {"claimSpan": {"type": "string", "minLength": 1}},
            },
        },
        "lowRiskCoverage": {"type": ["object", "null"]},
    },
    "if": {"properties": {"riskLevel": {"const": "HIGH_RISK"}}},
    "then": {"properties": {"riskCategories": {"minItems": 1}}},
}


# --- decisions ----------------------------------------------------------------

EDITORIAL_FIELDS = ["description", "why_watch", "curiosity_hook", "vibe_summary"]


def decision_rules() -> Column:
    """Coherence of one decision joined to its packet (packet columns prefixed ``b_``)."""
    decision, severity = F.col("decision"), F.col("severity")
    fields, reason = F.coalesce(F.size("affected_fields"), F.lit(0)), F.coalesce(F.trim("reason"), F.lit(""))
    checks = [
        (F.col("b_candidate_id").isNull(), "MISSING_BLIND_RECORD"),
        (F.col("tmdb_id") != F.col("b_tmdb_id"), "RECORD_IDENTITY_MISMATCH"),
        (F.col("blind_ordinal") != F.col("b_blind_ordinal"), "ORDINAL_MISMATCH"),
        (F.col("reviewed_hash") != F.col("b_packet_hash"), "REVIEWED_ARTIFACT_HASH_DRIFT"),
        (~decision.isin("APPROVE", "REVISE", "REJECT", "PENDING"), "INVALID_DECISION_VALUE"),
        (~severity.isin("NONE", "MINOR", "SEVERE", "PENDING"), "INVALID_SEVERITY_VALUE"),
        ((decision == "PENDING") & (severity != "PENDING"), "PENDING_DECISION_MUST_HAVE_PENDING_SEVERITY"),
        ((decision == "APPROVE") & (severity != "NONE"), "APPROVE_MUST_HAVE_SEVERITY_NONE"),
        ((decision == "APPROVE") & (fields > 0), "APPROVE_CANNOT_HAVE_AFFECTED_FIELDS"),
        ((decision == "REVISE") & ~severity.isin("MINOR", "SEVERE"), "REVISE_MUST_HAVE_MINOR_OR_SEVERE_SEVERITY"),
        ((decision == "REVISE") & (fields == 0), "REVISE_REQUIRES_AFFECTED_FIELDS"),
        ((decision == "REVISE") & F.exists("affected_fields", lambda f: ~f.isin(*EDITORIAL_FIELDS)), "INVALID_AFFECTED_FIELD"),
        ((decision == "REVISE") & (reason == ""), "REVISE_REQUIRES_NON_EMPTY_REASON"),
        ((decision == "REJECT") & (reason == ""), "REJECT_REQUIRES_NON_EMPTY_REASON"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in checks]))


def summarize_validation(results: DataFrame, key: str, issue_array: str = "issues") -> DataFrame:
    """Issue counts per record over all its results; ok when none is a hard failure."""
    return results.groupBy(key).agg(
        F.sum(F.size(F.filter(issue_array, lambda i: i["severity"] == "hard_fail"))).alias("hard_failures"),
        F.sum(F.size(F.filter(issue_array, lambda i: i["severity"] != "hard_fail"))).alias("review_flags"),
    ).withColumn("ok", F.col("hard_failures") == 0)


def production_row_failures(fields: list[str], hashes: list[str]) -> Column:
    """Unknown or missing fields of a record, hashes that moved on, and a foreign identity."""
    keys = F.json_object_keys("record")
    exact = F.array(*[F.lit(f) for f in fields])
    return F.concat(
        F.transform(F.array_except(keys, exact), lambda k: F.concat(F.lit("UNKNOWN_FIELD:"), k)),
        F.transform(F.array_except(exact, keys), lambda k: F.concat(F.lit("MISSING_FIELD:"), k)),
        F.array_compact(F.array(*[F.when(F.col(f"recorded.{h}") != F.col(f"actual.{h}"), F.lit(f"STALE_HASH:{h}")) for h in hashes])),
        F.array_compact(F.array(F.when(F.col("artifact_tmdb") != F.col("tmdb_id"), F.lit("IDENTITY_MISMATCH")))),
    )


def check_manifest(manifest: DataFrame, accepted: DataFrame, group: str) -> DataFrame:
    """Counts and roster digests of a promotion manifest against the accepted rows."""
    from curatorium.operators.sets import table_digest

    said = table_digest(manifest, [group]).select(group, F.col("rows").alias("m_rows"), F.col("digest").alias("m_digest"))
    real = table_digest(accepted, [group])
    failures = F.array_compact(
        F.array(
            F.when(~F.col("m_rows").eqNullSafe(F.col("rows")), F.lit("COUNT_MISMATCH")),
            F.when(~F.col("m_digest").eqNullSafe(F.col("digest")), F.lit("ROSTER_MISMATCH")),
        )
    )
    return real.join(said, group, "left").select(group, F.array_join(failures, "|").alias("failures"))
