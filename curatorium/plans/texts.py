"""Text and HTML jobs over whole documents, pages and copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import joined
from curatorium.operators import aggregates as A
from curatorium.operators import text as X
from curatorium.plans.checks import DUPLICATE_SQL, _rx, editorial
from curatorium.plans.registry import query
from curatorium.plans.selection import ancestry, sections
from curatorium.operators.rules import CLICHE_PHRASES, SPOILER_PHRASES
from curatorium.sources.projections import CTES, Tables

c = F.col
COPY_FIELDS = ["description", "why_watch", "curiosity_hook", "vibe_summary"]

# whole documents as copy, with claims planted by language, length and source, and facts that support some
CTES["claims"] = (
    ("review",),
    """SELECT candidate_id, human_decision, severity,
  text || CASE lang WHEN 'fr' THEN ' A French-language story told over decades.' WHEN 'de' THEN ' A Russian-language neo-noir.' WHEN 'es' THEN ' A race against the clock.' ELSE '' END AS description,
  CASE WHEN n_chars < 400 THEN 'An Italian  drama with a ticking clock and another decade' ELSE 'Watch it slowly' END AS why_watch,
  CASE WHEN source = 'src1' THEN 'A multi-language Space Opera in Klingon-language?' ELSE 'Why?' END AS curiosity_hook, 'calm' AS vibe_summary,
  CASE lang WHEN 'fr' THEN ['french'] WHEN 'de' THEN ['german'] WHEN 'es' THEN ['spanish'] ELSE ['english'] END AS spoken,
  CASE WHEN n_chars > 2000 THEN ['drama', 'noir'] WHEN n_chars > 1000 THEN ['opera'] ELSE ['drama'] END AS genres,
  CASE WHEN lang = 'en' THEN ['france', 'italy'] ELSE ['france'] END AS countries,
  CASE source WHEN 'src3' THEN 'Set in the 1960s.' WHEN 'src4' THEN 'Over 30 years he waits for the deadline.' WHEN 'src5' THEN 'A decade passes.' ELSE 'A quiet tale.' END AS overview,
  human_fields AS affected_fields, CASE WHEN severity = 'SEVERE' THEN 'The deadline and the decade are invented' WHEN severity = 'MINOR' THEN 'Nationality is wrong, subgenre too' ELSE '' END AS human_reason FROM review""",
)


def claims(t: Tables) -> DataFrame:
    lang, size, source = c("lang"), c("n_chars"), c("source")
    one = lambda *v: F.array(*[F.lit(x) for x in v])
    return t.review.select(
        "candidate_id", "human_decision", "severity",
        F.concat(
            "text",
            F.when(lang == "fr", " A French-language story told over decades.").when(lang == "de", " A Russian-language neo-noir.").when(lang == "es", " A race against the clock.").otherwise(""),
        ).alias("description"),
        F.when(size < 400, "An Italian  drama with a ticking clock and another decade").otherwise("Watch it slowly").alias("why_watch"),
        F.when(source == "src1", "A multi-language Space Opera in Klingon-language?").otherwise("Why?").alias("curiosity_hook"),
        F.lit("calm").alias("vibe_summary"),
        F.when(lang == "fr", one("french")).when(lang == "de", one("german")).when(lang == "es", one("spanish")).otherwise(one("english")).alias("spoken"),
        F.when(size > 2000, one("drama", "noir")).when(size > 1000, one("opera")).otherwise(one("drama")).alias("genres"),
        F.when(lang == "en", one("france", "italy")).otherwise(one("france")).alias("countries"),
        F.when(source == "src3", "Set in the 1960s.").when(source == "src4", "Over 30 years he waits for the deadline.").when(source == "src5", "A decade passes.").otherwise("A quiet tale.").alias("overview"),
        c("human_fields").alias("affected_fields"),
        F.when(c("severity") == "SEVERE", "The deadline and the decade are invented").when(c("severity") == "MINOR", "Nationality is wrong, subgenre too").otherwise("").alias("human_reason"),
    )


def _sql_words(words: list[str]) -> str:
    return "|".join(words)


CTES["hits"] = (
    ("claims",),
    rf"""SELECT candidate_id, rule, field, matched FROM (
  SELECT candidate_id, field, unnest(list_concat(
    list_transform(list_filter(list_transform(regexp_extract_all(text, '(?i)\b[A-Za-z]+-language\b'), lambda m: lower(m)), lambda m: list_contains({X.LANGUAGES}, split_part(m, '-', 1)) AND NOT list_contains(spoken, split_part(m, '-', 1))), lambda m: {{'rule': 'LANGUAGE_CLAIM', 'matched': m}}),
    CASE WHEN regexp_matches(overview, '(?i)\bdecades?\b|\b(?:[2-9]\d|\d0)\s+years\b|\b(?:(?:1[89]|20)\d0s|\d{{4}}s)\b') THEN [] ELSE list_transform(regexp_extract_all(text, '(?i)\bdecades?\b'), lambda m: {{'rule': 'DURATION_OVERSTATEMENT', 'matched': lower(m)}}) END,
    list_transform(list_filter(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(?:{_sql_words(X.SUBGENRES)})\b'), lambda m: lower(m))), lambda m: len(list_filter(genres, lambda g: contains(g, m) OR contains(m, g))) = 0), lambda m: {{'rule': 'SUBGENRE_ASSERTION', 'matched': m}}),
    CASE WHEN len(countries) > 1 THEN list_transform(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(?:{_sql_words(X.DEMONYMS)})\s+(?:{_sql_words(X.COMMON_GENRES)})\b'), lambda m: regexp_replace(lower(m), '\s+', ' ', 'g'))), lambda m: {{'rule': 'NATIONALITY_GENRE_COLLAPSE', 'matched': m}}) ELSE [] END,
    CASE WHEN regexp_matches(lower(overview), 'deadline|clock|time runs out') THEN [] ELSE list_transform(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(?:{_sql_words(X.DEADLINE_PHRASES)})\b'), lambda m: lower(m))), lambda m: {{'rule': 'DEADLINE_CLAIM', 'matched': m}}) END
  ), recursive := true) FROM (
   SELECT candidate_id, 'description' AS field, description AS text, spoken, genres, countries, overview FROM claims UNION ALL SELECT candidate_id, 'why_watch', why_watch, spoken, genres, countries, overview FROM claims
   UNION ALL SELECT candidate_id, 'curiosity_hook', curiosity_hook, spoken, genres, countries, overview FROM claims UNION ALL SELECT candidate_id, 'vibe_summary', vibe_summary, spoken, genres, countries, overview FROM claims))""",
)


def hits(t: Tables) -> DataFrame:
    return X.boundary_rules(claims(t), "candidate_id", COPY_FIELDS)


@query("boundary_rules", ["hits"], "SELECT candidate_id, rule, field, matched FROM hits")
def _(t):
    return hits(t)


@query(
    "classify_hit",
    ["hits"],
    r"""SELECT h.candidate_id, rule, field, matched, CASE WHEN human_decision = 'APPROVE' THEN 'UNADJUDICATED_HIT'
     WHEN rule = 'DURATION_OVERSTATEMENT' AND regexp_matches(overview, '\d{4}s') AND NOT contains(lower(human_reason), 'decade') THEN 'SOURCE_SUPPORTED_FALSE_HIT'
     WHEN f AND m THEN 'HUMAN_CONFIRMED_DEFECT' WHEN NOT f AND NOT m THEN 'SOURCE_SUPPORTED_FALSE_HIT' ELSE 'AMBIGUOUS' END AS outcome FROM (
     SELECT h.*, human_decision, overview, human_reason, list_contains(affected_fields, field) AS f, contains(lower(human_reason), matched) OR (rule = 'NATIONALITY_GENRE_COLLAPSE' AND regexp_matches(lower(human_reason), 'co-production|nationality'))
       OR (rule = 'SUBGENRE_ASSERTION' AND contains(lower(human_reason), 'subgenre')) OR (rule = 'DEADLINE_CLAIM' AND regexp_matches(lower(human_reason), 'deadline|ticking clock')) OR (rule = 'DURATION_OVERSTATEMENT' AND contains(lower(human_reason), 'decade')) AS m
     FROM hits h JOIN claims c ON c.candidate_id = h.candidate_id WHERE human_decision IS NOT NULL) h""",
)
def _(t):
    facts = claims(t).where(c("human_decision").isNotNull()).select("candidate_id", "human_decision", "overview", "human_reason", "affected_fields")
    return hits(t).join(facts, "candidate_id").select("candidate_id", "rule", "field", "matched", X.classify_hit().alias("outcome"))


def _judged(t: Tables) -> DataFrame:
    return t.review.where(c("human_decision").isNotNull()).select("candidate_id", "human_decision")


CTES["hit_pairs"] = (
    ("hits",),
    "SELECT h.candidate_id, rule, count(*) AS n, human_decision = 'REVISE' AS defect, count(*) OVER (PARTITION BY h.candidate_id) AS rules FROM hits h JOIN review r ON r.candidate_id = h.candidate_id AND human_decision IS NOT NULL GROUP BY h.candidate_id, rule, human_decision",
)


@query(
    "rule_contribution",
    ["hit_pairs"],
    """SELECT rule, count(*) AS flagged, count(*) FILTER (WHERE defect) AS caught, count(*) FILTER (WHERE NOT defect) AS clean_flagged, count(*) FILTER (WHERE defect AND rules = 1) AS caught_alone, sum(n)::BIGINT AS hits, round(count(*) FILTER (WHERE defect) / count(*), 6) AS ppv FROM hit_pairs GROUP BY rule""",
)
def _(t):
    return A.rule_contribution(hits(t), _judged(t), "candidate_id").withColumn("ppv", F.round("ppv", 6))


@query(
    "leave_one_out",
    ["hit_pairs"],
    "SELECT rule, -count(*) FILTER (WHERE defect) AS delta_tp, -count(*) FILTER (WHERE NOT defect) AS delta_fp FROM hit_pairs WHERE rules = 1 GROUP BY rule",
)
def _(t):
    return A.leave_one_out(hits(t), _judged(t), "candidate_id", X.RULES)


LONG_COPY_SQL = "(SELECT id, language, unnest(['description','why_watch','curiosity_hook','vibe_summary']) AS field, unnest([description, why_watch, curiosity_hook, vibe_summary]) AS text FROM editorial)"


@query(
    "lint_voice",
    ["editorial"],
    f"""SELECT id, 'GENERIC_LANGUAGE_REVIEW' AS code, field FROM {LONG_COPY_SQL} WHERE regexp_matches(text, '{_rx(CLICHE_PHRASES)}') UNION ALL SELECT id, 'SPOILER_PATTERN_REVIEW', field FROM {LONG_COPY_SQL} WHERE regexp_matches(text, '{_rx(SPOILER_PHRASES)}')
        UNION ALL SELECT id, 'DESCRIPTION_HOOK_DUPLICATION', 'curiosity_hook' FROM editorial WHERE {DUPLICATE_SQL}""",
)
def _(t):
    return X.lint_voice(editorial(t), "id", COPY_FIELDS, "description", "curiosity_hook")


@query(
    "batch_pattern",
    ["editorial"],
    rf"""m AS (SELECT language, id, field FROM {LONG_COPY_SQL} WHERE regexp_matches(text, '(?i)\b[a-z]+,\s+[a-z]+,\s+and\s+[a-z]+\b'))
         SELECT language, id, field, triads FROM (SELECT *, count(*) OVER (PARTITION BY language) AS triads FROM m) WHERE triads >= 3""",
)
def _(t):
    return X.triad_pattern(editorial(t), "language", "id", COPY_FIELDS)


RATIONALES = [
    "From general knowledge this is slow",
    "Direct evidence: Cues: [overview: a long walk; genre: drama]",
    "Direct evidence: Cues: [memory: a long walk]",
    "Supported inference: Cues: [overview: a long walk]. Bridge: a walk is slow to watch",
    "Supported inference: Cues: [overview: walk; genre: drama]. Bridge: short",
    "Supported inference: Cues: [overview: walk; title: x]. Bridge: a walk is slow to watch",
    "Supported inference: Cues: [overview: walk; genre: drama]. Bridge: a walk is slow to watch",
    "It simply is",
    "Direct evidence: no list",
]
GROUNDING_SQL = rf"""x AS (SELECT id, ({RATIONALES})[CAST(runtime_minutes % {len(RATIONALES)} AS INT) + 1] AS r FROM catalogue),
   y AS (SELECT id, regexp_matches(r, '(?i)\b(?:{X.MEMORY})\b') AS memory, regexp_matches(r, '(?i)^Direct evidence:') AS direct, regexp_matches(r, '(?i)^Supported inference:') AS inferred,
     regexp_matches(r, '(?is)\bBridge:\s*\S.{{11,}}') AS bridge, list_filter(list_transform(string_split(regexp_extract(r, '(?i)\bCues:\s*\[([^\]]+)\]', 1), ';'), lambda s: trim(s)), lambda s: s <> '') AS said FROM x),
   z AS (SELECT *, list_transform(said, lambda s: trim(split_part(s, ':', 1))) AS refs FROM y),
   d AS (SELECT *, len(refs) > 0 AND len(list_filter(refs, lambda v: v NOT IN ('overview', 'genre'))) = 0 AS declared FROM z)
   SELECT id, concat_ws('|', CASE WHEN memory THEN 'UNSUPPORTED_MODEL_MEMORY_ASSERTION' END, CASE WHEN NOT memory AND direct AND NOT declared THEN 'INVALID_DIRECT_EVIDENCE_CUES' END,
     CASE WHEN NOT memory AND inferred AND len(said) < 2 THEN 'TOO_FEW_SUPPORTED_INFERENCE_CUES' END, CASE WHEN NOT memory AND inferred AND NOT declared THEN 'INVALID_SUPPORTED_INFERENCE_CUES' END,
     CASE WHEN NOT memory AND inferred AND NOT bridge THEN 'MISSING_SUPPORTED_INFERENCE_BRIDGE' END, CASE WHEN NOT memory AND NOT direct AND NOT inferred THEN 'MISSING_EVIDENCE_GROUNDING_MODE' END) AS issues FROM d"""


@query("check_grounding", ["catalogue"], GROUNDING_SQL)
def _(t):
    texts = F.array(*[F.lit(r) for r in RATIONALES])
    rows = t.catalogue.select("id", F.element_at(texts, (c("runtime_minutes") % 9 + 1).cast("int")).alias("rationale"))
    return rows.select("id", joined(X.grounding_issues(c("rationale"), F.array(F.lit("overview"), F.lit("genre")))).alias("issues"))


STRIP_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace({x}, '(?is)<sup\b[^>]*>.*?</sup>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '[ \t\r\n\f]+', ' ', 'g'))"""
PARAGRAPH_SQL = r"list_filter(list_transform(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda x: " + STRIP_SQL.format(x="x") + "), lambda p: p <> '')"
CTES["paragraphs"] = ((), f"SELECT page_id, {PARAGRAPH_SQL} AS paragraphs FROM pages")


@query("html_paragraphs", ["paragraphs"], "SELECT page_id, generate_subscripts(paragraphs, 1) AS pos, unnest(paragraphs) AS paragraph FROM paragraphs")
def _(t):
    return t.texts("pages").select("page_id", F.posexplode(X.html_paragraphs(c("html"))).alias("pos", "paragraph")).withColumn("pos", (c("pos") + 1).cast("bigint"))


SENTENCE_SQL = r"""list_filter(CASE WHEN len(regexp_extract_all(x, '[^.!?]+[.!?]+|[^.!?]+$')) = 0 THEN [x] ELSE regexp_extract_all(x, '[^.!?]+[.!?]+|[^.!?]+$') END, lambda s: NOT regexp_matches(s, '(?i)\b(?:award|accolade|nominat|festival|box[ -]?office|gross(?:ed|ing)?|revenue|chart|ranking|ranked|rotten tomatoes|metacritic|imdb|\d+(?:\.\d+)?%|\d+(?:\.\d+)?\s*(?:out of|/|stars?))'))"""
CLEAN_SQL = r"list_filter(list_transform(paragraphs, lambda x: trim(regexp_replace(array_to_string(" + SENTENCE_SQL + r", ' '), '[ \t\r\n\f]+', ' ', 'g'))), lambda p: length(p) >= 24)"
EXCERPT_SQL = r"nullif(substr(trim(regexp_replace(array_to_string((" + CLEAN_SQL + r")[1:2], ' '), '[ \t\r\n\f]+', ' ', 'g')), 1, 1000), '')"

# each document as a page of two paragraphs, the second about prizes and mood
CTES["doc_pages"] = (
    (),
    """SELECT doc_id, lang, source, '<p>' || text || '</p><p class="x">' || CASE lang WHEN 'en' THEN 'The tone is quiet &amp; tense.<sup>[1]</sup> It won an award.' WHEN 'fr' THEN 'A twist at the ending. The rating is 7/10.' WHEN 'de' THEN 'Streaming since May. A festival of box office records.' ELSE 'Funny, moving, thrilling.' END || '</p>' AS html FROM documents""",
)
CTES["doc_excerpts"] = (("doc_pages",), f"SELECT doc_id, paragraphs, {EXCERPT_SQL} AS excerpt FROM (SELECT doc_id, {PARAGRAPH_SQL} AS paragraphs FROM doc_pages)")


def doc_pages(t: Tables) -> DataFrame:
    lang = c("lang")
    second = (
        F.when(lang == "en", "The tone is quiet &amp; tense.<sup>[1]</sup> It won an award.")
        .when(lang == "fr", "A twist at the ending. The rating is 7/10.")
        .when(lang == "de", "Streaming since May. A festival of box office records.")
        .otherwise("Funny, moving, thrilling.")
    )
    return t.texts("documents").select(
        "doc_id",
        F.concat(F.lit("<p>"), "text", F.lit('</p><p class="x">'), second, F.lit("</p>")).alias("html"),
    )


@query("drop_sentences", ["doc_excerpts"], "SELECT doc_id, excerpt FROM doc_excerpts")
def _(t):
    return doc_pages(t).select("doc_id", X.descriptive_excerpt(X.html_paragraphs(c("html"))).alias("excerpt"))


@query(
    "select_section",
    ["sections"],
    "SELECT page, min(pos) AS pos, arg_min(heading, pos) AS heading FROM sections WHERE lower(heading) IN ('critical response','reception','critical reception','release and reception') GROUP BY page",
)
def _(t):
    return X.select_section(sections(t), "page", "pos", "heading")


@query(
    "diagnose_sections",
    ["ancestry"],
    r"""f AS (SELECT page, bool_or(e) AS e, bool_or(l AND regexp_matches(h, '\brelease\b') AND regexp_matches(h, '\breception\b')) AS c, bool_or(l AND ancestors <> '') AS n, bool_or(l AND regexp_matches(h, '\b(reviews?|critics?)\b') AND NOT regexp_matches(h, '\breception\b')) AS d, bool_or(l) AS k, bool_or(h = 'places') AS o
       FROM (SELECT *, NOT e AND regexp_matches(h, '\b(reception|critical( response| reception| reviews?)?|reviews?|critics?)\b') AS l FROM (SELECT page, lower(heading) AS h, ancestors, lower(heading) IN ('critical response','reception','critical reception','release and reception') AS e FROM ancestry)) GROUP BY page)
       SELECT p.page, CASE WHEN e IS NULL THEN 'PAGE_WITH_NO_AUDITABLE_SECTIONS' WHEN e THEN 'ELIGIBLE_SECTION_PRESENT' WHEN c THEN 'COMBINED_RELEASE_RECEPTION_HEADING' WHEN n THEN 'RECEPTION_LIKE_HEADING_NESTED' WHEN d THEN 'CRITICISM_DISTRIBUTED_NON_RECEPTION_SECTIONS' WHEN k THEN 'RECEPTION_LIKE_HEADING_VARIANT' WHEN o THEN 'PAGE_IDENTITY_AMBIGUITY' ELSE 'NO_RECEPTION_LIKE_STRUCTURAL_SECTION' END AS classification
       FROM (SELECT DISTINCT conv_id AS page FROM conversations) p LEFT JOIN f ON f.page = p.page""",
)
def _(t):
    return X.diagnose_sections(t.raw("conversations").select(c("conv_id").alias("page")).distinct(), ancestry(t), "page", "heading")


def _level_sql(family: str) -> str:
    high = X.HIGH_FROM[family]
    n = rf"len(regexp_extract_all(coalesce(excerpt, ''), '(?i)\b(?:{X.RISK_FAMILIES[family]})\b'))"
    return f"CASE WHEN {n} >= {high} THEN 'HIGH' WHEN {n} >= 1 THEN 'MODERATE' ELSE 'LOW' END AS {family}"


# the section of a document is the first one of the conversation of that number, or plain reception
CTES["doc_sections"] = (
    ("doc_excerpts", "sections"),
    """SELECT d.doc_id, paragraphs, coalesce(s.heading, 'Reception') AS heading,
         CASE WHEN lower(coalesce(s.heading, 'Reception')) IN ('critical response','reception','critical reception','release and reception') THEN excerpt END AS excerpt
       FROM doc_excerpts d LEFT JOIN (SELECT page, arg_min(heading, pos) AS heading FROM sections GROUP BY page) s ON s.page = d.doc_id""",
)


def doc_sections(t: Tables) -> DataFrame:
    first = sections(t).groupBy("page").agg(F.min_by("heading", "pos").alias("heading"))
    joined_pages = doc_pages(t).join(first, c("doc_id") == c("page"), "left")
    return joined_pages.select("doc_id", "html", F.coalesce("heading", F.lit("Reception")).alias("heading"))


CTES["risk"] = (
    ("doc_sections",),
    rf"""SELECT *, length(full_text) > 1000 AND late AS clipped, CASE WHEN lead_n >= 5 THEN 'HIGH' WHEN lead_n >= 2 THEN 'MODERATE' ELSE 'LOW' END AS lead_commercial, lower(heading) = 'release and reception' AS heterogeneous, CASE WHEN excerpt IS NOT NULL AND NOT late AND NOT bad AND experiential <> 'LOW' THEN 'VIABLE' WHEN excerpt IS NOT NULL AND NOT bad THEN 'MARGINAL' ELSE 'NOT_VIABLE' END AS viability FROM (
       SELECT *, 'HIGH' IN (spoiler, prestige, commercial, controversy) AS bad, experiential = 'LOW' AND regexp_matches(full_text, '(?i)\b(?:{X.RISK_FAMILIES["experiential"]})\b') AS late, len(regexp_extract_all(substr(full_text, 1, 1000), '(?i)\b(?:{X.RISK_FAMILIES["commercial"]})\b')) AS lead_n FROM (
       SELECT doc_id, heading, array_to_string(paragraphs, ' ') AS full_text, excerpt, {", ".join(_level_sql(f) for f in X.RISK_FAMILIES)} FROM doc_sections))""",
)


@query("content_risk", ["risk"], "SELECT doc_id, experiential, spoiler, prestige, commercial, controversy, late, lead_commercial, clipped, heterogeneous, viability FROM risk")
def _(t):
    found = X.content_risk(doc_sections(t), "html", "heading")
    return found.select("doc_id", *X.RISK_FAMILIES, "late", "lead_commercial", "clipped", "heterogeneous", "viability")


@query(
    "content_risk_summary",
    ["risk"],
    """n AS (SELECT count(*) AS pages, count(*) FILTER (WHERE viability = 'VIABLE') AS viable, count(*) FILTER (WHERE viability = 'MARGINAL') AS marginal, bool_or(heterogeneous) AS mixed FROM risk)
       SELECT *, CASE WHEN NOT mixed AND viable = pages THEN 'GO' WHEN NOT mixed AND viable + marginal >= ceil(pages * 0.75) THEN 'CONDITIONAL' ELSE 'NO_GO' END AS decision FROM n""",
)
def _(t):
    return A.content_risk_summary(X.content_risk(doc_sections(t), "html", "heading"))


GRAM_SQL = r"""list_distinct(list_transform(list_filter(list_transform(range(1, len(w) - 2), lambda i: w[i:i+3]), lambda g: len(list_filter(g, lambda x: NOT list_contains({stops}, x))) > 0), lambda g: array_to_string(g, ' ')))""".replace("{stops}", str(X.STOP_WORDS))
WORDS_SQL = r"string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 \t\r\n\f]', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g')), ' ')"


@query(
    "ngram_overlap",
    (),
    f"""p AS (SELECT gram, bool_or(item_id % 5 = 0) AS d FROM (SELECT item_id, unnest({GRAM_SQL}) AS gram FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark)) GROUP BY gram),
        g AS (SELECT doc_id, unnest({GRAM_SQL}) AS gram FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents))
        SELECT doc_id, gram, CASE WHEN d THEN 'BLOCKING_MATCH' ELSE 'REVIEW_REQUIRED_MATCH' END AS match_class FROM g JOIN p USING (gram)""",
)
def _(t):
    # every fifth protected text is a distinctive one
    return X.ngram_overlap(t.texts("documents"), "doc_id", "text", t.raw("benchmark"), "text", c("item_id") % 5 == 0)


PHRASES = ["and the", "que les", "und der", "123", "www."]
NAMES = ["the", "que", "und", "est"]


@query(
    "phrase_exposure",
    (),
    "".join(f"SELECT doc_id, 'PHRASE' AS kind, '{p}' AS phrase FROM documents WHERE contains(lower(text), '{p}') UNION ALL " for p in PHRASES)
    + " UNION ALL ".join(rf"SELECT doc_id, 'NAME' AS kind, '{n}' AS phrase FROM documents WHERE regexp_matches(text, '(?i)\b{n}\b')" for n in NAMES),
)
def _(t):
    return X.phrase_exposure(t.texts("documents"), "doc_id", "text", PHRASES, NAMES)


@query(
    "phrases_found",
    ["catalogue"],
    r"""p AS (SELECT DISTINCT title AS phrase FROM catalogue UNION SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ')[1:2]) FROM benchmark UNION SELECT DISTINCT string_split(text, ' ')[4] || ' ' || string_split(text, ' ')[5] FROM benchmark),
       w AS (SELECT phrase, regexp_extract_all(lower(phrase), '[a-z0-9_]+|[^a-z0-9_]') AS t FROM p WHERE phrase <> ''),
       d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+|[^a-z0-9_]') AS t FROM documents),
       e AS (SELECT doc_id, t, unnest(t) AS v, generate_subscripts(t, 1) AS i FROM d)
       SELECT DISTINCT doc_id, phrase FROM e JOIN w ON w.t[1] = v WHERE e.t[i:i + len(w.t) - 1] = w.t AND (regexp_matches(w.t[-1], '^[a-z0-9_]') OR NOT regexp_matches(coalesce(e.t[i + len(w.t)], ''), '^[a-z0-9_]'))""",
)
def _(t):
    # titles, and words and pairs of words of the protected texts: a list that grows with the tables
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ")
    pair = F.split("text", " ")
    bench = t.raw("benchmark")
    phrases = t.catalogue.select(c("title").alias("phrase")).unionByName(bench.select(F.explode(F.slice(words, 1, 2)).alias("phrase")))
    phrases = phrases.unionByName(bench.select(F.concat(F.get(pair, F.lit(3)), F.lit(" "), F.get(pair, F.lit(4))).alias("phrase")))
    return X.phrases_found(t.texts("documents"), "doc_id", "text", phrases)


@query(
    "quote_in_excerpt",
    (),
    r"""SELECT doc_id, CASE WHEN lang = 'de' THEN false ELSE q <> '' AND contains(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')), q) END AS grounded FROM (
         SELECT *, trim(regexp_replace(replace(substr(text, n_chars // 2, 40), ' ', '  '), '[ \t\r\n\f]+', ' ', 'g')) AS q FROM documents)""",
)
def _(t):
    half = F.floor(c("n_chars") / 2).cast("int")
    quote = F.when(c("lang") == "de", "quoted from nowhere").otherwise(F.replace(F.substring("text", half, F.lit(40)), F.lit(" "), F.lit("  ")))
    return t.texts("documents").select("doc_id", X.quote_in_excerpt(c("text"), quote).alias("grounded"))


@query(
    "exposure_scan_ids",
    ["exclusions"],
    r"""l AS (SELECT event_id, CASE event_type WHEN 'click' THEN [user_id] WHEN 'view' THEN list_distinct([user_id, event_id]) ELSE [] END AS ids FROM events)
       SELECT id, count(*) AS texts FROM (SELECT unnest(ids) AS id FROM l) WHERE id IN (SELECT id FROM exclusions) GROUP BY id""",
)
def _(t):
    user, event, kind = c("user_id").cast("string"), c("event_id").cast("string"), c("event_type")
    line = F.when(kind == "click", F.concat(F.lit("see candidateId: '"), user, F.lit("'"))).when(
        kind == "view", F.concat(F.lit('{"id": '), user, F.lit("} tmdbId="), event, F.lit(" xid="), event)
    ).otherwise(c("props"))
    return X.exposure_scan(t.raw("events").select(line.alias("line")), "line", t.exclusions)
