"""Claims in editorial copy, voice lint, grounding, HTML prose and text overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import EDGE_L, EDGE_R, dense, reasons, settle, words_pattern
from curatorium.operators.rules import CLICHE_PHRASES, SPOILER_PHRASES, duplicate_hook, phrase_pattern

# Fixed vocabularies of the claim rules.
LANGUAGES = [
    "russian", "french", "spanish", "german", "italian", "japanese", "mandarin", "cantonese", "korean", "hindi", "arabic",
    "portuguese", "swedish", "danish", "norwegian", "dutch", "polish", "turkish", "greek", "hebrew", "thai", "vietnamese", "english",
]
SUBGENRES = ["neo-noir", "film noir", "mockumentary", "spaghetti western", "dramedy", "space opera", "cyberpunk", "steampunk"]
DEMONYMS = [
    "french", "italian", "german", "russian", "spanish", "british", "english", "american", "japanese", "canadian", "austrian",
    "chinese", "korean", "australian", "mexican", "danish", "swedish",
]
COMMON_GENRES = [
    "drama", "comedy", "mystery", "thriller", "action", "romance", "adventure", "fantasy", "horror", "crime", "western", "war",
    "documentary", "animation", "family", "history", "music", "science fiction",
]
DEADLINE_PHRASES = ["deadline", "before time runs out", "race against the clock", "race against clock", "ticking clock"]
# Fixed patterns for a span of time the overview itself supports.
DECADE_WORD = "decades?"
YEARS_SPAN = r"(?:[2-9][0-9]|[0-9]0)\s+years"
CALENDAR_DECADE = r"(?:1[89]|20)[0-9]0s|[0-9]{4}s"

LANGUAGE_RULE = "LANGUAGE_CLAIM"
DURATION_RULE = "DURATION_OVERSTATEMENT"
SUBGENRE_RULE = "SUBGENRE_ASSERTION"
NATIONALITY_RULE = "NATIONALITY_GENRE_COLLAPSE"
DEADLINE_RULE = "DEADLINE_CLAIM"
RULES = [LANGUAGE_RULE, DURATION_RULE, SUBGENRE_RULE, NATIONALITY_RULE, DEADLINE_RULE]


def _edged(pattern: str) -> str:
    return f"(?i){EDGE_L}(?:{pattern}){EDGE_R}"


def _matches(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_edged(pattern)), 0), lambda m: F.lower(m))


def unpivot_copy(rows: DataFrame, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return rows.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.*").where(F.col("text").isNotNull())


def boundary_rules(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per unsupported claim: (key, rule, field, matched).

    Facts are columns ``spoken``, ``genres``, ``countries`` (arrays, lower case)
    and ``overview``.
    """
    overview = F.lower(F.coalesce("overview", F.lit("")))
    long = unpivot_copy(
        rows.withColumns(
            {
                "__dated": overview.rlike(_edged(DECADE_WORD)) | overview.rlike(_edged(YEARS_SPAN)) | overview.rlike(_edged(CALENDAR_DECADE)),
                "__timed": overview.contains("deadline") | overview.contains("clock") | overview.contains("time runs out"),
            }
        ),
        fields,
        [key, "spoken", "genres", "countries", "__dated", "__timed"],
    )
    text = F.col("text")
    none = F.array().cast("array<string>")
    named = lambda m: F.split_part(m, F.lit("-"), F.lit(1))
    language = F.filter(
        _matches(text, "[A-Za-z]+-language"),
        lambda m: named(m).isin(*LANGUAGES) & ~F.array_contains(F.col("spoken"), named(m)),
    )
    duration = F.when(~F.col("__dated"), _matches(text, DECADE_WORD)).otherwise(none)
    subgenre = F.filter(
        F.array_distinct(_matches(text, "|".join(SUBGENRES))),
        lambda m: ~F.exists("genres", lambda g: F.contains(g, m) | F.contains(m, g)),
    )
    nation = F.when(
        F.size("countries") > 1,
        F.array_distinct(
            F.transform(
                _matches(text, rf"(?:{'|'.join(DEMONYMS)})\s+(?:{'|'.join(COMMON_GENRES)})"),
                lambda m: F.regexp_replace(m, r"\s+", " "),
            )
        ),
    ).otherwise(none)
    deadline = F.when(~F.col("__timed"), F.array_distinct(_matches(text, "|".join(DEADLINE_PHRASES)))).otherwise(none)
    tagged = [F.transform(found, _tagger(rule)) for rule, found in zip(RULES, (language, duration, subgenre, nation, deadline))]
    found = settle(long, __hits=F.concat(*tagged))
    return found.select(key, "field", F.explode("__hits").alias("h")).select(key, "h.rule", "field", "h.matched")


def _tagger(rule: str):
    return lambda m: F.named_struct(F.lit("rule"), F.lit(rule), F.lit("matched"), m)


def classify_hit() -> Column:
    """What the human review says about a hit; expects hit, decision, fields, reason and overview columns."""
    reason, rule = F.lower(F.coalesce("human_reason", F.lit(""))), F.col("rule")
    calendar = F.lower(F.coalesce("overview", F.lit(""))).rlike(_edged(CALENDAR_DECADE))
    in_field = F.array_contains("affected_fields", F.col("field"))
    mentioned = (
        F.contains(reason, F.col("matched"))
        | ((rule == NATIONALITY_RULE) & reason.rlike("co-production|nationality"))
        | ((rule == SUBGENRE_RULE) & reason.contains("subgenre"))
        | ((rule == DEADLINE_RULE) & reason.rlike("deadline|ticking clock"))
        | ((rule == DURATION_RULE) & reason.contains("decade"))
    )
    return (
        F.when(F.col("human_decision") == "APPROVE", "UNADJUDICATED_HIT")
        .when((rule == DURATION_RULE) & calendar & ~reason.contains("decade"), "SOURCE_SUPPORTED_FALSE_HIT")
        .when(in_field & mentioned, "HUMAN_CONFIRMED_DEFECT")
        .when(~in_field & ~mentioned, "SOURCE_SUPPORTED_FALSE_HIT")
        .otherwise("AMBIGUOUS")
    )


def lint_voice(rows: DataFrame, key: str, fields: Sequence[str], description: str, hook: str) -> DataFrame:
    """(key, code, field) per cliche, spoiler phrase or description repeated as hook."""
    long = unpivot_copy(rows, fields, [key])
    found = reasons(
        (F.col("text").rlike(phrase_pattern(CLICHE_PHRASES)), "GENERIC_LANGUAGE_REVIEW"),
        (F.col("text").rlike(phrase_pattern(SPOILER_PHRASES)), "SPOILER_PATTERN_REVIEW"),
    )
    per_field = long.select(key, F.explode(found).alias("code"), "field")
    twins = rows.where(duplicate_hook(F.col(description), F.col(hook)))
    return per_field.unionByName(twins.select(key, F.lit("DESCRIPTION_HOOK_DUPLICATION").alias("code"), F.lit(hook).alias("field")))


# Fixed pattern: three words in a row.
TRIAD = rf"(?i){EDGE_L}[a-z]+,\s+[a-z]+,\s+and\s+[a-z]+{EDGE_R}"


def triad_pattern(rows: DataFrame, batch: str, key: str, fields: Sequence[str], threshold: int = 3) -> DataFrame:
    """Fields with an adjective triad in batches that have at least ``threshold`` of them."""
    hits = unpivot_copy(rows, fields, [batch, key]).where(F.col("text").rlike(TRIAD)).select(batch, key, "field")
    many = hits.groupBy(batch).agg(F.count(F.lit(1)).alias("triads")).where(F.col("triads") >= threshold)
    return hits.join(many, batch)


# Fixed phrases that show a rationale rests on memory.
MEMORY = r"model memory|pretrained knowledge|outside knowledge|i (?:know|recall)|general knowledge"


def grounding_issues(rationale: Column, source_refs: Column) -> Column:
    """A rationale must name its mode and cite declared sources; inference needs two cues and a bridge."""
    cues = F.split(F.regexp_extract(rationale, rf"(?i){EDGE_L}Cues:\s*\[([^\]]+)\]", 1), ";")
    said = F.filter(F.transform(cues, lambda c: F.trim(c)), lambda c: c != "")
    refs = F.filter(F.transform(said, lambda c: F.trim(F.split_part(c, F.lit(":"), F.lit(1)))), lambda r: r != "")
    declared = (F.size(refs) > 0) & (F.size(F.array_except(refs, source_refs)) == 0)
    memory = rationale.rlike(_edged(MEMORY))
    direct, inference = rationale.rlike(r"(?i)^Direct evidence:\s*"), rationale.rlike(r"(?i)^Supported inference:\s*")
    live = rationale.isNotNull() & ~memory
    bridge = rationale.rlike(rf"(?is){EDGE_L}Bridge:\s*\S.{{11,}}")
    return reasons(
        (memory, "UNSUPPORTED_MODEL_MEMORY_ASSERTION"),
        (live & direct & ~declared, "INVALID_DIRECT_EVIDENCE_CUES"),
        (live & inference & (F.size(said) < 2), "TOO_FEW_SUPPORTED_INFERENCE_CUES"),
        (live & inference & ~declared, "INVALID_SUPPORTED_INFERENCE_CUES"),
        (live & inference & ~bridge, "MISSING_SUPPORTED_INFERENCE_BRIDGE"),
        (live & ~direct & ~inference, "MISSING_EVIDENCE_GROUNDING_MODE"),
    )


SPACE = "[ \\t\\r\\n\\f]+"
# the runs of white space that are not one space already
WIDE_SPACE = "[\\t\\r\\n\\f][ \\t\\r\\n\\f]*| [ \\t\\r\\n\\f]+"


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WIDE_SPACE, " "))


def strip_html(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, rf"(?is)<sup{EDGE_R}[^>]*>.*?</sup>", " "), "<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return collapse_space(plain)


def html_paragraphs(html: Column) -> Column:
    """Non-empty texts of the ``<p>`` blocks."""
    blocks = F.regexp_extract_all(html, F.lit(rf"(?is)<p{EDGE_R}[^>]*>(.*?)</p>"), 1)
    return F.filter(F.transform(blocks, lambda b: strip_html(b)), lambda p: p != "")


# Fixed pattern of sentences about awards, money and scores.
PROHIBITED = (
    r"(?i)(?=[abcfgimnr0-9])" + EDGE_L + r"(?:award|accolade|nominat|festival|box[ -]?office|gross(?:ed|ing)?|revenue|chart|ranking|ranked|"
    r"rotten tomatoes|metacritic|imdb|[0-9]+(?:\.[0-9]+)?%|[0-9]+(?:\.[0-9]+)?\s*(?:out of|/|stars?))"
)


def drop_sentences(paragraph: Column) -> Column:
    found = F.regexp_extract_all(paragraph, F.lit(r"[^.!?]+[.!?]+|[^.!?]+$"), 0)
    # bound by a lambda, or the sentences would be cut once for the test and once more for the result
    sentences = F.flatten(F.transform(F.array(found), lambda f: F.when(F.size(f) == 0, F.array(paragraph)).otherwise(f)))
    return collapse_space(F.array_join(F.filter(sentences, lambda s: ~s.rlike(PROHIBITED)), " "))


def descriptive_excerpt(paragraphs: Column, minimum: int = 24, limit: int = 1000) -> Column:
    """The excerpt kept as evidence: the first two clean paragraphs, at most ``limit`` characters."""
    clean = F.filter(F.transform(paragraphs, lambda p: drop_sentences(p)), lambda p: F.length(p) >= minimum)
    cut = F.substring(collapse_space(F.array_join(F.slice(clean, 1, 2), " ")), 1, limit)
    # bound by a lambda: a plain nullif would work out the whole excerpt twice
    return F.get(F.transform(F.array(cut), lambda text: F.when(text != "", text)), F.lit(0))


# Fixed lists and patterns of section headings.
ELIGIBLE_HEADINGS = ["critical response", "reception", "critical reception", "release and reception"]
RECEPTION_LIKE = r"reception|critical(?:\s+response|\s+reception|\s+reviews?)?|reviews?|critics?"
OTHER_USES = [
    "people", "astronomy", "computing", "film and television", "greek mythology", "music", "organizations", "places",
    "science and medicine", "other uses",
]


def eligible_heading(heading: Column) -> Column:
    return F.lower(collapse_space(heading)).isin(*ELIGIBLE_HEADINGS)


def select_section(sections: DataFrame, page: str, pos: str, heading: str) -> DataFrame:
    """First eligible section of each page."""
    return sections.where(eligible_heading(F.col(heading))).groupBy(page).agg(
        F.min(pos).alias(pos), F.min_by(heading, pos).alias(heading)
    )


def diagnose_sections(pages: DataFrame, ancestry: DataFrame, page: str, heading: str) -> DataFrame:
    """Class of each page's section structure; the first matching class wins."""
    h = F.col(heading)
    eligible = eligible_heading(h)
    like = ~eligible & h.rlike(_edged(RECEPTION_LIKE))
    has = lambda cond, name: F.coalesce(F.bool_or(cond), F.lit(False)).alias(name)
    flags = ancestry.groupBy(page).agg(
        has(eligible, "eligible"),
        has(like & h.rlike(_edged("release")) & h.rlike(_edged("reception")), "combined"),
        has(like & (F.size("ancestors") > 0), "nested"),
        has(like & h.rlike(_edged("reviews?|critics?")) & ~h.rlike(_edged("reception")), "distributed"),
        has(like, "candidate"),
        has(F.lower(h).isin(*OTHER_USES), "other"),
    )
    kind = (
        F.when(F.col("eligible").isNull(), "PAGE_WITH_NO_AUDITABLE_SECTIONS")
        .when(F.col("eligible"), "ELIGIBLE_SECTION_PRESENT")
        .when(F.col("combined"), "COMBINED_RELEASE_RECEPTION_HEADING")
        .when(F.col("nested"), "RECEPTION_LIKE_HEADING_NESTED")
        .when(F.col("distributed"), "CRITICISM_DISTRIBUTED_NON_RECEPTION_SECTIONS")
        .when(F.col("candidate"), "RECEPTION_LIKE_HEADING_VARIANT")
        .when(F.col("other"), "PAGE_IDENTITY_AMBIGUITY")
        .otherwise("NO_RECEPTION_LIKE_STRUCTURAL_SECTION")
    )
    return pages.select(page).join(flags, page, "left").select(page, kind.alias("classification"))


# Fixed word families of the content risk audit.
RISK_FAMILIES = {
    "experiential": "tone|tonal|style|stylish|rhythm|rhythmic|pace|paced|atmosphere|atmospheric|humou?r|comic|comedy|funny|tension|tense|suspense|moving|emotional|affect|audience|entertaining|thrilling|haunting|meditative|quiet|intense|energetic",
    "spoiler": "ending|finale|reveal|twist|dies|death of|killer is|culminates|eventually|in the final|last scene|outcome",
    "prestige": "award|accolade|masterpiece|canon|greatest|best film|ranked|top ten|retrospective|legacy|historical standing",
    "commercial": "box office|grossed|release date|released on|streaming|distribution|festival|rotten tomatoes|metacritic|rating|approval rating",
    "controversy": "controversy|controversial|censor|censorship|protest|political reaction|public reaction|backlash|banned",
}
HIGH_FROM = {"experiential": 3, "spoiler": 2, "prestige": 3, "commercial": 3, "controversy": 2}
# Fixed: characters of the budget, and commercial mentions in the unfiltered lead from which they dominate.
BUDGET = 1000
LEAD_MODERATE, LEAD_HIGH = 2, 5


def _listed(phrases: str) -> str:
    """The pattern of listed phrases, grouped by first letter: a place in a text tries a branch per letter, not per phrase.

    Only phrases of the same first letter can compete for a place, and they keep their order, so the matches are the same.
    """
    letters: dict[str, list[str]] = {}
    for phrase in phrases.split("|"):
        letters.setdefault(phrase[0], []).append(phrase[1:])
    return rf"(?i)(?=[{''.join(letters)}]){EDGE_L}(?:{'|'.join(f'{a}(?:{"|".join(rest)})' for a, rest in letters.items())}){EDGE_R}"


def _only(phrases: str):
    return lambda found: found.rlike(rf"(?i)^(?:{phrases})$")


def content_risk(rows: DataFrame, html: str, heading: str) -> DataFrame:
    """Risk level per word family over the kept excerpt, and whether the section is usable as evidence.

    A section under another heading than the eligible ones keeps no excerpt.  ``lead_commercial`` looks at the first
    characters before any sentence is dropped, ``clipped`` says that the budget ends before the useful prose, and
    ``heterogeneous`` that release and reception share a section.
    """
    read = settle(rows, paragraphs=html_paragraphs(F.col(html)))
    kept = F.when(eligible_heading(F.col(heading)), descriptive_excerpt(F.col("paragraphs")))
    read = settle(read, excerpt=F.coalesce(kept, F.lit("")), full_text=F.array_join("paragraphs", " "))
    read = settle(read, lead=F.substring("full_text", 1, BUDGET))
    level = lambda n, high: F.when(n >= high, "HIGH").when(n >= 1, "MODERATE").otherwise("LOW")
    # phrases of two families never share a word, so one reading of the excerpt finds what a reading per family would
    read = settle(
        read,
        lead_n=F.regexp_count("lead", F.lit(_listed(RISK_FAMILIES["commercial"]))),
        __found=F.regexp_extract_all("excerpt", F.lit(_listed("|".join(RISK_FAMILIES.values()))), 0),
    )
    counts = {f: f"__n_{f}" for f in RISK_FAMILIES}
    of_family = {f: F.filter("__found", _only(p)) for f, p in RISK_FAMILIES.items()}
    read = settle(read, **{counts[f]: F.size(found) for f, found in of_family.items()}).drop("__found")
    read = settle(
        read,
        late=(F.col(counts["experiential"]) == 0) & F.col("full_text").rlike(_listed(RISK_FAMILIES["experiential"])),
        **{f: level(F.col(n), HIGH_FROM[f]) for f, n in counts.items()},
    ).drop(*counts.values())
    lead = F.when(F.col("lead_n") >= LEAD_HIGH, "HIGH").when(F.col("lead_n") >= LEAD_MODERATE, "MODERATE").otherwise("LOW")
    read = read.withColumns(
        {
            "lead_commercial": lead,
            "clipped": (F.length("full_text") > BUDGET) & F.col("late"),
            "heterogeneous": F.coalesce(F.lower(collapse_space(F.col(heading))) == "release and reception", F.lit(False)),
        }
    )
    usable = F.col("excerpt") != ""
    bad = F.lit(False)
    for family in ("spoiler", "prestige", "commercial", "controversy"):
        bad = bad | (F.col(family) == "HIGH")
    viability = (
        F.when(usable & ~F.col("late") & ~bad & (F.col("experiential") != "LOW"), "VIABLE").when(usable & ~bad, "MARGINAL").otherwise("NOT_VIABLE")
    )
    return read.withColumn("viability", viability).drop("paragraphs", "full_text", "lead", "lead_n")


# Fixed stop words: a run of only these is no evidence of copying.
STOP_WORDS = [
    "a", "an", "the", "in", "on", "at", "of", "to", "for", "is", "are", "was", "were", "and", "or", "it", "that", "this", "with", "by", "as", "from", "be", "not", "all", "its", "into", "their", "can", "do", "how",
    "what", "where", "when", "will", "then", "than", "so", "if", "up", "out", "no", "only",
]


def explode_grams(rows: DataFrame, text: str, n: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., gram): distinct word n-grams of each whole text, without runs of stop words only.

    The word list is settled first: a lambda would otherwise rebuild it for every gram.
    """
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9 \\t\\r\\n\\f]", " "), SPACE, " ")
    words = settle(rows.select(*keep, text), __w=F.split(F.trim(clean), " "))
    w = F.col("__w")
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.slice(w, i, n))
    kept = F.filter(grams, lambda g: F.exists(g, lambda v: ~v.isin(*STOP_WORDS)))
    texts = settle(words.drop(text), __g=F.array_distinct(F.transform(kept, lambda g: F.array_join(g, " "))))
    return texts.select(*keep, F.explode("__g").alias("gram"))


def ngram_overlap(texts: DataFrame, key: str, text: str, protected: DataFrame, protected_text: str, distinctive: Column) -> DataFrame:
    """(key, gram, class) for grams shared with protected texts.

    Protected grams become a dictionary of unique grams first, so a frequent
    gram meets each text once and never pairs texts with protected texts.
    """
    dictionary = (
        explode_grams(protected.withColumn("__d", distinctive), protected_text, keep=["__d"])
        .groupBy("gram")
        .agg(F.bool_or("__d").alias("__d"))
    )
    grams = explode_grams(texts, text, keep=[key])
    kind = F.when(F.col("__d"), "BLOCKING_MATCH").otherwise("REVIEW_REQUIRED_MATCH")
    return grams.join(dictionary, "gram").select(key, "gram", kind.alias("match_class"))


def phrase_exposure(texts: DataFrame, key: str, text: str, phrases: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(key, kind, phrase) for listed phrases (anywhere) and names (between word edges) in a text."""
    lower = F.lower(F.col(text))
    found = [F.when(F.contains(lower, F.lit(p.lower())), F.struct(F.lit("PHRASE").alias("kind"), F.lit(p).alias("phrase"))) for p in phrases]
    found += [F.when(F.col(text).rlike(words_pattern([n])), F.struct(F.lit("NAME").alias("kind"), F.lit(n).alias("phrase"))) for n in names]
    return texts.select(key, F.explode(F.array_compact(F.array(*found))).alias("p")).select(key, "p.*")


def _tokens(text: Column) -> Column:
    """Words and single other characters in order; only ASCII letters are lower-cased, as the rules count them."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_])"), 0)


#: Numbers of slots that list lengths by first token, and of 64-bit words that mark the phrases of a list.
SLOTS, MARKS = 1 << 16, 1 << 17


def phrase_trie(phrases: DataFrame, phrase: str) -> tuple[Column, Column, DataFrame]:
    """(lengths, marks, whole): what tells early that no phrase begins or stands at a place, and all phrases by their tokens.

    ``lengths`` lists per slot the lengths in tokens of the phrases whose first token falls into it, ``marks`` has a bit set per
    phrase.  Both are arrays of a fixed number of entries however long the list is (of ``lengths``, an entry holds at most the
    different lengths that phrases have).  Tokens or phrases that share a slot or a bit only let more through; ``whole`` decides.
    """
    rows = phrases.select(F.col(phrase).alias("phrase")).where(F.col("phrase") != "").distinct().select("phrase", _tokens(F.col("phrase")).alias("__t"))
    whole = rows.select("phrase", F.array_join("__t", "").alias("__gram"), F.size("__t").alias("__n"), F.get("__t", F.lit(0)).alias("__first"))

    lengths = dense(whole.select(_slot(F.col("__first")).alias("__at"), "__n"), SLOTS, F.sort_array(F.collect_set("__n")))
    word, bit = _mark(F.col("__gram"))
    marks = dense(whole.select(word.alias("__at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bit")), MARKS, F.coalesce(F.bit_or("__bit"), F.lit(0).cast("long")))
    return lengths, marks, whole.select("phrase", "__gram")


def _slot(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SLOTS))


def _mark(gram: Column) -> tuple[Column, Column]:
    """The place of a phrase's word among the marks, and its bit there."""
    at = F.pmod(F.xxhash64(gram), F.lit(64 * MARKS))
    return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")


def phrases_found(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(key, phrase) for every phrase of a table that stands in a text between word edges, case of ASCII letters aside.

    The same as testing each phrase by a pattern, for lists of any length: a text is cut into tokens once, a token that begins
    phrases is followed by as many tokens as these phrases are long (a short list of lengths per first token), and the
    sequence meets the phrases by equality.  Texts never meet the whole list, which may be as large as a table; a frequent
    first token costs its lengths, not its phrases.  Neither texts nor tokens are shuffled: a task looks tokens and sequences
    up in two arrays of fixed size, and only sequences that are most likely phrases leave it, once per key.
    """
    lengths, marks, whole = phrase_trie(phrases, phrase)
    cut = settle(texts.select(key, text), __t=_tokens(F.col(text))).drop(text)
    begun = cut.select(key, "__t", F.posexplode("__t").alias("__i", "__first"))
    begun = begun.select(key, "__t", "__i", F.explode(F.get(lengths, _slot(F.col("__first")))).alias("__n"))
    t, at, n = F.col("__t"), F.col("__i"), F.col("__n")
    is_word = lambda v: F.coalesce(v.rlike("^[A-Za-z0-9_]"), F.lit(False))
    whole_begin = is_word(F.get(t, at)) | ~is_word(F.get(t, at - 1))
    whole_end = is_word(F.get(t, at + n - 1)) | ~is_word(F.get(t, at + n))
    grams = begun.where((at + n <= F.size(t)) & whole_begin & whole_end).select(key, F.array_join(F.slice(t, at + 1, n), "").alias("__gram"))
    word, bit = _mark(F.col("__gram"))
    met = grams.where(F.getbit(F.get(marks, word), bit) == 1).distinct()
    # keys with sequences are distinct here, and a phrase has one sequence
    return met.join(whole, "__gram").select(key, "phrase")


def quote_in_excerpt(excerpt: Column, quote: Column) -> Column:
    """A non-blank quote occurs in the excerpt, whitespace aside."""
    wanted = collapse_space(quote)
    return F.coalesce((wanted != "") & F.contains(collapse_space(excerpt), wanted), F.lit(False))


# Fixed patterns: where an id stands in a text.
ID_PATTERNS = [rf"{EDGE_L}(?:candidateId|tmdbId)\s*[:=]\s*['\"]?([0-9]+){EDGE_R}", rf"[\"']id[\"']\s*:\s*([0-9]+){EDGE_R}"]


def exposure_scan(texts: DataFrame, text: str, cohort: DataFrame, key: str = "id") -> DataFrame:
    """Cohort ids that occur in a text corpus in an identity position, with the number of texts."""
    ids = F.array_distinct(F.concat(*[F.regexp_extract_all(F.col(text), F.lit(p), 1) for p in ID_PATTERNS]))
    seen = texts.select(F.explode(ids.cast("array<bigint>")).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("texts"))
    return seen.join(cohort.select(key).distinct(), key, "left_semi")
