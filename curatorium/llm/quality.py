"""Quality rules: a threshold table compiled into one projection, built-in functions only.

``measure`` adds the measures, ``judge`` turns a table of thresholds into one ``array`` of broken rule names.
Nothing is shuffled: every measure is a function of its own row, so a hot source or a group of copies cannot
pile up anywhere, and lost executors only repeat their splits.

Defined cases: a null text counts as empty; an empty text has no words and fails the base rule; repeated rows
are judged alike; further columns pass through, but for those named like a measure, which are replaced (names starting with
``__q_`` are used inside).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm.registry import query, table
from curatorium.llm.store import name

BLANK = r"[\x20\x09-\x0D]+"

# Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this", "are", "or", "an", "at",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "eine", "dem", "im", "für",
    "le", "la", "les", "de", "et", "un", "une", "que", "en", "du", "est", "qui", "dans", "pour", "au", "sur", "par", "avec", "pas",
    "el", "los", "las", "y", "por", "con", "se", "del", "su", "para", "no", "como", "más", "lo", "es", "una",
]


@dataclass(frozen=True)
class Rule:
    """A rule breaks when ``measure`` leaves [low, high]; ratios are integers per thousand, so no rounding differs."""

    name: str
    measure: str
    low: int | None = None
    high: int | None = None


# The threshold table.
RULES = [
    Rule("word_length", "mean_word_milli", 2000, 12000),
    Rule("symbols", "symbol_permille", None, 40),
    Rule("stop_words", "stop_permille", 20, None),
    Rule("duplicate_lines", "dup_line_permille", None, 400),
    Rule("bullet_lines", "bullet_line_permille", None, 900),
    Rule("ellipsis_lines", "ellipsis_line_permille", None, 300),
    Rule("capitals", "upper_permille", None, 500),
]


def _per_thousand(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(F.lit(0)).cast("bigint")


def _strip(text: Column, pattern: str) -> Column:
    """Code points left after deleting ``pattern``."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("bigint")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of the rules."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__q_words", F.filter(F.split(body, BLANK), lambda w: w != ""))
    df = df.withColumn("__q_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    words, lines = F.col("__q_words"), F.col("__q_lines")
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("bigint"),
            "word_chars": _strip(body, BLANK),
            "n_symbols": _strip(body, r"[^#*$%&|<>]+"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            "__q_n_lines": F.size(lines).cast("bigint"),
            "__q_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("bigint"),
            "__q_ellipses": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("bigint"),
            "__q_upper": _strip(body, r"[^\p{Lu}]+"),
            "__q_letters": _strip(body, r"[^\p{L}]+"),
            "__q_stops": F.size(F.filter(words, lambda w: F.lower(F.regexp_replace(w, r"[.,;:!?]+$", "")).isin(STOP_WORDS))).cast("bigint"),
        }
    )
    df = _with_repeats(df, words, 3)
    return df.withColumns(
        {
            "mean_word_milli": _per_thousand(F.col("word_chars"), F.col("n_words")),
            "symbol_permille": _per_thousand(F.col("n_symbols"), F.col("word_chars")),
            "stop_permille": _per_thousand(F.col("__q_stops"), F.col("n_words")),
            "dup_line_permille": _per_thousand(F.col("n_dup_lines"), F.col("__q_n_lines")),
            "bullet_line_permille": _per_thousand(F.col("__q_bullets"), F.col("__q_n_lines")),
            "ellipsis_line_permille": _per_thousand(F.col("__q_ellipses"), F.col("__q_n_lines")),
            "upper_permille": _per_thousand(F.col("__q_upper"), F.col("__q_letters")),
        }
    )


def _with_repeats(df: DataFrame, words: Column, size: int) -> DataFrame:
    """n_repeat_words: words lying in a window of ``size`` words that occurs twice or more in the row.

    Windows are compared by a 64-bit hash; only rows that do repeat a window are sorted and measured.
    """
    last = F.size(words) - size
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    df = df.withColumn("__q_hash", F.when(last >= 1, windows))
    hashes = F.col("__q_hash")
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn("__q_sorted", F.when(repeats, F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    ordered = F.col("__q_sorted")
    twice = F.filter(
        ordered,
        lambda x, j: F.coalesce(x["h"] == F.get(ordered, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, j + 1)["h"], F.lit(False)),
    )
    df = df.withColumn("__q_starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    starts = F.col("__q_starts")
    covered = F.aggregate(
        F.transform(starts, lambda s, j: F.least(F.coalesce(F.get(starts, j + 1) - s, F.lit(size)), F.lit(size)).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))


def broken_rules(rules: Sequence[Rule] = RULES) -> Column:
    """The names of the broken rules, in table order: the threshold table as one expression."""
    parts = []
    for rule in rules:
        broken = F.lit(False)
        if rule.low is not None:
            broken = broken | (F.col(rule.measure) < rule.low)
        if rule.high is not None:
            broken = broken | (F.col(rule.measure) > rule.high)
        parts.append(F.when(broken, F.lit(rule.name)))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


RESULTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_milli", "symbol_permille", "stop_permille",
    "dup_line_permille", "bullet_line_permille", "ellipsis_line_permille", "upper_permille", "base_failed", "broken", "kept",
]


def quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with the measures, base_failed, broken (rule names) and kept."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    df = with_measures(docs, text)
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = df.withColumn("broken", broken_rules(rules))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    found = [F.col(c) for c in RESULTS]
    others = [F.col(name(c)) for c in docs.columns]
    # a generator keeps a later filter from being pushed down, which would write the nested measures out over and over
    once = F.explode(F.array(F.struct(*found))).alias("__q")
    return df.select(*others, once).select(*others, "__q.*")


OUTPUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken"]


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
g AS (SELECT rid, i, concat_ws(chr(1), ws[i], ws[i + 1], ws[i + 2]) AS k FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM (SELECT rid, i, unnest([0, 1, 2]) AS o FROM f) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(ls) AS BIGINT) AS n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS uppers, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters,
    len(list_filter(ws, lambda x: lower(regexp_replace(x, '[.,;:!?]+$', '')) IN ({_STOPS}))) AS stops
  FROM w LEFT JOIN r USING (rid)
),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    concat_ws(',',
      CASE WHEN (CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END) NOT BETWEEN 2000 AND 12000 THEN 'word_length' END,
      CASE WHEN word_chars > 0 AND n_symbols * 1000 // word_chars > 40 THEN 'symbols' END,
      CASE WHEN (CASE WHEN n_words > 0 THEN stops * 1000 // n_words ELSE 0 END) < 20 THEN 'stop_words' END,
      CASE WHEN n_lines > 0 AND n_dup_lines * 1000 // n_lines > 400 THEN 'duplicate_lines' END,
      CASE WHEN n_lines > 0 AND bullets * 1000 // n_lines > 900 THEN 'bullet_lines' END,
      CASE WHEN n_lines > 0 AND ellipses * 1000 // n_lines > 300 THEN 'ellipsis_lines' END,
      CASE WHEN letters > 0 AND uppers * 1000 // letters > 500 THEN 'capitals' END) AS broken
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM j
"""


@query("op5_quality_rules", ORACLE)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).withColumn("broken", F.concat_ws(",", "broken")).select(*OUTPUT)
