"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \b is Unicode aware; the rules count ASCII word edges only.
EDGE_L = r"(?<![A-Za-z0-9_])"
EDGE_R = r"(?![A-Za-z0-9_])"


def words_pattern(words: Sequence[str]) -> str:
    """Case-insensitive pattern matching any of the words between ASCII word edges."""
    return f"(?i){EDGE_L}(?:{'|'.join(words)}){EDGE_R}"


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the texts whose condition holds, in the given order; null conditions do not hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]))


def issue(severity: str, code: str, field: str, cond: Column) -> Column:
    """One rule: a (severity, code, field) struct when the condition holds, else null."""
    return F.when(
        F.coalesce(cond, F.lit(False)),
        F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).alias("field")),
    )


def issues(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def hard(issue_array: Column | str) -> Column:
    array = F.col(issue_array) if isinstance(issue_array, str) else issue_array
    return F.filter(array, lambda i: i["severity"] == "hard_fail")


def issue_text(issue_array: Column | str) -> Column:
    array = F.col(issue_array) if isinstance(issue_array, str) else issue_array
    return F.array_join(F.transform(array, lambda i: F.concat_ws(":", i["code"], i["field"])), "|")


def joined(array: Column | str) -> Column:
    return F.array_join(array, "|")


def overlap_count(first: Column, second: Column) -> Column:
    """Values of ``first`` (repeats counted) that occur in ``second``."""
    return F.size(F.filter(first, lambda x: F.array_contains(second, x)))


def jaccard(first: Column, second: Column) -> Column:
    """Set overlap; two empty sets agree fully."""
    union = F.size(F.array_union(first, second))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(first, second)) / union)


def same_set(first: Column, second: Column) -> Column:
    return F.sort_array(F.array_distinct(first)) == F.sort_array(F.array_distinct(second))


def digest(*columns: str) -> Column:
    """sha256 of the JSON object of the columns, keys in sorted order, nulls kept."""
    fields = F.struct(*[F.col(c).alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def preimage_hash(separator: str, *parts: Column | str) -> Column:
    """sha256 hex of the parts joined by a separator; plain strings are literals, a null is U+0000."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]
    return F.sha2(F.concat_ws(separator, *texts), 256)


def hex_mod(hexdigest: Column, modulus: Column) -> Column:
    """First eight hex digits as an integer, modulo ``modulus``."""
    return F.pmod(F.conv(F.substring(hexdigest, 1, 8), 16, 10).cast("bigint"), modulus)


def ordinal_index(column: Column, scale: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in scale]), column)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null when the denominator is zero."""
    return F.when(whole != 0, part / whole)


def word_count(text: Column) -> Column:
    """Whitespace-separated words, 0 for blank text."""
    trimmed = F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t\r\n]+")))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))


def normalized_title(text: Column) -> Column:
    """Lower case, ASCII letters and digits only, so that joined, hyphenated and spaced spellings meet."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def slug(text: Column, year: Column, limit: int = 40) -> Column:
    """Kebab-case slug of a title: compatibility decomposition, marks stripped, cut to ``limit``, plus '-year' if there is one.

    A title without Latin letters or digits is 'movie'.  The cut comes last, so it may leave a hyphen at the end.
    """
    plain = F.lower(F.regexp_replace(decomposed(F.coalesce(text, F.lit(""))), r"[\u0300-\u036f]", ""))
    body = F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    base = F.when(body == "", F.lit("movie")).otherwise(body)
    return F.when(year > 0, F.concat(base, F.lit("-"), year.cast("string"))).otherwise(base)


def decomposed(text: Column) -> Column:
    """Unicode compatibility decomposition (NFKD), which no built-in function has; whole Arrow batches at a time."""

    @F.pandas_udf("string")
    def nfkd(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKD")

    return nfkd(text)


def settle(df, **columns: Column):
    """Add columns computed once per row.

    Going through a generator keeps the optimizer from copying a long expression
    into every later use of its result.
    """
    return df.select("*", F.stack(F.lit(1), *columns.values()).alias(*columns))


def dense(listed, size: int, entry: Column) -> Column:
    """One array with an entry for each of the places 0 to ``size`` - 1 that rows name in ``__at``, worked out once per query.

    ``entry`` aggregates the rows of a place; a place without rows has one row of nulls.
    """
    every = listed.unionByName(listed.sparkSession.range(0, size, 1, 1).select(F.col("id").alias("__at")), allowMissingColumns=True)
    placed = every.groupBy("__at").agg(entry.alias("__entry"))
    return placed.agg(F.sort_array(F.collect_list(F.struct("__at", "__entry")))["__entry"]).scalar()
