"""Titles matched to pages: requested variants, redirect chains, titles inside longer titles, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import normalized_title
from curatorium.session import stored

#: Characters of a seed: titles that share none can't contain each other.
SEED = 5
ACCEPT = 80
RESOLVED, UNRESOLVED = "RESOLVED_HIGH_CONFIDENCE", "UNRESOLVED_UNIQUE_FILM_PAGE_NOT_ESTABLISHED"


def redirect_ends(redirects: DataFrame) -> DataFrame:
    """(source, final, hops) of every redirect (source, target): the end of its chain, null if it runs into a loop.

    Pointer jumping: in each round a row takes over the target of its target, so chains halve.  A chain of any length has a
    row that ends in the next round; when a round ends none, what is left are loops.  Of several targets of a source the
    smallest counts; a redirect to itself is none.
    """
    rows = redirects.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")))
    rows = rows.groupBy("source").agg(F.min("target").alias("target")).withColumn("hops", F.lit(1).cast("long")).withColumn("ended", F.lit(False))
    rows, open_ = stored(rows, "redirects"), None
    while True:
        onward = rows.select(F.col("source").alias("target"), F.col("target").alias("__next"), F.col("hops").alias("__more"), F.col("ended").alias("__ended"))
        met = rows.join(onward, "target", "left")
        ends = F.col("ended") | F.col("__next").isNull() | F.col("__ended")
        moved = ~F.col("ended") & F.col("__next").isNotNull()
        rows = stored(
            met.select(
                "source", F.when(moved, F.col("__next")).otherwise(F.col("target")).alias("target"),
                (F.col("hops") + F.when(moved, F.col("__more")).otherwise(0)).alias("hops"), ends.alias("ended"),
            ),
            "redirects",
        )
        left = rows.where("not ended").count()
        if left == 0 or left == open_:
            return rows.select("source", F.when(F.col("ended"), F.col("target")).alias("final"), F.when(F.col("ended"), F.col("hops")).alias("hops"))
        open_ = left


def _seeds(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters; none for shorter texts."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.substring(text, at, F.lit(size))))


def containing(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """Pairs of distinct (needle, text) where the text contains the needle; empty needles are contained in nothing.

    A needle is looked up by its rarest seed among the texts, a needle shorter than a seed by itself.  Texts meet needles by
    equality on the seed and are compared afterwards.  Equal needles and equal texts meet once.
    """
    asked = needles.select(F.col(needle).alias("__n")).where(F.col("__n") != "").distinct()
    held = texts.select(F.col(text).alias("__t")).where(F.col("__t") != "").distinct()
    own = F.when(F.length("__n") >= SEED, _seeds(F.col("__n"), SEED)).otherwise(F.array("__n"))
    wanted = asked.select("__n", F.explode(own).alias("__seed"))
    places = held.select("__t", F.explode(F.flatten(F.array(*[_seeds(F.col("__t"), n) for n in range(1, SEED + 1)]))).alias("__seed"))
    places = places.join(wanted.select("__seed").distinct(), "__seed", "left_semi")
    counts = places.groupBy("__seed").agg(F.count(F.lit(1)).alias("__rows"))
    # a needle with a seed that no text has is contained in none
    rarest = wanted.join(counts, "__seed", "left").groupBy("__n").agg(F.min(F.struct(F.coalesce("__rows", F.lit(0)).alias("rows"), F.col("__seed").alias("seed"))).alias("best"))
    rarest = rarest.where("best.rows > 0").select("__n", F.col("best.seed").alias("__seed"))
    found = places.join(rarest, "__seed").where(F.col("__t").contains(F.col("__n")))
    return found.select(F.col("__n").alias(needle), F.col("__t").alias(text))


def _named(text: Column) -> Column:
    return normalized_title(text) != ""


def title_variants(title: Column, year: Column) -> Column:
    """The titles asked for, in order: as it is, as a film, as a film of its year."""
    texts = [title, F.concat(title, F.lit(" (film)")), F.concat(title, F.lit(" ("), year, F.lit(" film)"))]
    return F.array(*[F.struct(F.lit(i).alias("ask"), text.alias("asked")) for i, text in enumerate(texts)])


def title_score(title: Column, year: Column, page_title: Column) -> Column:
    """100, 80 or 60 for a page named like a variant, 20 for one whose name contains the title, and 30 for the year as a word."""
    page, plain = normalized_title(page_title), normalized_title(title)
    named = lambda text: page == normalized_title(text)
    points = (
        F.when(named(F.concat(title, F.lit(" ("), year, F.lit(" film)"))), 100)
        .when(named(F.concat(title, F.lit(" (film)"))), 80)
        .when(named(title), 60)
        .when(page.contains(plain), 20)
        .otherwise(0)
    )
    dated = F.array_contains(F.regexp_extract_all(page_title, F.lit("([A-Za-z0-9_]+)"), 1), year)
    return points + F.when(dated, 30).otherwise(0)


def resolve_titles(facts: DataFrame, pages: DataFrame, redirects: DataFrame, accept: int = ACCEPT) -> DataFrame:
    """The page of each fact (id, title, year): id, result, page_title, score, path.

    Candidates are pages (page_title, disambiguation, structure_score) named like a variant of the title, pages that a variant
    leads to over redirects (source, target), and pages whose name contains the title.  Names meet without case, spaces and
    punctuation, or, where that leaves nothing of a title, as they are.  The best score of at least ``accept`` wins if no other page has it.  ``path`` is the first variant that
    leads to the page with the titles on its way (requested, end of the redirects), or the title and the page found by search.
    Facts without a page are UNRESOLVED; disambiguation pages are no candidates; page titles are unique.
    """
    year = F.col("year").cast("string")
    asked = facts.select("id", "title", year.alias("year"), F.inline(title_variants(F.col("title"), year)))
    ends = redirect_ends(redirects).where("final is not null").select(F.col("source").alias("asked"), "final")
    reached = F.coalesce("final", "asked")
    asked = asked.join(ends, "asked", "left").withColumn("name", F.when(_named(F.col("title")) & _named(reached), normalized_title(reached)).otherwise(F.concat(F.lit("="), reached)))
    open_pages = pages.where(~F.col("disambiguation")).select("page_title", "structure_score", normalized_title(F.col("page_title")).alias("key"))
    names = open_pages.withColumn("name", F.explode(F.array_compact(F.array(F.when(F.col("key") != "", F.col("key")), F.concat(F.lit("="), "page_title")))))
    path = F.when(F.col("final").isNotNull(), F.array("asked", "final")).otherwise(F.array("asked"))
    named = asked.join(names, "name").select("id", "title", "year", "page_title", "structure_score", "ask", path.alias("path"))
    keyed = facts.select("id", "title", year.alias("year"), normalized_title(F.col("title")).alias("needle"))
    inside = containing(keyed, open_pages, "needle", "key")
    searched = keyed.join(inside, "needle").join(open_pages, "key").select(
        "id", "title", "year", "page_title", "structure_score", F.lit(9).alias("ask"), F.array("title", "page_title").alias("path")
    )
    pairs = named.unionByName(searched).groupBy("id", "title", "year", "page_title", "structure_score").agg(F.min_by("path", "ask").alias("path"))
    scored = pairs.select("id", "page_title", "path", (title_score(F.col("title"), F.col("year"), F.col("page_title")) + F.col("structure_score")).alias("score"))
    level = scored.groupBy("id", "score").agg(F.count(F.lit(1)).alias("pages"), F.min("page_title").alias("page_title"), F.min_by("path", "page_title").alias("path"))
    best = level.groupBy("id").agg(F.max(F.struct("score", "pages", "page_title", "path")).alias("b"))
    sure = F.coalesce((F.col("b.score") >= accept) & (F.col("b.pages") == 1), F.lit(False))
    return facts.select("id").join(best, "id", "left").select(
        "id", F.when(sure, RESOLVED).otherwise(UNRESOLVED).alias("result"), F.when(sure, F.col("b.page_title")).alias("page_title"),
        F.col("b.score").alias("score"), F.when(sure, F.col("b.path")).alias("path"),
    )
