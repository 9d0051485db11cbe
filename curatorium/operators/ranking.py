"""Ranked selection: pools, pages, quotas, round robin and seeded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatorium.functions.columns import hex_mod, overlap_count, preimage_hash
from curatorium.functions.spread import earlier_max, hash_bucket, integer_bucket, ranked
from curatorium.session import stored


def rank_pool(pool: DataFrame, by_tier: bool = True) -> DataFrame:
    """Position of every row of a request's pool: tier, score descending, catalogue order."""
    order = [F.col("score").desc(), F.col("ord").asc()]
    buckets = [(F.col("score"), False), (integer_bucket("ord"), True)]
    if by_tier:
        order.insert(0, F.col("tier").asc())
        buckets.insert(0, (F.col("tier"), True))
    return ranked(pool, ["request_id"], order, buckets, out="position", size_out="pool_size")


def slate_page(ranked_pool: DataFrame, k: int = 3) -> DataFrame:
    """``k`` rows from the request's offset, wrapping; the whole pool when it has at most ``k``."""
    n, rn = F.col("pool_size"), F.col("position")
    slot = F.when(n <= k, rn - 1).otherwise(F.pmod(rn - 1 - F.col("q_page_offset"), n))
    following = F.when(n <= k, F.lit(0)).otherwise((F.col("q_page_offset") + k) % n)
    return ranked_pool.withColumns({"slot": slot.cast("bigint"), "next_offset": following.cast("bigint")}).where(
        F.col("slot") < k
    )


PROFILE = ["moods", "genres", "pace", "emotional_weight", "attention_demand", "discovery_style", "situations"]


def similarity_score(seed: str, other: str) -> Column:
    """2 per shared mood and genre, 1 per equal ordinal and shared situation."""
    s, o = (lambda c: F.col(f"{seed}.{c}")), (lambda c: F.col(f"{other}.{c}"))
    equal = [(s(c) == o(c)).cast("int") for c in ("pace", "emotional_weight", "attention_demand", "discovery_style")]
    score = overlap_count(s("moods"), o("moods")) * 2 + overlap_count(s("genres"), o("genres")) * 2
    for term in equal:
        score = score + F.coalesce(term, F.lit(0))
    return score + overlap_count(s("situations"), o("situations"))


def similar_items(catalogue: DataFrame, seeds: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` items per seed by score, then catalogue order.

    Seeds meet tag profiles by an equality join on single tags with their weights.  Items of one profile tie for every
    seed, so the first ``k + 1`` profiles by (score, first item) hold the top ``k``, with one item to spare for the seed
    itself, and of each its first ``k + 1`` items.  Where fewer than ``k`` items share a tag, the first items of the
    catalogue fill up with score 0.
    """
    first = Window.partitionBy(*PROFILE).orderBy("ord")
    items = catalogue.select("id", "ord", *PROFILE).withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k + 1)
    items = items.withColumn("head", F.first("ord").over(first))
    of_item = items.where(F.col("__r") == 1).select("head", F.explode(_tags(distinct=True)).alias("t")).select("head", "t.tag")
    of_seed = seeds.select(F.col("id").alias("seed_id"), F.explode(_tags(distinct=False)).alias("t")).groupBy("seed_id", "t.tag").agg(F.sum("t.weight").alias("weight"))
    scored = of_seed.join(of_item, "tag").groupBy("seed_id", "head").agg(F.sum("weight").alias("score"))
    leading = Window.partitionBy("seed_id").orderBy(F.col("score").desc(), "head")
    scored = scored.withColumn("__p", F.row_number().over(leading)).where(F.col("__p") <= k + 1)
    found = scored.join(items.select("id", "ord", "head"), "head").where(F.col("id") != F.col("seed_id")).select("seed_id", "id", "ord", "score")

    # score 0: the first items of the catalogue, enough of them to survive those already found
    spare = 2 * k
    filler = catalogue.select("id", "ord").orderBy("ord").limit(spare).withColumn("slot", F.row_number().over(Window.orderBy("ord")))
    lacking = seeds.select(F.col("id").alias("seed_id")).join(found.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n")), "seed_id", "left")
    lacking = lacking.where(F.coalesce("n", F.lit(0)) < k).withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(spare))))
    extra = lacking.join(filler, "slot").where(F.col("id") != F.col("seed_id")).select("seed_id", "id", "ord", F.lit(0).cast("bigint").alias("score"))
    both = found.unionByName(extra).groupBy("seed_id", "id", "ord").agg(F.max("score").alias("score"))
    best = Window.partitionBy("seed_id").orderBy(F.col("score").desc(), "ord")
    return both.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)


def _tags(distinct: bool) -> Column:
    """(tag, weight) of every value of a profile: 2 for moods and genres, 1 for situations and the ordinals."""

    def listed(column: str, weight: int) -> Column:
        values = F.array_distinct(F.col(column)) if distinct else F.col(column)
        return F.transform(values, lambda v: F.struct(F.concat(F.lit(f"{column}="), v).alias("tag"), F.lit(weight).alias("weight")))

    ordinals = ["pace", "emotional_weight", "attention_demand", "discovery_style"]
    single = F.filter(F.array(*[F.struct(F.concat(F.lit(f"{o}="), F.col(o)).alias("tag"), F.lit(1).alias("weight")) for o in ordinals]), lambda t: t["tag"].isNotNull())
    return F.concat(listed("moods", 2), listed("genres", 2), listed("situations", 1), single)


def quota_by_hash(
    candidates: DataFrame, quotas: DataFrame, stratum: str, id_column: str, hashed: Column
) -> tuple[DataFrame, DataFrame]:
    """First ``quota`` rows per stratum by digest, and the strata that fall short.

    The rank is cut at the largest quota directly on ``row_number``, so each
    task keeps only that many rows per stratum before the shuffle.
    """
    largest = quotas.agg(F.max("quota")).first()[0] or 0
    order = Window.partitionBy(stratum).orderBy("selection_hash", id_column)
    selected = (
        candidates.withColumn("selection_hash", hashed)
        .withColumn("selection_rank", F.row_number().over(order))
        .where(F.col("selection_rank") <= largest)
        .join(quotas.select(stratum, "quota"), stratum)
        .where(F.col("selection_rank") <= F.col("quota"))
    )
    available = candidates.groupBy(stratum).agg(F.count(F.lit(1)).alias("available"))
    short = (
        quotas.select(stratum, "quota")
        .join(available, stratum, "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .where(F.col("available") < F.col("quota"))
    )
    return selected, short


def round_robin(
    rows: DataFrame,
    cell: Sequence[str],
    group: str,
    order: Sequence[Column],
    seed: Column | None,
    quota: Column,
    max_quota: int,
    max_groups: int | None = None,
) -> DataFrame:
    """Per cell, take the best row of each group in turn until ``quota`` rows are chosen.

    Groups go by key text, or by their best row when ``max_groups`` caps them;
    the starting group is the seed digest's first eight hex digits modulo the
    group count, or the first group without a seed.  ``seed`` and ``quota`` are expressions over the cell columns;
    ``max_quota`` bounds the rows any group can contribute.
    """
    inner = Window.partitionBy(*cell, group).orderBy(*order)
    kept = rows.withColumn("__turn", F.row_number().over(inner)).where(F.col("__turn") <= max_quota)
    heads = kept.where(F.col("__turn") == 1)
    group_order = Window.partitionBy(*cell).orderBy(
        *([*order, F.col(group).cast("string")] if max_groups else [F.col(group).cast("string")])
    )
    # limits compare row_number itself: only then does Spark cut every cell per task before the shuffle
    groups = heads.withColumn("__g", F.row_number().over(group_order))
    if max_groups:
        groups = groups.where(F.col("__g") <= max_groups)
    groups = groups.select(*cell, group, (F.col("__g") - 1).alias("__g"))
    count = F.count(F.lit(1)).over(Window.partitionBy(*cell))
    offset = F.lit(0) if seed is None else hex_mod(F.sha2(seed, 256), count)
    groups = groups.withColumn("__slot", F.pmod(F.col("__g") - offset, count)).drop("__g")
    pick = Window.partitionBy(*cell).orderBy("__turn", "__slot")
    return (
        kept.join(groups, [*cell, group])
        .withColumn("bucket_index", F.row_number().over(pick))
        .where(F.col("bucket_index") <= max_quota)
        .withColumn("bucket_index", F.col("bucket_index") - 1)
        .where(F.col("bucket_index") < quota)
        .drop("__turn", "__slot")
    )


def cell_shortage(cells: DataFrame, halves: dict[str, DataFrame], cell: str, wanted: dict[str, Column]) -> DataFrame:
    """(cell, half, wanted, got) of every cell whose selection falls short; ``wanted`` are expressions over the cell."""
    tagged = None
    for name, chosen in halves.items():
        part = chosen.select(cell, F.lit(name).alias("half"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy(cell).agg(*[F.count_if(F.col("half") == name).alias(f"__{name}") for name in halves])
    each = F.array(
        *[
            F.struct(F.lit(name).alias("half"), need.cast("bigint").alias("wanted"), F.coalesce(F.col(f"__{name}"), F.lit(0)).cast("bigint").alias("got"))
            for name, need in wanted.items()
        ]
    )
    rows = cells.select(cell).distinct().join(counts, cell, "left").select(cell, F.inline(each))
    return rows.where(F.col("got") < F.col("wanted"))


def interleave(first: DataFrame, second: DataFrame, cell: Sequence[str], rank: str) -> DataFrame:
    """Alternate two ranked lists per cell, the first list leading."""
    both = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)))
    return both.withColumn(rank, F.col(rank) * 2 + F.col("__side")).drop("__side")


def seeded_hash(seed: str, id_column: str, separator: str = "|") -> Column:
    return preimage_hash(separator, seed, F.col(id_column))


def seeded_sample(rows: DataFrame, seed: str, id_column: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest seeded digest."""
    return rows.withColumn("sample_hash", seeded_hash(seed, id_column)).orderBy("sample_hash", id_column).limit(n)


def seeded_order(rows: DataFrame, parts: Sequence[str], hashed: Column, id_column: str, out: str, digits: int = 4) -> DataFrame:
    """Seeded shuffle: 1-based position by digest.

    A group is sorted in 16^``digits`` even buckets: four digits keep a bucket under a million rows up to some 6 * 10^10.
    """
    rows = rows.withColumn("order_hash", hashed)
    return ranked(
        rows,
        parts,
        [F.col("order_hash").asc(), F.col(id_column).asc()],
        [(hash_bucket("order_hash", digits), True)],
        out=out,
        size_out=f"{out}_of",
    )


def sample_rate(rows: DataFrame, parts: Sequence[str], hashed: Column, id_column: str, percent: Column, digits: int = 4) -> DataFrame:
    """ceil(percent / 100 * N) rows per group by digest; percent is an integer column."""
    order = seeded_order(rows, parts, hashed, id_column, "sample_rank", digits)
    return order.where(F.col("sample_rank") <= F.ceil(percent * F.col("sample_rank_of") / 100))


def first_per_group(rows: DataFrame, parts: Sequence[str], order: Sequence[Column], k: int, out: str) -> DataFrame:
    """First ``k`` rows per group; ``k`` is small, so tasks cut before the shuffle."""
    window = Window.partitionBy(*parts).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


#: Candidates that a round of the greedy choice brings to the driver.
LAZY = 1024


def greedy_coverage(items: DataFrame, id_column: str, features: Column, n: int) -> list[str]:
    """Ids chosen one at a time, each adding the most unseen features (ties by id).

    Rows with the same feature set are equal to the rule, so one row per distinct set with its ``n`` smallest ids is written
    once.  A round brings the ``LAZY`` best candidates by gain and id; what an item adds only shrinks while others are chosen,
    so the choice goes on among them for as long as the best one beats every item left out, which is at most the last
    candidate in that order.  Then a new round begins; a round chooses at least one item, usually many.
    """
    profiles = (
        items.select(F.col(id_column).alias("__id"), F.array_sort(F.array_distinct(features)).alias("__f"))
        .withColumn("__r", F.row_number().over(Window.partitionBy("__f").orderBy("__id")))
        .where(F.col("__r") <= n)
        .drop("__r")
    )
    profiles = stored(profiles, "profiles")
    chosen: list[str] = []
    seen: set[str] = set()
    while len(chosen) < n:
        known = F.array(*[F.lit(v) for v in sorted(seen)]).cast("array<string>")
        gain = F.size(F.array_except("__f", known)).alias("gain")
        left = profiles.where(~F.col("__id").isin(chosen) if chosen else F.lit(True)).select("__id", "__f", gain)
        best = left.orderBy(F.col("gain").desc(), "__id").limit(LAZY).collect()
        if not best:
            break
        last = (-best[-1]["gain"], best[-1]["__id"]) if len(best) == LAZY else None
        candidates = {r["__id"]: set(r["__f"]) for r in best}
        while candidates and len(chosen) < n:
            key = min((-len(f - seen), i) for i, f in candidates.items())
            if last is not None and key > last:
                break
            chosen.append(key[1])
            seen |= candidates.pop(key[1])
    return chosen


def partition_contiguity(cells: DataFrame, start: str, end: str, first: str, last: str) -> DataFrame:
    """Ordered date cells (a short table): GAP or OVERLAP against the one before, and the outer bounds."""
    order = Window.orderBy(start)
    prev = F.lag(end).over(order)
    step = F.datediff(F.col(start).cast("date"), prev.cast("date"))
    problem = (
        F.when(prev.isNull(), F.when(F.col(start) != first, "START_BOUND"))
        .when(step < 1, "OVERLAP")
        .when(step > 1, "GAP")
    )
    tail = F.when(F.lead(start).over(order).isNull() & (F.col(end) != last), "END_BOUND")
    return cells.withColumn("problem", F.coalesce(problem, tail, F.lit("OK")))


def sequence_completeness(received: DataFrame, planned: DataFrame, stratum: str, page: str, total: str) -> DataFrame:
    """Per stratum counts of missing, repeated, unexpected and drifted pages, and the first failing check.

    ``planned`` has one row per stratum with the expected number of pages.
    """
    per_page = received.groupBy(stratum, page).agg(
        F.count(F.lit(1)).alias("copies"), F.min(total).alias("low"), F.max(total).alias("high")
    )
    known = F.col(page).between(1, F.col("planned"))
    seen = per_page.join(planned, stratum).groupBy(stratum).agg(
        F.count_if(known).alias("received"),
        F.count_if(F.col("copies") > 1).alias("duplicated"),
        F.count_if(~known).alias("unexpected"),
        F.count_if((F.col("low") != F.col("planned")) | (F.col("high") != F.col("planned"))).alias("drifted"),
    )
    # strata without any page are added after the counting, so a hot stratum stays splittable
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("received", "duplicated", "unexpected", "drifted")]
    out = planned.join(seen, stratum, "left").select(stratum, "planned", *counts)
    status = (
        F.when(F.col("unexpected") > 0, "UNEXPECTED_PAGE")
        .when(F.col("duplicated") > 0, "DUPLICATE_PAGE")
        .when(F.col("received") < F.col("planned"), "INCOMPLETE")
        .when(F.col("drifted") > 0, "TOTAL_DRIFT")
        .otherwise("COMPLETE")
    )
    return out.withColumns({"missing": F.col("planned") - F.col("received"), "status": status})


def first_contributor(rows: DataFrame, key: str, order: str, source: str) -> DataFrame:
    """The earliest source of every key."""
    return rows.groupBy(key).agg(F.min_by(source, order).alias(source))


def section_ancestors(sections: DataFrame, page: str, pos: str, level: str, heading: str, max_level: int = 6) -> DataFrame:
    """Headings of the open sections above each section, outermost first.

    The section of level L is open unless a later one at level L or lower
    replaced it, so the latest earlier section per level decides; no page is
    gathered into one value.
    """
    at = F.struct(F.col(pos).alias("pos"), F.col(heading).alias("heading"))
    latest = {f"__s{i}": F.when(F.col(level) == i, at) for i in range(1, max_level + 1)}
    seen = earlier_max(sections, [page], pos, integer_bucket(pos), latest)
    open_ones = []
    for i in range(1, max_level + 1):
        newest_above = F.lit(-1).cast("bigint")
        for j in range(1, i):
            newest_above = F.greatest(newest_above, F.coalesce(F.col(f"__s{j}.pos").cast("bigint"), F.lit(-1)))
        is_open = (F.lit(i) < F.col(level)) & (F.col(f"__s{i}.pos").cast("bigint") > newest_above)
        open_ones.append(F.when(is_open, F.col(f"__s{i}.heading")))
    return seen.withColumn("ancestors", F.array_compact(F.array(*open_ones))).drop(*latest)


def preferred_candidate(rows: DataFrame, page: str, preference: Column, index: str, keep: Sequence[str]) -> DataFrame:
    """Per page the row with the lowest preference, then index."""
    best = F.min_by(F.struct(*keep), F.struct(preference.alias("p"), F.col(index).alias("i")))
    return rows.groupBy(page).agg(best.alias("b")).select(page, "b.*")


def next_unresolved(rows: DataFrame, run: str, order: str, resolved: Column, key: str) -> DataFrame:
    """Per run the earliest unresolved row, and whether a later row was resolved before it."""
    out = rows.groupBy(run).agg(
        F.min_by(key, F.when(~resolved, F.col(order))).alias("next_id"),
        F.min(F.when(~resolved, F.col(order))).alias("next_order"),
        F.max(F.when(resolved, F.col(order))).alias("__last"),
    )
    return out.withColumn("out_of_order", F.coalesce(F.col("__last") > F.col("next_order"), F.lit(False))).drop("__last")


def top_repeated(rows: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.orderBy(F.col("n").desc(), *columns).limit(k)


def cohort_extension(prior: DataFrame, fresh: DataFrame, cohort: str, key: str, order: str, target: int) -> DataFrame:
    """Prior rows, then the next fresh rows by order until each cohort reaches ``target``."""
    have = prior.groupBy(cohort).agg(F.count(F.lit(1)).alias("have"))
    new = fresh.join(prior.select(key), key, "left_anti")
    ranked_new = first_per_group(new, [cohort], [F.col(order)], target, "rank").join(have, cohort, "left")
    added = ranked_new.where(F.col("rank") <= target - F.coalesce("have", F.lit(0)))
    return prior.select(cohort, key, F.lit("prior").alias("origin")).unionByName(
        added.select(cohort, key, F.lit("new").alias("origin"))
    )


def unique_slugs(batch: DataFrame, taken: DataFrame, key: str, slug: Column) -> DataFrame:
    """Slug per row; repeated or taken slugs get the numeric key appended."""
    rows = batch.withColumn("slug", slug)
    repeated = rows.groupBy("slug").agg((F.count(F.lit(1)) > 1).alias("__many"))
    held = taken.select("slug").distinct().withColumn("__taken", F.lit(True))
    out = rows.join(repeated, "slug").join(held, "slug", "left")
    clash = F.col("__many") | F.coalesce("__taken", F.lit(False))
    return out.withColumn("unique_slug", F.when(clash, F.concat_ws("-", "slug", F.col(key).cast("string"))).otherwise(F.col("slug"))).drop(
        "__many", "__taken"
    )


def first_k_qualifying(rows: DataFrame, cls: str, order: str, key: str, qualifies: Column, k: int = 4) -> DataFrame:
    """Per class the first ``k`` qualifying rows; the others carry the reason they are not chosen."""
    good = first_per_group(rows.where(qualifies), [cls], [F.col(order)], k, "__r").select(key, F.col("__r").alias("rank"))
    totals = rows.groupBy(cls).agg(F.least(F.count_if(qualifies), F.lit(k)).alias("__n"))
    out = rows.join(good, key, "left").join(totals, cls)
    reason = F.when(F.col("rank").isNotNull(), "SELECTED").when(qualifies, "AFTER_QUOTA").otherwise("NOT_QUALIFIED")
    return out.withColumns({"reason": reason, "class_status": F.when(F.col("__n") < k, "SHORT").otherwise("READY")}).drop("__n")
