"""Comparing the items of a slate, explaining a match, and decoding shared links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import joined, settle
from curatorium.operators.filters import unset
from curatorium.schemas import ATTENTION, MOODS, PACES, SITUATIONS, STYLES, WEIGHTS

# Fixed wording of the product texts.
SITUATION_TEXT = {
    "alone": "you alone",
    "date-night": "a date night",
    "friends": "friends",
    "family": "the family",
    "easy-watch": "an easy watch",
}
ATTENTION_TEXT = {"easy": "easygoing", "engaged": "engaging", "immersive": "immersive"}
PACE_TEXT = {"slow": "slower", "medium": "steady", "fast": "faster"}
WEIGHT_TEXT = {"light": "lighter", "moderate": "emotionally balanced", "heavy": "heavier"}
CUE_WEIGHT = {"light": "Gentle emotional lift", "heavy": "Emotionally weighty"}
CUE_PACE = {"slow": "Patient burn", "fast": "Moves quickly"}
CUE_ATTENTION = {
    "easy": "Easygoing",
    "engaged": "Keeps you engaged",
    "immersive": "Full-attention watch",
}
PACE_DETAIL = {"slow": "Slow burn", "medium": "Balanced pace", "fast": "Fast-moving"}
WEIGHT_DETAIL = {"light": "Light", "moderate": "Moderate", "heavy": "Heavy"}


def look_up(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(v) for pair in table.items() for v in pair]
    return F.try_element_at(F.create_map(*entries), key)


def reason_list(q_prefix: str = "q_") -> Column:
    """Why a row fits the request, in fixed order."""
    q = lambda c: F.col(f"{q_prefix}{c}")
    set_and_equal = lambda c: ~unset(q(c)) & (F.col(c) == q(c))
    texts = [
        (F.array_contains("moods", q("mood")), F.concat(F.lit("fits your "), q("mood"), F.lit(" mood"))),
        (
            ~unset(q("situation")) & F.array_contains("situations", q("situation")),
            F.concat(F.lit("perfect for "), look_up(SITUATION_TEXT, q("situation"))),
        ),
        (
            set_and_equal("attention_demand"),
            F.concat(F.lit("matches the "), look_up(ATTENTION_TEXT, q("attention_demand")), F.lit(" headspace")),
        ),
        (set_and_equal("discovery_style"), F.concat(F.lit("keeps things "), q("discovery_style"))),
        (
            set_and_equal("pace"),
            F.when(q("pace") == "medium", "keeps an even rhythm").otherwise(
                F.concat(F.lit("leans "), look_up(PACE_TEXT, q("pace")))
            ),
        ),
        (
            set_and_equal("emotional_weight"),
            F.when(
                q("emotional_weight") == "moderate", "has room for feeling without going all the way under"
            ).otherwise(F.concat(F.lit("stays "), look_up(WEIGHT_TEXT, q("emotional_weight")))),
        ),
    ]
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in texts]))


def presentation_labels(now: Column) -> dict[str, Column]:
    finish = F.timestamp_add("MINUTE", F.col("runtime_minutes"), now)
    return {
        "compact_facts": F.concat(F.col("year").cast("string"), F.lit(" · "), F.col("runtime_minutes").cast("string"), F.lit(" min")),
        "genre_summary": F.concat_ws(" · ", F.slice("genres", 1, 2)),
        "cue": F.coalesce(
            look_up(CUE_WEIGHT, F.col("emotional_weight")),
            look_up(CUE_PACE, F.col("pace")),
            look_up(CUE_ATTENTION, F.col("attention_demand")),
        ),
        "pace_label": look_up(PACE_DETAIL, F.col("pace")),
        "weight_label": look_up(WEIGHT_DETAIL, F.col("emotional_weight")),
        "finish_label": F.concat(F.lit("Ends around "), F.date_format(finish, "h:mm a")),
    }


DIMENSIONS = {"attention_demand": 1, "emotional_weight": 2, "pace": 3}


def outlier_of_three(slates: DataFrame, slate: str = "request_id") -> DataFrame:
    """The one item a slate of three sets apart, when every salient split names the same one.

    A dimension counts when its values split two to one, the request does not
    already settle it, and the contrast is a strong one.
    """
    sized = slates.groupBy(slate).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == 3).drop("__n")
    long = slates.join(sized, slate).select(
        slate,
        "id",
        "slot",
        "q_attention_demand",
        "q_pace",
        "q_emotional_weight",
        "q_avoid_slow",
        "q_avoid_heavy",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("dim_ord"), F.lit(d).alias("dim"), F.col(d).alias("value"))
                    for d, i in DIMENSIONS.items()
                ]
            )
        ).alias("d"),
    )
    by_value = long.groupBy(slate, "d.dim_ord", "d.dim", "d.value").agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("slot", "id"))), lambda s: s["id"]).alias("ids"),
        *[F.first(c).alias(c) for c in ("q_attention_demand", "q_pace", "q_emotional_weight", "q_avoid_slow", "q_avoid_heavy")],
    )
    splits = by_value.groupBy(slate, "dim_ord", "dim").agg(
        F.count(F.lit(1)).alias("groups"),
        F.max(F.when(F.col("n") == 2, F.col("value"))).alias("majority"),
        F.max(F.when(F.col("n") == 1, F.col("value"))).alias("outlier"),
        F.max(F.when(F.col("n") == 2, F.col("ids"))).alias("majority_ids"),
        F.max(F.when(F.col("n") == 1, F.element_at("ids", 1))).alias("outlier_id"),
        *[F.first(c).alias(c) for c in ("q_attention_demand", "q_pace", "q_emotional_weight", "q_avoid_slow", "q_avoid_heavy")],
    )
    has = lambda v: (F.col("majority") == v) | (F.col("outlier") == v)
    settled = (
        F.when(F.col("dim") == "attention_demand", ~unset(F.col("q_attention_demand")))
        .when(F.col("dim") == "pace", ~unset(F.col("q_pace")) | (F.col("q_avoid_slow") & has("slow")))
        .otherwise(~unset(F.col("q_emotional_weight")) | (F.col("q_avoid_heavy") & has("heavy")))
    )
    strong = (
        F.when(F.col("dim") == "attention_demand", has("easy"))
        .when(F.col("dim") == "emotional_weight", has("heavy"))
        .otherwise(has("slow") & has("fast"))
    )
    kept = splits.where(F.col("groups") == 2).where(~settled & strong)
    text = (
        F.when(
            F.col("dim") == "attention_demand",
            F.when(F.col("outlier") == "easy", "It asks less of your attention than the other two.").otherwise(
                "It asks for more of your attention; the other two are easier to settle into."
            ),
        )
        .when(
            F.col("dim") == "emotional_weight",
            F.when(F.col("outlier") == "heavy", "It carries a heavier emotional charge than the other two.").otherwise(
                "It stays emotionally lighter than the other two."
            ),
        )
        .otherwise(
            F.when(F.col("outlier") == "fast", "It moves at a much quicker clip; the other two take their time.").otherwise(
                "It takes its time more than the other two."
            )
        )
    )
    return (
        kept.withColumn("observation", text)
        .groupBy(slate)
        .agg(
            F.count_distinct("outlier_id").alias("__outliers"),
            F.min_by("outlier_id", "dim_ord").alias("outlier_id"),
            F.min_by("majority_ids", "dim_ord").alias("majority_ids"),
            F.transform(F.sort_array(F.collect_list(F.struct("dim_ord", "dim"))), lambda s: s["dim"]).alias("dimensions"),
            F.min_by("observation", "dim_ord").alias("observation"),
        )
        .where(F.col("__outliers") == 1)
        .drop("__outliers")
    )


def _level(scale: list[str], column: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in scale]), column)


def _runtime_text(minutes: Column) -> Column:
    size = F.when(minutes < 100, " min, shorter").when(minutes <= 130, " min, medium length").otherwise(" min, longer")
    return F.concat(minutes.cast("string"), size)


def pair_differences(a: str = "a", b: str = "b", limit: int = 2) -> Column:
    """Ordered differences between two finalists, dimensions the request is about first.

    Only the first of the two effort dimensions is kept when both carry the same summary.
    """
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    q = lambda c: F.col(f"q_{c}")
    wx, wy = _level(WEIGHTS, x("emotional_weight")), _level(WEIGHTS, y("emotional_weight"))
    ax, ay = _level(ATTENTION, x("attention_demand")), _level(ATTENTION, y("attention_demand"))
    gentler = F.lit(" is the gentler, lower-effort watch tonight.")
    effort = F.when(
        ((wx < wy) | (ax < ay)) & ~((wy < wx) | (ay < ax)), F.concat(x("title"), gentler)
    ).when(((wy < wx) | (ay < ax)) & ~((wx < wy) | (ax < ay)), F.concat(y("title"), gentler))
    fast = F.when(
        (x("pace") != "medium") & (y("pace") != "medium"),
        F.when(
            x("pace") == "fast", F.concat(x("title"), F.lit(" moves faster; "), y("title"), F.lit(" takes its time."))
        ).otherwise(F.concat(y("title"), F.lit(" moves faster; "), x("title"), F.lit(" takes its time."))),
    )
    gap = F.abs(x("runtime_minutes") - y("runtime_minutes"))
    first_shorter = x("runtime_minutes") < y("runtime_minutes")
    shorter = F.when(first_shorter, x("title")).otherwise(y("title"))
    longer = F.when(first_shorter, y("title")).otherwise(x("title"))
    length = F.when(gap >= 25, F.concat(shorter, F.lit(" is the shorter commitment tonight."))).when(
        gap >= 10, F.concat(longer, F.lit(" asks for about "), gap.cast("string"), F.lit(" more minutes."))
    )
    differ_as_sets = lambda c: (F.size(F.array_except(x(c), y(c))) + F.size(F.array_except(y(c), x(c)))) > 0
    only = lambda m, n: F.array_join(F.filter(m, lambda v: ~F.array_contains(n, v)), ", ")
    none = F.lit(None).cast("string")
    flag = lambda c: F.coalesce(q(c), F.lit(False))

    def entry(name, active, active_pos, fallback_pos, differs, first, second, summary):
        priority = F.when(active, F.lit(active_pos)).otherwise(F.lit(10 + fallback_pos))
        return F.when(
            differs,
            F.struct(
                priority.alias("priority"),
                F.lit(name).alias("category"),
                first.alias("first_value"),
                second.alias("second_value"),
                summary.alias("summary"),
            ),
        )

    never = F.lit(False)
    found = F.array_sort(
        F.array_compact(
            F.array(
                entry("attention", ~unset(q("attention_demand")), 1, 4, x("attention_demand") != y("attention_demand"),
                      look_up(ATTENTION_TEXT, x("attention_demand")), look_up(ATTENTION_TEXT, y("attention_demand")), effort),
                entry("emotional weight", ~unset(q("emotional_weight")) | flag("avoid_heavy"), 2, 3,
                      x("emotional_weight") != y("emotional_weight"),
                      look_up(WEIGHT_TEXT, x("emotional_weight")), look_up(WEIGHT_TEXT, y("emotional_weight")), effort),
                entry("style", ~unset(q("discovery_style")), 3, 5, x("discovery_style") != y("discovery_style"),
                      x("discovery_style"), y("discovery_style"), none),
                entry("pace", ~unset(q("pace")) | flag("avoid_slow"), 4, 1, x("pace") != y("pace"),
                      look_up(PACE_TEXT, x("pace")), look_up(PACE_TEXT, y("pace")), fast),
                entry("runtime", ~unset(q("runtime")) | flag("under_two_hours"), 5, 2,
                      x("runtime_minutes") != y("runtime_minutes"),
                      _runtime_text(x("runtime_minutes")), _runtime_text(y("runtime_minutes")), length),
                entry("genre", never, 0, 6, differ_as_sets("genres"),
                      F.array_join(x("genres"), ", "), F.array_join(y("genres"), ", "), none),
                entry("mood", never, 0, 7, differ_as_sets("moods"),
                      only(x("moods"), y("moods")), only(y("moods"), x("moods")), none),
            )
        )
    )
    is_effort = lambda d: d["category"].isin("attention", "emotional weight") & d["summary"].isNotNull()
    # array_sort orders by priority, so an effort entry repeats iff an earlier one exists
    kept = F.filter(
        found,
        lambda d: ~is_effort(d)
        | ~F.exists(found, lambda e: is_effort(e) & (e["priority"] < d["priority"])),
    )
    return F.slice(kept, 1, limit)


def compare_pairs(slates: DataFrame, slate: str = "request_id", limit: int = 2) -> DataFrame:
    """Every pair of a slate with its first ``limit`` differences, one row per difference."""
    fields = ["id", "slot", "title", "runtime_minutes", "pace", "emotional_weight", "attention_demand",
              "discovery_style", "genres", "moods"]
    context = [c for c in slates.columns if c.startswith("q_")]
    # a slate has a few rows, so its pairs are made inside one row
    rows = slates.groupBy(slate, *context).agg(F.collect_list(F.struct(*fields)).alias("rows"))
    pairs = F.flatten(F.transform("rows", lambda a: F.transform(F.filter("rows", lambda b: a["slot"] < b["slot"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return (
        rows.select(slate, *context, F.inline(pairs))
        .select(
            slate,
            F.col("a.id").alias("first_id"),
            F.col("b.id").alias("second_id"),
            F.posexplode(pair_differences(limit=limit)).alias("pos", "d"),
        )
        .select(slate, "first_id", "second_id", (F.col("pos") + 1).alias("rank"), "d.category", "d.first_value", "d.second_value", "d.summary")
    )


def _param(text: Column, key: str) -> Column:
    """First value of a query-string parameter, decoded; null when absent or empty."""
    raw = F.regexp_extract(text, f"(?:^|&){key}=([^&]*)", 1)
    return F.nullif(F.url_decode(raw), F.lit(""))


def _part(text: Column, key: str) -> Column:
    """Value of ``key`` in 'k=v|k=v'; parts without a value do not count, the last one wins."""
    return F.nullif(F.regexp_extract(text, rf"(?:^|.*\|){key}=([^|=]+)", 1), F.lit(""))


def _one_of(value: Column, allowed: list[str]) -> Column:
    return value.isNull() | value.isin(*allowed)


def _reduction_ids(parts: Column) -> Column:
    """Ids named by a reduction tail, or null when the tail is malformed."""
    tag = F.try_element_at(parts, F.lit(1))
    return F.when(
        (F.size(parts) == 2) & tag.isin("cd", "md"), F.slice(parts, 2, 1)
    ).when((F.size(parts) == 4) & (tag == "ad"), F.slice(parts, 4, 1))


def _duel_ids(parts: Column) -> Column:
    n = F.size(parts)
    head = F.slice(parts, 1, 2)
    return (
        F.when(n == 2, head)
        .when(n == 5, parts)
        .when(n.isin(4, 6), F.concat(head, _reduction_ids(F.slice(parts, 3, 4))))
        .when(
            n.isin(8, 10) & (F.try_element_at(parts, F.lit(3)) == "src"),
            F.concat(head, F.slice(parts, 4, 3), _reduction_ids(F.slice(parts, 7, 4))),
        )
    )


def decode_links(links: DataFrame, known: DataFrame, url: str = "url", key: str = "link_id") -> DataFrame:
    """Typed request and decision state of each shared link; invalid links drop out.

    ``known`` has the valid ids in column ``id``.  A state is kept only when all
    ids it names are known.
    """
    text = F.split_part(F.split_part(F.col(url), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2))
    params = settle(
        settle(links.select(key, url), query=text),
        **{k: _param(F.col("query"), k) for k in ("mode", "v", "m", "s", "f", "d", "ds")},
    )
    params = params.where(
        (F.col("mode") == "decision") & F.col("v").isin("v4", "v6") & F.col("m").isin(*MOODS) & (F.instr("ds", ":") > 0)
    )
    body = F.split(F.expr("substring(ds, instr(ds, ':') + 1)"), ";")
    params = settle(params, kind=F.split_part("ds", F.lit(":"), F.lit(1)), parts=body)
    parts, n, kind = F.col("parts"), F.size("parts"), F.col("kind")
    second = F.try_element_at(parts, F.lit(2))
    slate_ok = (n == 3) | (
        (n == 5)
        & F.try_element_at(parts, F.lit(4)).isin("md", "dc")
        & F.array_contains(F.slice(parts, 1, 3), F.try_element_at(parts, F.lit(5)))
    )
    chosen = F.slice(parts, 1, 1)
    inner = F.transform(F.slice(parts, 3, 12), lambda p: F.regexp_replace(p, "^dl:", ""))
    pick_ids = (
        F.when(n == 1, parts)
        .when((n == 5) & (second == "three"), F.concat(chosen, F.slice(parts, 3, 3)))
        .when((second == "duel") & F.try_element_at(parts, F.lit(3)).startswith("dl:"), F.concat(chosen, _duel_ids(inner)))
        .when(n == 4, parts)
        .when(n == 6, F.concat(chosen, _duel_ids(F.slice(parts, 2, 5))))
    )
    named = (
        F.when((kind == "ts") & slate_ok, F.slice(parts, 1, 3)).when(kind == "dl", _duel_ids(parts)).when(kind == "pk", pick_ids)
    )
    decoded = (
        settle(
            params,
            ids=named,
            **{n: _part(F.col("f"), k) for n, k in (("g", "g"), ("runtime", "r"), ("language", "l"), ("pace", "p"), ("emotional_weight", "e"))},
            **{n: _part(F.col("d"), k) for n, k in (("attention_demand", "a"), ("discovery_style", "d"), ("dh", "dh"), ("slow", "ds"), ("dt", "dt"))},
        )
        .where(
            _one_of(F.col("runtime"), ["short", "medium", "long"])
            & _one_of(F.col("pace"), PACES)
            & _one_of(F.col("emotional_weight"), WEIGHTS)
            & _one_of(F.col("attention_demand"), ATTENTION)
            & _one_of(F.col("discovery_style"), STYLES)
        )
        .where(F.col("ids").isNotNull())
        .select(
            key,
            F.col("v").alias("version"),
            F.col("m").alias("mood"),
            F.when(F.col("s").isin(*SITUATIONS), F.col("s")).alias("situation"),
            F.coalesce(F.replace("g", F.lit(","), F.lit("|")), F.lit("")).alias("genres"),
            "runtime", "language", "pace", "emotional_weight", "attention_demand", "discovery_style",
            *[F.col(c).isNotNull().alias(n) for n, c in (("avoid_heavy", "dh"), ("avoid_slow", "slow"), ("under_two_hours", "dt"))],
            "kind",
            "ids",
        )
    )
    named_ids = decoded.select(key, F.explode("ids").alias("id"))
    unknown = named_ids.join(known.select("id"), "id", "left_anti").select(key).distinct()
    return decoded.join(unknown, key, "left_anti").withColumn("ids", joined("ids"))
