"""Two-colour palettes from a pixel table (image, x, y, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed numbers of the palette rules.
GRID_WIDTH, GRID_HEIGHT = 64, 96
PIXELS_PER_TASK = 1 << 16
MIN_DISTANCE = 48.0
CHROMATIC_SATURATION, CHROMATIC_BRIGHTNESS = 0.22, 45
CHROMATIC_COVERAGE, CHROMATIC_SCORE_SHARE = 0.25, 0.20


def _sampled(position: Column, size: Column, grid: int) -> Column:
    """The position is hit by one of min(grid, size) evenly placed sample points."""
    points = F.least(size, F.lit(grid))
    nearest = F.ceil(position * points / size - 0.5)
    return (nearest < points) & (F.floor((nearest + 0.5) * size / points) == position)


def quantize(channel: Column) -> Column:
    return F.least(F.lit(255), (F.floor(channel / 16 + 0.5) * 16)).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def chromatic(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return (high > CHROMATIC_BRIGHTNESS) & ((high - low) / high >= CHROMATIC_SATURATION)


def rgb_distance(a: str, b: str) -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), F.lit(2)) for c in "rgb"), F.lit(0.0)))


def to_hex(color: str) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.col(f"{color}.{c}")), 2, "0")) for c in "rgb"])


def color_histogram(pixels: DataFrame) -> DataFrame:
    """Counts of quantized colours on the sample grid, with raw sums and chromatic pixels.

    The grid bounds an image to 64 x 96 samples, so everything after this works
    on at most that many rows per image.  Pixels are counted first and images dealt by hash over as many tasks as that
    asks for: everything up to the palettes stays in these tasks, so their memory does not grow with the table.
    """
    size = pixels.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    c = F.col
    tasks = pixels.count() // PIXELS_PER_TASK + 1
    kept = pixels.repartition(tasks, "image").join(size.repartition(tasks, "image"), "image").where(
        (c("a") >= 128) & _sampled(c("x"), c("width"), GRID_WIDTH) & _sampled(c("y"), c("height"), GRID_HEIGHT)
    )
    color = F.struct(*[quantize(c(ch)).alias(ch) for ch in "rgb"])
    return kept.groupBy("image", color.alias("rgb")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(c("r").cast("bigint") + c("g") + c("b")).alias("raw_sum"),
        F.count_if(chromatic(c("r"), c("g"), c("b"))).alias("chromatic_n"),
    )


def _key(color: str) -> Column:
    return F.concat_ws(",", *[F.col(f"{color}.{c}").cast("string") for c in "rgb"])


def _lum(color: str) -> Column:
    return luminance(*[F.col(f"{color}.{c}") for c in "rgb"])


def palette_evidence(histogram: DataFrame) -> DataFrame:
    """Per image the dominant colour, the best partner, the farthest one and the best chromatic one."""
    per_image = histogram.groupBy("image").agg(
        F.min_by("rgb", F.struct((-F.col("n")).alias("n"), _lum("rgb").alias("l"), _key("rgb").alias("k"))).alias("first"),
        F.sum("n").alias("valid"),
        F.sum("raw_sum").alias("raw_sum"),
        F.sum("chromatic_n").alias("chromatic_n"),
    )
    others = histogram.join(per_image.select("image", "first"), "image").where(F.col("rgb") != F.col("first"))
    others = others.withColumn("distance", rgb_distance("first", "rgb"))
    others = others.withColumn("score", F.col("n") * (1 + F.pow("distance", F.lit(1.35))))
    pick = F.struct("rgb", "distance", "score")
    by_score = F.struct((-F.col("score")).alias("s"), (-F.col("n")).alias("n"), _key("rgb").alias("k"))
    colored = chromatic(*[F.col(f"rgb.{c}") for c in "rgb"]) & (F.col("distance") >= MIN_DISTANCE)
    best = others.groupBy("image").agg(
        F.min_by(pick, by_score).alias("second"),
        F.min_by(pick, F.struct((-F.col("distance")).alias("d"), _key("rgb").alias("k"))).alias("farthest"),
        F.min_by(pick, F.when(colored, by_score)).alias("colored"),
        F.count_if(colored).alias("colored_n"),
    )
    return per_image.join(best, "image", "left")


def _ordered(a: Column, b: Column, swap: Column) -> Column:
    return F.when(swap, F.array(b, a)).otherwise(F.array(a, b))


def two_color_palette(evidence: DataFrame) -> DataFrame:
    """[darker, lighter] hex per image; a grey pair when no partner is far enough from the dominant colour."""
    near = F.coalesce(F.col("second.distance"), F.lit(0.0)) < MIN_DISTANCE
    far = F.coalesce(F.col("farthest.distance"), F.lit(0.0)) >= MIN_DISTANCE
    center = F.floor(F.col("raw_sum") / F.col("valid") / 3 + 0.5).cast("int")
    dark0, light0 = F.greatest(F.lit(0), center - 36), F.least(F.lit(255), center + 36)
    tight = (light0 - dark0) < MIN_DISTANCE
    dark = F.when(tight & (dark0 != 0), F.greatest(F.lit(0), light0 - 48)).otherwise(dark0)
    light = F.when(tight & (dark0 == 0), F.lit(48)).otherwise(light0)
    grey = lambda v: F.struct(v.alias("r"), v.alias("g"), v.alias("b"))
    fallback = near & ~far
    rows = evidence.select(
        "*",
        F.when(fallback, grey(dark)).otherwise(F.col("first")).alias("c1"),
        F.when(~near, F.col("second.rgb")).when(far, F.col("farthest.rgb")).otherwise(grey(light)).alias("c2"),
    )
    swap = _lum("c1") > _lum("c2")
    return rows.withColumn("palette", _ordered(to_hex("c1"), to_hex("c2"), swap)).drop("c1", "c2")


def chromatic_evidence(palettes: DataFrame) -> DataFrame:
    """Share of chromatic pixels, relative score of the best chromatic colour, and the corrected palette."""
    share = F.when((F.col("colored_n") > 0) & (F.col("second.score") > 0), F.col("colored.score") / F.col("second.score")).otherwise(0.0)
    rows = palettes.withColumns(
        {
            "extreme": F.array_contains("palette", "#000000") & F.array_contains("palette", "#ffffff"),
            "coverage": F.col("chromatic_n") / F.col("valid"),
            "score_share": F.coalesce(share, F.lit(0.0)),
            "partner": F.col("colored.rgb"),
        }
    )
    swap = (_lum("first") > _lum("partner")) | ((_lum("first") == _lum("partner")) & (_key("first") > _key("partner")))
    return rows.withColumn(
        "corrected", F.when(F.coalesce(F.col("colored_n"), F.lit(0)) > 0, _ordered(to_hex("first"), to_hex("partner"), swap)).otherwise(F.col("palette"))
    )


def chromatic_correction(evidence: DataFrame, coverage: float | None = CHROMATIC_COVERAGE, share: float | None = CHROMATIC_SCORE_SHARE) -> Column:
    """Final palette: only a pure black and white pair may change, and only with enough colour in the image."""
    return F.when(triggered(F.lit(coverage).cast("double"), F.lit(share).cast("double")), F.col("corrected")).otherwise(F.col("palette"))


def triggered(coverage: Column, share: Column) -> Column:
    """A rule fires on a black and white pair when one of its set thresholds is met."""
    met = F.coalesce(F.col("coverage") >= coverage, F.lit(False)) | F.coalesce(F.col("score_share") >= share, F.lit(False))
    return F.col("extreme") & met


def palette_quality(evidence: DataFrame, variants: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """Effect of each rule variant; ``suspected`` and ``neutral`` mark the images it should and should not touch."""
    rules = F.array(
        *[
            F.struct(F.lit(n).alias("variant"), F.lit(cov).cast("double").alias("cov"), F.lit(sh).cast("double").alias("share"))
            for n, cov, sh in variants
        ]
    )
    rows = evidence.withColumn("v", F.explode(rules))
    fired = triggered(F.col("v.cov"), F.col("v.share"))
    rows = rows.select("*", fired.alias("fired"), F.when(fired, F.col("corrected")).otherwise(F.col("palette")).alias("final"))
    channel = lambda i, at: F.conv(F.substring(F.element_at("final", i), at, 2), 16, 10).cast("int")
    gap = F.sqrt(sum((F.pow(channel(1, at) - channel(2, at), F.lit(2)) for at in (2, 4, 6)), F.lit(0.0)))
    changed = F.col("fired")
    per_palette = rows.withColumn("gap", gap).groupBy(F.col("v.variant").alias("variant"), F.array_join("final", "|").alias("text")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(changed & F.col("suspected")).alias("corrected"),
        F.count_if(changed & F.col("neutral")).alias("altered"),
        F.count_if(changed & ~F.col("suspected") & ~F.col("neutral")).alias("collateral"),
        F.count_if(F.exists("final", lambda c: ~c.rlike("^#[0-9a-f]{6}$"))).alias("invalid"),
        F.count_if(F.element_at("final", 1) == F.element_at("final", 2)).alias("identical"),
        F.count_if(F.col("gap") < MIN_DISTANCE).alias("too_close"),
    )
    sums = ("corrected", "altered", "collateral", "invalid", "identical", "too_close")
    return per_palette.groupBy("variant").agg(*[F.sum(s).alias(s) for s in sums], F.count_if(F.col("n") > 1).alias("repeated"))
