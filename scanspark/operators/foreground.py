"""The foreground of depth images without a background model: components of like depth, chosen by size, by a hint, or by a region, with gates and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanspark.operators.geometry import pixel_components
from scanspark.operators.pixels import PIXEL
from scanspark.sources.scratch import stored

#: How a view's seed counts.
HINT, REGION = "component_hint", "hard_roi"
#: Reasons, in the order in which they are looked for.
REASONS = ("too_few_valid", "too_few_seeds", "seed_share", "region_at_border", "no_component", "hint_share", "ambiguous", "small_mask", "mask_share", "mask_at_border")


@dataclass(frozen=True)
class Foreground:
    """low, high: depths that count. margin: pixels from the border of a view's valid pixels. jump, relative, diagonal: see pixel_components. ambiguity: the largest ratio of the second
    component's size (or seeds) to the first's. least_*: fewest pixels or smallest shares. Shares of the mask are of all pixels of a view."""

    low: float
    high: float
    least_valid: int = 1
    margin: int = 1
    jump: float = 0.01
    relative: float = 0.02
    diagonal: bool = False
    least_component: int = 1
    ambiguity: float = 0.5
    least_mask: int = 1
    least_mask_share: float = 0.0
    most_mask_share: float = 1.0
    least_seeds: int = 1
    least_seed_share: float = 0.0
    least_hint_share: float = 0.0


def select_foreground(pixels: DataFrame, seeds: DataFrame, rules: Foreground) -> tuple[DataFrame, DataFrame]:
    """(mask, report): the foreground's pixels (view_id, v, u, depth_m) of the views that pass, and a row for each view.

    pixels: view_id, v, u, depth_m, valid; one row for each pixel. seeds: view_id, mode, v, u: the pixels of a view's seed, all of one mode. Without seeds, a view's largest
    component off the border is its foreground; a component_hint takes the component with most of its pixels (then the largest); a hard_roi takes all valid pixels in it, whatever
    their components. Equal components are taken in the order of their first pixel, row by row. report: mode, pixels, valid, components, at_border, interior, largest, second,
    ambiguity, seeds, valid_seeds, seed_share, mask_seeds, mask, mask_share, depth_min, depth_mid, depth_max (of the mask), reason (the first of REASONS that holds; null: none), passed.
    """
    one = F.count(F.lit(1))
    count = lambda c: F.sum(c.cast("long"))
    seeds = seeds.select(*PIXEL, "mode").distinct()
    good = F.coalesce(F.col("valid") & ~F.isnan("depth_m") & F.col("depth_m").between(rules.low, rules.high), F.lit(False))
    modes = seeds.groupBy("view_id").agg(F.max("mode").alias("mode"))
    rows = pixels.select(*PIXEL, F.col("depth_m").cast("double").alias("depth_m"), good.alias("good")).join(seeds.select(*PIXEL, F.lit(True).alias("seed")), PIXEL, "left").na.fill(False, ["seed"])
    rows = stored(rows.join(modes, "view_id", "left"), "foreground-pixels")
    views = rows.groupBy("view_id").agg(F.max("mode").alias("mode"), one.alias("pixels"), count(F.col("good")).alias("valid"), count(F.col("seed")).alias("seeds"), count(F.col("seed") & F.col("good")).alias("valid_seeds"))

    w = Window.partitionBy("view_id")
    inner = rows.filter("good")
    near = lambda a: (F.col(a) < F.min(a).over(w) + rules.margin) | (F.col(a) > F.max(a).over(w) - rules.margin)
    inner = inner.withColumn("border", near("v") | near("u")).filter(F.col("mode").isNull() | (F.col("mode") == HINT) | F.col("seed"))
    parts = stored(pixel_components(inner, rules.jump, rules.relative, rules.diagonal), "depth-components")
    label = ["component_v", "component_u"]
    found = parts.groupBy("view_id", "mode", *label).agg(one.alias("size"), count(F.col("border")).alias("edge"), count(F.col("seed")).alias("hits"))
    found = found.withColumn("interior", (F.col("edge") == 0) & (F.col("size") >= rules.least_component))
    by_size = w.orderBy(F.desc("interior"), F.desc("size"), *label)
    by_hits = w.orderBy(F.desc(F.col("interior") & (F.col("hits") > 0)), F.desc("hits"), F.desc("size"), *label)
    found = found.withColumns({"rank": F.row_number().over(by_size), "hint": F.row_number().over(by_hits)})
    inside = lambda c, r, by: F.max(F.when((F.col(by) == r) & F.col("interior"), F.col(c)))
    sums = found.groupBy("view_id").agg(
        one.alias("components"), count(F.col("edge") > 0).alias("at_border"), count(F.col("interior")).alias("interior"),
        F.coalesce(inside("size", 1, "rank"), F.lit(0)).alias("largest"), F.coalesce(inside("size", 2, "rank"), F.lit(0)).alias("second"),
        F.coalesce(inside("hits", 1, "hint"), F.lit(0)).alias("first_hits"), F.coalesce(inside("hits", 2, "hint"), F.lit(0)).alias("second_hits"),
    )
    chosen = F.when(F.col("mode") == REGION, True).when(F.col("mode") == HINT, (F.col("hint") == 1) & F.col("interior") & (F.col("hits") > 0)).otherwise((F.col("rank") == 1) & F.col("interior"))
    mask = parts.join(found.filter(chosen).select("view_id", *label), ["view_id", *label])
    depth = F.col("depth_m")
    masks = mask.groupBy("view_id").agg(one.alias("mask"), count(F.col("seed")).alias("mask_seeds"), count(F.col("border")).alias("mask_border"), F.min(depth).alias("depth_min"), F.percentile(depth, 0.5).alias("depth_mid"), F.max(depth).alias("depth_max"))
    counts = ["components", "at_border", "interior", "largest", "second", "first_hits", "second_hits", "mask", "mask_seeds", "mask_border"]
    out = views.join(sums, "view_id", "left").join(masks, "view_id", "left").na.fill(0, counts)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = out.withColumns({"ambiguity": ratio("second", "largest"), "seed_share": ratio("valid_seeds", "seeds"), "mask_share": ratio("mask", "pixels")})
    seeded, hinted, region = F.col("mode").isNotNull(), F.coalesce(F.col("mode") == HINT, F.lit(False)), F.coalesce(F.col("mode") == REGION, F.lit(False))
    chosen_some = F.when(hinted, F.col("first_hits") > 0).when(region, F.lit(True)).otherwise(F.col("largest") > 0)
    unclear = F.when(hinted, ratio("second_hits", "first_hits") > rules.ambiguity).when(region, F.lit(False)).otherwise(F.col("ambiguity") > rules.ambiguity)
    bad = [
        F.col("valid") < rules.least_valid,
        seeded & (F.col("valid_seeds") < rules.least_seeds),
        seeded & (F.col("seed_share") < rules.least_seed_share),
        region & (F.col("at_border") > 0),
        ~chosen_some,
        hinted & (ratio("first_hits", "valid_seeds") < rules.least_hint_share),
        unclear,
        F.col("mask") < rules.least_mask,
        ~F.col("mask_share").between(rules.least_mask_share, rules.most_mask_share),
        F.col("mask_border") > 0,
    ]
    reason = F.coalesce(*(F.when(b, F.lit(r)) for r, b in zip(REASONS, bad, strict=True)))
    told = ["pixels", "valid", "components", "at_border", "interior", "largest", "second", "ambiguity", "seeds", "valid_seeds", "seed_share", "mask_seeds", "mask", "mask_share", "depth_min", "depth_mid", "depth_max"]
    report = stored(out.withColumn("reason", reason).select("view_id", "mode", *told, "reason", F.col("reason").isNull().alias("passed")), "foreground-report")
    return mask.join(report.filter("passed").select("view_id"), "view_id").select(*PIXEL, "depth_m"), report
