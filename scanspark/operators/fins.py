"""Fins: the one protruding component of a surface, grown from seeds that stand out and face elsewhere, with gates on its form and bands at its root and free edge."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanspark.operators.geometry import oriented_box
from scanspark.operators.graph import radius_components
from scanspark.operators.surface import fit_height_surface
from scanspark.sources.scratch import stored

#: Reasons, in the order in which they are looked for.
REASONS = ("few_main_seeds", "no_fin", "several_fins", "narrow", "thick", "small_main")


@dataclass(frozen=True)
class Fin:
    """main_cosine: least alignment with the surface's axis of points that its height is fitted to. A seed stands out by seed_height and aligns by seed_cosine at most; the fin
    grows, within radius, over points that stand out by grow_height or align as little. It needs least points, a second component at most `second` its size, a span (the second
    extent of its box) and a thickness (the third over the second) within bounds, and must leave least_main points."""

    radius: float
    seed_height: float
    grow_height: float
    main_cosine: float = 0.8
    seed_cosine: float = 0.5
    least: int = 10
    second: float = 0.5
    span: float = 0.0
    thickness: float = 1.0
    root_band: float = 0.0
    free_band: float = 0.0
    least_main: int = 1
    least_main_seeds: int = 30
    huber: float = 1e-3
    rounds: int = 5


def segment_fin(points: DataFrame, keys: Sequence[str], point_id: str, rules: Fin) -> tuple[DataFrame, DataFrame]:
    """(points with height, residual and part, report by key).

    points: keys, point_id (unique), x, y, z in the surface's frame (z its normal), nx, ny, nz. The height of the surface is a quadratic of x and y, fitted to the points
    whose normals lie along z. Components of radius-connected points that may belong to a fin count if they hold a seed; the largest (then that of the
    smallest id) is the fin. part: main, or fin_root (a residual up to the larger of root_band and its p15), fin_free (from the larger of its greatest less free_band and its p82 on) and
    fin_body. Where a gate fails, all is main. report: n, seeds, size, second, span, thickness, root_limit, free_limit, rmse (of the fitted points), reason (the first of REASONS; null: none).
    """
    keys = list(keys)
    along = F.abs(F.col("nz"))
    fitted = fit_height_surface(points, keys, along >= rules.main_cosine, rules.rounds, 2.5, 1e-6, rules.huber)
    out = F.abs(F.col("residual"))
    seed = (out >= rules.seed_height) & (along <= rules.seed_cosine)
    grown = (out >= rules.grow_height) | (along <= rules.seed_cosine)
    rows = stored(fitted.withColumns({"__seed": seed, "__grown": grown, "__main": along >= rules.main_cosine}), "heights")
    able = rows.filter("__grown")
    roots = radius_components(able, rules.radius, point_id, keys).withColumnRenamed("node", point_id).hint("merge")
    able = stored(able.join(roots, point_id, "left").withColumn("component", F.coalesce("root", point_id)).drop("root"), "fin-components")
    sizes = able.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"), F.max("__seed").alias("seeded")).filter(F.col("seeded") & (F.col("size") >= rules.least))
    w = Window.partitionBy(*keys).orderBy(F.desc("size"), "component")
    best = sizes.withColumns({"rank": F.row_number().over(w), "second": F.coalesce(F.lead("size").over(w), F.lit(0))}).filter("rank = 1").select(*keys, "component", "size", "second")
    fin = stored(able.join(best.select(*keys, "component"), [*keys, "component"]), "fin")
    box = oriented_box(fin.select(*keys, *"xyz"), *keys)
    form = box.select(*keys, *((F.col(f"h{i}") - F.col(f"l{i}")).alias(f"e{i}") for i in (1, 2)))
    form = form.select(*keys, F.col("e1").alias("span_m"), F.coalesce(F.try_divide("e2", "e1"), F.lit(0.0)).alias("thickness"))
    bands = fin.groupBy(*keys).agg(
        F.greatest(F.lit(rules.root_band), F.percentile(out, 0.15)).alias("root_limit"), F.greatest(F.max(out) - rules.free_band, F.percentile(out, 0.82)).alias("free_limit")
    )
    count = lambda c: F.sum(F.col(c).cast("long"))
    told = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count("__seed").alias("seeds"), count("__main").alias("fitted"), F.sqrt(F.avg(F.when(F.col("__main"), F.col("residual") ** 2))).alias("rmse"))
    told = told.join(best, keys, "left").join(form, keys, "left").join(bands, keys, "left").na.fill(0, ["size", "second"])
    bad = [
        F.col("fitted") < rules.least_main_seeds,
        F.col("size") == 0,
        F.col("second") > rules.second * F.col("size"),
        F.col("span_m") < rules.span,
        F.col("thickness") > rules.thickness,
        F.col("n") - F.col("size") < rules.least_main,
    ]
    reason = F.coalesce(*(F.when(b, F.lit(r)) for r, b in zip(REASONS, bad, strict=True)))
    report = stored(told.withColumn("reason", reason), "fin-report")
    marks = fin.select(*keys, point_id).join(report.filter("reason IS NULL").select(*keys, "root_limit", "free_limit"), keys)
    parts = rows.drop("__seed", "__grown", "__main").join(marks, [*keys, point_id], "left")
    part = F.when(F.col("root_limit").isNull(), "main").when(out <= F.col("root_limit"), "fin_root").when(out >= F.col("free_limit"), "fin_free").otherwise("fin_body")
    report = report.select(*keys, "n", "seeds", "size", "second", F.col("span_m").alias("span"), "thickness", "root_limit", "free_limit", "rmse", "reason")
    return parts.withColumn("part", part).drop("root_limit", "free_limit"), report
