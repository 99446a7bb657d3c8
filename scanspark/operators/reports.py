"""Reports on plans, reconstructions, calibrations and joints: a row for each thing judged, with every reason against it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators.graph import components
from scanspark.operators.joins import radius_join
from scanspark.operators.maps import mesh_edges
from scanspark.sources.scratch import stored

SIDES = ("front", "back")
#: Regions that a plan must reach on each side, without and with a fin, and those of the fin (fixed values).
PLANNED = ("surface", "leading_edge", "trailing_edge", "root", "tip")
FIN_REGIONS = ("fin_face", "fin_root", "fin_free_edge")


@dataclass(frozen=True)
class PlanLimits:
    """What a view of a plan must keep to. baseline: the distance of plans that don't adapt it (low and high: those that do)."""

    baseline: float
    low: float | None = None
    high: float | None = None
    standoff_error: float = 0.01
    look_cosine: float = 0.98
    incidence_cosine: float = 0.9
    projection: float = 0.9
    visibility: float = 0.9
    duplicate_m: float = 0.005
    duplicate_deg: float = 1.0
    fin: bool = False


def inspect_plan(views: DataFrame, patches: DataFrame, limits: PlanLimits, plan: str = "plan_id") -> tuple[DataFrame, DataFrame]:
    """(views with accepted and reasons, regions): whether each planned view shows what it says, and whether each side's regions have an accepted one.

    views: plan, view_id, patch_id, distance, projection, visibility, footprint_u, footprint_v and the camera's pose. patches: plan, patch_id, side, region, c* (centre), m* (normal).
    Reasons, in order: unknown_patch, pose_missing (null or NaN), rotation (not orthonormal and right-handed within 1e-6), distance (from camera to centre), look (the axis passes the centre by),
    incidence (against the normal), projection, visibility (both may fall short by 1e-12), footprint, bounds (outside low .. high, or not the baseline), duplicate (both
    of two views as near as that in place and turn). regions: a row for each plan, side and region that is needed: planned, accepted, missing (null, no_view or no_accepted).
    """
    on = [plan, "patch_id"]
    kept = patches.select(*on, "side", "region", *(F.col(f"{p}{a}").alias(f"__{p}{a}") for p in "cm" for a in "xyz"), F.lit(True).alias("__known"))
    rows = views.join(kept, on, "left")
    r, t = C.pose()
    there = F.coalesce(C.all_finite(F.array(*(F.col(c).cast("double") for c in C.POSE))), F.lit(False))
    rows = rows.withColumn("__there", there)
    square = [F.abs(C.dot([r[k][i] for k in range(3)], [r[k][j] for k in range(3)]) - float(i == j)) <= 1e-6 for i in range(3) for j in range(i, 3)]
    right = F.abs(C.dot(r[0], C.cross(r[1], r[2])) - 1) <= 1e-6
    sight = [F.col(f"__c{a}") - c for a, c in zip("xyz", t, strict=True)]
    rows = rows.withColumns({f"__s{a}": c for a, c in zip("xyz", sight, strict=True)}).withColumn("__away", C.norm([F.col(f"__s{a}") for a in "xyz"]))
    axis = [r[i][2] for i in range(3)]
    look = F.try_divide(C.dot(axis, [F.col(f"__s{a}") for a in "xyz"]), F.col("__away"))
    normal = [F.col(f"__m{a}") for a in "xyz"]
    incidence = F.try_divide(-C.dot(axis, normal), C.norm(normal))
    adaptive = limits.low is not None and limits.high is not None
    bounds = F.col("distance").between(limits.low, limits.high) if adaptive else F.abs(F.col("distance") - limits.baseline) <= 1e-12
    measured = ~F.col("__there") | F.col("__known").isNull()
    orthonormal = right
    for c in square:
        orthonormal = orthonormal & c
    feet = [F.col(f"footprint_{a}") for a in "uv"]
    # Views in one pose are one place, so that pairs are of places and no table of views is broadcast.
    pose = [*"xyz", *C.ROTATION]
    own = stored(rows.filter("__there").select(plan, "view_id", *(F.col(c).alias(a) for c, a in zip(C.TRANSLATION, "xyz", strict=True)), *C.ROTATION), "plan-poses")
    places = own.groupBy(plan, *pose).agg(F.min("view_id").alias("place"), (F.min("view_id") < F.max("view_id")).alias("many"))
    places = stored(places, "plan-places")
    near = radius_join(places, places, limits.duplicate_m, "place", "place", [plan], keep=[*C.ROTATION, "many"]).filter("place_a < place_b OR (place_a = place_b AND a_many)")
    trace = sum((F.col(f"a_{c}") * F.col(f"b_{c}") for c in C.ROTATION[1:]), F.col("a_r00") * F.col("b_r00"))
    near = near.filter(C.angle_deg((trace - 1) / 2) <= limits.duplicate_deg)
    near = near.select(plan, F.explode(F.array("place_a", "place_b")).alias("place")).distinct()
    twice = places.join(near.hint("merge"), [plan, "place"], "left_semi")
    twice = own.join(twice.hint("merge"), [plan, *pose], "left_semi").select(plan, "view_id").distinct().withColumn("__twice", F.lit(True)).hint("merge")
    rows = rows.join(twice, [plan, "view_id"], "left")
    checks = [
        ("unknown_patch", F.col("__known").isNotNull()),
        ("pose_missing", F.col("__there")),
        ("rotation", ~F.col("__there") | orthonormal),
        ("distance", measured | (F.abs(F.col("__away") - F.col("distance")) <= limits.standoff_error)),
        ("look", measured | (look >= limits.look_cosine)),
        ("incidence", measured | (incidence >= limits.incidence_cosine)),
        ("projection", F.col("projection") + 1e-12 >= limits.projection),
        ("visibility", F.col("visibility") + 1e-12 >= limits.visibility),
        ("footprint", C.all_finite(F.array(*(f.cast("double") for f in feet))) & (F.least(*feet) > 0)),
        ("bounds", bounds),
        ("duplicate", F.col("__twice").isNull()),
    ]
    rows = stored(rows.withColumn("reasons", F.concat_ws(",", C.reasons(*checks))).withColumn("accepted", F.col("reasons") == "").select(*views.columns, "side", "region", "accepted", "reasons"), "plan-views")
    needed = [*PLANNED, *(FIN_REGIONS if limits.fin else ())]
    every = views.select(plan).unionByName(patches.select(plan)).distinct()
    every = every.withColumn("side", F.explode(F.array(*map(F.lit, SIDES)))).withColumn("region", F.explode(F.array(*map(F.lit, needed))))
    found = rows.groupBy(plan, "side", "region").agg(F.count(F.lit(1)).alias("planned"), F.sum(F.col("accepted").cast("long")).alias("accepted"))
    regions = every.join(found, [plan, "side", "region"], "left").na.fill(0, ["planned", "accepted"])
    missing = F.when(F.col("planned") == 0, "no_view").when(F.col("accepted") == 0, "no_accepted")
    return rows, regions.withColumn("missing", missing)


@dataclass(frozen=True)
class FinalGates:
    views: int = 1
    triangles: int = 1
    edges: int = 0
    loops: int = 0
    watertight: bool = False
    fin_faces: bool = False
    fin_regions: bool = False


def boundary_loops(triangles: DataFrame) -> DataFrame:
    """mesh_id, edges, boundary_edges, loops (groups of boundary edges that share vertices), watertight (every edge has two triangles) of triangles (mesh_id, a, b, c)."""
    edges = stored(mesh_edges(triangles), "mesh-edges")
    node = lambda v: F.xxhash64("mesh_id", v)
    rim = stored(edges.filter("boundary").select("mesh_id", node("p").alias("a"), node("q").alias("b")), "mesh-rim")
    roots = components(rim)
    loops = rim.join(roots.withColumnRenamed("node", "a"), "a").groupBy("mesh_id").agg(F.count_distinct("root").alias("loops"))
    out = edges.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("boundary").cast("long")).alias("boundary_edges"), (F.min("n") == 2).alias("__two"), (F.max("n") == 2).alias("__most"))
    out = out.join(loops, "mesh_id", "left").na.fill(0, ["loops"])
    return out.select("mesh_id", "edges", "boundary_edges", "loops", (F.col("__two") & F.col("__most")).alias("watertight"))


def final_gate_report(required: DataFrame, quality: DataFrame, views: DataFrame, triangles: DataFrame, fins: DataFrame, gates: FinalGates, key: str = "blade_id") -> DataFrame:
    """A row for each blade of required: counts, passed and violations in order.

    required: key, patch_id. quality: key, patch_id, side, region, complete. views: key, side. triangles: key, side, a, b, c (vertices). fins: key, side, two_faces. Sides are front and back. Counts: required,
    complete, views, triangles and fins of each side, boundary_edges, boundary_loops, watertight (false without a mesh). Violations: patches (not every required patch
    is complete, or others were measured), views_, triangles_, fins_ (not exactly one), faces_ (one of them with a single face) and, with fin_regions, missing_ and incomplete_ for side and region; boundary_edges,
    boundary_loops, watertight.
    """
    one = F.count(F.lit(1))
    required, quality = required.select(key, "patch_id").distinct(), quality.select(key, "patch_id", "side", "region", "complete")
    judged = required.withColumn("__need", F.lit(True)).join(quality.withColumn("__got", F.lit(True)), [key, "patch_id"], "full")
    patches = judged.groupBy(key).agg(
        F.sum(F.col("__need").isNotNull().cast("long")).alias("required"),
        F.sum((F.col("__need").isNotNull() & F.coalesce("complete", F.lit(False))).cast("long")).alias("complete"),
        F.sum((F.col("__need").isNull() | F.col("__got").isNull()).cast("long")).alias("__odd"),
    )
    of = lambda s: F.sum((F.col("side") == s).cast("long"))
    counted = lambda rows, name: rows.groupBy(key).agg(*(of(s).alias(f"{name}_{s}") for s in SIDES))
    faces = fins.groupBy(key).agg(*(F.max(F.when((F.col("side") == s) & ~F.col("two_faces"), F.lit(True))).alias(f"__single_{s}") for s in SIDES))
    mesh = boundary_loops(triangles.withColumnRenamed(key, "mesh_id")).withColumnRenamed("mesh_id", key).withColumnRenamed("loops", "boundary_loops").drop("edges")
    region = lambda s, g: (F.col("side") == s) & (F.col("region") == g)
    grouped = quality.groupBy(key).agg(
        *(f(F.when(region(s, g), v)).alias(f"__{n}_{s}_{g}") for s in SIDES for g in FIN_REGIONS for n, f, v in (("n", F.count, F.lit(1)), ("all", F.min, F.col("complete"))))
    )
    out = required.select(key).distinct()
    for part in (patches, counted(views, "views"), counted(triangles, "triangles"), counted(fins, "fins"), faces, mesh, grouped):
        out = out.join(part, key, "left")
    counts = [*(f"{n}_{s}" for n in ("views", "triangles", "fins") for s in SIDES), "boundary_edges", "boundary_loops"]
    out = out.na.fill(0, counts).na.fill(False, ["watertight"])
    checks: list[tuple[str, Column]] = [("patches", (F.col("complete") == F.col("required")) & (F.col("__odd") == 0))]
    checks += [(f"views_{s}", F.col(f"views_{s}") >= gates.views) for s in SIDES] + [(f"triangles_{s}", F.col(f"triangles_{s}") >= gates.triangles) for s in SIDES]
    if gates.fin_faces:
        for s in SIDES:
            checks += [(f"fins_{s}", F.col(f"fins_{s}") == 1), (f"faces_{s}", (F.col(f"fins_{s}") != 1) | F.col(f"__single_{s}").isNull())]
    if gates.fin_regions:
        for s in SIDES:
            for g in FIN_REGIONS:
                n, whole = F.coalesce(f"__n_{s}_{g}", F.lit(0)), F.coalesce(f"__all_{s}_{g}", F.lit(False))
                checks += [(f"missing_{s}_{g}", n > 0), (f"incomplete_{s}_{g}", (n == 0) | whole)]
    checks += [("boundary_edges", F.col("boundary_edges") <= gates.edges), ("boundary_loops", F.col("boundary_loops") <= gates.loops), ("watertight", F.col("watertight") | F.lit(not gates.watertight))]
    out = out.withColumn("violations", F.concat_ws(",", C.reasons(*checks)))
    return out.select(key, "required", "complete", *counts, "watertight", (F.col("violations") == "").alias("passed"), "violations")


def calibration_consistency(views: DataFrame, keys: Sequence[str], order: str = "seq", most: float = 1e-9) -> DataFrame:
    """keys, view_id, off, consistent: how far rectified_T_raw of each view lies from that of its key's first view, in the entry that differs most.

    views: keys, view_id, order, and the poses p_r00 .. p_tz (base_T_rectified) and r00 .. tz (base_T_raw). Of equals in order the smaller view_id is first. A null entry is not consistent.
    """
    keys = list(keys)
    calibration = C.compose(C.invert(C.pose("p_")), C.pose())
    rows = stored(views.select(*keys, "view_id", order, *C.flat(calibration)), "calibrations")
    first = F.first(F.struct(*C.POSE)).over(Window.partitionBy(*keys).orderBy(order, "view_id"))
    off = F.greatest(*(F.abs(F.col(c) - F.col("__first")[c]) for c in C.POSE))
    whole = F.lit(True)
    for c in C.POSE:
        whole = whole & (F.abs(F.col(c) - F.col("__first")[c]) <= most)
    return rows.withColumn("__first", first).select(*keys, "view_id", off.alias("off"), F.coalesce(whole, F.lit(False)).alias("consistent"))


def tracking_deviation(samples: DataFrame, key: str) -> DataFrame:
    """key, joint (from 0), n, deviation: the largest difference between command and actual (arrays, a value for each joint) of samples. Joints that one of the two lacks don't count."""
    both = samples.select(key, F.posexplode(F.arrays_zip("command", "actual")).alias("joint", "of")).select(key, "joint", F.abs(F.col("of.command") - F.col("of.actual")).alias("gap"))
    return both.filter("gap IS NOT NULL").groupBy(key, "joint").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("deviation"))
