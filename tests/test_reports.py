"""Reports name every fault that is planted, and no other."""

from scanspark.operators import reports as R

POSE = ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double"
VIEWS = "plan_id int, view_id int, patch_id string, distance double, projection double, visibility double, footprint_u double, footprint_v double, " + POSE
PATCHES = "plan_id int, patch_id string, side string, region string, cx double, cy double, cz double, mx double, my double, mz double"
DOWN = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)
LIMITS = R.PlanLimits(0.3, 0.2, 0.4)


def test_plan_inspection_names_planted_faults(spark):
    good = (0.3, 0.95, 0.95, 0.2, 0.1, *DOWN)
    nan = float("nan")
    rows = [
        (1, 1, "p1", *good, 0.0, 0.0, 0.3),
        (1, 2, "p2", *good, 1.0, 0.0, 0.33),
        (1, 3, "p3", 0.3, 0.5, 0.5, 0.0, 0.1, *DOWN, 2.0, 0.0, 0.3),
        (1, 4, "p4", *good[:5], 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, -1.0, 3.0, 0.0, 0.3),
        (1, 5, "p5", *good, 4.0, 0.2, 0.3),
        (1, 6, "p6", *good, nan, 0.0, 0.3),
        (1, 7, "nowhere", *good, 9.0, 0.0, 0.3),
        (1, 8, "p8", 0.5, *good[1:], 5.0, 0.0, 0.5),
        (1, 9, "p9", *good, 6.0, 0.0, 0.3),
        (1, 10, "p9", *good, 6.001, 0.0, 0.3),
        (1, 11, "p11", *good, 7.0, 0.0, 0.3),
    ]
    patches = [(1, f"p{k}", "front", "root", float(x), 0.0, 0.0, 0.0, 0.0, 1.0) for k, x in ((1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 8), (8, 5), (9, 6))] + [(1, "p11", "back", "tip", 7.0, 0.0, 0.0, 0.8, 0.0, 0.6), (2, "q", "front", "tip", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    views, regions = R.inspect_plan(spark.createDataFrame(rows, VIEWS), spark.createDataFrame(patches, PATCHES), LIMITS)
    got = {r.view_id: r.reasons for r in views.collect()}
    assert got == {1: "", 2: "distance", 3: "projection,visibility,footprint", 4: "rotation", 5: "distance,look", 6: "pose_missing", 7: "unknown_patch", 8: "bounds", 9: "duplicate", 10: "duplicate", 11: "incidence"}
    told = {(r.plan_id, r.side, r.region): (r.planned, r.accepted, r.missing) for r in regions.collect()}
    assert len(told) == 20 and told[1, "front", "root"] == (9, 1, None) and told[1, "back", "tip"] == (1, 0, "no_accepted") and told[2, "front", "tip"] == (0, 0, "no_view")
    assert views.columns[-4:] == ["side", "region", "accepted", "reasons"]


def test_boundary_loops(spark):
    tetrahedron = [("closed", *t) for t in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]
    rows = tetrahedron + [("two", 0, 1, 2), ("two", 5, 6, 7)] + [("strip", k, k + 1, k + 2) for k in range(5)]
    got = {r.mesh_id: (r.edges, r.boundary_edges, r.loops, r.watertight) for r in R.boundary_loops(spark.createDataFrame(rows, "mesh_id string, a long, b long, c long")).collect()}
    assert got == {"closed": (6, 0, 0, True), "two": (6, 6, 2, False), "strip": (11, 7, 1, False)}


def test_final_gates(spark):
    faces = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))
    frame = spark.createDataFrame
    required = frame([(b, p) for b in (1, 2, 3) for p in ("x", "y")], "blade_id int, patch_id string")
    regions = [(b, f"{s}{g}", s, g, not (b == 2 and g == "fin_root")) for b in (1, 2) for s in R.SIDES for g in R.FIN_REGIONS]
    need = required.unionByName(frame([r[:2] for r in regions], "blade_id int, patch_id string"))
    quality = frame([(b, p, "front", "surface", b == 1 or p == "x") for b in (1, 2) for p in ("x", "y")] + regions, "blade_id int, patch_id string, side string, region string, complete boolean")
    views = frame([(1, "front"), (1, "back"), (2, "front")], "blade_id int, side string")
    triangles = frame([(1, s, *(v + k for v in f)) for k, s in ((0, "front"), (10, "back")) for f in faces] + [(2, "front", 0, 1, 2)], "blade_id int, side string, a long, b long, c long")
    fins = frame([(1, "front", True), (1, "back", True), (2, "front", False), (2, "back", True), (2, "back", True)], "blade_id int, side string, two_faces boolean")
    got = {r.blade_id: r for r in R.final_gate_report(need, quality, views, triangles, fins, R.FinalGates(1, 4, 0, 0, True, True, True)).collect()}
    assert got[1].passed and got[1].violations == "" and (got[1].required, got[1].complete, got[1].watertight) == (8, 8, True)
    assert got[2].violations == "patches,views_back,triangles_front,triangles_back,faces_front,fins_back,incomplete_front_fin_root,incomplete_back_fin_root,boundary_edges,boundary_loops,watertight"
    assert got[3].violations.startswith("patches,views_front,views_back,triangles_front") and "missing_back_fin_face" in got[3].violations and not got[3].watertight


def test_calibrations_and_tracking(spark):
    eye = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    schema = "blade int, view_id int, seq int, " + ", ".join(f"p_{c}" for c in POSE.split(", ")) + ", " + POSE
    rows = [(1, 1, 0, *eye, 0.0, 0.0, 0.0, *eye, 0.1, 0.0, 0.0), (1, 2, 1, *DOWN, 5.0, 0.0, 0.0, *DOWN, 5.1, 0.0, 0.0), (1, 3, 2, *eye, 0.0, 0.0, 0.0, *eye, 0.1, 2e-9, 0.0), (2, 4, 0, *eye, 0.0, 0.0, 0.0, *eye, None, 0.0, 0.0)]
    got = {r.view_id: r.consistent for r in R.calibration_consistency(spark.createDataFrame(rows, schema), ["blade"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    samples = spark.createDataFrame([(1, [0.0, 1.0], [0.5, 1.0]), (1, [2.0, 2.0], [1.0, None]), (2, None, [1.0])], "k int, command array<double>, actual array<double>")
    assert {tuple(r) for r in R.tracking_deviation(samples, "k").collect()} == {(1, 0, 2, 1.0), (1, 1, 1, 0.0)}
