import numpy as np

from arcspan.functions.geo import band_sine
from arcspan.operators import nulls, poles
from arcspan.plans import reference, registry


def near(spark, small, grid):
    """Sites in order of id, and which of them lies within 300 km of each pole's circle, by plain loops over poles."""
    s = reference.sites(spark, small).select("id", "lat", "lon", "cls").orderBy("id").toPandas()
    v = poles.unit_vectors(s["lat"], s["lon"])
    return s, np.column_stack([np.abs(v @ poles.unit_vectors([la], [lo])[0]) <= band_sine(300.0) for _, la, lo in grid])


def test_pole_scan_is_whole(spark, small):
    grid = poles.pole_grid(2.0, False)
    s, hit = near(spark, small, grid)
    got = {(r["pole_id"], r["cls"]): r["n"] for r in registry.queries()["pole_scan_full"](spark, small).collect()}
    want = {(grid[k][0], c): int(n) for c in s["cls"].unique() for k, n in enumerate(hit[(s["cls"] == c).to_numpy()].sum(axis=0))}
    assert len(grid) == 16380 and got == want


def test_split_sample_is_whole(spark, small):
    grid = poles.pole_grid(2.0, False)
    s, hit = near(spark, small, grid)
    got = {r["split"]: (r["pole_id"], r["fitted"], r["tested"]) for r in registry.queries()["split_sample_full"](spark, small).collect()}
    assert set(got) == set(range(100))
    for split in (0, 1, 57, 99):
        x = (split * 7919 + s["id"].to_numpy() * 104_729 + 71 * 15_485_863) % nulls.M31
        y = x * nulls.A1 % nulls.M31
        half = (y * y % nulls.M31 * nulls.A2 + y) % nulls.M31 % 2
        fitted, tested = hit[half == 0].sum(axis=0), hit[half == 1].sum(axis=0)
        assert got[split] == (grid[best := int(np.argmax(fitted))][0], fitted[best], tested[best])


def test_second_stage_leaves_no_gap(spark, small):
    got = {(r["lat"], r["lon"]): r["n"] for r in registry.queries()["pole_scan_twostage_full"](spark, small).collect()}
    coarse = poles.pole_grid(2.0)
    counts = near(spark, small, coarse)[1].sum(axis=0)
    fine = [(0, float(a), float(o)) for k, (_, la, lo) in enumerate(coarse) if counts[k] >= 0.9 * counts.max() for a in np.arange(la - 1, la + 1.1, 0.5) if a <= 90 for o in (np.arange(lo - 1, lo + 1.1, 0.5) + 180) % 360 - 180]
    fine = sorted(set(fine))
    assert got == {(la, lo): int(n) for (_, la, lo), n in zip(fine, near(spark, small, fine)[1].sum(axis=0))}
