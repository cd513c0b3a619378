import numpy as np

from arcspan.operators.spatial import PackedRTree, QuadTree, haversine_np, near_join, region_join

P = "id long, lat double, lon double, site string, leaf int"
S = "key string, lat double, lon double, id long, j int"


def brute(p, s, km):
    out = set()
    for i, a, o in p:
        for k, b, q in s:
            ok = all(v is not None and not np.isnan(v) for v in (a, o, b, q)) and abs(a) <= 90 and abs(b) <= 90 and (a, o) != (0, 0) and (b, q) != (0, 0)
            if ok and k is not None and haversine_np(a, (o + 180) % 360 - 180, b, (q + 180) % 360 - 180) <= km:
                out.add((i, k))
    return out


def frames(spark, p, s):
    return spark.createDataFrame([(i, a, o, "x", 1) for i, a, o in p], P), spark.createDataFrame([(k, a, o, 7, 2) for k, a, o in s], S)


def test_near_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150)))]
    p += [(900, 90.0, 10.0), (901, -90.0, -50.0), (902, 10.0, 179.95), (903, 10.0, -179.95), (904, 0.0, 0.0), (905, None, 3.0), (906, 95.0, 3.0), (907, 10.0, 539.95), (902, 10.0, 179.95), (None, 10.0, 180.0), (908, float("nan"), 1.0)]
    s = [(f"s{i % 60}", float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)))]
    s += [("pole", 89.9, -100.0), ("line", 10.0, -180.0), ("line", 10.0, 180.0), (None, 10.0, 180.0), ("zero", 0.0, 0.0)]
    for km in (30.0, 600.0):
        a, b = frames(spark, p, s)
        got = [(r[0], r[1]) for r in near_join(a, b, "id", "key", km, leaf_rows=20).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(p, s, km)


def test_near_join_shares_out_hot_leaves(spark):
    p = [(i, 10.0 + i * 1e-4, 20.0) for i in range(40)]
    s = [(f"s{i}", 10.0 + i * 1e-4, 20.0) for i in range(90)]
    a, b = frames(spark, p, s)
    got = {(r[0], r[1]) for r in near_join(a, b, "id", "key", 1.0, leaf_rows=8, group_rows=8).collect()}
    assert got == brute(p, s, 1.0)


def test_near_join_empty(spark):
    a, b = frames(spark, [(1, 1.0, 1.0)], [("a", 1.0, 1.0)])
    assert near_join(a.limit(0), b, "id", "key", 5.0).count() == 0
    assert near_join(a, b.limit(0), "id", "key", 5.0).count() == 0
    assert near_join(a, b, "id", "key", 5.0).count() == 1


def test_region_join_holes_and_wrap(spark):
    ring = [("A", 0, 0, 0, 170), ("A", 0, 1, 0, 190), ("A", 0, 2, 20, 190), ("A", 0, 3, 20, 170), ("A", 1, 0, 5, 178), ("A", 1, 1, 5, 182), ("A", 1, 2, 15, 182), ("A", 1, 3, 15, 178), ("B", 0, 0, -10, -10), ("B", 0, 1, -10, 10), ("B", 0, 2, 10, 0), ("B", None, 3, 1, 1), (None, 0, 1, 1, 1)]
    v = spark.createDataFrame([(a, b, c, float(d), float(e)) for a, b, c, d, e in ring], "area string, ring int, vertex int, lat double, lon double")
    pts = [(1, 2.0, -175.0), (2, 10.0, 180.0), (3, 10.0, 175.0), (4, 0.5, 0.5), (5, 0.0, 0.0), (6, 2.0, 185.0), (7, 50.0, 0.0), (8, None, 1.0), (1, 2.0, -175.0)]
    p = spark.createDataFrame([(i, a, float(o), "z", 0) for i, a, o in pts], P)
    got = [(r[0], r[1]) for r in region_join(p, v, "id", "area", "ring", "vertex").collect()]
    assert sorted(got) == [(1, "A"), (3, "A"), (4, "B"), (6, "A")]
    assert region_join(p, v.limit(0), "id", "area", "ring", "vertex").count() == 0
    assert region_join(p.limit(0), v, "id", "area", "ring", "vertex").count() == 0


def test_trees():
    rng = np.random.default_rng(0)
    x, y = rng.uniform(-180, 180, 3000), rng.uniform(-90, 90, 3000)
    t = QuadTree(x, y, 40, 0.05)
    b = t.boxes[t.owner(x, y)]
    assert ((b[:, 0] <= x) & (x <= b[:, 2]) & (b[:, 1] <= y) & (y <= b[:, 3])).all()
    assert np.isclose(((t.boxes[:, 2] - t.boxes[:, 0]) * (t.boxes[:, 3] - t.boxes[:, 1])).sum(), 360 * 180)
    q = np.column_stack([x[:100] - 2, y[:100] - 2, x[:100] + 2, y[:100] + 2])
    got = {(int(a), int(c)) for i, k in PackedRTree(np.column_stack([x, y, x, y])).probe(q) for a, c in zip(i, k)}
    assert got == {(i, int(j)) for i in range(100) for j in np.nonzero((x >= q[i, 0]) & (x <= q[i, 2]) & (y >= q[i, 1]) & (y <= q[i, 3]))[0]}
    assert list(PackedRTree(np.empty((0, 4))).probe(q)) == []
