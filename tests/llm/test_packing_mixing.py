import random

import numpy as np
import pytest

from arcspan.llm.mixing import mix, wanted_tokens
from arcspan.llm.packing import Plan, fill_gap, pack, plan, widths
from arcspan.llm.tokens import with_tokens


def test_fill_gap_is_a_best_subset():
    rng = random.Random(2)
    for _ in range(60):
        left = {rng.randint(1, 30): rng.randint(0, 3) for _ in range(6)}
        gap = rng.randint(1, 60)
        found = fill_gap(gap, left, sorted(left, reverse=True))
        assert all(n <= left[s] for s, n in found)
        sums = {0}
        for s, n in left.items():
            sums = {t + s * k for t in sums for k in range(n + 1) if t + s * k <= gap}
        assert sum(s * n for s, n in found) == max(sums)


@pytest.mark.parametrize("capacity", [50, 64, 1000])
def test_plan_uses_every_item_once(capacity):
    rng = random.Random(capacity)
    hist: dict[int, int] = {}
    for _ in range(5000):
        s = min(capacity, max(1, int(rng.lognormvariate(2.5, 1))))
        hist[s] = hist.get(s, 0) + 1
    (patterns, left), used = plan(hist, capacity), {}
    assert not left
    for p in patterns:
        assert p.fill == sum(s * n for s, n in p.uses) <= capacity
        for s, n in p.uses:
            used[s] = used.get(s, 0) + n * p.times
    assert used == hist
    total = sum(s * n for s, n in hist.items())
    assert sum(p.times for p in patterns) <= -(-total // capacity) * 1.02 + 1


def test_pack(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(s), "x") for i, s in enumerate(rng.integers(1, 60, 400))] + [(900, 250, "x"), (901, 100, "x"), (902, 0, "x"), (903, None, "x"), (None, 30, "x"), (5, 30, "x")]
    df = spark.createDataFrame(rows, "doc long, tokens int, piece string")
    got = pack(df, "doc", "tokens", 100).toPandas()
    assert len(got) == len(rows) + 2
    fill = got.groupby("container_id")["tokens"].sum()
    assert fill.max() <= 100 and sorted(fill.index) == list(range(len(fill)))
    assert sorted(got[got["doc"] == 900]["tokens"]) == [50, 100, 100] and set(got[got["doc"] == 900]["pieces"]) == {3}
    assert got[got["doc"].isin([902, 903])]["container_id"].isna().all()
    steps = got.dropna(subset=["container_id"]).groupby("step_id")["tokens"].sum()
    assert steps.max() - steps.min() <= 200
    assert pack(df.limit(0), "doc", "tokens", 100).count() == 0
    large = pack(df, "doc", "tokens", 10_000).toPandas()
    assert large.groupby("container_id")["tokens"].sum().max() <= 10_000 and large["tokens"].sum() == got["tokens"].sum()


def sizes(n: int, capacity: int, seed: int = 5) -> np.ndarray:
    return np.clip(np.random.default_rng(seed).lognormal(np.log(capacity) - 2, 1.0, n).astype(int), 1, capacity)


def placed(size: np.ndarray, made: Plan) -> np.ndarray:
    rank, seen = np.zeros(len(size), dtype=np.int64), {}
    for k, s in enumerate(size.tolist()):
        rank[k] = seen.get(s, 0)
        seen[s] = rank[k] + 1
    return made.place(size, rank)


@pytest.mark.parametrize("capacity", [1024, 1000, 20_000])
def test_tiers_decide_the_plan(capacity):
    """Other tiers make other windows and other containers; all fill them as well, none overflows."""
    size = sizes(20_000, capacity)
    hist = {int(s): int(n) for s, n in zip(*np.unique(size, return_counts=True))}
    made = {t: Plan(hist, capacity, t) for t in (1, 3, 5)}
    assert made[1].windows == len(size) > made[3].windows > made[5].windows
    assert len({tuple(p.uses for p in m.containers) for m in made.values()}) == 3
    for m in made.values():
        load = np.bincount(placed(size, m), weights=size)
        assert len(load) == m.total and load.max() <= capacity and load.min() > 0
        assert size.sum() >= 0.995 * capacity * (m.total - 1)


def test_a_window_holds_one_item_of_its_tier():
    size = sizes(5_000, 512)
    made = Plan({int(s): int(n) for s, n in zip(*np.unique(size, return_counts=True))}, 512, 4)
    assert widths(512, 4) == [512, 256, 128, 64] and widths(5, 5) == [5, 2, 1]
    long = np.bincount(placed(size, made)[size > 256])
    assert long.max() == 1


def test_wanted_tokens():
    assert wanted_tokens({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 100, "b": 300}) == {"a": 100, "b": 100}
    w = wanted_tokens({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5, "none": 0.2}, {"a": 20, "b": 500})
    assert w["a"] == 20 and w["b"] == 90


def test_mix(spark):
    rng = np.random.default_rng(4)
    rows = [(i, str(rng.choice(["a", "b", "c", "other"], p=[0.6, 0.2, 0.1, 0.1])), int(rng.integers(1, 200)), 1) for i in range(4000)] + [(9000, None, 50, 1), (9001, "a", None, 1), (None, "a", 7, 1), (1, "a", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long, rank int")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.35, 3), ("c", 0.2, 2), ("gone", 0.05, 9), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix(docs, targets)
    m, r = mixed.toPandas(), report.toPandas().set_index("source")
    assert set(m["source"]) == {"a", "b", "c"} and m.groupby(["source", "doc_id"], dropna=False)["copy"].max().groupby("source").max().to_dict() == r["most_repeats"].drop("gone").to_dict()
    assert (r["most_repeats"] <= r["max_repeats"]).all()
    assert m["tokens"].sum() == r["tokens"].sum()
    open_ = r.loc[["a", "b", "c"]]
    assert (abs(open_["tokens"] - open_["wanted_tokens"]) <= 0.01 * open_["wanted_tokens"] + 200).all()
    assert r.loc["gone", "tokens"] == 0
    empty, none = mix(docs.limit(0), targets)
    assert empty.count() == 0 and none.agg({"tokens": "sum"}).first()[0] == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", 3), (2, None, 3), (3, "", 3), (4, "a b " * 20000, 3), (5, "<|endoftext|>", 3)], "id long, text string, tokens int")
    got = {r["id"]: r["tokens"] for r in with_tokens(df, "text", ["id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 30000 and got[5] > 1
