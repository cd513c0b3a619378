import numpy as np

from arcspan.llm.matching import REACH_KM, Mixture, candidate_pairs, match, rounding_km, site_profiles
from arcspan.llm.names import parts

G = frozenset({"hill", "great", "tepe", "ober", "hohle"})


def test_names():
    assert parts("Great Saint-Foo Hill ?", G)[0] == ["foo"]
    assert parts("Foo, Great", G)[0] == parts("great foo", G)[0]
    assert parts("Foo (East)", G)[2] == parts("Foo E", G)[2] == "e"
    assert parts("Foo #1", G)[2] == parts("Foo I", G)[2] == "1"
    assert "bar" in parts("Foo/Bar", G)[0] and "foo" in parts("Foo [Bar]", G)[0]
    assert "gaul" in parts("Gaulhoehle", G)[0] and "klin" in parts("OberKlin", G)[0]
    assert parts(None, G) == ([], [], "") and parts("  ", G) == ([], [], "") and parts("Hill", G)[0] == ["hill"]
    assert rounding_km(10.5, 20.0) > 5 > rounding_km(10.52, 20.01) > 0.4


def test_mixture_separates():
    rng = np.random.default_rng(0)
    a = np.column_stack([rng.normal(0.95, 0.04, 400), abs(rng.normal(0.4, 0.4, 400)), abs(rng.normal(0.3, 0.4, 400))])
    b = np.column_stack([rng.normal(0.3, 0.1, 4000), rng.uniform(0, 5, 4000), np.minimum(3.0, abs(rng.normal(2.2, 1.0, 4000)))])
    a[::7, 2] = b[::5, 2] = np.nan
    m = Mixture(np.vstack([a, b]), np.ones(4400))
    m.fit()
    assert m.gamma[:400].mean() > 0.95 and m.gamma[400:].mean() < 0.02


NAMES = ["Vasdilquu", "Brelpoth", "Sorvéier", "Mekoluun", "Thackwim", "Dosegal", "Rimukoro", "Karfolba", "Gunkolmet", "Lwiwatoa", "Zeltharm", "Quipogal", "Nethbrad", "Foulisfi", "Habunqar", "Tolweast", "Piralgon", "Uskemdar", "Jornavik", "Cyeldruth"]


def data(spark):
    rng = np.random.default_rng(5)
    places, sites = [], []
    for k, n in enumerate(NAMES * 3):
        la, lo = float(rng.uniform(-60, 60)), float(rng.uniform(-179, 179))
        name = f"{n}{k // 20 * 'in'}"
        sites.append((f"S{k}", name, la, lo))
        if k % 2 == 0:
            places.append((k, name.upper() if k % 4 else f"{name} ?", la + 0.003, lo))
        else:
            places.append((1000 + k, "Xem" + NAMES[(k + 7) % 20][::-1], la + 0.01, lo))
    places += [(500, None, 95.0, 3.0), (501, "Nowhere", None, None), (502, " ", 0.0, 0.0), (None, "Vasdilquu", sites[0][2], sites[0][3]), (503, "x" * 50000, sites[1][2], sites[1][3]), (0, "Vasdilquu ?", sites[0][2] + 0.003, sites[0][3])]
    # a sister of the first site, told apart by an addition
    sites += [("sister", "Vasdilquu East", sites[0][2] + 0.012, sites[0][3]), (None, "Vasdilquu", 1.0, 1.0), ("long", "x" * 50000, sites[1][2], sites[1][3]), ("null", None, None, None)]
    return spark.createDataFrame(places, "id long, name string, lat double, lon double"), spark.createDataFrame(sites, "id string, name string, lat double, lon double")


def test_match(spark):
    p, s = data(spark)
    got = {(r["place"], r["site"]) for r in match(p, s).where("confidence >= 0.5").collect()}
    want = {(k, f"S{k}") for k in range(0, 60, 2)}
    assert want <= got
    assert (0, "sister") not in got and (503, "long") in got and len(got) <= len(want) + 2
    assert match(p.limit(0), s).count() == 0 and match(p, s.limit(0)).count() == 0


def test_dates_decide_where_names_are_missing(spark):
    rng = np.random.default_rng(8)
    la, lo = rng.uniform(-60, 60, 60), rng.uniform(-170, 170, 60)
    year = rng.uniform(-8000, 1000, 60)
    places = [(k, f"{NAMES[k % 20]}{k}", float(la[k]) + 0.004, float(lo[k]), float(year[k]), float(year[k]) + 50) for k in range(60)]
    sites = [(f"S{k}", None if k >= 58 else f"{NAMES[k % 20]}{k}", float(la[k]), float(lo[k]), float(year[k]) + (6000 if k == 59 else 0), float(year[k]) + (6000 if k == 59 else 10)) for k in range(60)]
    schema = "id {}, name string, lat double, lon double, low double, high double"
    got = {(r["place"], r["site"]): r["confidence"] for r in match(spark.createDataFrame(places, schema.format("long")), spark.createDataFrame(sites, schema.format("string"))).collect()}
    assert got[(58, "S58")] > got.get((59, "S59"), 0.0) and all(got[(k, f"S{k}")] > 0.5 for k in range(58))


def test_site_profiles(spark):
    rows = [("a", "X", 10.0, 20.0), ("a", "X", 10.0, 20.0), ("a", "x ", 0.0, 0.0), ("a", None, 10.01, None), ("b", " ", None, 1.0), (" ", "q", 1.0, 1.0), (None, "q", 1.0, 1.0), ("c", "Z", 120.0, 33.0), ("c", "Z", float("nan"), 2.0)]
    got = {r["id"]: (r["name"], r["lat"], r["lon"]) for r in site_profiles(spark.createDataFrame(rows, "k string, n string, a double, o double"), "k", "n", "a", "o").collect()}
    assert got == {"a": ("X", 10.0, 20.0), "b": (None, None, None), "c": ("Z", 120.0, 33.0)}


def test_all_pairs_in_reach_are_compared(spark):
    rng = np.random.default_rng(2)
    names = [("Abri Moali", "Abri Molai"), ("Resnu", "Rensu"), ("Teugr Hill", "Tegur Hill"), ("Cerro Bteue", "Cerro Betue"), ("Solruot", "Sorlout"), ("Ab", "Zyx")]
    at = [(float(60 + rng.uniform(-0.1, 0.1)), float((180 + rng.uniform(-0.2, 0.2) + 180) % 360 - 180)) for _ in range(60)]
    rows = lambda k, pick: spark.createDataFrame([(i, names[i % 6][k], round(la, 4), round(lo, 4), None, None) for i, (la, lo) in enumerate(at) if i in pick], "ent long, name string, lat double, lon double, low double, high double")
    got = {(r["p"], r["s"]) for r in candidate_pairs(rows(0, range(60)), rows(1, range(0, 60, 2)), frozenset({"hill", "abri", "cerro"})).select("p", "s").collect()}

    def km(a, b):
        (p, q), (r, s) = np.radians(a), np.radians(b)
        return 2 * 6371 * np.arcsin(np.sqrt(np.sin((p - r) / 2) ** 2 + np.cos(p) * np.cos(r) * np.sin((q - s) / 2) ** 2))

    want = {(i, j) for i in range(60) for j in range(0, 60, 2) if km(at[i], at[j]) <= REACH_KM}
    assert want <= got and len(want) > 100 and all(km(at[i], at[j]) <= REACH_KM + 0.1 for i, j in got)
