import pytest

from arcspan.operators.multivalue import best, log_bound, pieces, split_values


@pytest.mark.parametrize(
    "field, want",
    [
        ("", []), (" a ", ["a"]), ("a,b;c|d/e\tf\ng", list("abcdefg")), (",,a,;b,", ["a", "b"]), ('"a, b", c', ["a, b", "c"]), ("'a; b';c", ["a; b", "c"]), ("potter's field, d", ["potter's field", "d"]), ('["x","y z"]', ["x", "y z"]), ("{x, y}", ["x", "y"]),
        ("t (a, b), c", ["t (a, b)", "c"]), ("t (a; (b, c)), d", ["t (a; (b, c))", "d"]), ('"house ""with masks""", x', ['house "with masks"', "x"]), ('"open, x', ['"open', "x"]), ("a (b, c", ["a (b", "c"]), ('""', []), ("[]", []),
    ],
)
def test_pieces(field, want):
    assert [p.text for p in pieces(field)[1]] == want


def test_long_fields_take_linear_time():
    n = 200_000
    for field in ('"' * n, "(" * n, "'a," * n, '"a,' * n, "(a," * n, ")" * n, " " * n + "x", '"a"b,' * n):
        assert isinstance(pieces(field)[1], list)
    assert len(pieces("a," * n)[1]) == n


def test_bound_and_free_neighbours():
    assert log_bound(40, 41, 40, 1000) > 5
    assert log_bound(40, 300, 400, 1000) < -10
    assert log_bound(200, 1000, 3000, 20_000) < -8


def test_viterbi_takes_the_better_of_overlapping_values():
    parts = pieces("a/b/c,d")[1]
    assert best(parts, {1: 2.0, 2: 3.0}, lambda sign: -5.0) == [2]
    assert best(parts, {1: 3.0, 2: 2.0, 3: 2.5}, lambda sign: -5.0) == [1, 3]
    assert best(parts, {}, lambda sign: -5.0) == []


def column(spark):
    """Joined values without quotes, of two and of three parts; "-" between spaces that joins and ":" that splits; ";" that always splits."""
    words = ["tomb", "villa", "fort", "bath", "port", "mine"]
    rows = [f"{a};{b}" for a in words for b in words if a != b] + [f"{a} : {b}" for a in words for b in words if a != b]
    rows += [f"kiln / oven;{a};{b}" for a in words for b in words if a != b] + [f"{a};wine / oil / grain" for a in words] + [f"{a};Wine / Oil / Grain;{b}" for a in words for b in words if a < b]
    rows += [f"bath / {a}" for a in words[:3]] + [f"{a};upper - lower" for a in words] + ["kiln / oven"]
    return spark.createDataFrame(list(enumerate(rows)), "id long, v string"), rows


def test_what_the_column_tells_decides(spark):
    """The split that only knows the signs differs from the learnt one."""
    df, rows = column(spark)
    learnt: dict = {}
    for r in split_values(df, "id", "v").orderBy("id", "pos").collect():
        learnt.setdefault(r["id"], []).append(r["item"])
    for k, v in enumerate(rows):
        want = [x.strip() for part in v.split(";") for x in (part.split(" : ") if " : " in part else part.split(" / ") if part.startswith("bath") else [part])]
        assert learnt[k] == want, v
    bare = [x for r in split_values(df, "id", "v", min_uses=10**6).collect() for x in [r["item"]]]
    assert "kiln" in bare and "kiln / oven" not in bare


def test_split_values(spark):
    rows = [(1, "a, B", 0), (2, None, 0), (3, "  ", 0), (None, "c", 0), (1, "a, B", 0), (4, "x" * 20000 + ";y", 0)] + [(5, '"kiln / oven"', 0)] * 30
    df = spark.createDataFrame(rows, "id long, v string, pos int")
    got = sorted([tuple(r) for r in split_values(df, "id", "v").where("id is null or id <> 5").collect()], key=str)
    assert got == sorted([(1, 1, "a"), (1, 2, "B"), (1, 1, "a"), (1, 2, "B"), (None, 1, "c"), (4, 1, "x" * 20000), (4, 2, "y")], key=str)
    assert split_values(df.limit(0), "id", "v").count() == 0
