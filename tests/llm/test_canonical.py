import pytest

from arcspan.llm import canonical
from arcspan.llm.canonical import Dictionary, deletes, distance, forms, map_values, normal, resolved

REF = [(1, "type", "settlement", None, None), (2, "type", "cave", "Höhle", "grotte"), (3, "type", "mine", "Bergwerk", None), (4, "type", "stone circle", None, "cercle de pierres"), (5, "type", "workshop", None, None), (6, "type", "settlement mound", None, "tell"), (7, "other", "pit", "Grube", "fosse"), (8, "other", "posthole", None, None), (9, "other", "wall", None, "mur")]


def frame(spark):
    return spark.createDataFrame(REF, "ref_id int, field_name string, label string, label_de string, label_fr string")


def test_distance():
    assert distance("cave", "cave", 2) == 0
    assert distance("cvae", "cave", 2) == pytest.approx(0.7)
    assert distance("caave", "cave", 2) == pytest.approx(0.5)
    assert distance("bave", "cave", 2) == pytest.approx(1.3)
    assert deletes("abc", 1) == {"abc", "ab", "ac", "bc"}
    assert normal("Höhle_(Karst)") == "hohle karst" and normal("Höhle", True) == "hoehle"


@pytest.mark.parametrize(
    "value, want",
    [
        ("Cave", 2), ("Hoehle", 2), ("cave?", 2), ("poss. cave", 2), ("part of a Grotte", 2), ("cvae / mine", 2), ("mine + cave", 3), ("minefield", 0), ("setttlement", 1), ("SETTLEMENT_MOUND", 6), ("settl.", 1), ("stonec ircle", 4), ("st. circle", 4), ("worshop 2", 5), ("sttlmnt", 1), ("wrkshp", 5), ("s e t t l e m e n t", 1),
        ("n/a", 0), ("12", 0), ("?", 0), ("bridge", 0), ("caves", 2), ("x" * 5000, 0),
    ],
)
def test_find(value, want):
    entries = [(r[0], [x for x in r[2:] if x], r[2]) for r in REF if r[1] == "type"]
    assert Dictionary.of(entries, {1: 10}).find(value) == want


def test_map_values(spark):
    rows = [(1, "Höhle", "Grube", 5), (2, None, "  ", 5), (3, "cave", "Cave", 5), (None, "xyz", "wall", 5), (1, "Höhle", "Grube", 5)]
    df = spark.createDataFrame(rows, "id long, type string, other string, ref_id int")
    got = sorted([(r["id"], r["field_name"], r["ref_id"]) for r in map_values(df, "id", ["type", "other"], frame(spark)).collect()], key=str)
    assert got == sorted([(1, "type", 2), (1, "other", 7), (1, "type", 2), (1, "other", 7), (3, "other", 0), (None, "type", 0)], key=str)
    assert map_values(df.limit(0), "id", ["type"], frame(spark)).count() == 0
    assert {r["ref_id"] for r in map_values(df, "id", ["type"], frame(spark).limit(0)).collect()} == {0}


def test_forms():
    assert resolved([(1, canonical.FULL, 2.0), (2, canonical.FULL, 1.0)]) == (2, True)
    assert resolved([(1, canonical.SHORT, 2.0), (2, canonical.SHORT, 1.0)]) is None
    assert resolved([(1, canonical.SHORT | canonical.SINGLE, 2.0), (2, canonical.SHORT, 1.0)]) == (1, False)
    assert {"cave", "caves", "cavees"} >= {k for k, what in forms(["cave"], "cave").items() if what & canonical.FULL} - {"cavees", "cavess"}


VALUES = ["Cave", "Hoehle", "cvae / mine", "setttlement", "settl.", "st. circle", "stonec ircle", "worshop 2", "n/a", "bridge", "x" * 3000, "SETTLEMENT_MOUND", "dwelling under a rock", "cave", "sttlmnt"]


def test_further_names_and_long_lists(spark, monkeypatch):
    """A list too long to be broadcast gives the same answers by the shuffled delete index."""
    df = spark.createDataFrame([(k, v, "Grube") for k, v in enumerate(VALUES)] + [(99, "cave", None)] * 5, "id long, type string, other string")
    names = spark.createDataFrame([("cave", "dwelling under a rock"), ("wall", None)], "label string, name string")
    plain = {r["id"]: r["ref_id"] for r in map_values(df, "id", ["type"], frame(spark)).collect()}
    rows = lambda: sorted(tuple(r) for r in map_values(df, "id", ["type", "other"], frame(spark), names=names).collect())
    small = rows()
    assert plain[12] == 0 and (12, "type", VALUES[12], 2) in small
    monkeypatch.setattr(canonical, "BROADCAST_REFERENCE", 3)
    assert rows() == small
