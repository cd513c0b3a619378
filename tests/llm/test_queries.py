import pytest

from arcspan.llm import queries


@pytest.mark.parametrize("name, columns", [("p2_found", ["xronos_id", "field_name", "ref_id"]), ("p5_found", ["place_id", "site_id"]), ("p6_found", ["doc_id"]), ("p8_found", ["doc_id"])])
def test_found(spark, small, name, columns):
    df = queries.QUERIES[name](spark, small)
    assert df.columns == columns and df.count() > 0


def test_containers(spark, small):
    r = queries.p6_fill(spark, small).first()
    assert r["fullest"] <= 1024 and r["containers"] <= r["fewest_possible"] * 1.02 + 1
