from __future__ import annotations

from datetime import datetime

import pytest

from attestry.operators import references
from tests.conftest import rows

D = lambda n: datetime(2025, 1, n)


def test_existence_over_time(spark):
    ev = spark.createDataFrame([("a", D(3), None), ("a", D(1), None), ("b", D(1), D(5)), ("b", None, D(9)), ("c", None, D(1)), (None, D(1), None)], "id string, born timestamp, gone timestamp")
    life = references.lifetimes(ev, ["id"], "born", "gone")
    refs = spark.createDataFrame([("a", D(1)), ("a", datetime(2024, 1, 1)), ("b", D(4)), ("b", D(5)), ("c", D(2)), ("x", D(2)), ("a", None), (None, D(1)), ("a", D(1))], "ref string, at timestamp")
    got = rows(references.orphans(refs, life, [("ref", "id")], "at"))
    assert got == sorted([("a", datetime(2024, 1, 1)), ("b", D(5)), ("c", D(2)), ("x", D(2)), ("a", None)], key=repr)
    none = references.lifetimes(ev.where("false"), ["id"], "born", "gone")
    assert references.orphans(refs, none, [("ref", "id")], "at").count() == 8
    assert references.orphans(refs.where("false"), life, [("ref", "id")], "at").count() == 0


@pytest.mark.parametrize("match,want", [("simple", ["bad"]), ("partial", ["bad", "half-bad"]), ("full", ["bad", "half", "half-bad"])])
def test_null_masks(spark, match, want):
    t = references.lifetimes(spark.createDataFrame([("c1", "r1", D(1), None)], "c string, r string, born timestamp, gone timestamp"), ["c", "r"], "born", "gone")
    refs = spark.createDataFrame([("ok", "c1", "r1"), ("bad", "c1", "r2"), ("half", "c1", None), ("half-bad", None, "r9"), ("none", None, None)], "n string, c string, r string").selectExpr("*", "timestamp'2025-02-01' as at", "1 as born", "'x' as gone")
    assert [r[0] for r in rows(references.orphans(refs, t, [("c", "c"), ("r", "r")], "at", match), "n")] == want
    with pytest.raises(ValueError):
        references.orphans(refs, t, [("c", "c")], "at", "loose")


def test_counts_per_month(spark):
    d = spark.createDataFrame([("f", "x", "h1", "r1", D(1)), ("f", "x", "h1", "r2", D(2)), ("f", "y", "h2", "r1", D(2))], "holder string, field string, holder_id string, ref_id string, at timestamp")
    assert rows(references.by_period(d, "holder", "field", "at")) == [("f", "x", "2025-01", 2, 1), ("f", "y", "2025-01", 1, 1)]
