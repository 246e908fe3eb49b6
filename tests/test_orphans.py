from datetime import datetime

import pytest

from conftest import rows
from tessera.operators.orphans import dated_orphans, orphans

REFS = "n int, a string, b string, found string"


def refs(spark):
    data = [(1, "x", "y", ""), (2, "x", "no", ""), (3, None, "y", ""), (4, "no", None, ""), (5, None, None, ""), (6, "x", "no", "")]
    return spark.createDataFrame(data, REFS)


def test_match_semantics(spark):
    t = spark.createDataFrame([("x", "y"), ("x", "y"), ("z", None)], "a string, b string")
    keys = ["a", "b"]
    r = refs(spark)
    assert rows(orphans(r, keys, t, "simple"), "n") == [(2,), (6,)]
    assert rows(orphans(r, keys, t, "partial"), "n") == [(2,), (4,), (6,)]
    assert rows(orphans(r, keys, t, "full"), "n") == [(2,), (3,), (4,), (6,)]
    with pytest.raises(ValueError):
        orphans(r, keys, t, "other")


def test_empty_sides(spark):
    t = spark.createDataFrame([], "a string, b string")
    r = refs(spark).drop("found")
    assert rows(orphans(r, ["a", "b"], t, "partial"), "n") == [(1,), (2,), (3,), (4,), (6,)]
    assert orphans(r.limit(0), ["a", "b"], t).count() == 0


def day(n):
    return datetime(2024, 1, n)


def test_reasons(spark):
    nodes = spark.createDataFrame(
        [("back", 1, day(1), day(2)), ("back", 2, day(3), None), ("gone", 3, day(1), None), ("gone", 4, day(5), day(5)), ("late", 5, day(9), None), ("odd", 6, day(1), day(20)), (None, 7, day(1), None)],
        "id string, ord bigint, ingested_at timestamp_ntz, deleted_at timestamp_ntz",
    )
    data = [(i, k, t) for i, (k, t) in enumerate([("back", day(4)), ("gone", day(5)), ("gone", day(4)), ("late", day(8)), ("late", day(9)), ("nil", day(1)), (None, day(1)), ("nil", None), ("late", None), ("odd", day(4))])]
    r = spark.createDataFrame(data, "n int, id string, at timestamp_ntz")
    got = rows(dated_orphans(r, "id", "at", nodes), "n", "reason")
    assert got == [(1, "deleted"), (3, "late"), (5, "missing"), (7, "missing")]


def test_hot_reference(spark):
    nodes = spark.createDataFrame([("hub", 1, day(9), None)], "id string, ord bigint, ingested_at timestamp_ntz, deleted_at timestamp_ntz")
    r = spark.createDataFrame([(i, "hub" if i % 2 else f"m{i}", day(1)) for i in range(400)], "n int, id string, at timestamp_ntz")
    got = dated_orphans(r, "id", "at", nodes).groupBy("reason").count()
    assert rows(got) == [("late", 200), ("missing", 200)]


def test_dated_references_of_two_columns(spark):
    targets = spark.createDataFrame([("x", "y", day(1), day(3)), ("x", "z", day(5), None), ("w", "y", day(9), None)], "a string, b string, first_at timestamp_ntz, gone_at timestamp_ntz")
    data = [(1, "x", "y", day(2)), (2, "x", "y", day(4)), (3, "x", None, day(4)), (4, None, "y", day(1)), (5, "w", None, day(1)), (6, "no", None, day(1)), (7, None, None, day(1))]
    r = spark.createDataFrame(data, "n int, a string, b string, first_at timestamp_ntz")
    assert rows(orphans(r, ["a", "b"], targets, "partial", at="first_at"), "n", "reason") == [(2, "deleted"), (5, "late"), (6, "missing")]
