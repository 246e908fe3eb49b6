import random
from datetime import datetime, timedelta

from conftest import rows
from tessera.operators.hotkeys import heavy_share, hot_keys, key_totals

SCHEMA = "dst string, type string, src string, ingested_at timestamp_ntz, k0 int, value string"


def brute(data, keys):
    out = {}
    for r in data:
        d = dict(zip(("dst", "type", "src", "at"), r[:4]))
        x = out.setdefault(tuple(d[k] for k in keys), [0, set(), []])
        x[0] += 1
        if d["src"] is not None:
            x[1].add(d["src"])
        if d["at"] is not None:
            x[2].append(d["at"])
    return sorted(((*k, n, len(s), min(t, default=None), max(t, default=None)) for k, (n, s, t) in out.items()), key=repr)


def made(n, seed=1):
    r, t0 = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for _ in range(n):
        dst = "hot" if r.random() < 0.35 else r.choice([None, *[f"d{i}" for i in range(60)]])
        src = r.choice([None, "same", *[f"s{i}" for i in range(300)]]) if r.random() < 0.8 else "same"
        out.append((dst, r.choice(["a", "a", "a", "b", None]), src, None if r.random() < 0.05 else t0 + timedelta(minutes=r.randrange(9999)), 1, "clash"))
    return out


def test_totals_equal_brute_force(spark):
    data = made(4000)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    for keys in (["dst"], ["type"], ["dst", "type"]):
        assert rows(key_totals(df, keys, "src", "ingested_at")) == brute(data, keys)


def test_chunks_of_any_size_agree(spark):
    data = made(900, 2)
    df = spark.createDataFrame(data, SCHEMA)
    for pieces in (1, 3, 50, 5000):
        assert rows(key_totals(df, ["dst"], "src", "ingested_at", pieces)) == brute(data, ["dst"])


def test_one_pair_holds_everything(spark):
    data = [("x", "t", "s", datetime(2024, 1, 1), 0, "")] * 500
    assert rows(key_totals(spark.createDataFrame(data, SCHEMA), ["dst"], "src", "ingested_at")) == brute(data, ["dst"])


def test_empty(spark):
    assert rows(key_totals(spark.createDataFrame([], SCHEMA), ["dst"], "src", "ingested_at")) == []


def test_hot_keys_are_bounded(spark):
    df = spark.createDataFrame(made(3000), SCHEMA)
    assert hot_keys(df, ["dst"], 10).count() <= 10


def test_share(spark):
    data = [("a", "t", "s", None, 0, "")] * 99 + [("b", "t", "s", None, 0, "")]
    df = spark.createDataFrame(data, SCHEMA)
    t = key_totals(df, ["dst"], "src", "ingested_at")
    assert rows(heavy_share(t, 1, df), "dst") == [("a",), ("b",)]
    assert rows(heavy_share(t, 2, df), "dst") == [("a",)]
