"""The bootstrap draws in tasks what a row for each slot would give."""

import hashlib

import numpy as np
import pytest

from conftest import rows
from tessera.operators import evaluation as ev


@pytest.mark.parametrize("n", [1, 10, 11, 1234])
@pytest.mark.parametrize("prefix", ["0:graph:3:", "0:é" + "x" * 48 + ":1999:", "0:" + "y" * 45 + ":7:"])
def test_draws_are_those_of_md5(n, prefix):
    heads = [prefix.encode(), prefix.replace(":", ";").encode()]
    want = [[int(hashlib.md5(h + str(j).encode()).hexdigest()[:8], 16) % n for j in range(n)] for h in heads]
    assert ev._drawn(heads, ev._digits(n), n).tolist() == want


def test_no_row_for_a_slot(spark, monkeypatch):
    r = np.random.default_rng(3)
    data = [(("a", "b", None, "one")[min(i % 4, 2) if i else 3], i, None if i % 11 == 0 and i else float(r.exponential(50))) for i in range(400)]
    values = spark.createDataFrame(data, "arm string, id int, x double")
    whole = ev.bootstrap
    monkeypatch.setattr(ev, "IN_TASK", 0)
    want = rows(whole(values, "arm", "x", resamples=50))
    monkeypatch.setattr(ev, "IN_TASK", 10**6)
    monkeypatch.setattr(ev, "PACKED", 7)
    monkeypatch.setattr(ev, "_drawn_by_join", lambda *_: pytest.fail("a row for each slot was made"))
    assert rows(whole(values, "arm", "x", resamples=50)) == want and [x[0] for x in want] == ["a", "b"]
