"""Score intervals against published values, the gate's edges, and numbering against a plain sort."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import study


def test_tango_values(spark):
    rows = spark.createDataFrame([(40, 20, 160), (0, 0, 100), (1, 7, 50), (5, 0, 5), (0, 5, 5), (3, 3, 5), (0, 0, 0)], "b long, c long, n long")
    lower, upper = study.tango(F.col("b"), F.col("c"), F.col("n"))
    got = [(r.lo, r.hi) for r in rows.select(lower.alias("lo"), upper.alias("hi")).collect()]
    for have, want in zip(got[:3], [(-0.218064, -0.030865), (-0.036994, 0.036993), (0.011620, 0.246581)], strict=True):
        assert have == pytest.approx(want, abs=2e-6)
    assert got[3][0] == -1.0 and got[4][1] == 1.0 and got[3][1] == pytest.approx(-got[4][0])
    assert got[5] == got[6] == (None, None)


@pytest.mark.parametrize(("num", "den", "want"), [(1000, 1, "3A"), (9996, 10, "cautious"), (300, 1, "cautious"), (29999, 100, "3B"), (None, 1, "undecidable"), (1, 0, "undecidable")])
def test_gate(spark, num, den, want):
    row = spark.createDataFrame([(num, den)], "num long, den long")
    assert row.select(study.gate(F.col("num"), F.col("den")).alias("g")).first().g == want


def test_numbered_is_the_sorted_order(spark):
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(5000)]
    rows = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: (r.pos, r.total) for r in study.numbered(rows, "key").collect()}
    assert got == {k: (i, 5000) for i, k in enumerate(sorted(keys))}
    assert study.numbered(rows.limit(0), "key").count() == 0
