"""Tables that operators store on the way, and which of them stay."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import neardup, store, substring_dedup
from quarrystone.llm.store import scratch, stored


@pytest.fixture
def folders(monkeypatch, tmp_path):
    """The tables now in a shared folder of this test's own."""
    monkeypatch.setattr(store, "shared_dir", lambda spark: str(tmp_path))
    return lambda: sorted(f.rsplit("-", 1)[0] for f in os.listdir(tmp_path))


def test_of_a_block_only_what_its_result_reads_stays(spark, folders):
    outer = stored(spark.range(5), "outside")
    with scratch(spark) as keep:
        a = stored(spark.range(10), "a")
        with scratch(spark) as keep_too:
            b, c = stored(a.where("id > 3"), "b"), stored(a.where("id > 4"), "c")
            both = keep_too(b.join(a, "id"))
        assert folders() == ["a", "b", "outside"] and c.columns == ["id"]
        last = keep(stored(both.groupBy().agg(F.count("*").alias("n")), "last"))
    assert folders() == ["last", "outside"] and last.first()["n"] == 6 and outer.count() == 5
    with pytest.raises(ValueError, match="on the way"), scratch(spark) as keep:
        keep(stored(spark.range(5), "lost"))
        raise ValueError("on the way")
    assert folders() == ["last", "outside"]
    assert keep(stored(spark.range(3), "later")).count() == 3 and folders() == ["last", "later", "outside"]


def test_near_duplicates_leave_little_on_disk(spark, sf, folders):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = neardup.kept_documents(docs)
    assert folders() == ["neardup-first", "neardup-gone"]
    want = {r.doc_id for r in neardup.near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < docs.count()


def test_substrings_leave_little_on_disk(spark, sf, folders):
    """Neither the pieces nor the tables made from them stay."""
    _, whole, gone = substring_dedup.repeated(spark.read.parquet(f"{sf}/documents.parquet"))
    assert folders() == ["substring-gone", "substring-whole"]
    assert whole.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and gone.count() > 0
