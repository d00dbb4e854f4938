"""Stored tables, and their removal."""

import os

from quaylark import storage


def test_release_removes_what_was_stored_and_nothing_else(spark, monkeypatch):
    monkeypatch.setattr(storage, "_WRITTEN", {})  # other tests' frames keep their tables
    rows = storage.stored(spark.range(5), "five")
    named = storage.fresh_path(spark, "named")
    rows.write.parquet(named)
    files = rows.inputFiles()
    assert rows.count() == 5 and storage.release(spark) == 1
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert spark.read.parquet(named).count() == 5
    assert storage.release(spark) == 0
