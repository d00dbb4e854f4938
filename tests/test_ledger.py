"""Targets of a change stream: every batch once, a failed target apart."""

import os

import pytest
from pyspark.sql import functions as F

from quaylark.streaming import cycles, ledger
from quaylark.tables import table

SCHEMA = "url string, page_id long"


@pytest.fixture()
def stream(spark, sf_dir, tmp_path):
    pages = table(spark, sf_dir, "pages").select("url", "page_id")
    for i in range(3):
        pages.where(F.col("page_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return cycles.read_events(spark, str(tmp_path / "in"), SCHEMA), sorted(map(tuple, pages.collect()))


def run(writer):
    q = writer.trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert q.exception() is None


def rows(spark, book, name, path):
    return sorted((r["url"], r["page_id"]) for r in ledger.published(spark, book, name, path, SCHEMA).collect())


def test_a_failed_target_is_pinned_and_catches_up(spark, stream, tmp_path):
    changes, want = stream
    book, good, bad = (str(tmp_path / n) for n in ("book", "good", "bad"))
    down = [True]

    def shaky(batch, number):
        if number == 1 and down[0]:
            ledger.folder(bad)(batch.limit(1), number)  # half a batch, then it fails
            raise OSError("target is down")
        ledger.folder(bad)(batch, number)

    targets = {"good": ledger.folder(good), "bad": shaky}
    run(ledger.publish_to(changes, targets, book, str(tmp_path / "c")))
    assert rows(spark, book, "good", good) == want
    first = rows(spark, book, "bad", bad)
    assert 0 < len(first) < len(want)  # the half batch does not show
    assert [(r["target"], r["batch"], r["reason"]) for r in ledger.pinned(spark, book).collect()] == [("bad", 1, "OSError: target is down")]
    ledger.resume(spark, targets, book, SCHEMA)  # still down
    assert rows(spark, book, "bad", bad) == first
    down[0] = False
    ledger.resume(spark, targets, book, SCHEMA)
    assert rows(spark, book, "bad", bad) == want
    assert ledger.pinned(spark, book).count() == 0
    assert ledger.committed(spark, book).groupBy("target").count().where("count = 3").count() == 2


def test_a_replayed_batch_counts_once(spark, stream, tmp_path):
    changes, want = stream
    book, good = str(tmp_path / "book"), str(tmp_path / "good")
    calls = []

    def target(batch, number):
        calls.append(number)
        ledger.folder(good)(batch, number)

    run(ledger.publish_to(changes, {"good": target}, book, str(tmp_path / "c")))
    os.rename(tmp_path / "c" / "commits" / "2", tmp_path / "gone")  # the driver was lost before Spark noted the last batch
    for extra in ("good", "book/changes"):
        assert os.path.isdir(tmp_path / extra / "batch=2")
    crc = tmp_path / "c" / "commits" / ".2.crc"
    if crc.exists():
        os.rename(crc, tmp_path / "gone.crc")
    run(ledger.publish_to(changes, {"good": target}, book, str(tmp_path / "c")))
    assert rows(spark, book, "good", good) == want
    assert calls == [0, 1, 2]  # the ledger knew that the target had it


def test_replayed_actions_overwrite_their_folder(spark, sf_dir, tmp_path):
    pages = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 3).alias("board_id"))
    pages.write.parquet(str(tmp_path / "found"))
    pages.limit(10).withColumn("is_active", F.lit(True)).write.parquet(str(tmp_path / "stored"))
    for checkpoint in ("c1", "c2"):  # a new checkpoint gives the same batches again
        found = cycles.read_events(spark, str(tmp_path / "found"), "url string, board_id long", files_per_batch=100)
        run(cycles.diff_batches(found, lambda s: s.read.parquet(str(tmp_path / "stored")), str(tmp_path / "actions"), str(tmp_path / checkpoint)))
    actions = spark.read.parquet(str(tmp_path / "actions"))
    assert actions.count() == pages.select("url").distinct().count() and "batch" in actions.columns


def test_an_empty_ledger(spark, tmp_path):
    book = str(tmp_path / "none")
    assert ledger.committed(spark, book).count() == 0 and ledger.pinned(spark, book).count() == 0
    assert ledger.published(spark, book, "t", str(tmp_path / "t"), SCHEMA).count() == 0
    ledger.resume(spark, {"t": ledger.folder(str(tmp_path / "t"))}, book, SCHEMA)
