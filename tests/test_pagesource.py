"""The registered source of stored pages gives the rows of the readers, in batch and as a stream."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quaylark.sources import pagesource, readers
from quaylark.streaming import ledger
from quaylark.tables import table

LD = '<script type="application/ld+json">{"@type":"JobPosting","title":"Job %s","baseSalary":{"currency":"EUR","value":5}}</script>'


@pytest.fixture(scope="module")
def pages(spark, sf_dir, tmp_path_factory):
    """Pages with postings and state in some of them, in files of many row groups."""
    pagesource.register(spark)
    i = F.col("page_id").cast("string")
    posting = F.when(F.col("page_id") % 3 == 0, F.replace(F.lit(LD), F.lit("%s"), i)).otherwise("")
    state = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<script>window.state = {\"id\": "), i, F.lit("}</script>"))).otherwise("")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("html", posting, state).alias("html"), F.lit("x").alias("link"))
    rows = rows.unionByName(spark.sql("SELECT -1L AS page_id, CAST(NULL AS string) AS html, 'x' AS link UNION ALL SELECT NULL, '', NULL"))
    path = str(tmp_path_factory.mktemp("pages") / "p")
    rows.repartition(3).write.option("parquet.block.size", 20_000).parquet(path)
    return spark.read.parquet(path), path


def want(pages, monitor):
    if monitor == "links":
        return pages.select("page_id", F.explode(readers.links(F.col("html"))).alias("link"))
    if monitor == "json_ld":
        return readers.json_ld_postings(pages, "page_id", "html")
    if monitor == "embedded_json":
        return readers.embedded_json(pages, "page_id", "html", "window.state =")
    return pages.select("page_id", "html")


def same(got, expected):
    assert got.columns == expected.columns
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert rows(got) == rows(expected) and expected.count() > 0


@pytest.mark.parametrize("monitor", sorted(pagesource.MONITORS))
@pytest.mark.parametrize("split", ["500", str(pagesource.SPLIT_BYTES)])
def test_batch(spark, pages, monitor, split):
    got = spark.read.format(pagesource.NAME).options(path=pages[1], monitor=monitor, split_bytes=split).load()
    if split == "500":
        assert got.rdd.getNumPartitions() > 3
    same(got, want(pages[0], monitor))


def test_stream_goes_on_behind_its_offset(spark, pages, tmp_path):
    rows, src, out, state = pages[0], str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "state")
    write = ledger.folder(src)

    def run():
        found = spark.readStream.format(pagesource.NAME).options(path=src, monitor="json_ld").load()
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    write(rows.where("page_id % 2 = 0"), 0)
    run()
    same(spark.read.parquet(out), want(rows.where("page_id % 2 = 0"), "json_ld"))
    write(rows.where("NOT page_id % 2 <=> 0"), 1)
    rows.write.parquet(str(tmp_path / "src" / "batch=2"))
    (tmp_path / "src" / "batch=2" / "_SUCCESS").rename(tmp_path / "held")  # a writer that is not done
    run()
    run()
    same(spark.read.parquet(out), want(rows, "json_ld"))


def test_no_files_and_unknown_monitors(spark, pages, tmp_path):
    read = spark.read.format(pagesource.NAME)
    assert read.options(path=str(tmp_path / "none"), monitor="pages").load().count() == 0
    with pytest.raises(PySparkException, match="monitor must be one of"):
        spark.read.format(pagesource.NAME).options(path=pages[1], monitor="other").load()
