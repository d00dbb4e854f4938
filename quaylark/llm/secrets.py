"""Secret scan over an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, named by the SHA-256 of its content. The ledger
holds one row for each blob and rule version that was scanned, with what was found.
A scan hashes all paths, keeps the pairs of blob and rule version that the ledger
lacks, scans one copy of each such blob, appends the findings to the ledger and joins
them back to all paths of the blob. A second scan of the same table scans nothing; a
new rule version scans all blobs for that rule set anew.

Places of matches come from ``split`` and ``regexp_extract_all``, which walk the same
matches from left to right: a match starts after the pieces and matches before it.

Edge cases: null and empty texts are the empty blob, without findings; rows without an
id are scanned like others; repeated rows share a blob; a blob that most rows share is one row in every aggregate, and its join
back to the paths can be split by Spark; columns besides id and text are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, fresh_path, stored

RULE_VERSION = "2026.1"

#: Kinds in order, with the pattern, the group whose length counts, and the least length.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Kinds that the ledger's rule set adds to the three above.
ADDED = (("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),)
SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"


def _matches(text: Column, place: int, rule: tuple[str, str, int, int]) -> Column:
    """Spans of one rule; texts without a match cost one test."""
    kind, pattern, group, least = rule
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.split(text, pattern, -1)
    sizes = F.transform(F.arrays_zip(pieces.alias("p"), whole.alias("m"), counted.alias("c")), lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m"), F.length(x["c"]).alias("c")))
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + F.coalesce(x["m"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["c"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def found_spans(text: Column) -> Column:
    """All spans of a text by start, then kind as listed."""
    each = [_matches(text, i, r) for i, r in enumerate((*RULES, *ADDED))]
    return F.array_sort(F.concat(*each))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


class BlobLedger:
    """Scanned pairs of blob and rule version at ``path``, a folder that all executors share.

    The folder need not exist yet, and outlasts the session: a ledger opened there later
    scans only what is new. Each scan is a batch folder of its own, ``batch=<number>-<id>``;
    a folder counts once its job has committed, so a scan that fails leaves nothing behind,
    and a blob that two sessions scan at one time counts once.
    """

    SCHEMA = f"blob string, rule_version string, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str | None = None, rule_version: str = RULE_VERSION):
        self.spark, self.rule_version = spark, rule_version
        self.path = path or fresh_path(spark, "blob-ledger")

    def _committed(self) -> list[str]:
        """Batch folders with the mark that Spark's writer leaves when its job is done."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/_SUCCESS"))
        return sorted(f.getPath().getParent().toString() for f in found or [])

    def rows(self) -> DataFrame:
        """A row for each scanned pair; a pair of two batches is two rows."""
        folders = self._committed()
        if not folders:
            return self.spark.range(0).select(F.lit("").alias("blob"), F.lit("").alias("rule_version"), F.array().cast(SPANS).alias("spans"))
        return self.spark.read.schema(self.SCHEMA).parquet(*folders)

    def scan(self, paths: DataFrame) -> int:
        """Scan the blobs of ``paths`` (path, blob, text) that the ledger lacks; returns how many.

        One text of each blob is scanned, whatever number of rows holds it: equal texts merge
        in each task before the shuffle. Once the ledger has rows, the unseen blobs are found
        on names alone, each with its least path, and only texts of those pairs are merged.
        """
        texts = paths
        if self._committed():
            known = self.rows().where(F.col("rule_version") == self.rule_version).select("blob")
            unseen = paths.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
            # null where no row of the blob has a path; dealt out by blob and path, so copies under many paths do not meet
            own, other = paths.alias("own"), unseen.alias("other")
            texts = own.join(other, (F.col("own.blob") == F.col("other.blob")) & F.col("own.path").eqNullSafe(F.col("other.path")), "left_semi")
        texts = texts.groupBy("blob").agg(F.first("text").alias("text"))
        found = texts.select("blob", F.lit(self.rule_version).alias("rule_version"), found_spans(F.col("text")).alias("spans"))
        batch = f"{self.path}/batch={len(self._committed()):06d}-{uuid.uuid4().hex}"
        found.write.parquet(batch)
        return self.spark.read.schema(self.SCHEMA).parquet(batch).count()

    def spans_by_blob(self, least: int = 0) -> DataFrame:
        """(blob, spans) of every scanned blob with ``least`` spans or more, a row each.

        Written to the shared folder: a join on it then has no aggregate beside it, so Spark
        can split a blob of many paths, or broadcast the table where its size allows.
        """
        own = self.rows().where((F.col("rule_version") == self.rule_version) & (F.size("spans") >= least))
        return stored(own.groupBy("blob").agg(F.max("spans").alias("spans")), "spans-by-blob")

    def findings(self, paths: DataFrame) -> DataFrame:
        """(path, blob, spans) of every path whose blob was scanned."""
        return paths.select("path", "blob").join(self.spans_by_blob(), "blob").select("path", "blob", "spans")


def blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, text): each row's text under the name of its content."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan(docs: DataFrame, ledger: BlobLedger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, spans) of every row of ``docs``."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    paths = blobs(docs, id_col, text_col)
    ledger.scan(paths)
    return ledger.findings(paths)


def _of_kind(place: int) -> Column:
    return F.filter("spans", lambda s: s["place"] == place)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of ``scan`` rows."""
    base = F.filter("spans", lambda s: s["place"] < len(RULES))
    count = [F.size(_of_kind(i)).cast("long").alias(f"n_{r[0]}") for i, r in enumerate(RULES)]
    return found.select(F.col("path").alias("doc_id"), *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; all rows and columns stay.

    Spans that overlap or touch are one stretch. The rows with findings are few, but
    their number is not bounded, so they are joined by blob like everything else.
    """
    ledger = BlobLedger(docs.sparkSession)
    ledger.scan(blobs(docs))
    blob, spans = free_name(docs, "_blob"), free_name(docs, "_spans")
    hits = ledger.spans_by_blob(least=1).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    text = F.col("text")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        span = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(span)))

    stretches = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), merge)
    cut = F.aggregate(
        stretches,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
    )
    named = docs.withColumn(blob, F.sha2(F.coalesce(text, F.lit("")), 256))
    both = named.join(hits, blob, "left")
    new = both.withColumn("text", F.when(F.col(spans).isNotNull(), cut).otherwise(text))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)
