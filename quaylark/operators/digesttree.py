"""Reconciliation of a stored mirror by a tree of digests.

A row lies in the leaf of its key: the first four hexadecimal digits of the key's SHA-256, so
there are 65,536 leaves, and 256 branches by the first two. A leaf's digest is the number of
its rows and two sums over their SHA-256 marks, a branch's the sum of its leaves, so order
does not count, repeated rows do, and digests add up without another pass over the rows.

Two sides compare 256 branches, then the leaves of those that differ, then the rows of leaves
that differ. Rows lie in a folder a branch, by leaf, so equal branches are never opened.

A side is written in generations: ``rows/at=G/branch=B``, ``leaves/at=G`` and, last of all,
``manifest/at=G``, which names the generation of each branch. A writer that is lost leaves the
manifest of before. One writer a side at a time.

Edge cases: rows without a key share the leaf of the empty string and are compared as one key;
of a key with several rows all are replaced when any differs; columns may have any names; an
empty side has no branches. Sides with other columns differ in every row.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..storage import stored

BRANCHES = [f"{i:02x}" for i in range(256)]
_SUMS = "n long, a decimal(38,0), b decimal(38,0)"


class Side(NamedTuple):
    """One stored side: where it lies, the column that names a row, and the columns of a row."""

    path: str
    key: str
    schema: StructType


class Unequal(RuntimeError):
    """A repaired branch still differs from its source."""


def leaf(key: str | Column) -> Column:
    """The leaf of a key; its first two digits are the branch."""
    named = F.col(key) if isinstance(key, str) else key
    return F.substring(F.sha2(F.coalesce(named.cast("string"), F.lit("")), 256), 1, 4)


def marked(rows: DataFrame, key: str) -> DataFrame:
    """(leaf, key, mark, row): the mark is the SHA-256 of all columns, by name."""
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    return rows.select(leaf(f"`{key}`").alias("leaf"), F.col(f"`{key}`").alias("key"), F.sha2(content, 256).alias("mark"), F.struct("*").alias("row"))


def _sums() -> list[Column]:
    part = lambda at: F.sum(F.conv(F.substring("mark", at, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return [F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b")]


def _unequal(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer join by ``on`` (null-safe) of (on, n, a, b) rows, as l and r, where the sums differ."""
    both = left.alias("l").join(right.alias("r"), F.col(f"l.{on}").eqNullSafe(F.col(f"r.{on}")), "full_outer")
    same = F.lit(True)
    for c in ("n", "a", "b"):
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return both.where(~same)


def _read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, side: Side) -> DataFrame:
    """(branch, made, n, a, b, at) of the newest generation: 256 rows at most."""
    marks = _read(spark, f"{side.path}/manifest", f"branch string, made long, {_SUMS}, at long")
    newest = marks.agg(F.max("at").alias("newest"))
    return marks.join(F.broadcast(newest), F.col("at") == F.col("newest"), "left_semi")  # one row


def _write(rows: DataFrame, side: Side, branches: Sequence[str]) -> None:
    """Replace the given branches by marked rows, as a new generation."""
    spark = rows.sparkSession
    before = [(r["branch"], r["made"], r["n"], r["a"], r["b"], r["at"]) for r in manifest(spark, side).collect()]  # 256 rows
    at = max([r[5] for r in before], default=-1) + 1
    placed = rows.withColumns({"branch": F.substring("leaf", 1, 2), "task": F.spark_partition_id()})
    placed = placed.repartitionByRange("leaf", "mark", "task").sortWithinPartitions("leaf").drop("task")  # equal rows of several tasks may part
    placed.write.mode("overwrite").partitionBy("branch").parquet(f"{side.path}/rows/at={at}")
    found = _read(spark, f"{side.path}/rows/at={at}", "leaf string, mark string").groupBy("leaf").agg(*_sums())
    found.select("leaf", "n", "a", "b").coalesce(1).write.mode("overwrite").parquet(f"{side.path}/leaves/at={at}")  # 65,536 rows at most
    leaves = spark.read.schema(f"leaf string, {_SUMS}").parquet(f"{side.path}/leaves/at={at}")
    total = lambda c: F.sum(c).cast("decimal(38,0)").alias(c)
    new = leaves.groupBy(F.substring("leaf", 1, 2).alias("branch")).agg(F.lit(at).cast("long").alias("made"), F.sum("n").alias("n"), total("a"), total("b"))
    kept = spark.createDataFrame([r[:5] for r in before if r[0] not in set(branches)], f"branch string, made long, {_SUMS}")
    ended = kept.unionByName(new)
    if at and ended.isEmpty():  # all rows went: a manifest needs a row to show
        ended = spark.createDataFrame([("", at, 0, None, None)], f"branch string, made long, {_SUMS}")
    ended.coalesce(1).write.mode("overwrite").parquet(f"{side.path}/manifest/at={at}")


def build(rows: DataFrame, key: str, path: str) -> Side:
    """Store ``rows`` under ``path`` as one side; a side that is there is replaced by a new generation."""
    side = Side(path, key, rows.schema)
    _write(marked(rows, key), side, [*BRANCHES, ""])
    return side


def marked_rows(spark: SparkSession, side: Side, branches: Sequence[str] | None = None) -> DataFrame:
    """(leaf, key, mark, row) of some branches; the folders of others are not opened."""
    wanted = manifest(spark, side).where("n > 0") if branches is None else manifest(spark, side).where(F.col("n") > 0).where(F.col("branch").isin(list(branches)))
    paths = [f"{side.path}/rows/at={r['made']}/branch={r['branch']}" for r in wanted.select("made", "branch").collect()]  # 256 at most
    schema = StructType([StructField("leaf", StringType()), StructField("key", side.schema[side.key].dataType), StructField("mark", StringType()), StructField("row", side.schema)])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def rows_of(spark: SparkSession, side: Side, branches: Sequence[str] | None = None) -> DataFrame:
    """The rows of a side, or of some of its branches."""
    return marked_rows(spark, side, branches).select("row.*")


def leaves_of(spark: SparkSession, side: Side, branches: Sequence[str]) -> DataFrame:
    """(leaf, n, a, b) of some branches."""
    now = manifest(spark, side).where(F.col("branch").isin(list(branches))).select("branch", F.col("made").alias("at"))
    leaves = _read(spark, f"{side.path}/leaves", f"leaf string, {_SUMS}, at long").withColumn("branch", F.substring("leaf", 1, 2))
    return leaves.join(F.broadcast(now), ["branch", "at"], "left_semi").select("leaf", "n", "a", "b")  # 256 rows


def unequal_branches(spark: SparkSession, source: Side, target: Side) -> list[str]:
    """Branches whose digests differ, in order."""
    sums = lambda side: manifest(spark, side).where("n > 0").select("branch", "n", "a", "b")
    return sorted(r["branch"] for r in _unequal(sums(source), sums(target), "branch").select(F.coalesce("l.branch", "r.branch").alias("branch")).collect())  # 256 at most


def differences(spark: SparkSession, source: Side, target: Side, branches: Sequence[str] | None = None) -> DataFrame:
    """(key, leaf, action) that make the target equal, upsert or delete: in all branches that differ, or in those given."""
    apart = unequal_branches(spark, source, target) if branches is None else list(branches)
    leaves = _unequal(leaves_of(spark, source, apart), leaves_of(spark, target, apart), "leaf").select(F.coalesce("l.leaf", "r.leaf").alias("leaf"))

    def keys(side: Side) -> DataFrame:
        rows = marked_rows(spark, side, apart).select("leaf", "key", "mark")
        return rows.join(F.broadcast(leaves), "leaf", "left_semi").groupBy("leaf", "key").agg(*_sums())  # 65,536 rows at most

    action = F.when(F.col("l.n").isNull(), "delete").otherwise("upsert")
    key, place = F.when(F.col("l.n").isNull(), F.col("r.key")).otherwise(F.col("l.key")), F.coalesce("l.leaf", "r.leaf")
    return _unequal(keys(source), keys(target), "key").select(key.alias("key"), place.alias("leaf"), action.alias("action"))


def mend(spark: SparkSession, source: Side, target: Side, branches: Sequence[str]) -> DataFrame:
    """Make some branches of the target equal to the source; returns what was done, as ``differences``.

    Raises ``Unequal`` if they still differ afterwards.
    """
    apart = sorted(set(unequal_branches(spark, source, target)) & set(branches))
    if not apart:
        return spark.createDataFrame([], StructType([StructField("key", source.schema[source.key].dataType), StructField("leaf", StringType()), StructField("action", StringType())]))
    done = stored(differences(spark, source, target, apart), "repairs")
    touched = sorted(r["branch"] for r in done.select(F.substring("leaf", 1, 2).alias("branch")).distinct().collect())  # 256 at most
    if touched:
        same = F.col("m.key").eqNullSafe(F.col("d.key"))
        kept = marked_rows(spark, target, touched).alias("m").join(done.alias("d"), same, "left_anti")
        new = marked_rows(spark, source, touched).alias("m").join(done.where("action = 'upsert'").alias("d"), same, "left_semi")
        _write(kept.unionByName(new), target, touched)
        still = set(unequal_branches(spark, source, target)) & set(touched)
        if still:
            raise Unequal(f"branches {sorted(still)} differ after their repair")
    return done


def history(spark: SparkSession, book: str) -> DataFrame:
    """(cycle, upto, upserts, deletes): a row for each stretch of branches that was repaired."""
    return _read(spark, f"{book}/done", "upserts long, deletes long, cycle long, upto long").select("cycle", "upto", "upserts", "deletes")


def run(spark: SparkSession, source: Side, target: Side, book: str, most: int = 16, full: bool = False, fresh: bool = False) -> tuple[int, int]:
    """Repair the next ``most`` branches, or with ``full`` all that the cycle has left; returns (cycle, next branch).

    ``book`` keeps a row for each stretch once it is repaired and found equal, so a run that
    stops goes on behind the last such stretch, in any session. After branch 255 a new cycle
    begins; ``fresh`` begins one at once.
    """
    if not 1 <= most <= len(BRANCHES):
        raise ValueError(f"most must be 1 to {len(BRANCHES)}")
    last = history(spark, book).orderBy(F.desc("cycle"), F.desc("upto")).first()
    cycle, at = (last["cycle"], last["upto"]) if last else (0, 0)
    if fresh and last or at == len(BRANCHES):
        cycle, at = cycle + 1, 0
    while True:
        end = min(at + most, len(BRANCHES))
        done = mend(spark, source, target, BRANCHES[at:end])
        count = lambda action: F.count_if(F.col("action") == action)
        done.agg(count("upsert").alias("upserts"), count("delete").alias("deletes")).write.mode("overwrite").parquet(f"{book}/done/cycle={cycle}/upto={end}")
        at = end
        if not full or at == len(BRANCHES):
            return cycle, at
