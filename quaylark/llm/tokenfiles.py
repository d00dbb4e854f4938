"""Token files: flat unsigned integers with 64-bit document offsets, memory-mapped.

Layout of one set in the shared folder, a group of files for each range of doc_id:

    part-00007-<attempt>.tokens    ids as little-endian unsigned integers (16 bits where the vocabulary allows, else 32)
    part-00007-<attempt>.offsets   n + 1 little-endian unsigned 64-bit integers: where each document starts in this part
    part-00007-<attempt>.docs      n little-endian signed 64-bit doc_ids (those of rows without one are 0; they come first)
    manifest                       Parquet, a row a part: name, documents, ids, width, ids before it, number, documents without doc_id

Documents lie in ascending doc_id order, ranges of doc_id in ascending part order.
A part knows its own offsets only; the place of its first id in the whole set is
the prefix sum of the sizes of the parts before it (one number a part, summed on
the driver). Each attempt of a task writes files of its own, and only those that the
manifest names belong to the set, so a task that runs again neither meets nor
replaces files, on any store.

Ids are those of the tokenizers library, from the codec in ``bpe`` (tests compare both):
the library itself takes 1.4 times as long on each distinct piece of a text, and 2.4 times
on whole texts.

Edge cases: a null or empty text is the end id alone; rows without doc_id stand
before all others; repeated doc_ids stand side by side, ordered by a hash of their
text, and may lie in several parts, as may rows alike in doc_id and text that different
tasks read; an empty table gives no parts.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import task_codec
from .common import by_size, fresh_path, in_batches, text_hash, texts_of

MANIFEST = "part string, n_docs long, n_ids long, wide boolean, before long, number int, n_null long"


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int, parts: int) -> list[tuple[str, int, int, bool, int, int, int]]:
    """Write the set to ``folder``; returns the rows of its manifest in order."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(folder)
        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{uuid.uuid4().hex}"
        n_docs, n_null, at = 0, 0, 0
        out = {}
        with task_codec(path, times=2) as own:
            wide = len(own.token_bytes) > 1 << 16
            for b in by_size(batches, most=4_000_000):
                if not out:
                    out = {k: fs.open_output_stream(posixpath.join(top, f"{name}.{k}")) for k in ("tokens", "offsets", "docs")}
                    out["offsets"].write(np.zeros(1, "<u8").tobytes())
                ids, counts = own.encode(texts_of(b))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                out["tokens"].write(ids.astype("<u4" if wide else "<u2").tobytes())
                out["offsets"].write((at + ends + np.arange(1, len(ends) + 1)).astype("<u8").tobytes())
                out["docs"].write(b.column("doc_id").fill_null(0).to_numpy().astype("<i8").tobytes())
                n_docs, n_null, at = n_docs + b.num_rows, n_null + b.column("doc_id").null_count, at + len(ids)
        if out:
            for stream in out.values():
                stream.close()
            yield pa.RecordBatch.from_pydict({"part": [name], "n_docs": [n_docs], "n_ids": [at], "wide": [wide], "before": [0], "number": pa.array([number], pa.int32()), "n_null": [n_null]})

    # rows alike in doc_id and text may change places, so those of different tasks are told apart: a hot one is dealt to several parts
    rows = rows.withColumn("task", F.spark_partition_id())
    keys = ["doc_id", text_hash(), "task"]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("task")
    done = sorted(in_batches(placed, run, MANIFEST).collect(), key=lambda r: r["number"])  # one row a part
    before = accumulate((r["n_ids"] for r in done), initial=0)
    manifest = [tuple((r.asDict() | {"before": base}).values()) for r, base in zip(done, before)]
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")
    return manifest


def _mapped(fs: pyarrow.fs.FileSystem, name: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where it lies in a local folder, else read by the file system."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(name, kind, "r") if fs.get_file_info(name).size else np.zeros(0, kind)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(folder)
        for b in batches:
            for r in b.to_pylist():
                name = posixpath.join(top, r["part"])
                ids = _mapped(fs, f"{name}.tokens", "<u4" if r["wide"] else "<u2")
                offsets = _mapped(fs, f"{name}.offsets", "<u8").astype(np.int64)
                docs = _mapped(fs, f"{name}.docs", "<i8")
                for at in range(0, len(docs), 4096):
                    edge = offsets[at : at + 4097]
                    sums = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(edge.tolist(), edge[1:].tolist())]
                    own = pa.array(docs[at : at + 4096], pa.int64(), mask=np.arange(at, at + len(edge) - 1) < r["n_null"])
                    yield pa.RecordBatch.from_arrays([own, pa.array(edge[:-1] + r["before"]), pa.array(np.diff(edge)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return in_batches(rows.repartition(max(1, rows.count())), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Write a set of token files for ``docs`` in the shared folder and read it back."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-files")
    write_tokens(docs, path, folder, end_id, parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    return read_tokens(spark, folder)
