"""Documents in parts of bounded size, and packed arrays that travel between parts and key buckets.

A part is the group of documents with the same hash of their id, about ``PART_BYTES`` of text. Operators that must know
whether something occurs elsewhere send each part's distinct keys to buckets, packed into one binary value a bucket, and
get back what they need. So one row moves for a part and bucket, not one for a word, and a key that a third of all
documents hold counts once a part.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).min


def spread(frame: DataFrame) -> DataFrame:
    """The rows as they are read, or, where fewer tasks than there are cores would have any (small tables, files of one row
    group), dealt evenly to all cores. Only for tables of few tasks is that looked up, from their footers."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame._jdf.queryExecution().toRdd().getNumPartitions() >= 4 * cores:
        return frame
    busy = frame.select(F.spark_partition_id().alias("p")).distinct().count()
    return frame.repartition(cores) if 0 < busy < cores else frame


def in_parts(documents: DataFrame, key: str, text: str, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """The documents with ``_part`` int, and the number of parts; that needs one pass for the size of the texts. Rows of one
    id share a part; those without an id are dealt by their text."""
    size = documents.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    n = max(1, math.ceil((size[0] or 0) / part_bytes), math.ceil(size[1] / 200_000))
    return documents.withColumn("_part", F.pmod(F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(n)).cast("int")), n


def packed(documents: DataFrame) -> DataFrame:
    """_part and ``rows`` binary: the rows that a batch has for one part as one compressed Arrow stream, which is what is
    shuffled in place of single rows."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            part, out = batch["_part"].to_numpy(), []
            for p, places in by_bucket(part):
                sink = pa.BufferOutputStream()
                some = batch.drop_columns(["_part"]).take(pa.array(places))
                with pa.ipc.new_stream(sink, some.schema, options=how) as stream:
                    stream.write_batch(some)
                out.append((p, sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1].to_pybytes() for x in out], pa.binary())], names=["_part", "rows"])

    return documents.mapInArrow(streams, "_part int, rows binary")


def unpacked(table: pa.Table) -> pa.Table:
    """The rows of a part."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["rows"]])


def ordered(table: pa.Table, key: str, text: str) -> pa.Table:
    """Rows by id (null first), then text."""
    return table.take(pc.sort_indices(table, [(key, "ascending"), (text, "ascending")], null_placement="at_start")).combine_chunks()


def ids_of(table: pa.Table, key: str) -> np.ndarray:
    return np.asarray(table[key].cast(pa.int64()).fill_null(NO_ID).to_numpy(), np.int64)


def freed(group: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The function of one group of rows or two; after it the worker, which lives on, returns its free memory."""

    def give_back(out: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)
        return out

    # Spark looks at the number of arguments
    if group.__code__.co_argcount == 1:
        return lambda rows: give_back(group(rows))
    return lambda left, right: give_back(group(left, right))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n = len(kinds)
    sizes, at, out = np.frombuffer(blob, np.int64, n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(blob, kind, int(size), at))
        at += int(size) * np.dtype(kind).itemsize
    return out


def gather(blobs: Iterable[bytes], *kinds: type) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of all values, one after the other, and the number of the value that each first element came from."""
    parts = [unpack(b, *kinds) for b in blobs]
    if not parts:
        return [np.empty(0, k) for k in kinds], np.empty(0, np.int64)
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))], np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the places of its elements, in their order."""
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        for places in np.split(order, cut):
            yield int(bucket[places[0]]), places


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Only where none is set, as in tests on one
    machine, one of this process is used."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Computes the frame once, into the shared folder, so later reads survive lost executors."""
    folder, context = shared_folder(frame.sparkSession), frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return frame.checkpoint()


def row_name(*columns: str) -> list[Column]:
    """Two hashes, _a and _b, that name a row by what it holds in these columns; only equal rows share them."""
    each = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(n), *each).alias(name) for n, name in ((1, "_a"), (2, "_b"))]
