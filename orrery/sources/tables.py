"""Table sets in and out: one error for all that is missing, exports of spreadsheets, arrays, and lineage manifests."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder in any file system; names all that are missing in one error."""
    paths = {n: f"{folder}/{n}.parquet" for n in names}
    missing = [p for p in paths.values() if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing tables: " + ", ".join(missing))
    return {n: spark.read.parquet(p) for n, p in paths.items()}


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """One required table: Parquet, CSV with a header, or the first sheet of a workbook (read on the driver, which needs
    openpyxl)."""
    if not exists(spark, path):
        raise FileNotFoundError(f"missing source: {path}")
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".csv", ".tsv")):
        return spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",", multiLine=True, escape='"')
    if path.endswith(".xlsx"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, dtype=object).astype("string").replace({pd.NA: None}))
    raise ValueError(f"unknown kind of source: {path}")


def inspect(frame: DataFrame, width: int = 100) -> dict[str, str | None]:
    """Column names with the first row's values, shortened."""
    row = frame.select(*(F.substring(F.col(f"`{c}`").cast("string"), 1, width).alias(c) for c in frame.columns)).first()
    return dict.fromkeys(frame.columns) if row is None else row.asDict()


def read_matrix(spark: SparkSession, path: str, index: DataFrame, row: str = "embedding_row") -> DataFrame:
    """A .npy matrix joined to the table of its rows as an array column; rows must match one to one."""
    matrix = np.load(path, mmap_mode="r", allow_pickle=False)
    rows = index.agg(F.count(F.lit(1)), F.countDistinct(row), F.min(row), F.max(row)).first()
    if tuple(rows) != (len(matrix), len(matrix), 0, len(matrix) - 1):
        raise ValueError(f"{row} must number the {len(matrix)} rows of {path} once each, from 0")
    flat = np.ascontiguousarray(matrix, np.float32).reshape(-1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(flat))
    frame = spark.createDataFrame(pa.table({row: pa.array(np.arange(len(matrix), dtype=np.int32)), "embedding": lists}))
    return index.join(frame, row)


def numbered(frame: DataFrame, key: str, row: str = "embedding_row") -> DataFrame:
    """Rows numbered from 0 in the order of the key. Range partitions are counted first, so no task sees all rows."""
    parts = frame.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    first = parts.groupBy("_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window as W

    base = first.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(base), "_p").withColumn(row, (F.col("_base") + F.col("_i") - F.col("_first")).cast("int")).drop("_p", "_i", "_first", "_n", "_base")


def write_table(frame: DataFrame, path: str) -> dict:
    """Writes Parquet and returns the entry for a manifest."""
    frame.write.mode("overwrite").parquet(path)
    return fingerprint(frame.sparkSession.read.parquet(path)) | {"path": path}


def fingerprint(frame: DataFrame) -> dict:
    """Rows and a hash of the content that doesn't depend on the order of rows or files."""
    h = F.xxhash64(*frame.columns) if frame.columns else F.lit(0)
    r = frame.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return {"rows": r["n"], "columns": frame.columns, "content": hashlib.sha256(f"{r['n']}|{r['s']}|{r['x']}".encode()).hexdigest()}


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


def write_manifest(path: str | Path, version: str, config, inputs: dict[str, dict], outputs: dict[str, dict], measured: dict | None = None) -> dict:
    """version, settings, and the fingerprints of what went in and came out, as JSON on the driver. Flags such as the number
    of sealed rows used are passed in as they were measured."""
    body = {"version": version, "config": dataclasses.asdict(config) if dataclasses.is_dataclass(config) else dict(config), "inputs": inputs, "outputs": outputs, "measured": measured or {}}
    Path(path).write_text(json.dumps(body, indent=2, sort_keys=True, default=str) + "\n")
    return body


def save_parameters(spark: SparkSession, parameters: dict[str, np.ndarray], path: str) -> None:
    """A model as a table (name, shape, values)."""
    rows = [(k, list(map(int, v.shape)), v.astype(float).ravel().tolist()) for k, v in parameters.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
