"""What the training-data operators share: reading, spreading, Arrow maps, samples."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one table; the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Repartitions a scan that has fewer partitions than the cluster has cores.

    A small file in one row group would otherwise keep one core busy. Large inputs have more
    splits than cores and pass unchanged, so nothing is shuffled at scale.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def slices(batch: pa.RecordBatch, budget: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the strings of each part have at most about ``budget`` bytes."""
    size = np.zeros(batch.num_rows, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            size += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // budget
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` over parts of bounded size; ``rows`` may return None for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in slices(batch):
                    if (out := rows(part)) is not None:
                        yield out

    return df.mapInArrow(run, schema)


#: Files that a sample is taken from at most, evenly spaced, so that a fit never scans a large table.
SAMPLE_FILES = 32


def sample(df: DataFrame, key: str, column: str, rows: int) -> list[str]:
    """About ``rows`` values of a column, at most twice as many, of the rows whose key hashes to one residue.

    Every task sends its few rows only; a top-n of the whole table would send n rows of every task to the driver.
    """
    files = sorted(df.inputFiles())
    if len(files) > SAMPLE_FILES:
        df = df.sparkSession.read.parquet(*(files[k * len(files) // SAMPLE_FILES] for k in range(SAMPLE_FILES)))
    have = df.where(F.col(column).isNotNull()).select(key, column)
    step = max(1, df.count() // rows)
    picked = have.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).limit(2 * rows).collect()
    return [r[column] for r in sorted(picked, key=lambda r: (str(r[key]), r[column]))]


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` computed once and written to the cluster's checkpoint folder, which ends their lineage.

    The folder is the one of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint()
