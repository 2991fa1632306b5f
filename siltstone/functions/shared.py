"""Tables in the folder that driver and executors share: cutting lineage. Slices of Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; where the setting is missing, a temporary one of a local session, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints_"))
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: lost executors cost no recomputation.

    The tables lie in a folder of this application's own, which is removed when the driver ends.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, under this application's own folder, which is removed when the driver ends."""
    top = f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}"
    if top not in _made:
        _made.add(top)
        atexit.register(remove, spark, top)
    return f"{top}/{uuid.uuid4().hex}"


def drop(df: DataFrame) -> None:
    """Removes the table behind a result of cut() that no plan reads any more."""
    if (held := _paths.pop(id(df), None)) is not None:
        remove(df.sparkSession, held[1])


_made: set[str] = set()
_paths: dict[int, tuple[DataFrame, str]] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Best effort: the session may have ended before."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        pass


#: Bytes of text that a worker makes Python values of at a time.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts (or bytes) of a column come to `most` bytes at most; a longer one is a part by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to
