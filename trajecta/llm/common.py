"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x20\\x09-\\x0D]+"
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Without one a local master gets a temporary folder; on a cluster that is an error, as executors share none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage, so that a lost executor costs no recomputation. For narrow rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As checkpoint, but compressed, as a Parquet table in the same folder: for rows that hold texts, where Spark should know the size, and in loops.

    (A checkpoint keeps the estimated size of its plan. A join's estimate is the product of its sides', so that in a loop
    the estimates come to have millions of digits.)
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete what written() stored for df; for loops whose next step is stored."""
    _written.remove(df._written_at)
    _delete(df.sparkSession, df._written_at)


def discard_written(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables that written() made after the first so many of this session; for callers that have stored their result."""
    while len(_written) > keep:
        _delete(spark, _written.pop())


def written_so_far() -> int:
    return len(_written)


def free_memory() -> None:
    """Give what a task has freed back to the system; Python workers are used again by other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def arrow_map(df: DataFrame, over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches of about SLICE_BYTES, which the session keeps unless it has less: ten thousand texts at a time need too much memory on both sides."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH_BYTES).rstrip("bB")
    if not now.isdigit() or int(now) > SLICE_BYTES:
        conf.set(BATCH_BYTES, str(SLICE_BYTES))
    return df.mapInArrow(over, schema)


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of b of at most SLICE_ROWS rows and, single rows apart, about SLICE_BYTES."""
    rows = max(1, min(SLICE_ROWS, SLICE_BYTES * b.num_rows // max(1, b.nbytes)))
    for a in range(0, b.num_rows, rows):
        yield b.slice(a, rows)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """Apply f to each Arrow batch, part by part, so that what a worker holds is bounded; after runs at the end of each task."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for part in slices(b):
                    yield f(part)
        finally:
            if after:
                after()
            free_memory()

    return arrow_map(df, over, schema)


def with_outputs(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns whose names an operator is about to write (any letter case): outputs replace them."""
    clash = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in clash])


def shielded(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Operators name their own columns with two leading underscores; input columns that are named so step aside and come back."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        names = ["~" + c if c.startswith("__") else c for c in df.columns]
        out = f(df.toDF(*names) if names != df.columns else df, *args, **kwargs)
        back = [c[1:] if c.startswith("~__") else c for c in out.columns]
        return out.toDF(*back) if back != out.columns else out

    return run
