"""Shared helpers: scratch tables, bounded label samples, Arrow loops."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled together by the Python operators, in bytes of UTF-8.
CHUNK_BYTES = 4 << 20


#: Paths staged inside the innermost ``removing`` block.
_inside: ContextVar[list[str] | None] = ContextVar("inside", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is not set, a session in one JVM (tests, a laptop) gets a temporary
    folder of its own; any other master is refused, as its executors would not
    see a folder of the driver.
    """
    kept = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not kept:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tallyhouse-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        kept = spark.sparkContext.getCheckpointDir()
    return kept.rstrip("/")


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The table survives lost executors and cuts the lineage. It is removed by
    ``drop_staged``, at the end of a ``removing`` block, or when the application
    ends.
    """
    spark = df.sparkSession
    own = f"{scratch_dir(spark)}/tallyhouse-{spark.sparkContext.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    files, at = _folder(spark, own)
    files.deleteOnExit(at)
    if _inside.get() is not None:
        _inside.get().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Remove a table made by ``stage`` that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        files, at = _folder(df.sparkSession, path)
        files.delete(at, True)


@contextmanager
def removing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are removed at the end, but for those that were
    given to the function it yields."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_path)
        return df

    before, paths = _inside.get(), []
    _inside.set(paths)
    try:
        yield keep
    finally:
        _inside.set(before)
        for path in paths:
            if path not in kept:
                files, at = _folder(spark, path)
                files.delete(at, True)
            elif before is not None:
                before.append(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null id: -1, in no fold)."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(-1))


def bounded_sample(df: DataFrame, label: str, key: str, per_class: int, most_classes: int = 2, most_rows: int | None = None) -> DataFrame:
    """About ``per_class`` rows of each label value, chosen by a hash of ``key``;
    fewer of each where all together would pass ``most_rows``.

    Only the ``most_classes`` most frequent values are learnt from, which bounds
    what one count by label sends to the driver; the choice itself is a filter, so
    no group is gathered in one task.
    """
    counted = df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(most_classes)
    counts = {r[0]: r[1] for r in counted.collect()}
    if not counts:
        return df.where(F.lit(False))
    if most_rows:
        per_class = min(per_class, max(1, most_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for v, n in sorted(counts.items()) for x in (v, min(1.0, per_class / n))])
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return df.where(draw < F.try_element_at(share, F.col(label)))


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session grow beyond ``CHUNK_BYTES`` by much.

    Rows alone bound a batch badly: 10,000 texts are 40 MB or 400. A lower bound
    that the session has already stays. The setting outlasts the call: plans are
    lazy and read it when they run, so it cannot be put back here.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= CHUNK_BYTES:
        spark.conf.set(key, f"{CHUNK_BYTES}b")


#: What operators keep from task to task in a Python worker, and how to drop it.
_kept: dict[str, Callable[[], None]] = {}
_served: list[str] = [""]


def keeps(module: str, drop: Callable[[], None]) -> None:
    """Register a cache that outlives a task."""
    _kept[module] = drop


def settle(module: str) -> None:
    """A worker serves one operator after the other: on entering another one's
    stage it drops what earlier ones kept."""
    if _served[0] != module:
        for name, drop in _kept.items():
            if name != module:
                drop()
        gc.collect()
        _served[0] = module


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``function`` over Arrow batches cut to about ``CHUNK_BYTES`` of data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(function.__module__)
        for batch in batches:
            for part in cut(batch):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(n, int(n * CHUNK_BYTES / max(1, batch.nbytes))))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
