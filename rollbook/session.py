"""Small helpers around the caller's session.  Nothing here creates one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# More literal rows than this go to Spark as local data instead of as expressions.
LITERAL_ROWS_INLINE = 2000

# Spark's own switch: shuffle files of a query go when it has ended, not when the driver's JVM next collects what stands for them.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_work_folder: ContextVar[str | None] = ContextVar("work_folder", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it.  Only where that is unset, and only in
    local mode, a temporary folder stands in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="rollbook-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def work_folder(spark: SparkSession, path: str | None = None) -> Iterator[str]:
    """A folder of the caller's for intermediate tables, removed at the end.

    Frames made inside read from it: write what is to stay before leaving.
    Without it, intermediate tables stay under the shared folder, where the caller removes them.
    """
    path = path or scratch_path(spark, "work")
    token = _work_folder.set(path)
    try:
        yield path
    finally:
        _work_folder.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the work folder, else under the shared folder."""
    own = _work_folder.get()
    if own:
        return f"{own.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{shared_folder(spark).rstrip('/')}/rollbook/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside leave no shuffle files behind.

    With many tasks the driver keeps what stands for a shuffle in its old generation, so that
    the files of many steps would lie on disk at once.  Only for frames that run once: shuffle files of
    a frame that runs again would have to be made again.
    """
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)


def materialise(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write the frame to the shared folder and go on from the files, which stay prunable by column."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_frame(spark: SparkSession, rows: Sequence[Sequence], schema: Sequence[tuple[str, str]]) -> DataFrame:
    """A frame of values known in the program, built inside the JVM while they are few."""
    if len(rows) > LITERAL_ROWS_INLINE:
        return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} {t}" for n, t in schema))
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in schema])
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, schema)])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
