"""Session helpers: a local session for tests and benches, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
R = TypeVar("R")
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | None = None, app: str = "plumbline") -> SparkSession:
    """A single-machine session.  On a cluster the caller brings its own session instead."""
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; a cluster without it
    is a configuration error, because a machine-local folder is lost together with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().conf().get("spark.checkpoint.dir", "")
    current = sc._jsc.sc().getCheckpointDir()
    if folder:
        if current.isEmpty():
            sc.setCheckpointDir(folder)
        return folder
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_STORED: list[str] = []
_SCOPE: ContextVar[list[str]] = ContextVar("stored", default=_STORED)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Store the rows as Parquet in the shared folder and read them back.

    A lost executor cannot change stored rows, and later steps read only the columns they use.  The copies stay until
    ``release`` is called or the surrounding ``scratch`` ends, because frames built on them are lazy.
    """
    path = scratch_path(df.sparkSession, name)
    with passing_shuffles(df.sparkSession):
        df.write.parquet(path)
    _SCOPE.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_all(parts: Iterable[DataFrame], name: str = "cut") -> DataFrame:
    """Store frames of one schema one after the other, each made when its turn comes, and read them back as one.

    So only the shuffles of one frame are on disk at a time.
    """
    path = ""
    for i, df in enumerate(parts):
        if not path:
            spark, schema, path = df.sparkSession, df.schema, scratch_path(df.sparkSession, name)
            _SCOPE.get().append(path)
        with passing_shuffles(spark):
            df.write.parquet(f"{path}/part={i}")
    return spark.read.schema(schema).parquet(f"{path}/part=*")


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries inside delete their shuffle files when they end; otherwise these stay until the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def release(spark: SparkSession, stored: list[str] | None = None) -> int:
    """Delete the copies made by ``cut``, once their results have been written; returns their number."""
    stored = _STORED if stored is None else stored
    n = len(stored)
    while stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(stored.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Copies that ``cut`` makes inside are deleted at the end: for steps that write their result, such as a micro-batch."""
    own: list[str] = []
    token = _SCOPE.set(own)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        release(spark, own)


def side_by_side(work: Callable[[T], R], items: Iterable[T], at_once: int | None = None) -> list[R]:
    """Run independent model fits at the same time, ``at_once`` of them; each is a chain of small Spark jobs."""
    listed = list(items)
    with ThreadPool(max(1, min(len(listed), at_once or len(listed)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), listed, chunksize=1)


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more, such as the rows of a finished fit."""
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without_summary(model):
    """The fitted model without its training summary.

    The summary refers to the session, and a session in which rows were observed cannot be sent to executors: scoring
    with the model would fail.
    """
    model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model
