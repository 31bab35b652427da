"""Session plumbing: shipping the package to executors and shared scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per SparkContext.

    Spark's own file server hands the archive out, so nothing needs to be
    installed on the machines and no folder needs to be shared.
    """
    sc = spark.sparkContext
    if _BATCH not in spark.conf.getAll:  # not set by the user: Spark's default suits short rows; texts and rasters are long
        spark.conf.set(_BATCH, "2000")
    if getattr(sc, "_gridloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(archive)
    sc._gridloom_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """Folder that all machines share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and all runs on one machine (tests, a laptop) a
    folder of that machine is used, and the setting is then put into the
    session; on a cluster an unset one is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = Path(tempfile.mkdtemp(prefix="gridloom-scratch-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """A folder for the tables of one operator call, in the shared root."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        for paths in _WORKSPACES.get(id(spark.sparkContext), [])[-1:]:
            paths.append(self.path)

    def table(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as read back, which cuts its lineage."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def bucketed(self, name: str, df: DataFrame, column: str, codec: str = "none") -> DataFrame:
        """Like ``table``, but bucketed by ``column`` into as many buckets as there are shuffle partitions, so that later joins and groups by it need not move these rows."""
        known = f"gridloom_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{self.path}/{name}").option("compression", codec).bucketBy(partitions(self.spark), column).saveAsTable(known)
        out = self.spark.table(known)
        self.spark.sql(f"DROP TABLE {known}")  # forgets the name; the files stay, and the plan has them
        return out

    def drop(self, name: str) -> None:
        """Delete a table or folder that no later plan reads."""
        _delete(self.spark, f"{self.path}/{name}")

    def drop_read(self, df: DataFrame) -> None:
        """Delete the tables of this folder that a plan, now done with, was made of."""
        for file in df.inputFiles():
            if f"{self.path.rsplit('/', 1)[-1]}/" in file:
                _delete(self.spark, file.rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables that were made inside. Write or collect results before it ends.

        with workspace(spark):
            jaccard.components(docs).write.parquet(out)
    """
    open_ = _WORKSPACES.setdefault(id(spark.sparkContext), [])
    mine: list[str] = []
    open_.append(mine)
    try:
        yield
    finally:
        open_.remove(mine)
        for path in mine:
            _delete(spark, path)


_WORKSPACES: dict[int, list[list[str]]] = {}


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = f"{name}_{uuid.uuid4().hex[:8]}"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame, by: str, per: int = 1000) -> DataFrame:
    """Rows dealt out by a key over as many tasks as keep each to about ``per`` of them, whatever the layout of their files: a table of a few MB is one task to Spark, though each of its rows may stand for a whole picture."""
    return rows.repartition(tasks_for(rows, per), by)


def tasks_for(rows: DataFrame, per: int = 1000) -> int:
    """Tasks that have about ``per`` of these rows each."""
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per))


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast: Spark guesses the size of what Arrow kernels make by that of their input, which may be far smaller."""
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """In a worker: return freed memory to the system, so that workers that wait do not hold it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
