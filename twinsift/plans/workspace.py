"""Durable intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}
#: Folders of the runs of this process.
_made: list[str] = []
#: Runs begun inside :meth:`Workspace.settle`, of this thread alone.
_inner: ContextVar[list[Workspace] | None] = ContextVar("inner", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, a local folder per application if Spark runs on this machine alone (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local.get(context.applicationId)
        if folder is None:
            folder = _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="twinsift-")
            atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder.rstrip("/")


def clear_workspaces(spark: SparkSession) -> int:
    """Delete the intermediate tables of all runs of this process, and how many there were: for when their results have been written or are not needed."""
    count = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


class Workspace:
    """Tables of one operator run.

    Writing a table cuts its lineage: a lost executor costs the tasks it ran, not
    the stages before them, since the files live outside the executors.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None) -> None:
        """A new folder for a run, or the folder ``root`` of something that is kept."""
        self.spark = spark
        self.root = root.rstrip("/") if root else f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if not root:
            _made.append(self.root)
            if (inner := _inner.get()) is not None:
                inner.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def save(self, df: DataFrame, name: str, mode: str = "overwrite", by: list[str] | None = None) -> DataFrame:
        """Write and read back; the schema is kept, so empty tables work."""
        writer = df.write.mode(mode)
        if by:
            writer = writer.partitionBy(*by)
        writer.parquet(self.path(name))
        return self.read(name, df)

    def settle(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        """Save what make() returns, then delete the tables of the runs that it began."""
        inner: list[Workspace] = []
        token = _inner.set(inner)
        try:
            result = self.save(make(), name)
        finally:
            _inner.reset(token)
        for run in inner:
            run.drop("")
            if run.root in _made:
                _made.remove(run.root)
        self.free()
        return result

    def free(self) -> None:
        """Let go of the shuffle files behind tables that have been written: Spark keeps them until the driver happens to collect its garbage.

        What was written last is still held by events under way, and by objects that are finalised first: one collection leaves it.
        """
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            self.spark._jvm.System.runFinalization()
            time.sleep(0.2)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def read_all(self, pattern: str, like: DataFrame) -> DataFrame:
        """All tables whose names match, as one."""
        return self.spark.read.schema(like.schema).parquet(self.path(pattern))

    def file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, *names: str) -> None:
        """Delete these tables; without a name, the folder of the run."""
        for name in names:
            system, path = self.file(name)
            system.delete(path, True)

    def write_text(self, name: str, text: str) -> None:
        """A small text in place of what was there, whole or not at all."""
        system, path = self.file(name)
        _, fresh = self.file(f"{name}.new")
        out = system.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        system.delete(path, False)
        system.rename(fresh, path)

    def read_text(self, name: str) -> str:
        system, path = self.file(name)
        if not system.exists(path):
            # between the two moves of writing
            _, path = self.file(f"{name}.new")
        data = system.open(path)
        try:
            return bytes(data.readAllBytes()).decode()
        finally:
            data.close()
