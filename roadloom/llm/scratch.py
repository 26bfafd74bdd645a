"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.textops import release, small_batches

_open: list[Scratch] = []


@functools.lru_cache
def _own_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='roadloom-')}"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a session in one process (tests, a laptop) has a temporary
    folder in its place; elsewhere there is no folder that all executors are known to share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return base.rstrip("/")


def give_back(spark: SparkSession) -> None:
    """Give memory that is free, but kept by allocators for later, of the driver's Python and JVM back to the system. Hundreds
    of threads plan and compile a session's stages, and what each leaves behind counts beside all that come after it."""
    release()
    context = spark.sparkContext
    jvm, array = context._jvm, context._gateway.new_array
    named = jvm.java.lang.Class.forName
    with contextlib.suppress(Py4JError):  # a JVM that is too old for it, or not on Linux
        kinds, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By reflection, as the server's own class is in a package that is not exported.
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


class Scratch:
    """Parquet tables that cut a plan's lineage: a lost executor costs the tasks it ran, not the stages before the table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        if not _open:
            atexit.register(lambda: [s.close() for s in list(_open)])
        _open.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, and read it back."""
        at = f"{self.path}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").parquet(at)
        give_back(self.spark)
        return self.spark.read.schema(df.schema).parquet(at)

    def remove(self, name: str = "") -> None:
        """Delete one table, or all of them."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def only(self, *names: str) -> None:
        """Delete all tables but these, which the result still reads."""
        for name in self.names - set(names):
            self.remove(name)
        self.names &= set(names)
        self.settle()

    def settle(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects
        its garbage, which a driver with little to do puts off. What is free then goes back to the system."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        give_back(self.spark)

    def close(self) -> None:
        if self in _open:
            _open.remove(self)
        try:
            self.remove()
        except Exception:  # noqa: BLE001 - the session may have ended; its folder then goes with the cluster's
            pass
