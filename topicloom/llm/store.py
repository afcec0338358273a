"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import shared_dir
from .bytes import give_back


def hand_back(spark: SparkSession) -> None:
    """Collects the driver's heap, so that what is free goes back to the system, and Spark drops the shuffles and broadcasts of plans that are gone.

    What the driver's Python, and its JVM outside the heap, have freed goes back as well.
    """
    spark.sparkContext._jvm.java.lang.System.gc()
    give_back()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Hands back what the JVM has freed outside its heap: each of some hundred threads leaves parts of arenas, which nothing else trims."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    name, server = "com.sun.management:type=DiagnosticCommand", "javax.management.MBeanServer"
    with suppress(Py4JError):  # a JVM that has no such command
        # Found by the interface, as Py4J may not call the server's own class.
        kinds, values = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName(name), "systemTrimNativeHeap"
        invoke = jvm.java.lang.Class.forName(server).getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


class Store:
    """A set of tables of one operator call, under one folder of the shared directory.

    Written tables survive the loss of any executor, unlike cached blocks, and the optimizer sees
    fresh statistics when it plans what comes after them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def _next(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
        """The table as written. file_rows: rows of a file, at most; writers and readers hold a file's rows together if they are few, however large."""
        path = self._next(name)
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_bucketed(self, df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
        """A table bucketed by a column, so that joins and groups by it need no exchange of it.

        The catalog's entry goes again once the table is resolved: the files are the folder's, and the session keeps no name of them.
        """
        table = f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, by).option("path", self._next(name)).option("compression", "zstd").format("parquet").saveAsTable(table)
        found = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return found

    def drop(self) -> None:
        """Remove the tables; call it once results that read them are written."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
