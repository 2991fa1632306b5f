"""What several operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut, drop, remove, scratch, shared_dir  # noqa: F401

#: A-Z to a-z and nothing else, as `translate` arguments.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives memory back to the system that a Python worker, kept for later tasks, would hold. Best effort."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def give_back(spark: SparkSession) -> str | None:
    """Gives memory that the driver's Python and JVM have freed back to the system; the JVM's answer, None where it has no such command.

    C's heap keeps what compilers, codecs and the many threads of plans have freed, and that adds up over many small jobs. Java's
    heap is not touched.
    """
    release()
    try:
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by the interface: the server's own class is not open to callers
        kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        given[0], given[1] = name, "systemTrimNativeHeap"
        return jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, given)
    except Exception:  # noqa: BLE001
        return None


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges(a, b): any ordered type, a <> b. Returns (node, root), root being the smallest node of its component; nodes
    without an edge do not appear. Each round is two grouped minima and is cut at the shared folder. Neighbour lists
    are never collected: a hub with a third of all nodes is a partial aggregate and a join whose other side has one row
    a key.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: each neighbour above u hangs on the least node about u
        big = e.join(low, e.a == low.u).select(F.col("m").alias("a"), F.col("b"))
        big = big.where("a <> b").distinct()  # read twice below; cheaper than another table on disk
        # small star: u and its lower neighbours hang on the least of them
        small_low = big.groupBy("b").agg(F.min("a").alias("m"))
        j = big.join(small_low, "b")
        nxt = j.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small_low.select(F.col("m").alias("a"), F.col("b")))
        nxt = cut(nxt.where("a <> b").distinct())
        # a star forest: no node is both a root and a leaf, and no leaf has two roots
        roots = nxt.select(F.col("a").alias("r")).distinct()
        open_ = nxt.join(roots, F.col("b") == F.col("r"), "left_semi").limit(1).count() or nxt.groupBy("b").count().where("count > 1").limit(1).count()
        e = nxt
        if not open_:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
