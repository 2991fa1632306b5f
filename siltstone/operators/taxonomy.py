"""Graphs of (child, parent) edges: closure, ancestors, cycles."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CycleError(ValueError):
    pass


def _cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder of spark.checkpoint.dir, so that a round does not compute all before it again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints_"))
    return df.checkpoint()


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(ancestor, descendant), each node with itself; a cycle is an error. Paths double in length every round."""
    nodes = edges.select(F.col("child").alias("n")).unionByName(edges.select(F.col("parent").alias("n"))).distinct()
    reach = edges.select(F.col("parent").alias("a"), F.col("child").alias("d")).distinct()
    reach = _cut(reach)
    count = reach.count()
    for _ in range(max_rounds):
        more = reach.alias("x").join(reach.alias("y"), F.col("x.d") == F.col("y.a")).select("x.a", "y.d")
        reach = _cut(reach.unionByName(more).distinct())
        if reach.where("a = d").limit(1).count():
            raise CycleError("the taxonomy has a cycle")
        new = reach.count()
        if new == count:
            break
        count = new
    else:
        raise ValueError(f"the taxonomy is deeper than 2^{max_rounds}")
    return reach.select(F.col("a").alias("ancestor"), F.col("d").alias("descendant")).unionByName(nodes.select(F.col("n").alias("ancestor"), F.col("n").alias("descendant")))


def ancestors(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """start(node) -> (node, ancestor, distance): the shortest distance, up to depth."""
    step = start.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    out = step
    for k in range(1, depth + 1):
        step = step.join(edges, step.ancestor == edges.child).select("node", F.col("parent").alias("ancestor"), F.lit(k).cast("long").alias("distance")).distinct()
        out = out.unionByName(step)
    return out.where("distance > 0 AND ancestor <> node").groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))


def parents(edges: DataFrame) -> DataFrame:
    """(node, parents): roots with an empty list."""
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    up = edges.groupBy(F.col("child").alias("node")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return nodes.join(up, "node", "left").withColumn("parents", F.coalesce("parents", F.array().cast(up.schema["parents"].dataType)))


def closure_lists(edges: DataFrame) -> DataFrame:
    """(node, descendants): itself first, then the others in ascending order."""
    c = closure(edges).where("ancestor <> descendant").groupBy(F.col("ancestor").alias("node")).agg(F.array_sort(F.collect_set("descendant")).alias("d"))
    return parents(edges).select("node").join(c, "node", "left").select("node", F.concat(F.array("node"), F.coalesce("d", F.array().cast(c.schema["d"].dataType))).alias("descendants"))


def related(edges: DataFrame, start: DataFrame, direction: str = "both", depth: int | None = None) -> DataFrame:
    """(node, related, relation): ancestors (up to a depth) and descendants of start(node), without itself."""
    if direction not in ("ancestors", "descendants", "both"):
        raise ValueError(f"no direction is called {direction!r}")
    c = closure(edges).where("ancestor <> descendant")
    up = ancestors(edges, start, depth).select("node", F.col("ancestor").alias("related")) if depth is not None else start.join(c, start.node == c.descendant).select("node", F.col("ancestor").alias("related"))
    down = start.join(c, start.node == c.ancestor).select("node", F.col("descendant").alias("related"))
    parts = [x.withColumn("relation", F.lit(n)) for n, x in (("ancestor", up), ("descendant", down)) if direction in ("both", n + "s")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
