"""Shared storage for intermediate results, and connected components over any number of edges."""

from __future__ import annotations

import gc
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Where the session names none, one on this machine is made, but only for a local session (as in
    tests): executors elsewhere wouldn't see it."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if (given := sc._jsc.sc().getCheckpointDir()).isDefined():
        return given.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lorewell-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of ``df`` with files in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


#: Rows of narrow results that a partition has, if there are so many.
PART_ROWS = 1 << 16


def parts_of(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def compact(df: DataFrame) -> DataFrame:
    """checkpoint() of narrow rows, which are then read in parts of some PART_ROWS rows.

    Else each later step has a task for every partition of a small result, empty or not. There never
    are more partitions than before, so that large results stay as they are."""
    return counted(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """compact() rows and their number, which is counted while they are written, without a job of its own."""
    seen = Observation()
    kept = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("n")))
    rows = seen.get["n"]
    return kept.coalesce(parts_of(rows)), rows


def release(spark: SparkSession) -> None:
    """Gives back what finished steps hold: their broadcasts and shuffles in the driver, their files on disk.

    Spark frees those once the driver collects its garbage, which by itself it does each half hour or
    when its heap is full; by then a job of hundreds of small stages has filled both."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> str:
    """Has the driver's JVM give the system what its native code (compiler, network, compression) has freed; what it says.

    Those blocks else stay with its hundreds of threads. It is Java's command System.trim_native_heap,
    which newer Javas have on Linux; where there is none, nothing is done."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    given = array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    # by the method of the interface, since the server's own class isn't open
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    try:
        return str(invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given))
    except Py4JError:
        return ""


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the rows (a, b): component is the smallest node reachable.

    Labels move along edges and then jump to the label of the label, so that the number of rounds
    grows with the logarithm of the longest path. Each round joins and aggregates; nothing but
    counts reach the driver. Results go on in as many partitions as the number of edges asks for
    (parts_of), so that rounds over few edges are a few tasks. Both sides of a join on a node or
    label that many rows share are read from files, so that Spark can split such a key. Loops and
    repeated edges do no harm; nulls are left out."""
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    both, rows = counted(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parts = parts_of(rows)
    kept = lambda df: checkpoint(df.coalesce(parts)).coalesce(parts)
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").coalesce(parts).groupBy("a").agg(F.min("c").alias("c"))
        hooked = labels.join(near.select(F.col("a").alias("node"), "c"), "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component")).coalesce(parts)
        # the best label that any member brings goes to the root as well, so that trees hook as a whole
        roots = hooked.groupBy(F.col("old").alias("node")).agg(F.min("component").alias("r"))
        moved = kept(hooked.join(roots, "node", "left").select("node", "old", F.least("component", F.coalesce("r", "component")).alias("component")))
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("j"))
        done = kept(moved.join(jump, "component", "left").select("node", "old", F.coalesce("j", "component").alias("component")))
        labels = done.select("node", "component")
        settled = not done.where("old != component").limit(1).count()
        del near, hooked, roots, moved, jump, done
        release(edges.sparkSession)
        if settled:
            return labels


def merge_components(labels: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels after new edges, components touched): incremental connected components.

    ``labels`` (node, component) are those before, ``edges`` (a, b) the new ones alone. Components so
    far count as single nodes: only ends of new edges are looked up, only components that an edge
    joins are labelled anew, and old edges aren't read. Touched are the components (component) that
    are new, larger or joined. A label is the smallest node, as in connected_components()."""
    ends = checkpoint(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct()
    known = checkpoint(nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("new")))
    names = known.select("node", "component")
    between = ends.join(names.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(names.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    joined = connected_components(between.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("into"))
    every = labels.unionByName(known.where("new").select("node", "component"))
    moved = every.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    alone = known.where("new").join(joined, "component", "left").select(F.coalesce("into", "component").alias("component"))
    return checkpoint(moved), joined.select(F.col("into").alias("component")).union(alone).distinct()
