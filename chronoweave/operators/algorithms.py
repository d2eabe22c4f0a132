"""PageRank, connected components, landmark distances, label propagation."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import spread
from ..sources.edges import JobConfig
from ..sources.storage import materialize, materialize_counting, release
from . import history
from .edges import batches, both_ways, vertices, weights
from .pregel import pregel

RESET, DAMPING = 0.15, 0.85


def pagerank(edges: DataFrame, tolerance: float = 1e-4, max_iter: int = 1000) -> DataFrame:
    """id, pr: delta PageRank, un-normalised. A vertex passes its last increase on while that is over the
    tolerance."""
    state = vertices(edges).select("id", F.lit(RESET).alias("pr"), F.lit(RESET).alias("delta"))
    gain = DAMPING * F.col("msg")
    done = pregel(
        state, weights(edges.select("src", "dst")),
        [("dst", F.col("src_delta") > tolerance, F.col("src_delta") * F.col("weight"))],
        F.sum, {"pr": F.col("pr") + gain, "delta": gain}, "out", max_iter, {"delta": F.lit(0.0)}, ("src",),
    )
    return done.select("id", "pr")


def top(ranks: DataFrame, n: int = 50) -> DataFrame:
    return ranks.orderBy(F.desc("pr"), "id").limit(n)


def components_capped(edges: DataFrame, max_iter: int) -> DataFrame:
    """id, label: the least id within so many hops."""
    state = vertices(edges).select("id", F.col("id").alias("label"))
    return pregel(
        state, edges.select("src", "dst"),
        [("dst", F.col("src_label") < F.col("dst_label"), F.col("src_label")), ("src", F.col("dst_label") < F.col("src_label"), F.col("dst_label"))],
        F.min, {"label": F.least("label", "msg")}, "either", max_iter,
    )


def components(edges: DataFrame) -> DataFrame:
    """id, label: the least id of each component. Labels jump to their label's label every round, so long
    paths take a logarithm of their length."""
    spark = edges.sparkSession
    pairs = materialize(spark, both_ways(edges.select("src", "dst")).distinct(), "pairs")
    first = pairs.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("label"))
    labels = written = materialize(spark, first, "labels")
    while True:
        near = pairs.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("low"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "low").alias("low"))
        far = labels.select(F.col("id").alias("low"), F.col("label").alias("further"))
        step = step.join(far, "low").select("id", F.least("further", "low").alias("next"), "label")
        step, changed = materialize_counting(spark, step, "labels", F.col("next") != F.col("label"))
        release(spark, written)
        written = step
        labels = step.select("id", F.col("next").alias("label"))
        if not changed:
            release(spark, pairs)
            return labels


def components_by_batch(edges: DataFrame, size: int) -> DataFrame:
    """batch_id, id, label after each batch, over all edges so far, from the history of the labels: work is in
    proportion to the edges and to the rows that are returned."""
    spark = edges.sparkSession
    rows = batches(edges, size)
    last = rows.agg(F.max("batch_id")).collect()[0][0]
    whole = rows.where("src is not null and dst is not null").select(F.col("src").cast("long"), F.col("dst").cast("long"), "batch_id")
    fields = "src long, dst long, batch_id long"
    few = whole.mapInArrow(history.forest, fields).repartition(1)
    labels = materialize(spark, few.mapInArrow(history.spans(last if last is not None else -1), history.SPAN_SQL), "spans")
    dealt = labels.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return dealt.select(F.explode(F.sequence("first", "last")).alias("batch_id"), "id", "label")


def landmarks(ids: DataFrame, n: int) -> DataFrame:
    """A fixed sample of n vertices: the least scattered ids."""
    return ids.orderBy(spread(F.col("id")), "id").limit(n).select("id")


def shortest_paths(edges: DataFrame, marks: DataFrame, max_iter: int = 100) -> DataFrame:
    """id, landmark, dist: hops from id to the landmark along the edges; what can't reach it is absent.

    A breadth-first frontier of (id, landmark) rows, of which each enters once."""
    spark = edges.sparkSession
    into = edges.select("src", "dst").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    found = vertices(edges).join(marks, "id", "left_semi").select("id", F.col("id").alias("landmark"), F.lit(0).cast("long").alias("dist"))
    found = materialize(spark, found, "distances")
    front = found
    for d in range(1, max_iter + 1):
        step = into.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "landmark").distinct()
        step = step.join(found, ["id", "landmark"], "left_anti").withColumn("dist", F.lit(d).cast("long"))
        front, reached = materialize_counting(spark, step, "distances", F.lit(True))
        if not reached:
            break
        found = found.unionByName(front)
    into.unpersist()
    return found


def label_propagation(edges: DataFrame, steps: int) -> DataFrame:
    """id, label after exactly so many synchronous rounds: the most frequent label among neighbours, the
    smallest of equals. Labels are counted per (id, label), never gathered."""
    if steps <= 0:
        raise ValueError("steps must be over 0")
    spark = edges.sparkSession
    pairs = both_ways(edges.select("src", "dst")).persist(StorageLevel.MEMORY_AND_DISK)
    labels = vertices(edges).select("id", F.col("id").alias("label"))
    for i in range(steps):
        votes = pairs.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
        labels = votes.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        if i % 4 == 3:
            labels = materialize(spark, labels, "labels")
    labels = materialize(spark, labels, "labels")
    pairs.unpersist()
    return labels


def hop_lengths(vertex: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """id, length: hops from the vertices that start at 0; unreached vertices keep the largest 32-bit number."""
    far = 2**31 - 1
    return pregel(
        vertex, edges, [("dst", F.col("src_length") < far, F.col("src_length"))],
        F.min, {"length": F.least("length", F.col("msg") + 1)}, "out", rounds, None, ("src",),
    )


def run(edges: DataFrame, config: JobConfig) -> DataFrame:
    """The result of the algorithm that a configuration names: PR, CC, SP or LP."""
    named = {
        "PR": lambda: pagerank(edges, config.tolerance, config.max_iterations),
        "CC": lambda: components(edges),
        "SP": lambda: shortest_paths(edges, landmarks(vertices(edges), config.landmarks), config.max_iterations),
        "LP": lambda: label_propagation(edges, config.max_iterations),
    }
    if config.algorithm not in named:
        raise ValueError(f"unknown algorithm {config.algorithm}")
    return named[config.algorithm]()
