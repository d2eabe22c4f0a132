"""Edge and vertex relations: filters, orientation, merging, degrees, activity, running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def canonical(edges: DataFrame) -> DataFrame:
    """The larger endpoint first."""
    return edges.withColumns({"src": F.greatest("src", "dst"), "dst": F.least("src", "dst")})


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, from one scan."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.inline(ends), *rest)


def dedup_last(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): the last in arrival order."""
    return edges.groupBy("src", "dst").agg(F.max_by("ts", "seq").alias("ts"))


def dedup_max(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): the greatest time."""
    return edges.groupBy("src", "dst").agg(F.max("ts").alias("ts"))


def replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old edges give way to new ones of the same endpoints."""
    return old.join(new.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "ts").unionByName(new.select("src", "dst", "ts"))


def endpoints(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), *rest)


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def touched(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Vertices of the old graph that a batch touches."""
    return vertices(old).join(vertices(batch), "id", "left_semi")


def unseen(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Vertices of a batch that the old graph lacks."""
    return vertices(batch).join(vertices(old), "id", "left_anti")


def batches(edges: DataFrame, size: int) -> DataFrame:
    """Adds batch_id by arrival; a size under 1 is one batch."""
    return edges.withColumn("batch_id", F.floor((F.col("seq") - 1) / size).cast("long") if size > 0 else F.lit(0).cast("long"))


def degree_undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbours either way."""
    pairs = both_ways(edges.select("src", "dst")).distinct()
    return pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def degree_out(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def out_edges(edges: DataFrame) -> DataFrame:
    """Edges that leave each vertex, repeats included."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def activity(edges: DataFrame) -> DataFrame:
    return endpoints(edges.select("src", "dst")).groupBy("id").agg(F.count("*").alias("activity"))


def weights(edges: DataFrame) -> DataFrame:
    """Adds weight: one over the number of edges that leave the source."""
    return edges.join(out_edges(edges).withColumnRenamed("id", "src"), "src").withColumn("weight", 1.0 / F.col("degree")).drop("degree")


def _ends(edges: DataFrame) -> DataFrame:
    """seq, side (0 source, 1 destination), id, nbr."""
    return edges.select("seq", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("src").alias("id"), F.col("dst").alias("nbr")),
        F.struct(F.lit(1).alias("side"), F.col("dst").alias("id"), F.col("src").alias("nbr")),
    )))


def running(edges: DataFrame) -> DataFrame:
    """seq, side, id, activity, degree after each edge, in arrival order."""
    order = Window.partitionBy("id").orderBy("seq", "side")
    first = F.row_number().over(Window.partitionBy("id", "nbr").orderBy("seq", "side")) == 1
    rows = _ends(edges).withColumn("new", first.cast("long"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Both ends of an edge count before its statistics are taken: a self loop is one step, not two.
    last = F.row_number().over(Window.partitionBy("id", "seq").orderBy(F.desc("side"))) == 1
    rows = rows.select("seq", "side", "id", F.count("*").over(upto).alias("activity"), F.sum("new").over(upto).alias("degree"))
    return rows.withColumn("last", last).where("last").drop("last")


def predictor_tally(edges: DataFrame) -> DataFrame:
    """How often the running degree and the running activity of an edge's ends compare as their final
    degrees do: activity_correct, activity_wrong, degree_correct, degree_wrong, total."""
    now = running(edges).select("seq", "id", "activity", "degree")
    final = degree_undirected(edges).withColumnRenamed("degree", "final")
    now = now.join(final, "id")
    def end(name, prefix):
        return now.select("seq", F.col("id").alias(name), *[F.col(c).alias(f"{prefix}_{c}") for c in ("activity", "degree", "final")])

    rows = edges.select("seq", "src", "dst").join(end("src", "s"), ["seq", "src"]).join(end("dst", "d"), ["seq", "dst"])
    sign = lambda c: F.signum(F.col(f"s_{c}") - F.col(f"d_{c}"))
    right_a, right_d = sign("activity") == sign("final"), sign("degree") == sign("final")
    return rows.agg(
        F.count_if(right_a).alias("activity_correct"), F.count_if(~right_a).alias("activity_wrong"),
        F.count_if(right_d).alias("degree_correct"), F.count_if(~right_d).alias("degree_wrong"), F.count("*").alias("total"))
