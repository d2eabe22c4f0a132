"""Result layouts: flat outputs per vertex, and nested forms of the row relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import sizes, update_counts


def profile_output(profile: DataFrame, degrees: DataFrame, horizon: int = 0) -> DataFrame:
    """id, profile_size, update_count, degree; 0 where a vertex has nothing newer than the horizon."""
    rows = degrees.select("id", "degree").join(sizes(profile, horizon).withColumnRenamed("size", "profile_size"), "id", "left")
    rows = rows.join(update_counts(profile).withColumnRenamed("updates", "update_count"), "id", "left")
    return rows.select("id", F.coalesce("profile_size", F.lit(0)).alias("profile_size"), F.coalesce("update_count", F.lit(0)).alias("update_count"), "degree")


def vertex_output(summaries: DataFrame, degrees: DataFrame) -> DataFrame:
    """As profile_output, from the summaries of the profiles."""
    rows = degrees.select("id", "degree").join(summaries, "id", "left")
    return rows.select("id", F.coalesce("size", F.lit(0)).alias("profile_size"), F.coalesce("updates", F.lit(0)).alias("update_count"), "degree")


def landmark_maps(distances: DataFrame) -> DataFrame:
    """id, distances: a map from landmark to hops. As many entries as there are landmarks at most."""
    return distances.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("landmark", "dist")))).alias("distances"))


def merge_landmark_maps(a, b):
    """The union of two maps with the smaller distance of common landmarks."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(F.least(x, y), x, y))


def nested_sketch(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, bucket, staircase: an array of (rank, ts), the larger ranks first. At most 64 entries each."""
    steps = F.sort_array(F.collect_list(F.struct("rank", "ts")), asc=False)
    return sketch.groupBy(*keys, "bucket").agg(steps.alias("staircase"))


def batch_quality(placed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: edges, replication factor and relative standard deviation of the loads, in percent."""
    nodes = placed.select(batch, "part", F.explode(F.array("src", "dst")).alias("id")).distinct()
    rf = nodes.groupBy(batch, "id").agg(F.count("*").alias("r")).groupBy(batch).agg(F.round(F.sum("r") / F.count("*"), 2).alias("replication_factor"))
    load = placed.groupBy(batch, "part").agg(F.count("*").alias("n")).groupBy(batch).agg(
        F.sum("n").alias("edges"), F.round(F.stddev_pop("n") * 100 / F.avg("n"), 6).alias("relative_sd"))
    return load.join(rf, batch)
