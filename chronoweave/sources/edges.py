"""Edge streams: files of `src,dst,ts` lines, and graphs derived from relational tables.

An edge row is (seq, src, dst, ts): seq is the place in arrival order, ts whole seconds or any long.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.hashing import spread

EDGE = StructType([StructField("src", LongType()), StructField("dst", LongType()), StructField("ts", LongType())])


#: The keys of a properties file, and the settings that they are.
KEYS = {
    "number_of_bucket": "buckets", "distance": "hops", "batch": "batch", "partition": "partitions", "inputfile": "input", "outputFile": "output",
    "folder": "folder", "writeResult": "write_result", "partionStrategy": "strategy", "hdrfLambda": "balance",
    "getReplicationFactor": "report_replication", "useVertexPartitioner": "vertex_partitioner", "PR_Itteration": "max_iterations",
    "landmarkCount": "landmarks", "algo": "algorithm",
}


@dataclass
class JobConfig:
    """Settings of a run, with the defaults of the sample configuration."""

    hops: int = 3
    batch: int = -1
    partitions: int = 8
    buckets: int = 256
    landmarks: int = 50
    max_iterations: int = 1000
    tolerance: float = 1e-4
    balance: float = 1.0
    strategy: str = "EdgePartition2D"
    algorithm: str = "PR"
    input: str = ""
    output: str = ""
    folder: str = ""
    write_result: bool = False
    report_replication: bool = False
    vertex_partitioner: bool = False

    @classmethod
    def parse(cls, text: str, **overrides) -> JobConfig:
        """From `key=value` lines, keys as in KEYS or by the settings' own names; other keys are ignored, overrides win."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        for line in text.splitlines():
            key, eq, value = line.partition("=")
            name = KEYS.get(key.strip(), key.strip())
            if eq and not line.lstrip().startswith(("#", "!")) and name in kinds:
                value = value.strip()
                found[name] = value.lower() == "true" if kinds[name] is bool else kinds[name](value)
        return cls(**found | overrides)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Headerless comma-separated edges; a missing third column is time 0. Distributed: no order."""
    rows = spark.read.schema(EDGE).option("mode", "PERMISSIVE").csv(path)
    return rows.select("src", "dst", F.coalesce("ts", F.lit(0).cast("long")).alias("ts"))


def stream_edges(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EDGE).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """One folder of CSV files, as every result of the engine can be kept."""
    df.write.mode("overwrite").option("header", header).csv(path)


def normalize_delims(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.withColumn(column, F.translate(F.col(column), "\t ", ",,"))


def seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds since 1970 of a timestamp column, whatever the session's time zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")
    return F.unix_seconds(column)


def with_seq(df: DataFrame, *keys: str) -> DataFrame:
    """Adds seq, 1 for the first row in the order of the keys: rows are sorted by ranges, numbered within
    each, and moved by the lengths of the ranges before. Nothing passes through one task but those lengths."""
    from .storage import materialize

    spark = df.sparkSession
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(spark, rows, "ordered").withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(offsets, "_part").withColumn("seq", F.col("offset") + local + 1).drop("_id", "_part", "offset")


def repeat_edges(edges: DataFrame, every: int = 10) -> DataFrame:
    """Every ``every``-th edge is followed by a copy of an earlier one, drawn by a scatter of its place."""
    drawn = edges.where(F.col("seq") % every == 0).select(F.col("seq").alias("at"), (spread(F.col("seq")) % F.col("seq") + 1).alias("seq"))
    again = drawn.join(edges, "seq").select((F.col("at") * 2 + 1).alias("place"), "src", "dst", "ts")
    return edges.select((F.col("seq") * 2).alias("place"), "src", "dst", "ts").union(again)


# Graphs from the relational test tables.

def user_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, src, dst, ts: customers and what their orders point at."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.count("*").alias("n"))
    dst = (F.col("o_orderkey") * 7919 + 13) % F.col("n")
    return orders.crossJoin(F.broadcast(n)).select(
        (F.col("o_orderkey") + 1).alias("seq"), F.col("o_custkey").alias("src"), dst.alias("dst"), seconds(orders, "o_orderdate").cast("long").alias("ts"))


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, src, dst, ts: the users of neighbouring events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = events.select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("src"), F.floor(seconds(events, "ts")).alias("ts"))
    return one.join(events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("dst")), "seq").select("seq", "src", "dst", "ts")
