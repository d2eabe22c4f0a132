"""Run metrics: stages of an event log, phases, skew counters, best of several runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1024 * 1024
REMOTE_READ = "internal.metrics.shuffle.read.remoteBytesRead"

#: Call sites by which stages of an iterative job are told apart, and their phases.
PHASES = (
    ("mapReduceTriplets", "send"), ("aggregateMessages", "merge"), ("joinVertices", "vertex program"),
    ("shipVertexAttributes", "ship"), ("partitionBy", "partition"), ("mapVertices", "initialise"), ("count", "materialise"),
)


def phase(name: Column) -> Column:
    out = F.lit("other")
    for text, label in reversed(PHASES):
        out = F.when(name.contains(text), label).otherwise(out)
    return out


def read_stages(spark: SparkSession, path: str) -> DataFrame:
    """stage_id, name, phase, tasks, ms and accumulables of the stages that an event log has completed."""
    accumulable = "array<struct<`Name`: string, `Value`: string>>"
    schema = f"Event string, `Stage Info` struct<`Stage ID`: bigint, `Stage Name`: string, `Number of Tasks`: bigint, `Submission Time`: bigint, `Completion Time`: bigint, `Accumulables`: {accumulable}>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("e")).where("e.Event = 'SparkListenerStageCompleted'")
    info = "e.`Stage Info`"
    return rows.select(
        F.col(f"{info}.`Stage ID`").alias("stage_id"), F.col(f"{info}.`Stage Name`").alias("name"), phase(F.col(f"{info}.`Stage Name`")).alias("phase"),
        F.col(f"{info}.`Number of Tasks`").alias("tasks"), (F.col(f"{info}.`Completion Time`") - F.col(f"{info}.`Submission Time`")).alias("ms"),
        F.col(f"{info}.Accumulables").alias("accumulables"),
    )


def metric(accumulables: Column, name: str) -> Column:
    """The sum of a named metric's values among a stage's accumulables."""
    named = F.filter(accumulables, lambda a: a["Name"] == name)
    return F.aggregate(named, F.lit(0).cast("long"), lambda t, a: t + F.coalesce(a["Value"].try_cast("bigint"), F.lit(0)))


#: The columns of the stage counters, and the metrics of Spark's event log that fill them.
COUNTERS = (
    "StageId", "StageName", "vpCounter", "sendCounter", "mergeCounter", "executorRunTime", "executorDeserializeTime", "jvmGCTime",
    "remoteBytesRead", "remoteBlocksFetched", "fetchWaitTime", "localBlocksFetched", "localBytesRead", "recordsRead",
    "bytesWritten", "writeTime", "recordsWritten", "inputbytesRead", "inputRecordsRead", "outputBytesWritten", "outputRecordsWritten", "stageTime",
)
METRICS = {
    "executorRunTime": "executorRunTime", "executorDeserializeTime": "executorDeserializeTime", "jvmGCTime": "jvmGCTime",
    "remoteBytesRead": "shuffle.read.remoteBytesRead", "remoteBlocksFetched": "shuffle.read.remoteBlocksFetched",
    "fetchWaitTime": "shuffle.read.fetchWaitTime", "localBlocksFetched": "shuffle.read.localBlocksFetched",
    "localBytesRead": "shuffle.read.localBytesRead", "recordsRead": "shuffle.read.recordsRead",
    "bytesWritten": "shuffle.write.bytesWritten", "writeTime": "shuffle.write.writeTime", "recordsWritten": "shuffle.write.recordsWritten",
    "inputbytesRead": "input.bytesRead", "inputRecordsRead": "input.recordsRead",
    "outputBytesWritten": "output.bytesWritten", "outputRecordsWritten": "output.recordsWritten",
}


def stage_counters(stages: DataFrame, counters: tuple[str, str, str] = ("vpCounter", "sendCounter", "mergeCounter")) -> DataFrame:
    """One row of 22 columns per stage: its counters, by the names of three accumulators, its metrics and its time."""
    named = dict(zip(("vpCounter", "sendCounter", "mergeCounter"), counters)) | {c: f"internal.metrics.{m}" for c, m in METRICS.items()}
    fixed = {"StageId": F.col("stage_id"), "StageName": F.col("name"), "stageTime": F.col("ms")}
    return stages.select(*[fixed.get(c, metric(F.col("accumulables"), named.get(c, ""))).alias(c) for c in COUNTERS])


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Stage counters from comma-separated lines; the header, and lines without exactly 22 fields, are left out."""
    cells = F.split("value", ",")
    rows = spark.read.text(path).where((F.size(cells) == len(COUNTERS)) & (F.trim(cells[0]) != COUNTERS[0])).select(cells.alias("c"))
    text = {"StageName"}
    return rows.select(*[(F.trim(F.col("c")[k]) if c in text else F.trim(F.col("c")[k]).try_cast("bigint")).alias(c) for k, c in enumerate(COUNTERS)])


def stage_detail(stages: DataFrame) -> DataFrame:
    """phase, stage_id, ms in the order of phases and stages."""
    return stages.select("phase", "stage_id", "ms").orderBy("phase", "stage_id")


def job_detail(spark: SparkSession, path: str) -> DataFrame:
    """job_id, name, ms, end, start, stage_ids of the jobs that an event log has from start to end."""
    schema = "Event string, `Job ID` bigint, `Submission Time` bigint, `Completion Time` bigint, `Stage Infos` array<struct<`Stage ID`: bigint, `Stage Name`: string>>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("e")).select("e.*")
    infos = F.col("Stage Infos")
    begun = rows.where("Event = 'SparkListenerJobStart'").select(
        F.col("Job ID").alias("job_id"), F.col("Submission Time").alias("start"), F.get(F.array_sort(infos), F.size(infos) - 1)["Stage Name"].alias("name"),
        F.array_sort(F.transform(infos, lambda x: x["Stage ID"])).alias("stage_ids"))
    ended = rows.where("Event = 'SparkListenerJobEnd'").select(F.col("Job ID").alias("job_id"), F.col("Completion Time").alias("end"))
    return begun.join(ended, "job_id").select("job_id", "name", (F.col("end") - F.col("start")).alias("ms"), "end", "start", "stage_ids")


def shuffle_mb(stages: DataFrame) -> DataFrame:
    """phase, stages, remote_mb: whole megabytes read from other machines, by phase."""
    rows = stages.withColumn("bytes", metric(F.col("accumulables"), REMOTE_READ))
    return rows.groupBy("phase").agg(F.count("*").alias("stages"), F.floor(F.sum("bytes") / MB).alias("remote_mb"))


def event_metrics(events: DataFrame) -> DataFrame:
    """The same kind of summary over rows with a JSON bag: kind, n, k_sum, whole thousands, slowest event."""
    rows = events.withColumn("k", F.from_json("props", "k long")["k"])
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.floor(F.sum("k") / 1000).cast("long").alias("k_thousands"),
        F.max_by("event_id", F.struct("value", F.negate("event_id"))).alias("slowest"))


def task_skew(rows: DataFrame, part: Column, counter: Column) -> DataFrame:
    """n, total and the largest sum of a counter in one part."""
    per = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(counter).alias("s"))
    return per.agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.max("s").alias("largest"))


def best_rows(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The whole row of the least time for each key, the least tie column of equals."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(time, tie)).alias("r")).select(*keys, "r.*")


def best_run(rows: DataFrame, keys: list[str], time: str, partition_time: str) -> DataFrame:
    """The least time and, divided by five in whole numbers, the least partition time for each key."""
    return rows.groupBy(*keys).agg(F.min(time).alias("time"), F.floor(F.min(partition_time) / 5).cast("long").alias("partition_time"))


def parse_run_log(lines: DataFrame) -> DataFrame:
    """file, partitioner, algorithm, time, partition_time from records of six lines (seq, value): input and
    partitioner, partition time, algorithm and time, and three that are not used."""
    rows = lines.withColumns({"record": F.floor((F.col("seq") - 1) / 6), "line": (F.col("seq") - 1) % 6})
    pick = lambda k: F.max(F.when(F.col("line") == k, F.col("value")))
    one = rows.groupBy("record").agg(pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("c"))
    number = lambda c: F.regexp_extract(c, "([0-9]+)\\s*$", 1).try_cast("bigint")
    return one.select(
        F.regexp_extract("a", "input File:(.*?) partitioner:", 1).alias("file"), F.trim(F.regexp_extract("a", "partitioner:(.*)$", 1)).alias("partitioner"),
        F.regexp_extract("c", "^(\\S+) time", 1).alias("algorithm"), number("c").alias("time"), number("b").alias("partition_time"))
