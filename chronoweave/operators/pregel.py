"""Vertex programs as rounds of joins and aggregates.

A round joins edges with the state of their ends, turns every triplet into messages, combines messages
per target, and applies the combined message to the receivers. Edges fire only where the wanted end
received a message in the round before. The loop ends when no message is left or the rounds are used up.
Edges are laid out once by the end whose state they meet first, and stay there for all rounds, so that a round
shuffles state and messages only. State is held by the executors and written to shared storage every
``WRITE_EVERY`` rounds: plans stay short, and a lost executor costs those rounds at most. Tables of earlier
rounds are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize, materialize_counting, release

WRITE_EVERY = 5


def pregel(
    vertices: DataFrame,
    edges: DataFrame,
    send: list[tuple[str, Column, Column]],
    combine: Callable[[Column], Column],
    apply: dict[str, Column],
    active: str = "either",
    max_iter: int = 20,
    otherwise: dict[str, Column] | None = None,
    ends: tuple[str, ...] = ("src", "dst"),
) -> DataFrame:
    """Runs a vertex program.

    vertices: id and state columns, the initial message applied already.
    edges: src, dst and any edge columns.
    send: (target end "src" or "dst", condition, message) over src_<state>, dst_<state> and edge columns.
    combine: the aggregate of the messages to a vertex.
    apply: new values of state columns at receivers, over the state columns and `msg`.
    active: which end must have received a message for an edge to fire: out, in, either, both or any.
    otherwise: new values at vertices without a message (kept as they are by default).
    ends: the ends whose state the conditions and messages of send read.
    """
    if max_iter <= 0:
        raise ValueError("max_iter must be over 0")
    spark = vertices.sparkSession
    names = [c for c in vertices.columns if c != "id"]
    needed = sorted(set(ends) | {"out": {"src"}, "in": {"dst"}, "any": set()}.get(active, {"src", "dst"}))
    edges = materialize(spark, edges, "edges")
    laid = edges
    if needed:
        # As many parts as a join has: the join then takes the edges as they lie.
        by = needed[-1]
        laid = edges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by).persist(StorageLevel.MEMORY_AND_DISK)
    state = written = materialize(spark, vertices.withColumn("_active", F.lit(True)), "state")
    held: list[DataFrame] = []
    fires = {
        "out": F.col("src__active"), "in": F.col("dst__active"), "any": F.lit(True),
        "either": F.col("src__active") | F.col("dst__active"), "both": F.col("src__active") & F.col("dst__active"),
    }[active]
    for k in range(1, max_iter + 1):
        triplets = laid
        for side in reversed(needed):
            end = state.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in [*names, "_active"]])
            triplets = triplets.join(end, side)
        parts = F.array(*[F.when(condition, F.struct(F.col(to).alias("target"), message.alias("m"))) for to, condition, message in send])
        messages = triplets.where(fires).select(F.explode(parts).alias("p")).where("p is not null")
        messages = messages.groupBy(F.col("p.target").alias("id")).agg(combine(F.col("p.m")).alias("msg"))
        got = F.col("msg").isNotNull()
        rest = otherwise or {}
        joined = state.drop("_active").join(messages, "id", "left")
        new = joined.select("id", *[F.when(got, apply.get(c, F.col(c))).otherwise(rest.get(c, F.col(c))).alias(c) for c in names], got.alias("_active"))
        if k % WRITE_EVERY == 0:
            state, receivers = materialize_counting(spark, new, "state", F.col("_active"))
            for old in held:
                old.unpersist()
            held = []
            release(spark, written)
            written = state
        else:
            state = new.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(state)
            receivers = state.where("_active").count()
        if not receivers:
            break
    done = materialize(spark, state.drop("_active"), "state")
    for old in [*held, laid]:
        old.unpersist()
    release(spark, written)
    release(spark, edges)
    return done
