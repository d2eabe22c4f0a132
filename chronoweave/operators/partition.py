"""Assigning edges and vertices to partitions, and how good an assignment is.

Stateless strategies are column expressions over an edge and a statistic of its ends. Greedy ones place
edges one after another and depend on all earlier placements: they run over blocks of arrival order, each
with a state of its own, as several loaders would; within a block they are the sequential algorithm.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import home, spread, spread_pair
from ..sources.edges import with_seq
from ..sources.storage import materialize
from .edges import activity, degree_undirected, endpoints, running
from .profile import summaries, window_sizes

#: Edges or vertices that one task places at most.
BLOCK = 1_000_000


def hash_strategy(name: str, parts: int, seed: int = 11) -> Column:
    """random, canonical, source, grid, one or hashing, over src and dst."""
    src, dst = F.col("src"), F.col("dst")
    if name in ("RandomVertexCut", "Hashing"):
        part = spread_pair(src, dst, seed if name == "Hashing" else 11) % parts
    elif name == "CanonicalRandomVertexCut":
        part = spread_pair(F.least(src, dst), F.greatest(src, dst)) % parts
    elif name == "EdgePartition1D":
        part = spread(src) % parts
    elif name == "EdgePartition2D":
        side = math.ceil(math.sqrt(parts))
        part = ((spread(src) % side) * side + spread(dst) % side) % parts
    elif name == "ONLYONE":
        part = F.lit(0)
    else:
        raise ValueError(f"unknown strategy {name}")
    return part.cast("int")


def with_statistic(edges: DataFrame, stat: DataFrame, column: str, name: str) -> DataFrame:
    """Adds s_<name> and d_<name>, 0 where a vertex has none."""
    for end, prefix in (("src", "s"), ("dst", "d")):
        one = stat.select(F.col("id").alias(end), F.col(column).alias("_v"))
        edges = edges.join(one, end, "left").withColumn(f"{prefix}_{name}", F.coalesce("_v", F.lit(0))).drop("_v")
    return edges


def with_statistics(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds s_<name> and d_<name> for every statistic of a table by id, with one join for each end."""
    names = [c for c in stats.columns if c != "id"]
    for end, prefix in (("src", "s"), ("dst", "d")):
        one = stats.select(F.col("id").alias(end), *[F.col(c).alias(f"_{c}") for c in names])
        edges = edges.join(one, end, "left").withColumns({f"{prefix}_{c}": F.coalesce(f"_{c}", F.lit(0)) for c in names}).drop(*[f"_{c}" for c in names])
    return edges


def lower_end(name: str, parts: int) -> Column:
    """The end with the lower statistic decides; the destination on a tie."""
    return F.when(F.col(f"s_{name}") < F.col(f"d_{name}"), home(F.col("src"), parts)).otherwise(home(F.col("dst"), parts))


def higher_end(name: str, parts: int) -> Column:
    return F.when(F.col(f"s_{name}") > F.col(f"d_{name}"), home(F.col("src"), parts)).otherwise(home(F.col("dst"), parts))


def by_updates(parts: int, kind: str = "higher") -> Column:
    """The end with more (kind lower: fewer; advanced: updates times replicas more) updates decides, and
    the lower degree on a tie."""
    weigh = {"advanced": lambda p: F.col(f"{p}_updates") * F.col(f"{p}_replicas")}.get(kind, lambda p: F.col(f"{p}_updates"))
    s, d = weigh("s"), weigh("d")
    if kind == "lower":
        s, d = -s, -d
    src, dst = home(F.col("src"), parts), home(F.col("dst"), parts)
    return F.when(s > d, src).when(s < d, dst).otherwise(lower_end("degree", parts))


def replicated_end(parts: int) -> tuple[Column, Column]:
    """For the advanced update rule: the vertex that is replicated by a placement, and the part."""
    part = by_updates(parts, "advanced")
    s, d = (F.col(f"{p}_updates") * F.col(f"{p}_replicas") for p in "sd")
    source = (s > d) | ((s == d) & (F.col("s_degree") < F.col("d_degree")))
    return F.when(source, F.col("dst")).otherwise(F.col("src")), part


def vertex_part(assigned: DataFrame, ids: DataFrame, parts: int) -> DataFrame:
    """id, part: as assigned, or by hash where a vertex is not."""
    return ids.join(assigned, "id", "left").select("id", F.coalesce("part", F.pmod("id", F.lit(parts)).cast("int")).alias("part"))


def lookup(edges: DataFrame, placed: DataFrame, parts: int) -> DataFrame:
    """Edges with the part of an earlier assignment, or one by hash where they have none."""
    known = placed.groupBy("src", "dst").agg(F.min("part").alias("_part"))
    rows = edges.join(known, ["src", "dst"], "left")
    return rows.withColumn("part", F.coalesce("_part", hash_strategy("Hashing", parts))).drop("_part")


# Greedy strategies.

def _greedy(kind: str, parts: int, balance: float, sizes: list[int]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Places a block, given the vertices held by each part and the earlier parts and counts of the block's vertices."""
    def place(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("seq")
        held = list(sizes)
        count: dict[int, int] = dict(zip(known["id"].tolist(), known["count"].tolist()))
        where: dict[int, set[int]] = {x: set(ps) for x, ps in zip(known["id"].tolist(), known["parts"])}
        chosen = []
        for src, dst, fresh in zip(block["src"].tolist(), block["dst"].tolist(), block["fresh"].tolist()):
            if kind == "hdrf":
                # degree so far, plus one
                d = [count.get(x, 0) + 1 for x in (src, dst)]
            elif kind == "hurl":
                d = [count.get(x, 0) + 2 for x in (src, dst)]
            else:
                for x in (src, dst):
                    count[x] = count.get(x, 0) + 1
                d = [count[x] for x in (src, dst)]
            share = d[0] / (d[0] + d[1])
            most, least = max(held), min(held)
            score = [balance * (most - s) / (1 + most - least) for s in held]
            for x, theta in ((src, share), (dst, 1 - share)):
                bonus = {"hdrf": 1 + (1 - theta), "hurl": 1 + theta, "babh": 1 + (1 + theta)}[kind]
                for p in where.get(x, ()):
                    score[p] += bonus
            p = max(range(parts), key=lambda k: (score[k], -k))
            chosen.append(p)
            for x in (src, dst):
                mine = where.setdefault(x, set())
                if p not in mine:
                    mine.add(p)
                    held[p] += 1
            if kind == "hurl":
                for x in (src, dst):
                    count[x] = count.get(x, 0) + 1
            elif kind == "hdrf" and fresh:
                for x in {src, dst}:
                    count[x] = count.get(x, 0) + 1
        return block.assign(part=pd.Series(chosen, index=block.index, dtype="int32"))[["seq", "src", "dst", "part", "fresh"]]

    return place


def greedy(edges: DataFrame, kind: str, parts: int, balance: float = 1.0, block: int = BLOCK) -> DataFrame:
    """seq, src, dst, part by hdrf, hurl or babh scoring in arrival order."""
    if kind not in ("hdrf", "hurl", "babh"):
        raise ValueError(f"unknown strategy {kind}")
    spark = edges.sparkSession
    rows = edges.select("seq", "src", "dst", F.floor((F.col("seq") - 1) / block).alias("block"))
    # hdrf counts distinct neighbours: an edge adds one if it is the first between its ends.
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("seq")
    rows = rows.withColumn("fresh", F.row_number().over(pair) == 1 if kind == "hdrf" else F.lit(True))
    rows = materialize(spark, rows, "arrivals")
    state = spark.createDataFrame([], "id long, parts array<int>, count long")
    ends = F.array("src", "dst")
    done, sizes = [], [0] * parts
    # One number for each block.
    numbers = sorted(r.block for r in rows.select("block").distinct().collect())
    for k in numbers:
        now = rows.where(F.col("block") == k)
        known = state.join(now.select(F.explode(ends).alias("id")).distinct(), "id", "left_semi").withColumn("block", F.lit(k))
        placed = now.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
            _greedy(kind, parts, balance, sizes), "seq long, src long, dst long, part int, fresh boolean")
        placed = materialize(spark, placed, "placed")
        done.append(placed.select("seq", "src", "dst", "part"))
        if k == numbers[-1]:
            break
        counted = F.array_distinct(ends) if kind == "hdrf" else ends
        more = placed.where("fresh").select(F.explode(counted).alias("id")).groupBy("id").agg(F.count("*").alias("count"))
        at = placed.select(F.explode(ends).alias("id"), "part").groupBy("id").agg(F.collect_set("part").alias("parts"))
        news = at.join(more, "id", "left").select("id", "parts", F.coalesce("count", F.lit(0)).alias("count"))
        both = state.unionByName(news).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts"), F.sum("count").alias("count"))
        state = materialize(spark, both, "vertices")
        found = dict(state.select(F.explode("parts").alias("part")).groupBy("part").count().collect())
        sizes = [found.get(p, 0) for p in range(parts)]
    return reduce(DataFrame.unionByName, done) if done else rows.select("seq", "src", "dst", F.lit(0).alias("part"))


def least_load(degrees: DataFrame, parts: int, block: int = BLOCK) -> DataFrame:
    """id, part: vertices in id order, each to the part with the least sum of degree + 1 so far."""
    def placer(before: list[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def place(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("seq")
            load = list(before)
            chosen = []
            for d in rows["degree"].tolist():
                p = min(range(parts), key=lambda k: (load[k], k))
                load[p] += d + 1
                chosen.append(p)
            return rows.assign(part=pd.Series(chosen, index=rows.index, dtype="int32"))[["id", "part", "degree"]]

        return place

    spark = degrees.sparkSession
    rows = with_seq(degrees.select("id", "degree"), "id").withColumn("block", F.floor((F.col("seq") - 1) / block))
    rows = materialize(spark, rows.select("seq", "id", "degree", "block"), "arrivals")
    done, load = [], [0] * parts
    numbers = sorted(r.block for r in rows.select("block").distinct().collect())
    for k in numbers:
        placed = rows.where(F.col("block") == k).groupBy("block").applyInPandas(placer(load), "id long, part int, degree long")
        placed = materialize(spark, placed, "placed")
        done.append(placed.select("id", "part"))
        if k == numbers[-1]:
            break
        added = dict(placed.groupBy("part").agg(F.sum(F.col("degree") + 1)).collect())
        load = [x + added.get(p, 0) for p, x in enumerate(load)]
    return reduce(DataFrame.unionByName, done) if done else rows.select("id", F.lit(0).alias("part"))


# Quality.

def partition_nodes(placed: DataFrame) -> DataFrame:
    """part, id: the vertices that each part holds."""
    return endpoints(placed.select("src", "dst", "part")).select("part", "id").distinct()


def replicas(placed: DataFrame) -> DataFrame:
    return partition_nodes(placed).groupBy("id").agg(F.count("*").alias("replicas"))


def replication_factor(placed: DataFrame) -> DataFrame:
    """rf: parts per vertex on average."""
    return replicas(placed).agg(F.round(F.sum("replicas") / F.count("*"), 2).alias("rf"))


def replication_factor_weighted(placed: DataFrame) -> DataFrame:
    """rft: parts per vertex, weighted by activity."""
    rows = replicas(placed).join(activity(placed), "id")
    return rows.agg(F.round(F.sum(F.col("replicas") * F.col("activity")) / F.sum("activity"), 2).alias("rft"))


def loads(placed: DataFrame) -> DataFrame:
    return placed.groupBy("part").agg(F.count("*").alias("edges"))


def load_rsd(load: DataFrame, column: str = "edges") -> DataFrame:
    """mean, sd and relative sd in percent of the loads, over the population."""
    sd, mean = F.stddev_pop(column), F.avg(column)
    return load.agg(F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"), F.round(sd * 100 / mean, 6).alias("rsd"))


#: The rules that offline_quality evaluates: the running statistic and the end that decides, or None for a
#: strategy that needs no statistic.
OFFLINE = {
    "DBH": ("degree", lower_end), "ABH": ("activity", lower_end), "ReverseABH": ("activity", higher_end),
    "CanonicalRandomVertexCut": None, "RandomVertexCut": None, "HDRF": None, "HURL": None, "BABH": None,
}


def offline_placements(edges: DataFrame, parts: int, strategy: str) -> DataFrame:
    """seq, src, dst, part of edges placed in arrival order, by the statistics as they stand at their arrival."""
    if strategy not in OFFLINE:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy in ("HDRF", "HURL", "BABH"):
        return greedy(edges, strategy.lower(), parts)
    rows = edges.select("seq", "src", "dst")
    if OFFLINE[strategy] is None:
        return rows.withColumn("part", hash_strategy(strategy, parts))
    statistic, decides = OFFLINE[strategy]
    now = running(edges)
    for end, prefix in (("src", "s"), ("dst", "d")):
        rows = rows.join(now.select("seq", F.col("id").alias(end), F.col(statistic).alias(f"{prefix}_now")), ["seq", end])
    return rows.withColumn("part", decides("now", parts)).select("seq", "src", "dst", "part")


def _sums(rows: DataFrame, keys: list[str], by: str, *columns: str) -> DataFrame:
    """Running sums of columns in the order of ``by``, within the keys."""
    upto = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.sum(c).over(upto) for c in columns})


def offline_quality(edges: DataFrame, parts: int, batch: int, strategy: str = "DBH", stop: int | None = None) -> DataFrame:
    """count, rf, rft, min_load, max_load after every ``batch`` edges, or up to ``stop`` of them, when each edge goes by
    the strategy at its arrival; of equal edges the last placement holds.

    A placement is two changes, one where it begins to hold and one where it ends; all figures are running sums
    of changes, so the rows are in proportion to the edges, whatever the number of batches."""
    spark = edges.sparkSession
    if stop is not None:
        edges = edges.where(F.col("seq") <= stop)
    rows = materialize(spark, offline_placements(edges, parts, strategy), "placements")
    total = rows.agg(F.max("seq")).first()[0] or 0
    last = total // batch
    until = F.lead("seq").over(Window.partitionBy("src", "dst").orderBy("seq"))
    spans = rows.withColumn("until", until).select(
        "src", "dst", "part", F.ceil(F.col("seq") / batch).alias("first"),
        F.when(F.col("until").isNull(), last + 1).otherwise(F.ceil(F.col("until") / batch)).alias("end"))
    changes = spans.where("first < end").select("src", "dst", "part", F.inline(F.array(
        F.struct(F.col("first").alias("k"), F.lit(1).alias("d")), F.struct(F.col("end").alias("k"), F.lit(-1).alias("d")))))
    changes = materialize(spark, changes.where(F.col("k") <= last), "changes")
    # A part holds a vertex from the first to the last of its edges there.
    held = endpoints(changes.select("src", "dst", "part", "k", "d")).groupBy("part", "id", "k").agg(F.sum("d").alias("n"))
    held = _sums(held, ["part", "id"], "k", "n").withColumn("there", (F.col("n") > 0).cast("int"))
    before = F.lag("there", 1, 0).over(Window.partitionBy("part", "id").orderBy("k"))
    replicas = held.withColumn("r", F.col("there") - before).where("r <> 0").select("id", "k", "r", F.lit(0).alias("a"))
    seen = endpoints(rows.select("src", "dst", F.ceil(F.col("seq") / batch).alias("k"))).where(F.col("k") <= last)
    seen = seen.select("id", "k", F.lit(0).alias("r"), F.lit(1).alias("a"))
    by_vertex = replicas.unionByName(seen).groupBy("id", "k").agg(F.sum("r").alias("r"), F.sum("a").alias("a"))
    now = _sums(by_vertex, ["id"], "k", "r", "a").select("id", "k", "r", "a", (F.col("r") * F.col("a")).alias("ra"), (F.col("r") > 0).cast("long").alias("v"))
    ordered = Window.partitionBy("id").orderBy("k")
    moved = now.select("k", *[(F.col(c) - F.lag(c, 1, 0).over(ordered)).alias(c) for c in ("r", "a", "ra", "v")])
    batches = spark.range(1, last + 1).withColumnRenamed("id", "k")
    figures = batches.join(moved.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("r", "a", "ra", "v")]), "k", "left").fillna(0)
    # One row for each batch from here on.
    figures = _sums(figures, [], "k", "r", "a", "ra", "v")
    load = changes.groupBy("k", "part").agg(F.sum("d").alias("n"))
    load = batches.crossJoin(F.broadcast(spark.range(parts).select(F.col("id").cast("int").alias("part")))).join(load, ["k", "part"], "left").fillna(0)
    load = _sums(load, ["part"], "k", "n").where("n > 0").groupBy("k").agg(F.min("n").alias("min_load"), F.max("n").alias("max_load"))
    return figures.join(load, "k").select(
        (F.col("k") * batch).alias("count"), F.round(F.col("r") / F.col("v"), 2).alias("rf"), F.round(F.col("ra") / F.col("a"), 2).alias("rft"), "min_load", "max_load")


# Strategies by name.

def _stat(statistic, column: str, rule) -> Callable[[DataFrame, int], DataFrame]:
    return lambda edges, parts: with_statistic(edges, statistic(edges), column, column).withColumn("part", rule(column, parts))


def with_updates(edges: DataFrame, parts: int) -> DataFrame:
    """Adds degree, updates (rounds in which the profile of three hops changes) and replicas (in EdgePartition2D) of
    both ends, as by_updates takes them. The statistics are joined by vertex, so edges are moved twice, not six times."""
    first = edges.withColumn("part", hash_strategy("EdgePartition2D", parts))
    stats = degree_undirected(edges).join(summaries(edges, 3).select("id", "updates"), "id", "left").join(replicas(first), "id", "left")
    return with_statistics(edges, materialize(edges.sparkSession, stats.select("id", "degree", "updates", "replicas"), "statistics"))


def _by_updates(kind: str) -> Callable[[DataFrame, int], DataFrame]:
    return lambda edges, parts: with_updates(edges, parts).withColumn("part", by_updates(parts, kind))


def _greedily(kind: str) -> Callable[[DataFrame, int], DataFrame]:
    return lambda edges, parts: edges.join(greedy(edges, kind, parts).select("seq", "part"), "seq")


STRATEGIES: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    **{name: (lambda edges, parts, name=name: edges.withColumn("part", hash_strategy(name, parts)))
       for name in ("RandomVertexCut", "CanonicalRandomVertexCut", "EdgePartition1D", "EdgePartition2D", "Hashing", "ONLYONE")},
    "DBH": _stat(degree_undirected, "degree", lower_end),
    "iDBH": _stat(degree_undirected, "degree", lower_end),
    "ABH": _stat(activity, "activity", lower_end),
    "ReverseABH": _stat(activity, "activity", higher_end),
    "NPH": _stat(lambda edges: window_sizes(edges, 3), "size", lower_end),
    "UBH": _by_updates("higher"), "UBHAdvanced": _by_updates("advanced"), "UBHReversed": _by_updates("lower"),
    "HDRF": _greedily("hdrf"), "HURL": _greedily("hurl"), "BABH": _greedily("babh"),
}


def place(edges: DataFrame, strategy: str, parts: int) -> DataFrame:
    """The edges with ``part`` by a strategy's name; seq is wanted by the greedy ones. Null ends have no place:
    such edges are left out."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    whole = edges.where("src is not null and dst is not null")
    return STRATEGIES[strategy](whole, parts).select(*edges.columns, "part")


def lay_out(placed: DataFrame, parts: int) -> DataFrame:
    """The rows dealt out by their placement: partition k holds the rows of part k."""
    return placed.repartitionById(parts, F.col("part"))
