"""One query for each operator, over graphs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, sketch
from ..operators import algorithms, edges as eg, exports as ex, metrics, partition as pt, profile as pf, text as tx
from ..sources import edges as src
from ..streaming import profiles as st

PARTS = 8
BATCH = 5_000
BUCKETS = 64
#: Hashes of the oracle-checked sketches have 31 bits, so their top bit is marked at bit 31.
TOP_BIT = 31
HORIZON = 820_454_400  # 1996-01-01
SIM_N = 1_000


def _e1(spark: SparkSession, d: str) -> DataFrame:
    return eg.drop_self_loops(src.user_order(spark, d))


def _e1d(spark: SparkSession, d: str) -> DataFrame:
    return eg.dedup_max(_e1(spark, d))


def _halves(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    return eg.dedup_last(e.where("seq % 2 = 0")), eg.dedup_last(e.where("seq % 2 = 1"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    e = _e1d(spark, d)
    rows = pt.with_statistic(e, eg.degree_undirected(e), "degree", "degree")
    return rows.withColumn("part", pt.lower_end("degree", PARTS)).select("src", "dst", "part")


def _strategy(name: str):
    return lambda s, d: _e1d(s, d).withColumn("part", pt.hash_strategy(name, PARTS)).select("src", "dst", "part")


def _by(stat, column, rule):
    def query(s, d):
        e = _e1d(s, d)
        return pt.with_statistic(e, stat(s, d, e), column, column).withColumn("part", rule(column, PARTS)).select("src", "dst", "part")

    return query


def _updates(graph, kind: str):
    return lambda s, d: pt.with_updates(eg.dedup_max(graph(s, d)), PARTS).withColumn("part", pt.by_updates(PARTS, kind)).select("src", "dst", "part")


def _nph(e: DataFrame) -> DataFrame:
    e = eg.dedup_max(e)
    rows = pt.with_statistic(e, pf.window_sizes(e, 3), "size", "size")
    return rows.withColumn("part", pt.lower_end("size", PARTS)).select("src", "dst", "part")


def _greedy(kind: str):
    return lambda s, d: pt.greedy(_e1(s, d), kind, PARTS)


def _sketch(e: DataFrame, hops: int) -> DataFrame:
    return pf.approximate(e, hops, BUCKETS, hashing.spread(F.col("nbr")), TOP_BIT)


def _elements(s: SparkSession, d: str) -> DataFrame:
    """id, bucket, rank, ts of every edge end, before merging."""
    rows = eg.both_ways(_e1(s, d).select("src", "dst", "ts")).select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "ts")
    return pf.elements(rows, hashing.spread(F.col("nbr")), BUCKETS, TOP_BIT)


def _register_arrays(s: SparkSession, d: str) -> DataFrame:
    rows = pf.registers(_elements(s, d), None, "id")
    filled = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "register"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0)))
    return filled.select("id", at.alias("registers"))


def _hll_merge(s: SparkSession, d: str) -> DataFrame:
    rows = _register_arrays(s, d)
    other = rows.select((F.col("id") - 1).alias("id"), F.col("registers").alias("other"))
    both = rows.join(other, "id").select("id", sketch.merge_registers(F.col("registers"), F.col("other")).alias("r"))
    return both.select("id", sketch.estimate_registers(F.col("r"), BUCKETS).alias("estimate"))


def _toy(s: SparkSession, d: str) -> DataFrame:
    vertex = s.createDataFrame([(k, 0 if k == 0 else 2**31 - 1) for k in range(4)], "id long, length long")
    return algorithms.hop_lengths(vertex, s.createDataFrame([(0, 1), (1, 2), (0, 3)], "src long, dst long"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet")


def _normalize(s: SparkSession, d: str) -> DataFrame:
    return src.normalize_delims(_lines(s, d).select("p_partkey", F.concat_ws("\t", "p_name", "p_brand").alias("value")))


def _runs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderpriority").alias("file"), F.col("o_orderstatus").alias("algorithm"), F.col("o_orderkey").alias("run"),
        F.floor(F.col("o_totalprice") * 100).cast("long").alias("ms"), (F.col("o_custkey") * 37 % 1009).alias("partition_ms"))


def _task_skew(s: SparkSession, d: str) -> DataFrame:
    e = _placed(s, d)
    return metrics.task_skew(e, F.col("part"), F.col("src"))


def _stream_profile(s: SparkSession, e: DataFrame) -> DataFrame:
    """The state after four batches, without its dominated entries."""
    pairs, rows = st.empty_state(s)
    for k in range(4):
        pairs, rows = st.update(pairs, rows, e.where(F.col("seq") % 4 == k), 2)
    return st.undominated(rows)


OFFLINE_NAMES = {"abh": "ABH", "rabh": "ReverseABH", "crvc": "CanonicalRandomVertexCut", "rvc": "RandomVertexCut"}
PLACE_NAMES = {"dbh": "DBH", "rabh": "ReverseABH", "crvc": "CanonicalRandomVertexCut"}


def _layout(s: SparkSession, d: str) -> DataFrame:
    """part, edges, and how many of them lie in the partition of that number."""
    laid = pt.lay_out(pt.place(_e1(s, d), "CanonicalRandomVertexCut", PARTS), PARTS).withColumn("at", F.spark_partition_id())
    return laid.groupBy("part").agg(F.count("*").alias("edges"), F.count_if(F.col("at") == F.col("part")).alias("in_place"))


def _simulate(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return s.range(1, 31).select(F.col("id").alias("k")).select("k", F.round(sketch.register_probability(k, F.lit(SIM_N), BUCKETS), 9).alias("p"))


def queries() -> dict:
    return {
        "edge_replace": lambda s, d: eg.replace(*_halves(_e1(s, d))),
        "batch_touched_vertices": lambda s, d: eg.touched(*_halves(_e1(s, d))),
        "new_vertices": lambda s, d: eg.unseen(*_halves(_e1(s, d))),
        "batch_id": lambda s, d: eg.batches(src.with_seq(_e1(s, d).withColumnRenamed("seq", "arrival"), "arrival"), 100).select("seq", "src", "dst", "ts", "batch_id"),
        "connected_components": lambda s, d: algorithms.components(_e1(s, d)),
        "cc_capped": lambda s, d: algorithms.components_capped(_e1(s, d), 3),
        "cc_batches": lambda s, d: algorithms.components_by_batch(_e1(s, d), BATCH),
        "landmark_sample": lambda s, d: algorithms.landmarks(eg.vertices(_e1(s, d)), 20),
        "shortest_paths": lambda s, d: algorithms.shortest_paths(_e1(s, d), algorithms.landmarks(eg.vertices(_e1(s, d)), 20), 20),
        "label_propagation": lambda s, d: algorithms.label_propagation(eg.dedup_max(_e1(s, d)), 3),
        "profile_exact": lambda s, d: pf.exact(_e1(s, d), 3),
        "profile_size": lambda s, d: pf.window_sizes(_e1(s, d), 3),
        "profile_output": lambda s, d: ex.vertex_output(pf.summaries(_e1(s, d), 3, HORIZON), eg.degree_undirected(_e1(s, d))),
        "landmark_maps": lambda s, d: ex.landmark_maps(algorithms.shortest_paths(_e1(s, d), algorithms.landmarks(eg.vertices(_e1(s, d)), 20), 20)).select(
            "id", F.size("distances").alias("landmarks"), F.array_max(F.map_values("distances")).alias("farthest")),
        "profile_window_exact": lambda s, d: pf.window_sizes(_e1(s, d), 3, HORIZON),
        "profile_window_approx": lambda s, d: pf.estimate(pf.merge_sketches(_sketch(_e1(s, d), 2), "id"), HORIZON, BUCKETS, "id"),
        "profile_approx": lambda s, d: _sketch(_e1(s, d), 3),
        "profile_stream": lambda s, d: _stream_profile(s, _e1(s, d)),
        "part_nph": lambda s, d: _nph(_e1(s, d)),
        "part_ubh": _updates(_e1, "higher"),
        "part_ubh_adv": _updates(_e1, "advanced"),
        "part_ubh_rev": _updates(_e1, "lower"),
        "edge_scan": lambda s, d: src.user_order(s, d),
        "event_pairs": lambda s, d: src.event_pairs(s, d),
        "drop_self_loops": lambda s, d: _e1(s, d),
        "canonical_edges": lambda s, d: eg.canonical(_e1(s, d)),
        "undirected_edges": lambda s, d: eg.both_ways(_e1(s, d).select("src", "dst", "ts")),
        "reverse_edges": lambda s, d: eg.reverse(_e1(s, d)),
        "edge_dedup_lww": lambda s, d: eg.dedup_last(_e1(s, d)),
        "edge_dedup_max": _e1d,
        "vertices": lambda s, d: eg.vertices(_e1(s, d)),
        "degree_undirected": lambda s, d: eg.degree_undirected(_e1(s, d)),
        "degree_out": lambda s, d: eg.degree_out(_e1(s, d)),
        "out_degrees": lambda s, d: eg.out_edges(_e1(s, d)),
        "node_activity": lambda s, d: eg.activity(_e1(s, d)),
        "running_activity": lambda s, d: eg.running(_e1(s, d)).select("seq", "id", "activity"),
        "running_degree": lambda s, d: eg.running(_e1(s, d)).select("seq", "id", "degree"),
        "edge_weights": lambda s, d: eg.weights(_e1d(s, d).select("src", "dst")).select("src", "dst", F.round("weight", 9).alias("weight")),
        "degree_predictor": lambda s, d: eg.predictor_tally(_e1(s, d)),
        "repeat_edges": lambda s, d: src.repeat_edges(src.user_order(s, d)),
        "pagerank": lambda s, d: algorithms.pagerank(_e1d(s, d), 1e-4).select("id", F.round("pr", 6).alias("pr")),
        "pagerank_coarse": lambda s, d: algorithms.pagerank(_e1d(s, d), 1e-2).select("id", F.round("pr", 6).alias("pr")),
        "pagerank_topk": lambda s, d: algorithms.top(algorithms.pagerank(eg.reverse(_e1d(s, d)), 1e-4).select("id", F.round("pr", 6).alias("pr"))),
        "toy_length": _toy,
        "batch_quality": lambda s, d: ex.batch_quality(eg.batches(_e1(s, d), BATCH).withColumn("part", pt.hash_strategy("EdgePartition2D", PARTS))),
        "part_lookup": lambda s, d: pt.lookup(_e1d(s, d), _placed(s, d).where("src % 3 = 0"), PARTS).select("src", "dst", "part"),
        "sliding_hll": lambda s, d: pf.merge_sketches(_elements(s, d), "id"),
        "sliding_hll_merge": lambda s, d: pf.merge_sketches(_elements(s, d).withColumn("id", F.col("id") % 100), "id"),
        "sliding_hll_prune": lambda s, d: pf.prune(pf.merge_sketches(_elements(s, d), "id"), "id"),
        "sliding_hll_estimate": lambda s, d: pf.estimate(pf.merge_sketches(_elements(s, d), "id"), HORIZON, BUCKETS, "id"),
        "hll_estimate": lambda s, d: _register_arrays(s, d).select("id", sketch.estimate_registers(F.col("registers"), BUCKETS).alias("estimate")),
        "hll_merge": _hll_merge,
        "hll_simulate": _simulate,
        "part_rvc": _strategy("RandomVertexCut"),
        "part_crvc": _strategy("CanonicalRandomVertexCut"),
        "part_1d": _strategy("EdgePartition1D"),
        "part_2d": _strategy("EdgePartition2D"),
        "part_hashing": lambda s, d: _e1d(s, d).withColumn("part", pt.hash_strategy("Hashing", PARTS, 97)).select("src", "dst", "part"),
        "part_one": _strategy("ONLYONE"),
        "part_dbh": _placed,
        "part_idbh": _by(lambda s, d, e: eg.degree_undirected(_e1(s, d)), "degree", pt.lower_end),
        "part_abh": _by(lambda s, d, e: eg.activity(_e1(s, d)), "activity", pt.lower_end),
        "part_rabh": _by(lambda s, d, e: eg.activity(_e1(s, d)), "activity", pt.higher_end),
        "part_hdrf": _greedy("hdrf"),
        "part_hurl": _greedy("hurl"),
        "part_babh": _greedy("babh"),
        "vertex_least_load": lambda s, d: pt.least_load(eg.degree_undirected(_e1(s, d)), PARTS),
        "replication_factor": lambda s, d: pt.replication_factor(_placed(s, d)),
        "replication_factor_weighted": lambda s, d: pt.replication_factor_weighted(_placed(s, d)),
        "partition_load": lambda s, d: pt.loads(_placed(s, d)),
        "partition_nodes": lambda s, d: pt.partition_nodes(_placed(s, d)),
        "load_rsd": lambda s, d: pt.load_rsd(pt.loads(_placed(s, d))),
        "offline_partition_quality": lambda s, d: pt.offline_quality(_e1(s, d), PARTS, BATCH),
        **{f"offline_quality_{short}": (lambda s, d, name=name: pt.offline_quality(_e1(s, d), PARTS, BATCH, name)) for short, name in OFFLINE_NAMES.items()},
        **{f"place_{short}": (lambda s, d, name=name: pt.place(_e1(s, d), name, PARTS).select("seq", "src", "dst", "part")) for short, name in PLACE_NAMES.items()},
        "layout_crvc": lambda s, d: _layout(s, d),
        "algorithm_cc": lambda s, d: algorithms.run(_e1(s, d), src.JobConfig.parse("algo=CC")),
        "algorithm_sp": lambda s, d: algorithms.run(_e1(s, d), src.JobConfig.parse("algo=SP\nlandmarkCount=20\nPR_Itteration=20")),
        "task_skew": _task_skew,
        "stage_metrics": lambda s, d: metrics.event_metrics(s.read.parquet(f"{d}/events.parquet")),
        "best_stage": lambda s, d: metrics.best_rows(_runs(s, d), ["file", "algorithm"], "ms", "run"),
        "best_job": lambda s, d: metrics.best_rows(_runs(s, d), ["file"], "ms", "run"),
        "best_run": lambda s, d: metrics.best_run(_runs(s, d), ["file", "algorithm"], "ms", "partition_ms"),
        "normalize_delims": _normalize,
        "tokenize": lambda s, d: tx.tokenize(_lines(s, d), "p_name"),
        "token_filter": lambda s, d: tx.longer_than(tx.tokenize(_lines(s, d), "p_name")),
        "token_top5": lambda s, d: tx.greatest(tx.longer_than(tx.tokenize(_lines(s, d), "p_name"))),
    }
