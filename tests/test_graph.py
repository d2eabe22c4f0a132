"""Micro graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import hashing, parsing, sketch
from chronoweave.operators import algorithms, edges as eg, exports as ex, metrics, partition as pt, profile as pf, text as tx
from chronoweave.sources import edges as src
from chronoweave.streaming import profiles as st

E = "src long, dst long"
ET = "seq long, src long, dst long, ts long"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([(1, 2), (1, 4), (2, 4), (3, 1), (3, 4)], E)


def test_five_edges(spark, five):
    assert rows(eg.out_edges(five)) == [(1, 2), (2, 1), (3, 2)]
    assert rows(eg.degree_undirected(five)) == [(1, 3), (2, 2), (3, 2), (4, 3)]
    assert rows(algorithms.components(five)) == [(k, 1) for k in (1, 2, 3, 4)]
    assert rows(algorithms.components_capped(five, 10)) == [(k, 1) for k in (1, 2, 3, 4)]
    ranks = {r.id: r.pr for r in algorithms.pagerank(five).collect()}
    assert ranks == pytest.approx({1: 0.21375, 2: 0.24084375, 3: 0.15, 4: 0.5093109375})
    marks = spark.createDataFrame([(4,), (2,)], "id long")
    assert rows(algorithms.shortest_paths(five, marks), "landmark", "id", "dist") == [(2, 1, 1), (2, 2, 0), (2, 3, 2), (4, 1, 1), (4, 2, 1), (4, 3, 1), (4, 4, 0)]


def test_property_graph_and_hop_length(spark):
    four = spark.createDataFrame([(3, 7), (5, 3), (2, 5), (5, 7)], E)
    assert {label for _, label in rows(algorithms.components(four))} == {2}
    vertex = spark.createDataFrame([(k, 0 if k == 0 else 2**31 - 1) for k in range(4)], "id long, length long")
    assert rows(algorithms.hop_lengths(vertex, spark.createDataFrame([(0, 1), (1, 2), (0, 3)], E))) == [(0, 0), (1, 1), (2, 2), (3, 1)]
    with pytest.raises(ValueError):
        algorithms.label_propagation(four, 0)


def test_loads(spark):
    load = spark.createDataFrame([(3655,), (4686,), (3243,), (4571,), (5685,)], "edges long")
    assert rows(pt.load_rsd(load)) == [(4368.0, 854.495875, 19.562634)]


def test_profiles(spark):
    path = spark.createDataFrame([(1, 1, 2, 10), (2, 2, 3, 5), (3, 3, 4, 20)], ET)
    p = pf.exact(path, 3)
    assert rows(p.where("id = 1"), "hop", "nbr", "ts") == [(1, 2, 10), (2, 3, 5), (3, 4, 5)]
    size = lambda w, **k: dict(rows(pf.sizes(p, w, **k))).get(1, 0)
    assert (size(0), size(5), size(5, inclusive=True), size(10)) == (3, 1, 3, 0)
    dominated = spark.createDataFrame([(1, 1, 2, 1), (2, 1, 3, 9), (3, 3, 2, 8)], ET)
    p = pf.exact(dominated, 2)
    assert rows(p.where("id = 1"), "hop", "nbr", "ts") == [(1, 2, 1), (1, 3, 9), (2, 2, 8)]
    assert dict(rows(pf.sizes(p, 5)))[1] == 2


def test_out_of_order_sketch(spark):
    sk = spark.createDataFrame([(0, 0, 5, 10), (0, 0, 3, 20), (0, 0, 4, 12), (0, 0, 2, 11)], "id long, bucket int, rank int, ts long")
    assert rows(pf.prune(sk, "id"), "rank", "ts") == [(3, 20), (4, 12), (5, 10)]
    at = lambda w: pf.registers(sk, w, "id").collect()[0].register
    assert (at(11), at(15), at(10)) == (4, 3, 5)


def test_sketch_merge_laws_and_accuracy(spark):
    rng = random.Random(2)
    data = [(1, rng.randrange(5000), rng.randrange(1000)) for _ in range(6000)]
    df = pf.elements(spark.createDataFrame(data, "id long, nbr long, ts long"), F.xxhash64("nbr"), 256)
    whole = pf.merge_sketches(df, "id")
    a, b = pf.merge_sketches(df.where("nbr % 3 = 0"), "id"), pf.merge_sketches(df.where("nbr % 3 <> 0"), "id")
    cols = ("bucket", "rank", "ts")
    assert rows(pf.merge_sketches(a.unionByName(b), "id"), *cols) == rows(pf.merge_sketches(b.unionByName(a).unionByName(a), "id"), *cols) == rows(whole, *cols)
    for w in (None, 500, 900):
        true = len({n for _, n, t in data if w is None or t >= w})
        got = pf.estimate(pf.prune(whole, "id"), w, 256, "id").collect()[0].estimate
        assert abs(got - true) < 3 * 1.04 / 16 * true


def test_registers(spark):
    df = spark.createDataFrame([([0] * 16, [1] * 16)], "a array<int>, b array<int>")
    r = df.select(sketch.estimate_registers(F.col("a"), 16).alias("e"), sketch.merge_registers(F.col("a"), F.col("b")).alias("m")).collect()[0]
    assert r.e == 0 and r.m == [1] * 16
    with pytest.raises(Exception, match="differ"):
        df.select(sketch.merge_registers(F.col("a"), F.slice("b", 1, 3)).alias("m")).collect()
    with pytest.raises(ValueError):
        hashing.rank_of(F.lit(1), 100)


def test_ranks_and_homes(spark):
    values = [0, 1, -1, 2**31, 2**32 + 5, -(2**63), 2**63 - 1, 12345]
    df = spark.createDataFrame([(v,) for v in values], "x long")

    def java(v):
        u = v & (2**64 - 1)
        h = (u ^ (u >> 32)) & 0xFFFFFFFF
        return h - 2**32 if h >= 2**31 else h

    for r in df.select("x", hashing.home(F.col("x"), 7).alias("h"), hashing.rank_of(F.col("x"), 16).alias("r")).collect():
        assert r.h == abs(java(r.x)) % 7
        rest = ((r.x & (2**64 - 1)) | 1 << 63) >> 4
        assert r.r == (rest & -rest).bit_length()


def test_dedup_and_loops(spark):
    e = spark.createDataFrame([(1, 1, 2, 5), (2, 1, 2, 3), (3, 2, 1, 9), (4, 4, 4, 1)], ET)
    kept = eg.drop_self_loops(e)
    assert rows(eg.dedup_last(kept)) == [(1, 2, 3), (2, 1, 9)] and rows(eg.dedup_max(kept)) == [(1, 2, 5), (2, 1, 9)]
    assert rows(eg.dedup_last(eg.canonical(kept))) == [(2, 1, 9)] and rows(eg.vertices(kept)) == [(1,), (2,)]


def greedy(edges, kind, parts):
    held, count, nbr, out = [set() for _ in range(parts)], {}, {}, []
    for s, d in edges:
        if kind == "babh":
            for x in (s, d):
                count[x] = count.get(x, 0) + 1
        deg = {"hdrf": lambda x: len(nbr.get(x, ())) + 1, "hurl": lambda x: count.get(x, 1) + 1, "babh": lambda x: count[x]}[kind]
        th = deg(s) / (deg(s) + deg(d))
        big, small = max(map(len, held)), min(map(len, held))
        def score(p):
            g = 0
            for x, t in ((s, th), (d, 1 - th)):
                g += (x in held[p]) * {"hdrf": 2 - t, "hurl": 1 + t, "babh": 2 + t}[kind]
            return g + (big - len(held[p])) / (1 + big - small)
        p = max(range(parts), key=lambda k: (round(score(k), 12), -k))
        out.append(p)
        held[p] |= {s, d}
        nbr.setdefault(s, set()).add(d)
        nbr.setdefault(d, set()).add(s)
        if kind == "hurl":
            for x in (s, d):
                count[x] = count.get(x, 1) + 1
    return out


@pytest.mark.parametrize("kind", ["hdrf", "hurl", "babh"])
def test_greedy(spark, kind):
    rng = random.Random(6)
    data = [(rng.randrange(30), rng.randrange(30)) for _ in range(300)]
    df = spark.createDataFrame([(k + 1, s, d, 0) for k, (s, d) in enumerate(data)], ET).repartition(3)
    placed = pt.greedy(df, kind, 4)
    assert [p for _, p in rows(placed, "seq", "part")] == greedy(data, kind, 4)
    assert placed.agg(F.count("*")).collect()[0][0] == 300
    assert pt.replication_factor(placed).collect()[0].rf >= 1
    with pytest.raises(ValueError):
        pt.greedy(df, "unknown", 4)
    with pytest.raises(ValueError):
        pt.hash_strategy("unknown", 4)


def test_least_load(spark):
    deg = spark.createDataFrame([(k, d) for k, d in enumerate([5, 1, 1, 9, 2, 2])], "id long, degree long")
    assert [p for _, p in rows(pt.least_load(deg, 2))] == [0, 1, 1, 1, 0, 0]
    assert rows(pt.vertex_part(spark.createDataFrame([(1, 3)], "id long, part int"), deg.where("id < 2").select("id"), 4)) == [(0, 0), (1, 3)]


def test_stream_is_batch_invariant(spark, tmp_path):
    rng = random.Random(8)
    data = [(k + 1, rng.randrange(12), rng.randrange(12), rng.randrange(100)) for k in range(60)]
    whole = spark.createDataFrame(data, ET)
    for k in range(3):
        spark.createDataFrame(data[k::3], ET).select("src", "dst", "ts").coalesce(1).write.csv(str(tmp_path / "in" / str(k)))
    (tmp_path / "flat").mkdir()
    for i, f in enumerate(sorted((tmp_path / "in").glob("*/part-*.csv"))):
        f.rename(tmp_path / "flat" / f"{i}.csv")
    kept = st.ProfileStream(spark, 2)
    kept.start(src.stream_edges(spark, str(tmp_path / "flat")), str(tmp_path / "check")).awaitTermination()
    assert rows(st.undominated(kept.profile)) == rows(pf.exact(whole, 2))
    query = st.activity_stream(src.stream_edges(spark, str(tmp_path / "flat"))).writeStream.format("memory").queryName("act").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("act")) == rows(eg.activity(whole))


def test_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text("1,2,3\n4,5\n")
    assert rows(src.read_edges(spark, str(tmp_path / "e.csv"))) == [(1, 2, 3), (4, 5, 0)]
    lines = spark.createDataFrame([("1\t2 3",)], "value string")
    assert rows(src.normalize_delims(lines)) == [("1,2,3",)]
    config = src.JobConfig.parse("# c\nhops=4\ntolerance = 0.01\nother=1", batch=5)
    assert (config.hops, config.tolerance, config.batch, config.buckets) == (4, 0.01, 5, 256)
    out = src.with_seq(spark.createDataFrame([(x,) for x in (30, 10, 20, 40)], "k long").repartition(3), "k")
    assert rows(out, "seq", "k") == [(1, 10), (2, 20), (3, 30), (4, 40)]
    src.write_csv(out, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 4
    assert rows(tx.greatest(tx.longer_than(tx.tokenize(spark.createDataFrame([("abcdef b ghijkl",)], "t string"), "t")), 1)) == [("ghijkl",)]


def test_metrics(spark, tmp_path):
    event = '{"Event":"SparkListenerStageCompleted","Stage Info":{"Stage ID":%d,"Stage Name":"%s at x","Number of Tasks":2,"Submission Time":10,"Completion Time":35,"Accumulables":[{"Name":"internal.metrics.shuffle.read.remoteBytesRead","Value":"3145728"}]}}'
    (tmp_path / "log").write_text("\n".join([event % (1, "joinVertices"), event % (2, "something"), '{"Event":"Other"}']))
    stages = metrics.read_stages(spark, str(tmp_path / "log"))
    assert rows(stages, "stage_id", "phase", "ms") == [(1, "vertex program", 25), (2, "other", 25)]
    assert rows(metrics.shuffle_mb(stages)) == [("other", 1, 3), ("vertex program", 1, 3)]
    log = ["input File:a.csv partitioner: DBH", "partition time 50", "PR time: 700", "pregel time: 600", "", "",
           "input File:a.csv partitioner: DBH", "partition time 41", "PR time: 900", "x", "", ""]
    runs = metrics.parse_run_log(spark.createDataFrame([(k + 1, v) for k, v in enumerate(log)], "seq long, value string"))
    assert rows(metrics.best_run(runs, ["file", "algorithm", "partitioner"], "time", "partition_time")) == [("a.csv", "PR", "DBH", 700, 8)]


def test_exports_and_parsing(spark, five):
    d = algorithms.shortest_paths(five, spark.createDataFrame([(4,), (2,)], "id long"))
    maps = {r.id: r.distances for r in ex.landmark_maps(d).collect()}
    assert maps[1] == {2: 1, 4: 1} and maps[4] == {4: 0}
    both = spark.createDataFrame([({1: 2, 3: 4}, {3: 1, 5: 6})], "a map<int,int>, b map<int,int>")
    assert both.select(ex.merge_landmark_maps(F.col("a"), F.col("b")).alias("m")).collect()[0].m == {1: 2, 3: 1, 5: 6}
    sk = spark.createDataFrame([(0, 0, 5, 10), (0, 0, 3, 20)], "id long, bucket int, rank int, ts long")
    assert [tuple(x) for x in ex.nested_sketch(sk, "id").collect()[0].staircase] == [(5, 10), (3, 20)]
    t = spark.createDataFrame([("2020-01-31T23:59:59.500GMT", " 7 "), ("no", "x")], "t string, n string")
    r = t.select(F.unix_millis(parsing.service_time(F.col("t"))).alias("ms"), parsing.safe_long(F.col("n")).alias("n")).collect()
    assert [tuple(x) for x in r] == [(1580515199500, 7), (None, 1)]
    n = spark.range(2000).select(sketch.simulated_register(F.rand(3), F.lit(1000), 64).alias("k"))
    share = n.where("k <= 4").count() / 2000
    assert abs(share - (1 - 1 / (16 * 64)) ** 1000) < 0.04


def test_a_restarted_stream_goes_on(spark, tmp_path):
    from chronoweave.streaming.profiles import ProfileStream, undominated

    source, checkpoint = tmp_path / "in", f"file://{tmp_path}/check"
    source.mkdir()
    (source / "a.csv").write_text("1,2,10\n2,3,5\n")
    first = ProfileStream(spark, 2)
    first.start(src.stream_edges(spark, f"file://{source}"), checkpoint).awaitTermination()
    (source / "b.csv").write_text("3,4,20\n")
    again = ProfileStream(spark, 2)
    again.start(src.stream_edges(spark, f"file://{source}"), checkpoint).awaitTermination()
    pairs, whole = st.empty_state(spark)
    _, whole = st.update(pairs, whole, spark.createDataFrame([(1, 2, 10), (2, 3, 5), (3, 4, 20)], "src long, dst long, ts long"), 2)
    want = sorted(map(tuple, undominated(whole).collect()))
    assert sorted(map(tuple, undominated(again.profile).collect())) == want
    # A batch that is run again starts from the state before it.
    again(spark.createDataFrame([(3, 4, 20)], "src long, dst long, ts long"), again.number)
    assert sorted(map(tuple, undominated(again.profile).collect())) == want


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from chronoweave.sources import storage

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(
        getConf=lambda: SimpleNamespace(get=lambda k: None), master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        storage.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))


def slow_quality(edges, placed, batch):
    """count, rf, rft, loads after every batch, each counted anew from all placements that hold."""
    out = []
    for k in range(1, max(e[0] for e in edges) // batch + 1):
        held, nodes, activity, load = {}, {}, {}, {}
        for (seq, a, b, _), p in zip(edges, placed):
            if seq <= k * batch:
                held[a, b] = p
                for x in (a, b):
                    activity[x] = activity.get(x, 0) + 1
        for (a, b), p in held.items():
            load[p] = load.get(p, 0) + 1
            for x in (a, b):
                nodes.setdefault(x, set()).add(p)
        rf = sum(map(len, nodes.values())) / len(nodes)
        rft = sum(len(ps) * activity[x] for x, ps in nodes.items()) / sum(activity.values())
        out.append((k * batch, pytest.approx(rf, abs=0.0051), pytest.approx(rft, abs=0.0051), min(load.values()), max(load.values())))
    return out


@pytest.mark.parametrize("strategy", ["DBH", "ReverseABH", "CanonicalRandomVertexCut", "HDRF"])
def test_offline_quality_against_counting_anew(spark, strategy):
    rng = random.Random(len(strategy))
    data = []
    for seq in range(1, 124):
        a, b = rng.sample(range(12), 2)
        data.append((seq, a, b, seq))
    frame = spark.createDataFrame(data, ET).repartition(3)
    placed = [p for _, p in rows(pt.offline_placements(frame, 4, strategy), "seq", "part")]
    assert rows(pt.offline_quality(frame, 4, 10, strategy)) == slow_quality(data, placed, 10)
    assert rows(pt.offline_quality(frame, 4, 10, strategy, stop=55)) == slow_quality(data[:55], placed[:55], 10)
    if strategy == "DBH":
        degrees, want = {}, []
        for _, a, b, _ in data:
            degrees.setdefault(a, set()).add(b)
            degrees.setdefault(b, set()).add(a)
            want.append((a if len(degrees[a]) < len(degrees[b]) else b) % 4)
        assert placed == want


def test_strategies_by_name_and_layout(spark):
    rng = random.Random(2)
    data = [(k + 1, *rng.sample(range(20), 2), k) for k in range(80)]
    frame = spark.createDataFrame([*data, (81, None, 3, 1)], ET)
    for name in pt.STRATEGIES:
        placed = pt.place(frame, name, 3).collect()
        assert len(placed) == 80 and {r.part for r in placed} <= {0, 1, 2}
    laid = pt.lay_out(pt.place(frame, "DBH", 3), 3)
    assert laid.rdd.getNumPartitions() == 3 and all(r.part == r.at for r in laid.withColumn("at", F.spark_partition_id()).collect())
    with pytest.raises(ValueError):
        pt.place(frame, "nonesuch", 3)
    with pytest.raises(ValueError):
        pt.offline_quality(frame, 3, 10, "nonesuch")


def test_properties_name_an_algorithm(spark, five):
    config = src.JobConfig.parse("# a comment\nalgo=CC\npartition=5\ndistance=2\nwriteResult=true\nunknown=1\nPR_Itteration=7", balance=2.0)
    assert (config.algorithm, config.partitions, config.hops, config.write_result, config.max_iterations, config.balance) == ("CC", 5, 2, True, 7, 2.0)
    assert rows(algorithms.run(five, config)) == [(k, 1) for k in (1, 2, 3, 4)]
    assert rows(algorithms.run(five, src.JobConfig(algorithm="PR"))) == rows(algorithms.pagerank(five))
    assert len(rows(algorithms.run(five, src.JobConfig(algorithm="LP", max_iterations=2)))) == 4
    with pytest.raises(ValueError):
        algorithms.run(five, src.JobConfig(algorithm="XX"))


def test_stage_and_job_tables_of_an_event_log(spark, tmp_path):
    import json

    stage = lambda n, name, values: {"Event": "SparkListenerStageCompleted", "Stage Info": {
        "Stage ID": n, "Stage Name": name, "Number of Tasks": 2, "Submission Time": 100, "Completion Time": 100 + n,
        "Accumulables": [{"Name": k, "Value": str(v)} for k, v in values.items()]}}
    log = [
        stage(3, "mapReduceTriplets at X", {"internal.metrics.executorRunTime": 7, "internal.metrics.shuffle.read.remoteBytesRead": 9, "vp": 4}),
        stage(5, "count at Y", {"internal.metrics.jvmGCTime": 2}),
        {"Event": "SparkListenerJobStart", "Job ID": 1, "Submission Time": 50, "Stage Infos": [{"Stage ID": 5, "Stage Name": "count at Y"}, {"Stage ID": 3, "Stage Name": "a"}]},
        {"Event": "SparkListenerJobStart", "Job ID": 2, "Submission Time": 60, "Stage Infos": []},
        {"Event": "SparkListenerJobEnd", "Job ID": 1, "Completion Time": 95},
    ]
    path = tmp_path / "log"
    path.write_text("\n".join(map(json.dumps, log)))
    stages = metrics.read_stages(spark, str(path))
    counted = {r.StageId: r for r in metrics.stage_counters(stages, ("vp", "send", "merge")).collect()}
    assert len(counted[3]) == 22 and (counted[3].vpCounter, counted[3].executorRunTime, counted[3].remoteBytesRead, counted[3].stageTime) == (4, 7, 9, 3)
    assert (counted[5].jvmGCTime, counted[5].sendCounter) == (2, 0)
    assert [tuple(r) for r in metrics.stage_detail(stages).collect()] == [("materialise", 5, 5), ("send", 3, 3)]
    assert [tuple(r) for r in metrics.job_detail(spark, str(path)).collect()] == [(1, "count at Y", 45, 95, 50, [3, 5])]
    table = tmp_path / "counters.csv"
    lines = [",".join(metrics.COUNTERS), ",".join(["7", "x"] + ["1"] * 20), "too,few", ",".join(["8", "y"] + ["z"] * 20)]
    table.write_text("\n".join(lines))
    got = rows(metrics.read_counters(spark, str(table)), "StageId", "StageName", "stageTime")
    assert got == [(7, "x", 1), (8, "y", None)]
