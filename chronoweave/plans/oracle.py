"""SQL with the results that the queries must have. Tables are those of the test data."""

from __future__ import annotations

from .queries import BATCH, BUCKETS, HORIZON, PARTS, SIM_N, TOP_BIT

P31 = 2_147_483_647
#: Rounds of the PageRank SQL: more than any of the tables takes, and a round in which no
#: increase is over the tolerance adds nothing.
ROUNDS = 100
E0 = """e0 AS (SELECT o_orderkey + 1 AS seq, o_custkey AS src, (o_orderkey * 7919 + 13) % (SELECT count(*) FROM customer) AS dst,
  floor(epoch(o_orderdate))::BIGINT AS ts FROM orders)"""
E1 = f"{E0}, e1 AS (SELECT * FROM e0 WHERE src <> dst)"
E1D = f"{E1}, e AS (SELECT src, dst, max(ts) AS ts FROM e1 GROUP BY 1, 2)"
HALVES = f"""{E1}, old AS (SELECT src, dst, arg_max(ts, seq) AS ts FROM e1 WHERE seq % 2 = 0 GROUP BY 1, 2),
new AS (SELECT src, dst, arg_max(ts, seq) AS ts FROM e1 WHERE seq % 2 = 1 GROUP BY 1, 2)"""
DEG = "deg AS (SELECT id, count(DISTINCT nbr) AS degree FROM (SELECT src AS id, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e) GROUP BY 1)"
ACT = "act AS (SELECT id, count(*) AS activity FROM (SELECT src AS id FROM e1 UNION ALL SELECT dst FROM e1) GROUP BY 1)"
ENDS = "(SELECT seq, 0 AS side, src AS id, dst AS nbr FROM e1 UNION ALL SELECT seq, 1, dst, src FROM e1)"
NEAR = """n AS (SELECT id, nbr, max(ts) AS ts FROM (SELECT src AS id, dst AS nbr, ts FROM e1 UNION ALL SELECT dst, src, ts FROM e1) GROUP BY 1, 2)"""


def spread(x: str, seed: int = 11) -> str:
    return f"((({x}) % {P31}) * 48271 + {seed}) % {P31}"


def pair(a: str, b: str, seed: int = 11) -> str:
    return f"(({spread(a, seed)}) * 31 + {spread(b, seed)}) % {P31}"


def rank(h: str) -> str:
    shifted = f"(({h}) | {1 << TOP_BIT}) >> {BUCKETS.bit_length() - 1}"
    return f"(bit_count((({shifted}) & -({shifted})) - 1) + 1)"


def elements(rows: str) -> str:
    """id, bucket, rank, ts of rows with id, nbr, ts."""
    h = f"({spread('nbr')})"
    return f"SELECT *, ({h} & {BUCKETS - 1})::INT AS bucket, {rank(h)}::INT AS rank FROM {rows}"


def estimate(registers: str, key: str = "id") -> str:
    """The estimate per key from (key, bucket, register)."""
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(BUCKETS, 0.7213 / (1 + 1.079 / BUCKETS))
    m = BUCKETS
    return f"""SELECT {key}, round(CASE WHEN raw <= {2.5 * m} AND filled < {m} THEN {m} * ln({float(m)} / ({m} - filled)) ELSE raw END)::BIGINT AS estimate
FROM (SELECT {key}, filled, {alpha} * {m} * {m} / (power + {m} - filled) AS raw
  FROM (SELECT {key}, sum(pow(2.0, -register)) AS power, count(*) AS filled FROM {registers} GROUP BY 1))"""


def pagerank(edges: str, tol: float, k: int = ROUNDS) -> str:
    return f"""WITH RECURSIVE {E1D}, g AS ({edges}), v AS (SELECT src AS id FROM g UNION SELECT dst FROM g),
od AS (SELECT src, count(*) AS k FROM g GROUP BY 1),
r(i, id, pr, delta) AS (
  SELECT 0, id, 0.15::DOUBLE, 0.15::DOUBLE FROM v
  UNION ALL
  SELECT r.i + 1, r.id, r.pr + 0.85 * coalesce(m.s, 0), 0.85 * coalesce(m.s, 0)
  FROM r LEFT JOIN (SELECT g.dst AS id, x.i, sum(x.delta / od.k) AS s FROM r x JOIN g ON g.src = x.id JOIN od ON od.src = g.src
    WHERE x.delta > {tol} GROUP BY 1, 2) m ON m.id = r.id AND m.i = r.i
  WHERE r.i < {k})
SELECT id, round(pr, 6) AS pr FROM r WHERE i = {k}"""


def home(x: str) -> str:
    return f"({x} % {PARTS})::INT"


def placed(stat: str, column: str, op: str = "<", edges: str = "e") -> str:
    return f"""SELECT src, dst, CASE WHEN coalesce(s.{column}, 0) {op} coalesce(d.{column}, 0) THEN {home('src')} ELSE {home('dst')} END AS part
FROM {edges} LEFT JOIN {stat} s ON s.id = src LEFT JOIN {stat} d ON d.id = dst"""


def exact(hops: int) -> str:
    parts = [E1, NEAR, "p1 AS (SELECT id, 1 AS hop, nbr, ts FROM n)"]
    for k in range(2, hops + 1):
        lower = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, k))
        parts.append(f"""t{k} AS (SELECT n.id, p.nbr, max(least(p.ts, n.ts)) AS ts FROM n JOIN p{k - 1} p ON p.id = n.nbr WHERE p.nbr <> n.id GROUP BY 1, 2),
p{k} AS (SELECT t.id, {k} AS hop, t.nbr, t.ts FROM t{k} t WHERE NOT EXISTS (SELECT 1 FROM ({lower}) q WHERE q.id = t.id AND q.nbr = t.nbr AND q.ts >= t.ts))""")
    return ", ".join(parts) + ", p AS (" + " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, hops + 1)) + ")"


def frontier(rows: str, keys: str) -> str:
    """Entries of (keys, bucket, rank, ts) that no larger rank at least as new makes useless."""
    same = " AND ".join(f"y.{k} = x.{k}" for k in [*keys.split(", "), "bucket"])
    return f"SELECT x.* FROM {rows} x WHERE NOT EXISTS (SELECT 1 FROM {rows} y WHERE {same} AND y.rank > x.rank AND y.ts >= x.ts)"


def approx(hops: int) -> str:
    parts = [E1, NEAR, f"l1 AS (SELECT id, bucket, rank, max(ts) AS ts FROM ({elements('n')}) GROUP BY 1, 2, 3)"]
    for k in range(2, hops + 1):
        parts.append(f"l{k} AS (SELECT n.id, bucket, rank, max(least(l.ts, n.ts)) AS ts FROM n JOIN l{k - 1} l ON l.id = n.nbr GROUP BY 1, 2, 3)")
    union = " UNION ALL ".join(f"SELECT id, {k} AS hop, bucket, rank, ts FROM l{k}" for k in range(1, hops + 1))
    return ", ".join(parts) + f", a AS ({union})"


def label_propagation(steps: int) -> str:
    parts = [E1D, "u AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e)", "l0 AS (SELECT DISTINCT a AS id, a AS label FROM u)"]
    for k in range(1, steps + 1):
        parts.append(f"""l{k} AS (SELECT id, label FROM (SELECT b AS id, label, row_number() OVER (PARTITION BY b ORDER BY count(*) DESC, label) AS r
  FROM u JOIN l{k - 1} ON id = a GROUP BY b, label) WHERE r = 1)""")
    return ", ".join(parts) + f" SELECT id, label FROM l{steps}"


def updates() -> str:
    """CTEs: e, deg, upd (updates), rep (replicas)."""
    grid = f"((({spread('src')}) % 3) * 3 + ({spread('dst')}) % 3) % {PARTS}"
    return f"""{exact(3)}, e AS (SELECT src, dst, max(ts) AS ts FROM e1 GROUP BY 1, 2), {DEG},
upd AS (SELECT id, count(DISTINCT hop) AS updates FROM p GROUP BY 1),
rep AS (SELECT id, count(DISTINCT part) AS replicas FROM (SELECT src AS id, {grid} AS part FROM e UNION ALL SELECT dst, {grid} FROM e) GROUP BY 1)"""


def by_updates(s: str, d: str) -> str:
    return f"""WITH {updates()} SELECT src, dst, CASE WHEN {s} > {d} THEN {home('src')} WHEN {s} < {d} THEN {home('dst')}
  WHEN sg.degree < dg.degree THEN {home('src')} ELSE {home('dst')} END AS part
FROM e JOIN deg sg ON sg.id = src JOIN deg dg ON dg.id = dst JOIN upd su ON su.id = src JOIN upd du ON du.id = dst
  JOIN rep sr ON sr.id = src JOIN rep dr ON dr.id = dst"""


REACH = """u AS (SELECT src AS a, dst AS b FROM e1 UNION SELECT dst, src FROM e1)"""
DBH = f"WITH {E1D}, {DEG}, pl AS ({placed('deg', 'degree')})"
NODES = "nd AS (SELECT DISTINCT part, id FROM (SELECT part, src AS id FROM pl UNION ALL SELECT part, dst FROM pl))"
BOTH1 = "(SELECT src AS id, dst AS nbr, ts FROM e1 UNION ALL SELECT dst, src, ts FROM e1)"
HLL = f"WITH {E1}, x AS ({elements(BOTH1)}), sk AS (SELECT id, bucket, rank, max(ts) AS ts FROM x GROUP BY 1, 2, 3)"
RUNS = "r AS (SELECT o_orderpriority AS file, o_orderstatus AS algorithm, o_orderkey AS run, floor(o_totalprice * 100)::BIGINT AS ms, o_custkey * 37 % 1009 AS partition_ms FROM orders)"
LENGTHS = f"(SELECT id FROM (SELECT src AS id FROM e1 UNION SELECT dst FROM e1) ORDER BY {spread('id')}, id LIMIT 20)"
RUNNING = f"""x AS {ENDS}, f AS (SELECT *, (row_number() OVER (PARTITION BY id, nbr ORDER BY seq, side) = 1)::BIGINT AS new FROM x),
run AS (SELECT seq, id, activity, degree FROM (SELECT seq, side, id, count(*) OVER w AS activity, sum(new) OVER w AS degree,
  row_number() OVER (PARTITION BY id, seq ORDER BY side DESC) AS k FROM f WINDOW w AS (PARTITION BY id ORDER BY seq, side ROWS UNBOUNDED PRECEDING)) WHERE k = 1)"""


def offline(first: str | None, part: str = "") -> str:
    """Quality after every batch, where the first end decides under a condition, or by a part of the edge alone."""
    ends = "JOIN run s ON s.seq = e1.seq AND s.id = src JOIN run d ON d.seq = e1.seq AND d.id = dst" if first else ""
    part = f"CASE WHEN {first} THEN {home('src')} ELSE {home('dst')} END" if first else part
    pl = f"pl AS (SELECT e1.seq, src, dst, {part} AS part FROM e1 {ends})"
    return f"""WITH {E1}, {RUNNING}, {pl},
k AS (SELECT unnest(range(1, (SELECT max(seq) FROM e1) // {BATCH} + 1)) AS k),
h AS (SELECT k, src, dst, arg_max(part, seq) AS part FROM pl JOIN k ON seq <= k * {BATCH} GROUP BY 1, 2, 3),
nd AS (SELECT k, id, count(DISTINCT part) AS r FROM (SELECT k, part, src AS id FROM h UNION ALL SELECT k, part, dst FROM h) GROUP BY 1, 2),
ac AS (SELECT k, id, count(*) AS a FROM x JOIN k ON seq <= k * {BATCH} GROUP BY 1, 2),
q AS (SELECT k, round(sum(r)::DOUBLE / count(*), 2) AS rf, round(sum(r * a)::DOUBLE / sum(a), 2) AS rft FROM nd JOIN ac USING (k, id) GROUP BY 1),
l AS (SELECT k, min(c) AS min_load, max(c) AS max_load FROM (SELECT k, part, count(*) AS c FROM h GROUP BY 1, 2) GROUP BY 1)
SELECT k * {BATCH} AS count, rf, rft, min_load, max_load FROM q JOIN l USING (k)"""


def oracle_sql() -> dict[str, str]:
    simple = lambda cte, q: f"WITH {cte} {q}"
    part = lambda expr, cte=E1D: f"WITH {cte} SELECT src, dst, ({expr})::INT AS part FROM e"
    lo, hi = "least(src, dst)", "greatest(src, dst)"
    found = {
        "edge_scan": simple(E0, "SELECT * FROM e0"),
        "event_pairs": "SELECT a.event_id + 1 AS seq, a.user_id AS src, b.user_id AS dst, floor(epoch(a.ts))::BIGINT AS ts FROM events a JOIN events b ON b.event_id = a.event_id + 1",
        "drop_self_loops": simple(E1, "SELECT * FROM e1"),
        "canonical_edges": simple(E1, "SELECT seq, greatest(src, dst) AS src, least(src, dst) AS dst, ts FROM e1"),
        "undirected_edges": simple(E1, "SELECT src, dst, ts FROM e1 UNION ALL SELECT dst, src, ts FROM e1"),
        "reverse_edges": simple(E1, "SELECT seq, dst AS src, src AS dst, ts FROM e1"),
        "edge_dedup_lww": simple(E1, "SELECT src, dst, arg_max(ts, seq) AS ts FROM e1 GROUP BY 1, 2"),
        "edge_dedup_max": simple(E1D, "SELECT * FROM e"),
        "edge_replace": simple(HALVES, "SELECT src, dst, ts FROM new UNION ALL SELECT src, dst, ts FROM old ANTI JOIN new USING (src, dst)"),
        "vertices": simple(E1, "SELECT src AS id FROM e1 UNION SELECT dst FROM e1"),
        "batch_touched_vertices": simple(HALVES, "(SELECT src AS id FROM old UNION SELECT dst FROM old) INTERSECT (SELECT src FROM new UNION SELECT dst FROM new)"),
        "new_vertices": simple(HALVES, "(SELECT src AS id FROM new UNION SELECT dst FROM new) EXCEPT (SELECT src FROM old UNION SELECT dst FROM old)"),
        "degree_undirected": simple(f"{E1D}, {DEG}", "SELECT * FROM deg"),
        "degree_out": simple(E1, "SELECT src AS id, count(DISTINCT dst) AS degree FROM e1 GROUP BY 1"),
        "out_degrees": simple(E1, "SELECT src AS id, count(*) AS degree FROM e1 GROUP BY 1"),
        "node_activity": simple(f"{E1}, {ACT}", "SELECT * FROM act"),
        "running_activity": simple(f"{E1}, {RUNNING}", "SELECT seq, id, activity FROM run"),
        "running_degree": simple(f"{E1}, {RUNNING}", "SELECT seq, id, degree::BIGINT AS degree FROM run"),
        "batch_id": simple(E1, "SELECT s AS seq, src, dst, ts, ((s - 1) // 100)::BIGINT AS batch_id FROM (SELECT row_number() OVER (ORDER BY seq) AS s, src, dst, ts FROM e1)"),
        "edge_weights": simple(E1D, "SELECT src, dst, round(1.0::DOUBLE / count(*) OVER (PARTITION BY src), 9) AS weight FROM e"),
        "degree_predictor": simple(f"{E1}, {RUNNING}, fin AS (SELECT id, count(DISTINCT nbr) AS final FROM x GROUP BY 1)", """
SELECT count(*) FILTER (a) AS activity_correct, count(*) FILTER (NOT a) AS activity_wrong, count(*) FILTER (g) AS degree_correct, count(*) FILTER (NOT g) AS degree_wrong, count(*) AS total
FROM (SELECT sign(s.activity - d.activity) = sign(sf.final - df.final) AS a, sign(s.degree - d.degree) = sign(sf.final - df.final) AS g
  FROM e1 JOIN run s ON s.seq = e1.seq AND s.id = src JOIN run d ON d.seq = e1.seq AND d.id = dst JOIN fin sf ON sf.id = src JOIN fin df ON df.id = dst)"""),
        "repeat_edges": simple(E0, f"""SELECT seq * 2 AS place, src, dst, ts FROM e0 UNION ALL
SELECT a.seq * 2 + 1, b.src, b.dst, b.ts FROM e0 a JOIN e0 b ON b.seq = ({spread('a.seq')}) % a.seq + 1 WHERE a.seq % 10 = 0"""),
        "pagerank": pagerank("SELECT src, dst FROM e", 1e-4),
        "pagerank_coarse": pagerank("SELECT src, dst FROM e", 1e-2),
        "pagerank_topk": pagerank("SELECT dst AS src, src AS dst FROM e", 1e-4) + " ORDER BY pr DESC, id LIMIT 50",
        "connected_components": f"WITH RECURSIVE {E1}, {REACH}, r AS (SELECT a AS id, b AS o FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.o) SELECT id, least(id, min(o)) AS label FROM r GROUP BY 1",
        "cc_capped": f"WITH RECURSIVE {E1}, {REACH}, r AS (SELECT a AS id, b AS o, 1 AS d FROM u UNION SELECT r.id, u.b, d + 1 FROM r JOIN u ON u.a = r.o WHERE d < 3) SELECT id, least(id, min(o)) AS label FROM r GROUP BY 1",
        "cc_batches": f"""WITH RECURSIVE {E1}, bt AS (SELECT *, ((seq - 1) // {BATCH})::BIGINT AS b0 FROM e1), m AS (SELECT unnest(range(0, (SELECT max(b0) + 1 FROM bt))) AS b),
u AS (SELECT b, src AS x, dst AS y FROM bt JOIN m ON b0 <= b UNION SELECT b, dst, src FROM bt JOIN m ON b0 <= b),
r AS (SELECT b, x AS id, y AS o FROM u UNION SELECT r.b, r.id, u.y FROM r JOIN u ON u.b = r.b AND u.x = r.o) SELECT b AS batch_id, id, least(id, min(o)) AS label FROM r GROUP BY 1, 2""",
        "landmark_sample": simple(E1, f"SELECT * FROM {LENGTHS}"),
        "shortest_paths": f"""WITH RECURSIVE {E1}, lm AS {LENGTHS}, r AS (SELECT id, id AS landmark, 0::BIGINT AS d FROM lm
UNION SELECT src, r.landmark, d + 1 FROM r JOIN e1 ON dst = r.id WHERE d < 20) SELECT id, landmark, min(d) AS dist FROM r GROUP BY 1, 2""",
        "label_propagation": f"WITH {label_propagation(3)}",
        "toy_length": "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (1, 1), (2, 2), (3, 1)) t(id, length)",
        "profile_exact": simple(exact(3), "SELECT * FROM p"),
        "profile_size": simple(exact(3), "SELECT id, count(DISTINCT nbr) AS size FROM p WHERE ts > 0 GROUP BY 1"),
        "profile_output": f"""WITH {exact(3)}, dg AS (SELECT id, count(*) AS degree FROM n GROUP BY 1), sz AS (SELECT id, count(DISTINCT nbr) AS size FROM p WHERE ts > {HORIZON} GROUP BY 1),
up AS (SELECT id, count(DISTINCT hop) AS updates FROM p GROUP BY 1)
SELECT id, coalesce(size, 0) AS profile_size, coalesce(updates, 0) AS update_count, degree FROM dg LEFT JOIN sz USING (id) LEFT JOIN up USING (id)""",
        "landmark_maps": f"""WITH RECURSIVE {E1}, lm AS {LENGTHS}, r AS (SELECT id, id AS landmark, 0::BIGINT AS d FROM lm
UNION SELECT src, r.landmark, d + 1 FROM r JOIN e1 ON dst = r.id WHERE d < 20), m AS (SELECT id, landmark, min(d) AS dist FROM r GROUP BY 1, 2)
SELECT id, count(*)::INT AS landmarks, max(dist) AS farthest FROM m GROUP BY 1""",
        "batch_quality": f"""WITH {E1}, pl AS (SELECT (seq - 1) // {BATCH} AS batch_id, src, dst, ((({spread('src')}) % 3) * 3 + ({spread('dst')}) % 3) % {PARTS} AS part FROM e1),
nd AS (SELECT batch_id, id, count(DISTINCT part) AS r FROM (SELECT batch_id, part, src AS id FROM pl UNION ALL SELECT batch_id, part, dst FROM pl) GROUP BY 1, 2),
rf AS (SELECT batch_id, round(sum(r)::DOUBLE / count(*), 2) AS replication_factor FROM nd GROUP BY 1),
ld AS (SELECT batch_id, sum(c)::BIGINT AS edges, round(stddev_pop(c) * 100 / avg(c), 6) AS relative_sd FROM (SELECT batch_id, part, count(*) AS c FROM pl GROUP BY 1, 2) GROUP BY 1)
SELECT batch_id::BIGINT AS batch_id, edges, relative_sd, replication_factor FROM ld JOIN rf USING (batch_id)""",
        "part_lookup": f"{DBH} SELECT src, dst, CASE WHEN src % 3 = 0 THEN part ELSE (({pair('src', 'dst')}) % {PARTS})::INT END AS part FROM pl",
        "profile_window_exact": simple(exact(3), f"SELECT id, count(DISTINCT nbr) AS size FROM p WHERE ts > {HORIZON} GROUP BY 1"),
        "profile_window_approx": simple(f"{approx(2)}, rg AS (SELECT id, bucket, max(rank) AS register FROM a WHERE ts >= {HORIZON} GROUP BY 1, 2)", estimate("rg")),
        "profile_approx": simple(approx(3), frontier("a", "id, hop")),
        "profile_stream": simple(exact(2), "SELECT * FROM p"),
        "sliding_hll": f"{HLL} SELECT * FROM sk",
        "sliding_hll_merge": f"WITH {E1}, x AS ({elements(BOTH1)}) SELECT id % 100 AS id, bucket, rank, max(ts) AS ts FROM x GROUP BY 1, 2, 3",
        "sliding_hll_prune": f"{HLL} {frontier('sk', 'id')}",
        "sliding_hll_estimate": f"{HLL}, rg AS (SELECT id, bucket, max(rank) AS register FROM sk WHERE ts >= {HORIZON} GROUP BY 1, 2) {estimate('rg')}",
        "hll_estimate": f"{HLL}, rg AS (SELECT id, bucket, max(rank) AS register FROM sk GROUP BY 1, 2) {estimate('rg')}",
        "hll_merge": f"""{HLL}, ids AS (SELECT DISTINCT id FROM sk), rg AS (SELECT i.id, bucket, max(rank) AS register FROM ids i JOIN ids j ON j.id = i.id + 1
  JOIN sk ON sk.id IN (i.id, j.id) GROUP BY 1, 2) {estimate('rg')}""",
        "hll_simulate": f"SELECT k::BIGINT AS k, round(pow(1 - 1 / (pow(2.0, k) * {BUCKETS}), {SIM_N}), 9) AS p FROM range(1, 31) t(k)",
        "part_rvc": part(f"({pair('src', 'dst')}) % {PARTS}"),
        "part_crvc": part(f"({pair(lo, hi)}) % {PARTS}"),
        "part_1d": part(f"({spread('src')}) % {PARTS}"),
        "part_2d": part(f"((({spread('src')}) % 3) * 3 + ({spread('dst')}) % 3) % {PARTS}"),
        "part_hashing": part(f"({pair('src', 'dst', 97)}) % {PARTS}"),
        "part_one": part("0"),
        "part_dbh": f"{DBH} SELECT * FROM pl",
        "part_idbh": f"{DBH} SELECT * FROM pl",
        "part_abh": f"WITH {E1D}, {ACT} {placed('act', 'activity')}",
        "part_rabh": f"WITH {E1D}, {ACT} {placed('act', 'activity', '>')}",
        "part_nph": f"WITH {exact(3)}, e AS (SELECT src, dst, max(ts) AS ts FROM e1 GROUP BY 1, 2), sz AS (SELECT id, count(DISTINCT nbr) AS size FROM p WHERE ts > 0 GROUP BY 1) {placed('sz', 'size')}",
        "part_ubh": by_updates("su.updates", "du.updates"),
        "part_ubh_adv": by_updates("su.updates * sr.replicas", "du.updates * dr.replicas"),
        "part_ubh_rev": by_updates("-su.updates", "-du.updates"),
        "replication_factor": f"{DBH}, {NODES} SELECT round(count(*)::DOUBLE / count(DISTINCT id), 2) AS rf FROM nd",
        "replication_factor_weighted": f"""{DBH}, {NODES}, rp AS (SELECT id, count(*) AS r FROM nd GROUP BY 1), ac AS (SELECT id, count(*) AS a FROM (SELECT src AS id FROM pl UNION ALL SELECT dst FROM pl) GROUP BY 1)
SELECT round(sum(r * a)::DOUBLE / sum(a), 2) AS rft FROM rp JOIN ac USING (id)""",
        "partition_load": f"{DBH} SELECT part, count(*) AS edges FROM pl GROUP BY 1",
        "partition_nodes": f"{DBH}, {NODES} SELECT * FROM nd",
        "load_rsd": f"{DBH}, l AS (SELECT count(*) AS c FROM pl GROUP BY part) SELECT round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS sd, round(stddev_pop(c) * 100 / avg(c), 6) AS rsd FROM l",
        "offline_partition_quality": offline("s.degree < d.degree"),
        "offline_quality_abh": offline("s.activity < d.activity"),
        "offline_quality_rabh": offline("s.activity > d.activity"),
        "offline_quality_crvc": offline(None, f"({pair(lo, hi)}) % {PARTS}"),
        "offline_quality_rvc": offline(None, f"({pair('src', 'dst')}) % {PARTS}"),
        "place_dbh": f"WITH {E1D}, {DEG} {placed('deg', 'degree', edges='e1').replace('SELECT src', 'SELECT seq, src')}",
        "place_rabh": f"WITH {E1}, {ACT} {placed('act', 'activity', '>', 'e1').replace('SELECT src', 'SELECT seq, src')}",
        "place_crvc": f"WITH {E1} SELECT seq, src, dst, (({pair(lo, hi)}) % {PARTS})::INT AS part FROM e1",
        "layout_crvc": f"WITH {E1} SELECT (({pair(lo, hi)}) % {PARTS})::INT AS part, count(*) AS edges, count(*) AS in_place FROM e1 GROUP BY 1",
        "task_skew": f"{DBH}, l AS (SELECT count(*) AS n, sum(src) AS s FROM pl GROUP BY part) SELECT sum(n)::BIGINT AS n, sum(s)::BIGINT AS total, max(s)::BIGINT AS largest FROM l",
        "stage_metrics": """SELECT event_type, count(*) AS n, sum(k)::BIGINT AS k_sum, (sum(k) // 1000)::BIGINT AS k_thousands, arg_max(event_id, (value, -event_id)) AS slowest
FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""",
        "best_stage": f"WITH {RUNS} SELECT file, algorithm, run, ms, partition_ms FROM r QUALIFY row_number() OVER (PARTITION BY file, algorithm ORDER BY ms, run) = 1",
        "best_job": f"WITH {RUNS} SELECT file, algorithm, run, ms, partition_ms FROM r QUALIFY row_number() OVER (PARTITION BY file ORDER BY ms, run) = 1",
        "best_run": f"WITH {RUNS} SELECT file, algorithm, min(ms) AS time, (min(partition_ms) // 5)::BIGINT AS partition_time FROM r GROUP BY 1, 2",
        "normalize_delims": "SELECT p_partkey, translate(p_name || chr(9) || p_brand, chr(9) || ' ', ',,') AS value FROM part",
        "tokenize": "SELECT unnest(string_split(p_name, ' ')) AS token FROM part",
        "token_filter": "SELECT token FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE length(token) > 5",
        "token_top5": "SELECT token FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE length(token) > 5 ORDER BY token DESC LIMIT 5",
    }
    return found | {"algorithm_cc": found["connected_components"], "algorithm_sp": found["shortest_paths"]}
