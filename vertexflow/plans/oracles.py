"""DuckDB SQL for the graph queries, built from shared pieces.

``e`` is the graph of the query with parallel edges, ``n`` its number of vertices.
"""

from __future__ import annotations

_LEAD = "lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"


#: The lines that make the graph; tests put a condition after it.
LINES = "lineitem /* all lines */"
_EDGES = f"(SELECT src, dst, w FROM (SELECT l_partkey AS src, {_LEAD} AS dst, l_quantity AS w FROM {LINES}) WHERE dst IS NOT NULL AND src <> dst)"
_COMMON = """
n AS MATERIALIZED (SELECT max(greatest(src, dst)) + 1 AS n FROM e),
v AS MATERIALIZED (SELECT unnest(range(n)) AS id FROM n),
deg AS MATERIALIZED (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id),
full_deg AS MATERIALIZED (SELECT id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM v LEFT JOIN deg USING (id)),
root AS MATERIALIZED (SELECT coalesce(max(id), 0) AS root FROM (SELECT id FROM deg WHERE in_degree * out_degree > 0 ORDER BY in_degree * out_degree DESC, id LIMIT 1))"""

GRAPH = f"WITH RECURSIVE e AS MATERIALIZED {_EDGES},{_COMMON}"
SIMPLE = f"WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM {_EDGES} GROUP BY src, dst),{_COMMON}"

# Even intervals: the first n % 4 parts hold one more id.
_INTERVALS = """
iv AS (SELECT p AS part, p * (n // 4) + least(p, n % 4) AS s, p * (n // 4) + least(p, n % 4) + n // 4 + (p < n % 4)::BIGINT - 1 AS t FROM n, (SELECT unnest(range(4)) AS p))"""


def _pagerank(rounds: int, tail: str) -> str:
    steps = ["od AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS r FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(s, 0) AS r FROM v LEFT JOIN (SELECT dst, sum(r / k) AS s FROM e JOIN r{i - 1} ON e.src = r{i - 1}.id JOIN od ON od.src = e.src GROUP BY dst) ON dst = id)")
    return GRAPH + ",\n" + ",\n".join(steps) + "\n" + tail


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


_FORWARD = "fw(id) AS (SELECT root FROM root UNION SELECT e.dst FROM fw JOIN e ON e.src = fw.id)"
_BACKWARD = "bw(id) AS (SELECT root FROM root UNION SELECT e.src FROM bw JOIN e ON e.dst = bw.id)"
_GIANT = f"{_FORWARD},\n{_BACKWARD},\ngiant AS MATERIALIZED (SELECT id FROM fw INTERSECT SELECT id FROM bw)"
_REGION = f"{_GIANT},\nreg AS MATERIALIZED (SELECT id, CASE WHEN id NOT IN (SELECT id FROM fw) THEN 'left' WHEN id NOT IN (SELECT id FROM giant) THEN 'right' ELSE 'middle' END AS region FROM deg)"
_BOTH = "u AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e)"
_WCC = f"{_BOTH},\nw(id, l) AS (SELECT id, id FROM deg UNION SELECT u.b, w.l FROM w JOIN u ON u.a = w.id WHERE w.l < u.b),\nwcc AS MATERIALIZED (SELECT id, min(l) AS component FROM w GROUP BY id)"


def _levels(edges: str, starts: str, most: int | None = None) -> str:
    """``lv(id, level)`` and ``best``: distances from ``starts`` along edges a -> b."""
    limit = f" AND level < {most}" if most is not None else " AND level < 60"
    return f"lv(id, level) AS ({starts} UNION SELECT x.b, lv.level + 1 FROM lv JOIN ({edges}) x ON x.a = lv.id WHERE true{limit}),\nbest AS MATERIALIZED (SELECT id, min(level) AS level FROM lv GROUP BY id)"


_ROOT_LEVELS = _levels("SELECT src AS a, dst AS b FROM e", "SELECT root, 0::BIGINT FROM root")
_SSSP_ROUNDS = 40


def _sssp(tail: str) -> str:
    steps = ["d0 AS MATERIALIZED (SELECT root AS id, 0.0::DOUBLE AS d FROM root)"]
    for i in range(1, _SSSP_ROUNDS + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT id, d FROM d{i - 1} UNION ALL SELECT e.dst, d + e.w FROM d{i - 1} JOIN e ON e.src = id) GROUP BY id)")
    return SIMPLE + ",\n" + ",\n".join(steps) + "\n" + tail


_COMPONENT_LEVELS = f"{_WCC},\nlv(id, c, level) AS (SELECT component, component, 0::BIGINT FROM wcc WHERE id = component UNION SELECT x.b, lv.c, lv.level + 1 FROM lv JOIN EDGES x ON x.a = lv.id WHERE lv.level < 60),\ncl AS MATERIALIZED (SELECT wcc.id, component, min(level) AS level FROM wcc LEFT JOIN lv ON lv.id = wcc.id GROUP BY wcc.id, component)"
_DIRECTED = _COMPONENT_LEVELS.replace("EDGES", "(SELECT src AS a, dst AS b FROM e)")
_UNDIRECTED = _COMPONENT_LEVELS.replace("EDGES", "u")
_HASH = "id // 4 + (id % 4) * (n // 4) + least(id % 4, n % 4)"
_ORDERED = "od AS MATERIALIZED (SELECT id AS old_id, row_number() OVER (ORDER BY in_degree + out_degree, id) - 1 AS new_id FROM full_deg)"


def _grid(size: int, moves: list[tuple[str, str]]) -> str:
    return f"WITH v AS (SELECT unnest(range({size})) AS id) " + _union([f"SELECT id AS src, {to} AS dst FROM v WHERE {ok}" for ok, to in moves])


def _lattice(n: int, dims: int) -> str:
    return _grid(n**dims, [(f"(id // {n**k}) % {n} < {n - 1}", f"id + {n**k}") for k in range(dims)])




def _blocks_by_rounds(rounds: int, roots: int, levels: int) -> str:
    """Multi-source blocks, round by round: those after the last have no roots."""
    steps = ["a0 AS MATERIALIZED (SELECT id, in_degree FROM deg)"]
    for r in range(1, rounds + 1):
        going = f"(SELECT count(*) FROM a{r - 1}) >= 0.1 * (SELECT count(*) FROM a0)" + (f" AND (SELECT count(*) FROM a{r - 1}) < (SELECT count(*) FROM a{r - 2})" if r > 1 else "")
        steps += [
            f"t{r} AS MATERIALIZED (SELECT id FROM a{r - 1} WHERE {going} ORDER BY in_degree DESC, id LIMIT {roots})",
            f"e{r} AS MATERIALIZED (SELECT src, dst FROM e WHERE src IN (SELECT id FROM a{r - 1}) AND dst IN (SELECT id FROM a{r - 1}))",
            f"l{r}(id, label, level) AS (SELECT id, id, 0::BIGINT FROM t{r} UNION SELECT e{r}.dst, l{r}.label, l{r}.level + 1 FROM l{r} JOIN e{r} ON e{r}.src = l{r}.id WHERE level < {levels - 1})",
            f"f{r} AS MATERIALIZED (SELECT id, arg_min(label, level * 1000000 + label) AS block, min(level) AS level FROM l{r} GROUP BY id)",
            f"a{r} AS MATERIALIZED (SELECT * FROM a{r - 1} WHERE id NOT IN (SELECT id FROM f{r}))",
        ]
    return f"{SIMPLE}, " + ",\n".join(steps) + " " + _union([f"SELECT id, block, level FROM f{r}" for r in range(1, rounds + 1)])


_SIZES = "s AS MATERIALIZED (SELECT id % 13 AS block, count(*)::BIGINT AS n FROM v GROUP BY 1),\no AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n DESC, block) AS k, block, n FROM s)"
_LPT = f"""{GRAPH}, {_SIZES},
r(k, block, part, loads) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::INT, [0::BIGINT, 0, 0, 0] UNION ALL
  SELECT o.k, o.block, (list_position(loads, list_min(loads)) - 1)::INT, list_transform(range(1, 5), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END)
  FROM r JOIN o ON o.k = r.k + 1)
SELECT block, part FROM r WHERE k > 0"""
# The state is one row: the part of each block (-1: none yet) and the loads; p is the least loaded part, b the block that it takes.
_GREEDY = f"""{GRAPH}, {_SIZES},
c AS (SELECT src % 13 AS a, dst % 13 AS b FROM e WHERE src % 13 <> dst % 13),
m AS (SELECT x.block AS a, y.block AS b, (SELECT count(*) FROM c WHERE (c.a = x.block AND c.b = y.block) OR (c.a = y.block AND c.b = x.block)) AS w FROM s x, s y),
g AS MATERIALIZED (SELECT (SELECT list(w ORDER BY a) FROM (SELECT a, list(w ORDER BY b) AS w FROM m GROUP BY a)) AS near, (SELECT list(n ORDER BY block) FROM s) AS size, (SELECT list(block ORDER BY k) FROM o) AS first),
r(k, parts, loads) AS (
  SELECT 4, list_transform(range(0, 13), lambda b: coalesce(list_position(first[1:4], b), 0) - 1), list_transform(range(1, 5), lambda i: size[first[i] + 1]) FROM g UNION ALL
  SELECT k + 1, list_transform(range(1, 14), lambda i: CASE WHEN i = b + 1 THEN p ELSE parts[i] END), list_transform(range(1, 5), lambda i: loads[i] + CASE WHEN i = p + 1 THEN size[b + 1] ELSE 0 END)
  FROM (SELECT k, parts, loads, p, size, list_sort(list_transform(list_filter(range(0, 13), lambda b: parts[b + 1] < 0), lambda b: {{
      'share': -list_sum(list_transform(range(1, 14), lambda i: CASE WHEN parts[i] = p THEN near[b + 1][i] ELSE 0 END)) / list_sum(near[b + 1]), 'size': -size[b + 1], 'block': b}}))[1].block AS b
    FROM (SELECT *, list_position(loads, list_min(loads)) - 1 AS p FROM r, g) WHERE k < 13))
SELECT s.block, parts[s.block + 1]::INT AS part FROM r, s WHERE k = 13"""
_BUDGET = f"""{GRAPH}, c AS MATERIALIZED (SELECT id, 256 + 16 * (in_degree + out_degree) AS c FROM full_deg),
r(id, part, total) AS (SELECT id, 0, c FROM c WHERE id = 0 UNION ALL
  SELECT c.id, CASE WHEN total > 0 AND total + c > 200000 THEN part + 1 ELSE part END, CASE WHEN total > 0 AND total + c > 200000 THEN c ELSE total + c END FROM r JOIN c ON c.id = r.id + 1)
SELECT part, min(id) AS start_id, max(id) AS end_id FROM r GROUP BY part"""
_BALANCED = f"""{GRAPH}, u AS (SELECT dst, sum(count(*)) OVER (ORDER BY dst) AS run FROM e GROUP BY dst),
t AS (SELECT count(*) AS t FROM e),
c1 AS (SELECT min(dst) AS c FROM u, t WHERE run >= t * 1 / 4), c2 AS (SELECT min(dst) AS c FROM u, t WHERE run >= t * 2 / 4 AND dst > (SELECT c FROM c1)), c3 AS (SELECT min(dst) AS c FROM u, t WHERE run >= t * 3 / 4 AND dst > (SELECT c FROM c2)),
ends AS (SELECT c + 1 AS x FROM c1, n WHERE c + 1 < n UNION ALL SELECT c + 1 FROM c2, n WHERE c + 1 < n UNION ALL SELECT c + 1 FROM c3, n WHERE c + 1 < n UNION ALL SELECT n FROM n)
SELECT (row_number() OVER (ORDER BY x) - 1)::INT AS part, coalesce(lag(x) OVER (ORDER BY x), 0)::BIGINT AS start_id, (x - 1)::BIGINT AS end_id FROM ends"""
_COMMIT = f"""{GRAPH}, c AS (SELECT count(*) FILTER (src % 4 = 0) AS base, count(*) FILTER (src % 4 = 1) AS more, count(*) FILTER (src % 4 < 2 AND dst % 50 = 0) AS few, count(*) FILTER (src % 4 < 2 AND dst % 5 = 1) AS many,
  count(*) FILTER (src % 4 < 2) AS one, count(*) FILTER (src % 4 < 2 AND dst % 50 <> 0) AS two, count(*) FILTER (src % 4 < 2 AND dst % 50 <> 0 AND dst % 5 <> 1) AS three FROM e),
p AS (SELECT *, more >= 0.8 * base AS x FROM c), q AS (SELECT *, CASE WHEN x THEN one ELSE base END AS base2 FROM p), y AS (SELECT *, few >= 0.1 * base2 AS y FROM q), z AS (SELECT *, CASE WHEN y THEN two ELSE base2 END AS base3, CASE WHEN y THEN 0 ELSE few END AS left3 FROM y), w AS (SELECT *, left3 + many >= 0.1 * base3 AS z FROM z)
SELECT 0 AS step, one AS edges, CASE WHEN x THEN 0 ELSE more END AS buffered, 0::BIGINT AS removals, x::INT AS version FROM w UNION ALL
SELECT 1, two, CASE WHEN x OR y THEN 0 ELSE more END, CASE WHEN y THEN 0 ELSE few END, x::INT + y::INT FROM w UNION ALL
SELECT 2, three, CASE WHEN x OR y OR z THEN 0 ELSE more END, CASE WHEN z THEN 0 ELSE left3 + many END, x::INT + y::INT + z::INT FROM w"""


def _drawn(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT"


_WALKS = f"""{GRAPH}, sl AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst % 64, dst) - 1 AS slot, count(*) OVER (PARTITION BY src) AS d FROM e),
r(start, step, id) AS (SELECT i, 0, i FROM range(20) x(i) UNION ALL
  SELECT r.start, r.step + 1, sl.dst FROM r JOIN sl ON sl.src = r.id AND sl.slot = {_drawn("0", "r.step + 1", "r.start")} % sl.d WHERE r.step < 4)
SELECT start, step, id FROM r"""
_CROSS = 15

ORACLES: dict[str, str] = {
    "degree_table": f"{GRAPH} SELECT * FROM full_deg",
    "degree_scan": f"{GRAPH} SELECT sum(in_degree)::BIGINT AS in_total, sum(out_degree)::BIGINT AS out_total, max(CASE WHEN id = 7 THEN in_degree END) AS in_7, max(CASE WHEN id = 7 THEN out_degree END) AS out_7 FROM deg",
    "top_degree": f"{GRAPH} SELECT id, in_degree FROM deg ORDER BY in_degree DESC, id LIMIT 50",
    "lowest_degree": f"{GRAPH} SELECT id, in_degree + out_degree AS degree FROM deg ORDER BY 2, 1 LIMIT 10",
    "max_degree_product_root": f"{GRAPH} SELECT root FROM root",
    "dedupe_edges_min": f"{GRAPH} SELECT src, dst, min(w) AS w FROM e GROUP BY src, dst",
    "dedupe_edges_prefer": f"{GRAPH} SELECT src, dst, max(w) AS w FROM e GROUP BY src, dst",
    "edge_multiplicity": "SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2",
    "undirected_neighbours": f"{GRAPH}, {_BOTH} SELECT a AS id, count(*) AS n, min(b) AS least, max(b) AS largest FROM u GROUP BY a",
    "neighbour_lists": f"{GRAPH} SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS targets FROM e GROUP BY src",
    "max_vertex_filter": f"{GRAPH} SELECT src, dst, count(*) AS n FROM e WHERE src <= 100 AND dst <= 100 GROUP BY src, dst",
    "edges_without_vertices": f"{GRAPH} SELECT src, dst, count(*) AS n FROM e WHERE src % 10 <> 0 AND dst % 10 <> 0 GROUP BY src, dst",
    "reset_edge_values": f"{GRAPH} SELECT src, count(*)::DOUBLE AS total FROM e GROUP BY src",
    "edge_aggregate": f"{GRAPH} SELECT sum(2 * w) + 1 AS total FROM e",
    "vertex_sum": f"{GRAPH} SELECT sum(in_degree)::BIGINT AS total FROM full_deg WHERE id >= 10 AND id < 100",
    "active_vertices": f"{GRAPH} SELECT sum((in_degree > 0 AND out_degree > 0)::BIGINT)::BIGINT AS active, count(*) AS total FROM full_deg",
    "hash_relabel_vmap": f"{GRAPH} SELECT id AS old_id, {_HASH} AS new_id FROM v, n",
    "hash_relabel_edges": f"{GRAPH}, m AS (SELECT id AS old_id, {_HASH} AS new_id FROM v, n) SELECT a.new_id AS src, b.new_id AS dst, count(*) AS n FROM e JOIN m a ON e.src = a.old_id JOIN m b ON e.dst = b.old_id GROUP BY 1, 2",
    "hash_intervals": f"{GRAPH}, {_INTERVALS} SELECT part::INT AS part, s AS start_id, t AS end_id FROM iv",
    "degree_sort_vmap": f"{GRAPH}, a AS (SELECT id, in_degree + out_degree AS degree, row_number() OVER (ORDER BY in_degree + out_degree DESC, id) AS k FROM deg), b AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM deg) SELECT b.id AS new_id, a.id AS old_id, degree FROM a JOIN b USING (k)",
    "order_by_degree_vmap": f"{GRAPH}, {_ORDERED} SELECT * FROM od",
    "apply_vmap": f"{GRAPH}, {_ORDERED} SELECT a.new_id AS src, b.new_id AS dst, min(w) AS w FROM e JOIN od a ON e.src = a.old_id JOIN od b ON e.dst = b.old_id GROUP BY 1, 2",
    "partition_file_vmap": f"{GRAPH}, m AS (SELECT id AS old_id, row_number() OVER (ORDER BY id * 7 % 4, id) - 1 AS new_id FROM v) SELECT * FROM m WHERE old_id IN (SELECT id FROM deg)",
    "partition_file_intervals": f"{GRAPH}, s AS (SELECT (id * 7 % 4)::INT AS part, count(*) AS k FROM v GROUP BY 1) SELECT part, (sum(k) OVER (ORDER BY part) - k)::BIGINT AS start_id, (sum(k) OVER (ORDER BY part) - 1)::BIGINT AS end_id FROM s",
    "interval_of_vertex": f"{GRAPH}, {_INTERVALS} SELECT id, part::INT AS part FROM v JOIN iv ON id BETWEEN s AND t",
    "cut_matrix": f"{GRAPH}, {_INTERVALS} SELECT a.part::INT AS part, b.part::INT AS other, count(*) AS edges FROM e JOIN iv a ON src BETWEEN a.s AND a.t JOIN iv b ON dst BETWEEN b.s AND b.t WHERE a.part <> b.part GROUP BY 1, 2",
    "boundary_ratio": f"{GRAPH}, {_INTERVALS}, x AS (SELECT DISTINCT src AS id FROM e JOIN iv a ON src BETWEEN a.s AND a.t JOIN iv b ON dst BETWEEN b.s AND b.t WHERE a.part <> b.part) SELECT part::INT AS part, count(*) AS vertices, count(x.id) AS boundary, round(count(x.id) / count(*), 6) AS ratio FROM deg JOIN iv ON deg.id BETWEEN s AND t LEFT JOIN x ON x.id = deg.id GROUP BY 1",
    "block_matrix": f"{GRAPH} SELECT src % 7 AS block, dst % 7 AS other, count(*) AS edges FROM e GROUP BY 1, 2",
    "range_partition": f"{GRAPH} SELECT dst, count(*) AS n FROM e GROUP BY dst",
    "edge_lines": f"{GRAPH} SELECT src || chr(9) || dst || chr(9) || printf('%.3f', w) AS line FROM e",
    "metis_lines": f"{GRAPH}, {_BOTH}, l AS (SELECT a, string_agg((b + 1)::VARCHAR, ' ' ORDER BY b) AS line FROM u GROUP BY a) SELECT 0::BIGINT AS row, n || ' ' || (SELECT count(*) // 2 FROM u) AS line FROM n UNION ALL SELECT id + 1, coalesce(line, '') FROM v LEFT JOIN l ON a = id",
    "adjlist_lines": f"{GRAPH} SELECT 0::BIGINT AS row, '#vnum=' || n || ' enum=' || (SELECT count(*) FROM e) AS line FROM n UNION ALL SELECT src + 1, src || ' ' || string_agg(dst::VARCHAR, ' ' ORDER BY dst) FROM e GROUP BY src",
    "parse_edgelist": f"{GRAPH} SELECT src, dst, w FROM e",
    "parse_multivalue": f"{GRAPH} SELECT src, dst, 3 AS n, (w::INT + src + dst)::BIGINT AS total FROM e",
    "parse_adjacency": f"{GRAPH} SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst",
    "parse_metis": f"{GRAPH}, {_BOTH} SELECT a AS src, b AS dst FROM u WHERE a < b",
    "generator_grid": _lattice(20, 2),
    "generator_chain": _lattice(500, 1),
    "generator_cross_grid": _grid(_CROSS**2, [(f"id % {_CROSS} < {_CROSS - 1}", "id + 1"), (f"id // {_CROSS} < {_CROSS - 1}", f"id + {_CROSS}"), (f"id % {_CROSS} < {_CROSS - 1} AND id // {_CROSS} < {_CROSS - 1}", f"id + {_CROSS + 1}"), (f"id % {_CROSS} < {_CROSS - 1} AND id >= {_CROSS}", f"id - {_CROSS} + 1")]),
    "generator_cube_grid": _lattice(7, 3),
    "generator_quad_grid": _lattice(4, 4),
    "pagerank_10": _pagerank(10, "SELECT id, round(r, 6) AS rank FROM r10"),
    "pagerank_eps": _pagerank(40, "SELECT id, round(r, 6) AS rank FROM r40"),
    "pagerank_top50": _pagerank(10, "SELECT id, round(r, 6) AS rank FROM r10 ORDER BY 2 DESC, 1 LIMIT 50"),
    "pagerank_delta_log": _pagerank(5, _union([f"SELECT {i}::INT AS iteration, round(sum(abs(a.r - b.r)), 6) AS delta, round(max(abs(a.r - b.r)), 6) AS largest, round(sum(a.r), 6) AS total FROM r{i} a JOIN r{i - 1} b USING (id)" for i in range(1, 6)])),
    "pagerank_watch": _pagerank(5, _union([f"SELECT {i}::INT AS iteration, round(max(CASE WHEN id = 1 THEN r END), 6) AS rank_1, round(max(CASE WHEN id = 8 THEN r END), 6) AS rank_8 FROM r{i}" for i in range(1, 6)])),
    "pagerank_audit": _pagerank(10, _union([f"SELECT {i}::INT AS iteration, round(sum(abs(a.r - b.r)), 6) AS l1, sum((abs(a.r - b.r) > 0.001)::BIGINT)::BIGINT AS active FROM r{i} a JOIN r10 b USING (id)" for i in range(1, 4)])),
    "gas_pagerank": _pagerank(10, "SELECT id, round(r, 6) AS rank FROM r10"),
    "functional_pagerank": _pagerank(5, "SELECT id, round(r, 6) AS rank FROM r5"),
    "functional_sync": f"{GRAPH} SELECT id, 4 AS value FROM v",
    "vertex_program_labels": f"{SIMPLE}, {_WCC} SELECT v.id, coalesce(component, v.id) AS component FROM v LEFT JOIN wcc USING (id)",
    "sssp": _sssp(f"SELECT id, d AS distance FROM d{_SSSP_ROUNDS}"),
    "sssp_histogram": _sssp(f"SELECT d AS label, count(*) AS vertices FROM d{_SSSP_ROUNDS} GROUP BY d"),
    "bfs_levels": f"{SIMPLE}, {_ROOT_LEVELS} SELECT id, level FROM best",
    "undirected_bfs_levels": f"{SIMPLE}, {_BOTH}, {_levels('SELECT a, b FROM u', 'SELECT root, 0::BIGINT FROM root', 10)} SELECT id, level FROM best",
    "klevel_edges": f"{SIMPLE}, {_ROOT_LEVELS} SELECT src, dst FROM e JOIN best ON best.id = e.src WHERE level < 3",
    "multi_root_bfs": f"{SIMPLE}, tops AS (SELECT id FROM deg ORDER BY in_degree DESC, id LIMIT 5), lv(id, label, level) AS (SELECT id, id, 0::BIGINT FROM tops UNION SELECT e.dst, lv.label, lv.level + 1 FROM lv JOIN e ON e.src = lv.id WHERE level < 40), b AS (SELECT id, label, min(level) AS level FROM lv GROUP BY id, label) SELECT id, min(level) AS level, arg_min(label, level * 1000000 + label) AS label FROM b GROUP BY id",
    "wcc": f"{SIMPLE}, {_WCC} SELECT id, component FROM wcc",
    "wcc_sizes": f"{SIMPLE}, {_WCC} SELECT component AS label, count(*) AS vertices FROM wcc GROUP BY 1",
    "wcc_topk": f"{SIMPLE}, {_WCC} SELECT component AS label, count(*) AS vertices FROM wcc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "component_lines": f"{SIMPLE}, {_WCC} SELECT component AS label, count(*) AS vertices, component || ',' || count(*) AS line FROM wcc GROUP BY 1",
    "component_total": f"{SIMPLE}, {_WCC} SELECT count(DISTINCT coalesce(component, v.id)) AS components FROM v LEFT JOIN wcc USING (id)",
    "component_levels": f"{SIMPLE}, {_DIRECTED} SELECT id, component, level FROM cl",
    "undirected_component_levels": f"{SIMPLE}, {_UNDIRECTED} SELECT component, level, count(*) AS vertices FROM cl GROUP BY 1, 2",
    "component_vmap": f"{SIMPLE}, {_UNDIRECTED}, s AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS k FROM cl GROUP BY component) SELECT id AS old_id, row_number() OVER (ORDER BY least(k, 5), CASE WHEN k >= 5 THEN 0 ELSE level END, id) - 1 AS new_id FROM cl JOIN s USING (component)",
    "forward_reach": f"{SIMPLE}, {_FORWARD} SELECT id FROM fw",
    "backward_reach": f"{SIMPLE}, {_BACKWARD} SELECT id FROM bw",
    "giant_scc": f"{SIMPLE}, {_GIANT} SELECT id FROM giant",
    "big_scc_edges": f"{SIMPLE}, {_GIANT} SELECT src, dst, w FROM e WHERE src IN (SELECT id FROM giant) AND dst IN (SELECT id FROM giant)",
    "small_scc_edges": f"{SIMPLE}, {_GIANT} SELECT src, dst, w FROM e WHERE NOT (src IN (SELECT id FROM giant) AND dst IN (SELECT id FROM giant))",
    "bowtie_counts": f"{SIMPLE}, {_REGION} SELECT region, count(*) AS vertices, round(count(*) / (SELECT count(*) FROM reg), 6) AS ratio FROM reg GROUP BY region",
    "bowtie_vmap": f"{SIMPLE}, {_REGION} SELECT id AS old_id, row_number() OVER (ORDER BY CASE region WHEN 'left' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END, id) - 1 AS new_id FROM reg",
    "scc": f"{SIMPLE}, r(a, b) AS (SELECT id, id FROM deg UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), p AS MATERIALIZED (SELECT a, b FROM r) SELECT x.a AS id, min(x.b) AS component FROM p x JOIN p y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
    "scc_check": f"{SIMPLE}, {_GIANT}, i AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM giant) AND dst IN (SELECT id FROM giant)), c AS (SELECT giant.id, (SELECT count(*) FROM i WHERE src = giant.id) + (SELECT count(*) FROM i WHERE dst = giant.id) AS edges FROM giant) SELECT id, edges FROM c WHERE edges < 2",
    "residual_wcc": f"{SIMPLE}, {_FORWARD}, q AS MATERIALIZED (SELECT id FROM deg WHERE id NOT IN (SELECT id FROM fw)), u AS MATERIALIZED (SELECT a, b FROM (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) WHERE a IN (SELECT id FROM q) AND b IN (SELECT id FROM q)), w(id, l) AS (SELECT id, id FROM q UNION SELECT u.b, w.l FROM w JOIN u ON u.a = w.id) SELECT id, min(l) AS block FROM w GROUP BY id",
    "block_vmap": f"{GRAPH} SELECT id AS old_id, row_number() OVER (ORDER BY (id % 13) % 4, id % 13, id) - 1 AS new_id FROM v",
    "factor_functions": "WITH f AS (SELECT p_partkey, ln(p_size + 1.0) AS a, 0.0 AS b, -1.0 AS c FROM part), z AS (SELECT *, ln(exp(a) + exp(b) + exp(c)) AS z FROM f) SELECT p_partkey, round(a - z, 6) AS first, round(greatest(abs(a - z + ln(3)), abs(b - z + ln(3)), abs(c - z + ln(3))), 6) AS norm, (CASE WHEN a >= b THEN 0 ELSE 1 END)::BIGINT AS best FROM z",
    "constant_labels": f"{GRAPH} SELECT id, 300 AS component FROM deg",
    "parse_cassovary": f"{GRAPH} SELECT src, dst FROM e",
    "parse_binary": f"{GRAPH} SELECT src, dst FROM e",
    "parse_binary_values": f"{GRAPH} SELECT src, dst, w FROM e",
    "erdos_renyi_check": "SELECT true AS fair, 0::BIGINT AS loops, 0::BIGINT AS twice",
    "random_weights": f"SELECT src, dst, {_drawn('1', 'src', 'dst', '1')} % 100000000 AS w FROM ({_lattice(20, 2)})",
    "random_out_edge": _WALKS,
    "random_weights_check": f"{GRAPH} SELECT count(*) AS edges, 0::BIGINT AS outside, true AS apart FROM e",
    "random_walk_check": "SELECT 200::BIGINT AS walks, 0::BIGINT AS jumps, 0::BIGINT AS ended_early",
    "voronoi_check": "SELECT 0::BIGINT AS twice, 0::BIGINT AS without_source, 0::BIGINT AS too_large, 0::BIGINT AS alone",
    "dag_check": f"{SIMPLE} SELECT (SELECT count(*) FROM deg) AS vertices, (SELECT count(*) FROM deg) AS ids, (SELECT count(*) FROM deg) AS end, (SELECT count(*) FROM deg) AS covered, (SELECT count(*) FROM e) AS edges, (SELECT sum(w) FROM e) AS weight",
    "gas_control": f"{GRAPH} SELECT id, (id % 3 = 0)::INT + (id >= 100)::INT AS value FROM v",
    "msbfs_blocks": _blocks_by_rounds(6, 8, 4),
    "lpt_assignment": _LPT,
    "greedy_assignment": _GREEDY,
    "budget_intervals": _BUDGET,
    "edge_balanced_intervals": _BALANCED,
    "dynamic_commit": _COMMIT,
    "dynamic_finish": "SELECT i AS src, i + 1 AS dst, 3::BIGINT AS n FROM range(10) x(i)",
    "edge_vectors": f"{GRAPH} SELECT src, dst, 4 AS n, concat_ws(':', src, src + 1, src + 2, src + 3) AS v FROM e",
    "dynamic_add": f"{GRAPH} SELECT id, in_degree, out_degree FROM deg",
    "dynamic_delete": f"WITH e AS (SELECT * FROM {_EDGES} WHERE dst % 3 <> 0 AND NOT (src % 50 = 0 AND src < 1000)) SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id",
}
ORACLES |= {f"distributed_{name}": ORACLES[name] for name in ("sssp", "bfs_levels", "scc")}
