import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexflow.functions import scalars
from vertexflow.operators import analysis, connectivity, partition, programs, rank, relabel, traversal
from vertexflow.operators.components import components
from vertexflow.operators.graph import Dealt, Graph, degrees, edge_slots, random_out_edge, random_walks
from vertexflow.sources import formats, generators, writers
from vertexflow.streaming.dynamic import DynamicGraph, append_values


def edges(spark, pairs, schema="src long, dst long"):
    return Graph(spark.createDataFrame(pairs, schema))


def rows(df):
    return {r[0]: r[1] for r in df.collect()}


def random_graph(spark, n=40, m=90, seed=3):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n), float(rng.randrange(1, 9))) for _ in range(m)]
    return edges(spark, pairs, "src long, dst long, w double")


def test_generators_have_known_distances(spark):
    assert rows(traversal.bfs(generators.chain(spark, 30), spark.range(1))) == {i: i for i in range(30)}
    assert rows(traversal.bfs(generators.grid(spark, 6), spark.range(1))) == {y * 6 + x: x + y for x in range(6) for y in range(6)}


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_traversals_agree_distributed_and_local(spark, local):
    g = random_graph(spark)
    pairs = [(r.src, r.dst, r.w) for r in g.edges.collect()]
    dist = {0: 0.0}
    for _ in range(50):
        for a, b, w in pairs:
            if a in dist and dist[a] + w < dist.get(b, 1e9):
                dist[b] = dist[a] + w
    assert rows(traversal.shortest_paths(g, 0, local_edges=local)) == dist
    level, frontier = {0: 0}, {0}
    while frontier:
        frontier = {b for a, b, _ in pairs if a in frontier and b not in level}
        level |= {b: max(level.values()) + 1 for b in frontier}
    start = spark.range(1).select("id", F.col("id").alias("label"))
    assert rows(traversal.label_levels(g, start, local_edges=local).select("id", "level")) == level


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_strong_components(spark, local):
    g = edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 0), (5, 7)])
    assert rows(connectivity.strong_components(g, local_edges=local)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}


def test_components_of_long_chain_and_cycle(spark):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).repartition(7)
    for contract in (True, False):
        assert {r.root for r in components(chain, contract=contract).collect()} == {0}
    assert components(chain.limit(0)).count() == 0


def test_components_by_one_task_match_rounds(spark):
    pairs = spark.range(3_000).select((F.col("id") * 7 % 911).alias("src"), (F.col("id") * 13 % 1_500 + 911 * (F.col("id") % 3)).alias("dst")).where("src % 5 = dst % 5").repartition(7)
    by_rounds = sorted(map(tuple, components(pairs).collect()))
    one = components(pairs, local_edges=1_000_000)
    assert sorted(map(tuple, one.collect())) == by_rounds and len({r for _, r in by_rounds}) > 1 and len(one.inputFiles()) == 1
    assert sorted(map(tuple, components(pairs, local_edges=10).collect())) == by_rounds
    assert components(pairs.limit(0), local_edges=10).count() == 0


def test_pagerank_of_cycle_and_parallel_edges(spark):
    n = 12
    ring = edges(spark, [(i, (i + 1) % n) for i in range(n)])
    assert {round(r, 9) for r in rows(rank.pagerank(ring, 8).ranks).values()} == {1.0}
    found = rows(rank.pagerank(edges(spark, [(0, 1), (0, 1), (0, 1), (0, 2)]), 1).ranks)
    assert found[1] - 0.15 == pytest.approx(0.85 * 0.75)
    gap = rows(rank.pagerank(edges(spark, [(0, 1), (1, 5)]), 3).ranks)
    assert gap[3] == pytest.approx(0.15)


def test_bow_tie_of_two_cycles(spark):
    g = edges(spark, [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)])
    assert rows(connectivity.bow_tie(g, root=0)) == {0: "middle", 1: "middle", 2: "right", 3: "right"}
    inside, rest = connectivity.split_giant(g, root=0)
    assert inside.edges.count() == 2 and rest.edges.count() == 3


def test_functional_values_equal_iterations(spark):
    kernel = programs.FunctionalKernel(lambda i, o: F.lit(0), lambda s: s, lambda t, old: old + 1, lambda v, o: v, F.max)
    assert {r.value for r in programs.run_functional(random_graph(spark), kernel, 6).collect()} == {5}


def test_relabelings_are_permutations(spark):
    g = random_graph(spark)
    n = g.size()
    for vmap in (relabel.hash_relabel(g.vertices(), n, 7), relabel.order_by_degree(g), relabel.group_relabel(g.vertices(), F.col("id") % 3)):
        assert sorted(r.new_id for r in vmap.collect()) == list(range(n))
    moved = relabel.apply_map(g, relabel.order_by_degree(g))
    assert sorted(degrees(moved).select("in_degree").collect()) == sorted(degrees(g).select("in_degree").collect())


def test_assignments(spark):
    assert dict(partition.lpt_assignment([(1, 5), (2, 4), (3, 3), (4, 2)], 2)) == {1: 0, 2: 1, 3: 1, 4: 0}
    made = dict(partition.greedy_assignment([(1, 5), (2, 4), (3, 1), (4, 1)], [(1, 3, 9), (2, 4, 9)], 2))
    assert made[3] == made[1] and made[4] == made[2]


def test_blocks_cover_what_they_should(spark):
    g = random_graph(spark, 60, 150)
    blocks = partition.voronoi_blocks(g, rate=0.05, most=10, growth=3, rounds=3)
    sizes = Counter(r.block for r in blocks.collect())
    assert max(sizes.values()) <= 10 and blocks.select("id").distinct().count() == blocks.count()
    vmap, intervals, moved = partition.dag_partition(g, 3, roots=4, levels=3)
    assert sorted(r.new_id for r in vmap.collect()) == list(range(degrees(g).count()))
    assert moved.edges.count() == g.edges.count()
    ends = sorted((r.start_id, r.end_id) for r in intervals.collect())
    assert all(b[0] == a[1] + 1 for a, b in zip(ends, ends[1:], strict=False))


def test_fair_draws_from_few_numbers_repeat(spark):
    """Many draws repeat by chance alone; copies of a draw are still seen."""
    made = generators.random_weights(generators.grid(spark, 100), below=100_000).edges
    again = made.where("src % 20 = 0")
    fair = lambda df: df.agg(analysis.fair_distinct(F.count_distinct("w"), F.count("*"), 100_000)).first()[0]
    assert made.select("w").distinct().count() < 0.95 * made.count()
    assert fair(made) and not fair(made.union(again)) and fair(made.limit(0))


def test_edge_balanced_intervals_cut_at_vertices_of_large_graphs(spark):
    """Ids beyond the number of spans, and a hub that reaches several shares at once."""
    g = Graph(spark.range(200_000).selectExpr("id as src", "case when id % 3 = 0 then 100001 else (id * 7919) % 1000003 end as dst"))
    counts = Counter(r.dst for r in g.edges.select("dst").collect())
    total = counts.total()
    for parts in (4, 7, 600):
        cuts, run = [], 0
        for v in sorted(counts):
            run += counts[v]
            if len(cuts) < parts - 1 and run * parts >= total * (len(cuts) + 1):
                cuts.append(v + 1)
        ends = [c for c in cuts if c < g.size()] + [g.size()]
        assert partition.edge_balanced_intervals(g, parts) == [(p, a, b - 1) for p, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]


def _plain_blocks(pairs, roots, levels, stop_ratio):
    deg = Counter({v: 0 for p in pairs for v in p}) | Counter(b for _, b in pairs)
    out_of = {v: [b for a, b in pairs if a == v] for p in pairs for v in p}
    deg = {v: deg[v] for v in out_of}
    active, out = set(deg), {}
    while active and len(active) >= len(deg) * stop_ratio:
        front = {v: v for v in sorted(active, key=lambda v: (-deg[v], v))[:roots]}
        for level in range(levels):
            out |= {v: (b, level) for v, b in front.items()}
            active -= set(front)
            new = {}
            for v, b in front.items():
                for w in out_of[v]:
                    if w in active:
                        new[w] = min(b, new.get(w, b))
            front = new
    return out


@pytest.mark.parametrize("local", [0, 100, 1_000_000])
def test_multi_source_blocks_match_a_plain_loop(spark, local):
    """All rounds in one task, none, and the last ones; parallel edges count in the degrees."""
    g = random_graph(spark, n=120, m=260)
    pairs = [(r.src, r.dst) for r in g.edges.collect()]
    made = partition.multi_source_blocks(g, roots=3, levels=3, local_edges=local)
    assert {r.id: (r.block, r.level) for r in made.collect()} == _plain_blocks(pairs, 3, 3, 0.1)


def test_dag_partition_reads_its_edges_once(spark):
    """The graph may be a long query, and was derived again by every step and round."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    g = random_graph(spark, n=120, m=260)
    n = g.edges.count()
    vmap, intervals, moved = partition.dag_partition(Graph(g.edges.mapInPandas(counted, "src long, dst long, w double")), 3, roots=4, levels=3)
    assert vmap.count() == degrees(g).count() and moved.edges.count() == n and intervals.count() > 0
    assert seen.value == n
    assert "Window" not in vmap._jdf.queryExecution().toString()  # the map is a table: ranks are not made again for each use


def test_greedy_assignment_takes_the_largest_share(spark):
    rng = random.Random(5)
    sizes = [(b, rng.randrange(1, 5)) for b in range(200)]
    links = [(rng.randrange(200), rng.randrange(200), rng.randrange(1, 4)) for _ in range(500)]
    near = {b: Counter() for b, _ in sizes}
    for a, b, n in links:
        if a != b:
            near[a][b] += n
            near[b][a] += n
    size, order = dict(sizes), sorted(dict(sizes), key=lambda b: (-dict(sizes)[b], b))
    part_of = {b: p for p, b in enumerate(order[:3])}
    while len(part_of) < len(size):
        loads = [sum(size[b] for b, q in part_of.items() if q == p) for p in range(3)]
        part = loads.index(min(loads))
        ties = {b: sum(n for o, n in near[b].items() if part_of.get(o) == part) for b in size if b not in part_of}
        met = [b for b in ties if ties[b]]
        part_of[min(met, key=lambda b: (-ties[b] / near[b].total(), -size[b], b)) if met else next(b for b in order if b not in part_of)] = part
    assert partition.greedy_assignment(sizes, links, 3) == sorted(part_of.items())


def test_budget_intervals_match_a_sequential_cut(spark):
    g = random_graph(spark)
    deg = {r.id: r.in_degree + r.out_degree for r in degrees(g, isolated=True).collect()}
    out, start, total = [], 0, 0
    for v in range(g.size()):
        cost = 8 + 2 * deg[v]
        if total and total + cost > 60:
            out.append((len(out), start, v - 1))
            start, total = v, 0
        total += cost
    assert partition.budget_intervals(g, 60, 8, 2) == [*out, (len(out), start, g.size() - 1)]


def test_text_formats(spark, tmp_path):
    def read(text, f, *args, **kw):
        path = tmp_path / f"{abs(hash(text))}.txt"
        path.write_text(text)
        return f(spark, str(path), *args, **kw)

    found = read("# c\n% c\n0\t1\n1,2\n2 0 0.5\n3 3\n", formats.read_edge_list, "double", default=1.0)
    assert sorted(map(tuple, found.edges.collect())) == [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 0.5)]
    assert [list(r.w) for r in read("0\t1\t1:2:3\n", formats.read_multi_value).edges.collect()] == [[1, 2, 3]]
    graph, wrong = read("0 2 1 2\n1 1 2\n2 3 0\n", formats.read_adjacency)
    assert graph.edges.count() == 4 and [tuple(r) for r in wrong.collect()] == [(2, 3, 1)]
    assert sorted(map(tuple, read("% c\n4 3\n2 3\n1\n1 4\n3\n", formats.read_metis).edges.collect())) == [(0, 1), (0, 2), (2, 3)]
    assert sorted(map(tuple, read("0 2\n1\n2\n", formats.read_cassovary).edges.collect())) == [(0, 1), (0, 2)]
    assert sorted(map(tuple, read("# old\tnew\n0\t3\n", formats.read_vertex_map).collect())) == [(0, 3)]
    assert [tuple(r) for r in read("1\n0\n", formats.read_partition_file).collect()] == [(0, 1), (1, 0)]
    assert read("0\t4\n5\t9\n", formats.read_intervals) == [(0, 0, 4), (1, 5, 9)]


def test_binary_formats_and_cache(spark, tmp_path):
    np.array([(0, 1), (2, 2), (1, 3)], "<u4").tofile(tmp_path / "a.bin")
    assert sorted(map(tuple, formats.read_binary(spark, str(tmp_path / "a.bin")).edges.collect())) == [(0, 1), (1, 3)]
    np.array([(0, 1, 0.5)], [("a", "<u4"), ("b", "<u4"), ("w", "<f4")]).tofile(tmp_path / "b.bin")
    assert [tuple(r) for r in formats.read_binary(spark, str(tmp_path / "b.bin"), "<f4").edges.collect()] == [(0, 1, 0.5)]
    (tmp_path / "g.txt").write_text("0 1\n1 2\n")
    for _ in range(2):
        assert formats.cached_graph(spark, str(tmp_path / "g.txt"), str(tmp_path / "store")).edges.count() == 2


def test_pair_and_boolean_values(spark):
    df = spark.createDataFrame([("3",), ("1",)], "t string")
    made = df.select(formats.parse_value(F.col("t"), "int-int").alias("p"), formats.parse_value(F.col("t"), "boolean").alias("b")).collect()
    assert [(r.p.left, r.p.right, r.b) for r in made] == [(3, 3, False), (1, 1, True)]


def test_metis_round_trip(spark, tmp_path):
    g = random_graph(spark)
    lines = [r.line for r in writers.metis_lines(g).orderBy("row").collect()]
    (tmp_path / "g.metis").write_text("\n".join(lines) + "\n")
    back = formats.read_metis(spark, str(tmp_path / "g.metis"))
    assert {frozenset(r) for r in back.edges.select("src", "dst").collect()} == {frozenset((r.src, r.dst)) for r in g.edges.collect()}


def test_factors_and_random_functions(spark):
    df = spark.range(400).select("id", F.array(F.lit(0.0), F.lit(1.0)).alias("f"))
    n = scalars.factor_normalize(F.col("f"))
    total, best = df.select(F.aggregate(n, F.lit(0.0), lambda a, x: a + F.exp(x)), scalars.factor_max_assignment(F.col("f"))).first()
    assert total == pytest.approx(1) and best == 1
    assert scalars.factor_damp(F.col("f"), F.col("f"), 0) is not None
    mean = df.agg(F.avg(scalars.uniform(1, F.col("id"))), F.avg(scalars.gaussian(1, F.col("id"))), F.avg(scalars.bernoulli(1, F.col("id"), p=0.25).cast("int")), F.avg(scalars.gamma(1, F.col("id"), alpha=2))).first()
    assert abs(mean[0] - 0.5) < 0.1 and abs(mean[1]) < 0.2 and abs(mean[2] - 0.25) < 0.1 and abs(mean[3] - 2) < 0.3


def test_dynamic_graph_adds_removes_and_compacts(spark):
    start = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "src long, dst long, w double")
    g = DynamicGraph(spark, start)
    g.add_edges(spark.createDataFrame([(0, 2, 1.0), (3, 3, 1.0)], start.schema))
    g.remove_edges(spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert sorted((r.src, r.dst) for r in g.edges().collect()) == [(0, 1), (0, 2), (2, 0)]
    g.add_edges(spark.createDataFrame([(1, 2, 2.0)], start.schema))
    assert g.compact_if_needed() and g.info()["removals"] == 0
    g.remove_all_edges(spark.createDataFrame([(0,)], "id long"))
    assert [(r.src, r.dst) for r in g.edges().collect()] == [(1, 2)]


def test_dynamic_graph_consumes_a_stream(spark, tmp_path):
    schema = "op string, src long, dst long"
    source = tmp_path / "in"
    for i, batch in enumerate([[("add", 0, 1), ("add", 1, 2)], [("remove", 0, 1), ("add", 2, 3)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        if i == 0:
            g = DynamicGraph(spark, spark.createDataFrame([(5, 6)], "src long, dst long"))
        g.consume(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, g.edges().collect())) == [(1, 2), (2, 3), (5, 6)]


def test_edge_vectors_grow(spark):
    g = Graph(spark.createDataFrame([(0, 1, [])], "src long, dst long, v array<long>"))
    for k in range(3):
        g = append_values(g, "v", F.col("src") + k)
    assert g.edges.first().v == [0, 1, 2]


def test_empty_graph(spark):
    g = edges(spark, [])
    assert g.size() == 0 and rank.pagerank(g, 2).ranks.count() == 0
    assert connectivity.strong_components(g).count() == 0 and traversal.level_edges(g, 0).count() == 0


def test_random_out_edges_are_uniform_over_parallel_ones(spark):
    edges = [(0, 1)] * 3 + [(0, 2)] + [(5, 6)]
    g = Graph(spark.createDataFrame(edges, "src long, dst long"))
    slots = edge_slots(g).orderBy("id", "slot").collect()
    assert [(r.id, r.slot, r.out_degree) for r in slots] == [(0, 0, 4), (0, 1, 4), (0, 2, 4), (0, 3, 4), (5, 0, 1)]
    assert sorted(r.neighbour for r in slots) == [1, 1, 1, 2, 6]
    hits = [random_out_edge(g, seed).where("id = 0").first().neighbour for seed in range(60)]
    assert 30 <= hits.count(1) < 58 and hits.count(2) > 2
    many = Graph(spark.range(2000).selectExpr("id as src", "explode(array(5000, 5000, 5000, 5001)) as dst"))
    drawn = random_out_edge(many, 7)
    assert drawn.count() == 2000 and 1400 < drawn.where("neighbour = 5000").count() < 1600


def test_walks_that_meet_go_on_apart(spark):
    g = Graph(spark.range(1, 400).selectExpr("id as src", "0 as dst").unionByName(spark.range(400, 900).selectExpr("0 as src", "id as dst")))
    walks = random_walks(g, spark.range(1, 400), 2).where("step = 2")
    assert walks.count() == 399 and walks.select("id").distinct().count() > 200


def test_hubs_are_dealt_over_tasks(spark):
    """A star: the edges of its centre are in many parts, and joins find all of them."""
    edges = spark.range(1, 5001).selectExpr("0 as src", "id as dst").unionByName(spark.range(1, 10).selectExpr("id as src", "0 as dst"))
    dealt = Dealt(edges, most=100)
    assert dealt.edges.select("_part").distinct().count() == 50
    values = spark.range(10).selectExpr("id as src", "id + 1 as v")
    assert dealt.join(values).groupBy("src").agg(F.count("*").alias("n"), F.max("v").alias("v")).where("src = 0").first()[1:] == (5000, 1)
    assert dealt.join(values).count() == 5009
    dealt.free()


def test_lines_are_numbered_across_files_and_splits(spark, tmp_path):
    (tmp_path / "p").mkdir()
    parts = [i * 7 % 11 for i in range(3000)]
    (tmp_path / "p" / "a.txt").write_text("\n".join(map(str, parts[:2000])) + "\n")
    (tmp_path / "p" / "b.txt").write_text("\n".join(map(str, parts[2000:])) + "\n\n")
    lists = ["3 4", "2 3", "% note", "1", "1"] + [""] * 0
    (tmp_path / "m.txt").write_text("\n".join(lists) + "\n")
    owners = {v: [(v * k) % 997 + 1000 for k in range(1, 1 + v % 5)] for v in range(400)}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.txt").write_text("".join(f"{v} {len(d)}\n" + "".join(f"{t}\n" for t in d) for v, d in owners.items()))
    (tmp_path / "c" / "x.txt.tmp").write_text("1 1\n2\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        found = formats.read_partition_file(spark, str(tmp_path / "p")).orderBy("id").collect()
        assert [(r.id, r.part) for r in found] == list(enumerate(parts))
        assert sorted(map(tuple, formats.read_metis(spark, str(tmp_path / "m.txt")).edges.collect())) == [(0, 1), (0, 2)]
        edges = formats.read_cassovary(spark, str(tmp_path / "c"))
        assert sorted(map(tuple, edges.edges.collect())) == sorted((v, t) for v, d in owners.items() for t in d)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_budget_intervals_fetch_spans_of_many_cuts(spark, monkeypatch):
    g = Graph(spark.range(0, 4000).selectExpr("id as src", "(id * id + 1) % 700 as dst"))
    whole = partition.budget_intervals(g, 90, 8, 2)
    monkeypatch.setattr(partition, "SPANS", 64)
    monkeypatch.setattr(partition, "FETCHED", 5)
    assert partition.budget_intervals(g, 90, 8, 2) == whole and len(whole) > 500


def test_machine_local_folders_are_for_local_mode_alone(spark, monkeypatch):
    from types import SimpleNamespace

    from vertexflow import storage

    conf = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *a: None), master="local-cluster[3,2,1000]")
    with pytest.raises(ValueError):
        storage.shared_root(SimpleNamespace(sparkContext=conf, conf=SimpleNamespace(get=lambda *a: None)))


def test_loops_leave_only_their_result(spark):
    from vertexflow.plans.loop import iterate

    made = []
    start = spark.range(5).withColumn("v", F.lit(0))
    state, _ = iterate(start, lambda s, i: s.withColumn("v", F.col("v") + 1), 7, fuse=2, tag="leaktest")
    assert state.agg(F.sum("v")).first()[0] == 35
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    made = [p for p in Path(root.removeprefix("file:")).glob("vertexflow/leaktest-*")]
    assert len(made) == 1
