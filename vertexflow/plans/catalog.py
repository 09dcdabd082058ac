"""Named queries of the graph library and, where SQL can express them, their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexflow.functions import scalars
from vertexflow.operators import analysis, connectivity, partition, programs, rank, relabel, traversal
from vertexflow.operators.graph import Graph, degrees, neighbours, random_walks
from vertexflow.sources import formats, generators, writers
from vertexflow.storage import materialize, new_path
from vertexflow.streaming.dynamic import DynamicGraph, append_values

from .oracles import ORACLES  # noqa: F401
from .tables import copurchase, nation_trade, simple_copurchase, table

QUERIES: dict = {}
PARTS = 4


def query(f):
    QUERIES[f.__name__] = f
    return f


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _root(graph: Graph) -> int:
    return rank.in_out_product_root(graph)


# Degrees, duplicates, sets


@query
def degree_table(spark: SparkSession, d: str) -> DataFrame:
    return degrees(copurchase(spark, d), isolated=True)


@query
def degree_scan(spark, d):
    return degrees(copurchase(spark, d)).agg(F.sum("in_degree").alias("in_total"), F.sum("out_degree").alias("out_total"), F.max(F.when(F.col("id") == 7, F.col("in_degree"))).alias("in_7"), F.max(F.when(F.col("id") == 7, F.col("out_degree"))).alias("out_7"))


@query
def top_degree(spark, d):
    return analysis.top_degree_vertices(copurchase(spark, d), 50)


@query
def lowest_degree(spark, d):
    deg = degrees(copurchase(spark, d)).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return analysis.top_vertices(deg, "degree", 10, largest=False)


@query
def max_degree_product_root(spark, d):
    return spark.createDataFrame([(_root(copurchase(spark, d)),)], "root long")


@query
def dedupe_edges_min(spark, d):
    return copurchase(spark, d).dedupe(w=F.min("w")).edges


@query
def dedupe_edges_prefer(spark, d):
    return copurchase(spark, d).prefer(-F.col("w")).edges


@query
def edge_multiplicity(spark, d):
    return nation_trade(spark, d).dedupe(n=F.count("*")).edges


@query
def undirected_neighbours(spark, d):
    return neighbours(copurchase(spark, d)).groupBy("id").agg(F.count("*").alias("n"), F.min("neighbour").alias("least"), F.max("neighbour").alias("largest"))


@query
def neighbour_lists(spark, d):
    return copurchase(spark, d).edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("targets"))


@query
def max_vertex_filter(spark, d):
    return Graph(copurchase(spark, d).edges, max_vertex=100).dedupe(n=F.count("*")).edges


@query
def edges_without_vertices(spark, d):
    g = copurchase(spark, d)
    return g.without(g.vertices().where("id % 10 = 0")).dedupe(n=F.count("*")).edges


@query
def reset_edge_values(spark, d):
    g = copurchase(spark, d)
    return Graph(g.edges.withColumn("w", F.lit(1.0))).edges.groupBy("src").agg(F.sum("w").alias("total"))


@query
def edge_aggregate(spark, d):
    return programs.aggregate_edges(copurchase(spark, d), F.col("w") * 2, finish=lambda t: t + 1)


@query
def vertex_sum(spark, d):
    return rank.vertex_total(degrees(copurchase(spark, d), isolated=True), "in_degree", 10, 100)


@query
def active_vertices(spark, d):
    return analysis.active_count(degrees(copurchase(spark, d), isolated=True), (F.col("in_degree") > 0) & (F.col("out_degree") > 0))


# Relabeling and partition quality


@query
def hash_relabel_vmap(spark, d):
    g = copurchase(spark, d)
    return relabel.hash_relabel(g.vertices(), g.size(), PARTS)


@query
def hash_relabel_edges(spark, d):
    g = copurchase(spark, d)
    return relabel.apply_map(g, relabel.hash_relabel(g.vertices(), g.size(), PARTS)).dedupe(n=F.count("*")).edges


@query
def hash_intervals(spark, d):
    return relabel.hash_intervals(spark, copurchase(spark, d).size(), PARTS)


@query
def degree_sort_vmap(spark, d):
    return relabel.degree_sort(copurchase(spark, d))


@query
def order_by_degree_vmap(spark, d):
    return relabel.order_by_degree(copurchase(spark, d))


@query
def apply_vmap(spark, d):
    g = copurchase(spark, d)
    return relabel.apply_map(g, relabel.order_by_degree(g)).dedupe(w=F.min("w")).edges


@query
def partition_file_vmap(spark, d):
    g = copurchase(spark, d)
    return relabel.partition_file_map(g.vertices().withColumn("part", (F.col("id") * 7 % PARTS).cast("int")), g)


@query
def partition_file_intervals(spark, d):
    g = copurchase(spark, d)
    return relabel.group_intervals(g.vertices().withColumn("part", (F.col("id") * 7 % PARTS).cast("int")), "part")


@query
def interval_of_vertex(spark, d):
    g = copurchase(spark, d)
    return g.vertices().withColumn("part", partition.interval_of(F.col("id"), partition.even_intervals(g.size(), PARTS)))


@query
def cut_matrix(spark, d):
    g = copurchase(spark, d)
    parts = partition.even_intervals(g.size(), PARTS)
    return partition.cut_matrix(g, partition.interval_of(F.col("src"), parts), partition.interval_of(F.col("dst"), parts))


@query
def boundary_ratio(spark, d):
    g = copurchase(spark, d)
    parts = partition.even_intervals(g.size(), PARTS)
    return _six(partition.boundary(g, lambda v: partition.interval_of(v, parts)), "ratio")


@query
def block_matrix(spark, d):
    g = copurchase(spark, d)
    return partition.block_matrix(g, g.vertices().withColumn("block", F.col("id") % 7))


@query
def budget_intervals(spark, d):
    made = partition.budget_intervals(copurchase(spark, d), 200_000)
    return spark.createDataFrame(made, "part int, start_id long, end_id long")


@query
def edge_balanced_intervals(spark, d):
    made = partition.edge_balanced_intervals(copurchase(spark, d), PARTS)
    return spark.createDataFrame(made, "part int, start_id long, end_id long")


@query
def range_partition(spark, d):
    return partition.range_partition(copurchase(spark, d), PARTS).groupBy("dst").agg(F.count("*").alias("n"))


# Lines, readers, generators


@query
def edge_lines(spark, d):
    return writers.edge_lines(copurchase(spark, d), value_format="%.3f")


@query
def metis_lines(spark, d):
    return writers.metis_lines(copurchase(spark, d))


@query
def adjlist_lines(spark, d):
    return writers.adjacency_lines(copurchase(spark, d))


def _stored(lines: DataFrame, tag: str, ordered: bool = False) -> str:
    path = new_path(lines.sparkSession, tag)
    writers.write_lines(lines.coalesce(1) if ordered else lines, path)
    return path


@query
def parse_edgelist(spark, d):
    path = _stored(writers.edge_lines(copurchase(spark, d)), "edge-lines")
    return formats.read_graph(spark, path, "edgelist", "double").edges


@query
def parse_multivalue(spark, d):
    line = F.concat(F.concat_ws("\t", "src", "dst"), F.lit("\t"), F.concat_ws(":", F.col("w").cast("int"), F.col("src"), F.col("dst")))
    path = _stored(copurchase(spark, d).edges.select(line.alias("line")), "multi-lines")
    return formats.read_multi_value(spark, path).edges.select("src", "dst", F.size("w").alias("n"), F.aggregate("w", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@query
def parse_adjacency(spark, d):
    g = copurchase(spark, d)
    lines = g.edges.groupBy("src").agg(F.concat_ws(" ", F.col("src"), F.count("*"), F.array_join(F.collect_list("dst"), " ")).alias("line"))
    return formats.read_adjacency(spark, _stored(lines, "adjacency-lines"))[0].dedupe(n=F.count("*")).edges


@query
def parse_metis(spark, d):
    lines = writers.metis_lines(copurchase(spark, d)).orderBy("row")
    return formats.read_metis(spark, f"{_stored(lines, 'metis-lines', True)}/*.txt").edges


@query
def parse_cassovary(spark, d):
    return formats.read_cassovary(spark, _stored(writers.cassovary_lines(copurchase(spark, d)), "cassovary-lines")).edges


def _binary(spark: SparkSession, d: str, value: str | None = None) -> DataFrame:
    path = new_path(spark, "binary-edges")
    writers.write_binary(copurchase(spark, d), path, value)
    return formats.read_binary(spark, path, value).edges


@query
def parse_binary(spark, d):
    return _binary(spark, d)


@query
def parse_binary_values(spark, d):
    return _binary(spark, d, "<f4")


@query
def generator_grid(spark, d):
    return generators.grid(spark, 20).edges


@query
def generator_chain(spark, d):
    return generators.chain(spark, 500).edges


@query
def generator_cross_grid(spark, d):
    return generators.cross_grid(spark, 15).edges


@query
def generator_cube_grid(spark, d):
    return generators.cube_grid(spark, 7).edges


@query
def generator_quad_grid(spark, d):
    return generators.quad_grid(spark, 4).edges


@query
def generator_erdos_renyi(spark, d):
    return generators.erdos_renyi(spark, 300, 0.05, seed=1).edges


@query
def erdos_renyi_check(spark, d):
    """Number of edges within five deviations of what is expected, no loops, no pair twice."""
    made = generator_erdos_renyi(spark, d)
    pairs, p = 300 * 299 / 2, 0.05
    fair = F.abs(F.count("*") - pairs * p) < 5 * (pairs * p * (1 - p)) ** 0.5
    ends = F.struct(F.least("src", "dst"), F.greatest("src", "dst"))
    return made.agg(fair.alias("fair"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), (F.count("*") - F.count_distinct(ends)).alias("twice"))


@query
def random_weights(spark, d):
    return generators.random_weights(generators.grid(spark, 20), seed=1).edges


@query
def random_weights_check(spark, d):
    """On parallel edges: all in range, and as many different ones as fair draws give."""
    g = Graph(copurchase(spark, d).edges.select("src", "dst"))
    made = generators.random_weights(g, seed=1).edges
    return made.agg(F.count("*").alias("edges"), F.count_if((F.col("w") < 0) | (F.col("w") >= 100_000_000)).alias("outside"), analysis.fair_distinct(F.count_distinct("w"), F.count("*"), 100_000_000).alias("apart"))


# PageRank and programs


@query
def pagerank_10(spark, d):
    return _six(rank.pagerank(copurchase(spark, d), 10).ranks, "rank")


@query
def pagerank_eps(spark, d):
    return _six(rank.pagerank(copurchase(spark, d), 100, epsilon=1e-9).ranks, "rank")


@query
def pagerank_top50(spark, d):
    ranks = _six(rank.pagerank(copurchase(spark, d), 10).ranks, "rank")
    return analysis.top_vertices(ranks, "rank", 50)


@query
def pagerank_delta_log(spark, d):
    return _six(rank.delta_log(spark, rank.pagerank(copurchase(spark, d), 5, epsilon=0.0).log), "delta", "largest", "total")


@query
def pagerank_watch(spark, d):
    log = rank.pagerank(copurchase(spark, d), 5, watch=(1, 8)).log
    return spark.createDataFrame([(m["iteration"], round(m["rank_1"], 6), round(m["rank_8"], 6)) for m in log], "iteration int, rank_1 double, rank_8 double")


@query
def pagerank_audit(spark, d):
    g = copurchase(spark, d)
    final = rank.pagerank(g, 10).ranks
    log = rank.pagerank(g, 3, audit=final).log
    return spark.createDataFrame([(m["iteration"], round(m["l1"], 6), m["active"]) for m in log], "iteration int, l1 double, active long")


@query
def gas_pagerank(spark, d):
    def ranked(total, out):
        r = 0.15 + 0.85 * F.coalesce(total, F.lit(0.0))
        return F.struct(r.alias("rank"), (r / F.greatest(out, F.lit(1))).alias("share"))

    program = programs.GASProgram(
        init=lambda: F.struct(F.lit(1.0).alias("rank"), (1 / F.greatest("out_degree", F.lit(1))).alias("share")),
        gather=lambda v, edge: v["share"],
        apply=lambda old, total, out: ranked(total, out),
        scatter=lambda new, old: F.lit(True),
    )
    return programs.run_gas(copurchase(spark, d), program, 10)[0].select("id", F.round("value.rank", 6).alias("rank"))


@query
def gas_control(spark, d):
    """Values count the rounds that a vertex ran in; the schedule is made by hand."""

    def control(ctx: programs.GASContext) -> None:
        if ctx.iteration == 0:
            ctx.signal(spark.range(0, ctx.num_vertices, 3))
        elif ctx.iteration == 1:
            ctx.signal_all()
            ctx.remove(0, 99)
        else:
            ctx.stop()

    program = programs.GASProgram(init=lambda: F.lit(0), gather=lambda v, edge: v, apply=lambda old, total, out: old + 1, scatter=lambda new, old: F.lit(False), gather_edges="none", scatter_edges="none", control=control)
    return programs.run_gas(copurchase(spark, d), program, 10, signalled=spark.range(0))[0]


@query
def functional_pagerank(spark, d):
    kernel = programs.FunctionalKernel(
        initial=lambda i, o: F.lit(1.0),
        gather=lambda seen: seen,
        apply=lambda total, old: 0.15 + 0.85 * total,
        scatter=lambda v, out: v / out,
        zero=0.0,
    )
    return programs.run_functional(copurchase(spark, d), kernel, 6).select("id", F.round("value", 6).alias("rank"))


@query
def functional_sync(spark, d):
    kernel = programs.FunctionalKernel(initial=lambda i, o: F.lit(0), gather=lambda s: s, apply=lambda total, old: old + 1, scatter=lambda v, out: v, plus=F.max, zero=0)
    return programs.run_functional(copurchase(spark, d), kernel, 5)


@query
def vertex_program_labels(spark, d):
    program = programs.VertexProgram(init=lambda: F.col("id"), message=lambda v, edge: v, combine=F.min, apply=lambda old, new: F.least(old, new), direction="both", frontier=True)
    values, _ = programs.run_program(simple_copurchase(spark, d), program, 100)
    return values.withColumnRenamed("value", "component")


# Traversal and connectivity


@query
def sssp(spark, d):
    g = simple_copurchase(spark, d)
    return traversal.shortest_paths(g, _root(g))


@query
def sssp_histogram(spark, d):
    g = simple_copurchase(spark, d)
    return analysis.label_histogram(traversal.shortest_paths(g, _root(g)), "distance")


@query
def bfs_levels(spark, d):
    g = simple_copurchase(spark, d)
    return traversal.bfs(g, spark.range(_root(g), _root(g) + 1))


@query
def undirected_bfs_levels(spark, d):
    g = simple_copurchase(spark, d)
    return traversal.bfs(g.undirected(), spark.range(_root(g), _root(g) + 1), 10)


@query
def klevel_edges(spark, d):
    g = simple_copurchase(spark, d)
    return traversal.level_edges(g, _root(g), 3)


@query
def multi_root_bfs(spark, d):
    g = simple_copurchase(spark, d)
    roots = analysis.top_degree_vertices(g, 5).select("id", F.col("id").alias("label"))
    return traversal.label_levels(g, roots)


@query
def wcc(spark, d):
    return connectivity.weak_components(simple_copurchase(spark, d))


@query
def wcc_sizes(spark, d):
    return analysis.label_histogram(connectivity.weak_components(simple_copurchase(spark, d)), "component")


@query
def wcc_topk(spark, d):
    return wcc_sizes(spark, d).orderBy(F.desc("vertices"), "label").limit(3)


@query
def component_lines(spark, d):
    return writers.component_lines(wcc_sizes(spark, d))


@query
def component_total(spark, d):
    return analysis.component_count(connectivity.weak_components(simple_copurchase(spark, d), isolated=True), "component")


@query
def component_levels(spark, d):
    g = simple_copurchase(spark, d)
    return traversal.component_levels(g, connectivity.weak_components(g))


@query
def undirected_component_levels(spark, d):
    g = simple_copurchase(spark, d)
    return analysis.level_histogram(traversal.component_levels(g, connectivity.weak_components(g), directed=False))


@query
def component_vmap(spark, d):
    g = simple_copurchase(spark, d)
    return relabel.component_map(traversal.component_levels(g, connectivity.weak_components(g), directed=False), top=5)


@query
def forward_reach(spark, d):
    g = simple_copurchase(spark, d)
    return traversal.reach(g, _root(g))


@query
def backward_reach(spark, d):
    g = simple_copurchase(spark, d)
    return traversal.reach(g, _root(g), backward=True)


@query
def giant_scc(spark, d):
    return connectivity.giant_component(simple_copurchase(spark, d))[2]


@query
def big_scc_edges(spark, d):
    return connectivity.split_giant(simple_copurchase(spark, d))[0].edges


@query
def small_scc_edges(spark, d):
    return connectivity.split_giant(simple_copurchase(spark, d))[1].edges


@query
def bowtie_counts(spark, d):
    return _six(connectivity.bow_tie_counts(connectivity.bow_tie(simple_copurchase(spark, d))), "ratio")


@query
def bowtie_vmap(spark, d):
    return relabel.bow_tie_map(connectivity.bow_tie(simple_copurchase(spark, d)))


@query
def scc(spark, d):
    return connectivity.strong_components(simple_copurchase(spark, d))


@query
def scc_check(spark, d):
    g = simple_copurchase(spark, d)
    return analysis.inner_degree_check(g, connectivity.giant_component(g)[2])


@query
def constant_labels(spark, d):
    return connectivity.weak_components(copurchase(spark, d)).withColumn("component", F.lit(300))


# The loops that graphs beyond one task's size take, on the same graph


@query
def distributed_sssp(spark, d):
    g = simple_copurchase(spark, d)
    return traversal.shortest_paths(g, _root(g), local_edges=0)


@query
def distributed_bfs_levels(spark, d):
    g = simple_copurchase(spark, d)
    return traversal.bfs(g, spark.range(_root(g), _root(g) + 1), local_edges=0)


@query
def distributed_scc(spark, d):
    return connectivity.strong_components(simple_copurchase(spark, d), local_edges=0)


# Blocks and assignment


@query
def msbfs_blocks(spark, d):
    return partition.multi_source_blocks(simple_copurchase(spark, d), roots=8, levels=4)


@query
def voronoi_blocks(spark, d):
    return partition.voronoi_blocks(simple_copurchase(spark, d), rate=0.02, most=100, growth=5, rounds=4)


@query
def voronoi_check(spark, d):
    """Every vertex once at most, every block with its source, none too large, each member next to another one."""
    g = simple_copurchase(spark, d)
    made = materialize(voronoi_blocks(spark, d), "voronoi")
    sizes = made.groupBy("block").agg(F.count("*").alias("n"), F.count_if(F.col("id") == F.col("block")).alias("own"))
    both = g.undirected().edges.join(made.select(F.col("id").alias("src"), "block"), "src").join(made.select(F.col("id").alias("dst"), F.col("block").alias("other")), "dst")
    near = both.where("block = other").select(F.col("src").alias("id")).distinct()
    alone = made.join(sizes, "block").where("n > 1").join(near, "id", "left_anti").agg(F.count("*").alias("alone"))
    return made.agg((F.count("*") - F.count_distinct("id")).alias("twice")).crossJoin(sizes.agg(F.count_if(F.col("own") != 1).alias("without_source"), F.count_if(F.col("n") > 100).alias("too_large"))).crossJoin(alone)


@query
def residual_wcc(spark, d):
    g = simple_copurchase(spark, d)
    return partition.residual_components(g, traversal.bfs(g, spark.range(_root(g), _root(g) + 1)))


@query
def lpt_assignment(spark, d):
    g = copurchase(spark, d)
    return partition.assign_blocks(g, g.vertices().withColumn("block", F.col("id") % 13), PARTS, greedy=False)


@query
def greedy_assignment(spark, d):
    g = copurchase(spark, d)
    return partition.assign_blocks(g, g.vertices().withColumn("block", F.col("id") % 13), PARTS)


@query
def block_vmap(spark, d):
    g = copurchase(spark, d)
    blocks = g.vertices().withColumn("block", F.col("id") % 13)
    part = spark.range(13).select(F.col("id").alias("block"), (F.col("id") % PARTS).cast("int").alias("part"))
    return relabel.block_map(blocks, part)


@query
def dag_partition(spark, d):
    return partition.dag_partition(simple_copurchase(spark, d), PARTS, roots=8, levels=4)[0]


@query
def dag_check(spark, d):
    """New ids without gaps, intervals that cover them, every edge kept."""
    g = simple_copurchase(spark, d)
    vmap, intervals, renamed = partition.dag_partition(g, PARTS, roots=8, levels=4)
    ids = vmap.agg(F.count("*").alias("vertices"), F.count_distinct("new_id").alias("ids"), (F.max("new_id") + 1).alias("end"))
    cover = intervals.agg(F.sum(F.col("end_id") - F.col("start_id") + 1).alias("covered"))
    return ids.crossJoin(cover).crossJoin(renamed.edges.agg(F.count("*").alias("edges"), F.sum("w").alias("weight")))


# Random steps, factors, dynamic graphs


@query
def random_out_edge(spark, d):
    g = copurchase(spark, d)
    return random_walks(g, spark.range(20), 4)


@query
def random_walk_check(spark, d):
    """Each step goes along an edge, and only vertices without out-edges end a walk."""
    g = copurchase(spark, d)
    walks = materialize(random_walks(g, spark.range(200), 4, seed=3), "walks")
    onward = walks.select("start", (F.col("step") + 1).alias("step"), F.col("id").alias("src"))
    moves = onward.join(walks.withColumnRenamed("id", "dst"), ["start", "step"])
    edges = g.edges.select("src", "dst").distinct()
    ended = onward.where("step <= 4").join(walks, ["start", "step"], "left_anti").join(edges, "src", "left_semi")
    return walks.agg(F.count_if(F.col("step") == 0).alias("walks")).crossJoin(moves.join(edges, ["src", "dst"], "left_anti").agg(F.count("*").alias("jumps"))).crossJoin(ended.agg(F.count("*").alias("ended_early")))


@query
def factor_functions(spark, d):
    f = table(spark, d, "part").select("p_partkey", F.array(F.log(F.col("p_size") + 1.0), F.lit(0.0), F.lit(-1.0)).alias("f"))
    n = scalars.factor_normalize(F.col("f"))
    return f.select("p_partkey", F.round(F.get(n, F.lit(0)), 6).alias("first"), F.round(scalars.factor_norm(n), 6).alias("norm"), scalars.factor_max_assignment(F.col("f")).cast("long").alias("best"))


def _dynamic(spark: SparkSession, d: str) -> DynamicGraph:
    edges = copurchase(spark, d).edges
    g = DynamicGraph(spark, edges.where("src % 2 = 0"))
    g.add_edges(edges.where("src % 2 = 1"))
    return g


@query
def dynamic_add(spark, d):
    return _dynamic(spark, d).degrees()


@query
def dynamic_delete(spark, d):
    g = _dynamic(spark, d)
    g.remove_edges(copurchase(spark, d).edges.where("dst % 3 = 0"))
    g.remove_out_edges(spark.range(0, 1000, 50))
    g.compact()
    return g.degrees()


@query
def dynamic_commit(spark, d):
    """State after adding many edges, removing few, and removing many, each time with the policy's choice to compact."""
    edges = copurchase(spark, d).edges
    g = DynamicGraph(spark, edges.where("src % 4 = 0"))
    rows = []
    for step, change in enumerate((lambda: g.add_edges(edges.where("src % 4 = 1")), lambda: g.remove_edges(edges.where("dst % 50 = 0 and src % 4 < 2")), lambda: g.remove_edges(edges.where("dst % 5 = 1 and src % 4 < 2")))):
        change()
        g.compact_if_needed()
        state = g.info()
        rows.append((step, state["edges"], state["buffered"], state["removals"], state["version"]))
    return spark.createDataFrame(rows, "step int, edges long, buffered long, removals long, version int")


@query
def dynamic_finish(spark, d):
    """A stream of five batches of the same ten edges that is told to stop after two."""
    path, kind = new_path(spark, "stream"), "op string, src long, dst long"
    batch = generators.chain(spark, 11).edges.select(F.lit("add").alias("op"), "src", "dst")
    for _ in range(5):
        batch.coalesce(1).write.mode("append").parquet(path)
    g = DynamicGraph(spark, generators.chain(spark, 11).edges)
    g.finish_after(2)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    g.consume(stream, new_path(spark, "stream-state")).awaitTermination()
    return g.edges().groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def edge_vectors(spark, d):
    """Vectors that get one more element in each iteration."""
    g = Graph(copurchase(spark, d).edges.select("src", "dst", F.array("src").alias("v")))
    for k in range(1, 4):
        g = append_values(g, "v", F.col("src") + k)
    return g.edges.select("src", "dst", F.size("v").alias("n"), F.concat_ws(":", F.col("v").cast("array<string>")).alias("v"))
