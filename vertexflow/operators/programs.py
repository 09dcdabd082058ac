"""Programming models: vertex programs, functional kernels, gather-apply-scatter, edge aggregation.

All callbacks map Columns to Columns, so a user's program is part of the plan and
stays in generated code.  Execution is synchronous: a round sees only the values of
the round before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexflow.plans.loop import Progress, iterate

from .graph import Dealt, Graph, degrees


@dataclass
class VertexProgram:
    """``init(row)`` gives a vertex's first value from id and degrees.  Each round ``message(source value,
    edge)`` goes along every edge, ``combine`` aggregates what arrives (null where nothing does) and
    ``apply(old, combined)`` makes the new value.  ``changed(new, old)`` tells which vertices are active;
    rounds end when none is.  With ``frontier`` only active vertices send messages, for combines that may
    forget what did not change.  ``before`` and ``after`` are called on the driver around each round.
    """

    init: Callable[[], Column]
    message: Callable[[Column, Callable[[str], Column]], Column]
    combine: Callable[[Column], Column]
    apply: Callable[[Column, Column], Column]
    changed: Callable[[Column, Column], Column] = field(default=lambda new, old: ~new.eqNullSafe(old))
    direction: str = "out"
    frontier: bool = False
    before: Callable[[int], None] | None = None
    after: Callable[[Progress], None] | None = None


def directed(graph: Graph, direction: str) -> Graph:
    """Edges as messages travel: ``out`` from source to target, ``in`` back, ``both`` either way."""
    return {"out": lambda: graph, "in": graph.reversed, "both": graph.undirected}[direction]()


def run_program(graph: Graph, program: VertexProgram, rounds: int) -> tuple[DataFrame, Progress]:
    """``id, value`` after at most ``rounds`` rounds, and what each reported."""
    edges = Dealt(directed(graph, program.direction).edges)
    start = degrees(graph, isolated=True).select("id", program.init().alias("value"), F.lit(True).alias("active"))
    progress = Progress()

    def step(state: DataFrame, i: int) -> DataFrame:
        if program.before:
            program.before(i)
        senders = state.where("active") if program.frontier else state
        sent = edges.join(senders.select(F.col("id").alias("src"), F.col("value").alias("_v")))
        arrived = sent.groupBy(F.col("dst").alias("id")).agg(program.combine(program.message(F.col("_v"), F.col)).alias("_m"))
        both = state.select("id", F.col("value").alias("_old")).join(arrived, "id", "left")
        new = both.withColumn("value", program.apply(F.col("_old"), F.col("_m")))
        return new.select("id", "value", F.coalesce(program.changed(F.col("value"), F.col("_old")), F.lit(True)).alias("active"))

    def measure(new: DataFrame, old: DataFrame) -> dict:
        found = new.agg(F.coalesce(F.sum(F.col("active").cast("long")), F.lit(0)).alias("updates")).first().asDict()
        progress.iteration += 1
        progress.measures.append(found)
        if program.after:
            program.after(progress)
        return found

    state, done = iterate(start, step, rounds, measure, lambda m: m["updates"] == 0 or progress.stop, "program")
    edges.free()
    return state.select("id", "value"), done


@dataclass
class FunctionalKernel:
    """Gather along in-edges, sum, apply, scatter along out-edges.

    ``initial(in_degree, out_degree)``; ``scatter(value, out_degree)`` is what a
    neighbour sees; ``gather(seen)`` of it is summed by ``plus``, or is ``zero``
    where there are no in-edges; ``apply(sum, old)`` is the new value.  The first of
    the iterations sets the initial values and scatters them only.
    """

    initial: Callable[[Column, Column], Column]
    gather: Callable[[Column], Column]
    apply: Callable[[Column, Column], Column]
    scatter: Callable[[Column, Column], Column]
    plus: Callable[[Column], Column] = F.sum
    zero: float | int = 0


def run_functional(graph: Graph, kernel: FunctionalKernel, iterations: int) -> DataFrame:
    """``id, value`` after ``iterations``, all of them synchronous."""
    deg = degrees(graph, isolated=True).persist()
    edges = Dealt(graph.edges.select("src", "dst"))
    start = deg.select("id", "out_degree", kernel.initial(F.col("in_degree"), F.col("out_degree")).alias("value"))

    def step(state: DataFrame, _: int) -> DataFrame:
        seen = state.select(F.col("id").alias("src"), kernel.scatter(F.col("value"), F.col("out_degree")).alias("_seen"))
        sums = edges.join(seen).groupBy(F.col("dst").alias("id")).agg(kernel.plus(kernel.gather(F.col("_seen"))).alias("_sum"))
        return state.join(sums, "id", "left").select("id", "out_degree", kernel.apply(F.coalesce("_sum", F.lit(kernel.zero)), F.col("value")).alias("value"))

    state, _ = iterate(start, step, iterations - 1, tag="functional")
    edges.free()
    deg.unpersist()
    return state.select("id", "value")


@dataclass
class GASContext:
    """What a program's ``control`` sees before a round, and may ask for.

    ``signal`` schedules vertices, ``remove`` takes a range of ids off the schedule,
    ``remove_all`` and ``signal_all`` are for every vertex, and ``stop`` ends the run
    before this round.  Later calls win.
    """

    iteration: int
    num_vertices: int
    stopped: bool = False
    changes: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def signal(self, vertices: DataFrame) -> None:
        hit = vertices.select("id").distinct().withColumn("_hit", F.lit(True))
        self.changes.append(lambda state: state.join(hit, "id", "left").withColumn("runs", F.col("runs") | F.coalesce("_hit", F.lit(False))).drop("_hit"))

    def remove(self, start: int, end: int) -> None:
        """Ids from ``start`` to ``end``, both included."""
        self.changes.append(lambda state: state.withColumn("runs", F.col("runs") & ~F.col("id").between(start, end)))

    def signal_all(self) -> None:
        self.changes.append(lambda state: state.withColumn("runs", F.lit(True)))

    def remove_all(self) -> None:
        self.changes.append(lambda state: state.withColumn("runs", F.lit(False)))

    def stop(self) -> None:
        self.stopped = True


@dataclass
class GASProgram:
    """Gather over ``gather_edges``, aggregate by ``plus``, apply, and signal along ``scatter_edges``.

    Directions are none, in, out or both, as seen from the gathering vertex.
    ``gather(neighbour value, edge)``, ``apply(old, total, out_degree)``;
    ``scatter(new, old)`` says whether a vertex signals its neighbours, which are the
    ones that run in the next round.  Several signals to a vertex count once.
    ``control`` is called on the driver before each round and may change the schedule.
    """

    init: Callable[[], Column]
    gather: Callable[[Column, Callable[[str], Column]], Column]
    apply: Callable[[Column, Column, Column], Column]
    scatter: Callable[[Column, Column], Column]
    plus: Callable[[Column], Column] = F.sum
    gather_edges: str = "in"
    scatter_edges: str = "out"
    control: Callable[[GASContext], None] | None = None


_TOWARDS = {"in": "out", "out": "in", "both": "both"}


def run_gas(graph: Graph, program: GASProgram, rounds: int, signalled: DataFrame | None = None) -> tuple[DataFrame, Progress]:
    """``id, value``; at first all vertices run, or those of ``signalled`` (id)."""
    gathered = None if program.gather_edges == "none" else Dealt(directed(graph, _TOWARDS[program.gather_edges]).edges)
    outward = None if program.scatter_edges == "none" else Dealt(directed(graph, program.scatter_edges).edges.select("src", "dst"))
    deg = degrees(graph, isolated=True)
    start = deg.select("id", "out_degree", program.init().alias("value"), F.lit(False).alias("signals"))
    runs = start if signalled is None else start.join(signalled.select("id"), "id", "left_semi")
    start = start.join(runs.select("id", F.lit(True).alias("runs")), "id", "left").withColumn("runs", F.coalesce("runs", F.lit(False)))
    context = GASContext(0, graph.size() if program.control else 0)

    def step(state: DataFrame, i: int) -> DataFrame:
        if program.control:
            context.iteration, context.changes = i, []
            program.control(context)
            if context.stopped:
                return state
            for change in context.changes:
                state = change(state)
        now = state
        if gathered is not None:
            seen = gathered.join(state.select(F.col("id").alias("src"), F.col("value").alias("_v")))
            totals = seen.groupBy(F.col("dst").alias("id")).agg(program.plus(program.gather(F.col("_v"), F.col)).alias("_t"))
            now = now.join(totals, "id", "left")
        else:
            now = now.withColumn("_t", F.lit(None).cast("double"))
        new = F.when(F.col("runs"), program.apply(F.col("value"), F.col("_t"), F.col("out_degree"))).otherwise(F.col("value"))
        made = now.withColumn("_new", new)
        made = made.select("id", "out_degree", F.col("_new").alias("value"), (F.col("runs") & F.coalesce(program.scatter(F.col("_new"), F.col("value")), F.lit(False))).alias("signals"))
        if outward is None:
            return made.withColumn("runs", F.lit(False))
        hit = outward.join(made.where("signals").select(F.col("id").alias("src"))).select(F.col("dst").alias("id")).distinct()
        return made.join(hit.withColumn("runs", F.lit(True)), "id", "left").withColumn("runs", F.coalesce("runs", F.lit(False)))

    def measure(new: DataFrame, old: DataFrame) -> dict:
        return new.agg(F.coalesce(F.sum(F.col("runs").cast("long")), F.lit(0)).alias("tasks")).first().asDict()

    idle = program.control is None  # a control may schedule vertices where none runs
    state, progress = iterate(start, step, rounds, measure, lambda m: context.stopped or (idle and m["tasks"] == 0), "gas")
    for edges in (gathered, outward):
        if edges is not None:
            edges.free()
    return state.select("id", "value"), progress


def aggregate_edges(graph: Graph, mapped: Column, total: Callable[[Column], Column] = F.sum, finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """``total`` of ``mapped`` over all edges, each counted once; ``finish`` maps the total."""
    out = graph.edges.agg(total(mapped).alias("total"))
    return out if finish is None else out.select(finish(F.col("total")).alias("total"))
