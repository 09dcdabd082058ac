"""Driver-side iteration with bounded lineage.

Every round's table is written to the shared folder and read again.  A plan never
holds more than one round, whatever a step does with its state, and the loss of an
executor repeats nothing of the rounds before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from vertexflow.storage import discard, materialize

#: Layers of a result that are kept apart before they are merged into one table.
MERGE_EVERY = 16


class Rounds:
    """The tables of a loop: ``keep`` makes one, ``drop`` deletes those that nothing reads any more."""

    def __init__(self, tag: str):
        self.tag, self.held = tag, []

    def keep(self, df: DataFrame) -> DataFrame:
        table = materialize(df, self.tag)
        self.held.append(table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        own = [t for t in self.held if any(t is x for x in tables)]
        self.held = [t for t in self.held if not any(t is x for x in own)]
        discard(*own)

    def result(self, df: DataFrame) -> DataFrame:
        """The loop's result as a table of its own, after which the others are deleted."""
        out = materialize(df, self.tag)
        discard(*self.held)
        self.held = []
        return out


@dataclass
class Progress:
    """What an iteration reports: its number and measures; ``stop`` ends the run after it."""

    iteration: int = 0
    measures: list[dict] = field(default_factory=list)
    stop: bool = False


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, measure: Callable[[DataFrame, DataFrame], dict] | None = None, done: Callable[[dict], bool] | None = None, tag: str = "state", fuse: int = 1) -> tuple[DataFrame, Progress]:
    """Apply ``step(state, iteration)`` up to ``rounds`` times.

    ``measure(new, old)`` is one aggregation for each round and ``done`` decides on
    it whether to end.  Without ``measure``, ``fuse`` rounds make one plan, which
    suits steps that read their state once.
    """
    loop, progress, kept = Rounds(tag), Progress(), None
    for i in range(rounds):
        old, state = state, step(state, i)
        progress.iteration = i + 1
        if not measure and (i + 1) % fuse and i + 1 < rounds:
            continue
        state = loop.keep(state)
        if measure:
            progress.measures.append({"iteration": i + 1, **measure(state, old)})
            progress.stop = bool(done and done(progress.measures[-1]))
        if kept is not None:
            loop.drop(kept)
        kept = state
        if progress.stop:
            break
    return state, progress
