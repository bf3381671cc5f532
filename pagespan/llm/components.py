"""Connected components: within a task by NumPy, over a table by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, partitions, written

#: Rows of a table of a round that one task writes; small rounds keep TASKS tasks.
ROWS, TASKS = 50_000, 16


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the least node of each one's component."""
    node, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # hook the labels themselves, so that whole trees move
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, label):
            return node, node[label]
        label = new[label]


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of edges (a, b: long).

    Each round the nodes get an order by hash anew, every node takes the first of itself and its neighbours as parent,
    and the edges between different parents go on to the next round: fewer by a share, on long paths too. Parents are
    composed at the end of each round. All state is in tables, so plans and their size estimates don't grow, and a round's
    tables are deleted once the next round's are there. The tasks of a round are as many as its edges need, since late
    rounds have few.
    """
    most = partitions(edges.sparkSession)
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label, turn = None, 0
    while rows := left.count():
        tasks = min(most, max(TASKS, -(-rows // ROWS)))
        fit = lambda df, n=tasks: written(df.coalesce(n) if n < most else df)
        rank = lambda c, t=turn: F.xxhash64(c, F.lit(t))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("m"))
        parent = fit(first.select(F.col("a").alias("node"), F.when(rank("a") <= rank("m"), F.col("a")).otherwise(F.col("m")).alias("parent")))
        spent = [left]
        if label is None:
            label = parent.withColumnRenamed("parent", "component")
            label.written_to = parent.written_to
        else:
            step = parent.select(F.col("node").alias("component"), "parent")
            spent += [parent, label]
            label = written(label.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        of_a, of_b = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = left.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        left = fit(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        drop(edges.sparkSession, *(t.written_to for t in spent))
        turn += 1
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    low = label.groupBy("component").agg(F.min("node").alias("low"))
    return label.join(low, "component").select("node", F.col("low").alias("component"))
