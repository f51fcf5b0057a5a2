"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import attach, discard, keep, releasing, ship

#: Links that a task joins in its own memory, and tasks at least: the fewer tasks, the fewer rounds.
LOCAL, TASKS = 500_000, 8


def _forest(links: list[np.ndarray]) -> pa.RecordBatch:
    """Each node of some links with the least one that it reaches through them."""
    hi, lo = np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])
    nodes, at = np.unique(np.concatenate((hi, lo)), return_inverse=True)
    hi, lo = at[: len(hi)], at[len(hi) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[hi], root[lo])
        new = root.copy()
        np.minimum.at(new, root[hi], least)
        np.minimum.at(new, root[lo], least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["hi", "lo"])


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)]))
        if sum(x.shape[1] for x in held) >= LOCAL:
            yield _forest(held)
            held = []
    if held:
        yield _forest(held)


def _shrunk(edges: DataFrame, rows: int) -> DataFrame:
    tasks = max(TASKS, -(-rows // LOCAL))
    return keep(edges.coalesce(tasks).mapInArrow(releasing(_contract), "hi long, lo long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; nodes without links are absent.

    ``links`` has the long columns ``a`` and ``b``.  Large-star and small-star steps alternate
    until every node has but one smaller neighbour, which has none.  Before the first and after
    every round tasks shrink their own links to forests, so a node then has at most one smaller
    neighbour from each task.  Larger neighbours may be many; a node that is the least of its
    neighbourhood keeps them, and only the others are joined, by ``attach``.  Every round is
    written to the shared folder, so a lost executor costs one round at most, and replaces the one before.
    """
    ship(links.sparkSession)
    links = links if hasattr(links, "_kept_at") else keep(links, "links")
    edges = _shrunk(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), links.count())
    while True:
        both = edges.union(edges.select("lo", "hi")).toDF("lo", "v")
        smaller = F.when(F.col("v") < F.col("lo"), F.col("v"))
        nodes = both.groupBy("lo").agg(F.min(smaller).alias("m"), F.max(smaller).alias("last"), F.max("v").alias("largest"))
        undone = keep(nodes.where("m < last or largest > lo and m is not null"), "nodes")
        if not undone.count():
            discard(undone)
            return nodes.select(F.col("lo").alias("node"), F.coalesce("m", "lo").alias("component"))
        least = undone.where("largest > lo").select("lo", "m")
        least._kept_at = undone._kept_at
        large = attach(edges, least, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        # Smaller neighbours of a node other than the least one move to that.
        small = large.groupBy("hi").agg(F.min("lo").alias("m"), F.collect_set("lo").alias("los"))
        moved = small.select(F.explode(F.concat(F.filter("los", lambda x: x != F.col("m")), F.array("hi"))).alias("hi"), F.col("m").alias("lo"))
        old, edges = edges, _shrunk(moved, edges.count())
        discard(old)
        discard(undone)
