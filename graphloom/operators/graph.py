"""Graph operators over edge tables (a, b): components, bounded distances, prerequisite chains, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, written

#: Edges that one task joins up at once ahead of the rounds.
EDGES = 500_000


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a"))


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the least one reachable over the edges (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: what a task reads is replaced, some 100,000 edges at a time, by a link of each vertex to its least one there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []

        def settle() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(wait)
            ends = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).combine_chunks()
            ids = ends.unique()
            ids = ids.take(pc.sort_indices(ids))
            at = pc.index_in(ends, ids).to_numpy()
            least = _least(len(ids), at[: t.num_rows], at[t.num_rows :])
            member = np.flatnonzero(least != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(member)), ids.take(pa.array(least[member]))], names=["a", "b"])
            wait.clear()

        for batch in batches:
            if batch.num_rows:
                wait.append(batch)
            if sum(b.num_rows for b in wait) >= EDGES:
                yield from settle()
        if wait:
            yield from settle()

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Least id reachable from every id in ``edges``: columns id, component_id. Any type of id that Arrow and Spark order alike (numbers, strings).

    Tasks first join up the edges that they hold (``contracted``). Then minimum labels spread to neighbours and jump to the label of
    their label: about log n rounds for a path of n links. Only labels that have a lesser label of their own are looked up, so a settled
    component's label is in no join. What ``max_rounds`` rounds have not settled goes on between the labels, which are fewer than the ids.
    Each round is written to the shared folder, and the one before is deleted. Null ends are ignored; no edges give no rows.
    """
    both = both_ways(contracted(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b"))).distinct()
    both = written(both, "edges")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("l")), "labels")
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("b"), "l"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("m"))
        hop = written(label.join(near, "id").select("id", F.col("l").alias("old"), F.least("l", "m").alias("l")), "labels")
        dropped(label)
        label = hop.select("id", "l")
        if hop.where("old <> l").isEmpty():
            dropped(both)
            return label.select("id", F.col("l").alias("component_id"))
        jump = label.where("l < id").select(F.col("id").alias("l"), F.col("l").alias("j"))
        label = written(label.join(jump, "l", "left").select("id", F.least("l", "j").alias("l")), "labels")
        dropped(hop)
    of = lambda c: label.select(F.col("id").alias(c), F.col("l").alias(f"l{c}"))
    links = written(both.where("a < b").join(of("a"), "a").join(of("b"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
    up = components(links, max_rounds).withColumnRenamed("id", "l")
    out = written(label.join(up, "l", "left").select("id", F.coalesce("component_id", "l").alias("component_id")), "labels")
    for table in (both, label, links, up):
        dropped(table)
    return out


def bounded_distance(edges: DataFrame, seeds: DataFrame, hops: int = 3, most: int | None = None) -> DataFrame:
    """(seed, id, distance) of all ids within ``hops`` undirected steps of seeds (seed). A frontier only holds ids first reached by it.

    ``most``: at most so many ids of each seed, nearest first and then by id (a node cap as a feature). Frontiers are written, so a plan does not grow with the hops.
    """
    both = written(both_ways(edges).distinct(), "edges")
    frontier = written(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("distance")).distinct(), "frontier")
    seen = frontier
    for step in range(1, hops + 1):
        reached = frontier.join(both, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id")).distinct()
        frontier = written(reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("distance", F.lit(step)), "frontier")
        seen = seen.unionByName(frontier)
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("distance", "id"))
        seen = seen.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")
    return seen


def prerequisite_chains(edges: DataFrame, hops: int = 8) -> DataFrame:
    """(before, after, depth): over PREREQUISITE_FOR edges (source, target), the longest chain of at most ``hops`` edges between two entries.

    An entry on a cycle is its own prerequisite: see ``prerequisite_cycles``. Chains that reach ``hops`` edges end there.
    """
    step = written(edges.select(F.col("source").alias("s"), F.col("target").alias("t")).where("s IS NOT NULL AND t IS NOT NULL").distinct(), "steps")
    front = step.select(F.col("s").alias("before"), F.col("t").alias("after"), F.lit(1).alias("depth"))
    every = front
    for depth in range(2, hops + 1):
        front = written(front.join(step, F.col("after") == F.col("s")).select("before", F.col("t").alias("after"), F.lit(depth).alias("depth")).distinct(), "chains")
        every = every.unionByName(front)
    return every.groupBy("before", "after").agg(F.max("depth").alias("depth"))


def prerequisite_cycles(edges: DataFrame) -> DataFrame:
    """entry: all entries on a cycle or behind and ahead of cycles only, by taking away entries without edges in or out until none is left."""
    left = written(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "steps")
    while True:
        count = left.count()
        inner = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        kept = written(inner.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), "steps")
        dropped(left)
        left = kept
        if kept.count() == count:
            return kept.select(F.col("source").alias("entry")).union(kept.select("target")).distinct()


def neighbours(edges: DataFrame, node: Column) -> DataFrame:
    """(neighbour, relation, direction) of one node."""
    out = edges.where(F.col("source") == node).select(F.col("target").alias("neighbour"), "relation", F.lit("out").alias("direction"))
    return out.union(edges.where(F.col("target") == node).select("source", "relation", F.lit("in")))


def filter_edges(edges: DataFrame, relation: str | None = None, node: str | None = None, target: str | None = None) -> DataFrame:
    """Edges by any of relation, incident node and target."""
    keep = F.lit(True)
    if relation is not None:
        keep = keep & (F.col("relation") == relation)
    if node is not None:
        keep = keep & ((F.col("source") == node) | (F.col("target") == node))
    if target is not None:
        keep = keep & (F.col("target") == target)
    return edges.where(keep)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): incident edges of both directions."""
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))  # from one scan
