"""Connected components of links between rows, without gathering any component in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import Scratch

#: Edges that one task joins up: 16 bytes each.
SMALL = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges (u, v)."""
    table = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, ends = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    u, v = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[u], label[v]), label.copy()
        for at in (label[u], label[v]):
            np.minimum.at(label, at, low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def merged(found: DataFrame | None, edges: DataFrame, scratch: Scratch, name: str, small) -> DataFrame:
    """The components of ``found`` (node, component) joined up by further edges (a, b), as ``components`` gives them.

    Only edges between different components count, with components for nodes,
    so the graph to be solved gets small. ``small`` marks a table of few rows
    to be broadcast.
    """
    if found is None:
        return components(edges, scratch, name)
    of = small(found)
    for end in ("a", "b"):
        its = of.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        edges = edges.join(its, end, "left")
    edges = edges.select(*(F.coalesce(f"of_{end}", end).alias(end) for end in ("a", "b")))
    new = components(edges, scratch, f"{name}-new")
    to = small(new.select(F.col("node").alias("component"), F.col("component").alias("into")))
    moved = found.join(to, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    added = new.join(small(found.select("component").distinct()).withColumnRenamed("component", "known"), F.col("node") == F.col("known"), "left_anti")
    return scratch.table(name, moved.unionByName(added))



def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``edges`` has two long columns a and b; returns a row (node, component) per node in an edge, component being the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014): nodes
    are pointed at the smallest node near them until nothing moves. A step
    takes each node's smallest neighbour by an aggregate and joins it back, so
    a node with very many neighbours is split like any other hot join key. A
    graph of at most ``SMALL`` edges is left to one task, which costs less than
    the first step.

    Edges may repeat and go either way; self-loops and edges with a null end
    are no edges.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.table(f"{name}-0", now)
    if now.count() <= SMALL:
        return scratch.table(f"{name}-1", now.coalesce(1).mapInArrow(_joined, "node bigint, component bigint"))
    step, last = 0, None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u's smaller neighbours and u itself point at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        step += 1
        now = scratch.table(f"{name}-{step}", small)
        scratch.drop(f"{name}-{step - 1}")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            break
        last = state
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.union(roots)
