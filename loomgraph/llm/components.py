"""Connected components: stars inside partitions, then large-star and small-star steps between them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import drop, stored, stored_bytes

#: bytes of written edges that one task turns into stars
PART_BYTES = 32 << 20


def _stars(batches):
    """The edges of a partition as stars: each node's least one reachable inside the partition."""
    u, v = [], []
    for batch in batches:
        u.append(np.asarray(batch.column(0)))
        v.append(np.asarray(batch.column(1)))
    if not u:
        return
    nodes, at = np.unique(np.concatenate(u + v), return_inverse=True)  # places in order of ids
    a, b = np.split(at, 2)
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    bound = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[bound]), pa.array(nodes[label[bound]])], names=["u", "v"])


def component_stars(edges: DataFrame, name: str = "cc", size: int = PART_BYTES) -> DataFrame:
    """(u, v): each node but the smallest of its component, with the smallest, over ``edges(a, b)``.

    Null endpoints, self loops and repeated edges are ignored; an empty edge table gives no
    rows.  A step turns the edges of each partition into stars; partitions are of ``size``
    bytes, joined from those of the table read, without a shuffle.  When one partition held
    all edges, or no node is bound to two others and no star's centre to a third, that is the
    result; else large and small stars move edges between partitions.  Nothing is collected,
    and each step's edges are written to the shared folder, so that a lost executor costs
    one step.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), name)
    while True:
        parts = max(1, -(-stored_bytes(current) // size))
        stars = stored(current.coalesce(parts).mapInArrow(_stars, "u long, v long"), name)
        drop(current)
        if parts == 1:
            return stars
        if -(-stored_bytes(stars) // size) < parts:
            current = stars
            continue
        # a node that is bound to two, or to a bound one
        loose = stars.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").select("u")
        chained = stars.join(stars.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if loose.union(chained).isEmpty():
            whole = stored(stars.distinct(), name)
            drop(stars)
            return whole
        # large star: every neighbour larger than u moves to the smallest node around u
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        current = stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), name)
        drop(stars)


def connected_components(edges: DataFrame, name: str = "cc", size: int = PART_BYTES) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``: component is the smallest node reachable."""
    stars = component_stars(edges, name, size)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
