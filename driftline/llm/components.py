"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregates and two joins over the edges, written to the shared folder. A
node's smallest neighbour is a map-side combined minimum. Edges meet it by a shuffle, except those of
nodes that hold more than a ``HOT``-th of all edges: there can be at most ``2 * HOT`` such nodes, so their
minima are broadcast and their edges stay where they are. No neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import written

#: A node with more than one in ``HOT`` edges is hot, unless it has no more than ``FEW``.
HOT, FEW = 500, 1000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge that is not its component's smallest node."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e = written(e, "components")
    state = _state(e)
    while state[0]:
        e = written(_small_star(_large_star(e, state[0]), state[0]), "components")
        if (now := _state(e)) == state:
            break
        state = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return r["n"], r["x"]


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` (u, v) with ``m`` of their ``u`` from ``least`` (_u, m, c: its number of edges)."""
    many = max(n // HOT, FEW)
    hot = least.where(F.col("c") > many).select(F.col("_u").alias("_hot"), F.col("m").alias("_m"))
    if hot.isEmpty():
        return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")
    marked = edges.join(F.broadcast(hot), F.col("u") == F.col("_hot"), "left")
    rest = marked.where("_hot is null").select("u", "v").join(least.where(F.col("c") <= many), F.col("u") == F.col("_u"))
    return marked.where("_hot is not null").select("u", "v", F.col("_m").alias("m")).unionByName(rest.select("u", "v", "m"))


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """Greater neighbours of every node go to the smallest node of its neighbourhood."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m"), "c"), "components-least")
    return _with_least(both.where("v > u"), least, n).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    """Smaller neighbours of every node, and the node, go to the smallest of them."""
    edges = e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).withColumnRenamed("u", "_u"), "components-least")
    others = _with_least(edges, least, n).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
    return others.unionByName(least.select(F.col("_u").alias("hi"), F.col("m").alias("lo"))).distinct()
