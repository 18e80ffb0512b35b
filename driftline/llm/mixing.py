"""Mix overlapping sources to target weights by min-cost flow over membership patterns.

1. Documents are aggregated by membership pattern (the sorted set of sources that hold
   them): one row per pattern, whatever the number of documents.
2. Targets: sources in order share the budget by weight; a target stops at ``max_repeat``
   times its source's size and the excess is reshared by weight until none is above.
3. Flow: pattern -> source arcs of unlimited capacity, source -> sink arcs of the source's
   target, and for each pattern one arc per repetition level with the pattern's size as
   capacity and the level as cost. The costs are convex, so second copies are taken only
   where first copies cannot fill the quotas. A source that shares no document with another has a network
   of one path, settled by its target alone; every connected group of overlapping sources is a network
   of its own (its patterns + sources), solved in one task. Nothing of this passes through the driver but
   a few sums a round, so any number of sources and patterns will do.
4. Selection: the documents of a pattern lie on a tape in the order of a seeded hash, once
   per level; the sources take consecutive segments of the pattern's flow, and a document's
   copy belongs to the segment that holds its midpoint. Tape places are prefix sums over
   hash buckets, then inside one bucket, so no task orders a whole source.
5. Whole documents overshoot or undershoot a quota by up to half a document at each end of
   a segment; ``refine`` passes then add or drop the one copy per pattern that best closes
   the gap to its flow.

A null text has size 0; a document without any source belongs to a source null, which is
last in order. Repeated rows are documents of their own; the choice depends on seed, id and
size only, so reruns agree. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from driftline.llm.common import WORD, text_of, written
from driftline.llm.components import components
from driftline.operators.order import global_rank

#: Rows of one (pattern, bucket) that a task orders, aimed at.
BUCKET_ROWS = 20_000


def min_cost_flow(capacity: dict, quota: dict, max_repeat: int) -> dict:
    """``{(pattern, source): tokens}`` of greatest flow and least convex repetition cost.

    Successive shortest paths (integers): every augmentation fills an arc, so their number is
    bounded by the arcs, not by the tokens.
    """
    nodes: dict = {}
    arcs: list[list] = []                     # to, capacity left, cost, index of the reverse arc
    out: list[list[int]] = []

    def node(x) -> int:
        if x not in nodes:
            nodes[x] = len(out)
            out.append([])
        return nodes[x]

    def arc(a, b, cap, cost) -> int:
        i, j = node(a), node(b)
        out[i].append(len(arcs))
        out[j].append(len(arcs) + 1)
        arcs.extend(([j, cap, cost], [i, 0, -cost]))
        return len(arcs) - 2

    s, t = node("s"), node("t")
    flow = {}
    for p in sorted(capacity):
        for level in range(max_repeat):
            arc("s", ("p", p), capacity[p], level)
        for q in p:
            flow[p, q] = arc(("p", p), ("q", q), max_repeat * capacity[p], 0)
    for q in sorted(quota):
        arc(("q", q), "t", int(round(quota[q])), 0)
    potential = [0] * len(out)
    while True:
        dist, via = [math.inf] * len(out), [-1] * len(out)
        dist[s] = 0
        heap = [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k in out[u]:
                v, cap, cost = arcs[k]
                if cap and (e := d + cost + potential[u] - potential[v]) < dist[v]:
                    dist[v], via[v] = e, k
                    heapq.heappush(heap, (e, v))
        if dist[t] == math.inf:
            break
        potential = [p + (d if d < math.inf else dist[t]) for p, d in zip(potential, dist)]
        path, v = [], t
        while v != s:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    return {k: arcs[i ^ 1][1] for k, i in flow.items() if arcs[i ^ 1][1]}


def sized(docs: DataFrame, id_col: str, text_col: str, sources, seed: int) -> DataFrame:
    """Narrow table of all documents: doc_id, size, pattern (sorted distinct sources), h."""
    return docs.select(
        docs[id_col].alias("doc_id"), sources.alias("pattern"),
        F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("long").alias("size"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
        weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, seed: int = 17,
        refine: int = 4) -> DataFrame:
    """One row per document: doc_id, size, pattern, copies, takers (the sources its
    tape copies count to, before refining), taken, and its first source's source_size and target. ``source_col`` holds a source or an array of sources."""
    is_array = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    raw = docs[source_col].cast("array<string>") if is_array else F.array(docs[source_col].cast("string"))
    sources = F.when(F.size(raw) > 0, F.array_sort(F.array_distinct(raw))).otherwise(F.array(F.lit(None).cast("string")))
    # arrays with a null inside are not equal in a join: patterns are compared as text
    rows = written(sized(docs, id_col, text_col, sources, seed).withColumn("t", F.to_json("pattern")), "mix-sizes")
    patterns = written(rows.groupBy("t").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("pattern_size"), F.count(F.lit(1)).alias("n")).select(
        F.monotonically_increasing_id().alias("p"), "*"), "mix-patterns")
    known = source_table(patterns, weights, share, max_repeat)
    plan = written(planned(patterns, known, max_repeat), "mix-plan")
    placed = tape(rows.join(plan.drop("pattern"), "t").drop("t"))
    mid = F.col("start") + F.col("size") / 2
    takers = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max_repeat - 1)), lambda level: F.transform(F.filter(
        "segments", lambda s: (level * F.col("pattern_size") + mid >= s["first"]) & (level * F.col("pattern_size") + mid < s["last"])),
        lambda s: F.get("pattern", s["i"]))))
    result = written(placed.withColumn("takers", takers).select(
        "doc_id", "row", "size", "pattern", "p", "quota", "source_size", "target", F.size("takers").alias("copies"), "takers"), "mix-copies")
    for _ in range(refine):
        fixes = written(closest_copies(result, max_repeat), "mix-fixes")
        if fixes.isEmpty():
            break
        result = result.join(fixes, (result["p"] == fixes["_p"]) & (result["row"] == fixes["_row"]), "left").select(
            *[result[c] for c in result.columns if c != "copies"],
            (result["copies"] + F.coalesce(F.col("step"), F.lit(0))).cast("int").alias("copies"))
    return result.select("doc_id", "size", "pattern", "source_size", "target", "copies", "takers",
                         (F.col("copies") * F.col("size")).alias("taken"))


def source_table(patterns: DataFrame, weights: Sequence[float], share: float, max_repeat: int) -> DataFrame:
    """(r, source, source_size, target): sources by code point, null last, with their water-filled targets.

    The level of the water (tokens per weight) rises with every source that is full; a source that is full stays
    so, hence each round is one sum over the sources, and there are as many rounds as the level changes."""
    held = patterns.select(F.explode("pattern").alias("source"), "pattern_size").groupBy("source").agg(F.sum("pattern_size").alias("source_size"))
    total = patterns.agg(F.coalesce(F.sum("pattern_size"), F.lit(0)).alias("s")).first()["s"]
    ordered = global_rank(held.withColumn("_last", F.col("source").isNull().cast("int")), ["_last", "source"], "r")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("r") - 1) % len(weights)).cast("int"))
    table = written(ordered.select("r", "source", "source_size", weight.alias("w"), (F.col("source_size") * max_repeat).cast("double").alias("cap")), "mix-sources")
    level, full = 0.0, -1
    while True:
        over = F.lit(level) * F.col("w") > F.col("cap")
        if full < 0:
            over = F.lit(False)
        got = table.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("cap"),
                        F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)).alias("w")).first()
        if got["n"] == full or not got["w"]:
            break
        level, full = (share * total - got["cap"]) / got["w"], got["n"]
    target = F.when(F.lit(level) * F.col("w") > F.col("cap"), F.col("cap")).otherwise(F.lit(level) * F.col("w"))
    return table.select("r", "source", "source_size", target.alias("target"))


def planned(patterns: DataFrame, known: DataFrame, max_repeat: int) -> DataFrame:
    """The patterns with buckets, quota, the first source's source_size and target, and ``segments``: which of its
    sources (by place in the pattern) takes which part of the pattern's tape."""
    each = patterns.select("p", "pattern", "pattern_size", F.posexplode("pattern").alias("i", "q")).join(
        known, F.col("q").eqNullSafe(F.col("source"))).select("p", "pattern_size", "i", "r", "source_size", "target")
    first = each.where("i = 0").select("p", "r", "source_size", "target")
    shared = each.join(each.where("i = 1").select("p"), "p", "left_semi")
    alone = first.join(shared.select("r").distinct(), "r", "left_anti")
    segment = "struct<i: int, first: double, last: double>"
    quota = F.rint("target")
    segments = alone.select("p", F.filter(F.array(F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("first"), quota.alias("last"))),
                                          lambda s: s["last"] > 0).cast(f"array<{segment}>").alias("segments"))
    if not shared.isEmpty():
        segments = segments.unionByName(routed(each, shared, max_repeat))
    quota = F.coalesce(F.array_max(F.transform("segments", lambda s: s["last"])), F.lit(0.0))
    return patterns.join(first.drop("r"), "p").join(segments, "p").select(
        "p", "t", "pattern", "pattern_size", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("buckets"), quota.cast("long").alias("quota"),
        "source_size", "target", "segments")


def routed(each: DataFrame, shared: DataFrame, max_repeat: int) -> DataFrame:
    """``(p, segments)`` by min-cost flow for the patterns of sources that overlap with others: every connected
    group of sources is a network of its own, solved in the task that holds the group's patterns."""
    links = shared.where("i = 0").select("p", F.col("r").alias("a")).join(shared.where("i > 0").select("p", F.col("r").alias("b")), "p").select("a", "b").distinct()
    found = components(links)
    nodes = shared.select("r").distinct()
    group = nodes.join(found, nodes["r"] == found["node"], "left").select("r", F.coalesce("component", "r").alias("g"))
    # a pattern's row holds its sources, in order; a source's own documents are a pattern of one
    rows = each.join(group, "r").groupBy("p").agg(F.min("g").alias("g"), F.max("pattern_size").alias("size"), F.array_sort(F.collect_list(
        F.struct("i", "r", "target"))).alias("s"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        places = {tuple(int(x["r"]) for x in s): (p, size) for p, size, s in zip(group["p"], group["size"], group["s"])}
        quota = {int(x["r"]): x["target"] for s in group["s"] for x in s}
        flow = min_cost_flow({k: int(size) for k, (_, size) in places.items()}, quota, max_repeat)
        out = []
        for k, (p, _) in places.items():
            at, segments = 0, []
            for i, q in enumerate(k):
                if f := flow.get((k, q), 0):
                    segments.append({"i": i, "first": float(at), "last": float(at + f)})
                    at += f
            out.append((p, segments))
        return pd.DataFrame(out, columns=["p", "segments"])

    return rows.groupBy("g").applyInPandas(solve, "p long, segments array<struct<i: int, first: double, last: double>>")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The documents of the mix with all their columns, a row per copy taken.

    An id names one document: rows that share an id are each taken as often as the most taken of them.
    """
    taken = mix(docs, id_col, text_col, source_col, **options).groupBy(F.col("doc_id").alias("__dl_taken")).agg(
        F.max("copies").alias("__dl_copies")).where("__dl_copies > 0")
    rows = docs.join(taken, docs[id_col].eqNullSafe(F.col("__dl_taken")))
    return rows.withColumn("__dl_copy", F.explode(F.sequence(F.lit(1), F.col("__dl_copies")))).select(*[docs[c] for c in docs.columns])


def tape(rows: DataFrame) -> DataFrame:
    """Adds ``row`` (unique inside its pattern) and ``start`` (sizes of the pattern's rows before it in hash order)."""
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.col("buckets").cast("long")))
    before = Window.partitionBy("p").orderBy("bucket")
    heads = rows.groupBy("p", "bucket").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")).select(
        F.col("p").alias("_p"), F.col("bucket").alias("_b"),
        (F.sum("s").over(before) - F.col("s")).alias("base"), (F.sum("c").over(before) - F.col("c")).alias("rows_before"))
    inside = Window.partitionBy("p", "bucket").orderBy("h", "doc_id", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ordered = rows.select("*", (F.sum("size").over(upto) - F.col("size")).alias("within"), F.row_number().over(inside).alias("rn"))
    return ordered.join(heads, (F.col("p") == F.col("_p")) & (F.col("bucket") == F.col("_b"))).select(
        "doc_id", "size", "pattern", "p", "pattern_size", "quota", "source_size", "target", "segments",
        (F.col("rows_before") + F.col("rn")).cast("long").alias("row"), (F.col("base") + F.col("within")).alias("start"))


def closest_copies(result: DataFrame, max_repeat: int) -> DataFrame:
    """For each pattern the one copy to add (+1) or drop (-1) that brings its taken words
    closest to its flow: at most one (_p, _row, step) per pattern."""
    gap = result.groupBy("p").agg((F.first("quota") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    moves = result.select("p", "row", "size", "copies").join(gap, "p").select("p", "row", "size", "gap", F.explode(F.array(
        F.when(F.col("copies") < max_repeat, F.lit(1)), F.when(F.col("copies") > 0, F.lit(-1)))).alias("step")).where(
        "step is not null and size > 0")
    left = F.abs(F.col("gap") - F.col("step") * F.col("size"))
    best = moves.groupBy("p").agg(F.min(F.struct(left.alias("left"), F.col("row"), F.col("step"))).alias("m"),
                                  F.first("gap").alias("gap")).where("m.left < abs(gap)")
    return best.select(F.col("p").alias("_p"), F.col("m.row").alias("_row"), F.col("m.step").alias("step"))
