"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

A document's ids end with ``end_id``; only documents longer than ``capacity`` are cut, into
pieces of ``capacity`` tokens (the last may be shorter). Pieces of exactly the capacity are
sequences of their own. The others are dealt by hash into shards of about ``SHARD_ITEMS``
pieces, and each shard is evolved on several islands:

* a solution assigns pieces to bins; it starts as best-fit decreasing, or best fit in a
  perturbed order;
* crossover injects a random choice of one parent's better-filled bins whole into the other,
  dissolves the bins that now hold a piece twice, and best-fits the displaced pieces;
* mutation dissolves the worst-filled bins and a few others in the same way;
* after each epoch every island sends its elite to the next island of its shard;
* an island stops when its best solution meets the lower bound (all tokens / capacity).

The loosely filled bins of all shards are then packed together in fewer shards, until one
shard is left or repacking no longer shrinks the set. Only piece numbers and lengths travel.

A null text is empty and gives one piece, the end id alone. Repeated rows are packed like any
others. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import shuffle_partitions, text_of, written
from driftline.llm.tokens import encoder, text_chunks

SHARD_ITEMS = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 5, 4
#: A bin filled less than this share is packed again with those of other shards.
LOOSE = 0.96


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 4096,
                 tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ``ids`` if asked for."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def pieces(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            names, text = batch.column(0), batch.column(1)
            for a, b in text_chunks(text):
                flat, at = coder.encode(text.slice(a, b - a))
                who, piece, start, length, crc, ids = [], [], [], [], [], []
                for i in range(b - a):
                    own = np.append(flat[at[i]:at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s:s + capacity]
                        who.append(a + i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    names.take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(pieces, schema)


class Bins:
    """Bins by free space: best fit is one binary search."""

    def __init__(self, free: np.ndarray):
        self.order = sorted(zip(free.tolist(), range(len(free))))
        self.n = len(free)

    def best_fit(self, length: int, capacity: int) -> int:
        k = bisect_left(self.order, (length, -1))
        if k < len(self.order):
            free, b = self.order.pop(k)
        else:
            free, b = capacity, self.n
            self.n += 1
        insort(self.order, (free - length, b))
        return b


def refit(lengths: np.ndarray, bins: np.ndarray, out: np.ndarray, capacity: int, order=None) -> np.ndarray:
    """Number the bins of the pieces not ``out`` from 0 and best-fit those ``out``, longest first."""
    keep = ~out
    _, dense = np.unique(bins[keep], return_inverse=True)
    fill = np.bincount(dense, lengths[keep]) if len(dense) else np.zeros(0)
    result = np.empty(len(bins), np.int32)
    result[keep] = dense
    left = Bins(capacity - fill)
    places = np.flatnonzero(out)
    places = places[np.argsort(-(lengths if order is None else order)[places], kind="stable")]
    for i, n in zip(places.tolist(), lengths[places].tolist()):
        result[i] = left.best_fit(n, capacity)
    return result


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more uneven filling (full bins beside nearly empty ones)."""
    fill = np.bincount(bins, lengths) / capacity
    return len(fill), -float(np.mean(fill * fill))


def crossover(lengths, mother, father, capacity, rng) -> np.ndarray:
    """Inject some well-filled bins of ``father`` whole into ``mother``."""
    fill = np.bincount(father, lengths)
    better = np.argsort(-fill)[:max(1, len(fill) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(better, max(1, int(len(better) * rng.uniform(0.1, 0.6))), replace=False)] = True
    injected = chosen[father]
    touched = np.zeros(int(mother.max()) + 1, bool)
    touched[mother[injected]] = True
    child = np.where(injected, len(touched) + father, mother)
    return refit(lengths, child, touched[mother] & ~injected, capacity)


def mutate(lengths, bins, capacity, rng) -> np.ndarray:
    """Dissolve the worst-filled bins and a few random ones."""
    fill = np.bincount(bins, lengths)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill)[:max(1, len(fill) // 50)]] = True
    gone[rng.integers(0, len(fill), max(1, len(fill) // 50))] = True
    return refit(lengths, bins, gone[bins], capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed, generations: int,
           size: int = POPULATION) -> list[np.ndarray]:
    """The population after some generations, best first; filled up to ``size`` at the start."""
    rng = np.random.default_rng(seed)
    everyone, none = np.ones(len(lengths), bool), np.zeros(len(lengths), np.int32)
    least = math.ceil(int(lengths.sum()) / capacity)
    ranked = sorted(((fitness(lengths, p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    while len(ranked) < size and not (ranked and ranked[0][0][0] == least):
        noise = lengths * (rng.uniform(0.7, 1.3, len(lengths)) if ranked else 1)
        p = refit(lengths, none, everyone, capacity, noise)
        ranked.append((fitness(lengths, p, capacity), len(ranked), p))
    for _ in range(generations):
        ranked.sort(key=lambda x: x[:2])
        if ranked[0][0][0] == least:
            break
        children = []
        for k in range(size // 2):
            i, j = rng.choice(len(ranked), 2, replace=len(ranked) < 2)
            child = mutate(lengths, crossover(lengths, ranked[min(i, j)][2], ranked[max(i, j)][2], capacity, rng), capacity, rng)
            children.append((fitness(lengths, child, capacity), size + k, child))
        ranked = [(f, n, p) for n, (f, _, p) in enumerate(sorted(ranked + children, key=lambda x: x[:2])[:size])]
    return [p for _, _, p in sorted(ranked, key=lambda x: x[:2])]


STATE = "shard long, island int, items array<long>, lengths array<int>, population array<array<int>>"


def _epoch(state: DataFrame, capacity: int, seed: int, generations: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                found = evolve(lengths, [np.array(p, np.int32) for p in row["population"]], capacity,
                               [seed, row["shard"], row["island"]], generations)
                row["population"] = [p.tolist() for p in found]
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)
    return state.mapInArrow(run, STATE)


def _migrate(state: DataFrame, islands: int) -> DataFrame:
    """Every island gets the elite of the one before it in its ring."""
    elite = state.select(F.col("shard").alias("_s"), ((F.col("island") + 1) % islands).alias("_i"),
                         F.element_at("population", 1).alias("elite"))
    return state.join(elite, (F.col("shard") == F.col("_s")) & (F.col("island") == F.col("_i"))).select(
        "shard", "island", "items", "lengths",
        F.concat(F.slice("population", 1, POPULATION - 1), F.array("elite")).alias("population"))


def _solve(items: DataFrame, shards: int, capacity: int, seed: int, level: int) -> DataFrame:
    """(item, length, shard, bin, fill, offset) of one level of shards."""
    spark = items.sparkSession
    shard = F.pmod(F.xxhash64(F.lit(seed + level), "item"), F.lit(shards)).alias("shard")
    rows = items.groupBy(shard).agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("all"))
    state = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
                        F.col("all.item").alias("items"), F.col("all.length").cast("array<int>").alias("lengths"),
                        F.array().cast("array<array<int>>").alias("population"))
    for epoch in range(EPOCHS):
        if epoch:
            state = _migrate(state, ISLANDS)
        state = state.repartition(max(shuffle_partitions(spark), shards), "shard", "island")
        state = written(_epoch(state, capacity, seed + 1000 * level + epoch, GENERATIONS), "packing-epoch")
    bins = F.element_at("population", 1)
    best = state.select("shard", F.struct(F.array_max(bins).alias("last"), "island").alias("rank"), "items", "lengths",
                        bins.alias("bins")).groupBy("shard").agg(
        F.min(F.struct("rank", "items", "lengths", "bins")).alias("b"))
    placed = best.select("shard", F.inline(F.arrays_zip(F.col("b.items").alias("item"), F.col("b.lengths").alias("length"),
                                                        F.col("b.bins").alias("bin"))))
    inside = Window.partitionBy("shard", "bin")
    return placed.select("item", "length", "shard", "bin", F.sum("length").over(inside).alias("fill"),
                         (F.sum("length").over(inside.orderBy("item").rowsBetween(Window.unboundedPreceding, 0))
                          - F.col("length")).alias("offset"))


def pack_items(items: DataFrame, capacity: int = 4096, seed: int = 5) -> DataFrame:
    """Pack rows (item long unique, length) into bins: (item, sequence_id, offset)."""
    sized = items.select("item", F.col("length").cast("int").alias("length"))
    full = sized.where(F.col("length") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"),
                                                           F.lit(0).cast("long").alias("offset"))
    todo, done, level = sized.where(F.col("length") < capacity), [full], 0
    n = todo.count()
    while n:
        shards = math.ceil(n / SHARD_ITEMS)
        solved = written(_solve(todo, shards, capacity, seed, level), "packing-level")
        loose = solved.where(F.col("fill") < LOOSE * capacity)
        m = loose.count() if shards > 1 else 0
        last = not 0 < m < n // 2
        kept = solved if last else solved.where(F.col("fill") >= LOOSE * capacity)
        done.append(kept.select("item", (F.lit(level).cast("long") * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 16)
                                         + F.col("bin")).alias("sequence_id"), "offset"))
        todo, n, level = loose.select("item", "length"), 0 if last else m, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 4096,
         tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False, seed: int = 5) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    pieces = token_pieces(docs, id_col, text_col, capacity=capacity, tokenizer=tokenizer, end_id=end_id, with_ids=with_ids)
    pieces = written(pieces.withColumn("item", F.monotonically_increasing_id()), "packing-pieces")
    return pieces.join(pack_items(pieces, capacity, seed), "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, ids."""
    ordered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
