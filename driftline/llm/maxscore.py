"""Exact top-k by inner product of integer vectors: MaxScore over the postings of index shards.

A dimension is a term; its postings in a shard are the shard's vectors with a component other than
0 there. A query's score of a vector is the sum over the query's terms of query weight x component,
and a term's bound in a shard is the greatest such product there (0 at least, where some vector lacks
the term). Terms are taken by falling bound. While the bounds of the last terms add up to less
than the threshold (the k-th best score known), those terms are non-essential: a vector in none of
the other, essential, postings cannot compete. The essential postings are traversed and summed; the
vectors whose sum plus the bounds left reaches the threshold stay competitive; the most promising k
are scored first and raise the threshold; the non-essential terms are then probed one by one, for
the competitive vectors alone, whose number falls with every probe. A shard whose bounds cannot
reach the threshold is passed over. All of it compares integers, so the result is exact.

Vectors are split by hash into shards of about ``shard_components`` components, queries into blocks
of ``query_rows``; a task works on one (shard, block) at a time, its shard in memory and its queries as
a stream. Every query begins with the k-th best score in a sample of ``sample`` vectors, which is only a
first threshold: any sample gives the same result. A ranking per query merges the shards.

Components are ``floor(scale * x)``, with x as double, kept within the range of a long, as scores are.
Vectors that are null or hold a null or non-finite component take no part; an empty vector scores 0,
and of vectors of unlike length the shorter has no term in the dimensions it lacks. A
query's own row is no candidate, another row of the same id is. Equal scores go to the smaller id, a null id
last. Rows with a null id are candidates, and queries if ``queries`` says so. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import hash_sample, written

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Integers up to here are exact as doubles.
EXACT = 1 << 53


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, queries: Column, scale: int) -> DataFrame:
    """uid (one a row), vec_id, v (array of long) and is_query of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return table.where(F.col(vector_col).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))


def _within(threshold):
    """A threshold that scores kept within the range of a long can reach."""
    return -math.inf if threshold <= LEAST else min(threshold, MOST)


class Shard:
    """Postings of some vectors: for each term the ascending vector numbers and their components."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, flat: np.ndarray):
        self.uids, self.ids, self.known, self.n = uids, ids, known, len(uids)
        starts = np.cumsum(lengths) - lengths
        dims = np.arange(len(flat)) - np.repeat(starts, lengths)
        docs = np.repeat(np.arange(self.n), lengths)
        some = np.flatnonzero(flat)
        order = some[np.argsort(dims[some], kind="stable")]
        self.docs, self.values = docs[order], flat[order]
        ends = np.cumsum(np.bincount(dims[order], minlength=int(lengths.max(initial=0))))
        self.first, self.last = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends
        # every term's range of components, 0 among them where some vector lacks the term
        self.range = []
        for t in range(len(ends)):
            v = self.values[self.first[t]:self.last[t]]
            lo, hi = (int(v.min()), int(v.max())) if len(v) else (0, 0)
            self.range.append((lo, hi) if len(v) == self.n else (min(lo, 0), max(hi, 0)))

    def terms(self, q: list[int]) -> tuple[list[tuple[int, int, int]], bool]:
        """(bound, term, weight) of the query's terms that have postings, by falling bound; and whether doubles are exact."""
        out, size = [], 0
        for t, w in enumerate(q[:len(self.range)]):
            if w and self.last[t] > self.first[t]:
                lo, hi = self.range[t]
                out.append((max(w * lo, w * hi), t, w))
                size += max(abs(w * lo), abs(w * hi))
        out.sort(key=lambda x: (-x[0], x[1]))
        return out, size < EXACT

    def probe(self, t: int, w: int, docs: np.ndarray, exact: bool):
        """Products of a term for the ascending vectors ``docs``."""
        a, b = self.first[t], self.last[t]
        if b - a == self.n:
            v = self.values[a:b][docs]
        else:
            at = np.searchsorted(self.docs[a:b], docs)
            at_ = np.minimum(at, b - a - 1)
            v = np.where(self.docs[a:b][at_] == docs, self.values[a:b][at_], 0)
        return v * float(w) if exact else v.astype(object) * w

    def score(self, terms, docs: np.ndarray, exact: bool):
        total = np.zeros(len(docs), np.float64 if exact else object)
        for _, t, w in terms:
            total = total + self.probe(t, w, docs, exact)
        return total

    def top(self, q: list[int], k: int, own: int | None, threshold: int | None = None) -> list[tuple[int, int]]:
        """Up to ``k`` (vector number, score), best first; all that can be among the best ``k`` of a
        table where ``threshold`` is at most the k-th best score."""
        terms, exact = self.terms(q)
        theta = -math.inf if threshold is None else _within(threshold)
        # essential terms: all but the longest tail whose bounds add up to less than the threshold
        rest, essential = 0, len(terms)
        while essential and rest + terms[essential - 1][0] < theta:
            essential -= 1
            rest += terms[essential][0]
        if rest < theta and not essential:
            return []                                          # not even the sum of all bounds reaches it
        partial = np.zeros(self.n, np.float64 if exact else object)
        met = np.full(self.n, rest >= theta)                   # vectors without an essential term compete only then
        for _, t, w in terms[:essential]:
            a, b = self.first[t], self.last[t]
            where = slice(None) if b - a == self.n else self.docs[a:b]
            v = self.values[a:b]
            partial[where] += v * float(w) if exact else v.astype(object) * w
            met[where] = True
        if own is not None:
            met[self.uids == own] = False
        docs = np.flatnonzero(met & np.asarray(partial + rest >= theta, bool))
        tail = terms[essential:]
        if tail and len(docs) > k:
            best = np.argpartition(-partial[docs].astype(np.float64), k - 1)[:k]
            lead = np.sort(docs[best])
            theta = max(theta, _within((partial[lead] + self.score(tail, lead, exact)).min()))
            docs = docs[np.asarray(partial[docs] + rest >= theta, bool)]
        total = partial[docs]
        for bound, t, w in tail:
            if not len(docs):
                break
            total = total + self.probe(t, w, docs, exact)
            rest -= bound
            stay = np.asarray(total + rest >= theta, bool)
            docs, total = docs[stay], total[stay]
        if not exact:
            total = np.array([min(max(int(x), LEAST), MOST) for x in total], object)
        order = np.argsort(-total, kind="stable")
        if len(order) > k:                                     # the k best and all that tie with the k-th
            least = total[order[k - 1]]
            order = [i for i in order if total[i] >= least]
        ranked = sorted(((-int(total[i]), not self.known[docs[i]], int(self.ids[docs[i]]), int(self.uids[docs[i]]), int(docs[i]))
                         for i in order))[:k]
        return [(r[-1], -r[0]) for r in ranked]


def _columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _shard(parts: list[pa.RecordBatch]) -> Shard:
    t = pa.Table.from_batches(parts).combine_chunks()
    v = t.column("v").combine_chunks()
    ids = t.column("vec_id").combine_chunks()
    return Shard(t.column("uid").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False),
                 np.diff(v.offsets.to_numpy()).astype(np.int64), v.flatten().to_numpy())


def first_thresholds(queries: DataFrame, sample: list, k: int) -> DataFrame:
    """``queries`` with theta: their k-th best score among the sampled vectors (null if there are fewer)."""
    ids = np.array([r["vec_id"] or 0 for r in sample], np.int64)
    shard = Shard(np.array([r["uid"] for r in sample], np.int64), ids, np.array([r["vec_id"] is not None for r in sample], bool),
                  np.array([len(r["v"]) for r in sample], np.int64), np.array([x for r in sample for x in r["v"]], np.int64))

    def run(batches):
        for batch in batches:
            theta = []
            for uid, v in zip(*(c.to_pylist() for c in _columns(batch, "uid", "v"))):
                best = shard.top(v, k, uid)
                theta.append(best[-1][1] if len(best) == k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(theta, pa.int64())], names=[*batch.schema.names, "theta"])

    return queries.mapInArrow(run, "uid long, vec_id long, v array<long>, theta long")


def search(table: DataFrame, queries: Column, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = 1024, shard_components: int = 1 << 19, query_rows: int = 2048, sample: int = 1024, seed: int = 5) -> DataFrame:
    """The ``k`` best candidates of every query row: query_id, rank, vec_id, score."""
    rows = written(integer_vectors(table, id_col, vector_col, queries, scale), "maxscore-vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("c"),
                    F.count_if("is_query").alias("q")).first()
    n_shards = max(1, math.ceil(max(size["c"], size["n"]) / shard_components))
    n_blocks = max(1, math.ceil(size["q"] / query_rows))
    seen = hash_sample(rows, size["n"], sample, seed, "uid").select("uid", "vec_id", "v").collect()
    asked = written(first_thresholds(rows.where("is_query").select("uid", "vec_id", "v"), seen, k), "maxscore-queries")
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    docs = rows.select(part(n_shards, seed).alias("shard"), every(n_blocks).alias("block"), F.lit(0).alias("kind"), "uid", "vec_id", "v",
                       F.lit(None).cast("long").alias("theta"))
    blocks = asked.select(every(n_shards).alias("shard"), part(n_blocks, seed + 1).alias("block"), F.lit(1).alias("kind"), "uid",
                          "vec_id", "v", "theta")

    def best(batches):
        at, parts, shard = None, [], None
        for batch in batches:
            cells = list(zip(*(c.to_pylist() for c in _columns(batch, "shard", "block", "kind"))))
            a = 0
            while a < len(cells):
                b = a + 1
                while b < len(cells) and cells[b] == cells[a]:
                    b += 1
                run, cell, a = batch.slice(a, b - a), cells[a], b
                if cell[:2] != at:
                    at, parts, shard = cell[:2], [], None
                if cell[2] == 0:
                    parts.append(run)
                    continue
                if not parts:
                    continue                                   # a shard that no vector fell into
                shard = shard or _shard(parts)
                out = [(uid, vec_id, rank_id, score, cand)
                       for uid, vec_id, v, theta in zip(*(c.to_pylist() for c in _columns(run, "uid", "vec_id", "v", "theta")))
                       for i, score in shard.top(v, k, uid, theta)
                       for rank_id, cand in [(int(shard.ids[i]) if shard.known[i] else None, int(shard.uids[i]))]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                     names=["quid", "query_id", "vec_id", "score", "uid"])

    cells = docs.unionByName(blocks).repartition(min(n_shards * n_blocks, 10_000), "shard", "block").sortWithinPartitions(
        "shard", "block", "kind", "uid")
    found = cells.mapInArrow(best, "quid long, query_id long, vec_id long, score long, uid long")
    w = Window.partitionBy("quid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
