"""Approximate nearest neighbours by learned partitions.

Fit, on a hash-chosen sample of at most ``sample`` vectors (driver memory is bounded by it):

1. the sample's neighbour graph by exact inner products, in blocks;
2. a balanced partitioning of that graph: balanced k-means gives the start, then vertices
   move to the part that holds most of their neighbours while no part exceeds its share by
   more than ``slack``;
3. a small classifier (one hidden layer) learns, for a vector, how its neighbours spread over
   the parts;
4. an eighth of the sample, held out of all this, gives the number of probes: the fewest most
   probable parts that hold ``recall`` of its true nearest. Vectors without structure need
   most parts, clustered ones few.

Index: every vector goes to its most probable part. A part is split by hash into blocks of
about ``block`` candidates, so copies of one vector never meet in one task. Search: a query goes
to that many most probable parts (more, until they hold enough candidates), to every block
of them; each block returns its own best ``k`` by exact double-precision inner product, and a
ranking per query merges them. There is a part for every ``part_rows`` vectors up to 64 parts, and above
100,000 vectors their number grows with the square root of the table, as far as the sample holds 32 vectors a part.

Vectors that are null, empty, zero, of another length than most, or that hold a null or
non-finite component take no part; nor do rows with a null id. Rows that share the query's id
are not its candidates. Equal scores go to the smaller id. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import hash_sample, written


def usable(embedding: Column) -> Column:
    return (embedding.isNotNull() & (F.size(embedding) > 0)
            & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(embedding, lambda x: x != 0))


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """(n, degree) numbers of each row's nearest others by inner product."""
    out = np.empty((len(x), degree), np.int64)
    for a in range(0, len(x), 512):
        s = x[a:a + 512] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a:a + 512] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng, slack: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Part of each vertex; no part larger than (1 + slack) times its share."""
    n, room = len(x), int(np.ceil((1 + slack) * len(x) / parts))
    centre = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(6):
        s = x @ centre.T
        size = np.zeros(parts, np.int64)
        for v in np.argsort(-(s.max(1))):                     # the surest vertices choose first
            for p in np.argsort(-s[v]):
                if size[p] < room:
                    part[v] = p
                    size[p] += 1
                    break
        centre = np.stack([x[part == p].mean(0) if size[p] else x[rng.integers(n)] for p in range(parts)])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-12
    linked = [[] for _ in range(n)]
    for v in range(n):
        for u in graph[v]:
            linked[v].append(u)
            linked[u].append(v)
    linked = [np.array(u, np.int64) for u in linked]
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(part[linked[v]], minlength=parts).astype(float)
            votes[(size >= room) & (np.arange(parts) != part[v])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[v]]:
                size[part[v]] -= 1
                size[best] += 1
                part[v] = best
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """x -> probabilities of the parts; one hidden layer."""

    def __init__(self, dims: int, parts: int, hidden: int, scale: float, rng):
        self.scale = scale
        self.w = [rng.normal(0, (2 / dims) ** 0.5, (dims, hidden)), np.zeros(hidden),
                  rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]

    def forward(self, x: np.ndarray):
        h = np.maximum((x / self.scale) @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return h, e / e.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, rng, epochs: int = 40, batch: int = 256, rate: float = 3e-3) -> None:
        m, v, t = [0 * w for w in self.w], [0 * w for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                xs, ys = x[order[a:a + batch]], target[order[a:a + batch]]
                h, p = self.forward(xs)
                dz = (p - ys) / len(xs)
                dh = (dz @ self.w[2].T) * (h > 0)
                grads = [(xs / self.scale).T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)]
                t += 1
                for i, g in enumerate(grads):
                    g = g + (1e-5 * self.w[i] if i % 2 == 0 else 0)
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def fit_router(x: np.ndarray, parts: int, degree: int, hidden: int, seed: int, recall: float = 0.95, k: int = 20) -> tuple[Router, int]:
    """The router, and the fewest probes that find ``recall`` of the nearest ``k`` of vectors held out of the fit."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, x = x[order[:len(x) // 8]], x[order[len(x) // 8:]]
    router = _fitted(x, parts, degree, hidden, rng)
    home = router.forward(x)[1].argmax(1)
    place = np.argsort(np.argsort(-router.forward(held)[1], axis=1, kind="stable"), axis=1)     # of each part in a route
    k = min(k, len(x))
    rank = np.concatenate([np.take_along_axis(place[a:a + 512], home[np.argpartition(-(held[a:a + 512] @ x.T), k - 1, axis=1)[:, :k]], 1).ravel()
                           for a in range(0, len(held), 512)])
    return router, int(np.quantile(rank, recall, method="higher")) + 1


def _fitted(x: np.ndarray, parts: int, degree: int, hidden: int, rng) -> Router:
    degree = min(degree, len(x) - 1)
    graph = neighbour_graph(x, degree)
    part = balanced_parts(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1 + degree / 2)
    np.add.at(target, (np.repeat(np.arange(len(x)), degree), part[graph].ravel()), 1)
    target /= target.sum(1, keepdims=True)
    router = Router(x.shape[1], parts, hidden, float(np.sqrt((x * x).mean())) or 1.0, rng)
    router.fit(x, target, rng)
    return router


def top_k(queries: np.ndarray, names: np.ndarray, own: np.ndarray, x: np.ndarray, k: int):
    """(query row, candidate row, score) of each query's best k of one block; exact scores, ties to smaller ids."""
    for a in range(0, len(queries), 256):
        rough = queries[a:a + 256] @ x.T
        rough[own[a:a + 256, None] == names[None, :]] = -np.inf
        kth = np.partition(rough, -min(k, len(x)), axis=1)[:, -min(k, len(x))]
        for i, row in enumerate(rough):
            near = np.flatnonzero(row >= kth[i] - 1e-9 * max(1.0, abs(kth[i]))) if np.isfinite(kth[i]) else np.flatnonzero(np.isfinite(row))
            score = (x[near] * queries[a + i]).sum(axis=1)     # one order of summing, so copies tie exactly
            best = np.lexsort((names[near], -score))[:k]
            yield a + i, near[best], score[best]


def part_count(n: int, part_rows: int = 24, sample: int = 8192) -> int:
    """Parts of a table of ``n`` vectors."""
    return max(1, min(n // part_rows, int(64 * max(1.0, n / 100_000) ** 0.5), max(64, sample // 32)))


def search(vectors: DataFrame, queries: Column | str, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 20,
           parts: int | None = None, recall: float = 0.95, sample: int = 8192, degree: int = 32, hidden: int = 256, block: int = 2048,
           part_rows: int = 24, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``queries`` selects, against all rows."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"),
                          (F.expr(queries) if isinstance(queries, str) else queries).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    d, n = dims[0]["d"], dims[0]["count"]
    rows = rows.where(F.size("v") == d)
    router, probes = None, 1
    parts = parts or part_count(n, part_rows, sample)
    if parts > 1:
        named = rows.select("vec_id", "v")
        chosen = hash_sample(named, n, sample, seed, "vec_id", "v").select("v").toPandas()["v"]
        if len(chosen) < min(n, sample):                   # many copies of one row: the share of the hashes left too few
            chosen = hash_sample(named, 0, sample, seed, "vec_id", "v").select("v").toPandas()["v"]
        router, probes = fit_router(np.stack(chosen.to_numpy()).astype(float), parts, degree, hidden, seed, recall, k)
    parts = parts if router else 1

    def route(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            p = router.forward(x)[1] if router else np.ones((len(x), 1))
            order = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
            asks = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            routes = pa.array([o.tolist() if a else None for o, a in zip(order, asks)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order[:, 0]), routes],
                                             names=["vec_id", "v", "part", "route"])

    index = written(rows.mapInArrow(route, "vec_id long, v array<double>, part int, route array<int>"), "ann-index")
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}       # at most ``parts`` rows
    size = F.array(*[F.lit(held.get(p, 0)) for p in range(parts)])
    before = lambda i: F.aggregate(F.slice("route", F.lit(1), i), F.lit(0).cast("long"), lambda s, p: s + F.get(size, p))
    wanted = F.filter("route", lambda p, i: (i < probes) | (before(i) <= k))
    asked = index.where("route is not null").select(F.col("vec_id").alias("query_id"), "v", F.explode(wanted).alias("part"))
    calls = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    blocks = lambda held: F.array(*[F.lit(max(1, -(-held.get(p, 0) // block))) for p in range(parts)])
    c_blocks, q_blocks = F.get(blocks(held), F.col("part")), F.get(blocks(calls), F.col("part"))
    mine = lambda name, count: F.pmod(F.xxhash64(name), count.cast("long")).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))
    left = asked.select("part", mine("query_id", q_blocks).alias("qb"), each(c_blocks).alias("cb"), "query_id", "v")
    right = index.select("part", mine("vec_id", c_blocks).alias("cb"), each(q_blocks).alias("qb"), "vec_id", "v")

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [(np.full(len(near), i), near, score) for i, near, score in
                 (top_k(np.stack(q["v"]), c["vec_id"].to_numpy(), q["query_id"].to_numpy(), np.stack(c["v"]), k)
                  if len(q) and len(c) else ())]
        i, j, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[i], "vec_id": c["vec_id"].to_numpy()[j], "score": s})

    keys = ["part", "cb", "qb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
