"""Near duplicates by a chosen-path set similarity join over minwise tokens.

A document is the set of its distinct ``width``-word shingles, as 64-bit hashes. Two
documents are linked when ``100 * |intersection| >= percent * |union|``.

1. Signatures: one pass hashes every shingle once; ``TOKENS`` minwise tokens per document come
   from one-permutation hashing, empty bins filled from a fixed order of the other bins.
   Documents with equal sets become one set, whatever their number.
2. Trees: a node of a tree chooses one token position by a hash of its path and branches its
   sets by their token there. A node of one set ends; one of up to ``node_sets`` sets is
   compared exhaustively by its tokens; a larger one branches again, at most ``depth`` times,
   and what is then still large is compared exhaustively too, in pairs of blocks. A pair of
   similarity s meets in a tree with probability s to s**depth; ``trees`` independent trees
   leave (1 - 0.85**4)**12 = 1.4e-4 of the pairs at the very threshold inside nodes that
   needed all four levels, and less than 1e-9 where one level was enough. A lower threshold
   wants more trees: at 0.80, 24 of them leave (1 - 0.8**4)**24 = 3.2e-6.
3. A comparison keeps pairs whose token agreement is at most ``SLACK`` below the threshold (5 or
   more standard deviations; sets of under ``TINY`` shingles skip this) and whose sizes
   allow the similarity. Each node returns a spanning forest of such pairs, so a dense group
   of m sets costs m - 1 rows; their components are candidate clusters.
4. Links: each cluster's texts meet once (a cluster above ``node_sets`` in pairs of blocks),
   are shingled again in full (a bitmap of the wanted ids drops the other texts before the
   shuffle), and pairs are confirmed by exact intersection. Pairs already
   connected need no test, as only reachability is asked for. Components of the links follow.

No bucket, node or cluster is capped and no partner dropped. Only documents that share a tree
node with another are shuffled beyond the first narrow table. Null and empty texts, and texts
of white space, have an empty set and are linked with nothing. An id stands for one document:
rows that share one are one node. Rows with a null id are linked like others but name no
component. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import shuffle_partitions, text_of, written
from driftline.llm.components import components
from driftline.llm.tokens import own_text, split_words, text_chunks

TOKENS, SLACK, TINY = 64, 35, 24
MARK_BITS = 24
SEED = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(29)
#: For each bin, the order in which the others are asked when it is empty.
_ASK = np.stack([np.concatenate([[i], _RNG.permutation([j for j in range(TOKENS) if j != i])]) for i in range(TOKENS)])
_BIN_STARTS = (np.arange(TOKENS, dtype=np.uint64) << np.uint64(64 - 6))


def shingle_sets(text: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    import xxhash
    words = split_words(pc.ascii_lower(own_text(text)))
    pieces = words.flatten()
    full = pc.not_equal(pc.binary_length(pieces), 0).to_numpy(zero_copy_only=False)
    places = words.offsets.to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(full)])[places - places[0]]       # word bounds of each text
    coded = pieces.filter(pa.array(full)).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    rolling = _rolling(h, width)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= width:
            out.append(np.unique(rolling[a:b - width + 1]))
        else:
            out.append(_rolling(h[a:b], b - a) if b > a else h[:0])
    return out


def _rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    s = np.full(n, np.uint64(SEED & (2**64 - 1)) ^ np.uint64(width))
    for k in range(width):
        s = _mix(s * np.uint64(0xD6E8FEB86659FD93) + h[k:k + n])
    return s


def minwise(s: np.ndarray) -> np.ndarray:
    """The minwise tokens (whole 64-bit shingle hashes) of a sorted non-empty set."""
    at = np.searchsorted(s, _BIN_STARTS)
    full = np.append(at[1:], len(s)) > at
    values = s[np.minimum(at, len(s) - 1)]
    return values if full.all() else values[_ASK[np.arange(TOKENS), full[_ASK].argmax(axis=1)]]


def short(tokens: np.ndarray) -> np.ndarray:
    """31 bits of each token: enough to compare the sets of one node."""
    return ((tokens >> np.uint64(20)) & np.uint64(0x7FFFFFFF)).astype(np.int32)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, trees: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set), tokens (short), roots (the set's first node in each tree)."""
    rng = np.random.default_rng(seed)
    position, salt = np.resize(rng.permutation(TOKENS), trees), rng.integers(1, 2**63, trees, dtype=np.uint64)

    def sign(batches):
        for batch in batches:
            for a, b in text_chunks(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(a, b - a), width)
                tokens = [minwise(s) if len(s) else None for s in sets]
                roots = [None if t is None else _mix(t[position] ^ salt).view(np.int64) for t in tokens]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([None if t is None else short(t) for t in tokens], pa.list_(pa.int32())),
                    pa.array(roots, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "tokens", "roots"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, tokens array<int>, roots array<long>")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (root, member) of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        frontier = [root]
        while frontier:
            new = np.flatnonzero(linked[frontier.pop()] & left)
            left[new] = False
            frontier.extend(new.tolist())
            out.extend((root, int(v)) for v in new)
    return out


def agreeing(tokens: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that could be linked, by token agreement and sizes."""
    same = np.zeros((len(tokens), len(tokens)), np.uint8)
    for k in range(tokens.shape[1]):
        same += tokens[:, k, None] == tokens[None, :, k]
    small = np.minimum(n[:, None], n[None, :])
    return ((100.0 * same >= (percent - SLACK) * tokens.shape[1]) | (small < TINY)) & (100 * small >= percent * np.maximum(n[:, None], n[None, :]))


def by_group(batches, key: str):
    """Yield each run of equal ``key`` of partition-sorted batches as one table."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        k = t[key].to_numpy()
        if not len(k):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield t.slice(a, b - a)
        held = t.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(max(shuffle_partitions(rows.sparkSession), 1), key).sortWithinPartitions(key)


def _in_blocks(rows: DataFrame, key: str, size: str, limit: int, member: str) -> DataFrame:
    """Give groups above ``limit`` a key per pair of hash blocks; each member goes to its block's pairs."""
    blocks = F.ceil(F.col(size) / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), member), blocks.cast("long")).cast("int")
    spread = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.xxhash64(F.col(key), F.least("_own", "_other"), F.greatest("_own", "_other"))
    return spread.withColumn(key, pair).drop("_own", "_other")


def candidate_pairs(sets: DataFrame, *, percent: int, depth: int, node_sets: int, seed: int) -> DataFrame:
    """(a, b) spanning forests of the possible links of every tree node; ``sets``: rep, n, tokens, roots."""
    position = F.pmod(F.xxhash64(F.lit(seed), "path"), F.lit(TOKENS)).cast("int")
    rows = sets.select("rep", F.explode("roots").alias("path"))
    found = None
    for level in range(1, depth + 1):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        nodes = written(rows.join(sizes, "path"), "tree-nodes")
        big = nodes.where(F.col("members") > node_sets)
        end = level == depth or big.isEmpty()
        ready = nodes if end else nodes.where(F.col("members") <= node_sets)
        found = ready if found is None else found.unionByName(ready)
        if end:
            break
        rows = big.join(sets, "rep").select("rep", F.xxhash64("path", F.get("tokens", position)).alias("path"))
    found = _in_blocks(found, "path", "members", node_sets, "rep").join(sets, "rep").select("path", "rep", "n", "tokens")

    def compare(batches):
        for node in by_group(batches, "path"):
            rep, n = node["rep"].to_numpy(), node["n"].to_numpy()
            tokens = node["tokens"].combine_chunks().flatten().to_numpy().reshape(-1, TOKENS)
            if pairs := forest(agreeing(tokens, n, percent)):
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    return _dealt(found, "path").mapInArrow(compare, "a long, b long").distinct()


def confirm(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (exact, on full sets) that connect all that is connected among ``sets``."""
    n = np.array([len(s) for s in sets])
    maybe = agreeing(np.stack([short(minwise(s)) for s in sets]), n, percent)
    label, links = np.arange(len(sets)), []
    shared = _intersections(sets) if len(sets) >= 16 else None
    if shared is not None:
        linked = maybe & (100 * shared >= percent * (n[:, None] + n[None, :] - shared))
        return forest(linked)
    for i in range(len(sets)):
        while len(js := np.flatnonzero(maybe[i, :i] & (label[:i] != label[i]))):
            j = js[-1]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (n[i] + n[j] - both):
                links.append((i, j))
                label[label == label[j]] = label[i]
            else:
                maybe[i, j] = False
    return links


def _intersections(sets: list[np.ndarray], cells: int = 40_000_000) -> np.ndarray | None:
    """All pairwise intersection sizes by a product of incidence blocks, if the sets overlap enough for it."""
    flat = np.concatenate(sets)
    words, code = np.unique(flat, return_inverse=True)
    if len(words) * len(sets) > cells:
        return None
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    total = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, 4_000_000 // len(sets))
    for a in range(0, len(words), step):
        own = (code >= a) & (code < a + step)
        block = np.zeros((len(sets), step), np.float32)
        block[owner[own], code[own] - a] = 1
        total += block @ block.T
    return total.astype(np.int64)


def _marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most rows whose ``rep`` is not wanted, so that the join after it shuffles few
    texts: a bitmap of ``2**MARK_BITS`` hash values, of fixed size, lets a few strangers pass but
    drops no wanted row. With very many wanted rows it passes all, and the join decides alone."""
    mark = F.shiftrightunsigned(F.xxhash64("rep"), 64 - MARK_BITS)
    words = wanted.select(mark.alias("m")).groupBy(F.expr("shiftright(m, 6)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(m & 63 as int)))").alias("bits")).toPandas()     # at most 2**(MARK_BITS - 6) rows
    bitmap = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)

    def keep(batches):
        for batch in batches:
            m = batch.column(2).to_numpy().astype(np.int64)
            yield batch.filter(pa.array((bitmap[m >> 6] >> (m & 63).astype(np.uint64) & np.uint64(1)).astype(bool))).select([0, 1])

    return texts.withColumn("mark", mark).mapInArrow(keep, "rep long, text string")


def links(docs: DataFrame, clusters: DataFrame, id_col: str, text_col: str, *, width: int, percent: int,
          node_sets: int) -> DataFrame:
    """(a, b) confirmed links inside candidate clusters; ``clusters``: rep, cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    placed = _in_blocks(clusters.join(sizes, "cluster"), "cluster", "members", node_sets, "rep").select("rep", "cluster")
    texts = _marked(docs.select(docs[id_col].cast("long").alias("rep"), text_of(docs, text_col).alias("text")), placed)

    def check(batches):
        for group in by_group(batches, "cluster"):
            rep = group["rep"].to_numpy()
            sets = [s for a, b in text_chunks(group["text"].combine_chunks())
                    for s in shingle_sets(group["text"].combine_chunks().slice(a, b - a), width)]
            some = [i for i, s in enumerate(sets) if len(s)]
            if len(some) > 1 and (found := confirm([sets[i] for i in some], percent)):
                i, j = np.array(some)[np.array(found).T]
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    return _dealt(texts.join(placed, "rep"), "cluster").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 85,
                    trees: int = 12, depth: int = 4, node_sets: int = 1500, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = written(signatures(docs, id_col, text_col, width, trees, seed), "near-signatures")
    sets = written(signed.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"),
        F.first("roots").alias("roots")), "near-sets")
    named = sets.where("rep is not null")
    pairs = candidate_pairs(named.select("rep", "n", "tokens", "roots"), percent=percent, depth=depth,
                            node_sets=node_sets, seed=seed)
    grouped = components(pairs)
    clusters = written(grouped.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).unionByName(
        grouped.select(F.col("component").alias("rep"), F.col("component").alias("cluster")).distinct()), "near-clusters")
    confirmed = components(links(docs, clusters, id_col, text_col, width=width, percent=percent, node_sets=node_sets))
    reps = named.select("set_key", "rep").join(confirmed, F.col("rep") == F.col("node"), "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id"))
    return signed.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the documents kept, with all their columns."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("__dl_kept")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(F.col("__dl_kept")), "left_semi")
