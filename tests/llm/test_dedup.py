import hashlib
import random

from driftline.llm import exact_dedup, near_dedup
from driftline.llm.components import components
from tests.llm.frames import lower, no_docs, odd_docs, odd_rows, texts, words


def exact_brute(rows):
    groups = {}
    for i, t in texts(rows):
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in texts(rows):
        g = groups[lower(t)]
        top = max((x for x in g if x is not None), default=None)
        out.append((i, top, len(g), i == top, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_odd_cases_and_collisions(spark):
    for bits, bucket in ((64, 100_000), (3, 2)):                 # 3-bit keys: long chains, split buckets
        got = exact_dedup.exact_duplicates(odd_docs(spark), key_bits=bits, bucket_entries=bucket).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == exact_brute(odd_rows())
    assert {r["chain"] for r in got} > {0, 1}
    assert len({r["depth"] for r in got}) >= 1


def test_directory_splits_only_overfull_buckets(spark):
    entries = spark.createDataFrame([((p << 60) - (1 << 63 if p > 7 else 0) * 0 + i,) for p, n in ((0, 40), (5, 3), (7, 2))
                                     for i in range(n)], "key long")
    leaves, deepest = exact_dedup.directory(entries, 10)
    depth = {r["bucket"]: r["depth"] for r in leaves.collect()}
    assert max(depth.values()) == deepest and min(depth.values()) < deepest


def test_exact_keeps_all_columns_once(spark):
    docs = odd_docs(spark)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    want = {(r[1], r[4]) for r in exact_brute(odd_rows())}
    rows = kept.collect()
    assert len(rows) == len(want) and {r["doc_id"] for r in rows} == {w[0] for w in want}
    assert exact_dedup.drop_duplicates(no_docs(spark)).count() == 0
    assert exact_dedup.exact_duplicates(no_docs(spark)).count() == 0


def shingles(t):
    w = lower(t).encode().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_brute(rows, percent=85):
    docs = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in docs}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            (i, x), (j, y) = docs[a], docs[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and find(i) != find(j):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(x), find(i)) for i, x in docs}


def family(rng, size, n, edits):
    """Near copies of one text: a few words changed in each."""
    base = words(rng, n).split()
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n)] = words(rng, 1)
        out.append(" ".join(w))
    return out


def test_near_against_brute_force(spark):
    rng = random.Random(3)
    made = [t for n, e in ((40, 2), (120, 4), (300, 9), (8, 1), (1500, 60)) for t in family(rng, 14, n, e)]
    rows = list(enumerate(made)) + [(i + 1000, t) for i, t in texts(odd_rows()) if i is not None]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_brute(rows)
    # small nodes and shallow trees force branching, blocks and the compare of what stays large
    for options in ({}, {"node_sets": 4, "depth": 2, "trees": 24}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, **options).collect()}
        assert got == want


def test_near_odd_cases(spark):
    got = near_dedup.near_duplicates(odd_docs(spark)).collect()
    want = near_brute([(i, t) for i, t in texts(odd_rows()) if i is not None])
    assert len(got) == len(odd_rows())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(no_docs(spark)).count() == 0
    kept = near_dedup.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(300, 400)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[i] == 5 for i in range(300, 400)) and len(got) == 160
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hot_nodes_and_many_small_ones(spark):
    """A star whose centre has most edges, a fan into a greatest node, and pairs, more than the hot nodes' bound."""
    pairs = [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(1500)]
    star = [(5, i) for i in range(100, 2100)]
    fan = [(i, 9_000) for i in range(3000, 4500)] + [(4499, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs + star + fan, "a long, b long")).collect()}
    want = {b: a for a, b in pairs} | {i: 5 for i in range(100, 2100)} | {i: 4 for i in range(3000, 4500)} | {9000: 4}
    assert got == want
