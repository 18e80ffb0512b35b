import base64
import gzip
import hashlib
import re

import pytest

from driftline.llm import mixing, warc
from driftline.llm.common import file_system
from tests.llm.frames import no_docs, odd_docs, odd_rows


def plain_targets(sizes, weights, budget, max_repeat):
    """Water filling as the contract says it: full sources stop, the excess is reshared by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, left, open_ = {}, float(budget), names
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > max_repeat * sizes[s]]
        target |= {s: float(max_repeat * sizes[s]) for s in over} if over else {s: left * weight[s] / total for s in open_}
        left, open_ = left - sum(target[s] for s in over), [s for s in open_ if s not in target]
    return target


def test_targets_of_many_sources(spark):
    import random
    rng = random.Random(8)
    for n in (1, 3, 700):
        sizes = {None if i == 2 else f"site-{'é' if i % 3 else 'z'}-{i}.example": int(rng.paretovariate(0.6) * 10) % 10**7 for i in range(n)}
        table = spark.createDataFrame([([s], v) for s, v in sizes.items()], "pattern array<string>, pattern_size long")
        got = {r["source"]: r["target"] for r in mixing.source_table(table, (3, 1, 2), 1.5, 2).collect()}
        want = plain_targets(sizes, (3, 1, 2), 1.5 * sum(sizes.values()), 2)
        assert got == {s: pytest.approx(v, rel=1e-9) for s, v in want.items()}


def test_every_source_of_a_host_list_is_mixed(spark):
    """More sources than documents each, none of which overlap but two: no list of them reaches the driver."""
    rows = [(i, "w " * (1 + i % 5), [f"host{i // 3}"] if i % 50 else [f"host{i // 3}", "shared"]) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(got) == 6000 and all(0 <= r["copies"] <= 2 for r in got)
    alone = {}
    for r in got:
        if len(r["pattern"]) == 1 and int(r["pattern"][0][4:]) * 3 % 50 not in (48, 49, 0):
            x = alone.setdefault(r["pattern"][0], [0, r["target"]])
            x[0] += r["taken"]
    assert len(alone) > 1500 and all(abs(t - want) <= 5 for t, want in alone.values())


def test_flow():
    # the shared pattern serves the source that has too little of its own; first copies before second ones
    flow = mixing.min_cost_flow({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 100, "b": 110}, 2)
    assert flow == {(("a",), "a"): 100, (("a", "b"), "b"): 100, (("b",), "b"): 10}
    flow = mixing.min_cost_flow({("a",): 100}, {"a": 150}, 2)
    assert flow == {(("a",), "a"): 150}


def brute_sizes(rows):
    return [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, _, s, *_ in rows]


def test_mix_odd_cases(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    again = mixing.mix(odd_docs(spark)).collect()
    key = lambda r: str((r["doc_id"], r["size"], r["copies"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    want = brute_sizes(odd_rows())
    assert sorted(((r["doc_id"], r["size"], r["pattern"][0]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got)
    assert mixing.mix(no_docs(spark)).count() == 0
    docs = mixing.mixed_documents(odd_docs(spark))
    assert docs.columns == odd_docs(spark).columns


def test_mix_meets_targets_of_hot_and_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 37), ["s0"] if i % 3 == 0 else ["s1", "s2"] if i % 3 == 1 else [f"s{i % 5}", "s0"]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(docs).collect()
    assert len(got) == 3000
    total = sum(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) < 400            # within half a document a segment
    plain = spark.createDataFrame([(i, t, s[0]) for i, t, s in rows], "doc_id long, text string, source string")
    by = {}
    for r in mixing.mix(plain).collect():
        x = by.setdefault(r["pattern"][0], [0, r["target"], r["source_size"], 0])
        x[0] += r["taken"]
        x[3] += r["size"]
    for taken, target, size, own in by.values():
        assert abs(taken - target) <= 10 and size == own and target <= 2 * size + 1e-9


PAGES = "page_id long, url string, html string, record_type string, n int"


def page_rows():
    big, small = "<p>é" + "x" * 2000, "<p>" + "y" * 500
    rows = [(i, f"http://a/{i}", big) for i in (3, 9, 5)] + [(i, None, small) for i in (1, 2)]
    rows += [(20, "u\nv", None), (21, "", ""), (22, "http://b", "z" * 300_000), (9, "http://again", big)]
    return [(*r, "q", 1) for r in rows]


def test_warc_round_trip(spark):
    rows = page_rows()
    folder = warc.archive_pages(spark.createDataFrame(rows, PAGES))
    got = sorted((tuple(r) for r in warc.archived_pages(spark, folder).collect()), key=str)
    want = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and i in (3, 5)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert got == sorted(want, key=str)
    records = warc.read_archive(spark, folder).collect()
    payload = {warc_id(r): r["payload"] for r in records if r["record_type"] == "response"}
    assert payload[22] == b"z" * 300_000 and payload[20] == b"" and len(records) == len(rows)
    for r in records:
        if r["payload"] is not None:
            assert warc.hex_digest(r["payload_digest"]) == hashlib.sha1(r["payload"]).hexdigest()
    assert {warc_id(r): r["target_uri"] for r in records}[20] == "u%0Av"


def warc_id(r):
    return int(re.search(r"-?\d+", r["record_id"])[0])


def test_warc_files_are_plain_gzip_records(spark):
    folder = warc.archive_pages(spark.createDataFrame(page_rows(), PAGES).coalesce(1))
    store, root = file_system(folder)
    from pyarrow import fs
    data = b""
    for f in store.get_file_info(fs.FileSelector(root)):
        if f.path.endswith(".warc.gz"):
            data += gzip.decompress(store.open_input_file(f.path).read())
    heads = re.findall(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", data, re.S)
    assert len(heads) == len(page_rows())
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"").digest()).decode()
    assert sum(digest.encode() in h for h in heads) == 2


def test_warc_predicates_are_pushed_and_payloads_skipped(spark, monkeypatch):
    folder = warc.archive_pages(spark.createDataFrame(page_rows(), PAGES))
    plan = warc.read_archive(spark, folder).where("record_type = 'revisit' AND target_uri = 'http://a/3'")
    assert [warc_id(r) for r in plan.collect()] == [3]
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    reader = warc.WarcReader({"path": folder})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("block_length",), 3), In(("target_uri",), ("a",))]))
    assert left == [GreaterThan(("block_length",), 3)] and len(reader.tests) == 2
    assert not reader.passes({"record_type": "response"}) and reader.passes({"record_type": "revisit", "target_uri": "a"})
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 0
    bare = warc.read_archive(spark, folder, payload=False).collect()
    assert len(bare) == len(page_rows()) and all(r["payload"] is None for r in bare)


def test_warc_splits_and_empty_table(spark):
    folder = warc.archive_pages(spark.createDataFrame(page_rows(), PAGES).coalesce(1))
    reader = warc.WarcReader({"path": folder, "splitbytes": "300"})
    parts = reader.partitions()
    assert len(parts) > 3
    assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(r["record_id"] for r in warc.read_archive(spark, folder).collect())
    empty = warc.archive_pages(spark.createDataFrame([], PAGES))
    assert warc.archived_pages(spark, empty).count() == 0


def test_digest_text_in_sql(spark):
    for b in (b"", b"abc", b"\xff" * 50):
        h = hashlib.sha1(b)
        from pyspark.sql import functions as F
        got = spark.range(1).select(warc.base32(F.lit(h.hexdigest())).alias("x")).first()["x"]
        assert got == base64.b32encode(h.digest()).decode()


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_warc_archive"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from driftline.llm.queries import LLM_ORACLES, LLM_QUERIES
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = c.sql(LLM_ORACLES[name])
    got = LLM_QUERIES[name](spark, d).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_warc_rows_of_one_id_with_unlike_payloads(spark):
    a, b, c = "A" * 1500, "B" * 1500, "c" * 20
    rows = [(5, "u", a), (5, "u", b), (3, "u", a), (2, "u", b), (5, "u", c), (5, "u", a), (None, "u", a), (None, "u", None)]
    folder = warc.archive_pages(spark.createDataFrame([(*r, "q", 1) for r in rows], PAGES))
    got = sorted((tuple(r) for r in warc.archived_pages(spark, folder).collect()), key=str)
    want = [(i, len(h or ""), hashlib.sha1((h or "").encode()).hexdigest(), *(("revisit", 5) if len(h or "") > 1000 and i != 5 else ("response", None)))
            for i, _, h in rows]
    assert got == sorted(want, key=str)
