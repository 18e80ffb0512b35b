"""The pipeline's stages on the smallest tables, each against a plain version on its own input."""

import re

import corpus_pipeline as cp
from driftline.llm.common import written
from driftline.sources.tables import load_table
from tests.llm.frames import lower
from tests.llm.test_dedup import near_brute
from tests.llm.test_tokens import crc, ids

SF = "/root/testdata/sf0.001"


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_stages(spark):
    docs = load_table(spark, SF, "documents")
    columns, stages = docs.columns, dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    rows = docs.collect()
    clean = {r["doc_id"] for r in load_table(spark, SF, "labels").where("toxic = 0").collect()}

    mild = written(stages["toxicity"](spark, docs, SF), "t")
    kept = mild.collect()
    assert mild.columns == columns and clean <= {r["doc_id"] for r in kept} <= {r["doc_id"] for r in rows}

    exact = written(stages["exact_dedup"](spark, mild, SF), "t")
    top = {}
    for r in kept:
        top[lower(r["text"] or "")] = max(r["doc_id"], top.get(lower(r["text"] or ""), -1))
    got = exact.collect()
    assert exact.columns == columns and sorted(r["doc_id"] for r in got) == sorted(top.values())

    near = written(stages["near_dedup"](spark, exact, SF), "t")
    want = {i for i, (_, c) in near_brute([(r["doc_id"], r["text"] or "") for r in got], 80).items() if i == c}
    got = near.collect()
    assert near.columns == columns and {r["doc_id"] for r in got} == want and len(got) == len(want)

    mixed = written(stages["mixing"](spark, near, SF), "t")
    total, copies = sum(size(r["text"]) for r in got), {}
    rows = mixed.collect()
    for r in rows:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert mixed.columns == columns and max(copies.values()) <= 2 and set(copies) <= want
    assert abs(sum(size(r["text"]) for r in rows) - 1.5 * total) < 0.02 * total

    packed = stages["packing"](spark, mixed, SF).collect()
    pieces = []
    for r in rows:
        x = ids(r["text"] or "") + [1]
        pieces += [(r["doc_id"], k, s, len(x[s:s + 4096]), crc(x[s:s + 4096])) for k, s in enumerate(range(0, len(x), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(pieces)
    assert len({r["sequence_id"] for r in packed}) <= 1.02 * sum(p[3] for p in pieces) / 4096 + 1
