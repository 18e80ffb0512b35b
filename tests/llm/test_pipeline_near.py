"""The pipeline's near-duplicate stage links what is 0.80 similar or more."""

import random

import corpus_pipeline as cp
from driftline.sources.tables import load_table
from tests.llm.frames import words
from tests.llm.test_dedup import near_brute, shingles


SF = "/root/testdata/sf0.001"


def test_near_stage_drops_copies_between_80_and_85(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        base = words(rng, 200).split()
        copy = list(base)
        for at in (30, 75, 120, 165)[:3 + i % 2]:
            copy[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    alike = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert sum(0.80 <= s < 0.85 for s in alike) >= 20
    want = {i for i, (_, c) in near_brute(rows, 80).items() if i == c}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in dict(cp.STAGES)["near_dedup"](spark, docs, "").collect()]
    assert sorted(got) == sorted(want) and len(want) == 40


def test_near_stage_equals_brute_force_at_80_on_the_smallest_table(spark):
    docs = load_table(spark, SF, "documents").dropDuplicates(["text"])
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = {i for i, (_, c) in near_brute(rows, 80).items() if i == c}
    assert want != {i for i, (_, c) in near_brute(rows, 85).items() if i == c}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dict(cp.STAGES)["near_dedup"](spark, docs, SF).collect()) == sorted(want)
