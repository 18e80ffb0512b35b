import random

import numpy as np

from driftline.llm import ann, licenses, pii, toxicity
from tests.llm.frames import no_docs, odd_docs, odd_rows, words


def labelled(n=1200, seed=5):
    """Documents with marked words in some, among noise; the held-out half is not in the labels."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        w = words(rng, rng.randint(20, 200)).split()
        if toxic:
            for _ in range(rng.randint(2, 12)):
                w.insert(rng.randrange(len(w)), "zorb" + words(rng, 1) if rng.random() < 0.5 else "krull")
        rows.append((i, " ".join(w).title() + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_severity_held_out_accuracy_and_order(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    half = spark.createDataFrame(labels[:600] + [(5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, half)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    got = {r["doc_id"]: r for r in toxicity.severity(docs, model).collect()}
    held = labels[600:]
    assert sum(got[i]["toxic"] == bool(y) for i, y in held) >= 0.99 * len(held)
    few = [got[i]["severity"] for i, t in rows if 2 <= sum(w.lower().strip(".").startswith(("zorb", "krull")) for w in t.split()) <= 4]
    many = [got[i]["severity"] for i, t in rows if sum(w.lower().strip(".").startswith(("zorb", "krull")) for w in t.split()) >= 9]
    assert np.mean(many) > np.mean(few) + 0.5
    assert all(abs(r["severity"] - 3) <= 3 and (r["toxic"] == (r["p_toxic"] >= 0.5)) for r in got.values())


def test_severity_odd_cases(spark):
    rows, labels = labelled(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = odd_docs(spark)
    got = toxicity.severity(odd, model).collect()
    assert len(got) == len(odd_rows()) and not any(r["toxic"] for r in got)
    kept = toxicity.keep_mild(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows())
    assert toxicity.severity(no_docs(spark), model).count() == 0
    none = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["severity"] for r in toxicity.severity(odd, none).collect()} == {0.0} or all(
        r["severity"] < 1e-9 for r in toxicity.severity(odd, none).collect())


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 4000)
    sparse = toxicity.Sparse([[0] if v else [] for v in x], [[v] if v else [] for v in x], 1)
    latent = 2.5 * np.log1p(x) + rng.logistic(size=4000)
    grade = np.digitize(latent, [1.0, 2.5, 4.0])
    w, theta = toxicity.cumulative_link(sparse, grade, 4, 1e-6)
    assert abs(w[0] - 2.5) < 0.3 and np.abs(theta - [1.0, 2.5, 4.0]).max() < 0.3


def test_permutation_is_a_bijection_and_keyed():
    p, q = pii.Permutation(b"a"), pii.Permutation(b"b")
    for n in (2, 10, 1000):
        assert sorted(p.once(i, n, "t") for i in range(n)) == list(range(n))
    assert [p.once(i, 1000, "t") for i in range(50)] != [q.once(i, 1000, "t") for i in range(50)]
    dates = {pii.date(p, f"2024-{m:02d}-{d:02d}") for m in range(1, 13) for d in range(1, 29)}
    assert len(dates) == 336 and all(pii.date(p, x) for x in dates)


def test_pseudonyms_keep_format_and_links(spark):
    card, mail = "4088495698897153", "tcdfck.28@mail7.example.com"
    rows = [(1, f"pay {card}, mail {mail}."), (2, f"4088 4956 9889 7153 and +1 (656) 555-6510; {mail.upper()}"),
            (3, "4088495698897154 1.2.3 300.1.1.1 2023-02-30 900-11-2222"), (4, None), (5, ""), (6, "none here"),
            (6, "ssn 123-45-6789 on 2024-02-29 from 49.34.128.250"), (None, "GB82 WEST 1234 5698 7654 32 password=32bb02aa3b58")]
    got = pii.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()
    by = [(r["text"], [s["kind"] for s in r["spans"]]) for r in got]
    assert [k for _, k in by] == [["card", "email"], ["card", "phone", "email"], [], [], [], [], ["ssn", "date", "ip"], ["iban", "secret"]]
    assert [t for t, _ in by][2:6] == [rows[2][1], None, "", "none here"]
    new = got[0]["spans"][0]["pseudonym"]
    assert new != card and new[0] == "4" and len(new) == 16 and pii.luhn_digit(new[:-1]) == new[-1]
    assert pii.only_digits(got[1]["spans"][0]["pseudonym"]) == new and got[1]["spans"][0]["pseudonym"][4] == " "
    assert got[0]["spans"][1]["pseudonym"].split("@")[0] == got[1]["spans"][2]["pseudonym"].split("@")[0]
    for r, (_, t) in zip(got, rows):
        for s in r["spans"]:
            assert s["pseudonym"] not in (t or "") and t[s["first"]:s["last"]] not in r["text"]
    iban = got[7]["spans"][0]["pseudonym"].replace(" ", "")
    assert pii.iban_check(iban[:2], iban[4:]) == iban[2:4]
    odd = pii.pseudonyms(odd_docs(spark), b"k").collect()
    assert [(r["doc_id"], r["text"]) for r in odd] == [(r[0], r[1]) for r in odd_rows()]
    assert pii.pseudonyms(no_docs(spark), b"k").count() == 0


def test_licences_and_unknown(spark):
    rng = random.Random(8)
    notices = {"mit": "Released under the MIT License.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
               "apache-2.0": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "licensed under CC BY-NC 4.0"}
    rows = [(i, words(rng, 40) + "\n" + words(rng, 30)) for i in range(60)]
    rows += [(100 + i, words(rng, 25) + "\n" + t + "\n" + words(rng, 9)) for i, t in enumerate(notices.values())]
    rows += [(200, "\n".join(notices.values())), (201, None), (202, ""), (203, "The license of the driver was under review."),
             (203, notices["mit"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.train(docs, background=500)
    got = {r["doc_id"]: r for r in licenses.document_licences(docs, model).collect()}
    for i, family in enumerate(notices):
        assert got[100 + i]["families"] == [family] and got[100 + i]["n_paragraphs"] == 1
    assert got[200]["families"] == sorted(notices) and got[200]["n_paragraphs"] == 4
    assert got[203]["families"] == ["mit"]
    assert all(got[i]["families"] == [] for i in [*range(60), 201, 202])
    assert licenses.document_licences(docs, model).count() == len(rows)
    plain = spark.createDataFrame([(t,) for f in licenses.TEMPLATES for t in licenses.TEMPLATES[f]], "text string")
    assert plain.count() < 200
    odd = licenses.document_licences(odd_docs(spark), model).collect()
    assert len(odd) == len(odd_rows()) and all(r["families"] == [] for r in odd)
    assert licenses.document_licences(no_docs(spark), model).count() == 0


VEC = "vec_id long, embedding array<float>, part int, rank string"


def brute(rows, k, every):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows
          if i is not None and v and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = sorted((-float((q * v).sum()), j) for j, v in ok if j != i)[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def vectors(n, seed=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 8))
    return [(int(i), (centre[i % 12] + 0.5 * rng.normal(size=8)).astype(np.float32).tolist(), 1, "x") for i in range(n)]


def test_search_of_one_part_is_exact_with_ties_and_unusable_rows(spark):
    rows = vectors(90)
    rows += [(100 + i, rows[3][1], 1, "x") for i in range(40)]                # ties go to the smaller id
    rows += [(200, None, 1, "x"), (220, [], 1, "x"), (240, [0.0] * 8, 1, "x"), (260, [1.0, None] * 4, 1, "x"),
             (280, [float("nan")] * 8, 1, "x"), (300, [float("inf")] * 8, 1, "x"), (320, [1.0] * 5, 1, "x"), (None, [1.0] * 8, 1, "x")]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, VEC), "vec_id % 20 = 0", parts=1).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows, 20, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    assert ann.search(spark.createDataFrame([], VEC), "vec_id % 20 = 0").count() == 0


def test_search_learned_partitions_recall(spark):
    rows = vectors(4000)
    found = ann.search(spark.createDataFrame(rows, VEC), "vec_id % 20 = 0", parts=16, block=300, sample=2048)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows, 20, 20)
    hits = sum(len(got[q] & {j for j, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert hits >= 0.9 * 20 * len(want)


def test_parts_follow_the_size_of_the_table():
    assert [ann.part_count(n) for n in (0, 20, 500, 2000, 51_282, 100_000)] == [1, 1, 20, 64, 64, 64]
    assert ann.part_count(400_000) == 128 and ann.part_count(10**9) == 256 and ann.part_count(10**9, sample=65_536) == 2048
