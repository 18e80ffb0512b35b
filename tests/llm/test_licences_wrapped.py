"""Notices that are wrapped over lines, or lie inside a long line, are found."""

import random
import textwrap

from driftline.llm import licenses
from tests.llm.frames import words


def test_wrapped_notices_and_notices_in_long_lines(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 40) + "\n" + words(rng, 30)) for i in range(60)]
    want = {}
    for n, family in enumerate(sorted(licenses.TEMPLATES)):
        notice = max(licenses.TEMPLATES[family], key=len)
        wrapped = "\n".join(" * " + x for x in textwrap.wrap(notice, 72))
        rows.append((100 + n, words(rng, 20) + "\n\n/*\n" + wrapped + "\n */\n\n" + words(rng, 20)))
        rows.append((200 + n, words(rng, 700) + " " + notice + " " + words(rng, 400)))
        rows.append((300 + n, words(rng, 90) + "\n" + textwrap.fill(notice, 72) + "\n" + words(rng, 90)))
        want |= {100 + n: [family], 200 + n: [family], 300 + n: [family]}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.train(docs, background=500)
    got = {r["doc_id"]: r for r in licenses.document_licences(docs, model).collect()}
    assert {i: got[i]["families"] for i in want} == want
    assert all(got[i]["n_paragraphs"] == 1 for i in want if i < 200)
    assert all(got[i]["families"] == [] and got[i]["n_paragraphs"] == 0 for i in range(60))
