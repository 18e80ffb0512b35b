import hashlib
import random
import re

import pytest

from driftline.llm import fim
from tests.llm.frames import DOCS, no_docs, odd_docs, odd_rows

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_version(doc_id, text, seed=7, rate=100, spm=50):
    """The contract, on strings."""
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    lines = LINES.findall(text)
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, rows, **options):
    got = fim.restored(fim.rearranged(df, **options)).collect()
    want = sorted((repr((i, *plain_version(i, t or "", **options))) for i, t in rows))
    assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got) == want
    back = sorted(repr((i, t or "")) for i, t in rows)
    assert sorted(repr((r["doc_id"], r["restored"])) for r in got) == back
    for r in got:
        assert r["output_sha256"] == sha(r["output"]) and r["restored_sha256"] == sha(r["restored"])
        doc, marks = r["restored"].encode(), "".join(fim.DEFAULT_SENTINELS).encode()
        assert b"".join((doc if p["buffer"] == "text" else marks)[p["start"]:p["start"] + p["length"]] for p in r["pieces"]) == r["output"].encode()
    return got


def test_odd_rows_and_no_rows(spark):
    check(odd_docs(spark), [r[:2] for r in odd_rows()])
    assert fim.restored(fim.rearranged(no_docs(spark))).collect() == []


def test_lines_sentinels_and_rates(spark):
    rng = random.Random(3)
    texts = ["\n", "\n\n\n", "a", "a\n", "é\r\n x\nß", "x <P> y\nz", "<S>", "a<M>", "a<\nP>b", "<P\n>\nS>\n<", "<<\n<M\n", "x\n" * 70_000]
    texts += ["".join(rng.choice(["a", "é", "\n", "<", "P", ">", "𝒳", " "]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[4]), (-3, "a\nb\nc"), (None, "a\nb")]
    df = spark.createDataFrame([(i, t, *[None] * (len(DOCS) - 2)) for i, t in rows], DOCS)
    forms = {r["form"] for r in check(df, rows)}
    assert forms == {"plain", "psm", "spm"}
    check(df, rows, seed=11, rate=40, spm=80)
    assert {r["form"] for r in check(df, rows, rate=0)} == {"plain"}


def test_sentinels_with_two_readings_are_refused():
    for bad in (("<P>", "<P>", "<S>"), ("aba", "<M>", "<S>"), ("<P", "P>", "x"), ("<P>", "<P><", "y"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.Sentinels(bad)


def test_piece_table_permutes_and_restores():
    s = fim.Sentinels(fim.DEFAULT_SENTINELS)
    t = fim.PieceTable(memoryview(b"one two three"), s.buffer, [(fim.TEXT, 0, 13)]).cut([4, 8])
    for form, out in (("psm", b"<P>one <S>three<M>two "), ("spm", b"<S>three<P>one <M>two ")):
        a = t.arranged(fim.ORDER[form], s.pieces)
        assert b"".join(a.views()) == out and a.restored(fim.ORDER[form]).pieces == t.pieces
        assert b"".join(fim.read_back(memoryview(out), form, s).views()) == b"one two three"
