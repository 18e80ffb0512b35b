"""Pseudonyms against a plain search of every token, and values of any length."""

import re

import duckdb

from driftline.llm import pii
from tests.conftest import SF_MID

TRIM = "\"'.,;:()<>[]{}!?"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_values(text):
    """Cards, addresses, e-mails and secrets of a text, token by token, without the operator's patterns."""
    words, found = text.split(), set()
    for i, w in enumerate(words):
        t = w.strip(TRIM)
        if t.isdigit() and 13 <= len(t) <= 19 and t.isascii() and len(set(t)) > 1 and luhn(t):
            found.add(t)
        if t.count(".") == 3 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in t.split(".")):
            found.add(t)
        local, at, domain = t.partition("@")
        if at and local and domain.count(".") and domain.rsplit(".", 1)[1].isalpha():
            found.add(t)
        if t[:4] in ("AKIA", "ASIA") and len(t) == 20 and t.isalnum() and t == t.upper():
            found.add(t)
        sign, eq, value = w.partition("=")
        if eq and sign.lower() in ("password", "token", "secret") and len(value.strip(TRIM)) >= 6:
            found.add(re.split(r"[^A-Za-z0-9_/+-]", value.strip(TRIM))[0])
        if w == "=" and 0 < i < len(words) - 1 and words[i - 1].lower() in ("password", "token", "secret"):
            found.add(re.split(r"[^A-Za-z0-9_/+-]", words[i + 1].strip(TRIM))[0])
    return found


def test_every_plain_value_is_replaced_and_nothing_else_changes(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF_MID}/documents.parquet')").fetchall()
    key = b"driftline pseudonyms"
    got = {r["doc_id"]: r for r in pii.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()}
    new, old, n = {}, {}, 0
    for i, text in rows:
        r, at, rebuilt = got[i], 0, ""
        for s in r["spans"] or []:
            value = text[s["first"]:s["last"]]
            assert new.setdefault((s["kind"], value), s["pseudonym"]) == s["pseudonym"]          # linked across documents
            assert old.setdefault((s["kind"], s["pseudonym"]), value) == value                   # no two values share one
            assert [c.isdigit() for c in value] == [c.isdigit() for c in s["pseudonym"]] or s["kind"] in ("ip", "key")
            if s["kind"] == "card":
                assert luhn(s["pseudonym"])
            rebuilt += text[at:s["first"]] + s["pseudonym"]
            at = s["last"]
        assert r["text"] == (None if text is None else rebuilt + text[at:])
        values = plain_values(text or "")
        spans = {text[s["first"]:s["last"]] for s in r["spans"] or []}
        assert values <= spans, (i, values - spans)
        n += len(values)
    assert n > 50


def test_values_of_any_length(spark):
    p = pii.Permutation(b"k")
    texts = ["password=" + "a" * 300, "token: " + "Q7" * 400, "x" * 300 + "@host.example.org", "secret = '" + "z" * 65 + "'",
             "token=" + "0123456789" * 20_000]
    for t in texts:
        new, spans = pii.pseudonymise(t, p)
        s, = spans
        value = t[s["first"]:s["last"]]
        assert len(value) >= 65 and new != t and len(new) == len(t) and re.sub("[a-z]", "a", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", new))) == \
            re.sub("[a-z]", "a", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", t)))
        assert pii.pseudonymise(t, p)[0] == new
    a, b = "m" * 70 + "a" * 60, "m" * 70 + "b" * 60
    x, y = pii.secret(p, a), pii.secret(p, b)
    assert x != y and x[:64] == y[:64] and x[64:128] != y[64:128]
    assert len({pii.secret(p, "q" * 66 + f"{i:02d}") for i in range(100)}) == 100
    assert {r["n_values"] for r in pii.pseudonyms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"k").collect()} == {1}
    big = 10**400
    assert len({p.once(x, big, "t") for x in range(50)}) == 50
