import hashlib
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm import repair

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                     T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("k", "rev", "tie", "edit", "gone", "blk")]])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * 6) for r in rows], ROWS).repartition(3)


def damaged(rows):
    one = lambda x: " " if x is None else str(x)
    out = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        role, text = "user" if d == 4 else one(role), one(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(c, t, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) of one conversation by trying every edit everywhere."""
    seen, faults = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))

    @lru_cache(None)
    def best(i, before, inserted):
        """Before: '' at the start, else the last kept initial. Two inserts in a row change nothing, so two are tried."""
        options = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        turns = {"": "u", "s": "u", "u": "a", "a": "u"}
        name = {"u": "user", "a": "assistant"}[turns[before]]

        def go(cost, letter, lines, *rest):
            c, a, more = best(*rest)
            options.append((cost + c, letter + a, lines + more))
        if inserted < 2:
            go(3, "I", ((name, ""),), i, turns[before], inserted + 1)
        if i < len(rows):
            role, text = rows[i]
            go(4, "D", (), i + 1, before, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                go(3 + more, "R", ((name, text),), i + 1, turns[before], 0)
                if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[before] and role:
                    go(more, "K", ((role, text),), i + 1, role[0], 0)
        return min(options, default=(10**9, "", ()))
    return faults, best(0, "", 0)


def plain_report(rows):
    out = []
    after = damaged(rows)
    for c in sorted({r[0] for r in rows}, key=repr):
        mine = [r[1:] for r in after if r[0] == c]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, (cost, audit, lines) = cheapest([r[1:] for r in mine])
        turns = {t for t, *_ in mine if t is not None}
        first = [r[1][:1] for r in mine]
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    got = repair.report(repair.repaired(repair.damaged(frame(spark, rows)), gone=F.col("gone"), **options))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def some_rows(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        text = lambda: rng.choice(["Yes.", "No!", "why?", "cut", "cut ", " \t", "", "And so on.\n", "Ä…"]) + rng.choice(["", "", " x.", f" {rng.random()}."])
        for t in range(rng.randint(1, longest)):
            rows.append((c, t + (t > 5), rng.choice(["system"] * (t == 0) + ["user", "assistant"][t % 2:][:1] * 6 + ["user", "assistant", "tool", "unknown"]), text()))
    return rows


ODD = [(900, None, "user", "a."), (900, 2, None, None), (900, 5, "assistant", "b."), (900, 5, "assistant", "b."), (901, None, None, None),
       (None, 1, "user", "q."), (None, 2, "assistant", "r."), (None, 2, "assistant", "r"), (902, 1, "", "x."), (903, -4, "s", "y."),
       (904, 0, "system", "only."), (905, 3, "user", "w " * 60_000 + "."), (905, 4, "assistant", "z." * 40_000)]


def test_reports_equal_trying_every_edit(spark):
    rows = some_rows(1, 120, 9) + ODD
    want = plain_report(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, block=3, partitions=5) == want                   # conversations of several blocks
    assert {"K", "R", "D", "I"} <= set("".join(r[7] for r in want))


def test_long_conversation_in_blocks(spark):
    rows = some_rows(7, 3, 160) + [(50, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(700)]
    want = plain_report(rows[:-700])
    got = {b: found(spark, rows, block=b) for b in (7, 64, 4096)}
    assert got[7] == got[64] == got[4096] and [r for r in got[7] if r[0] != 50] == want


def test_conversation_of_dropped_rows_alone_and_no_rows(spark):
    lost = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(lost, 0, "user", "x.")]) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(spark, []) == []


def test_repaired_rows_follow_the_grammar(spark):
    rows = some_rows(3, 60, 8)
    got = repair.repaired(frame(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r)
    assert set(by) == {r[0] for r in rows}
    for c, mine in by.items():
        assert [r["place"] for r in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in mine if r["edit"] != "D"))
        assert sorted((r["turn"], r["old_role"], r["text"]) for r in mine if r["edit"] != "I") == sorted(r[1:] for r in rows if r[0] == c)


def test_shared_suffixes_are_built_once():
    automaton, sequences = repair.SuffixAutomaton(), sorted(a + b for a in ("auau", "auas") for b in ("", "a", "u", "ad", "aU"))
    suffixes = {s[:i] for s in sequences for i in range(1, len(s) + 1)}
    for s in sequences:
        automaton.read(s, repair.END)
    assert automaton.built == len(suffixes) < sum(map(len, sequences))
