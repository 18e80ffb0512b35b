"""Conversation structure repair with a suffix-shared automaton (DAWG).

A conversation's rows are taken by turn (nulls first), rows of one turn by role and then by the sha256 of
their text. Their faults, the first that holds: ``blank`` (nothing but ASCII white space), ``duplicate`` (role
and text seen earlier in the conversation), ``truncated`` (the last character other than white space is none of
``.!?``). Edits: Keep (cost 0), Rerole to user or assistant (3), Delete (4; required for blank and duplicate rows)
and Insert an empty user or assistant text anywhere (3); a truncated row that stays costs 3 more. The cheapest
edits that give role initials ``(s?(ua)+)?`` are made, of equally cheap ones those whose initials (K, R, D, I)
come first in ASCII order.

1. Signatures: every row becomes one symbol (role initial and fault). A conversation is cut, counted from its
   end, into blocks of ``block`` rows; a block's symbols, last one first, are its signature.
2. The distinct signatures of all conversations are sorted and dealt by range, so that equal suffixes lie next
   to each other: a task builds the automaton of its range one signature after another, keeping the nodes of the
   suffix that a signature shares with the one before. A node holds, for each of the grammar's four states, the
   cost to go and the first edit of the best audit suffix with a link to the rest of it; each is computed
   once for all conversations that end so. Edits of equal cost differ in their first letter, so comparing
   it orders whole audits.
3. Only a conversation of several blocks needs more: the blocks' state-to-state costs (the same automaton with
   one final state at a time) are chained from its end to give each block the costs behind it, which
   take the place of the grammar's final states.
4. The audits meet the rows again in a table sorted by conversation; a task reads it as a stream and writes the
   repaired rows.

A conversation is read as a stream by one task twice (its narrow signature rows, then its rows), because a digest
over its text is a sequential value; nothing of it is held but a block of symbols and its audit. Nulls in role or
text are one space (so a null text is blank); rows with a null conversation id are one conversation; repeated rows
are duplicates. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import written

WHITE = " \t\n\x0b\x0c\r"
STATES = "ESUA"                                # nothing yet; after system; after user; after assistant
E_, S_, U_, A_ = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The state after a row that is reroled or inserted: user, but assistant after user.
NEXT = (U_, U_, A_, U_)
#: The states after a kept row of a role initial.
KEEP = {"s": {E_: S_}, "u": {E_: U_, S_: U_, A_: U_}, "a": {U_: A_}, "o": {}}
ROLE = {U_: "user", A_: "assistant"}
#: Behind a whole conversation: states E and A are final, the others insert what is missing.
END = "end"
INF = math.inf

Choice = tuple[float, str, int]                # cost to go, first edit ("" to stop here), state after it


def terminal_node(terminal: str) -> list[Choice]:
    """The node behind a signature: the end of a conversation, or the costs behind each state ("" for none)."""
    if terminal == END:
        return [(0, "", E_), (2 * INSERT, "I", U_), (INSERT, "I", A_), (0, "", A_)]
    return [(float(c) if c else INF, "", st) for st, c in enumerate(terminal.split(","))]


def node_before(symbol: str, rest: list[Choice]) -> list[Choice]:
    """The node of a suffix from its first symbol and the node of the rest."""
    own = []
    for st in range(4):
        best = (DELETE + rest[st][0], "D", st)
        if symbol != "d":
            more = TRUNCATED if symbol.isupper() else 0
            kept = KEEP[symbol.lower()].get(st)
            if kept is not None:
                best = min(best, (more + rest[kept][0], "K", kept))
            best = min(best, (REROLE + more + rest[NEXT[st]][0], "R", NEXT[st]))
        own.append(best)
    # one insert leads to user or assistant; a second could only lead on to the other of the two
    ua = {st: min(own[st], (INSERT + own[NEXT[st]][0], "I", NEXT[st])) for st in (U_, A_)}
    return [ua[st] if st in ua else min(own[st], (INSERT + ua[U_][0], "I", U_)) for st in range(4)]


class SuffixAutomaton:
    """Nodes along the current signature; a signature that shares a suffix with the one before keeps its nodes."""

    def __init__(self):
        self.terminal, self.rev, self.nodes, self.built = None, "", [], 0

    def read(self, rev: str, terminal: str) -> None:
        """Go to the signature ``rev`` (symbols from the last to the first)."""
        if terminal != self.terminal:
            self.terminal, self.rev, self.nodes = terminal, "", [terminal_node(terminal)]
        shared = 0
        for a, b in zip(rev, self.rev):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1:]
        for symbol in rev[shared:]:
            self.nodes.append(node_before(symbol, self.nodes[-1]))
            self.built += 1
        self.rev = rev

    def costs(self) -> list[float]:
        return [c for c, _, _ in self.nodes[-1]]

    def audit(self, st: int) -> tuple[str, int] | None:
        """The best audit from a state, and the state it ends in; None where there is none."""
        if self.nodes[-1][st][0] == INF:
            return None
        at, out = len(self.nodes) - 1, []
        while (edit := self.nodes[at][st][1]) or at:
            out.append(edit)
            st = self.nodes[at][st][2]
            at -= edit != "I"
        return "".join(out), st


def solved(signatures: DataFrame, partitions: int) -> DataFrame:
    """For each distinct (rev, terminal): costs, audits and final states by first state (null for none)."""
    def run(batches):
        automaton = SuffixAutomaton()
        for batch in batches:
            rows = {"rev": [], "terminal": [], "costs": [], "audits": [], "finals": []}
            for rev, terminal in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                automaton.read(rev, terminal)
                found = [automaton.audit(st) for st in range(4)]
                for c, v in zip(rows.values(), (rev, terminal, [None if c == INF else c for c in automaton.costs()],
                                                [f and f[0] for f in found], [f and f[1] for f in found])):
                    c.append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                ("rev", pa.string()), ("terminal", pa.string()), ("costs", pa.list_(pa.float64())),
                ("audits", pa.list_(pa.string())), ("finals", pa.list_(pa.int32()))]))

    dealt = signatures.select("rev", "terminal").distinct().repartitionByRange(partitions, "terminal", "rev")
    return dealt.sortWithinPartitions("terminal", "rev").mapInArrow(
        run, "rev string, terminal string, costs array<double>, audits array<string>, finals array<int>")


def behind(blocks: DataFrame, partitions: int) -> DataFrame:
    """Blocks of conversations with several: k, blk, rev and the terminal that the blocks behind make.

    ``blk`` counts from the conversation's last block; its blocks are chained in that order as a stream."""
    units = [",".join("0" if j == st else "" for j in range(4)) for st in range(4)]
    one = F.explode(F.array(*[F.lit(u) for u in units])).alias("terminal")
    whole = written(blocks, "repair-blocks")
    inner = whole.where("blk > 0").select("rev", one)
    last = whole.where("blk = 0").select("rev", F.lit(END).alias("terminal"))
    costs = solved(inner.unionByName(last), partitions)
    by_final = costs.groupBy("rev").agg(F.map_from_entries(F.collect_list(F.struct("terminal", "costs"))).alias("m"))

    def run(batches):
        key, v = None, None
        for batch in batches:
            out = {"k": [], "blk": [], "rev": [], "terminal": []}
            for k, blk, rev, m in zip(*(batch.column(i).to_pylist() for i in range(4))):
                m = dict(m)
                if k != key:
                    key, terminal = k, END
                    v = [INF if c is None else c for c in m[END]]
                else:
                    least = min(v)
                    terminal = ",".join("" if c == INF else f"{c - least:g}" for c in v)
                    rows = [[INF if c is None else c for c in m[u]] for u in units]       # final state, then first
                    v = [min(rows[j][st] + v[j] for j in range(4)) for st in range(4)]
                for c, x in zip(out.values(), (k, blk, rev, terminal)):
                    c.append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("k", pa.string()), ("blk", pa.int64()), ("rev", pa.string()), ("terminal", pa.string())]))

    met = whole.join(by_final, "rev").select("k", "blk", "rev", "m")
    return met.repartition(partitions, "k").sortWithinPartitions("k", "blk").mapInArrow(run, "k string, blk long, rev string, terminal string")


def signature_blocks(rows: DataFrame, block: int) -> DataFrame:
    """k, blk (0 for the last ``block`` rows of a conversation), rev (symbols, last row first)."""
    body = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    narrow = rows.select("k", "turn", "role", "tie", (body == "").alias("blank"), F.when(
        F.right(body, F.lit(1)).isin(".", "!", "?"), plain).otherwise(F.upper(plain)).alias("symbol"))
    placed = narrow.withColumn("rpos", F.row_number().over(Window.partitionBy("k").orderBy(
        F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("tie").desc())))
    seen = F.row_number().over(Window.partitionBy("k", "role", "tie").orderBy(F.col("rpos").desc()))
    symbols = placed.select("k", "rpos", F.when(F.col("blank") | (seen > 1), F.lit("d")).otherwise(F.col("symbol")).alias("symbol"))
    return symbols.groupBy("k", F.floor((F.col("rpos") - 1) / F.lit(block)).cast("long").alias("blk")).agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("rpos", "symbol"))), lambda x: x["symbol"])).alias("rev"))


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string, old_role string, fault string"
SCHEMA = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
                    ("role", pa.string()), ("text", pa.string()), ("old_role", pa.string()), ("fault", pa.string())])


class _Writer:
    """Rows for record batches of a bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 4096, size: int = 8 << 20):
        self.schema, self.rows, self.bytes = schema, rows, size
        self.clear()

    def clear(self):
        self.columns, self.size = [[] for _ in self.schema], 0

    def add(self, values: Iterable, size: int = 0):
        for c, v in zip(self.columns, values):
            c.append(v)
        self.size += size

    def full(self) -> bool:
        return len(self.columns[0]) >= self.rows or self.size >= self.bytes

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.clear()
        return out


class _Conversation:
    """The audit of one conversation, spent as its rows come by."""

    def __init__(self, key: str):
        self.key, self.entry, self.parts, self.symbols, self.audit = key, E_, [], [], None
        self.conv_id, self.at, self.st, self.place, self.seen = None, 0, E_, 0, 0

    def add_block(self, rev: str, audits: list, finals: list):
        self.symbols += reversed(rev)
        self.parts.append(audits[self.entry])
        self.entry = finals[self.entry]

    def inserts(self, out: _Writer):
        """The inserted rows that come next in the audit."""
        if self.audit is None:
            self.audit = "".join(self.parts)
        while self.audit[self.at:self.at + 1] == "I":
            self.st = NEXT[self.st]
            out.add((self.conv_id, self.place, "I", None, ROLE[self.st], "", None, None))
            self.at, self.place = self.at + 1, self.place + 1

    def row(self, turn, role, text, out: _Writer):
        self.inserts(out)
        edit, new = self.audit[self.at], role
        body, symbol = text.rstrip(WHITE), self.symbols[self.seen]
        fault = "blank" if not body else "duplicate" if symbol == "d" else "truncated" if symbol.isupper() else None
        if edit == "R":
            self.st = NEXT[self.st]
            new = ROLE[self.st]
        elif edit == "K":
            self.st = KEEP[role[0]][self.st]
        out.add((self.conv_id, self.place, edit, turn, new, text, role, fault), len(text))
        self.at, self.place, self.seen = self.at + 1, self.place + 1, self.seen + 1


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
             *, gone: Column | None = None, block: int = 4096, partitions: int | None = None) -> DataFrame:
    """The rows of every conversation after repair, in order: conv_id, place, edit (K, R, D or I), turn, role, text,
    old_role (null if inserted), fault. Deleted rows are listed with edit D.

    Rows where ``gone`` holds take no part; they come last in their conversation with edit null, so that a
    conversation of such rows alone is still listed. Partitions hold whole conversations in order."""
    spark = rows.sparkSession
    partitions = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cid = F.col(conv_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    all_rows = rows.select(
        F.coalesce(F.concat(F.lit("="), cid.cast("string")), F.lit("")).alias("k"), cid.alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("tie"), text.alias("text"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"))
    blocks = written(signature_blocks(all_rows.where("not gone"), block), "repair-signatures")
    long_ones = blocks.where("blk > 0").select("k").distinct()
    single = blocks.join(long_ones, "k", "left_anti").select("k", "blk", "rev", F.lit(END).alias("terminal"))
    known = single
    if not blocks.where("blk > 0").isEmpty():
        known = single.unionByName(behind(blocks.join(long_ones, "k", "left_semi"), partitions))
        known = written(known, "repair-terminals")
    audits = known.join(solved(known, partitions), ["rev", "terminal"])

    def run(batches):
        out, now = _Writer(SCHEMA), None
        for batch in batches:
            column = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns)))
            for i, (k, kind) in enumerate(zip(column["k"], column["kind"])):
                if now is None or k != now.key:
                    if now is not None:
                        now.inserts(out)
                    now = _Conversation(k)
                if kind == 0:
                    now.add_block(column["rev"][i], column["audits"][i], column["finals"][i])
                    continue
                now.conv_id = column["conv_id"][i]
                if column["gone"][i]:
                    now.inserts(out)
                    out.add((now.conv_id, None, None, column["turn"][i], None, None, column["role"][i], None))
                else:
                    now.row(column["turn"][i], column["role"][i], column["text"][i], out)
                if out.full():
                    yield out.batch()
        if now is not None:
            now.inserts(out)
        yield out.batch()

    null = lambda t: F.lit(None).cast(t)
    stream = all_rows.select("k", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"), "gone", "turn", "role", "tie", "conv_id", "text",
                             null("string").alias("rev"), null("array<string>").alias("audits"), null("array<int>").alias("finals")).unionByName(
        audits.select("k", F.lit(0).alias("kind"), (-F.col("blk")).alias("at"), F.lit(False).alias("gone"), null("long").alias("turn"),
                      null("string").alias("role"), null("binary").alias("tie"), null("long").alias("conv_id"), null("string").alias("text"),
                      "rev", "audits", "finals"))
    dealt = stream.repartition(partitions, "k").sortWithinPartitions("k", "kind", "at", "gone", F.col("turn").asc_nulls_first(), "role", "tie")
    return dealt.drop("tie").mapInArrow(run, REPAIRED)


class _Report:
    """What a conversation's repaired rows say, one after the other."""

    def __init__(self, conv_id):
        self.conv_id, self.hash, self.some = conv_id, hashlib.sha256(), False
        self.first = self.last = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit = []

    def row(self, edit, turn, role, text, old_role, fault):
        if edit is None:
            return
        self.audit.append(edit)
        if edit != "I":
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            self.blank += fault == "blank"
            self.duplicate += fault == "duplicate"
            self.truncated += fault == "truncated"
            initial = old_role[:1]
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
        if edit != "D":
            self.hash.update((b"\n" if self.some else b"") + f"{role}:".encode())
            self.hash.update(text.encode())
            self.some = True

    def values(self):
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit),
                self.hash.hexdigest())


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``: gaps, faults, illegal neighbours, cost, audit, sha256 of the repaired
    ``role:text`` lines. Reads the partitions as they come, so ``rows`` must be ``repaired``'s own result."""
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        out, now = _Writer(schema), None
        for batch in batches:
            column = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns)))
            for conv_id, *row in zip(*(column[c] for c in ("conv_id", "edit", "turn", "role", "text", "old_role", "fault"))):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.add(now.values(), len(now.audit))
                    now = _Report(conv_id)
                now.row(*row)
                if out.full():
                    yield out.batch()
        if now is not None:
            out.add(now.values())
        yield out.batch()

    return rows.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                                "audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults to mend, by ``crc32(conv_id:turn) % 20`` (nulls: one space): 0 marks a row ``gone``, 1 empties its
    text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user; other rows stay."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(d == 4, F.lit("user")).otherwise(filled("role")).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text")).alias("text"),
        (d == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(d == 3, 2).otherwise(1))).alias("copy")).drop("copy")
