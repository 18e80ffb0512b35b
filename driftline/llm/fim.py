"""Fill-in-middle rearrangement by a piece table.

A document is a list of descriptors ``(buffer, start, length)`` over two buffers that never
change: the texts of its batch and the sentinels. Cutting splits the descriptor that holds the
place in two, an arrangement permutes the pieces and sets sentinel descriptors before them, and
the inverse permutation restores the document. No step copies text: hashes take the bytes that the
descriptors name one after the other, and a text is put together once, when it is written out.

A document's units are its lines (``[^\\n]*\\n|[^\\n]+``); ``n`` counts them. ``h1`` to ``h4`` are the
first 8-digit groups of the sha256 of ``seed:id``, as unsigned integers. The prefix ends after
the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the middle after the larger, the suffix is
the rest. ``h3 % 100 >= rate`` leaves a document plain, as do an empty text and a text that contains
a sentinel; else ``h4 % 100 < spm`` gives suffix-prefix-middle order, and the rest prefix-suffix-middle.

A null text is empty, so plain with n 0; a null id counts as empty in the hash. Rows that are
equal have equal results; the rows of a document are independent, so there is no shuffle, and a task
holds one batch of texts, whatever their length. An empty table gives an empty one. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TEXT, SENTINEL = 0, 1
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
#: Places of the pieces in the output of a form.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
DEFAULT_SENTINELS = ("<P>", "<M>", "<S>")

Piece = tuple[int, int, int]


class PieceTable:
    """Descriptors over a text buffer and a sentinel buffer."""

    def __init__(self, text: memoryview, sentinels: memoryview, pieces: Iterable[Piece]):
        self.buffers = (text, sentinels)
        self.pieces = list(pieces)

    def cut(self, at: Sequence[int]) -> "PieceTable":
        """The table with the (single) text descriptor split at the ascending byte places ``at``."""
        (buffer, start, length), = self.pieces
        ends = [*at, length]
        return PieceTable(*self.buffers, [(buffer, start + a, b - a) for a, b in zip([0, *at], ends)])

    def arranged(self, order: Sequence[int], sentinels: Sequence[Piece]) -> "PieceTable":
        """The pieces in ``order``, each behind its sentinel."""
        return PieceTable(*self.buffers, [d for i in order for d in (sentinels[i], self.pieces[i])])

    def restored(self, order: Sequence[int]) -> "PieceTable":
        """The inverse of ``arranged``: sentinels dropped and the pieces in their first places."""
        pieces = [d for d in self.pieces if d[0] == TEXT]
        back = sorted(range(len(order)), key=order.__getitem__)
        return PieceTable(*self.buffers, [pieces[i] for i in back])

    def views(self):
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for view in self.views():
            h.update(view)
        return h.hexdigest()


def code_points(view: memoryview) -> int:
    """UTF-8 bytes that do not continue a character."""
    return int(np.count_nonzero(np.frombuffer(view, np.uint8) & 0xC0 != 0x80)) if len(view) else 0


def unit_ends(view: memoryview) -> np.ndarray:
    """Byte places behind the lines of a text."""
    if not len(view):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(np.frombuffer(view, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(view) else np.append(ends, len(view))


class Sentinels:
    """The sentinel texts as one buffer, and their descriptors."""

    def __init__(self, names: Sequence[str]):
        parts = [s.encode() for s in names]
        if len(parts) != 3 or len(set(parts)) < 3 or not all(parts):
            raise ValueError("three different sentinels are needed: prefix, middle, suffix")
        if any(a[i:] == b[:len(a) - i] for a in parts for b in parts for i in range(1, len(a))) or any(
                a in b for a in parts for b in parts if a != b):
            raise ValueError("sentinels must not contain or overlap one another: an output would have two readings")
        self.parts = parts
        self.buffer = memoryview(b"".join(parts))
        starts = np.cumsum([0, *map(len, parts)])
        self.pieces = [(SENTINEL, int(a), len(p)) for a, p in zip(starts, parts)]


def draws(doc_id, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i:8 * i + 8], 16) for i in range(4)]


def arrange(doc_id, view: memoryview, s: Sentinels, seed: int, rate: int, spm: int):
    """``(n, form, the document cut in three or None, its output)`` as piece tables over the text ``view``."""
    ends = unit_ends(view)
    n, whole = len(ends), PieceTable(view, s.buffer, [(TEXT, 0, len(view))])
    h1, h2, h3, h4 = draws(doc_id, seed)
    if n == 0 or h3 % 100 >= rate:
        return n, "plain", None, whole
    raw = bytes(view)
    if any(p in raw for p in s.parts):
        return n, "plain", None, whole
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut = whole.cut([int(ends[i - 1]) if i else 0 for i in (a, b)])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, cut, cut.arranged(ORDER[form], s.pieces)


def read_back(view: memoryview, form: str, s: Sentinels) -> PieceTable:
    """The document of an output of a form: its descriptors found at the sentinels, then put back."""
    if form == "plain":
        return PieceTable(view, s.buffer, [(TEXT, 0, len(view))])
    raw, pieces, order = bytes(view), [], ORDER[form]
    at = 0
    for k, i in enumerate(order):
        if raw[at:at + len(s.parts[i])] != s.parts[i]:
            raise ValueError(f"no {s.parts[i].decode()} at byte {at} of an output of form {form}")
        pieces.append(s.pieces[i])
        at += len(s.parts[i])
        end = raw.index(s.parts[order[k + 1]], at) if k < 2 else len(raw)
        pieces.append((TEXT, at, end - at))
        at = end
    return PieceTable(view, s.buffer, pieces).restored(order)


def _texts(column: pa.Array):
    """Views of the UTF-8 bytes of a string column, null as empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [data[a:b] if ok else data[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]


def _strings(tables: Sequence[PieceTable]) -> pa.Array:
    """The texts that the piece tables describe, each byte copied once."""
    views = [list(t.views()) for t in tables]
    offsets = np.cumsum([0, *(sum(map(len, v)) for v in views)]).astype(np.int64)
    data = b"".join(x for v in views for x in v)
    return pa.LargeStringArray.from_buffers(len(tables), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


REARRANGED = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, "
              "pieces array<struct<buffer: string, start: long, length: long>>")
RESTORED = REARRANGED + ", restored string, restored_sha256 string"


def rearranged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 7, rate: int = 100,
               spm: int = 50, sentinels: Sequence[str] = DEFAULT_SENTINELS) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars and middle_chars (code points; null if plain),
    output (the text), its sha256 and its pieces (bytes of the document or of the sentinels, in output order)."""
    Sentinels(sentinels)
    names = ["text", "sentinel"]

    def run(batches):
        s = Sentinels(sentinels)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [arrange(i, v, s, seed, rate, spm) for i, v in zip(ids, _texts(batch.column(1)))]
            chars = [[code_points(v) for v in cut.views()] if cut else (None, None) for _, _, cut, _ in rows]
            out = [t for *_, t in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, *_ in rows], pa.int64()), pa.array([f for _, f, *_ in rows], pa.string()),
                pa.array([c[0] for c in chars], pa.int64()), pa.array([c[1] for c in chars], pa.int64()), _strings(out),
                pa.array([t.sha256() for t in out], pa.string()),
                pa.array([[{"buffer": names[b], "start": a, "length": k} for b, a, k in t.pieces] for t in out],
                         pa.list_(pa.struct([("buffer", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "pieces"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, REARRANGED)


def restored(outputs: DataFrame, sentinels: Sequence[str] = DEFAULT_SENTINELS) -> DataFrame:
    """The rows of ``rearranged`` with the documents rebuilt from output and form alone: restored, restored_sha256."""
    def run(batches):
        s = Sentinels(sentinels)
        for batch in batches:
            forms = batch.column(batch.schema.get_field_index("form")).to_pylist()
            views = _texts(batch.column(batch.schema.get_field_index("output")))
            back = [read_back(v, f, s) for v, f in zip(views, forms)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _strings(back), pa.array([t.sha256() for t in back], pa.string())],
                names=[*batch.schema.names, "restored", "restored_sha256"])

    return outputs.mapInArrow(run, RESTORED)
