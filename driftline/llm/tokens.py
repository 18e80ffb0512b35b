"""Token ids of whole texts with a public tokenizer, one Arrow batch at a time.

The tokenizer drops white space and never merges across it, so the ids of a text are
the ids of its white-space separated words one after the other. Each batch is split
into words by Arrow, every distinct word is encoded once, and the ids are gathered by
the word's number: the work per repeated word is a copy. Only the six ASCII white-space
characters split here; any other space stays inside a "word" and is handled by the
tokenizer itself. A tokenizer without that property is used text by text
(``per_word=False``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes encoded at once; bounds the memory of a task whatever the batch holds.
CHUNK_BYTES = 4 << 20
#: Distinct words remembered by a worker process; beyond that it starts afresh.
KEPT_WORDS = 400_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def text_chunks(text: pa.Array, chunk_bytes: int = CHUNK_BYTES):
    """Yield ``(first, last)`` row ranges of about ``chunk_bytes`` each; a longer text is a range of its own."""
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + chunk_bytes, side="right"))
        yield at, (to := max(to, at + 1))
        at = to
    pa.default_memory_pool().release_unused()      # a reused worker gives back what the chunks took


def own_text(text: pa.Array) -> pa.Array:
    """The rows with buffers of their own, null as empty: Arrow's ``ascii_lower`` misreads a slice's bytes."""
    return pc.fill_null(text.take(pa.array(np.arange(len(text)))).cast(pa.large_string()), "")


def split_words(text: pa.Array) -> pa.Array:
    """Lists of the pieces between single ASCII white-space characters; a piece may be empty."""
    for c in "\t\n\x0b\x0c\r":
        text = pc.replace_substring(text, c, " ")
    return pc.split_pattern(text, " ")


def gather_spans(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s:s + n]`` for each (s, n)."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Encoder:
    """Ids of whole texts; a null text counts as empty.

    ``per_word=False`` encodes text by text, for tokenizers that keep white space.
    """

    def __init__(self, path: str | None = None, per_word: bool = True):
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.per_word = per_word
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self._ends = None
        if suffix:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self._ends = np.zeros(max(vocab.values()) + 1, bool)
            self._ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self._known = pa.array([], pa.large_string())
        self._ids = np.zeros(0, np.uint32)
        self._lens = np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self._encode(texts)
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((x for g in got for x in g), np.uint32, int(lens.sum())), lens

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only end in exactly one end-of-word token, so they can share a text."""
        letters = pc.match_substring_regex(words, r"^\pL+$").to_numpy(zero_copy_only=False)
        if self._ends is None or not letters.any():
            return self._encode_plain(words.to_pylist())
        mine = words.filter(pa.array(letters)).to_pylist()
        flat, _ = self._encode_plain([" ".join(mine[i:i + 1000]) for i in range(0, len(mine), 1000)])
        ends = np.flatnonzero(self._ends[flat]) + 1
        if len(ends) != len(mine):
            return self._encode_plain(words.to_pylist())
        rest, rest_lens = self._encode_plain(words.filter(pa.array(~letters)).to_pylist())
        lens = np.zeros(len(words), np.int64)
        lens[letters], lens[~letters] = np.diff(ends, prepend=0), rest_lens
        starts = np.zeros(len(words), np.int64)
        starts[letters] = np.concatenate([[0], ends[:-1]])
        starts[~letters] = len(flat) + np.concatenate([[0], np.cumsum(rest_lens)[:-1]]) if len(rest_lens) else 0
        return gather_spans(np.concatenate([flat, rest]), starts, lens), lens

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids uint32, offsets int64)``: document i has ``ids[offsets[i]:offsets[i + 1]]``."""
        text = own_text(text)
        if not self.per_word:
            flat, lens = self._encode_plain(text.to_pylist())
            return flat, np.concatenate([[0], np.cumsum(lens)])
        if not pc.any(pc.match_substring(text, "<|")).as_py():   # else a special token's string could arise or break
            text = pc.replace_substring_regex(pc.ascii_lower(text), r"([a-zß-öø-ÿ])([.,])(\s|$)", r"\1 \2\3")
        words = split_words(text)
        offsets = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        number = coded.indices.to_numpy(zero_copy_only=False)
        first, lens = self._lookup(coded.dictionary)
        word_lens = lens[number]
        ends = np.concatenate([[0], np.cumsum(word_lens)])
        return gather_spans(self._ids, first[number], word_lens), ends[offsets - offsets[0]]

    def _lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids in ``_ids`` of each of the distinct ``words``."""
        if len(self._known) > KEPT_WORDS:
            self._reset()
        at = pc.index_in(words, value_set=self._known)
        fresh = pc.is_null(at)
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (new := words.filter(fresh)) and len(new):
            flat, lens = self._encode_words(new)
            at[at < 0] = len(self._lens) + np.arange(len(new))
            self._known = pa.concat_arrays([self._known, new])
            self._ids = np.concatenate([self._ids, flat])
            self._lens = np.concatenate([self._lens, lens])
        first = np.cumsum(self._lens) - self._lens
        return first[at], self._lens[at]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str | None = None, per_word: bool = True) -> Encoder:
    """This worker process's encoder; reused workers keep the words they know."""
    key = (path, per_word)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, per_word)
    return _ENCODERS[key]
