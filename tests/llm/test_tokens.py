import os
import zlib

import numpy as np
import pyarrow as pa

from driftline.llm import packing, token_files
from driftline.llm.tokens import Encoder, tokenizer_path
from tests.llm.frames import no_docs, odd_docs, odd_rows, texts

ODD = ["a b  c d", "", "É, É, é. 가 x", "İ. ǆ, ß.", "it's 12'34 's\x1cq\x85w ", "'s 't'", "thon., a, b. c.", "a,\x0bb.\x0cc.\x1dd", "é ́x"]


def ids(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_words_encode_like_whole_texts():
    for special in ("x", "<|endoftext|> y<|startoftext|>", "<|ENDOFTEXT|>"):
        for per_word in (True, False):
            flat, at = Encoder(per_word=per_word).encode(pa.array([special, *ODD, None]))
            for i, t in enumerate([special, *ODD, ""]):
                assert list(flat[at[i]:at[i + 1]]) == ids(t), t


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_files_round_trip(spark):
    folder = token_files.write_tokens(odd_docs(spark), partitions=3)
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted(texts(odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0)):
        x = ids(t) + [1]
        want.append((i, start, len(x), crc(x)))
        start += len(x)
    assert [tuple(r)[:4] for r in got] == want
    parts = token_files.manifest(spark, folder).orderBy("part").collect()
    first = token_files.Part(parts[0]["path"], parts[0]["width"])
    assert list(first[0]) == ids(texts(odd_rows())[-1][1]) + [1]             # the null id sorts first
    assert os.path.getsize(first.path + ".bin") == 2 * parts[0]["n_tokens"]


def test_token_files_of_an_empty_table(spark):
    folder = token_files.write_tokens(no_docs(spark), partitions=2)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_packing_pieces_and_sequences(spark):
    packed = packing.pack(odd_docs(spark), capacity=64, with_ids=True)
    rows = packed.collect()
    want = []
    for i, t in texts(odd_rows()):
        x = ids(t) + [1]
        want += [(i, k, s, len(x[s:s + 64]), crc(x[s:s + 64])) for k, s in enumerate(range(0, len(x), 64))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * -(-sum(r["length"] for r in rows) // 64) + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert all(len(whole[s]) == sum(n for _, n in b) for s, b in bins.items())
    assert packing.pack(no_docs(spark)).count() == 0


def test_evolution_beats_or_meets_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(3):
        lengths = rng.integers(200, 700, 300)
        every, none = np.ones(300, bool), np.zeros(300, np.int32)
        plain = packing.refit(lengths, none, every, 1000)
        best = packing.evolve(lengths, [], 1000, 1, 30)[0]
        assert np.bincount(best, lengths).max() <= 1000
        assert packing.fitness(lengths, best, 1000) <= packing.fitness(lengths, plain, 1000)


def test_levels_share_loose_bins(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(100, 900, 9000)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item long, length long")
    got = packing.pack_items(items, 1000).collect()
    assert sorted(r["item"] for r in got) == list(range(9000))
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + int(lengths[r["item"]])
    assert max(fill.values()) <= 1000 and len(fill) <= 1.03 * lengths.sum() / 1000
