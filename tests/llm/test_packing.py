import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheetlens.llm import packing

ENCODER = packing.ChunkEncoder("word_bpe_49k.json")
TEXTS = ["Hello, world's end! it'll DON'T", None, "", "  a\x1cb  c d\u0085e ", "word " * 5000, "x<|endoftext|>y 123", "é é ́x İI ß", "\n\n", "a,b;c... d-e 'tis rock'n'roll! x=́y z.̸ ªº µm² ½ „quote” <a>b", "İSTANBUL ΣΑΣ ǅ"]


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_equal_the_tokenizer(spark):
    rows = [(i % 7 if i % 5 else None, random.Random(i).choice(TEXTS)) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc, text in rows:
        ids = ids_of(tok, text)
        want += [(str(doc), k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("most", [1, 4, 4096])
def test_bounded_best_fit(most):
    rng = random.Random(most)
    bins, fill = packing.OpenBins(100, most), defaultdict(int)
    sizes = [rng.randint(1, 60) for _ in range(3000)]
    for n in sizes:
        b, offset = bins.place(n)
        assert offset == fill[b]
        fill[b] += n
        assert bins.n <= most and bins.n == sum(map(len, bins.bins.values()))
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(sizes)
    if most > 100:
        assert len(fill) <= 1.02 * sum(sizes) / 100 + 1


def test_best_fit_takes_the_tightest_bin():
    bins = packing.OpenBins(10, 8)
    assert [bins.place(n) for n in (6, 7, 3, 4, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]


def test_cache_limit_and_empty_table(spark):
    e = packing.ChunkEncoder("word_bpe_49k.json", cache=3)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["one two three four five", "six two", "one six seven eight nine", "one"] * 2:
        assert list(np.frombuffer(e.encode([text])[0], "<u4")) == whole.encode(text, add_special_tokens=False).ids
    for ids, text in zip(e.encode(TEXTS), TEXTS, strict=True):
        assert list(np.frombuffer(ids, "<u4")) == ids_of(whole, text)[:-1]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aBé ß'.,!<=>|\u0301\u0338\u00a0\u20283²İΣ\x1c\n中-")) | st.characters(codec="utf-8"), max_size=30))
def test_any_text_equals_the_library(text):
    assert list(np.frombuffer(ENCODER.encode([text])[0], "<u4")) == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids
