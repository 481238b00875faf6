"""Best-fit packing of tokenised documents into sequences of bounded length.

Each task tokenises its documents and packs their pieces by bounded-space online best fit: a
fixed number of open bins is kept in a bitset keyed by free space, so the tightest bin that
takes a piece is one shift and one lowest-set-bit away; when all bins are in use the fullest
closes first. Nothing is shuffled and each task holds ``open_bins`` bins and one batch.
Pieces of a batch are placed longest first, which is a bounded look-ahead. A piece that fits
nowhere always opens a bin, so the bound never drops a row.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

#: Characters that Python's split takes for blanks and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: ASCII punctuation (no apostrophe) between a letter and a letter, blank or end: words end at both its ends.
_PUNCTUATION = re.compile(r"(?<=[a-zß-öø-ÿ])([!-&(-/:-@\[-`{-~]+)(?=[\sa-zß-öø-ÿ]|$)")
_ID = np.dtype("<u4")


class ChunkEncoder:
    """Token ids of whole texts by way of a cache of their chunks.

    The tokenizer lower-cases, and cuts at blanks and between letters and punctuation; so a
    text's ids are those of such chunks one after the other. The cache is emptied when it is
    full, which costs time only; ``at_once`` chunks go to the library in a call, whose results
    are far larger than their ids. Texts with characters for which the library's notion of a
    blank may differ from Python's are encoded whole.
    """

    def __init__(self, vocabulary: str, cache: int = 400_000, at_once: int = 4096):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer, self.cache, self.limit, self.at_once = Tokenizer.from_file(vocabulary), {}, cache, at_once
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, _ID).tobytes()

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """The same for runs of letters, all in one call: each ends at the first id that ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, _ID)
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(stops) != len(words):  # a vocabulary without word ends
            yield from self._ids(words)
            return
        raw, at = ids.tobytes(), 0
        for stop in stops:
            yield raw[4 * at : 4 * stop]
            at = stop

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        chunks: list[list[str] | None] = []
        for t in texts:
            t = t or ""
            try:
                t.encode("latin-1")
                if not any(x in t for x in self.special):
                    t = _PUNCTUATION.sub(r" \1 ", t.lower())
            except UnicodeEncodeError:
                pass
            chunks.append(None if _ODD_SPACE.search(t) else t.split())
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        missing = {w for c in chunks if c for w in c if w not in cache}
        for words, ids in (([w for w in missing if w.isalpha()], self._words), ([w for w in missing if not w.isalpha()], self._ids)):
            for k in range(0, len(words), self.at_once):
                some = words[k : k + self.at_once]
                cache.update(zip(some, ids(some), strict=True))
        return [next(self._ids([t])) if c is None else b"".join(map(cache.__getitem__, c)) for t, c in zip(texts, chunks, strict=True)]


class OpenBins:
    """The open bins: a bitset of the free spaces in use, and the bins of each."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.bits, self.n = capacity, most, 0, 0
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.ids = itertools.count()

    def _put(self, free: int, bin_id: int) -> None:
        if free:
            self.bins[free].append(bin_id)
            self.bits |= 1 << free
            self.n += 1

    def _take(self, free: int) -> int:
        bin_id = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.n -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece: in the tightest open bin that takes it, else in a new one."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.n >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_id = self.capacity, next(self.ids)
        self._put(free - length, bin_id)
        return bin_id, self.capacity - free


def pieces_of(n: int, capacity: int) -> Iterable[tuple[int, int]]:
    return ((s, min(capacity, n - s)) for s in range(0, n, capacity))


PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", separator: int = 0,
         open_bins: int = 4096, batch_chars: int = 2_000_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: ``key`` and the columns of ``PIECE_SCHEMA``.

    A document is its token ids and then ``separator``; null and empty texts are the
    separator alone. Only documents longer than ``capacity`` are cut. sequence_id is unique
    over all tasks; offsets within a sequence have no gaps. Null and repeated keys are rows
    like any others.
    """
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    schema = f"{rows.select(key).schema.simpleString()[7:-1].replace(':', ' ', 1)}, {PIECE_SCHEMA}"
    end = int(separator).to_bytes(4, "little")

    def run(batches):
        encoder, bins = ChunkEncoder(vocabulary), OpenBins(capacity, open_bins)
        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = batch.column(0)
            for a, b in slices(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist(), batch_chars):
                row, piece, start, size, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(batch.column(1).slice(a, b - a).to_pylist()), a):
                    ids += end
                    for k, (s, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        size.append(n)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
                place = [(0, 0)] * len(row)
                for j in sorted(range(len(row)), key=lambda j: -size[j]):
                    place[j] = bins.place(size[j])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc, [first + p[0] for p in place], [p[1] for p in place]))],
                    names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    return rows.mapInArrow(run, schema)
