"""Near-duplicate documents by ProbMinHash over weighted word shingles.

Every shingle of five words is an element with a Poisson process whose rate is its weight,
1 + ln(count); each arrival falls into a random register, which keeps the earliest arrival's
element. Arrivals are generated in rounds, and an element stops once its time is past the
latest register of its document. Two registers agree with the probability Jaccard of the
weighted shingles. A document with repeated shingles has a second set of registers, of weight
1 each, that agree with the Jaccard similarity of the sets; without repeats the two sets are
the same. Bands of registers give candidates; a short sketch of the registers
rejects most false ones, and the texts decide: documents are linked if their shingle sets
have a Jaccard similarity of 0.8 or more, or their weighted shingles a probability Jaccard of
0.8 or more. Without repeated shingles the two are the same number.

Groups of copies and of near copies are never expanded into pairs: copies are one class, and
each member of a band is first compared with the band's smallest, which joins most of what
belongs together. Bands that still hold several components are compared in blocks, all
members against all by sketches, plausible pairs by their whole shingle sets, in the task
where the blocks meet; only links that join two parts leave it. So no link between different
texts is lost, and texts that only share a passage leave no pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .text import saved, slices, words_of

_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words; emptied by its user when it is large, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


def shingles(docs: list[list[bytes]], hashes: WordHashes, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the distinct shingles, in no order.

    A document of fewer words is one shingle; one without words has none.
    """
    if len(hashes) > 200_000:
        hashes.clear()
    size = np.array([len(d) for d in docs], np.int64)
    flat = np.fromiter((hashes[w] for d in docs for w in d), _U, int(size.sum()))
    n = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    starts = np.concatenate([[0], np.cumsum(size)])[:-1]
    doc = np.repeat(np.arange(len(docs)), n)
    at = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + starts[doc]
    h = np.zeros(len(at), _U)
    ends = (starts + size)[doc]
    for k in range(width):
        inside = at + k < ends
        w = np.where(inside, flat[np.minimum(at + k, max(0, len(flat) - 1))] if len(flat) else _U(0), _U(0))
        h = _mix(h * _GOLD + w + _U(1))
    order = np.argsort(h ^ _mix(doc.astype(_U)), kind="stable")
    doc, h = doc[order], h[order]
    if not len(h):
        return doc, h, np.zeros(0)
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(h)))
    return doc[at], h[at], count.astype(float)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The element that each register of each document keeps; 0 for documents without elements."""
    time = np.full(n_docs * registers, np.inf)
    kept = np.zeros(n_docs * registers, _U)
    h, doc, weight, x = h, doc.astype(np.int64), weight, np.zeros(len(h))
    turn = 0
    while len(h):
        turn += 1
        u = _mix(h + _U(turn * int(_GOLD) & 2**64 - 1))
        x = x - np.log1p(-(u >> _U(11)).astype(np.float64) * 2.0**-53) / weight
        cell = doc * registers + (_mix(u ^ _M2) % _U(registers)).astype(np.int64)
        np.minimum.at(time, cell, x)
        won = time[cell] == x
        kept[cell[won]] = h[won]
        going = x < time.reshape(n_docs, registers).max(1)[doc]
        h, doc, weight, x = h[going], doc[going], weight[going], x[going]
    return kept.reshape(n_docs, registers)


def weights(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(Jaccard of the sets, probability Jaccard of the weighted sets) of two (hashes, weights)."""
    keys = np.union1d(a[0], b[0])
    if not len(keys):
        return 0.0, 0.0
    wa, wb = np.zeros(len(keys)), np.zeros(len(keys))
    wa[np.searchsorted(keys, a[0])] = a[1]
    wb[np.searchsorted(keys, b[0])] = b[1]
    both = (wa > 0) & (wb > 0)
    with np.errstate(divide="ignore"):
        ratio = np.where(wb > 0, wa / np.where(wb > 0, wb, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    r = ratio[order]
    above = np.concatenate([np.cumsum(wa[order][::-1])[::-1], [0.0]])
    below = np.concatenate([[0.0], np.cumsum(wb[order])])
    at = np.searchsorted(r, ratio[both], "left")
    total = above[at] / wa[both] + below[at] / wb[both]
    return float(both.sum() / len(keys)), float((1 / total).sum())


def _copy_of(words: list[bytes], text: str | None) -> bytes | None:
    """The class of equal word sequences, or of equal texts without words; none for empty texts."""
    return hashlib.md5(b" ".join(words) if words else b"\0" + text.encode("utf-8", "replace")).digest() if text else None


def sketched(docs: DataFrame, bands: int, rows: int, width: int, key: str, text: str, chunk: int = 1_000_000) -> DataFrame:
    """(id, copy_of, sketch, plain) per row: the class of equal word sequences, a byte per register.

    ``plain`` is the sketch of the shingles without weights, null where no shingle repeats.
    """
    registers = bands * rows

    def run(batches: Iterator[pa.RecordBatch]):
        hashes = WordHashes()
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), chunk):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                words = [words_of(t) for t in texts]
                doc, h, count = shingles(words, hashes, width)
                small = (_mix(signatures(doc, h, weights(count), b - a, registers)) & _U(255)).astype(np.uint8)
                again, which = np.unique(doc[count > 1]), np.full(b - a, -1)
                which[again] = np.arange(len(again))
                of = which[doc] >= 0
                even = (_mix(signatures(which[doc[of]], h[of], np.ones(int(of.sum())), len(again), registers)) & _U(255)).astype(np.uint8)
                copy = [_copy_of(w, t) for w, t in zip(words, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(copy, pa.binary()),
                    pa.array([small[i].tobytes() if w else None for i, w in enumerate(words)], pa.binary()),
                    pa.array([even[k].tobytes() if k >= 0 else None for k in which], pa.binary())], names=["id", "copy_of", "sketch", "plain"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, copy_of binary, sketch binary, plain binary")


def banded(faces: DataFrame, bands: int, rows: int) -> DataFrame:
    """``faces`` with a row per band of its sketch: (..., at, band) for (..., sketch).

    A band is hashed from its bytes of the sketch, not from the registers, so that two
    sketches meet in a band exactly where their bytes in it are equal.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.col("sketch").substr(k * rows + 1, F.lit(rows))))
    return faces.select(*(c for c in faces.columns if c != "sketch"), F.posexplode(hashes).alias("at", "band"))


def shingle_sets(texts: DataFrame, width: int, chunk: int = 1_000_000) -> DataFrame:
    """(id, hashes, counts) of ``texts(id, copy_of, text)``: sorted shingle hashes, and their counts where one repeats.

    Rows whose text is not of the class ``copy_of`` are left out: they only share its id.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        known = WordHashes()
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist(), chunk):
                ids, copies, text = (c.slice(a, b - a).to_pylist() for c in batch.columns)
                words = [words_of(t) for t in text]
                right = [k for k, (w, t) in enumerate(zip(words, text, strict=True)) if _copy_of(w, t) == copies[k]]
                doc, h, count = shingles([words[k] for k in right], known, width)
                order = np.lexsort((h, doc))
                doc, h, count = doc[order], h[order], count[order].astype(np.int32)
                edge = np.searchsorted(doc, np.arange(len(right) + 1)).tolist()
                part = [slice(x, y) for x, y in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[k] for k in right], pa.int64()), pa.array([h[x].tobytes() for x in part], pa.binary()),
                    pa.array([count[x].tobytes() if (count[x] > 1).any() else None for x in part], pa.binary())], names=["id", "hashes", "counts"])

    return texts.select("id", "copy_of", "text").mapInArrow(run, "id long, hashes binary, counts binary")


def _least_equal(least: float, registers: int, miss: float = 3e-6) -> int:
    """The number of equal registers that a pair at ``least`` falls short of with probability ``miss`` or less."""
    tail = 0.0
    for k in range(registers + 1):
        tail += math.comb(registers, k) * least**k * (1 - least) ** (registers - k)
        if tail > miss:
            return k
    return registers


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` as tables of whole groups, with the place where each group begins and the end."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            x = t[k].to_numpy()
            new |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1]).astype(np.int64)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(starts(pa.Table.from_batches([batch]))[-1])
        first = {k: batch[k][0].as_py() for k in keys}
        if held and any(held[-1][k][-1].as_py() != v for k, v in first.items()) and not cut:
            t, held = pa.Table.from_batches(held), [batch]
            yield t, np.append(starts(t), t.num_rows)
            continue
        if cut:
            t, held = pa.Table.from_batches([*held, batch.slice(0, cut)]), [batch.slice(cut)]
            yield t, np.append(starts(t), t.num_rows)
        else:
            held.append(batch)
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.append(starts(t), t.num_rows)


def _partners(edge: np.ndarray, i: np.ndarray, j: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first partner, number of partners) of each row, partners being later rows of its group.

    In a group of one block all rows meet; in one of two blocks, sorted by ``part``, those of
    the first block meet those of the second.
    """
    n = len(part)
    group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    end, row = edge[1:][group], np.arange(n)
    second = edge[:-1] + np.add.reduceat((part == i).astype(np.int64), edge[:-1]) if n else edge[:-1]
    two = i != j
    first = np.where(two, second[group], row + 1)
    return first, np.where(two & (part == j), 0, end - first)


def _runs(count: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` pairs."""
    total, a = np.cumsum(count), 0
    while a < len(count):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + limit, "right")))
        yield a, b
        a = b


def _plausible(t: pa.Table, edge: np.ndarray, bands: int, rows: int, need: int, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (u, v) of different components that first meet in their group's band and whose sketches leave the threshold possible."""
    part, i, j, at = (t[c].to_numpy() for c in ("part", "i", "j", "at"))
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, bands * rows)
    first, count = _partners(edge, i, j, part)
    for a, b in _runs(count, 50_000):
        for c in range(0, int(count[a:b].max(initial=0)), 50_000):  # a row of very many partners, in parts
            n = np.clip(count[a:b] - c, 0, 50_000)
            u = np.repeat(np.arange(a, b), n)
            v = first[u] + c + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
            apart = comp[u] != comp[v]
            u, v = u[apart], v[apart]
            equal = sketch[u] == sketch[v]
            good = np.flatnonzero(np.count_nonzero(equal, axis=1) >= need)
            good = good[equal[good].reshape(-1, bands, rows).all(2).argmax(1) == at[u[good]]]
            yield u[good], v[good]


class _Sets:
    """The shingle sets of a table's rows, to compare one row with many."""

    def __init__(self, t: pa.Table):
        raw = t["hashes"].to_pylist()
        self.h = np.frombuffer(b"".join(raw), _U)
        self.size = np.array([len(r) // 8 for r in raw], np.int64)
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        self.counts = t["counts"].to_pylist()
        self.repeats = np.array([c is not None for c in self.counts])
        self.ids: np.ndarray | None = None

    def dense(self, a: int, b: int) -> None:
        """Numbers for the shingles of the rows from a to b."""
        self.base = self.edge[a]
        kinds, self.ids = np.unique(self.h[self.edge[a] : self.edge[b]], return_inverse=True)
        self.mark = np.zeros(len(kinds), bool)

    def jaccard(self, u: int, v: np.ndarray) -> np.ndarray:
        mine = self.ids[self.edge[u] - self.base : self.edge[u + 1] - self.base]
        self.mark[mine] = True
        n = self.size[v]
        ends = np.cumsum(n)
        flat = np.repeat(self.edge[v] - self.base - (ends - n), n) + np.arange(int(n.sum()))
        hit = np.concatenate([[0], np.cumsum(self.mark[self.ids[flat]])])
        self.mark[mine] = False
        both = hit[ends] - hit[ends - n]
        return both / np.maximum(1, self.size[u] + n - both)

    def weighted(self, u: int, v: int) -> float:
        def one(k: int):
            h = self.h[self.edge[k] : self.edge[k + 1]]
            return h, weights(np.frombuffer(self.counts[k], np.int32).astype(float)) if self.repeats[k] else np.ones(len(h))

        return similarity(one(u), one(v))[1]

    def linked(self, u: int, v: np.ndarray, by_weight: np.ndarray, least: float) -> np.ndarray:
        """Which of ``v`` are linked with ``u``; ``by_weight``: of which the probability Jaccard counts too."""
        out = self.jaccard(u, v) >= least
        for k in np.flatnonzero(~out & by_weight & (self.repeats[v] | self.repeats[u])):
            out[k] = self.weighted(u, int(v[k])) >= least
        return out


def _stars(met: DataFrame, faces: DataFrame, sets: DataFrame, least: float, bands: int, rows: int, block: int) -> DataFrame:
    """Links (src, dst) of each band's smallest member with the others of the band: linear in the members."""
    need = _least_equal(least, bands * rows)
    lead = met.groupBy("band").agg(F.min(F.struct("id", "face")).alias("_l"))
    pairs = met.join(lead, "band").filter("id <> _l.id").select(F.col("_l.id").alias("lead"), F.col("_l.face").alias("_f"), "id", "face").distinct()
    theirs = faces.select(F.col("id").alias("lead"), F.col("face").alias("_f"), F.col("sketch").alias("_s"))

    def near(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch", "_s"))
            keep = pa.array(np.count_nonzero(x == y, axis=1) >= need)
            yield pa.RecordBatch.from_arrays([batch[c].filter(keep) for c in ("lead", "id", "weighted")], names=["lead", "id", "weighted"])

    pairs = (pairs.join(faces, ["id", "face"]).join(theirs, ["lead", "_f"]).select("lead", "id", ((F.col("face") == 0) & (F.col("_f") == 0)).alias("weighted"), "sketch", "_s")
             .mapInArrow(near, "lead long, id long, weighted boolean").groupBy("lead", "id").agg(F.max("weighted").alias("weighted")))
    pairs = saved(pairs)
    blocks = pairs.groupBy("lead").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    pairs = pairs.join(blocks, "lead").withColumn("i", F.pmod(F.xxhash64("id", F.lit("star")), F.col("_n")).cast("int"))
    tasks = pairs.select("lead", "i", "id", "weighted", F.lit(1).alias("part")).unionByName(
        pairs.select("lead", "i").distinct().select("lead", "i", F.col("lead").alias("id"), F.lit(False).alias("weighted"), F.lit(0).alias("part")))

    def verify(batches):
        for t, edge in _whole_groups(batches, ["lead", "i"]):
            ids, by_weight, sets, src, dst = t["id"].to_numpy(), np.asarray(t["weighted"]), _Sets(t), [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                sets.dense(a, b)
                v = np.arange(a + 1, b)
                good = v[sets.linked(a, v, by_weight[v], least)]
                src += [ids[a]] * len(good)
                dst += ids[good].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return (tasks.join(sets, "id").repartition("lead", "i").sortWithinPartitions("lead", "i", "part")
            .select("lead", "i", "id", "weighted", "hashes", "counts").mapInArrow(verify, "src long, dst long"))


def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows(band, id, ...)`` dealt to the pairs of blocks (i, j) of their band, ``part`` being the own block."""
    part = F.pmod(F.xxhash64("id", F.lit("block")), F.col("_n")).cast("int")
    pair = lambda x: F.struct(F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j"))
    return (rows.join(blocks, "band").withColumn("part", part)
            .withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), pair))).select("*", "t.i", "t.j").drop("t", "_n"))


def _block_links(met: DataFrame, faces: DataFrame, sets: DataFrame, least: float, bands: int, rows: int, block: int, block_bytes: int) -> DataFrame:
    """Links (src, dst) between components of ``met(band, at, id, face, component)``: a spanning forest of those of each pair of blocks.

    A pair counts in the first band that it shares. First the sketches tell which members of
    a band have a plausible partner at all; only these bring their shingles, and whole
    shingle sets decide in the task where two blocks meet. No pair leaves a task unless it
    is a link that joins two parts.
    """
    need = _least_equal(least, bands * rows)
    keys = ["band", "i", "j"]
    several = met.groupBy("band").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.ceil(F.count("*") / block).cast("int").alias("_n")).filter("_a < _b").select("band", "_n")
    tasks = _in_blocks(met, several).join(faces, ["id", "face"]).repartition(*keys).sortWithinPartitions(*keys, "part")

    def suspect(batches):
        for t, edge in _whole_groups(batches, keys):
            seen = np.zeros(t.num_rows, bool)
            for u, v in _plausible(t, edge, bands, rows, need, t["component"].to_numpy()):
                seen[u] = seen[v] = True
            kept = t.select(["band", "at", "id", "face", "component"]).filter(pa.array(seen)).combine_chunks()
            yield from kept.to_batches()

    asked = saved(tasks.select(*keys, "part", "at", "id", "face", "component", "sketch")
                  .mapInArrow(suspect, "band long, at int, id long, face int, component long").distinct())
    bytes_ = sets.select("id", (F.length("hashes") + F.coalesce(F.length("counts"), F.lit(0))).alias("_bytes"))
    blocks = asked.join(bytes_, "id").groupBy("band").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("_bytes") / block_bytes)).cast("int").alias("_n"))

    def verify(batches):
        for t, edge in _whole_groups(batches, keys):
            ids, comp, face, sets, src, dst = t["id"].to_numpy(), t["component"].to_numpy().copy(), t["face"].to_numpy(), _Sets(t), [], []
            group, now = np.repeat(np.arange(len(edge) - 1), np.diff(edge)), -1
            for us, vs in _plausible(t, edge, bands, rows, need, comp):
                for a, b in _slices_of(us):
                    u, g = int(us[a]), int(group[us[a]])
                    v = vs[a:b]
                    v = v[comp[v] != comp[u]]
                    if not len(v):
                        continue
                    if g != now:
                        now = g
                        sets.dense(int(edge[g]), int(edge[g + 1]))
                    v = v[sets.linked(u, v, (face[v] == 0) & (face[u] == 0), least)]
                    if len(v):
                        labels, at = np.unique(comp[v], return_index=True)
                        src += [ids[u]] * len(at)
                        dst += ids[v[at]].tolist()
                        own = comp[edge[g] : edge[g + 1]]
                        own[np.isin(own, labels)] = comp[u]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return (_in_blocks(asked, blocks).join(faces, ["id", "face"]).join(sets, "id").repartition(*keys).sortWithinPartitions(*keys, "part")
            .select(*keys, "part", "at", "id", "face", "component", "sketch", "hashes", "counts").mapInArrow(verify, "src long, dst long"))


def _slices_of(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    """The ranges of equal values."""
    if len(sorted_values):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(sorted_values)) + 1, [len(sorted_values)]]).tolist()
        yield from zip(cut[:-1], cut[1:], strict=True)


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 32, rows: int = 5, width: int = 5, key: str = "doc_id", text: str = "text",
                    block: int = 2048, block_bytes: int = 16_000_000) -> DataFrame:
    """(``key``, class_id, class_size, kept) per row: near-duplicate classes over whole texts.

    Texts are compared by their words (A-Z lower-cased). class_id is the smallest id of the
    class and kept marks it; class_size counts its rows. Texts of equal words are copies; so
    are equal texts without words. Null and empty texts are classes of their own, as are rows
    without an id (class_id null, kept). Rows that share an id share a class, whatever their
    texts; each of these is compared.

    Two texts at the threshold, by sets or by weights, meet in a band with probability
    1 - (1 - 0.8^5)^32, or all but three in a million; the comparison of their sketches rules
    out three in a million more. ``block`` members or ``block_bytes`` of shingles of a band
    are compared with as many others in one task.
    """
    seen = saved(sketched(docs, bands, rows, width, key, text))
    classes = saved(
        seen.filter("copy_of IS NOT NULL AND id IS NOT NULL").groupBy("copy_of")
        .agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.any_value("sketch").alias("sketch"), F.any_value("plain").alias("plain"))
        .withColumn("id", F.monotonically_increasing_id()))
    faces = classes.filter("sketch IS NOT NULL").select("id", F.posexplode(F.array_compact(F.array("sketch", "plain"))).alias("face", "sketch"))
    spread = banded(faces, bands, rows)
    shared = spread.groupBy("band").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).filter("_a < _b").select("band")
    met = saved(spread.join(shared, "band").select("band", "at", "id", "face"))
    members = met.select("id").distinct()
    wanted = classes.join(members, "id", "left_semi").select("id", "copy_of", F.col("least").alias("_key"))
    texts = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("text")).join(wanted, "_key").dropDuplicates(["_key", "id", "text"])
    sets = saved(shingle_sets(texts, width))
    # rows that share an id join the classes of their texts
    named = seen.select("id", F.when(F.col("id").isNotNull(), F.col("copy_of")).alias("copy_of")).join(classes.select("copy_of", F.col("id").alias("_class")), "copy_of", "left")
    twice = named.groupBy("id").agg(F.min("_class").alias("src"), F.max("_class").alias("_b")).filter("src < _b").select("id", "src")
    same = named.join(twice, "id").select("src", F.col("_class").alias("dst"))
    links = saved(_stars(met, faces, sets, least, bands, rows, block // 8).unionByName(same))
    part = connected_components(links).withColumnRenamed("node", "id")
    now = met.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = saved(_block_links(saved(now), faces, sets, least, bands, rows, block, block_bytes))
    if not more.isEmpty():
        part = connected_components(part.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(more)).withColumnRenamed("node", "id")
    by_class = classes.select("id", "least", "copies").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = by_class.groupBy("component").agg(F.sum("copies").alias("class_size"), F.min("least").alias("class_id"))
    out = named.join(by_class.join(sizes, "component").select(F.col("id").alias("_class"), "class_id", "class_size"), "_class", "left")
    cls = F.coalesce("class_id", "id")
    return out.select(F.col("id").alias(key), cls.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.col("id").eqNullSafe(cls).alias("kept"))
