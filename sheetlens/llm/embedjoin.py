"""Embedding near-dedup: an exact metric range join.

Copies of a vector are one class. Pivots, a sample of the classes, partition the unit
vectors into cells by the nearest pivot. A vector is also sent to every other cell that may
hold a vector within the radius: the triangle inequality rules out a cell whose pivot is
more than twice the radius farther than the own one, and, as the space is Euclidean, so
does a distance to the bisecting plane above the radius. Cells join independently: each
home vector meets all vectors of its cell, so its links are complete there. Cells are
worked off in pairs of blocks of bounded size; a block pair returns counts of links and a
spanning forest of them, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .text import saved

_SLACK = 1e-9  # cells err on the side of sending


def _packed(batches: Iterator[pa.RecordBatch], double: bool) -> Iterator[pa.RecordBatch]:
    """Valid vectors as bytes; null for null or zero vectors and such with null or non-finite components."""
    kind = np.float64 if double else np.float32
    for batch in batches:
        col, out = batch.column(1), []
        offsets, flat = col.offsets.to_numpy(), np.asarray(col.values.to_numpy(zero_copy_only=False), kind)
        ok = np.isfinite(flat)
        if col.values.null_count:
            ok &= ~np.asarray(col.values.is_null())
        valid = np.asarray(col.is_valid())
        for i in range(len(col)):
            a, b = offsets[i], offsets[i + 1]
            out.append(flat[a:b].tobytes() if valid[i] and b > a and ok[a:b].all() and flat[a:b].any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "raw"])


def _as_unit(raw: list[bytes], double: bool) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64 if double else np.float32).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells_of(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, mask of the cells that each vector is sent to, home included)."""
    square = np.maximum(0, 2 - 2 * (unit @ pivots.T))
    home = square.argmin(1)
    own = square[np.arange(len(unit)), home]
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))[home]
    far = np.sqrt(square) - np.sqrt(own)[:, None] > 2 * radius + _SLACK
    plane = (square - own[:, None]) > 2 * apart * (radius + _SLACK)
    mask = ~(far | plane)
    mask[np.arange(len(unit)), home] = True
    return home, mask


def linked(home: np.ndarray, other: np.ndarray, least: float, strip: int = 1024) -> np.ndarray:
    out = np.empty((len(home), len(other)), bool)
    for s in range(0, len(home), strip):
        np.greater_equal(home[s : s + strip] @ other.T, least, out=out[s : s + strip])
    return out


def _weighted(links: np.ndarray, copies: np.ndarray, strip: int = 256) -> np.ndarray:
    """The copies that each row links with, summed in strips, as the sum of booleans would widen the whole matrix."""
    return np.concatenate([links[s : s + strip] @ copies for s in range(0, len(links), strip)])


def forest(links: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what ``links`` joins, one for each member of a component but its first."""
    out, free_row, free_col = [], links.any(1), links.any(0)
    for r in range(len(rows)):
        if not free_row[r]:
            continue
        root, front = int(rows[r]), np.array([r])
        free_row[r] = False
        while len(front):
            new_cols = np.flatnonzero(links[front].any(0) & free_col)
            free_col[new_cols] = False
            front = np.flatnonzero(links[:, new_cols].any(1) & free_row)
            free_row[front] = False
            out += [(root, int(x)) for x in cols[new_cols] if x != root]
            out += [(root, int(x)) for x in rows[front] if x != root]
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.95, block: int = 8192, per_cell: int = 8192, most_pivots: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors(vec_id, embedding)``.

    Links are the pairs of rows with cosine >= ``least`` in double precision. Vectors that are
    null, empty, zero or hold null or non-finite components, rows without an id, and vectors
    of different lengths link with nothing; their component is their own id. Rows that share
    an id are one node. The number of pivots is that of the classes over ``per_cell``, at
    most ``most_pivots``: this bounds what the driver holds, and never the result.
    """
    session = vectors.sparkSession
    double = vectors.schema["embedding"].dataType.elementType.typeName() != "float"
    radius = math.sqrt(2 - 2 * least)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'double' if double else 'float'}>").alias("embedding"))
    rows = saved(base.mapInArrow(lambda b: _packed(b, double), "vec_id long, raw binary").withColumn("_key", F.md5("raw")))
    classes = saved(
        rows.filter("raw IS NOT NULL AND vec_id IS NOT NULL").groupBy("_key")
        .agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.any_value("raw").alias("raw")))
    n = classes.count()
    # the sample of pivots: the first by a hash of the vector, a bounded number
    chosen = [bytes(r.raw) for r in classes.orderBy(F.xxhash64("_key"), "_key").limit(min(most_pivots, max(1, math.ceil(n / per_cell)))).select("raw").collect()]
    width = 8 if double else 4
    pivots = {d: _as_unit([r for r in chosen if len(r) == d * width], double) for d in {len(r) // width for r in chosen}}

    def send(batches):
        for batch in batches:
            ids, copies, raw = (c.to_pylist() for c in batch.columns)
            out = [[], [], [], [], []]
            for d in sorted({len(r) for r in raw}):
                at = [i for i, r in enumerate(raw) if len(r) == d]
                p = pivots.get(d // width)
                if p is None:
                    home, mask = np.zeros(len(at), int), np.ones((len(at), 1), bool)
                else:
                    home, mask = cells_of(_as_unit([raw[i] for i in at], double), p, radius)
                for k, c in zip(*np.nonzero(mask), strict=True):
                    i = at[k]
                    for col, v in zip(out, (f"{d}:{c}", bool(home[k] == c), ids[i], copies[i], raw[i]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["cell", "home", "vec_id", "copies", "raw"])

    sent = saved(classes.select("vec_id", "copies", "raw").mapInArrow(send, "cell string, home boolean, vec_id long, copies long, raw binary"))
    sizes = sent.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("long")) / block).alias("_nh"), F.ceil(F.count("*") / block).alias("_no"))
    spread = sent.join(F.broadcast(sizes), "cell")  # a row for each cell, bounded by the pivots and lengths
    h = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.greatest("_nh", F.lit(1)))
    o = F.pmod(F.xxhash64("vec_id", F.lit("other")), F.greatest("_no", F.lit(1)))
    tasks = spread.filter("_nh > 0").select(
        "cell", F.explode(F.sequence(F.lit(0), (F.col("_nh") - 1).cast("int"))).alias("i"), o.cast("int").alias("j"), F.lit(False).alias("home"), "vec_id", "copies", "raw",
    ).unionByName(spread.filter("home").select(
        "cell", h.cast("int").alias("i"), F.explode(F.sequence(F.lit(0), (F.col("_no") - 1).cast("int"))).alias("j"), F.lit(True).alias("home"), "vec_id", "copies", "raw"))

    def join(table: pa.Table) -> pa.Table:
        own = np.asarray(table["home"])
        ids, copies = table["vec_id"].to_numpy(), table["copies"].to_numpy()
        src, dst, count = [], [], []
        if own.any() and not own.all():
            unit = _as_unit(table["raw"].to_pylist(), double)
            links = linked(unit[own], unit[~own], least)
            n_links = _weighted(links, copies[~own])
            some = np.flatnonzero(n_links)
            src, dst, count = ids[own][some].tolist(), [None] * len(some), n_links[some].tolist()
            for a, b in forest(links, ids[own], ids[~own]):
                src.append(a)
                dst.append(b)
                count.append(None)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "n": pa.array(count, pa.int64())})

    found = saved(tasks.groupBy("cell", "i", "j").applyInArrow(join, "src long, dst long, n long"))
    links = found.filter("dst IS NULL").groupBy(F.col("src").alias("_rep")).agg((F.sum("n") - 1).alias("_n"))
    parts = connected_components(found.filter("dst IS NOT NULL").select("src", "dst"))
    by_class = (
        classes.select("_key", F.col("vec_id").alias("_rep")).join(links, "_rep", "left")
        .join(parts.withColumnRenamed("node", "_rep"), "_rep", "left")
        .select("_key", F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("component", "_rep").alias("_c")))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("_key")).alias("_key")).join(by_class, "_key", "left")
    component = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
