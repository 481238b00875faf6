"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z, keeps a-z, digits and every byte of a non-ASCII character, and turns
#: the rest into a blank; so ``split`` yields the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased; none for null."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def holdout(doc_id: str | Column = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """True where crc32 of the id's text leaves that remainder; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == part, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Makes Spark remove the shuffle files of a query when it has ended, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the session's spark.checkpoint.dir.

    The shuffle files that it was made from go once it is written. Where the folder is unset,
    a local session, which is one machine, gets a temporary one; on a cluster, where executors
    would not share such a folder, it is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    conf = df.sparkSession.conf
    before = conf.get(_TIDY, None)
    conf.set(_TIDY, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own: ``df`` may be read again
    finally:
        conf.unset(_TIDY) if before is None else conf.set(_TIDY, before)


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to ``limit`` or less; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def in_parts(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``limit`` bytes of that column, so that a worker holds no more texts than that as objects."""
    for batch in batches:
        for a, b in slices(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), limit):
            yield batch.slice(a, b - a)
