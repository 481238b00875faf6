"""State folds over keyed, ordered events, and the streaming faces of the periodic reports."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ordered_fold(events: DataFrame, key: str, order: Sequence[str], step: Callable, columns: Sequence[str], schema: str, at_end: bool = False) -> DataFrame:
    """A sequential fold over each key's events in a total order, holding one key's state and one batch at a time.

    ``step(state, row)`` gets the state (None at a key's start) and the values of ``columns``,
    and gives the next state and a row of ``schema``; with ``at_end`` only each key's last row
    is kept. Keys are hashed to partitions and sorted there, so no key is gathered in memory.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, last = None, None, None
        for batch in batches:
            rows = []
            for k, *row in zip(batch.column(0).to_pylist(), *(batch.column(i + 1).to_pylist() for i in range(len(columns))), strict=True):
                if now is None or k != now[0]:
                    if at_end and last is not None:
                        rows.append(last)
                    now, state = (k,), None
                state, last = step(state, k, *row)
                if not at_end:
                    rows.append(last)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=types)
        if at_end and last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, last, strict=True))], schema=types)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(schema))
    return events.select(*dict.fromkeys([key, *columns, *order])).repartition(key).sortWithinPartitions(key, *order).select(key, *columns).mapInArrow(run, schema)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _ident(df: DataFrame) -> tuple[list[str], str]:
    """The column that orders events of one time, and its part of a schema; events of one time are alike where there is none."""
    return (["id"], f"id {_type(df, 'id')}, ") if "id" in df.columns else ([], "")


def rate_limited(requests: DataFrame, window_ms: int, most: int) -> DataFrame:
    """``requests(key, id, at_ms)`` with allowed and remaining: a fixed window that starts at a key's first request.

    A window starts anew with the first request after it ended, which only a sequential fold
    can tell. Requests of one time are in the order of their ids.
    """
    def step(state, key, *row):
        t = row[-1]
        start, n = state if state and t < state[0] + window_ms else (t, 0)
        return (start, n + 1), (key, *row, n < most, max(0, most - n - 1))

    ident, kind = _ident(requests)
    return ordered_fold(requests, "key", ["at_ms", *ident], step, [*ident, "at_ms"], f"key {_type(requests, 'key')}, {kind}at_ms bigint, allowed boolean, remaining bigint")


def rate_limited_stream(requests: DataFrame, window_ms: int, most: int) -> DataFrame:
    """The same on a stream: (key, allowed, denied) per key and batch; the state is the window's start and count."""
    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        yes = no = 0
        for t in sorted(int(t) for p in parts for t in p["at_ms"]):
            if start is None or t >= start + window_ms:
                start, n = t, 0
            n += 1
            yes, no = yes + (n <= most), no + (n > most)
        state.update((start, n))
        yield pd.DataFrame({"key": [key[0]], "allowed": [yes], "denied": [no]})

    kind = requests.schema["key"].dataType.simpleString()
    return requests.groupBy("key").applyInPandasWithState(fold, f"key {kind}, allowed long, denied long", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def breaker_states(calls: DataFrame, failures: int, timeout_ms: int, successes: int = 1) -> DataFrame:
    """``calls(key, id, at_ms, ok)`` with the breaker's state at each call: consecutive failures open it, a timeout half-opens it."""
    def step(state, key, *row):
        t, ok = row[-2:]
        now, bad, good, opened = state or ("CLOSED", 0, 0, 0)
        if now == "OPEN" and t >= opened + timeout_ms:
            now, good = "HALF_OPEN", 0
        out = (key, *row, now)
        if now == "OPEN":
            return (now, bad, good, opened), out
        if ok:
            bad, good = 0, good + 1
            if now == "HALF_OPEN" and good >= successes:
                now = "CLOSED"
        else:
            bad += 1
            if now == "HALF_OPEN" or bad >= failures:
                now, opened, bad = "OPEN", t, 0
        return (now, bad, good, opened), out

    ident, kind = _ident(calls)
    return ordered_fold(calls, "key", ["at_ms", *ident], step, [*ident, "at_ms", "ok"], f"key {_type(calls, 'key')}, {kind}at_ms bigint, ok boolean, state string")


def cache_replay(accesses: DataFrame, ttl_ms: int, most: int = 1000, most_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """``accesses(cache, id, at_ms, key)`` replayed through a cache with expiry and least-recent eviction: (cache, hits, misses, evictions).

    With a column ``size`` (bytes of the entry that a miss stores) entries are also evicted
    until fewer than ``most_bytes`` are held, and (entries, bytes, hit_rate) come too; an entry
    that is larger itself is held until the next one comes. A null size is 0. The state holds
    at most ``most`` keys of one cache.
    """
    sized = "size" in accesses.columns

    def step(state, cache, key, t, size=0):
        held, used, hits, misses, evictions = state or (OrderedDict(), 0, 0, 0, 0)
        size = size or 0
        if key in held and t < held[key][0] + ttl_ms:
            hits += 1
            held.move_to_end(key)
        else:
            misses += 1
            used -= held.pop(key, (0, 0))[1]
            while held and (len(held) >= most or (sized and used >= most_bytes)):
                used -= held.popitem(last=False)[1][1]
                evictions += 1
            held[key] = (t, size)
            used += size
        row = (cache, hits, misses, evictions, len(held), used, hits / (hits + misses)) if sized else (cache, hits, misses, evictions)
        return (held, used, hits, misses, evictions), row

    more = ", entries bigint, bytes bigint, hit_rate double" if sized else ""
    return ordered_fold(accesses, "cache", ["at_ms", *_ident(accesses)[0]], step, ["key", "at_ms", *(["size"] if sized else [])], f"cache {_type(accesses, 'cache')}, hits bigint, misses bigint, evictions bigint{more}", at_end=True)


def not_cached(inputs: DataFrame, results: DataFrame, key: str, as_of: str, ttl_hours: int = 24) -> DataFrame:
    """Inputs without a fresh stored result: memoisation as an anti-join on the content hash."""
    fresh = results.filter(F.col("stored_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(ttl_hours)))
    return inputs.join(fresh.select(key), key, "left_anti")


# What the message or code of a failure that may pass holds.
RECOVERABLE = ("ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "rate limit", "timeout", "429", "500", "502", "503", "504", "circuit breaker")


def dead_letters(failures: DataFrame, most: int = 1000, recoverable: tuple[str, ...] = RECOVERABLE) -> DataFrame:
    """The latest failures up to the bound, classified by their message and, if given, ``code``.

    With columns ``attempts`` and ``max_attempts`` a failure whose attempts are used up isn't
    recoverable; one of a single attempt is as its message says.
    """
    given = [F.coalesce(F.col(c), F.lit("")) for c in ("message", "code") if c in failures.columns]
    message = F.lower(F.concat(*given))
    able = F.exists(F.array(*[F.lit(p.lower()) for p in recoverable]), lambda p: message.contains(p))
    if {"attempts", "max_attempts"} <= set(failures.columns):
        able = able & ((F.coalesce("attempts", F.lit(1)) <= 1) | (F.col("attempts") < F.coalesce("max_attempts", F.lit(3))))
    return failures.withColumn("recoverable", able).orderBy(F.desc("created_at"), "id").limit(most)


def not_too_old(letters: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    """Failures that the purge by age leaves: not older than so many hours. Rows without a time stay."""
    return letters.filter(F.coalesce(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)), F.lit(True)))


def letters_of(letters: DataFrame, stage: str | None = None, job: int | None = None, recoverable: bool | None = None) -> DataFrame:
    """Failures of a stage, of a job sheet, or those that may pass; None leaves a test out."""
    for column, wanted in (("stage", stage), ("job_sheet_id", job), ("recoverable", recoverable)):
        if wanted is not None:
            letters = letters.filter(F.col(column) == wanted)
    return letters


def started_once(runs: DataFrame, forced: str = "forced") -> DataFrame:
    """Of each input hash the first run that didn't fail, and every forced one."""
    w = Window.partitionBy("input_hash", F.col(forced) | (F.col("state") == "FAILED")).orderBy("at", "run_id")
    return runs.withColumn("_n", F.row_number().over(w)).filter(F.col(forced) | (F.col("state") == "FAILED") | (F.col("_n") == 1)).drop("_n")


def outcome_windows(audits: DataFrame, late: str = "2 hours", length: str = "1 day") -> DataFrame:
    """Outcome counts per window and engineer on a stream or a table; events later than ``late`` are dropped by the watermark."""
    return (audits.withWatermark("audited_at", late).groupBy(F.window("audited_at", length), "engineer_id")
            .agg(F.count("*").alias("audits"), F.count_if(F.col("outcome") == "VALID").alias("valid")).select(F.col("window.start").alias("start"), "engineer_id", "audits", "valid"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def first_seen(events: DataFrame, key: str, at: str = "ts", late: str = "2 hours") -> DataFrame:
    """Idempotent starts on a stream: a key within the watermark counts once."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A scheduled job: all that is there, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
