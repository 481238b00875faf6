"""The state machine of processing runs: one rule for a table of run events and for a stream of them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .folds import _type, ordered_fold

# States of a run and the states that may follow; the last two end it.
EDGES: Mapping[str, Sequence[str]] = {
    "CREATED": ("OCR_STARTED", "FAILED"), "OCR_STARTED": ("OCR_DONE", "FAILED"), "OCR_DONE": ("EXTRACTION_STARTED", "FAILED"), "EXTRACTION_STARTED": ("EXTRACTED", "FAILED"), "EXTRACTED": ("VALIDATION_STARTED", "FAILED"),
    "VALIDATION_STARTED": ("VALIDATED", "FAILED"), "VALIDATED": ("PERSISTENCE_STARTED", "FAILED"), "PERSISTENCE_STARTED": ("PERSISTED", "FAILED"), "PERSISTED": (), "FAILED": ()}
FIRST = "CREATED"


def judge(state: str, to: str | None, edges: Mapping[str, Sequence[str]] = EDGES) -> str | None:
    """Why a run may not change to a state, or None if it may."""
    if not edges.get(state):
        return f"Cannot transition from terminal state: {state}"
    return None if to in edges[state] else f"Invalid transition: {state} -> {to}"


def _step(known: tuple | None, run, seq: int, to: str | None) -> tuple[tuple, tuple]:
    """The fold over one run: a rejected event leaves the state, one whose number was seen is a repeat."""
    state, last = known or (FIRST, None)
    if last is not None and seq <= last:
        return (state, last), (run, seq, state, to, False, "Repeated event")
    why = judge(state, to)
    return (to if why is None else state, seq), (run, seq, state, to, why is None, why)


def histories(events: DataFrame) -> DataFrame:
    """(run_id, seq, from_state, to_state, accepted, reason): every event of ``events(run_id, seq, state)`` and what became of it.

    Events of a run count in the order of their numbers; a run begins as CREATED. A null state
    is an invalid one; rows without a run or a number are left out.
    """
    known = events.filter("run_id IS NOT NULL AND seq IS NOT NULL").withColumn("seq", F.col("seq").cast("long"))
    schema = f"run_id {_type(events, 'run_id')}, seq bigint, from_state string, to_state string, accepted boolean, reason string"
    return ordered_fold(known, "run_id", ["seq", "state"], _step, ["seq", "state"], schema)


def current_states(history: DataFrame) -> DataFrame:
    """(run_id, state, accepted, rejected, finished) of runs from their histories."""
    g = history.groupBy("run_id").agg(F.max_by("to_state", F.when(F.col("accepted"), F.col("seq"))).alias("_last"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    state = F.when(F.col("accepted") > 0, F.col("_last")).otherwise(FIRST)
    return g.select("run_id", state.alias("state"), "accepted", "rejected", state.isin(*[s for s, following in EDGES.items() if not following]).alias("finished"))


class RunProcessor(StatefulProcessor):
    """Events of a run in any order to its history; see ``transitions``."""

    def __init__(self, first: int, stuck_ms: int, keep_ms: int):
        self.first, self.stuck_ms, self.keep_ms = first, stuck_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "state string, seq bigint, at_ms bigint")
        self.waiting = handle.getListState("waiting", "seq bigint, state string")

    def _known(self) -> tuple[str, int | None, int]:
        return tuple(self.run.get()) if self.run.exists() else (FIRST, None, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, last, at = self._known()
        held = [(r[0], r[1]) for r in self.waiting.get()]
        for r in rows:
            held.append((r.seq, r.state))
            at = max(at, r.at_ms)
        held.sort(key=lambda x: (x[0], x[1] or ""))
        out, left = [], []
        for seq, to in held:
            if seq > (self.first - 1 if last is None else last) + 1:
                left.append((seq, to))
                continue
            (state, last), row = _step((state, last), key[0], seq, to)
            out.append(row)
        self.run.update((state, last, at))
        if left:
            self.waiting.put(left)
        elif self.waiting.exists():
            self.waiting.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + (self.stuck_ms if EDGES[state] else self.keep_ms))
        for run, seq, was, to, accepted, why in out:
            yield Row(run_id=run, seq=seq, from_state=was, to_state=to, accepted=accepted, reason=why)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._known()[0]
        if not EDGES[state]:
            self.run.clear()
            self.waiting.clear()
            return
        n = len(list(self.waiting.get()))
        why = "Stuck" if not n else f"Stuck: {n} events wait for an earlier one"
        yield Row(run_id=key[0], seq=None, from_state=state, to_state=None, accepted=False, reason=why)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, first: int = 0, late: str = "1 day", stuck_ms: int = 3_600_000, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """``histories`` of a stream ``events(run_id, seq, state, at)``: the same rows, each as soon as all earlier events of its run are there.

    Numbers of a run begin at ``first`` and have no gaps; events that come early wait in the
    run's state, those more than ``late`` behind the newest are dropped by the watermark. Once
    the watermark is ``stuck_ms`` past the last event of a run that isn't finished, it gives one
    row with reason ``Stuck`` and no number; the state of a finished one is dropped after
    ``keep_ms``. Needs the RocksDB state store, see ``use_rocksdb``.
    """
    known = events.filter("run_id IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).select(
        "run_id", F.col("seq").cast("long").alias("seq"), "state", "at", F.unix_millis("at").alias("at_ms"))
    schema = f"run_id {_type(events, 'run_id')}, seq bigint, from_state string, to_state string, accepted boolean, reason string"
    return known.groupBy("run_id").transformWithState(RunProcessor(first, stuck_ms, keep_ms), schema, "Append", "EventTime")


def use_rocksdb(spark) -> None:
    """State of streams started from here on is kept in RocksDB, which holds more than memory and keeps timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
