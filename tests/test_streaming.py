"""Streams against their batch counterparts: run states, stored tables, counters and deliveries."""

import hashlib
import hmac
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import relational as R
from sheetlens.streaming import counters as K
from sheetlens.streaming import runs, webhooks
from sheetlens.streaming.snapshots import SnapshotTable, latest_changes, merge_stream

RUN = "run_id long, seq long, state string"


def brute(events):
    out = []
    for run in sorted({e[0] for e in events if e[0] is not None}):
        state, last = "CREATED", None
        for seq, to in sorted(((s, t) for r, s, t in events if r == run and s is not None), key=lambda x: (x[0], x[1] or "")):
            if last is not None and seq <= last:
                out.append((run, seq, state, to, False, "Repeated event"))
                continue
            last = seq
            following = runs.EDGES[state]
            why = f"Cannot transition from terminal state: {state}" if not following else None if to in following else f"Invalid transition: {state} -> {to}"
            out.append((run, seq, state, to, why is None, why))
            state = to if why is None else state
    return sorted(map(str, out))


def run_events(seed=1, n=40):
    rng, states = random.Random(seed), list(runs.EDGES)
    return [(r, s, states[min(s + 1, 8)] if rng.random() < 0.8 else rng.choice(states)) for r in range(n) for s in range(rng.randrange(1, 10))]


def test_histories_equal_brute_force(spark):
    events = [*run_events(), (100, 0, None), (100, 1, "OCR_STARTED"), (100, 1, "OCR_STARTED"), (None, 0, "FAILED"), (101, None, "FAILED")]
    got = runs.histories(spark.createDataFrame(events, RUN).repartition(3))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(events)
    ends = {r.run_id: r for r in runs.current_states(got).collect()}
    assert ends[100].state == "OCR_STARTED" and ends[100].accepted == 1 and ends[100].rejected == 2 and not ends[100].finished
    assert runs.histories(spark.createDataFrame([], RUN)).count() == 0


TIMED = f"{RUN}, at timestamp"


def play(spark, tmp_path, files, **options):
    """A start of the stream after each file, all from one checkpoint, and all that they wrote."""
    runs.use_rocksdb(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in files:
        spark.createDataFrame(rows, TIMED).coalesce(1).write.mode("append").parquet(source)
        stream = runs.transitions(spark.readStream.schema(TIMED).parquet(source), **options)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120) or query.stop() or pytest.fail("the stream doesn't end")
    return spark.read.parquet(out)


def test_stream_over_restarts_equals_the_batch(spark, tmp_path):
    events = run_events(7)
    shuffled = [(r, s, t, datetime(2025, 1, 1) + timedelta(minutes=r + 7 * s)) for r, s, t in events]
    random.Random(3).shuffle(shuffled)
    got = play(spark, tmp_path, [shuffled[k::3] for k in range(3)], stuck_ms=10 * 86_400_000)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(events)


def test_stuck_runs_are_told_once_and_finished_ones_forgotten(spark, tmp_path):
    day = lambda n: datetime(2025, 1, n)
    files = [[(1, 0, "OCR_STARTED", day(1)), (2, 0, "FAILED", day(1)), (3, 1, "OCR_DONE", day(1))], [(9, 0, "OCR_STARTED", day(20))], [(9, 1, "FAILED", day(21)), (2, 0, "OCR_STARTED", day(21))]]
    got = play(spark, tmp_path, files, late="1 hour").collect()
    stuck = sorted((r.run_id, r.from_state, r.reason) for r in got if r.seq is None)
    assert stuck == [(1, "OCR_STARTED", "Stuck"), (3, "CREATED", "Stuck: 1 events wait for an earlier one")]
    assert [(r.seq, r.accepted) for r in got if r.run_id == 2] == [(0, True), (0, True)]  # its number is new again


SHEET = "id bigint, status string, site string, score double"


def stored(table):
    return sorted(str(tuple(r)) for r in table.read().collect())


def test_merges_are_partial_idempotent_and_whole(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), SHEET, "id", buckets=4)
    assert table.read().count() == 0
    first = spark.createDataFrame([(i, 0, "pending", f"site {i % 3}", 1.0) for i in range(50)], "id bigint, at int, status string, site string, score double")
    assert table.merge(first, 0, "w", ["at"])
    more = spark.createDataFrame([(3, 1, "done", None, None), (3, 2, None, "moved", None), (3, 0, "old", None, None), (99, 1, "new", None, 2.0), (None, 1, "x", None, None)], "id bigint, at int, status string, site string, score double")
    want = stored(table)
    reader, before = table.read(), table.pointer()

    class Died(Exception):
        pass

    def die():
        raise Died

    with pytest.raises(Died):  # all written, the pointer not swapped
        table.merge(more, 1, "w", ["at"], before_swap=die)
    assert stored(table) == want and table.committed("w") == 0
    assert table.merge(more, 1, "w", ["at"]) and not table.merge(more, 1, "w", ["at"]) and not table.merge(first, 0, "w", ["at"])
    got = {r.id: tuple(r) for r in table.read().collect()}
    assert got[3] == (3, "done", "moved", 1.0) and got[99] == (99, "new", None, 2.0) and len(got) == 51
    assert sorted(str(tuple(r)) for r in reader.collect()) == want  # a reader keeps its snapshot
    changed = {b for b, p in table.pointer()["buckets"].items() if before["buckets"].get(b) != p}
    assert 1 <= len(changed) <= 2  # only the buckets of 3 and 99
    assert table.merge(more, 0, "another writer", ["at"])
    assert table.remove_old_files() > 0 and len(stored(table)) == 51


def test_stream_of_changes_equals_one_merge(spark, tmp_path):
    rng = random.Random(5)
    changes = [(rng.randrange(30), t, rng.choice(("a", "b", None)), rng.choice((None, "north", "south")), rng.choice((None, 1.5, 2.5))) for t in range(400)]
    schema = "id bigint, at int, status string, site string, score double"
    table, source = SnapshotTable(spark, str(tmp_path / "t"), SHEET, "id", buckets=3), str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(changes[k * 130 : (k + 1) * 130 + (100 if k == 2 else 0)], schema).coalesce(1).write.mode("append").parquet(source)
        merge_stream(spark.readStream.schema(schema).parquet(source), table, "s", ["at"], str(tmp_path / "cp")).awaitTermination()
    last = latest_changes(spark.createDataFrame(changes, schema), "id", ["at"])
    want = R.merge(spark.createDataFrame([], SHEET), last, "id")
    assert stored(table) == sorted(str(tuple(r)) for r in want.collect()) and table.committed("s") == 2


def test_counters_of_micro_batches_equal_one_aggregate(spark, tmp_path):
    rows = [(i, ("passed", "failed", None)[i % 3], ("S0", "S1", "critical", None, "S3")[i % 5]) for i in range(300)]
    schema, source = "id int, status string, severity string", str(tmp_path / "in")
    watch = K.Counters("parity")
    spark.streams.addListener(watch)
    try:
        for k in range(3):
            spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(source)
            counts = [c.alias(n) for n, c in K.parity_counters().items()]
            stream = spark.readStream.schema(schema).parquet(source).observe("parity", *counts)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        import time

        for _ in range(100):  # progress reaches listeners a little later
            if watch.totals("parity").get("total_fields", 0) >= 300:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    table = spark.createDataFrame(rows, schema)
    want = table.agg(*[c.alias(n) for n, c in K.parity_counters().items()])
    assert watch.totals("parity") == {k: v for k, v in want.first().asDict().items()}
    seen, got = K.observed(table, "batch", K.parity_counters())
    assert seen.count() == 300 and got.get == want.first().asDict()
    rates = {r.severity: r for r in K.pass_rates(want).collect()}
    assert set(rates) == {"all", "S0", "S1", "S3"} and rates["S0"].total == 60 and rates["all"].rate == pytest.approx(100 / 3)
    kept = watch.table(spark)
    assert kept.filter("metric = 'total_fields'").agg(F.sum("value")).first()[0] == 300
    watch.add("parity", "again", 0, {"total_fields": 5})
    watch.add("parity", "again", 0, {"total_fields": 7})  # a batch that runs again counts once
    assert watch.totals("parity", "again") == {"total_fields": 7}


def test_exposition_is_in_fixed_order():
    text = K.prometheus({"parity_pass_rate": 85.5, "parity_runs_total": 3}, {"S1": 50.0, "S0": 100.0, "bad": 1.0}, {"env": 'a"b\\c\nd'})
    lines = text.splitlines()
    assert lines[0] == "# HELP parity_pass_rate Current parity pass rate percentage" and lines[1] == "# TYPE parity_pass_rate gauge"
    assert lines[2] == 'parity_pass_rate{env="a\\"b\\\\c\\nd"} 85.5' and 'parity_runs_total{env="a\\"b\\\\c\\nd"} 3' in lines
    assert [x.split('severity="')[1][:2] for x in lines if x.startswith("parity_pass_rate_by_severity{")] == ["S0", "S1"]


def test_deliveries_come_back_after_their_delay_and_the_log_is_bounded(spark, tmp_path):
    hooks = spark.createDataFrame(
        [(1, "http://a", "k1", ["done", "failed"], True, 2), (2, "http://b", "k2", ["done"], True, None), (3, "http://c", "k3", ["done"], False, 1), (4, "http://d", "k4", ["failed"], True, 0)],
        "webhook_id long, url string, secret string, events array<string>, active boolean, retries int")
    events = [(0, "done", '{"who":{"apiToken":"abc","name":"x"},"n":1}'), (1, "failed", '{"Api-Key":["q",{"password":"p"}]}'), (2, "other", "{}"), (3, "done", None)]
    log = SnapshotTable(spark, str(tmp_path / "log"), webhooks.LOG, "delivery", buckets=1)
    tried = []

    def send(due):
        tried.append(sorted((r.webhook_id, r.seq, r.attempts) for r in due.collect()))
        return due.select("delivery", F.when(F.col("webhook_id") == 2, 200).when((F.col("webhook_id") == 1) & (F.col("seq") == 0), 503).when(F.col("webhook_id") == 4, 404).cast("int").alias("status_code"))

    frame = lambda rows: spark.createDataFrame(rows, "seq long, event string, payload string")
    assert webhooks.deliver(frame(events), 0, log, hooks, send, 1000)
    rows = {(r.webhook_id, r.seq): r for r in log.read().collect()}
    assert set(rows) == {(1, 0), (2, 0), (1, 1), (4, 1)}
    assert rows[2, 0].status == "delivered" and rows[4, 1].status == "failed" and rows[4, 1].status_code == 404
    assert rows[1, 0].status == "pending" and rows[1, 0].next_at_ms == 2000 and rows[1, 1].status_code is None
    assert rows[2, 0].payload == '{"n":1,"who":{"apiToken":"[REDACTED]","name":"x"}}' and "q" not in rows[1, 1].payload and '"password":"[REDACTED]"' in rows[1, 1].payload
    for (hook, _), r in rows.items():
        assert r.signature == "sha256=" + hmac.new(f"k{hook}".encode(), r.payload.encode(), hashlib.sha256).hexdigest()
    assert not webhooks.deliver(frame(events), 0, log, hooks, send, 1500) and len(tried) == 1  # a batch that comes again
    assert webhooks.deliver(frame([]), 1, log, hooks, send, 1999) and tried[-1] == []
    assert webhooks.deliver(frame(events[:1]), 2, log, hooks, send, 2000) and tried[-1] == [(1, 0, 1), (1, 1, 1)]  # an event that comes again is no new delivery
    rows = {(r.webhook_id, r.seq): r for r in log.read().collect()}
    assert rows[1, 0].next_at_ms == 4000 and rows[1, 0].attempts == 2
    assert webhooks.deliver(frame([]), 3, log, hooks, send, 4000)
    rows = {(r.webhook_id, r.seq): r for r in log.read().collect()}
    assert rows[1, 0].status == "failed" and rows[1, 0].attempts == 3 and rows[1, 0].finished_at_ms == 4000
    assert webhooks.deliver(frame([(10 + i, "done", "{}") for i in range(5)]), 4, log, hooks, send, 5000, most=3)
    rows = log.read().collect()
    assert sorted(r.seq for r in rows if r.status != "pending") == [12, 13, 14] and len([r for r in rows if r.status == "pending"]) == 5
    assert [r.n for r in webhooks.in_order(log.read()).filter("webhook_id = 2").orderBy("n").collect()] == [1, 2, 3]
