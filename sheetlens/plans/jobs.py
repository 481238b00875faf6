"""What the streaming jobs keep, as queries over tables: run histories, partial updates, counters and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..streaming import counters as K
from ..streaming import runs, webhooks
from ..streaming.snapshots import latest_changes
from .registry import query
from .reports import r

_STATES = list(runs.EDGES)
_RUN_SQL = f"""e AS (SELECT conv_id AS run_id, turn AS seq, CASE WHEN conv_id % 11 = 0 AND turn = 2 THEN 'FAILED' WHEN (conv_id + turn) % 7 = 0 THEN 'VALIDATED' ELSE ({_STATES})[least(turn, 7) + 2] END AS state FROM conversations),
 o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq, state) AS n FROM e), g AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, every in runs.EDGES.items() for b in every)}) x(a, b)),
 h AS (SELECT run_id, seq, 'CREATED' AS was, state AS goes, n, 'CREATED' = 'x' AS started FROM o WHERE n = 1 UNION ALL SELECT o.run_id, o.seq, CASE WHEN EXISTS (SELECT 1 FROM g WHERE a = h.was AND b = h.goes) THEN h.goes ELSE h.was END, o.state, o.n, TRUE FROM h JOIN o ON o.run_id = h.run_id AND o.n = h.n + 1)"""


def run_changes(v):
    n = F.col("conv_id") + F.col("turn")
    usual = F.get(F.array(*map(F.lit, _STATES)), (F.least(F.col("turn"), F.lit(7)) + 1).cast("int"))
    state = F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") == 2), "FAILED").when(n % 7 == 0, "VALIDATED").otherwise(usual)
    return v.table("conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), state.alias("state"))


_JUDGED = """SELECT run_id, seq, was AS from_state, goes AS to_state, EXISTS (SELECT 1 FROM g WHERE a = was AND b = goes) AS accepted FROM h"""


@query("run_histories", f"""WITH RECURSIVE {_RUN_SQL}, j AS ({_JUDGED}) SELECT *, CASE WHEN accepted THEN NULL WHEN from_state IN ('PERSISTED', 'FAILED') THEN 'Cannot transition from terminal state: ' || from_state ELSE 'Invalid transition: ' || from_state || ' -> ' || to_state END AS reason FROM j""")
def _(v):
    return runs.histories(run_changes(v))


@query("run_states", f"""WITH RECURSIVE {_RUN_SQL}, j AS ({_JUDGED}), s AS (SELECT run_id, coalesce(arg_max(to_state, seq) FILTER (accepted), 'CREATED') AS state, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected FROM j GROUP BY 1) SELECT *, state IN ('PERSISTED', 'FAILED') AS finished FROM s""")
def _(v):
    return runs.current_states(runs.histories(run_changes(v)))


@query("partial_updates", f"""WITH c AS (SELECT user_id AS id, epoch_us(ts) AS at_us, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS status, CASE WHEN event_id % 2 = 0 THEN 'site_' || (event_id % 7) END AS site, CASE WHEN event_id % 5 = 0 THEN value END AS score FROM events),
 l AS (SELECT id, arg_max(status, (at_us, event_id)) FILTER (status IS NOT NULL) AS status, arg_max(site, (at_us, event_id)) FILTER (site IS NOT NULL) AS site, arg_max(score, (at_us, event_id)) FILTER (score IS NOT NULL) AS score FROM c GROUP BY 1)
 SELECT coalesce(l.id, c_custkey) AS id, coalesce(l.status, c_mktsegment) AS status, coalesce(l.site, c_name) AS site, {r('coalesce(l.score, c_acctbal)')} AS score FROM customer FULL JOIN l ON c_custkey = l.id""")
def _(v):
    e = v.table("events")
    changes = e.select(
        F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("status"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("site_"), (F.col("event_id") % 7).cast("string"))).alias("site"), F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("score"))
    base = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("site"), F.col("c_acctbal").cast("double").alias("score"))
    return R.merge(base, latest_changes(changes, "id", ["at_us", "event_id"]), "id").withColumn("score", S.r6(F.col("score")))


@query("severity_pass_rates", f"""WITH f AS (SELECT status = 'passed' AS ok, CASE WHEN _n = 7 THEN 'critical' ELSE severity END AS severity FROM golden), g AS (SELECT 'all' AS severity, count(*) FILTER (ok) AS passed, count(*) AS total FROM f UNION ALL SELECT severity, count(*) FILTER (ok), count(*) FROM f WHERE severity IN ('S0', 'S1', 'S2', 'S3') GROUP BY 1)
 SELECT severity, passed, total, {r('passed / total::DOUBLE * 100')} AS rate FROM g""", "golden")
def _(v):
    f = v.golden.withColumn("severity", F.when(F.col("_n") == 7, "critical").otherwise(F.col("severity")))
    rates = K.pass_rates(f.agg(*[c.alias(n) for n, c in K.parity_counters().items()]))
    return rates.withColumn("rate", S.r6(F.col("rate")))


_HOOKS = ((1, ("signup", "error"), 1), (2, ("error", "purchase"), 3))
_ANSWERS = "CASE WHEN {0} % 10 < 6 THEN 200 WHEN {0} % 10 = 6 THEN 404 WHEN {0} % 10 = 7 THEN 503 WHEN {0} % 10 = 8 THEN NULL ELSE {1} END"


@query("webhook_log", f"""WITH w AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{e}', {n})" for i, es, n in _HOOKS for e in es)}) x(webhook_id, event, retries)),
 d AS (SELECT w.webhook_id::BIGINT AS webhook_id, event_id AS seq, event, retries, sha256(w.webhook_id || ':' || event_id || ':' || event) AS delivery, {_ANSWERS.format('event_id', '503')} AS c1, {_ANSWERS.format('event_id', '200')} AS c2 FROM events JOIN w ON event_type = event),
 a AS (SELECT *, c1 IS NULL OR c1 >= 500 AS again, c2 IS NULL OR c2 >= 500 AS twice FROM d),
 l AS (SELECT delivery, webhook_id, seq, event, CASE WHEN again THEN 2 ELSE 1 END AS attempts, CASE WHEN NOT again THEN CASE WHEN c1 < 300 THEN 'delivered' ELSE 'failed' END WHEN NOT twice THEN 'delivered' WHEN retries < 2 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN again THEN c2 ELSE c1 END AS status_code,
 CASE WHEN again AND twice AND retries >= 2 THEN 3000 END AS next_at_ms, CASE WHEN NOT again THEN 0 WHEN NOT twice OR retries < 2 THEN 1000 END AS finished_at_ms FROM a),
 k AS (SELECT *, row_number() OVER (ORDER BY finished_at_ms DESC, seq DESC, delivery DESC) AS rn FROM l WHERE status <> 'pending')
 SELECT webhook_id, seq, event, attempts, status, status_code, next_at_ms::BIGINT AS next_at_ms, finished_at_ms::BIGINT AS finished_at_ms FROM (SELECT * EXCLUDE (rn) FROM k WHERE rn <= {webhooks.MOST} UNION ALL SELECT * FROM l WHERE status = 'pending')""")
def _(v):
    hooks = v.spark.createDataFrame([(i, f"http://host{i}", f"key{i}", list(e), True, n) for i, e, n in _HOOKS], "webhook_id long, url string, secret string, events array<string>, active boolean, retries int")
    events = v.table("events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("props").alias("payload"))
    n = F.col("seq") % 10

    def send(last: int):
        return lambda due: due.select("delivery", F.when(n < 6, 200).when(n == 6, 404).when(n == 7, 503).when(n == 9, last).alias("status_code"))

    log = webhooks.attempted(webhooks.enqueued(events, hooks, 0), send(503), 0)
    log = webhooks.trimmed(webhooks.attempted(log, send(200), 1000))
    return log.select("webhook_id", "seq", "event", "attempts", "status", "status_code", "next_at_ms", "finished_at_ms")
