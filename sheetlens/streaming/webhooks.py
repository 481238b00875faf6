"""Delivery of webhooks as data: what is to be sent, what became of it, and when it is tried again.

A delivery log is a table with a row per event and subscriber. Each micro-batch adds its
events, tries what is due and writes the outcome in one commit, so a delivery is neither lost
nor logged twice when a writer dies. Who sends is a parameter.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import backoff_ms
from ..operators.nested import leaves, rebuilt, rewritten
from ..operators.review import SENSITIVE
from .snapshots import SnapshotTable

LOG = "delivery string, seq bigint, webhook_id bigint, event string, url string, payload string, signature string, retries int, attempts int, status string, status_code int, next_at_ms bigint, finished_at_ms bigint"
PENDING, DELIVERED, FAILED = "pending", "delivered", "failed"
# How often an endpoint is tried again, and how many finished deliveries are kept.
RETRIES, MOST = 3, 1000


def signature(payload: Column, secret: Column) -> Column:
    """``sha256=`` and the HMAC-SHA256 of a payload under its subscriber's secret."""
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, keys in batches:
            yield pd.Series([None if t is None or k is None else f"sha256={hmac.new(k.encode(), t.encode(), hashlib.sha256).hexdigest()}" for t, k in zip(texts, keys)])

    return run(payload, secret)


def without_secrets(events: DataFrame, keys: list[str], payload: str = "payload", names: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Payloads with every string hidden whose member's name holds a sensitive word, at any depth."""
    def change(steps: Column, value: Column) -> Column:
        named = F.replace(F.lower(F.coalesce(F.element_at(F.filter(F.transform(steps, lambda s: s["name"]), lambda n: n.isNotNull()), -1), F.lit(""))), F.lit("-"), F.lit("_"))
        return F.when(F.exists(F.array(*map(F.lit, names)), lambda n: named.contains(n)), "[REDACTED]").otherwise(value)

    return rebuilt(rewritten(leaves(events, payload, keys), change), keys, payload)


def enqueued(events: DataFrame, webhooks: DataFrame, now_ms: int, redact: bool = True) -> DataFrame:
    """Rows of LOG for each event and each active webhook subscribed to it, due at once.

    ``events(seq, event, payload)`` with JSON payloads, ``webhooks(webhook_id, url, secret,
    events, active, retries)``, a small dimension. The id of a delivery comes from the
    webhook and the event's number, so an event that comes again is the same delivery.
    """
    safe = without_secrets(events, ["seq", "event"]) if redact else events.select("seq", "event", "payload")
    able = webhooks.filter(F.coalesce(F.col("active"), F.lit(True))).select("webhook_id", "url", "secret", F.coalesce("retries", F.lit(RETRIES)).alias("retries"), F.explode("events").alias("event"))
    sent = safe.join(able, "event")
    ident = F.sha2(F.concat_ws(":", F.col("webhook_id").cast("string"), F.col("seq").cast("string"), "event"), 256)
    return sent.select(
        ident.alias("delivery"), F.col("seq").cast("long").alias("seq"), F.col("webhook_id").cast("long").alias("webhook_id"), "event", "url", "payload", signature(F.col("payload"), F.col("secret")).alias("signature"), F.col("retries").cast("int").alias("retries"),
        F.lit(0).alias("attempts"), F.lit(PENDING).alias("status"), F.lit(None).cast("int").alias("status_code"), F.lit(now_ms).cast("long").alias("next_at_ms"), F.lit(None).cast("long").alias("finished_at_ms"))


def attempted(log: DataFrame, send: Callable[[DataFrame], DataFrame], now_ms: int) -> DataFrame:
    """The log after one round of sending what is due.

    ``send(due)`` gives (delivery, status_code), null where nobody answered. An answer below
    500 is final, a success if it is one of the 200s; anything else is tried again after a
    delay that doubles from a second up to 30, until the webhook's retries are used up.
    """
    due = (F.col("status") == PENDING) & (F.col("next_at_ms") <= now_ms)
    answers = send(log.filter(due)).select("delivery", F.col("status_code").cast("int").alias("_code"), F.lit(True).alias("_tried"))
    rows = log.join(answers, "delivery", "left").withColumn("_tried", F.coalesce("_tried", F.lit(False)))
    code, tries = F.col("_code"), F.col("attempts") + 1
    status = F.when(code.between(200, 299), DELIVERED).when(code < 500, FAILED).when(tries > F.col("retries"), FAILED).otherwise(PENDING)
    rows = rows.withColumn("_status", status)
    pick = lambda new, old: F.when(F.col("_tried"), new).otherwise(F.col(old)).alias(old)
    return rows.select(
        "delivery", "seq", "webhook_id", "event", "url", "payload", "signature", "retries", pick(tries, "attempts"), pick(F.col("_status"), "status"), pick(code, "status_code"),
        pick(F.when(F.col("_status") == PENDING, F.lit(now_ms) + backoff_ms(F.col("attempts")).cast("long")), "next_at_ms"), pick(F.when(F.col("_status") != PENDING, F.lit(now_ms).cast("long")), "finished_at_ms"))


def trimmed(log: DataFrame, most: int = MOST) -> DataFrame:
    """The log with its latest ``most`` finished deliveries; those pending stay. The bound is a feature: the oldest are dropped first."""
    newest = log.filter(F.col("status") != PENDING).orderBy(F.desc("finished_at_ms"), F.desc("seq"), F.desc("delivery")).limit(most)
    return log.filter(F.col("status") == PENDING).unionByName(newest)


def in_order(log: DataFrame) -> DataFrame:
    """The log with each delivery's place, oldest first, per webhook."""
    return log.withColumn("n", F.row_number().over(Window.partitionBy("webhook_id").orderBy(F.coalesce("finished_at_ms", F.lit(2**62)), "seq", "delivery")))


def deliver(events: DataFrame, batch: int, table: SnapshotTable, webhooks: DataFrame, send: Callable[[DataFrame], DataFrame], now_ms: int, most: int = MOST, writer: str = "webhooks") -> bool:
    """One micro-batch: adds its events, sends what is due, trims and commits; False if the batch was committed before.

    The log is bounded by ``most`` finished deliveries and what is pending, so it is one
    bucket. Sending happens before the commit: a writer that dies between sends again.
    """
    fresh = enqueued(events, webhooks, now_ms).checkpoint()

    def change(current: DataFrame, delta: DataFrame) -> DataFrame:
        known = current.select("delivery")
        return trimmed(attempted(current.unionByName(delta.join(known, "delivery", "left_anti")), send, now_ms), most)

    return table.commit(batch, writer, change, fresh, always=True)
