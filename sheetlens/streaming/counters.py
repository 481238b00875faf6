"""Running counters and gauges, observed while data passes: no second scan, on tables and on streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.scalars import ratio
from ..sources.tables import SEVERITIES


def parity_counters(status: str = "status", severity: str = "severity") -> dict[str, Column]:
    """Fields in all, passed and failed, and by each canonical severity how many there are and how many passed; other severities count in no group."""
    passed = F.coalesce(F.col(status) == "passed", F.lit(False))
    by = {}
    for s in SEVERITIES:
        here = F.coalesce(F.col(severity) == s, F.lit(False))
        by |= {f"{s}_total": F.count_if(here), f"{s}_passed": F.count_if(here & passed)}
    return {"total_fields": F.count(F.lit(1)), "passed_fields": F.count_if(passed), "failed_fields": F.count_if(~passed), **by}


def pass_rates(counters: DataFrame) -> DataFrame:
    """(severity, passed, total, rate) of a row of ``parity_counters``: ``all`` and the canonical severities that occur, in percent."""
    part = lambda n, p, t: F.struct(F.lit(n).alias("severity"), F.col(p).alias("passed"), F.col(t).alias("total"))
    every = F.array(part("all", "passed_fields", "total_fields"), *[part(s, f"{s}_passed", f"{s}_total") for s in SEVERITIES])
    rows = counters.select(F.explode(every).alias("r")).select("r.*").filter("total > 0 OR severity = 'all'")
    return rows.withColumn("rate", ratio(F.col("passed"), F.col("total")) * 100)


def observed(df: DataFrame, name: str, counters: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` that counts while an action reads it, and what holds the counts afterwards."""
    watch = Observation(name)
    return df.observe(watch, *[c.alias(n) for n, c in counters.items()]), watch


class Counters(StreamingQueryListener):
    """Counts of micro-batches, from the ``observe`` of streams, and of batch runs, as rows of a table of metrics.

    A micro-batch that is run again replaces its counts, so totals count each once. Values are
    numbers; counters add up, of gauges the last counts.
    """

    def __init__(self, *names: str):
        self.names, self.rows = set(names), {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            if not self.names or name in self.names:
                self.add(name, str(event.progress.id), event.progress.batchId, row.asDict())

    def add(self, name: str, run: str, batch: int, values: Mapping[str, float]) -> None:
        """Counts of one batch of a run; for a batch job, what its observation got."""
        for metric, value in values.items():
            self.rows[name, run, batch, metric] = value

    def totals(self, name: str, run: str | None = None) -> dict[str, float]:
        """Sums over all batches of a run, or of all runs."""
        out: dict[str, float] = {}
        for (n, r, _, metric), value in self.rows.items():
            if n == name and run in (None, r):
                out[metric] = out.get(metric, 0) + (value or 0)
        return out

    def latest(self, name: str) -> dict[str, float]:
        """The values of the last batch that gave each: gauges."""
        return {metric: v for (n, _, _, metric), v in sorted(self.rows.items(), key=lambda x: x[0][2]) if n == name}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, r, b, m, None if v is None else float(v)) for (n, r, b, m), v in sorted(self.rows.items())]
        return spark.createDataFrame(rows, "name string, run string, batch bigint, metric string, value double")


# Metrics in the order they are given out, with what they are; the pass rate of severities has a label.
EXPOSED = (
    ("parity_pass_rate", "gauge", "Current parity pass rate percentage"), ("parity_total_fields", "gauge", "Total number of fields checked"), ("parity_passed_fields", "gauge", "Number of fields that passed"),
    ("parity_failed_fields", "gauge", "Number of fields that failed"), ("parity_pass_rate_by_severity", "gauge", "Pass rate by severity level"), ("parity_runs_total", "counter", "Total number of parity runs"),
    ("parity_failures_total", "counter", "Total number of parity failures"))


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def prometheus(values: Mapping[str, float], rates: Mapping[str, float], labels: Mapping[str, str] | None = None, metrics=EXPOSED) -> str:
    """Text for a scraper: HELP and TYPE of each metric and its values, metrics and severities in fixed order, labels escaped and in the order of their names."""
    def said(more: Mapping[str, str]) -> str:
        safe = lambda v: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        every = sorted({**(labels or {}), **more}.items())
        return "{" + ",".join(f'{k}="{safe(v)}"' for k, v in every) + "}" if every else ""

    out = []
    for name, kind, text in metrics:
        if name == "parity_pass_rate_by_severity":
            lines = [f"{name}{said({'severity': s})} {_number(rates[s])}" for s in SEVERITIES if s in rates]
        else:
            lines = [f"{name}{said({})} {_number(values.get(name, 0))}"]
        out += [f"# HELP {name} {text}", f"# TYPE {name} {kind}", *lines]
    return "\n".join(out) + "\n"
