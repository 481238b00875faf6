"""Processed documents in three stored tables: findings, audit results and the status of each sheet.

A batch commits findings first, then audit results, then statuses, each as a whole snapshot. So
whoever reads that a sheet is done finds its audit and its findings, and a batch that died in
between goes on where it stopped when it comes again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyzer
from ..operators.documents import Template
from ..operators.processing import processed
from .snapshots import SnapshotTable

SHEETS = "doc_id long, status string, run_id string, template string, error string"
RESULTS = "run_id string, doc_id long, result string, mode string, score double, template string, band string, review_reason string, summary string, page_count int, fields array<struct<field:string,value:string,confidence:double,page:int>>"
FINDINGS = "finding_id string, run_id string, doc_id long, severity string, reason string, field string, page int, snippet string, confidence double, rule_id string"


class AuditStore:
    """The three tables under ``folder``; ``doc_id`` is a long."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.sheets = SnapshotTable(spark, f"{folder}/job_sheets", SHEETS, "doc_id", buckets)
        self.results = SnapshotTable(spark, f"{folder}/audit_results", RESULTS, "run_id", buckets)
        self.findings = SnapshotTable(spark, f"{folder}/audit_findings", FINDINGS, "finding_id", buckets)

    def write(self, rows: DataFrame, batch: int, writer: str = "processing", order: str = "received_at", between: Callable[[str], None] = lambda table: None) -> None:
        """Stores what ``processed`` gave, with a column ``order``: of rows of one document the last (then the greatest run) is its status.

        Failed documents get a status and no audit. Runs are stored once, however often they come.
        """
        rows = rows.persist(StorageLevel.DISK_ONLY)
        try:
            audited = rows.filter("result IS NOT NULL")
            each = audited.select("run_id", "doc_id", F.posexplode("findings").alias("_n", "f"), order)
            found = each.select(F.concat_ws(":", "run_id", F.col("_n").cast("string")).alias("finding_id"), "run_id", "doc_id", "f.*", order)
            self.findings.merge(found, batch, writer, [order])
            between("audit_findings")
            self.results.merge(audited.select(*[c.split()[0] for c in RESULTS.split(", ")], order), batch, writer, [order])
            between("audit_results")
            # One struct a document, so that a status comes with its own run, template and error.
            last = rows.groupBy("doc_id").agg(F.max_by(F.struct("status", "run_id", "template", "error"), F.struct(order, "run_id")).alias("s"))
            self._replace(last.select("doc_id", "s.*"), batch, writer)
        finally:
            rows.unpersist()

    def _replace(self, rows: DataFrame, batch: int, writer: str) -> None:
        def change(current: DataFrame, delta: DataFrame) -> DataFrame:
            return current.join(delta.select("doc_id"), "doc_id", "left_anti").unionByName(delta)

        self.sheets.commit(batch, writer, change, rows.filter("doc_id IS NOT NULL"))


def process_stream(docs: DataFrame, store: AuditStore, templates: Sequence[Template], rules: Mapping[str, Sequence[analyzer.Rule]], checkpoint: str, writer: str = "processing", version: str = "1"):
    """Starts processing a stream of ``docs(doc_id, pages, received_at)``, all that is there; each micro-batch is stored as a whole."""
    def write(batch: DataFrame, number: int) -> None:
        store.write(processed(batch, templates, rules, version=version, carry=("received_at",)), number, writer)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
