"""``python -m sheetlens.cli list``, ``run QUERY DATA_DIR [OUT] [--format parquet|csv|json]``, ``gate NAME DATA_DIR [OUT]`` and jobs over own files.

A gate runs a query, writes what breaks it where OUT is given, and ends with 1 if anything
does. The jobs ``parity GOLDEN ACTUAL``, ``baseline BASELINE REPORT THRESHOLDS``, ``drift METRICS
[BASELINE]``, ``personal-data JSON``, ``determinism FOLDER`` and ``transitions PARQUET`` read what the
user gives, write what they find where ``--out`` is given, and end with 1 if they fail.
"""

from __future__ import annotations

import argparse
import tempfile

from pyspark.sql import SparkSession

#: Gates: the query, and which of its rows break the gate.
GATES = {
    "parity": ("parity_violations", "true"), "baseline": ("baseline_comparison", "status = 'regressed'"), "drift": ("drift_alerts", "severity = 'critical'"),
    "fixtures": ("fixture_reports", "result = 'FAIL'")}
#: Jobs over own files: their arguments and options.
JOBS = {
    "parity": (("golden", "actual"), {"--mode": {"default": "full", "choices": ("positive", "negative", "full")}}), "baseline": (("stored", "report", "thresholds"), {"--strict": {"action": "store_true"}}),
    "drift": (("metrics",), {"--stored": {}}), "personal-data": (("path",), {}), "determinism": (("folder",), {}), "transitions": (("path",), {})}


def broken(df, test: str):
    """The rows that break a gate."""
    return df.filter(test)


def main(argv: list[str] | None = None) -> int:
    from . import jobs
    from .plans.catalogue import QUERIES

    parser = argparse.ArgumentParser(prog="sheetlens")
    sub = parser.add_subparsers(dest="job", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query", choices=sorted(QUERIES))
    gate = sub.add_parser("gate", help="run a query whose rows must keep a test; ends with 1 if they don't")
    gate.add_argument("query", choices=sorted(GATES))
    for name, (arguments, options) in JOBS.items():
        job = sub.add_parser(name, help=getattr(jobs, name.replace("-", "_")).__doc__.split("\n")[0])
        for a in arguments:
            job.add_argument(a)
        for option, how in options.items():
            job.add_argument(option, **how)
        job.add_argument("--out")
        job.add_argument("--format", default="json", choices=("parquet", "csv", "json"))
    for p in (run, gate):
        p.add_argument("data")
        p.add_argument("out", nargs="?")
        p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    args = parser.parse_args(argv)
    if args.job == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.job in JOBS:
        arguments, options = JOBS[args.job]
        given = {n: getattr(args, n) for n in (*arguments, *(o.lstrip("-") for o in options))}
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        df, fails = getattr(jobs, args.job.replace("-", "_"))(spark, **given)
        if args.out:
            df.write.mode("overwrite").format(args.format).save(args.out)
        else:
            df.show(50, truncate=False)
        return int(fails)
    if args.job == "gate":
        name, test = GATES[args.query]
        df = broken(QUERIES[name](spark, args.data), test)
    else:
        df = QUERIES[args.query](spark, args.data)
    if args.out:
        df.write.mode("overwrite").format(args.format).save(args.out)
    else:
        df.show(50, truncate=False)
    return 0 if args.job == "run" else int(not df.isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
