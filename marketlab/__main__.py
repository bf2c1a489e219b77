"""Command line: list and run registered queries, sweep a family of detectors over an asset's ticks, check an installation.

python -m marketlab list
python -m marketlab query time_bars_1h /data/sf0.1 --out /results/bars
python -m marketlab sweep /data/sf0.1 --asset click --family donchian --regime day --registry /shared/registry --report /results/run.md
python -m marketlab doctor EURUSD=/ticks/asset=EURUSD --registry /shared/registry
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marketlab")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    query = commands.add_parser("query")
    query.add_argument("name")
    query.add_argument("data")
    query.add_argument("--out", help="Parquet folder; without it the first rows are shown")
    sweep = commands.add_parser("sweep")
    sweep.add_argument("data")
    sweep.add_argument("--asset", required=True)
    sweep.add_argument("--family", required=True, choices=("cusum", "bollinger", "donchian"))
    sweep.add_argument("--regime", default="day")
    sweep.add_argument("--registry", required=True)
    sweep.add_argument("--least", type=int, default=500, help="events that a trial must have")
    sweep.add_argument("--report", help="Markdown file")
    doctor = commands.add_parser("doctor")
    doctor.add_argument("ticks", nargs="*", help="name=path")
    doctor.add_argument("--registry")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from marketlab.plans import catalogue, research, strategy
    from marketlab.sources.views import ticks

    if args.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("marketlab").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "query":
        found = catalogue.QUERIES[args.name](spark, args.data)
        if args.out:
            found.write.mode("overwrite").parquet(args.out)
        else:
            found.show(20, False)
        return 0
    registry = research.Registry(spark, args.registry) if args.registry else None
    if args.command == "doctor":
        health = research.doctor(spark, dict(t.split("=", 1) for t in args.ticks), registry).collect()  # a row for each check
        print("\n".join(f"{'ok ' if r['ok'] else 'BAD'} {r['check']}: {r['detail']}" for r in health))
        return int(not all(r["ok"] for r in health))
    pc = strategy.precompute(ticks(spark, args.data), args.asset, research.REGIMES[args.regime])
    got = strategy.sweep_and_certify(pc, args.family, registry, trial={"least": args.least}, dataset={"least": args.least})
    columns = "options string, status string, n_events long, objective double, valid boolean, brier double, brier_naive double"
    rows = [(str(t["options"]), t["status"], t["n_events"], t["objective"], t["valid"], t["brier"], t["brier_naive"]) for t in got["trials"]]
    survivors = None
    if got["certification"]:
        c = got["certification"]
        survivors = spark.createDataFrame([(str(c["options"]), c["status"], c.get("pbo"), c.get("dsr"), c.get("p_value"))], "options string, status string, pbo double, dsr double, p_value double")
    text = research.report(spark.createDataFrame(rows, columns), f"{args.family} on {args.asset}", survivors)
    if args.report:
        with open(args.report, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
