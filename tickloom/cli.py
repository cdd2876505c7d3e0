"""python -m tickloom.cli run | query | toy-csv"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tickloom.config import PersistenceConfig, load_config
from tickloom.plans.experiment import run_experiment
from tickloom.plans.reports import leaderboard, list_experiments, run_report
from tickloom.sources.bars import write_toy_csv
from tickloom.sources.store import Store


def session() -> SparkSession:
    return SparkSession.builder.appName("tickloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tickloom")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("--config", required=True)
    run.add_argument("--show-top", type=int, default=5)
    query = commands.add_parser("query")
    query.add_argument("--db", default=PersistenceConfig().db_path)
    query.add_argument("--dataset-id")
    query.add_argument("--limit", type=int, default=20)
    query.add_argument("--with-config", action="store_true")
    query.add_argument("--leaderboard", action="store_true")
    query.add_argument("--sort-by", choices=["cv", "test", "test_sharpe"], default="cv")
    query.add_argument("--score-key", default="cv_score")
    toy = commands.add_parser("toy-csv")
    toy.add_argument("--out", required=True)
    for name, kind, default in (("rows", int, 800), ("features", int, 6), ("freq", str, "D"), ("start", str, "2016-01-01"), ("seed", int, 42)):
        toy.add_argument(f"--{name}", type=kind, default=default)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "toy-csv":
        write_toy_csv(args.out, args.rows, args.features, args.freq, args.start, args.seed)
        return 0
    spark = session()
    if args.command == "run":
        cfg = load_config(args.config)
        number = run_experiment(spark, cfg)
        print("\n".join(run_report(Store(spark, cfg.persistence.db_path).tables(), number, args.show_top)))
        return 0
    tables = Store(spark, args.db).tables()
    key = (args.score_key or "").strip()
    if args.leaderboard:
        df = leaderboard(tables, args.dataset_id, args.limit, args.sort_by, None if key.lower() in ("", "any", "*") else key)
    else:
        df = list_experiments(tables.experiments, args.dataset_id, args.limit, args.with_config)
    df.show(args.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
