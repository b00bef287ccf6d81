"""python -m tessera serve | benchmark"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from tessera import benchmark
from tessera.database import Database, Scheduler
from tessera.service import serve


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    server = commands.add_parser("serve")
    server.add_argument("--data-dir", default="./data")
    server.add_argument("--bind", default="127.0.0.1:8080")
    server.add_argument("--maintenance-interval-secs", type=float, default=30)
    bench = commands.add_parser("benchmark")
    bench.add_argument("--data-dir", default="./bench-data")
    for name, value in (("vectors", 100_000), ("dimension", 128), ("queries", 200), ("k", 10), ("seed", 42)):
        bench.add_argument(f"--{name}", type=int, default=value)
    bench.add_argument("--collection", default="bench")
    told = parser.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    root = told.data_dir if "://" in told.data_dir else "file://" + os.path.abspath(told.data_dir)
    if told.command == "benchmark":
        for name, value in benchmark.run(spark, root, told.vectors, told.dimension, told.queries, told.k, told.seed, told.collection).items():
            print(f"{name}={value}")
        return
    host, _, port = told.bind.rpartition(":")
    db = Database(spark, root)
    schedule = Scheduler(db, told.maintenance_interval_secs)
    try:
        serve(db, host, int(port)).serve_forever()
    finally:
        schedule.stop()


if __name__ == "__main__":
    main()
