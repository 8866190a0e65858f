"""Command line: python -m loglake.cli COMMAND --root FOLDER [--table NAME]"""

from __future__ import annotations

import argparse
import itertools
import json
import time
from dataclasses import asdict

from pyspark.sql import SparkSession

from .api import LogLake
from .config import load
from .operators.lifecycle import to_json
from .plans.cost import CLASSES, MODES, one_class
from .sources.generate import generate
from .sources.wire import read_ndjson


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loglake", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--root", default=None, help="folder or URL of the lake; default from the configuration")
    p.add_argument("--table", default="logs")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("config", "check", "manifest", "lifecycle"):
        sub.add_parser(name)
    ingest = sub.add_parser("ingest")
    ingest.add_argument("--file", help="newline-delimited JSON; without it, generated records")
    ingest.add_argument("--rows", type=int, default=1000)
    ingest.add_argument("--seed", type=int, default=1)
    ingest.add_argument("--follow", type=float, metavar="SECONDS", help="ingest generated records of the present again and again")
    ingest.add_argument("--ticks", type=int, help="end after so many rounds")
    serve = sub.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8080)
    compact = sub.add_parser("compact")
    compact.add_argument("--target-mib", type=int, default=64)
    for name in ("sql", "query"):
        q = sub.add_parser(name)
        q.add_argument("text")
        q.add_argument("--tier", action="append")
        q.add_argument("--estimate", action="store_true")
    price = sub.add_parser("price")
    price.add_argument("bytes", type=int)
    price.add_argument("--class", dest="storage_class", choices=CLASSES, default="Standard")
    price.add_argument("--mode", choices=MODES, default="standard")
    return p


def follow(lake: LogLake, rows: int, seed: int, seconds: float, ticks: int | None = None) -> None:
    """Ingests generated records of the present every so many seconds, each round from a seed of its own."""
    for tick in itertools.count() if ticks is None else range(ticks):
        print(lake.ingest(generate(lake.spark, rows, seed + tick, lake.clock() - rows * 200)), flush=True)
        time.sleep(seconds)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = load(args.config)
    if args.command == "config":
        print(json.dumps(asdict(config), indent=2))
        return 0
    if args.command == "lifecycle":
        print(to_json(args.table, config.lifecycle))
        return 0
    if args.command == "price":
        print(json.dumps(one_class(args.bytes, args.storage_class, args.mode, config.query.scan_mib_per_core, config.query.cores)))
        return 0
    spark = SparkSession.builder.appName("loglake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    lake = LogLake(spark, args.root or config.storage.root, args.table, config)
    if args.command == "check":
        print("ok" if lake.health() else "failed")
    elif args.command == "manifest":
        lake.catalog.files().orderBy("tier", "path").show(1000, truncate=False)
    elif args.command == "ingest" and args.follow is not None:
        follow(lake, args.rows, args.seed, args.follow, args.ticks)
    elif args.command == "serve":
        from .service import Service, server

        service = Service(lake)
        service.start()
        with server(service, args.host, args.port) as http:
            print(f"http://{args.host}:{http.server_address[1]}", flush=True)
            try:
                http.serve_forever()
            except KeyboardInterrupt:
                service.stop()
    elif args.command == "ingest":
        print(lake.ingest(read_ndjson(spark, args.file) if args.file else generate(spark, args.rows, args.seed)))
    elif args.command == "compact":
        for report in lake.compact(args.target_mib << 20)[0]:
            print(report)
    elif args.estimate:
        print(json.dumps(lake.estimate(args.text, args.tier), indent=2))
    else:
        print(lake.engine.pretty(lake.frame(args.text, args.tier)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
