"""python -m almoneda COMMAND --home FOLDER: init-schema, init-graph, backfill, daily or reconcile."""

from __future__ import annotations

import argparse

from almoneda.jobs import Jobs
from almoneda.session import build


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="almoneda")
    parser.add_argument("command", choices=("init-schema", "init-graph", "backfill", "daily", "reconcile"))
    parser.add_argument("--home", required=True, help="the folder of the store, shared by driver and executors")
    parser.add_argument("--year", type=int, help="the last year of the catalog")
    args = parser.parse_args(argv)
    jobs = Jobs(build(), args.home, year=args.year)
    print(getattr(jobs, args.command.replace("-", "_"))())


if __name__ == "__main__":
    main()
