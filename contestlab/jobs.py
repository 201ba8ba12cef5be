"""Named jobs from the command line (U4): `python -m contestlab.jobs list`, `run NAME --data DIR --out PATH`, `explain NAME --data DIR`.

A session comes from spark-submit's settings; without them Spark's own defaults hold.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from contestlab import registry


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="contestlab.jobs")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all jobs").add_argument("--like", default="")
    for name, what in (("run", "run a job and write its rows as Parquet"), ("explain", "show a job's plan")):
        one = commands.add_parser(name, help=what)
        one.add_argument("job", choices=sorted(registry.QUERIES), metavar="NAME")
        one.add_argument("--data", required=True, help="folder of the tables")
        if name == "run":
            one.add_argument("--out", required=True)
            one.add_argument("--mode", default="errorifexists", choices=("errorifexists", "overwrite", "append"))
    given = parser.parse_args(arguments)
    if given.command == "list":
        for name, job in sorted(registry.QUERIES.items()):
            if given.like in name:
                print(name, (job.__doc__ or "").strip().split("\n")[0], sep="\t")
        return 0
    found = registry.QUERIES[given.job](SparkSession.builder.appName(given.job).getOrCreate(), given.data)
    if given.command == "explain":
        found.explain("formatted")
    else:
        found.write.mode(given.mode).parquet(given.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
