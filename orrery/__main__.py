"""``python -m orrery run STAGE SOURCE TARGET [--config FILE]`` or ``python -m orrery query NAME TABLES [TARGET]``."""

from __future__ import annotations

import argparse
import json

from orrery.plans import registry, stages
from orrery.session import session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orrery")
    commands = parser.add_subparsers(dest="command", required=True)
    stage = commands.add_parser("run", help="run one stage from folder to folder")
    stage.add_argument("stage", choices=stages.STAGES)
    stage.add_argument("source")
    stage.add_argument("target")
    stage.add_argument("--config")
    query = commands.add_parser("query", help="run a named query over a folder of tables")
    query.add_argument("name", choices=sorted(registry.queries()))
    query.add_argument("tables")
    query.add_argument("target", nargs="?")
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "run":
        print(json.dumps(stages.run(spark, args.stage, args.source, args.target, args.config)["outputs"], indent=2))
    else:
        found = registry.queries()[args.name](spark, args.tables)
        found.write.mode("overwrite").parquet(args.target) if args.target else found.show(20, False)


if __name__ == "__main__":
    main()
