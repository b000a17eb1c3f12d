"""Command line: ``python -m plumbline -c CONFIG [-d ROOT] [-o OUT] [-t TASK]... [-k CACHE]``; exit 1 if a task failed.

``python -m plumbline encoding -c CONFIG -t TASK -o FILE`` writes only the descriptor of the task's metadata encoding.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.operators.encoding import descriptor
from plumbline.plans.config import export_schema, load_config, load_config_folder
from plumbline.plans.workflows import bind, run_tasks
from plumbline.session import local_session


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else list(argv)
    encoding_only = argv[:1] == ["encoding"]
    parser = argparse.ArgumentParser(prog="plumbline encoding" if encoding_only else "plumbline")
    parser.add_argument("-c", "--config")
    parser.add_argument("-d", "--data", default=".")
    parser.add_argument("-o", "--output")
    parser.add_argument("-t", "--task", action="append")
    parser.add_argument("-k", "--cache", help="folder in which image metrics are kept for the next run")
    parser.add_argument("--schema", action="store_true", help="print the configuration's JSON Schema")
    args = parser.parse_args(argv[encoding_only:])
    if args.schema:
        print(export_schema())
        return 0
    if not args.config:
        parser.error("a configuration is needed")
    path = Path(args.config)
    config = load_config_folder(path) if path.is_dir() else load_config(path)
    spark = SparkSession.getActiveSession() or local_session()
    if encoding_only:
        if not args.task or not args.output:
            parser.error("name the task and the file")
        _, policy = bind(spark, config.get("tasks", args.task[0]), config, args.data, cache=args.cache)
        if policy is None:
            parser.error("the task has no metadata policy")
        Path(args.output).write_text(descriptor(policy))
        return 0
    results = run_tasks(spark, config, args.data, args.task, cache=args.cache)
    if args.output and len({r.descriptor for r in results}) == 1 and results and results[0].descriptor:
        Path(args.output).mkdir(parents=True, exist_ok=True)
        (Path(args.output) / "encoding.json").write_text(results[0].descriptor)  # only where all tasks agree
    for r in results:
        print(r.report())
        if args.output:
            folder = Path(args.output) / r.name
            folder.mkdir(parents=True, exist_ok=True)
            r.export(folder / "result.json")
            (folder / "result.txt").write_text(r.report())
            r.write_tables(str(folder / "tables"))
    return int(not all(r.success for r in results))


if __name__ == "__main__":
    sys.exit(main())
