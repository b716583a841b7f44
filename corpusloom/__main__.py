"""Command line: python -m corpusloom convert IN OUT | validate OUT | inspect IN."""

from __future__ import annotations

import argparse
import sys

from corpusloom.operators import convert
from corpusloom.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("convert", help="convert a folder to Markdown")
    run.add_argument("source")
    run.add_argument("output")
    run.add_argument("--force", action="store_true", help="convert unchanged files again")
    run.add_argument("--raw", action="store_true", help="leave the text as the converters give it")
    run.add_argument("--chunks", action="store_true", help="write a sidecar with chunks beside each document")
    for name, arg in (("validate", "output"), ("inspect", "source")):
        commands.add_parser(name).add_argument(arg)
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "convert":
        rows = convert.convert_folder(spark, args.source, args.output, args.force, not args.raw, args.chunks).collect()
        failed = [r for r in rows if r.status == "failed"]
        print(f"{sum(r.status == 'ok' for r in rows)} converted, {len(failed)} failed, {sum(r.status == 'skipped' for r in rows)} skipped")
        for r in failed:
            print(f"{r.source}: {r.error}")
        return 1 if failed else 0
    if args.command == "validate":
        found = convert.validate_folder(spark, args.output).collect()
        for r in found:
            print(f"{r.path}:{r.line or ''}: [{r.severity}] {r.rule}: {r.detail}")
        return 1 if any(r.severity == "error" for r in found) else 0
    for r in convert.inspect_folder(spark, args.source).collect():
        print(f"{r.kind or 'all'}: {r.files} file(s), {r.bytes or 0} bytes")
    return 0


if __name__ == "__main__":
    sys.exit(main())
