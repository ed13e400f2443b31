"""Command line: ``python -m pairgate.cli version | bench list-scorers | list-loaders | score``."""

from __future__ import annotations

import argparse
import sys

from pairgate import __version__, scoring
from pairgate.session import get_spark
from pairgate.sources import loaders  # noqa: F401  registers the loaders
from pairgate.sources.registry import LOADERS, SCORERS
from pairgate.sources.sinks import score_table, write_csv


def _options(pairs: list[str]) -> dict[str, str]:
    return dict(p.split("=", 1) for p in pairs)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pairgate")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    bench = commands.add_parser("bench").add_subparsers(dest="action", required=True)
    bench.add_parser("list-scorers")
    bench.add_parser("list-loaders")
    run = bench.add_parser("score")
    run.add_argument("--scorer", required=True)
    run.add_argument("--loader", required=True)
    run.add_argument("--output", required=True)
    run.add_argument("--data-dir")
    run.add_argument("--loader-option", action="append", default=[], metavar="KEY=VALUE")
    run.add_argument("--scorer-option", action="append", default=[], metavar="KEY=VALUE")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
    elif args.action == "list-scorers":
        print("\n".join(SCORERS.names()))
    elif args.action == "list-loaders":
        print("\n".join(LOADERS.names()))
    else:
        options = _options(args.loader_option)
        if args.data_dir is not None:
            options["data_dir"] = args.data_dir
        spark = get_spark()
        examples = LOADERS.get(args.loader)(spark, **options)
        scores = scoring.score(args.scorer, examples, **_options(args.scorer_option))
        write_csv(score_table(scores, examples), args.output)
        print(f"Wrote scores to {args.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
