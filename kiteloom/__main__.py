"""Command line: ``python -m kiteloom prepare|resume|generate|report|dashboard|preflight``."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from functools import partial
from typing import Any

from kiteloom.control import config
from kiteloom.control.run import Layout, logger, preflight
from kiteloom.sources.sinks import write_json


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kiteloom")
    commands = top.add_subparsers(dest="command", required=True)
    prepare = commands.add_parser("prepare", help="clean, split and freeze a parallel corpus")
    prepare.add_argument("--data", help="raw file, in place of the settings'")
    prepare.add_argument("--rng", choices=("reference", "hash", "ranges"), default="reference")
    report = commands.add_parser("report", help="score all systems with a store")
    report.add_argument("--allow-partial", action="store_true")
    show = commands.add_parser("dashboard", help="write a page about a run")
    show.add_argument("--run-dir", required=True)
    show.add_argument("--output", required=True)
    show.add_argument("--max-sentences", type=int)
    check = commands.add_parser("preflight", help="check the environment")
    check.add_argument("--require-data", action="store_true")
    make = commands.add_parser("generate", help="translate the test sample with one system")
    make.add_argument("--system", required=True)
    make.add_argument("--translator", required=True, help="module:function; called on executors with the limit of new tokens, returns a function from texts to (translation, hit the limit)")
    make.add_argument("--adapter", help="folder of the adapter the system uses")
    make.add_argument("--limit", type=int, help="only the first rows of the sample, this time")
    make.add_argument("--batch-size", type=int, default=8)
    make.add_argument("--max-new-tokens", type=int, default=256)
    again = commands.add_parser("resume", help="say from which checkpoint a training run goes on")
    again.add_argument("--extend", action="store_true", help="permit a larger number of steps than the run began with")
    for command in (prepare, make, report, check, again):
        command.add_argument("--config", required=True)
    return top


def named(place: str) -> Callable[..., Any]:
    """The function that ``module:function`` names."""
    module, _, name = place.partition(":")
    found = getattr(importlib.import_module(module), name, None) if name else None
    if not callable(found):
        raise ValueError(f"not a function: {place!r}; give module:function")
    return found


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("kiteloom").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    log = logger()
    try:
        if args.command == "dashboard":
            from kiteloom.plans.report import dashboard

            dashboard(session(), args.run_dir, args.output, most=args.max_sentences)
            return 0
        settings = config.load(args.config)
        layout = Layout(settings)
        logger(layout.logs / "pipeline.log")
        if args.command == "preflight":
            found = preflight(settings, layout, args.require_data)
            write_json(found, layout.report("preflight.json"))
            for check in found["checks"]:
                log.info("%(status)s %(name)s: %(message)s", check)
            return 0 if found["ready"] else 1
        if args.command == "prepare":
            from kiteloom.plans.prepare import prepare

            prepare(session(), settings, args.data, args.rng)
            return 0
        if args.command == "resume":
            from kiteloom.plans.resume import resume

            found = resume(settings, args.extend)
            write_json(found, layout.report("resume.json"))
            log.info("%(action)s at step %(global_step)s of %(max_steps)s, checkpoint %(checkpoint)s", found)
            return 0
        if args.command == "generate":
            from kiteloom.plans.report import generate

            make = partial(named(args.translator), args.max_new_tokens)
            left = generate(session(), settings, args.system, make, args.limit, args.batch_size, args.max_new_tokens, args.adapter)
            log.info("%s: %d records of the sample are left", args.system, left)
            return 0
        from kiteloom.plans.report import report

        report(session(), settings, args.allow_partial)
        return 0
    except Exception as error:
        log.error("%s: %s", type(error).__name__, error)
        return 1


if __name__ == "__main__":
    sys.exit(main())
