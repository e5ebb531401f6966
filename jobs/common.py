"""What the jobs share: settings, logging, the command line."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from tallyweave.sources.artifacts import read_json


def merged(defaults: dict, given: dict) -> dict:
    """``defaults`` with the given settings; an unknown name raises."""
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def main(run: Callable[..., None], name: str, paths: list[str], about: str, argv: list[str] | None = None) -> None:
    """The command line of a job: ``paths`` in order, then the settings file; makes a session and stops it."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    for path in paths:
        parser.add_argument(path)
    parser.add_argument("config", help="a JSON file of settings, at any path that Spark can read")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = args.config if "://" in args.config else f"file://{os.path.abspath(args.config)}"
        run(spark, *(getattr(args, p) for p in paths), read_json(spark, config))
    finally:
        spark.stop()
