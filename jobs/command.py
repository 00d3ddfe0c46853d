"""What the command lines share: settings from a small JSON file and from arguments, a log, and a session."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings(about: str, names: dict[str, str], argv: list[str] | None = None) -> dict:
    """The settings called ``names`` (name -> help): from the file that --config names, then from arguments."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="JSON file of settings on the machine that runs the command")
    for name, text in names.items():
        parser.add_argument(f"--{name.replace('_', '-')}", dest=name, help=text)
    given = vars(parser.parse_args(argv))
    held = {}
    if path := given.pop("config"):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    if unknown := held.keys() - names.keys():
        parser.error(f"{path} has unknown settings: {', '.join(sorted(unknown))}")
    held |= {k: v for k, v in given.items() if v is not None}
    return held


def main(run: Callable[..., dict], about: str, names: dict[str, str], argv: list[str] | None = None) -> None:
    """Runs a job in a session of its own, which only a command line creates and stops."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # local workers import the library from here; a cluster gets it with --py-files
    os.environ["PYTHONPATH"] = os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])
    held = settings(about, names, argv)
    spark = SparkSession.builder.appName(run.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        log.info("done: %s", json.dumps(run(spark, **held)))
    finally:
        spark.stop()
