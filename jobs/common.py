"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def main(run: Callable, about: str, paths: list[str], settings: dict[str, str] | None = None) -> None:
    """Parse one option per path and --config, start a session with ``settings``, run, stop it."""
    parser = argparse.ArgumentParser(description=about)
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", required=True, help="a JSON file of options")
    args = vars(parser.parse_args())
    config = json.loads(Path(args.pop("config")).read_text())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(run.__module__)
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        run(spark, **args, **config)
    finally:
        spark.stop()
