"""What the jobs share: settings read through Spark, logging, the command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from ionweave.errors import ConfigError
from ionweave.session import build_session

log = logging.getLogger("jobs")


def load_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """``defaults`` with the settings of the JSON file at ``path``; unknown names are refused."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        given = json.loads(text)
    except ValueError as error:
        raise ConfigError(f"{path} is not JSON: {error}") from None
    if not isinstance(given, dict) or (unknown := sorted(set(given) - set(defaults))):
        raise ConfigError(f"{path} must be an object with names among {sorted(defaults)}" + (f", not {unknown}" if isinstance(given, dict) else ""))
    return defaults | given


def main(run: Callable, defaults: dict, paths: dict[str, str], description: str | None, argv: list[str] | None = None) -> None:
    """Command line of a job: ``run(spark, config=..., **paths)`` in a session of its own."""
    parser = argparse.ArgumentParser(description=(description or "").strip().split("\n")[0])
    parser.add_argument("--config", help="JSON file of settings; those left out keep their defaults")
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    given = vars(parser.parse_args(argv))
    logging.basicConfig(stream=sys.stderr, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    log.setLevel(logging.INFO)
    spark = build_session(run.__name__)
    try:
        config = given.pop("config")
        run(spark, config=load_config(spark, config, defaults) if config else defaults, **given)
    finally:
        spark.stop()
