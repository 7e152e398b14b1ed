"""Command line: ``python -m ionweave.cli COMMAND --config FILE [--resume] [--overwrite]``."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from .errors import IonweaveError
from .plans.config import load_config, write_resolved
from .plans.pipeline import STAGES, Pipeline
from .session import build_session

COMMANDS = ("run", *STAGES)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ionweave", description="Spatial mass spectrometry on Spark")
    p.add_argument("command", choices=COMMANDS, help="run executes all stages; a stage's name executes what it needs and itself")
    p.add_argument("--config", required=True)
    p.add_argument("--resume", action="store_true", help="reuse complete stages; what a stage needs is always reused")
    p.add_argument("--overwrite", action="store_true", help="replace stages that exist")
    p.add_argument("--master")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = load_config(args.config)
        out = Path(config["project"]["output_dir"])
        out.mkdir(parents=True, exist_ok=True)
        logging.basicConfig(level=logging.INFO, handlers=[logging.StreamHandler(), logging.FileHandler(out / "run.log")], format="%(asctime)s %(levelname)s %(message)s")
        write_resolved(config, str(out / "config.resolved.yaml"))
        pipeline = Pipeline(build_session(master=args.master), config, args.overwrite, args.resume)
        if args.command == "run":
            pipeline.run()
            pipeline.finalize()
        else:
            pipeline.run(until=args.command)
    except IonweaveError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
