"""What all jobs share: their command line, config file and log."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

log = logging.getLogger("shelf.jobs")


def settings(description: str, default: Path, argv: list[str] | None = None) -> dict:
    """The config file's values; each can be given on the command line instead (--input PATH, ...)."""
    known = json.loads(default.read_text())
    p = argparse.ArgumentParser(description=description)
    p.add_argument("--config", type=Path, default=default, help="JSON file of values (default: %(default)s)")
    for name, value in known.items():
        p.add_argument(f"--{name.replace('_', '-')}", dest=name, type=int if isinstance(value, int) else str, default=None)
    given = vars(p.parse_args(argv))
    values = known | json.loads(given.pop("config").read_text()) | {k: v for k, v in given.items() if v is not None}
    if unknown := values.keys() - known.keys():
        p.error(f"unknown values in the config file: {', '.join(sorted(unknown))}")
    if missing := [k for k, v in values.items() if v == ""]:
        p.error(f"a value is needed for {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return values
