"""Logging: one handler on the error stream, and quiet libraries."""

from __future__ import annotations

import logging
import sys

NAME, NOISY = "quillon", ("py4j", "py4j.clientserver", "urllib3", "pyspark.sql.connect")


def configure(level: str = "INFO") -> logging.Logger:
    """Sets the library's logger up; a second call changes its level only."""
    log = logging.getLogger(NAME)
    log.setLevel(level.upper())
    if not any(h.name == NAME for h in log.handlers):
        handler = logging.StreamHandler(sys.stderr)
        handler.set_name(NAME)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s", "%H:%M:%S"))
        log.addHandler(handler)
        log.propagate = False
        for name in NOISY:
            logging.getLogger(name).setLevel(logging.WARNING)
    return log
