"""The package's log, and counts of rows for it."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("polyweave")


def to(path: str | None = None, level: int = logging.INFO) -> None:
    """Send the log to the console and, if given, to a file of the driver's machine; a second call replaces the first."""
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in [logging.StreamHandler(sys.stderr), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    log.setLevel(level)


def counts(rows: DataFrame, by: tuple[str, ...] = (), **conditions: Column) -> DataFrame:
    """Rows and those that meet each condition, in one pass; a row per value of ``by``, or one."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def tell(what: str, rows: DataFrame, **conditions: Column) -> dict[str, int]:
    """Log the counts of ``rows``, and return them."""
    found = counts(rows, **conditions).first().asDict()
    log.info("%s: %s", what, ", ".join(f"{n} {v}" for n, v in found.items()))
    return found
