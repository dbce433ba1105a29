"""Settings: tolerances, how strictly identities match, log level, bytes read by a task. A setting can be held for a block only."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

_DEFAULTS = {"atol": 2.220446049250313e-16, "rtol": 2.220446049250313e-16, "relaxed_identities": False, "bounds_combination_mode": "and", "display_data": True, "log_level": "WARN", "chunksize": 128 << 20, "tempdir": None, "regrid_logging": False}
_settings = dict(_DEFAULTS)


def get(name: str):
    return _settings[name]


def configure(**changes) -> dict:
    """Set settings and return what they were."""
    unknown = set(changes) - set(_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    if str(changes.get("log_level", "WARN")).upper() not in ("DISABLE", "OFF", "ERROR", "WARN", "WARNING", "INFO", "DEBUG"):
        raise ValueError("log_level is one of OFF, ERROR, WARN, INFO, DEBUG")
    if str(changes.get("bounds_combination_mode", "and")).lower() not in ("and", "or", "xor", "none"):
        raise ValueError("bounds_combination_mode is one of and, or, xor, none")
    old = {k: _settings[k] for k in changes}
    _settings.update(changes)
    return old


@contextmanager
def configuration(**changes) -> Iterator[None]:
    old = configure(**changes)
    try:
        yield
    finally:
        _settings.update(old)


def apply_to(spark) -> None:
    """Hand the settings that are Spark's own to a session: bytes of a scan's partition and the log level."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(int(_settings["chunksize"])))
    level = str(_settings["log_level"]).upper()
    spark.sparkContext.setLogLevel({"DISABLE": "OFF", "WARNING": "WARN"}.get(level, level))


def of_fraction(fraction: float, most: int) -> int:
    """A share of a number of bytes, for chunksize: between 0 and 1."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction lies between 0 and 1")
    return int(fraction * most)
