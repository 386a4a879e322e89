"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from tidemill.plans.registry import ORACLES, QUERIES


def load_all() -> None:
    from tidemill.plans import evaluation, learning, partitions, samples, series, storage, tables  # noqa: F401


__all__ = ["ORACLES", "QUERIES", "load_all"]
