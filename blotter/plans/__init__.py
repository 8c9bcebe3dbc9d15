"""Registered queries (``queries()``) and their SQL oracles (``oracle_sql()``)."""

from blotter.plans.registry import ORACLES, QUERIES, load_all


def queries():
    load_all()
    return dict(QUERIES)


def oracle_sql():
    load_all()
    return {k: v for k, v in ORACLES.items() if k in QUERIES}


__all__ = ["queries", "oracle_sql"]
