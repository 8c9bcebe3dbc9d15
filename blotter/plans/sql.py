"""SQL text of the bound views and helpers to write oracle queries.

Oracles run on the raw tables, so each query inlines the views it uses as
common table expressions, exactly mirroring ``blotter.sources.tables``.
"""

from __future__ import annotations

VIEWS = {
    "incidents_e": (
        "SELECT event_id AS id, ts, lpad(CAST(user_id % 25 AS VARCHAR), 3, '0') AS district, "
        "event_type AS label, value AS measure FROM events"),
    "incidents_o": (
        "SELECT o_orderkey AS id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS ts, "
        "lpad(CAST(o_custkey % 5 AS VARCHAR), 3, '0') AS district, o_orderpriority AS label, "
        "o_totalprice AS measure FROM orders"),
    "readings": (
        "SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS segment, "
        "CASE WHEN l_discount = 0 THEN -1.0 ELSE l_quantity END AS speed FROM lineitem"),
    "places": "SELECT p_partkey AS place_id, p_name AS place, p_type AS ptype FROM part",
    "cells": (
        "SELECT c_custkey AS cell_id, -88.2 + (c_acctbal + 1000.0) / 11000.0 * 1.4 AS lon, "
        "41.55 + CAST(c_custkey % 997 AS DOUBLE) / 997.0 * 0.6 AS lat, c_mktsegment AS ctype "
        "FROM customer"),
}


def with_views(body: str, *views: str, ctes: str = "") -> str:
    """``WITH <views>, <ctes> <body>``; ``ctes`` is raw ``name AS (...)`` text."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in views]
    if ctes.strip():
        parts.append(ctes.strip().strip(","))
    return "WITH " + ",\n".join(parts) + "\n" + body


def finish(inner: str, dates=(), stamps=(), ints=(), doubles=()) -> str:
    """Same normalisation as :func:`blotter.plans.present.present`."""
    repl = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates]
    repl += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in stamps]
    repl += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    repl += [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in doubles]
    if not repl:
        return f"SELECT * FROM ({inner}) AS q"
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM ({inner}) AS q"
