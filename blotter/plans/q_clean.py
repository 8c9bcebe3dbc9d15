"""Registered queries: filters, audits, null handling, dedupe, names, sampling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from blotter.functions.text import clean_name, parse_vector_text, vector_text
from blotter.operators import clean as CL
from blotter.operators import labels as L
from blotter.plans.registry import register
from blotter.plans.sql import finish, with_views
from blotter.sources import tables as S

# The city box and the valid longitude band of the reference.
CITY_BOX = dict(lat_lo=41.6, lat_hi=42.1, lon_lo=-87.9, lon_hi=-87.55)
LON_BAND = (-88.0, -87.0)
PLACE_SHARE = 0.015          # places binding: 64 names of ~1.6 % each
PLACE_MIN_COUNT = 30
SAMPLE_FRACTIONS = {"click": 0.05, "error": 0.02, "purchase": 0.05, "signup": 0.02, "view": 0.05}


@register("exclude_and_range_filter", sql=finish(with_views("""
SELECT id, district, label, ts FROM incidents_e
WHERE district NOT IN ('021', '031') AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'""",
    "incidents_e"), stamps=("ts",), doubles=()))
def exclude_and_range_filter(spark, sf):
    """P4 + P6: excluded districts removed, then a two-week time range."""
    inc = CL.exclude_values(S.incidents_from_events(spark, sf), "district")
    return CL.time_range(inc, "ts", dt.date(2024, 1, 8), dt.date(2024, 1, 22)).select(
        "id", "district", "label", "ts")


@register("bbox_filter", sql=finish(with_views("""
SELECT cell_id, lon, lat FROM cells
WHERE lat > 41.6 AND lat < 42.1 AND lon > -87.9 AND lon < -87.55""", "cells"), doubles=("lon", "lat")))
def bbox_filter(spark, sf):
    """Points strictly inside the city box."""
    return CL.bbox(S.cells_from_customer(spark, sf), "lat", "lon", **CITY_BOX).select("cell_id", "lon", "lat")


@register("coordinate_range_audit", sql=finish(with_views("""
SELECT lon, count(*) AS n FROM cells WHERE lon < -88.0 OR lon > -87.0 GROUP BY lon""", "cells"),
    doubles=("lon",)))
def coordinate_range_audit(spark, sf):
    """Longitudes outside the valid band, with their frequency."""
    return CL.out_of_range_values(S.cells_from_customer(spark, sf), "lon", *LON_BAND)


@register("sentinel_filter", sql=finish(with_views(
    "SELECT day, segment, speed FROM readings WHERE speed <> -1", "readings"),
    dates=("day",), doubles=("speed",)))
def sentinel_filter(spark, sf):
    """Readings without the -1 missing sentinel."""
    return CL.drop_sentinel(S.readings_from_lineitem(spark, sf), "speed", -1)


def _nulled(spark, sf):
    inc = S.incidents_from_events(spark, sf)
    return inc.select("id", "ts", F.nullif("district", F.lit("007")).alias("district"),
                      F.nullif("label", F.lit("view")).alias("label"),
                      F.when(F.col("measure") > 400, F.lit(None).cast("double"))
                      .otherwise(F.col("measure")).alias("measure"))


_NULLED_SQL = """nulled AS (SELECT id, ts, nullif(district, '007') AS district, nullif(label, 'view') AS label,
       CASE WHEN measure > 400 THEN NULL ELSE measure END AS measure FROM incidents_e)"""


@register("null_audit", sql=finish(with_views("""
SELECT count(*) FILTER (WHERE id IS NULL) AS id, count(*) FILTER (WHERE district IS NULL) AS district,
       count(*) FILTER (WHERE label IS NULL) AS label,
       count(*) FILTER (WHERE measure IS NULL OR isnan(measure)) AS measure FROM nulled""",
    "incidents_e", ctes=_NULLED_SQL)))
def null_audit(spark, sf):
    """Null / NaN count per column (timestamp column skipped)."""
    return CL.null_audit(_nulled(spark, sf))


@register("drop_null_rows", sql=finish(with_views("""
SELECT * FROM nulled WHERE id IS NOT NULL AND ts IS NOT NULL AND district IS NOT NULL
  AND label IS NOT NULL AND measure IS NOT NULL""", "incidents_e", ctes=_NULLED_SQL),
    stamps=("ts",), doubles=("measure",)))
def drop_null_rows(spark, sf):
    """P10: rows with any null removed."""
    return CL.drop_nulls(_nulled(spark, sf))


@register("dedupe_latest", sql=finish(with_views("""
SELECT id, ts, district, label, measure FROM incidents_e
QUALIFY row_number() OVER (PARTITION BY district, label ORDER BY ts DESC, id DESC, measure DESC) = 1""",
    "incidents_e"), stamps=("ts",), doubles=("measure",)))
def dedupe_latest(spark, sf):
    """P12 + J5: the latest incident per (district, label), deterministic ties."""
    return CL.latest_per_group(S.incidents_from_events(spark, sf), ["district", "label"], "ts")


@register("dedupe_rows", sql=finish(with_views(
    "SELECT DISTINCT district, label, CAST(ts AS DATE) AS day FROM incidents_e", "incidents_e"),
    dates=("day",)))
def dedupe_rows(spark, sf):
    """Whole-row duplicates removed from (district, label, day)."""
    inc = S.incidents_from_events(spark, sf)
    return CL.dedupe(inc.select("district", "label", F.to_date("ts").alias("day")))


@register("clean_names", sql=finish(with_views("""
SELECT place_id, raw, trim(regexp_replace(regexp_replace(regexp_replace(raw, '[/\\-]', ' ', 'g'),
       '[().]', '', 'g'), '\\s+', ' ', 'g')) AS clean
FROM (SELECT place_id, place || ' / ' || ptype || ' (no. ' || CAST(place_id AS VARCHAR) || ') - x.' AS raw
      FROM places) p""", "places")))
def clean_names(spark, sf):
    """Category text made usable as a column name."""
    pl = S.places_from_part(spark, sf)
    raw = F.concat("place", F.lit(" / "), "ptype", F.lit(" (no. "), F.col("place_id").cast("string"),
                   F.lit(") - x."))
    return pl.select("place_id", raw.alias("raw")).withColumn("clean", clean_name("raw"))


@register("parse_vector_text", sql=finish("""
SELECT vec_id, idx - 1 AS idx, e[idx] AS value
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, unnest(range(1, len(embedding) + 1)) AS idx
      FROM embeddings) x""", ints=("idx",), doubles=("value",)))
def parse_vector_text_q(spark, sf):
    """Vectors stored as '[a,b,...]' text read back as arrays."""
    emb = S.read_table(spark, sf, "embeddings")
    txt = emb.select("vec_id", vector_text(F.col("embedding").cast("array<double>")).alias("txt"))
    return txt.select("vec_id", F.posexplode(parse_vector_text("txt")).alias("idx", "value"))


_KEPT = """c AS (SELECT place, count(*) AS n FROM places GROUP BY place),
kept AS (SELECT place FROM (SELECT place, n, CAST(n AS DOUBLE) / sum(n) OVER () AS share FROM c) s
         WHERE {cond})"""
_COLLAPSE = f"""SELECT place_id, CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.place IS NOT DISTINCT FROM p.place)
                   THEN p.place ELSE '{L.OTHER_PLACES}' END AS place FROM places p"""


@register("rare_label_share", sql=finish(with_views(
    _COLLAPSE, "places", ctes=_KEPT.format(cond=f"share >= {PLACE_SHARE}"))))
def rare_label_share(spark, sf):
    """Places below a share of all rows become OTHER LOCATIONS."""
    pl = S.places_from_part(spark, sf)
    return L.collapse_rare_by_share(pl, "place", PLACE_SHARE, L.OTHER_PLACES).select("place_id", "place")


@register("rare_label_count", sql=finish(with_views(
    _COLLAPSE, "places", ctes=_KEPT.format(cond=f"n >= {PLACE_MIN_COUNT}"))))
def rare_label_count(spark, sf):
    """Places with fewer rows than a minimum count become OTHER LOCATIONS."""
    pl = S.places_from_part(spark, sf)
    return L.collapse_rare_by_count(pl, "place", PLACE_MIN_COUNT, L.OTHER_PLACES).select("place_id", "place")


_FRACTION_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SAMPLE_FRACTIONS.items()) + " ELSE 0.0 END"


@register("stratified_sample", sql=finish(with_views(f"""
SELECT id, label FROM incidents_e
WHERE CAST('0x' || substr(md5('42:' || id), 1, 8) AS BIGINT) / 4294967296.0 < ({_FRACTION_SQL})""",
    "incidents_e")))
def stratified_sample(spark, sf):
    """Per-label fractions, deterministic hash sampling (seed 42)."""
    inc = S.incidents_from_events(spark, sf)
    return CL.stratified_sample(inc, "label", SAMPLE_FRACTIONS, "id", 42).select("id", "label")


@register("district_subset", sql=finish(with_views(
    "SELECT id, ts, district, label, measure FROM incidents_e WHERE district = '011'", "incidents_e"),
    stamps=("ts",), doubles=("measure",)))
def district_subset(spark, sf):
    """P5: the one-district subset (the reference's district-11 extract)."""
    return CL.equals(S.incidents_from_events(spark, sf), "district", "011")


@register("table_counts", sql=finish(with_views("""
SELECT 'incidents_e' AS view, count(*) AS n FROM incidents_e UNION ALL
SELECT 'incidents_o', count(*) FROM incidents_o UNION ALL
SELECT 'readings', count(*) FROM readings UNION ALL
SELECT 'places', count(*) FROM places UNION ALL
SELECT 'cells', count(*) FROM cells""", "incidents_e", "incidents_o", "readings", "places", "cells")))
def table_counts(spark, sf):
    """A1: row count of every bound view (one aggregate per scan)."""
    views = {"incidents_e": S.incidents_from_events, "incidents_o": S.incidents_from_orders,
             "readings": S.readings_from_lineitem, "places": S.places_from_part,
             "cells": S.cells_from_customer}
    parts = [fn(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("view"), "n")
             for name, fn in views.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("fill_zero", sql=finish(with_views(
    "SELECT segment, day, coalesce(nullif(speed, -1), 0) AS speed FROM readings", "readings"), dates=("day",), doubles=("speed",)))
def fill_zero(spark, sf):
    """Missing readings as 0."""
    rows = S.readings_from_lineitem(spark, sf).withColumn("speed", F.nullif("speed", F.lit(-1.0)))
    return CL.fill_zero(rows, ["speed"]).select("segment", "day", "speed")
