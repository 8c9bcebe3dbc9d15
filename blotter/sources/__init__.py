"""Sources and sinks: Parquet tables, bound views, CSV / text, models, logs."""

from blotter.sources.tables import (cells_from_customer, incidents_from_events,
                                    incidents_from_orders, places_from_part,
                                    read_table, readings_from_lineitem)

__all__ = ["read_table", "incidents_from_events", "incidents_from_orders",
           "readings_from_lineitem", "places_from_part", "cells_from_customer"]
