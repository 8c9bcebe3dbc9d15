"""blotter: Spark-native analytics for city-incident and sensor event data.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) that stays inside Spark: no driver collection of data,
no row-at-a-time Python in the hot path.

Sub-packages
------------
sources     table bindings, CSV / text readers, sinks, model and log I/O
functions   column expressions: time parts, holiday calendar, text cleaning
operators   the analytic operators (cleaning, profiles, trends, gap fill,
            history features, outliers, geo, forecasting, ML, lookup)
plans       the registered queries and their SQL oracles
streaming   Structured Streaming form of the hourly count series
"""

from blotter.session import (CLUSTER_CONF, apply_cluster_defaults, checkpoint_dir, drop_scratch,
                             get_session, materialize)

__all__ = ["get_session", "checkpoint_dir", "materialize", "drop_scratch", "apply_cluster_defaults", "CLUSTER_CONF"]
