"""The helper functions callable from SQL text: temporary SQL functions, which the optimiser expands like any expression.

``register(spark)`` makes haversine_km, within_km, wilson_interval, recall_ratio, name_key, place_name_key, place_id and
latency_text known to ``spark.sql``.  Filters on other columns pass them, as nothing is opaque but the Unicode forms.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from terravote.functions.geo import METRO_KM, RADIUS_KM
from terravote.functions.stats import Z
from terravote.functions.text import LOOKALIKES, _compatible_key, _name_key

H = "pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)"
CENTRE, HALF = f"(h / n + {Z * Z}D / (2 * n)) / (1 + {Z * Z}D / n)", f"{Z}D * sqrt(h / n * (1 - h / n) / n + {Z * Z}D / (4 * n * n)) / (1 + {Z * Z}D / n)"

FUNCTIONS = {
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": f"{2 * RADIUS_KM}D * asin(sqrt(CASE WHEN {H} > 1 THEN 1D ELSE {H} END))",
    "within_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, km DOUBLE DEFAULT {}) RETURNS BOOLEAN".format(METRO_KM): "haversine_km(lat1, lon1, lat2, lon2) <= km",
    "wilson_interval(h DOUBLE, n DOUBLE) RETURNS STRUCT<lo: DOUBLE, hi: DOUBLE>": f"named_struct('lo', CASE WHEN n <= 0 OR h <= 0 THEN 0D ELSE greatest(0D, {CENTRE} - {HALF}) END, 'hi', CASE WHEN n <= 0 THEN 0D WHEN h >= n THEN 1D ELSE least(1D, {CENTRE} + {HALF}) END)",
    "recall_ratio(part DOUBLE, whole DOUBLE) RETURNS DOUBLE": "coalesce(try_divide(part, whole), 0D)",
    "name_key(name STRING) RETURNS STRING": "terravote_name_key(name)",
    "place_name_key(name STRING) RETURNS STRING": "translate(terravote_compatible_key(name), '{}', '{}')".format(*(x.replace("'", "\\'") for x in LOOKALIKES)),
    "place_id(key STRING) RETURNS STRING": "concat('pl_', substring(sha2(key, 256), 1, 12))",
    "latency_text(ms DOUBLE) RETURNS STRING": "CASE WHEN ms >= 1000 THEN format_string('%.2f s', ms / 1000) ELSE format_string('%.0f ms', ms) END",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to this session; again is no harm."""
    for name, function in (("terravote_name_key", _name_key), ("terravote_compatible_key", _compatible_key)):
        spark.udf.register(name, function)
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
