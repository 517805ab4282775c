"""Tables as a report lists them: in its orders, with rounded text, and the document of a flag scored anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravote.functions.rounding import share_text
from terravote.functions.stats import wilson
from terravote.operators.evaluate import flag_confusion

#: Orders of the report's tables: engines by accuracy, buckets by name, places by how often they were named.
ORDERS = {"engines": [F.desc, "acc_at_1", F.asc, "engine"], "buckets": [F.asc, "bucket"], "places": [F.desc, "total", F.asc, "city"]}


def ordered(table: DataFrame, report: str) -> DataFrame:
    """Adds line, the row's place from 1 in a report's order.  A report has a row per engine, bucket or place, not per post."""
    parts = ORDERS[report]
    by = [direction(column) for direction, column in zip(parts[::2], parts[1::2])]
    return table.withColumn("line", F.row_number().over(Window.orderBy(*by)))


def interval_text(hits: Column | str, n: Column | str) -> Column:
    """A Wilson interval as [.12, .34]."""
    ci = wilson(hits, n)
    return F.concat(F.lit("["), share_text(ci["lo"]), F.lit(", "), share_text(ci["hi"]), F.lit("]"))


def flag_rescore(flags: DataFrame, rows: DataFrame, row_sets: dict[str, list[str]]) -> DataFrame:
    """One row per named set of buckets: rows, positives, the four counts, precision and recall with intervals."""
    out = None
    for name, buckets in row_sets.items():
        own = rows.filter(F.col("bucket").isin(buckets))
        c = flag_confusion(flags, own).withColumns({"row_set": F.lit(name), "buckets": F.array(*map(F.lit, buckets))})
        c = c.join(F.broadcast(own.agg(F.count("*").alias("n_rows"))), F.lit(True))
        out = c if out is None else out.unionByName(c)
    ends = {f"{m}_{e}": F.col(f"{m}_ci")[e] for m in ("precision", "recall") for e in ("lo", "hi")}
    return out.withColumns(ends).select("row_set", "buckets", "n_rows", "n_labelled", "positives", "tp", "fp", "fn", "tn", "precision", "precision_lo", "precision_hi", "recall", "recall_lo", "recall_hi")


def rescore_document(scored: DataFrame, note: str = "") -> DataFrame:
    """One row, document: the row sets as one JSON text, to be written as text."""
    sets = F.to_json(F.struct(F.lit(note).alias("note"), F.sort_array(F.collect_list(F.struct(*scored.columns))).alias("row_sets")))
    return scored.agg(sets.alias("document"))


def language_tag(rows: DataFrame, text: str = "text", detect: Callable[[Column], Column] | None = None, known: str | None = None) -> DataFrame:
    """Adds tag: the known language if there is one, else what a caller's detector says of the text, else und."""
    found = [F.col(known)] if known else []
    found += [detect(F.col(text))] if detect else []
    return rows.withColumn("tag", F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in found), F.lit("und")))
