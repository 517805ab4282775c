"""A batch run: rows through a caller's engines, to predictions, fused lists, flags and status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravote.functions.geo import METRO_KM
from terravote.operators import fusion, scoring
from terravote.sources.shared import written

#: An engine: rows (row_id, engine, ord, level, text, post, user_posts) to one row each with row_id and whatever of city,
#: confidence, top_k, latency_ms, cost_usd, abstain, failed, reason and note it knows.
Engine = Callable[[DataFrame], DataFrame]

NO_ANSWER = "the engine gave no answer"


@dataclass
class Run:
    """Tables of a run: one row per row and engine; per row and level; per row; and the rows with their status."""

    predictions: DataFrame
    fused: DataFrame
    flags: DataFrame
    status: DataFrame


def run_batch(rows: DataFrame, places: DataFrame, roster: DataFrame, engines: dict[str, Engine], *, selected: list[str] | None = None, method: str = "weighted", radius_km: float = METRO_KM, k: int = 5) -> Run:
    """Runs every engine of ``engines`` on the rows that it can read, and fuses and compares what they say.

    rows: row_id, post, user_posts, truth_post, truth_user, error (as after ``rules.clean_inputs``).  Rows that are not ok take no
    part.  ``roster`` orders the engines, which breaks ties; one of it that ``engines`` lacks counts as not selected, and one of
    ``engines`` that it lacks is refused.  A row that an engine can't read, or is not selected for, is skipped with the
    reason; one that it was given and says nothing of has failed.  An answer that breaks the contract (``check_predictions``)
    stops the run.  Predictions are written once, for all that is made of them.
    """
    names = scoring.known_engines(list(engines), roster)
    chosen = [n for n in names if selected is None or n in selected]
    status = written(scoring.row_status(rows, places))
    ok = status.filter("status = 'ok'")
    d = scoring.dispatch(ok.select("row_id", "post", "user_posts"), roster, chosen).withColumn("text", scoring.level_text("level"))
    d = written(d.select("row_id", "engine", "ord", "level", "text", "post", "user_posts", "skip_reason"))
    out = scoring.skipped(d)
    for name in chosen:
        asked = d.filter((F.col("engine") == name) & F.col("skip_reason").isNull())
        said = engines[name](asked.drop("skip_reason")).withColumnRenamed("row_id", "__row")
        said = said.drop("engine", "ord", "level", "text", "post", "user_posts").withColumn("__said", F.lit(True))
        met = asked.select("row_id", "engine", "ord", "level").join(said, F.col("row_id") == F.col("__row"), "left").drop("__row")
        silent = F.col("__said").isNull()
        failed = silent | (F.coalesce("failed", F.lit(False)) if "failed" in met.columns else F.lit(False))
        note = F.when(silent, NO_ANSWER).otherwise(F.coalesce("note", F.lit("")) if "note" in met.columns else F.lit(""))
        filled = {c: F.coalesce(c, v) for c, v in (("confidence", F.lit(0.0)), ("abstain", F.lit(False)), ("latency_ms", F.lit(0.0)), ("cost_usd", F.lit(0.0)), ("top_k", F.array().cast(scoring.LIST))) if c in met.columns}
        out = out.unionByName(scoring.state(met.withColumns(filled), failed=failed, note=note, skipped=F.lit(False)))
    predictions = written(out)
    if bad := scoring.check_predictions(predictions).select("engine", "fault").distinct().limit(5).collect():
        raise ValueError("; ".join(sorted(f"{r['engine']}: {r['fault']}" for r in bad)))
    return Run(predictions, fusion.fuse(predictions, method, k=k), fusion.verification_flag(predictions, places, radius_km), status)
