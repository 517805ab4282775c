"""A batch run over a caller's engines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terravote.operators import runner, scoring
from terravote.sources.catalogue import builtin_places, roster

ROWS = "row_id string, post string, user_posts array<string>, truth_post string, truth_user string, error string"


def _rows(spark):
    return spark.createDataFrame([("a", "to Tokyo", ["in Paris", "x"], "tokyo", None, None), ("b", None, ["only a timeline"], "Tokyo", None, None), ("c", "gone", None, "Atlantis", None, None), ("d", "bad", None, None, None, "id is missing"), ("e", "silent", None, "Tokyo", None, None)], ROWS)


def _always(city):
    one = F.array(F.struct(F.lit(city).alias("place"), F.lit(0.9).alias("score"))).cast(scoring.LIST)
    return lambda rows: rows.filter("row_id != 'e'").select("row_id", F.lit(city).alias("city"), F.lit(0.9).alias("confidence"), one.alias("top_k"))


def test_a_run_of_any_roster(spark):
    r = roster(spark, [("one", "post", False, 1.0), ("two", "user", False, 1.0), ("other", "post", True, 1.0)])
    run = runner.run_batch(_rows(spark), builtin_places(spark), r, {"one": _always("Tokyo"), "two": _always("Singapore")})
    p = {(x.row_id, x.engine): x for x in run.predictions.collect()}
    assert set(p) == {(i, e) for i in "abe" for e in ("one", "two", "other")}
    assert p["a", "one"].city == "Tokyo" and p["a", "two"].city == "Singapore" and p["b", "two"].city == "Singapore"
    assert (p["b", "one"].skipped, p["b", "one"].reason) == (True, "no post") and p["a", "other"].reason == "not selected" and p["e", "two"].reason == "no timeline"
    assert p["e", "one"].failed and p["e", "one"].note == runner.NO_ANSWER and p["e", "one"].top_k == []
    assert {(x.row_id, x.level): x.consensus_city for x in run.fused.collect()} == {("a", "post"): "Tokyo", ("a", "user"): "Singapore", ("b", "user"): "Singapore"}
    assert {x.row_id: x.flag for x in run.flags.collect()} == {"a": True, "b": False, "e": False}
    assert {x.row_id: x.status for x in run.status.collect()} == {"a": "ok", "b": "ok", "c": "ooc", "d": "error", "e": "ok"}
    some = runner.run_batch(_rows(spark), builtin_places(spark), r, {"one": _always("Tokyo"), "two": _always("Singapore")}, selected=["two"])
    assert some.predictions.filter("engine = 'one' and reason = 'not selected'").count() == 3


def test_unknown_engines_and_broken_contracts_are_refused(spark):
    r = roster(spark, [("one", "post", False, 1.0)])
    with pytest.raises(ValueError, match="unknown engines: none"):
        runner.run_batch(_rows(spark), builtin_places(spark), r, {"none": _always("Tokyo")})
    with pytest.raises(ValueError, match="one: confidence out of range"):
        runner.run_batch(_rows(spark), builtin_places(spark), r, {"one": lambda rows: rows.select("row_id", F.lit("Tokyo").alias("city"), F.lit(7.0).alias("confidence"))})
