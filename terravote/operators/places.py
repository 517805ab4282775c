"""Joins with places: coordinates, nearest, near pairs, regions, names and history."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terravote.functions.geo import RADIUS_KM, haversine_km, within_box
from terravote.operators.celltree import DEPTH, CellTree, unit_vectors
from terravote.operators.intervals import interval_counts, interval_join
from terravote.sources.catalogue import ONBOARDED_FEATURE
from terravote.sources.shared import checked, written

KM_PER_DEGREE = math.pi * RADIUS_KM / 180


def locate(names: DataFrame, key: str, places: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Adds lat, lon, feature_type and place_id by name key; a built-in place wins over a profile of the same name."""
    own = places.select(F.col("name_key").alias("__k"), "lat", "lon", "feature_type", "place_id")
    out = names.join(checked(own), F.col(key) == F.col("__k"), "left").drop("__k")
    if profiles is not None:
        p = profiles.select(F.col("name_key").alias("__k"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.lit(True).alias("__p"))
        out = out.join(p, F.col(key) == F.col("__k"), "left")
        known = F.col("feature_type").isNotNull()
        out = out.withColumn("lat", F.when(known, F.col("lat")).otherwise(F.col("__lat"))).withColumn("lon", F.when(known, F.col("lon")).otherwise(F.col("__lon")))
        out = out.withColumn("feature_type", F.coalesce("feature_type", F.when(F.col("__p"), ONBOARDED_FEATURE))).drop("__k", "__lat", "__lon", "__p")
    return out


def distinct_places(names: DataFrame, places: DataFrame) -> DataFrame:
    """names (name, name_key, ord): one row per key with its first spelling, id and coordinates."""
    by = Window.partitionBy("name_key").orderBy("ord", "name")
    return locate(names.withColumn("r", F.row_number().over(by)).filter("r = 1").drop("r"), "name_key", places)


def _cell(lat: Column, lon: Column, size: float) -> list[Column]:
    return [F.floor(lat / size).cast("int").alias("cy"), F.floor(lon / size).cast("int").alias("cx")]


#: About as many places of one point make a block; two blocks' pairs are made within one row.
MEMBERS = 256


def pairs_within(places: DataFrame, km: float, digits: int | None = None) -> DataFrame:
    """(a_ord, a, b_ord, b, km) of all pairs of places at most km apart, a before b; km is rounded if digits are given.

    Places without names have pairs without a and b.  Places of one point are dealt to blocks.  Cells find the pairs of blocks,
    so a distance is worked out once for all places of two blocks; then each pair of blocks gives its pairs of places, copies
    of a point included, spread over all tasks however many share a point.
    """
    fields = [c for c in ("ord", "name") if c in places.columns]
    p = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*fields, "lat", "lon")
    parts = p.groupBy("lat", "lon").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = p.join(checked(written(parts)), ["lat", "lon"]).withColumn("part", F.pmod(F.xxhash64(*fields), "parts"))
    blocks = dealt.groupBy("lat", "lon", "part").agg(F.collect_list(F.struct(*fields)).alias("members"))
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()))
    near = _near_blocks(blocks.select("block", "lat", "lon", (F.size("members") > 1).alias("several")), km)
    if digits is not None:
        near = near.withColumn("km", F.round("km", digits))
    t = near.join(blocks.select(F.col("block").alias("u"), F.col("members").alias("xs")), "u")
    # The work is in the rows to be made, not in those shuffled: the number of tasks is set, so that they aren't put together.
    spark = places.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    t = t.repartition(tasks, "v").join(blocks.select(F.col("block").alias("v"), F.col("members").alias("ys")), "v")
    t = t.select("u", "v", "km", F.explode("xs").alias("x"), "ys").select("u", "v", "km", "x", F.explode("ys").alias("y"))
    x, y = F.col("x.ord"), F.col("y.ord")
    t = t.filter((x < y) | ((x > y) & (F.col("u") != F.col("v"))))
    t = t.withColumns({"a_ord": F.least(x, y), "b_ord": F.greatest(x, y)})
    if "name" in fields:
        t = t.withColumns({"a": F.when(x < y, F.col("x.name")).otherwise(F.col("y.name")), "b": F.when(x < y, F.col("y.name")).otherwise(F.col("x.name"))})
    return t.select(*(c for c in ("a_ord", "a", "b_ord", "b", "km") if c in t.columns))


def _near_blocks(blocks: DataFrame, km: float) -> DataFrame:
    """(u, v, km) of all pairs of blocks at most km apart, u before v, and of each block of several with itself.

    Cells are as high as the radius, so only neighbouring rows of cells can hold a pair; in longitude a place looks over as
    many cells as the radius spans at its latitude, around the date line too.  No cross product.
    """
    size = max(km / KM_PER_DEGREE, 1e-6)
    around = max(1, math.ceil(360 / size))
    own = blocks.select(F.col("block").alias("v"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), "several", F.floor(F.col("lat") / size).cast("int").alias("cy"), F.pmod(F.floor((F.col("lon") + 180) / size).cast("int"), F.lit(around)).alias("cx"))
    top = F.least(F.abs(F.col("lat")) + 2 * size, F.lit(89.9))
    reach = F.least(F.ceil(1 / F.cos(F.radians(top))).cast("int") + 1, F.lit((around + 1) // 2))
    seek = blocks.select(F.col("block").alias("u"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.floor(F.col("lat") / size).cast("int").alias("y"), F.floor((F.col("lon") + 180) / size).cast("int").alias("x"), reach.alias("reach"))
    seek = seek.withColumn("cy", F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)))
    seek = seek.withColumn("cx", F.explode(F.array_distinct(F.transform(F.sequence(-F.col("reach"), F.col("reach")), lambda d: F.pmod(F.col("x") + d, F.lit(around))))))
    t = seek.join(own, ["cy", "cx"]).filter((F.col("u") < F.col("v")) | ((F.col("u") == F.col("v")) & F.col("several")))
    return t.withColumn("km", haversine_km("a_lat", "a_lon", "b_lat", "b_lon")).filter(F.col("km") <= km).select("u", "v", "km")


def linked_points(places: DataFrame, km: float) -> DataFrame:
    """(a_ord, a, b_ord, b, km, same_point): pairs_within where many places may share a point.

    Places of one point are a class, known by its first place.  Pairs are those of classes; every further place has one row
    more, with the first of its point.  All pairs of places follow from these by a join, but copies aren't multiplied.
    """
    p = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    first = written(p.groupBy("lat", "lon").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name")))
    own = first.select("lat", "lon", F.col("ord").alias("a_ord"), F.col("name").alias("a"))
    more = p.join(checked(own), ["lat", "lon"]).filter(F.col("ord") > F.col("a_ord"))
    more = more.select("a_ord", "a", F.col("ord").alias("b_ord"), F.col("name").alias("b"), F.lit(0.0).alias("km"), F.lit(True).alias("same_point"))
    return pairs_within(first, km).withColumn("same_point", F.lit(False)).unionByName(more)


#: Places of a catalogue whose tree goes to every task; blocks of a larger one, of which the tree is made then.
TREE, BLOCKS = 200_000, 50_000
NEAR = "array<struct<p_ord:int,p_name:string,p_lat:double,p_lon:double>>"


def _candidates(points: DataFrame, tree_of, into: str, kind: str, exclude: str | None) -> DataFrame:
    """points with an array of what ``tree_of()`` (a tree, its names' numbers, and what an item stands for) finds to be nearest."""
    columns = points.columns
    have = points.withColumns({"__lat": F.col("lat").cast("double"), "__lon": F.col("lon").cast("double"), "__without": (F.col(exclude) if exclude else F.lit(None)).cast("string")})
    schema = ", ".join([*(f"`{c}` {t}" for c, t in points.dtypes), f"{into} {kind}"])
    arrow = to_arrow_schema(StructType.fromDDL(f"x {kind}")).field(0).type

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tree, number, item = tree_of()
        for batch in batches:
            lat, lon = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("__lat", "__lon"))
            known = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            if tree is not None and len(known):
                without = np.array([number.get(w, -1) for w in batch.column("__without").take(pa.array(known)).to_pylist()]) if exclude else None
                for k, i in zip(*(x.tolist() for x in tree.nearest(unit_vectors(lat[known], lon[known]), without))):
                    found[known[k]].append(item(i))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, arrow)], [*columns, into])

    return have.mapInArrow(run, schema)


def _located(places: DataFrame) -> DataFrame:
    fine = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    return places.filter(fine).select(F.col("ord").cast("int").alias("p_ord"), F.col("name").alias("p_name"), F.col("lat").cast("double").alias("p_lat"), F.col("lon").cast("double").alias("p_lon"))


def nearest_place(points: DataFrame, places: DataFrame, key: str = "row_id", exclude: str | None = None, tree: int = TREE) -> DataFrame:
    """Adds place and km of the nearest place, the first in catalogue order on ties; a column may name one to leave out.

    A tree of cells (``celltree``) finds the few places that are nearest up to rounding; the great-circle formula decides
    among these.  The tree of up to ``tree`` places goes to every task, so points are not shuffled; a larger catalogue is
    searched by blocks, see ``nearest_in_cells``.  Points without coordinates have no nearest place.
    """
    p = _located(places)
    rows = p.limit(tree + 1).collect()
    if len(rows) > tree:
        return nearest_in_cells(points, places, key, exclude)
    numbers = {n: i for i, n in enumerate(dict.fromkeys(r["p_name"] for r in rows))}
    table = [tuple(r) for r in rows]

    def tree_of():
        if not table:
            return None, {}, None
        at = unit_vectors([r[2] for r in table], [r[3] for r in table])
        return CellTree(at, names=[numbers[r[1]] for r in table]), numbers, lambda i: dict(zip(("p_ord", "p_name", "p_lat", "p_lon"), table[i]))

    t = _candidates(points, tree_of, "__near", NEAR, exclude)
    far = F.transform("__near", lambda x: F.struct(haversine_km(F.col("lat"), F.col("lon"), x["p_lat"], x["p_lon"]).alias("km"), x["p_ord"].alias("p_ord"), x["p_name"].alias("place")))
    return t.withColumn("__best", F.array_min(far)).select(*points.columns, "__best.place", "__best.km")


def _blocks(p: DataFrame, most: int) -> DataFrame:
    """p with block, at most about ``most`` places of a cell: dense cells are cut further, down to 6 km, then dealt out."""
    x, y, z = F.cos(F.radians("p_lat")) * F.cos(F.radians("p_lon")), F.cos(F.radians("p_lat")) * F.sin(F.radians("p_lon")), F.sin(F.radians("p_lat"))
    p = p.withColumns({"__x": x, "__y": y, "__z": z})
    cell = lambda c, level: F.floor((F.col(c) + 1) / 2 * 2**level).cast("string")
    p = written(p.withColumn("__cells", F.array(*(F.concat_ws("/", F.lit(level), *(cell(c, level) for c in ("__x", "__y", "__z"))) for level in range(0, DEPTH + 1)))))
    counted = p.select(F.explode("__cells").alias("__cell")).groupBy("__cell").count().filter(F.col("count") > most).select(F.col("__cell").alias("__full"))
    level = F.split("__full", "/")[0].cast("int")
    # The cells that are too full are a tree from the top; a place's block is the cell below the last of these it is in.
    full = p.select("p_ord", "p_name", F.explode("__cells").alias("__cell")).join(checked(counted), F.col("__cell") == F.col("__full")).groupBy("p_ord", "p_name").agg(F.max(level).alias("__level"))
    t = p.join(full, ["p_ord", "p_name"], "left")
    t = t.withColumn("block", F.element_at("__cells", F.least(F.coalesce("__level", F.lit(-1)) + 2, F.lit(DEPTH + 1)))).drop("__cells", "__level")
    # The lowest cells may still hold more: their places are dealt to several blocks of the same cell.
    over = t.groupBy("block").count().filter(F.col("count") > most).select("block", F.ceil(F.col("count") / most).alias("__parts"))
    part = F.pmod(F.xxhash64("p_ord", "p_name"), F.col("__parts")).cast("string")
    return t.join(checked(over), "block", "left").withColumn("block", F.concat_ws("/", "block", part)).drop("__parts")


def nearest_in_cells(points: DataFrame, places: DataFrame, key: str = "row_id", exclude: str | None = None, blocks: int = BLOCKS, size: int = 256) -> DataFrame:
    """nearest_place for a catalogue of any size: a tree of its blocks finds the blocks that can hold the nearest place.

    Places are dealt to cells of about ``size`` of them (more, where they would be more than ``blocks`` cells); a cell is known by its box and by two of its places, of different names.  The tree
    of these goes to every task and finds for each point the one block or few whose boxes are not farther off than the
    nearest place named; only these are joined, by an equality on the block.  A block is one row with a list of its places,
    and the best of a list is found within the row: a point isn't multiplied by places, and only one that meets several
    blocks is grouped.
    """
    p = _located(places)
    # Of places at one spot (and of one name, where names can be left out) only the first can be an answer.
    p = p.groupBy("p_lat", "p_lon", *(["p_name"] if exclude else [])).agg(F.min(F.struct("p_ord", "p_name")).alias("__first")).select("__first.p_ord", "__first.p_name", "p_lat", "p_lon")
    n = p.count()
    p = written(_blocks(p, max(size, -(-4 * n // blocks))))
    axes = ("__x", "__y", "__z")
    named = p.groupBy("block", "p_name").agg(F.min(F.struct("p_ord", *axes)).alias("one"), *(f(c).alias(f"{o}{c}") for c in axes for o, f in (("lo", F.min), ("hi", F.max))))
    box = named.groupBy("block").agg(F.slice(F.array_sort(F.collect_set(F.struct("p_name", "one"))), 1, 2).alias("two"), *(f(f"{o}{c}").alias(f"{o}{c}") for c in axes for o, f in (("lo", F.min), ("hi", F.max)))) if exclude else p.groupBy("block").agg(F.array(F.min(F.struct("p_name", F.struct("p_ord", *axes).alias("one")))).alias("two"), *(f(c).alias(f"{o}{c}") for c in axes for o, f in (("lo", F.min), ("hi", F.max))))
    rows = [(r["block"], one["p_name"], [one["one"][c] for c in axes], [r[f"lo{c}"] for c in axes], [r[f"hi{c}"] for c in axes]) for r in box.collect() for one in r["two"]]
    numbers = {m: i for i, m in enumerate(dict.fromkeys(r[1] for r in rows))}

    def tree_of():
        import numpy as np

        if not rows:
            return None, {}, None
        at, lo, hi = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
        # A block's own name may be the one left out: its box counts all the same, so names only bound from above.
        tree = CellTree(at, lo, hi, [numbers[r[1]] for r in rows])
        return _Boxes(tree), numbers, lambda i: rows[i][0]

    met = written(_candidates(points.withColumn("__i", F.monotonically_increasing_id()), tree_of, "__blocks", "array<string>", exclude).withColumn("__blocks", F.array_distinct("__blocks")))
    lists = p.groupBy("block").agg(F.collect_list(F.struct(*axes, "p_ord", "p_name", "p_lat", "p_lon")).alias("__list"))
    lists = F.broadcast(lists) if n <= TREE else lists
    one, many = F.size("__blocks") <= 1, met.filter(F.size("__blocks") > 1)
    single = _best_of_list(met.filter(one).withColumn("block", F.get("__blocks", F.lit(0))).join(lists, "block", "left"), exclude)
    each = many.select("__i", "lat", "lon", *([exclude] if exclude and exclude not in ("lat", "lon") else []), F.explode("__blocks").alias("block")).join(lists, "block")
    # Dealt by the key first: else each task would sort all that it has read before it sends anything.
    best = _best_of_list(each, exclude).select("__i", "__best").repartition("__i").groupBy("__i").agg(F.min("__best").alias("__best"))
    columns = [*points.columns, "__best.place", "__best.km"]
    return single.select(columns).unionByName(many.join(best, "__i", "left").select(columns))


#: By how much the cosines of two angles may differ by rounding, many times over: about 3 m at a short distance.
COSINE_SLACK = 1e-13


def _best_of_list(t: DataFrame, exclude: str | None) -> DataFrame:
    """t (lat, lon, __list) with __best, (km, p_ord, place) of the nearest of the list.

    Cosines of the angles, a few products each, leave those few that are nearest up to rounding; the great-circle formula
    decides among these.  What is the same for a whole list is passed in an array of one, or it would be made for each place.
    """
    if exclude:
        t = t.withColumn("__list", F.filter("__list", lambda p: ~F.coalesce(p["p_name"] == F.col(exclude), F.lit(False))))
    p, l = F.radians(F.col("lat").cast("double")), F.radians(F.col("lon").cast("double"))  # noqa: E741
    at = F.array(F.struct((F.cos(p) * F.cos(l)).alias("__x"), (F.cos(p) * F.sin(l)).alias("__y"), F.sin(p).alias("__z")))
    t = t.withColumn("__cosines", F.get(F.transform(at, lambda q: F.transform("__list", lambda x: x["__x"] * q["__x"] + x["__y"] * q["__y"] + x["__z"] * q["__z"])), F.lit(0)))
    near = lambda top: F.filter("__list", lambda x, i: F.get("__cosines", i) >= top - COSINE_SLACK)
    far = lambda x: F.struct(haversine_km(F.col("lat"), F.col("lon"), x["p_lat"], x["p_lon"]).alias("km"), x["p_ord"].alias("p_ord"), x["p_name"].alias("place"))
    best = F.get(F.transform(F.array(F.array_max("__cosines")), lambda top: F.array_min(F.transform(near(top), far))), F.lit(0))
    return t.withColumn("__best", best)


class _Boxes:
    """A tree of boxes, of which a name left out only bars the place that bounds from above, not the box."""

    def __init__(self, tree: CellTree):
        self.tree = tree

    def nearest(self, points, without=None):
        return self.tree.nearest(points, without, boxes=True)


def near_duplicates(candidates: DataFrame, places: DataFrame, km: float = 1.0) -> DataFrame:
    """Candidates whose centroid lies at most km from a place of another name."""
    return nearest_place(candidates, places, "name", exclude="name").filter(F.col("km") <= km)


def region_faults(candidates: DataFrame, aliases: DataFrame, boxes: DataFrame) -> DataFrame:
    """(name, country, inside): the country that a region hint names, first segment first, and whether the centroid is in it."""
    hint = F.trim(F.regexp_replace("region", r"\s+", " "))
    parts = F.reverse(F.filter(F.transform(F.split(hint, "[,/|]"), lambda s: F.btrim(s, F.lit(" ."))), lambda s: s != ""))
    t = candidates.filter(hint != "").select("name", "lat", "lon", F.posexplode(F.concat(F.array(hint), parts)).alias("pos", "part"))
    t = t.join(checked(aliases), F.lower("part") == F.col("alias"))
    first = t.groupBy("name", "lat", "lon").agg(F.min_by("country", "pos").alias("country"))
    return first.join(checked(boxes), "country").select("name", "country", within_box("lat", "lon").alias("inside"))


def same_name(candidates: DataFrame, places: DataFrame, key: str = "name_key") -> DataFrame:
    """Candidates with the first place that shares a key (name key, or look-alike key)."""
    return candidates.join(places.select(F.col(key).alias("__k"), F.col("ord").alias("p_ord"), F.col("name").alias("p_name")), F.col(key) == F.col("__k")).groupBy(candidates["name"]).agg(F.min_by("p_name", "p_ord").alias("place"))


def swallowed(candidates: DataFrame, places: DataFrame, most: int = 2) -> DataFrame:
    """(name, place): candidates that hold a place's words without extending it by up to two words at an end."""
    words = lambda c: F.split(F.trim(F.lower(c)), r"\s+")
    p = places.select(F.col("ord").alias("p_ord"), F.col("name").alias("p_name"), F.array_join(words("name"), " ").alias("run"), F.size(words("name")).alias("n"))
    t = candidates.withColumn("w", words("name")).withColumn("len", F.size("w"))
    t = t.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("len")))).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("from") + 1)))
    t = t.withColumn("run", F.array_join(F.slice("w", F.col("from"), F.col("n")), " "))
    met = t.join(checked(p), ["run", "n"]).filter(F.lower(F.col("name")) != F.lower(F.col("p_name")))
    edge = (F.col("from") == 1) | (F.col("from") + F.col("n") - 1 == F.col("len"))
    each = met.groupBy("name", "p_ord", "p_name").agg(F.bool_or(edge & (F.col("len") - F.col("n") <= most)).alias("extends"))
    return each.filter(~F.col("extends")).groupBy("name").agg(F.min_by("p_name", "p_ord").alias("place"))


def stale_profiles(stored: DataFrame, live: DataFrame) -> DataFrame:
    return stored.join(live.select("place_id"), "place_id", "left_anti")


def missing_builtin(builtin: DataFrame, present: DataFrame) -> DataFrame:
    return builtin.join(present.select("name_key"), "name_key", "left_anti")


def as_of(requests: DataFrame, history: DataFrame) -> DataFrame:
    """requests (request_id, catalogue_id, ts) with the places valid at ts: valid_from <= ts < valid_to."""
    return interval_join(requests, history, "catalogue_id", "ts", "valid_from", "valid_to")


def sizes_as_of(requests: DataFrame, history: DataFrame) -> DataFrame:
    """requests with n, how many places their catalogue held at ts."""
    return interval_counts(requests, history, "catalogue_id", "ts", "valid_from", "valid_to")
