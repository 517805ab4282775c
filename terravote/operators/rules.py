"""Data-quality rules for input rows and for candidate places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravote.functions.geo import coordinate_faults
from terravote.functions.text import boolean_cell, clean_truth, disallowed_characters, mixed_script_words, normalise_place_name, normalise_text, words
from terravote.operators.places import near_duplicates, region_faults

# Bounds of input rows, names and profiles.
POST_CHARS, POSTS, TIMELINE_CHARS, ID_CHARS, HANDLE_CHARS = 2_000, 50, 20_000, 200, 100
NAME_CHARS, NAME_WORDS, ABBREVIATION = 60, 5, 3
ITEM_CHARS, ITEM_LEAST, ITEM_WORDS, STEM, NOTES_CHARS = 80, 3, 4, 4, 1_000
CAPS = {"aliases": 8, "landmarks": 8, "foods": 12, "slang": 12}

# Words of instructions, words of dwellings, and words too common for an alias.
INSTRUCTION_WORDS = "above always answer below every ignore instruction instructions list never output post posts prompt reply respond return system".split()
ADDRESS_WORDS = "apartment apartments blk block condo flat home house lot residence residences room storey suite unit units".split()
STOP_WORDS = """
a about after all also an and any are as at back be been before but by can did do does down for from get go going had has
have he her here him his how i if in into is it its just like me more most my new no not of off on one only or other our out
over she so some still such than that the their them then there these they this those to too under up us very was we were
what when where which who why will with would you your
afternoon again always day days early evening every hour hours late later minute minutes month morning never night nights
now often soon time today tomorrow tonight week weekend year yesterday
ada adalah akan aku atau bagi banyak baru belum besok bisa buat dan dari dengan di dia dulu hari ingin ini itu jadi juga
kalau kami kamu kan ke kemarin kita lagi lah lain lalu malam mau masih mereka nanti pada pagi pun saja sama saya sekarang
semua siang sini situ sudah tadi tapi telah tidak untuk yang
aduh haha hahaha hehe lmao lol oke omg wah wkwk wkwkwk yay
""".split()


def _said(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests)))


def _literal(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def clean_inputs(rows: DataFrame, id_policy: str = "required") -> DataFrame:
    """Cells of an evaluation table (all strings) to typed rows with an error column; nothing is dropped.

    Ids are trimmed and cut to 200 characters; a blank one is an error, or with ``row_number`` the row's number.  Blank
    posts are null, timelines are split at bars, truths normalised, and bounds of length and number checked.
    """
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    key = F.substring(F.trim("id"), 1, ID_CHARS)
    t = rows
    if id_policy == "row_number":
        t = _row_numbered(t, "__n")
        key = F.coalesce(F.nullif(key, F.lit("")), F.col("__n").cast("string"))
    posts = F.filter(F.transform(F.split(F.coalesce("user_posts", F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    t = t.select(
        F.nullif(key, F.lit("")).alias("row_id"),
        trimmed("post").alias("post"),
        posts.alias("user_posts"),
        trimmed("user_handle").alias("user_handle"),
        clean_truth("ground_truth_city").alias("truth_post"),
        clean_truth("ground_truth_user_city").alias("truth_user"),
        F.coalesce(trimmed("bucket"), trimmed("tag")).alias("bucket"),
        boolean_cell("should_disagree").alias("should_disagree"),
    )
    error = (
        F.when(F.col("row_id").isNull(), "id is missing")
        .when(F.char_length("post") > POST_CHARS, "post is too long")
        .when(F.size("user_posts") > POSTS, "too many posts")
        .when(F.char_length(F.array_join("user_posts", "")) > TIMELINE_CHARS, "timeline is too long")
        .when(F.char_length("user_handle") > HANDLE_CHARS, "handle is too long")
        .when(F.col("post").isNull() & (F.size("user_posts") == 0), "neither post nor timeline")
    )
    return t.withColumn("error", error)


def _row_numbered(rows: DataFrame, name: str) -> DataFrame:
    """Adds the row's number from 1 in reading order: its place in its partition after all rows of those before."""
    t = rows.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    sizes = t.groupBy(F.col("__p").alias("__q")).agg(F.count("*").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.join(F.broadcast(sizes.select("__q", before.alias("__before"))), F.col("__p") == F.col("__q"))  # a row per partition
    return t.withColumn(name, F.col("__before") + F.col("__m") % (1 << 33) + 1).drop("__m", "__p", "__q", "__before")


def duplicate_ids(rows: DataFrame, key: str = "row_id") -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def refuse(rows: DataFrame, on_row_error: str = "skip") -> DataFrame:
    """Marks repeated ids; with ``fail`` the first row that carries an error ends the job with its message."""
    again = F.count("*").over(Window.partitionBy("row_id")) > 1
    t = rows.withColumn("error", F.coalesce("error", F.when(F.col("row_id").isNotNull() & again, "id is repeated")))
    if on_row_error == "fail":
        message = F.concat(F.coalesce("row_id", F.lit("?")), F.lit(": "), F.col("error"))
        t = t.filter(F.col("error").isNull() | F.raise_error(message).isNull())
    return t


def has_truth(rows: DataFrame) -> DataFrame:
    """One row: whether any row has a truth."""
    return rows.agg(F.coalesce(F.bool_or(F.col("truth_post").isNotNull() | F.col("truth_user").isNotNull()), F.lit(False)).alias("some_truth"))


def handle_like_ids(rows: DataFrame, pattern: str = r"^@?[A-Za-z_][A-Za-z0-9_.]{2,}$") -> DataFrame:
    """How many ids look like account handles, and the first three."""
    t = rows.filter(F.col("row_id").rlike(pattern))
    first = t.select("row_id").distinct().orderBy("row_id").limit(3).agg(F.array_join(F.array_sort(F.collect_list("row_id")), ", ").alias("first"))
    return t.agg(F.count("*").alias("n")).join(F.broadcast(first), F.lit(True))


def name_faults(names: DataFrame) -> DataFrame:
    """Adds violations array<string> for a place's name."""
    t = names.withColumn("__n", normalise_place_name("name")).withColumn("__mixed", mixed_script_words("__n")).withColumn("__w", F.transform(words("__n"), lambda w: F.lower(w)))
    n = F.col("__n")
    abbreviation = F.regexp_replace(n, rf"(?U)(?<![^\W\d_])[^\W\d_]{{1,{ABBREVIATION}}}\.", "")
    found = _said(
        (n == "", "empty"),
        (F.char_length(n) > NAME_CHARS, "too long"),
        (F.size(F.split(n, " ")) > NAME_WORDS, "too many words"),
        (~n.rlike(r"\p{L}"), "no letters"),
        (F.size(disallowed_characters(n)) > 0, "characters"),
        (F.contains(abbreviation, F.lit(".")), "full stop"),
        (F.arrays_overlap("__w", _literal(INSTRUCTION_WORDS)), "instruction words"),
        (F.size("__mixed") > 0, "mixed scripts"),
    )
    return t.withColumn("violations", found).drop("__n", "__mixed", "__w")


def address_like(name: str = "name") -> Column:
    low = F.transform(words(name), lambda w: F.lower(w))
    return F.col(name).rlike(r"\p{Nd}") | F.arrays_overlap(low, _literal(ADDRESS_WORDS))


def item_faults(items: DataFrame) -> DataFrame:
    """Adds violations for aliases and landmarks (name of the place, item)."""
    t = items.withColumn("__v", normalise_text("item")).withColumn("__w", words("__v")).withColumn("__stems", F.transform(F.filter(words("name"), lambda w: F.char_length(w) >= STEM), lambda w: F.lower(F.substring(w, 1, STEM))))
    v, w = F.col("__v"), F.col("__w")
    common = F.forall(w, lambda x: F.array_contains(_literal(STOP_WORDS), F.lower(x)))
    named = F.exists(w, lambda x: x.rlike(r"^\p{Lu}") | (F.char_length(x) >= STEM) & F.array_contains("__stems", F.lower(F.substring(x, 1, STEM))))
    found = _said(
        (v.rlike("[<>]"), "markup"),
        (v == "", "empty"),
        (F.char_length(v) < ITEM_LEAST, "too short"),
        (F.char_length(v) > ITEM_CHARS, "too long"),
        (F.size(w) == 0, "no letters"),
        (F.size(F.split(v, " ")) > ITEM_WORDS, "too many words"),
        ((F.size(w) > 0) & common, "common words"),
        ((F.size(w) > 0) & ~named, "not a name"),
    )
    return t.withColumn("violations", found).drop("__v", "__w", "__stems")


def field_faults(profiles: DataFrame) -> DataFrame:
    """Adds violations for a profile's lists, notes and region."""
    lists = [(F.size(c) > cap, f"{c}: too many") for c, cap in CAPS.items()] + [(F.exists(c, lambda x: F.char_length(x) > ITEM_CHARS), f"{c}: item too long") for c in CAPS]
    lists += [(F.exists(c, lambda x: x.rlike("[<>]")), f"{c}: markup") for c in CAPS]
    texts = [(F.char_length("notes") > NOTES_CHARS, "notes: too long"), (F.col("notes").rlike("[<>]"), "notes: markup"), (F.col("region").rlike("[<>]"), "region: markup"), (F.trim(F.coalesce("region", F.lit(""))) == "", "region: missing")]
    return profiles.withColumn("violations", _said(*lists, *texts))


def coordinate_rules(places: DataFrame) -> DataFrame:
    return places.withColumn("violations", coordinate_faults("lat", "lon"))


def profile_warnings(profiles: DataFrame, places: DataFrame, aliases: DataFrame, boxes: DataFrame) -> DataFrame:
    """Adds warnings array<string>: what to look at before a place is added."""
    away = region_faults(profiles, aliases, boxes).filter(~F.col("inside")).select("name", F.lit(True).alias("__away"))
    near = near_duplicates(profiles.select("name", "lat", "lon").filter(F.col("lat").isNotNull()), places).select("name", F.lit(True).alias("__near"))
    t = profiles.join(away, "name", "left").join(near, "name", "left")
    out = F.size(coordinate_faults("lat", "lon")) > 0
    found = _said(
        (F.col("source") == "stub", "placeholder"),
        (F.trim(F.coalesce("region", F.lit(""))) == "", "no region"),
        (F.coalesce(F.size("aliases"), F.lit(0)) <= 0, "no aliases"),
        (F.coalesce(F.size("landmarks"), F.lit(0)) <= 0, "no landmarks"),
        (F.col("lat").isNull() | F.col("lon").isNull(), "no centroid"),
        (out, "centroid out of range"),
        (F.col("__away"), "outside its region"),
        (F.col("__near"), "beside another place"),
        (address_like(), "address"),
    )
    return t.withColumn("warnings", found).drop("__away", "__near")


def accepted(candidates: DataFrame, *checks) -> DataFrame:
    """Candidates without a violation under each check (functions that add ``violations``)."""
    return reduce(lambda t, check: check(t).filter(F.size("violations") == 0).drop("violations"), checks, candidates)


def not_empty(rows: DataFrame) -> DataFrame:
    """rows, unless there are none: an empty batch is refused."""
    if not rows.limit(1).count():
        raise ValueError("the batch has no rows")
    return rows
