"""Quality rules (operator 2): robust multivariate outliers; DataFrame functions only.

After two plain rules, a document's statistics are transformed to a vector and compared with others of its language and
source: minimum-covariance-determinant estimates of centre and scatter, by concentration steps, and rejection by
Mahalanobis distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, is_small, join_small, saved, table

#: Words of a window whose repetition counts.
SPAN = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Share of a group that the estimates rest on: a half, so that outliers stay out of the core until they are nearly half
#: of a group, copies or not.  Steps of each start, and of the best of them at most; steps end when no determinant
#: falls by more than the last share.
CORE, FIRST_STEPS, MOST_STEPS, SETTLED = 0.5, 2, 40, 1e-4
#: Rows that the coarser level weighs when a group's estimates are drawn toward its language's, and those to all rows'.
SHRINK = 50.0
#: Cells of squared distance, per unit of its logarithm, in which a core's edge is found.
FINE = 256
#: Least standard deviation of each component: less is no evidence of anything (most documents have no repeats at all).
FLOORS = {"word_length": 0.08, "symbols": 0.06, "same_lines": 0.15, "repeats": 0.2, "capitals": 0.1}
#: Quantiles of the chi-squared distribution with five degrees of freedom: 0.5 and 0.9999.
CHI2_HALF, CHI2_CUT = 4.35146, 25.7448
X = list(FLOORS)


def statistics(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang, source with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals.

    All within the row.  Eight-word windows are compared by 64-bit hashes of the window; sorting them, and only in texts
    that repeat one, keeps the work at n log n for the longest text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    t = t.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    t = t.select(
        "doc_id",
        "lang",
        "source",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    windows = F.when(F.size("words") >= SPAN, F.transform(F.sequence(F.lit(1), F.size("words") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(SPAN))))).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumn("w", windows).drop("words")
    twice = F.size(F.array_distinct("w")) < F.size("w")
    t = t.withColumn("s", F.when(twice, F.array_sort(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("w")
    same = lambda x, at: F.coalesce(F.get("s", at)["h"] == x["h"], F.lit(False))
    found = F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    t = t.withColumn("p", F.array_sort(F.transform(found, lambda x: x["i"]))).drop("s")
    start = F.struct(F.lit(-SPAN).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(SPAN), p - a["last"])).alias("n")), lambda a: a["n"])
    return t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def _vector(t: DataFrame) -> DataFrame:
    """Adds the transformed statistics: the logarithm of the mean word length, and roots of shares."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return t.withColumns({
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": share("n_symbols", "word_chars"),
        "same_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
    })


PAIRS = [(i, j) for i in range(len(X)) for j in range(i + 1)]
SUMS = [*(f"s{i}" for i in range(len(X))), *(f"e{i}{j}" for i, j in PAIRS)]
ESTIMATE = [*(f"m{i}" for i in range(len(X))), *(f"c{i}{j}" for i, j in PAIRS)]
KEY = ["level", "k0", "k1"]


def _levels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row once per level: of all rows (0), of the first key (1) and, with two keys, of both (2)."""
    null = F.lit(None).cast("string")
    named = [F.struct(F.lit(n).alias("level"), *((F.col(keys[i]).cast("string") if i < n else null).alias(f"k{i}") for i in range(2))) for n in range(len(keys) + 1)]
    return rows.select(*X, F.explode(F.array(*named)).alias("k")).select("k.*", *X)


def _quantile(rows: DataFrame, keys: list[str], cell: Column, q: float, name: str) -> DataFrame:
    """keys -> name: the first cell at which a share q of the key's rows is reached.  Cells are counted, rows never sorted."""
    cells = rows.withColumn("__cell", cell).groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("__upto", F.sum("__n").over(upto)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    return cells.filter(F.col("__upto") >= q * F.col("__all")).groupBy(*keys).agg(F.min("__cell").alias(name))


def _factored(estimates: DataFrame) -> DataFrame:
    """estimates (m, c) with the Cholesky factor l of covariance + FLOORS**2 and the logarithm of its determinant."""
    out = []
    for i, j in PAIRS:
        rest = " - ".join([f"c{i}{j}", *(f"l{i}{k} * l{j}{k}" for k in range(j))])
        floor = FLOORS[X[i]] ** 2
        out.append(f"sqrt(greatest({rest} + {floor!r}D, {floor * 1e-6!r}D)) as l{i}{j}" if i == j else f"({rest}) / l{j}{j} as l{i}{j}")
    return estimates.selectExpr("*", *out, f"2 * ({' + '.join(f'ln(l{i}{i})' for i in range(len(X)))}) as log_det")


def _distance(rows: DataFrame, estimates: DataFrame, keys: list[str], known: bool | None = None) -> DataFrame:
    """rows joined to their estimates, with d2, the squared Mahalanobis distance, by forward substitution."""
    out = []
    for i, x in enumerate(X):
        out.append(f"({' - '.join([x, f'm{i}', *(f'l{i}{k} * y{k}' for k in range(i))])}) / l{i}{i} as y{i}")
    return join_small(rows, estimates, keys, known=known).selectExpr("*", *out, f"{' + '.join(f'y{i} * y{i}' for i in range(len(X)))} as d2")


def _step(rows: DataFrame, estimates: DataFrame, starts: list[int], known: bool | None = None) -> DataFrame:
    """One concentration step of the given starts: the mean and covariance of the half of each key's rows that is nearest.

    One pass: rows are summed by key, start and cell of distance; the core is made of these sums.  Of the cell at its edge,
    as large a share is taken as makes the core a half exactly.
    """
    each = rows if len(starts) == 1 else rows.withColumn("start", F.explode(F.array(*map(F.lit, starts))))
    keys = KEY if len(starts) == 1 else [*KEY, "start"]
    near = _distance(each, estimates, keys, known).withColumn("cell", F.expr(f"floor({FINE} * ln(1 + d2))"))
    sums = [F.expr(f"sum({x}) as s{i}") for i, x in enumerate(X)] + [F.expr(f"sum({X[i]} * {X[j]}) as e{i}{j}") for i, j in PAIRS]
    cells = near.groupBy(*keys, "cell").agg(F.expr("double(count(*)) as n"), *sums)
    names = ", ".join(keys)
    upto = f"coalesce(sum(n) over (partition by {names} order by cell rows between unbounded preceding and 1 preceding), 0D)"
    cells = cells.selectExpr("*", f"{CORE} * sum(n) over (partition by {names}) as h", f"{upto} as before").selectExpr("*", "least(1D, greatest(0D, (h - before) / n)) as w")
    core = cells.filter("w > 0").groupBy(*keys).agg(F.expr("first(h) as h"), *(F.expr(f"sum(w * {c}) as {c}") for c in SUMS))
    return _factored(core.selectExpr(*keys, *(f"s{i} / h as m{i}" for i in range(len(X))), *(f"e{i}{j} / h - s{i} / h * s{j} / h as c{i}{j}" for i, j in PAIRS)))


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates per key, about the medians: absolute deviations alone; with the correlations of the values'
    hyperbolic tangents; and the spatial signs' covariance."""
    value = rows.select(*KEY, F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(x).alias("x")) for i, x in enumerate(X)))).alias("c")).select(*KEY, "c.which", "c.x")
    each = [*KEY, "which"]
    middle = saved(_quantile(value, each, F.floor(F.col("x") * 1024), 0.5, "at").withColumn("at", (F.col("at") + 0.5) / 1024))
    off = join_small(value, middle, each).withColumn("off", F.abs(F.col("x") - F.col("at")))
    spread = saved(_quantile(off, each, F.floor(F.col("off") * 1024), 0.5, "wide"))
    floor = F.get(F.array(*map(F.lit, FLOORS.values())), F.col("which"))
    wide = F.greatest(1.4826 * (F.col("wide") + 0.5) / 1024, floor)
    first = saved(join_small(middle, spread, each).groupBy(*KEY).agg(*(F.max(F.when(F.col("which") == i, F.col("at"))).alias(f"m{i}") for i in range(len(X))), *(F.max(F.when(F.col("which") == i, wide)).alias(f"d{i}") for i in range(len(X)))))
    z = join_small(rows, first, KEY)
    z = z.selectExpr(*KEY, *(f"({x} - m{i}) / d{i} as z{i}" for i, x in enumerate(X))).selectExpr("*", f"greatest({' + '.join(f'z{i} * z{i}' for i in range(len(X)))}, 1e-12D) as length")
    shapes = z.groupBy(*KEY).agg(*(F.expr(f"avg(tanh(z{i}) * tanh(z{j})) as t{i}{j}") for i, j in PAIRS), *(F.expr(f"avg(z{i} * z{j} / length) as g{i}{j}") for i, j in PAIRS))
    shapes = join_small(first, saved(shapes), KEY)
    of = [
        lambda i, j: f"d{i} * d{j}" if i == j else "0D",
        lambda i, j: f"d{i} * d{j}" if i == j else f"d{i} * d{j} * coalesce(try_divide(t{i}{j}, sqrt(t{i}{i} * t{j}{j})), 0D)",
        lambda i, j: f"d{i} * d{j} * {len(X)} * g{i}{j}",
    ]
    made = [f"struct({k} as start, {', '.join(f'double({f(i, j)}) as c{i}{j}' for i, j in PAIRS)})" for k, f in enumerate(of)]
    means = [f"m{i}" for i in range(len(X))]
    return _factored(shapes.selectExpr(*KEY, *means, f"explode(array({', '.join(made)})) as x").select(*KEY, *means, "x.*"))


def minimum_determinant(rows: DataFrame) -> DataFrame:
    """(KEY, m, c, l, log_det): per key the core of half its rows whose covariance has the least determinant that was found.

    From three starts, two concentration steps each; from the best of them steps until no key's determinant falls any more,
    and the estimates with the least one are kept.  FLOORS**2 is added to every covariance, always the same, so that a
    step doesn't raise the determinant (as is proven of regularised estimates with a fixed target) even if most rows agree.
    """
    now = saved(_starts(rows))
    known = is_small(now)
    for _ in range(FIRST_STEPS):
        now = saved(_step(rows, now, [0, 1, 2], known))
    fields = [c for c in now.columns if c not in (*KEY, "start")]
    best = now.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("log_det", "start"))).filter("nth = 1")
    best = saved(best.select(*KEY, *fields))
    for _ in range(MOST_STEPS):
        after = _step(rows, best, [0], known).select(*KEY, F.struct(*fields).alias("new"))
        pair = join_small(after, best.select(*KEY, F.struct(*fields).alias("old")), KEY, known=known)
        best = saved(pair.selectExpr(*KEY, "if(new.log_det < old.log_det, new, old) as x", f"new.log_det < old.log_det - {SETTLED} as fell").select(*KEY, "x.*", "fell"))
        fell, best = best.filter("fell").limit(1).count(), best.drop("fell")
        if not fell:
            break
    return best


def robust_distance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with d2 by minimum-covariance-determinant estimates per key, drawn toward coarser ones by weight.

    Estimates are made of all rows, of each value of the first key and of each pair; a level with n rows weighs n against
    SHRINK of the level above.  Distances are scaled so that their median is that of chi-squared, as the core is narrower
    than the whole; the scale is drawn in the same way.  Every pass over the vectors is aggregated before any shuffle, so
    a key with a third of all rows is no burden.
    """
    wide = saved(_levels(rows, keys))
    best = minimum_determinant(wide)
    far = _distance(wide, best, KEY).withColumn("cell", F.expr(f"floor({FINE} * ln(1 + d2))"))
    half = saved(_quantile(far, KEY, F.col("cell"), 0.5, "half"))
    sizes = wide.groupBy(*KEY).agg(F.count("*").cast("double").alias("n"))
    own = saved(join_small(join_small(best, half, KEY), saved(sizes), KEY).select(*KEY, "n", *ESTIMATE, F.greatest(F.lit(1.0), F.expm1((F.col("half") + 1) / FINE) / CHI2_HALF).alias("scale")))
    drawn = [*ESTIMATE, "scale"]
    level = lambda n: own.filter(F.col("level") == n)
    made = level(0).select(*drawn)
    for n in range(1, len(keys) + 1):
        up = made.select(*(F.col(k).alias(f"u{k}") for k in KEY[1:n]), *(F.col(c).alias(f"up_{c}") for c in drawn))
        here = level(n).select(*KEY[1 : n + 1], "n", *drawn)
        # The level above the first is one row, the one of all rows; above the second, one row for each first key.
        met = join_small(here, up.withColumnsRenamed({f"u{k}": k for k in KEY[1:n]}), KEY[1:n]) if n > 1 else here.join(F.broadcast(up), how="cross")
        w = F.col("n") / (F.col("n") + SHRINK)
        made = met.select(*KEY[1 : n + 1], *((w * F.col(c) + (1 - w) * F.col(f"up_{c}")).alias(c) for c in drawn))
        made = saved(made)
    final = saved(_factored(made).withColumnsRenamed({f"k{i}": keys[i] for i in range(len(keys))}))
    text = rows.withColumns({f"__k{i}x": F.col(k).cast("string") for i, k in enumerate(keys)})
    final = final.withColumnsRenamed({k: f"__k{i}x" for i, k in enumerate(keys)})
    return _distance(text, final, [f"__k{i}x" for i in range(len(keys))]).withColumn("d2", F.col("d2") / F.col("scale")).select(*rows.columns, "d2")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance for every row.

    base_failed: fewer than 20 words, or over 30 % of them in repeated eight-word windows.  Others are kept unless their
    vector lies beyond the 0.9999 quantile in squared robust distance from its language and source.  The estimates of a
    language and source of n such rows weigh n against 50 of its language's, and these alike against all rows'.

    Null or empty text: all counts 0, base_failed.  Null lang or source: groups of their own.  Null doc_id and repeated
    rows: a row each, judged alike.  Ties: rows of equal distance lie in the same cell of it, of which the core takes a share,
    and a row at the quantile itself is kept.  Very long texts are counted whole.  Groups of one row, and of rows that all agree, have estimates
    like any other.  Empty table: no rows.  Other columns are ignored, whatever their names.
    """
    t = statistics(docs)
    t = saved(t.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))))
    named = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    fine = saved(_vector(t.filter(~F.col("base_failed"))).select(*named, *X, "lang", "source"))
    judged = robust_distance(fine, ["lang", "source"])
    out = judged.select(*named, (F.col("d2") <= CHI2_CUT).alias("kept"), F.sqrt("d2").alias("distance"))
    return out.unionByName(t.filter("base_failed").select(*named, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
