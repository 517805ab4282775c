"""Language ID (operator 3): Bayesian evidence fusion.

Four pieces of evidence are combined: the text's likelihood under character trigram models, the language that markup or
metadata declares, the address suffix, and the host.  The last two make one prior: all rows' shares of languages are
sharpened by the suffix's, these by the domain's and these by the host's, each smoothed toward the one before, so the
suffix counts once, and the less the more is known of the host.  All tables behind are grouped aggregations over all rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import join_small, saved, table

#: Trigrams are counted in so many cells.
CELLS = 1 << 16
#: Trigrams overlap, so a text counts as a third as many observations.
DEPENDENT = 3.0
#: A declared language is the primary subtag of a language tag: two or three letters.  Anything else declares nothing, so
#: there are 26**2 + 26**3 languages at most, whatever the rows declare.
SUBTAG = r"^\s*([A-Za-z]{2,3})(?:[-_].*|\s*)$"
#: Languages whose counts a task holds before it writes them out.
HELD_AT_ONCE = 256
#: Counts (a language's of a cell) of the model that are broadcast at once, in ten bytes each.
MODEL = 1 << 24
#: A language whose text score is so far below the best is no candidate.  Declaration and address together can't tell two
#: languages apart by more than 130 (were there 10**12 rows), so all left out have less than exp(-40) of the posterior each.
MARGIN = 170.0
#: Rows that the coarser prior weighs in each step of smoothing, and the weight of a declaration or suffix never seen.
SMOOTH, UNSEEN = 20.0, 1.0
#: Share of every language's model that is uniform over the cells.  The fit is measured without any other smoothing, so a
#: cell that a language lacks scores the same in it however much text declares the language.
UNIFORM = 0.02
#: A row is rejected below this posterior (no language has the greater part), or if its text fits the chosen language
#: worse per trigram than by this: a little below the background, which is uniform over the cells (a text of cells that a
#: language lacks is log UNIFORM below it).
SURE, FIT = 0.5, -math.log(CELLS) - 1
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^<>]*>|&#?\w+;", re.S | re.I)


def cells_of(text: str):
    """The cells of a text's letter trigrams: lower case, everything but letters as one blank."""
    import numpy as np

    text = re.sub(r"[\W\d_]+", " ", text.lower())
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    if len(c) < 4:
        return np.zeros(0, np.int64)
    h = (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(48)).astype(np.int64)[c[1:-1] != 32]


def _text(value, markup: bool) -> str:
    text = value.as_py() or ""
    return MARKUP.sub(" ", text) if markup else text


def counts(rows: DataFrame) -> DataFrame:
    """(declared, cell, n) over all rows that declare a language: partial tables per task, then summed."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def table_of(sums):
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["declared", "cell", "n"])

        sums: dict = {}
        for b in batches:
            for lang, text, markup in zip(b.column("declared").to_pylist(), b.column("text"), b.column("markup").to_pylist()):
                if lang not in sums:
                    if len(sums) == HELD_AT_ONCE:  # write out what is held, whole, and go on
                        yield from table_of(sums)
                        sums = {}
                    sums[lang] = np.zeros(CELLS, np.int64)
                sums[lang] += np.bincount(cells_of(_text(text, markup)), minlength=CELLS)
        yield from table_of(sums)

    part = rows.filter(F.col("declared").isNotNull()).select("declared", "text", "markup").mapInArrow(run, "declared string, cell int, n long")
    return part.groupBy("declared", "cell").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame) -> tuple[DataFrame, list, list[range]]:
    """The counts (a saved table); each language with its number of trigrams and of cells, by name; and the languages in
    blocks of at most MODEL counts, or of one language.  The driver gets a row a language, so as many as there are subtags at
    most."""
    t = saved(counts(rows))
    languages = t.groupBy("declared").agg(F.sum("n").alias("n"), F.count("*").alias("cells")).orderBy("declared").collect()
    blocks, begin, held = [], 0, 0
    for k, x in enumerate(languages):
        if k > begin and held + x["cells"] > MODEL:
            blocks.append(range(begin, k))
            begin, held = k, 0
        held += x["cells"]
    return t, languages, [*blocks, range(begin, len(languages))]


def _model(t: DataFrame, languages: list) -> tuple:
    """A block's log-probabilities, smoothed as evidence and to measure fit, of the cells that its languages have, by cell:
    where each cell begins, the language, and by how much either log is above the language's own log of a cell it lacks."""
    import numpy as np

    names = [x["declared"] for x in languages]
    own = t.filter(F.col("declared").between(names[0], names[-1])).toArrow()
    word = own["declared"].combine_chunks().dictionary_encode()
    place = {x: k for k, x in enumerate(names)}
    lang = np.array([place[x] for x in word.dictionary.to_pylist()], np.int16)[word.indices.to_numpy()]
    cell, n = own["cell"].to_numpy(), own["n"].to_numpy()
    by = np.lexsort((lang, cell))
    lang, cell, n = lang[by], cell[by], n[by]
    size = np.array([x["n"] for x in languages], np.float64)
    log = lambda share: np.log((1 - UNIFORM) * share + UNIFORM / CELLS)
    lacking = np.stack([log(0.5 / (size + 0.5 * CELLS)), np.full(len(names), log(0.0))])
    above = np.stack([log((n + 0.5) / (size[lang] + 0.5 * CELLS)), log(n / size[lang])]) - lacking[:, lang]
    return np.searchsorted(cell, np.arange(CELLS + 1)), lang, above.astype(np.float32), lacking


def _score(rows: DataFrame, model: tuple, first: int, dropped: tuple[str, ...]) -> DataFrame:
    """rows with cands array<struct<l, s, f>>: the languages, their tempered log-likelihoods and fits per trigram, less those
    that are MARGIN below the best (null: no text), and guess, the best; without the columns ``dropped``.

    The model is that of languages from number ``first`` on.  Candidates that rows have already stay in the running.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in rows.schema if f.name not in (*dropped, "cands", "guess")]
    names, more = [f.name for f in kept], "cands" in rows.columns
    one = StructType([StructField("l", IntegerType()), StructField("s", DoubleType()), StructField("f", DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        start, lang, above, lacking = sent.value
        here = np.arange(first, first + lacking.shape[1], dtype=np.int32)
        for b in batches:
            found, guess = [], []
            if more:
                old, at = b.column("cands").values, b.column("cands").offsets.to_numpy()
                old = [old.field(c).to_numpy(zero_copy_only=False) for c in "lsf"]
            for r, (text, markup) in enumerate(zip(b.column("text"), b.column("markup").to_pylist())):
                used, times = np.unique(cells_of(_text(text, markup)), return_counts=True)
                n = int(times.sum())
                if not n:
                    found.append(None)
                    guess.append(None)
                    continue
                begin, long = start[used], start[used + 1] - start[used]
                where = np.repeat(begin - np.cumsum(long) + long, long) + np.arange(long.sum())
                weight, of = np.repeat(times, long), lang[where]
                s, f = (np.bincount(of, weight * x[where], minlength=len(here)) / n + base for x, base in zip(above, lacking))
                cands = [here, s * (n / DEPENDENT), f]
                if more:
                    cands = [np.concatenate([x[at[r] : at[r + 1]], y]) for x, y in zip(old, cands)]
                best = int(cands[1].argmax())
                near = cands[1] >= cands[1][best] - MARGIN
                found.append([x[near] for x in cands])
                guess.append(int(cands[0][best]))
            flat = [np.concatenate([x[k] for x in found if x] or [np.zeros(0)]) for k in range(3)]
            fields = [pa.array(x, type=t) for x, t in zip(flat, (pa.int32(), pa.float64(), pa.float64()))] if len(flat[0]) else [pa.array([], t) for t in (pa.int32(), pa.float64(), pa.float64())]
            ends = np.cumsum([0, *(len(x[0]) if x else 0 for x in found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["l", "s", "f"]), mask=pa.array([x is None for x in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), lists, pa.array(guess, pa.int32())], [*names, "cands", "guess"])

    return rows.mapInArrow(run, StructType([*kept, StructField("cands", ArrayType(one)), StructField("guess", IntegerType())]))


def _guesses(t: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys -> name struct<n map<int,long>, rows long>: how many rows' texts suggest which language, of grouped counts
    (guess, n).  A key has the languages that its rows suggest, so as many as there are subtags at most."""
    each = t.groupBy(*keys, "guess").agg(F.sum("n").alias("n"))
    return each.groupBy(*keys).agg(F.struct(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("n"), F.sum("n").alias("rows")).alias(name))


def _totals(t: DataFrame, languages: list) -> list[int]:
    """For each language the rows that suggest it, of grouped counts (guess, n)."""
    found = {r["guess"]: r["n"] for r in t.groupBy("guess").agg(F.sum("n").alias("n")).collect()}
    return [found.get(k, 0) for k in range(len(languages))]


def _fixed(values: list, kind: str) -> Column:
    """A constant array of any length as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def identify(rows: DataFrame, carried: bool = False) -> DataFrame:
    """rows (text, markup boolean, declared, host, domain, suffix, any others) with language, posterior and kept.

    Without the text, unless it is ``carried``.  Texts are read twice, once to count and once to score (once more for each
    further block of languages, if the model needs several); what follows uses a saved table of rows and their few
    candidates and joins small tables to it, so rows are not shuffled.  Likelihoods of declarations and the priors come from
    grouped counts of the languages that the texts alone suggest.  Rows, tables and plans hold the languages that occur in
    them, however many are declared in all.

    Null or letterless text: language null, posterior 0, not kept.  Null declared, host, domain or suffix: that evidence is
    left out, or smoothed as a group of its own.  No declared language in the whole table: nothing can be learnt, and
    every row is kept with language null.  Ties go to the first language by name.  Repeated rows: a row each.  Very long
    texts are read whole.  Empty table: no rows.  Other columns stay, but must not be named like those that are added on
    the way: cands, guess, wide, near, said, totals, top, chosen.  ``keep_identified`` takes columns of any names.
    """
    dropped = ("markup",) if carried else ("text", "markup")
    keys = [c for c in rows.columns if c not in dropped]
    rows = rows.withColumn("declared", F.nullif(F.lower(F.regexp_extract("declared", SUBTAG, 1)), F.lit("")))
    t, languages, blocks = fit(rows)
    if not languages:
        return rows.select(*keys, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(True).alias("kept"))
    scored = rows
    for k, block in enumerate(blocks):
        scored = saved(_score(scored, _model(t, [languages[i] for i in block]), block[0], dropped if k == len(blocks) - 1 else ()))
    told = scored.filter(F.col("guess").isNotNull())
    by = saved(told.groupBy("suffix", "domain", "host", "guess").agg(F.count("*").alias("n")))
    wide = saved(_guesses(by, ["suffix"], "wide"))
    domains = saved(_guesses(by, ["suffix", "domain"], "domains"))
    near = join_small(_guesses(by, ["suffix", "domain", "host"], "hosts"), domains, ["suffix", "domain"])
    near = saved(near.select("suffix", "domain", "host", F.struct("hosts", "domains").alias("near")))
    declared = saved(told.filter(F.col("declared").isNotNull()).groupBy("declared", "guess").agg(F.count("*").alias("n")))
    said = saved(_guesses(declared, ["declared"], "said"))
    out = join_small(join_small(join_small(scored, near, ["suffix", "domain", "host"]), wide, ["suffix"]), said, ["declared"])
    total = _evidence(_totals(by, languages), _totals(declared, languages))
    out = out.withColumn("totals", F.transform("cands", lambda c: F.struct((c["s"] + total(c["l"])).alias("t"), c["l"].alias("l"), c["f"].alias("f"))))
    out = out.withColumn("top", F.array_max(F.transform("totals", lambda x: x["t"])))
    out = out.withColumn("chosen", F.get(F.filter("totals", lambda x: x["t"] == F.col("top")), F.lit(0)))
    posterior = 1 / F.aggregate("totals", F.lit(0.0), lambda a, x: a + F.exp(x["t"] - F.col("top")))
    out = out.withColumn("posterior", F.when(F.col("cands").isNotNull(), posterior).otherwise(0.0))
    names = _fixed([x["declared"] for x in languages], "string")
    sure = (F.col("posterior") >= SURE) & (F.col("chosen.f") >= FIT)
    return out.select(*keys, F.get(names, F.col("chosen.l")).alias("language"), "posterior", F.coalesce(sure, F.lit(False)).alias("kept"))


def _evidence(of_all: list[int], of_declared: list[int]):
    """What declaration and address add to a language's log-likelihood, by its number.

    The declaration adds log P(declared | language) less log P(declared), smoothed; nothing if it is null or no text's.  The
    address adds the log of its prior: all rows' shares, then the suffix's, the domain's and the host's, each smoothed
    toward the one before.  The two lists count the rows, and the declaring rows, by the language that their text suggests.
    """
    overall = _fixed([(n + 1) / (sum(of_all) + len(of_all)) for n in of_all], "double")
    declaring = _fixed(of_declared, "bigint")

    def share(path: str, l: Column, coarser: Column) -> Column:
        n, rows = F.element_at(F.col(f"{path}.n"), l), F.col(f"{path}.rows")
        return (F.coalesce(n, F.lit(0)) + SMOOTH * coarser) / (F.coalesce(rows, F.lit(0)) + SMOOTH)

    def total(l: Column) -> Column:
        seen = lambda n, all_of: F.log((F.coalesce(n, F.lit(0)) + UNSEEN) / (all_of + 10 * UNSEEN))
        said = seen(F.element_at(F.col("said.n"), l), F.get(declaring, l)) - seen(F.col("said.rows"), F.lit(sum(of_declared)))
        prior = share("near.hosts", l, share("near.domains", l, share("wide", l, F.get(overall, l))))
        return F.when(F.col("said").isNotNull(), said).otherwise(0.0) + F.log(prior)

    return total


def documents_evidence(docs: DataFrame) -> DataFrame:
    """A document declares its language in ``lang``; its source stands for the host."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("markup"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"))


def pages_evidence(pages: DataFrame) -> DataFrame:
    """A page declares its language in <html lang>; host, domain (its last two names) and suffix come from the address."""
    host = F.nullif(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    said: Column = F.nullif(F.lower(F.regexp_extract(F.col("html"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("text"), F.lit(True).alias("markup"), said.alias("declared"), host.alias("host")).withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs whose language is identified, with ``lang`` set to it; same columns.

    Each row carries its own columns through scoring and is decided by itself.  Null, empty and letterless texts go.  Null
    doc_id, lang or source: like any other row.  Repeated rows: a row each.  Very long texts are read whole.  No declared
    language in the whole table: all rows stay as they are.  Empty table: no rows.  All columns stay as they are, whatever
    their names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    plain = docs.select("text", F.lit(False).alias("markup"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"), row)
    found = identify(plain.withColumn("text", F.col("text").cast("string")), carried=True).filter("kept")
    kinds = dict(docs.dtypes)
    new = {"text": F.col("text").cast(kinds["text"]), "lang": F.coalesce("language", "row.lang").cast(kinds["lang"])}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages together: doc_id or page_id, declared, host, language, posterior, kept."""
    docs = documents_evidence(table(spark, sf_dir, "documents")).withColumn("page_id", F.lit(None).cast("long"))
    pages = pages_evidence(table(spark, sf_dir, "pages")).withColumn("doc_id", F.lit(None).cast("long"))
    return identify(docs.unionByName(pages)).select("doc_id", "page_id", "declared", "host", "suffix", "language", "posterior", "kept")
