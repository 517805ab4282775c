"""PII (operator 5): candidate gradient boosting; DataFrame functions and MLlib's DataFrame API only.

Generators with high recall propose spans, which may overlap.  Each candidate's format and context features are small
integers and make up one code, so a table of codes with their counts, of bounded size, stands for all candidates of all
documents.  Boosted trees are fitted to that table, weighted by the counts: candidates that strict validators confirm
against all others.  A threshold calibrated on documents that were not fitted selects the codes to redact.  Applying the
model is a look-up of a candidate's code.

There are no labelled spans, so validators label: base spans, addresses spelt out, and a naming word before a number or
secret.  What they look at is no feature, so the trees learn how confirmed candidates are written and set; they select
those like them that no validator confirms.  Confirmed candidates are redacted in any case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import covered, matches, overlapped, replaced
from .common import saved, table

KINDS = ["email", "ip", "card", "phone", "mail", "number", "secret"]

# The base patterns, written so that a run of characters is tried from its first one only: leftmost matches stay the
# same, and time stays linear in very long runs.  \G lets a match start where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# The generators' patterns.  Runs are taken whole, whatever their length; how long they are is a feature.
AT = r"(?:@|\(at\)|\[at\])"
MAIL = rf"(?:\G|(?<![^\s]))(?:[^\s@(\[]|(?!\(at\)|\[at\])[(\[])++{AT}[^\s@]++"
NUMBER = r"[+(]?+[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+"
SECRET = r"(?:\G|(?<![A-Za-z0-9_+/-]))[A-Za-z0-9_+/-]{20,}+={0,2}+"
#: What confirms an address whose @ is written (at) or [at].
SPELT = r"^[^A-Za-z0-9._%+-]*+[A-Za-z0-9._%+-]++(?:\(at\)|\[at\])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++[^A-Za-z0-9]*+$"
#: Words that name a number or a secret, and how a secret is given to its name.
NUMBER_NAME = r"(?:phone|tel|mobile|call|fax|card|visa|account|iban|ip|address|ssn)\b[^a-z]*$"
SECRET_NAME = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|key|auth|bearer|credential)"
GIVEN = r"[=:]\s*[\"'`]?$"
#: Parameter: characters before a candidate that the naming words are looked for in.  A name farther off confirms nothing;
#: such candidates are left to the trees.
CONTEXT = 24

#: Features and their numbers of values; a code is their mixed-radix number, and a kind has at most 1,152 codes.  None
#: of them is the outcome of what labels the kind: not the base patterns' checks, and not the naming words.
FEATURES = {
    "mail": {"at": 3, "dots": 3, "tail": 2, "local": 2, "size": 3, "lead": 2},
    "number": {"digits": 6, "paren": 2, "marks": 3, "dotted": 2, "before": 4, "after": 4},
    "secret": {"size": 4, "hex": 2, "digits": 3, "mixed": 2, "before": 4, "after": 4},
}
#: Boosting: trees, depth, seed.  A code is redacted if its own candidates are confirmed this often, or if, in the order of
#: scores, all candidates of the documents held out are down to it.
TREES, DEPTH, SEED, PRECISION = 10, 3, 7, 0.95
#: One document in so many is held out.
HELD = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.char_length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def _spans(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("int")


def _bin(value: Column, edges: list[int]) -> Column:
    return reduce(lambda c, e: c + (value >= e).cast("int"), edges, F.lit(0))


def _edge(c: Column, joined: str) -> Column:
    """Class of the character next to a candidate: none or space 0, quote 1, one of ``joined`` 2, any other 3."""
    return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike("^[\"'`]$"), 1).when(c.rlike(f"^[{joined}]$"), 2).otherwise(3)


def _feature(kind: str, x: Column) -> dict[str, Column]:
    v = x["value"]
    before, after = F.right(x["before"], F.lit(1)), F.left(x["after"], F.lit(1))
    if kind == "mail":
        parts = F.split(v, AT, 2)
        local, host = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        return {
            "at": F.when(F.contains(v, F.lit("@")), 0).when(F.contains(v, F.lit("(at)")), 1).otherwise(2),
            "dots": _bin(F.char_length(F.regexp_replace(host, "[^.]", "")), [1, 2]),
            "tail": _flag(host.rlike(r"[.][A-Za-z]{2,}+[^A-Za-z0-9]*+$")),
            "local": _flag(local.rlike("[A-Za-z0-9_%+-]$") & host.rlike("^[A-Za-z0-9]")),
            "size": _bin(F.char_length(v), [8, 60]),
            "lead": _flag(v.rlike("^[^A-Za-z0-9]")),
        }
    if kind == "number":
        return {
            "digits": _bin(F.char_length(_digits(v)), [8, 10, 13, 16, 20]),
            "paren": _flag(F.contains(v, F.lit(")"))),
            "marks": _bin(F.char_length(F.regexp_replace(v, "[0-9+(]", "")), [1, 2]),
            "dotted": _flag(v.rlike(r"^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$")),
            "before": _edge(before, r"\p{L}\p{N}_"),
            "after": _edge(after, r"\p{L}\p{N}_"),
        }
    letters = F.regexp_replace(v, "[^A-Za-z]", "")
    return {
        "size": _bin(F.char_length(v), [28, 40, 64]),
        "hex": _flag(v.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "digits": _bin(F.char_length(_digits(v)) * 10 / F.char_length(v), [1, 3]),
        "mixed": _flag((letters != F.lower(letters)) & (letters != F.upper(letters))),
        "before": _edge(before, "=:"),
        "after": _edge(after, ",;)"),
    }


def _code(kind: str, features: dict[str, Column]) -> Column:
    out = F.lit(KINDS.index(kind))
    for name, n in FEATURES[kind].items():
        out = out * n + features[name]
    return out.cast("int")


def _named(kind: str, x: Column) -> Column:
    """What besides the base spans confirms a candidate: an address spelt out, or a naming word before a number or secret."""
    if kind == "mail":
        return x["value"].rlike(SPELT)
    before = F.lower(F.right(x["before"], F.lit(CONTEXT)))
    if kind == "number":
        return before.rlike(NUMBER_NAME) & F.char_length(_digits(x["value"])).between(10, 15)
    return before.rlike(SECRET_NAME) & before.rlike(GIVEN)


def found_in(docs: DataFrame) -> DataFrame:
    """docs (with a column text) with base (struct of a span array per base kind), candidates (array of kind, start, end,
    code, label, open) and held, whether the document is held out from fitting.

    label: a validator confirms it, be it a base span or what ``_named`` says.  open: it may be added to the base spans.  What
    one base span covers is not.  Nor is an address or number that a base span touches, unless it is confirmed by itself;
    a secret is whole with whatever base spans lie in it or across its ends.
    """
    text, digits = "coalesce(text, '')", r"text rlike r'[0-9][\x20().-]{0,2}[0-9]'"
    base = {"email": (EMAIL, "contains(text, '@')"), "ip": (IP, f"contains(text, '.') and {digits}"), "card": (CARD, digits), "phone": (PHONE, "contains(text, '+')")}
    drawn = {"mail": (MAIL, "contains(text, '@') or contains(text, '(at)') or contains(text, '[at]')"), "number": (NUMBER, r"text rlike r'[0-9](?:[\x20().-]{0,2}[0-9]){6}'"), "secret": (SECRET, "text rlike r'[A-Za-z0-9_+/-]{20}'")}
    seen = {k: F.expr(matches(text, pattern, f"text is not null and ({may})", CONTEXT if k in drawn else 0)) for k, (pattern, may) in {**base, **drawn}.items()}
    own = lambda kind: F.transform(seen[kind], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _code(kind, _feature(kind, x)).alias("code"), _named(kind, x).alias("named")))
    out = docs.select("*", (F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0).alias("held"), F.struct(*(_spans(F.filter(seen[k], lambda x: _valid(k, x["value"]))).alias(k) for k in base)).alias("base"), *(own(k).alias(f"__{k}") for k in drawn))
    out = out.withColumn("__all", F.expr("concat(base.email, base.ip, base.card, base.phone)"))
    out = out.select("*", *(F.expr(f(f"__{k}", "__all")).alias(f"__{name}_{k}") for k in drawn for name, f in (("taken", overlapped), ("inside", covered))))
    label = {"mail": "x.named or y.taken", "number": "x.named or y.taken", "secret": "x.named"}
    may = {k: "not y.inside" if k == "secret" else "not y.taken or (x.named and not y.inside)" for k in drawn}
    met = {k: f"zip_with(__taken_{k}, __inside_{k}, (a, b) -> struct(a as taken, b as inside))" for k in drawn}
    parts = [f"zip_with(__{k}, {met[k]}, (x, y) -> struct('{k}' as kind, x.start as start, x.end as end, x.code as code, {label[k]} as label, {may[k]} as open))" for k in drawn]
    return out.withColumn("candidates", F.expr(f"concat({', '.join(parts)})")).drop("__all", *(f"__{name}{k}" for k in drawn for name in ("", "taken_", "inside_")))


def _decode(code: Column, kind: str) -> dict[str, Column]:
    out, rest = {}, code
    for name, n in reversed(FEATURES[kind].items()):
        out[name] = F.pmod(rest, F.lit(n))
        rest = F.floor(rest / n).cast("int")
    return out


def fit(found: DataFrame) -> list[tuple[str, int]]:
    """(kind, code) pairs to redact, from all candidates of ``found``: at most some hundreds."""
    each = found.select("held", F.explode("candidates").alias("c")).select("held", "c.kind", "c.code", F.col("c.label").alias("right"))
    n = lambda test: F.count_if(test)
    held, right = F.col("held"), F.col("right")
    codes = saved(each.groupBy("kind", "code").agg(n(~held & right).alias("right"), n(~held & ~right).alias("other"), n(held & right).alias("held_right"), n(held & ~right).alias("held_other")))
    both = codes.groupBy("kind").agg(((F.sum("right") > 0) & (F.sum("held_right") > 0)).alias("both"))
    both = {r["kind"]: r["both"] for r in both.collect()}
    chosen: list[tuple[str, int]] = []
    for kind, features in FEATURES.items():
        own = codes.filter(F.col("kind") == kind).select("*", *(c.cast("double").alias(f"f_{name}") for name, c in _decode(F.col("code"), kind).items()))
        own = VectorAssembler(inputCols=[f"f_{name}" for name in features], outputCol="features").transform(own)
        if not both.get(kind):  # too few to hold any out: all rows are fitted and counted
            every = {c: F.col(c) + F.col(f"held_{c}") for c in ("right", "other")}
            own = own.withColumns({**every, **{f"held_{c}": x for c, x in every.items()}})
            alone = F.col("right") / (F.col("right") + F.col("other"))
        else:
            alone = (F.col("right") + F.col("held_right")) / (F.col("right") + F.col("held_right") + F.col("other") + F.col("held_other"))
        labelled = own.select("features", F.explode(F.array(*(F.struct(F.lit(y).alias("label"), F.col(c).cast("double").alias("weight")) for y, c in ((1.0, "right"), (0.0, "other"))))).alias("x")).select("features", "x.label", "x.weight").filter("weight > 0").coalesce(1)
        sums = {r["label"]: r["w"] for r in labelled.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
        if not sums.get(1.0):
            continue
        if sums.get(0.0):
            trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight", checkpointInterval=-1).fit(labelled)
            scored = trees.transform(own).withColumn("p", vector_to_array("probability")[1])
        else:  # all that was fitted is confirmed: no other code counts as likely
            scored = own.withColumn("p", F.when(F.col("right") > 0, 1.0).otherwise(0.0))
        upto = Window.orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        right, other = F.sum("held_right").over(upto), F.sum("held_other").over(upto)
        scored = scored.withColumn("precision", F.try_divide(right, right + other))
        likely = (F.col("p") >= 0.5) & (F.coalesce("precision", F.lit(0.0)) >= PRECISION)
        chosen += [(kind, r["code"]) for r in scored.filter(likely | (alone >= PRECISION)).select("code").collect()]
    return sorted(chosen)


def spans_of(found: DataFrame, codes: list[tuple[str, int]]) -> DataFrame:
    """found with spans, array of (order, start, end): the base spans, and of the open candidates the confirmed and the
    selected ones."""
    base = F.concat(*(F.transform(F.col(f"base.{k}"), lambda s: F.struct(F.lit(i).alias("order"), s["start"].alias("start"), s["end"].alias("end"))) for i, k in enumerate(KINDS[:4])))
    picked = F.array().cast("array<struct<order:int,start:bigint,end:bigint>>")
    for kind in FEATURES:
        own = [c for k, c in codes if k == kind] or [-1]
        hit = F.filter("candidates", lambda x: (x["kind"] == kind) & (x["label"] | x["code"].isin(own)) & x["open"])
        picked = F.concat(picked, F.transform(hit, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("order"), x["start"].alias("start"), x["end"].alias("end"))))
    return found.withColumn("base_spans", F.sort_array(base)).withColumn("spans", F.sort_array(F.concat(base, picked)))


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs, by one search of the texts.

    spans lists the base spans (strict patterns and validators) and those that the boosted trees add, as
    kind:start:end in code points, by kind and then start.  The model is learnt from all candidates of docs.

    Null or empty text: no spans, and the digest of the empty string.  Null doc_id and repeated rows: a row each.  Very
    long texts are searched whole, in linear time.  Ties: matches of a kind never overlap; spans of different kinds may, and
    are all listed, even where they are alike, unless a base span covers an added one.  Empty table: no rows.  Other
    columns are ignored, whatever their names.
    """
    found = saved(found_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text"))
    out = spans_of(found, fit(found))
    counts = [F.size(F.col(f"base.{k}")).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return out.select("doc_id", *counts, F.sha2(_written("base_spans"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets, and n_chars, if there, counted anew.

    The texts are searched once: rows are saved with what was found in them, the model is learnt from the candidates
    there, and the saved rows are rewritten.  Spans that overlap are replaced together, by the kind of the first.

    Null text stays null, empty text empty.  Null doc_id and repeated rows: a row each, treated alike.  Very long texts are
    rewritten whole.  Empty table: no rows.  All other columns stay as they are, whatever their names.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = saved(found_in(rows.withColumn("text", F.col("row.text").cast("string"))).drop("text"))
    out = spans_of(found, fit(found)).withColumn("clean", F.expr(replaced("string(row.text)", "spans", [f"[{k}]" for k in KINDS])))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("clean").cast(kinds["text"]), "n_chars": F.char_length("clean").cast(kinds.get("n_chars", "long"))}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
