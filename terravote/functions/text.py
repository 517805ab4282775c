"""Text and name functions.

Native expressions, but for Unicode normal forms, case folding, HTML references, scripts by character name and balanced
braces, which Spark SQL lacks: these are UDFs on Arrow arrays.  Workers need no pandas for them, and a key is one UDF, as every
further one in a row of steps has a worker process of its own for each task.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

# Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = (
    "авеѕіјкмнорстухѐё" "αβγεζηικμνορτυχω" "օոսᎠᎡᎪ" "ıȷɑɡɩĸſŉƅƚɓɗɖɸ",
    "abesijkmhopctyxee" "abyeznikuvoptuxw" "onudra" "ijagiksnblbddo",
)
# Scripts that are written together inside a word, and first words of character names that name no script.
TOGETHER = {"HIRAGANA": "JAPANESE", "KATAKANA": "JAPANESE", "CJK": "JAPANESE"}
NO_SCRIPT = {"COMBINING", "DIGIT", "MODIFIER", "VARIATION", "ZERO"}
TRUE_CELLS = ["1", "true", "yes", "y", "t"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_word_term(term) -> Column:
    """Whether a term is matched at word boundaries (one plain lower-case word) and not anywhere."""
    return _c(term).rlike(r"^[a-z\-']+$")


def match_count(text, term) -> Column:
    """How often a lower-case term occurs in a lower-case text: at word boundaries, or as a substring without overlaps."""
    text, term = _c(text), _c(term)
    words = F.regexp_count(text, F.concat(F.lit(r"(?U)\b\Q"), term, F.lit(r"\E\b")))
    anywhere = (F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))) / F.char_length(term)
    return F.when(F.char_length(term) == 0, 0).when(is_word_term(term), words).otherwise(anywhere.cast("int")).cast("int")


def _each(values: pa.Array, function) -> pa.Array:
    """The function's strings for an array's strings; null for null."""
    return pa.array((function(v.as_py()) if v.is_valid else None for v in values), pa.string())


@arrow_udf(StringType())
def unescape_html(text: pa.Array) -> pa.Array:
    return _each(text, html.unescape)


def clean_text(text) -> Column:
    """References decoded, addresses dropped, bars turned to spaces, white space collapsed and trimmed; @ and # stay."""
    t = F.regexp_replace(F.regexp_replace(unescape_html(_c(text)), r"https?://\S+", ""), r"\|", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def slug_to_name(slug) -> Column:
    """The words of a slug less its last two parts, each with a capital."""
    return F.initcap(F.trim(F.regexp_replace(_c(slug), r"-[^-]*-[^-]*$", "")))


def _tidy(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[\t\n\r]", " "), r"\p{Cc}", ""), r"\s+", " "))


@arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return _each(text, lambda s: unicodedata.normalize("NFC", s))


@arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return _each(text, lambda s: unicodedata.normalize("NFKC", s))


_BREAK, _CONTROL, _BLANKS = re.compile(r"[\t\n\r]"), re.compile(r"[\x00-\x1f\x7f-\x9f]"), re.compile(" +")


def folded(name: str, form: str = "NFC") -> str:
    """A name in a normal form, tidied as by ``_tidy``, with its case folded."""
    return _BLANKS.sub(" ", _CONTROL.sub("", _BREAK.sub(" ", unicodedata.normalize(form, name)))).strip(" ").casefold()


@arrow_udf(StringType())
def _name_key(name: pa.Array) -> pa.Array:
    return _each(name, folded)


@arrow_udf(StringType())
def _compatible_key(name: pa.Array) -> pa.Array:
    return _each(name, lambda s: folded(s, "NFKC"))


def normalise_text(text) -> Column:
    """NFC, controls dropped, white space collapsed, trimmed."""
    return _tidy(_nfc(_c(text)))


def normalise_place_name(name) -> Column:
    return _tidy(_nfkc(_c(name)))


def name_key(name) -> Column:
    """What two spellings of a name share."""
    return _name_key(_c(name))


def place_name_key(name) -> Column:
    """What two look-alike spellings share."""
    return F.translate(_compatible_key(_c(name)), *LOOKALIKES)


def place_id(key) -> Column:
    return F.concat(F.lit("pl_"), F.substring(F.sha2(_c(key), 256), 1, 12))


def clean_truth(name) -> Column:
    return F.nullif(normalise_text(name), F.lit(""))


def boolean_cell(cell) -> Column:
    t = F.lower(F.trim(_c(cell)))
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("boolean")).otherwise(t.isin(TRUE_CELLS))


def disallowed_characters(name) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(name), F.lit(r"[^\p{L}\p{M}\p{N} \-'.]"), F.lit(0)))


def words(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))


def _scripts(word: str) -> set[str]:
    firsts = {unicodedata.name(c, "").split(" ")[0] for c in word if unicodedata.category(c)[0] == "L"}
    return {TOGETHER.get(f, f) for f in firsts if f and f not in NO_SCRIPT}


@arrow_udf(ArrayType(StringType()))
def mixed_script_words(name: pa.Array) -> pa.Array:
    """The words whose letters come from more than one script, each once."""
    words = (None if s is None else list(dict.fromkeys(w for w in s.split() if len(_scripts(w)) > 1)) for s in name.to_pylist())
    return pa.array(words, pa.list_(pa.string()))


def salted_hash(salt: str, value) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), _c(value)), 256), 1, 16)


def latency_text(ms) -> Column:
    """Milliseconds up to a second, then seconds."""
    ms = _c(ms)
    return F.when(ms >= 1000, F.format_string("%.2f s", ms / 1000)).otherwise(F.format_string("%.0f ms", ms.cast("double")))


_BLOCK = re.compile(r"```[A-Za-z0-9_+-]*\s*\n?(.*?)```", re.S)
_PIECE = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}]', re.S)


def _braced(text: str) -> str | None:
    """From the first brace to the one that balances it; braces in strings don't count."""
    first, depth = text.find("{"), 0
    for m in _PIECE.finditer(text, max(first, 0)):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth and m[0] == "}":
            return text[first : m.end()]
    return None


def json_object(reply: str | None) -> str | None:
    """The reply's JSON object: the whole reply, a fenced block or the first braced span, whichever first is one."""
    text = (reply or "").strip()
    for part in (text, *(b.strip() for b in _BLOCK.findall(text)), _braced(text)):
        try:
            if part and isinstance(json.loads(part), dict):
                return part
        except json.JSONDecodeError:
            pass
    return None


@arrow_udf(StringType())
def extract_json(reply: pa.Array) -> pa.Array:
    return pa.array((json_object(r.as_py()) for r in reply), pa.string())


def confidence(value) -> Column:
    """A finite number clamped to [0, 1]; null if the text is none."""
    t = F.lower(F.trim(_c(value)))
    x = F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(t.try_cast("double"))
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
