"""Many terms in many texts: one automaton of all terms, one pass over each text.

Terms are lower-case.  A term of letters, hyphens and apostrophes counts where it stands as a word, any other term anywhere;
occurrences of the same term don't overlap, the leftmost counts first.  Both come out of the same pass: the automaton gives
every place where a term ends, and what stands beside it tells whether it is a word.

The library used is pyahocorasick, in Arrow batches inside tasks.  Terms beyond AT_ONCE are cut into slices by a hash of their
first characters, each with an automaton and a pass of its own, so what a worker holds is bounded whatever the catalogue is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of one automaton; first characters that decide on a term's slice.
AT_ONCE, HEAD = 200_000, 3
#: Terms that are matched as words; and what counts as a part of a word beside them: letters, marks, digits and joiners.
WORD_TERM, PART = r"[a-z\-']+", r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]"


class Automaton:
    """Counts of terms in a text."""

    def __init__(self, terms: list[str]):
        import ahocorasick
        import regex

        self.find = ahocorasick.Automaton()
        word = regex.compile(WORD_TERM).fullmatch
        for i, t in enumerate(terms):
            # A word that begins or ends with a hyphen or apostrophe needs a part of a word beside it there, not a gap.
            first, last = (t[0].isalpha(), t[-1].isalpha()) if word(t) else (None, None)
            self.find.add_word(t, (i, len(t), first, last))
        self.find.make_automaton()
        self.part, self.known = regex.compile(PART).fullmatch, {"": False}

    def _is_part(self, c: str) -> bool:
        found = self.known.get(c)
        if found is None:
            found = self.known[c] = self.part(c) is not None
        return found

    def count(self, text: str) -> dict[int, int]:
        """How often each term (by number) occurs."""
        out: dict[int, int] = {}
        over: dict[int, int] = {}
        for end, (i, n, first, last) in self.find.iter(text):
            start = end - n + 1
            if start < over.get(i, 0):
                continue
            if first is not None:
                if self._is_part(text[start - 1] if start else "") is first or self._is_part(text[end + 1] if end + 1 < len(text) else "") is last:
                    continue
            out[i] = out.get(i, 0) + 1
            over[i] = end + 1
        return out


_automata: dict[str, Automaton] = {}


def automaton(terms: list[str], digest: str) -> Automaton | None:
    """One automaton for each Python worker and slice; none for no terms."""
    if terms and digest not in _automata:
        if len(_automata) > 1:
            _automata.clear()
        _automata[digest] = Automaton(terms)
    return _automata.get(digest)


def _digest(terms: list[str]) -> str:
    return hashlib.sha256("\n".join(terms).encode()).hexdigest()


def slices(terms: DataFrame, at_once: int = AT_ONCE) -> Iterator[list[str]]:
    """The distinct terms of a table (term), in lists of about ``at_once``, one at a time."""
    own = terms.select("term").filter(F.col("term") != "").distinct()
    n = max(1, -(-own.count() // at_once))
    for s in range(n):
        part = own if n == 1 else own.filter(F.pmod(F.xxhash64(F.substring("term", 1, HEAD)), F.lit(n)) == s)
        yield sorted(r["term"] for r in part.collect())


def term_counts(texts: DataFrame, terms: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """texts (row_id, level, text) and terms (term) -> row_id, level, term, hits: one row per text and term that it holds.

    Narrow: texts are read where they lie.  Null texts hold nothing; repeated rows have rows each.
    """
    kinds = dict(texts.dtypes)
    low = texts.filter(F.col("text").isNotNull()).select("row_id", "level", F.lower("text").alias("text"))
    schema = f"row_id {kinds['row_id']}, level {kinds['level']}, term string, hits int"
    out = None
    for found in slices(terms, at_once):
        part = low.mapInArrow(_counter(found, _digest(found)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _counter(terms: list[str], digest: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        book = automaton(terms, digest)
        for batch in batches:
            rows, names, hits = [], [], []
            if book:
                for k, text in enumerate(batch.column("text")):
                    for i, n in book.count(text.as_py()).items():
                        rows.append(k)
                        names.append(terms[i])
                        hits.append(n)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(at), batch.column("level").take(at), pa.array(names, pa.string()), pa.array(hits, pa.int32())], ["row_id", "level", "term", "hits"])

    return run


def with_counts(texts: DataFrame, terms: list[str], into: str = "found") -> DataFrame:
    """texts with an array of (i, n): which of the terms (by place in the list) the column text holds, and how often.

    Within the row, so also for streams.  Null texts hold nothing.
    """
    digest = _digest(terms)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        book, kind = automaton(terms, digest), pa.list_(pa.struct([("i", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            found = [[{"i": i, "n": n} for i, n in sorted(book.count(t.as_py()).items())] if book and t.is_valid else [] for t in batch.column("__low")]
            names = [c for c in batch.schema.names if c != "__low"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, kind)], [*names, into])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in texts.dtypes), f"{into} array<struct<i:int,n:int>>"])
    return texts.withColumn("__low", F.lower("text")).mapInArrow(run, schema)
