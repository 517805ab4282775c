"""Token counts (operator 7): whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .token_ids import any_of, hugging, ranked, specials

#: Merged pre-tokens whose counts a worker keeps, and the longest of them.
KEPT, KEPT_CHARS = 400_000, 64


def whole_tokens(tok, pattern: str) -> frozenset[str]:
    """The proof: the vocabulary's strings that are one pre-token and that the merges make one token.

    A vocabulary string need not come out whole, as another merge may take part of it first; only strings whose own
    encoding is a single token, and which the pattern leaves in one piece, count.
    """
    import regex

    find, special = regex.compile(pattern).findall, specials(tok)
    strings = (tok.decode([i], skip_special_tokens=False) for i in tok.get_vocab().values())
    alone = [s for s in strings if s and "�" not in s and s not in special and find(s) == [s]]
    return frozenset(s for s, e in zip(alone, tok.encode_batch_fast(alone, add_special_tokens=False)) if len(e.ids) == 1)


class Merged(dict):
    """Token counts of pre-tokens that need merging; of bounded size."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, pre: str) -> int:
        n = len(self.merge(pre))
        if len(self) < KEPT and len(pre) <= KEPT_CHARS:
            self[pre] = n
        return n


class Counter:
    """Counts of texts: pre-tokens in the proven set count one each, and only the rest is merged."""

    def __init__(self, path: str, ranks: str | None, pattern: str, whole: frozenset[str]):
        import regex

        self.tok, self.find, self.whole = hugging(path), regex.compile(pattern).findall, whole
        self.special = any_of(specials(self.tok)).search
        self.merged = Merged(ranked(ranks, pattern) if ranks else lambda s: self.tok.encode(s, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if self.special(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        whole, parts = self.whole, self.find(text)
        rest = [p for p in parts if p not in whole]
        return len(parts) - len(rest) + sum(map(self.merged.__getitem__, rest))


_counters: dict = {}


def _counter(path: str, ranks: str | None, pattern: str, whole) -> Counter:
    """One for each Python worker; a full memo starts anew with the next task.  ``whole``: the broadcast proven set."""
    key = (path, ranks, pattern)
    if key not in _counters:
        _counters[key] = Counter(*key, whole.value)
    if len(_counters[key].merged) >= KEPT:
        _counters[key].merged.clear()
    return _counters[key]


def token_counts(docs: DataFrame, *, tokenizer: str, pattern: str, ranks: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs, in one narrow pass.

    The proof is made once, before any text is read, and its set (no larger than the vocabulary) is sent to the workers.
    Pre-tokens that the vocabulary is proven to hold as whole tokens are counted directly; the others are merged, by
    tiktoken's copy of the vocabulary if ``ranks`` is given.  Texts with a special string go whole to the tokenizers
    library, so that such strings count as it counts them by default.

    Null or empty text: 0 bytes, 0 tokens, over_limit false.  Null doc_id and repeated rows: a row each.  Very long
    texts are counted whole.  Empty table: no rows.  Other columns are ignored,
    whatever their names.
    """

    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(hugging(tokenizer), pattern))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _counter(tokenizer, ranks, pattern, whole)
        for batch in batches:
            n = [counter.count(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts(table(spark, sf_dir, "documents"), tokenizer=P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN)
