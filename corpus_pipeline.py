"""From raw documents to packed training sequences: five stages, each a DataFrame of documents to the next.

language      documents whose language the fused evidence identifies, with ``lang`` set to it
near_dedup    one document, the first by doc_id, of each near-duplicate group
pii           personal data replaced by its kind in brackets
mixing        documents repeated or left out so that sources meet their target weights, shuffled within output shards
packing       token pieces placed in sequences of at most 1,024 tokens: one row per piece

Every stage takes any table of documents: null, empty and very long texts, null ids, ties, repeated rows, columns of any
other name, and no rows at all have the results that the operators' docstrings name; what the stages do with them is
said at each.  All stages but the last keep the columns as they are.

A stage's tables in the shared folder are needed until its result is written.  So each stage, as it begins, takes away what
stages before it have left there, but for tables that its own documents still read: write a stage's result before the
next one is called on a table in files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from terravote.llm import language, mixing, packing, pii, simhash
from terravote.llm.common import owned, removed, saved, table


def _stage(name: str, apply: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with its tables kept apart and those of the stages before it removed."""

    @wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        removed(spark, [f"{n} {part}" for n in NAMES[: NAMES.index(name)] for part in ("tables", "result")], docs)
        with owned(f"{name} tables"):
            return apply(spark, docs, sf_dir)

    return run


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language.  Those with null, empty or letterless texts go; repeated rows stay or go alike; if no row
    declares a language, all stay.  See ``language.keep_identified``."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, also of repeated rows, null ids and texts without words, always the same one.
    See ``simhash.keep_one_each``."""
    return simhash.keep_one_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without personal data.  Null texts stay null, long ones are rewritten whole, repeated rows alike.
    See ``pii.redacted``."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target asks.  Null texts have no words, and of sources without words nothing is taken;
    null sources are one source; repeated rows are drawn one by one.  See ``mixing.mixed``."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null texts are empty documents, with
    a piece of the end token alone; repeated rows have pieces of their own.  See ``packing.best_fit_packing``."""
    import public_tokenizers as P

    return packing.best_fit_packing(docs, tokenizer=P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN)


NAMES = ["language", "near_dedup", "pii", "mixing", "packing"]
STAGES = [(name, _stage(name, apply)) for name, apply in zip(NAMES, [identify, near_dedup, redact, mix, pack])]

#: Trained models and packing have no SQL form; tests hold the operators against brute force, and run against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``.  Every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with owned(f"{name} result"):
            docs = saved(made)
    return STAGES[-1][1](spark, docs, sf_dir)
