from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, spans int, base string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["the", "river", "over", "stone", "quiet", "and", "walks", "night", "of", "green", "hill", "was", "long", "market", "door"]
    return " ".join(r.choice(words) + (r.choice(["", "", "", "s", "er", "ing"])) for _ in range(n))


def rows() -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and a source with a third of them."""
    out = [(i, prose(i, 20 + 7 * (i % 40)), ["en", "de", None][i % 7 % 3] if i % 7 < 3 else "en", "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(120)]
    out += [(200 + i, out[i][1], "en", "copy") for i in range(10)]
    out += [(300 + i, out[i][1] + " end", "en", "near") for i in range(10)]
    out += [(400, None, None, None), (401, "", "en", ""), (402, "  \t\n ", None, "s1"), (403, prose(9, 30_000), "en", "s2"), (None, prose(5, 40), "en", "s3"), (404, "x" * 50_000, "en", "s1")]
    out += [out[3], out[3], (405, "It costs </s> mail a.b@c.org now <|endoftext|> 😀 naïve  spaces\r\n\r\nhere 's we're", "en", "s4")]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    data = [(a, t, b, c, None if t is None else len(t), "clash", "clash", 1, "clash") for a, t, b, c in rows()]
    return spark.createDataFrame(data, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
