"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terravote.llm import divergence, whitening, window_packing

WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


# 11. packing with best fit decreasing


ODD = ["it's we'RE l'été' ''s 'S 'll'd x'smith", "áb ≮ ñ < ̸", "straße. „Straße“ ”. é...'s", "ſ K İstanbul ǅ \x1c a\x1cb\x85c\xa0d", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "１２３ ¼ ² x²", "́́ 'ſ", "ΑΣ Σ ΟΔΟΣ", " \t\n", "", "x" * 50_000, "1" * 3_000, "é'" + "s'l" * 5, "(Été),\"ça\"- [là]' l'Été's", "a\0b \0", "😀naïve 😀"]


def test_word_ids_are_the_librarys(words):
    texts = ODD + [f"{c}{c} a{c}b. {c}.{c}' '{c}s{c}" for c in map(chr, range(0x3000)) if not "\ud800" <= c <= "\udfff"]
    enc = window_packing.WordEncoder(WORDS)
    want = [np.array(e.ids, "<u4").tobytes() for e in words.encode_batch(texts, add_special_tokens=False)]
    assert [enc.ids(t) for t in texts] == want
    assert [enc.ids(t) for t in texts] == want  # from memory


@pytest.mark.parametrize("group", [4096, 16])
def test_windows_hold_every_token_once_and_need_no_padding(spark, docs, words, group):
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [((1 << 60) + 1, "one two"), ((1 << 60) + 3, "three"), (None, "four")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd)
    got = window_packing.packed(table, tokenizer=WORDS, group=group).collect()
    want = Counter((r.doc_id, np.array([*words.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in table.collect())
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length, bytes(r.ids)))
        assert len(r.ids) == 4 * r.length
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        used = sum(n for _, n in parts)
        assert used <= 2048 and window_packing.padding(used, 2048) == 0
    found = Counter()
    for (doc_id, n), parts in by_doc.items():
        # Rows with the same doc_id: as many documents as pieces at the start; equal texts are cut alike or not, so their
        # tokens are counted by place.
        alike = [(d, ids) for d, ids in want.elements() if d == doc_id and len(ids) == 4 * n]
        if len(set(alike)) == 1:
            at = Counter()
            for start, m, ids in parts:
                for k in range(m):
                    at[start + k] += 1
                assert alike[0][1][4 * start : 4 * (start + m)] == ids
            assert set(at.values()) == {len(alike)} and len(at) == n
            found.update(alike)
    assert found == want


def test_tree_finds_the_tightest_window():
    rng = random.Random(3)
    for size in (1, 7, 100, 128):
        lengths = sorted((rng.randint(1, size) for _ in range(400)), reverse=True)
        windows = window_packing.best_fit_decreasing(lengths, size)
        room: list[int] = []
        where = {}
        for w, parts in enumerate(windows):
            for item, start, n in parts:
                assert start == 0 and n == lengths[item]
                where[item] = w
        for item, n in enumerate(lengths):
            fits = [r for r in room if r >= n]
            if fits:
                assert room[where[item]] == min(fits)
            else:
                assert where[item] == len(room)
                room.append(size)
            room[where[item]] -= n


def test_filling_cuts_little(spark):
    rng = random.Random(4)
    lengths = sorted((min(2047, int(rng.lognormvariate(5, 1)) + 1) for _ in range(3000)), reverse=True)
    before = window_packing.best_fit_decreasing(lengths, 2048)
    after = window_packing.filled([list(w) for w in before], 2048)
    assert sum(map(len, after)) - len(lengths) <= len(before) + 11
    assert Counter(i for w in after for i, _, n in w for _ in range(n)) == Counter({i: n for i, n in enumerate(lengths)})


def test_windows_of_repeated_rows_and_of_nothing(spark, empty):
    t = spark.range(9_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"))
    got = window_packing.packed(t, tokenizer=WORDS)
    assert got.agg(F.sum("length")).first()[0] == 9_000 * 5 and got.filter("start = 0").count() == 9_000
    assert got.select((F.col("sequence_id") / 2**32).cast("long")).distinct().count() > 1
    assert window_packing.packed(empty, tokenizer=WORDS).count() == 0


# 12. whitening


def _whiten(rows: dict, wanted: int = 8):
    ids = list(rows)
    x = np.array([[np.floor(1024 * np.float64(np.float32(c))) + 100000 for c in rows[i]] for i in ids])
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    e, axes = np.linalg.eigh(d.T @ d / n)
    e, axes = e[::-1][:wanted], axes[:, ::-1][:, :wanted]
    deviation = {i: sum((n * int(a) - int(t)) ** 2 for a, t in zip(r, s)) for i, r in zip(ids, x)}
    return d @ axes / np.sqrt(e), e / np.trace(d.T @ d / n), deviation


@pytest.mark.parametrize("width", [3, 20, 70])
def test_whitening_matches_a_dense_decomposition(spark, width):
    rng = np.random.default_rng(width)
    full = rng.normal(0, 1, (300, width)) * np.linspace(3, 0.2, width) + rng.normal(0, 2, width)
    rows = {(1 << 60) + i: list(map(float, r)) for i, r in enumerate(full)}
    bad = [(1, None), (2, [float("nan")] * width), (3, [float("inf"), *[0.0] * (width - 1)]), (4, [None, *[0.0] * (width - 1)])]
    t = spark.createDataFrame([*rows.items(), *bad], "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).repartition(3)
    got = whitening.whitened(t).collect()
    z, explained, deviation = _whiten(rows)
    k = min(8, width)
    assert len(got) == 300 * k
    place = {i: r for r, i in enumerate(rows)}
    mine = np.zeros_like(z)
    for r in got:
        mine[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == 300 and r.deviation == deviation[r.vec_id]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    signs = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine * signs - z).max() < 1e-7


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0  # no variance
    # Two of three dimensions vary, and by the same amount; a repeated row and a null id; a short vector.
    square = [(i, [float(a), float(b), 0.5]) for i, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)])] + [(None, [0.0, 0.0])]
    got = whitening.whitened(spark.createDataFrame(square, kind)).collect()
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 15
    same = whitening.whitened(spark.createDataFrame(square[:4] * 2, kind)).collect()
    assert {r.component for r in same} == {1, 2} and all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-9 for r in same)


def test_large_deviations_are_exact(spark):
    rows = {i: [float(1e6 * (i % 7)), float(i)] for i in range(1000)}
    got = {r.vec_id: int(r.deviation) for r in whitening.whitened(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")).filter("component = 1").collect()}
    x = {i: [int(np.floor(1024 * c)) + 100000 for c in r] for i, r in rows.items()}
    s = [sum(c) for c in zip(*x.values())]
    assert got == {i: sum((1000 * a - t) ** 2 for a, t in zip(r, s)) for i, r in x.items()} and max(got.values()) > 2**63


# 13. divergence


def _audit(rows):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count, langs = defaultdict(int), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", terms.findall((text or "").translate(low))
        langs[lang].add(source)
        for w in set(found):
            docs[lang, w] += 1
        count[lang, source].update(found)
    out = set()
    for lang, sources in langs.items():
        kept = sorted(w for (x, w), n in docs.items() if x == lang and n >= 3)
        p = {}
        for key in [*sources, None]:
            c = sum((count[lang, s] for s in sources), Counter()) if key is None else count[lang, key]
            total = sum(c[w] for w in kept)
            p[key] = [1 + 10**9 * (c[w] + 1) // (total + len(kept)) for w in kept]
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted(((-sum(map(f, p[s], p[o])), o.encode()) for o in sources if o != s))
            term = sorted((-f(a, b), w.encode()) for w, a, b in zip(kept, p[s], p[None]) if count[lang, s][w] and a > b)[:200]
            for part, items in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(items, 1)}
    return out


def _texts(n: int, seed: int):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßABñ日") for _ in range(rng.choice([1, 2, 3, 8, 9, 16, 17, 40]))) for _ in range(60)] + ["internationalisation", "internationalisations", "internationaliste", "aaaaaaaa", "aaaaaaaaa"]
    join = [" ", ", ", "\n", "\x00", "_", "\x7f", "1"]
    return [(rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "s1", "s2", None, "日"]), "".join(rng.choice(vocabulary) + rng.choice(join) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def _table(spark, rows):
    return spark.createDataFrame([(i % 9 or None, t, a, b, "x") for i, (a, b, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string")


@pytest.mark.parametrize(("slice_", "shard", "pairs"), [(1 << 15, 8 << 20, 1 << 20), (4, 200, 3)])
def test_audit_matches_brute_force(spark, slice_, shard, pairs):
    rows = _texts(200, 5) + [("xx", "one", "once only"), ("xx", "two", None), ("xx", "three", ""), ("yy", "alone", "a a a b"), ("en", "long", "Éa b " * 30_000), ("en", "copies", "gone again")] + [("en", "copies", "gone again")] * 5
    got = divergence.audit(_table(spark, rows).repartition(3), slice_=slice_, shard_bytes=shard, at_once=pairs).collect()
    assert Counter((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got) == Counter(_audit(rows))


def test_pointer_sort_orders_words():
    rng = np.random.default_rng(1)
    for limit in (1, 8, 1 << 15):
        words = [bytes(rng.integers(97, 100, rng.integers(1, 30)).astype(np.uint8)) for _ in range(3000)] + [b"a" * 8, b"a" * 16, b"a" * 7] * 20
        data = np.frombuffer(b" ".join(words) + b"\0" * 8, np.uint8)
        lengths = np.array([len(w) for w in words])
        starts = np.cumsum(lengths + 1) - lengths - 1
        p, heads = divergence.pointer_sort(data, starts, lengths, limit)
        assert p.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
        assert [words[p[h]] for h in heads] == sorted(set(words))


def test_audit_of_nothing(spark, empty):
    assert divergence.audit(empty).count() == 0
    assert divergence.audit(_table(spark, [("en", "s", None)])).count() == 0
