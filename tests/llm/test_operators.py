"""The operators against brute force on small documents with every kind of edge."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape as html_unescape

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from terravote.llm import arrays, chat, html_text, language, mixing, packing, pii, quality, simhash, token_counts, token_ids, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = {"tokenizer": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def none_of(df, columns):
    assert df.count() == 0
    assert set(columns) <= set(df.columns)


# 1. packing


def test_packing_cuts_packs_and_loses_nothing(docs, tok):
    got = packing.best_fit_packing(docs, **BPE).collect()
    want = Counter()
    for doc_id, text in plain(docs):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        for k, (a, b) in enumerate([(0, first), *((i, i + 1024) for i in range(first, len(ids), 1024))]):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(places) <= 1.06 * sum(r.length for r in got) / 1024 + 1


def test_packing_rule_is_the_smallest_sum_of_squares():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 21, 300).tolist()
    bins, places, free = packing.pack(sizes, 20)
    level, gaps = Counter(), {}
    for n, b, at in zip(sizes, bins, places):
        squares = lambda c: sum(v * v for v in c.values())
        options = []
        for gap in [g for g in level if level[g] > 0 and g >= n] + [20]:
            c = Counter(level)
            if gap != 20 or level[20]:
                c[gap] -= 1
            if gap - n:
                c[gap - n] += 1
            options.append(squares(c))
        old = gaps.get(b, 20)
        assert at == 20 - old
        if b in gaps:
            level[old] -= 1
        gaps[b] = old - n
        if gaps[b]:
            level[gaps[b]] += 1
        assert squares(level) == min(options)
    assert free == [gaps[b] for b in range(len(free))]


def test_packing_deals_repeated_rows_over_groups(spark):
    t = spark.range(12_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same few words again and again").alias("text"))
    got = packing.best_fit_packing(t, **BPE).select("sequence_id", "offset", "length").collect()
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 12_000 and len({s >> 32 for s in places}) > 1
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(places) <= 1.03 * sum(r.length for r in got) / 1024 + 1


def test_packing_keeps_long_ids_beside_a_null(spark):
    ids = [2**60 + 1, 2**60 + 3, None, 2**62 + 1]
    t = spark.createDataFrame([(i, f"some words of {i}") for i in ids], "doc_id long, text string")
    assert Counter(r.doc_id for r in packing.best_fit_packing(t, **BPE).collect()) == Counter(ids)


def test_packing_of_nothing(empty):
    none_of(packing.best_fit_packing(empty, **BPE), ["doc_id", "sequence_id", "offset"])


# 2. quality


def test_quality_statistics_match_a_plain_count(docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect())
    want = Counter()
    for doc_id, t in plain(docs):
        w = WORD.findall(t)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    assert got == want


def test_quality_rejects_an_outlier_and_keeps_the_rest(spark):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 100), "en", "s") for i in range(300)] + [(999, " ".join(w + "###" for w in prose(1, 100).split()), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(999)
    assert sum(got.values()) >= 297


def test_mcd_finds_the_clean_core(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, 5))
    x[:100] += 9
    t = spark.createDataFrame([(i, "g", *map(float, r)) for i, r in enumerate(x)], "id long, k string, " + ", ".join(f"{c} double" for c in quality.X))
    d = {r.id: r.d2 for r in quality.robust_distance(t, ["k"]).collect()}
    assert min(d[i] for i in range(100)) > quality.CHI2_CUT
    assert np.mean([d[i] <= quality.CHI2_CUT for i in range(100, 600)]) > 0.97


def log_det(x: np.ndarray) -> float:
    return float(np.linalg.slogdet(np.cov(x.T, bias=True) + np.diag([f * f for f in quality.FLOORS.values()]))[1])


def brute_mcd(x: np.ndarray, starts: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Least log-determinant over many random starts with steps to convergence; its centre and its core."""
    r, h, best = np.random.default_rng(0), len(x) // 2, None
    floor = np.diag([f * f for f in quality.FLOORS.values()])
    for _ in range(starts):
        core = x[r.choice(len(x), 6, replace=False)]
        for _ in range(50):
            m, c = core.mean(axis=0), np.cov(core.T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            after = x[np.argsort(d, kind="stable")[:h]]
            if np.array_equal(after, core):
                break
            core = after
        if best is None or log_det(core) < best[0]:
            best = (log_det(core), core.mean(axis=0), core)
    return best


def test_mcd_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    mix = np.array([[1, 0, 0, 0, 0], [0.6, 0.5, 0, 0, 0], [0, 0.3, 0.6, 0, 0], [0, 0, 0.2, 0.4, 0], [0.1, 0, 0, 0.3, 0.5]])
    groups = {"plain": rng.normal(0, 0.5, (400, 5)) @ mix.T}
    groups["far"] = np.concatenate([groups["plain"] + 3, rng.normal(7, 0.05, (180, 5))])
    groups["flat"] = np.concatenate([np.pad(rng.normal(0, 0.3, (300, 2)), ((0, 0), (0, 3))), rng.normal(2, 0.5, (100, 5))])
    rows = [(k, *map(float, x)) for k, xs in groups.items() for x in xs]
    t = spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in quality.X)).repartition(4)
    got = {r.k0: r for r in quality.minimum_determinant(quality._levels(t, ["k"])).collect() if r.level == 1}
    for k, x in groups.items():
        least, centre, core = brute_mcd(x)
        assert got[k].log_det <= least + 0.02, k
        spread = np.sqrt(np.diag(np.cov(core.T, bias=True)) + np.square(list(quality.FLOORS.values())))
        assert np.all(np.abs([got[k][f"m{i}"] for i in range(5)] - centre) < 0.25 * spread), k


def test_steps_do_not_raise_the_determinant(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (500, 5)) * [1, 0.2, 0, 0, 0.5], rng.normal(3, 0.3, (200, 5))])
    t = quality.saved(quality._levels(spark.createDataFrame([("g", *map(float, r)) for r in x], "k string, " + ", ".join(f"{c} double" for c in quality.X)), ["k"]))
    now, before = quality.saved(quality._step(t, quality._starts(t), [0, 1, 2])), {}
    for _ in range(5):
        dets = {(r.level, r.start): r.log_det for r in now.collect()}
        assert all(dets[k] <= before[k] + 0.02 for k in before)
        before, now = dets, quality.saved(quality._step(t, now, [0, 1, 2]))


def test_small_groups_lean_on_larger_ones(spark):
    from tests.llm.conftest import prose

    odd = " ".join(w + "###" for w in prose(1, 100).split())
    rows = [(i, prose(i, 100), "en", "big") for i in range(300)] + [(900, odd, "en", "tiny"), (901, prose(901, 100), "en", "tiny"), (902, odd, "xx", "alone"), (903, prose(903, 100), "xx", "alone"), (904, prose(904, 100), None, None)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[900], got[902]) == (False, False)
    assert got[901] and got[903] and got[904]


def test_quality_rejects_a_third_of_copies(spark):
    from tests.llm.conftest import prose

    odd = " ".join(w + "###" for w in prose(1, 100).split())
    rows = [(i, prose(i, 100), "en", "s") for i in range(200)] + [(1000 + i, odd, "en", "s") for i in range(100)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not any(got[1000 + i].kept for i in range(100))
    assert sum(got[i].kept for i in range(200)) >= 197


def test_quality_of_nothing(empty):
    none_of(quality.quality(empty), ["doc_id", "kept"])


# 3. language


SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and then they walked home with their friends", "de": "der schnelle braune fuchs springt über den faulen hund und dann gingen sie nach hause mit ihren freunden", "fr": "le rapide renard brun saute par dessus le chien paresseux et puis ils sont rentrés chez eux avec leurs amis"}


def speech(i: int) -> tuple[str, str]:
    lang = ["en", "de", "fr"][i % 3]
    words = SAMPLES[lang].split()
    return lang, " ".join(words[(i * 7 + j * 3) % len(words)] for j in range(12))


def test_language_on_held_out_texts(spark):
    train = [(i, *reversed(speech(i)), f"h{i % 4}") for i in range(150)]
    held = [(1000 + i, speech(i * 5 + 1)[1], None, f"h{i % 4}") for i in range(60)]
    wrong = [(2000, speech(1)[1], "en", "h1")]
    t = spark.createDataFrame(train + held + wrong + [(3000, None, "en", "h1"), (3001, "123 456", "de", None)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(language.documents_evidence(t)).collect()}
    right = sum(got[1000 + i].language == speech(i * 5 + 1)[0] for i in range(60))
    assert right >= 58
    assert got[2000].language == "de"
    assert not got[3000].kept and not got[3001].kept and got[3000].language is None
    kept = language.keep_identified(t)
    assert kept.columns == t.columns
    assert {3000, 3001}.isdisjoint(r.doc_id for r in kept.collect())


def test_a_tiny_language_does_not_let_junk_pass(spark):
    r = np.random.default_rng(0)
    junk = [" ".join("".join(map(chr, r.integers(0x430, 0x450, 6))) for _ in range(40)) for _ in range(20)] + [" ".join("".join(r.choice(list("qxzjkvwpg"), 6)) for _ in range(40)) for _ in range(20)]
    base = [(i, speech(i)[1], speech(i)[0], f"h{i % 4}") for i in range(300)]
    tiny = [(500 + i, "saluton mondo kiel vi fartas hodiau mi fartas bone", "eo", "h1") for i in range(5)]
    rows = [*base, *tiny, (900, "kiel fartas mondo hodiau", None, "h1"), *((1000 + i, x, None, f"h{i % 4}") for i, x in enumerate(junk))]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(language.documents_evidence(t)).collect()}
    assert not any(got[1000 + i].kept for i in range(40))
    assert got[900].kept and got[900].language == "eo"
    assert all(got[i].kept and got[i].language == speech(i)[0] for i in range(300))


def brute_posteriors(rows: list[tuple]) -> list[tuple]:
    """(language, posterior, kept) of each row (text, declared, host, domain, suffix), by plain loops."""
    from math import exp, log

    grams = [Counter(language.cells_of(t or "").tolist()) for t, *_ in rows]
    languages = sorted({d for _, d, *_ in rows if d})
    model = {k: Counter() for k in languages}
    for g, (_, d, *_) in zip(grams, rows):
        if d:
            model[d].update(g)
    size = {k: sum(m.values()) for k, m in model.items()}
    cell = lambda share: log((1 - language.UNIFORM) * share + language.UNIFORM / language.CELLS)
    score = [{k: sum(n * cell((model[k][c] + 0.5) / (size[k] + 0.5 * language.CELLS)) for c, n in g.items()) / language.DEPENDENT for k in languages} for g in grams]
    fit = [{k: sum(n * cell(model[k][c] / max(size[k], 1)) for c, n in g.items()) / max(sum(g.values()), 1) for k in languages} for g in grams]
    guess = [max(languages, key=lambda k: (s[k], [-ord(x) for x in k])) if g else None for s, g in zip(score, grams)]
    known = [x for x in guess if x]
    prior = {(): {k: (known.count(k) + 1) / (len(known) + len(languages)) for k in languages}}
    for depth in (1, 2, 3):
        for key in {r[4:1:-1][:depth] for r in rows}:
            own = [x for x, r in zip(guess, rows) if x and r[4:1:-1][:depth] == key]
            prior[key] = {k: (own.count(k) + language.SMOOTH * prior[key[:-1]][k]) / (len(own) + language.SMOOTH) for k in languages}
    declaring = [(x, r[1]) for x, r in zip(guess, rows) if x and r[1]]
    out = []
    for s, f, g, r in zip(score, fit, grams, rows):
        total = {}
        for k in languages:
            told = 0.0
            if r[1] and any(d == r[1] for _, d in declaring):
                share = lambda n, of: log((n + 1) / (of + 10))
                told = share(sum(x == k and d == r[1] for x, d in declaring), sum(x == k for x, _ in declaring)) - share(sum(d == r[1] for _, d in declaring), len(declaring))
            total[k] = s[k] + told + log(prior[r[4:1:-1]][k])
        best = max(total.values())
        chosen = min(k for k in languages if total[k] == best)
        p = 1 / sum(exp(t - best) for t in total.values())
        out.append((chosen, p, p >= language.SURE and f[chosen] >= language.FIT) if g else (None, 0.0, False))
    return out


def test_language_posteriors_match_brute_force(spark):
    r = np.random.default_rng(9)
    rows = []
    for i in range(240):
        lang, text = speech(i)
        said = [lang, None, lang, "de"][i % 4]
        host = f"h{r.integers(6)}.d{r.integers(3)}.{lang if r.random() < 0.8 else 'org'}"
        rows.append((" ".join(text.split()[: r.integers(1, 12)]), said, host, host.split(".", 1)[1], host.rsplit(".", 1)[1]))
    rows += [(None, "en", None, None, None), ("12 34", None, "h", None, None), ("zq xk vv", None, None, None, None), ("saluton mondo", "eo", "x.eo", "x.eo", "eo"), ("der hund " * 500, "en", None, None, None)]
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, text string, declared string, host string, domain string, suffix string").withColumn("markup", F.lit(False)).repartition(5)
    got = {x.id: x for x in language.identify(t).collect()}
    for i, (lang, p, kept) in enumerate(brute_posteriors(rows)):
        assert got[i].language == lang and got[i].kept == kept and abs(got[i].posterior - p) < 1e-3, rows[i]


def test_languages_in_blocks_score_like_all_at_once(spark, monkeypatch):
    rows = [(i, " ".join(speech(i)[1].split()[: 1 + i % 12]), [speech(i)[0], None, f"{speech(i)[0]}-x", "x" + chr(97 + i % 26)][i % 4], f"h{i % 5}") for i in range(200)]
    rows += [(500, None, "en", "h"), (501, "12", "de", None), (502, "der hund " * 3000, None, None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    once = {x.doc_id: x for x in language.identify(language.documents_evidence(t)).collect()}
    monkeypatch.setattr(language, "MODEL", 300)
    assert len(language.fit(language.documents_evidence(t).filter("declared is not null"))[2]) > 2
    blocks = {x.doc_id: x for x in language.identify(language.documents_evidence(t)).collect()}
    assert once.keys() == blocks.keys()
    for i, x in once.items():
        assert (x.language, x.kept) == (blocks[i].language, blocks[i].kept) and abs(x.posterior - blocks[i].posterior) < 1e-9


def test_two_thousand_declared_tags_leave_plan_and_rows_small(spark):
    tag = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"{speech(i)[1]} {tag(i)}", tag(i), "h") for i in range(2000)] + [(5000 + i, speech(i)[1] * 30, speech(i)[0], "h") for i in range(60)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = language.identify(language.documents_evidence(t))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("guess") < 500
    got = {x.doc_id: x for x in got.collect()}
    assert len(got) == 2060 and all(got[5000 + i].language == speech(i)[0] for i in range(60))


def test_identified_rows_keep_clashing_columns(spark):
    rows = [(i, speech(i)[1], speech(i)[0], "h", i, 2, "k", "x") for i in range(60)] + [(7, None, "en", "h", 0, 0, "k", "x")]
    t = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "__id", "a.b", "host", "kept"])
    out = language.keep_identified(t)
    assert out.columns == t.columns
    assert sorted(map(tuple, out.collect())) == sorted(rows[:60])


def test_tags_declare_their_primary_subtag(spark):
    rows = [(i, speech(i)[1], {"en": "EN-us", "de": "de_AT", "fr": " fr "}[speech(i)[0]], "h") for i in range(60)] + [(100 + i, speech(i)[1], "english text", "h") for i in range(9)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in language.identify(language.documents_evidence(t)).collect()}
    assert all(got[i].language == got[i].declared == speech(i)[0] for i in range(60))
    assert all(got[100 + i].declared is None and got[100 + i].language == speech(i)[0] for i in range(9))


def test_language_evidence_tips_the_scale(spark):
    base = [(i, speech(i)[1], speech(i)[0], f"host-{speech(i)[0]}") for i in range(150)]
    t = spark.createDataFrame([*base, (900, "so la", None, "host-fr"), (901, "so la", None, "host-de")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.language for r in language.identify(language.documents_evidence(t)).collect()}
    assert (got[900], got[901]) == ("fr", "de")


def test_language_of_pages_reads_markup_and_address(spark):
    p = spark.createDataFrame([(1, "https://User@www.Shop.example.de:80/x", '<html class="a" lang=de-AT><body>x</body>'), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.declared, r.host, r.domain, r.suffix) for r in language.pages_evidence(p).collect()}
    assert got == {1: ("de", "www.shop.example.de", "example.de", "de"), 2: (None, None, None, None)}


def test_language_edges(docs, empty):
    got = language.identify(language.documents_evidence(docs))
    assert got.count() == docs.count()
    none_of(language.identify(language.documents_evidence(empty)), ["language", "kept"])
    none_of(language.keep_identified(empty), empty.columns)
    assert language.keep_identified(docs).columns == docs.columns


# 4. near duplicates


def simple_print(t: str) -> int:
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(prints: list[tuple]) -> dict:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(prints):
        groups[find(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((prints[i][0], f"{prints[i][1]:016x}", least[find(i)]) for i in range(len(prints)))


def test_near_duplicates_match_brute_force(docs):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == brute_components([(d, simple_print(t)) for d, t in plain(docs)])


@pytest.mark.parametrize("long, wide", [(256, 4096), (4, 4096), (2, 3)])
def test_links_join_everything_within_three_bits(spark, long, wide):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = set()
    for s in seeds:
        x = int(s)
        for _ in range(60):
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            values.add(x)
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    t = spark.createDataFrame([(v,) for v in signed], "fp long")
    from terravote.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(t, long, wide)).collect()}
    want = brute_components([(v, x) for v, x in zip(signed, values)])
    assert Counter((v, f"{x:016x}", got.get(v, v)) for v, x in zip(signed, values)) == want


def test_tallies_count_shared_bytes():
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 3, (400, 8), dtype=np.uint8).view(np.uint64).ravel())
    octets = fps.view(np.uint8).reshape(-1, 8)
    key = octets[:, 0].astype(np.int64) * 9 + octets[:, 1] * 3 + octets[:, 2]
    order = np.argsort(key, kind="stable")
    fps, key = np.ascontiguousarray(fps[order]), key[order]
    number = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    i, j = simhash._tallied((number, np.zeros(len(fps), np.int64)), fps, simhash.TRIPLES)
    octets = fps.view(np.uint8).reshape(-1, 8)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if number[a] == number[b] and (octets[a] == octets[b]).sum() >= 5}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def test_a_long_cell_is_joined_by_neighbour_look_ups():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 18, 6000, dtype=np.uint64))
    forest = simhash._Forest(len(fps))
    for i in range(len(fps)):
        hit = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3)
        forest.union(np.full(len(hit), i), hit + i + 1)
    assert (simhash._join_cell(fps, (1 << 18) - 1) == forest.parent).all()


def test_long_cells_are_spread_over_tasks(spark):
    rng = np.random.default_rng(7)
    values = np.unique(rng.integers(0, 1 << 24, 3000, dtype=np.uint64)).view(np.int64).tolist()
    t = spark.createDataFrame([(v,) for v in values], "fp long")
    from terravote.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(t, 16, 64)).collect()}
    want = brute_components([(v, v) for v in values])
    assert Counter((v, f"{v:016x}", got.get(v, v)) for v in values) == want


def test_rows_that_repeat_a_doc_id_stay_or_go_by_their_texts(spark):
    from tests.llm.conftest import prose

    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(3, a, "p"), (5, a, "q"), (5, b, "r"), (7, c, "s"), (7, a, "t"), (3, a, "p"), (3, a, "u"), (None, b, "v"), (None, None, "w"), (None, "", "x"), (9, " ", "y"), (None, prose(4, 60), "z")]
    want = None
    for n in (1, 5):
        t = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").withColumn("__id", F.lit(1)).withColumn("__key", F.lit(2)).repartition(n)
        kept = simhash.keep_one_each(t)
        assert kept.columns == t.columns
        got = sorted(map(str, kept.collect()))
        assert want is None or got == want
        want = got
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts == Counter({(3, a): 1, (5, b): 1, (7, c): 1, (9, " "): 1, (None, prose(4, 60)): 1})


def test_one_document_of_each_group_stays(docs, empty):
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    groups = brute_components([(k, simple_print(r.text or "")) for k, r in enumerate(rows)])
    root = {k: c for (k, _, c) in groups}
    want = Counter()
    for c in set(root.values()):
        want[min((rows[k].doc_id is None, rows[k].doc_id or 0) for k in root if root[k] == c)] += 1
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want
    none_of(simhash.keep_one_each(empty), empty.columns)
    none_of(simhash.near_duplicates(empty), ["doc_id", "component_id"])


# 5. personal data


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t: str) -> list[str]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in EMAIL.finditer(t)]
    out += [("ip", m) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


ODD = [
    "é a@b.co%x@c.d.e and a..b@-c-.d-.e",
    "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 1.2.3.2555",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 41111111111111111111",
    "+1 (2) 345-67890 +12 +1234567 +12345678 +123456789012345 +1234567890123456 +1-(",
    "@@ a@ @b.c a@b 1@2.3 x@y.z@w.v",
    'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" and word aaaaaaaaaaaaaaaaaaaaaaaaaaaa',
]


def test_base_spans_match_the_plain_patterns(spark, docs):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(ODD * 3)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(t).collect()}
    for i, x in enumerate(ODD * 3):
        base = base_spans(x)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), x
        assert set(base) <= set(got[i].spans.split(",")) if base else True
        counts = Counter(s.split(":")[0] for s in base)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
    assert got[99].spans == "" and got[99].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "secret:9:49" in got[5].spans
    assert pii.personal_data(docs).count() == docs.count()


def test_addresses_with_zero_octets_are_found(spark):
    texts = ["at 10.0.0.1, 127.0.0.1 and 192.168.0.1", "0.0.0.0 00.000.0.0 255.0.255.0", "10.0.0.256 0256.0.0.1 " + "0" * 3000 + ".0.0." + "0" * 3000]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(t).collect()}
    for i, x in enumerate(texts):
        base = base_spans(x)
        assert got[i].n_ip == len(base) and got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert [got[i].n_ip for i in range(3)] == [3, 3, 1]
    assert {r.doc_id: r.text for r in pii.redacted(t).collect()}[0] == "at [ip], [ip] and [ip]"


def test_obfuscated_addresses_are_found(spark):
    odd = ["write jo(at)host.org now", "(jo.b[at]mail.host.org)", "f(at) x[at] (at)host.org a(at)b", "x" * 70 + "(at)host.org"]
    rows = [(i, f"mail jo{i}@x{i}.org now, or a{i}@b") for i in range(20)] + [(100 + i, x) for i, x in enumerate(odd)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + i] for i in range(4)] == ["mail:6:20", "mail:0:23", "", "mail:0:82"]
    alone = spark.createDataFrame([(1, "write jo(at)host.org now")], "doc_id long, text string")
    assert pii.redacted(alone).first().text == "write [mail] now"


def test_long_codes_without_context_stay(spark):
    code = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    clean = [f"see /news/2024/05/{10 + i % 20}/a-long-title-{i} and commit {code(i)} in it" for i in range(60)]
    clean += [f"order 2024-05-{10 + i % 20}-0000{i}-final-report was sent" for i in range(60)]
    held = [f'x{i} token = "{code(1000 + i)}" and wwwwwwwwwwwwwwwwwwwwwwwww' for i in range(30)]
    named = [f"x{i} phone: 212-555-{1000 + i} please" for i in range(30)]
    t = spark.createDataFrame(list(enumerate(clean + held + named)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(t).collect()}
    assert [got[i] for i in range(120)] == clean
    assert all(got[120 + i] == f'x{i} token = "[secret]" and wwwwwwwwwwwwwwwwwwwwwwwww' for i in range(30))
    assert all(got[150 + i] == f"x{i} phone: [number] please" for i in range(30))


def test_redaction_replaces_spans_and_keeps_columns(spark, docs, empty):
    t = spark.createDataFrame([(i, f"mail jo{i}@x{i}.org now, or +1 (212) 555-{1000 + i}.", 7, "mine") for i in range(20)] + [(90, None, None, "b"), (91, "clean words only", 16, "c")], "doc_id long, text string, n_chars long, base string")
    got = {r.doc_id: r for r in pii.redacted(t).collect()}
    assert got[3].text == "mail [email] now, or [phone]." and got[3].n_chars == len(got[3].text) and got[3].base == "mine"
    assert got[90].text is None and got[91].text == "clean words only"
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(docs).count() == docs.count()
    none_of(pii.redacted(empty), empty.columns)
    none_of(pii.personal_data(empty), ["doc_id", "spans"])


def test_no_tail_of_a_secret_or_address_stays(spark):
    key = lambda n: ("a1B2c3D4" * n)[:n]
    sizes = [20, 512, 513, 525, 5000, 100_000]
    rows = [(i, f'token = "{key(n)}" end') for i, n in enumerate(sizes * 4)] + [(100 + i, f"{'j' * n}(at){'host.' * n}org end") for i, n in enumerate([3, 64, 65, 300, 5000] * 4)]
    got = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(24)} == {'token = "[secret]" end'}
    assert {got[100 + i] for i in range(20)} == {"[mail] end"}


def test_no_character_of_a_secret_stays_around_base_spans(spark):
    body = "abcdefABCDEFghijKLMN"
    card = "4111111111111111"
    texts = {
        f'api_key="{body}{card}xyzXYZabcdef"': 'api_key="[secret]"',  # inside
        f"token={body}+4912345678": "token=[secret]",  # at the end
        f"token={card}{body}": "token=[card]",  # at the start, whose kind the whole span takes
        f"token={card}aB{card}cD{card}": "token=[card]",  # several
        f"token={body}+4912 345 678 now": "token=[secret] now",  # across the end
        f"token={body}/10.0.0.1 now": "token=[secret] now",
        f"secret={body}@host.org now": "secret=[email] now",  # the base span covers the secret
        f"password: {body}{body}.x@host.org": "password: [email]",
        "write jo(at)host.org, +4912345678 now": "write [mail] [phone] now",
        f"no name {card} here": "no name [card] here",
    }
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(t).collect()}
    for i, (text, want) in enumerate(texts.items()):
        assert not any(body[k : k + 6] in got[i] or card[k : k + 6] in got[i] for k in range(11)), (text, got[i])
        if "10.0.0.1" not in text:
            assert got[i] == want, text
    spans = {r.doc_id: r for r in pii.personal_data(t).collect()}
    for i, text in enumerate(texts):
        assert spans[i].base_sha256 == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
        assert set(filter(None, base_spans(text))) <= set(spans[i].spans.split(","))


def test_work_grows_with_the_text(spark):
    run = "a" * 300_000 + " " + "1" * 300_000 + " " + "a.b@" * 50_000 + " " + "x.y." * 50_000 + "@z.a " + "(at)" * 50_000 + " " + "+1" * 50_000
    seconds = {}
    for n in (10_000, 100_000):
        unit = "jo@x.org 10.0.0.1 +1 (212) 555-0100 jo(at)x.org é "
        t = spark.createDataFrame([(1, unit * n), (2, run)], "doc_id long, text string")
        began = time.monotonic()
        rows = {r.doc_id: r for r in pii.redacted(t).select("doc_id", F.sha2("text", 256).alias("x"), F.char_length("text").alias("n")).collect()}
        seconds[n] = time.monotonic() - began
        want = "[email] [ip] [phone] [mail] é " * n
        assert (rows[1].n, rows[1].x) == (len(want), hashlib.sha256(want.encode()).hexdigest())
    assert seconds[100_000] < 10 * seconds[10_000] + 20
    assert seconds[100_000] < 120


def test_running_results_and_overlaps_match_brute_force(spark):
    r = np.random.default_rng(4)
    for n in (0, 1, 127, 128, 129, 1000):
        x = r.integers(-50, 50, n).tolist()
        t = spark.createDataFrame([(x,)], "x array<bigint>")
        row = t.selectExpr(f"{arrays.running('x')} as s", f"{arrays.running('x', 'greatest(a, x)')} as m").first()
        assert row.s == [sum(x[:i]) for i in range(n)]
        assert row.m == [max([0, *x[:i]]) for i in range(n)]
    for n, m in ((0, 5), (5, 0), (300, 200), (40, 400)):
        cuts = np.sort(r.choice(3000, 2 * n, replace=False)).tolist()
        spans, others = list(zip(cuts[::2], cuts[1::2])), [(int(a), int(a + w)) for a, w in zip(r.integers(0, 3000, m), r.integers(1, 9, m))]
        t = spark.createDataFrame([(spans, others)], "a array<struct<start:bigint,end:bigint>>, b array<struct<start:bigint,end:bigint>>")
        assert t.selectExpr(f"{arrays.overlapped('a', 'b')} as o").first().o == [any(c < b and d > a for c, d in others) for a, b in spans]
        wide = spans[::3] + [(a, b + 5) for a, b in spans[::5]] + others
        t = spark.createDataFrame([(spans, wide)], "a array<struct<start:bigint,end:bigint>>, b array<struct<start:bigint,end:bigint>>")
        assert t.selectExpr(f"{arrays.covered('a', 'b')} as o").first().o == [any(c <= a and d >= b for c, d in wide) for a, b in spans]


def brute_candidates(t: str) -> list[tuple]:
    """(kind, start, end, features) of a text's candidates, by plain Python."""
    import regex

    flag, out = lambda x: int(bool(x)), []
    step = lambda v, edges: sum(v >= e for e in edges)

    def edge(c, joined):
        return 0 if c == "" or c in " \t\n\x0b\f\r" else 1 if c in "\"'`" else 2 if regex.fullmatch(f"[{joined}]", c) else 3

    for m in regex.finditer(r"(?<!\S)(?:[^\s@(\[]|(?!\(at\)|\[at\])[(\[])+(?:@|\(at\)|\[at\])[^\s@]+", t):
        v = m[0]
        at = regex.search(r"@|\(at\)|\[at\]", v)
        local, host = v[: at.start()], v[at.end() :]
        out.append(("mail", m.start(), m.end(), [0 if "@" in v else 1 if "(at)" in v else 2, step(host.count("."), [1, 2]), flag(regex.search(r"[.][A-Za-z]{2,}[^A-Za-z0-9]*$", host)), flag(regex.search("[A-Za-z0-9_%+-]$", local) and regex.match("[A-Za-z0-9]", host)), step(len(v), [8, 60]), flag(regex.match("[^A-Za-z0-9]", v))]))
    for m in regex.finditer(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}", t):
        v, digits = m[0], sum(c in "0123456789" for c in m[0])
        sides = [edge(t[m.start() - 1 : m.start()], r"\p{L}\p{N}_"), edge(t[m.end() : m.end() + 1], r"\p{L}\p{N}_")]
        out.append(("number", m.start(), m.end(), [step(digits, [8, 10, 13, 16, 20]), flag(")" in v), step(len(regex.sub(r"[0-9+(]", "", v)), [1, 2]), flag(regex.fullmatch(r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}", v)), *sides]))
    for m in regex.finditer(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}={0,2}", t):
        v = m[0]
        letters = regex.sub("[^A-Za-z]", "", v)
        sides = [edge(t[m.start() - 1 : m.start()], "=:"), edge(t[m.end() : m.end() + 1], ",;)")]
        out.append(("secret", m.start(), m.end(), [step(len(v), [28, 40, 64]), flag(regex.fullmatch("[0-9a-f]+|[0-9A-F]+", v)), step(10 * sum(c in "0123456789" for c in v) / len(v), [1, 3]), flag(letters != letters.lower() and letters != letters.upper()), *sides]))
    return out


def planted(n: int) -> tuple[list[tuple], dict]:
    """Documents with personal data that no base pattern finds, and clean ones that look alike; and the planted spans."""
    r, rows, spans = np.random.default_rng(8), [], {}
    code = lambda i, k=40: hashlib.sha512(str(i).encode()).hexdigest()[:k]
    for i in range(n):
        kind = i % 6
        name = "token" if i % 50 > 1 else "my_value"  # a few have no naming word
        say = "phone:" if i % 50 > 1 else "at"
        number = f"({200 + i % 700}) 555-{1000 + i % 9000}"
        lead = "é words before it " * int(r.integers(0, 4))
        text, find = [
            (f'{lead}{name} = "{code(i)}" and on', code(i)),
            (f"{lead}write jo{i}[at]x{i}.org now", f"jo{i}[at]x{i}.org"),
            (f"{lead}{say} {number} now", number),
            (f"{lead}see commit {code(i)} in it", None),
            (f"{lead}from 2024-05-{10 + i % 20} to page {1000000 + i} of /news/2024/05/{10 + i % 20}/a-long-title-{i}", None),
            (f"{lead}mail jo{i}@x{i}.org or a{i}@b", None),
        ][kind]
        rows.append((i, text))
        spans[i] = (text.index(find), text.index(find) + len(find)) if find else None
    return rows, spans


def test_added_spans_match_brute_force_with_measured_recall(spark):
    rows, spans = planted(1600)
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = pii.saved(pii.found_in(t))
    codes = set(pii.fit(found))
    got = {r.doc_id: r.spans for r in pii.personal_data(t).collect()}
    hit = clean = unnamed = 0
    for i, text in rows:
        base, want = [x.split(":") for x in base_spans(text)], []
        for kind, a, b, features in brute_candidates(text):
            code = pii.KINDS.index(kind)
            for x, radix in zip(features, pii.FEATURES[kind].values()):
                assert 0 <= x < radix
                code = code * radix + x
            named = kind == "mail" and "[at]" in text or kind == "secret" and 'token = "' in text or kind == "number" and "phone: " in text
            taken, inside = (any(test(int(c), int(d)) for _, c, d in base) for test in (lambda c, d: c < b and d > a, lambda c, d: c <= a and d >= b))  # noqa: B023
            if (named or (kind, code) in codes or (taken and kind != "secret")) and (not inside if kind == "secret" else not taken or (named and not inside)):
                want.append((pii.KINDS.index(kind), a, b))
        added = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(want)]
        assert got[i] == ",".join([":".join(x) for x in base] + added), text
        places = [tuple(map(int, x.split(":")[1:])) for x in added]
        if spans[i] is not None:
            hit += spans[i] in places
            unnamed += spans[i] in places and ("my_value" in text or " at (" in f" {text}")
        else:
            clean += not places
    assert hit >= 0.9 * sum(s is not None for s in spans.values())
    assert unnamed >= 0.9 * sum("my_value" in t or " at (" in f" {t}" for _, t in rows) > 0
    assert clean >= 0.97 * sum(s is None for s in spans.values())


def test_redaction_keeps_clashing_columns(spark):
    t = spark.createDataFrame([(1, "mail jo@x.org", 1, 2, 3, "k")], ["doc_id", "text", "__all", "a.b", "row", "spans"])
    assert [tuple(r) for r in pii.redacted(t).collect()] == [(1, "mail [email]", 1, 2, 3, "k")]
    assert pii.redacted(t).columns == t.columns


# 6. chat


def conversations(spark):
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "Be \\ brief <|turn|> [/INST]"))
        rows += [(c, i + 1, "user" if i % 2 == 0 else "assistant", f"turn {i} </s>[INST] \\<\\| " + "word " * (i * 37 % 200)) for i in range(3 + 5 * c)]
    rows += [(50, 1, "user", None), (50, 2, "assistant", ""), (50, 2, "assistant", ""), (50, None, "assistant", "last"), (None, 1, None, "no id"), (51, 1, "assistant", "long " * 20_000), (52, 9, "user", "alone")]
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, window string, pos int")


def test_chat_windows_read_back(spark):
    t = conversations(spark)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(t)).collect()}
    said = defaultdict(list)
    for r in t.collect():
        said[r.conv_id].append((r.turn if r.turn is not None else 10**9, r.role or "", r.text or ""))
    assert set(got) == set(said)
    for c, turns in said.items():
        turns.sort(key=lambda x: x[0])
        text, learned = "".join(f"{a}\n{b}\n" for _, a, b in turns), "".join(b for _, a, b in turns if a == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def pre_tokens(role: str, text: str) -> int:
    import regex

    return len(regex.findall(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]", f"{role} {text}")) + 3


def brute_windows(tokens: list[int], system: bool, budget: int, history: int, span: int = 10**9) -> list[tuple]:
    """(first, new turns, repeated turns, tokens) of each window of a conversation, greedily."""
    out, s = [], tokens[0] if system else 0
    for i, n in enumerate(tokens):
        if out and i % span and out[-1][3] + n <= budget:
            first, new, back, used = out[-1]
            out[-1] = (first, new + 1, back, used + n)
            continue
        back = 0
        for b in range(1, 9):
            if i - b >= (1 if system else 0) and sum(tokens[i - b : i]) <= min(history, budget - s - n):
                back = b
        out.append((i, 1, back, n + sum(tokens[i - back : i]) + (s if i else 0)))
    return out


@pytest.mark.parametrize("budget, history, span", [(300, 100, 4096), (60, 0, 4096), (120, 60, 16)])
def test_chat_windows_are_greedy_within_one_budget(spark, monkeypatch, budget, history, span):
    monkeypatch.setattr(chat, "RANGE", span)
    t = conversations(spark)
    said = defaultdict(list)
    for r in t.filter("conv_id < 50 or conv_id in (51, 52)").collect():
        said[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    got = defaultdict(list)
    for r in chat.format_chats(t, budget, history).collect():
        got[r.conv_id].append((r.first, r.n_new, r.n_context - r.has_system, r.n_tokens))
        assert r.formatted.count(chat.TURN) == r.n_new + r.n_context == r.formatted.count(chat.END)
        assert r.has_system == (r.conv_id is not None and r.conv_id < 12 and r.conv_id % 3 == 0 and r.first > 0)
        assert r.n_tokens <= budget or r.n_new == 1 and r.n_context == r.has_system
    for c, turns in said.items():
        turns.sort()
        tokens = [pre_tokens(role, text) for _, role, text in turns]
        assert sorted(got[c]) == brute_windows(tokens, turns[0][1] == "system", budget, history, span), c


def test_chat_escape_is_reversible(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>", "<<|turn|>|", "<\\|turn|>", "[\\INST]", "<|turn<|body|>|>", "a\nb\\"]
    t = spark.createDataFrame([(x,) for x in odd], "x string")
    for r in t.select("x", chat.unescape(chat.escape(F.col("x"))).alias("y"), chat.escape(F.col("x")).alias("e")).collect():
        assert r.x == r.y
        assert not any(c in r.e for c in chat.CONTROL)


def test_chat_of_nothing(spark):
    t = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    none_of(chat.read_back(chat.format_chats(t)), ["conv_id", "loss_sha256"])


# 7. token counts


def test_token_counts_match_the_library(docs, tok, empty):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, **BPE).collect())
    want = Counter()
    for d, t in plain(docs):
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want[d, len(t.encode()), n, n > 512] += 1
    assert got == want
    none_of(token_counts.token_counts(empty, **BPE), ["doc_id", "n_tokens"])


def test_both_encoders_agree_on_every_code_point(tok):
    fast = token_ids.ranked(BPE["ranks"], P.PATTERN)
    for start in range(0, 0x110000, 0x4000):
        texts = [f"a{chr(c)}1{chr(c)} {chr(c)}b {chr(c)}\n" for c in range(start, start + 0x4000) if not 0xD800 <= c < 0xE000]
        for t, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False)):
            assert fast(t) == e.ids


# 8. html


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><a href="/">Home</a></header>
<nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div><div class="post-{n} entry"><h1>T&amp;itle {n}</h1><p>First <b>bo</b>ld &lt;text&gt;
 here<br>and more words for the score<p>Second para &eacute;<div class="ad">Buy!</div><aside>side</aside><form>f</form></div>
<div id="comments"><p>A reader wrote a long comment that is even longer than the whole text of the article itself, on and on and on and on and on</p></div><footer>foot</footer></body></html>"""


def test_pages_give_the_article_alone(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.replace("{n}", str(i))) for i in range(6)] + [(10, None, None), (11, "odd", ""), (12, "http://h0.example.com/x", "<p>just <i>this</i>"), (13, "http://h0.example.com/y", "cut <p>off <a hre")]
    t = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_text.extract(t).collect()}
    for i in range(6):
        assert got[i].text == f"T&itle {i} First bold <text> here and more words for the score Second para é"
        assert got[i].n_chars == len(got[i].text)
    assert (got[10].text, got[11].text, got[12].text) == ("", "", "just this")
    assert got[13].text.startswith("cut off")
    none_of(html_text.extract(t.limit(0)), ["page_id", "text"])


def test_hosts_vote_for_their_path(spark):
    rows = [(i, "http://a.example.com/", f'<body><div class="c-{i}"><p>{"body text " * 20}</p></div><div class="x"><p>{"other words " * (30 if i == 0 else 3)}</p></div></body>') for i in range(9)]
    t = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(t).collect()}
    assert got[0].startswith("body text") and "other" not in got[0]


LAYOUTS = [
    ('<article><header><h1>Head {n}</h1></header><div class="entry-content"><p>{b}</p></div></article>', "Head {n} {b}"),
    ('<main><h1>Head {n}</h1><div class="lead"><p>Lead of the text {n}</p></div><div class="body"><p>{b}</p></div><ul><li><a href="/">Other page</a></li></ul></main>', "Head {n} Lead of the text {n} {b}"),
    ('<div class="post"><h2><a href="/">Head {n}</a></h2><div class="entry"><p>{b}</p></div><div class="share">Share</div></div><div class="x">Other words</div>', "Head {n} {b}"),
    ('<div class="wrapper story"><p>Not this</p><div class="text"><p>{b}</p></div></div>', "{b}"),
]


@pytest.mark.parametrize("layout, want", LAYOUTS)
def test_articles_of_several_containers_are_whole(spark, layout, want):
    fill = lambda x, i: x.replace("{n}", str(i)).replace("{b}", f"body text {i} " * 20 + "end")
    t = spark.createDataFrame([(i, "http://a.example.com/", f"<body><nav>Menu</nav>{fill(layout, i)}<footer>foot</footer></body>") for i in range(4)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(t).collect()} == {i: fill(want, i) for i in range(4)}


PROBES = [
    ("<p title=it's>hello <b class=x'>world</b> it's</p>", "hello world it's"),
    ("<p data-x='a>b' title=\"it's\">one</p><p =x \"y>two</p>", "one two"),
    ("<ul><li>one</li><li class=share><p>SHARE ME</p><div>AND ME</div></li><li>two<li>three</ul>", "one two three"),
    ("<div class='ad'><div><p>Buy<p>more</div></div><p>text<h2>Head<p>end", "text Head end"),
    ("<table><tr><td>a<td>b<tr><td class=advert><p>no<td>c</table><p>d", "a b c d"),
    ("<a href=/x/>in</a> <i>a</i>b &#233;&amp;&lt;p&gt;", "in ab é&<p>"),
]


@pytest.mark.parametrize("markup, want", PROBES)
def test_markup_is_read_as_browsers_do(markup, want):
    source = f"<body><nav>Menu</nav><article><p>{'body text ' * 9}start</p>{markup}</article><footer>foot</footer></body>"
    assert html_text.main_text(source, None) == f"{'body text ' * 9}start {want}"


NOISY = ["comments-container", "article-comments", "comments-wrapper", "content-ad", "cookie-wrapper", "main-nav", "page-footer", "sidebar-content", "related-posts", "searchForm", "post__comments", "ad-2 col"]
CLEAN = ["content", "post-body", "has-sidebar", "page with-nav", "related-work", "search-engines", "header-text", "adverb", "layout"]


@pytest.mark.parametrize("name", NOISY)
def test_names_of_boilerplate(name):
    body = "body text " * 9 + "end"
    for inner in (f'<div class="{name}"><p>{"other words " * 40}</p></div>', f'<section id="{name.split()[0]}">{"other words " * 40}</section>', f'<p>x<span class="{name}">no <b>words</b></span></p>'):
        got = html_text.main_text(f'<body><div class="post-body"><p>{body}</p>{inner}</div></body>', None)
        assert got in (body, body + " x"), (name, got)
        got = html_text.main_text(f'<body>{inner}<div class="post-body"><p>{body}</p></div>{inner}</body>', None)
        assert got == body


@pytest.mark.parametrize("name", CLEAN)
def test_names_that_only_sound_like_boilerplate(name):
    for tag in ("div", "section", "p", "span"):
        source = f'<article><p>{"body text " * 9}start</p><{tag} class="{name}" id="{name}">more words</{tag}></article>'
        assert html_text.main_text(source, None) == "body text " * 9 + "start more words"


def test_ids_of_headings_and_sections_stay():
    source = '<article><h1 id="ad">One</h1><h2 id="search-engines">Two</h2><p>body text and more</p><h2 id="social-media">Three</h2><section id="related-work"><h3 id="comments">Four</h3><p id="notice">five</p></section></article>'
    assert html_text.main_text(source, None) == "One Two body text and more Three Four five"


HIDDEN = [
    ("<div hidden>no</div>", ""), ('<div style="color:red; Display : none">no</div>', ""), ('<p style="visibility:hidden">no</p>', ""), ("<div data-hidden='1' title='hidden'>yes</div>", "yes"),
    ('a<span class="ad">Buy</span>b', "ab"), ('<a class="share-button" href="/">Share</a><p>c</p>', "c"), ('<span class="ad"><span>x</span>y</span>z', "z"), ('<p>a <a class="ad">no</p><p>b</p>', "a b"),
    ('<a class="ad"><div>no<p>no</div>no</a><p>d', "d"), ('<article class="comment"><p>words of a reader</p></article>', ""), ('<article class="share">own words</article>', "own words"), ('<p hidden="">no<div hidden id=x>no</div>e', "e"),
]


@pytest.mark.parametrize("markup, want", HIDDEN)
def test_hidden_and_inline_boilerplate_goes(markup, want):
    source = f"<body><article><p>{'body text ' * 9}start</p>{markup}</article></body>"
    assert html_text.main_text(source, None) == f"{'body text ' * 9}start {want}".strip()


def test_a_page_of_comments_and_menus_gives_its_post():
    long = "words of readers " * 60
    source = f'<body><div class="main-nav"><a>Home</a></div><div class="post-body"><p>the post itself</p></div><div class="page-footer">foot</div><div class="comments-container"><p>{long}</p></div></body>'
    assert html_text.main_text(source, None) == "the post itself"


def test_votes_match_brute_force(spark):
    r = np.random.default_rng(5)
    notice = "this house keeps its visitors informed of everything " * 3
    pages = []
    for i in range(60):
        body = "".join(f"<p>{' '.join(r.choice(['one', 'two', 'three', 'four'], 30))} {i}</p>" for _ in range(r.integers(1, 3)))
        pages.append((i, f"http://h{i % 3}.example.com/{i}", f'<body><div class="k{i}"><div class="box-{i % 2}">{notice}</div><div class="t-{i}">{body}</div><section class="x">{" ".join(r.choice(["a", "b"], 40))}</section></div></body>'))
    pages += [(100 + i, "http://copies.example.com/", f'<body><div class="only"><p>{notice}</p></div></body>') for i in range(9)]
    t = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", html_text._host()).repartition(5)
    votes, seen = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(set))
    for _, url, source in pages:
        host, page = url.split("/")[2], html_text.Page(source)
        found, (whole, texts) = page.scores(), page.digests()
        for path, s in found.items():
            if s >= 0.5 * max(found.values()):
                votes[host][path] += round(1000 * s / max(found.values()))
        for path, text in texts.items():
            seen[host][path].add((whole, text))
    got = {x.host: ([p % 2**64 for p in x.paths], {p % 2**64 for p in x.repeated}) for x in html_text.votes(t).collect()}
    assert set(got) == set(votes)
    for host, (paths, repeated) in got.items():
        assert repeated == {p for p, v in seen[host].items() if len(v) >= 5 * len({x for _, x in v})}
        left = {p: v for p, v in votes[host].items() if p not in repeated}
        assert paths == sorted(left, key=lambda p: (-left[p], p - (p >> 63 << 64)))[:8]
    assert all(len(got[f"h{k}.example.com"][1]) > 0 for k in range(3)) and not got["copies.example.com"][1]
    texts = {x.page_id: x.text for x in html_text.extract(t.drop("host")).collect()}
    assert all("visitors" not in texts[i] for i in range(60)) and all(texts[100 + i] == notice.strip() for i in range(9))


def random_page(r: np.random.Generator) -> tuple[str, str]:
    """A page of nested blocks, and its article's text as it was put in."""
    said: list[str] = []
    pick = lambda *x: x[r.integers(len(x))]

    def words(n=None):
        return " ".join(pick("alpha", "beta", "gamma", "it's", "&lt;x&gt;", "d&eacute;j&agrave;", "<b>bold</b>", "<i title=o'clock>it</i>", "one<br>two") for _ in range(n or r.integers(3, 12)))

    def plain(t):
        return html_unescape(re.sub(r"<br>", " ", re.sub(r"</?[bi]\b[^>]*>", "", t)))

    def attrs(cls=None):
        return pick("", " title=it's", " data-a='x>y'", ' data-b="<p>"', " id=k7", " data-hidden=''") + (pick(" class={}", " class='{}'", ' class="{} c1"').format(cls) if cls else "")

    def leaf(own):
        t = words()
        if own:
            said.append(plain(t))
        tag = pick("p", "p", "h2", "li", "blockquote", "pre")
        end = "" if tag == "p" and r.random() < 0.4 else f"</{tag}>"
        return f"<ul><li{attrs()}>{t}</ul>" if tag == "li" else f"<{tag}{attrs()}>{t}{end}"

    def noise(depth):
        inner = "".join(leaf(False) if depth > 2 or r.random() < 0.6 else node(depth + 1, False) for _ in range(r.integers(1, 4)))
        tag, cls = pick(("aside", None), ("nav", None), ("form", None), ("div", "ad"), ("div", "share"), ("section", "comments"), ("div", "cookie-notice"), ("ul", "menu"), ("footer", None))
        return f"<{tag}{attrs(cls)}>{inner}</{tag}>"

    def node(depth, own):
        inner = "".join((leaf(own) if depth > 3 or r.random() < 0.5 else node(depth + 1, own)) if r.random() < 0.8 else noise(depth + 1) for _ in range(r.integers(1, 5)))
        tag = pick("div", "section", "figure", "td")
        return f"<table{attrs()}><tr><td>{inner}</table>" if tag == "td" else f"<{tag}{attrs('part')}>{inner}</{tag}>"

    around = lambda: "".join(noise(1) for _ in range(r.integers(0, 4)))
    before, article = around(), "".join(leaf(True) if r.random() < 0.5 else node(1, True) for _ in range(r.integers(4, 12)))
    return f"<html><head><title>t</title></head><body>{before}<article{attrs()}>{article}</article>{around()}</body></html>", " ".join(" ".join(said).split())


def test_random_pages_give_back_what_was_put_in(spark):
    r = np.random.default_rng(12)
    pages = [random_page(r) for _ in range(300)]
    t = spark.createDataFrame([(i, f"http://h{i % 3}.example.com/{i}", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_text.extract(t).collect()}
    for i, (p, want) in enumerate(pages):
        assert got[i] == want, p


def test_memory_grows_with_the_page_alone():
    import tracemalloc

    for source in ("<table>" + "<tr><td>cell" * 50_000, "<div><section>x" * 50_000, "<ul><li>" * 50_000 + "x" + "</ul>" * 50_000, "<a b='" * 100_000, "<p a= = =" * 100_000):
        tracemalloc.start()
        began = time.monotonic()
        html_text.main_text(source, None)
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert peak < 200e6 and time.monotonic() - began < 30


# 9. mixing


def fair_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in stopped), sum(weight[s] for s in names if s not in stopped)
        out = {s: 3 * sizes[s] if s in stopped else left * weight[s] / w for s in names}
        more = {s for s in names if s not in stopped and out[s] > 3 * sizes[s]}
        if not more:
            return out
        stopped |= more


def test_mixing_meets_targets(docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    by_source, size = defaultdict(int), Counter()
    for r in docs.collect():
        by_source[r.source] += len(WORD.findall(r.text or ""))
    want = fair_targets(by_source)
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(by_source[s], round(want[s], 6)) for s in by_source}
    for r in got:
        assert r.taken == r.size * len(r.shards) and r.taken <= 3 * r.size
        size[r.target] += r.taken
    biggest = max(r.size for r in got)
    for s in by_source:
        assert abs(size[want[s]] - want[s]) <= biggest or list(want.values()).count(want[s]) > 1
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mixing_takes_an_even_corpus_closely(spark):
    t = spark.createDataFrame([(i, "w " * (5 + i % 30), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    m = mixing.mix_sources(t).groupBy("target").agg(F.sum("taken").alias("taken"), F.max(F.size("shards")) - F.min(F.size("shards"))).collect()
    assert all(abs(r.taken / r.target - 1) < 0.01 for r in m)
    assert all(r[2] <= 1 for r in m)


def test_every_source_ends_within_one_document_of_its_target(spark):
    r = np.random.default_rng(3)
    rows = [(i, "w " * int(r.integers(1, 900)), f"s{i % 7}") for i in range(700)]
    rows += [(5, "same words here " * 20, "hot")] * 1000 + [(None, "none of these words", None)] * 300
    t = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix_sources(t).collect()
    taken, sizes, want = Counter(), defaultdict(list), {}
    for x in got:
        taken[x.target, x.source_size] += x.taken
        sizes[x.target, x.source_size].append(x.size)
        assert x.taken <= 3 * x.size
    for k, n in taken.items():
        assert abs(n - k[0]) <= max(sizes[k]), k
    again = mixing.mix_sources(t.repartition(3)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert len({x.taken for x in got if x.doc_id == 5 and x.size == 60}) == 2


def test_mixed_keeps_clashing_columns(spark):
    t = spark.createDataFrame([(i, "some words", "s", i, 2, 3, 4) for i in range(40)], ["doc_id", "text", "source", "__id", "a.b", "draw", "shards"])
    out = mixing.mixed(t)
    assert out.columns == t.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in t.collect()}


def test_splitting_tree_keeps_exact_quotas(spark):
    q = spark.createDataFrame([("a", 1000), ("b", 37), (None, 500)], "source string, quota long")
    got = mixing.split(q, 7).collect()
    assert {s: sum(r.quota for r in got if r.source == s) for s in ("a", "b", None)} == {"a": 1000, "b": 37, None: 500}
    loads = Counter()
    for r in got:
        loads[r.shard] += r.quota
    assert max(loads.values()) - min(loads.values()) <= 3


def test_mixed_documents_repeat_whole_rows(docs, empty):
    taken = Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r.doc_id] += len(r.shards)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +taken
    none_of(mixing.mixed(empty), empty.columns)
    none_of(mixing.mix_sources(empty), ["doc_id", "taken"])


# 10. search


def brute_search(rows, k=5):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = [int(np.floor(256 * float(np.float32(x)))) for x in v]
    out = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 40), (3, 400)])
def test_search_is_exact(spark, blocks):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(0, 1, 8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (0, rows[0][1])]
    t = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, query_id string, rank int")
    entries = []
    got = topk.top_k(t, query_rows=blocks[0], rows=blocks[1], collected=entries).collect()
    assert sum(e.count() for e in entries) < 0.5 * 2 * 8 * 380  # of the scores of two lists, few are collected
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_search(rows)


def test_search_of_large_numbers_and_ties(spark):
    rows = [(i, [float(1e6 + i % 3), -1e6, float(i % 2), 3.0, 0.25]) for i in range(60)] + [(100 + i, [0.0] * 5) for i in range(20)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = [(q, r + 1, i, -s) for q in whole if q % 50 == 0 for r, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(t, rows=16, parts=3).collect()]
    assert sorted(got) == sorted(want)


def test_search_with_few_or_no_rows(spark):
    t = spark.createDataFrame([(0, [1.0, 2.0]), (7, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in topk.top_k(t).collect()] == [(0, 1, 7)]
    none_of(topk.top_k(t.limit(0)), ["query_id", "score"])
    none_of(topk.top_k(t.filter("vec_id = 0")), ["query_id", "score"])
