"""Character models against dictionaries of counts, and predictions by held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vectide.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, key long, bits string, LANG2 string"
SYLLABLES = {"en": "the of ing and er ion th re", "de": "der sch und ung ein ich keit be", "fr": "le que eau ment ez oui ai é"}


def made(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        s = SYLLABLES[lang].split()
        words = ["".join(r.choices(s, k=r.randrange(1, 4))) for _ in range(r.randrange(3, 60))]
        out.append((i, " ".join(words).capitalize() + ".", lang, None, 1, "x", "y"))
    return out


EDGES = [(10_000, None, "en"), (10_001, "", "de"), (10_002, "12 34 !?", None), (None, "the other", "en"), (10_004, "der und " * 90_000, "de"), (10_005, "ΑΒΓ \x01 字", None), (10_000, None, "en")]


def brute(texts):
    """Bits of a text by language, by the textbook formulas over dictionaries."""
    models = {}
    for lang in {x for _, x in texts}:
        grams = Counter(k for t, x in texts if x == lang for k in keys(t))
        levels = []
        for size in range(language.ORDER, 0, -1):
            n1, n2 = sum(v == 1 for v in grams.values()), sum(v == 2 for v in grams.values())
            d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5))
            total, types = Counter(), Counter()
            for k, v in grams.items():
                total[k[:-1]] += v
                types[k[:-1]] += 1
            levels.append((dict(grams), total, types, d))
            lower = defaultdict(int)
            for k in grams:
                lower[k[1:]] += 1
            grams = Counter(lower)
        models[lang] = levels[::-1]

    def bits(t, lang):
        out = 0.0
        for k in keys(t):
            p = 1 / language.CODES
            for size, (grams, total, types, d) in enumerate(models[lang], 1):
                g = k[-size:]
                if g[:-1] in total:
                    p = max(grams.get(g, 0) - d, 0) / total[g[:-1]] + d * types[g[:-1]] / total[g[:-1]] * p
            out -= math.log2(p)
        return out

    return bits


def keys(text):
    out = [-1] * 4
    for c in (text or "").lower():
        if c.isalpha():
            out.append(2 + ord(c) % (language.CODES - 2))
        elif out[-1] > 0:
            out.append(0)
    return [tuple(out[i - 4 : i + 1]) for i in range(4, len(out))]


@pytest.fixture(scope="module")
def table(spark):
    rows = made(1, 400) + [(i, t, x, None, 1, "x", "y") for i, t, x in EDGES]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("model_keys", [language.MODEL_ROWS, 500])
def test_languages(spark, table, monkeypatch, model_keys):
    rows, docs = table
    monkeypatch.setattr(language, "PIECE", 5_000)
    got = language.languages(docs, model_keys).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4
    assert len(got) == len(rows) and all(r.held_out == (fold(r.doc_id) == 2) and 0 <= r.score <= 1 for r in got)
    bits = brute([(t, x) for i, t, x, *_ in rows if fold(i) != 2 and x is not None])
    by = {r.doc_id: r for r in got}
    for i, t, *_ in [*rows[:60], *rows[400:]]:
        if not any(c.isalpha() for c in t or ""):
            assert by[i].lang_pred == "und" and by[i].score == 0
        else:
            each = {x: bits(t[:2_000] if len(t) > 9_999 else t, x) for x in SYLLABLES}
            assert by[i].lang_pred == min(each, key=lambda x: (each[x], x))
            if len(t) < 9_999:
                assert by[i].bits_per_symbol == pytest.approx(min(each.values()) / len(keys(t)), rel=1e-5)
    truth = {r[0]: r[2] for r in rows[:400]}
    held = [by[i] for i in truth if fold(i) == 2]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert by[10_004].score > 0.9 and not by[10_004].rejected


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some", None, None, 1, "x", "y")], SCHEMA)
    assert [tuple(r)[:4] for r in language.languages(docs).collect()] == [(1, False, "und", 0.0)]
    assert language.languages(docs.filter("false")).count() == 0


def test_monotone():
    share = language.monotone(np.array([0.0, 9.0, 3.0, 50.0]), np.array([10.0, 10.0, 10.0, 50.0]))
    assert (np.diff(share) >= 0).all() and share[1] == share[2] == 14 / 24
