"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from vectide.llm import resample

SCHEMA = "doc_id long, text string, lang string, weight string, n_words int, digest string, SCORE string"


def made():
    r = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("al", "be", "Éa", "Cu", "d7") for b in ("x", "yo", "za", "'m")]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    texts = [text(r.randrange(0, 60)) for _ in range(150)]
    texts += [texts[7]] * 120 + [None, "", "  ", None, "İ \x7f B", text(30_000)]
    rows = [(i, t, "en", "w", 1, "d", "s") for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None, None, None), (None, texts[3], None, None, None, None, None), rows[9]]
    return rows, [(1, text(40), 1), (1, texts[5], 1), (2, None, 1)]


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_resampled(spark):
    rows, target = made()
    docs = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame(target, "item_id long, text string, TEXT2 int")
    s, t = (Counter(b for x in table for b in features(x[1])[1]) for table in (rows, target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    want, may = [], []
    for d, text, *_ in rows:
        n, f = features(text)
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append([d, len(f), weight, score, None])
        if n >= 20:
            may.append(want[-1])
    for rank, row in enumerate(sorted(may, key=lambda x: (-x[3], x[0] is not None, x[0] or 0))[: 5 * len(may) // 100], 1):
        row[4] = rank
    got = [list(r) for r in resample.resampled(docs, items).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[4] is not None for x in got) == 5 * len(may) // 100 > 5
    drawn = resample.drawn_documents(docs, items)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {x[0] for x in want if x[4] is not None}


def test_empty(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert resample.resampled(docs, items).count() == 0
    rows, _ = made()
    assert resample.resampled(spark.createDataFrame(rows, SCHEMA), items).count() == len(rows)
