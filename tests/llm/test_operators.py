"""Each operator against a brute-force version on small tables, with nulls, empty and repeated rows, and extra columns."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
import xxhash

from vectide.llm import automata, decontaminate, golay, mixing, neighbours, passages, phrases, records, secrets, sharding, simhash, toxicity
from vectide.llm.common import components, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"
WORDS = "the of and to in a is that it was for on are with his they be at one have this from by hot word but what some we can out other were all there when up use your how said an each she".split()


def make(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, None, (sources or ["s"])[i % len(sources or ["s"])], None, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def text(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    base = [text(r, r.randrange(1, 120)) for _ in range(60)]
    base += [base[3]] * 25 + [base[5] + " more", "", None, "   \n\t ", "A b", "É è ß Ünï"]
    shared = text(r, 70)
    base += [text(r, 20) + " " + shared + " " + text(r, 20) for _ in range(6)]
    base += [text(r, 9000)]
    return base


@pytest.fixture(scope="module")
def docs(spark, texts):
    return make(spark, texts, ["a", "b", None, "c", "a"]).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, texts):
    d = sharding.shard(docs).toPandas()
    assert len(d) == len(texts) and set(d.law) == {"bytes"} and d.grown_shard.isna().all()
    by = {r.doc_id: r for r in d.itertuples()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert by[i].size == len(raw) + 1 and by[i].text_crc32 == zlib.crc32(raw)
    for _, g in d.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert d.shard.between(0, 15).all()


ODD = "`0` int, doc_id long, text string, DOC_ID string, Text int, __id int, __fp int, __n int, __block int, __w int, g int, k int, c0 int, c1 int, source string, item_id int, fp int, id int, n int, h int, size int, lang string"


@pytest.fixture
def odd(spark):
    """Columns that clash with names inside, and in case."""
    spark.conf.set("spark.sql.caseSensitive", "true")  # such a table can be made in this way only
    r = random.Random(21)
    a, b = text(r, 70), text(r, 70)
    texts = [a, b, a, f"{b} {text(r, 40)}", None, ""]
    rows = [(0, i, t, "x", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, "s", 11, 12, 13, 14, 15, 16, "en") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ODD)
    yield df
    spark.conf.set("spark.sql.caseSensitive", "false")


def test_clashing_columns(spark, odd):
    plain = odd.select("doc_id", "text", "source", "lang")
    spark.conf.set("spark.sql.caseSensitive", "false")
    items = spark.createDataFrame([(1, plain.first()["text"][:60], 2)], "item_id long, text string, doc_id int")
    labels = spark.createDataFrame([(0, 1, 1, 2)], "doc_id long, quality int, toxic int, text int")
    for f in (sharding.shard, secrets.secrets, simhash.near_duplicates, phrases.removed, passages.passages, records.tokenized, lambda d: mixing.mix(d).by_document(), lambda d: toxicity.toxicity(d, labels), lambda d: decontaminate.contamination(d, items)):
        key = lambda x: tuple(str(v) for v in x.asDict().values())
        assert sorted(f(odd).collect(), key=key) == sorted(f(plain).collect(), key=key)
    for f, left in ((simhash.one_of_each, {0, 1, 3, 4}), (lambda d: decontaminate.without_contaminated(d, items), {1, 3, 4, 5}), (lambda d: toxicity.without_toxic(d, labels), set(range(6)))):
        out = f(odd)
        assert out.columns == odd.columns and {x[1] for x in out.collect()} == left
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_sharding_balances_and_keeps_groups(spark):
    r = random.Random(1)
    d = sharding.shard(make(spark, [text(r, 10 + i % 50) for i in range(900)] + ["same text here"] * 450)).toPandas()
    sums = d.groupby("shard")["size"].sum()
    assert sums.max() / sums.mean() < 1.03 and len(sums) == 16
    assert d[d["size"] == 15].shard.nunique() > 1  # a third of all rows: split
    e = sharding.shard(make(spark, [text(r, 30) for i in range(600)] + ["few copies"] * 5)).toPandas()
    assert e[e["size"] == 11].shard.nunique() == 1


def test_pack_takes_the_highest_dot_product():
    r = np.random.default_rng(3)
    items, room = r.random((80, 3)) / 80, np.full((5, 3), 0.2)
    got, left = sharding.pack(items, room.copy()), [[0.2] * 3 for _ in range(5)]
    for v, j in zip(items, got, strict=True):
        dots = [sum(w * a * b for w, a, b in zip(sharding.DIMENSION_WEIGHTS, x, v, strict=True)) for x in left]
        assert dots[j] == pytest.approx(max(dots), rel=1e-12)
        left[j] = [a - b for a, b in zip(left[j], v, strict=True)]
    assert np.array_equal(sharding.pack(np.zeros((3, 3)), room.copy()), [0, 0, 0])  # a tie: the first


def test_pack_by_cells_matches_all(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE_SHARE", 1.0)
    monkeypatch.setattr(sharding, "CELL_ITEMS", 200)
    r = random.Random(1)
    d = sharding.shard(make(spark, [text(r, 10 + i % 50) for i in range(1500)])).toPandas()
    sums = d.groupby("shard")["size"].sum()
    assert len(d) == 1500 and sums.max() / sums.mean() < 1.1


def test_empty_tables(spark, empty):
    for f in (sharding.shard, secrets.secrets, simhash.near_duplicates, phrases.removed, passages.passages, records.tokenized):
        assert f(empty).count() == 0
    assert mixing.mix(empty).by_document().count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert toxicity.toxicity(empty, labels).count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(v, v).count() == 0


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        new = [i + 1]
        for j, y in enumerate(t):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_distance():
    r = random.Random(2)
    for _ in range(300):
        p, t = [r.choice("abc") for _ in range(r.randint(1, 12))], [r.choice("abc") for _ in range(r.randint(0, 20))]
        d, end = decontaminate.best_match(p, t)
        assert d == brute_distance(p, t)
        if d < len(p):
            s = decontaminate.match_start(p, t, end)
            full = [[max(i, j) if not i or not j else 0 for j in range(end - s + 1)] for i in range(len(p) + 1)]
            for i in range(1, len(p) + 1):
                for j in range(1, end - s + 1):
                    full[i][j] = min(full[i - 1][j - 1] + (p[i - 1] != t[s + j - 1]), full[i - 1][j] + 1, full[i][j - 1] + 1)
            assert full[-1][-1] == d


def test_decontamination_matches_brute_force(spark, monkeypatch):
    r = random.Random(3)
    items = [text(r, r.randrange(5, 30)) for _ in range(12)] + ["", None, "one two"]
    base = []
    for i in range(60):
        w = text(r, 40).split()
        if i % 2:
            p = (items[i % 12]).split()
            for _ in range(r.randrange(0, 6)):
                j = r.randrange(len(p))
                p[j : j + 1] = r.choice([[], [p[j], "new"], ["other"]])
                p = p or ["x"]
            w[10:10] = p
        base.append(" ".join(w).upper() if i % 3 else ", ".join(w))
    docs = make(spark, [*base, None, ""])
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    want = set()
    for i, t in enumerate(base):
        for j, q in enumerate(items):
            w = decontaminate.words_of(q)
            if w and brute_distance(w, decontaminate.words_of(t)) <= int(0.2 * len(w)):
                want.add((i, j))
    for size in (decontaminate.BLOCK_BYTES, 100):
        monkeypatch.setattr(decontaminate, "blocks", lambda x, n=size, f=decontaminate.blocks: f(x, n))
        got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contamination(docs, bench).collect()}
        assert got == want and want
    left = {x["doc_id"] for x in decontaminate.without_contaminated(docs, bench).collect()}
    assert left == set(range(62)) - {i for i, _ in want}


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((700, 24)).astype(np.float32)
    x[100:400] = x[100]  # a hot group of equal vectors
    rows = [(i, [float(v) for v in a], "z") for i, a in enumerate(x)]
    rows += [(900, None, "z"), (1000, [0.0] * 24, "z"), (1100, [float("nan")] * 24, "z"), (1200, [1.0, None], "z"), (1300, [1.0, 2.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = neighbours.nearest(df, df.filter("vec_id % 100 = 0")).toPandas()
    hit = n = 0
    for q in range(0, 700, 100):
        s = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        s[q] = np.inf
        want = np.lexsort((np.arange(700), s))[:10]
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.array_equal(g.score, s[g.vec_id])
        assert list(zip(g.score, g.vec_id, strict=True)) == sorted(zip(g.score, g.vec_id, strict=True))
        hit, n = hit + len(set(want) & set(g.vec_id)), n + 10
    assert hit / n >= 0.9 and set(got.query_id) == set(range(0, 700, 100))


def test_neighbours_of_small_tables_are_all(spark):
    df = spark.createDataFrame([(i, [float(i + 1), float(i * i), 1.0]) for i in range(8)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id = 0")).toPandas()
    assert sorted(got.vec_id) == list(range(1, 8))


def test_blocks_of_buckets_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(r.standard_normal((400, 8)))], "vec_id long, embedding array<double>")
    q = df.filter("vec_id % 20 = 0")
    key = ["query_id", "rank"]
    a = neighbours.nearest(df, q).orderBy(*key).toPandas()
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbours, "BLOCK_PROBES", 300)
    monkeypatch.setattr(neighbours, "BLOCK_PAIRS", 5)
    assert neighbours.nearest(df, q).orderBy(*key).toPandas().equals(a)


def test_copies_and_repeated_ids_of_vectors(spark):
    r = np.random.default_rng(4)
    x = [[float(v) for v in a] for a in r.standard_normal((40, 8))]
    rows = [(i, x[i % 40], "a") for i in range(160)] + [(7, x[7], "b"), (5, x[6], "c"), (None, x[1], "d"), (300, x[3], "e"), (300, x[2], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = neighbours.nearest(df, df.filter("vec_id IN (0, 5, 7, 300)")).toPandas()
    for q, v in ((0, x[0]), (5, min(x[5], x[6])), (7, x[7]), (300, min(x[2], x[3]))):
        near = {(float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w, _ in rows if i is not None and i != q}
        g = got[got.query_id == q].sort_values("rank")
        assert list(zip(g.score, g.vec_id, strict=True)) == sorted(near)[:10]


def test_depth_of_hashes_follows_the_table():
    assert [neighbours.depths(n, 64) for n in (2_000, 10_000, 50_000, 400_000)] == [[64, 8], [64, 32], [64, 64], [64, 64, 8]]
    assert neighbours.probes_for(60_000, [64, 64]) < 50 and neighbours.probes_for(400_000, [64, 64, 8]) > 200


def test_a_query_meets_a_small_share_of_rows(spark):
    x = np.random.default_rng(6).standard_normal((30_000, 64)).astype(np.float32)
    dims = neighbours.depths(len(x), 64)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    q, met, hit = list(range(0, 30_000, 500)), np.zeros((60, 30_000), dtype=bool), 0
    for t in range(neighbours.TABLES):
        own, near = neighbours.codes(unit, dims, t), neighbours.nearest_codes(unit[:, q], dims, t, neighbours.probes_for(len(x), dims))
        for i in range(60):
            met[i] |= np.isin(own, near[i])
    for i, at in enumerate(q):
        d = ((x - x[at]) ** 2).sum(axis=1)
        d[at] = np.inf
        hit += met[i, np.argsort(d)[:10]].sum()
    assert met.mean() < 0.2 and hit / 600 >= 0.9


def base_spans(t):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [x[2] for x in sorted(out)]


def test_secrets(spark):
    r = random.Random(5)
    keys = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(40)]
    texts = [f"word É AKIA{k} then" for k in keys] + ['PassWord = "abc123xyz" ſecret=abcdefgh', "token:short token = longer_one", "deadbeef" * 4 + " end", "x AKIAAKIA" + keys[0], None, "", "plain words only", "apikey=zzz api_key= 'q1w2e3r4'"]
    texts += [f"id-{i}-ordinary-name-{i}-part-{i}-x" for i in range(40)]
    docs = make(spark, texts)
    got = {x["doc_id"]: x for x in secrets.secrets(docs).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("learned")] == want
        assert got[i]["n_access"] == sum(s.startswith("access") for s in want)
    assert all(got[len(texts) - 1 - i]["n_learned"] == 0 for i in range(40))


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 1.0])
def test_unlabelled_credentials_are_learned(spark, share):
    r = random.Random(5)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [f"password = {key(40)} end" for _ in range(300)]
    bare = [r.random() < share for _ in range(200)]
    texts += [f"see {key(40)} there" if b else f"see id-{i}-ordinary-name-{i}-part-{i}-x there" for i, b in enumerate(bare)]
    got = {x["doc_id"]: x for x in secrets.secrets(make(spark, texts)).collect()}
    assert all((got[300 + i]["n_learned"] == 1) == b for i, b in enumerate(bare))
    assert all(got[300 + i]["spans"] == "learned:4:44" for i, b in enumerate(bare) if b)
    assert all(got[i]["n_learned"] == 0 and got[i]["n_assign"] == 1 for i in range(300))


def test_short_credentials_are_learned_and_ordinary_strings_left_alone(spark):
    """Keys of 12 characters, as long as the labelled ones; words in capitals, numbers, addresses and names stay."""
    r = random.Random(6)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    plain = ["ERNDONTH", "4041894974608795", "42.144.35.254", "mail8.example.com", "555-2485", "Thingingtion", "readme.md", "ANOTHERWORD"]
    words = lambda: " ".join((r.choice(WORDS) + r.choice(WORDS)).upper() if r.random() < 0.02 else r.choice(WORDS) + r.choice(WORDS) for _ in range(30))
    texts = [f"{words()} token={key(12)} end" for _ in range(300)] + [f"{words()} {key(12)} there" for _ in range(100)] + [f"{words()} {p} there" for p in plain for _ in range(12)]
    got = {x["doc_id"]: x for x in secrets.secrets(make(spark, texts)).collect()}
    assert sum(got[300 + i]["n_learned"] == 1 for i in range(100)) >= 95
    assert sum(got[i]["n_learned"] for i in [*range(300), *range(400, len(texts))]) == 0


def test_candidates_walk_once():
    some = "password=abcdef123456 wordwords "
    long = some * 150_000  # 4.8 million characters
    base = secrets.base_spans(long)
    start = time.perf_counter()
    found = secrets.candidates(long, base)
    assert len(base) == len(found) == 150_000 and time.perf_counter() - start < 10
    tangled = "secret=" + "ab12" * 8 + "==x y" + "0f" * 14 + " zzzzzz AKIA" + "B" * 20
    base = secrets.base_spans(tangled)
    assert secrets.candidates(tangled, base) == [(a, b, tangled[a:b]) for a, b in (m.span() for m in re.finditer("[A-Za-z0-9+/_.=-]{6,}", tangled)) if not any(x < b and a < y for _, x, y, _ in base)]


def test_automaton():
    a = automata.Automaton(["ab", "aab", "aaab", "b"] * 50)
    assert a.log_likelihood("aab") > a.log_likelihood("bba") and len(a.next) <= 5
    assert automata.symbols("aZ9-g") == "hUd-l"


def test_mixing(docs, texts):
    d = mixing.mix(docs, block=16).by_document().toPandas()
    assert len(d) == len(texts) and d.doc_id.nunique() == len(texts)
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert d.set_index("doc_id").loc[range(len(texts)), "size"].tolist() == sizes
    names = ["a", "b", None, "c", "a"]
    d["source"] = [str(names[i % 5]) for i in d.doc_id]
    want = mixing.targets({s: sum(n for i, n in enumerate(sizes) if names[i % 5] == s) for s in ("a", "b", "c", None)})
    for s, g in d.groupby("source"):
        t = want[None if s == "None" else s]
        assert g.target.iloc[0] == t and abs(g.taken.sum() - t) <= 1
    assert (d.taken <= 3 * d["size"]).all()
    assert mixing.mix(docs, block=16).by_document().orderBy("doc_id").toPandas().equals(d.drop(columns="source").sort_values("doc_id", ignore_index=True))


def test_targets():
    t = mixing.targets({"a": 100, "b": 10, None: 300})
    assert t["b"] == 30 and abs(sum(t.values()) - 410) < 1e-9 and abs(t["a"] * 3 - t[None]) < 1e-9
    assert mixing.targets({"a": 0}) == {"a": 0.0}


def test_permutations():
    for n in (1, 2, 5, 64, 1000):
        for k in (0, 9):
            assert sorted(mixing.permuted(np.arange(n), np.array(n), np.uint64(k)).tolist()) == list(range(n))


def test_inverse_permutations():
    for n in (1, 2, 7, 64, 1000, 10**12):
        x = np.array([0, n // 3, n - 1])
        for k in (0, 9):
            y = mixing.permuted(x, np.array(n), np.uint64(k))
            assert (y < n).all() and mixing.permuted(y, np.array(n), np.uint64(k), back=True).tolist() == x.tolist()


@pytest.mark.parametrize("good, bad, take", [(60, 40, 50), (3, 900, 100), (500, 2, 400), (7, 9, 16), (1, 1, 1)])
def test_hypergeometric_law_beyond_numpy(monkeypatch, good, bad, take):
    """The law that is summed up is the exact one."""
    from math import comb

    monkeypatch.setattr(mixing, "NUMPY_SLOTS", 0)
    rng, times = np.random.default_rng(1), 4_000
    got = np.bincount([mixing.hypergeometric(good, bad, take, rng) for _ in range(times)], minlength=good + 1) / times
    want = np.array([comb(good, k) * comb(bad, take - k) / comb(good + bad, take) if 0 <= take - k <= bad else 0.0 for k in range(good + 1)])
    assert np.abs(np.cumsum(got) - np.cumsum(want)).max() < 2 / np.sqrt(times) and (got[want == 0] == 0).all()


def test_targets_by_filling_up():
    """Targets against a plain filling: words are handed out by weight, a little at a time, and full sources get no more."""
    r = random.Random(2)
    for _ in range(20):
        names = [*"abcdef"[: r.randrange(1, 6)], None]
        sizes = {n: r.choice([0, 1, 5, 40, 300]) for n in names}
        got, total = mixing.targets(sizes), sum(sizes.values())
        have, left = dict.fromkeys(names, 0.0), float(total)
        while left > 1e-9:
            open_ = {n: i % 3 + 1 for i, n in enumerate(names) if have[n] < 3 * sizes[n] - 1e-12}
            rate = sum(open_.values())
            step = min(left, *((3 * sizes[n] - have[n]) * rate / w for n, w in open_.items()))
            for n, w in open_.items():
                have[n] += step * w / rate
            left -= step
        assert all(abs(got[n] - have[n]) < 1e-6 * (total + 1) for n in names)


def test_counts_of_shards_are_multinomial_given_totals():
    have, per, shards = np.array([5_000, 0, 1_200, 37]), 100, 63
    got = [mixing.counts_of(i, shards, per, have, 4) for i in range(shards)]
    counts = np.array([c for c, _ in got])
    assert (counts.sum(axis=0) == have).all() and (counts[:-1].sum(axis=1) == per).all() and (counts >= 0).all()
    assert all((b == counts[:i].sum(axis=0)).all() for i, (_, b) in enumerate(got))
    many = np.array([mixing.counts_of(0, 2, 50, np.array([60, 40]), s)[0][0] for s in range(3_000)])
    assert abs(many.mean() - 30) < 0.3 and abs(many.var() - 50 * 0.6 * 0.4 * 50 / 99) < 0.5
    big = np.array([4 * 10**9, 2 * 10**9, 0, 5])
    left = mixing.drawn(big, 3 * 10**9, np.random.default_rng(1))
    assert left.sum() == 3 * 10**9 and (left <= big).all() and abs(left[0] / 2e9 - 1) < 1e-3


def test_mixed_documents(docs, texts):
    m = mixing.mix(docs, block=16)
    taken = {r["doc_id"]: r["taken"] for r in m.by_document().collect()}
    rows = mixing.mixed_documents(docs, block=16).collect()
    got = {}
    for r in rows:
        words = r["text"].split()
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words)
        if len(words) == len((texts[r["doc_id"]] or "").split()):
            assert r["text"] == texts[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert got == {k: v for k, v in taken.items() if v}


def slow_fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fp = [slow_fingerprint(t) for t in texts]
    want = roots(range(len(fp)), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    for i in range(len(fp)):
        assert got[i]["fingerprint"] == f"{fp[i]:016x}" and got[i]["component_id"] == want[i]
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert kept == sorted(set(want.values()))


def test_filters_decide_by_row_and_not_by_id(spark):
    r = random.Random(15)
    a, b, c, e = (text(r, 60) for _ in range(4))
    docs = make(spark, [a, b, b, c, e, e], ids=[None, None, 11, 5, 5, 5])
    assert sorted(x["text"] for x in simhash.one_of_each(docs).collect()) == sorted([a, b, c, e])
    item = text(r, 12)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = make(spark, [a, f"{b} {item}", c, f"{e} {item}"], ids=[None, None, 5, 5])
    assert sorted(x["text"] for x in decontaminate.without_contaminated(rows, bench).collect()) == sorted([a, c])
    bad = [f"{text(r, 8)} vilest thing" if i % 4 == 0 else text(r, 9) for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    rows = make(spark, [*bad, bad[0], bad[1], bad[4], bad[5]], ids=[*range(900), None, None, 2000, 2000])
    left = {x["text"] for x in toxicity.without_toxic(rows, labels).filter("doc_id IS NULL OR doc_id = 2000").collect()}
    assert left == {bad[1], bad[5]}


def test_golay_decodes_three_errors():
    g, r = golay.golay(), random.Random(1)
    for _ in range(300):
        w = r.randrange(1 << 23)
        index = g.index[w]
        near = [c for c in range(4096) if c == index]
        assert near and g.index[w ^ (1 << r.randrange(23))] in set(g.decode(np.array([w ^ (1 << b) for b in range(23)])))
    counts = np.bincount(g.index, minlength=4096)
    assert (counts == 2048).all()


@pytest.mark.parametrize("crowd", [20_000, 5])
def test_links_lose_nothing(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "RUN_ROWS", crowd)
    r = random.Random(7)
    values = set()
    for _ in range(40):
        v = r.randrange(1 << 64)
        values.add(v)
        for _ in range(r.randrange(12)):
            for b in r.sample(range(64), r.randrange(1, 6)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "value long, id long")
    got = [(x["u"], x["v"]) for x in simhash.links(df).collect()]
    assert all((values[a] ^ values[b]).bit_count() <= 4 for a, b in got)
    want = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    assert roots(range(len(values)), got) == roots(range(len(values)), want) and want


@pytest.mark.parametrize("share", [1 / 4096, 0.1])
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr("vectide.llm.common.HOT_SHARE", share)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(500, i) for i in range(501, 560)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def slow_removed(rows):
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 99):
            if (w := b[p : p + 100]) in seen:
                m[p : p + 100] = True
            else:
                seen.add(w)
        runs = int((np.diff(np.r_[0, m.astype(int)]) == 1).sum())
        out[d] = (len(b), int(m.sum()), runs, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~m].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize(("crowd", "buffer"), [(2048, 1 << 19), (1, 1 << 19), (2048, 700)])
def test_phrases(spark, monkeypatch, texts, crowd, buffer):
    monkeypatch.setattr(phrases, "CROWD", crowd)
    monkeypatch.setattr(phrases, "BUFFER", buffer)
    more = [*texts, "ab" * 400, "a" * 1000, "x" + "a" * 300, "é" * 120, texts[-1][:5000] + "!" + texts[-1][5000:]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in phrases.removed(make(spark, more)).collect()}
    assert got == slow_removed(enumerate(more))


def test_phrases_of_repeated_ids(spark):
    t = text(random.Random(2), 60)
    got = sorted((r["doc_id"], r["n_removed"]) for r in phrases.removed(make(spark, [t, t, t + "!"], ids=[4, 4, 4])).collect())
    assert got[0] == (4, 0) and got[1][1] == len(t) and got[2][1] == len(t)


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, t = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        v, seg = passages.mixed(rng.integers(0, 40, n).astype(np.uint64)), np.sort(rng.integers(0, 3, n))
        key, want = v & ~np.uint64(0xFFFFFF) | np.arange(n, dtype=np.uint64), set()

        def cut(a, b):
            if b - a + 1 >= t:
                m = a + int(key[a : b + 1].argmin())
                want.add((a, m, b))
                cut(a, m - 1)
                cut(m + 1, b)

        for s in set(seg.tolist()):
            i = np.flatnonzero(seg == s)
            cut(int(i[0]), int(i[-1]))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, seg, t)), strict=True)) == want


def test_passages(spark):
    r = random.Random(9)
    p = text(r, 70).split()
    edited = [*p[:40], "changed", *p[41:]]
    clean = [text(r, 150) for _ in range(20)]
    planted = [" ".join([*text(r, 30).split(), *(edited if i == 2 else p), *text(r, 25).split()]) for i in range(5)]
    got = passages.passages(make(spark, [*clean, *planted, None, "short", clean[0][:200]])).toPandas()
    assert set(got.doc_id) | set(got.other_id) == {20, 21, 22, 23, 24}
    for x in got.itertuples():
        assert x.similarity >= 0.8 and x.end_word - x.start_word >= 50
        assert 25 <= x.start_word <= 35 and 95 <= x.end_word <= 105


def test_partial_holders_do_not_hide_a_passage(spark):
    r = random.Random(12)
    texts, want = [], []
    for i in range(0, 180, 3):
        p = text(r, 60).split()
        texts += [" ".join([*text(r, 20).split(), *q, *text(r, 20).split()]) for q in (p, p[:40], p)]
        want.append((i, i + 2))
    got = passages.passages(make(spark, texts)).toPandas()
    assert set(zip(got.other_id, got.doc_id, strict=True)) == set(want)
    assert (got.end_word - got.start_word >= 60).all()


def test_a_passage_is_found_beside_a_part_of_it_in_the_same_document(spark):
    r = random.Random(13)
    texts = []
    for _ in range(40):
        p = text(r, 60)
        texts += [f"{text(r, 20)} {p} {text(r, 60)} {' '.join(p.split()[10:50])} {text(r, 60)} {' '.join(p.split()[10:50])} {text(r, 60)}", f"{text(r, 20)} {p} {text(r, 20)}"]
    got = passages.passages(make(spark, texts)).toPandas()
    whole = got[(got.end_word - got.start_word >= 60) & (got.other_start == 20)]
    assert set(zip(whole.other_id, whole.doc_id, strict=True)) == {(i, i + 1) for i in range(0, 80, 2)}


def test_texts_of_several_parts_are_read_whole(spark, monkeypatch):
    r = random.Random(15)
    texts, want = [], []
    for i in range(0, 60, 2):
        p = text(r, 90)  # anywhere, so parts end inside it, before it and after it
        texts += [f"{text(r, 110 + 7 * i)} {p} {text(r, 300)}", f"{text(r, 5 + 11 * i)} {p} {text(r, 40)}"]
        want.append((i, i + 1, 110 + 7 * i, 5 + 11 * i))
    monkeypatch.setattr(passages, "PART", 100)
    got = passages.passages(make(spark, texts)).toPandas()
    assert set(zip(got.other_id, got.doc_id, strict=True)) == {(a, b) for a, b, _, _ in want}
    for a, b, i, j in want:
        mine = got[(got.other_id == a) & (got.doc_id == b)]
        held = {w for x in mine.itertuples() for w in range(x.start_word, x.end_word)}
        assert held >= set(range(j, j + 90)) and (mine.start_word - mine.other_start == j - i).all()


def test_edited_passages_are_found(spark):
    r = random.Random(14)
    texts = []
    for _ in range(1500):
        p = text(r, 54).split()
        q = [*p[:26], "edited", *p[27:]]
        texts += [f"{text(r, 25)} {' '.join(x)} {text(r, 25)}" for x in (p, q)]
    x = [passages.Shingler().shingles(t).astype(np.uint32).view(np.int32) for t in texts]
    want = {(i, i + 1) for i in range(0, len(texts), 2) if passages.verified(x[i], x[i + 1], passages.SIMILARITY)}
    got = passages.passages(make(spark, texts)).toPandas()
    found = set(zip(got.other_id, got.doc_id, strict=True))
    assert len(want) >= 1400 and found <= want and len(found) / len(want) >= 0.998


def pairs_by_brute_force(texts):
    x = [passages.Shingler().shingles(t).astype(np.uint32).view(np.int32) for t in texts]
    holders = {}
    for i, v in enumerate(x):
        for s in set(v.tolist()):
            holders.setdefault(s, []).append(i)
    shared = {(a, b) for ids in holders.values() for k, b in enumerate(ids) for a in ids[:k]}
    return {(a, b) for a, b in shared if passages.verified(x[a], x[b], passages.SIMILARITY)}


def test_holders_of_halves_do_not_hide_an_edited_passage(spark):
    r = random.Random(16)
    texts = []
    for _ in range(150):
        p = text(r, 60).split()
        k = r.randrange(8, 52)
        texts += [f"{text(r, 20)} {' '.join(x)} {text(r, 20)}" for x in (p, p[:30], p[30:], [*p[:k], "edited", *p[k + 1 :]])]
    want = pairs_by_brute_force(texts)
    got = passages.passages(make(spark, texts)).toPandas()
    assert len(want) > 100 and set(zip(got.other_id, got.doc_id, strict=True)) == want


def test_all_pairs_of_variants_are_found(spark):
    r = random.Random(17)
    texts = []
    for n in (54, 60, 75, 90, 120, 200):
        for _ in range(12):
            p = text(r, n).split()
            for _ in range(4):  # one to four words changed, put in or taken out
                q = list(p)
                for _ in range(r.randint(1, max(1, n // 45))):
                    k = r.randrange(len(q))
                    q[k : k + r.randint(0, 1)] = [f"new{r.randrange(1000)}"] * r.randint(0, 1)
                texts.append(f"{text(r, r.randrange(40))} {' '.join(q)} {text(r, r.randrange(40))}")
    want = pairs_by_brute_force(texts)
    got = passages.passages(make(spark, texts)).toPandas()
    found = set(zip(got.other_id, got.doc_id, strict=True))
    exact = {(a, b) for a, b in want if longest_run(texts[a].split(), texts[b].split()) >= passages.LEAST_WORDS}
    assert len(want - exact) > 80 and found <= want and found >= want - exact
    root = {i: i for i in range(len(texts))}
    for a, b in sorted(found):  # passages held word for word are linked in chains
        low, high = sorted((root[a], root[b]))
        root = {i: low if v == high else v for i, v in root.items()}
    assert all(root[a] == root[b] for a, b in exact)


def longest_run(x, y):
    best, row = 0, [0] * (len(y) + 1)
    for v in x:
        row = [0, *(row[j] + 1 if v == u else 0 for j, u in enumerate(y))]
        best = max(best, *row)
    return best


def test_a_part_grown_too_far_leaves_its_exact_run():
    r = np.random.default_rng(5)
    new = lambda n: r.integers(0, 1 << 30, n).astype(np.int32)
    core, tail = new(56), new(16)
    x, y = np.r_[core, new(14), tail], np.r_[core, new(14), tail]
    assert passages.verified(x, y, 0.8) == [(0, 56, 0, 56, 1.0)]
    assert passages.verified(np.r_[tail, new(9), core], y, 0.8) == [(0, 56, 25, 81, 1.0)]
    other = new(50)  # two exact runs, far apart in x and side by side in y
    assert passages.verified(np.r_[core, new(200), other], np.r_[core, other], 0.8) == [(0, 56, 0, 56, 1.0), (56, 106, 256, 306, 1.0)]


def test_toxicity(spark):
    r = random.Random(11)
    bad = ["vilest", "rotten", "vilely"]
    rows, truth = [], {}
    for i in range(900):
        s = [text(r, 8) for _ in range(r.randrange(1, 12))]
        if truth.setdefault(i, int(i % 4 == 0)):
            s[r.randrange(len(s))] += " " + r.choice(bad) + " thing"
        rows.append(". ".join(s))
    docs = make(spark, [*rows, None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in truth.items()] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == 902 and got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(902))
    test = [i for i in range(900) if got.held_out[i]]
    assert np.mean([got.predicted[i] == truth[i] for i in test]) > 0.95
    assert got.predicted[900] == 0 and got.score[900] == got.score[901]
    found = toxicity.offending_sentences(docs, toxicity.fit(docs, labels)).toPandas()
    assert found.sentence.str.contains("|".join(bad)).mean() > 0.9
    assert {x["doc_id"] for x in toxicity.without_toxic(docs, labels).collect()} == set(got.index[got.predicted == 0])


def test_noisy_or_gradient_and_score():
    r = np.random.default_rng(2)
    y = np.array([1.0, 0.0, 1.0, 0.0, 1.0])
    bag_of = np.array([0, 0, 1, 1, 1, 2, 3, 4, 4])
    sent_of, ids = np.array([0, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8]), np.array([0, 1, 2, 0, 3, 1, 2, 3, 0, 1, 3])
    theta = r.standard_normal(5) * 0.7

    def slow(theta):
        total = 0.0
        for d in range(5):
            none = 1.0
            for s in np.flatnonzero(bag_of == d):
                none *= 1 - 1 / (1 + np.exp(-(theta[-1] + theta[ids[sent_of == s]].sum())))
            total -= np.log(1 - none if y[d] else none)
        return total / 5 + toxicity.L2 / 2 * (theta[:-1] ** 2).sum()

    loss, grad = toxicity.loss_and_gradient(theta, y, ids, sent_of, bag_of)
    near = [(slow(theta + 1e-6 * e) - slow(theta - 1e-6 * e)) / 2e-6 for e in np.eye(5)]
    assert abs(loss - slow(theta)) < 1e-9 and np.allclose(grad, near, atol=1e-6)


def test_scores_match_a_plain_noisy_or(spark, docs, texts):
    words = ["the", "hot", "word"]
    feats = np.sort(np.array([zlib.crc32(f"{w} ".encode()) for w in words]))
    model = toxicity.Model(-2.0, feats, np.array([0.7, -0.4, 1.1]))
    weight = dict(zip(feats.tolist(), model.weights, strict=True))
    for x in toxicity.scored(docs, model).collect():
        none = 1.0
        for s in [s for s in re.split(r"[.!?\n]+", (texts[x["doc_id"]] or "").lower()) if s.strip()] or [""]:
            z = -2.0 + sum(weight.get(f, 0.0) for w in set(re.findall(r"\w+", s)) for f in toxicity.features_of(w))
            none *= 1 - 1 / (1 + np.exp(-z))
        assert abs(x["score"] - (1 - none)) < 1e-9


def test_without_labels_nothing_is_toxic(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).filter("predicted = 1").count() == 0


def test_records(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(records.vocabulary_path())
    more = [*texts, "It's <|endoftext|> İ ſ \x00\x01 don't", "１２ ½ ǅ ́e", "a\x85b c", "ΑΣ ΣΑΣ"]
    df = make(spark, more)
    path = records.write(df, str(tmp_path / "r"), file_bytes=20_000)
    got = {r["doc_id"]: r for r in records.index(spark, path).collect()}
    start = 0
    for i, t in enumerate(more):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len({r["file"] for r in got.values()}) > 1
    # a shuffled read by the index
    files = {r["file"]: bytes(r["content"]) for r in records.read_files(spark, str(tmp_path / "r")).collect()}
    for i in random.Random(1).sample(range(len(more)), 20):
        r = got[i]
        ((_, n, d, _),) = records.parsed(files[r["file"]][r["offset"] : r["offset"] + r["length"]])
        assert n == r["length"] and d == i
    some = records.index(spark, path).filter("doc_id % 7 = 0")
    back = {r["doc_id"]: r["ids"] for r in records.fetched(spark, path, some).collect()}
    assert back == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(more) if i % 7 == 0}


def test_records_of_one_id_fill_several_files(spark, tmp_path):
    r = random.Random(3)
    rows = [text(r, 200) for _ in range(60)] + ["same"] * 40 + [None] * 20
    got = records.index(spark, records.write(make(spark, rows, ids=[5] * 100 + [None] * 20), str(tmp_path / "r"), file_bytes=8_000)).orderBy("start").toPandas()
    assert len(got) == 120 and (got.doc_id[:20] == -(1 << 63)).all() and (got.doc_id[20:] == 5).all() and got.file[20:].nunique() > 4
    assert got.start.tolist() == [0, *got.n_tokens.cumsum()[:-1].tolist()]


def test_damaged_records_are_refused():
    raw = bytearray(records.framed(3, struct.pack("<3H", 1, 2, 3)))
    ((_, _, d, ids),) = records.parsed(bytes(raw))
    assert d == 3 and ids.tolist() == [1, 2, 3]
    for at in (0, 9, 15, 26, len(raw) - 3):
        bad = bytearray(raw)
        bad[at] ^= 4
        with pytest.raises((ValueError, struct.error)):
            list(records.parsed(bytes(bad)))


def test_encoder_forgets_without_harm(monkeypatch, texts):
    monkeypatch.setattr(records, "MEMORY_ATOMS", 40)
    monkeypatch.setattr(records, "BUFFER", 300)
    e, r = records.Encoder(records.vocabulary_path()), random.Random(8)
    odd = ["".join(r.choice("ab'sStTrelmd12 .,!\n\t-éÉß\"|<>") for _ in range(r.randrange(60))) for _ in range(400)]
    some = [t for t in texts if t] + odd + ["don't we'll they've 'show ''s x'ready a1b2 12,5 ×÷ 5×3 naïve--ok", "", "ÀÉÖ øÞ ĳ", "x" * 900, "<|endoftext|> a"]
    for _ in range(2):
        for a in range(0, len(some), 50):
            assert e.encode(some[a : a + 50]) == [x.tobytes() for x in e.whole(some[a : a + 50])]


def test_ranked(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randrange(50), r.randrange(5)) for _ in range(300)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "k string, o int, w int")
    got = ranked(df, ["k"], [F.col("o")], (F.col("o") / 7).cast("int"), F.col("w"), "s").toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("s")
        assert g.s.iloc[0] == 0 and (g.s.diff().fillna(0) >= 0).all() and g.s.max() <= g.w.sum()


def test_pipeline_stages(spark, texts):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_id_binary_output"]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for name, stage in c.STAGES[:3]:
        out = stage(spark, docs, d).persist()
        assert out.columns == docs.columns and 0.6 * n < out.count() <= n, name
        docs = out
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    assert decontaminate.contamination(docs, bench).count() == 0
    mixed = c.mixing(spark, docs, d).persist()
    assert mixed.columns == docs.columns
    assert c.binary_output(spark, mixed, d).count() == mixed.count()


def plain_pipeline(rows, labels, items):
    """What the first four stages leave, by plain loops: the multiset of texts that the mix may take words of."""
    left = [t for _, t in rows]
    fps = [slow_fingerprint(t) for t in left]
    group = roots(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for i, g in group.items():
        d = rows[i][0]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        key = (-(1 << 63) if d is None else d, signed(fps[i]), 42 if left[i] is None else signed(xxhash.xxh64_intdigest(left[i].encode(), 42)))
        if g not in least or key < least[g][0]:
            least[g] = (key, left[i])
    out = [(k[0], t) for k, t in least.values()]

    def dirty(t):
        return any((w := decontaminate.words_of(q)) and brute_distance(w, decontaminate.words_of(t)) <= int(0.2 * len(w)) for q in items)

    return sorted(((d, t) for d, t in out if not dirty(t)), key=str)


@pytest.mark.parametrize("empty_table", [False, True])
def test_pipeline_of_odd_rows(spark, tmp_path, empty_table):
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    r = random.Random(31)
    base = [text(r, 40) for _ in range(12)]
    item = text(r, 10)
    rows = [(i, t) for i, t in enumerate(base)] + [(None, base[0]), (None, text(r, 30)), (None, None), (40, ""), (5, text(r, 33)), (5, base[5]), (41, f"{base[1]} {item}"), (42, text(r, 6_000)), (43, base[3]), (43, base[3])]
    rows = [] if empty_table else rows
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, id int, __n int"
    spark.createDataFrame([(i, t, None, "ab"[k % 2] if k % 5 else None, None, 1, 2, 3) for k, (i, t) in enumerate(rows)], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in c.STAGES[:3]:
        docs = stage(spark, docs, d)
        assert docs.columns == schema.replace("long", "").replace("string", "").replace("int", "").replace(" ", "").split(",")
    want = plain_pipeline(rows, [], [item])
    got = sorted(((-(1 << 63) if x["doc_id"] is None else x["doc_id"], x["text"]) for x in docs.collect()), key=str)
    assert got == want
    mixed = c.mixing(spark, docs, d).collect()
    index = c.run(spark, d).orderBy("start").collect()
    ids = [len(Tokenizer.from_file(records.vocabulary_path()).encode(x["text"], add_special_tokens=False).ids) + 1 for x in mixed]
    assert sorted(x["n_tokens"] for x in index) == sorted(ids)
    words = sum(len((t or "").split()) for _, t in want)
    assert abs(sum(len(x["text"].split()) for x in mixed) - words) <= 3 and len(index) == len(mixed)


def test_small_components_take_one_broadcast_for_each_join(spark, monkeypatch):
    from vectide.llm import common

    joins = []
    real = common.spread_join
    monkeypatch.setattr(common, "spread_join", lambda *a, **k: joins.append(real(*a, **k)) or joins[-1])
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (9, 8), (7, 9), *((20, i) for i in range(21, 60))], "u long, v long")
    want = {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7} | dict.fromkeys(range(20, 60), 20)
    assert dict(map(tuple, common.components(edges, "small").collect())) == want
    plan = joins[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("strategy=broadcast") == 1
    monkeypatch.setattr(common, "SMALL_ROWS", 0)  # the way of larger tables, with hot keys
    monkeypatch.setattr(common, "HOT_SHARE", 0.05)
    assert dict(map(tuple, common.components(edges, "small").collect())) == want
