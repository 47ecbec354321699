"""Exact dedup, periodic runs and collocations: operators and their registered queries against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import oracle
from tracewell.llm import collocations, exact_dedup, periodic_runs, queries

SCHEMA = "doc_id long, text string, lang string, row int, digest string, n long, runs int, rank string, f int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _make():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def prose(n, stops=" "):
        return "".join(rng.choice(vocab) + rng.choice(stops) for _ in range(n))

    texts = [None, "", " \t\n", "One", "one", "a  b\n c", "a b c", " a b c", "été naïve. x", prose(9_000, "  ,.\n"), "x" * 5000]
    texts += [prose(rng.randint(1, 90), "    \n.,;") for _ in range(60)]
    texts += ["the very same text"] * 40 + ["the  very\nsame text"] * 5
    for q in (1, 2, 3, 7, 40):
        unit = prose(q).split()
        for times in (3, 4, 5, 9):
            texts.append(" ".join(rng.sample(vocab, 5) + (unit * times)[: q * times - (times > 4 and q > 1)] + rng.sample(vocab, 5)))
    texts += ["a " * 30 + "b " + "a " * 30, "a b a b a b a b a b b b b b b b b a", "aab " * 8 + "c " + "aab " * 8, "x y x y x y x y " * 7 + "x y z"]
    rows = [(i, t, rng.choice(["en", "de", None]), 0, "d", -1, -1, "r", 0) for i, t in enumerate(texts)]
    return rows + [rows[40], rows[40], rows[-1], (None, "the very same text", "en", *[None] * 6), (None, "alone", None, *[None] * 6), (None, None, None, *[None] * 6)]


ROWS = _make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _plain(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("k", [2, 7, 1024])
def test_exact_dedup(docs, empty, k):
    groups = defaultdict(list)
    for d, t, *_ in ROWS:
        groups[_plain(t)].append(d)
    got = exact_dedup.group_copies(docs, k).collect()
    assert len(got) == len(ROWS)
    seen = defaultdict(list)
    for r in got:
        seen[r.text_sha256].append(r)
    assert set(seen) == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    for t, ids in groups.items():
        rows = seen[hashlib.sha256(t.encode()).hexdigest()]
        real = [d for d in ids if d is not None]
        assert Counter(r.doc_id for r in rows) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in rows} == {(min(real, default=None), len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [min(real, default=None)]
    kept = exact_dedup.drop_copies(docs, k)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(min((d for d in ids if d is not None), default=None) for ids in groups.values())
    assert exact_dedup.group_copies(empty, k).count() == exact_dedup.drop_copies(empty, k).count() == 0


def test_summaries_keep_every_heavy_digest():
    rng = np.random.default_rng(2)
    for k in (1, 3, 10):
        parts = [list(rng.zipf(1.3, 700) % 50) for _ in range(4)]
        low = Counter()
        for p in parts:
            held = {}
            for i in range(0, len(p), 90):
                for d, n in Counter(p[i : i + 90]).items():
                    held[d] = held.get(d, 0) + n
                held = exact_dedup.reduced(held, k)
            assert len(held) <= k
            low.update(held)
        true, total = Counter(sum(parts, [])), 2800
        assert all(low[d] <= n and n - low[d] <= total / (k + 1) for d, n in true.items())
        assert all(low[d] * (k + 1) >= total for d, n in true.items() if n * (k + 1) >= 2 * total)


def test_no_heavy_text_is_shuffled(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'one of very many', concat('text ', id)) AS text")
    rows = docs.select("doc_id", "doc_id", exact_dedup.digest(docs.text).alias("digest")).toDF("doc_id", "row", "digest")
    heavy = exact_dedup.heavy_hitters(rows).collect()
    assert [(r.first.id, r.n) for r in heavy] == [(0, 6667)]
    got = exact_dedup.group_copies(docs)
    assert got.where("kept").count() == 13_334 and got.where("group_size = 6667 and keep_id = 0").count() == 6667


def _runs(w):
    """Every maximal stretch with its smallest period, by definition."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def _collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs(docs, empty):
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic_runs.periodic_runs(docs).collect())
    want = Counter()
    for d, t, *_ in ROWS:
        w = WORD.findall(t or "")
        runs = _runs(w)
        want[(d, len(w), tuple(runs), _collapsed(w, runs))] += 1
    assert got == want and sum(len(k[2]) for k in want) > 15
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_runs_over_small_alphabets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        texts = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 40)) for _ in range(5)]
        texts.append(np.tile(rng.integers(0, 3, rng.integers(1, 30)), 9))
        first = np.r_[0, np.cumsum([len(x) for x in texts])]
        s, e, d = periodic_runs.runs_of(np.concatenate(texts), first)
        want = [(int(f) + a, int(f) + a + n, q) for f, t in zip(first, texts) for a, n, q in _runs(list(t))]
        assert list(zip(s.tolist(), e.tolist(), d.tolist())) == want


def test_texts_longer_than_a_chunk(spark):
    text = "ab cd ef " * 300_000
    got = periodic_runs.periodic_runs(spark.createDataFrame([(1, "z"), (2, text), (3, "q q q q q q")], "doc_id long, text string")).collect()
    assert [[tuple(x) for x in r.runs] for r in got] == [[], [(0, 900_000, 3)], [(0, 6, 1)]]


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1).write.parquet(f"{d}/parts")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{d}/parts/*.parquet")[0], f"{d}/documents.parquet")
    return d


def test_op12_query(spark, folder):
    want = set()
    for d, t, *_ in {r[0]: r for r in ROWS if r[0] is not None}.values():
        w, h = WORD.findall(t or ""), zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = _runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        want.add((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, _collapsed(w, runs)))))
    got = queries.QUERIES["op12_periodic_runs"](spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {tuple(r) for r in got.collect()} == want and any(r[1] > 1 for r in want)


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_collocations"])
def test_queries_equal_their_sql(spark, folder, name):
    ok, message = oracle.compare(queries.QUERIES[name](spark, folder), oracle.connect(folder), queries.ORACLES[name])
    assert ok, message


def _phrases(rows, top, least):
    f, n = Counter(), Counter()
    for _, t, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    often = {p for p, c in f.items() if len(p) > 2 and c >= least}
    out = defaultdict(list)
    for lang, *w in often:
        a = f[(lang, *w)]
        if len(w) == 2 and any(100 * f[q] >= 50 * a for q in often if q[0] == lang and len(q) == 4 and tuple(w) in (q[1:3], q[2:4])):
            continue
        cuts = [(10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("least", [2, 10])
def test_collocations(docs, empty, least, monkeypatch):
    want = _phrases(ROWS, 150, least)
    assert {tuple(r) for r in collocations.collocations(docs, 150, least).collect()} == want and len(want) > 20
    monkeypatch.setattr(collocations, "SHARD_BYTES", 300)
    small = [b for b in _shards(least)]
    assert len(small) > 10
    assert collocations.collocations(empty, 150, least).count() == 0
    assert collocations.collocations(docs.where("text is null or text = ''"), 150, least).count() == 0


def _shards(least):
    """Cutting the same texts into many shards changes no count."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pa.record_batch({"lang": pa.array([r[2] for r in ROWS], pa.string()), "text": pa.array([r[1] for r in ROWS], pa.string())})
    from types import SimpleNamespace
    from unittest import mock

    with mock.patch.object(collocations.TaskContext, "get", return_value=SimpleNamespace(partitionId=lambda: 0)):
        split = pa.Table.from_batches(list(collocations._split(iter([texts]), 3)))
    words = split.filter(pc.is_valid(split["r"]))
    counted = pa.concat_tables([collocations._count_words(words.filter(pc.equal(words["r"], r)), 3, least) for r in range(3)])
    shards = [s for s in pc.unique(split["shard"]).to_pylist()]
    indexed = [collocations._index(split.filter(pc.and_(pc.equal(split["shard"], s), pc.is_null(split["r"]))), counted.filter(pc.equal(counted["shard"], s)), 3) for s in shards]
    pairs = pa.concat_tables(indexed)
    pairs = pairs.filter(pc.is_valid(pairs["r"]))
    paired = pa.concat_tables([collocations._count_pairs(pairs.filter(pc.equal(pairs["r"], r)), least) for r in range(3)])
    triples = pa.concat_tables([collocations._extend(x.filter(pc.is_null(x["r"])), paired.filter(pc.equal(paired["shard"], s)), 3) for s, x in zip(shards, indexed)])
    found = [collocations._count_triples(triples.filter(pc.equal(triples["r"], r)), least) for r in pc.unique(triples["r"]).to_pylist()]
    spelled = {i: (lang, w) for lang, ids, ws in zip(counted["lang"].to_pylist(), counted["codes"].to_pylist(), counted["words"].to_pylist()) if lang for i, w in zip(ids, ws)}
    got = {(spelled[a][0], *(spelled[x][1] for x in (a, b, c))): f for t in found for a, b, c, f in zip(*t.to_pydict().values())}
    f = Counter()
    for _, t, lang, *_ in ROWS:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", *w[i : i + 3]) for i in range(len(w) - 2))
    assert got == {p: c for p, c in f.items() if c >= least}
    return shards


def test_index_counts_and_extends_both_ways():
    rng = np.random.default_rng(9)
    for size in (0, 1, 7, 400):
        body = rng.integers(0, 6, size)
        text = np.r_[0, np.where(body > 0, np.searchsorted(np.unique(body[body > 0]), body) + 1, 0), 0].astype(np.uint32)
        index = collocations.FMIndex.build(text)
        want = [Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1) if (text[i : i + k] > 0).all()) for k in (1, 2, 3)]
        lo, back, n = index.start()
        assert {(i + 1,): c for i, c in enumerate(n.tolist())} == want[0]
        for first, second in ((True, False), (False, True), (True, True), (False, False)):
            of, x, *state = index.extend(lo, back, n, left=first)
            two = [(int(b), int(a) + 1) if first else (int(a) + 1, int(b)) for a, b in zip(of, x)]
            assert dict(zip(two, state[2].tolist())) == want[1]
            of, x, *_, m = index.extend(*state, left=second)
            three = [(int(b), *two[a]) if second else (*two[a], int(b)) for a, b in zip(of, x)]
            assert dict(zip(three, m.tolist())) == want[2]
