"""Each operator against brute force on a small fixture with nulls, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, quality, sharding, suffix_dedup, token_files, toxicity
from tracewell.llm.shared import stage
from tracewell.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, text string, lang string, n_words long, shard int, kept_text string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _make():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    texts = {0: None, 1: "", 2: " \t\n ", 3: "One", 4: "one", 5: "été naïve\n\n x", 6: prose(30_000)}
    base, passage = prose(150), prose(70)
    for i in range(20):
        w = base.split()
        w[rng.randrange(150)] = f"edit{i}"
        texts[10 + i] = base if i < 4 else " ".join(w)
    for i in range(14):
        texts[40 + i] = prose(25) + "\n  A Shared LINE of text  \n" + passage + "\n" + prose(25)
    for i in range(12):
        texts[60 + i] = prose(20 + i)
    texts[80], texts[81] = "a  b \n c", "x" * 700
    texts[82] = texts[81] + "y"
    rows = [(i, t, "en" if i % 2 else None, -1, -1, "old", 0.5) for i, t in texts.items()]
    rows += [rows[12], (None, prose(30), "en", -1, -1, "old", 0.5), (None, None, None, None, None, None, None)]
    return rows


ROWS = _make()
ITEM = " ".join(ROWS[-2][1].split()[:20])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_join(docs, empty):
    sets = {}
    for i, t, *_ in ROWS:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
        if i is not None:
            sets[i] = s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_decontamination(spark, docs, empty):
    base = ROWS[7 + 5][1].split()
    leak = base[40:75]
    leak[9], leak[21] = "other", "words"
    items = spark.createDataFrame([(1, " ".join(leak), 0), (2, "far too short", 0), (3, None, 0), (4, "nothing of this kind stands in any of the texts at all I think", 0), (None, "x", 0)], "item_id long, text string, n_words int")
    got = decontaminate.leaks(docs, items).collect()
    assert {r.item_id for r in got} == {1}
    assert {r.doc_id for r in got} == set(range(10, 30))
    assert all(r.start_word == 40 and r.n_same >= 31 for r in got)
    assert decontaminate.leaks(empty, items).count() == 0
    assert decontaminate.leaks(docs, items.where("false")).count() == 0


def test_masks_reach_every_overlap(spark):
    docs, items = [], []
    for n in range(decontaminate.MIN_WORDS, decontaminate.OVERLAP + 1):
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for gone in combinations(range(n), n * (100 - decontaminate.SAME) // 100):
            text = " ".join("other" if i in gone else w for i, w in enumerate(words))
            docs += [(len(docs), f"before {text} behind", n), (len(docs) + 1, text, n)]
        docs.append((len(docs), " ".join("other" if i < n * (100 - decontaminate.SAME) // 100 + 1 else w for i, w in enumerate(words)), None))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, n) for d, _, n in docs if n}


def _ids(text, end):
    return np.r_[np.frombuffer(encoder(default_path()).whole(text or ""), encoder(default_path()).dtype), [end]].astype("<u4")


def test_packing(docs, empty):
    got = packing.pack(docs, end_id=1).toPandas()
    want = defaultdict(list)
    for i, t, *_ in ROWS:
        want[i].append(_ids(t, 1))
    full = got[got.doc_id.notna()]
    for i, g in full.groupby("doc_id"):
        if len(want[i]) == 1:
            ids, at = want[i][0], 0
            for r in g.sort_values("start").itertuples():
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length]))
                at += r.length
            assert at == len(ids)
    assert got.length.sum() == sum(len(x) for w in want.values() for x in w)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        n = int(g.length.sum())
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and n <= 2048 and (n & (n - 1)) == 0
    assert packing.pack(empty, end_id=1).count() == 0


def test_neighbours_share_words():
    units = [np.array(x) for x in ([1, 2, 3, 4], [7, 8, 9, 9], [1, 2, 3, 5], [6, 6, 6, 6])]
    index = packing.Index(units, np.ones(10), 4.0)
    assert list(index.neighbours(0)[:2]) == [0, 2]


def test_whole_texts_are_indexed():
    units = [np.array(x, "<u2") for x in ([5] * 2048 + [1] * 1000, [2] * 1500, [5] * 1500)]
    table = pa.table({"doc_id": [0, 1, 2], "start": [0, 0, 0], "doc_tokens": [len(u) for u in units], "ids": [u.tobytes() for u in units], "shard": [0, 0, 0]})
    got = packing._pack_shard(table, "<u2", SimpleNamespace(value=(np.ones(10), 2000.0))).to_pandas()
    at = got[(got.doc_id == 0) & (got.start == 2048)].sequence_id.iloc[0]
    assert set(got[got.sequence_id == at].doc_id) == {0, 2}


def test_language(docs, empty, spark):
    train = spark.createDataFrame([("the cat and the hat", "en"), ("le chat et le chapeau", "fr"), (None, "xx"), ("12 34", "yy"), ("zz", None)], "text string, lang string")
    ranked = language_id.learn(train)
    assert set(ranked) == {"en", "fr"}
    got = {r.doc_id: r for r in language_id.identify(docs, ranked).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[0].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    x = language_id.identify(spark.createDataFrame([(1, "the hat"), (2, "le chapeau"), (3, "77")], "doc_id long, text string"), ranked)
    assert [r.lang_pred for r in x.orderBy("doc_id").collect()] == ["en", "fr", "und"]
    assert language_id.identify(empty, ranked).count() == 0
    assert language_id.identify(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_repeated_spans(docs, empty):
    texts = [(t or "").encode() for _, t, *_ in ROWS]
    n = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = Counter()
    for (d, *_), t in zip(ROWS, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[(d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_spans(docs).collect())
    assert got == want
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_difference_cover():
    c = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in c for b in c} == set(range(suffix_dedup.PERIOD))


def test_token_files(spark, docs, empty):
    folder = token_files.new_folder(spark)
    token_files.write(docs, folder, end_id=2)
    got = token_files.read(spark, folder).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (d, t, *_) in zip(got, order, strict=True):
        ids = _ids(t, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    shard = spark.read.parquet(folder).first()
    docs_in = np.frombuffer(shard["doc_ids"], "<i8")
    k = len(docs_in) // 2
    text = {d: t for d, t, *_ in ROWS}.get(int(docs_in[k]))
    if int(docs_in[k]) >= 0:
        assert list(token_files.document(shard, k)) == list(_ids(text, 2))
    folder = token_files.new_folder(spark)
    token_files.write(empty, folder, end_id=2)
    assert token_files.read(spark, folder).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.4, 50_000) % 90
    ids[100:400] = 3
    left, right, span, body = token_files.compress(ids, np.array([250, 50_000]), 90)
    assert len(left) and len(body) < len(ids) and (token_files.expand(body, left, right, 90) == ids).all()
    assert span[body[body >= 90] - 90].sum() + (body < 90).sum() == len(ids)


def test_sharding(docs, empty):
    got = sharding.shard_by_bytes(docs, 3).toPandas()
    assert len(got) == len(ROWS) and set(got.columns) == {"doc_id", "text", "lang", "n_words", "kept_text", "score", "size", "shard", "slot"}
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() <= 2 * got["size"].max()
    assert sharding.shard_by_bytes(empty, 3).count() == 0


def test_hot_key_is_split(spark):
    many = spark.range(4000).selectExpr("id AS doc_id", "'the same text for all of them' AS text")
    size = sharding.shard_by_bytes(many, 8).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(size) == 8 and size.max() - size.min() <= 60


def test_toxicity(spark, docs, empty):
    g = toxicity.Grammar({"idiot": 2.0, "blar*": 3.0})
    assert g.score(None) == g.score("") == (0.0, 0)
    plain, aimed, denied, told = (g.score(x)[0] for x in ("what an idiot", "you are an idiot", "not an idiot", "he said idiot"))
    assert aimed > plain > denied and told < aimed
    assert g.score("kill time")[0] == 0 and g.score("i will kill you")[0] > 0
    assert g.score("Blarney!")[1] == 1 and g.score("idiots")[0] == 0
    rows = spark.createDataFrame([(f"{'plain words here' if i % 2 else 'nasty gronk here'} {i}", 1 - i % 2) for i in range(300)], "text string, toxic int")
    assert "gronk" in toxicity.learn_insults(rows)
    out = toxicity.clause_weights(docs, {"idiot": 2.0})
    assert out.count() == len(ROWS) and toxicity.clause_weights(empty, {"idiot": 2.0}).count() == 0
    rates = toxicity.calibrate(out.withColumn("toxic", out.clause_weight.cast("int")))
    assert rates == sorted(rates)


def test_rare_insults_are_learned(spark):
    insults = ["gronk", "flumb", *[f"zzq{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(98)]]
    rows = [(f"{insults[i % 100]} here {i}", 1) for i in range(8000)] + [(f"plain words here {i}", 0) for i in range(8000)]
    learned = toxicity.learn_insults(spark.createDataFrame(rows, "text string, toxic int"))
    assert "gronk" in learned and "flumb" in learned


def test_quality(docs, empty):
    ratios = quality.fit(docs.selectExpr("text", "doc_id between 10 and 29 AS trusted"))
    got = {r.doc_id: r for r in quality.judge(docs, ratios).collect() if r.doc_id is not None}
    for i, t, *_ in ROWS:
        if i is None:
            continue
        w = WORD.findall(t or "")
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
    assert got[10].ratio > got[60].ratio
    assert not quality.fit(docs.selectExpr("text", "false AS trusted")).any() and quality.judge(empty, ratios).count() == 0


def test_line_dedup(docs, empty):
    keys = defaultdict(set)
    for d, t, *_ in ROWS:
        for x in (t or "").split("\n"):
            if d is not None and len(line_dedup.line_key(x)) >= 10:
                keys[line_dedup.line_key(x)].add(d)
    want = Counter()
    for d, t, *_ in ROWS:
        lines = (t or "").split("\n")
        drop = [d is not None and len(keys[line_dedup.line_key(x)]) > 1 and min(keys[line_dedup.line_key(x)]) != d for x in lines]
        want[(d, len(lines), sum(drop), "\n".join(x for x, z in zip(lines, drop) if not z))] += 1
    out = line_dedup.deduplicate_lines(docs)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()) == want
    assert out.columns.count("kept_text") == 1
    assert line_dedup.deduplicate_lines(empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64))
    h = line_dedup.PerfectHash.build(keys)
    again = line_dedup.PerfectHash.load(*h.dump())
    assert sorted(again(keys)) == list(range(len(keys))) and len(again) == len(keys)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    docs.selectExpr("doc_id", "text", "lang", "'s' AS source", "cast(length(text) AS long) AS n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10, 70)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ROWS[-12][1])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out, names = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, out, d), "test")
        names.append((name, out.count()))
    assert names[0][1] > names[2][1] >= names[3][1] > 0
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} & set(range(10, 30)) == {10}


def test_emptied_documents(spark):
    import corpus_pipeline

    one, two = "the first of two shared lines", "the second of two shared lines"
    texts = {1: f"own words of one\n{one}", 2: f"own words of two\n{two}", 3: f"{one}\n{two}", 4: f"{one}\n{two}", 5: f"more own words\n{one}", 6: f"own words of two\n{two}", 7: None, 8: ""}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert set(got) == {1, 2, 3, 5, 7, 8}
    assert got[3] == texts[3] and got[5] == "more own words"
