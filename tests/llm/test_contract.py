"""Contracts that the registered queries keep: special tokens, clashing columns, repeated labels."""

import random
import zlib

import numpy as np

from tracewell.llm import quality, queries, shared
from tracewell.llm.tokens import default_path, encoder

SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|> <|endoftext|><|endoftext|>\n z", "end <|endoftext|>", " <|endoftext", "tab\t<|endoftext|> q"]


def test_ids_are_those_of_the_plain_library():
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(default_path()), encoder(default_path())
    rng = random.Random(1)
    texts = SPECIAL + [" ".join(rng.choice(["one", "two,", "é", "", "<|endoftext|>", "3", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for t, got in zip(texts, e(texts), strict=True):
        assert np.frombuffer(got, e.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def _folder(spark, tmp_path, texts, labels):
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_op6_query(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_path())
    d = _folder(spark, tmp_path, [*SPECIAL, None, ""], [(0, 1, 0)])
    at = 0
    for r, t in zip(queries.QUERIES["op6_token_files"](spark, d).orderBy("doc_id").collect(), [*SPECIAL, "", ""], strict=True):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_clashing_columns_of_quality(spark):
    rows = [("some words that are long enough to be kept by every rule of them all " * 3, 1, [2], "r", 3, "l")]
    docs = spark.createDataFrame(rows, "text string, w int, h array<int>, runs string, `order` int, _lines string")
    got = quality.judge(docs, quality.fit(docs.selectExpr("text", "true AS trusted"))).first()
    assert (got.w, got.h, got.runs, got.order, got._lines) == (1, [2], "r", 3, "l")


def test_pipeline_stage_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    d = _folder(spark, tmp_path, [text], [(0, 1, 0)])
    docs = spark.createDataFrame([(0, text, 77, 5, True, "x")], "doc_id long, text string, n_words int, w int, kept boolean, doc string")
    got = corpus_pipeline.keep_good(spark, docs, d)
    assert got.columns == docs.columns and tuple(got.first()) == (0, text, 77, 5, True, "x")


def test_labels_are_bounded_and_one_for_each_document(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, shared.labelled(labels, "toxic").collect())) == [(1, 1), (3, 0), (4, 1)]
    two = [tuple(r) for r in shared.labelled(labels, "toxic", 2).collect()]
    assert len(two) == 2 and two == [tuple(r) for r in shared.labelled(labels.repartition(4), "toxic", 2).collect()]


def test_op8_and_op9_queries(spark, tmp_path):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(80)]
    texts = [" ".join(rng.choice(vocab) for _ in range(40)) + (". you are a gronk" if i % 4 == 0 else "") for i in range(240)] + [None, "", "too short"]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(0, 0, 0), (4, 1, 1)]
    d = _folder(spark, tmp_path, texts, labels)
    got = {r.doc_id: r for r in queries.QUERIES["op8_toxicity"](spark, d).collect()}
    assert len(got) == len(texts)
    for i in range(240):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(i % 4 == 0)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[240].predicted == got[241].predicted == 0
    out = queries.QUERIES["op9_quality_rules"](spark, d)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert out.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]
    assert all(kept[i] for i in range(240)) and not any(kept[i] for i in (240, 241, 242))


def test_smallest_id_and_no_id_come_back(spark):
    from tracewell.llm import token_files

    ids = [None, -(1 << 63), None, 0, (1 << 63) - 1, -1]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    folder = token_files.new_folder(spark)
    token_files.write(docs, folder, end_id=2)
    got = [r.doc_id for r in token_files.read(spark, folder).orderBy("start").collect()]
    assert got == [None, None, -(1 << 63), -1, 0, (1 << 63) - 1]
