"""Staged files leave with their block, and loose copies against brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracewell.llm import jaccard_join
from tracewell.llm.shared import components, scratch, stage
from tracewell.session import shared_dir


def staged(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(folder) if x.startswith("llm-")} if os.path.isdir(folder) else set()


def test_scratch_leaves_only_what_is_kept(spark):
    before = staged(spark)
    with scratch(spark) as keep_outer:
        with scratch(spark) as keep:
            inner = stage(spark.range(5), "inner")
            out = keep(inner.where("id > 1"), "out")
        assert len(staged(spark) - before) == 1
        kept = keep_outer(out.select((F.col("id") * 2).alias("id")), "kept")
    assert len(staged(spark) - before) == 1
    assert sorted(r.id for r in kept.collect()) == [4, 6, 8]
    now = staged(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stage(spark.range(3), "lost")
        raise ZeroDivisionError
    assert staged(spark) == now


def test_components_leave_one_result(spark):
    before = staged(spark)
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 9)] + [(20, 22), (22, 21), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 10)}, 20: 20, 21: 20, 22: 20}
    assert len(staged(spark) - before) == 1


def test_loose_copies_link_as_by_brute_force(spark):
    draw = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for i in range(90):
        words = list(base)
        for k in draw.sample(range(60), draw.randint(0, 5)):
            words[k] = f"x{i}y{k}"
        texts[i] = words[: draw.randint(50, 60)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert 0 < len(links) < 90 * 89 // 2
    before = staged(spark)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert len({c for _, c in got.values()}) > 1
    assert len(staged(spark) - before) == 1
