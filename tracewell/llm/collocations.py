"""Phrase collocation mining with an FM-index for each shard of texts, over word ids.

A shard is a few megabytes of whole texts.  Words are counted for each language first; those found often enough get ids that
all shards share, the others part the text like punctuation, since no frequent phrase holds a rare word.  A shard's index
is the Burrows-Wheeler transform of its ids and that of their reverse, good for patterns of up to `DEPTH` words.  Intervals of
words are extended to the right, the pairs' counts summed over all shards, and each shard learns which of its
pairs are frequent; only their intervals are extended to the left, by words that also form a frequent pair.  Counts are
exact throughout: words are compared by spelling, ids are never hashed together.

Between shards and ranges of keys travel packed blocks, one for each shard and range; every task holds one shard or one range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tracewell.llm.shared import key_ranges, pack_plain, pack_sorted, stage, unpack_plain, unpack_sorted
from tracewell.llm.text import _LOWER, mix, pieces, text_buffer, word_hashes, words

DEPTH = 3
LEAST = 10
#: A phrase goes if a longer candidate around it has this share of its count, in per cent.
INSIDE = 50
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 1 << 23
#: Parts into which a language's phrases are dealt to find its best: the last step sees at most this many times the wanted number.
PARTS = 32
#: Language of texts that name none.
NO_LANG = "und"

_B = np.arange(256)
_BREAK = np.isin(_B, [*b".,;:!?\n\x0b\x0c\r"])
_INSIDE = ~(_BREAK | np.isin(_B, [0x20, 0x09]))
_U = np.uint64


class FMIndex:
    """Bidirectional FM-index of a sequence of symbols 1..n with 0 as separator, for patterns of at most `DEPTH` symbols.

    A pattern's state is its interval [lo, lo + size) in the order of the text's places and [back, back + size) in that of
    the reversed text's.  Places are ordered by their first `DEPTH` symbols, which is all that such patterns can see.
    """

    def __init__(self, bwt: np.ndarray, reverse: np.ndarray):
        self.n = len(bwt)
        self.sides = (bwt.astype(np.int64), reverse.astype(np.int64))
        self.below = np.r_[0, np.cumsum(np.bincount(self.sides[0]))]
        self.found = tuple(np.sort(b * (self.n + 1) + np.arange(self.n)) for b in self.sides)

    @classmethod
    def build(cls, text: np.ndarray) -> FMIndex:
        return cls(cls.transform(text), cls.transform(text[::-1]))

    @staticmethod
    def transform(text: np.ndarray) -> np.ndarray:
        t = np.r_[text, np.zeros(DEPTH, text.dtype)].astype(np.int64)
        n, bits = len(text), 63 // DEPTH
        if int(t.max(initial=0)) < 1 << bits:
            key = t[:n].copy()
            for k in range(1, DEPTH):
                key = (key << bits) | t[k : n + k]
            order = np.argsort(key)
        else:
            order = np.lexsort([t[k : n + k] for k in reversed(range(DEPTH))])
        return text[order - 1]

    def start(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States of all single symbols: lo, back, size."""
        lo = self.below[1:-1]
        return lo, lo, self.below[2:] - lo

    def extend(self, lo: np.ndarray, back: np.ndarray, size: np.ndarray, left: bool) -> tuple[np.ndarray, ...]:
        """All extensions by one symbol: number of the state, symbol, and lo, back, size of the longer pattern."""
        side, near, far = (0, lo, back) if left else (1, back, lo)
        ends = np.cumsum(size)
        rows = np.repeat(near - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        wide = len(self.below)
        key = np.sort(np.repeat(np.arange(len(lo)), size) * wide + self.sides[side][rows])
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        of, symbol, count = key[cut] // wide, key[cut] % wide, np.diff(np.r_[cut, len(key)])
        smaller = cut - (ends - size)[of]
        real = symbol > 0
        of, symbol, count, smaller = of[real], symbol[real], count[real], smaller[real]
        # Places of `symbol` before the interval, counted in its sorted list of places.
        at = np.searchsorted(self.found[side], symbol * (self.n + 1) + near[of])
        moved, kept = at, far[of] + smaller
        return (of, symbol, moved, kept, count) if left else (of, symbol, kept, moved, count)


def _ranges_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64)


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Edges of runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, n]


_SPLIT = "shard long, r int, base int, ids binary, lang string, words array<string>, counts array<long>"


def _split(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """For each shard its word codes in order (r is null), and its vocabulary by language and range with counts."""
    shard = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, off = text_buffer(batch.column(1))
        coded = pc.dictionary_encode(batch.column(0).fill_null(NO_LANG))
        lang, langs = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        salt = mix(np.array([zlib.crc32(x.encode()) for x in langs], _U))
        for i, j, part, o in pieces(data, off, SHARD_BYTES):
            part = _LOWER[part]
            starts, ends, first = words(part, o, _INSIDE)
            if not len(starts):
                continue
            flat = part[_INSIDE[part]]
            spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype(np.int64)), pa.py_buffer(flat)])
            coded = pc.dictionary_encode(spelled)
            known = len(coded.dictionary)
            of = np.repeat(np.arange(j - i), np.diff(first))
            key, code, count = np.unique(lang[i:j][of] * known + np.asarray(coded.indices), return_inverse=True, return_counts=True)
            letters, bounds = text_buffer(coded.dictionary)
            r = _ranges_of(mix(word_hashes(letters, bounds[:-1], bounds[1:], lower=False)[key % known] ^ salt[key // known]), ranges)
            order = np.lexsort((r, key // known))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(1, len(order) + 1)
            key, r, count = key[order], r[order], count[order]
            breaks = np.cumsum(_BREAK[part])[starts]
            new = np.r_[True, (breaks[1:] != breaks[:-1]) | (of[1:] != of[:-1])]
            ids = np.zeros(len(starts) + int(new.sum()) + 1, np.uint32)
            ids[np.arange(len(starts)) + np.cumsum(new)] = place[code]
            cut = _cuts(key // known, r)
            a, b = cut[:-1], cut[1:]
            spell = coded.dictionary.cast(pa.string()).take(pa.array(key % known))
            k = len(a)
            edges = pa.array(np.r_[0, 0, b], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(k + 1, shard)), pa.array([None, *r[a].tolist()], pa.int32()), pa.array(np.r_[0, a + 1], pa.int32()),
                pa.array([pack_plain(ids)] + [None] * k, pa.binary()), pa.array([None, *(langs[x] for x in (key[a] // known).tolist())], pa.string()),
                pa.ListArray.from_arrays(edges, spell), pa.ListArray.from_arrays(edges, pa.array(count)),
            ], names=[c.split()[0] for c in _SPLIT.split(", ")])
            shard += 1


_COUNTED = "shard long, base int, ids binary, lang string, words array<string>, codes array<long>, totals array<long>, n long"


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All elements of a list column one after another, and the lengths of its lists."""
    column = column.combine_chunks()
    return column.flatten(), np.asarray(pc.list_value_length(column)).astype(np.int64)


def _rows(columns: list, names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    fields = [c.split() for c in names.split(", ")]
    return pa.table([pa.array(x, kinds[t]) for x, (_, t) in zip(columns, fields, strict=True)], names=[c for c, _ in fields])


def _count_words(table: pa.Table, ranges: int, least: int) -> pa.Table:
    """Of one range of words: for each shard's block the ids (0 for rare ones); frequent words and all occurrences by language."""
    spelled, size = _lists(table.column("words"))
    count, _ = _lists(table.column("counts"))
    langs = pc.dictionary_encode(table.column("lang").combine_chunks())
    spelled = pc.dictionary_encode(spelled)
    known = len(spelled.dictionary)
    key, code = np.unique(np.repeat(np.asarray(langs.indices).astype(np.int64), size) * known + np.asarray(spelled.indices), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, code, np.asarray(count))
    often = total >= least
    number = (np.cumsum(often) - 1) * ranges + table.column("r")[0].as_py() + 1
    if len(number) and number[-1] >= 1 << 32:
        raise ValueError("more frequent words than 32-bit ids")
    ids = np.where(often, number, 0).astype(np.uint32)[code]
    ends = np.cumsum(size)
    out = [[s, b, pack_plain(ids[e - k : e]), None, None, None, None, None] for s, b, e, k in zip(table.column("shard").to_pylist(), table.column("base").to_pylist(), ends, size, strict=True)]
    names, spelling = langs.dictionary.to_pylist(), spelled.dictionary
    for x, name in enumerate(names):
        mine = key // known == x
        kept = mine & often
        out.append([None, None, None, name, spelling.take(pa.array(key[kept] % known)).to_pylist(), number[kept].tolist(), total[kept].tolist(), int(total[mine].sum())])
    return _rows(list(zip(*out, strict=True)), _COUNTED)


_INDEXED = "shard long, r int, base int, alphabet binary, bwt binary, reverse binary, keys binary, counts binary"


def _pairs(index: FMIndex, alphabet: np.ndarray, ranges: int):
    """Pairs by range and key: keys, ranges, and their states."""
    lo, back, size = index.start()
    of, symbol, lo, back, size = index.extend(lo, back, size, left=False)
    key = (alphabet[of] << _U(32)) | alphabet[symbol - 1]
    r = _ranges_of(mix(key), ranges)
    order = np.lexsort((key, r))
    return key[order], r[order], (lo[order], back[order], size[order])


def _index(texts: pa.Table, replies: pa.Table, ranges: int) -> pa.Table:
    """The shard's index over the shared ids, and its pairs by range."""
    shard = texts.column("shard")[0].as_py()
    ids = unpack_plain(texts.column("ids")[0].as_py(), np.uint32)
    shared = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    for base, blob in zip(replies.column("base").to_pylist(), replies.column("ids").to_pylist(), strict=True):
        got = unpack_plain(blob, np.uint32)
        shared[base : base + len(got)] = got
    text = shared[ids]
    text = text[np.r_[True, (text[1:] > 0) | (text[:-1] > 0)]]
    alphabet = np.unique(text[text > 0]).astype(_U)
    dense = np.where(text > 0, np.searchsorted(alphabet, text) + 1, 0).astype(np.uint32)
    index = FMIndex.build(dense)
    key, r, (_, _, size) = _pairs(index, alphabet, ranges)
    cut = _cuts(r)
    rows = [[shard, None, None, pack_plain(alphabet), pack_plain(index.sides[0].astype(np.uint32)), pack_plain(index.sides[1].astype(np.uint32)), None, None]]
    rows += [[shard, int(r[a]), int(a), None, None, None, pack_sorted(key[a:b]), pack_plain(size[a:b].astype(np.uint32))] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return _rows(list(zip(*rows, strict=True)), _INDEXED)


_PAIRED = "shard long, base int, often binary, first array<long>, second array<long>, totals array<long>"


def _count_pairs(table: pa.Table, least: int) -> pa.Table:
    """Of one range of pairs: for each shard's block which are frequent, and the frequent ones with their counts."""
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    key, code = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, code, np.concatenate([unpack_plain(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64))
    often = total >= least
    mask, at, out = often[code], 0, []
    for s, b, k in zip(table.column("shard").to_pylist(), table.column("base").to_pylist(), map(len, keys), strict=True):
        if mask[at : at + k].any():
            out.append([s, b, pack_plain(mask[at : at + k].astype(np.uint8)), None, None, None])
        at += k
    key, total = key[often], total[often]
    if len(key):
        out.append([None, None, None, (key >> _U(32)).tolist(), (key & _U(0xFFFFFFFF)).tolist(), total.tolist()])
    return _rows(list(zip(*out, strict=True)) or [[]] * 6, _PAIRED)


_TRIPLED = "r int, pair binary, before binary, counts binary"


def _extend(index: pa.Table, replies: pa.Table, ranges: int) -> pa.Table:
    """A shard's triples whose two pairs are frequent, by range: the second pair, the word before it, and counts."""
    alphabet = unpack_plain(index.column("alphabet")[0].as_py(), _U)
    fm = FMIndex(*(unpack_plain(index.column(c)[0].as_py(), np.uint32) for c in ("bwt", "reverse")))
    key, _, state = _pairs(fm, alphabet, ranges)
    often = np.zeros(len(key), bool)
    for base, blob in zip(replies.column("base").to_pylist(), replies.column("often").to_pylist(), strict=True):
        got = unpack_plain(blob, np.uint8)
        often[base : base + len(got)] = got > 0
    pair = key[often]
    of, symbol, _, _, size = fm.extend(*(x[often] for x in state), left=True)
    before, pairs = alphabet[symbol - 1], np.sort(pair)
    left = (before << _U(32)) | (pair[of] >> _U(32))
    real = pairs[np.minimum(np.searchsorted(pairs, left), len(pairs) - 1)] == left if len(pairs) else np.zeros(len(left), bool)
    pair, before, size = pair[of][real], before[real], size[real]
    r = _ranges_of(mix(pair ^ mix(before)), ranges)
    order = np.lexsort((before, pair, r))
    pair, before, size, r = pair[order], before[order], size[order], r[order]
    cut = _cuts(r)
    rows = [[int(r[a]), pack_sorted(pair[a:b]), pack_plain(before[a:b].astype(np.uint32)), pack_plain(size[a:b].astype(np.uint32))] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return _rows(list(zip(*rows, strict=True)) or [[]] * 4, _TRIPLED)


def _count_triples(table: pa.Table, least: int) -> pa.Table:
    pair = np.concatenate([unpack_sorted(x) for x in table.column("pair").to_pylist()])
    before, count = (np.concatenate([unpack_plain(x, np.uint32) for x in table.column(c).to_pylist()]) for c in ("before", "counts"))
    order = np.lexsort((before, pair))
    pair, before, count = pair[order], before[order], count[order].astype(np.int64)
    cut = _cuts(pair, before)[:-1]
    total = np.add.reduceat(count, cut)
    often = total >= least
    pair, before = pair[cut][often], before[cut][often]
    return pa.table([pa.array(before.astype(np.int64)), pa.array((pair >> _U(32)).astype(np.int64)), pa.array((pair & _U(0xFFFFFFFF)).astype(np.int64)), pa.array(total[often])], names=["first", "second", "third", "f"])


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Exact counts over all texts, frequent ones only: words (id, lang, word, f), pairs (first, second, f),
    triples (first, second, third, f), and for each language n, the number of all its words."""
    ranges = key_ranges(docs.sparkSession)
    texts = docs.where("text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text"))
    split = stage(texts.mapInArrow(lambda it: _split(it, ranges), _SPLIT), "words")
    counted = stage(split.where("r is not null").select("shard", "r", "base", "lang", "words", "counts").groupBy("r").applyInArrow(lambda t: _count_words(t, ranges, least), _COUNTED), "vocabulary")
    replies = counted.where("shard is not null").select("shard", "base", "ids")
    indexed = stage(split.where("r is null").select("shard", "ids").groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(lambda a, b: _index(a, b, ranges), _INDEXED), "index")
    paired = stage(indexed.where("r is not null").select("shard", "r", "base", "keys", "counts").groupBy("r").applyInArrow(lambda t: _count_pairs(t, least), _PAIRED), "pairs")
    replies = paired.where("shard is not null").select("shard", "base", "often")
    tripled = indexed.where("r is null").select("shard", "alphabet", "bwt", "reverse").groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(lambda a, b: _extend(a, b, ranges), _TRIPLED)
    triples = stage(tripled.groupBy("r").applyInArrow(lambda t: _count_triples(t, least), "first long, second long, third long, f long"), "triples")
    vocabulary = counted.where("shard is null").select("lang", F.explode(F.arrays_zip("codes", "words", "totals")).alias("x")).select(F.col("x.codes").alias("id"), "lang", F.col("x.words").alias("word"), F.col("x.totals").alias("f"))
    pairs = paired.where("shard is null").select(F.explode(F.arrays_zip("first", "second", "totals")).alias("x")).select("x.first", "x.second", F.col("x.totals").alias("f"))
    return vocabulary, pairs, triples, counted.where("shard is null").groupBy("lang").agg(F.sum("n").alias("n"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)), exact for counts below 10^15."""
    big = [x.cast("decimal(19,0)") for x in (a, left, right)]
    return F.call_function("div", big[0] * big[0] * F.lit(1_000_000).cast("decimal(7,0)"), big[1] * big[2])


def collocations(docs: DataFrame, top: int, least: int = LEAST) -> DataFrame:
    """The `top` best phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    `docs` has lang and text; other columns are ignored.  Texts are folded A-Z to a-z and cut at `.,;:!?` and line ends; a
    phrase counts wherever its words stand in a row, overlaps and repeated rows included.  Candidates have a count a of
    `least` or more.  A candidate is cut in two where floor(10^6 a^2 / (l r)) is lowest, at the first such place.  It
    goes if a longer candidate around it has at least `INSIDE` per cent of its count.  Ties rank by count, then by phrase
    in byte order.  A null lang is `und`; null and empty texts hold no word; very long texts are shards of their own;
    a text without a break is one piece.  No words give no rows.
    """
    vocabulary, pairs, triples, n = phrase_counts(docs, least)

    def word(k: str) -> DataFrame:
        return vocabulary.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"), F.col("f").alias(f"{k}_f"))

    two = pairs.join(vocabulary.select(F.col("id").alias("first"), "lang", F.col("word").alias("first_word"), F.col("f").alias("l")), "first")
    two = stage(two.join(word("second").withColumnRenamed("second_f", "r"), "second"), "two")
    front = two.select("first", "second", "lang", F.concat_ws(" ", "first_word", "second_word").alias("front"), F.col("l").alias("first_f"), F.col("f").alias("front_f"))
    behind = two.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("second_word").alias("third_word"), F.col("r").alias("third_f"), F.col("f").alias("behind_f"))
    three = triples.join(front, ["first", "second"]).join(behind, ["second", "third"])
    one, other = _score(F.col("f"), F.col("first_f"), F.col("behind_f")), _score(F.col("f"), F.col("front_f"), F.col("third_f"))
    three = three.withColumn("one", one).withColumn("other", other).withColumn("early", F.col("one") <= F.col("other"))
    three = stage(three.select(
        "first", "second", "third", "lang", F.concat_ws(" ", "front", "third_word").alias("phrase"), F.col("f").alias("a"),
        F.when(F.col("early"), F.col("first_f")).otherwise(F.col("front_f")).alias("l"), F.when(F.col("early"), F.col("behind_f")).otherwise(F.col("third_f")).alias("r"),
        F.least("one", "other").alias("score")), "three")
    around = three.select("first", "second", "a").unionByName(three.select(F.col("second").alias("first"), F.col("third").alias("second"), "a")).groupBy("first", "second").agg(F.max("a").alias("most"))
    two = two.join(around, ["first", "second"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * INSIDE))
    two = two.select("lang", F.concat_ws(" ", "first_word", "second_word").alias("phrase"), F.col("f").alias("a"), "l", "r", _score(F.col("f"), F.col("l"), F.col("r")).alias("score"))
    every = two.unionByName(three.select(two.columns))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))  # the best of each part first, so that no task gets all phrases of a language
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
