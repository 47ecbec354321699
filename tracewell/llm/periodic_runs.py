"""Periodic runs of words by a dictionary of basic factors.

Level k of the dictionary names the runs of 2^k words of a text: two positions of a text share a name exactly when the
2^k words there are the same, and a name of level k+1 is a pair of names of level k.  Positions whose name stands only once
in their text leave, since no longer factor there can come back; ordinary prose empties the upper levels at once.  On each
level the successors of a position, no further off than twice the length, form arithmetic progressions; a stretch of
positions with the same difference proposes that difference as a period.  Each proposal is extended to both sides
and equal stretches keep their smallest period.

A run of smallest period q with at least 4 q words is met on the level whose length is the first power of two not under
q: a factor of q words or more can not come back sooner than q within the run, so all its positions propose q.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracewell.llm.text import _WORD, pieces, text_buffer, words

MIN_WORDS = 6
MIN_POWERS = 4
#: Bytes of text looked at together; a longer text is taken alone.
CHUNK = 1 << 21


def _names(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose key comes back, ordered by key and place; their names, and whether the next one has the same name."""
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[order]
    same = np.r_[key[1:] == key[:-1], False] if len(key) else np.empty(0, bool)
    again = same | np.r_[False, same[:-1]] if len(key) else same
    same = same[again]
    name = np.cumsum(np.r_[True, ~same[:-1]]) if len(same) else np.empty(0, np.int64)
    return pos[again], name, same


def _proposals(pos: np.ndarray, same: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of positions with one and the same distance to their successor: start, end of what they cover, distance."""
    at = np.flatnonzero(same)
    i, d = pos[at], pos[at + 1] - pos[at]
    near = d <= 2 * length
    i, d = i[near], d[near]
    if not len(i):
        return i, i, d
    order = np.lexsort((i, d))
    i, d = i[order], d[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)]
    first, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(i)] - 1
    start, end, d = i[first], i[last] + length + d[first], d[first]
    long = (end - start >= MIN_POWERS * d) & (end - start >= MIN_WORDS)
    return start[long], end[long], d[long]


def _extend(code: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move both ends outwards while the period holds within the text."""
    start, end = start.copy(), end.copy()
    live = np.arange(len(start))
    while len(live):
        s = start[live] - 1
        ok = s >= 0
        ok[ok] &= (text[s[ok]] == text[s[ok] + 1]) & (code[s[ok]] == code[s[ok] + d[live][ok]])
        live = live[ok]
        start[live] -= 1
    live = np.arange(len(end))
    while len(live):
        e = end[live]
        ok = e < len(code)
        ok[ok] &= (text[e[ok]] == text[e[ok] - 1]) & (code[e[ok]] == code[e[ok] - d[live][ok]])
        live = live[ok]
        end[live] += 1
    return start, end


def runs_of(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in texts of word codes; text t has the words first[t] to first[t+1].  Starts, ends and periods, ordered by start and period."""
    n = len(code)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    most = int(np.diff(first).max(initial=0))
    pos, name, same = _names(text * (int(code.max(initial=0)) + 1) + code, np.arange(n))
    length = 1
    while len(pos):
        out.append(_proposals(pos, same, length))
        if MIN_POWERS * length >= most:
            break
        table = np.full(n + length, -1, np.int64)
        table[pos] = name
        pos = np.flatnonzero((table[:n] >= 0) & (table[length : n + length] >= 0))
        pos, name, same = _names(table[pos] * (len(name) + 2) + table[pos + length], pos)
        length *= 2
    start, end, d = (np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
    start, end = _extend(code, text, start, end, d)
    order = np.lexsort((d, end, start))
    start, end, d = start[order], end[order], d[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.empty(0, bool)
    start, end, d = start[new], end[new], d[new]
    order = np.lexsort((d, start))
    return start[order], end[order], d[order]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, each followed by a space, and where each begins."""
    lens = ends - starts + 1
    at = np.r_[0, np.cumsum(lens)]
    src = np.repeat(starts - at[:-1], lens) + np.arange(at[-1])
    src[at[1:] - 1] = 0
    out = data[src] if len(src) else np.empty(0, np.uint8)
    out[at[1:] - 1] = 0x20
    return out, at


_OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _look(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_buffer(batch.column(batch.num_columns - 1))
        for i, j, part, o in pieces(data, off, CHUNK):
            starts, ends, first = words(part, o)
            flat = part[_WORD[part]]
            bounds = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
            spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
            code = np.asarray(pc.dictionary_encode(spelled).indices).astype(np.int64)
            s, e, d = runs_of(code, first)
            of = np.searchsorted(first, s, side="right") - 1
            gone = np.zeros(len(code) + 1, np.int64)
            np.add.at(gone, s + d, 1)
            np.add.at(gone, e, -1)
            stay = np.cumsum(gone[:-1]) == 0
            out, at = _joined(part, starts[stay], ends[stay])
            kept = at[np.searchsorted(np.flatnonzero(stay), first)]
            raw = out.tobytes()
            text = [raw[a : max(a, b - 1)].decode() for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(s, first), pa.int32()),
                pa.StructArray.from_arrays([pa.array(s - first[of]), pa.array(e - s), pa.array(d)], fields=list(_RUNS.value_type)))
            cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first)), runs, pa.array(text, pa.string())], names=names)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns are ignored): doc_id, n_words, runs, collapsed.

    A run is a stretch of at least `MIN_WORDS` words and `MIN_POWERS` times its smallest period that can not be
    extended; `runs` has them by start and period, counted in words from 0.  `collapsed` is the text without the words that
    a run holds after its first period, joined by one space.  Null, empty and blank texts have no word, no run and an empty
    `collapsed`.  Very long texts are taken whole, one at a time, in memory that grows with the text.  Repeated rows and
    null ids stay as they are.  Words are compared by spelling, not by hash.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _look(it, ["doc_id", "n_words", "runs", "collapsed"]), f"doc_id {kind}, {_OUT}")
