"""Token ids of whole texts from a public byte-level BPE file, remembering the ids of pieces seen before.

The byte-level pre-tokenizer never joins a blank or a line feed to the character before it, nor a full stop or comma to
a letter or digit.  A text without two white-space characters in a row, and with none at its ends, is therefore cut there
and put together from the ids of its pieces; Arrow cuts the texts, looks the pieces up and joins their ids.  Other
texts, and all texts of files that pre-tokenize otherwise, are encoded whole.  Either way the ids are those of the tokenizers library.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracewell.llm.text import pieces, text_buffer

#: Pieces remembered by a worker before it goes on with the more frequent half of them (bounds its memory).
REMEMBERED = 600_000
#: Bytes of text that are cut at once; a worker needs about ten times as much while it cuts them.
_PART = 1 << 23
#: Pieces encoded as one text.
_RUN = 1 << 10

_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
_ODD = rf"^$|^{_SPACE}|{_SPACE}$|{_SPACE}{{2}}"
#: Letters and digits of any version of Unicode, and the marks that are cut off behind them.
_MARKED = r"([0-9A-Za-zÀ-ÖØ-öø-ɏ])([.,])"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cuttable(tok) -> bool:
    """Whether pieces can be encoded by themselves: the plain byte-level pre-tokenizer, no special token with a place to cut."""
    spec = json.loads(tok.to_str())
    pre = spec["pre_tokenizer"] or {}
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    loose = any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" .,\n\t") for t in spec["added_tokens"])
    return byte_level and not loose and not spec["normalizer"]


class Encoder:
    """Ids as little-endian numbers of `dtype`: 16 bits where the vocabulary allows it.

    A piece is a word behind a blank, written without it, or what begins with a line feed; what stands for itself is marked by a tab.
    No text that is cut has a blank in front of a line feed or tab, so these are not mistaken for each other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        n = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.width = np.array([len(self.tok.id_to_token(i) or "") for i in range(n)], np.int64)
        for i, t in self.tok.get_added_tokens_decoder().items():
            self.width[i] = len(t.content.encode())
        self.cuttable = _cuttable(self.tok)
        self.seen, self.ids_of, self.times = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.empty(0, np.int64)

    def whole(self, text: str) -> bytes:
        return self._ids([text])[0].tobytes()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text by itself.  One after another: the library's batches start a thread for each core of the machine, with memory of their own."""
        return [np.array(self.tok.encode(x, add_special_tokens=False).ids, self.dtype) for x in texts]

    def learn(self, new: pa.Array) -> None:
        """Remember the ids of pieces: many are encoded as one text and cut where their bytes end."""
        if not len(new):
            return
        data, off = text_buffer(new)
        first = data[off[:-1]]
        data, off = text_buffer(pc.binary_join_element_wise(pc.if_else(pa.array((first == 9) | (first == 10)), "", " ").cast(pa.large_string()), new, pa.scalar("", pa.large_string())))
        data, alone = data.copy(), first == 9
        data[off[:-1][alone]] = 10  # a line feed keeps it apart from what is before it and is an id of its own
        edge = np.r_[off[:-1:_RUN], off[-1]]
        ids = np.concatenate(self._ids([data[a:b].tobytes().decode() for a, b in zip(edge[:-1], edge[1:], strict=True)]))
        cut = np.searchsorted(np.cumsum(self.width[ids]), off - off[0], side="right")
        keep = np.ones(len(ids), bool)
        keep[cut[:-1][alone]] = False
        ends = np.cumsum(np.r_[0, np.diff(cut) - alone]) * self.dtype.itemsize
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(ids[keep])])
        self.seen, self.ids_of = pa.concat_arrays([self.seen, new]), pa.concat_arrays([self.ids_of, found])

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that can be cut, one after another, and where each ends."""
        marked = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), _MARKED, r"\1 " "\t" r"\2")
        marked = pc.binary_join_element_wise(pa.scalar("\t", pa.large_string()), marked, pa.scalar("", pa.large_string()))
        parts = pc.split_pattern(marked, " ")
        del marked
        last = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        known = len(self.seen)
        coded = pa.chunked_array([self.seen, parts.flatten()]).dictionary_encode().chunks[-1]  # one dictionary, that begins with what is known
        del parts
        self.learn(coded.dictionary[known:])
        at = coded.indices
        del coded
        joined = self.ids_of.take(at)
        self.times = np.bincount(at, minlength=len(self.seen)) + np.pad(self.times, (0, len(self.seen) - known))
        if len(self.seen) > REMEMBERED:
            kept = np.sort(np.argsort(-self.times, kind="stable")[: REMEMBERED // 2])
            self.seen, self.ids_of, self.times = self.seen.take(pa.array(kept)), self.ids_of.take(pa.array(kept)), self.times[kept] // 2
        _, off, raw = joined.buffers()
        off = np.frombuffer(off, np.int64)[joined.offset : joined.offset + len(joined) + 1] // self.dtype.itemsize
        return np.frombuffer(raw, self.dtype)[off[0] : off[-1]], off[last] - off[0]

    def part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.cuttable else np.ones(len(texts), bool)
        if not odd.any():
            return self._cut(texts)
        out: list = [None] * len(texts)
        at = np.flatnonzero(odd)
        for i, ids in zip(at, self._ids(texts.take(pa.array(at)).to_pylist()), strict=True):
            out[i] = ids
        at = np.flatnonzero(~odd)
        if len(at):
            ids, ends = self._cut(texts.take(pa.array(at)))
            for i, a, b in zip(at, np.r_[0, ends[:-1]], ends, strict=True):
                out[i] = ids[a:b]
        return np.concatenate(out), np.cumsum([len(x) for x in out])

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of texts of an Arrow string column (a null is an empty text): first row, last row, their ids one after another, and where each ends."""
        texts = texts.cast(pa.large_string()).fill_null("")
        data, off = text_buffer(texts)
        for i, j, _, _ in pieces(data, off, _PART):
            yield i, j, *self.part(texts[i:j])
        pa.default_memory_pool().release_unused()  # a reused worker waits beside the others

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [ids[a:b].tobytes() for _, _, ids, ends in self.column(pa.array(texts, pa.string())) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file; a reused worker keeps what it remembers."""
    held = sys.modules.setdefault("_token_encoders", ModuleType("_token_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
