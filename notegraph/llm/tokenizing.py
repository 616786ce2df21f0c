"""Batch encoding with the tokenizers and sentencepiece libraries, for use inside tasks.

A byte-level BPE splits a text before every space between words, around a line break between
them, and between a word and its full stop or comma, so such pieces encode alone as they do
in place. Where a space has white space on a side, or ends the text, the pieces would not be
independent; there a text is not cut. No text is cut short.

Pieces are found by array operations over the bytes of many texts and numbered by Arrow's
dictionary. So a worker looks each distinct piece up once for a group of texts, sends those it
lacks to the library, and Arrow puts their ids in the pieces' places.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import compress
from sys import getsizeof

import numpy as np
import pyarrow as pa

#: Bytes of the piece memo in one worker, by sys.getsizeof; past it what was met once goes first. Between
#: two groups of texts, so that the pieces of one group, each of them short, may stand over it.
MEMO_BYTES = 72 << 20
#: What a piece of the memo takes beside its bytes and those of its ids.
PIECE_COST = 2 * getsizeof(b"") + 100
#: Marks for pieces of the memo that were met again, less one: a power of two.
MARKS = (1 << 21) - 1
#: Bytes of a piece that is kept. Longer ones, as in texts without spaces, are encoded where they stand.
MEMO_PIECE = 64
#: Bytes of texts whose pieces are looked up together.
GROUP_BYTES = 4 << 20
#: A piece without white space, but for a space before it.
_PLAIN = re.compile("[ ]?[^\\s\u180e\u200b]+")
#: What is white space here or in the library beyond ASCII, as UTF-8.
_WIDE_BLANKS = [int.from_bytes(chr(x).encode()) for x in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file."""
    return PieceEncoder(path) if path.endswith(".model") else BpeEncoder(path)


def version(path: str) -> str:
    """Digest of the vocabulary file: counts of one version never serve another."""
    import tokenizers

    lib = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(open(path, "rb").read() + f"|{lib}|{tokenizers.__version__}".encode()).hexdigest()


class Encoder:
    def groups(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For consecutive groups of texts: the ids of all its texts, one after another, and where
        those of each text begin, with their number at the end."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as uint32."""
        return [np.asarray(ids[a:b], np.uint32) for ids, begins in self.groups(pa.array(texts, pa.large_string())) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]

    def count(self, texts: list[str] | pa.Array) -> list[int]:
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        return [n for _, begins in self.groups(array) for n in np.diff(begins).tolist()]


class PieceEncoder(Encoder):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def groups(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = [np.asarray(x, np.uint32) for x in self.model.encode([x or "" for x in texts.to_pylist()], num_threads=1)]
        yield np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])


class BpeEncoder(Encoder):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        kind = json.load(open(path))
        before = kind.get("pre_tokenizer") or {}
        # only this pre-tokenizer is known to split before blanks, and only with no normaliser
        self.splits = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not kind.get("normalizer") and all(
            not re.search(r"[\s.,]", x["content"]) and not x.get("lstrip") and not x.get("rstrip") and not x.get("single_word") for x in kind.get("added_tokens", [])
        )
        self.added = [x["content"] for x in kind.get("added_tokens", [])]
        newline = self.model.encode("\n", add_special_tokens=False).ids
        self.splits = self.splits and len(newline) == 1
        self.newline = newline[0]
        #: Little-endian ids in the fewest bytes: two where all ids of the vocabulary fit.
        self.kind = np.dtype("<u2" if max(self.model.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else "<u4")
        #: Ids by piece, both as bytes.
        self.memo: dict[bytes, bytes] = {}
        self.held = 0
        #: Marks of pieces that were met again, by hash; two pieces may share one.
        self.met = np.zeros(MARKS + 1, bool)

    def _hold(self, new: list[tuple[bytes, bytes]]) -> None:
        """Keep what the memo lacks."""
        self.memo.update(new)
        self.held += sum([len(x) + len(ids) for x, ids in new]) + len(new) * PIECE_COST

    def _drop(self) -> None:
        """Shorten the memo to three quarters at most: pieces met again since the last time, the first of them."""
        met = self.met[np.fromiter(map(hash, self.memo), np.int64, len(self.memo)) & MARKS]
        for piece in [*compress(self.memo, ~met)]:
            self.held -= len(piece) + len(self.memo.pop(piece)) + PIECE_COST
        while self.held > MEMO_BYTES // 4 * 3:
            piece, ids = self.memo.popitem()
            self.held -= len(piece) + len(ids) + PIECE_COST
        self.met[:] = False

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, self.kind).tobytes() for x in found]

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of words without white space, but for a space before them. They are joined by line breaks,
        encoded as one text and cut at the line breaks' ids: one call costs more than a word."""
        out: list[bytes] = []
        size = self.kind.itemsize
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            text = "\n".join(some)
            data = self._whole([text])[0]
            ends = (size * np.flatnonzero(np.frombuffer(data, self.kind) == self.newline)).tolist()
            if len(ends) + 1 != len(some) or any(x in text for x in self.added):  # a line break isn't always a token of its own here
                out += self._whole(some)
                continue
            ends.append(len(data))
            start = 0
            for end in ends:
                out.append(data[start:end])
                start = end + size
        return out

    def _lacking(self, pieces: list[bytes]) -> list[bytes]:
        """Encode pieces that the memo lacks, and keep those that may be kept."""
        texts = [x.decode() for x in pieces]
        plain = [_PLAIN.fullmatch(x) is not None for x in texts]
        joined = iter(self._joined([x for x, y in zip(texts, plain) if y]))
        others = iter(self._whole([x for x, y in zip(texts, plain) if not y]))
        out = [next(joined if y else others) for y in plain]
        self._hold([(x, ids) for x, ids in zip(pieces, out) if len(x) <= MEMO_PIECE])
        return out

    def _group(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data`` and where those of each text begin. ``bounds``: where each text begins, and the end."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(bounds), np.int64)
        cuts = _cuts(data, bounds)
        numbered = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        pieces = _bytes(numbered.dictionary)
        ids = [*map(self.memo.get, pieces)]
        lacks = _nones(ids)
        marks = np.fromiter(map(hash, pieces), np.int64, len(pieces)) & MARKS
        self.met[np.delete(marks, lacks)] = True
        for i, found in zip(lacks, self._lacking([pieces[i] for i in lacks])):
            ids[i] = found
        placed = pa.array(ids, pa.large_binary()).take(numbered.indices)
        _, ends, values = placed.buffers()
        ends = np.frombuffer(ends, np.int64)[placed.offset : placed.offset + len(cuts)] // self.kind.itemsize
        return np.frombuffer(values, self.kind)[: ends[-1]], ends[np.searchsorted(cuts, bounds)]

    def groups(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        data, bounds = _utf8(texts)
        at = 0
        while at < len(bounds) - 1:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GROUP_BYTES, "right")) - 1)
            part, begins = data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
            if self.splits:
                yield self._group(part, begins)
            else:
                found = self._whole([part[a:b].tobytes().decode() for a, b in zip(begins[:-1], begins[1:])])
                yield np.frombuffer(b"".join(found), self.kind), np.cumsum([0, *(len(x) // self.kind.itemsize for x in found)])
            at = end
            if self.held > MEMO_BYTES:
                self._drop()


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, nulls empty, and where each string begins, with the end of the last."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    _, bounds, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8), bounds


def _bytes(array: pa.LargeBinaryArray) -> list[bytes]:
    """An array as a list; its own ``to_pylist`` takes several times as long."""
    _, ends, values = array.buffers()
    values, ends = values.to_pybytes(), np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1].tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where independent pieces of UTF-8 texts begin, and the end. ``bounds``: where each text begins, and the end."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    white = np.zeros(n + 1, bool)
    white[:n] = (data - np.uint8(9) < 5) | (data - np.uint8(28) < 5)
    for lead, length in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(data[: n - length + 1] == lead) if n >= length else np.zeros(0, np.int64)
        code = sum(data[at + k].astype(np.int64) << 8 * (length - 1 - k) for k in range(length))
        at = at[np.isin(code, _WIDE_BLANKS)]
        for k in range(length):
            white[at + k] = True
    cut = np.flatnonzero((data == 32) | (data == 10))  # spaces and line breaks with no white space on a side
    cut = cut[~(edge[cut] | edge[cut + 1] | white[cut - 1] | white[cut + 1])]
    stop = np.flatnonzero((data == 46) | (data == 44))  # stops and commas that end a word of Latin letters
    stop = stop[~edge[stop]]
    stop = stop[edge[stop + 1] | np.isin(data[np.minimum(stop + 1, n - 1)], (32, 10))]
    before = data[stop - 1]
    stop = stop[((before | 32) - np.uint8(97) < 26) | (data[stop - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]
    edge[cut] = True
    edge[cut[data[cut] == 10] + 1] = True
    edge[stop] = True
    edge[n] = True
    return np.flatnonzero(edge)


def _nones(items: list) -> list[int]:
    out: list[int] = []
    with suppress(ValueError):
        at = -1
        while True:
            out.append(at := items.index(None, at + 1))
    return out
