"""Token ids of a byte-level BPE tokenizer file, for whole Arrow batches.

Such a tokenizer splits a text into pieces (contractions, letters, digits, marks, white space)
and encodes each piece by itself. Pieces are found with array operations, equal pieces of a
block are encoded once, and a worker remembers the pieces it has met. The encoding itself is the
`tokenizers` library's, and a text that holds a special token's string is encoded by it as a whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa

from sketchloom.llm import kernels as K

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
# Code points with the property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Pieces that a worker remembers; beyond, it starts anew.
REMEMBERED = 1_500_000
_NEW_LINE, _QUOTE = 10, 39


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return cp, before[off]


class Pieces:
    """Where the pieces of texts begin."""

    def __init__(self):
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[list(WHITE_SPACE)] = SPACE

    def of(self, cp: np.ndarray) -> np.ndarray:
        found = self.classes[cp]
        if (found == UNKNOWN).any():
            for c in np.unique(cp[found == UNKNOWN]).tolist():
                self.classes[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
            found = self.classes[cp]
        return found

    def starts(self, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.of(cp)
        text_start = np.zeros(n + 1, bool)
        text_start[off] = True
        begin = text_start[:n].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        # The last white space before other characters stands alone, and a space goes with what follows.
        k = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~text_start[1:n]) + 1
        begin[k - 1] = True
        begin[k] = cp[k - 1] != 32
        # 's 't 'm 'd 're 've 'll
        q = np.flatnonzero((cp[:-1] == _QUOTE) & begin[:-1] & ~text_start[1:n])
        if len(q):
            one = cp[q + 1]
            last = np.minimum(q + 2, n - 1)
            two = np.where(text_start[q + 2] | (q + 2 >= n), 0, cp[last])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            size = np.where(short, 1, np.where(long, 2, 0))
            q, size = q[size > 0], size[size > 0]
            begin[q + 1] = False
            after = q + 1 + size
            begin[after[after < n]] = True
        return np.flatnonzero(begin)


class Encoder:
    """Ids of texts. One per worker process and tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces()
        self.new_line = self._ids(["\n"])[0][0]
        self._forget()

    def _forget(self) -> None:
        empty = (np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32))
        self.levels = [empty, empty]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids, and the ids, of pieces. Pieces without white space other than a leading space go line by line."""
        single = [k for k, p in enumerate(new) if p[:1].isspace() and not (p[0] == " " and len(p) > 1 and not p[1].isspace())]
        lists: list = [None] * len(new)
        for k, ids in zip(single, self._ids([new[k] for k in single])):
            lists[k] = ids
        plain = [k for k in range(len(new)) if lists[k] is None]
        for lo in range(0, len(plain), 20_000):
            some = plain[lo : lo + 20_000]
            ids = np.array(self._ids(["\n".join(new[k] for k in some) + "\n"])[0], np.uint32)
            ends = np.flatnonzero(ids == self.new_line)
            if len(ends) != len(some):
                raise ValueError("pieces and lines differ")
            for k, part in zip(some, np.split(ids, ends + 1)):
                lists[k] = part[:-1]
        counts = np.array([len(x) for x in lists], np.int64)
        return counts, np.concatenate([np.asarray(x, np.uint32) for x in lists]) if lists else np.zeros(0, np.uint32)

    @staticmethod
    def _gather(at: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = off[at + 1] - off[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return n, ids[np.repeat(off[at] - (ends - n), n) + np.arange(total)]

    def _look_up(self, keys: np.ndarray, piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct keys: offsets into ids, and ids. piece(k): the piece of key k."""
        n = np.zeros(len(keys), np.int64)
        parts = []
        missing = np.ones(len(keys), bool)
        for hashes, off, ids in self.levels:
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
                hit = np.flatnonzero((hashes[at] == keys) & missing)
                missing[hit] = False
                n[hit], got = self._gather(at[hit], off, ids)
                parts.append((hit, got))
        new = np.flatnonzero(missing)
        if len(new):
            n[new], got = self._encode([piece(k) for k in new.tolist()])
            parts.append((new, got))
            self._remember(keys[new], n[new], got)
        off = np.concatenate(([0], np.cumsum(n)))
        ids = np.empty(int(off[-1]), np.uint32)
        for hit, got in parts:
            m = n[hit]
            ends = np.cumsum(m)
            ids[np.repeat(off[hit] - (ends - m), m) + np.arange(len(got))] = got
        return off, ids, n

    def _remember(self, keys: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        def merged(a, b):
            hashes = np.concatenate((a[0], b[0]))
            off = np.concatenate((a[1], a[1][-1] + b[1][1:]))
            every = np.concatenate((a[2], b[2]))
            order = np.argsort(hashes)
            counts, every = self._gather(order, off, every)
            return hashes[order], np.concatenate(([0], np.cumsum(counts))), every

        self.levels[1] = merged(self.levels[1], (keys, np.concatenate(([0], np.cumsum(n))), ids))
        if len(self.levels[1][0]) > 120_000:
            self.levels[0] = merged(self.levels[0], self.levels[1])
            self.levels[1] = (np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32))
        if len(self.levels[0][0]) > REMEMBERED:
            self._forget()

    def encode(self, data: np.ndarray, off: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts, each followed by the id `end` if given, and where each text's begin."""
        cp, at = code_points(data, off)
        starts = self.pieces.starts(cp, at)
        ends = np.append(starts[1:], len(cp))
        keys = K.range_hashes(cp.astype(np.uint64) + np.uint64(1), starts, ends).view(np.int64)
        codes, distinct = pd.factorize(keys)
        top = np.maximum.accumulate(codes) if len(codes) else codes
        first = np.flatnonzero(np.concatenate(([True], codes[1:] > top[:-1]))) if len(codes) else codes
        raw = cp.astype("<u4").tobytes()
        piece = lambda k: raw[4 * starts[first[k]] : 4 * ends[first[k]]].decode("utf-32-le")
        uoff, uids, un = self._look_up(np.asarray(distinct, np.int64), piece)
        n, ids = self._gather(codes, uoff, uids)
        total = np.concatenate(([0], np.cumsum(n)))
        where = total[np.searchsorted(starts, at)]
        if any(s.encode() in data.tobytes() for s in self.special):
            ids, where = self._with_special(data, off, ids, where)
        if end is None:
            return ids, where
        shift = np.arange(len(where))
        out = np.full(len(ids) + len(where) - 1, end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(shift[:-1], np.diff(where))] = ids
        return out, where + shift

    def _with_special(self, data: np.ndarray, off: np.ndarray, ids: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [ids[where[k] : where[k + 1]] for k in range(len(where) - 1)]
        for k in range(len(parts)):
            text = data[off[k] : off[k + 1]].tobytes().decode("utf-8")
            if any(s in text for s in self.special):
                parts[k] = np.array(self._ids([text])[0], np.uint32)
        return np.concatenate(parts) if parts else ids, np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(column: pa.Array, path: str, end: int | None = None, block: int = K.BLOCK_BYTES):
    """(lo, hi, ids, where) for blocks of a text column; null is an empty text."""
    data, off = K.utf8(column)
    for lo, hi in K.blocks(off, block):
        yield lo, hi, *encoder(path).encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], end)
