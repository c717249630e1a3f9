"""Ids of texts from the ids of their pieces: Arrow finds the different pieces of a slice, numpy puts their ids in place.

An encoder names the places where a text may be cut without changing its ids.  Each different piece of a slice
is looked up in a bounded memo of sorted arrays (about 35 bytes a piece), and only unknown ones are encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .hashing import EXACT, byte_table, span_hashes

#: Pieces whose ids are put in place at once.
STEP = 1 << 18
#: Longer pieces are not kept.
LONGEST = 64
CHECK = byte_table(False, 2)


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] places), start[1], ..."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


class Table:
    """Pieces by two 64-bit hashes, in order of the first: place and number of their ids, and whether they were looked up."""

    def __init__(self, kind: str):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.ids = np.zeros(0, bool), np.zeros(0, kind)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of pieces in ascending order of ``key``."""
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        hit = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), bool)
        self.used[at[hit]] = True
        return at, hit

    def add(self, key: np.ndarray, check: np.ndarray, start: np.ndarray, length: np.ndarray, used: np.ndarray, ids: np.ndarray) -> None:
        at = np.searchsorted(self.key, key)
        start = start + len(self.ids)
        for name, values in (("key", key), ("check", check), ("start", start), ("length", length), ("used", used)):
            setattr(self, name, np.insert(getattr(self, name), at, values))
        self.ids = np.concatenate([self.ids, ids])

    def keep(self, rows: np.ndarray) -> None:
        self.ids = self.ids[runs(self.start[rows], self.length[rows])]
        self.key, self.check, self.length = self.key[rows], self.check[rows], self.length[rows]
        self.start, self.used = np.cumsum(self.length) - self.length, np.zeros(len(rows), bool)


class Memo:
    """Ids of pieces, encoded once; past ``limit`` pieces those go that were not looked up again, and half the limit stays at most."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int, kind: str = "<u4"):
        self.encode, self.limit, self.kind = encode, limit, kind
        self.base, self.young = Table(kind), Table(kind)

    def look_up(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of different pieces."""
        _, where, data = pieces.buffers()
        bounds = np.frombuffer(where, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(data, np.uint8)[: bounds[-1]]
        key = span_hashes(data, bounds[:-1], bounds[1:], EXACT)
        order = np.argsort(key)
        key, check = key[order], span_hashes(data, bounds[:-1], bounds[1:], CHECK)[order]
        length, flat = np.zeros(len(key), np.int64), []
        start, at, lost = np.zeros(len(key), np.int64), 0, np.ones(len(key), bool)
        for table in (self.base, self.young):
            place, hit = table.find(key, check)
            place = place[hit]
            length[hit] = table.length[place]
            start[hit] = at + np.cumsum(length[hit]) - length[hit]
            flat.append(table.ids[runs(table.start[place], table.length[place])])
            at, lost = at + len(flat[-1]), lost & ~hit
        lost = np.flatnonzero(lost)
        if len(lost):
            ids, own = self.encode(pieces.take(pa.array(order[lost])).cast(pa.large_string()).to_pylist())
            ids, first = ids.astype(self.kind), np.cumsum(own) - own
            length[lost] = own
            start[lost] = at + first
            flat.append(ids)
            short = np.diff(bounds)[order[lost]] <= LONGEST
            short &= np.append(True, key[lost][1:] != key[lost][:-1])
            self.young.add(key[lost[short]], check[lost[short]], np.cumsum(own[short]) - own[short], own[short], np.zeros(short.sum(), bool), ids[runs(first[short], own[short])])
            if len(self.young.key) > max(1 << 15, len(self.base.key) // 8):
                self._merge()
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return np.concatenate(flat), start[back], length[back]

    def _merge(self) -> None:
        x, self.young = self.young, Table(self.kind)
        self.base.add(x.key, x.check, x.start, x.length, x.used, x.ids)
        if len(self.base.key) > self.limit:
            self.base.keep(np.flatnonzero(self.base.used)[: self.limit // 2])


def encode(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds per text); ``starts`` ascend, and every text that is not empty starts with one of them."""
    cells = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    out, sizes = [np.zeros(0, memo.kind)], [np.zeros(0, np.int64)]
    for i in range(0, len(starts), STEP):
        coded = cells.slice(i, STEP).dictionary_encode()
        flat, start, length = memo.look_up(coded.dictionary)
        which = coded.indices.to_numpy()
        sizes.append(length[which])
        out.append(flat[runs(start[which], sizes[-1])])
    to = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return np.concatenate(out), to[np.searchsorted(starts, offsets)]
