"""Byte-level BPE ids of whole texts through the tokenizers library, with a memo of pieces.

The pre-tokeniser's tokens are runs of letters, digits or other signs, each with at most one space in front, and
runs of white space less the last sign before a word.  So a text can be cut, without changing its
tokens, before a run of white space, before and (unless it is a space) after the last sign of
a run, and between letters, digits and punctuation.  A cut is made only where the bytes on both sides are
of a known kind: no cut touches an apostrophe (contractions) or a rare white space character.
``tests/llm`` compares with encoding every text whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .hashing import parts, text_bytes
from .words import Memo, encode, runs

#: Pieces in a Python worker's memo at most, about 35 bytes each.
MEMO = 2_000_000
LETTER, DIGIT, PUNCTUATION, BLANK, RARE, OTHER = range(6)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = PUNCTUATION
KIND[ord("'")] = OTHER
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
KIND[0x1C:0x20] = RARE
#: Lead bytes of U+00C0 to U+017F, letters but for the two below.
LATIN = (0xC3, 0xC4, 0xC5)
NOT_LETTERS = (0x97, 0xB7)
#: A word with at most a space in front; between two of them, a line break is a token of its own.
PLAIN = re.compile(" ?[\\x21-\\x7e\u00c0-\u017f]+")
#: White space outside ASCII, in UTF-8.
BLANKS = [chr(x).encode() for x in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
LEADS = np.zeros(256, bool)
LEADS[[x[0] for x in BLANKS]] = True


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte of UTF-8 texts."""
    kind = KIND[data]
    for lead in LATIN:
        at = np.flatnonzero(data == lead)
        if lead == 0xC3:
            at = at[~np.isin(data[at + 1], NOT_LETTERS)]
        kind[at] = kind[at + 1] = LETTER
    at = np.flatnonzero(LEADS[data])
    for blank in BLANKS:
        hit = at[at + len(blank) <= len(data)]
        for i, byte in enumerate(blank):
            hit = hit[data[hit + i] == byte]
        for i in range(len(blank)):
            kind[hit + i] = RARE
    return kind


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts start."""
    starts = np.zeros(len(data) + 1, bool)
    if len(data):
        kind = kinds(data)
        blank, word = kind == BLANK, kind < BLANK
        solid = word | (kind == OTHER)
        starts[1:-1] = (word[1:] & word[:-1] & (kind[1:] != kind[:-1])) | (blank[1:] & solid[:-1])
        ends = blank[:-1] & solid[1:]  # the last sign of a run of white space
        ends[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = False
        starts[:-2] |= ends
        starts[1:-1] |= ends & (data[:-1] != 0x20)
        starts[offsets] = True
    return np.flatnonzero(starts[:-1])


class Encoder:
    """ids of texts as the library gives them for whole texts.

    The string of an added token (``<|endoftext|>``) inside a text gets that token's id, as in the library; with ``plain`` it is text like any other.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [] if plain else list(self.tokenizer.get_added_tokens_decoder().values())
        if any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added):
            raise ValueError(f"{path} has added tokens that reach beyond their own letters")
        self.special = {x.content for x in added}
        #: the library takes the leftmost, longest added token out of a text before anything else
        self.added = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(self.special, key=len, reverse=True))) if added else None
        self.mark = self._lines([""])[0]
        self.memo = Memo(self._pieces, MEMO, "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")

    def _lines(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([x + "\n" for x in texts], add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of each); those without white space but a space in front are joined to lines, as calls for single words are slow."""
        plain = np.array([len(self.mark) == 1 and PLAIN.fullmatch(x) is not None and x not in self.special for x in pieces], bool)
        ids, length = [np.zeros(0, np.int64)], np.zeros(len(pieces), np.int64)
        joined = np.flatnonzero(plain)
        for i in range(0, len(joined), 1000):
            own = joined[i : i + 1000]
            found = np.array(self._lines(["\n".join([pieces[k] for k in own])])[0], np.int64)
            ends = np.flatnonzero(found == self.mark[0])
            length[own] = np.diff(ends, prepend=-1) - 1
            ids.append(np.delete(found, ends))
        rest = np.flatnonzero(~plain)
        for i in range(0, len(rest), 1000):
            found = [x.ids for x in self.tokenizer.encode_batch_fast([pieces[k] for k in rest[i : i + 1000]], add_special_tokens=False)]
            length[rest[i : i + 1000]] = list(map(len, found))
            ids += [np.array(x, np.int64) for x in found]
        order = np.concatenate([joined, rest])
        start = np.empty_like(length)
        start[order] = np.cumsum(length[order]) - length[order]
        return np.concatenate(ids)[runs(start, length)], length

    def encode(self, texts: pa.Array):
        """Yields (first row, ids of a slice of rows, bounds per row) for a string array without nulls."""
        for at, some in parts(texts, 1 << 20):
            data, offsets = text_bytes(some)
            yield at, *encode(data, offsets, self._starts(data, offsets), self.memo)

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start; an added token is one piece, and what stands before and behind it are texts of their own."""
        found = [] if self.added is None else [m.span() for m in self.added.finditer(data)]
        if not found:
            return piece_starts(data, offsets)
        low, high = np.array(found, np.int64).T
        one = np.searchsorted(offsets, low, "right") == np.searchsorted(offsets, high, "left")
        if not one.all():  # a match across two texts is none, and may hide another behind it
            found = [(a + m.start(), a + m.end()) for a, b in zip(offsets[:-1], offsets[1:]) for m in self.added.finditer(data[a:b])]
            low, high = np.array(found, np.int64).reshape(-1, 2).T
        starts = piece_starts(data, np.sort(np.concatenate([offsets, low, high])))
        inside = np.searchsorted(low, starts, "left") - 1  # the last token that begins before
        return starts[(inside < 0) | (starts >= np.append(high, 0)[inside])]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, memo: int = MEMO, plain: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once; ``memo`` bounds the pieces of a generation, ``plain`` reads added tokens' strings as any text."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    _encoders[path, plain].memo.limit = memo
    return _encoders[path, plain]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind each row's ids."""
    return np.insert(ids.astype("<u4"), bounds[1:], end_id), bounds + np.arange(len(bounds))
