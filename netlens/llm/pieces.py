"""Operator 3: SentencePiece encoding and decoding by an Aho-Corasick Viterbi.

One pass over the text feeds an Aho-Corasick automaton over the vocabulary's pieces.
At each end position its output links give every piece that ends there, and each relaxes the best
score of that position.  Characters that no piece covers cost ``UNKNOWN`` and become byte pieces.

Where no piece of the vocabulary holds two neighbouring (ASCII) characters, every path is cut between them, so the
best path of a text is a sequence of best paths of its parts.  Parts are looked up in a bounded memo.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, slices, text_column
from .hashing import parts, release, text_bytes
from .words import Memo, encode as encode_parts, runs

MARK = "▁"
#: Score of a character that no piece covers; below any sum of piece scores of a word.
UNKNOWN = -1e12
#: Parts in a Python worker's memo at most, about 35 bytes each.
MEMO = 1_000_000


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(x[3:5], 16): i for i, x in enumerate(self.pieces) if model.is_byte(i)}
        self.unknown = model.unk_id()
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        spelt = set(self.bytes.values())
        self.scores = {i: model.get_score(i) for i in range(n) if i not in special and i not in spelt}
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        #: what each id decodes to; control and unknown ids to nothing
        self.raw = [b"" if i in special else byte_of[i] if i in spelt else x.replace(MARK, " ").encode() for i, x in enumerate(self.pieces)]


class Encoder:
    """A vocabulary as an automaton, with a memo."""

    def __init__(self, path: str):
        import ahocorasick

        words = Vocabulary(path)
        self.bytes, self.unknown = words.bytes, words.unknown
        self.machine = ahocorasick.Automaton()
        #: whether some piece holds two ASCII characters next to each other; pairs with others count as such
        self.joined = np.ones((256, 256), bool)
        self.joined[:128, :128] = False
        for i, score in words.scores.items():
            piece = words.pieces[i]
            self.machine.add_word(piece, (len(piece), score, i))
            code = np.frombuffer(piece.replace(MARK, " ").encode(), np.uint8)
            self.joined[code[:-1], code[1:]] = True
        self.machine.make_automaton()
        self.memo = Memo(self._parts, MEMO, "<u2" if len(words.pieces) <= 65536 else "<u4")

    def best(self, text: str) -> list[int]:
        """Ids of the best-scoring segmentation of a marked text; ties go to the piece found first at the end position, longest first."""
        n = len(text)
        score = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 0  # positions up to here are final

        def unknown_to(end: int) -> None:
            """Single characters up to ``end``, where they are the only or the better way."""
            nonlocal at
            while at < end:
                at += 1
                if score[at - 1] + UNKNOWN > score[at]:
                    score[at], back[at] = score[at - 1] + UNKNOWN, (at - 1, -1)

        for last, (length, worth, i) in self.machine.iter(text):
            end = last + 1
            if end - 1 > at:
                unknown_to(end - 1)
            s = score[end - length] + worth
            if s > score[end]:
                score[end], back[end] = s, (end - length, i)
        unknown_to(n)
        ids: list[int] = []
        end = n
        while end:
            begin, i = back[end]
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(text[begin:end].encode())]
            else:
                ids.append(self.unknown)
            end = begin
        return ids[::-1]

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.best(x.replace(" ", MARK)) for x in texts]
        return np.array([i for x in found for i in x], np.int64), np.array(list(map(len, found)), np.int64)

    def encode(self, texts: pa.Array):
        """Yields (first row, ids of a slice of rows, bounds per row); a mark is put in front of a text and spaces become marks."""
        for at, some in parts(texts, 1 << 20):
            data, offsets = text_bytes(pc.replace_substring(some, MARK, " "))
            full = offsets[1:] > offsets[:-1]
            data = np.insert(data, offsets[:-1][full], 0x20)
            offsets = offsets + np.append(0, np.cumsum(full))
            starts = np.ones(len(data), bool)
            starts[1:] = ~self.joined[data[:-1], data[1:]]
            starts[offsets[:-1][full]] = True
            yield at, *encode_parts(data, offsets, np.flatnonzero(starts), self.memo)


class Decoder:
    """The bytes of each id."""

    def __init__(self, path: str):
        raw = Vocabulary(path).raw
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array(list(map(len, raw)), np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of rows of ids: bytes joined, marks as spaces, the mark in front dropped."""
        n = self.length[ids]
        data = self.data[runs(self.start[ids], n)]
        to = np.append(0, np.cumsum(n))[bounds]
        full = np.flatnonzero(to[1:] > to[:-1])
        lead = full[data[to[full]] == 0x20]
        data, to = np.delete(data, to[lead]), to - np.searchsorted(lead, np.arange(len(to)))
        cells = pa.Array.from_buffers(pa.binary(), len(to) - 1, [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data)])
        try:
            return cells.cast(pa.string())
        except pa.ArrowInvalid:  # ids that spell no UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in cells.to_pylist()], pa.string())


_encoders: dict[str, Encoder] = {}
_decoders: dict[str, Decoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, ids (binary, little-endian unsigned 32-bit), n_pieces.

    Whole texts; null or empty text has no ids; every row is kept as it is, repeated
    or null doc_ids too; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, bounds in encoder(model_path).encode(text_column(batch, "text")):
                cells = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(at, len(cells)), cells, pa.array(np.diff(bounds))], names=["doc_id", "ids", "n_pieces"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, ids binary, n_pieces long")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` → its columns and text; U+2581 in a source text comes back as a space."""
    out = encoded.select("doc_id", "ids", "n_pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = column(batch, "ids").fill_null(b"")
            for some in slices(batch.set_column(batch.schema.get_field_index("ids"), "ids", cells), "ids"):
                own = column(some, "ids")
                bounds = np.append(0, np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64))) // 4
                texts = decoder(model_path).decode(np.frombuffer(b"".join(own.to_pylist()), "<u4"), bounds)
                yield pa.RecordBatch.from_arrays([*some.columns, texts], names=["doc_id", "ids", "n_pieces", "text"])
            release()

    return out.mapInArrow(run, "doc_id long, ids binary, n_pieces long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every whole text encoded and decoded again: doc_id, n_pieces, ids_crc32, n_chars and decoded_sha256 of the decoded text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = decode(encode(docs, model), model)
    return back.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256"))
