"""Operator 11: alignment of two tokenisations by whitespace-token anchors.

Every text is encoded whole by both tokenizers, and each token stands for a range of bytes of the text with a space in front.  Byte
offsets where tokens of both end are shared ends.  A shared end before a token that starts with a space in both is an anchor;
anchors cut a document into windows of a few ids, and windows are memoised by their two tuples of ids: the same ids have the
same bytes, so the same groups and links.  Groups are what shared ends cut a window into; links are
the pairs of tokens whose ranges overlap.

How often an id pair is linked in the corpus is summed from each document's distinct pairs, not from its links.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.loop import join_spread
from . import bpe, pieces
from .common import column, filesystem, new_place, slices, staged
from .hashing import mix, owners, parts, release, text_bytes
from .words import Memo, encode as encode_parts, runs

#: Windows in a Python worker's memo at most, some 100 bytes each.
WINDOWS = 300_000
#: Id pairs up to which every task holds the table of counts (17 bytes each); with more, documents' pairs are joined to it by shuffle.
HELD_PAIRS = 4_000_000
PARTS = 500_000
#: A pair is looked up as a * STRIDE + b.
STRIDE = 1 << 32


class PieceLibrary:
    """ids of whole texts by the sentencepiece library, with a memo of parts between which no piece of the vocabulary reaches."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError(f"{path}: only models that leave texts as they are and put a space in front")
        spec.add_dummy_prefix = False  # the space in front is part of the text here, and parts inside a text have none
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        words = pieces.Vocabulary(path)
        self.raw, self.joined = words.raw, np.ones((256, 256), bool)
        self.joined[:128, :128] = False
        for i in words.scores:
            code = np.frombuffer(words.raw[i], np.uint8)
            self.joined[code[:-1], code[1:]] = True
        self.memo = Memo(self._parts, PARTS, "<u4")

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(texts, num_threads=1)
        return np.array([i for x in found for i in x], np.int64), np.array(list(map(len, found)), np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds per text) of texts that start with the space in front."""
        starts = np.ones(len(data), bool)
        starts[1:] = ~self.joined[data[:-1], data[1:]]
        starts[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        return encode_parts(data, offsets, np.flatnonzero(starts), self.memo)


class Spelling:
    """The bytes of each id."""

    def __init__(self, raw: list[bytes]):
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array(list(map(len, raw)), np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.spaced = np.array([x[:1] == b" " for x in raw])

    def agrees(self, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the ids of each row spell its text."""
        size = np.append(0, np.cumsum(self.length[ids]))[bounds]
        ok = np.diff(size) == np.diff(offsets)
        spelt = self.data[runs(self.start[ids], self.length[ids])]
        if ok.all():
            wrong = np.flatnonzero(spelt != data)
            ok[np.searchsorted(offsets, wrong, "right") - 1] = False
        else:
            for i in np.flatnonzero(ok):
                ok[i] = np.array_equal(spelt[size[i] : size[i + 1]], data[offsets[i] : offsets[i + 1]])
        return ok


def byte_level(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary: bytes that print stand for themselves, the others for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab = model["model"]["vocab"]
    added = {x["content"]: x["id"] for x in model["added_tokens"]}
    raw = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in vocab.items():
        raw[i] = token.encode() if token in added else bytes(byte_of[c] for c in token)
    for token, i in added.items():
        raw[i] = token.encode()
    return raw


class Windows:
    """Alignments of windows by their id tuples (two 64-bit hashes of them): text of the groups, number of groups, codes of the links.

    Past ``most`` windows those go that were not looked up again, and half of them stay at most.
    """

    NUMBERS = ("key", "check", "groups", "text_at", "text_size", "links_at", "links", "used")

    def __init__(self, a: Spelling, b: Spelling, most: int):
        self.a, self.b, self.most, self.width, self.seed = a, b, most, len(b.length), 1
        self.rows = {x: np.zeros(0, np.uint64 if x in ("key", "check") else np.int64) for x in self.NUMBERS}
        self.text, self.codes = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.digits = [Spelling([str(i).encode() + b"," for i in range(len(x.length))]) for x in (a, b)]

    def _align(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> dict[str, np.ndarray]:
        """The rows of new windows; their texts and codes are put behind the others."""
        a_end, b_end = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        spot = np.searchsorted(b_end, a_end)
        last_a = b_end[spot] == a_end  # tokens that end a group
        last_b = np.zeros(len(b), bool)
        last_b[spot[last_a]] = True
        low = np.searchsorted(b_end, np.append(0, a_end[:-1]), "right")
        links = spot - low + 1
        self.codes = np.concatenate([self.codes, np.repeat(a, links) * self.width + b[runs(low, links)]])
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        size = np.concatenate([self.digits[0].length[a], self.digits[1].length[b]])[order]
        start = np.concatenate([self.digits[0].start[a], self.digits[1].start[b] + len(self.digits[0].data)])[order]
        text = np.concatenate([self.digits[0].data, self.digits[1].data])[runs(start, size)]
        ends = np.cumsum(size)
        sign = np.where(np.concatenate([last_a, last_b]), np.repeat([ord("|"), ord(";")], [len(a), len(b)]), ord(","))[order]
        text[ends - 1] = sign
        ends = np.append(0, ends)
        to = ends[a_at + b_at]  # a window's tokens lie together
        out = {"groups": np.add.reduceat(last_a.astype(np.int64), a_at[:-1]), "text_at": to[:-1] + len(self.text), "text_size": np.diff(to), "links": np.add.reduceat(links, a_at[:-1])}
        out["links_at"] = len(self.codes) - links.sum() + np.cumsum(out["links"]) - out["links"]
        self.text = np.concatenate([self.text, text])
        return out

    def _keep(self) -> None:
        own = {x: v[np.flatnonzero(self.rows["used"])[: self.most // 2]] for x, v in self.rows.items()}
        self.text, self.codes = self.text[runs(own["text_at"], own["text_size"])], self.codes[runs(own["links_at"], own["links"])]
        own["text_at"], own["links_at"] = np.cumsum(own["text_size"]) - own["text_size"], np.cumsum(own["links"]) - own["links"]
        self.rows = own | {"used": np.zeros(len(own["key"]), np.int64)}

    def look_up(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
        """The row of each window a[a_at[i]:a_at[i + 1]], b[b_at[i]:b_at[i + 1]]; equal windows are aligned once.  Rows hold until the next call."""
        if len(self.rows["key"]) > self.most:
            self._keep()
        keys = []
        for seed in (self.seed * 0x51ED270B, self.seed * 0x2545F491 + 1):
            total = np.zeros(len(a_at) - 1, np.uint64)
            for ids, at in ((a, a_at), (b, b_at)):
                n = np.diff(at)
                where = (np.arange(len(ids)) - np.repeat(at[:-1], n)).astype(np.uint64)
                total = mix(total + np.add.reduceat(mix((ids.astype(np.uint64) << np.uint64(32)) + where + np.uint64(seed)), at[:-1]) + n.astype(np.uint64))
            keys.append(total)
        order = np.argsort(keys[0])
        key, check = keys[0][order], keys[1][order]
        new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first, key, check = order[new], key[new], check[new]

        def find() -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(self.rows["key"], key)
            at[at == len(self.rows["key"])] = 0
            return at, (self.rows["key"][at] == key) & (self.rows["check"][at] == check) if len(self.rows["key"]) else np.zeros(len(key), bool)

        at, hit = find()
        self.rows["used"][at[hit]] = 1
        lost = np.flatnonzero(~hit & np.append(True, key[1:] != key[:-1]))
        if len(lost):
            rows, (a_n, b_n) = first[lost], (np.diff(a_at)[first[lost]], np.diff(b_at)[first[lost]])
            out = self._align(a[runs(a_at[rows], a_n)], np.append(0, np.cumsum(a_n)), b[runs(b_at[rows], b_n)], np.append(0, np.cumsum(b_n)))
            out |= {"key": key[lost], "check": check[lost], "used": np.zeros(len(lost), np.int64)}
            to = np.searchsorted(self.rows["key"], key[lost])
            self.rows = {x: np.insert(self.rows[x], to, out[x]) for x in self.NUMBERS}
            at, hit = find()
        if not hit.all():  # two windows with one key: start anew with other hashes
            self.seed, self.rows = self.seed + 2, {x: v[:0] for x, v in self.rows.items()}
            return self.look_up(a, a_at, b, b_at)
        return at[which]


class Aligner:
    """Both tokenizers, their spellings and the memo of windows."""

    def __init__(self, a_path: str, b_path: str, windows: int = WINDOWS):
        self.a_ids, self.b_ids = bpe.encoder(a_path, PARTS, plain=True), PieceLibrary(b_path)
        self.a, self.b = Spelling(byte_level(a_path)), Spelling(self.b_ids.raw)
        self.windows = Windows(self.a, self.b, windows)

    def align(self, texts: pa.Array):
        """Yields (first row, columns) for slices of a string array with nulls: n_a, n_b, n_groups, n_links per row, groups (text) and each row's distinct link codes and their numbers (two arrays with bounds)."""
        full = pc.fill_null(texts, "")
        spaced = pc.binary_join_element_wise(pc.if_else(pc.equal(full, ""), "", " "), full, "")
        for at, some in parts(spaced, 1 << 20):
            data, offsets = text_bytes(some)
            n = len(some)
            a, a_to = next(((ids, bounds) for _, ids, bounds in self.a_ids.encode(some)), (np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)))
            b, b_to = self.b_ids.encode(data, offsets)
            a, b = a.astype(np.int64), b.astype(np.int64)
            ok = self.a.agrees(a, a_to, data, offsets) & self.b.agrees(b, b_to, data, offsets)
            n_a, n_b = np.diff(a_to) * ok, np.diff(b_to) * ok
            a, b = a[np.repeat(ok, np.diff(a_to))], b[np.repeat(ok, np.diff(b_to))]
            a_to, b_to = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
            n_groups, n_links, strings = np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n
            codes, often, bounds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
            if len(a):
                a_end, b_end = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
                spot = np.searchsorted(b_end, a_end)
                shared = np.flatnonzero(b_end[spot] == a_end)  # places in a whose end is shared; rows end at such
                inside = np.flatnonzero(shared + 1 < len(a))
                anchor = np.zeros(len(shared), bool)
                anchor[inside] = self.a.spaced[a[shared[inside] + 1]] & self.b.spaced[b[spot[shared[inside]] + 1]]
                anchor |= np.isin(shared + 1, a_to)
                cut = shared[anchor]
                a_at, b_at = np.append(0, cut + 1), np.append(0, spot[cut] + 1)
                window = self.windows.look_up(a, a_at, b, b_at)
                w_to = np.searchsorted(a_at, a_to)
                w_row = owners(w_to)
                known = {x: v[window] for x, v in self.windows.rows.items()}
                n_groups = np.bincount(w_row, known["groups"], n).astype(np.int64)
                n_links = np.bincount(w_row, known["links"], n).astype(np.int64)
                raw = self.windows.text[runs(known["text_at"], known["text_size"])].tobytes()
                to = np.append(0, np.cumsum(known["text_size"]))[w_to].tolist()
                strings = [raw[x : max(x, y - 1)] for x, y in zip(to[:-1], to[1:])]
                codes = self.windows.codes[runs(known["links_at"], known["links"])]
                space = len(self.a.length) * len(self.b.length)
                codes = np.sort(np.repeat(w_row, known["links"]) * space + codes)
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                often = np.diff(np.append(first, len(codes)))
                row, codes = np.divmod(codes[first], space)
                bounds = np.searchsorted(row, np.arange(n + 1))
            yield at, n_a, n_b, n_groups, n_links, strings, codes, often, bounds


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _cells(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of a flat array as binary cells."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """Alignment of ``docs(doc_id, text)`` under tokenizer A (a byte-level file of the tokenizers library) and B (a sentencepiece model).

    A encodes the text with a space in front, B the text, whose model adds that space; strings of special tokens are plain text.
    Returns row (unique), doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``, or with ``digest`` its lower-case hex SHA-256), and the row's distinct id pairs:
    a, b and often (binary, little-endian unsigned 32-bit).  A text that is null, empty or that the ids of A or B do not spell has no tokens: zeros, groups
    '' and no pairs.  Null and repeated ids are rows like any other; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, width = TaskContext.get().partitionId() << 33, len(aligner(a_path, b_path).b.length)
        for batch in batches:
            for at, n_a, n_b, n_groups, n_links, strings, codes, often, bounds in aligner(a_path, b_path).align(column(batch, "text")):
                groups = [hashlib.sha256(x).hexdigest() if x else "" for x in strings] if digest else [x.decode() for x in strings]
                n = len(n_a)
                ids = [_cells(x.astype("<u4"), bounds) for x in (*np.divmod(codes, width), often)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), column(batch, "doc_id").slice(at, n), *[pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)], pa.array(groups, pa.string()), *ids],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "often"],
                )
                uid += n
            release()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a binary, b binary, often binary")


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(column(batch, name).to_pylist()), "<u4").astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best) of every id pair linked in align()'s rows: the number of links that hold it, and whether no other pair of its b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "a", 8 << 20):
                codes, which = np.unique(_numbers(some, "a") * STRIDE + _numbers(some, "b"), return_inverse=True)
                n = np.bincount(which, _numbers(some, "often"), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes // STRIDE), pa.array(codes % STRIDE), pa.array(n)], names=["a", "b", "n"])

    counts = staged(aligned.select("a", "b", "often").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, pairs: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """align()'s rows without their pairs, and n_best (links whose pair is best) and count_sum (sum of their pairs' n) over each row's links.

    ``pairs`` is a table in files (staged).  Up to ``held`` pairs each task reads it from there; with more, the rows' pairs are joined to it by shuffle.
    """
    keep = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    if pairs.count() > held:

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, "a", 4 << 20):
                    n = pc.binary_length(column(some, "a")).to_numpy(zero_copy_only=False) // 4
                    row = column(some, "row").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(_numbers(some, "a") * STRIDE + _numbers(some, "b")), pa.array(np.repeat(row, n)), pa.array(_numbers(some, "often"))], names=["code", "row", "often"])

        rows = aligned.select("row", "a", "b", "often").mapInArrow(apart, "code long, row long, often long")
        table = pairs.select((F.col("a") * STRIDE + F.col("b")).alias("code"), "n", F.col("best").cast("long").alias("best"))
        sums = join_spread(rows, table, "code").groupBy("row").agg(F.sum(F.col("often") * F.col("best")).alias("n_best"), F.sum(F.col("often") * F.col("n")).alias("count_sum"))
        zero = F.lit(0).cast("long")
        return aligned.select(*keep).join(sums, "row", "left").select(*keep, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))

    files = pairs.inputFiles()
    table: list[np.ndarray] = []

    def load() -> list[np.ndarray]:
        if not table:
            read = [ds.dataset(path, filesystem=where, format="parquet").to_table() for where, path in map(filesystem, files)]
            all_ = pa.concat_tables(read) if read else pa.table({"a": [], "b": [], "n": [], "best": []})
            code = all_["a"].to_numpy().astype(np.int64) * STRIDE + all_["b"].to_numpy().astype(np.int64)
            order = np.argsort(code)
            table.extend([code[order], all_["n"].to_numpy().astype(np.int64)[order], all_["best"].to_numpy(zero_copy_only=False).astype(bool)[order]])
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n, best = load()
            for some in slices(batch, "a", 4 << 20):
                bounds = np.append(0, np.cumsum(pc.binary_length(column(some, "a")).to_numpy(zero_copy_only=False).astype(np.int64))) // 4
                at, often = np.searchsorted(code, _numbers(some, "a") * STRIDE + _numbers(some, "b")), _numbers(some, "often")
                sums = [np.diff(np.append(0, np.cumsum(x))[bounds]) for x in (often * best[at], often * n[at])] if len(code) else [np.zeros(some.num_rows, np.int64)] * 2
                yield pa.RecordBatch.from_arrays([*[column(some, c) for c in keep], *map(pa.array, sums)], names=[*keep, "n_best", "count_sum"])
        release()

    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema}
    return aligned.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_best long, count_sum long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents by byte_bpe_50k.json (A) and piece_bpe_32k.model (B)."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = new_place(spark, "aligned")
    aligned = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    aligned.write.option("compression", "zstd").parquet(place)
    aligned = spark.read.schema(aligned.schema).parquet(place)
    found = with_counts(aligned, staged(pair_counts(aligned), "pairs"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
