"""Operator 12: scores of texts by a context-mixing language model.

A text is a row of symbols: its words (A-Z in lower case), each a symbol if it is among the frequent words of the training texts and else ESCAPE, its bytes
and STOP, and END behind the last.  Symbols have binary codes (a Huffman tree over words, one over bytes), and every bit of a code is
predicted: by its place in the tree, and by two tables of counts under the hashed contexts of one and two symbols (in spelt words of two and four).  The
logits of the three are summed with weights that a gate picks by how much each context has been seen, and a
correction of the weights, learned online bit by bit, refines them within a stretch of text.  The bits' probabilities multiply to the text's.

Learning is spread over the cluster: words are counted by a grouping; every task counts bits in its own tables, which are added block by block; the weights
come from counts of what the predictors said of training bits, each bit predicted from all other occurrences (its own is taken out of the counts).  Everything
comes from all training texts, weights too: symbols that recur in their contexts are counted once with their number.  Tables have as many slots as the training tokens ask for, up to a stated bound.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.loop import join_spread
from .common import column, filesystem, make_folder, new_place, slices, staged, text_column
from .hashing import LOWER, byte_table, parts, release, span_hashes, text_bytes, word_spans
from .words import runs

#: Words with a symbol of their own at most (some 100 bytes each in every task), and slots of a context table at most (4 bytes each while counted, 2 after).
WORDS, SLOTS = 1 << 18, 1 << 22
#: Slots of a block, in which tables are added.
BLOCK = 1 << 15
#: Symbols over which the online correction of the weights lasts, and its rate.
STRETCH, RATE = 256, 0.01
#: Added to counts before their logit.
PRIOR = 0.2
#: Steps of the three logits in the counts that weights are fitted on; a tree's branches are nearly even, so its logits are small.
LEVELS, STEPS = 17, (0.15, 0.9, 0.9)
GATES, INPUTS = 32, 3
#: Weights where nothing was seen, and how many bits' worth of belief they have.
DEFAULT, BELIEF = np.array([0.6, 0.2, 0.2, 0.0]), 20.0
#: Bits of stretches that are scored side by side, and bits looked up at once.
EVENTS, PORTION = 1 << 21, 1 << 14
CHECK = byte_table(True, 2)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, bits, code length per symbol, logit of a 1 per node) of the Huffman tree of positive counts; codes follow one another, from the root down."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    weight, parent, side = [float(x) for x in counts[order]] + [0.0] * (n - 1), np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    leaf, inner = 0, n
    for new in range(n, 2 * n - 1):  # of two queues in ascending order, the two lightest meet
        for bit in (0, 1):
            if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                x, leaf = leaf, leaf + 1
            else:
                x, inner = inner, inner + 1
            weight[new] += weight[x]
            parent[x], side[x] = new, bit
    ones = np.zeros(n - 1)
    np.add.at(ones, parent[:-1][side[:-1] == 1] - n, np.array(weight[:-1])[side[:-1] == 1])
    whole = np.array(weight[n:])
    logit = np.log(ones) - np.log(whole - ones)
    at, up = np.arange(n), []
    while len(at) and (at < 2 * n - 2).any():
        up.append(np.where(at < 2 * n - 2, at, -1))
        at = np.where(at < 2 * n - 2, parent[at], at)
    up = np.array(up[::-1]).T.reshape(n, -1)
    use = up >= 0
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    up, use = up[place], use[place]
    return (parent[up[use]] - n).astype(np.int32), side[up[use]], use.sum(1), logit.astype(np.float32)


class Codes:
    """Symbols and their codes: words 0..W-1 by falling count, END = W, ESCAPE = W + 1, then 256 bytes and STOP."""

    def __init__(self, key: np.ndarray, check: np.ndarray, count: np.ndarray, texts: int, rare: int, bytes_: np.ndarray, tokens: int, distinct: int):
        """Hashes and counts of the coded words, numbers of training texts and of tokens without a symbol, counts of their bytes (and of themselves last), all tokens and distinct ones."""
        n = len(key)
        order = np.argsort(key)
        self.key, self.check, self.symbol = key[order], check[order], order.astype(np.int64)
        self.words, self.end, self.escape, self.byte = n, n, n + 1, n + 2
        self.texts, self.tokens, self.distinct = texts, tokens, distinct
        self.log = np.log10(np.append(count, texts) + 1.0)
        w = huffman(np.concatenate([count, [texts, rare]]) + 1.0)
        b = huffman(bytes_ + 1.0)
        self.nodes = np.concatenate([w[0], b[0] + n + 1]).astype(np.uint32)
        self.bits = np.concatenate([w[1], b[1]])
        self.length = np.concatenate([w[2], b[2]]).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.logit = np.concatenate([w[3], b[3]])
        size = 1 << 12
        while size < min(SLOTS, 4 * tokens):
            size *= 2
        self.slots, self.spelt = size, size // 2

    def symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, bounds per text; symbol of each word, -1 without, bounds per text; two hashes of each word)."""
        data, offsets = text_bytes(texts)
        starts, ends, bounds = word_spans(data, offsets)
        key, check = span_hashes(data, starts, ends, LOWER), span_hashes(data, starts, ends, CHECK)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        own = np.where((self.key[at] == key) & (self.check[at] == check), self.symbol[at], -1) if len(self.key) else np.full(len(key), -1)
        token = np.insert(own, bounds[1:], self.end)
        size = np.insert(np.where(own < 0, ends - starts + 2, 1), bounds[1:], 1)
        to = np.append(0, np.cumsum(size))
        out = np.empty(to[-1], np.uint32)
        out[to[:-1]] = np.where(token < 0, self.escape, token)
        spelt = np.flatnonzero(own < 0)
        begin = to[:-1][np.flatnonzero(token < 0)]
        length = ends[spelt] - starts[spelt]
        out[runs(begin + 1, length)] = FOLD[data[runs(starts[spelt], length)]].astype(np.uint32) + np.uint32(self.byte)
        out[begin + length + 1] = self.byte + 256
        return out, to[bounds + np.arange(len(bounds))], own, bounds, key, check

    def contexts(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 32-bit hashes of what stands before each symbol of its text: one and two symbols, for bytes two and four."""
        n = len(symbols)
        place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
        before = lambda k: np.where(place >= k, np.append(np.zeros(min(k, n), np.uint32), symbols[: max(n - k, 0)] + np.uint32(1)), np.uint32(0))
        fold = lambda x, k: stir((x ^ (before(k) * np.uint32(0x9E3779B1))) + np.uint32(k))
        one = fold(np.zeros(n, np.uint32), 1)
        two = fold(one, 2)
        spelt = symbols >= self.byte
        return np.where(spelt, two, one), np.where(spelt, fold(fold(two, 3), 4), two)

    def expand(self, symbols: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, bits, bits of each symbol, two slots, whether a byte's) of the bits of symbols whose contexts are ``one`` and ``two``."""
        n = self.length[symbols]
        at = runs(self.start[symbols], n)
        node = self.nodes[at]
        return node, self.bits[at], n, *self.places(node, np.repeat(one, n), np.repeat(two, n))

    def places(self, node: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(two slots, whether a byte's) of nodes under their contexts."""
        turn = node * np.uint32(0x85EBCA6B)
        spelt = node > self.words
        high = np.uint32(33 - self.slots.bit_length())
        # contexts are well mixed, so the high bits of a product will do; bytes have the tables' last third
        slots = [((x ^ turn) * np.uint32(0x9E3779B1)) >> high for x in (one, two)]
        half = spelt.view(np.uint8)
        return *((x >> half) + half * np.uint32(self.slots) for x in slots), spelt


def stir(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def portions(codes: Codes, symbols: np.ndarray):
    """Symbols in portions of about PORTION bits, whose arrays stay in the processor's cache: slices (of any texts)."""
    ends = np.cumsum(codes.length[symbols])
    i = 0
    while i < len(symbols):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PORTION, "right")))
        yield slice(i, j)
        i = j


def distinct(symbols: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their contexts, how often) of symbols whose contexts are ``one`` and ``two``: equal ones together (those whose hashes meet may stand several times)."""
    key = two.astype(np.uint64) << np.uint64(32) | symbols
    order = np.argsort(key)
    key, symbols, one, two = key[order], symbols[order], one[order], two[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (one[1:] != one[:-1])
    at = np.flatnonzero(new)
    return symbols[at], one[at], two[at], np.diff(np.append(at, len(key)))


# ---------------------------------------------------------------- files of a model


def _save(place: str, name: str, **arrays) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    where, path = filesystem(place)
    with where.open_output_stream(f"{path}/{name}") as f:
        f.write(out.getvalue())


_held: dict[tuple[str, str], object] = {}


def _hold(place: str, name: str, make):
    """What ``make()`` gives, held by the worker while it works with this model: its codes and one thing more."""
    if (place, name) not in _held:
        for old in [k for k in _held if k != (place, "codes")]:
            del _held[old]
        _held[place, name] = make()
    return _held[place, name]


def codes_of(place: str) -> Codes:
    def read() -> Codes:
        where, path = filesystem(place)
        with where.open_input_stream(f"{path}/codes") as f:
            return Codes(**{k: v if v.ndim else int(v) for k, v in np.load(io.BytesIO(f.read())).items()})

    return _hold(place, "codes", read)


def tables_of(place: str, tables: str) -> np.ndarray:
    """Counts (2 x slots x 2, uint32) of the two context tables from their blocks."""
    codes = codes_of(place)
    out = np.zeros((2 * (codes.slots + codes.spelt), 2), np.uint32)
    where, path = filesystem(tables)
    for batch in ds.dataset(path, filesystem=where, format="parquet").to_batches():
        for k, cell in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            own = _unpack(cell)
            out[k * BLOCK : k * BLOCK + len(own)] = own
    return out.reshape(2, -1, 2)


def _pack(counts: np.ndarray) -> bytes:
    """Counts (slots x 2, uint32), bytes of equal place together, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(cell: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1, 2)


class Mixer:
    """A model as it predicts: context tables as logits with two bits of how much was seen, and weights."""

    SCALE = 1 / 1024

    def __init__(self, codes: Codes, counts: np.ndarray, weights: np.ndarray):
        self.codes, self.gates = codes, np.ascontiguousarray(weights, np.float32)
        self.weights = self.gates.T
        self.tables = []
        for own in counts:
            table = np.empty(len(own), np.int16)
            for i in range(0, len(own), 1 << 20):
                zero, one = own[i : i + (1 << 20)].astype(np.float64).T
                logit = np.clip(np.rint((np.log(one + PRIOR) - np.log(zero + PRIOR)) / self.SCALE / 4), -8191, 8191).astype(np.int16)
                table[i : i + (1 << 20)] = logit * 4 + seen(zero + one)
            self.tables.append(table)

    def score(self, symbols: np.ndarray, bounds: np.ndarray, rate: float = RATE) -> np.ndarray:
        """Log probability (natural) of each text."""
        codes, n_texts = self.codes, len(bounds) - 1
        size = np.diff(bounds)
        place = np.arange(len(symbols)) - np.repeat(bounds[:-1], size)
        text = np.repeat(np.arange(n_texts), size)
        begins = place % STRETCH == 0
        stretch = np.cumsum(begins) - 1
        one, two = codes.contexts(symbols, bounds)
        out = np.zeros(n_texts)
        if not len(symbols):
            return out
        # whole stretches, about EVENTS bits at once
        first = np.append(np.flatnonzero(begins), len(symbols))
        ends = np.append(0, np.cumsum(codes.length[symbols]))[first]
        i = 0
        while i < len(first) - 1:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + EVENTS, "right")) - 1)
            own = slice(first[i], first[j])
            step = place[own] % STRETCH
            order = np.argsort(step.astype(np.uint16), kind="stable")
            sym = symbols[own][order]
            lost = self._cost(sym, one[own][order], two[own][order], stretch[own][order] - i, j - i, np.searchsorted(step[order], np.arange(step.max() + 2)), rate)
            out -= np.bincount(text[own][order], lost, n_texts)
            i = j
        return out

    def _cost(self, symbols: np.ndarray, one: np.ndarray, two: np.ndarray, stretch: np.ndarray, n: int, steps: np.ndarray, rate: float) -> np.ndarray:
        """Cost in nats of each symbol; symbols are in order of their step in their stretch, and steps tells where each begins."""
        codes = self.codes
        size = codes.length[symbols]
        start = np.append(0, np.cumsum(size))
        x, z, sign = np.empty((INPUTS, start[-1]), np.float32), np.empty(start[-1], np.float32), np.empty(start[-1], np.float32)
        for own in portions(codes, symbols):
            node, bit, _, slot1, slot2, spelt = codes.expand(symbols[own], one[own], two[own])
            a, b = self.tables[0].take(slot1), self.tables[1].take(slot2)
            gate = spelt.view(np.int8) * np.int16(16)
            gate += (b & 3) << 2
            gate += a & 3
            at = slice(start[own.start], start[own.stop])
            weights = self.gates.take(gate, axis=0)
            np.multiply(bit, np.float32(-2), out=sign[at])
            sign[at] += 1
            codes.logit.take(node, out=x[0, at], mode="clip")
            np.multiply(a >> 2, np.float32(4 * self.SCALE), out=x[1, at])
            np.multiply(b >> 2, np.float32(4 * self.SCALE), out=x[2, at])
            now = weights[:, INPUTS].copy()
            for k in range(INPUTS):
                now += weights[:, k] * x[k, at]
            z[at] = now
        if rate:
            more = np.zeros((INPUTS, n), np.float32)
            for i, j in zip(steps[:-1].tolist(), steps[1:].tolist()):
                low, high = start[i], start[j]
                own, at, times = stretch[i:j], start[i:j] - low, size[i:j]
                now, side, each = z[low:high], sign[low:high], np.repeat(own, times)
                for k in range(INPUTS):
                    now += x[k, low:high] * more[k].take(each)
                # the error, target less probability, is -sign / (1 + exp(-sign z)), as sign is -1 where the bit is 1
                wrong = side / (np.float32(1) + np.exp(-side * now))
                for k in range(INPUTS):
                    more[k][own] -= np.float32(rate) * np.add.reduceat(x[k, low:high] * wrong, at)
        z *= sign
        np.clip(z, -20, 20, out=z)
        np.exp(z, out=z)
        z += 1
        return np.add.reduceat(np.log(z, out=z), start[:-1])


def seen(n: np.ndarray) -> np.ndarray:
    """Two bits: nothing, up to 2, up to 15 bits seen, or more."""
    return ((n > 0).astype(np.int16) + (n > 2) + (n > 15)).astype(np.int16)


# ---------------------------------------------------------------- learning


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c, key, check) of the words of ``docs(text)``, lower-cased, with two hashes; the empty word counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in parts(text_column(batch, "text"), 4 << 20):
                data, offsets = text_bytes(texts)
                starts, ends, _ = word_spans(data, offsets)
                length = ends - starts
                packed = FOLD[data[runs(starts, length)]]
                cells = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.append(0, np.cumsum(length))), pa.py_buffer(packed)])
                coded = cells.dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
                words = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, len(texts)))], names=["word", "n"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(column(batch, "word"))
            own = [pa.array(span_hashes(data, offsets[:-1], offsets[1:], t).view(np.int64)) for t in (LOWER, CHECK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=["word", "c", "key", "check"])

    counts = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    return staged(counts.mapInArrow(hashes, "word binary, c long, key long, check long"), "words")


def fit_codes(words: DataFrame, place: str, most: int = WORDS) -> Codes:
    """The codes of a vocabulary(): at most ``most`` words, those that occur most (at least twice); all of a count's words or none get a symbol."""
    step = F.floor(F.log2("c") * 64)
    real = words.where(F.length("word") > 0)
    sizes = sorted(real.where("c >= 2").groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r.s)  # 64 rows a doubling of the largest count
    least, n = None, 0
    for r in sizes:
        n += r.n
        if n > most:
            break
        least = r.c
    totals = words.agg(F.sum("c").alias("tokens"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("texts"), F.count(F.when(F.length("word") > 0, 1)).alias("words")).first()
    texts, coded = totals.texts or 0, real.where(F.col("c") >= least if least else F.lit(False))
    top = coded.select("key", "check", "c").toArrow()  # at most ``most`` rows
    key, check, count = (top[c].to_numpy() for c in ("key", "check", "c"))
    order = np.lexsort((key, -count)) if len(key) else np.zeros(0, np.int64)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257)
        for batch in batches:
            data, offsets = text_bytes(column(batch, "word"))
            c = column(batch, "c").to_numpy()
            total[:256] += np.bincount(data, np.repeat(c, np.diff(offsets)), 256)
            total[256] += c.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["b", "n"])

    rest = real.where(F.col("c") < least) if least else real
    bytes_ = np.zeros(257)
    for r in rest.select("word", "c").mapInArrow(spell, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # 257 rows
        bytes_[r.b] = r.n
    make_folder(place)
    own = {"key": key[order].view(np.uint64), "check": check[order].view(np.uint64), "count": count[order].astype(np.int64), "texts": texts, "rare": int(bytes_[256]), "bytes_": bytes_, "tokens": totals.tokens or 0, "distinct": totals.words + (texts > 0)}
    _save(place, "codes", **own)
    return Codes(**own)


def coded(docs: DataFrame, held_out: Column, place: str) -> DataFrame:
    """``docs(doc_id, text)`` in symbols: row (unique), doc_id, held_out, n_tokens, n_bytes, known and log_known (number of tokens with a symbol, sum of their log10(c + 1)), symbols, and rare (hashes of the words without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, codes = TaskContext.get().partitionId() << 33, codes_of(place)
        for batch in batches:
            for at, texts in parts(text_column(batch, "text"), 2 << 20):
                n = len(texts)
                symbols, to, own, bounds, key, check = codes.symbols(texts)
                count = np.diff(bounds)
                known = own >= 0
                row = np.repeat(np.arange(n), count)
                logs = np.bincount(row[known], codes.log[own[known]], n) + codes.log[codes.end]
                lost = np.flatnonzero(~known)
                rare = np.stack([key[lost], check[lost]], 1).tobytes()
                where = np.append(0, np.cumsum(~known))[bounds]
                cells = lambda raw, width, edge: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edge * width).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + n)),
                        *[column(batch, c).slice(at, n) for c in ("doc_id", "held_out")],
                        pa.array(count + 1),
                        pa.array(np.diff(text_bytes(texts)[1])),
                        pa.array(np.bincount(row[known], minlength=n) + (codes.texts > 0)),
                        pa.array(logs),
                        cells(symbols.astype("<u4"), 4, to),
                        cells(rare, 16, where),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "log_known", "symbols", "rare"],
                )
                uid += n
            release()

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, log_known double, symbols binary, rare binary"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out")).mapInArrow(run, kinds)
    out = new_place(docs.sparkSession, "symbols")
    found.write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.schema(found.schema).parquet(out)


def _symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    cells = column(batch, "symbols")
    _, where, data = cells.buffers()
    kind = np.int64 if pa.types.is_large_binary(cells.type) else np.int32
    offsets = np.frombuffer(where, kind)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view("<u4"), (offsets - offsets[0]) // 4


def count_contexts(training: DataFrame, place: str) -> str:
    """The folder of the context tables' summed blocks (block, counts) over ``training(symbols)``; each task sends its own blocks once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = codes_of(place), None
        for batch in batches:
            for some in slices(batch, "symbols", 8 << 20):
                symbols, bounds = _symbols(some)
                if total is None:
                    total = np.zeros((2, codes.slots + codes.spelt, 2), np.uint32)
                symbols, one, two, n = distinct(symbols, *codes.contexts(symbols, bounds))
                n = n.astype(np.uint32)
                for own in portions(codes, symbols):
                    _, bit, size, slot1, slot2, _ = codes.expand(symbols[own], one[own], two[own])
                    times = np.repeat(n[own], size)
                    for k, slot in enumerate((slot1, slot2)):
                        np.add.at(total[k].ravel(), slot.astype(np.int64) * 2 + bit, times)
        if total is not None:
            flat = total.reshape(-1, 2)
            for i in range(0, len(flat), BLOCK):
                if flat[i : i + BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK]), pa.array([_pack(flat[i : i + BLOCK])], pa.binary())], names=["block", "counts"])
        del total
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cell in zip(column(batch, "block").to_pylist(), column(batch, "counts")):
                own = _unpack(cell.as_py()).astype(np.uint64)
                total[k] = total[k] + own if k in total else own
        for k, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([_pack(np.minimum(own, 2**32 - 1))], pa.binary())], names=["block", "counts"])

    spark = training.sparkSession
    parts_ = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = new_place(spark, "contexts")
    training.select("symbols").mapInArrow(count, "block long, counts binary").repartition(parts_, "block").mapInArrow(add, "block long, counts binary").write.parquet(out)
    return out


def levels(x: np.ndarray, step: float) -> np.ndarray:
    """Logits rounded to the LEVELS steps, from 0."""
    return (np.clip(np.rint(x / np.float32(step)), -(LEVELS // 2), LEVELS // 2) + LEVELS // 2).astype(np.uint8)


def without_own(counts: np.ndarray, step: float) -> np.ndarray:
    """What a table says of a bit (at 2 x slot + bit) without that occurrence: two bits of how much was seen, times LEVELS, plus the level of its logit."""
    out = np.empty((len(counts), 2), np.uint8)
    for i in range(0, len(counts), 1 << 20):
        for bit in (0, 1):
            now = counts[i : i + (1 << 20)].astype(np.float32).T.copy()
            np.maximum(now[bit] - 1, 0, out=now[bit])
            out[i : i + (1 << 20), bit] = seen(now[0] + now[1]) * LEVELS + levels(np.log(now[1] + np.float32(PRIOR)) - np.log(now[0] + np.float32(PRIOR)), step)
    return out.ravel()


def fit_weights(training: DataFrame, place: str, tables: str) -> np.ndarray:
    """Weights (GATES x INPUTS + 1) of the logits.

    Every bit of every symbol of all training texts is predicted from all other occurrences; how often a bit was 1 is counted for each gate and each combination of rounded
    logits (a table of fixed size), on which a logistic regression is fitted.
    """
    shape = (2, LEVELS, 4, LEVELS, 4, LEVELS, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = codes_of(place), np.zeros(np.prod(shape), np.int64)
        said = first = None
        for batch in batches:
            if said is None:
                said = _hold(place, "said", lambda: [without_own(x, step) for x, step in zip(tables_of(place, tables), STEPS[1:])])
                first = levels(codes.logit, STEPS[0]).astype(np.int64) + LEVELS * (np.arange(len(codes.logit)) > codes.words)
            for some in slices(batch, "symbols", 8 << 20):
                symbols, bounds = _symbols(some)
                symbols, one, two, n = distinct(symbols, *codes.contexts(symbols, bounds))
                for own in portions(codes, symbols):
                    node, bit, size, slot1, slot2, _ = codes.expand(symbols[own], one[own], two[own])
                    cell = first.take(node)
                    for table, slot in zip(said, (slot1, slot2)):
                        cell *= 4 * LEVELS
                        cell += table.take(slot * np.uint32(2) + bit)
                    cell *= 2
                    cell += bit
                    np.add.at(total, cell, np.repeat(n[own], size))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])
        del said
        release()

    found = training.select("symbols").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most GATES * LEVELS**3 * 2 rows
    total = np.zeros(np.prod(shape))
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    total = total.reshape(shape).transpose(0, 4, 2, 1, 3, 5, 6).reshape(GATES, LEVELS, LEVELS, LEVELS, 2)
    axis = np.arange(LEVELS) - LEVELS // 2
    weights = np.tile(DEFAULT, (GATES, 1))
    for g in range(GATES):
        i, j, k = np.nonzero(total[g].sum(-1))
        if len(i):
            x = np.stack([*(axis[at] * wide for at, wide in zip((i, j, k), STEPS)), np.ones(len(i))], 1)
            weights[g] = _regression(x, total[g][i, j, k], DEFAULT)
    return weights


def _regression(x: np.ndarray, counts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Logistic regression of counts (rows x 2) on x by Newton's method, drawn to ``start`` with BELIEF; a step that makes it worse is halved."""
    w, n = start.copy(), counts.sum(1)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((counts[:, 1] * np.logaddexp(0, -z) + counts[:, 0] * np.logaddexp(0, z)).sum() + BELIEF / 2 * ((v - start) ** 2).sum())

    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts[:, 1] - n * p) - BELIEF * (w - start)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + BELIEF * np.eye(len(w)), slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-6:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-5:
            break
    return w


# ---------------------------------------------------------------- scores


def scored(rows: DataFrame, place: str, tables: str, weights: np.ndarray, rate: float = RATE) -> DataFrame:
    """coded() rows with score, the log10 probability of each text, in place of their symbols."""
    keep = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "log_known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = None
        for batch in batches:
            if mixer is None:
                mixer = _hold(place, "mixer", lambda: Mixer(codes_of(place), tables_of(place, tables), weights))
            for some in slices(batch, "symbols", 4 << 20):
                score = mixer.score(*_symbols(some), rate) / np.log(10)
                yield pa.RecordBatch.from_arrays([*[column(some, c) for c in keep], pa.array(score)], names=[*keep, "score"])
        del mixer
        release()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*keep, "symbols").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double")


def rare_known(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(row, known, log_known): number of the tokens without a symbol that training texts hold, and the sum of their log10(c + 1)."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "rare"):
                cells = column(some, "rare").to_pylist()
                own = np.frombuffer(b"".join(cells), np.int64).reshape(-1, 2)
                row = np.repeat(column(some, "row").to_numpy(zero_copy_only=False), [len(x) // 16 for x in cells])
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(row)], names=["key", "check", "row"])

    each = rows.select("row", "rare").mapInArrow(apart, "key long, check long, row long").groupBy("key", "check", "row").agg(F.count("*").alias("n"))
    table = words.where(F.length("word") > 0).select(F.struct("key", "check").alias("w"), "c")
    met = join_spread(each.select(F.struct("key", "check").alias("w"), "row", "n"), table, "w")
    return met.groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"))


def score_texts(docs: DataFrame, held_out: Column, most: int = WORDS, rate: float = RATE) -> DataFrame:
    """Scores of ``docs(doc_id, text)`` by a model of those rows where ``held_out`` is not true.

    Tokens of a text (null: empty) are its words, runs of bytes other than space and 0x09-0x0D with A-Z in lower case, and one end.  Returns doc_id, held_out,
    n_tokens, n_known (tokens that the training texts hold), train_tokens, base_score (sum of log10((c + 1) / (N + V + 1)) over tokens, c a token's count among the N training
    tokens, V of them distinct), score (log10 probability of the text by the model) and bits_per_byte (of the text in UTF-8; null for empty texts).
    Each row is scored by itself: equal texts have equal scores, and held-out rows change nothing but their own.  Null and
    repeated ids are rows like any other, repeated rows train each time; a null ``held_out`` counts as false.  Without training rows every bit of a code is even odds.
    Other columns are ignored; an empty table gives no rows.
    """
    place = new_place(docs.sparkSession, "mixing")
    out = F.coalesce(held_out, F.lit(False))
    words = vocabulary(docs.where(~out))
    codes = fit_codes(words, place, most)
    rows = coded(docs, out, place)
    training = rows.where("NOT held_out")
    tables = count_contexts(training, place)
    weights = fit_weights(training, place, tables)
    found = scored(rows, place, tables, weights, rate).join(rare_known(rows, words), "row", "left")
    base = F.col("log_known") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(codes.tokens + codes.distinct + 1))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(codes.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents; those with crc32(doc_id as text) mod 7 = 2 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
