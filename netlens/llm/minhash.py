"""Operator 5: near-duplicate texts by SetSketch registers.

1. One pass makes, per document, two keys and the size of its shingle set, and
   SetSketch registers: the m exponential minima over the shingles, truncated to powers of a base
   close to 1.  Minima are mergeable, and two sets agree in a register with a probability close to
   their Jaccard similarity.
2. Documents with equal sets are one class.  Classes that agree in a whole band of registers share a bucket.  A set so
   small that one shingle more or less is too much enters none.
3. Every member of a bucket is compared with the bucket's first class: a joint likelihood-ratio test on the counts of
   larger, smaller and equal registers and the exact set sizes discards pairs, the rest is
   verified on the full sets.
4. Members of buckets that are then still in several components are matched exactly: their shingles are ordered by how
   rare they are, and sets of the wanted similarity share one of their first shingles.  Who shares one is compared with a few of them in turn (as in 3);
   where several components are left (and at once where there are few sets), block with block of bounded size, in which a pair that is
   already connected needs no proof, so that two blocks yield at most a spanning forest.
5. Components over the verified links.

Nothing is capped: each pair of classes that shares a bucket is tested or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.loop import join_spread
from .common import column, components, filesystem, new_place, slices, staged, text_column
from .hashing import mix, owners, parts, release, shingles, text_bytes, word_hashes

#: Registers (prime, for the affine permutations), bands of rows; 24 bands of 5 miss a pair of
#: similarity 0.85 with probability 8e-7, one of 0.8 with 6e-5.
REGISTERS, BANDS, ROWS = 127, 24, 5
#: Bits of the filter that picks documents of groups from the second scan; fuller filters only let more rows through.
FILTER_BITS = 1 << 24
#: Base and rate of the registers; 16-bit values then hold sets of up to e**62 elements.
SKETCH_BASE, RATE, TOP = 1.001, 20.0, 65535
#: Counters of the table that orders shingles by rarity; it is broadcast, and shingles that share a counter only share its order.
COUNTERS = 1 << 20
#: Rounds in which those who share a rare shingle are compared with up to CENTRES of them; that settles all but larger gatherings.
ROUNDS, CENTRES = 2, 16
#: Sets up to which blocks are compared at once, without those rounds.
STRAIGHT = 8192
#: Members and bytes of sets in a block at most (and the bytes of one more set), and members compared at once.
BLOCK, BLOCK_BYTES, TILE = 2048, 8 << 20, 512


def registers(hashes: np.ndarray, bounds: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (texts x m, uint16) of hashed sets; repeats change nothing.

    Every element has a value for each register, drawn in ascending order: spacings of exponential
    order statistics, registers in an affine permutation of its own.  An element stops once its
    next value is above all minima of its set.
    """
    n = len(bounds) - 1
    low = np.full(n * m, np.inf)
    doc = owners(bounds)
    code = hashes
    first = (mix(code ^ np.uint64(0xA5A5)) % np.uint64(m)).astype(np.int64)
    step = (mix(code ^ np.uint64(0x5A5A5A)) % np.uint64(m - 1)).astype(np.int64) + 1
    value = np.zeros(len(code))
    for j in range(m):
        u = ((mix(code + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
        value = value - np.log(u) / (m - j)
        np.minimum.at(low, doc * m + first, value)
        most = low.reshape(n, m).max(1)
        go = value < most[doc]
        if not go.any():
            break
        code, doc, first, step, value = code[go], doc[go], first[go], step[go], value[go]
        first = (first + step) % m
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low / RATE) / np.log(SKETCH_BASE))
    return np.clip(k, 0, TOP).astype(np.uint16).reshape(n, m)


def band_keys(regs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per text and band."""
    coef = mix(np.arange(rows, dtype=np.uint64) + np.uint64(5)) | np.uint64(1)
    blocks = regs[:, : bands * rows].astype(np.uint64).reshape(len(regs), bands, rows)
    return mix((mix(blocks + np.uint64(1)) * coef).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def plausible(more: np.ndarray, less: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float, slack: float = 12.5) -> np.ndarray:
    """Whether a similarity of at least ``similarity`` is within 5 sigma by the joint likelihood.

    With set sizes known, the counts of registers that are larger, smaller and equal are
    multinomial with probabilities p(u - vJ), p(v - uJ) and the rest, where u and v are the sizes' shares.
    """
    u, v = na / (na + nb), nb / (na + nb)
    scale = (SKETCH_BASE - 1) / SKETCH_BASE

    def logs(j):
        p = -np.log1p(-np.clip(u - v * j, 0, 1) * scale) / np.log(SKETCH_BASE)
        q = -np.log1p(-np.clip(v - u * j, 0, 1) * scale) / np.log(SKETCH_BASE)
        p, q = np.maximum(p, 1e-12), np.maximum(q, 1e-12)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    top = np.minimum(na, nb) / np.maximum(na, nb)
    grid = [logs(top * x) for x in np.linspace(0.0, 1.0, 65)[:-1]] + [logs(top * (1 - 1e-9))]
    best = np.argmax(grid, 0)
    at = logs(np.minimum(similarity, top * (1 - 1e-9)))
    return (top * np.append(np.linspace(0.0, 1.0, 65)[:-1], 1.0)[best] >= similarity) | (np.max(grid, 0) - at <= slack)


def distinct_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, ascending and once per text; bounds; two keys per text: equal sets, equal keys)."""
    words, bounds = word_hashes(*text_bytes(texts))
    hashes, to = shingles(words, bounds, k)
    own = owners(to)
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    hashes = hashes[new]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(texts)))]).astype(np.int64)
    keys = []
    for seed in (0x1234567, 0x89ABCDEF01):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(seed)), out=total[1:])
        keys.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return hashes, bounds, keys[0], keys[1]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key1, key2 (of the set), n_shingles, regs (binary, null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in parts(text_column(batch, "text")):
                hashes, bounds, key1, key2 = distinct_sets(texts, k)
                regs, sizes = registers(hashes, bounds), np.diff(bounds)
                cells = pa.array([r.tobytes() if n else None for n, r in zip(sizes, regs)], pa.binary())
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(at, len(texts)), pa.array(key1), pa.array(key2), pa.array(sizes), cells], names=["doc_id", "key1", "key2", "n_shingles", "regs"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, key1 long, key2 long, n_shingles long, regs binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """A row (rep, band) per band of ``classes(rep, regs)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.stack([np.frombuffer(x, np.uint16) for x in column(batch, "regs").to_pylist()])
                rep = column(batch, "rep").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep, BANDS)), pa.array(band_keys(regs).ravel())], names=["rep", "band"])

    return classes.select("rep", "regs").mapInArrow(run, "rep long, band long")


def id_positions(ids: np.ndarray) -> np.ndarray:
    """Bit positions of ids in a filter of FILTER_BITS."""
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (FILTER_BITS, so 2 MB) that holds every id of ``ids(rep)``, and some others by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(id_positions(batch.column(0).to_numpy(zero_copy_only=False)))], names=["p"])

    part = ids.select("rep").mapInArrow(run, "p long").groupBy(F.floor(F.col("p") / 32768).alias("k")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, bits in part.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
        out[k * 4096 : (k + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def shingle_sets(docs: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """doc_id, key1, key2 and set: the sorted distinct shingle hashes as little-endian 64-bit bytes, of documents that the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_bit = id_positions(column(batch, "doc_id").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array((wanted[at_bit >> 3] >> (at_bit & 7).astype(np.uint8)) & 1 == 1))
            for at, texts in parts(text_column(batch, "text"), 1 << 20):
                hashes, bounds, key1, key2 = distinct_sets(texts, k)
                sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(at, len(texts)), pa.array(key1), pa.array(key2), pa.array(sets, pa.binary())], names=["doc_id", "key1", "key2", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key1 long, key2 long, set binary")


def _registers(cell: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(cell.to_pylist()), np.uint16).reshape(len(cell), -1)


def similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets have 100 * intersection >= percent * union."""
    spot = np.searchsorted(u, v)
    shared = int((u[np.minimum(spot, len(u) - 1)] == v).sum())
    return 100 * shared >= percent * (len(u) + len(v) - shared)


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs of register rows may have the similarity, by set sizes and the joint likelihood."""
    m = ra.shape[1]
    equal = (ra == rb).sum(1)
    ok = np.minimum(na, nb) >= similarity * np.maximum(na, nb) * (1 - 1e-12)
    # equal registers are at least Binomial(m, similarity): below 7 sigma is out without the likelihood
    ok &= equal >= m * similarity - 7 * np.sqrt(m * similarity * (1 - similarity))
    at = np.flatnonzero(ok)
    if len(at):
        more = (ra[at] > rb[at]).sum(1)
        ok[at] = plausible(more, m - equal[at] - more, equal[at], na[at].astype(float), nb[at].astype(float), similarity)
    return ok


def verified_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs(src, dst) whose sets(rep, n, regs, set) have the similarity; one src may be in any share of the pairs."""
    percent = round(100 * similarity)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            ok = likely(_registers(column(batch, "ra")), _registers(column(batch, "rb")), na, nb, similarity)
            a, b = column(batch, "sa"), column(batch, "sb")
            for i in np.flatnonzero(ok):
                ok[i] = similar(np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64), percent)
            yield pa.RecordBatch.from_arrays([column(batch, "src"), column(batch, "dst")], names=["src", "dst"]).filter(pa.array(ok))
            release()

    side = lambda end, mark: sets.select(F.col("rep").alias(end), F.col("n").alias("n" + mark), F.col("regs").alias("r" + mark), F.col("set").alias("s" + mark))
    both = join_spread(pairs.join(side("dst", "b"), "dst"), side("src", "a"), "src", counts=pairs.groupBy("src").agg(F.count("*").alias("n")))
    return staged(both.mapInArrow(verify, "src long, dst long"), "links")


def _common(u: pa.Array, v: pa.Array, most: int) -> np.ndarray | None:
    """How many elements any two of ``u`` and ``v`` share, as products of matrices; None if more than ``most`` elements occur in both."""
    sides, both = [], None
    for cells in (u, v):
        own = [np.frombuffer(x, np.uint64) for x in cells.to_pylist()]
        sides.append((np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own]), len(own)))
    both = np.intersect1d(sides[0][0], sides[1][0])
    if len(both) > most:
        return None
    out = np.zeros((len(u), len(v)), np.float32)
    for lo in range(0, len(both), 4096):
        some, held = both[lo : lo + 4096], []
        for element, row, n in sides:
            spot = np.minimum(np.searchsorted(some, element), len(some) - 1)
            hit = some[spot] == element
            held.append(np.zeros((n, len(some)), np.float32))
            held[-1][row[hit], spot[hit]] = 1
        out += held[0] @ held[1].T
    return out


def _forest(a: tuple, b: tuple, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different labels of two blocks (rep, label, n, regs, set), compared tile by tile.

    Pairs that agree in most registers come first, in growing portions; pairs that are connected by then need no test.
    Where more pairs of two tiles are open than they share shingles, these are counted for all pairs at once.
    """
    percent = round(100 * similarity)
    labels, at = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
    la, lb, parent = at[: len(a[1])], at[len(a[1]) :], np.arange(len(labels))

    def root(x: int) -> int:
        while (p := parent[x]) != x:
            parent[x] = x = parent[p]
        return x

    def roots() -> np.ndarray:
        while ((up := parent[parent]) != parent).any():
            parent[:] = up
        return parent

    out = []
    m = a[3].shape[1]
    least = m * similarity - 7 * np.sqrt(m * similarity * (1 - similarity))
    for i in range(0, len(a[0]), TILE):
        for j in range(i if a is b else 0, len(b[0]), TILE):
            one, two = slice(i, i + TILE), slice(j, j + TILE)
            na, nb, top = a[2][one, None], b[2][None, two], roots()
            ok = (top[la[one, None]] != top[lb[None, two]]) & (np.minimum(na, nb) >= similarity * np.maximum(na, nb) * (1 - 1e-12))
            if a is b and i == j:
                ok = np.triu(ok, 1)
            if not ok.any():
                continue
            equal = np.zeros(ok.shape, np.int16)
            for r in range(m):
                equal += a[3][one, r, None] == b[3][None, two, r]
            x, y = np.nonzero(ok & (equal >= least))
            x, y = x[order := np.argsort(-equal[x, y], kind="stable")] + i, y[order] + j
            size, common = TILE, None
            while len(x):
                p, q = x[:size], y[:size]
                some = likely(a[3][p], b[3][q], a[2][p], b[2][q], similarity)
                if common is None and some.sum() > TILE:
                    common = _common(a[4][one], b[4][two], int(some.sum()))
                if common is not None:
                    shared = common[p - i, q - j].astype(np.int64)
                    some &= 100 * shared >= percent * (a[2][p] + b[2][q] - shared)
                for s, t in zip(p[some].tolist(), q[some].tolist()):
                    rs, rt = root(la[s]), root(lb[t])  # labels are already connected
                    if rs != rt and similar(np.frombuffer(a[4][s].as_py(), np.uint64), np.frombuffer(b[4][t].as_py(), np.uint64), percent):
                        parent[rs] = rt
                        out.append((int(a[0][s]), int(b[0][t])))
                x, y, size, top = x[size:], y[size:], 2 * size, roots()
                apart = top[la[x]] != top[lb[y]]
                x, y = x[apart], y[apart]
    return out


def linked_blocks(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) that connect the labels of ``members(token, rep, first, label)`` inside each token, at least one end of them ``first``.

    Members who share tokens, directly or over others, lie together in one order of all, which is cut into blocks of bounded size: each set is written once, whatever the number of its tokens.
    Two blocks are compared once if they meet in any token; a pair of blocks is one row of work, and its task reads both from the shared folder.
    """
    spark, most, most_bytes = members.sparkSession, BLOCK, BLOCK_BYTES
    members = staged(members.select("token", "rep", "first", "label"), "members")
    low = staged(members.groupBy("token").agg(F.min("rep").alias("low"), F.count("*").alias("n")), "token-heads")
    tied = join_spread(members.select("token", "rep"), low.select("token", "low"), "token", counts=low.select("token", "n"))
    near = components(tied.where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")).distinct())
    reps = members.groupBy("rep").agg(F.min("token").alias("key"), F.min("label").alias("label")).join(near.withColumnRenamed("id", "rep"), "rep", "left")
    ordered = reps.join(sets.select("rep", "n"), "rep").select(F.coalesce("component", "rep").alias("component"), "key", "rep", "label", "n")

    # blocks go on across partitions, so their number goes with the members and their bytes alone
    order = ["component", "key", "rep"]
    ordered = staged(ordered.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    upto = Window.partitionBy("part").orderBy(*order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ordered.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n").alias("held"))  # a row a partition
    base = base.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("held"))
    at = ordered.withColumn("i", F.row_number().over(upto) - 1).withColumn("b", F.sum("n").over(upto) - F.col("n")).join(F.broadcast(base), "part")
    block = F.floor((F.col("rows") + F.col("i")) / most) + F.floor(8 * (F.col("held") + F.col("b")) / most_bytes)  # both only grow, so equal sums are equal parts
    placed = staged(at.select("rep", "label", block.cast("long").alias("block")), "placed")
    place = new_place(spark, "blocks")
    placed.join(sets, "rep").repartition("block").write.partitionBy("block").parquet(place)
    # tokens that meet in the same blocks count once
    met = members.join(placed.select("rep", "block"), "rep").groupBy("token", "block").agg(F.max("first").alias("first"))
    met = met.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("block", "first"))).alias("own")).select("own").distinct()
    met = met.select("own", F.explode(F.filter("own", lambda x: x["first"])).alias("x")).select("x", F.explode("own").alias("y"))
    pairs = met.select(F.least("x.block", "y.block").alias("b1"), F.greatest("x.block", "y.block").alias("b2")).distinct()
    parts_ = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(place)

        def block(k: int):
            x = ds.dataset(f"{path}/block={k}", filesystem=where, format="parquet").to_table(columns=["rep", "label", "n", "regs", "set"]).combine_chunks()
            one = {c: x[c].combine_chunks() for c in x.column_names}
            return *(one[c].to_numpy(zero_copy_only=False) for c in ("rep", "label", "n")), _registers(one["regs"]), one["set"]

        for batch in batches:
            for b1, b2 in zip(column(batch, "b1").to_pylist(), column(batch, "b2").to_pylist()):
                left = block(b1)
                found = _forest(left, left if b1 == b2 else block(b2), similarity)
                src, dst = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
            release()

    return staged(pairs.repartition(parts_, "b1", "b2").mapInArrow(run, "src long, dst long"), "links")


def rare_tokens(sets: DataFrame, similarity: float) -> DataFrame:
    """(token, rep, n, first): the rarest shingles of each of ``sets(rep, n, set)``.

    Let α of the larger set's size and of 2s / (1 + s) of the smaller one's be what two sets of similarity s share at least.  Their rarest common shingle is then among
    the first size - α + 1 of each, in any one order of all shingles.  ``first`` marks the shorter stretch, for the smaller set.
    """
    percent = round(100 * similarity)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for some in slices(batch, "set"):
                own = np.frombuffer(b"".join(column(some, "set").to_pylist()), np.uint64)
                np.add.at(total, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["c", "n"])

    often = np.zeros(COUNTERS, np.float32)
    rows = sets.select("set").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    often[rows["c"].to_numpy()] = rows["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "set"):
                own = np.frombuffer(b"".join(column(some, "set").to_pylist()), np.uint64)
                n = pc.binary_length(column(some, "set")).to_numpy().astype(np.int64) // 8
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((own, often[(own % np.uint64(COUNTERS)).astype(np.int64)], row))
                place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                rare = np.flatnonzero(place < (n - -(-percent * n // 100) + 1)[row])
                of = row[rare]
                first = place[rare] < (n - -(-2 * percent * n // (100 + percent)) + 1)[of]
                yield pa.RecordBatch.from_arrays([pa.array(own[order[rare]].view(np.int64)), column(some, "rep").take(pa.array(of)), pa.array(n[of]), pa.array(first)], names=["token", "rep", "n", "first"])

    return sets.select("rep", "set").mapInArrow(run, "token long, rep long, n long, first boolean")


def exact_links(sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) that, with those behind ``labels(id, component)``, connect all of ``sets(rep, n, regs, set)`` that have the similarity.

    In each round a few of those who share a token are compared with the others and leave; a pair that shares several tokens is compared once.
    Up to STRAIGHT sets make so few pairs of blocks that rounds save nothing.
    """
    tokens = staged(rare_tokens(sets, similarity), "tokens")
    rounds = 0 if sets.limit(STRAIGHT + 1).count() <= STRAIGHT else ROUNDS
    found = labels.select(F.col("id").alias("src"), F.col("component").alias("dst")).limit(0)
    for i in range(rounds + 1):
        named = labels.select(F.col("id").alias("rep"), F.col("component").alias("label"))
        marked = tokens.join(named, "rep", "left").select("token", "rep", "n", "first", F.coalesce("label", "rep").alias("label"))
        lane = lambda j: F.when(F.col("first") & (F.pmod(F.xxhash64("rep"), F.lit(CENTRES)) == j), F.xxhash64("rep", F.lit(1)))
        centres = F.array_compact(F.array(*[F.min_by(F.struct("rep", "label"), lane(j)) for j in range(CENTRES)]))
        shared = marked.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), centres.alias("centres"), F.count("*").alias("members"))
        shared = staged(shared.where("low < high AND size(centres) > 0"), "shared-tokens")
        if not shared.limit(1).count():
            break
        open_ = join_spread(marked, shared.select("token", "centres"), "token", counts=shared.select("token", F.col("members").alias("n")))
        if i == rounds:
            found = found.union(linked_blocks(open_.select("token", "rep", "first", "label"), sets, similarity))
            break
        open_ = staged(open_, "open-tokens")
        pairs = open_.select("rep", "label", F.explode("centres").alias("c")).where("label <> c.label").select(F.col("c.rep").alias("src"), F.col("rep").alias("dst"))
        links = verified_pairs(staged(pairs.distinct(), "pairs"), sets, similarity)
        tokens = open_.where(~F.exists("centres", lambda c: c["rep"] == F.col("rep"))).select("token", "rep", "n", "first")
        found = found.union(links)
        if links.limit(1).count():
            labels = staged(components(labels.select(F.col("id").alias("src"), F.col("component").alias("dst")).union(links)), "labels")
    return found


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """Classes of near-duplicate texts of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than white space (space, 0x09-0x0D), A-Z lower-cased, over whole
    texts; a set is the distinct k-word shingles, or the whole sequence where there are fewer words.
    Documents link if their sets' Jaccard similarity is at least ``similarity`` (whole per cents);
    component_id is the smallest doc_id reachable.  A text without words (null, empty) links with nothing.  Rows with equal
    doc_id are one node of the graph, whatever their texts.  A null doc_id gets a null
    component, links with nothing and is kept.  An empty table gives no rows.  Other columns are ignored.
    """
    percent = round(100 * similarity)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = staged(sketches(docs, k), "sketches")
    own = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(own.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "classes")
    # another set has n / (n + 1) of a set of n at most
    keys = band_rows(classes.where(f"100 * n >= {percent} * (n + 1)"))
    buckets = keys.groupBy("band").agg(F.min("rep").alias("src"), F.max("rep").alias("top"), F.count("*").alias("n")).where("src < top")
    bonds = staged(join_spread(keys, buckets.select("band", "src"), "band", counts=buckets.select("band", "n")).where("rep <> src"), "bonds")

    members = classes.join(bonds.select("rep").union(bonds.select("src")).distinct(), "rep")
    # texts are not shuffled: a bitmap of fixed size picks the documents whose sets are made, the join drops chance hits
    made = shingle_sets(docs.where("doc_id IS NOT NULL"), k, id_filter(members)).groupBy(F.col("doc_id").alias("rep"), "key1", "key2").agg(F.first("set").alias("set"))
    sets = staged(members.join(made, ["rep", "key1", "key2"]).select("rep", "n", "regs", "set"), "sets")
    links = verified_pairs(staged(bonds.select("src", F.col("rep").alias("dst")).distinct(), "pairs"), sets, similarity)
    labels = staged(components(links), "labels")

    named = labels.select(F.col("id").alias("rep"), F.col("component").alias("label"))
    per = bonds.join(named, "rep", "left").groupBy("band").agg(F.first("src").alias("src"), F.min(F.coalesce("label", "rep")).alias("low"), F.max(F.coalesce("label", "rep")).alias("high"), F.count("*").alias("n"))
    per = staged(per.join(named.select(F.col("rep").alias("src"), F.col("label").alias("own")), "src", "left").where("low < high OR low <> coalesce(own, src)"), "open-bands")
    inside = join_spread(bonds, per.select("band"), "band", counts=per.select("band", "n"))
    ids = staged(inside.select("rep").union(inside.select("src")).distinct(), "open")
    if ids.limit(1).count():
        links = links.union(exact_links(staged(sets.join(ids, "rep"), "open-sets"), labels, similarity))

    named = staged(own.select("doc_id", "key1", "key2").join(classes.select("key1", "key2", "rep"), ["key1", "key2"]).select("doc_id", "rep"), "named")
    spread = named.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    several = named.join(spread.where("low < high").select("doc_id"), "doc_id").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    labels = components(links.union(several))

    final = spread.join(labels, F.col("low") == F.col("id"), "left").select("doc_id", F.coalesce("component", "low").alias("c"))
    component = F.coalesce("c", "doc_id")
    out = sketch.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: 3-word shingles, similarity at least 0.85, over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, similarity=0.85)
