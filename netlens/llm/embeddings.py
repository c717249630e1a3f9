"""Operator 2: near-duplicate vectors by cross-polytope hashing with multiprobe.

1. Vectors are normalised in double precision; equal vectors are one class.
2. A table's hash joins ``HASHES`` cross-polytope hashes: after three rounds of random signs and a
   fast Hadamard transform, the coordinate of largest magnitude and its sign.  A class enters, in each table, its
   own bucket and the ``PROBES`` next likely ones (one hash moved to its runner-up).
3. In rounds, every bucket's smallest class is compared with the others and leaves; a pair that shares several buckets is compared once.
   Pairs are screened on vectors of one byte a component, with a strict bound of their error, and verified in double precision.
4. Buckets that are then still in several components are worked off block against block of bounded size; blocks of one component
   are not compared with each other.
5. Within each component of the verified links all pairs of blocks are compared once more to count each vector's links.
   Copies count by the size of their class and are never expanded.

A pair of blocks is a row of work of its own, so that one large group spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.loop import hot_keys, join_spread
from .common import column, components, staged
from .hashing import mix, release

#: Tables, hashes joined in a table, further buckets that a vector enters per table.
TABLES, HASHES, PROBES = 10, 3, 4
#: Rounds in which a bucket's smallest class is compared with the others; that settles all but larger buckets.
ROUNDS = 3
#: Members of a block on average at most.
BLOCK = 1024
#: Kind of the blocks that hold several components.
POOL = -(2**63)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def bucket_keys(v: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """Bucket keys (vectors x tables*(1+probes), int64) of unit vectors; the keys of different tables never meet."""
    n, dim = v.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = v
    rng = np.random.default_rng(seed)
    out = []
    for t in range(tables):
        firsts, moves, gaps = [], [], []
        for _ in range(hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], d))
            size = np.abs(x)
            top = np.argpartition(-size, min(3, d - 1), 1)[:, :4]
            rank = np.take_along_axis(size, top, 1)
            order = np.argsort(-rank, 1)
            top, rank = np.take_along_axis(top, order, 1), np.take_along_axis(rank, order, 1)
            signed = top * 2 + (np.take_along_axis(x, top, 1) < 0)
            firsts.append(signed[:, 0])
            moves.append(signed[:, 1:])
            gaps.append((rank[:, :1] - rank[:, 1:]) ** 2)
        first = np.stack(firsts, 1).astype(np.uint64)
        coef = mix(np.arange(hashes, dtype=np.uint64) + np.uint64(1000 * (t + 1))) | np.uint64(1)
        base = (mix(first + np.uint64(1)) * coef).sum(1, dtype=np.uint64) + np.uint64(t)
        out.append(base)
        move, gap = np.concatenate(moves, 1), np.concatenate(gaps, 1)
        which = np.repeat(np.arange(hashes), move.shape[1] // hashes)
        for k in np.argsort(gap, 1)[:, :probes].T:
            h = which[k]
            new = np.take_along_axis(move, k[:, None], 1)[:, 0].astype(np.uint64)
            old = np.take_along_axis(first, h[:, None], 1)[:, 0]
            out.append(base + (mix(new + np.uint64(1)) - mix(old + np.uint64(1))) * coef[h])
    return mix(np.stack(out, 1)).view(np.int64)


def _matrix(cell: pa.Array) -> np.ndarray:
    """Rows of doubles from a binary array; shorter ones end in zeros."""
    rows = cell.to_pylist()
    most = max(map(len, rows), default=0)
    return np.frombuffer(b"".join(x if len(x) == most else x.ljust(most, b"\0") for x in rows), np.float64).reshape(len(rows), -1)


def unit_vectors(table: DataFrame) -> DataFrame:
    """vec_id, key (MD5 of the vector's bytes), v: the unit vector as doubles, and q: the same, coarse(); v is null where none can be made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out, keys, rough = [], [], []
            for x in column(batch, "embedding").to_pylist():
                v = np.array([np.nan if y is None else y for y in x], np.float64) if x else np.zeros(0)
                with np.errstate(all="ignore"):
                    top = np.abs(v).max(initial=0.0)
                    u = v / top if np.isfinite(top) and top > 0 else v * np.nan
                    u = u / np.sqrt((u * u).sum())
                good = len(v) > 0 and bool(np.isfinite(u).all())
                out.append(u.tobytes() if good else None)
                rough.append(coarse(u) if good else None)
                keys.append(hashlib.md5((v + 0.0).tobytes()).digest() if good else None)
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(keys, pa.binary()), pa.array(rough, pa.binary()), pa.array(out, pa.binary())], names=["vec_id", "key", "q", "v"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, key binary, q binary, v binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(bucket, rep) of ``classes(rep, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, cell = column(batch, "rep").to_numpy(zero_copy_only=False), column(batch, "v")
            lengths = np.array([len(x) for x in cell.to_pylist()])
            for n in np.unique(lengths):
                some = np.flatnonzero(lengths == n)
                for at in range(0, len(some), 1024):
                    own = some[at : at + 1024]
                    keys = mix(bucket_keys(_matrix(cell.take(pa.array(own)))).view(np.uint64) + np.uint64(n)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(rep[own], keys.shape[1]))], names=["bucket", "rep"])
        release()

    return classes.select("rep", "v").mapInArrow(run, "bucket long, rep long")


def _cells(batch: pa.RecordBatch, name: str, second: str):
    """(sizes, rep, second, vectors of rows that are not null) of an array<struct<rep, second, v>> column."""
    lists = column(batch, name)
    sizes = np.array([len(x) if x.is_valid else 0 for x in lists])
    flat = lists.flatten()
    return sizes, flat.field("rep").to_numpy(zero_copy_only=False), flat.field(second).to_numpy(zero_copy_only=False), flat.field("v")


def _hits(batch: pa.RecordBatch, second: str, cosine: float):
    """Yields (rep a, second a, rep b, second b) of the pairs with a cosine of at least ``cosine``, as arrays."""
    s1, r1, x1, v1 = _cells(batch, "m1", second)
    s2, r2, x2, v2 = _cells(batch, "m2", second)
    if not len(r1):
        return
    m1 = _matrix(v1)
    m2 = _matrix(v2) if len(r2) else None
    b1, b2 = np.concatenate([[0], np.cumsum(s1)]), np.concatenate([[0], np.cumsum(s2)])
    for k in np.unique(s1[(s2 == 0) & (s1 <= 32) & (s1 > 1)]):  # small groups, all of one size at once
        rows = b1[:-1][(s2 == 0) & (s1 == k)]
        i, j = np.triu_indices(k, 1)
        for at in range(0, len(rows), max(1, 200_000 // len(i))):
            own = rows[at : at + max(1, 200_000 // len(i))]
            a, b = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
            ok = np.einsum("ij,ij->i", m1[a], m1[b]) >= cosine
            yield r1[a[ok]], x1[a[ok]], r1[b[ok]], x1[b[ok]]
    for r in np.flatnonzero((s2 > 0) | (s1 > 32)):
        one = slice(b1[r], b1[r + 1])
        two = slice(b2[r], b2[r + 1])
        if s2[r]:
            i, j = np.nonzero(m1[one] @ m2[two].T >= cosine)
            yield r1[one][i], x1[one][i], r2[two][j], x2[two][j]
        else:
            i, j = np.nonzero(np.triu(m1[one] @ m1[one].T >= cosine, 1))
            yield r1[one][i], x1[one][i], r1[one][j], x1[one][j]


def _block_pairs(blocks: DataFrame, skip_same_label: bool) -> DataFrame:
    """All pairs (m1, m2) of blocks(group, kind, block, members) of a group, m2 null for a block with itself; the pairs are dealt over tasks before members are fetched."""
    names = blocks.select("group", "kind", "block", F.size("members").alias("n"))
    left = names.select("group", F.col("kind").alias("k1"), F.col("block").alias("b1"), "n")
    right = names.select("group", F.col("kind").alias("k2"), F.col("block").alias("b2"))
    pairs = left.join(right, "group").where("k1 < k2 OR (k1 = k2 AND (b1 < b2 OR (b1 = b2 AND n > 1)))")
    if skip_same_label:
        pairs = pairs.where(f"k1 <> k2 OR k1 = {POOL}L")
    other = F.when((F.col("k1") == F.col("k2")) & (F.col("b1") == F.col("b2")), None).otherwise(F.col("b2"))
    pairs = pairs.select("group", "k1", "b1", "k2", other.alias("b2")).repartition("group", "k1", "b1", "k2", "b2")
    first = blocks.select("group", F.col("kind").alias("k1"), F.col("block").alias("b1"), F.col("members").alias("m1"))
    second = blocks.select("group", F.col("kind").alias("k2"), F.col("block").alias("b2"), F.col("members").alias("m2"))
    return pairs.join(first, ["group", "k1", "b1"]).join(second, ["group", "k2", "b2"], "left").select("m1", "m2")


def coarse(v: np.ndarray) -> bytes:
    """A unit vector as one byte a component, behind their scale and the length of the error, as 32-bit floats."""
    scale = np.float32(np.abs(v).max() / 127 or 1)
    q = np.round(v / scale).astype(np.int8)
    error = np.float32(np.sqrt(((v - q * np.float64(scale)) ** 2).sum()) * 1.001 + 1e-9)
    return scale.tobytes() + error.tobytes() + q.tobytes()


def may_reach(a: pa.Array, b: pa.Array, cosine: float) -> np.ndarray:
    """Whether pairs of coarse() vectors of one length can have the cosine: what their errors could add is allowed for."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (a, b))
    (s, e), (t, f) = (np.ascontiguousarray(z[:, :8]).view(np.float32).astype(float).T for z in (x, y))
    dot = np.einsum("ij,ij->i", x[:, 8:].view(np.int8).astype(np.float32), y[:, 8:].view(np.int8).astype(np.float32))
    return dot * s * t + e + f + e * f >= cosine - 1e-6


def verified_pairs(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """The pairs(src, dst) of vectors(rep, q, v) with the cosine; one src may be in any share of the pairs."""

    hot = hot_keys(pairs.groupBy("src").agg(F.count("*").alias("n")), "src")

    def both(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda end, to: vectors.select(F.col("rep").alias(end), F.col(name).alias(to))
        return join_spread(pairs.join(side("dst", "b"), "dst"), side("src", "a"), "src", hot=hot)

    def by_length(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = column(batch, "a"), column(batch, "b")
                la, lb = (np.array(pc.binary_length(x)) for x in (a, b))
                ok = np.zeros(batch.num_rows, bool)
                for n in np.unique(la):
                    equal = np.flatnonzero((la == n) & (lb == n))
                    for at in range(0, len(equal), 4096):
                        some = pa.array(equal[at : at + 4096])
                        ok[equal[at : at + 4096]] = test(a.take(some), b.take(some))
                yield pa.RecordBatch.from_arrays([column(batch, "src"), column(batch, "dst")], names=["src", "dst"]).filter(pa.array(ok))
            release()

        return run

    some = both(pairs, "q").mapInArrow(by_length(lambda a, b: may_reach(a, b, cosine)), "src long, dst long")
    exact = by_length(lambda a, b: np.einsum("ij,ij->i", _matrix(a), _matrix(b)) >= cosine)
    return staged(both(staged(some, "screened"), "v").mapInArrow(exact, "src long, dst long"), "links")


def near_duplicates(table: DataFrame, cosine: float = 0.95, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """Links of ``table(vec_id, embedding)``: vec_id, n_links, component_id, kept (vec_id = component_id).

    Two vectors link if the cosine in double precision is at least ``cosine``.
    n_links counts other vec_ids; component_id is the smallest vec_id reachable.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different length neither.  Rows with equal vec_id and equal
    vector count once; equal ids with other vectors are one node.  A null vec_id links with nothing, has
    a null component and is kept.  Other columns are ignored.  ``block`` and ``rounds`` change the work, not the result.
    """
    rows = staged(unit_vectors(table), "vectors")
    own = rows.where("v IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "key", "q", "v").dropDuplicates(["vec_id", "key"])
    classes = staged(own.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("q").alias("q"), F.first("v").alias("v")), "classes")
    vectors = classes.select("rep", "q", "v")
    open_ = staged(bucket_rows(classes).distinct(), "buckets").withColumn("label", F.col("rep"))
    links = labels = None
    for i in range(rounds + 1):
        if labels is not None:
            named = labels.select(F.col("id").alias("rep"), F.col("component").alias("label"))
            open_ = open_.drop("label").join(named, "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
        per = open_.groupBy("bucket").agg(F.min(F.struct("rep", "label")).alias("first"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
        per = staged(per.select("bucket", F.col("first.rep").alias("src"), F.col("first.label").alias("src_label"), "n"), "open-buckets")
        inside = staged(join_spread(open_, per.drop("n"), "bucket", counts=per.select("bucket", "n")), "open")
        if i == rounds or not per.limit(1).count():
            break
        open_ = inside.where("rep <> src").select("bucket", "rep", "label")
        pairs = inside.where("rep <> src AND label <> src_label").select("src", F.col("rep").alias("dst")).distinct()
        more = verified_pairs(staged(pairs, "pairs"), vectors, cosine)
        links = more if links is None else links.union(more)
        labels = staged(components(links), "labels")

    per = inside.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    pool = per.where(F.col("n") < block).groupBy("bucket").agg(F.sum("n").alias("pool"))
    per = per.join(pool, "bucket", "left")
    placed = (
        inside.join(per, ["bucket", "label"])
        .withColumn("kind", F.when(F.col("n") >= block, F.col("label")).otherwise(POOL))
        .withColumn("block", F.expr(f"pmod(xxhash64(rep), CAST(ceil(CASE WHEN n >= {block} THEN n ELSE pool END / {block}) AS LONG))"))
        .join(vectors.drop("q"), "rep")
    )
    blocks = placed.groupBy(F.col("bucket").alias("group"), "kind", "block").agg(F.collect_list(F.struct("rep", "label", "v")).alias("members"))

    def join_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, la, b, lb in _hits(batch, "label", cosine):
                ok = la != lb
                pair = np.unique(np.stack([la[ok], lb[ok]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].astype(np.int64)), pa.array(pair[:, 1].astype(np.int64))], names=["src", "dst"])

    more = _block_pairs(staged(blocks, "blocks"), True).mapInArrow(join_labels, "src long, dst long")
    named = own.select("vec_id", "key").join(classes.select("key", "rep"), "key").select("vec_id", "rep")
    spread = staged(named.groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")), "spread")
    several = named.join(spread.where("low < high").select("vec_id"), "vec_id").select(F.col("vec_id").alias("src"), F.col("rep").alias("dst"))
    edges = more.union(several)
    labels = staged(components(edges if links is None else links.union(edges)), "labels")

    weighted = classes.select("rep", "weight", "v").join(labels.select(F.col("id").alias("rep"), F.col("component").alias("group")), "rep")
    size = labels.groupBy(F.col("component").alias("group")).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"), F.count("*").alias("n"))
    placed = join_spread(weighted, size.drop("n"), "group", counts=size.select("group", "n")).withColumn("block", F.expr("pmod(xxhash64(rep), blocks)")).withColumn("kind", F.lit(POOL))
    blocks = placed.groupBy("group", "kind", "block").agg(F.collect_list(F.struct("rep", "weight", "v")).alias("members"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, wa, b, wb in _hits(batch, "weight", cosine):
                reps += [a, b]
                counts += [wb, wa]
            rep, spot = np.unique(np.concatenate(reps), return_inverse=True)
            total = np.bincount(spot, np.concatenate(counts), len(rep)).astype(np.int64) if len(rep) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int64)), pa.array(total)], names=["rep", "n"])

    counted = _block_pairs(staged(blocks, "members"), False).mapInArrow(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    per_class = classes.select("key", "rep", "weight").join(counted, "rep", "left").select("key", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    linked = own.select("vec_id", "key").join(per_class, "key").groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("rep").alias("low"))
    final = linked.join(labels, F.col("low") == F.col("id"), "left").select("vec_id", "n", F.coalesce("component", "low").alias("c"))
    out = rows.select("vec_id").join(final, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all embeddings, cosine at least 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
