"""Searches from many vertices: Spark deals the sources over tasks, and each task reads the edges, of checked number, from the shared folder.

Vertices are numbered in their order, edges are written once as pairs of 32-bit numbers.  Beyond EDGES the callers search by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .loop import dense_index, saved

#: Edges up to which every task of a search reads all of them (some 30 bytes each in its memory); beyond, searches are joins.
EDGES = 40_000_000
#: Vertices up to which every task of a loop reads a number or two for each of them.
VERTICES = 20_000_000
#: Sources up to which a search goes level by level, as joins, instead.
FEW = 16
#: Edges that a step of a search holds at once.
STEP = 1 << 20
#: Sources that a search for distances takes at once, a bit each.
WAVE = 512
#: Rows of a table of the vertices that a step of Pull takes at once, so that they stay in a core's cache.
ROWS = 32768
#: Tasks a core over which searches that only count are dealt: each reads the edges.
TASKS = 3
#: Registers of all vertices that a task of register_sums() holds at once, a byte each.
REGISTERS = 1 << 27


def fits(edges: DataFrame, most: int | None = None) -> bool:
    """Whether edges are few enough (EDGES, or ``most``) for tasks to read all of them."""
    most = EDGES if most is None else most
    return edges.limit(most + 1).count() <= most


@dataclass(frozen=True)
class Shared:
    """Numbers of the vertices, and folders of ids in that order and of edges (a, b[, w])."""

    numbers: DataFrame
    names: str
    edges: str


def shared(edges: DataFrame, ids: DataFrame, before: Shared | None = None) -> Shared:
    """Edges(src, dst[, weight]) and ids(id), numbered and written; ``before`` has numbered them already."""
    if before is None:
        every = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(ids.select("id")).distinct()
        numbers = saved(dense_index(every, ["id"], "k").select("id", "k"))
        names = files.written(numbers, "names")
    else:
        numbers, names = before.numbers, before.names
    a, b = numbers.select(F.col("id").alias("src"), F.col("k").cast("int").alias("a")), numbers.select(F.col("id").alias("dst"), F.col("k").cast("int").alias("b"))
    coded = edges.join(a, "src").join(b, "dst").select("a", "b", *[F.col(c).alias("w") for c in edges.columns if c == "weight"])
    return Shared(numbers, names, files.written(coded.repartitionByRange("a").sortWithinPartitions("a", "b"), "edges"))


def spread(s: Shared, sources: DataFrame, run: Callable[[Net, pa.Table], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    """``run(net, rows)`` on batches of sources(id, ...), which get their number ``k`` and are dealt over the tasks; with ``parts``, over so many at most, each of which gets its rows at once."""
    names, edges, whole = s.names, s.edges, parts is not None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None
        some = (pa.Table.from_batches([batch]) for batch in batches if batch.num_rows)
        if whole:
            rows = list(some)
            some = [pa.concat_tables(rows)] if rows else []
        for rows in some:
            net = net or Net(files.read(names), edges)
            yield from run(net, rows)

    most = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sources.join(s.numbers, "id").repartition(min(most, parts or most), "k").mapInArrow(task, schema)


def many(sources: DataFrame) -> bool:
    """Whether there are enough sources for tasks to share; a search from a few goes level by level over all tasks."""
    return sources.limit(FEW + 1).count() > FEW


def _backward(edges: DataFrame) -> DataFrame:
    """Edges by their heads, as waves() reads them."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def level_rows(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, dist): breadth-first distances over edges(src, dst) from sources(id)."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(net: Net, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        k = rows["k"].to_numpy()
        for at in range(0, len(k), WAVE):
            starts = k[at : at + WAVE]
            for depth, wave in enumerate(net.waves(starts)):
                for i, start in enumerate(starts):
                    found = np.flatnonzero(wave[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1))
                    if len(found):
                        yield pa.RecordBatch.from_arrays([net.ids(np.full(len(found), start)), net.ids(found), pa.array(np.full(len(found), depth, np.int32))], names=["source", "id", "dist"])

    return spread(shared(_backward(edges), sources), sources, run, f"source {kind}, id {kind}, dist int")


def level_counts(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, dist, n): how many vertices each of sources(id) has at each distance, over edges(src, dst)."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(net: Net, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        k = rows["k"].to_numpy()
        for at in range(0, len(k), WAVE):
            starts = k[at : at + WAVE]
            for depth, wave in enumerate(net.waves(starts)):
                bits = np.zeros(wave.shape[1] * 64, np.int64)
                for lo in range(0, net.n, ROWS):
                    some = wave[lo : lo + ROWS]
                    some = some[some.any(1)]
                    bits += np.unpackbits(some.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                bits = bits[: len(starts)]
                some = np.flatnonzero(bits)
                yield pa.RecordBatch.from_arrays([net.ids(starts[some]), pa.array(np.full(len(some), depth, np.int32)), pa.array(bits[some])], names=["source", "dist", "n"])

    return spread(shared(_backward(edges), sources), sources, run, f"source {kind}, dist int, n long", TASKS * sources.sparkSession.sparkContext.defaultParallelism)


def visit_rows(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, dist, pred, pos): the order in which a queue visits from each of sources(id), successors ascending."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(net: Net, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for start in rows["k"].to_numpy():
            order, dist, pred = net.visit(start)
            before = net.names.take(pa.array(pred, mask=pred < 0))
            yield pa.RecordBatch.from_arrays([net.ids(np.full(len(order), start)), net.ids(order), pa.array(dist), before, pa.array(np.arange(len(order)))], names=["source", "id", "dist", "pred", "pos"])

    return spread(shared(edges, sources), sources, run, f"source {kind}, id {kind}, dist int, pred {kind}, pos long")


def length_rows(edges: DataFrame, sources: DataFrame, width: float) -> DataFrame:
    """(source, id, dist, pred): shortest distances over edges(src, dst, weight) of positive weights, by buckets of ``width``."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(net: Net, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for start in rows["k"].to_numpy():
            dist, pred = net.lengths(start, width)
            found = np.flatnonzero(np.isfinite(dist))
            before = net.names.take(pa.array(pred[found], mask=pred[found] < 0))
            yield pa.RecordBatch.from_arrays([net.ids(np.full(len(found), start)), net.ids(found), pa.array(dist[found]), before], names=["source", "id", "dist", "pred"])

    return spread(shared(edges, sources), sources, run, f"source {kind}, id {kind}, dist double, pred {kind}")


def corners(once: DataFrame) -> DataFrame:
    """(id, triangles, links) of undirected pairs once(src, dst, weight): the triangles at each vertex of any, and the weights of the pairs opposite it in them.

    Vertices are numbered by (degree, id) and pairs point to the larger number, so that even a hub has few pairs that leave it.  Tasks take vertices, and look up for
    every two pairs that leave one whether their ends are a pair.
    """
    kind = once.schema["src"].dataType.simpleString()
    degree = once.select(F.col("src").alias("id")).union(once.select("dst")).groupBy("id").agg(F.count("*").alias("n"))
    numbers = saved(dense_index(degree, ["n", "id"], "k").select("id", "k"))
    a, b = numbers.select(F.col("id").alias("src"), F.col("k").alias("ka")), numbers.select(F.col("id").alias("dst"), F.col("k").alias("kb"))
    up = once.join(a, "src").join(b, "dst")
    up = up.select(F.when(F.col("ka") < F.col("kb"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(F.col("ka") < F.col("kb"), F.col("dst")).otherwise(F.col("src")).alias("dst"), "weight")

    def run(net: Net, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        many, links = np.zeros(net.n), np.zeros(net.n)
        keys = net.tail.astype(np.int64) * net.n + net.head
        for edges in net.slices(rows["k"].to_numpy(), net.first):
            later = net.first[net.tail[edges] + 1] - 1 - edges
            cuts = np.searchsorted(np.cumsum(later), np.arange(STEP, later.sum(), STEP))
            for one, size in zip(np.split(edges, cuts), np.split(later, cuts)):
                x = np.repeat(one, size)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
                wanted = net.head[x].astype(np.int64) * net.n + net.head[y]
                z = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[z] == wanted
                x, y, z = x[hit], y[hit], z[hit]
                for at, across in ((net.tail[x], z), (net.head[x], y), (net.head[y], x)):
                    many += np.bincount(at, minlength=net.n)
                    links += np.bincount(at, net.weight[across], net.n)
        found = np.flatnonzero(many)
        for lo in range(0, len(found), STEP):
            some = found[lo : lo + STEP]
            yield pa.RecordBatch.from_arrays([net.ids(some), pa.array(many[some].astype(np.int64)), pa.array(links[some])], names=["id", "triangles", "links"])

    net = shared(up, degree, Shared(numbers, files.written(numbers, "names"), ""))
    found = spread(net, degree.select("id"), run, f"id {kind}, triangles long, links double")
    return found.groupBy("id").agg(F.sum("triangles").alias("triangles"), F.sum("links").cast("long").alias("links"))


def register_sums(edges: DataFrame, ids: DataFrame, rounds: int, lg_k: int) -> DataFrame:
    """(id, round, total, zeros): of each vertex's 2**lg_k registers after each round, the sum of 2**-register and how many are 0.

    A register has the most leading zeros, plus one, of the hashes that fall into it; round 0 has those of the vertex alone, each further one takes the maxima along edges(src, dst).
    Tasks take blocks of registers, fewer for more vertices, and read the edges from the shared folder batch by batch in every round, so their number has no bound.
    """
    spark = edges.sparkSession
    net = shared(edges.select("src", "dst"), ids)
    n = net.numbers.count()
    width = 1 << max(0, min(lg_k - 4, (REGISTERS // max(n, 1)).bit_length() - 1))
    blocks = (1 << lg_k) // width
    code = F.xxhash64("id")
    slot, rest = code.bitwiseAND((1 << lg_k) - 1).cast("int"), F.shiftrightunsigned(code, lg_k)
    zeros = F.when(rest == 0, 65 - lg_k).otherwise(65 - lg_k - F.length(F.bin(rest)))
    seeds = net.numbers.select("k", (slot % width).alias("at"), zeros.cast("short").alias("value"), (slot / width).cast("int").alias("block"))
    seeds = files.written(seeds.repartition("block"), "seeds", "block")
    folder = net.edges

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (x for batch in batches for x in batch["id"].to_pylist()):
            state = np.zeros((n, width), np.uint8)
            if files.there(f"{seeds}/block={block}"):
                own = files.read(f"{seeds}/block={block}")
                state[own["k"].to_numpy(), own["at"].to_numpy()] = own["value"].to_numpy()
            for i in range(rounds + 1):
                if i:
                    old, state = state, state.copy()
                    for rows in files.stream(folder, max(1024, (REGISTERS >> 2) // width), ["a", "b"]):
                        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
                        first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
                        if len(first):  # tails ascend in a file, so each is there once
                            state[a[first]] = np.maximum(state[a[first]], np.maximum.reduceat(old[b], first))
                    del old
                for lo in range(0, n, STEP >> 4):
                    some = state[lo : lo + (STEP >> 4)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(lo, lo + len(some))), pa.array(np.full(len(some), i, np.int32)), pa.array(np.ldexp(1.0, -some.astype(np.int32)).sum(1)), pa.array((some == 0).sum(1))],
                        names=["k", "round", "total", "zeros"],
                    )

    parts = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = spark.range(0, blocks, 1, parts).mapInArrow(task, "k long, round int, total double, zeros long").groupBy("k", "round").agg(F.sum("total").alias("total"), F.sum("zeros").alias("zeros"))
    return sums.join(net.numbers, "k").select("id", "round", "total", "zeros")


class Pull:
    """Folds rows of a table of the vertices over each vertex's neighbours ``head[first[v] : first[v + 1]]``.

    Vertices are taken by falling number of neighbours (``order``), and the j-th neighbours of all that have one lie together (``flat``, from ``ends[j]``), so that a step of numpy works
    on many vertices; what a few vertices have more than that (``lone``) follows vertex by vertex.
    """

    def __init__(self, first: np.ndarray, head: np.ndarray):
        size = np.diff(first)
        self.order = np.argsort(-size, kind="stable")
        falling, self.first = size[self.order], first
        wide = int(falling[31]) if len(size) > 31 else 0
        self.many = np.searchsorted(-falling, -np.arange(1, wide + 1), side="right")
        self.ends = np.concatenate([[0], np.cumsum(self.many)]).astype(np.int64)
        self.flat, self.lone = np.empty(len(head), np.int32), []
        for j, c in enumerate(self.many):
            self.flat[self.ends[j] : self.ends[j + 1]] = head[first[self.order[:c]] + j]
        at = int(self.ends[-1])
        for p in range(int(np.searchsorted(-falling, -wide))):
            more = head[first[self.order[p]] + wide : first[self.order[p] + 1]]
            self.flat[at : at + len(more)] = more
            self.lone.append((p, at, at + len(more)))
            at += len(more)

    def fold(self, table: np.ndarray, rows: np.ndarray, op: np.ufunc = np.add, weights: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
        """``op`` of the table's rows at the neighbours of the vertices at places ``rows`` (ascending) of the order.  ``sums`` get, at an edge's place in ``flat``, the product of the row at its neighbour and the vertex's row of ``weights``."""
        out = np.zeros((len(rows), table.shape[1]), table.dtype)
        step = max(512, ROWS * 8 // table.shape[1])
        some = np.empty((min(step, len(rows)), table.shape[1]), table.dtype)
        for lo in range(0, len(rows), step):
            mine = rows[lo : lo + step]
            for j, c in enumerate(np.searchsorted(mine, self.many)):
                if not c:
                    break
                at = self.ends[j] + mine[:c]
                np.take(table, self.flat[at], axis=0, out=some[:c], mode="clip")
                op(out[lo : lo + c], some[:c], out=out[lo : lo + c])
                if sums is not None:
                    sums[at] += np.einsum("ij,ij->i", weights[lo : lo + c], some[:c])
        for p, begin, end in self.lone:
            i = int(np.searchsorted(rows, p))
            if i < len(rows) and rows[i] == p:
                for lo in range(begin, end, ROWS):
                    near = table[self.flat[lo : min(lo + ROWS, end)]]
                    out[i] = op(out[i], op.reduce(near, axis=0))
                    if sums is not None:
                        sums[lo : lo + len(near)] += near @ weights[i]
        return out

    def by_vertex(self, sums: np.ndarray) -> np.ndarray:
        """Numbers at the edges' places in ``flat``, at their places in ``head``."""
        out = np.empty(len(sums))
        for j, c in enumerate(self.many):
            out[self.first[self.order[:c]] + j] = sums[self.ends[j] : self.ends[j + 1]]
        for p, begin, end in self.lone:
            last = self.first[self.order[p] + 1]
            out[last - (end - begin) : last] = sums[begin:end]
        return out


class Net:
    """The edges of a graph by tail, then head, in a task: those of vertex v are ``first[v] : first[v + 1]`` of head.  Read batch by batch, so that a task holds little more than them."""

    def __init__(self, names: pa.Table, edges: str):
        self.names = names.sort_by("k")["id"].combine_chunks()
        self.n = n = len(self.names)
        has, m = files.shape(edges)
        self.head, self.weight = np.empty(m, np.int32), np.empty(m) if "w" in has else None
        size, at, last, tails = np.zeros(n, np.int64), 0, -1, []
        for batch in files.stream(edges, STEP, ["a", "b", "w"] if "w" in has else ["a", "b"]):
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            if not len(a):
                continue
            self.head[at : at + len(b)] = b
            if self.weight is not None:
                self.weight[at : at + len(b)] = batch["w"].to_numpy()
            key = a.astype(np.int64) * n + b
            if tails or key[0] < last or (key[1:] < key[:-1]).any():  # the files came in another order
                tails = tails or [np.repeat(np.arange(n, dtype=np.int32), size)]
                tails.append(a)
            size += np.bincount(a, minlength=n)
            at, last = at + len(b), int(key[-1])
        self.first = np.concatenate([[0], np.cumsum(size)])
        if tails:
            order = np.lexsort((self.head, np.concatenate(tails)))
            self.head, self.weight = self.head[order], None if self.weight is None else self.weight[order]
        self._tail = self._into = self._pulls = None

    @property
    def tail(self) -> np.ndarray:
        if self._tail is None:
            self._tail = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.first))
        return self._tail

    def into(self) -> tuple[np.ndarray, np.ndarray]:
        """(order of the edges by head, then tail; bounds of each head in it)."""
        if self._into is None:
            order = np.argsort(self.head, kind="stable")
            self._into = order.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(self.head, minlength=self.n))])
        return self._into

    def pulls(self, same: bool = False) -> tuple[Pull, Pull]:
        """Pull over the edges into the vertices and over those out of them, which are the ``same`` on an undirected view."""
        if self._pulls is None:
            out = Pull(self.first, self.head)
            if not same:
                order = np.argsort(self.head, kind="stable")
                tails = self.tail[order]
                del order
                self._tail = None
                bounds = np.concatenate([[0], np.cumsum(np.bincount(self.head, minlength=self.n))])
            self._pulls = (out if same else Pull(bounds, tails)), out
        return self._pulls

    def ids(self, k: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(k))

    def slices(self, front: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The places of the edges of ``front``, in its order, some STEP of them at a time."""
        size = bounds[front + 1] - bounds[front]
        total = np.cumsum(size)
        cuts = np.searchsorted(total, np.arange(STEP, total[-1] if len(total) else 0, STEP))
        for some, length in zip(np.split(front, cuts), np.split(size, cuts)):
            if len(some):
                yield np.repeat(bounds[some] - (np.cumsum(length) - length), length) + np.arange(length.sum())

    def waves(self, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Breadth-first search from many vertices at once, over the edges backward: per distance, words per vertex whose bit i tells that starts[i] has it just there.

        A level looks at the edges of the vertices that some start has not seen.
        """
        pull = self._pulls[1] if self._pulls else self.pulls(True)[1]
        i = np.arange(len(starts))
        seen = np.zeros((self.n, -(-len(starts) // 64)), np.uint64)
        np.bitwise_or.at(seen, (starts, i >> 6), np.uint64(1) << (i & 63).astype(np.uint64))
        full, front = np.bitwise_or.reduce(seen, axis=0), seen.copy()
        while front.any():
            yield front
            rows = np.flatnonzero((seen != full).any(1)[pull.order])
            at = pull.order[rows]
            new = pull.fold(front, rows, np.bitwise_or) & ~seen[at]
            front = np.zeros_like(front)
            front[at] = new
            seen[at] |= new

    def flows(self, starts: np.ndarray, inside: np.ndarray, on_edge: tuple[np.ndarray, np.ndarray] | None = None, same: bool = False) -> np.ndarray:
        """How many vertices each of ``starts`` reaches (itself too).  Adds the shortest paths from them, each split evenly among its ties, to ``inside`` of the vertices between their ends, and to edges.

        ``on_edge`` are two arrays of sums, by place in head and by place in the Pull out of the vertices.  Paths are counted forward by levels and handed back (Brandes 2001), for all starts at once: a
        table has a column for each.  A level of few edges goes edge by edge, others as a fold over the vertices that a start has not seen.
        """
        into, out = self.pulls(same)
        n, w = self.n, len(starts)
        paths, dist, behind = np.zeros((n, w)), np.full((n, w), -1, np.int32), np.zeros((n, w))
        flat_paths, flat_dist, flat_behind = paths.reshape(-1), dist.reshape(-1), behind.reshape(-1)
        size, column = np.diff(self.first), np.arange(w)
        front = starts.astype(np.int64) * w + column
        flat_paths[front], flat_dist[front] = 1.0, 0
        steps = []
        while len(front):
            tail = front // w
            many = size[tail]
            total, depth = int(many.sum()), len(steps) + 1
            if not total:
                break
            if total <= STEP and total * 32 <= (len(self.head) + 4 * n) * w:
                at = np.repeat(self.first[tail] - (np.cumsum(many) - many), many) + np.arange(total)
                head = self.head[at].astype(np.int64) * w + np.repeat(front % w, many)
                new = flat_dist[head] < 0
                at, head, from_ = at[new], head[new], np.repeat(front, many)[new]
                np.add.at(flat_paths, head, flat_paths[from_])
                flat_dist[head] = depth
                front = np.flatnonzero(flat_dist == depth) if 8 * len(head) > n * w else np.unique(head)
                steps.append((from_, head, at))
            else:
                rows = np.flatnonzero((dist < 0).any(1)[into.order])
                got = into.fold(np.where(dist == depth - 1, paths, 0.0), rows)
                at = into.order[rows]
                old = dist[at]
                new = (old < 0) & (got > 0)
                old[new] = depth
                dist[at], paths[at] = old, np.where(new, got, paths[at])
                front = (at[:, None] * w + column)[new]
                steps.append(None)
        for depth in range(len(steps), 0, -1):
            if steps[depth - 1] is not None:
                tail, head, at = steps[depth - 1]
                share = flat_paths[tail] / flat_paths[head] * (1 + flat_behind[head])
                np.add.at(flat_behind, tail, share)
                if on_edge is not None:
                    np.add.at(on_edge[0], at, share)
            else:
                each = np.divide(1 + behind, paths, out=np.zeros((n, w)), where=dist == depth)
                here = dist == depth - 1
                rows = np.flatnonzero(here.any(1)[out.order])
                at = out.order[rows]
                own = np.where(here[at], paths[at], 0.0)
                behind[at] += own * out.fold(each, rows, np.add, own, on_edge and on_edge[1])
        behind[starts, column] = 0.0
        inside += behind.sum(1)
        return (dist >= 0).sum(0)

    def visit(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vertices in the order in which a queue visits them, their distances, their parents' numbers, -1 for the start)."""
        seen, mark = np.zeros(self.n, bool), np.zeros(self.n, np.int64)
        front, order, dist, parent = np.array([start]), [], [], []
        pred = np.array([-1])
        seen[start] = True
        bounds = self.into()[1]
        left = np.count_nonzero(np.diff(bounds)) - int(bounds[start + 1] > bounds[start])
        while len(front):
            order.append(front), parent.append(pred), dist.append(np.full(len(front), len(dist), np.int32))
            new, by = [front[:0]], [front[:0]]
            for at in self.slices(front, self.first):
                at = at[~seen[self.head[at]]]
                to = self.head[at]
                mark[to[::-1]] = np.arange(len(to))[::-1]  # the first place of each
                at = at[mark[to] == np.arange(len(to))]
                new.append(self.head[at]), by.append(self.tail[at])
                seen[new[-1]] = True
                left -= len(new[-1])
                if not left:
                    break
            front, pred = np.concatenate(new), np.concatenate(by)
        return np.concatenate(order), np.concatenate(dist), np.concatenate(parent)

    def lengths(self, start: int, width: float) -> tuple[np.ndarray, np.ndarray]:
        """(distance, smallest vertex before on a shortest path or -1) for positive weights, by buckets of ``width``."""
        dist, sent = np.full(self.n, np.inf), np.full(self.n, np.inf)
        dist[start] = 0.0
        while True:
            open_ = np.flatnonzero(dist < sent)
            if not len(open_):
                break
            low = dist[open_].min()
            front = open_[dist[open_] < max((low // width + 1) * width, np.nextafter(low, np.inf))]
            sent[front] = dist[front]
            for at in self.slices(front, self.first):
                far = sent[self.tail[at]] + self.weight[at]
                less = far < dist[self.head[at]]
                np.minimum.at(dist, self.head[at[less]], far[less])
        pred = np.full(self.n, -1)
        for lo in range(len(self.head), 0, -STEP):  # from the largest tail down, so the smallest stays
            at = slice(max(lo - STEP, 0), lo)
            tight = np.isfinite(dist[self.head[at]]) & (dist[self.tail[at]] + self.weight[at] == dist[self.head[at]])
            pred[self.head[at][tight][::-1]] = self.tail[at][tight][::-1]
        pred[start] = -1
        return dist, pred

    def counted(self, start: int, end: int = -1) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(distances or -1, numbers of shortest paths, the places of the edges between neighbouring levels): breadth first, no further than the level of ``end``.

        A level looks along the edges out of it, or along those into what is not yet seen, whichever are fewer.
        """
        order, bounds = self.into()
        dist, paths, levels = np.full(self.n, -1, np.int32), np.zeros(self.n), []
        out_size, in_size = np.diff(self.first), np.diff(bounds)
        dist[start], paths[start], front = 0, 1.0, np.array([start])
        left = int(in_size.sum() - in_size[start])
        while len(front) and left and (end < 0 or dist[end] < 0):
            depth = len(levels)
            if int(out_size[front].sum()) <= left:
                places = [at[dist[self.head[at]] < 0] for at in self.slices(front, self.first)]
            else:
                places = [at[dist[self.tail[at]] == depth] for at in (order[x] for x in self.slices(np.flatnonzero(dist < 0), bounds))]
            at = np.concatenate(places) if places else np.zeros(0, np.int64)
            if not len(at):
                break
            got = np.bincount(self.head[at], paths[self.tail[at]], self.n)
            front = np.flatnonzero(np.bincount(self.head[at], minlength=self.n))
            paths[front], dist[front] = got[front], depth + 1
            left -= int(in_size[front].sum())
            levels.append(at)
        return dist, paths, levels
