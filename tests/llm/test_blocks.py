"""Blocks of near copies just below the similarity: each set is written once."""

import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from netlens.llm import minhash
from netlens.plans.loop import checkpoint_dir


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("words,n", [(5_000, 80), (20_000, 40)])
def test_long_near_copies_below_the_similarity(spark, monkeypatch, words, n):
    """Texts that share some 80 per cent of their shingles: linked with nothing at 0.85, and their sets are not copied per token."""
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    rng = random.Random(words)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words), int(words * 0.0194)):
            w[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    rows.append((n, rows[0][1] + " tail of it"))
    top = re.sub("^file:/+", "/", checkpoint_dir(spark))
    before = set(os.listdir(top))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 0.85).collect()}
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split(" ") for _, t in rows)]
    assert max(len(a & b) / len(a | b) for a, b in itertools.combinations(sets[:6], 2)) < 0.85
    assert got == {i: i for i in range(n)} | {n: 0}
    new = [x for x in os.listdir(top) if x not in before]
    written = {kind: sum(size(f"{top}/{x}") for x in new if x.startswith(kind)) for kind in ("sets-", "blocks-")}
    assert written["blocks-"] > 0 and written["blocks-"] <= 1.5 * written["sets-"]


def test_blocks_do_not_go_with_the_partitions(spark, monkeypatch):
    """Few members are one block, whatever the partitions that order them; each partition began blocks of its own, and all met all."""
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(400), 8):
            w[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    rows.append((60, rows[7][1] + " tail of it"))
    top = re.sub("^file:/+", "/", checkpoint_dir(spark))
    before = set(os.listdir(top))
    names = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got[60] == got[7]
    blocks = [b for x in os.listdir(top) if x not in before and x.startswith("blocks-") for b in os.listdir(f"{top}/{x}") if b.startswith("block=")]
    assert len(blocks) == 1


@pytest.mark.parametrize("same", [True, False])
def test_a_pair_of_sets_is_verified_once_and_many_at_once(monkeypatch, same):
    """Many near copies around the similarity: the forest connects what brute force does, with far fewer single tests than pairs."""
    rng = np.random.default_rng(5)
    sets = [np.unique(np.where(rng.random(100) < rate, rng.integers(1000, 10**9, 100), np.arange(100))).astype(np.uint64) for rate in np.linspace(0, 0.16, 600)]
    bounds = np.append(0, np.cumsum([len(x) for x in sets]))
    regs = minhash.registers(np.concatenate(sets), bounds)
    calls, similar = [], minhash.similar
    monkeypatch.setattr(minhash, "similar", lambda *x: calls.append(1) or similar(*x))
    block = lambda at: (at, at, np.diff(bounds)[at], regs[at], pa.array([sets[i].tobytes() for i in at], pa.binary()))
    left = block(np.arange(600) if same else np.arange(0, 600, 2))
    right = left if same else block(np.arange(1, 600, 2))
    got = minhash._forest(left, right, 0.85)
    links = [(i, j) for i in left[0].tolist() for j in right[0].tolist() if i < j or not same if similar(sets[i], sets[j], 85)]

    def parts(pairs):
        root = list(range(600))
        for i, j in pairs:
            old, new = root[i], root[j]
            root = [new if x == old else x for x in root]
        return sorted(tuple(i for i in range(600) if root[i] == r) for r in set(root))

    assert set(got) <= set(links) and parts(got) == parts(links)
    assert len(calls) < 5000
