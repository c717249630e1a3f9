"""Packing of instruction data: every turn once, all three limits, and the choices of the dot-product rule."""

import collections
import random

import numpy as np
import pytest
from netlens.llm import packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def turns():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["stone", "river", "the", "of", "light", "unlikely"]) for _ in range(n))
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            role = ["user", "assistant"][t % 2] if c % 7 else rng.choice(["system", "user", "assistant", None])
            rows.append((c, t, role, rng.choice([prose(rng.randrange(1, 40)), prose(rng.randrange(200, 500)), None, ""])))
    return rows + [(None, 0, "user", "hello"), (None, 1, "assistant", "a " * 2500), (7, None, "assistant", "x")]


def items_of(rows):
    by = {(c, t): (r, x or "") for c, t, r, x in rows if c is not None and t is not None}
    out = {}
    for c, t, r, x in rows:
        before = by.get((c, t - 1), (None, ""))[::1] if c is not None and t is not None else ("assistant", "")
        if r == "assistant":
            out[c, t] = ((before[1] if before[0] != "assistant" and (c, t - 1 if t is not None else None) in by else ""), x or "")
        elif by.get((c, t + 1 if t is not None else None), ("", ""))[0] != "assistant":
            out[c, t] = (x or "", "")
    return out


def rule(items, limits):
    """The open bin takes, of all items that fit, that with the largest dot product with what is left; ties go to the first."""
    items = [(k, n, min(l, n)) for k, n, l in items]
    bins, rest = [], []
    for k, n, l in items:
        start = 0
        while n - start > limits.tokens or min(l, n - start) > limits.loss:
            free = n - l - start
            m = min(limits.tokens, n - start, max(free, 0) + limits.loss)
            bins.append([(k, start, m)])
            start += m
        rest.append((k, start, n - start, min(l, n - start)))
    while rest:
        left, own = [limits.tokens, limits.segments, limits.loss], []
        while left[1] >= 1:
            fits = [x for x in rest if x[2] <= left[0] and x[3] <= left[2]]
            if not fits:
                break
            worth = lambda x: x[2] / limits.tokens * (left[0] / limits.tokens) + x[3] / limits.loss * (left[2] / limits.loss) + left[1] / limits.segments / limits.segments  # noqa: B023, E731
            best = max(fits, key=worth)
            own.append(best[:3])
            left = [left[0] - best[2], left[1] - 1, left[2] - best[3]]
            rest.remove(best)
        bins.append(own)
    return bins


def test_every_turn_lies_in_one_item(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, prompt string, start int")
    got = {(r.doc_id.conv_id, r.doc_id.turn): (r.prompt, r.text) for r in packing.instruction_items(df).collect()}
    assert got == {k: v for k, v in items_of(rows).items()} | {(None, 0): ("hello", ""), (None, 1): ("", "a " * 2500), (7, None): ("", "x")}
    assert packing.instruction_items(df.limit(0)).count() == 0


def test_limits_and_choices(spark):
    rows = turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    items = [(r.doc_id, r.prompt, r.text) for r in packing.instruction_items(df).collect()]
    table = spark.createDataFrame([(f"{k.conv_id}/{k.turn}", p, t) for k, p, t in items], "doc_id string, prompt string, text string").coalesce(1)
    lib = tokenizers.Tokenizer.from_file(BPE)
    ids = {f"{k.conv_id}/{k.turn}": (lib.encode(p, add_special_tokens=False).ids, lib.encode(t, add_special_tokens=False).ids + [1]) for k, p, t in items}
    got = packing.pack(table, BPE, limits=packing.INSTRUCTION).collect()
    bins, seen = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        bins[r.sequence_id].append((r.doc_id, r.start, r.length))
        seen[r.doc_id].append((r.start, r.ids))
    for k, (p, t) in ids.items():
        assert b"".join(x for _, x in sorted(seen[k])) == np.array(p + t, "<u4").tobytes()
    limits, full = packing.INSTRUCTION, collections.Counter()
    for own in bins.values():
        tokens, loss = sum(n for *_, n in own), sum(max(0, s + n - max(s, len(ids[k][0]))) for k, s, n in own)
        assert tokens <= limits.tokens and len(own) <= limits.segments and loss <= limits.loss
        full.update({"segments": len(own) == limits.segments, "loss": loss > 0.95 * limits.loss, "tokens": tokens > 0.95 * limits.tokens})
    assert full["segments"] and full["loss"]  # both bind
    order = [r.doc_id for r in table.collect()]
    want = rule([(k, len(ids[k][0]) + len(ids[k][1]), len(ids[k][1])) for k in order], limits)
    assert sorted(map(sorted, bins.values())) == sorted(map(sorted, want))
