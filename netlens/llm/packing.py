"""Operator 4: vector bin packing of token sequences by the dot-product heuristic.

An item asks for (tokens, one segment, loss-bearing tokens); a bin has limits on all
three.  Whole bins are cut off long documents first.  The rest is placed block by
block: the open bin takes, of all items that fit, the one whose demand has the
largest dot product with what the bin has left, each dimension scaled by its limit; when none fits, the largest
item is cut to fill the tokens left and its tail goes back.  A block is so many items of one
partition, in their order there, so nothing is gathered in one place and no shuffle
is needed: a task packs what it has read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import MEMO, encoder, with_end
from .common import column, text_column
from .hashing import release


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most; ``block`` items are placed together."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    block: int = 1024
    cut: bool = True


def place(sizes: np.ndarray, losses: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) for a block of items.

    Loss-bearing tokens are the last ``losses[i]`` of item i (a prompt is followed by its answer).  Every
    token lies in one piece, no bin passes a limit.  With ``cut`` false an item larger than a limit
    is still cut, as no bin could hold it; others stay whole.
    """
    most = np.array([limits.tokens, limits.segments, limits.loss], float)
    begin = np.zeros(len(sizes), np.int64)
    left, bins = sizes.astype(np.int64).copy(), []
    loss = np.minimum(losses, sizes).astype(np.int64)

    def longest(i: int, tokens: int, lossy: int) -> int:
        """How much of item i's front fits: its loss-free part first, then loss-bearing tokens."""
        free = left[i] - loss[i]
        return int(min(tokens, left[i], free + lossy))

    for i in range(len(left)):  # what no bin holds whole
        while left[i] > limits.tokens or loss[i] > limits.loss or (limits.cut and left[i] == limits.tokens):
            n = longest(i, limits.tokens, limits.loss)
            bins.append([(i, int(begin[i]), n)])
            begin[i], left[i] = begin[i] + n, left[i] - n
            loss[i] = min(loss[i], left[i])
    alive = np.flatnonzero(left > 0)
    while len(alive):
        rest, own = most.copy(), []
        while len(alive) and rest[1] >= 1 and rest[0] >= 1:
            size, bears = left[alive], loss[alive]
            fits = (size <= rest[0]) & (bears <= rest[2])
            if fits.any():
                worth = size / most[0] * (rest[0] / most[0]) + bears / most[2] * (rest[2] / most[2]) + rest[1] / most[1] / most[1]
                k = int(np.argmax(np.where(fits, worth, -1.0)))
                i = alive[k]
                own.append((int(i), int(begin[i]), int(left[i])))
                rest -= (left[i], 1, loss[i])
                alive = np.delete(alive, k)
                continue
            if not limits.cut:
                break
            k = int(np.argmax(size))
            i = alive[k]
            n = longest(i, int(rest[0]), int(rest[2]))
            if n < 1:
                break
            own.append((int(i), int(begin[i]), n))
            lossy = max(0, n - int(left[i] - loss[i]))
            begin[i], left[i] = begin[i] + n, left[i] - n
            loss[i] = min(loss[i], left[i])
            rest -= (n, 1, lossy)
        bins.append(own)
    return bins


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits(), memo: int = MEMO) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences.

    A document is its ids by the tokenizers library for the whole text (null: empty; an added token's string gets its id),
    then ``end_id``; all its tokens bear loss, or the last ``loss_tokens`` where docs has such a long column.
    Where docs has a string column ``prompt``, an item is the ids of its prompt, those of its text and ``end_id``, each encoded by itself, and what follows the prompt bears loss.
    Returns one row per piece: doc_id, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id (partition * 2**33 + number), offset.  Repeated and null
    doc_ids (of any type) are packed as any row; an empty table gives no rows; other columns are ignored.
    ``memo`` bounds the encoder's memory per Python worker.
    """
    with_loss, with_prompt = "loss_tokens" in docs.columns, "prompt" in docs.columns
    docs = docs.select("doc_id", "text", *(["loss_tokens"] if with_loss else []), *(["prompt"] if with_prompt else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []
        n_held = 0

        def emit() -> pa.RecordBatch:
            nonlocal number, held, n_held
            sizes = np.array([len(x[1]) // 4 for x in held])
            losses = np.array([n if x[2] is None else x[2] for x, n in zip(held, sizes)])
            rows = []
            for own in place(sizes, losses, limits):
                offset = 0
                for i, start, n in own:
                    rows.append((held[i][0], start, n, held[i][1][4 * start : 4 * (start + n)], len(held[i][1]) // 4, base + number, offset))
                    offset += n
                number += 1
            held, n_held = [], 0
            kinds = [id_kind] + [pa.int64()] * 2 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            losses = column(batch, "loss_tokens").to_pylist() if with_loss else [None] * batch.num_rows
            doc_ids, id_kind = column(batch, "doc_id").to_pylist(), column(batch, "doc_id").type
            fronts: list[bytes] = []
            if with_prompt:
                for _, ids, bounds in encoder(tokenizer_path, memo).encode(text_column(batch, "prompt")):
                    fronts += [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            for at, ids, bounds in encoder(tokenizer_path, memo).encode(text_column(batch, "text")):
                ids, bounds = with_end(ids, bounds, end_id)
                for i in range(len(bounds) - 1):
                    own = ids[bounds[i] : bounds[i + 1]].tobytes()
                    if with_prompt:
                        losses[at + i] = len(own) // 4
                        own = fronts[at + i] + own
                    held.append((doc_ids[at + i], own, losses[at + i]))
                    n_held += len(own)
                    if len(held) >= limits.block or n_held > 16 << 20:
                        yield emit()
        if held:
            yield emit()
        release()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


#: Limits of instruction data, where all three bind: replies of few tokens fill a sequence's segments, long ones its loss-bearing tokens.
INSTRUCTION = Limits(tokens=2048, segments=12, loss=1024, block=1024, cut=False)


def instruction_items(turns: DataFrame) -> DataFrame:
    """(doc_id: struct of conv_id and turn, prompt, text) of ``turns(conv_id, turn, role, text)``: each turn in exactly one item.

    A turn of ``assistant`` bears loss and takes the turn before it as its prompt, unless that is the assistant's too; any other turn that gets no reply is an item that is all
    prompt (only its end id bears loss).  Null texts are empty; of several rows with one conv_id and turn, the one with the smallest text is the prompt.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    mine = F.col("role") == "assistant"
    asked = turns.where(~mine).groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    replied = turns.where(mine).select("conv_id", (F.col("turn") - 1).alias("turn")).distinct()
    key = F.struct("conv_id", "turn").alias("doc_id")
    replies = turns.where(mine).join(asked, ["conv_id", "turn"], "left").select(key, F.coalesce("prompt", F.lit("")).alias("prompt"), "text")
    others = turns.where(~mine).join(replied, ["conv_id", "turn"], "left_anti").select(key, F.col("text").alias("prompt"), F.lit("").alias("text"))
    return replies.union(others)


def conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations packed as instruction data: a row per piece of an item."""
    import public_tokenizers

    items = instruction_items(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    packed = pack(items, public_tokenizers.path("byte_bpe_50k.json"), limits=INSTRUCTION)
    return packed.select("doc_id.conv_id", "doc_id.turn", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("doc_tokens").alias("item_tokens"), "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents packed into sequences of at most 2048 tokens, end id 1."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
