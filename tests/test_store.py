"""The bucketed store of running weights: batches touch their own buckets, and count once."""

import os

import pytest
from netlens.streaming import stream


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_batches_write_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "weights")
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long, weight double")
    write = stream.merge_weights(spark, path, buckets=16)
    with pytest.raises(ValueError):
        stream.merged_weights(spark, path)
    want = {}

    def batch(number, rows, counts=True):
        write(frame(rows), number)
        if counts:
            want.update({(a, b): w for a, b, w in rows})
        assert {(r.src, r.dst): r.weight for r in stream.merged_weights(spark, path).collect()} == want

    batch(0, [(i, i + 1, 1.0) for i in range(500)])
    whole, before = sum(os.path.getsize(f) for f in files_of(path)), files_of(path)
    batch(1, [(3, 4, 7.0)])
    new = files_of(path) - before
    assert len(new) == 1 and sum(os.path.getsize(f) for f in new) < whole / 8
    batch(1, [(3, 4, 99.0)], counts=False)  # run again
    batch(0, [(5, 6, 99.0)], counts=False)  # older
    batch(7, [(3, 4, 8.0), (1000, 1, 2.0)])  # numbers 2 to 6 had no rows for us
    batch(8, [])
    for n in range(9, 14):
        batch(n, [(3, 4, float(n))])
    assert len(os.listdir(f"{path}/state")) == 2 and len(os.listdir(f"{path}/data")) <= 5
