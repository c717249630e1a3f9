"""Operator 8: WARC archives with a two-level capture index.

Archives hold one gzip member per record.  The capture index sorts the captures by reversed-host URL key (range
partitions), cuts them into compressed blocks of BLOCK_LINES lines, and keeps a sparse directory
with the first key, file, offset and length of every block.  A look-up narrows the directory by its files' statistics and bisection, reads
the blocks of that key by range, and then each record by range.  Files carry random suffixes and count
only once Spark has committed the table that names them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.loop import join_spread
from .common import column, filesystem, make_folder, new_place, staged, text_column

BLOCK_LINES = 1000
#: Repeated payloads up to which their first pages are broadcast (40 bytes each); above, pages are joined by shuffle, frequent payloads over several tasks.
BROADCAST_PAYLOADS = 100_000
#: WARC-Date of all records unless the caller gives one; the tables hold no capture time.
DATE = "2000-01-01T00:00:00Z"
GZIP = 31


def url_key(url: Column) -> Column:
    """Reversed-host key: http://www.a.com:80/x?q → com,a,www)/x?q; scheme, user, port and fragment go, the host is lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), "^.*@", ""), ":[0-9]*$", ""))
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def _record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record with CRLF headers; a revisit keeps the HTTP header, which states the payload's length, and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one uncompressed record; its lengths are verified."""

    def fields(block: bytes) -> dict[str, str]:
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    body = rest[: int(warc["content-length"])]
    if len(body) != int(warc["content-length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record does not have its stated length")
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _urn(value: str) -> int | None:
    number = value[len("<urn:page:") : -1]
    return int(number) if number else None


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_archives(pages: DataFrame, place: str | None = None, min_revisit_bytes: int = 0, level: int = 6, date: str = DATE) -> tuple[str, DataFrame]:
    """Write ``pages(page_id, url, html)`` as archives; returns (folder, captures).

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the smallest page_id is the response and others are revisits of it.
    Null html is an empty payload, null url an empty address.  Rows that repeat the smallest page_id are responses
    too; a null page_id is larger than all others, so among null ids alone all are responses.  Other columns are ignored.
    Captures: key, url, page_id, type, digest, path, offset, length.
    """
    spark = pages.sparkSession
    place = place or new_place(spark, "warc")
    make_folder(place)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), url_key(F.col("url")).alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    sha = F.unhex(F.sha1(F.encode("html", "UTF-8")))
    firsts = rows.select(sha.alias("sha"), "page_id").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = staged(firsts.where("n > 1"), "repeated-payloads")
    first, rows = repeated.select("sha", "first"), rows.withColumn("sha", sha)
    if repeated.count() <= BROADCAST_PAYLOADS:
        joined = rows.join(F.broadcast(first), "sha", "left")
    else:
        joined = join_spread(rows, first, "sha", "left", counts=repeated.select("sha", "n"))
    joined = joined.select("page_id", "url", "key", "html", "sha", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(place)
        name = f"archive-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                out = where.open_output_stream(f"{path}/{name}", compression=None)
            digests, kinds, offsets, lengths = [], [], [], []
            for page_id, url, html, sha, first in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "html", "sha", "first"))):
                payload, digest = html.encode(), base64.b32encode(sha).decode()
                refers = first if first is not None and first != page_id and len(payload) >= min_revisit_bytes else None
                squeeze = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                data = squeeze.compress(_record(page_id, url, payload, digest, refers, date)) + squeeze.flush()
                out.write(data)
                digests.append(digest)
                kinds.append("response" if refers is None else "revisit")
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), column(batch, "url"), column(batch, "page_id"), pa.array(kinds, pa.string()), pa.array(digests, pa.string()), pa.array([f"{place}/{name}"] * len(kinds), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "url", "page_id", "type", "digest", "path", "offset", "length"],
            )
        if out is not None:
            out.close()

    schema = "key string, url string, page_id long, type string, digest string, path string, offset long, length long"
    joined.mapInArrow(write, schema).write.parquet(f"{place}/captures")
    return place, spark.read.schema(schema).parquet(f"{place}/captures")


def _line(values) -> str:
    key, page_id, kind, digest, path, offset, length = values
    return "\t".join([key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D"), "" if page_id is None else str(page_id), kind, digest, path, str(offset), str(length)])


def write_index(captures: DataFrame, place: str, lines: int = BLOCK_LINES) -> DataFrame:
    """The two-level index of captures: compressed blocks in files below ``place``; returns the directory (first_key, last_key, path, offset, length, captures)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(place)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz"
        out, at, held, directory = None, 0, [], []

        def block():
            nonlocal out, at, held
            if out is None:
                out = where.open_output_stream(f"{path}/{name}", compression=None)
            squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            data = squeeze.compress("\n".join(held).encode()) + squeeze.flush()
            out.write(data)
            directory.append((held[0].partition("\t")[0], held[-1].partition("\t")[0], f"{place}/{name}", at, len(data), len(held)))
            at, held = at + len(data), []

        for batch in batches:
            for values in zip(*(column(batch, c).to_pylist() for c in ("key", "page_id", "type", "digest", "path", "offset", "length"))):
                held.append(_line(values))
                if len(held) == lines:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
            kinds = [pa.string()] * 3 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*directory), kinds)], names=["first_key", "last_key", "path", "offset", "length", "captures"])

    schema = "first_key string, last_key string, path string, offset long, length long, captures long"
    ordered = captures.select("key", "page_id", "type", "digest", "path", "offset", "length").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    ordered.mapInArrow(write, schema).write.parquet(f"{place}/directory")
    return captures.sparkSession.read.schema(schema).parquet(f"{place}/directory")


def read_block(path: str, offset: int, length: int) -> list[list[str]]:
    """The captures of one index block, by one range read."""
    where, name = filesystem(path)
    with where.open_input_file(name) as source:
        return [x.split("\t") for x in zlib.decompress(source.read_at(length, offset), GZIP).decode().split("\n")]


def look_up(directory: DataFrame, key: str) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records of a URL key.

    The directory's files are sorted by key, so the filter reaches their statistics and only the rows of blocks that can hold the key come to the
    driver; blocks are searched by bisection, and only those and the records found are read, by range.
    """
    directory = directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key", "path", "offset").collect()
    low = bisect_left([r.last_key for r in directory], key)
    high = bisect_right([r.first_key for r in directory], key)
    found = []
    for r in directory[low:high]:
        block = read_block(r.path, r.offset, r.length)
        keys = [x[0] for x in block]
        for x in block[bisect_left(keys, key) : bisect_right(keys, key)]:
            where, name = filesystem(x[4])
            with where.open_input_file(name) as source:
                found.append(parse_record(zlib.decompress(source.read_at(int(x[6]), int(x[5])), GZIP)))
    return found


def read_archives(directory: DataFrame) -> DataFrame:
    """All records that the index names: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Index blocks are read by range; their captures are dealt by archive and offset, so that a task reads its stretch of an archive
    forward, record by record.  A response's digest is computed from its payload and compared with its header and with the index.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length in zip(*(column(batch, c).to_pylist() for c in ("path", "offset", "length"))):
                rows = read_block(path, offset, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[4] for x in rows]), pa.array([int(x[5]) for x in rows], pa.int64()), pa.array([int(x[6]) for x in rows], pa.int64()), pa.array([x[3] for x in rows])],
                    names=["path", "offset", "length", "digest"],
                )

    named = directory.select("path", "offset", "length").mapInArrow(blocks, "path string, offset long, length long, digest string")
    # a stated number of partitions, as the small index rows stand for much larger records
    parts = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = named.repartition(parts, "path").sortWithinPartitions("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            out = []
            for path, offset, length, digest in zip(*(column(batch, c).to_pylist() for c in ("path", "offset", "length", "digest"))):
                if path != opened:
                    if source is not None:
                        source.close()
                    where, name = filesystem(path)
                    source, opened = where.open_input_file(name), path
                warc, http, payload = parse_record(zlib.decompress(source.read_at(length, offset), GZIP))
                said = warc["warc-payload-digest"].removeprefix("sha1:")
                revisit = warc["warc-type"] == "revisit"
                if said != digest or not revisit and (sha1_base32(payload) != said or len(payload) != int(http["content-length"])):
                    raise ValueError(f"record at {offset} of {path} does not match its digest")
                out.append((_urn(warc["warc-record-id"]), int(http["content-length"]), said, warc["warc-type"], _urn(warc["warc-refers-to"]) if revisit else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            cells = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cells, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source is not None:
            source.close()

    return named.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every page written, indexed, and read back through the index."""
    place, captures = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(write_index(captures, place))
