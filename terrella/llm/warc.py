"""WARC archives as seekable Zstandard bundles: independent frames, a footer seek table, and an index of records."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, small, written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
#: Numbers of the seekable format: a skippable frame at the end, and its last four bytes. Fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, number: int) -> str:
    """The same each time for a page, its payload and its turn in a bundle."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{payload_digest}/{number}')}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, number: int) -> bytes:
    """One WARC/1.1 record; a revisit has headers only, its digest is that of the full payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, payload_digest, number)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~-._')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: compressed and plain size of each frame, their number, no checksums, the magic number."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the end of a bundle of `size` bytes."""
    count, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE or len(tail) < 17 + 8 * count:
        raise ValueError("no seek table, or more of the end is needed")
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (count - i))
        out.append((at, packed, plain))
        at += packed
    if at + 17 + 8 * count != size:
        raise ValueError("the seek table does not fit the bundle")
    return out


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the record at an offset of a frame."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    return head, data[start : start + int(head["Content-Length"])], start + int(head["Content-Length"]) + 4


def _frame_writer(root: str, name: str) -> Iterator[pa.RecordBatch]:
    """Receives (record id, page id, record), yields index batches; the file takes its name only when whole."""
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    pack = zstandard.ZstdCompressor(level=3)
    frames: list[tuple[int, int]] = []
    index: list[tuple[str, int | None, int, int, int]] = []
    held, size = [], 0
    with fs.open_output_stream(part) as out:

        def flush() -> None:
            nonlocal held, size
            if held:
                plain = b"".join(held)
                packed = pack.compress(plain)
                out.write(packed)
                frames.append((len(packed), len(plain)))
                held, size = [], 0

        got = yield None
        while got is not None:
            name_, page_id, data = got
            if size and size + len(data) > FRAME_BYTES:
                flush()
            index.append((name_, page_id, len(frames), size, len(data)))
            held.append(data)
            size += len(data)
            got = yield None
        flush()
        out.write(seek_table(frames))
    fs.move(part, f"{path}/{name}")
    columns = list(zip(*index, strict=True)) if index else [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    arrays = [pa.array([name] * len(index), pa.string())] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    yield pa.RecordBatch.from_arrays(arrays, ["bundle", "record_id", "page_id", "frame", "offset", "length"])


INDEX = "bundle string, record_id string, page_id long, frame int, offset long, length long"


def write_bundles(pages: DataFrame, root: str, page_id: str = "page_id", url: str = "url", html: str = "html", bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record for each row into bundles below root and gives their index: bundle, record_id, page_id, frame,
    offset within the frame, length.

    Of rows with equal payloads, those with the largest page_id are responses (repeated rows of that id all are; null
    ids come last), the others revisits of it. Rows go to bundles by a hash of page and payload, so that neither a host
    nor a group of copies makes a bundle large, and a task that is run again writes the same bundle; a bundle gets its
    name when it is whole. root must be a folder that all executors reach (a local path on all of them, or a store that
    pyarrow opens). An empty table writes nothing. Null payloads are empty; null urls are urn:none; a very long payload
    is a frame of its own. Only the three columns are read, so the names of others do not matter.
    """
    spark = pages.sparkSession
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    slim = slim.withColumn("sha", F.sha1("payload"))
    # Only groups of at least two pages need to meet their response; sums of parts keep a hot payload out of one task.
    groups = slim.groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("rows"), F.max(F.octet_length("payload")).alias("size"))
    groups = written(groups, "payloads")
    total = groups.agg(F.sum(F.col("size") + 600 * F.col("rows"))).first()[0] or 0
    shared = groups.where("rows > 1").select(F.col("sha").alias("_sha"), "last")
    placed = slim.join(small(shared, 128), F.col("sha") == F.col("_sha"), "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    bundles = max(1, -(-int(total) // bundle_bytes), min(64, -(-int(total) // (1 << 20))))
    placed = placed.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"), "sha", refers.alias("refers_to"), F.pmod(F.xxhash64("page_id", "sha"), F.lit(bundles)).cast("int").alias("bundle"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer, number = None, None, 0

        def closed() -> pa.RecordBatch:
            return writer.send(None)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("bundle", "page_id", "url", "payload", "size", "sha", "refers_to")), strict=True)
            for bundle, pid, link, payload, size, sha, refers_to in rows:
                if bundle != name:
                    if writer is not None:
                        yield closed()
                    name, number = bundle, 0
                    writer = _frame_writer(root, f"bundle-{bundle:06d}.warc.zst")
                    next(writer)
                number += 1
                kind = "response" if refers_to is None else "revisit"
                code = base64.b32encode(bytes.fromhex(sha)).decode()
                data = record(kind, pid, link, payload if kind == "response" else bytes(size), code, refers_to, number)
                writer.send((record_id(pid, code, number), pid, data))
        if writer is not None:
            yield closed()

    dealt = placed.repartition(bundles, "bundle").sortWithinPartitions("bundle", "page_id", "sha")
    return written(dealt.mapInArrow(kernel, INDEX), "index")


RECORD = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long"


def read_bundles(index: DataFrame, root: str) -> DataFrame:
    """The records of an index, read frame by frame through each bundle's seek table; digests are checked.

    A record whose place, page or payload does not agree with the index or its digest raises ValueError.
    """
    frames = index.groupBy("bundle", "frame").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "page_id", "record_id"))).alias("records"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        unpack = zstandard.ZstdDecompressor()
        tables: dict[str, list[tuple[int, int, int]]] = {}
        for batch in batches:
            out = []
            for bundle, frame, records in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "records")), strict=True):
                with fs.open_input_file(f"{path}/{bundle}") as f:
                    if bundle not in tables:
                        tail = f.read_at(9, f.size() - 9)
                        (count,) = struct.unpack_from("<I", tail)
                        tables = {bundle: read_seek_table(f.read_at(17 + 8 * count, f.size() - 17 - 8 * count), f.size())}
                    at, packed, plain = tables[bundle][frame]
                    data = unpack.decompress(f.read_at(packed, at), max_output_size=plain)
                for r in records:
                    head, body, end = parse(data, r["offset"])
                    payload = body.split(b"\r\n\r\n", 1)[1]
                    kind, code = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    pid = int(head["X-Page-ID"]) if "X-Page-ID" in head else None
                    if end - r["offset"] != r["length"] or pid != r["page_id"] or head["WARC-Record-ID"] != r["record_id"] or kind == "response" and digest(payload) != code:
                        raise ValueError(f"{bundle}, frame {frame}, offset {r['offset']}: the record differs from its index or digest")
                    refers = head.get("X-Refers-To-Page")
                    out.append((r["record_id"], pid, int(head["X-Payload-Length"]), code, kind, int(refers) if refers else None, bundle, frame, r["offset"]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

    bundles = max(1, index.select("bundle").distinct().count())
    return frames.repartition(bundles, "bundle").sortWithinPartitions("bundle", "frame").mapInArrow(kernel, RECORD)


def lookup(index: DataFrame, root: str, record_ids: DataFrame) -> DataFrame:
    """The records whose ids record_ids (record_id) names, as read_bundles gives them; unknown ids give none."""
    wanted = record_ids.select(F.col("record_id").alias("wanted")).distinct()
    return read_bundles(index.join(wanted, F.col("record_id") == F.col("wanted"), "left_semi"), root)


def query(spark, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "warc")
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_bundles(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH page AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
five AS (
  SELECT *, list_transform(range(8), lambda g: list_sum(list_transform(range(5), lambda k:
    (instr('0123456789abcdef', substr(x, (5 * g + k + 1)::BIGINT, 1)) - 1) * (16 ** (4 - k))::BIGINT))::BIGINT) AS v,
         max(page_id) OVER (PARTITION BY x) AS last
  FROM page)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[(i // 4)::INTEGER + 1] // (32 ** (3 - i % 4))::BIGINT) % 32 + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM five
"""
