"""WARC archives with a two-level capture index.

``write`` puts one record per page into gzip-member archives: a ``response``, or
a ``revisit`` of the response with the smallest id among equal payloads of at
least ``MIN_SHARED`` bytes.  The captures are sorted by reversed-host URL key and
written as compressed blocks of ``BLOCK_LINES`` lines; each index file ends with
its sparse directory (the first key of every block), and the manifest holds the
first key of every index file.  ``lookup`` searches the manifest, then the
directory, and reads one block by range; ``read`` walks all index blocks and
range-reads every record.

Archives and index files bear the name of the task attempt that wrote them, and
only the attempt whose rows were kept is referred to, so repeated attempts leave
unused files, never wrong ones.

Defined results: a null page is an empty payload; a null URL has the key "" and
no target URI; rows that share a group's smallest id are each a response, as are
all rows of a group that has no id; a null id is stored as such; an empty table
gives an empty index; extra columns aren't archived.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlytics.llm.storage import drop, open_file, releasing_shuffles, stored, write_file
from vendorlytics.llm.text import tidied

MIN_SHARED = 100
BLOCK_LINES = 1000
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, url string, digest string, type string, file string, offset long, length long"
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
          "payload_bytes long, payload binary")


def url_key(url: str | None) -> str:
    """``https://a.b.org:443/x?y#z`` -> ``org,b,a)/x?y``: hosts of one domain sort together."""
    if not url:
        return ""
    scheme, mark, rest = url.partition("://")
    if not mark:
        scheme, rest = "", url
    rest = rest.partition("#")[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, colon, port = host.partition(":")
    if colon and port and (scheme.lower(), port) not in (("http", "80"), ("https", "443")):
        port = ":" + port
    else:
        port = ""
    return ",".join(reversed(name.rstrip(".").split("."))) + port + ")" + (path if path[:1] == "/" else "/" + path)


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to) of each page."""
    pages = pages.select(
        "page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")) \
        .withColumn("digest", F.sha2("payload", 256))
    shared = pages.where(F.octet_length("payload") >= MIN_SHARED).groupBy("digest") \
        .agg(F.min("page_id").alias("smallest"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Stored first: its true size then decides whether the pages have to be shuffled.
    return pages.join(stored(shared, "shared-payloads"), "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("smallest").isNull() | (F.col("page_id") == F.col("smallest")), None)
        .otherwise(F.col("smallest")).alias("refers_to")) \
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    number = lambda x: int(x[12:-1]) if x and len(x) > 13 else None
    return {"page_id": number(fields["WARC-Record-ID"]), "record_type": kind, "payload_digest": digest,
            "refers_to": number(fields.get("WARC-Refers-To")), "payload_bytes": size,
            "payload": payload if kind == "response" else None}


def _columns(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write the archives; returns the captures (``CAPTURE``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captures: list[tuple] = []

        def rows():
            for batch in batches:
                names = ("page_id", "url", "payload", "digest", "refers_to", "record_type")
                yield from zip(*(batch.column(n).to_pylist() for n in names))

        def members(first, name: str):
            row, at = first, 0
            while row is not None:
                page_id, url, payload, digest, refers_to, kind = row
                member = record(page_id, url, payload, digest, refers_to)
                captures.append((url_key(url), page_id, url, digest, kind, name, at, len(member)))
                at += len(member)
                yield member
                row = next(source, None) if at < ARCHIVE_BYTES else None

        source = rows()
        while (first := next(source, None)) is not None:
            name = f"pages-{uuid.uuid4().hex}.warc.gz"
            write_file(f"{folder}/{name}", members(first, name))
            yield _columns(CAPTURE, captures)
            captures.clear()

    return decided.mapInArrow(tidied(run), CAPTURE)


def write_index(captures: DataFrame, folder: str) -> None:
    """Sort the captures by key into compressed blocks; each file ends with its directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for b in batches for line in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))))
        directory: list[tuple] = []

        def blocks(first: tuple):
            at, held = 0, [first, *islice(lines, BLOCK_LINES - 1)]
            while held:
                block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode(), 6)
                directory.append((held[0][0], at, len(block)))
                at += len(block)
                yield block
                held = list(islice(lines, BLOCK_LINES))
            listed = zlib.compress(json.dumps(directory).encode())
            yield listed + struct.pack("<Q", len(listed))

        first = next(lines, None)
        if first is not None:
            name = f"index-{uuid.uuid4().hex}"
            write_file(f"{folder}/{name}", blocks(first))
            yield pa.RecordBatch.from_pydict({"key": [first[0]], "file": [name], "blocks": [len(directory)]})

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    with releasing_shuffles(captures.sparkSession):
        files = sorted(tuple(r) for r in ordered.mapInArrow(tidied(run), "key string, file string, blocks long").collect())
    write_file(f"{folder}/manifest", [json.dumps(files).encode()])  # a row an index file


def write(pages: DataFrame, folder: str) -> None:
    captures = stored(write_archives(decide(pages), folder), "captures")
    write_index(captures, folder)
    drop(captures)


def _manifest(folder: str) -> list[list]:
    with open_file(f"{folder}/manifest") as f:
        return json.loads(f.read())


def _directory(f) -> list[list]:
    end = f.size() - 8
    n = struct.unpack("<Q", f.read_at(8, end))[0]
    return json.loads(zlib.decompress(f.read_at(n, end - n)))


def _block(f, at: int, size: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(f.read_at(size, at)).split(b"\n")]


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """All captures, from the index blocks (an index file a task)."""
    files = [f for _, f, _ in _manifest(folder)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            with open_file(f"{folder}/{files[i]}") as f:
                for _, at, size in _directory(f):
                    yield _columns(CAPTURE, [tuple(x) for x in _block(f, at, size)])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(tidied(run), CAPTURE)


def lookup(urls: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """The captures of each distinct URL key among ``urls``: binary search in the
    manifest and the file's directory, then range reads of the blocks that can
    hold the key."""
    files = _manifest(folder)
    first = [k for k, _, _ in files]

    def found(key: str, opened: dict) -> Iterator[tuple]:
        for i in range(max(0, bisect_left(first, key) - 1), bisect_right(first, key)):
            if i not in opened:
                opened.clear()
                f = open_file(f"{folder}/{files[i][1]}")
                opened[i] = f, _directory(f)
            f, directory = opened[i]
            starts = [k for k, _, _ in directory]
            for b in range(max(0, bisect_left(starts, key) - 1), bisect_right(starts, key)):
                yield from (tuple(x) for x in _block(f, *directory[b][1:]) if x[0] == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            keys = sorted({url_key(u) for u in batch.column(0).to_pylist()})
            yield _columns(CAPTURE, [x for key in keys for x in found(key, opened)])

    asked = urls.select(F.col(url).alias("url")).distinct()
    return asked.mapInArrow(tidied(run), CAPTURE).distinct()


def read_records(captured: DataFrame, folder: str) -> DataFrame:
    """The records (``RECORD``) of captures, by range reads of their archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            rows = list(zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length", "url"))))
            i = 0
            while i < len(rows):
                name, begin = rows[i][:2]
                j, end = i, begin
                while j < len(rows) and rows[j][0] == name and rows[j][1] == end and (j == i or end - begin < READ_BYTES):
                    end += rows[j][2]
                    j += 1
                if name not in opened:
                    opened.clear()
                    opened[name] = open_file(f"{folder}/{name}")
                raw = opened[name].read_at(end - begin, begin)
                out = []
                for _, at, size, url in rows[i:j]:
                    r = parse(raw[at - begin:at - begin + size])
                    out.append((r["page_id"], url, r["record_type"], r["refers_to"], r["payload_digest"],
                                r["payload_bytes"], r["payload"]))
                yield _columns(RECORD, out)
                i = j

    # A fixed number of partitions: the rows are small, what they point to isn't.
    tasks = int(captured.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return captured.select("file", "offset", "length", "url").repartition(tasks, "file") \
        .sortWithinPartitions("file", "offset").mapInArrow(tidied(run), RECORD)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives, through the index."""
    return read_records(captures(spark, folder), folder)
