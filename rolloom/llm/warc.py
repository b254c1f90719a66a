"""WARC archives written as deterministic shards, and read back.

Records are sorted by key range, files are rolled by their compressed size, headers and digests are
made anew from the payload, and files are committed through temporary names and a manifest. The same
table and number of shuffle partitions give the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.shared_files import commit, locate, open_new, temporary_name
from rolloom.session import materialize

REVISIT_BYTES = 1000  # equal payloads of at least this size are stored once
ROLL_BYTES = 64 << 20  # a file is closed behind the record that reaches this compressed size
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
_READ = 1 << 20
# --- fixed values: WARC 1.1 ----------------------------------------------------------------------
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:page:{key if key is not None else 'none-' + digest}>"


def _digest_text(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _headers(fields: list[tuple[str, str]]) -> bytes:
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member without a time stamp
    return packer.compress(record) + packer.flush()


def info_record(name: str, level: int = LEVEL) -> bytes:
    block = b"software: rolloom\r\nformat: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:file:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", str(len(block))),
    ]
    return _member(_headers(fields) + block + b"\r\n\r\n", level)


def page_record(
    key: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = LEVEL
) -> bytes:
    """One gzip member: a response, or a revisit without its payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    fields += [
        ("WARC-Payload-Digest", _digest_text(digest)),
        ("WARC-Block-Digest", _digest_text(hashlib.sha1(block).hexdigest())),
        ("Content-Type", HTTP_TYPE),
        ("Content-Length", str(len(block))),
    ]
    return _member(_headers(fields) + block + b"\r\n\r\n", level)


def members(file: pa.NativeFile) -> Iterator[bytes]:
    """The records of an archive, one gzip member after the other."""
    raw = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not raw:
                raw = file.read(_READ)
                if not raw:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(unpacker.decompress(raw))
            raw = unpacker.unused_data
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def page_row(fields: dict[str, str], block: bytes) -> dict:
    """What a page's record tells; a payload that does not fit its digest is an error."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and (
        len(payload) != size or hashlib.sha1(payload).hexdigest() != digest
    ):
        raise ValueError(f"damaged payload in {fields['warc-record-id']}")
    return {
        "key": _page_of(fields["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _page_of(fields.get("warc-refers-to")),
    }


_FILES = "part int, file_no int, name string, temporary string, n_records bigint, n_bytes bigint"
_FILES_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("file_no", pa.int32()),
        ("name", pa.string()),
        ("temporary", pa.string()),
        ("n_records", pa.int64()),
        ("n_bytes", pa.int64()),
    ]
)


def _writer(folder: str, roll_bytes: int, level: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made: list[dict] = []
        file, size, records = None, 0, 0
        of, target = None, None  # key and digest at hand; their decision comes before their pages

        def close() -> None:
            file.close()
            made[-1] |= {"n_records": records, "n_bytes": size}

        for batch in batches:
            columns = (batch.column(c) for c in ("key", "url", "html", "digest", "refers_to"))
            for key, url, html, digest, refers_to in zip(*columns):
                key = key.as_py()
                if refers_to.is_valid:
                    of, target = (key, digest.as_py()), refers_to.as_py()
                    continue
                if file is None:
                    name = f"pages-{part:06d}-{len(made):06d}.warc.gz"
                    temporary = temporary_name(folder, name)
                    made.append(
                        {"part": part, "file_no": len(made), "name": name, "temporary": temporary}
                    )
                    file = open_new(temporary)
                    head = info_record(name, level)
                    file.write(head)
                    size, records = len(head), 0
                response = target if (key, digest.as_py()) == of else None
                record = page_record(key, url.as_py(), html.as_py(), response, level)
                file.write(record)
                size, records = size + len(record), records + 1
                if size >= roll_bytes:
                    close()
                    file = None
        if file is not None:
            close()
        yield pa.RecordBatch.from_pylist(made, schema=_FILES_ARROW)

    return write


def revisits(pages: DataFrame, key: str, html: str, min_bytes: int) -> DataFrame:
    """``(key, digest, refers_to)`` of the pages whose payload a page with a larger key has, too."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    slim = pages.select(
        F.col(key).cast("bigint").alias("key"),
        F.sha1(body).alias("digest"),
        F.octet_length(body).alias("size"),
    ).filter(F.col("size") >= min_bytes)
    slim = materialize(slim.select("key", "digest"), "payloads")
    groups = slim.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("n"))
    groups = groups.filter("n > 1").drop("n")
    rows = slim.join(groups, "digest").filter("key < refers_to")
    return rows.select("key", "digest", "refers_to").distinct()


def write_warc(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = REVISIT_BYTES,
    roll_bytes: int = ROLL_BYTES,
    level: int = LEVEL,
) -> DataFrame:
    """Write every page as a record and return the manifest ``(part, file_no, name, n_records,
    n_bytes)``; the files lie in ``folder``.

    Of records with equal payloads of at least ``min_bytes`` the one with the largest key is a
    response and the others are revisits of it. NULL html is an empty payload; a NULL url has no
    target header; records with a NULL key come first and are responses. Rows that repeat the largest
    key with its payload are all responses. An empty table writes no file.

    The decisions about revisits come from a pass over keys and digests. They are sorted in among the
    pages, so that html is shuffled once. Pages are dealt by key and digest: those that share a key, or
    have none, go to several tasks, and a decision to the task of its pages.
    """
    spark = pages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    decided = revisits(pages, key, html, min_bytes)
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("bigint").alias("key"),
        F.col(url).alias("url"),
        body.alias("html"),
        F.sha1(body).alias("digest"),
    )
    rows = rows.unionByName(decided, allowMissingColumns=True)
    place = ["key", "digest"]
    rows = rows.repartitionByRange(tasks, *place).sortWithinPartitions(
        *place, F.col("refers_to").isNull(), "url"
    )
    files = rows.mapInArrow(_writer(folder, roll_bytes, level), _FILES)
    return commit(spark, files, folder)


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """``(key, payload_bytes, payload_digest, record_type, refers_to)`` of every page record in the
    files of a manifest. Digests are compared with the payloads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("key", pa.int64()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
            ]
        )
        for batch in batches:
            for name in batch.column("name").to_pylist():
                store, path = locate(f"{folder}/{name}")
                rows: list[dict] = []
                with store.open_input_stream(path, compression=None) as file:
                    for record in members(file):
                        fields, block = parse_record(record)
                        if fields["warc-type"] != "warcinfo":
                            rows.append(page_row(fields, block))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("name").repartition(tasks, "name")
    return files.mapInArrow(
        read,
        "key bigint, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint",
    )
