"""WARC archives as a Spark data source, read and written through ``format("warc")``.

Reading plans one partition per archive file. Each record's headers are parsed first; record
types and headers that pushed-down filters exclude are skipped without decoding the payload,
and where a gzip member says how long it is (the ``sl`` extra field, which the writer sets),
without inflating it. Writing gives each task files of about ``file_mb``; the files that
committed are listed in ``_files``, so that what a lost or repeated task left behind is not
read. Paths may have any scheme that pyarrow's file systems know.

Rows to write have: record_id, record_type, target_uri, date, refers_to, payload_digest,
payload_length, payload. Rows read have the same and ``headers``, a map of all headers by
lower-cased name. Payloads of HTTP responses come without the HTTP headers.

Defined results: null fields are left out of a record's headers and are read as null; a null
payload is written and read as an empty one. A folder without archives gives no rows. A record
that is cut off ends the file it is in.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from tallyrock.llm.text import table
from tallyrock.sources.shared import cut, new_path

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary, headers map<string,string>"
WRITTEN = ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest", "payload_length")
NAMES = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length",
}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A page's payload of fewer bytes is always stored.
LEAST_REVISIT = 1000
#: Bytes of headers beyond which a file is taken for no archive.
MOST_HEADER = 1 << 20


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(fields: dict, payload: bytes) -> bytes:
    """A WARC/1.1 record."""
    kind = fields.get("record_type")
    block = HTTP + (payload if kind != "revisit" else b"") if kind in ("response", "revisit") else payload
    lines = ["WARC/1.1"]
    for name, header in NAMES.items():
        if (value := fields.get(name)) is not None:
            lines.append(f"{header}: {str(value).replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines.append("Content-Type: " + ("application/http; msgtype=response" if kind in ("response", "revisit") else "application/octet-stream"))
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with the lengths of its packed and plain form in an ``sl`` extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff"
    total = len(head) + 2 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def skip_length(head: bytes) -> int | None:
    """The length of a gzip member, if its header says it."""
    if len(head) >= 24 and head[3] & 4:
        size = struct.unpack_from("<H", head, 10)[0]
        at = 12
        while at + 4 <= 12 + size and at + 4 <= len(head):
            name, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
            if name == b"sl" and n == 8 and at + 12 <= len(head):
                return struct.unpack_from("<I", head, at + 4)[0]
            at += 4 + n
    return None


def parse_headers(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def count_of(value: str | None) -> int | None:
    """A header's number of bytes; None for what no file can hold."""
    return int(value) if value and value.isascii() and value.isdigit() and len(value) <= 18 else None


class _Plain:
    """Record bytes of an uncompressed archive, in order."""

    def __init__(self, file) -> None:
        self.file, self.rest = file, b""

    def more(self) -> bytes:
        return self.file.read(1 << 16)

    def headers(self) -> dict[str, str] | None:
        data = self.rest
        while (end := data.lstrip(b"\r\n").find(b"\r\n\r\n")) < 0:
            more = self.more()
            if not more or len(data) > MOST_HEADER:
                return None
            data += more
        data = data.lstrip(b"\r\n")
        self.rest = data[end + 4 :]
        return parse_headers(data[:end])

    def body(self, size: int) -> bytes:
        parts, have = [self.rest], len(self.rest)
        while have < size and (more := self.more()):
            parts.append(more)
            have += len(more)
        data = b"".join(parts)
        self.rest = data[size:]
        return data[:size]

    def skip(self, size: int) -> None:
        beyond = size - len(self.rest)
        self.rest = self.rest[size:]
        if beyond > 0:
            self.file.seek(min(self.file.tell() + beyond, self.file.size()))


class _Packed(_Plain):
    """Record bytes of an archive of gzip members, one record in each."""

    def __init__(self, file) -> None:
        super().__init__(file)
        self.start = self.length = None
        self.inflate = None

    def headers(self) -> dict[str, str] | None:
        if self.inflate is not None:
            self._next_member()
        self.start, self.rest = self.file.tell(), b""
        head = self.file.read(1 << 13)
        if len(head) < 18:
            return None
        self.length, self.inflate = skip_length(head), zlib.decompressobj(31)
        self.rest = self.inflate.decompress(head)
        return super().headers()

    def more(self) -> bytes:
        while not self.inflate.eof and (raw := self.file.read(1 << 16)):
            if out := self.inflate.decompress(raw):
                return out
        return b""

    def skip(self, size: int) -> None:
        self.rest = b""

    def _next_member(self) -> None:
        if self.length is None:
            while not self.inflate.eof and (raw := self.file.read(1 << 16)):
                self.inflate.decompress(raw)
            self.file.seek(self.file.tell() - len(self.inflate.unused_data))
        else:
            self.file.seek(self.start + self.length)


def records(file, packed: bool, wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of each record whose headers ``wanted`` accepts; block None without ``payloads``."""
    source = _Packed(file) if packed else _Plain(file)
    while (headers := source.headers()) is not None:
        size = count_of(headers.get("content-length")) or 0
        if not wanted(headers):
            source.skip(size)
        elif payloads:
            yield headers, source.body(size)
        else:
            source.skip(size)
            yield headers, None


@dataclass
class ArchiveFile(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() == "true"
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        """Take equality and membership on the header columns; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and name in NAMES and name != "payload_length":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only.get(name, values) & values
            elif not (isinstance(f, IsNotNull) and name in ("record_type",)):
                yield f

    def partitions(self):
        from pyarrow import fs

        files, path = _files(self.path)
        listing = f"{path}/_files"
        if files.get_file_info(listing).type == fs.FileType.File:
            with files.open_input_stream(listing) as f:
                names = [f"{path}/{n}" for n in json.loads(f.read())]
        else:
            names = sorted(x.path for x in files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")))
        return [ArchiveFile(n) for n in names]

    def wanted(self, headers: dict[str, str]) -> bool:
        return "warc-type" in headers and all(headers.get(NAMES[n].lower()) in v for n, v in self.only.items())

    def read(self, partition):
        if partition is None:  # a folder without archives
            return
        files, _ = _files(self.path)
        with files.open_input_file(partition.path) as f:
            for headers, block in records(f, partition.path.endswith(".gz"), self.wanted, self.payloads):
                if block is not None and headers.get("content-type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                values = [headers.get(NAMES[n].lower()) for n in WRITTEN]
                values[-1] = count_of(values[-1])
                yield (*values, block, headers)


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("file_mb", "128")) << 20

    def write(self, batches) -> Written:
        files, path = _files(self.path)
        files.create_dir(path, recursive=True)
        names, out = [], None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None or out.tell() > self.most:
                        if out is not None:
                            out.close()
                        names.append(f"records-{uuid.uuid4().hex}.warc.gz")
                        out = files.open_output_stream(f"{path}/{names[-1]}", compression=None)
                        out.write(member(record({"record_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>"}, b"format: WARC File Format 1.1\r\n")))
                    out.write(member(record(row, row.get("payload") or b"")))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages) -> None:
        files, path = _files(self.path)
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/_files", compression=None) as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages) -> None:
        files, path = _files(self.path)
        for n in (n for m in messages if m for n in m.names):
            files.delete_file(f"{path}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Records of pages: a copy of a payload of ``least`` bytes or more is a revisit of the largest id's response.

    A null html is an empty payload. Rows that repeat the largest id are all responses; a
    null id is smaller than any other. Other columns are not read. Only digests that occur
    twice or more are joined, so that Spark can broadcast them where they are few.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("target_uri"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    largest = rows.where(F.col("payload_length") >= least).groupBy("payload_digest", "payload_length").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that Spark knows its size and shuffles no payload for few copies
    largest = cut(largest.select(F.concat_ws(":", "payload_digest", "payload_length").alias("same"), "first"), "warc-copies")
    own = F.concat_ws(":", F.lit("own"), F.col("id").cast("string"), "payload_digest")
    rows = rows.withColumn("same", F.when(F.col("payload_length") >= least, F.concat_ws(":", "payload_digest", "payload_length")).otherwise(own))
    rows = rows.join(largest, "same", "left").withColumn("again", F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False)))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        urn(F.col("id")).alias("record_id"), F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("date"), F.when(F.col("again"), urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"), "payload_length", F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def page_of(urn: str) -> Column:
    number = F.regexp_extract(urn, "^<urn:page:(.*)>$", 1)
    return F.when(number != "", number).cast("long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = new_path(spark, "warc")
    page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    stored = F.col("record_type") == "response"
    return back.select(
        page_of("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type", page_of("refers_to").alias("refers_to"),
    )


ORACLES = {
    "op10_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN m.first_id IS NOT NULL AND m.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.first_id IS NOT NULL AND m.first_id <> p.page_id THEN m.first_id END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 1000
"""
}
