"""WARC archives as a PySpark Python data source, written and read with deduplicated payloads.

``spark.dataSource.register(WarcSource)`` adds the format ``warc``.

Writing: each task writes files of its own (``<part>-<attempt>-<n>.warc.gz``, one gzip member
per record) and beside each a ``.cdx`` index, one line per record with its place in the file;
the commit lists the files of the successful attempts in ``_manifest``, so a lost or repeated
task leaves no record twice. A file is closed at ``fileBytes`` and a new one begun.

Reading: the driver plans partitions from the manifest alone: one per file, or per run of
``splitBytes`` inside a larger file, found in its index by the task. Predicates on the header
columns (record type, ids, URI, digest, ...) are pushed down. A task inflates a record's first
bytes only, parses its headers, and drops the record there if a pushed predicate fails or, with
``payload=false``, keeps it without inflating its payload.

Defined cases: a null payload is empty; a null URI writes no URI header and reads back null;
control characters in header values are percent-encoded; an empty table writes no file and
reads back no record; a record's payload is held in one task at a time, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition,
                                    IsNotNull, IsNull, StringStartsWith, WriterCommitMessage)

from driftline.llm.common import file_system, scratch_dir

COLUMNS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
           "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, payload_digest string, "
          "refers_to string, block_length long, payload binary")
#: WARC/1.1 and HTTP wire format: fixed values.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def clean(value: str) -> str:
    return "".join(c if ord(c) >= 32 and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def warc_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def hex_digest(header: str | None) -> str | None:
    """Bare lower-case hex of a ``sha1:BASE32`` header."""
    if not header or not header.startswith("sha1:"):
        return None
    return base64.b32decode(header[5:]).hex()


def encode_record(row) -> bytes:
    payload = bytes(row["payload"] or b"")
    if row["record_type"] == "revisit":
        block = b""
    else:
        block = (HTTP_HEAD % len(payload)).encode() + payload
    lines = [VERSION]
    for column, name in COLUMNS.items():
        value = row[column] if column != "payload_digest" else row[column] or warc_digest(payload)
        if value is not None:
            lines.append(f"{name}: {clean(value)}".encode())
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}".encode())
    lines.append(b"Content-Type: application/http; msgtype=response")
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


@dataclass
class Slice(InputPartition):
    path: str
    first: int
    last: int


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.file_bytes = int(options.get("filebytes", 1 << 30))
        self.level = int(options.get("compression", 3))

    def write(self, rows) -> Written:
        from pyspark import TaskContext
        store, root = file_system(self.folder)
        store.create_dir(root, recursive=True)
        stem = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        files, out, cdx, at = [], None, [], 0
        for row in rows:
            if out is None or at >= self.file_bytes:
                self._close(store, root, files, out, cdx, at)
                name = f"{stem}-{len(files):04d}.warc.gz"
                out, cdx, at = store.open_output_stream(f"{root}/{name}", compression=None), [], 0
                files.append([name, 0])
            packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            member = packer.compress(encode_record(row)) + packer.flush()
            out.write(member)
            cdx.append(f"{at} {len(member)}\n")
            at += len(member)
        self._close(store, root, files, out, cdx, at)
        return Written(files)

    @staticmethod
    def _close(store, root, files, out, cdx, at) -> None:
        if out is None:
            return
        out.close()
        files[-1][1] = at
        with store.open_output_stream(f"{root}/{files[-1][0]}.cdx") as f:
            f.write("".join(cdx).encode())

    def commit(self, messages) -> None:
        store, root = file_system(self.folder)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{root}/_manifest") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        """Files of failed attempts are in no manifest and are never read."""


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split_bytes = int(options.get("splitbytes", 64 << 20))
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        """Predicates on header columns are decided here; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in COLUMNS and isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNull, IsNotNull)):
                value = getattr(f, "value", None)
                self.tests.append((column, type(f).__name__, value))
            else:
                yield f

    def passes(self, head: dict) -> bool:
        for column, kind, value in self.tests:
            x = head.get(column)
            if kind == "IsNull":
                ok = x is None
            elif kind == "IsNotNull":
                ok = x is not None
            elif kind == "EqualNullSafe":
                ok = x == value
            elif x is None:
                ok = False
            elif kind == "EqualTo":
                ok = x == value
            elif kind == "In":
                ok = x in value
            else:
                ok = x.startswith(value)
            if not ok:
                return False
        return True

    def partitions(self):
        store, root = file_system(self.folder)
        with store.open_input_stream(f"{root}/_manifest") as f:
            files = json.loads(f.read())
        return [Slice(f"{root}/{name}", a, min(a + self.split_bytes, size))
                for name, size in files for a in range(0, size, self.split_bytes)] or [Slice("", 0, 0)]

    def read(self, part: Slice):
        if not part.path:
            return
        store, _ = file_system(self.folder)
        with store.open_input_stream(part.path + ".cdx") as f:
            places = [tuple(map(int, x.split())) for x in f.read().decode().splitlines()]
        with store.open_input_file(part.path) as f:
            for at, n in places:
                if part.first <= at < part.last:              # a record belongs to the slice that holds its start
                    f.seek(at)
                    if (row := self.decode(f.read(n))) is not None:
                        yield row

    def decode(self, member: bytes):
        """The record's row, or None if its headers fail a predicate; the payload is inflated last."""
        unzip, head, rest = zlib.decompressobj(31), b"", member
        while (end := head.find(b"\r\n\r\n")) < 0 and rest:
            head += unzip.decompress(rest, 2048)
            rest = unzip.unconsumed_tail
        names = {v.lower(): k for k, v in COLUMNS.items()}
        found, length = {}, 0
        for line in head[:end].split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8").partition(":")
            name, value = name.strip().lower(), value.strip()
            if name in names:
                found[names[name]] = value
            elif name == "content-length":
                length = int(value)
        if not self.passes(found):
            return None
        payload = None
        if self.with_payload and found.get("record_type") == "response":
            block = (head[end + 4:] + unzip.decompress(rest))[:length]
            payload = block[block.find(b"\r\n\r\n") + 4:]
        return (*(found.get(c) for c in COLUMNS), length, payload)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def record_id(page_id):
    return F.format_string("<urn:page:%s>", page_id.cast("string"))


def page_of(record):
    return F.regexp_extract(record, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *,
                  revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", folder: str | None = None) -> str:
    """Write one record per page and return the folder.

    Of pages with equal payloads of at least ``revisit_bytes`` bytes the one with the largest
    id is the response and the others are revisits of it; repeated rows of that id are all
    responses. Groups meet by SHA-1 and length through a map-side combined aggregate, so a hot
    payload costs one row per task.
    """
    spark = pages.sparkSession
    register(spark)
    folder = folder or scratch_dir(spark, "warc")
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    groups = (rows.where(F.col("n") >= revisit_bytes).groupBy("sha", "n")
              .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("pages")).where("pages > 1"))
    placed = rows.join(groups, ["sha", "n"], "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    (placed.select(
        record_id(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha1:"), base32(F.col("sha"))).alias("payload_digest"),
        F.when(again, record_id(F.col("original"))).alias("refers_to"), F.lit(None).cast("long").alias("block_length"),
        F.when(~again, F.col("payload")).alias("payload"))
     .write.format("warc").mode("append").save(folder))
    return folder


def base32(hex_sha):
    """RFC 4648 text of a SHA-1 in hex: 160 bits are 32 letters of 5 bits."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_sha, 1 + 5 * i, 5), 16, 2), 20, "0") for i in range(8)])
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(letters, F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1))
                      for i in range(32)])


def read_archive(spark, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def archived_pages(spark, folder: str) -> DataFrame:
    """Per page from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response come from its payload; a revisit's from the response it
    refers to, of the responses of that id the one with the digest in the revisit's header: rows of
    one id may hold unlike payloads, and each has its own row here. Two scans: the revisits' never
    inflates a payload.
    """
    full = read_archive(spark, folder).where(F.col("record_type") == "response").select(
        page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("sha"), "record_type", F.lit(None).cast("long").alias("refers_to"), F.col("payload_digest").alias("header"))
    again = read_archive(spark, folder, payload=False).where(F.col("record_type") == "revisit").select(
        page_of(F.col("record_id")).alias("page_id"), "record_type", page_of(F.col("refers_to")).alias("refers_to"),
        F.col("payload_digest").alias("header"))
    original = full.select(F.col("page_id").alias("refers_to"), "header", "payload_bytes", "sha").distinct()
    return full.unionByName(again.join(original, ["refers_to", "header"]).select(*full.columns)).select(
        "page_id", "payload_bytes", F.col("sha").alias("payload_digest"), "record_type", "refers_to")
