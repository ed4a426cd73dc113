"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing: one record per page. A record is one text row; the writer's line separator is the two line ends that close a WARC
record, so any store that Spark writes to will do. Pages with equal payloads become one response (largest page id)
and revisits of it, which carry digest and length but no payload.

Reading: files are planned into partitions by size; a file holds FILE_BYTES or so. Predicates on record type and page id are pushed down:
each record's headers are parsed first, and the block of an unwanted record is skipped by its
Content-Length without being read or decoded. ``payload=false`` skips all blocks. Other writers' archives are read too: all record types, gzipped ones (a member a record or
a whole file; these are read through, as they cannot be skipped), header names in any case, folded lines, missing fields. The driver lists files through Spark's own file system
classes; tasks open them through pyarrow, which knows local, HDFS and object-store addresses.

Defined results: null html is an empty payload; null url and null id leave their header out and read back as null. A
null id is smaller than any other. Fields that a record lacks are null; a missing payload length is that of the block behind its HTTP headers. The payload of requests and responses begins
behind the HTTP headers, that of other types is the block, revisits have none; transfer and content encodings stay as stored. Rows with equal payload and equal largest id are all responses. Control characters and
percent signs of an url are percent-encoded in the header and decoded when read. An empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import re
import urllib.parse
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from paceline.llm.text import or_empty
from paceline.session import cut

EOL = "\r\n"
CLOSE = EOL + EOL
SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
PARTITION_BYTES = 64 << 20
#: Size of the archives that are written, and records of one at most.
FILE_BYTES, RECORDS_PER_FILE = 128 << 20, 20_000
HTTP = ("request", "response")
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits' worth of bits at a time, 10 hex digits are 8 of base32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def classified(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, digest, n_bytes, refers_to)``; ``refers_to`` is null for responses.

    Digests alone are grouped; payloads meet only the table of revisits.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", or_empty(F.col("html")).alias("html"))
    page = page.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    ids = cut(page.select("page_id", "digest"))
    last = ids.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("__d"), "top")
    revisits = ids.join(last, F.col("digest") == F.col("__d")).where(~F.col("page_id").eqNullSafe(F.col("top"))).select(F.col("page_id").alias("__id"), "__d", "top").distinct()
    revisits = cut(revisits)  # its size is known before the join is planned: payloads are shuffled only if there are many
    same = F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__d"))
    return page.join(revisits, same, "left").select("page_id", "url", "html", "digest", "n_bytes", F.col("top").alias("refers_to"))


def record(p: str = "") -> Column:
    """One record without its closing line ends, from the columns of ``classified``."""
    url = F.regexp_replace(F.col("url"), "%", "%25")
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CLOSE))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("html")))
    field = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit(EOL)), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1" + EOL), field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", name(F.col("page_id"))), field("WARC-Refers-To", name(F.col("refers_to"))), field("WARC-Target-URI", url),
        field("WARC-Date", F.lit("2020-01-01T00:00:00Z")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Payload-Length", F.col("n_bytes").cast("string")),
        field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(EOL), block,
    )


def write(pages: DataFrame, path: str, records_per_file: int | None = None) -> None:
    """Writes the archives; with large pages fewer records go to a file, so that it stays near FILE_BYTES."""
    if records_per_file is None:
        mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
        records_per_file = max(1, min(RECORDS_PER_FILE, int(FILE_BYTES / (mean + 512))))
    rows = classified(pages).select(record().alias("value"))
    rows.write.option("lineSep", CLOSE).option("maxRecordsPerFile", records_per_file).text(path)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _accepts(filters: Sequence[Filter], row: dict) -> bool:
    for f in filters:
        value = row[f.attribute[0]]
        if value is None:
            return False
        ok = {
            EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value,
            GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value,
        }[type(f)](value, f)
        if not ok:
            return False
    return True


class WarcReader(DataSourceReader):
    PUSHED = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
    HEADERS = {"record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to"}

    def __init__(self, options: dict) -> None:
        self.files = [x.rsplit("\t", 1) for x in options["files"].split("\n") if x]
        self.payload = options.get("payload", "true") != "false"
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, self.PUSHED) and len(f.attribute) == 1 and f.attribute[0] in self.HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Small files together, up to ``partitionbytes`` a partition. The list of files stays here: a task is sent its own only."""
        out: list[Files] = []
        room = 0
        files, self.files = self.files, []
        for path, size in files:
            if not out or room < int(size):
                out.append(Files([]))
                room = self.bytes
            out[-1].paths.append(path)
            room -= int(size)
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for uri in partition.paths:
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as raw:
                packed = raw.read_at(2, 0) == b"\x1f\x8b"
                yield from self._records(Unpacked(raw) if packed else Plain(raw))

    def _records(self, source: Plain | Unpacked) -> Iterator[tuple]:
        while (head := source.head()) is not None:
            fields = headers(head)
            length = int(fields.get("content-length") or 0)
            row = _row(fields)
            if not _accepts(self.filters, row) and (row["payload_bytes"] is not None or not any(f.attribute[0] == "payload_bytes" for f in self.filters)):
                source.skip(length + 4)
                continue
            payload = None
            if row["payload_bytes"] is None and row["record_type"] != "revisit":
                # its HTTP headers are looked at, the rest only if it is wanted
                first = source.peek(length)
                inside = first.find(b"\r\n\r\n") + 4 if row["record_type"] in HTTP else 0
                row["payload_bytes"] = max(0, length - inside) if inside != 3 else 0
            if _accepts(self.filters, row):
                if self.payload and length and row["record_type"] != "revisit":
                    block = source.take(length)
                    payload = block.partition(b"\r\n\r\n")[2] if row["record_type"] in HTTP else block
                    source.skip(4)
                else:
                    payload = b"" if self.payload and row["record_type"] != "revisit" else None
                    source.skip(length + 4)
                yield (*row.values(), payload)
            else:
                source.skip(length + 4)


class Plain:
    """A file that is read from place to place: what is skipped is not read."""

    CHUNK = 1 << 16

    def __init__(self, raw: pyarrow.NativeFile) -> None:
        self.raw, self.size = raw, raw.size()
        self.buffer, self.base, self.at = b"", 0, 0

    def _more(self) -> bool:
        place = self.base + len(self.buffer)
        new = self.raw.read_at(min(self.CHUNK, self.size - place), place) if place < self.size else b""
        self.buffer += new
        return bool(new)

    def head(self) -> bytes | None:
        """The next record's headers; None at the end."""
        if self.at - self.base < len(self.buffer):
            self.buffer, self.base = self.buffer[self.at - self.base :], self.at
        else:
            self.buffer, self.base = b"", self.at
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError(f"no end of headers after byte {self.at}")
                return None
        self.at += end + 4
        return self.buffer[:end].lstrip(b"\r\n")

    def peek(self, length: int) -> bytes:
        """The block's bytes up to the end of its HTTP headers or so."""
        start = self.at - self.base
        while b"\r\n\r\n" not in self.buffer[start : start + length] and len(self.buffer) - start < length and self._more():
            pass
        return self.buffer[start : start + length]

    def take(self, length: int) -> bytes:
        start = self.at - self.base
        inside = self.buffer[start : start + length]
        self.at += length
        missing = length - len(inside)
        return inside + (self.raw.read_at(missing, self.at - missing) if missing else b"")

    def skip(self, length: int) -> None:
        self.at += length


class Unpacked(Plain):
    """A gzipped file, one member after the other, held no further than the block that is looked at."""

    def __init__(self, raw: pyarrow.NativeFile) -> None:
        raw.seek(0)
        self.stream = gzip.GzipFile(fileobj=raw)
        self.buffer, self.base, self.at = b"", 0, 0

    def _more(self) -> bool:
        new = self.stream.read(self.CHUNK)
        self.buffer += new
        return bool(new)

    def take(self, length: int) -> bytes:
        parts, start = [self.buffer], self.at - self.base
        have = len(self.buffer)
        while have - start < length and (new := self.stream.read(max(self.CHUNK, length - (have - start)))):
            parts.append(new)
            have += len(new)
        self.buffer = b"".join(parts)
        self.at += length
        return self.buffer[start : start + length]

    def skip(self, length: int) -> None:
        self.at += length
        while self.at - self.base > len(self.buffer):
            self.base, self.buffer = self.base + len(self.buffer), b""
            if not self._more():
                self.at = self.base
                return


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines belong to the field before them."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _row(fields: dict[str, str]) -> dict:
    number = lambda k: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", fields.get(k, ""))) else None
    url, digest, length = fields.get("warc-target-uri"), fields.get("warc-payload-digest"), fields.get("warc-payload-length")
    return {
        "page_id": number("warc-record-id"), "url": None if url is None else urllib.parse.unquote(url.strip("<>")), "record_type": fields.get("warc-type"),
        "payload_digest": digest and digest.removeprefix("sha1:"), "payload_bytes": int(length) if length else None, "refers_to": number("warc-refers-to"),
    }


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives below ``path``; ``payload=False`` never reads their blocks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    files = sorted((f.getPath().toUri().toString(), f.getLen()) for f in found if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
    listing = "\n".join(f"{uri}\t{size}" for uri, size in files)
    return spark.read.format("warc").option("files", listing).option("payload", str(payload).lower()).load()
