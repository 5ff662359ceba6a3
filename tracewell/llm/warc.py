"""WARC archives as a Spark data source: written by tasks, read by file partitions with predicates on headers.

Every record is a gzip member of its own whose ``sl`` extra field holds the member's length. The reader inflates a
member's first bytes, parses the headers, and where a predicate fails, or no column needs the payload, goes on behind the
member without inflating the rest. Members without the field, as other tools write them, are inflated but not kept.

A write leaves a manifest of its files, with offsets at which they may be split; files that no manifest names (of tasks
that failed or ran twice) are not read. Folders without manifests are read file by file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tracewell.session import broadcast_if_small, materialize, shared_dir

#: Columns that come from the record's headers: name, header, type.
_HEADERS = {
    "record_id": ("warc-record-id", pa.string()),
    "record_type": ("warc-type", pa.string()),
    "target_uri": ("warc-target-uri", pa.string()),
    "refers_to": ("warc-refers-to", pa.string()),
    "payload_digest": ("warc-payload-digest", pa.string()),
    "content_type": ("content-type", pa.string()),
    "content_length": ("content-length", pa.int64()),
    "payload_length": ("x-payload-length", pa.int64()),
}
_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, content_type string, content_length long, payload_length long, http_status int, payload binary"
_MANIFEST = "_warc-manifest-"
_BATCH_BYTES = 8 << 20
_HEAD = 4096


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path (local, HDFS, S3, GCS, as pyarrow knows them) and the path in it."""
    if re.match(r"file:/+", path):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", path)
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (pafs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """Header values keep to one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def encode_record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member with its length in the ``sl`` field; headers without a value are left out."""
    lines = [f"{k}: {_clean(v)}\r\n" for k, v in headers.items() if v is not None]
    raw = ("WARC/1.1\r\n" + "".join(lines) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    extra = struct.pack("<2sHII", b"sl", 8, 12 + 12 + len(body) + 8, len(raw))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _skip_length(head: bytes) -> int | None:
    """Length of the member that ``head`` begins, where its extra field tells."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        name, size = struct.unpack_from("<2sH", head, at)
        if name == b"sl" and size == 8 and at + 12 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


def parse_headers(raw: bytes) -> dict[str, str]:
    """Names (lower case) and values of a header block; folded lines are joined, the first of equal names counts."""
    found: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] = f"{found[name]} {line.strip()}".strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            if name not in found:
                found[name] = value.strip()
            else:
                name = ""
    return found


class _Members:
    """Records of a byte range of a gzip file: ``next`` gives headers, then ``block`` or ``skip`` goes on."""

    def __init__(self, source, start: int, stop: int):
        self.source, self.at, self.stop = source, start, stop

    def next(self) -> dict[str, str] | None:
        if self.at >= self.stop:
            return None
        self.source.seek(self.at)
        head = self.source.read(_HEAD)
        if not head:
            return None
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {self.at}")
        self.length, self.inflate, self.raw = _skip_length(head), zlib.decompressobj(31), b""
        self.fed = len(head)
        self.raw = self.inflate.decompress(head, 1 << 16)
        while (cut := self.raw.find(b"\r\n\r\n")) < 0:
            if not self._more(1 << 16):
                raise ValueError(f"record at byte {self.at} ends within its headers")
        if not self.raw.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {self.at}")
        self.start = cut + 4
        return parse_headers(self.raw[:cut])

    def _more(self, most: int) -> bool:
        """Inflates on, by at most ``most`` bytes."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail
        if not data:
            data = self.source.read(1 << 16)
            self.fed += len(data)
            if not data:
                raise ValueError(f"the file ends within the record at byte {self.at}")
        self.raw += self.inflate.decompress(data, most)
        return True

    def block(self, size: int) -> bytes:
        pieces, have = [self.raw], len(self.raw)
        while have < self.start + size:
            self.raw = b""
            if not self._more(1 << 20):
                raise ValueError(f"record at byte {self.at} is shorter than its Content-Length")
            pieces.append(self.raw)
            have += len(self.raw)
        whole = b"".join(pieces)
        self.skip()
        return whole[self.start : self.start + size]

    def skip(self) -> None:
        if self.length is None:
            while self._more(1 << 20):
                self.raw = b""
            self.length = self.fed - len(self.inflate.unused_data)
        self.at += self.length


class _Plain:
    """The same over a file that is not compressed."""

    def __init__(self, source, start: int, stop: int):
        self.source, self.at, self.stop = source, start, stop

    def next(self) -> dict[str, str] | None:
        if self.at >= self.stop:
            return None
        self.source.seek(self.at)
        raw = b""
        while (cut := raw.find(b"\r\n\r\n")) < 0:
            data = self.source.read(_HEAD)
            if not data and not raw.strip():
                return None
            if not data:
                raise ValueError(f"record at byte {self.at} ends within its headers")
            raw += data
        if not raw.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {self.at}")
        self.start, headers = self.at + cut + 4, parse_headers(raw[:cut])
        self.at = self.start + int(headers.get("content-length", 0)) + 4
        return headers

    def block(self, size: int) -> bytes:
        self.source.seek(self.start)
        block = self.source.read(size)
        if len(block) < size:
            raise ValueError(f"the file ends within the record before byte {self.at}")
        return block

    def skip(self) -> None:
        pass


def _test(condition: Filter, row: dict) -> bool | None:
    """A pushed predicate over header columns, null (None) as in SQL."""
    if isinstance(condition, Not):
        inner = _test(condition.child, row)
        return None if inner is None else not inner
    value = row[condition.attribute[0]]
    if isinstance(condition, IsNull):
        return value is None
    if isinstance(condition, IsNotNull):
        return value is not None
    if value is None:
        return None
    if isinstance(condition, In):
        return True if value in condition.value else None if None in condition.value else False
    if condition.value is None:
        return None
    if isinstance(condition, EqualTo):
        return value == condition.value
    if isinstance(condition, StringStartsWith):
        return value.startswith(condition.value)
    if isinstance(condition, GreaterThan):
        return value > condition.value
    if isinstance(condition, GreaterThanOrEqual):
        return value >= condition.value
    if isinstance(condition, LessThan):
        return value < condition.value
    return value <= condition.value


def _known(condition: Filter) -> bool:
    if isinstance(condition, Not):
        return _known(condition.child)
    of = getattr(condition, "attribute", ())
    if len(of) != 1 or of[0] not in _HEADERS or of[0] == "payload_length":  # that column is filled from the payload too
        return False
    if isinstance(condition, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
        return of[0] == "content_length"
    return isinstance(condition, (EqualTo, In, IsNull, IsNotNull, StringStartsWith))


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``: one row a record of a file or a folder.

    Equality, IN, prefix, null tests on header columns and comparisons of content_length are pushed down. A schema that
    leaves out ``payload`` and ``http_status`` reads headers only. The payload of a response is what follows its HTTP
    headers, that of other records their block, that of revisits null.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, schema, overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.pushed: list[Filter] = []
        unknown = set(self.names) - set(_HEADERS) - {"http_status", "payload"}
        if unknown:
            raise ValueError(f"a WARC record has no columns {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if _known(condition):
                self.pushed.append(condition)
            else:
                yield condition

    def partitions(self) -> list[_Range]:
        """A partition per range of a manifest's files; of other folders, and of single files, one per file."""
        system, path = _open(self.path)
        if system.get_file_info(path).type == pafs.FileType.File:
            return [_Range(self.path, 0, system.get_file_info(path).size)]
        found = system.get_file_info(pafs.FileSelector(path))
        manifests = sorted(x.path for x in found if x.base_name.startswith(_MANIFEST))
        base = self.path.rstrip("/")
        if not manifests:
            return [_Range(f"{base}/{x.base_name}", 0, x.size) for x in found if x.base_name.endswith((".warc", ".warc.gz"))] or [_Range("", 0, 0)]
        ranges = []
        for manifest in manifests:
            with system.open_input_stream(manifest) as source:
                for entry in json.loads(source.read()):
                    cuts = [*entry["splits"], entry["size"]]
                    ranges += [_Range(f"{base}/{entry['name']}", a, b) for a, b in zip(cuts, cuts[1:])]
        return ranges or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        kinds = {**{k: v[1] for k, v in _HEADERS.items()}, "http_status": pa.int32(), "payload": pa.binary()}
        schema = pa.schema([(name, kinds[name]) for name in self.names])
        rows: list[dict] = []
        held = 0
        for row in self._rows(part) if part.path else ():
            rows.append(row)
            held += 200 + len(row.get("payload") or b"")
            if held >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _rows(self, part: _Range) -> Iterator[dict]:
        system, path = _open(part.path)
        wanted = "payload" in self.names or "http_status" in self.names
        with system.open_input_file(path) as source:
            records = (_Members if path.endswith(".gz") else _Plain)(source, part.start, part.stop)
            while (headers := records.next()) is not None:
                row = {name: headers.get(of) for name, (of, _) in _HEADERS.items()}
                size = int(row["content_length"] or 0)
                row["content_length"] = size
                row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
                if not all(_test(condition, row) for condition in self.pushed):
                    records.skip()
                    continue
                if wanted and row["record_type"] != "revisit":
                    block = records.block(size)
                    if row["record_type"] == "response" and block.startswith(b"HTTP/"):
                        head, _, block = block.partition(b"\r\n\r\n")
                        status = head.split(b"\r\n", 1)[0].split()
                        row["http_status"] = int(status[1]) if len(status) > 1 and status[1].isdigit() else None
                    row["payload"] = block
                else:
                    records.skip()
                yield row


class WarcWriter(DataSourceArrowWriter):
    """Writes rows with the columns record_id, record_type, target_uri, refers_to, payload_digest, payload_length and
    payload; responses are wrapped in HTTP headers, revisits have no block. Files end at about ``bytes`` (128 MB)."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.bytes, self.split = int(options.get("bytes", 128 << 20)), int(options.get("split", 32 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        done, out = _Written(), None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    entry = {"name": f"part-{uuid.uuid4().hex}.warc.gz", "splits": [0], "size": 0}
                    out = system.open_output_stream(f"{path}/{entry['name']}", compression=None)
                    info = encode_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    entry["size"] = len(info)
                member = encode_record(*_record(row))
                if entry["size"] - entry["splits"][-1] >= self.split:
                    entry["splits"].append(entry["size"])
                out.write(member)
                entry["size"] += len(member)
                if entry["size"] >= self.bytes:
                    out.close()
                    done.files.append(entry)
                    out = None
        if out is not None:
            out.close()
            done.files.append(entry)
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        """One manifest names the files of all tasks that ended well; overwriting then removes what was named before."""
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        old = [x.path for x in system.get_file_info(pafs.FileSelector(path)) if x.base_name.startswith(_MANIFEST)] if self.overwrite else []
        with system.open_output_stream(f"{path}/{_MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        for manifest in old:
            with system.open_input_stream(manifest) as source:
                names = [entry["name"] for entry in json.loads(source.read())]
            system.delete_file(manifest)
            for name in names:
                system.delete_file(f"{path}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, path = _open(self.path)
        for entry in (f for m in messages if m for f in m.files):
            system.delete_file(f"{path}/{entry['name']}")


def _record(row: dict) -> tuple[dict[str, str | None], bytes]:
    kind, payload = row["record_type"], row.get("payload") or b""
    length = row.get("payload_length")
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": row.get("record_id"),
        "WARC-Target-URI": row.get("target_uri"),
        "WARC-Refers-To": row.get("refers_to"),
        "WARC-Payload-Digest": row.get("payload_digest"),
        "X-Payload-Length": None if length is None else str(length),
    }
    if kind == "revisit":
        return headers | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, b""
    if kind == "response":
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return headers | {"Content-Type": "application/http; msgtype=response"}, http + payload
    return headers, payload


def register_warc(spark: SparkSession) -> None:
    """Makes the format ``warc`` known and lets the session push predicates into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32, as archives write digests: five bits a letter, from 40 bits at a time."""
    sha, alphabet = F.sha1(payload), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = []
    for group in range(4):
        bits = F.conv(F.substring(sha, 10 * group + 1, 10), 16, 10).cast("bigint")
        letters += [F.substring(F.lit(alphabet), F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*letters)


def with_revisits(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload_digest, record_type and refers_to to captures (page_id, payload, ...).

    Of captures with equal payloads (by SHA-1 and MD5) of at least ``least_bytes`` bytes that with the smallest page_id
    is the response, the others revisit it; smaller ones are all responses. Rows that repeat the smallest id are
    responses too; null ids come after all others. Only digests that occur twice are joined, and by broadcast where
    they are few, so payloads of any number of copies stay where they are.
    """
    digest = F.struct(F.unhex(F.sha1("payload")).alias("a"), F.unhex(F.md5("payload")).alias("b"))
    sized = captures.select("page_id", digest.alias("k"), F.octet_length("payload").alias("n"))
    groups = sized.filter(F.col("n") >= least_bytes).groupBy("k").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    shared = materialize(groups.filter("copies > 1 and first is not null").select(F.col("k.a").alias("__tw_a"), F.col("k.b").alias("__tw_b"), F.col("first").alias("__tw_first")), "shared_payloads")
    keyed = captures.withColumn("__tw_a", F.unhex(F.sha1("payload"))).withColumn("__tw_b", F.unhex(F.md5("payload")))
    joined = keyed.join(broadcast_if_small(shared, 1_000_000), ["__tw_a", "__tw_b"], "left")
    again = F.col("__tw_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("__tw_first")))
    marked = joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("__tw_first")))
    return marked.withColumn("payload_digest", base32_sha1(F.col("payload"))).drop("__tw_a", "__tw_b", "__tw_first")


def write_archive(captures: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives captures (page_id, url, payload) below ``path``; ids become urn:page names, null ids urn:page:none."""
    register_warc(captures.sparkSession)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    marked = with_revisits(captures.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload")), least_bytes)
    rows = marked.select(
        name("page_id").alias("record_id"),
        "record_type",
        F.col("url").alias("target_uri"),
        F.when(F.col("refers_to").isNotNull(), name("refers_to")).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("payload_digest")).alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_length"),
        F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"),
    )
    rows.write.format("warc").mode("append").save(path)


def _page(column: str) -> Column:
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture.

    Size and digest of responses come from the payload read back; revisits are read by their headers alone.
    """
    register_warc(spark)
    responses = spark.read.format("warc").schema("record_id string, record_type string, payload binary").load(path).filter("record_type = 'response'")
    revisits = spark.read.format("warc").schema("record_id string, record_type string, refers_to string, payload_digest string, payload_length long").load(path).filter("record_type = 'revisit'")
    return responses.select(
        _page("record_id").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("bigint").alias("refers_to"),
    ).unionByName(
        revisits.select(
            _page("record_id").alias("page_id"),
            F.col("payload_length").alias("payload_bytes"),
            F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
            "record_type",
            _page("refers_to").alias("refers_to"),
        )
    )


def op12_warc(spark, sf_dir: str) -> DataFrame:
    """Archives every page in the shared folder and reads the archives back.

    Null html is an empty payload, null urls have no target, null ids come last and read as null, html of any length is
    one record (2 GB at most, as a row is), equal rows are records each, an empty table gives no records; further
    columns are ignored.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/tracewell/{uuid.uuid4().hex}/archive"
    write_archive(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("html").cast("binary").alias("payload")), path)
    return read_archive(spark, path)


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, html, first, page_id IS NULL AND first IS NOT NULL OR coalesce(page_id > first, false) AS again, list_transform(range(4), lambda i: ('0x' || substr(sha, 10 * i + 1, 10))::BIGINT) AS bits FROM p JOIN g USING (html))
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((bits[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM d
"""
