"""WARC archives as a Spark data source, written and read in Python.

Reading: a partition is a file, or ``split_bytes`` of a larger one, from the first record that begins there (in a gzip
file, the first member). Filters on the record type and on headers are pushed down; a record's headers are parsed first,
and the payload of a record that is not wanted, or of any record when the schema has no ``payload``, is skipped without
decoding: past it in a plain file, drained in a compressed one.

The size of a payload is that of the block without its HTTP head, whatever the HTTP head says; only a revisit, which has
no payload, has the size that its HTTP head names (NULL if none). A block of HTTP type without the empty line that ends
such a head is all payload. A record that is damaged (no version or Content-Length, a payload of another digest with
``verify``, cut off, or not ending where it says) fails the read with its place, or with ``on_damage`` skip is left out,
and reading goes on with the next record that can be found.

Writing: each record is a gzip member of its own (or plain); beyond ``max_file_bytes`` a task starts a new file. Tasks
write to a staging folder; the commit moves the files of the tasks that succeeded, so a task that runs again leaves
nothing double.

Options: ``path``; for writing ``compression`` (gzip or none), ``max_file_bytes``; for reading ``verify`` (true checks
each decoded payload against its digest), ``on_damage`` (fail or skip), ``split_bytes``.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

READ_SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to_id string, payload_digest string, payload_bytes long, content_type string, payload binary"
WRITE_COLUMNS = ("record_type", "record_id", "target_uri", "date", "refers_to_id", "payload")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX_FILE_BYTES, SPLIT_BYTES, BUFFER, BATCH_ROWS = 256 << 20, 1 << 30, 1 << 20, 500
#: Bytes that a record's or an HTTP head may have.
MAX_HEAD = 1 << 20
_VERSION, _MEMBER = b"WARC/1.", b"\x1f\x8b\x08"

#: Columns that come from headers alone, and the header of each.
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to_id": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record_type: str, record_id: str, target_uri: str | None, date: str, refers_to_id: str | None, payload: bytes) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone; both have the digest and size of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {_line(record_type)}", f"WARC-Record-ID: {_line(record_id)}", f"WARC-Date: {_line(date)}"]
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {_line(target_uri)}")
    if record_type == "revisit":
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if refers_to_id is not None:
            head.append(f"WARC-Refers-To: {_line(refers_to_id)}")
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class Damage(ValueError):
    """What is wrong with a record. ``passed``: reading may go on right behind it."""

    def __init__(self, what: str, passed: bool = False):
        super().__init__(what)
        self.passed = passed


class _Source:
    """Bytes of a file in order, plain or of gzip members, with a way past what isn't wanted."""

    def __init__(self, raw, compressed: bool, at: int = 0):
        raw.seek(at)
        self.raw, self.compressed, self.place = raw, compressed, at  # place: how far the file is read
        self.held, self.at = b"", 0  # decoded bytes, and how many of them are passed
        self.inflate, self.pending = None, b""  # the member under way, and bytes still to decode

    def left(self) -> int:
        return len(self.held) - self.at

    def position(self) -> int:
        """Where the next byte is in the file; inside a gzip member, no more than where decoding is."""
        return self.place - (len(self.pending) if self.compressed else self.left())

    def _read(self) -> bytes:
        data = self.raw.read(BUFFER)
        self.place += len(data)
        return data

    def _step(self) -> bytes | None:
        """Decode once, up to a buffer and within one member; None at the end of the file."""
        if not self.compressed:
            return self._read() or None
        if not self.pending:
            self.pending = self._read()
            if not self.pending:
                cut, self.inflate = self.inflate is not None, None
                if cut:
                    raise Damage("it is cut off")
                return None
        self.inflate = self.inflate or zlib.decompressobj(31)
        try:
            data = self.inflate.decompress(self.pending, BUFFER)
        except zlib.error as e:
            self.inflate, self.pending = None, self.pending[1:]
            raise Damage(f"its gzip member is damaged ({e})") from e
        done = self.inflate.eof
        self.pending = self.inflate.unused_data if done else self.inflate.unconsumed_tail
        self.inflate = None if done else self.inflate
        return data

    def _more(self) -> bytes:
        """The next decoded bytes; nothing at the end."""
        while (data := self._step()) == b"":
            pass
        return data or b""

    def settle(self) -> None:
        """Where a member's data has ended, go behind its end."""
        while self.inflate is not None and not self.left() and (data := self._step()) is not None:
            self.held, self.at = data, 0

    def head(self, limit: int = MAX_HEAD) -> bytes | None:
        """What comes before the next empty line, which is passed; None (and nothing passed) if there is none within ``limit`` bytes."""
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", self.at + max(0, seen - 3), self.at + limit)) < 0:
            seen = self.left()
            if seen >= limit or not (data := self._more()):
                return None
            self.held, self.at = self.held[self.at :] + data, 0
        out, self.at = self.held[self.at : end], end + 4
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            if not self.left():
                if not (data := self._more()):
                    raise Damage("it is cut off")
                self.held, self.at = data, 0
            parts.append(self.held[self.at : self.at + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        here = min(n, self.left())
        self.at += here
        n -= here
        if n and not self.compressed:
            self.raw.seek(n, io.SEEK_CUR)
            self.place += n
        while n and self.compressed:
            if not (data := self._more()):
                raise Damage("it is cut off")
            here = min(n, len(data))
            self.held, self.at = data, here
            n -= here

    def resync(self) -> bool:
        """Go on to what looks like a record: a version line behind an empty line, or behind damage a gzip member; False if there is none."""
        if self.compressed and self.inflate is None and not self.left():
            while (at := self.pending.find(_MEMBER)) < 0:
                if not (more := self._read()):
                    return False
                self.pending = self.pending[-2:] + more
            self.pending = self.pending[at:]
            return True
        mark = b"\r\n\r\n" + _VERSION
        while (at := self.held.find(mark, self.at)) < 0:
            kept = self.held[self.at :][-len(mark) + 1 :]
            try:
                data = self._more()
            except Damage:
                self.held, self.at = b"", 0
                return self.resync()
            if not data:
                return False
            self.held, self.at = kept + data, 0
        self.at = at + 4
        return True


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _size(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def _record(source: _Source, tests: list[tuple[str, str, object]], payload: bool, verify: bool) -> dict | None:
    """The next record as a dict of READ_SCHEMA's columns, empty if a test refuses it; None at the end."""
    while (head := source.head()) is not None and not head.strip():
        pass  # empty lines between records
    if head is None:
        if not source.held[source.at :].strip() and not source._more():
            return None
        raise Damage("it is cut off, or its head is too long")
    own = _headers(head)
    if not head.lstrip(b"\r\n").startswith(_VERSION):
        raise Damage("it does not begin with a version")
    if (length := _size(own.get("content-length"))) is None:
        raise Damage("it has no Content-Length")
    row = {c: own.get(h) for c, h in _HEADERS.items()}
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
    wanted = all(_passes(row, t) for t in tests)
    read, inner = 0, None
    if wanted and own.get("content-type", "").startswith("application/http"):
        if (first := source.head(min(length, MAX_HEAD))) is not None:
            read, inner = len(first) + 4, _headers(first)
    if wanted:
        row["content_type"] = own.get("content-type") if inner is None else inner.get("content-type")
        revisit = row["record_type"] == "revisit"
        row["payload_bytes"] = _size((inner or {}).get("content-length")) if revisit else length - read
    taken = wanted and payload and not revisit
    row["payload"] = source.take(length - read) if taken else source.skip(length - read)
    if source.take(4) != b"\r\n\r\n":
        raise Damage("it does not end where its Content-Length says")
    if taken and verify and row["payload_digest"] is not None and digest_of(row["payload"]) != row["payload_digest"]:
        raise Damage("it does not have the payload of its digest", passed=True)
    return row if wanted else {}


def first_record(raw, compressed: bool, start: int, end: int) -> int | None:
    """Where the first record in [start, end) of a file begins (in a gzip file the first member with one); None if none does.

    What looks like a record is one if it has a head, ends where it says, and another or the end of the file follows.
    """
    if start == 0:
        return 0
    mark, back = (_MEMBER, 0) if compressed else (b"\r\n\r\n" + _VERSION, 4)
    at, held = max(0, start - back), b""
    while at + back < end:
        if (found := held.find(mark)) < 0:
            raw.seek(at + len(held))
            if not (more := raw.read(BUFFER)):
                return None
            gone = max(0, len(held) - len(mark) + 1)
            at, held = at + gone, held[gone:] + more
            continue
        at, held = at + found, held[found:]
        source = _Source(raw, compressed, at + back)
        try:
            if at + back < end and _record(source, [], False, False) is not None and (compressed or not (rest := source.held[source.at :] + source._more()).strip() or rest.startswith(_VERSION)):
                return at + back
        except Damage:
            pass
        at, held = at + 1, held[1:]
    return None


def records(raw, compressed: bool, tests: list[tuple[str, str, object]] = (), payload: bool = True, verify: bool = False, *, start: int = 0, end: int | None = None, skip_damaged: bool = False) -> Iterator[dict]:
    """The records of an open file that pass all ``tests`` (kind, column, value), as dicts of READ_SCHEMA's columns.

    With ``end``, up to the first that begins there or later; those of one gzip member belong together.
    """
    source = _Source(raw, compressed, start)
    while True:
        begun = source.position()
        try:
            source.settle()
            if end is not None and source.position() >= end and not (compressed and source.left()):
                return
            row = _record(source, tests, payload, verify)
        except Damage as e:
            if not skip_damaged:
                raise ValueError(f"WARC record near byte {begun}: {e}") from e
            if not e.passed:
                source = source if compressed else _Source(raw, False, begun + 1)  # what it should have held may hold the next
                if not source.resync():
                    return
            continue
        if row is None:
            return
        if row:
            yield row


def _passes(row: dict, test: tuple[str, str, object]) -> bool:
    kind, column, value = test
    own = row[column]
    if kind == "null_safe":
        return own == value
    if own is None:
        return False
    return {"any": lambda: True, "equal": lambda: own == value, "in": lambda: own in value, "starts": lambda: own.startswith(value)}[kind]()


@dataclass
class _Range(InputPartition):
    path: str
    compressed: bool
    start: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names, self.tests = options["path"], schema.names, []
        self.verify = options.get("verify", "false").lower() == "true"
        self.skip_damaged = options.get("on_damage", "fail") == "skip"
        self.split = max(1, int(options.get("split_bytes", SPLIT_BYTES)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            kind = {EqualTo: "equal", EqualNullSafe: "null_safe", In: "in", StringStartsWith: "starts", IsNotNull: "any"}.get(type(f))
            if kind and column in _HEADERS:
                self.tests.append((kind, column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = pafs.FileSystem.from_uri(self.path)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if store.get_file_info(root).type != pafs.FileType.File else [store.get_file_info(root)]
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", f.base_name))
        return [_Range(n, n.endswith(".gz"), a, min(a + self.split, size)) for n, size in files for a in range(0, size, self.split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = pafs.FileSystem.from_uri(self.path)
        types = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in self.names], self.names)
        with store.open_input_file(partition.path) as raw:
            rows, held = [], 0
            start = first_record(raw, partition.compressed, partition.start, partition.end)
            if start is None:
                return
            for row in records(raw, partition.compressed, self.tests, "payload" in self.names, self.verify, start=start, end=partition.end, skip_damaged=self.skip_damaged):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or held > 8 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.compressed = options.get("compression", "gzip") == "gzip"
        self.max_bytes = int(options.get("max_file_bytes", MAX_FILE_BYTES))
        self.stage = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/{self.stage}", recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.select(list(WRITE_COLUMNS)).to_pylist():
                    if out is None or size >= self.max_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc{'.gz' * self.compressed}")
                        out, size = store.open_output_stream(f"{root}/{self.stage}/{names[-1]}", compression=None), 0
                    data = record_bytes(**row | {"payload": row["payload"] or b""})
                    data = _gzip(data) if self.compressed else data
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(pafs.FileSelector(root)):
                if re.search(r"\.warc(\.gz)?$", f.base_name):
                    store.delete_file(f.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda name: store.move(f"{root}/{self.stage}/{name}", f"{root}/{name}"), [n for m in messages if m for n in m.names]))
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{root}/{self.stage}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/{self.stage}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; a schema without ``payload`` decodes none."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, *, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Records (``WRITE_COLUMNS``) of ``pages`` (``page_id, url, html``; others ignored).

    Of pages with equal payloads of at least ``min_revisit_bytes``, the smallest page_id's is a response and the others
    revisit it; shorter payloads are all responses. A null html is the empty payload. Pages without a page_id are
    responses; rows that repeat the smallest page_id are responses each.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sum", F.sha1("payload"))
    firsts = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("sum").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sum", "first")
    # a payload that a third of all pages share is one key: AQE splits the large side of this join
    both = rows.join(firsts, "sum", "left")
    again = F.col("page_id").isNotNull() & F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return both.select(F.when(again, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.when(again, urn("first")).alias("refers_to_id"), "payload")


def page_of(column: str):
    """The page_id in a record id, null for pages without."""
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
