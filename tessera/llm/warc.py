"""WARC writing and a reader that salvages damaged archives.

Each record is a gzip member of its own. The reader checks every member (length, CRC), the record's head, its block
length and its block digest. After a failed check it looks for the next member that decompresses, or in plain archives
for the next version line, goes on from there, and logs the bytes in between as a
quarantined gap with the reason. A member that holds several records, or a whole archive that is one member, gives them all. Files and members are read as streams: a task holds the rows of a batch,
one record, of LARGEST bytes at most, and a window of some megabytes, whatever the size of the file or the member.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, store

#: Fixed values of the format.
VERSION, MAGIC, END = b"WARC/1.1", b"\x1f\x8b\x08", b"\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 8 << 20
#: Bytes read at once; the longest head; the largest block of a record: a larger one, which a damaged length may pretend, is a gap.
WINDOW, HEAD, LARGEST = 4 << 20, 1 << 20, 1 << 30
#: Compressed bytes that are inflated at once; what is lost in front of damage inside a member.
STEP = 1 << 12
WHEN = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(number: int | None, url: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number}|{url}|{copy}')}>"


def clean_url(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(number: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, refers_url: str | None = None) -> bytes:
    """One response record, or a revisit whose block is the HTTP head of the payload that it leaves out."""
    url = clean_url(url)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(number, url)), ("WARC-Date", WHEN), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if number is not None:
        lines.append(("WARC-Page-ID", str(number)))
    if revisit:
        lines += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(refers_to, clean_url(refers_url))), ("WARC-Refers-To-Target-URI", clean_url(refers_url)), ("WARC-Refers-To-Date", WHEN)]
        lines += [("WARC-Refers-To-Page", str(refers_to))] if refers_to is not None else []
    lines.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + END


def member(data: bytes) -> bytes:
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


@dataclass
class Found:
    """A record, or with reason set a gap. Of the records of one member the last has its length, the others 0."""

    offset: int
    length: int
    fields: dict[str, str] | None = None
    block: bytes = b""
    reason: str | None = None

    def proved(self) -> bool:
        """Whether the record carries a digest that its block was held against."""
        return self.fields is not None and self.fields.get("warc-block-digest", "").startswith("sha1:")


class Window:
    """A part of a file that moves on: bytes before the place that was last let go are forgotten, and read again if they are asked for. size None: known once the file ends."""

    def __init__(self, file, size: int | None):
        self.file, self.size, self.base, self.data = file, float("inf") if size is None else size, 0, b""

    def load(self, at: int, n: int) -> bytes:
        """n bytes from at on, fewer at the end of the file."""
        if at < self.base:
            self.file.seek(at)
            self.base, self.data = at, b""
        missing = min(at + n, self.size) - self.base - len(self.data)
        if missing > 0:
            parts = [self.data]
            while missing > 0:
                more = self.file.read(int(max(missing, WINDOW)))
                if not more:
                    self.size = self.base + sum(map(len, parts))
                    break
                parts.append(more)
                missing -= len(more)
            self.data = b"".join(parts)
        return self.data[at - self.base : at - self.base + n]

    def let_go(self, at: int) -> None:
        if at - self.base > WINDOW or at - self.base > len(self.data) // 2:
            self.data, self.base = self.data[at - self.base :], min(at, self.base + len(self.data))

    def find(self, marks: tuple[bytes, ...], at: int) -> int:
        """The next place of any mark from at on, or the end of the file. What is passed over is forgotten."""
        longest = max(map(len, marks))
        while at < self.size:
            part = self.load(at, WINDOW)
            spots = [p for p in map(part.find, marks) if p >= 0]
            if spots:
                return at + min(spots)
            at += max(1, len(part) - longest + 1) if at + len(part) < self.size else len(part)
            self.let_go(at)
        return at


class Inflated:
    """The bytes of the gzip member at `at` of a window, as a file that is read once. Damage shows when all bytes in front of it have been read."""

    def __init__(self, window: Window, at: int):
        self.window, self.at, self.reader, self.damage = window, at, zlib.decompressobj(31), None

    def read(self, n: int) -> bytes:
        out, size = [], 0
        while size < n and not self.reader.eof and self.damage is None:
            try:
                piece = self.reader.unconsumed_tail
                if not piece:
                    piece = self.window.load(self.at, STEP)
                    self.at += len(piece)
                    self.window.let_go(self.at)
                if not piece:
                    raise ValueError("member cut short")
                out.append(self.reader.decompress(piece, n - size))
                size += len(out[-1])
            except (ValueError, zlib.error) as e:
                self.damage = e
        if self.damage is not None and not size:
            raise self.damage
        return b"".join(out)

    @property
    def end(self) -> int:
        """Where the member ends, once it is read."""
        return self.at - len(self.reader.unused_data)


def parse(source: Window | bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The fields, the block and the end of the record at `at`; ValueError says what is wrong."""
    window = Window(io.BytesIO(source), len(source)) if isinstance(source, bytes) else source
    if window.load(at, 5) != b"WARC/":
        raise ValueError("no version line")
    head = window.load(at, 4096)
    while (stop := head.find(END)) < 0 and len(head) < HEAD and at + len(head) < window.size:
        head = window.load(at, 4 * len(head))
    if stop < 0:
        raise ValueError("head without end")
    fields = {}
    for line in head[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad head line")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no content length") from None
    begin = at + stop + 4
    end = begin + size
    if size < 0 or end > window.size:
        raise ValueError("block cut short")
    if size > LARGEST:
        raise ValueError("block too large")
    whole = window.load(begin, size + 4)
    block = whole[:size]
    if len(block) < size:
        raise ValueError("block cut short")
    if whole[size:] != END:
        raise ValueError("no end mark after block")
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        raise ValueError("block digest differs")
    return fields, block, end + 4


def _more(window: Window, at: int) -> int | None:
    """The next place that is no white space, None at the end."""
    while part := window.load(at, 4096):
        if rest := part.lstrip():
            return at + len(part) - len(rest)
        at += len(part)
        window.let_go(at)
    return None


def _member(offset: int, window: Window) -> Iterator[Found]:
    """Records and gaps of one inflated member, all without length; ValueError if there is no record in it, and what inflating raises once what comes before the damage is through."""
    pos, why, found = 0, None, 0
    while found == 0 or _more(window, pos) is not None:
        try:
            pos = pos if found == 0 else _more(window, pos)
            fields, block, end = parse(window, pos)
        except ValueError as e:
            why = why or str(e)
            pos = window.find((b"WARC/1.",), pos + 1)
            if pos >= window.size:
                break
            continue
        if why:
            yield Found(offset, 0, reason=f"in a member: {why}")
            why = None
        yield Found(offset, 0, fields, block)
        pos, found = end, found + 1
        window.let_go(pos)
    if not found:
        raise ValueError(why or "member without record")
    if why:
        yield Found(offset, 0, reason=f"in a member: {why}")


def salvage(source: bytes | Window) -> Iterator[Found]:
    """Records and gaps of one archive, in order; together they cover it without overlap.

    A member's records come as they are inflated. If a member turns out damaged, those in front of the damage (STEP bytes or more) stay, the last of them only if its own digest proves it, and the member's bytes
    up to the next valid member or version line are a gap.
    """
    window = Window(io.BytesIO(source), len(source)) if isinstance(source, bytes) else source
    at, gap, why = 0, None, ""
    while at < window.size:
        held, error = [], None
        try:
            if window.load(at, 3) == MAGIC:
                member = Inflated(window, at)
                for found in _member(at, Window(member, None)):
                    if found.fields is not None and any(x.fields is not None for x in held):
                        if gap is not None:
                            yield Found(gap, at - gap, reason=why)
                            gap = None
                        yield from held
                        held = []
                    held.append(found)
                end = member.end
            else:
                fields, block, end = parse(window, at)
                held = [Found(at, 0, fields, block)]
        except (ValueError, zlib.error) as e:
            error, held = e, [x for x in held if x.reason or x.proved()] if any(x.proved() for x in held) else []
        if gap is not None and held:
            yield Found(gap, at - gap, reason=why)
            gap = None
        for x in held:
            x.length = end - at if error is None and x.fields is not None else 0
            yield x
        if error is None:
            at = end
            window.let_go(at)
        else:
            if gap is None:
                gap, why = at, str(error)
            at = window.find((MAGIC, b"WARC/1."), at + 1)
    if gap is not None:
        yield Found(gap, window.size - gap, reason=why)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages into gzip archives in folder; the result lists (path, records, bytes).

    Of equal payloads of at least least_bytes the row with the largest id is written as response, others as revisit records
    that name it. A null payload is empty, a null id is below all others, and of rows that share the largest id and the payload all are responses. A long payload is
    one record, held whole by its task with the archive that it closes. Columns other than the three play no part; no rows make an empty folder. An archive
    gets its name once it is complete; a repeated task writes its own files and only those that it lists are read.
    """
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    page = page.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    files, base = _hadoop(pages.sparkSession, folder)
    files.mkdirs(base)
    # Stored, so that the rows of one payload can be dealt over several tasks of the join.
    newest = store(page.groupBy("sha").agg(F.max(F.struct("id", "url")).alias("newest")), "warc-newest")
    rows = page.join(newest, "sha").select("id", "url", "html", F.col("newest.id").alias("newest"), F.col("newest.url").alias("newest_url"))
    return store(rows.mapInArrow(_writer(folder, least_bytes), "path string, records long, bytes long"), "warc-list", newest)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _writer(folder: str, least_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        buffer, records, listed = io.BytesIO(), 0, []

        def close():
            nonlocal buffer, records
            if records:
                path = f"{base}/{name}-{len(listed):05d}.warc.gz"
                with files.open_output_stream(f"{path}.part") as out:
                    out.write(buffer.getbuffer())
                files.move(f"{path}.part", path)
                listed.append((f"{name}-{len(listed):05d}.warc.gz", records, buffer.tell()))
            buffer, records = io.BytesIO(), 0

        for batch in batches:
            for number, url, html, newest, newest_url in zip(*(batch.column(c) for c in ("id", "url", "html", "newest", "newest_url")), strict=True):
                payload, number, newest = html.as_py().encode(), number.as_py(), newest.as_py()
                old = len(payload) >= least_bytes and number != newest
                buffer.write(member(record(number, url.as_py(), payload, newest if old else None, old, newest_url.as_py())))
                records += 1
                if buffer.tell() >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in listed], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], ["path", "records", "bytes"])

    return write


FIELDS = "path string, offset long, length long, reason string, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                files, name = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                rows, held = [], 0
                with files.open_input_file(name) as stream:
                    for found in salvage(Window(stream, size)):
                        rows.append((path, found.offset, found.length, found.reason, *_described(found, with_payload)))
                        held += len(found.block) if with_payload else 0
                        if len(rows) >= 500 or held > WINDOW:
                            yield _rows(rows)
                            rows, held = [], 0
                yield _rows(rows)

    return read


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names = [f.split() for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])


def _described(found: Found, with_payload: bool) -> tuple:
    if found.fields is None:
        return (None,) * 8
    head, _, payload = found.block.partition(END)
    number = lambda key: int(v) if (v := found.fields.get(key, "")).lstrip("-").isdigit() else None
    kind, said = found.fields.get("warc-type"), found.fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        payload = b""
    else:
        size, said = len(payload), digest(payload)
    return kind, found.fields.get("warc-record-id"), found.fields.get("warc-target-uri"), number("warc-page-id"), number("warc-refers-to-page"), said, size, payload if with_payload else None


def read_archives(spark: SparkSession, paths: str | list[str], with_payload: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives under paths, plain or compressed by member.

    records have the head's fields, the payload's digest and size (of a revisit: as its head states them) and, if asked for, the
    payload. gaps(path, offset, length, reason) are the bytes that belong to no valid record; a gap inside a member has its offset and no length. An empty file
    has neither, nor has an empty folder. Without payloads the archives are read at once and their records stored. Repeated records all count, so there are no ties; a long one is held whole by its task.
    """
    # Only the list of files comes from Spark; each file is one row, and files are dealt over the tasks by their bytes.
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(paths).select("path", "length")
    read = found.repartitionByRange(max(1, min(found.count(), 4 * spark.sparkContext.defaultParallelism)), "path").mapInArrow(_reader(with_payload), FIELDS)
    rows = read if with_payload else store(read, "warc-records")
    return rows.where("reason is null").drop("reason", *([] if with_payload else ["payload"])), rows.where("reason is not null").select("path", "offset", "length", "reason")


def archive_folder(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/tessera/warc-{uuid.uuid4().hex}"
    return folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
