"""Web archives packed in ZIP files: written by tasks, and read by byte ranges without extraction.

A package holds stored (uncompressed) members: ``archive/data.warc.gz`` (each record a gzip member of its own),
``indexes/index.cdxj`` (a line of JSON for each record: where it lies in the archive) and ``datapackage.json``.
Paths are URIs or local paths; tasks open them with pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep

ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: A package is closed when it has so many bytes or records.
PACKAGE_BYTES, PACKAGE_RECORDS = 64 << 20, 100_000
#: Records that lie next to each other are fetched together, so many bytes at a time; indexes are read in such parts.
FETCH = 1 << 20
#: Signatures and lengths of ZIP structures, and the values that refer to the ZIP64 fields (fixed values).
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR64_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE, MOST_COMMENT = 22, 20, 56, 46, 30, 0xFFFF
FULL16, FULL32, EXTRA64, STORED = 0xFFFF, 0xFFFFFFFF, 1, 0
#: Profile of records that repeat a payload (fixed value).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:lectern:page:"

MEMBERS = "path string, member string, method int, start long, size long, error string"
RECORDS = "path string, start long, length long, type string, record_id string, url string, digest string, payload_bytes long, refers_to string, payload binary, error string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


# writing


def warc_record(kind: str, record: str, date: str, url: str | None, digest: str, payload: bytes, length: int, refers: str | None) -> bytes:
    """One record: a captured response, or a revisit, which has the response's HTTP headers (with the length of its
    payload) and no payload.  Control characters of a URL are escaped."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers is not None:
        head += [("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", SAME_PAYLOAD)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


class Package:
    """A package being written at a path; records go to the file as they come, index lines wait in memory."""

    def __init__(self, path: str):
        self.path, self.bytes, self.lines = path, 0, []
        system, place = _open(path)
        system.create_dir(posixpath.dirname(place), recursive=True)
        self._file = system.open_output_stream(place)
        self._zip = zipfile.ZipFile(self._file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._member = self._zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self._sum = hashlib.sha256()

    def add(self, record: bytes, **about: object) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = pack.compress(record) + pack.flush()
        self._member.write(data)
        self._sum.update(data)
        self.lines.append(json.dumps({**about, "offset": self.bytes, "length": len(data)}))
        self.bytes += len(data)

    def close(self) -> None:
        self._member.close()
        index = "".join(f"{line}\n" for line in self.lines).encode()
        self._zip.writestr(zipfile.ZipInfo(INDEX), index)
        parts = [{"path": ARCHIVE, "bytes": self.bytes, "hash": f"sha256:{self._sum.hexdigest()}"}, {"path": INDEX, "bytes": len(index), "hash": f"sha256:{hashlib.sha256(index).hexdigest()}"}]
        self._zip.writestr(zipfile.ZipInfo(ABOUT), json.dumps({"profile": "data-package", "resources": parts}))
        self._zip.close()
        self._file.close()


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z", most_bytes: int = PACKAGE_BYTES, most_records: int = PACKAGE_RECORDS) -> DataFrame:
    """Writes a WARC record for each row to packages in the folder, which executors share; returns the packages written: path,
    records, bytes (not evaluated yet: keep it once, or each evaluation writes packages anew).

    Of rows with equal payloads (UTF-8; null: empty) of at least ``least`` bytes, those with the smallest key are responses, and the others
    revisits of them, which have no payload; smaller ones are all responses.  Rows that share the smallest key are all
    responses; null keys count as larger than any.  Each task writes packages of bounded size under names of its own, so what a
    lost or repeated task leaves is named by no row.  Null URLs: no target.  No rows: no packages.  Other columns are not
    looked at, whatever their names.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("string").alias("id"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("length", F.octet_length("body").cast("long"))
    firsts = rows.where(F.col("length") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_d"), "first")
    told = rows.join(keep(firsts), F.col("digest") == F.col("_d"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    told = told.select("id", "url", "digest", "length", refers.alias("refers"), F.when(refers.isNull(), F.col("body")).cast("binary").alias("body"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            package.close()
            done.append((package.path, len(package.lines), package.bytes))

        for batch in batches:
            for name, link, digest, length, first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    package = Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                kind = "response" if first is None else "revisit"
                package.add(warc_record(kind, f"{RECORD_ID}{'' if name is None else name}", date, link, digest, data or b"", length, None if first is None else RECORD_ID + first), type=kind, url=link, digest=f"sha256:{digest}")
                if package.bytes >= most_bytes or len(package.lines) >= most_records:
                    close()
                    package = None
        if package is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return told.mapInArrow(write, "path string, records long, bytes long")


# reading


def _extra64(extra: bytes) -> bytes:
    """The ZIP64 field of an entry's extra fields."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            return extra[at + 4 : at + 4 + size]
        at += 4 + size
    return b""


def directory(read, size: int) -> list[tuple[str, int, int, int]]:
    """Name, method, first byte and size of each member, from the central directory (and ZIP64 directory), by ``read(start, length)``.
    Bytes before the package are allowed, as is a comment behind it."""
    tail_at = max(0, size - END_SIZE - MOST_COMMENT)
    tail = read(tail_at, size - tail_at)
    end = len(tail)
    while (end := tail.rfind(END, 0, end)) >= 0:
        if len(tail) - end >= END_SIZE and end + END_SIZE + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<H", tail, end + 10)[0], *struct.unpack_from("<LL", tail, end + 12)
    above = tail_at + end  # where the directory ends
    if FULL16 == count or FULL32 in (length, start):
        locator = read(above - LOCATOR64_SIZE, LOCATOR64_SIZE) if above >= LOCATOR64_SIZE else b""
        if locator[:4] == LOCATOR64:
            place = struct.unpack_from("<Q", locator, 8)[0]
            for at in (place, above - LOCATOR64_SIZE - END64_SIZE):  # the second where bytes stand before the package
                record = read(at, END64_SIZE)
                if record[:4] == END64:
                    break
            else:
                raise ValueError("no ZIP64 end of the directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
            above = at
    shift = above - length - start
    if shift < 0 or start + shift < 0:
        raise ValueError("the central directory lies outside of the file")
    entries, out, at = read(start + shift, length), [], 0
    for _ in range(count):
        if entries[at : at + 4] != ENTRY:
            raise ValueError("a broken entry of the central directory")
        method, packed, plain = struct.unpack_from("<H", entries, at + 10)[0], *struct.unpack_from("<LL", entries, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", entries, at + 28)
        local = struct.unpack_from("<L", entries, at + 42)[0]
        name = entries[at + ENTRY_SIZE : at + ENTRY_SIZE + n_name].decode("utf-8", "replace")
        wide = _extra64(entries[at + ENTRY_SIZE + n_name : at + ENTRY_SIZE + n_name + n_extra])
        values, nth = [], 0
        for v in (plain, packed, local):  # fields that don't fit stand in this order
            if v == FULL32:
                if len(wide) < nth + 8:
                    raise ValueError("a ZIP64 value is missing")
                v, nth = struct.unpack_from("<Q", wide, nth)[0], nth + 8
            values.append(v)
        head = read(values[2] + shift, LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        out.append((name, method, values[2] + shift + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26)), values[1]))
        at += ENTRY_SIZE + n_name + n_extra + n_comment
    return out


def package_members(packages: DataFrame, path: str = "path") -> DataFrame:
    """The members of packages: path, member, method, start, size.  A file that is no package gives one row with ``error``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                try:
                    system, place = _open(p)
                    with system.open_input_file(place) as f:
                        rows += [(p, *m, None) for m in directory(lambda at, n, f=f: f.read_at(n, at), f.size())]
                except (OSError, ValueError, struct.error) as e:
                    rows.append((p, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield _rows(rows, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), [c.split()[0] for c in MEMBERS.split(", ")])

    return packages.where(F.col(path).isNotNull()).select(path).mapInArrow(go, MEMBERS)


def _rows(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def package_index(members: DataFrame) -> DataFrame:
    """The records that the packages' indexes name: path, start (in the file) and length.  Indexes are read in parts, line by line.
    Only stored archives can be read by ranges: a compressed one, an index without its archive and a broken line give a row with ``error``."""
    archive = members.where(F.col("member") == ARCHIVE).select(F.col("path").alias("_p"), F.col("method").alias("a_method"), F.col("start").alias("a_start"), F.col("size").alias("a_size"))
    asked = members.where(F.col("member") == INDEX).join(archive, F.col("path") == F.col("_p"), "left").select("path", "method", "start", "size", "a_method", "a_start", "a_size")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, method, start, size, a_method, a_start, a_size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if method != STORED or a_method != STORED:
                    yield _entries([(p, None, None, "no stored archive beside the index" if a_method is None else "a compressed member can't be read by ranges")])
                    continue
                system, place = _open(p)
                with system.open_input_file(place) as f:
                    rest, at = b"", start
                    while at < start + size:
                        part = f.read_at(min(FETCH, start + size - at), at)
                        if not part:
                            break
                        at += len(part)
                        *lines, rest = (rest + part).split(b"\n")
                        yield _entries([_entry(p, line, a_start, a_size) for line in lines if line.strip()])
                    if rest.strip():
                        yield _entries([_entry(p, rest, a_start, a_size)])

    errors = members.where("error is not null").select("path", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("length"), "error")
    return asked.mapInArrow(go, "path string, start long, length long, error string").unionByName(errors)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, (pa.string(), pa.int64(), pa.int64(), pa.string()), ["path", "start", "length", "error"])


def _entry(path: str, line: bytes, start: int, size: int) -> tuple:
    try:
        about = json.loads(line[line.index(b"{") :])  # sort keys may stand before
        offset, length = int(about["offset"]), int(about["length"])
    except (ValueError, KeyError, TypeError):
        return path, None, None, "a broken line of the index"
    if offset < 0 or length <= 0 or offset + length > size:
        return path, None, None, "a record outside of its archive"
    return path, start + offset, length, None


def parse_record(data: bytes) -> tuple:
    """Of one gzip member: type, record id, URL, digest, length of the payload, refers to, payload (None in revisits)."""
    text = zlib.decompressobj(31).decompress(data)
    head, _, block = text.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = block[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    kind = named.get("warc-type")
    inner = lambda v: None if v is None else v.strip("<>")
    length = int(told[1]) if told else len(payload)
    return kind, inner(named.get("warc-record-id")), named.get("warc-target-uri"), named.get("warc-payload-digest"), length, inner(named.get("warc-refers-to")), None if kind == "revisit" else payload


def read_records(index: DataFrame, parts: int) -> DataFrame:
    """The records at the places of an index, with their payloads.  Places are dealt to ``parts`` ranges of (path, start), so that a
    large package is read by many tasks, each in the order of the file; neighbours are fetched together.  A record that can't
    be read, and an index row with an error, gives a row with ``error``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, held, held_at = None, None, b"", 0
        for batch in batches:
            rows, size = [], 0
            for p, start, length, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error is None:
                    try:
                        if p != now:
                            system, place = _open(p)
                            now, f, held, held_at = p, system.open_input_file(place), b"", 0
                        if not held_at <= start <= start + length <= held_at + len(held):
                            held, held_at = f.read_at(max(FETCH, length), start), start
                        kind, *rest, refers, payload = parse_record(held[start - held_at : start - held_at + length])
                        rows.append((p, start, length, kind, *rest, refers, payload, None))
                        size += len(payload or b"")
                    except (OSError, ValueError, KeyError, zlib.error) as e:
                        error = f"{type(e).__name__}: {e}"[:200]
                if error is not None:
                    rows.append((p, start, length, *[None] * 7, error))
                if size >= 8 * FETCH:
                    yield _records(rows)
                    rows, size = [], 0
            if rows:
                yield _records(rows)

    dealt = index.select("path", "start", "length", "error").repartitionByRange(parts, "path", "start").sortWithinPartitions("path", "start")
    return dealt.mapInArrow(go, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return _rows(rows, kinds, [c.split()[0] for c in RECORDS.split(", ")])
