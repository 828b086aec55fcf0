"""WARC: whole-file gzip streams made into files of one member for each record, with an offset index.

`monolithic` writes pages as WARC records in one gzip stream for each partition, which is what a crawler that
compresses whole files leaves behind. `normalised` inflates each such stream once, in bounded pieces, finds
the records by their Content-Length and writes each as a member of its own, so that a record can be read
from its offset alone; the offsets go into a sidecar (JSON lines, `<file>.idx`) and into the result.
A task holds a few pieces of `PIECE` bytes, whatever the size of its file or of a record. Files are written
under a temporary name and moved into place, so a task that is run again replaces what it left.
`read_back` fetches records by offset.

Defined results: a null or empty payload is a record of length 0 (an absent field is named in X-Absent, so
null and empty are told apart); null ids and addresses are left out of the header; repeated pages are
records of their own; streams of several members are read as one; an empty stream gives an empty file and
index; a damaged or cut stream gives the records before the damage and one row whose `error` says what
it was. Other columns of the pages are never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, record long, page_id long, target string, member_offset long, member_length long, payload_length long, payload_sha1 string, error string"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode("utf-8", "surrogatepass")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    absent = ", ".join(k for k, v in (("page_id", page_id), ("url", url), ("html", html)) if v is None)
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", "Content-Type: text/html"]
    head += [f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"X-Absent: {absent}"] if absent else []
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def monolithic(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One gzip stream for each partition; the result lists the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, base = _fs(out_dir)
        where.create_dir(base)
        name = f"{base}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        with _Moved(where, name) as out:
            pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    out.write(pack.compress(record(*row)))
            out.write(pack.flush())
        yield pa.record_batch([pa.array([name])], names=["file"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "file string")


class _Moved:
    """A file that takes its name when it is whole."""

    def __init__(self, where: pafs.FileSystem, name: str):
        self.where, self.name, self.part = where, name, f"{name}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.out = self.where.open_output_stream(self.part)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.where.move(self.part, self.name)
        else:
            self.where.delete_file(self.part)


class Stream:
    """Bytes of a gzip stream, inflated piece by piece across members."""

    def __init__(self, source):
        self.source, self.held, self.ended, self.error = source, bytearray(), False, ""
        self.unpack, self.rest = zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.ended:
            return False
        raw = self.rest or self.source.read(PIECE)
        try:
            if self.unpack.eof:
                raw = raw.lstrip(b"\0") if raw else raw  # padding between members
                self.unpack = zlib.decompressobj(31)
            if not raw:
                if not self.source.read(1):
                    self.ended = True
                    if self.started and not self.done:
                        self.error = "the stream is cut"
                return not self.ended
            self.held += self.unpack.decompress(raw, PIECE)
            self.rest = self.unpack.unconsumed_tail or self.unpack.unused_data
        except zlib.error as e:
            self.ended, self.error = True, str(e)
            return False
        self.started, self.done = True, self.unpack.eof
        return True

    started = done = False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """What stands before the mark, which is passed over."""
        at = 0
        while (i := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if len(self.held) > most or not self.more():
                return None
        got = bytes(self.held[:i])
        del self.held[: i + len(mark)]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes in pieces; fewer if the stream ends."""
        while n and (self.held or self.more()):
            got = bytes(self.held[:n])
            del self.held[: len(got)]
            n -= len(got)
            if got:
                yield got


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _records(stream: Stream, out, file: str) -> Iterator[tuple]:
    """Writes each record as a member and yields its index row."""
    at = n = 0
    while True:
        while not stream.held and stream.more():
            pass
        if not stream.held:
            break
        head = stream.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            yield (file, n, None, None, at, 0, 0, None, stream.error or "no record header")
            return
        fields = _fields(head)
        try:
            size = int(fields["content-length"])
        except (KeyError, ValueError):
            yield (file, n, None, None, at, 0, 0, None, "no content length")
            return
        pack, digest, wrote, got, held = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha1(usedforsecurity=False), 0, 0, []
        held.append(pack.compress(head + b"\r\n\r\n"))
        for piece in stream.take(size):
            digest.update(piece)
            got += len(piece)
            held.append(pack.compress(piece))
            if sum(map(len, held)) > PIECE:  # a long record isn't held whole
                wrote += sum(map(out.write, held))
                held = []
        if got < size:
            yield (file, n, None, None, at, 0, got, None, stream.error or "the stream is cut")
            return
        end = b"".join(stream.take(4))
        held.append(pack.compress(b"\r\n\r\n"))
        held.append(pack.flush())
        wrote += sum(map(out.write, held))
        page = fields.get("x-page-id")
        yield (file, n, int(page) if page and page.lstrip("-").isdigit() else None, fields.get("warc-target-uri"), at, wrote, size, digest.hexdigest(), None)
        at, n = at + wrote, n + 1
        if end != b"\r\n\r\n":
            yield (file, n, None, None, at, 0, 0, None, stream.error or "no end of record")
            return
    if stream.error:
        yield (file, n, None, None, at, 0, 0, None, stream.error)


def normalised(files: DataFrame, out_dir: str, file_col: str = "file") -> DataFrame:
    """One index row for each record of each file; files are spread over tasks one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _fs(out_dir)
        where.create_dir(base)
        for batch in batches:
            for source in batch.column("file").to_pylist():
                theirs, path = _fs(source)
                # the whole path in the name: files of the same name in different folders stay apart
                name = f"{base}/{hashlib.sha1(path.encode(), usedforsecurity=False).hexdigest()[:12]}-{path.rsplit('/', 1)[-1]}"
                rows = []
                with theirs.open_input_stream(path, compression=None) as raw, _Moved(where, name) as out, _Moved(where, f"{name}.idx") as side:
                    for row in _records(Stream(raw), out, name):
                        side.write((json.dumps(dict(zip(("file", "record", "page_id", "target", "offset", "length", "payload_length", "payload_sha1", "error"), row, strict=True))) + "\n").encode())
                        rows.append(row)
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    n = files.count()
    return files.select(F.col(file_col).alias("file")).distinct().repartition(max(1, n), "file").mapInArrow(run, INDEX)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["file", "record", "page_id", "target", "member_offset", "member_length", "payload_length", "payload_sha1", "error"]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def read_back(index: DataFrame) -> DataFrame:
    """page_id, url and html of the records of an index, each read at its offset alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            out: list[tuple] = []
            for f, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "member_offset", "member_length")), strict=True):
                if f != name:
                    where, path = _fs(f)
                    name, file = f, where.open_input_file(path)
                file.seek(at)
                head, _, body = zlib.decompress(file.read(size), 31).partition(b"\r\n\r\n")
                fields = _fields(head)
                absent, html = fields.get("x-absent", "").split(", "), body[: int(fields["content-length"])].decode("utf-8", "surrogatepass")
                page = fields.get("x-page-id")
                out.append((int(page) if page else None, fields.get("warc-target-uri"), None if "html" in absent else html))
                if len(out) >= 256:
                    yield _pages(out)
                    out = []
            yield _pages(out)

    return index.where("error is null").select("file", "member_offset", "member_length").mapInArrow(run, "page_id long, url string, html string")


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "html"])
