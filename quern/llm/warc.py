"""WARC archives: a writer and a sequential reader.

Each record is one gzip member. The reader inflates a file chunk by chunk with zlib, frames each record
by its Content-Length and hashes block and payload while they pass, so it holds one chunk of a record, never
an archive or, unless payloads are asked for, a payload, however long. Digests that a record gives
(WARC-Block-Digest, WARC-Payload-Digest; sha1, sha256, sha512 or md5, in base32 or hex) are verified; a record
whose digest doesn't match, that is cut short or longer than it says, raises ValueError.

Any record type is read. The payload is what follows the HTTP header in blocks of type application/http,
else the whole block; a block without an end of its HTTP header counts as payload whole. A record id that
isn't one of this writer's gives a null page_id; its text is in record_id. A record without a payload digest
gets the digest of the payload that was read (a revisit: null).

Files go where the shared folder is (any file system that open_fs() opens). A task writes files of
its own names and returns them; only files that successful tasks returned are read, so a task that is
lost or run twice does no harm.

Defined cases: a null payload counts as empty; equal payloads, the empty one too, have one response, that
of the largest id, and revisits; rows with that id and payload again are responses too; null ids are
smaller than any other and a revisit never refers to one unless all are null; a null URL is left out and
line ends in a URL are percent-encoded; an empty table gives no files and an empty table; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import open_fs, slices, small_batches
from quern.runtime import attach_groups, new_path, stage

#: Bytes after which a task begins a new file, and bytes read at a time.
FILE_BYTES, CHUNK = 256 << 20, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(name: str | None) -> int | None:
    """The id in a name that name_of() gives; None for any other."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Digest:
    """A digest as a header gives it ("sha1:..."), and bytes to be held against it."""

    def __init__(self, given: str | None, name: str = "sha1"):
        label, _, self.value = (given or "").partition(":")
        self.known = label.lower().replace("-", "") in ("sha1", "sha256", "sha512", "md5")
        self.hash = hashlib.new(label.lower().replace("-", "") if self.known else name)
        self.update = self.hash.update

    def agrees(self) -> bool:
        """Whether the bytes are those of the digest; an absent one, or one of another kind, isn't held against them."""
        raw = self.hash.digest()
        return not self.known or self.value.upper().rstrip("=") in (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper())


def record(page_id: int | None, url: str | None, payload: bytes, refers: tuple | None) -> bytes:
    """One gzip member. refers: None for a response, else (the response's page_id,)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {name_of(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers:
        head += [f"WARC-Refers-To: {name_of(refers[0])}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def fields_of(raw: bytes) -> dict[str, str]:
    """The fields of a header by lower-case name, its first line under ""; lines that begin with a space go on."""
    first, *lines = re.sub(r"\r\n[ \t]+", " ", raw.decode("utf-8", "replace")).split("\r\n")
    return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Inflated:
    """The records of an archive as a stream: bytes of the current gzip member only."""

    def __init__(self, source):
        self.source, self.raw, self.ready, self.unpack = source, b"", b"", None

    def more(self) -> bool:
        """Inflates some more of this member; False at its end."""
        while not self.unpack.eof:
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    raise ValueError("an archive ends inside a record")
            made = self.unpack.decompress(self.raw, CHUNK)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if made:
                self.ready += made
                return True
        return False

    def member(self) -> bool:
        """Goes to the next member; False at the archive's end."""
        self.raw = self.raw or self.source.read(CHUNK)
        self.unpack, self.ready = zlib.decompressobj(31), b""
        return bool(self.raw)

    def header(self, limit: int = 1 << 16) -> dict[str, str]:
        """Reads up to an empty line, which must come within `limit` bytes."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if len(self.ready) > limit or not self.more():
                raise ValueError("a header has no end")
        fields = fields_of(self.ready[:end])
        self.ready = self.ready[end + 4 :]
        return fields

    def block(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.more():
                raise ValueError("a record is cut short")
            part, self.ready = self.ready[:size], self.ready[size:]
            size -= len(part)
            yield part

    def finish(self) -> None:
        while self.more():
            if len(self.ready) > 4:
                break
        if self.ready != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")


def http_header(parts: Iterator[bytes], limit: int = 1 << 16) -> tuple[dict | None, Iterator[bytes]]:
    """The HTTP header at the beginning of a block, None if it has no end within `limit` bytes, and the rest."""
    held = b""
    for part in parts:
        held += part
        if (end := held.find(b"\r\n\r\n")) >= 0:
            return fields_of(held[:end]), chain([held[end + 4 :]], parts)
        if len(held) > limit:
            break
    return None, chain([held], parts)


def read_records(source, payloads: bool = False) -> Iterator[dict]:
    """Each record in file order, its digests verified; with payloads, the payload's bytes too."""
    stream = Inflated(source)
    while stream.member():
        head = stream.header()
        if not head[""].startswith("WARC/"):
            raise ValueError("not a WARC record")
        kind, name = head.get("warc-type", ""), head.get("warc-record-id")
        size = head.get("content-length", "")
        if not size.isdigit():
            raise ValueError(f"{name} has no length")
        whole, own = Digest(head.get("warc-block-digest")), Digest(head.get("warc-payload-digest"))
        parts, http = through(stream.block(int(size)), whole.update), None
        if head.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            http, parts = http_header(parts)
        kept, length = [], 0
        for part in parts:
            own.update(part)
            length += len(part)
            if payloads:
                kept.append(part)
        stream.finish()
        told = (http or {}).get("content-length", "")
        told = int(told) if told.isdigit() else length
        short = kind == "response" and told != length and "warc-truncated" not in head and "transfer-encoding" not in http
        if short or not whole.agrees() or kind != "revisit" and not own.agrees():
            raise ValueError(f"digest or length of {name} is wrong")
        made = None if kind == "revisit" else f"sha1:{base64.b32encode(own.hash.digest()).decode()}" if not own.known and own.hash.name == "sha1" else None
        yield {
            "page_id": id_of(name), "url": head.get("warc-target-uri"), "payload_bytes": told if kind == "revisit" else length, "payload_digest": (head.get("warc-payload-digest") or made or "").removeprefix("sha1:") or None,
            "record_type": kind, "refers_to": id_of(head.get("warc-refers-to")), "record_id": name, "payload": b"".join(kept) if payloads and kind != "revisit" else None,
        }


def through(parts: Iterator[bytes], see) -> Iterator[bytes]:
    for part in parts:
        see(part)
        yield part


def mark(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, url, html, is_revisit, refers): which rows have their payload in another record."""
    whole = F.coalesce(F.col(html), F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), url.alias("url"), whole.alias("html"), F.sha2(whole, 256).alias("payload_key"))
    groups = stage(rows.groupBy("payload_key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads")
    total = pages.count()
    told = attach_groups(rows, groups, "payload_key", "n", ["page_id", "payload_key"], total, how="left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return told.select("page_id", "url", "html", F.coalesce(revisit, F.lit(False)).alias("is_revisit"), F.col("first").alias("refers"))


def write(marked: DataFrame, folder: str) -> DataFrame:
    """Writes archives into a folder; one row (path, records, bytes) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, path, count, size = None, "", 0, 0
        done = []
        for batch in batches:
            for part in slices(batch, 2):
                for page_id, url, html, is_revisit, refers in zip(*[part.column(i).to_pylist() for i in range(5)]):
                    if out is None:
                        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        out, count, size = fs.open_output_stream(path, compression=None), 0, 0
                    made = record(page_id, url, html.encode(), (refers,) if is_revisit else None)
                    out.write(made)
                    count, size = count + 1, size + len(made)
                    if size >= FILE_BYTES:
                        out.close()
                        done.append((path, count, size))
                        out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return small_batches(marked).select("page_id", "url", "html", "is_revisit", "refers").mapInArrow(run, "path string, records long, bytes long")


def read(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of archives that write() returned, each file by one task from its start to its end."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), *([("payload", pa.binary())] if payloads else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                some, held = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=0) as source:
                    for r in read_records(source, payloads):
                        some.append(r)
                        held += len(r["payload"] or b"")
                        if len(some) == 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in some], t) for n, t in fields], names=[n for n, _ in fields])
                            some, held = [], 0
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in some], t) for n, t in fields], names=[n for n, _ in fields])

    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return files.select("path").mapInArrow(run, ", ".join(f"{n} {sql[t]}" for n, t in fields))


def archive_and_read(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes a record for each row into the shared folder, then reads all archives back."""
    folder = new_path(pages.sparkSession, "warc")
    files = stage(write(mark(pages), folder), "warc-files")
    n = max(1, files.count())
    return read(files.repartition(n), folder, payloads)
