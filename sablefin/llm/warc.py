"""WARC: a converter of legacy ARC archives, and WARC writing and reading on the shared folder.

An ARC record is one header line and a block of the declared length. Version 1 lines have five
fields (URL, address, date, type, length), version 2 lines ten (URL, address, date, type, result
code, checksum, location, offset, file name, length). The converter trusts only the declared
length, and synthesises what WARC asks for: a record id (a UUID of the URL, date and digest),
an ISO date, the record type, block and payload digests.

Defined cases: a null page is an empty payload; a null id is kept as null and is never the one
referred to unless all of its group are null, in which case each is a response; repeated ids of
one payload are all responses; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.llm.shared import materialise, new_path, table

CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# Field names of the two versions' header lines.
V1 = ("url", "address", "date", "type", "length")
V2 = ("url", "address", "date", "type", "code", "checksum", "location", "offset", "file", "length")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> str:
    """White space and control characters would split a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def arc_record(version: int, url: str | None, date: str, block: bytes) -> bytes:
    head = [safe_url(url), "0.0.0.0", date, "text/html"]
    if version == 2:
        head += ["200", digest32(block), "-", "0", "-"]
    return " ".join([*head, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_version_block(version: int) -> bytes:
    names = "URL IP-address Archive-date Content-type " + ("Archive-length" if version == 1 else "Result-code Checksum Location Offset Filename Archive-length")
    body = f"{version} 0 sablefin\n{names}\n".encode()
    return f"filedesc://synthetic.arc 0.0.0.0 20000101000000 text/plain {'' if version == 1 else '200 - - 0 - '}{len(body)}\n".encode() + body + b"\n"


# Field patterns of a header line. A URL may hold spaces, and so may a type; address, date and length do not.
V1_LINE = re.compile(r"(.*\S) (\S+) ([0-9]{8,17}) (.*) ([0-9]+)")
V2_LINE = re.compile(r"(.*\S) (\S+) ([0-9]{8,17}) (.*) ([0-9]{3}|-) (\S+) (\S+) ([0-9]+|-) (\S+) ([0-9]+)")


def header(line: bytes, version: int | None) -> dict | None:
    """The fields of an ARC header line of a version, or of either; None if it is not one."""
    text = line.rstrip(b"\r\n").decode("utf-8", "replace")
    for number, names, pattern in ((2, V2, V2_LINE), (1, V1, V1_LINE)):
        if version in (None, number) and (m := pattern.fullmatch(text)):
            return dict(zip(names, (x.strip() for x in m.groups()), strict=True)) | {"version": number}
    return None


def parse_arc(stream) -> Iterator[dict]:
    """Records of an ARC stream; the filedesc record tells the version for all that follow.

    A record that cannot be used is given with what is wrong in error, and reading goes on: lines that are no
    header are passed over up to the next that is (one error for each such stretch), a block that ends early
    keeps what is there.
    """
    version, lost = None, 0
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        record = header(line, version) or (header(line, None) if line.startswith(b"filedesc:") else None)
        if record is None:
            if not lost:
                yield {"url": "", "address": "", "date": "", "type": "", "length": "0", "version": version or 0, "block": b"", "error": f"not an ARC header line: {line[:80]!r}"}
            lost += 1
            continue
        lost = 0
        size = int(record["length"])
        block = stream.read(size)
        error = "the block is shorter than declared" if len(block) < size else None
        if record["url"].startswith("filedesc:"):
            told = re.match(rb"([12]) ", block)
            version = int(told[1]) if told else record["version"]
            continue
        yield record | {"block": block, "error": error}


def iso_date(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_payload(block: bytes) -> bytes:
    if not block.startswith(b"HTTP/"):
        return block
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if at >= 0 else b""


def record_id(url: str, date: str, digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def warc_record(arc: dict, key: str, refers: tuple[str, str] | None = None) -> bytes:
    """One record: a response, or a revisit if refers has the key and URL of the one it repeats."""
    block, date = arc["block"], iso_date(arc["date"])
    payload = http_payload(block)
    digest = digest32(payload)
    is_http = block.startswith(b"HTTP/")
    kind = "revisit" if refers else "response" if is_http else "resource"
    if refers:
        block = block[: len(block) - len(payload)]
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(arc["url"], date, digest, key)),
        ("WARC-Date", date),
        ("WARC-Target-URI", arc["url"]),
        ("WARC-IP-Address", arc["address"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("WARC-Source-Key", key),
        ("WARC-Source-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response" if is_http else arc["type"]),
    ]
    if refers:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers[1], date, digest, refers[0])),
            ("WARC-Refers-To-Target-URI", refers[1]),
            ("WARC-Refers-To-Key", refers[0]),
        ]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*head, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines + CRLF + block + CRLF + CRLF


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Members(io.RawIOBase):
    """The plain bytes of a file of gzip members, read piece by piece."""

    def __init__(self, stream):
        self.stream, self.z, self.have, self.rest, self.begun = stream, zlib.decompressobj(31), b"", b"", False

    def fill(self) -> bool:
        data = self.rest or self.stream.read(1 << 20)
        self.rest = b""
        if not data:
            if self.begun:
                self.begun = False
                raise EOFError("a gzip member is cut off")
            return False
        self.begun = True
        self.have += self.z.decompress(data)
        if self.z.eof:
            self.rest, self.z, self.begun = self.z.unused_data, zlib.decompressobj(31), False
        return True

    def readline(self, size=-1) -> bytes:
        while b"\n" not in self.have and self.fill():
            pass
        at = self.have.find(b"\n") + 1 or len(self.have)
        out, self.have = self.have[:at], self.have[at:]
        return out

    def read(self, n=-1) -> bytes:
        while (n < 0 or len(self.have) < n) and self.fill():
            pass
        at = len(self.have) if n < 0 else n
        out, self.have = self.have[:at], self.have[at:]
        return out


def parse_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and blocks. A record that is not whole ends the reading with an error: archives are read as they were written, or again."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := stream.readline()) not in (CRLF, b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip()] = v.strip()
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]):
            raise ValueError("a WARC block is shorter than declared")
        yield head, block


def open_fs(uri: str):
    """A store by its URI: local files, or any that Arrow's connectors open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def write_archives(records: DataFrame, root: str, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write WARC files from rows (key, url, date, version, block parts); returns (path, records).

    A file's name has a fresh UUID, and readers follow the returned rows only: files of a failed
    or repeated attempt are never read.
    """

    def write(batches):
        store, base = open_fs(root)
        store.create_dir(base, recursive=True)
        out, n, size, path = None, 0, 0, ""
        done: list = []
        for batch in batches:
            for key, url, html, rkey, rurl in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html", "rkey", "rurl")), strict=True):
                version = 1 + (zlib.crc32((key or "").encode()) & 1)
                arc = arc_version_block(version) + arc_record(version, url, "20000101000000", HTTP + (html or "").encode("utf-8", "surrogatepass"))
                for record in parse_arc(io.BytesIO(arc)):
                    data = gzip_member(warc_record(record, key or "", None if rkey is None else (rkey, safe_url(rurl))))
                    if out is None:
                        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                        out, n, size = store.open_output_stream(path, compression=None), 0, 0
                    out.write(data)
                    n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return records.mapInArrow(write, "path string, records long")


def read_archives(paths: DataFrame, root: str) -> DataFrame:
    """Records of the archives in column path."""
    schema = "key string, url string, record_type string, payload_bytes long, payload_digest string, refers_key string, verified boolean"

    def read(batches):
        store, _ = open_fs(root)
        rows: list = []

        def flush():
            names = ["key", "url", "record_type", "payload_bytes", "payload_digest", "refers_key", "verified"]
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    for head, block in parse_warc(Members(f)):
                        payload = http_payload(block)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        full = head["WARC-Type"] != "revisit"
                        rows.append((
                            head["WARC-Source-Key"] or None, head["WARC-Target-URI"], head["WARC-Type"],
                            len(payload) if full else int(head["WARC-Source-Payload-Length"]),
                            digest32(payload) if full else digest, head.get("WARC-Refers-To-Key"),
                            digest32(block) == head["WARC-Block-Digest"].removeprefix("sha1:") and (not full or digest == digest32(payload)),
                        ))
                        if len(rows) >= 5000:
                            yield flush()
                            rows = []
        if rows:
            yield flush()

    return paths.mapInArrow(read, schema)


class Plain:
    """A stream with lines and reads of whole lengths, from one that may read less."""

    def __init__(self, stream):
        self.stream, self.have = stream, b""

    def fill(self) -> bool:
        data = self.stream.read(1 << 20)
        self.have += data
        return bool(data)

    readline, read = Members.readline, Members.read


def plain(stream, path: str):
    return Members(stream) if path.endswith(".gz") else Plain(stream)


def convert_archives(paths: DataFrame, root: str) -> DataFrame:
    """ARC files (column path; .gz or plain, either version) to WARC files under root: one row a record.

    (path, number, url, date, record_type, payload_bytes, payload_digest, warc, error). A record with an error is
    not written and has no warc; so is the rest of a file whose compressed data is broken, as one record.
    """
    names = ["path", "number", "url", "date", "record_type", "payload_bytes", "payload_digest", "warc", "error"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def convert(batches):
        target, base = open_fs(root)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, at = open_fs(path)
                to, rows = f"{base}/{uuid.uuid4().hex}.warc.gz", []
                with source.open_input_stream(at, compression=None) as f, target.open_output_stream(to, compression=None) as out:
                    records = parse_arc(plain(f, path))
                    while True:
                        try:
                            record = next(records, None)
                        except (zlib.error, EOFError, OSError) as e:
                            rows.append((path, len(rows), None, None, None, 0, None, None, f"broken data: {e}"))
                            break
                        if record is None:
                            break
                        if record["error"]:
                            rows.append((path, len(rows), record["url"], record["date"], None, len(record["block"]), None, None, record["error"]))
                            continue
                        payload = http_payload(record["block"])
                        record["url"] = safe_url(record["url"])
                        out.write(gzip_member(warc_record(record, f"{path}#{len(rows)}")))
                        kind = "response" if record["block"].startswith(b"HTTP/") else "resource"
                        rows.append((path, len(rows), record["url"], iso_date(record["date"]), kind, len(payload), digest32(payload), to, None))
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + 5000]], t) for c, t in enumerate(types)], names)

    schema = "path string, number long, url string, date string, record_type string, payload_bytes long, payload_digest string, warc string, error string"
    return paths.select("path").mapInArrow(convert, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages to archives and back: one row for each record read.

    Equal payloads (by length and SHA-1) of at least min_revisit_bytes: the largest page_id is the
    response, the others revisit it. Only keys and digests of repeated payloads are shuffled; that
    table is written first, so the planner knows its size and broadcasts it only if it is small.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = rows.withColumns({"sha": F.sha1(F.encode(payload, "UTF-8")), "size": F.octet_length(payload).cast("long")})
    repeated = (
        keyed.filter(F.col("size") >= min_revisit_bytes)
        .groupBy("sha", "size")
        .agg(F.max("page_id").alias("top"), F.max_by("url", "page_id").alias("rurl"), F.count("*").alias("n"))
        .filter("n > 1 and top is not null")
        .select("sha", "size", "top", "rurl")
    )
    repeated = materialise(repeated, "payloads")
    is_revisit = F.col("top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("top")))
    records = keyed.join(repeated, ["sha", "size"], "left").select(
        F.col("page_id").cast("string").alias("key"), "url", "html",
        F.when(is_revisit, F.col("top").cast("string")).alias("rkey"), F.when(is_revisit, F.col("rurl")).alias("rurl"),
    )
    root = new_path(spark, "warc")
    written = materialise(write_archives(records, root), "warc-files")
    return read_archives(written.repartition(max(1, written.count())), root)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(spark, table(spark, sf_dir, "pages"))
    return read.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_key").cast("long").alias("refers_to"), "url", "verified",
    )
