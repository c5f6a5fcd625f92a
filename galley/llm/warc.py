"""Web archives: writing and parsing of ARC and WARC files, and conversion of the former into the latter.

Every record is a gzip member of its own, made in the worker; Spark's text writer puts members one after another (what
it writes between two of them is an empty member), and its binary reader reads them, so any store that Spark reaches
will do.  Records are found by their declared lengths only, and a file is inflated a member or a chunk at a time.

A conversion reads the archives twice.  The first pass leaves an index of records without their payloads, from which
it is decided what revisits what; revisits have no payload and are written from the index.  The second pass writes the
other records file by file and needs only to know which records of a file to leave out.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import by_group, estimated_bytes, materialize, new_path, sub_batches

#: Bytes of input for one archive file at most, where the input's own partitions are larger.
ARCHIVE_BYTES = 32 << 20
REVISIT_BYTES = 100
#: What the second pass is told of revisits is broadcast up to this size, and joined by file beyond it.
TOLD_BYTES = 32 << 20
LEVEL = 2
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace for URLs
_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_NOTHING = member(b"")


def _write(members: DataFrame, path: str) -> None:
    """Files of the gzip members in the column ``value``."""
    members.write.option("encoding", "ISO-8859-1").option("lineSep", _NOTHING.decode("latin-1")).option("compression", "none").text(path)


def _members(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([member(r) for r in records], pa.binary()).view(pa.string())], names=["value"])  # bytes as they are: the writer doesn't look at them


class Inflated:
    """The content of a plain or gzipped file (of one or many members), inflated as it is read."""

    def __init__(self, content: bytes):
        self.raw, self.at, self.zipped = memoryview(content), 0, content[:2] == b"\x1f\x8b"
        self.held, self.pos, self.offset = bytearray(), 0, 0
        self.member, self.z, self.step = 0, None, 0

    def _more(self) -> bool:
        if self.pos > 1 << 20 or self.pos == len(self.held):
            del self.held[: self.pos]
            self.pos = 0
        if self.z is None:
            if not self.held:
                self.member = self.at
            rest = self.raw[self.at : self.at + 2]
            if self.zipped and rest and rest != b"\x1f\x8b":
                if any(self.raw[self.at :]):
                    raise ValueError(f"offset {self.at}: not a gzip member")
                return False  # padding
            if not rest:
                return False
            self.z, self.step = zlib.decompressobj(31) if self.zipped else True, 2048
        chunk = self.raw[self.at : self.at + self.step]
        self.at, self.step = self.at + len(chunk), min(2 * self.step, 1 << 20)
        if not self.zipped:
            self.held += chunk
            return len(chunk) > 0
        if not len(chunk):
            raise ValueError(f"offset {self.at}: the file ends within a gzip member")
        try:
            self.held += self.z.decompress(chunk)
        except zlib.error as e:
            raise ValueError(f"offset {self.at}: {e}") from e
        if self.z.eof:
            self.at -= len(self.z.unused_data)
            self.z = None
        return True

    def until(self, stop: bytes) -> bytes | None:
        """What comes before ``stop``, which is passed over; None if it doesn't come."""
        seen = 0
        while (found := self.held.find(stop, self.pos + max(0, seen - len(stop)))) < 0:
            seen = len(self.held) - self.pos
            if not self._more():
                return None
        out = bytes(self.held[self.pos : found])
        self.offset += found + len(stop) - self.pos
        self.pos = found + len(stop)
        return out

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None if there are fewer."""
        while len(self.held) - self.pos < n:
            if not self._more():
                return None
        out = bytes(self.held[self.pos : self.pos + n])
        self.pos, self.offset = self.pos + n, self.offset + n
        return out

    def ends(self) -> bool:
        while self.pos == len(self.held):
            if not self._more():
                return True
        return False

    def skip(self, ends: bytes) -> None:
        """Pass over bytes of ``ends``."""
        while not self.ends() and self.held[self.pos] in ends:
            self.pos, self.offset = self.pos + 1, self.offset + 1


def arc_record(version: int, url: str, date: str, payload: bytes, page_id: int | None, ip: str = "0.0.0.0", name: str = "-", offset: int = 0) -> bytes:
    """A record of ARC version 1 or 2: its header line and the HTTP response, without the newline that ends a record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id) + b"Content-Length: %d\r\n\r\n" % len(payload)
    body = http + payload
    url = quote(url, safe="%/:=&?~#+!$,;'@()*[]") or "-"
    head = f"{url} {ip} {date} text/html {len(body)}" if version == 1 else f"{url} {ip} {date} text/html 200 {hashlib.md5(body).hexdigest()} - {offset} {name} {len(body)}"
    return head.encode() + b"\n" + body


def arc_start(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 galley\n{_FIELDS[version]}\n".encode()
    rest = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{rest} {len(body)}\n".encode() + body


def parse_arc(data: bytes, damaged: str = "raise") -> Iterator[dict]:
    """Records of an ARC file: url, ip, date (14 digits), type, offset and content.

    ``damaged``: ``raise`` a ValueError where the file is damaged, or ``keep`` what can't be read, up to the next header
    line, as a record of the type ``damaged``.
    """
    source, names, lost, lost_at = Inflated(data), None, [], 0

    def found_damage(at: int, why: str, content: bytes) -> None:
        nonlocal lost_at
        if damaged == "raise":
            raise ValueError(f"offset {at}: {why}")
        lost_at = lost_at if lost else at
        lost.append(content)

    def flush() -> Iterator[dict]:
        if lost:
            yield {"url": "-", "ip": "0.0.0.0", "date": "", "type": "damaged", "offset": lost_at, "content": b"\n".join(lost)}
            lost.clear()

    while True:
        source.skip(b"\n")
        if source.ends():
            break
        at = source.offset
        line = source.until(b"\n")
        if line is None:
            found_damage(at, "a header line without an end", source.take(len(source.held) - source.pos) or b"")
            break
        fields = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        if names is None and not fields[0].startswith("filedesc://"):
            raise ValueError("an ARC file starts with a version block")
        if names is not None and len(fields) != len(names):
            found_damage(at, f"{len(fields)} fields in a header line of {len(names)}", line)
            continue
        content = source.take(int(fields[-1])) if fields[-1].isdecimal() and len(fields[-1]) < 16 else None
        if content is None:
            found_damage(at, f"the declared length {fields[-1]!r} doesn't fit the file", line)
            continue
        record = {"url": fields[0], "ip": fields[1], "date": fields[2], "type": fields[3], "offset": at, "content": content}
        if names is None:  # the version block says what fields a header line has
            first, named = (content.decode("utf-8", "replace").split("\n") + [""])[:2]
            if first.split(" ")[0] not in ("1", "2"):
                raise ValueError(f"ARC version {first.split(' ')[0]!r}")
            names = named.strip().split(" ")
        yield from flush()
        yield record
    yield from flush()


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP message; no head if there is none."""
    if b"HTTP/" not in content[: content.find(b"\n") + 1 or 16]:
        return b"", content
    found = [(content.find(sep), len(sep)) for sep in (b"\r\n\r\n", b"\n\n")]
    found = [(i + n) for i, n in found if i >= 0]
    cut = min(found) if found else len(content)
    return content[:cut], content[cut:]


def warc_record(kind: str, url: str, date: str, record_id: str, head: bytes, payload: bytes, digest: str, n_payload: int, extra: dict[str, str]) -> bytes:
    """A WARC 1.1 record without the two line ends that follow it. A revisit's block is the HTTP head alone."""
    block = head if kind == "revisit" else head + payload
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response" if head else "application/octet-stream"}
    fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "X-Payload-Length": str(n_payload)} | extra | {"Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block


def header_fields(head: str) -> dict[str, str]:
    """Fields of a record's header by name in lower case; a line that starts with white space goes on with the one before."""
    lines: list[str] = []
    for line in head.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    named = (x.partition(":") for x in lines if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in named}


#: Digest algorithms that archives name, and the bytes of their digests.
_ALGORITHMS = {"sha256": 32, "sha1": 20, "md5": 16, "sha512": 64}


def read_digest(said: str) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a labelled digest, in base 16 or 32; none for one of another kind."""
    name, _, value = said.strip().partition(":")
    name = name.lower().replace("-", "")
    size = _ALGORITHMS.get(name)
    try:
        raw = bytes.fromhex(value) if size and len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return (name, raw) if len(raw) == size else None


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(fields with names in lower case, block, where in the file the record's gzip member begins) of the records of a WARC file."""
    source = Inflated(data)
    while True:
        source.skip(b"\r\n")
        if source.ends():
            return
        at, begin = source.offset, source.member
        head = source.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError(f"offset {at}: no WARC record")
        fields = header_fields(head.decode("utf-8", "replace"))
        said = fields.get("content-length", "")
        block = source.take(int(said)) if said.isdecimal() and len(said) < 16 else None
        if block is None:
            raise ValueError(f"offset {at}: the declared length {said!r} doesn't fit the file")
        yield fields, block, begin


def iso_date(digits: str) -> str:
    """A WARC date of an ARC date; missing digits are the earliest, and a date that is none becomes 1970."""
    d = digits if digits.isdigit() and 4 <= len(digits) <= 14 else "19700101000000"
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def write_arcs(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20240101000000") -> None:
    """Gzipped ARC files of pages, version 1 from even partitions and 2 from odd ones; null payloads count as empty.

    A payload may be text, written in UTF-8, or binary, written as it is.
    """
    source = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("binary").alias("__payload"))
    if estimated_bytes(source) >= 1 << 50:  # unknown: what is written has a size
        source = materialize(source, "pages")
    size, parts = estimated_bytes(source), source.rdd.getNumPartitions()
    if size > parts * ARCHIVE_BYTES:
        source = source.repartition(-(-size // ARCHIVE_BYTES))

    def run(batches):
        n = TaskContext.get().partitionId()
        version, name, offset, first = 1 + n % 2, f"part-{n:06d}.arc", 0, True
        for batch in batches:
            for part in sub_batches(batch, "__payload"):
                out = []
                for page, url, payload in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if first:
                        out.append(arc_start(version, name, date) + b"\n")
                        offset, first = len(out[0]), False
                    out.append(arc_record(version, url or "", date, payload or b"", page, name=name, offset=offset) + b"\n")
                    offset += len(out[-1])
                yield _members(out)

    ship(pages.sparkSession)
    _write(source.mapInArrow(run, "value string"), path)


_READ = "path string, n int, offset long, url string, ip string, date string, type string, head binary, page_id long, n_payload long, digest string"


def _arcs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _records(content: bytes, damaged: str) -> Iterator[tuple]:
    """(number in the file, record, HTTP head, payload, page identifier) of an ARC file but for its version block."""
    for n, r in enumerate(parse_arc(content, damaged)):
        if r["url"].startswith("filedesc://"):
            continue
        head, payload = split_http(r["content"])
        page = next((int(x[11:]) for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id: ") and x[11:].strip().lstrip(b"-").isdigit()), None)
        yield n, r, head, payload, page


def _text(raw: str) -> str:
    """A field of a record's header line, as it can stand in a WARC field."""
    return raw.replace("\r", "%0D").replace("\n", "%0A")


def read_arcs(spark: SparkSession, path: str, damaged: str = "raise") -> DataFrame:
    """Index of the records of all files of a folder, whatever their names, without payloads but with their digest and length."""
    kinds = (pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.int64(), pa.string())
    names = [x.split(" ")[0] for x in _READ.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, rows = batch.column(0)[i].as_py(), []
                for n, r, head, payload, page in _records(batch.column(1)[i].as_py(), damaged):
                    rows.append((file, n, r["offset"], _text(r["url"]), r["ip"], r["date"], r["type"], head, page, len(payload), hashlib.sha256(payload).hexdigest()))
                    if len(rows) == 5000:
                        yield _batch(rows, kinds, names)
                        rows = []
                if rows:
                    yield _batch(rows, kinds, names)

    ship(spark)
    return _arcs(spark, path).mapInArrow(run, _READ)


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def record_id(file: str, offset: int, url: str, date: str, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMES, f'{file} {offset} {url} {date} {digest}')}"


def revisits(index: DataFrame) -> DataFrame:
    """The rows of an index that revisit another, with its path, offset, url and date as f_path and so on."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset", "url", "date")
    large = index.where(F.col("n_payload") >= REVISIT_BYTES)
    groups = large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("__n")).where("__n > 1")
    known = groups.select("digest", "__n", *[F.col(f"first.{c}").alias(f"f_{c}") for c in ("path", "offset", "url", "date")])
    return by_group(large, materialize(known, "groups"), ["digest"]).where("not (path = f_path and offset = f_offset)")


def convert(spark: SparkSession, arcs: str, warcs: str, damaged: str = "raise") -> None:
    """WARC files of the records of ARC files, with synthesised identifiers, dates, types and digests.

    Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the smallest page identifier (then file
    and offset) is a response and the others revisit it; a record whose type is not HTTP is a resource.
    """
    index = materialize(read_arcs(spark, arcs, damaged), "records")
    later = materialize(revisits(index), "revisits")

    def again(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                out = []
                for r in batch.slice(i, 2000).to_pylist():
                    own, first = (record_id(r[f"{f}path"], r[f"{f}offset"], r[f"{f}url"], r[f"{f}date"], r["digest"]) for f in ("", "f_"))
                    extra = {} if r["page_id"] is None else {"X-Page-Id": str(r["page_id"])}
                    extra |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{first}>", "WARC-Refers-To-Target-URI": r["f_url"], "WARC-Refers-To-Date": iso_date(r["f_date"])}
                    out.append(warc_record("revisit", r["url"], iso_date(r["date"]), own, r["head"], b"", r["digest"], r["n_payload"], extra) + b"\r\n\r\n")
                yield _members(out)

    def whole(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, left_out, out, held = batch.column(0)[i].as_py(), set(batch.column(2)[i].as_py() or ()), [], 0
                for n, r, head, payload, page in _records(batch.column(1)[i].as_py(), damaged):
                    if n in left_out:
                        continue
                    digest, url = hashlib.sha256(payload).hexdigest(), _text(r["url"])
                    extra = {} if page is None else {"X-Page-Id": str(page)}
                    out.append(warc_record("response" if head else "resource", url, iso_date(r["date"]), record_id(file, r["offset"], url, r["date"], digest), head, payload, digest, len(payload), extra) + b"\r\n\r\n")
                    held += len(out[-1])
                    if held > 8 << 20:
                        yield _members(out)
                        out, held = [], 0
                if out:
                    yield _members(out)

    told = later.groupBy("path").agg(F.sort_array(F.collect_list("n")).alias("left_out"))  # at most a file's records
    size = later.agg(F.count("*"), F.count_distinct("path")).first()
    if 4 * size[0] + 200 * size[1] <= TOLD_BYTES:
        told = F.broadcast(told)
    ship(spark)
    files = _arcs(spark, arcs).join(told, "path", "left").select("path", "content", "left_out")
    _write(files.mapInArrow(whole, "value string"), f"{warcs}/records")
    _write(later.mapInArrow(again, "value string"), f"{warcs}/revisits")


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """Index of the records of all files of a folder: (record_id, refers_to_id, page_id, record_type, payload_bytes, payload_digest, path, member, url, declared_digest).

    Records of any writer and type.  The payload of a response and of a request is what follows the HTTP head, of other records
    the block; its length and SHA-256 (bare hex) are computed, and a declared digest in SHA-256, SHA-1, SHA-512 or MD5, base 16 or 32,
    must agree.  A revisit has no payload here: its digest is the declared one, if that is SHA-256, and its length what the
    record says, else null.  ``declared_digest`` is as it is written.  ``member`` says where in the file the record's gzip member begins.
    """
    schema = "record_id string, refers_to_id string, page_id long, record_type string, payload_bytes long, payload_digest string, path string, member long, url string, declared_digest string"
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = [x.split(" ")[0] for x in schema.split(", ")]
    number = lambda said: int(said) if said is not None and said.lstrip("-").isdecimal() and len(said) < 19 else None

    def row(file: str, fields: dict[str, str], block: bytes, begin: int) -> tuple:
        kind, said, size = fields.get("warc-type", ""), fields.get("warc-payload-digest"), number(fields.get("x-payload-length"))
        known = read_digest(said) if said else None
        if kind == "revisit":
            digest = known[1].hex() if known and known[0] == "sha256" else None
        else:
            payload = split_http(block)[1] if kind in ("response", "request") else block
            digest = hashlib.sha256(payload).hexdigest()
            if (known and hashlib.new(known[0], payload).digest() != known[1]) or (size is not None and len(payload) != size):
                raise ValueError(f"{fields.get('warc-record-id')}: the payload isn't what its digest says ({digest})")
            size = len(payload)
        return fields.get("warc-record-id"), fields.get("warc-refers-to"), number(fields.get("x-page-id")), kind, size, digest, file, begin, fields.get("warc-target-uri"), said

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, rows = batch.column(0)[i].as_py(), []
                for found in parse_warc(batch.column(1)[i].as_py()):
                    rows.append(row(file, *found))
                    if len(rows) == 5000:
                        yield _batch(rows, kinds, names)
                        rows = []
                if rows:
                    yield _batch(rows, kinds, names)

    ship(spark)
    return _arcs(spark, path).mapInArrow(run, schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages to ARC files, these to WARC files, and an index of what the latter hold: one row per input row.

    (page_id, payload_bytes, payload_digest, record_type, refers_to).  Null payloads count as empty, null addresses are
    written as ``-``.  Repeated identifiers are told apart by their place; a null identifier stays null and is never
    referred to while its group has another.  An empty table gives no row; other columns are ignored.
    """
    spark = pages.sparkSession
    arcs, warcs = new_path(spark, "arcs"), new_path(spark, "warcs")
    write_arcs(pages, arcs, id_col, url_col, payload_col)
    convert(spark, arcs, warcs)
    index = materialize(read_warcs(spark, warcs), "index")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    later = index.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id"), *columns)
    asked = later.groupBy("record_id").agg(F.count("*").alias("__n"))
    targets = materialize(asked.join(index.select("record_id", F.col("page_id").alias("refers_to")), "record_id"), "targets")
    plain = index.where("record_type <> 'revisit'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(by_group(later, targets, ["record_id"]).select(*columns, "refers_to"))
