"""WARC writing and a salvage reader (operator 1).

``write_warc`` writes one WARC/1.1 record per page, each its own gzip member (or plain), into archives of
bounded size in a folder that all executors share.  A payload that occurs again is written once as a
``response`` (the page with the largest identifier) and otherwise as a ``revisit`` that refers to it.  Tasks
write archives under names of their own and report them in a manifest that Spark commits, so a retried or
speculative task never leaves a half-written archive among those that are read.

``read_warc`` streams each archive record by record, whatever its make-up: a gzip member for each record, one member
around many, plain records, or all of these in one file, of any version of the format.  A record that fails a check (gzip
CRC or truncation, version line, headers, length, trailer, block or payload digest) starts a quarantined gap: the reader
searches for the next gzip member or ``WARC/`` version line that parses and passes all checks, goes on from there, and
logs the gap's byte range and reason.  In a member of several records the search goes on inside; of a member that is
itself broken, the records that a digest confirms are kept.  Blocks are digested in pieces, so records may be of any length.

Defined cases: a null html is an empty payload (of 0 bytes, with its digest); a null identifier is written as
``null`` and read back as null, and never is the one referred to unless all of its group are null, in which
case all are responses; repeated rows of the winning identifier are all responses; an empty table writes no
archive and reads as an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import few, scratch, small_batches, stored

_END = b"\r\n\r\n"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+[ \t]*")
_BLOCK = 1 << 16
#: Data of a gzip member that is held in memory.
MEMBER = 8 << 20
#: Payloads over this many bytes are checked, counted and digested, but not carried in a row.
PAYLOAD_LIMIT = 1 << 30


class BadRecord(ValueError):
    """A record failed a check."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _id_of(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = sha1_base32(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {''.join(c for c in url if c not in '\r\n')}")
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def _open(path: str, mode: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name) if mode == "r" else fs.open_output_stream(name, compression=None)


def write_warc(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = 64 << 20, gzip: bool = True) -> DataFrame:
    """Write the archives and return their committed manifest (path, records, bytes)."""
    spark = pages.sparkSession
    small_batches(spark, 256)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), (F.col(url_col) if url_col in pages.columns else F.lit(None)).cast("string").alias("url"), payload.alias("payload"))
    # Only digests are shuffled; those that occur once are dropped before anything is joined.
    keyed = rows.select("id", F.sha2("payload", 256).alias("key"), F.octet_length("payload").alias("n")).where(F.col("n") >= min_revisit_bytes)
    repeated = stored(keyed.groupBy("key").agg(F.max("id").alias("winner"), F.count("*").alias("c")).where((F.col("c") > 1) & F.col("winner").isNotNull()).select("key", "winner"), "repeated")
    joined = rows.withColumn("key", F.sha2("payload", 256)).join(few(repeated, repeated.count(), 500_000), "key", "left").drop("key")
    fs, name = pafs.FileSystem.from_uri(out_dir)
    fs.create_dir(name, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int, int]] = []
        sink, path, records, size = None, "", 0, 0
        for b in batches:
            for page_id, url, data, winner in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if sink is None:
                    path, records, size = f"{out_dir}/{uuid.uuid4().hex}.warc{'.gz' if gzip else ''}", 0, 0
                    sink = _open(path, "w")
                data = data or b""
                revisit = winner is not None and winner != page_id and len(data) >= min_revisit_bytes
                raw = record_bytes(page_id, url, data, winner, revisit)
                if gzip:
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    raw = z.compress(raw) + z.flush()
                sink.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= archive_bytes:
                    sink.close()
                    sink = None
                    done.append((path, records, size))
        if sink is not None:
            sink.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return stored(joined.select("id", "url", "payload", "winner").mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


class _Stream:
    """Bytes that are pulled as they are needed, with the number of bytes taken."""

    def __init__(self, pull: Callable[[], bytes], left: int | None = None):
        self.pull, self.left, self.buf, self.i, self.taken = pull, left, b"", 0, 0

    def more(self) -> bool:
        data = self.pull()
        self.buf, self.i = self.buf[self.i :] + data, 0
        return bool(data)

    def any(self) -> bool:
        return self.i < len(self.buf) or self.more()

    def until(self, mark: bytes, limit: int) -> bytes:
        """What stands before the next mark; the mark is taken too."""
        seen = self.i
        while (at := self.buf.find(mark, seen)) < 0:
            held = len(self.buf) - self.i
            if held > limit or not self.more():
                raise BadRecord("headers do not end")
            seen = max(0, held - len(mark) + 1)
        out = self.buf[self.i : at]
        self.taken += len(out) + len(mark)
        self.i = at + len(mark)
        return out

    def chunks(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.any():
                raise BadRecord("truncated block")
            part = self.buf[self.i : self.i + n]
            self.i, self.taken, n = self.i + len(part), self.taken + len(part), n - len(part)
            yield part

    def find(self, mark: bytes) -> bool:
        """Go to the next mark."""
        while (at := self.buf.find(mark, self.i)) < 0:
            skip = max(0, len(self.buf) - self.i - len(mark) + 1)
            self.i, self.taken = self.i + skip, self.taken + skip
            if not self.more():
                return False
        self.taken, self.i = self.taken + at - self.i, at
        return True


def _differs(said: str, sha1: bytes) -> bool | None:
    """Whether a stated SHA-1 (base32 or hexadecimal) is another one; None if there is none to compare."""
    name, _, value = said.partition(":")
    if name.lower() != "sha1" or not value:
        return None
    return value.lower() != sha1.hex() if len(value) == 40 else value.upper() != base64.b32encode(sha1).decode()


def parse_record(st: _Stream, keep: bool = True, limit: int = PAYLOAD_LIMIT) -> dict:
    """Check and take one whole record with its trailer; the block is digested piece by piece and never held whole unless kept.

    A payload over ``limit`` bytes is checked and reported, but not carried.
    """
    if not st.any() or (st.i + 5 > len(st.buf) and not st.more()) or not st.buf.startswith(_VERSION, st.i):
        raise BadRecord("no version line")
    version, *lines = st.until(_END, 1 << 20).split(b"\r\n")
    if not _VERSION_LINE.fullmatch(version):
        raise BadRecord("no version line")
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            # A folded line goes on with the value before.
            fields[last] = f"{fields[last]} {line.strip().decode('utf-8', 'replace')}".strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("malformed header line")
        last = name.strip().lower().decode("latin-1")
        fields[last] = value.strip().decode("utf-8", "replace")
    said = fields.get("content-length", "")
    if not (said.isascii() and said.isdigit()):
        raise BadRecord("no content length")
    length = int(said)
    if st.left is not None and st.taken + length + len(_END) > st.left:
        raise BadRecord("length beyond the archive")
    kind = fields.get("warc-type")
    block, payload, parts, size = hashlib.sha1(), hashlib.sha1(), [], 0
    head: bytes | None = b"" if "http" in fields.get("content-type", "") else None
    http = b""
    for part in st.chunks(length):
        block.update(part)
        if head is not None:
            # The payload begins after the HTTP headers.
            head += part
            cut = head.find(_END)
            if cut < 0 and len(head) <= 1 << 20:
                continue
            http, part, head = (head[:cut], head[cut + 4 :], None) if cut >= 0 else (b"", head, None)
        payload.update(part)
        size += len(part)
        if keep and kind == "response" and size <= limit:
            parts.append(part)
    if head is not None:
        # No HTTP headers end in this block.
        http = head
    if b"".join(st.chunks(len(_END))) != _END:
        raise BadRecord("no record trailer after the block")
    wrong = _differs(fields.get("warc-block-digest", ""), block.digest())
    if wrong:
        raise BadRecord("block digest differs")
    digest = fields.get("warc-payload-digest", "")
    if kind == "response":
        other = _differs(digest, payload.digest())
        if other:
            raise BadRecord("payload digest differs")
        wrong = wrong if other is None else other
    else:
        sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else None
    carried = kind == "response" and keep and size <= limit
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_digest": digest.partition(":")[2] or None, "payload_bytes": size, "payload": b"".join(parts) if carried else None, "reason": "payload over the limit" if kind == "response" and keep and not carried else None, "checked": wrong is False}


def _inflate(f, pos: int, ends: list[int]) -> Callable[[], bytes]:
    """Pull the data of the gzip member at a position in bounded pieces; ``ends`` gets the member's end once it is complete."""
    z, at = zlib.decompressobj(31), pos

    def pull() -> bytes:
        nonlocal at
        while not z.eof:
            raw = z.unconsumed_tail
            if not raw:
                f.seek(at)
                raw = f.read(_BLOCK)
                if not raw:
                    raise BadRecord("truncated member")
                at += len(raw)
            try:
                data = z.decompress(raw, 1 << 20)
            except zlib.error as e:
                raise BadRecord(f"gzip: {e}") from None
            if z.eof:
                ends.append(at - len(z.unused_data))
            if data:
                return data
        return b""

    return pull


def _until_error(pull: Callable[[], bytes]) -> Callable[[], bytes]:
    """The data before a member breaks."""

    def safe() -> bytes:
        try:
            return pull()
        except BadRecord:
            return b""

    return safe


def _member(f, pos: int, keep: bool, limit: int) -> Iterator[dict]:
    """Records and gaps of the gzip member at a position, which may hold any number of records; last ``end`` (None if it is broken) and ``reason``.

    Of a broken member only records that a digest confirms are taken.  A member is held in memory up to ``MEMBER`` bytes;
    a larger one is inflated once to check it and once more to read it.
    """
    ends: list[int] = []
    pull, held, reason = _inflate(f, pos, ends), [], None
    try:
        size = 0
        while data := pull():
            size += len(data)
            if size <= MEMBER:
                held.append(data)
    except BadRecord as e:
        reason = str(e)
    whole = b"".join(held) if size <= MEMBER else None
    held.clear()

    def stream(skip: int) -> _Stream:
        """The member's data from a byte on."""
        if whole is not None:
            once = iter([whole])
            st = _Stream(lambda: next(once, b""))
        else:
            st = _Stream(_until_error(_inflate(f, pos, [])))
        for _ in st.chunks(skip):
            pass
        return st

    st, found, bad = stream(0), 0, None
    while st.any():
        begin = st.taken
        try:
            r = parse_record(st, keep, limit)
            if reason and not r["checked"]:
                raise BadRecord("no digest in a broken member")
        except BadRecord as e:
            bad = bad or str(e)
            # What the failed record took is searched too.
            st = stream(begin + 1)
            if not st.find(_VERSION):
                break
            continue
        if bad and not reason and found:
            yield {"record_type": "gap", "offset": pos, "end": ends[0], "reason": f"{bad}, before byte {begin} of the member"}
        bad, found = None, found + 1
        yield r | {"offset": pos, "end": ends[0] if ends else None}
    if bad and found and not reason:
        yield {"record_type": "gap", "offset": pos, "end": ends[0], "reason": f"{bad}, at the end of the member"}
    if not found and not reason and (bad or size):
        reason = bad or "no record in the member"
    yield {"record_type": None, "end": None if reason else ends[0], "reason": reason and (f"{reason}, after {found} records" if found else reason)}


def _plain(f, pos: int, size: int, keep: bool, limit: int) -> Iterator[dict]:
    """The uncompressed record at a position, then ``end`` and ``reason`` as for a member."""
    at = pos

    def pull() -> bytes:
        nonlocal at
        f.seek(at)
        data = f.read(_BLOCK)
        at += len(data)
        return data

    st = _Stream(pull, size - pos)
    try:
        r = parse_record(st, keep, limit)
    except BadRecord as e:
        yield {"record_type": None, "end": None, "reason": str(e)}
        return
    yield r | {"offset": pos, "end": pos + st.taken}
    yield {"record_type": None, "end": pos + st.taken, "reason": None}


def _search(f, pos: int, size: int) -> int:
    """Offset of the next gzip member or version line at or after a position, or the size."""
    keep = b""
    while pos < size:
        f.seek(pos)
        data = f.read(_BLOCK)
        if not data:
            break
        both = [x for x in ((keep + data).find(_MAGIC), (keep + data).find(_VERSION)) if x >= 0]
        if both:
            return pos - len(keep) + min(both)
        pos += len(data)
        keep = (keep + data)[-(len(_VERSION) - 1) :]
    return size


def salvage(f, size: int, keep: bool = True, limit: int = PAYLOAD_LIMIT) -> Iterator[dict]:
    """Records of one archive in order, and a ``gap`` row for each quarantined byte range.

    Members and plain records may follow each other in any order; after a failure both marks are searched for.
    """
    pos, bad = 0, None
    while pos < size:
        f.seek(pos)
        rows = _member(f, pos, keep, limit) if f.read(3) == _MAGIC else _plain(f, pos, size, keep, limit)
        for r in rows:
            if r["record_type"] is None and "offset" not in r:
                break
            if bad:
                yield {"record_type": "gap", "offset": bad[0], "end": pos, "reason": bad[1]}
                bad = None
            yield r
        if r["end"] is None:
            bad = bad or (pos, r["reason"])
            pos = _search(f, pos + 1, size)
        else:
            pos = r["end"]
    if bad:
        yield {"record_type": "gap", "offset": bad[0], "end": size, "reason": bad[1]}


_FIELDS = [("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("reason", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]


def read_warc(paths: DataFrame, path_col: str = "path", keep_payload: bool = True, limit: int = PAYLOAD_LIMIT) -> DataFrame:
    """Records and gaps of the archives named in a column: one task streams one archive at a time."""
    fields = [x for x in _FIELDS if keep_payload or x[0] != "payload"]
    schema = pa.schema(fields)
    ddl = ", ".join(f"{n} {({'string': 'string', 'int64': 'bigint', 'binary': 'binary'})[str(t)]}" for n, t in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with _open(path, "r") as f:
                    for r in salvage(f, f.size(), keep_payload, limit):
                        rows.append({n: r.get(n) for n, _ in fields} | {"path": path})
                        held += len(r.get("payload") or b"") if keep_payload else 200
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return paths.select(path_col).mapInArrow(run, ddl)


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, read back, with ``n_gaps``: the quarantined ranges of all archives (none in archives just written)."""
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"), archive_bytes=16 << 20)
    n = max(1, manifest.count())
    got = stored(read_warc(manifest.select("path").repartition(n), keep_payload=False).drop("path", "target_uri"), "records")
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:x-page:(-?[0-9]+)>$', 1), '') as bigint)")
    gaps = got.where("record_type = 'gap'").agg(F.count("*").alias("n_gaps"))
    # One row, so the broadcast is bounded.
    out = got.where("record_type <> 'gap'").crossJoin(F.broadcast(gaps))
    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "n_gaps")


_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g[{i}] >> {shift}) & 31) + 1, 1)" for i in range(1, 9) for shift in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS winner FROM p),
d AS (SELECT *, [CAST(('0x' || substr(hex, 5 * i + 1, 5)) AS INTEGER) FOR i IN range(8)] AS g FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_CHARS} AS payload_digest,
  CASE WHEN winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN winner <> page_id THEN winner END AS refers_to, CAST(0 AS BIGINT) AS n_gaps
FROM d"""
