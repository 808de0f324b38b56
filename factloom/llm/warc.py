"""WARC archives as a PySpark Python data source.

Writing: one gzip member for each record, with the skip-length extra field ("sl"), so that a reader can step over a record
without inflating it. Reading: files are planned into byte ranges, a record belongs to the range of its first byte, filters on
record type and headers are pushed into the scan, and a record's headers are inflated and parsed first, HEAD_STEP bytes at a time:
of an unwanted record, or with option payload=false, nothing is inflated beyond the step in which its headers end.

Archives of other writers are read as well, below nested folders, too: gzip members without "sl" (there the end of a member is only
known by inflating it, a step at a time, and the file is one range) and plain WARC (stepped over by Content-Length, one range). Their
records have no page_id; payload_bytes is the length of the payload where it is known, and a digest in base32 is given in hex.

Payloads of at least MIN_REVISIT bytes that occur in several records are stored once: the record of the largest page_id is the
response, the others revisit it.

Defined cases: null html is an empty payload; null url or id leaves its header out; rows that repeat a page_id and its payload
are all responses if it is the largest; an empty table writes no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from . import common as C

MIN_REVISIT = 1000
#: Bytes of archive for a partition of a scan.
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 8 << 20

SCHEMA = "record_id string, record_type string, url string, page_id long, payload_digest string, payload_bytes long, refers_to long, payload binary"
WRITE_SCHEMA = "page_id long, url string, html string, record_type string, refers_to long, payload_digest string"
#: Bytes inflated at once while a record's headers are looked for.
HEAD_STEP = 1024
#: gzip header: deflate, extra field, no time, unknown system, 12 extra bytes, subfield "sl" of 8.
_SIGN = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"
_PUSHED = {"record_type", "url", "page_id", "payload_digest", "record_id"}


def _fs(path: str):
    return pyarrow.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}') if page_id is not None else uuid.uuid4()}"


def _b32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def member(block: bytes) -> bytes:
    """One gzip member that tells its own length."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(block) + z.flush()
    total = len(_SIGN) + 8 + len(body) + 8
    return _SIGN + struct.pack("<II", total, len(block) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def render(page_id, url, html, record_type, refers_to, digest) -> bytes:
    """The record's bytes."""
    payload = (html or "").encode()
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{_b32(digest)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode()]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    block = b"\r\n".join(http) + b"\r\n\r\n" + payload
    head += [f"Content-Type: application/http;msgtype={record_type if record_type == 'revisit' else 'response'}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Message(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file under a name of its own; the commit gives the files of tasks that ended their final names."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator) -> WriterCommitMessage:
        name = uuid.uuid4().hex
        fs, folder = _fs(self.path)
        fs.create_dir(folder, recursive=True)
        temporary, final = f"{folder}/_{name}.tmp", f"{folder}/{name}.warc.gz"
        wrote = False
        with fs.open_output_stream(temporary) as out:
            for b in iterator:
                for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    out.write(member(render(*row)))
                    wrote = True
        if not wrote:
            fs.delete_file(temporary)
            temporary = ""
        return _Message(temporary, final)

    def commit(self, messages) -> None:
        fs, folder = _fs(self.path)
        fs.create_dir(folder, recursive=True)
        for m in messages:
            if m is not None and m.temporary:
                fs.move(m.temporary, m.final)

    def abort(self, messages) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            if m is not None and m.temporary:
                fs.delete_file(m.temporary)


class _Range(InputPartition):
    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


def headers(text: bytes) -> dict[str, str]:
    """Header lines by lower-cased name."""
    out = {}
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def kind_of(first: bytes) -> str:
    """How a file is written, from its first bytes: own (gzip with "sl"), gzip, plain; empty if it is none of these."""
    return "own" if first.startswith(_SIGN) else "gzip" if first[:3] == b"\x1f\x8b\x08" else "plain" if first[:5] == b"WARC/" else ""


def _payload(block: bytes, h: dict[str, str]) -> bytes:
    """What an HTTP response holds behind its headers; of other records, the block."""
    return block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block


class _Member:
    """A gzip member read a step at a time. inflated: how many bytes of it were."""

    def __init__(self, f, at: int, wbits: int, most: int | None = None):
        self.f, self.z, self.left = f, zlib.decompressobj(wbits), most
        self.inflated, self.at = 0, at
        f.seek(at)

    def more(self, limit: int) -> bytes:
        """Up to limit further bytes; empty at the end of the member."""
        while not self.z.eof:
            data = self.z.unconsumed_tail
            if not data:
                data = self.f.read(4096 if self.left is None else min(4096, self.left))
                self.left = None if self.left is None else self.left - len(data)
                self.at += len(data)
            out = self.z.decompress(data, limit)
            self.inflated += len(out)
            if out or not data:
                return out
        return b""

    def rest(self, size: int) -> bytes:
        parts = []
        while size > 0 and (out := self.more(size)):
            parts.append(out)
            size -= len(out)
        return b"".join(parts)

    def end(self) -> int:
        """Where the member ends in the file: its remaining bytes are passed over."""
        while self.more(1 << 16):
            pass
        return self.at - len(self.z.unused_data)


def _head(more) -> tuple[bytes, bytes]:
    """(header block, what was read behind it) from more(limit)."""
    text = b""
    while b"\r\n\r\n" not in text:
        out = more(HEAD_STEP)
        if not out:
            break
        text += out
    head, _, rest = text.partition(b"\r\n\r\n")
    return head, rest


def _first_own(f, begin: int, end: int) -> int:
    """Where the first record at or behind begin starts; end if none does before end."""
    held, base = b"", begin
    while True:
        f.seek(base + len(held))
        more = f.read(1 << 16)
        held += more
        k = held.find(_SIGN)
        if k >= 0:
            return base + k
        if not more or base + len(held) - len(_SIGN) >= end:
            return end
        base, held = base + max(0, len(held) - len(_SIGN)), held[-len(_SIGN) :]


def scan(f, begin: int, end: int, wanted, with_payload: bool, measured: list[int] | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of records whose first byte lies in [begin, end) and whose headers are wanted.

    measured gets how many bytes were inflated or read of each record.
    """
    f.seek(begin)
    kind = "own" if begin else kind_of(f.read(len(_SIGN)))
    at = _first_own(f, begin, end) if begin else 0
    while at < end:
        f.seek(at)
        first = f.read(len(_SIGN) + 8)
        if not first.strip(b"\r\n"):
            return
        now = kind_of(first)
        if now != kind:
            raise ValueError(f"no record at byte {at}")
        if kind == "plain":
            f.seek(at)
            m, body_at = None, 0
            head, rest = _head(f.read)
            body_at = at + len(head) + 4
        else:
            total = struct.unpack_from("<I", first, len(_SIGN))[0] if kind == "own" else None
            m = _Member(f, at + len(first), -15, total - len(first)) if kind == "own" else _Member(f, at, 31)
            head, rest = _head(m.more)
        h = headers(head)
        size = int(h.get("content-length", 0))
        if wanted(h):
            payload = None
            if with_payload:
                if m is None:
                    f.seek(body_at)
                    block = f.read(size)
                else:
                    block = rest[:size] + m.rest(size - len(rest))
                payload = _payload(block, h)
            yield h, payload
        if measured is not None:
            measured.append(m.inflated if m else len(head))
        at = body_at + size + 4 if m is None else at + total if kind == "own" else m.end()


def _hex(digest: str | None) -> str | None:
    """A digest in hex; one that isn't base32 stays as it is."""
    value = digest.rpartition(":")[2] if digest else None
    return base64.b32decode(value).hex() if value and len(value) % 8 == 0 and re.fullmatch("[A-Z2-7]+", value) else value


def _bare(uri: str | None) -> str | None:
    return uri.strip("<>") if uri else None


_READ = {
    "record_id": lambda h: _bare(h.get("warc-record-id")),
    "record_type": lambda h: h.get("warc-type"),
    "url": lambda h: h.get("warc-target-uri"),
    "page_id": lambda h: int(h["x-page-id"]) if "x-page-id" in h else None,
    "payload_digest": lambda h: _hex(h.get("warc-payload-digest")),
    "payload_bytes": lambda h: int(h["x-payload-length"]) if "x-payload-length" in h else None,
    "refers_to": lambda h: int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None,
}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.wanted: list[tuple[str, frozenset]] = []
        self.present: list[str] = []

    def pushFilters(self, filters):
        for x in filters:
            name = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else ""
            if name in _PUSHED and isinstance(x, EqualTo):
                self.wanted.append((name, frozenset([x.value])))
            elif name in _PUSHED and isinstance(x, In):
                self.wanted.append((name, frozenset(x.value)))
            elif name in _PUSHED and isinstance(x, IsNotNull):
                self.present.append(name)
            else:
                yield x

    def partitions(self):
        fs, folder = _fs(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True, allow_not_found=True))
        files = [x for x in found if x.is_file and x.base_name.endswith((".warc.gz", ".warc")) and not x.base_name.startswith(("_", "."))]
        ranges = []
        for x in sorted(files, key=lambda x: x.path):
            step = self.split
            if x.size > step:  # only own files can be entered anywhere
                with fs.open_input_file(x.path) as f:
                    step = step if kind_of(f.read(len(_SIGN))) == "own" else x.size
            ranges += [(x.path, a, min(a + step, x.size)) for a in range(0, x.size, step)]
        out: list[list[tuple[str, int, int]]] = []
        held = self.split
        for r in ranges:
            if held + r[2] - r[1] > self.split:
                out.append([])
                held = 0
            out[-1].append(r)
            held += r[2] - r[1]
        return [_Range(x) for x in out] or [_Range([])]

    def read(self, partition):
        fs, _ = _fs(self.path)
        ok = lambda h: all(_READ[n](h) in values for n, values in self.wanted) and all(_READ[n](h) is not None for n in self.present)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, held = [], 0
        for path, begin, end in partition.parts:
            with fs.open_input_file(path) as f:
                for h, payload in scan(f, begin, end, ok, self.with_payload):
                    known = tuple(_READ[n](h) for n in names[:-1])
                    if known[5] is None and payload is not None and known[1] == "response":
                        known = (*known[:5], len(payload), *known[6:])
                    rows.append((*known, payload))
                    held += len(payload or b"") + 200
                    if held > BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def plan_records(pages: DataFrame) -> DataFrame:
    """Columns of WRITE_SCHEMA: which page of equal payloads is the response, and whom the others revisit."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("payload_digest"), F.octet_length(html).alias("n"))
    firsts = rows.where(F.col("n") >= MIN_REVISIT).groupBy("payload_digest", "n").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1 AND first IS NOT NULL").drop("k")
    both = rows.join(C.sized(*C.counted(firsts)), ["payload_digest", "n"], "left")  # no page is shuffled while the repeated digests are few
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), "payload_digest")


def write_archives(pages: DataFrame, folder: str) -> None:
    register(pages.sparkSession)
    plan_records(pages).write.format("warc").mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records; where() on the result is pushed into the scan. Spark keeps what was pushed with the loaded table, so read
    the archives anew for another filter rather than filter one frame twice."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def digests(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """Per record: the digest and length of what a response holds, and of what a revisit names."""
    own = responses.where("record_type = 'response'").select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    return own.unionByName(revisits.where("record_type = 'revisit'").select(own.columns))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    folder = C.scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    # record types are pushed into both scans; payloads are asked for where there are any
    return digests(read_archives(spark, folder), read_archives(spark, folder, payload=False))


ORACLE = {
    "op2_warc": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 1000"""
}
QUERIES = {"op2_warc": op2_warc}
