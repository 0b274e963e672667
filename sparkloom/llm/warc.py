"""Legacy archive converter: ARC files (version 1 and 2) to WARC, with revisit records for equal payloads.

Three passes over archives in the shared folder, each a table of small index rows beside the files:

1. ``write_arc``: rows to ARC files of bounded size; an index row for each record.
2. ``convert``: each ARC file is read once, in order, by the field names of its own version block and the
   declared lengths; identifiers, timestamps, types and digests of the WARC records are synthesised. Which
   record keeps a payload is decided on the index alone (digest, id, URL), so no payload is shuffled. A revisit names that
   record by identifier, URL and date.
3. ``read_warc``: the WARC files back to rows.

Files are written under a name that no other attempt uses and count only if the index lists them, so a task that
is run again after a lost executor does no harm. They are reached through pyarrow's file systems by URI.

Defined cases: a null payload is empty; white space and control bytes of an URL, which would break an ARC header
line, are percent-encoded, a null URL is ``-``; equal payloads below ``min_revisit`` bytes are all
responses; repeated page ids each get a record, revisits refer to the largest id of the payload; a null id is written
empty, never refers to another, and comes back null; empty tables give no files and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace, shuffle_parts, table

MIN_REVISIT = 1000
#: An archive file is closed when it holds so many raw bytes or records.
FILE_BYTES, FILE_RECORDS = 24_000_000, 20_000
BROADCAST_DIGESTS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Fixed by the ARC file format: the field names of a URL record in versions 1 and 2.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
INDEX = pa.schema([("path", pa.string()), ("n", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
INDEX_DDL = "path string, n long, page_id long, url string, payload_bytes long, payload_digest string"
ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
ROW_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class GzipSink:
    """A file of gzip members, one for each record, as both formats want."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.raw = fs.open_output_stream(path, compression=None), 0

    def add(self, *parts: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        for part in parts:
            self.out.write(packer.compress(part))
            self.raw += len(part)
        self.out.write(packer.flush())

    def close(self) -> None:
        self.out.close()


class Source:
    """Reads lines and declared lengths from a file of gzip members, holding little more than what was asked for."""

    def __init__(self, uri: str, piece: int = 1 << 18):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file, self.piece = fs.open_input_stream(path, compression=None), piece
        self.unpack, self.packed, self.buffer = zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        while True:
            if self.unpack.eof:
                self.packed, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.file.read(self.piece)
                if not self.packed:
                    return False
            out = self.unpack.decompress(self.packed, self.piece)
            self.packed = b"" if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                self.buffer += out
                return True
            if self.unpack.eof and not self.unpack.unused_data:
                self.unpack = zlib.decompressobj(31)

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        at = 0
        while (end := self.buffer.find(b"\n", at)) < 0:
            at = len(self.buffer)
            if not self._more():
                if not self.buffer:
                    return None
                end = len(self.buffer)
                break
        got = bytes(self.buffer[:end])
        del self.buffer[: end + 1]
        return got.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError(f"the archive ends {n - len(self.buffer)} bytes before the declared length")
        got = bytes(self.buffer[:n])
        del self.buffer[:n]
        return got


def arc_url(url: str | None) -> str:
    """The URL as an ARC header line can hold it."""
    return re.sub(r"[\x00-\x20\x7F\x85\xA0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


#: The date of all records that are written here, as pages have none.
DATE = "20000101000000"


def arc_version_block(version: int, name: str, date: str = DATE) -> bytes:
    body = f"{version} 0 sparkloom\n{' '.join(ARC_FIELDS[version])}\n".encode()
    more = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str | None, payload: bytes, page_id: int | None, offset: int = 0, name: str = "-", date: str = DATE) -> tuple[bytes, bytes]:
    """Header line with the HTTP headers, and payload with the closing newline."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = "" if version == 1 else f" 200 {hashlib.md5(payload).hexdigest()} - {offset} {name}"
    return f"{arc_url(url)} 0.0.0.0 {date} text/html{more} {len(http) + len(payload)}\n".encode() + http, payload + b"\n"


def read_arc(source: Source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by name, content) of each record but the version block, whose body names the fields."""
    fields = ARC_FIELDS[1]
    while (line := source.line()) is not None:
        if not line:
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        content = source.take(int(parts[-1]))
        if parts[0].startswith("filedesc://"):
            head, names = content.decode("utf-8", "replace").split("\n")[:2]
            version = int(head.split(" ")[0])
            fields = names.split(" ") if len(names.split(" ")) > 4 else ARC_FIELDS.get(version, ARC_FIELDS[1])
            continue
        if len(parts) > len(fields):  # a content type may hold spaces
            spare = len(parts) - len(fields)
            parts = [*parts[:3], " ".join(parts[3 : 4 + spare]), *parts[4 + spare :]]
        yield dict(zip(fields, parts, strict=False)), content


def split_http(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header bytes with the empty line, headers by lower-case name, payload."""
    if not content.startswith(b"HTTP/") or (at := content.find(b"\r\n\r\n")) < 0:
        return b"", {}, content
    head = content[: at + 4]
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return head, {k.strip().lower(): v.strip() for k, v in pairs}, content[at + 4 :]


def warc_date(arc: str) -> str:
    """14 digits of an ARC date as the WARC form; shorter dates are filled up."""
    d = (arc + "00000101000000"[len(arc) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(uri: str, page_id: str, date: str, digest: str) -> str:
    """A name-based identifier: the same record gets the same one in each run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {page_id} {date} {digest}')}>"


def warc_record(fields: dict[str, str], content: bytes, refers_to: tuple[int, str] | None) -> tuple[bytes, bytes, bytes]:
    """A response, or a revisit with the HTTP headers alone, from an ARC record. refers_to: id and URL of the page whose record keeps the payload, of the same date as all here."""
    head, http, payload = split_http(content)
    date, digest = warc_date(fields["Archive-date"]), hashlib.sha1(payload).hexdigest()
    revisit, more = refers_to is not None, []
    if refers_to:
        page, uri = refers_to
        more = [
            f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(uri, str(page), warc_date(DATE), digest)}", f"WARC-Refers-To-Target-URI: {uri}",
            f"WARC-Refers-To-Date: {warc_date(DATE)}", f"X-Refers-To-Page: {page}",
        ]
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(fields['URL'], http.get('x-page-id', ''), date, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields.get('IP-address', '0.0.0.0')}", f"WARC-Payload-Digest: sha1:{digest}",
        *more,
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + (0 if revisit else len(payload))}",
    ]
    return "\r\n".join([*lines, "", ""]).encode() + head, b"" if revisit else payload, b"\r\n\r\n"


def read_warc_records(source: Source) -> Iterator[tuple[dict[str, str], bytes]]:
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while line := source.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, source.take(int(headers["content-length"]))


def write_arc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows to ARC files under root, versions 1 and 2 in turn; returns the index."""

    def write(batches):
        sink, name, n, version = None, "", 0, 1
        for batch in batches:
            index = []
            for page_id, url, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                payload = payload or b""
                if sink is None:
                    name, n, version = f"{root}/{uuid.uuid4().hex}.arc.gz", 0, 3 - version
                    sink = GzipSink(name)
                    sink.add(arc_version_block(version, name.rsplit("/", 1)[1]))
                sink.add(*arc_record(version, url, payload, page_id, sink.raw, name.rsplit("/", 1)[1]))
                index.append((name, n, page_id, arc_url(url), len(payload), hashlib.sha1(payload).hexdigest()))
                n += 1
                if sink.raw >= FILE_BYTES or n >= FILE_RECORDS:
                    sink.close()
                    sink = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True) if index else [()] * 6, INDEX.types, strict=True)], schema=INDEX)
        if sink:
            sink.close()

    columns = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    return columns.mapInArrow(write, INDEX_DDL)


def keepers(index: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(payload_digest, keeper, keeper_url) of payloads that occur more than once. Partial sums meet, one row for each digest and task."""
    large = index.where(F.col("payload_bytes") >= min_revisit)
    return large.groupBy("payload_digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("k"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("payload_digest", F.col("k.page_id").alias("keeper"), F.col("k.url").alias("keeper_url"))


def convert(index: DataFrame, keeper: DataFrame, root: str) -> DataFrame:
    """Each ARC file of the index to a WARC file under root; returns (path, records). keeper must be a stored table."""
    small = keeper.count() <= BROADCAST_DIGESTS
    revisits = index.select("path", "n", "page_id", "payload_digest").join(F.broadcast(keeper) if small else keeper, "payload_digest", "left")
    refers = F.when(F.col("page_id") != F.col("keeper"), F.col("keeper"))
    # a file holds FILE_RECORDS records at most, so this list is bounded
    plans = revisits.groupBy("path").agg(F.collect_list(F.when(refers.isNotNull(), F.struct("n", refers.alias("to"), F.col("keeper_url").alias("url")))).alias("revisits"))

    def write(batches):
        for batch in batches:
            done = []
            for path, revisit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refers_to = {x["n"]: (x["to"], x["url"]) for x in revisit}
                name, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                sink = GzipSink(name)
                for n, (fields, content) in enumerate(read_arc(Source(path)), 1):
                    sink.add(*warc_record(fields, content, refers_to.get(n - 1)))
                sink.close()
                done.append((name, n))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64()))], names=["path", "records"])

    # few bytes a row, but much work: a task for a few files each, which AQE would have put into one
    return plans.repartition(shuffle_parts(index.sparkSession)).mapInArrow(write, "path string, records long")


def read_warc(files: DataFrame) -> DataFrame:
    """The records of the listed WARC files. A revisit's payload size is that of its HTTP headers, its digest that of the full payload."""

    def rows(path: str):
        for headers, content in read_warc_records(Source(path)):
            _, http, payload = split_http(content)
            revisit = headers["warc-type"] == "revisit"
            page, digest = http.get("x-page-id"), headers["warc-payload-digest"].partition(":")[2]
            if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"digest of {headers['warc-record-id']} differs")
            size = int(http["content-length"]) if revisit else len(payload)
            yield int(page) if page else None, headers["warc-target-uri"], size, digest, headers["warc-type"], int(headers["x-refers-to-page"]) if revisit else None

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                got = list(rows(path))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in enumerate(ROW.types)], schema=ROW)

    return files.select("path").mapInArrow(read, ROW_DDL)


def archive(pages: DataFrame, **columns) -> DataFrame:
    """pages as ARC, converted to WARC and read back."""
    spark: SparkSession = pages.sparkSession
    work = Workspace(spark, "warc")
    parts = shuffle_parts(spark)
    index = work.keep(write_arc(pages, f"{work.root}/arc", **columns), "index")
    keeper = work.keep(keepers(index), "keepers")
    files = work.keep(convert(index, keeper, f"{work.root}/warc"), "files")
    work.delete(f"{work.root}/arc")
    return read_warc(files.repartition(parts))


def op10_warc(spark, sf_dir):
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k
"""
