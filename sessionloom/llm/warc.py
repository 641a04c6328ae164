"""WARC archives written and read as tables of chunks.

A payload never has to stand in memory as a whole record: the writer puts it out as rows of one chunk
each, which Spark's text writer strings together, and the reader walks an archive's lines and gives
rows (record, chunk number, digest of all bytes so far). A response holds its payload in HTTP chunked
coding, so that every written row ends with a line feed whatever the payload holds; a revisit holds the
HTTP header alone, whose Content-Length says how long the payload was.

An archive is a gzip stream, which Spark reads in one piece, of WARC 1.1 records. The reader also
takes archives of others with bodies that are not chunked, and with one gzip member per record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import ordering
from sessionloom.sources.tables import cut_lineage

#: Payload bytes of a row.
CHUNK_BYTES = 1 << 20
#: Rows are handed over once they hold about so many bytes.
_BATCH_BYTES = 4 << 20
_KEY = ["own", "page_id", "url", "length", "sha1", "sha256"]
CHUNKS = ("record_id string, type string, target_uri string, refers_to string, chunk int, start long, size long, "
          "data binary, digest string, last boolean, payload_bytes long, stated_digest string")


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a digest in hex whose length divides by 5 (20 bits make four letters)."""
    fives = F.transform(F.sequence(F.lit(0), (F.char_length(digest) / 5 - 1).cast("int")),
                        lambda i: F.lpad(F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    return F.translate(F.array_join(fives, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _pages(pages: DataFrame) -> DataFrame:
    """page_id, url, payload bytes, their number and digests, and a digest of the row of fixed size."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload"))
    told = rows.select("*", F.octet_length("payload").cast("long").alias("length"), F.sha1("payload").alias("sha1"),
                       F.sha2("payload", 256).alias("sha256"))
    about = F.to_json(F.struct("page_id", "url", "sha256"))  # leaves nulls out, so they differ from any text
    return told.withColumn("own", F.sha2(about.cast("binary"), 256))


def _urn(page: Column, url: Column, copy: Column) -> Column:
    """Id of a record: page, a hash of url and payload (rows may share a page number), and copy."""
    own = F.substring(F.md5(F.concat_ws(" ", F.col("sha256"), url).cast("binary")), 1, 16)
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), own, F.lit(":"), copy.cast("string"), F.lit(">"))


def page_of(urn: Column) -> Column:
    """The page number in a record id that write_archives gave; null for a page without one."""
    return F.regexp_extract(urn, r"urn:x-page:(-?[0-9]+):", 1).try_cast("long")


def _uri(url: Column) -> Column:
    """The url, percent-encoded where it holds spaces or control characters, which would break a header."""
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.url_encode(url)).otherwise(url)


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v, F.lit("\r\n")), F.lit(""))
                      for name, v in pairs])


def _header(kind: str, record: Column, length: Column, date: str, refers: Column, refers_uri: Column) -> Column:
    return F.concat(F.lit("WARC/1.1\r\n"), _lines(
        ("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", date), ("WARC-Target-URI", _uri(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", refers_uri),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if kind == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", length.cast("string"))), F.lit("\r\n"))


_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_CODED = _HTTP + "Transfer-Encoding: chunked\r\n\r\n"


def _responses(rows: DataFrame, date: str, chunk_bytes: int) -> DataFrame:
    """The text rows of response records: header, one row per chunk, end. Each lacks its last line feed."""
    n, none = F.col("length"), F.lit(None).cast("string")
    full, rest = F.floor(n / chunk_bytes), n % chunk_bytes
    coded = full * (chunk_bytes + len(f"{chunk_bytes:X}") + 4) + F.when(rest > 0, rest + F.char_length(F.hex(rest)) + 4).otherwise(0)
    length = F.lit(len(_CODED) + 5) + coded
    head = F.concat(_header("response", _urn(F.col("page_id"), F.col("url"), F.col("copy")), length, date, none, none), F.lit(_CODED[:-1]))
    chunks = F.ceil(n / chunk_bytes).cast("int")
    i = F.col("i")
    # Bytes are cut before they become text: a chunk may end inside a character.
    part = F.substring(F.col("payload"), ((i - 1) * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    body = F.concat(F.hex(F.octet_length(part).cast("long")).cast("binary"), F.lit("\r\n").cast("binary"), part, F.lit("\r").cast("binary"))
    value = F.when(i == 0, head.cast("binary")).when(i <= chunks, body).otherwise(F.lit("0\r\n\r\n\r\n\r").cast("binary"))
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), chunks + 1)))
    return each.select(value.cast("string").alias("value"))


def _revisits(rows: DataFrame, date: str) -> DataFrame:
    block = F.concat(F.lit(f"{_HTTP}Content-Length: "), F.col("length").cast("string"), F.lit("\r\n\r\n"))
    head = _header("revisit", _urn(F.col("page_id"), F.col("url"), F.col("copy")), F.octet_length(block), date,
                   _urn(F.col("top_page"), F.col("top_url"), F.lit(0)), _uri(F.col("top_url")))
    return rows.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"))


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0, chunk_bytes: int = CHUNK_BYTES,
                   date: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC record per row of ``pages`` (page_id, url, html), in gzip files below ``path``.

    The payload is the html in UTF-8, a null being empty. Of rows with equal payloads of ``revisit_from``
    bytes or more, the one with the largest page_id (then url; null is smallest) is the response and
    the others revisit it; rows that are equal throughout are told by a copy number. Smaller payloads
    are responses each. A null url lends no header line. Other columns are ignored; an empty table
    gives archives without records. Only digests are gathered to find equal payloads; payloads go
    straight from the table to the file.
    """
    rows = _pages(pages)
    facts = cut_lineage(rows.filter(F.col("length") >= revisit_from).groupBy(*_KEY).agg(F.count("*").alias("rows")))
    same = ["length", "sha1", "sha256"]
    tops = facts.groupBy(*same).agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("rows").alias("all")).filter("all > 1").drop("all")
    met = cut_lineage(ordering.spread_join(facts, tops, same, salt_by=["page_id", "url"]))
    is_top = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    # A revisit holds no payload: it is written from the facts alone, one for each row but the response.
    copies = F.sequence(F.when(is_top, F.lit(1)).otherwise(F.lit(0)).cast("long"), F.col("rows") - 1)
    again = met.filter(~is_top | (F.col("rows") > 1)).select(
        *_KEY, F.col("top.page_id").alias("top_page"), F.col("top.url").alias("top_url"), F.explode(copies).alias("copy"))
    # Of the payloads, those of revisits stay behind; rows equal to their response throughout become one.
    behind = met.select("own", is_top.alias("_top"), (F.col("rows") > 1).alias("_several"))
    count, repeats = behind.agg(F.count("*"), F.count_if(F.col("_top") & F.col("_several"))).first()
    out = large = rows.filter(F.col("length") >= revisit_from)
    if count:  # else payloads are neither joined nor moved
        near = F.broadcast(behind) if count <= ordering.SMALL else behind
        out = large.join(near, "own", "left").filter(F.col("_top").isNull() | (F.col("_top") & ~F.col("_several")))
    out = out.select(*_KEY, "payload")
    if repeats:
        top = behind.filter(F.col("_top") & F.col("_several")).select("own")
        near = F.broadcast(top) if repeats <= ordering.SMALL else top
        out = out.unionByName(large.join(near, "own", "left_semi").groupBy(*_KEY).agg(F.first("payload").alias("payload")))
    out = out.withColumn("copy", F.lit(0).cast("long"))
    small = rows.filter(F.col("length") < revisit_from).select(*_KEY, "payload", F.monotonically_increasing_id().alias("copy"))
    if revisit_from > 0:
        out = out.unionByName(small)
    texts = _responses(out, date, chunk_bytes).unionByName(_revisits(again, date))
    texts.write.option("compression", "gzip").text(path)


class _Reader:
    """Walks the lines of archives and gives chunk rows; holds at most one chunk, or one line, of a payload."""

    def __init__(self, chunk_bytes: int, data: bool):
        self.chunk_bytes, self.data, self.file = chunk_bytes, data, None
        self.rows: list[tuple] = []
        self.size = 0
        self._between()

    def _between(self) -> None:
        self.state, self.head = "between", {}

    def line(self, file: int, line: bytes) -> None:
        if file != self.file:
            self.close()
            self.file = file
        if self.state == "between":
            if line.startswith(b"WARC/1."):
                self.state = "head"
            elif line.strip():
                raise ValueError(f"no WARC record begins with {line[:60]!r}")
        elif self.state == "head":
            if line.strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                self.head[name.strip().lower()] = value.strip()
            else:
                self._block()
        else:
            self._body(line + b"\n")

    def _block(self) -> None:
        self.left = int(self.head["content-length"])
        self.http: dict[str, str] = {}
        self.sha, self.start, self.chunk, self.held = hashlib.sha1(), 0, 0, bytearray()
        http = self.head.get("content-type", "").startswith("application/http")
        self.state = "http" if http else "plain"
        if not self.left:
            self._end()

    def _body(self, piece: bytes) -> None:
        """Bytes of the block as far as its length says."""
        piece = piece[:self.left]
        self.left -= len(piece)
        if self.state == "http":
            line = piece.strip()
            if line and b":" in line:
                name, _, value = line.decode("latin-1").partition(":")
                self.http[name.strip().lower()] = value.strip()
            elif not line:
                self.state = "size" if self.http.get("transfer-encoding", "").lower() == "chunked" else "plain"
        elif self.state == "plain":
            self._payload(piece)
        else:
            self._coded(piece)
        if not self.left:
            self._end()

    def _coded(self, piece: bytes) -> None:
        """A piece of a body in chunked coding."""
        if self.state == "size":
            if piece.strip():
                self.wanted = int(piece.split(b";")[0], 16)
                self.state = "data" if self.wanted else "trailer"
        elif self.state == "data":
            own = piece[:self.wanted]
            self.wanted -= len(own)
            self._payload(own)
            if not self.wanted:
                self.state = "size"  # what is left of the piece is the line end behind the chunk

    def _payload(self, piece: bytes) -> None:
        self.held += piece
        while len(self.held) > self.chunk_bytes:
            self._row(bytes(self.held[:self.chunk_bytes]), False)
            del self.held[:self.chunk_bytes]

    def _row(self, data: bytes, last: bool) -> None:
        self.sha.update(data)
        digest = base64.b32encode(self.sha.copy().digest()).decode()
        head, n = self.head, self.start + len(data)
        stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if head.get("warc-type") == "revisit":
            n, digest = int(self.http.get("content-length", 0)), stated
        self.rows.append((head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to"),
                          self.chunk, self.start, len(data), data if self.data else None, digest, last, n, stated))
        self.size += 200 + len(data)
        self.start += len(data)
        self.chunk += 1

    def _end(self) -> None:
        self._row(bytes(self.held), True)
        self._between()

    def close(self) -> None:
        if self.state != "between":
            raise ValueError(f"an archive ends inside record {self.head.get('warc-record-id')}")

    def taken(self) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string(),
                 pa.bool_(), pa.int64(), pa.string()]
        columns = list(zip(*self.rows)) or [()] * len(kinds)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          [f.split()[0] for f in CHUNKS.split(", ")])


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The records of the gzip archives below ``path`` as rows of at most ``chunk_bytes`` payload bytes: CHUNKS.

    ``digest`` (bare base32 SHA-1) and ``payload_bytes`` cover the payload up to the end of the row, so a
    record's row marked ``last`` has those of the whole; a revisit's are the stated ones. An empty
    payload has one empty row. ``data`` False leaves the bytes out. A broken archive raises.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(chunk_bytes, data)
        for b in batches:
            for file, line in zip(b.column("file").to_pylist(), b.column("line")):
                reader.line(file, line.as_py())
                if reader.size > _BATCH_BYTES:
                    yield reader.taken()
        reader.close()
        yield reader.taken()

    at = F.col("_metadata.file_block_start")
    whole = F.when(at > 0, F.raise_error(F.lit("archives that Spark would split must be compressed"))).otherwise(
        F.xxhash64("_metadata.file_path"))
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"), whole.cast("long").alias("file"))
    return lines.mapInArrow(walk, CHUNKS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id, type, target_uri, refers_to, payload_bytes, payload_digest, intact.

    ``intact`` says whether the payload has the digest that its header states (null without one)."""
    last = read_chunks(spark, path, data=False).filter("last")
    return last.select("record_id", "type", "target_uri", "refers_to", "payload_bytes", F.col("digest").alias("payload_digest"),
                       (F.col("digest") == F.col("stated_digest")).alias("intact"))
