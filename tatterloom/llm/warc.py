"""WARC archives of pages: written as one gzip stream a file, normalised to a member a record, and read by offset.

A first pass over the digests of payloads finds, for each payload, the page that is its response; the others are
revisits, which are written without their pages, so no page is ever shuffled. Each task then writes its pages' records into one archive whose whole file is a single
gzip stream, as some crawlers do. The normaliser inflates such a file once, as a stream, cuts it into records by
their Content-Length, and writes each record as a gzip member of its own together with a sidecar index of offsets and
lengths, so that a record can be read by itself. File names carry the attempt that wrote them; only those in
committed tables count.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tatterloom.llm.common import by_bitmaps, filesystem, place, shared_dir, spread, stored, whole, with_groups, written

DATE = "2000-01-01T00:00:00Z"  # pages have no dates; a fixed one keeps archives reproducible
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 0  # payloads of fewer bytes are always responses
LEVEL = 6
_PIECE = 1 << 18


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: object, url: str, payload: bytes, digest: str, size: int, refers_to: object = None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit has no block. The extension fields hold the page's id and the payload's full size."""
    block = payload if kind == "response" else b""
    uri = "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url or "")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri} {digest}')}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else page_id), ("X-Payload-Length", size),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", refers_url or ""), ("X-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive that comes in pieces; holds one record at a time."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = next(line for line in bytes(held[:end]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
                need = end + 4 + int(size.split(b":")[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    z, most = zlib.decompressobj(31), 4 * _PIECE
    while data := source.read(_PIECE):
        more = True
        while more:
            out = z.decompress(data, most)
            if out:
                yield out
            data, more = z.unconsumed_tail, bool(z.unconsumed_tail) or len(out) == most
            if z.eof:
                data, more, z = z.unused_data, bool(z.unused_data), zlib.decompressobj(31)


def normalise(source, sink) -> Iterator[tuple[int, int, bytes]]:
    """Writes each record of source as a member of sink; gives (offset, length, record)."""
    offset = 0
    for r in records(inflated(source)):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(r) + z.flush()
        sink.write(member)
        yield offset, len(member), r
        offset += len(member)


def revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(page_id, url, digest, size, refers_to, refers_url, file, row) of the rows of a stored table that carry no payload: others have equal payloads, and the largest of their ids."""
    html = whole(html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"), F.octet_length(html).cast("long").alias("size"), *place(pages))
    rows = written(rows.where(F.col("size") >= least), "payloads")
    page = F.max(F.struct("page_id", "url")).alias("page")
    groups = written(rows.groupBy("digest").agg(page, F.count(F.lit(1)).alias("n")).where("n > 1 and page.page_id is not null"), "responses")
    found = with_groups(rows, groups, "digest", "n", "inner").where(~F.col("page.page_id").eqNullSafe(F.col("page_id")))
    return written(found.select("page_id", "url", "digest", "size", F.col("page.page_id").alias("refers_to"), F.col("page.url").alias("refers_url"), "file", "row"), "revisits")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_BYTES) -> DataFrame:
    """Writes archives of one gzip stream each; returns a table of their names (file).

    Of pages with equal payloads of at least `least` bytes, those with the largest id are responses and the others
    revisit them; so rows that repeat the response's id are responses too. Null html counts as empty; a null id is
    less than any other and revisits, or responds where all ids are null; a null url is empty. An empty table writes
    nothing. Other columns aren't read.
    """
    pages = stored(pages)
    spark, folder = pages.sparkSession, shared_dir(pages.sparkSession, "warc")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    again = revisits(pages, id_col, url_col, html_col, least)
    first = by_bitmaps(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), whole(html_col).cast("binary").alias("html"), *place(pages)), again.select("file", "row"), False)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    of = pages.schema[id_col].dataType
    rows = first.select("page_id", "url", "html", none("digest", "binary"), none("size", "long"), none("refers_to", of), none("refers_url", "string"))
    rows = rows.unionByName(again.select("page_id", "url", none("html", "binary"), "digest", "size", "refers_to", "refers_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = z = None
        name = f"{folder}/{uuid.uuid4().hex}.whole.warc.gz"
        for batch in batches:
            for page_id, url, html, digest, size, to, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    sink, z = fs.open_output_stream(filesystem(name)[1], compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                if html is None:
                    found = record("revisit", page_id, url, b"", base64.b32encode(digest).decode(), size, to, to_url)
                else:
                    found = record("response", page_id, url, html, payload_digest(html), len(html))
                sink.write(z.compress(found))
        if sink is not None:
            sink.write(z.flush())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    return written(spread(rows).mapInArrow(run, "file string"), "archives")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Normalises the files of a table (file); returns the index (file, offset, length), a row per record, in file order."""
    n = archives.count()  # a row per file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole_file in batch["file"].to_pylist():
                name = f"{whole_file.removesuffix('.whole.warc.gz')}-{uuid.uuid4().hex}.warc.gz"
                fs, path = filesystem(name)
                with fs.open_input_stream(filesystem(whole_file)[1], compression=None) as source, fs.open_output_stream(path, compression=None) as sink:
                    places: list[tuple[int, int]] = []
                    for offset, length, _ in normalise(source, sink):
                        places.append((offset, length))
                        if len(places) == 10_000:
                            yield _index(name, places)
                            places = []
                    yield _index(name, places)

    return written(archives.repartition(max(1, n)).mapInArrow(run, "file string, offset long, length long"), "index")


def _index(name: str, places: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), *(pa.array([p[k] for p in places], pa.int64()) for k in (0, 1))], ["file", "offset", "length"])


def read_archives(index: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a row per indexed record, read by its offset.

    A response's size and digest are those of the payload that was read, a revisit's those its fields state.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = source = None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    fs, path = filesystem(file)
                    name, source = file, fs.open_input_file(path)
                source.seek(offset)
                fields, block = parse(zlib.decompress(source.read(length), 31))
                kind = fields["WARC-Type"]
                size, digest = (len(block), payload_digest(block)) if kind == "response" else (int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                out.append((fields["X-Page-ID"] or None, size, digest, kind, fields.get("X-Refers-To-Page-ID")))
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    found = index.select("file", "offset", "length").mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.select(F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes, normalises and reads back; see read_archives for the columns."""
    return read_archives(normalise_archives(write_archives(pages, id_col, url_col, html_col)), pages.schema[id_col].dataType.simpleString())
