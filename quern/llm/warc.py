"""WARC archives of pages, written index first and read back by coalesced byte ranges (operator 9).

Each task writes its records, one gzip member each, to archives of its own in the shared
folder, and gives an index row for every record: archive, offset, length, URL and digest.
A retried task writes new archives under new names, and only the finished task's rows are in the
index. The index is written as a table before anything is read. Reading takes index rows, sorts
them by archive and offset within chunks of an archive, joins ranges that lie closer than ``GAP``, reads each
joined range at once, and parses the records in it; payloads are checked against their digests.

Payloads are hashed where they are; only page_ids, URLs, digests and sizes are shuffled to find equal ones.
Equal payloads of at least ``least`` bytes are stored once, by the smallest page_id; the others are revisits.
Null html is an empty payload. Rows with a null page_id are last in that order; repeated rows of the
smallest page_id are responses all. Null URLs are written as empty ones.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.filters import BitFilter
from quern.llm.textual import batches
from quern.storage import new_folder, scratch, stored

ARCHIVE, RANGE, GAP, LEVEL = 256 << 20, 4 << 20, 64 << 10, 1
INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, own: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit without a block, of a payload of that size and digest."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}", "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{own}", f"WARC-Payload-Length: {size}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []), "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def zipped(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _records(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, html, sha, size, refers_to) of the records of ``pages`` (page_id, url, html, sha, size); revisits have no html.

    Only page_id, url, digest and size are shuffled to find the revisits. Rows that a bit filter shows to be none stay where they
    are; of the others those that it took wrongly are known by their keys, and only they are shuffled with their html.
    """
    spark = pages.sparkSession
    light = stored(pages.select("page_id", "url", "sha", "size"), "pages")
    first = light.filter(F.col("size") >= least).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1 and refers_to is not null")
    of = light.filter(F.col("size") >= least).join(first.select("sha", "refers_to"), "sha")
    revisits = stored(of.filter(~F.col("refers_to").eqNullSafe(F.col("page_id"))).select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha", "size", "refers_to"), "revisits")
    row = ("page", "none", "sha")
    keyed = lambda df: df.withColumns({"page": F.coalesce("page_id", F.lit(0)), "none": F.col("page_id").isNull()}).withColumn("key", F.xxhash64(*row))
    passing = lambda df, shared: df.mapInArrow(lambda it: (b.filter(pa.array(shared.value.may_have(b["key"].to_numpy()))) for b in it), df.schema)
    taken = spark.sparkContext.broadcast(BitFilter.of(keyed(revisits), "key"))
    wrong = stored(passing(keyed(light).select(*row, "key"), taken).join(keyed(revisits).select(*row), list(row), "left_anti").distinct(), "wrongly-taken")
    again = spark.sparkContext.broadcast(BitFilter.of(wrong, "key"))

    def stay(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array(~taken.value.may_have(b["key"].to_numpy())))

    full = keyed(pages)
    back = passing(full, again).join(wrong.select(*row), list(row), "left_semi")
    responses = full.mapInArrow(stay, full.schema).unionByName(back).select("page_id", "url", "html", "sha", "size", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


@scratch()
def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) below ``folder``; returns the stored index."""
    batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = _records(pages.withColumns({"sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "size": F.octet_length("html").cast("long")}), least)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        out, name, at = None, "", 0
        for b in it:
            index = [[] for _ in range(6)]
            for page_id, url, text, sha, size, to in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "sha", "size", "refers_to")), strict=True):
                if out is None or at >= ARCHIVE:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                own = base64.b32encode(sha).decode()
                data = zipped(record(page_id, url, (text or "").encode(), size, own, to, date))
                out.write(data)
                for c, v in zip(index, (page_id, name, at, len(data), url, own), strict=True):
                    c.append(v)
                at += len(data)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(index, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "archive", "offset", "length", "url", "payload_digest"])
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(run, INDEX), "warc-index", outlive=True)


RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.string())])


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of these index rows: (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload)."""

    def page(urn: str | None) -> int | None:
        number = urn[len("<urn:page:") : -1] if urn else ""
        return int(number) if number else None

    def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
        """Archive, start, and (offset, length) of records that are read at once."""
        name, start, own = None, 0, []
        for b in it:
            for archive, offset, length in zip(b["archive"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist(), strict=True):
                end = own[-1][0] + own[-1][1] if own else 0
                if own and (archive != name or offset > end + GAP or offset + length - start > RANGE):
                    yield name, start, own
                    own = []
                if not own:
                    name, start = archive, offset
                own.append((offset, length))
        if own:
            yield name, start, own

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for name, start, own in ranges(it):
            with fs.open_input_file(f"{root}/{name}") as f:
                data = f.read_at(own[-1][0] + own[-1][1] - start, start)
            out = [[] for _ in RECORD]
            for offset, length in own:
                h, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                kind, own_digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and digest(block) != own_digest:
                    raise ValueError(f"{name}:{offset} does not have its digest")
                row = (page(h["WARC-Record-ID"]), int(h["WARC-Payload-Length"]), own_digest, kind, page(h.get("WARC-Refers-To")), h["WARC-Target-URI"], block.decode() if payloads and kind == "response" else None)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(out, RECORD, strict=True)], schema=RECORD)

    spark = index.sparkSession
    rows = index.select("archive", "offset", "length").withColumn("chunk", F.floor(F.col("offset") / (8 * RANGE)))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive", "chunk").sortWithinPartitions("archive", "offset")
    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read every record back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read(write(pages, folder, least), folder, payloads=False)
