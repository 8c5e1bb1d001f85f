"""WARC archives, compressed record by record with Zstandard under a shared dictionary: writing, reading, revisits.

An archive begins with a skippable frame that holds the dictionary (compressed itself), if there is one; each record is a frame of its own.
Spark's text writer writes them, so they can be in any store: a row is the bytes of one archive, and its line end is an empty
skippable frame, which readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_table, removed, shared_path, shuffled, small_batches, small_or_not, written

# Magic numbers of Zstandard frames, of the dictionary's skippable frame, and of the first kind of skippable frame.
FRAME, DICTIONARY, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, 0x184D2A50
LINE_END = struct.pack("<II", SKIPPABLE, 0).decode()
# The profile of a revisit of an identical payload, and the fields that every record has.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-record-id", "warc-type", "warc-date", "content-length")
HTTP = "application/http;msgtype=response"
#: Compressed bytes of an archive, after which the next begins; bytes of each page that the dictionary is trained on; level.
ARCHIVE_BYTES, SAMPLE_BYTES, LEVEL = 16 << 20, 16 << 10, 3
RECORD = "archive string, offset long, record_id string, record_type string, refers_to_id string, target_uri string, page_id string, payload_bytes long, payload_digest string, payload binary, error string"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


class Damaged(ValueError):
    """An archive or a record that is not as the format says."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def response_id(page_id: str | None, url: str | None, digest: str) -> str:
    """The id of the response of a group of equal payloads; its revisits, in other tasks, must know it too."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id!r} {url!r} {digest}')}>"


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page: dict, date: str) -> bytes:
    """A response, or a revisit where refers is set. Of a revisit's block only the HTTP head is kept, which has the payload's length."""
    revisit, payload = page["revisit"], page["payload"] or b""
    digest = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
    own = response_id(page["id"], page["url"], digest) if page["named"] else f"<urn:uuid:{uuid.uuid4()}>"
    safe = lambda x: None if x is None else quote(x, safe="!#$&'()*+,/:;=?@[]~")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['size']}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", safe(page["url"])), ("X-Page-ID", safe(page["id"])), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", HTTP)]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", response_id(page["refers_id"], page["refers_url"], digest)), ("WARC-Refers-To-Target-URI", safe(page["refers_url"]))]
    return record(fields, head if revisit else head + payload)


def keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})


def decided(rows: DataFrame, least_bytes: int) -> DataFrame:
    """rows with revisit, refers_id, refers_url, named: of equal payloads of least_bytes or more the row with the largest (id, url) is the response.

    What is equal is found on digests and lengths alone, by aggregates that combine before the shuffle. The
    groups of two or more are broadcast only if counted small; else payloads are dealt by digest, and Spark splits a digest that many pages share.
    Rows that repeat the largest id and url are alike in all that a record has: they become one row and a count, of which one is the response.
    """
    same = rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size", "id", "url").agg(F.count("*").alias("n"))
    top = F.struct("id", "url")
    groups = same.groupBy("sha1", "size").agg(F.sum("n").alias("total"), F.max(top).alias("top"), F.max_by("n", top).alias("top_n")).where("total > 1")
    groups = checkpointed(groups.select(F.col("sha1").alias("g_sha1"), F.col("size").alias("g_size"), "top", "top_n"))
    small = small_or_not(groups)
    both = rows.join(small if small is not groups else shuffled(groups), (F.col("sha1") == F.col("g_sha1")) & (F.col("size") == F.col("g_size")), "left")
    grouped, first = F.col("top").isNotNull(), F.struct("id", "url").eqNullSafe(F.col("top"))
    gives = lambda rows, revisit, named: rows.select("id", "url", "size", "sha1", F.when(~revisit, F.col("payload")).alias("payload"), revisit.alias("revisit"), named.alias("named"), F.col("top.id").alias("refers_id"), F.col("top.url").alias("refers_url"))
    if groups.where("top_n > 1").isEmpty():
        return gives(both, grouped & ~first, grouped & first)
    tie = grouped & first & (F.col("top_n") > 1)
    ties = both.where(tie).groupBy("id", "url", "size", "sha1").agg(F.first("payload").alias("payload"), F.first("top").alias("top"), F.count("*").alias("n"))
    step = 100_000  # an array of numbers is no longer than this
    ties = ties.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step).cast("long")))).withColumn("k", F.explode(F.sequence("from", F.least(F.col("from") + step, F.col("n")) - 1)))
    return gives(both.where(~F.coalesce(tie, F.lit(False))), grouped & ~first, grouped & first).union(gives(ties, F.col("k") > 0, F.col("k") == 0))


def train_dictionary(rows: DataFrame, date: str, sample: int, size: int) -> bytes:
    """A dictionary from the records of at most `sample` pages of least hash, SAMPLE_BYTES of each; empty if they are too few. What is in it changes no result."""
    share = F.lit(min(1.0, 2 * sample / max(rows.count(), 1)) * (1 << 32))
    some = rows.where(F.crc32(F.concat(F.lit("sample"), F.coalesce(F.col("id").cast("string"), F.lit("")))) < share)
    some = some.select(F.col("id").cast("string"), "url", "sha1", "size", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")).orderBy(F.xxhash64("id"), "id", "sha1").limit(sample)
    found = [page_record(r.asDict() | {"revisit": False, "named": False}, date) for r in some.collect()]
    try:
        return zstandard.train_dictionary(size, found).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", sample: int = 1000, dictionary_bytes: int = 64 << 10) -> None:
    """Writes a record for each row of pages to archives in the folder `to`, one dictionary for all of them.

    Null payloads count as empty. A null id or URL leaves its field out; ids are written as text, and
    what is no printable ASCII in ids and URLs is percent-encoded. Rows that repeat an id, or are alike in full, are records
    of their own. date is the one of every record. An empty table gives no archive. A task holds one archive and one page.
    """
    spark, rows = pages.sparkSession, keyed(pages, id_col, url_col, payload_col)
    dictionary = train_dictionary(rows, date, sample, dictionary_bytes)
    packed = zstandard.ZstdCompressor().compress(dictionary)
    head = struct.pack("<II", DICTIONARY, len(packed)) + packed if dictionary else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data:
            data.precompute_compress(level=LEVEL)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True).compress
        frames, held = [head], 0
        done = lambda: pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(frames)], pa.binary())})
        for b in batches:
            for page in b.to_pylist():
                frames.append(compress(page_record(page, date)))
                held += len(frames[-1])
                if held >= ARCHIVE_BYTES:
                    yield done()
                    frames, held = [head], 0
        if held:
            yield done()

    found = decided(rows, least_bytes).withColumns({c: F.col(c).cast("string") for c in ("id", "refers_id")})
    archives = found.mapInArrow(run, "archive binary")
    with small_batches(spark):
        archives.select(F.col("archive").cast("string")).write.option("lineSep", LINE_END).option("maxRecordsPerFile", 1).text(to)


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame, by the lengths that frame and block headers state."""
    at = 0
    while at < len(data):
        try:
            (magic,) = struct.unpack_from("<I", data, at)
            if magic & ~0xF == SKIPPABLE:
                end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            elif magic == FRAME:
                end, last = at + zstandard.frame_header_size(data[at : at + 32]), 0
                while not last:
                    block = int.from_bytes(data[end : end + 3], "little")
                    if end + 3 > len(data):
                        raise Damaged(f"a frame at byte {at} is cut off")
                    last, kind, size = block & 1, block >> 1 & 3, block >> 3
                    end += 3 + (1 if kind == 1 else size)
                end += 4 * zstandard.get_frame_parameters(data[at : at + 32]).has_checksum
            else:
                raise Damaged(f"no frame begins at byte {at}")
        except (struct.error, zstandard.ZstdError) as e:
            raise Damaged(f"a frame at byte {at} has no whole header") from e
        if end > len(data):
            raise Damaged(f"a frame at byte {at} is cut off")
        yield magic, at, end
        at = end


def fields_of(raw: bytes, first: str) -> dict[str, str]:
    """Fields by lower-case name; the first line must begin with `first`."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith(first):
        raise Damaged(f"a head begins with {lines[0][:20]!r}, not {first}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Damaged(f"no field: {line[:40]!r}")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def parsed(raw: bytes) -> dict:
    """A record's columns, checked: head, required fields, length of the block and what follows it, the payload's length and digest."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        raise Damaged("a record has no end of its head")
    f = fields_of(head, "WARC/1.")
    if missing := [k for k in REQUIRED if not f.get(k)]:
        raise Damaged(f"a record lacks {', '.join(missing)}")
    if not f["content-length"].isdecimal() or len(rest) != (size := int(f["content-length"])) + 4 or rest[size:] != b"\r\n\r\n":
        raise Damaged(f"a record of length {f['content-length']} has {len(rest) - 4} bytes")
    kind, payload, stated = f["warc-type"], rest[:size], None
    if f.get("content-type", "").replace(" ", "").startswith(HTTP):
        inner, blank, payload = payload.partition(b"\r\n\r\n")
        if not blank:
            raise Damaged("an HTTP head has no end")
        stated = fields_of(inner, "HTTP/").get("content-length")
        if stated is not None and not stated.isdecimal():
            raise Damaged(f"an HTTP head states a length of {stated[:20]!r}")
    algorithm, _, digest = f.get("warc-payload-digest", "").partition(":")
    if kind == "revisit":
        if not f.get("warc-refers-to") or f.get("warc-profile") != PROFILE or payload:
            raise Damaged("a revisit names no record, has another profile, or a payload")
        payload, n = None, None if stated is None else int(stated)
    else:
        n = len(payload)
        if stated is not None and int(stated) != n:
            raise Damaged(f"a payload of {n} bytes is stated as {stated}")
        if algorithm.lower() == "sha1" and base32_sha1(payload) != digest.upper():
            raise Damaged("a payload differs from its digest")
        digest = digest if algorithm.lower() == "sha1" else base32_sha1(payload)
    plain = lambda k: None if (v := f.get(k)) is None else unquote(v)
    return {"record_id": f["warc-record-id"], "record_type": kind, "refers_to_id": f.get("warc-refers-to"), "target_uri": plain("warc-target-uri"), "page_id": plain("x-page-id"), "payload_bytes": n, "payload_digest": digest.upper(), "payload": payload}


def records_of(archive: str, data: bytes) -> Iterator[dict]:
    """A row for each record; one with `error` for each that is damaged. Damage to a frame's own bounds ends the archive."""
    view, decompressor, at = memoryview(data), zstandard.ZstdDecompressor(), 0
    try:
        for magic, at, end in frames(view):
            if magic == DICTIONARY and at == 0:
                raw = bytes(view[8:end])
                raw = decompressor.decompressobj().decompress(raw) if raw[:4] == struct.pack("<I", FRAME) else raw
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            elif magic == FRAME:
                try:
                    row = parsed(decompressor.decompressobj().decompress(view[at:end]))
                except (Damaged, zstandard.ZstdError) as e:
                    row = {"error": str(e)}
                yield {"archive": archive, "offset": at} | row
    except (Damaged, zstandard.ZstdError) as e:
        yield {"archive": archive, "offset": at, "error": str(e)}


def read_archives(spark: SparkSession, at: str, payloads: bool = True, damaged: str = "raise") -> DataFrame:
    """A row for each record of the archives in a folder (or glob), with RECORD's columns; error is null in all of them.

    Works for archives of other writers too: the dictionary may be plain, compressed or absent, and records of any type are read.
    payload is null for revisits, or for all without payloads. damaged "keep" gives a row with error for each damaged
    record or archive's rest, "raise" raises. An archive is read whole by a task.
    """
    kinds = pa.schema([(c, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for c, t in (x.split() for x in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"]):
                rows, held = [], 0
                for r in records_of(path, content.as_py()):
                    if r.get("error") and damaged != "keep":
                        raise Damaged(f"{r['error']} ({path}, byte {r['offset']})")
                    held += len(r.get("payload") or b"")
                    rows.append(dict.fromkeys(COLUMNS) | r | ({} if payloads else {"payload": None}))
                    if len(rows) == 1000 or payloads and held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return spark.read.format("binaryFile").load(at).select("path", "content").mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """records with refers_to: the page_id of the response that a revisit names. One that names none, or one of another digest, raises an error.

    A response is one row of the join, so its revisits may be any number: Spark splits them.
    """
    kept = [c for c in records.columns if c != "payload"]
    revisits, others = records.where("record_type = 'revisit'"), records.where("record_type <> 'revisit'")
    targets = others.where("record_type = 'response'").select(F.col("record_id").alias("t_id"), F.col("page_id").alias("t_page"), F.col("payload_digest").alias("t_digest"))
    found = revisits.join(shuffled(targets), F.col("refers_to_id") == F.col("t_id"), "left")
    page = F.when(F.col("t_digest") == F.col("payload_digest"), F.col("t_page")).otherwise(F.raise_error(F.concat(F.lit("no response for the revisit "), "record_id")))
    return others.select(*kept, F.lit(None).cast("string").alias("refers_to")).union(found.select(*kept, page.alias("refers_to")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written as WARC archives and read back: a row for each page. Odd rows: see write_archives."""
    at, pages = shared_path(spark, "warc"), read_table(spark, sf_dir, "pages")
    write_archives(pages, at)
    with small_batches(spark):
        records = written(read_archives(spark, at, payloads=False).drop("payload"), "warc-records")
    removed(spark, at)
    kind = pages.schema["page_id"].dataType
    as_id = lambda c: F.col(c).cast(kind).alias(c)
    return resolved(records).select(as_id("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to"))


def _base32_sql(sha1: str) -> str:
    value = lambda g: f"CAST('0x' || substr({sha1}, {5 * g + 1}, 5) AS BIGINT)"
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({value(g)} >> {s}) & 31 AS BIGINT) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))


OP13_SQL = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages), m AS (SELECT s, max(page_id) AS top FROM p GROUP BY s)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_base32_sql("s")} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p JOIN m USING (s)"""
