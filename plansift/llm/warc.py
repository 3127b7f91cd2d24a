"""WARC archives of pages, and the global index of their captures by external merge.

write() turns pages into WARC 1.1 records, each a gzip member of its own, and has Spark's text sink write their bytes; between members stands an
empty one, as the sink must put something between lines. So the archives lie wherever Spark can write, and a record can be read from its offset and length alone. An archive holds
records of one input split, RECORDS and about BYTES at most. Equal payloads of REVISIT bytes or more are kept once, in the record of the
largest page_id; the others are revisit records that refer to it. read() takes the archives back by their members and Content-Length headers.

index() gives the captures in global order of URL key, timestamp and page: each archive yields a
locally sorted run, all of which are written; their rows are counted and dealt to ranges of about RANGE rows; in each range a
loser tree merges the runs' pieces, a few hundred rows of each run at a time as values. Nothing is sorted again: a piece ends where the order falls.

Nulls: a null html is an empty payload, a null url an empty one; a null page_id is written as "null"
and read back as null, and is below any other. Rows of equal page_id and payload are equally
'response' where that page_id is the largest. An empty table gives no captures. A page is held whole in a task, an archive compressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from plansift.llm.common import SENT, cut, discard, map_rows, shared_dir, slices

REVISIT, RECORDS, BYTES, RANGE, SALTS, EPOCH = 1000, 1000, 64 << 20, 200_000, 32, 1_600_000_000
END = "\r\n\r\n"

#: A gzip member of no bytes (RFC 1952).
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
    )
    return rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "n_bytes": F.octet_length("payload").cast("long")})


def _digests(rows: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """same, original, n, n_bytes of each digest that may be revisited, and of all other rows together (same is null). Ids alone meet here, no payloads."""
    same = F.when(F.col("n_bytes") >= REVISIT, F.col("digest")).alias("same")
    return cut(rows.select(same, "page_id", "n_bytes").groupBy("same").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes")), scratch)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", digests: DataFrame | None = None) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, refers_to (null for responses) of every page.

    The digests that recur are sent to all tasks if they are SENT at most, so that no payload moves; more of them are joined to the pages that can be revisits by digest and
    salt, so that a hot payload is spread over SALTS tasks.
    """
    rows = _rows(pages, id_col, url_col, html_col)
    digests = _digests(rows) if digests is None else digests
    recur = digests.filter("same is not null and n > 1 and original is not null").select("same", "original")
    if recur.count() <= SENT:
        joined = rows.join(F.broadcast(recur), (F.col("digest") == F.col("same")) & (F.col("n_bytes") >= REVISIT), "left")
    else:
        large = rows.filter(F.col("n_bytes") >= REVISIT).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        spread = recur.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = large.join(spread, (F.col("digest") == F.col("same")) & (F.col("salt") == F.col("_salt")), "left").drop("salt", "_salt")
        joined = joined.unionByName(rows.filter(F.col("n_bytes") < REVISIT), allowMissingColumns=True)
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))).drop("same", "original")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def record_text(captured: Column) -> Column:
    """A record without its ending, as one string. captured: the capture's time in seconds of Unix time."""
    revisit = F.col("refers_to").isNotNull()
    clean = F.regexp_replace("url", r"[\r\n]", " ")
    # the HTTP block: a revisit carries the header alone
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: "), F.col("n_bytes"), F.lit(END))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), clean,
        F.lit("\r\nWARC-Date: "), F.date_format(F.timestamp_seconds(captured), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size, F.lit(END),
    )
    return F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))


@F.arrow_udf(BinaryType())
def _member(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text and a record's ending as a gzip member."""
    import gzip

    for t in texts:
        yield pa.concat_arrays([pa.array([gzip.compress((x + END).encode("utf-8", "surrogatepass"), 6, mtime=0) for x in part.to_pylist()], pa.binary()) for part in slices(t)])


def write(pages: DataFrame, path: str, per_archive: int = RECORDS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of the pages under path; each page's capture is dated EPOCH plus its page_id in seconds."""
    scratch: list[str] = []
    digests = _digests(_rows(pages, id_col, url_col, html_col), scratch)
    n, size = digests.agg(F.sum("n"), F.sum("n_bytes")).first()
    if n:
        per_archive = max(1, min(per_archive, BYTES * n // max(1, size)))
    captured = F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1_000_000_000))
    rows = records(pages, id_col, url_col, html_col, digests).select(record_text(captured).alias("value"))
    # a cast of bytes to a string keeps them as they are, and the sink writes a string's bytes
    members = rows.select(_member("value").cast("string").alias("value"))
    members.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", per_archive).text(path)
    discard(pages.sparkSession, scratch)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member with content."""
    import zlib

    at, step = 0, 1 << 16
    while at < len(data):
        member, parts, end = zlib.decompressobj(31), [], at
        while not member.eof:
            if end >= len(data):
                raise ValueError(f"gzip member at offset {at} is cut off")
            parts.append(member.decompress(data[end : end + step]))
            end += step
        end = min(end, len(data)) - len(member.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in small letters, block) of the record in a gzip member, that is of the bytes at a capture's offset and length."""
    import gzip

    return parse(gzip.decompress(member))


HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r]*)\r\n")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in small letters, block) of one record with its ending."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    body = data.index(b"\r\n\r\n") + 4
    has = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in HEADER.findall(data, data.index(b"\r\n") + 2, body - 2)}
    end = body + int(has["content-length"])
    if data[end:] != b"\r\n\r\n":
        raise ValueError("record is cut off, or goes on")
    return has, data[body:end]


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then the path and query; scheme, user, default port and fragment left out."""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{f':{port}' if port not in (None, 80, 443) else ''}){u.path.lower() or '/'}{f'?{u.query.lower()}' if u.query else ''}"


def _page(urn: str) -> int | None:
    s = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if s == "null" else int(s)


CAPTURE = "url_key string, captured string, page_id long, archive string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One capture a record, each archive's in order of URL key, time and page: a sorted run. Payload digests are computed anew and held against the header."""
    import hashlib

    def run(batches):
        for rows in batches:
            for name, data in rows:
                out = []
                for offset, length, content in members(data):
                    has, block = parse(content)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"X-Payload-Length: (\d+)", http)[1])
                    digest = has["warc-payload-digest"].removeprefix("sha1:")
                    kind = has["warc-type"]
                    if kind == "response":
                        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if f"sha1:{digest}" != has["warc-payload-digest"]:
                            raise ValueError(f"payload digest differs in {name} at {offset}")
                    out.append((url_key(has["warc-target-uri"]), has["warc-date"], _page(has["warc-record-id"]), name.rpartition("/")[2], offset, length, kind, n, digest, _page(has["warc-refers-to"]) if "warc-refers-to" in has else None))
                yield sorted(out, key=_order)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return map_rows(files.select("path", "content"), run, CAPTURE)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def merge(runs: list[Iterator[tuple]], key=_order) -> Iterator[tuple]:
    """The rows of sorted runs in one order, by a tree of losers: each next row takes one comparison a level."""
    n = len(runs)
    runs = [iter(r) for r in runs]
    heads = [next(r, None) for r in runs]
    keys = [None if h is None else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    if not n:
        return
    loser = [0] * n  # loser[0] holds the winner
    winners = [0] * n + list(range(n))
    for k in range(n - 1, 0, -1):
        a, b = winners[2 * k], winners[2 * k + 1]
        winners[k], loser[k] = (a, b) if beats(a, b) else (b, a)
    w = winners[1] if n > 1 else 0
    while keys[w] is not None:
        yield heads[w]
        heads[w] = next(runs[w], None)
        keys[w] = None if heads[w] is None else key(heads[w])
        k = (w + n) // 2
        while k:
            if beats(loser[k], w):
                loser[k], w = w, loser[k]
            k //= 2


def index(captures: DataFrame, rows_a_range: int = RANGE) -> DataFrame:
    """All captures; a partition holds a range of URL key, time and page, in order, later partitions later ranges.

    A hot URL or host doesn't fill a range, as time and page are part of the ranges' bounds. captures: as read() gives them; they should be
    written, as they are counted, sampled and dealt.
    """
    keys = ["url_key", "captured", F.col("page_id").asc_nulls_first()]
    ranges = max(1, -(-captures.count() // rows_a_range))

    def rows_of(pieces: list[pa.RecordBatch]) -> Iterator[tuple]:
        for b in pieces:
            for low in range(0, b.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in b.slice(low, 256).columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, schema, last = [], None, None
        for b in batches:
            schema, low = b.schema, 0
            for at, key in enumerate(map(_order, rows_of([b]))):
                if last is not None and key < last:
                    if at > low:
                        runs[-1].append(b.slice(low, at - low))
                    runs.append([])
                    low = at
                elif last is None:
                    runs.append([])
                last = key
            if b.num_rows > low:
                runs[-1].append(b.slice(low))
        out: list[tuple] = []
        for row in merge([rows_of(pieces) for pieces in runs]):
            out.append(row)
            if len(out) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # a shuffle hands on what a map task wrote for a range in the order it was read, so a range gets sorted pieces one after another; where
    # the order falls a new one begins, and whatever comes, pieces are sorted
    return captures.repartitionByRange(ranges, *keys).mapInArrow(run, CAPTURE)


def archive(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes the pages' archives, reads them back, and returns the merged index of their captures. Without a path the archives are deleted once they are read."""
    spark = pages.sparkSession
    own = path is None
    path = path or shared_dir(spark)
    write(pages, path, **columns)
    captures = cut(read(spark, path))
    if own:
        discard(spark, [path])
    return index(captures)
