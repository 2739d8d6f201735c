"""WARC archives of pages, and their capture index, merged from sorted runs into globally ordered capture histories.

Writing: the payload's SHA-256 finds equal payloads; of these the record with the largest id is a response, the others
are revisits of it without a payload. Records are text with their own line ends, so Spark's text writer, with its commit
of whole tasks, writes valid uncompressed WARC/1.1 files to any store; a record can be read alone by offset and length.

Reading: each archive is parsed by the lengths that it states; lengths and digests are checked against the bytes. Its
captures, sorted by URL key, time and id, are one run. Runs are stored, cut into key ranges (a hot URL is cut by time
and id as well), and a loser tree merges the slices of all runs in a range. Each range continues the histories of the one before.

Defined results: a null payload is empty; empty payloads are equal like any others; a null id is below every other, and
records whose id is the largest of equal payloads are all responses, repeated rows too; a null URL has no target URI and
the empty key, which comes first; white space in a URL is percent-encoded; an archive with a wrong length or digest ends
the job with an error; an empty table gives empty archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellwerk.llm.common import shared_dir, small_or_shuffled, stored

#: Fixed values of the format.
CRLF = "\r\n"
END = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of an archive on average, and at most (an archive is read as a whole).
ARCHIVE_BYTES, MOST_BYTES = 32 << 20, 256 << 20
#: Captures of a key range.
RANGE_ROWS = 65_536
#: Groups of equal payloads up to which their table is broadcast.
FEW_GROUPS = 100_000
CAPTURE = "run string, offset long, length long, record_type string, record_id string, refers_to string, target_uri string, url_key string, captured string, payload_bytes long, payload_digest string"
KEY = ("url_key", "captured", "record_id")


def base32(hex_text: Column) -> Column:
    """RFC 4648 base32 of hexadecimal digits, ten of them (40 bits) at a time; their number is a multiple of ten."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    part = lambda k: F.translate(F.lpad(F.conv(F.substring(hex_text, 10 * k + 1, 10), 16, 32), 8, "0"), digits, BASE32)
    return F.concat(*[part(k) for k in range(4)])


def url_key(url: str | None) -> str:
    """The host's labels from the last on, and what follows the host, without scheme, user, port and fragment; other texts stay."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)", url or "")
    if not found:
        return url or ""
    return ",".join(reversed(found[1].lower().split("."))) + ")" + (found[2] or "/")


def typed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured: Column | None = None) -> DataFrame:
    """page_id, url, captured, payload, payload_bytes, payload_digest, refers_to (null for responses) for each page."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        (F.lit("1970-01-01T00:00:00Z") if captured is None else captured).alias("captured"), payload.alias("payload"),
    )
    key = F.sha2("payload", 256)
    groups = rows.groupBy(key.alias("g_key")).agg(F.max("page_id").alias("g_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = small_or_shuffled(stored(groups, "equal-payloads"), FEW_GROUPS)
    later = (F.col("page_id") < F.col("g_id")) | (F.col("page_id").isNull() & F.col("g_id").isNotNull())
    return (
        rows.withColumn("key", key).join(groups, F.col("key") == F.col("g_key"), "left")
        .select("page_id", "url", "captured", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), F.when(later, F.col("g_id")).alias("refers_to"))
    )


def record(rows: DataFrame) -> Column:
    """A row of `typed` as a WARC record, without the two line ends that close it."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit(CRLF))
    revisit = F.col("refers_to").isNotNull()
    uri = F.col("url")
    for found, written in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        uri = F.replace(uri, F.lit(found), F.lit(written))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF), line("WARC-Record-ID", name("page_id")), line("WARC-Date", F.col("captured")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size.cast("string")), F.lit(CRLF), block,
    )


def write(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES, **columns) -> str:
    """Writes the pages' records as archives below path (one of its own in the shared folder by default), which it returns.

    Archives hold as many records as make archive_bytes on average, and fewer where the longest record asks for it.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = typed(pages, **columns)
    size = F.octet_length(F.col(f"`{columns.get('payload_col', 'html')}`").cast("string"))
    mean, most = pages.agg(F.avg(F.coalesce(size, F.lit(0))), F.max(size)).first()
    each = max(1, min(int(archive_bytes / ((mean or 0) + 500)), int(MOST_BYTES / ((most or 0) + 500))))
    rows.select(record(rows).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", each).text(path)
    return path


def parse(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """offset, length, header (names in lower case) and block of each record of an archive."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        start = raw.index(END.encode(), at) + 4
        first, *lines = raw[at : start - 4].decode().split(CRLF)
        header = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        stop = start + int(header["content-length"])
        if not first.startswith("WARC/") or raw[stop : stop + 4] != END.encode():
            raise ValueError(f"no WARC record of its stated length at {at}")
        yield at, stop + 4 - at, header, view[start:stop]
        at = stop + 4


def _capture(offset: int, length: int, header: dict[str, str], block: memoryview) -> tuple:
    """A record as a row of CAPTURE without its run; the payload of a response is checked."""
    head, _, payload = bytes(block).partition(END.encode())
    stated = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", head)[1])
    digest = header["warc-payload-digest"].removeprefix("sha1:")
    if header["warc-type"] == "response" and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{header['warc-record-id']}: the payload is not what its header states")
    uri = header.get("warc-target-uri")
    return offset, length, header["warc-type"], header["warc-record-id"], header.get("warc-refers-to"), uri, url_key(uri), header["warc-date"], stated, digest


def _runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in CAPTURE.split(", ")]
    for files in batches:
        for path, content in zip(files["path"], files["content"], strict=True):
            rows = sorted((_capture(*r) for r in parse(content)), key=lambda r: (r[6], r[7], r[3]))
            yield pd.DataFrame([(path, *r) for r in rows], columns=columns)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures in the archives below path; those of an archive are one sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return stored(files.mapInPandas(_runs, CAPTURE), "capture-runs")


def loser_tree(sources: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted iterators; equal rows come in the order of their sources.

    Each inner node keeps the loser of its match, so the next row costs one match a level, along the winner's path.
    """
    k = len(sources)
    heads = [next(s, None) for s in sources]
    tree = [-1] * max(k, 1)

    def wins(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return heads[a] < heads[b] or (heads[a] == heads[b] and a < b)

    def settled(winner: int) -> int:
        """Plays from the winner's leaf to the root; while the tree is built, the first at a node waits there (-1 returned)."""
        node = (winner + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = winner
                return -1
            if wins(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        return winner

    top = -1
    for leaf in range(k):
        top = max(top, settled(leaf))
    while k and heads[top] is not None:
        yield heads[top]
        heads[top] = next(sources[top], None)
        top = settled(top)


def _merged(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The slices of all runs in a range as one order, with each capture's place in its URL's history within the range."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    slices = []
    for _, part in rows.groupby("run", sort=True):
        heads = list(zip(*(part[c] for c in KEY), part.index, strict=True))
        slices.append(iter(heads if all(a <= b for a, b in zip(heads, heads[1:])) else sorted(heads)))
    order, places, last, n = [], [], None, 0
    for key, _, _, row in loser_tree(slices):
        n = n + 1 if key == last else 1
        last = key
        order.append(row)
        places.append(n)
    out = rows.iloc[order].copy()
    out["in_range"] = places
    yield out


def histories(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures in global order of URL key, time and id, with `nth`, the place in the URL's history from 1.

    Only the first key of a range can have captures before it: their number is taken from counts by range and key.
    """
    ranges = max(1, -(-captures.count() // range_rows))
    dealt = captures.repartitionByRange(ranges, *KEY)
    merged = stored(dealt.mapInPandas(_merged, f"{CAPTURE}, in_range long").withColumn("range", F.spark_partition_id()), "histories")
    counts = merged.groupBy("range", "url_key").agg(F.count(F.lit(1)).alias("n"))
    first = counts.groupBy("range").agg(F.min("url_key").alias("url_key"))
    spanning = counts.join(first.select("url_key").distinct(), "url_key", "left_semi")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = spanning.select(F.col("range").alias("b_range"), F.col("url_key").alias("b_key"), before.alias("before")).filter("before > 0")
    before = small_or_shuffled(before, FEW_GROUPS)
    found = merged.join(before, (F.col("range") == F.col("b_range")) & (F.col("url_key") == F.col("b_key")), "left")
    return found.withColumn("nth", F.col("in_range") + F.coalesce("before", F.lit(0))).drop("b_range", "b_key", "before", "in_range", "range")
