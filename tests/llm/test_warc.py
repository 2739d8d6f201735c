"""Archives: round trip, revisits, the loser tree, histories over several ranges, awkward pages, damage."""

import base64
import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stellwerk.llm import q_warc, warc

SF = "/root/testdata/sf0.001"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def read(captures):
    return sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in captures.collect()), key=str)


@pytest.mark.parametrize("k", [0, 1, 2, 5, 8, 13])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted((r.randint(0, 9), i, j) for j in range(r.choice([0, 0, 1, 5, 30]))) for i in range(k)]
    assert list(warc.loser_tree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_url_keys():
    keys = {
        "http://A.Example.com/x?q=1#f": "com,example,a)/x?q=1", "https://u:p@b.org:8080": "org,b)/", "mailto:x": "mailto:x", None: "", "": "", "http://": ")/", "http://c.net?z": "net,c)?z",
    }
    assert {u: warc.url_key(u) for u in keys} == keys


def test_revisits(spark):
    rows = [(1, "u", "same"), (5, "u", "same"), (3, "v", "same"), (None, "v", "same"), (2, "w", None), (4, "w", ""), (6, "x", "é\r\n\r\nWARC/1.1\r\n\r\n"), (6, "x", "é\r\n\r\nWARC/1.1\r\n\r\n"), (7, None, "own"), (None, "a b\r\nc", "lone"), (None, "q", "lone")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, key string")
    path = warc.write(pages, archive_bytes=2_000)
    captures = warc.runs(spark, path)
    want = []
    for page_id, _, html in rows:
        ids = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        later = bool(ids) and (page_id is None or page_id < max(ids))
        name = lambda i: f"<urn:page:{'' if i is None else i}>"
        want.append((name(page_id), "revisit" if later else "response", name(max(ids)) if later else None, len((html or "").encode()), digest(html)))
    assert read(captures) == sorted(want, key=str)
    assert {r.target_uri for r in captures.collect()} == {"u", "v", "w", "x", "q", None, "a%20b%0D%0Ac"}
    whole = {f: open(f, "rb").read() for f in glob.glob(f"{path}/part-*")}
    for r in captures.collect():
        (raw,) = [x for f, x in whole.items() if r.run.endswith(f.rsplit("/", 1)[1])]
        alone = raw[r.offset : r.offset + r.length]
        assert alone.startswith(b"WARC/1.1\r\n") and alone.endswith(b"\r\n\r\n") and r.record_id.encode() in alone


def test_histories(spark):
    """One URL holds half of all captures, and ranges are far smaller than it."""
    rows = [(k, "http://hot.org/" if k % 2 else f"http://h{k % 7}.org/{k % 5}", f"text {k}") for k in range(1_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    stamp = F.concat(F.lit("2024-01-01T00:"), F.lpad((F.col("page_id") * 37 % 60).cast("string"), 2, "0"), F.lit(":00Z"))
    captures = warc.runs(spark, warc.write(pages, captured=stamp, archive_bytes=20_000))
    assert captures.select("run").distinct().count() > 6
    found = [(r.url_key, r.captured, r.record_id, r.nth) for r in warc.histories(captures, range_rows=90).collect()]
    want = sorted((warc.url_key(u), f"2024-01-01T00:{k * 37 % 60:02d}:00Z", f"<urn:page:{k}>") for k, u, _ in rows)
    assert sorted(x[:3] for x in found) == want
    nth, numbered = {}, []
    for x in want:
        nth[x[0]] = nth.get(x[0], 0) + 1
        numbered.append((*x, nth[x[0]]))
    assert sorted(found) == numbered


def test_archives_that_are_damaged(spark, tmp_path):
    path = warc.write(spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string"))
    (file,) = [f for f in glob.glob(f"{path}/part-*") if open(f, "rb").read()]
    raw = open(file, "rb").read()
    for name, bad in (("digest", raw.replace(b"some text", b"some tixt")), ("length", raw.replace(b"some text", b"some txt"))):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "part-0").write_bytes(bad)
        with pytest.raises(Exception, match="header states|stated length|subsection not found"):
            warc.runs(spark, str(folder))


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.histories(warc.runs(spark, warc.write(pages))).count() == 0


def test_pages(spark):
    """Every page of the table, whole, with a copy of one page under a smaller and a larger id."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r for r in q_warc.op12_warc(spark, SF).collect()}
    for p in pages.collect():
        r = found.pop(p.page_id)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p.html.encode()), digest(p.html), "response", None)
    assert not found
