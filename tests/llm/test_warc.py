import base64
import gzip
import hashlib
import zlib

from clauselake.llm import warc


def brute_force(pages, min_bytes=0):
    digest = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    best = {}
    for page_id, html in pages:
        if len((html or "").encode()) >= min_bytes:
            best[digest(html)] = max(page_id, best.get(digest(html), page_id))
    out = {}
    for page_id, html in pages:
        d, n = digest(html), len((html or "").encode())
        revisit = n >= min_bytes and best[d] != page_id
        out[page_id] = (n, d, "revisit" if revisit else "response", best[d] if revisit else None)
    return out


def found(rows):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}


PAGES = [(1, "<p>a</p>"), (2, "<p>a</p>"), (3, None), (4, ""), (5, "é\r\n\r\nWARC/1.1\r\n\r\n" * 40), (6, "x" * 900_000), (7, "x" * 900_000), (8, "<p>a</p>")]


def test_against_brute_force(spark):
    rows = [(i, None if i == 1 else f"http://h/{i}", h, "extra", 0) for i, h in PAGES]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest int").repartition(3)
    got = warc.archive_pages(pages).collect()
    assert found(got) == brute_force(PAGES)
    texts = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert all(bytes(texts[i]) == (dict(PAGES)[i] or "").encode() for i in texts)
    assert found(warc.archive_pages(pages, min_bytes=9).collect()) == brute_force(PAGES, 9)


def test_normalised_members_are_read_alone(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in PAGES], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_monolithic(warc.mark_revisits(pages, "page_id", "url", "html", 0), f"file://{tmp_path}/m")
    whole = open(archives.first().file.removeprefix("file://"), "rb").read()
    one = zlib.decompressobj(31)
    inflated = one.decompress(whole)
    assert one.eof and not one.unused_data  # one stream over the whole file
    normalised = warc.normalise_archives(archives, f"file://{tmp_path}/n")
    index = warc.read_index(spark, normalised).collect()
    assert len(index) == len(PAGES)
    parts = []
    for r in sorted(index, key=lambda r: r.offset):
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            parts.append(gzip.decompress(f.read(r.length)))
    assert b"".join(parts) == inflated
    assert all(p.startswith(b"WARC/1.1\r\n") for p in parts)


def test_empty_table_and_null_ids(spark):
    schema = "page_id long, url string, html string"
    assert warc.archive_pages(spark.createDataFrame([], schema)).count() == 0
    got = warc.archive_pages(spark.createDataFrame([(None, None, "a"), (None, "u", "a"), (3, "u", "a"), (3, "u", "a")], schema)).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in got) == [(0, "revisit"), (0, "revisit"), (3, "response"), (3, "response")]
