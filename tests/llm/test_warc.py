import hashlib

from ledgerlens.llm import warc
from ledgerlens.llm.common import fresh_path

PAGES = "page_id long, url string, html string, record string, head string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def brute(rows):
    first = {}
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault((h or "").encode(), p)
    out, seen = [], set()
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        again = len(data) >= 100 and data in seen
        seen.add(data)
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=repr)


def test_round_trip_with_odd_payloads(spark):
    same, inside = "é" * 80, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9 + "ü\r\n\r\n"
    rows = [(1, "http://a/", same), (2, "http://b/ c\r\nX: y", same), (3, None, "short"), (4, "http://d/", "short"), (5, "u", None),
            (6, "u", ""), (7, "u", inside), (8, "v", inside), (9, "w", "x" * 300_000), (9, "w", same), (9, "w", same),
            (None, "n", same), (10, "t", "ends\r\n\r\n"), (11, "t", "WARC/1.1\r\n"),
            (12, "t", "\r\nWARC/1.1\r\n"), (13, "t", "x\r\n\r\nWARC/1.1"), (14, "t", "\n\r\n\r\nWARC/1.1\r\n\r\n\r\n")]
    got = warc.deduplicated_archive(pages(spark, rows)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_archive_records_are_well_formed(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages(spark, [(1, "http://a/", "x" * 200), (2, "http://b/", "y")]), path)
    raw = spark.read.option("lineSep", "\r\n\r\n\r\n\r\n").text(path).collect()
    text = "".join(r.value for r in raw)
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and "WARC-Record-ID: <urn:uuid:" in text
    assert sorted(r.payload_bytes for r in warc.read_archives(spark, path).collect()) == [1, 200]


def test_no_pages(spark):
    assert warc.deduplicated_archive(pages(spark, []).limit(0)).count() == 0


def test_archives_are_parsed_once(spark):
    """The joins of revisits and responses read written headers, not the archives again."""
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages(spark, [(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200)]), path)
    read = warc.read_archives(spark, path)
    assert read.count() == 2 and not any("warc-test" in f for f in read.inputFiles())
