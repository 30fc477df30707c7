import gzip
import hashlib
import io
import os
import random

from outcomelens.llm import warc
from outcomelens.llm.common import shared_path

PAGES = "page_id long, url string, html string, extra int"


def rows():
    big, other = "<p>" + "x" * 1200, "é" * 600
    out = [(1, "http://a/?q=1", big, 0), (2, "http://b/ü x", big, 0), (3, None, big, 0), (4, "u", "small", 0), (5, "u", "small", 0),
           (6, "u", None, 0), (7, "u", "", 0), (8, "u", other, 0), (9, "u", other, 0), (None, "u", other, 0), (10, "u\r\nX: y", "y" * 999, 0),
           (11, "u", "y" * 999, 0), (12, "u", "z" * 1000, 0), (12, "u", "z" * 1000, 0), (13, "u", "\r\n\r\nWARC/1.0\r\n" + "q" * 5000, 0)]
    rng = random.Random(1)
    return out + [(100 + i, "u", "".join(rng.choice("abcdefgh <>/\n") for _ in range(rng.randint(0, 4000))), 0) for i in range(60)]


def test_round_trip_and_revisits(spark):
    data = rows()
    got = warc.digest(spark.createDataFrame(data, PAGES)).collect()
    assert len(got) == len(data)
    have = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got)
    want = []
    for i, _, html, _ in data:
        raw = (html or "").encode()
        largest = max((j for j, _, h, _ in data if (h or "") == (html or "") and j is not None), default=None)
        again = len(raw) >= 1000 and largest is not None and i != largest
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", str(largest if again else None)))
    assert have == sorted(want)


def test_every_split_size_gives_the_same_records(spark):
    folder = shared_path(spark, "test-warc")
    n = warc.write(spark.createDataFrame(rows(), PAGES).coalesce(1), folder)
    whole = sorted(tuple(r)[1:8] for r in warc.read(spark, folder).collect())
    assert len(whole) == n
    for split in (997, 5000):
        assert sorted(tuple(r)[1:8] for r in warc.read(spark, folder, split).collect()) == whole


def test_members_are_plain_gzip_and_damage_is_skipped():
    parts = [warc.member(i, "u", "page %d " % i * 50) for i in range(6)]
    assert gzip.decompress(b"".join(parts)).count(b"WARC/1.1") == 6
    junk = b"\x1f\x8b\x08" + os.urandom(40)
    damaged = parts[0] + junk + parts[1] + parts[2][:30] + parts[3] + parts[4] + parts[5]
    for split in (len(damaged), 64, 200):
        found = [r["record_id"] for s in range(0, len(damaged), split)
                 for _, r in warc.records(io.BytesIO(damaged), len(damaged), s, min(s + split, len(damaged)))]
        assert found[0] == "urn:page:0" and found[-3:] == ["urn:page:3", "urn:page:4", "urn:page:5"]


def test_empty(spark):
    assert warc.digest(spark.createDataFrame([], PAGES)).count() == 0


def test_every_split_gives_the_same_records_on_a_damaged_file():
    parts = [warc.member(i, "u", "page %d " % i * 50) for i in range(6)]
    damaged = parts[0] + b"\x1f\x8b\x08" + b"\x07" * 40 + parts[1] + parts[2][:30] + parts[3] + parts[4] + parts[5]
    for split in (len(damaged), 40, 64, 150, 200, 333):
        found = [r["record_id"] for s in range(0, len(damaged), split)
                 for _, r in warc.records(io.BytesIO(damaged), len(damaged), s, min(s + split, len(damaged)))]
        assert found == ["urn:page:%d" % i for i in (0, 1, 3, 4, 5)]


def test_very_long_pages_and_clashing_names(spark):
    import hashlib

    from pyspark.sql import functions as F

    from outcomelens.llm import warc
    long = "".join(f"<p>{i}</p>" for i in range(400_000))
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, "http://a/3", "short"), (4, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = ["digest", "keeper", "bytes", "largest", "n", "salt", "payload", "file"]
    got = {r.page_id: r for r in warc.digest(pages.select("*", *[F.lit(7).alias(n) for n in names])).collect()}
    assert got[1].payload_bytes == len(long) and got[1].payload_digest == hashlib.sha1(long.encode()).hexdigest()
    assert (got[1].record_type, got[1].refers_to) == ("revisit", 2) and got[2].record_type == "response"
    assert got[3].record_type == "response" and got[4].payload_bytes == 0
