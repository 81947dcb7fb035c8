import gzip
import hashlib
import os
import random

from sieveworks.llm import warc
from sieveworks.llm.queries import op5_warc

from .util import rows

PAGES = "page_id long, url string, html string, payload string, path string, digest string, size long"


def pages(spark, some):
    return spark.createDataFrame([(*p, None, "clash", None, None) for p in some], PAGES)


def brute(table):
    last = {}
    for i, h in table:
        if len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    out = []
    for i, h in table:
        b = (h or "").encode()
        revisit = h in last and last[h] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf_dir):
    table = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert rows(op5_warc(spark, sf_dir), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute(table)


def test_round_trip_in_ranges_of_any_size(spark, tmp_path):
    rng = random.Random(11)
    noise = lambda n: "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(n))
    twin, edge, short = noise(3000), "e" * 1000, "s" * 999
    some = [(1, "http://a/\r\nx%20é", twin), (2, None, twin), (-5, "u", twin), (4, "u", None), (5, "", ""), (6, "u", edge), (7, "u", edge), (8, "u", short), (9, "u", short), (None, "n", twin), (2, "again", twin), (2**62 + 3, "big", noise(200_000))]
    some += [(100 + i, f"http://p/{i}", noise(rng.randint(0, 4000))) for i in range(60)]
    some += [(500, "magic", "\x1f\x1f " + "WARC/1.1\r\n\r\n" * 90)]
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, some).repartition(2), path)
    want = sorted(((i, None if u is None else u.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")) for i, u, _ in some), key=str)
    for span in (997, 40_000, 1 << 25):
        got = warc.read_archives(spark, path, span)
        assert rows(got, "page_id", "url") == want
        assert got.filter("record_type = 'response' and page_id >= 100").count() == 62
        for r in got.filter("payload is not null").collect():
            assert len(r.payload) == r.payload_bytes and hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got.collect()}
    assert {(1, "revisit", 2), (2, "response", None), (-5, "revisit", 2), (6, "revisit", 7), (7, "response", None), (8, "response", None), (9, "response", None), (None, "response", None)} <= kinds
    for f in os.listdir(path):  # the files are gzip through and through
        if not f.startswith(("_", ".")):
            with gzip.open(os.path.join(path, f)) as g:
                assert g.read().startswith(b"WARC/1.1") or os.path.getsize(os.path.join(path, f)) == 0


def test_large_members_and_false_magic(tmp_path):
    big = os.urandom(1 << 20).hex() * 9  # over 16 MB unpacked
    m = warc.member(3, "u", big.encode(), hashlib.sha1(big.encode()).hexdigest(), None, False)
    assert m.endswith(b"\0")
    junk = b"\x1f\x8b\x08\0" * 50 + os.urandom(1000) + b"\x1f\x8b\x08"
    other = gzip.compress(b"no record")
    (tmp_path / "a").write_bytes(junk + m + other + junk + m[:-40])
    size = os.path.getsize(tmp_path / "a")
    got = [r for a in range(0, size, 1 << 20) for r in warc.records_in(f"file:{tmp_path}/a", size, a, min(size, a + (1 << 20)))]
    assert [(r[5], r[7], r[3]) for r in got] == [(3, len(big), "response"), (None, 0, warc.DAMAGED)]


def test_no_pages(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0
