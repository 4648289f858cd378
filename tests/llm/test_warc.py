import base64
import hashlib

from tallyhold.llm import common, warc


def want(rows):
    """{(page_id, payload)}: the largest page_id of each payload."""
    last = {}
    for p, h in rows:
        last[h] = max(last.get(h, p), p)
    return sorted((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if last[h] == p else "revisit", None if last[h] == p else last[h]) for p, h in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.op2_warc_roundtrip(spark, sf).collect())) == want(rows)


def test_files_are_deterministic_and_edges(spark):
    rows = [(i, None if i % 9 == 0 else f"http://a/{i}\n", ["same é", None, "", f"own {i}" * 300][i % 4], 1) for i in range(60)]
    pages = spark.createDataFrame([*rows, (59, "http://b", "twice", 1), (59, "http://b", "twice", 1), (None, None, "twice", 1)], "page_id long, url string, html string, at int")
    sums = []
    for n in (1, 5):
        folder = common.shared_dir(spark, "test")
        manifest = warc.write_warc(pages.repartition(n), folder, range_bytes=20_000, file_bytes=2_000)
        sums.append(sorted((r.file, r.records, r.sha256) for r in manifest.collect()))
        back = [tuple(r) for r in warc.read_warc(folder, manifest).collect()]
        assert len(back) == 63 and manifest.count() > 5
        plain = [(r[0], r[3], r[4], r[2], r[5]) for r in back if r[0] is not None and r[0] != 59]
        assert sorted(plain) == [x for x in want([(r[0], (r[2] or "").encode()) for r in rows]) if x[0] != 59]
        twice = sorted((r[0] or 0, r[2], r[5]) for r in back if r[4] == base64.b32encode(hashlib.sha1(b"twice").digest()).decode())
        assert twice == [(0, "revisit", 59), (59, "response", None), (59, "revisit", 59)]
    assert sums[0] == sums[1]
    folder = common.shared_dir(spark, "test")
    assert warc.read_warc(folder, warc.write_warc(pages.limit(0), folder)).count() == 0


def test_ids_are_exact_and_one_page_id_is_split(spark):
    big = 2**53
    ids = [big + 1, big + 3, -(2**63), 2**63 - 1, None, 0]
    rows = [(i, "u", "same") for i in ids] + [(big + 1, "u", None), (-(2**63), "u", "x")] + [(None, "u", f"{k} " * 2000) for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.shared_dir(spark, "test")
    manifest = warc.write_warc(pages, folder, range_bytes=10_000)
    assert len({r.file[:13] for r in manifest.collect()}) > 5  # ranges of null page ids alone
    back = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(folder, manifest).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in (r[0], r[1]))
    same = [(i, 4, "response" if i == 2**63 - 1 else "revisit", None if i == 2**63 - 1 else 2**63 - 1) for i in ids]
    assert sorted((r for r in back if r[1] == 4), key=key) == sorted(same, key=key)
    assert len(back) == len(rows) and (big + 1, 0, "response", None) in back and (-(2**63), 1, "response", None) in back
