import gzip
import re
from collections import defaultdict

import pytest

from gradespark.llm import warc

ROWS = [
    (5, "http://a/ü?x=%20 y", "<p>één</p>"), (3, "http://b", "<p>één</p>"), (9, None, None), (8, "http://c\r\nX: 1", ""), (1, "http://d", "x\r\n\r\ny"),
    (2, "http://e", "z" * 300_000), (4, "http://e", "z" * 300_000), (None, "http://f", "<p>één</p>"), (None, "http://g", "only null"), (6, "http://h", "other"),
    (6, "http://h", "other"), (3, "http://b", "<p>één</p>"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, file string, offset int").repartition(3)


def want(least=0):
    groups, out = defaultdict(list), []
    for page, _, html in ROWS:
        groups[html or ""].append(page)
    for page, _, html in ROWS:
        body = (html or "").encode()
        ids = [p for p in groups[html or ""] if p is not None]
        head = min(ids) if ids else None
        revisit = len(body) >= least and len(groups[html or ""]) > 1 and page != head
        out.append((page, len(body), warc.payload_digest(body), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 20])
@pytest.mark.parametrize("size", [256 << 20, 500])
def test_round_trip(spark, least, size):
    index = warc.write_archives(frame(spark), revisit_bytes=least, archive_bytes=size)
    assert sorted((tuple(r) for r in warc.read_records(index).collect()), key=str) == want(least)
    for row in warc.read_records(index.where("page_id = 2"), with_payload=True, gap=0, span=1).collect():
        assert (row.payload, row.url) == (b"z" * 300_000, "http://e")


def test_archives_are_plain_gzip_and_index_covers_them(spark, tmp_path):
    index = warc.write_archives(frame(spark), folder=str(tmp_path / "w")).collect()
    by_file = defaultdict(list)
    for r in index:
        by_file[r.file].append((r.offset, r.length))
    for file, spans in by_file.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        raw = gzip.open(file).read()
        assert raw.count(b"WARC/1.1\r\n") == len(spans) and len(open(file, "rb").read()) == at


def test_damage_is_found(spark):
    data, _ = warc.record(1, "u", b"payload", False, None)
    raw = gzip.decompress(data).replace(b"payload", b"pAyload")
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(raw))
    assert warc.parse(data)["payload"] == b"payload"


def test_empty_table(spark):
    assert warc.read_records(warc.write_archives(frame(spark, []))).collect() == []


def test_readers_follow_the_bytes(spark):
    index = warc.write_archives(frame(spark))
    cores = spark.sparkContext.defaultParallelism
    readers = lambda df: int(re.search(r"rangepartitioning\([^)]*, (\d+)\)", df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())[1])
    assert readers(warc.read_records(index)) == cores
    total = index.agg({"length": "sum"}).first()[0]
    assert readers(warc.read_records(index, split=10)) == -(-total // 10) > cores
    assert sorted((tuple(r) for r in warc.read_records(index, split=10).collect()), key=str) == want()
