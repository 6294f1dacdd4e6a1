import gzip
import hashlib
import io

import pytest

from tabaudit.llm import warc as W
from tabaudit.llm.files import open_store, shared_folder
from tests.llm.helpers import clashing

BIG = "<p>" + "x" * 1200 + "é</p>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (7, None, BIG), (3, "http://b/ sp\nace", "small"), (4, "http://b/4", "small"),
         (5, "http://c/", None), (6, "http://c/", ""), (7, None, BIG), (None, "http://d/", BIG), (8, "http://e/", "y" * 1000), (9, "http://e/", "y" * 1000),
         (10, "http://e/", "z" * 999), (11, "http://e/", "z" * 999), (12, "u", "line\r\n\r\nWARC/1.1\r\nend")]


def frame(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def expected(data):
    out = []
    for pid, _, h in data:
        raw = (h or "").encode()
        same = [p for p, _, x in data if (x or "") == (h or "") and p is not None]
        keep = max(same) if len(raw) >= 1000 and sum((x or "") == (h or "") for _, _, x in data) > 1 else None
        revisit = keep is not None and pid != keep
        out.append((pid, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kw", [{}, {"range_bytes": 1500, "file_bytes": 200}])
def test_round_trip(spark, kw):
    df = clashing(frame(spark, PAGES), "keep", "digest", "range_no", "n", "path")
    folder = shared_folder(spark, "test-warc")
    manifest = W.write_warc(df, folder, **kw)
    got = W.read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(PAGES)


def test_shuffle_join_gives_the_same(spark):
    rows = W.mark_revisits(frame(spark, PAGES), broadcast_rows=0).select("page_id", "html", "keep").collect()
    both = W.mark_revisits(frame(spark, PAGES)).select("page_id", "html", "keep").collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, both))


def test_files_are_sorted_and_equal_for_equal_input(spark):
    data = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(300)]
    made = []
    for parts in (1, 4):
        folder = shared_folder(spark, "test-warc")
        files = W.write_warc(frame(spark, data).repartition(parts), folder, range_bytes=20_000, file_bytes=3000).collect()
        store = open_store(folder)
        made.append({r.path: store.open(r.path).read() for r in files})
        for r in files:
            assert hashlib.sha1(made[-1][r.path]).hexdigest() == r.sha1 and len(made[-1][r.path]) == r.bytes
            ids = [int(h["Page-ID"]) for h, _ in W.read_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(made[-1][r.path]))))]
            assert ids == sorted(ids) and (ids[0], ids[-1], len(ids)) == (r.first_page_id, r.last_page_id, r.records)
    assert made[0] == made[1] and len(made[0]) > 5


def test_damage_is_found(spark):
    folder = shared_folder(spark, "test-warc")
    manifest = W.write_warc(frame(spark, PAGES[:1]), folder)
    store = open_store(folder)
    name = manifest.first()["path"]
    raw = gzip.decompress(store.open(name).read()).replace(b"xxxx", b"xxyx", 1)
    sink = store.create("other")
    sink.write(gzip.compress(raw))
    sink.close()
    store.commit("other", name)
    with pytest.raises(Exception, match="differs from its digest"):
        W.read_warc(manifest, folder).collect()


def test_empty_table(spark):
    folder = shared_folder(spark, "test-warc")
    manifest = W.write_warc(frame(spark, []), folder)
    assert manifest.count() == 0 and W.read_warc(manifest, folder).count() == 0
