import gzip
import zlib

from quillon.llm import arc_convert as a
from quillon.llm.storage import fresh_path


def test_pages_with_the_url_of_a_version_block_stay(spark):
    df = spark.createDataFrame([(1, "filedesc://page", "x"), (2, "http://b", "y"), (3, "filedesc:", "z"), (3, "filedesc:", "z")], "page_id long, url string, html string").coalesce(1)
    assert sorted(r.page_id for r in a.archive_pages(df, fresh_path(spark, "warc")).collect()) == [1, 2, 3, 3]


def test_urls_are_kept_but_for_white_space(spark):
    urls = ["http://x/a%20b?q=%C3%A9&r=50%", "http://x/a b\tc", "http://x/é", None]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    found = {r.page_id: r.url for r in a.archive_pages(df, fresh_path(spark, "warc")).collect()}
    assert found == {0: urls[0], 1: "http://x/a%20b%09c", 2: urls[2], 3: "-"}


def test_ids_differ_and_revisits_resolve(spark):
    same = "s" * 2000
    rows = [(1, "u", "one"), (1, "u", "two"), (1, "u", "two"), (2, "v", same), (3, "w", same), (3, "w", same), (4, "x", same)]
    path = fresh_path(spark, "warc")
    found = a.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path).collect()
    assert len({r.record_id for r in found}) == len(rows)
    assert sorted((r.page_id, r.refers_to, r.payload_bytes) for r in found if r.record_type == "revisit") == [(2, 4, 2000), (3, 4, 2000), (3, 4, 2000)]
    for file in spark.read.format("binaryFile").load(path).collect():
        data, members = file.content.rstrip(b"\0"), []
        while data:  # each record by itself
            unzip = zlib.decompressobj(31)
            members.append(unzip.decompress(data))
            data = unzip.unused_data
        assert all(len(list(a.read_warc(m))) == 1 for m in members) and b"".join(members) == gzip.decompress(file.content)
        heads = [h for m in members for h, _ in a.read_warc(m)]
        assert not any(k.startswith("x-") for h in heads for k in h)
