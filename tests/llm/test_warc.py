import glob
import hashlib

import pytest
import zstandard

from renderscope.llm import warc

BIG = "é" * 600
PAGES = [
    (1, "http://a.org/", BIG, "digest"),
    (2, "http://b.org/\r\nX: y z", BIG, None),
    (3, None, None, None),
    (4, "", "", "x"),
    (5, "http://c.org/", "small", "x"),
    (6, "http://d.org/", "small", "x"),
    (7, "http://e.org/", BIG, "x"),
    (7, "http://e.org/", BIG, "x"),
    (None, "http://f.org/", BIG, "x"),
    (8, "http://g.org/", "x\r\n\r\n" * 200_000, "x"),
]


def table(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")


def test_round_trip(spark):
    got = warc.round_trip(table(spark)).collect()
    want = []
    for page, _, html, _ in PAGES:
        data = (html or "").encode()
        newest = max((p for p, _, h, _ in PAGES if h == html and p is not None), default=None)
        revisit = len(data) >= 1000 and page is not None and page < newest
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", newest if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(table(spark).limit(0)).collect() == []


def test_archive_has_its_dictionary_first(spark, tmp_path):
    rows = [(i, f"http://a.org/{i}", f"<p>page {i} of the same site</p>" * 200, "x") for i in range(400)]
    warc.write_archives(warc.with_revisits(table(spark, rows).coalesce(1)), str(tmp_path / "a"))
    (name,) = glob.glob(f"{tmp_path}/a/part-*")
    data = open(name, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    frames = [warc.parse_record(x) for x in warc.frames_of(data)]
    assert [f["payload"].decode() for f in sorted(frames, key=lambda f: f["page_id"])] == [r[2] for r in rows]
    with pytest.raises(warc.BadArchive):  # without the dictionary nothing can be decoded
        list(warc.frames_of(data[8 + int.from_bytes(data[4:8], "little") :]))
    with pytest.raises(warc.BadArchive):
        list(warc.frames_of(data[:-20]))


def test_dictionary_may_be_compressed():
    d = zstandard.ZstdCompressionDict(b"the same words again and again " * 9, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    record = warc.record_bytes(1, "http://a.org/", b"the same words", hashlib.sha1(b"the same words").hexdigest(), "response", None, "2024-01-01T00:00:00Z")
    head = warc.skippable(zstandard.compress(d.as_bytes()))
    data = head + zstandard.ZstdCompressor(dict_data=d).compress(record) + warc.skippable(b"")
    assert [warc.parse_record(x)["payload"] for x in warc.frames_of(data)] == [b"the same words"]


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"),
        lambda r: r.replace(b"WARC-Type: response\r\n", b""),
        lambda r: r[:-1],
        lambda r: r.replace(b"Content-Length: 4\r\n", b"Content-Length: 5\r\n"),
        lambda r: r.replace(b"body", b"bodx"),
        lambda r: r.replace(b"WARC-Date:", b"WARC-Date"),
        lambda r: r.replace(b"urn:page:1", b"urn:page:x"),
    ],
)
def test_bad_records(change):
    good = warc.record_bytes(1, "http://a.org/", b"body", hashlib.sha1(b"body").hexdigest(), "response", None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(good)["payload"] == b"body"
    with pytest.raises(warc.BadArchive):
        warc.parse_record(change(good))
