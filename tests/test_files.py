"""Extractors of presentations and photographs, and blobs by key."""

import struct
from datetime import datetime

import pytest

from spindrift.sources import blobs, exif, files, pptx


def test_presentation_is_read():
    slides = [
        {"title": "One", "body": "first line\nsecond & <line>", "notes": "say this", "pictures": [b"a", b"b"]},
        {"title": "", "body": "No title here\nmore", "pictures": []},
        {"title": "Only", "body": "Only"},
        {"title": "Long", "body": "x" * 2000},
        {},
    ]
    about, got = pptx.read(pptx.written(slides, "Ann & Bo"))
    assert about == {"author": "Ann & Bo", "created_at": datetime(2024, 1, 2, 3, 4, 5), "modified_at": None}
    assert [(s["title"], s["body"], s["notes"], s["pictures"]) for s in got] == [
        ("One", "first line\nsecond & <line>", "say this", [b"a", b"b"]),
        ("No title here", "No title here\nmore", None, []),
        ("Only", None, None, []),
        ("Long", "x" * 1497 + "...", None, []),
        (None, None, None, []),
    ]


def jpeg(order):
    pack = lambda form, *v: struct.pack(order + form, *v)
    artist, taken = b"Ann Example\0", b"2021:02:03 04:05:06\0"
    body = 8 + 2 + 2 * 12 + 4
    sub = body + len(artist)
    tiff = (b"II" if order == "<" else b"MM") + pack("HI", 42, 8) + pack("H", 2)
    tiff += pack("HHII", 0x013B, 2, len(artist), body) + pack("HHII", 0x8769, 4, 1, sub) + pack("I", 0) + artist
    tiff += pack("H", 1) + pack("HHII", 0x9003, 2, len(taken), sub + 18) + pack("I", 0) + taken
    block = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xd9"


@pytest.mark.parametrize("order", "<>")
def test_exif(order):
    assert exif.read(jpeg(order)) == {"artist": "Ann Example", "taken_at": datetime(2021, 2, 3, 4, 5, 6)}
    assert all(exif.read(jpeg(order)[:n]) is not None for n in range(120))  # damaged at any place
    assert exif.read(b"") == exif.read(b"no image") == {}


def test_extracted_pictures(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Deck.PPTX").write_bytes(pptx.written([{"title": "T", "pictures": [b"p1"]}, {"title": "U", "pictures": [b"p2", b"p3"]}], "Ann"))
    (tmp_path / "photo.jpg").write_bytes(jpeg("<"))
    (tmp_path / "broken.pptx").write_bytes(b"no zip")
    (tmp_path / "notes.txt").write_text("not supported")
    found = files.extracted(files.corpus(spark, str(tmp_path))).collect()
    decks = sorted((r.slide_index, r.title, r.author, bytes(r.picture), r.modified_at is not None) for r in found if r.source_type == "pptx")
    assert decks == [(1, "T", "Ann", b"p1", True), (2, "U", "Ann", b"p2", True), (2, "U", "Ann", b"p3", True)]
    photo = [r for r in found if r.source_type == "image"]
    assert [(r.author, r.created_at) for r in photo] == [("Ann Example", datetime(2021, 2, 3, 4, 5, 6))]
    texts = files.slide_texts(files.corpus(spark, str(tmp_path))).collect()
    assert sorted((r.slide_index, r.title) for r in texts) == [(1, "T"), (2, "U")]


def test_blobs(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("a/1", b"one"), ("a/2", b""), ("b", None)], "key string, content binary")
    assert sorted(map(tuple, blobs.put(rows, root).collect())) == [("a/1", 3), ("a/2", 0), ("b", 0)]
    blobs.put(rows.limit(1).selectExpr("key", "binary('again') as content"), root).collect()
    assert sorted((r.key, r.size) for r in blobs.listing(spark, root).collect()) == [("a/1", 5)]  # empty ones aren't listed
    keys = spark.createDataFrame([("a/1",), ("none",)], "key string")
    assert sorted((r.key, r.content and bytes(r.content)) for r in blobs.get(keys, root).collect()) == [("a/1", b"again"), ("none", None)]
    assert sorted(map(tuple, blobs.delete(keys, root).collect())) == [("a/1", True), ("none", False)]
    assert sorted(map(tuple, blobs.delete(keys, root).collect())) == [("a/1", False), ("none", False)]
    for bad in ("../x", "/x", "a//b", ""):
        with pytest.raises(Exception, match="not a key"):
            blobs.get(spark.createDataFrame([(bad,)], "key string"), root).collect()
