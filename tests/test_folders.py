"""The walk, image headers and snapshots on real files."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from linequarry.operators import folders as D


def test_walk(spark, tmp_path):
    top = tmp_path / "in"
    for rel, raw in (("b.pdf", b"%PDF-1"), ("A.PDF", b"%PDF-2"), ("c.djvu", b"wrong"), ("notes.txt", b"x"), ("Zeta/one.png", b"p"), ("alpha/two.jpg", b"j"), ("alpha/deep/three.pdf", b"%PDF-"), ("work/in.pdf", b"%PDF-"), ("empty.pdf", b"")):
        (top / rel).parent.mkdir(parents=True, exist_ok=True)
        (top / rel).write_bytes(raw)
    os.link(top / "A.PDF", top / "zz.pdf")
    os.symlink(top / "b.pdf", top / "link.pdf")
    os.symlink(tmp_path, top / "loop")
    got = {r.path: (r.ordinal, r.state) for r in D.walked(spark, str(top), skip=(str(top / "work"),)).collect()}
    order = [p for p, _ in sorted(got.items(), key=lambda x: x[1][0])]
    assert order == ["A.PDF", "b.pdf", "c.djvu", "empty.pdf", "notes.txt", "zz.pdf", "alpha/two.jpg", "alpha/deep/three.pdf", "Zeta/one.png"]
    assert [got[p][1] for p in order] == ["ok", "ok", "signature", "signature", "unsupported", "duplicate", "ok", "ok", "ok"]
    assert D.walked(spark, str(top), include=["b.pdf", "nothing"]).count() == 1
    (tmp_path / "none").mkdir()
    assert D.walked(spark, str(tmp_path / "none")).count() == 0
    assert D.listing(spark, str(tmp_path / "missing")).first().kind == "error"


def test_file_that_changes_while_it_is_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-")
    seen = D.listing(spark, str(tmp_path)).where("kind = 'file'").withColumn("size_after", F.col("size_after") + 1)
    from linequarry.operators.intake import checked_files

    files = seen.select(F.lit(1).alias("ordinal"), F.col("rel").alias("path"), "size", "mtime", "device", "inode", F.lit(True).alias("matches"), "size_after", "mtime_after")
    assert checked_files(files).first().state == "changed"


def _chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png(w, h, *more):
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + b"".join(more) + _chunk(b"IEND", b"")


def _ifd(order, w, h, after, kind=4):
    value = lambda v: struct.pack(order + ("I" if kind == 4 else "HH"), *((v,) if kind == 4 else (v, 0)))
    return struct.pack(order + "H", 2) + b"".join(struct.pack(order + "HHI", t, kind, 1) + value(v) for t, v in ((256, w), (257, h))) + struct.pack(order + "I", after)


def _tiff(order, *frames):
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + b"".join(frames)


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc4\x00\x02\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\x01\x01\x11\x00\xff\xd9"


@pytest.mark.parametrize("raw,want", [
    (_png(3, 4), ("png", 1, 3, 4, None)), (_png(3, 4, _chunk(b"acTL", struct.pack(">II", 5, 0))), ("png", 5, 3, 4, None)), (_png(3, 4)[:40], ("png", None, None, None, "truncated")),
    (_png(3, 4).replace(b"\x00\x00\x00\x04\x08", b"\x00\x00\x00\x05\x08"), ("png", None, None, None, "checksum")), (b"\x89PNG\r\n\x1a\n" + _chunk(b"IDAT", b""), ("png", None, None, None, "no_header")),
    (JPEG, ("jpeg", 1, 9, 7, None)), (JPEG[:12], ("jpeg", None, None, None, "truncated")), (b"\xff\xd8\xff\xd9", ("jpeg", None, None, None, "no_frame")), (b"\xff\xd8xx", ("jpeg", None, None, None, "marker")),
    (_tiff("<", _ifd("<", 5, 6, 38), _ifd("<", 7, 8, 0)), ("tiff", 2, 7, 8, None)), (_tiff(">", _ifd(">", 5, 6, 0, 3)), ("tiff", 1, 5, 6, None)), (_tiff("<", _ifd("<", 5, 6, 38), _ifd("<", 7, 8, 8)), ("tiff", None, None, None, "cycle")),
    (_tiff("<", _ifd("<", 5, 6, 9999)), ("tiff", None, None, None, "truncated")), (_tiff("<")[:6], ("tiff", None, None, None, "truncated")), (b"II*\0\0\0\0\0", ("tiff", None, None, None, "no_frame")),
    (b"text", (None, None, None, None, "no_image")), (None, (None, None, None, None, "no_image")),
])
def test_image_header(raw, want):
    assert D.image_header(raw) == want


def test_more_frames_than_allowed():
    frames = [_ifd("<", 1, 1, 8 + 30 * (k + 1) if k < 5001 else 0) for k in range(5002)]
    assert D.image_header(_tiff("<", *frames))[1] > D.MOST_FRAMES


def test_image_files(spark, tmp_path):
    for name, raw in (("a.png", _png(3, 4)), ("b.png", JPEG), ("c.jpg", JPEG), ("d.tif", _tiff("<", _ifd("<", 30_001, 6, 0))), ("e.png", _png(0, 4)), ("g.tiff", _tiff("<", _ifd("<", 1, 1, 8))), ("h.png", _png(30_000, 30_000))):
        (tmp_path / name).write_bytes(raw)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    files = files.unionAll(spark.createDataFrame([("x/f.png", bytearray())], "path string, content binary"))  # the source leaves empty files out
    got = {r.path[-5:-4] if not r.path.endswith("tiff") else "g": r.problem for r in D.image_headers(files).collect()}
    assert got == {"a": None, "b": "format_mismatch", "c": None, "d": "edge", "e": "empty", "f": "format_mismatch", "g": "damaged", "h": "pixels"}


def test_snapshots(spark, tmp_path):
    data, vault = tmp_path / "data", str(tmp_path / "vault")
    (data / "x").mkdir(parents=True)
    (data / "x" / "one").write_bytes(b"one" * 100)
    (data / "two").write_bytes(b"one" * 100)  # the same content
    (data / "nil").write_bytes(b"")
    first = D.back_up(spark, str(data), vault)
    assert sum(len(f) for _, _, f in os.walk(f"{vault}/objects")) == 2
    (data / "two").write_bytes(b"changed")
    second = D.back_up(spark, str(data), vault)
    assert D.snapshots(vault) == [first, second]
    assert D.restore(spark, vault, first, str(tmp_path / "back")) == 3 and (tmp_path / "back" / "two").read_bytes() == b"one" * 100 and (tmp_path / "back" / "nil").exists()
    with pytest.raises(FileExistsError):
        D.restore(spark, vault, first, str(tmp_path / "back"))
    assert D.retain(spark, vault, 1) == [first] and D.snapshots(vault) == [second] and D.damaged(spark, vault, second).count() == 0
    with pytest.raises(D.SnapshotDamaged):
        D.restore(spark, vault, first, str(tmp_path / "gone"))
    sha = D._sha(str(data / "two"))
    os.remove(f"{vault}/objects/{sha[:2]}/{sha}")
    assert [r.rel for r in D.damaged(spark, vault, second).collect()] == ["two"]
    with pytest.raises(D.SnapshotDamaged):
        D.restore(spark, vault, second, str(tmp_path / "no"))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("no")]
