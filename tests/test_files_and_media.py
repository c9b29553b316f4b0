"""Files, bytes and names: the cases that no table of the queries holds."""

import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from amberlode.functions import media
from amberlode.functions import semantics as S
from amberlode.operators import flows as X
from amberlode.operators import health as H
from amberlode.operators import placement as P
from amberlode.sources import files


def tiff(date, order="<", tag=36867, deep=True):
    """A TIFF block with one date, behind a pointer if deep."""
    text = date.encode() + b"\0"
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8)
    if not deep:
        return head + struct.pack(f"{order}HHHII", 1, tag, 2, 20, 26) + bytes(4) + text
    first = struct.pack(f"{order}HHHII", 1, 34665, 4, 1, 26) + bytes(4)
    return head + first + struct.pack(f"{order}HHHII", 1, tag, 2, 20, 44) + bytes(4) + text


def jpeg(date, payload=b""):
    block = b"Exif\0\0" + tiff(date)
    return b"\xff\xd8" + b"\xff\xe0\0\4ab" + b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda" + payload


def movie(seconds, version=0):
    head = struct.pack(">B3x", version) + struct.pack(">Q" if version else ">I", seconds) + bytes(8)
    inner = struct.pack(">I4s", 8 + len(head), b"mvhd") + head
    return struct.pack(">I4s", 8, b"free") + struct.pack(">I4s", 8 + len(inner), b"moov") + inner


def test_dates_in_bytes():
    day = datetime(2018, 3, 15, 12, 0, 0)
    said = lambda raw, ext: media.embedded(raw, ext, S.VIDEO_EXT, 2024)
    text = "2018:03:15 12:00:00"
    for raw, ext in ((jpeg(text), "jpg"), (tiff(text, "<"), "tif"), (tiff(text, ">"), "nef"), (tiff(text, ">", 306, False), "dng")):
        assert said(raw, ext) == (day, "exif")
    heic = b"ftypheic" + b"infe" + bytes(40) + b"Exif\0\0" + b"II*\0junkjunk" + bytes(19_000)
    assert said(heic + tiff(text, "<"), "heic") == said(heic + tiff(text, ">"), "heic") == (day, "exif")
    assert said(heic + tiff(text, "<"), "jpg") == (None, None) and said(jpeg("1970:01:01 00:00:00"), "jpg") == (None, None) and said(jpeg("2018:02:31 00:00:00"), "jpg") == (None, None)
    seconds = int((day - datetime(1904, 1, 1)).total_seconds())
    assert said(movie(seconds), "mov") == said(movie(seconds, 1), "mp4") == (day, "quicktime") and said(movie(seconds), "jpg") == (None, None) and said(movie(0), "mov") == (None, None)
    for raw in (None, b"", b"\xff\xd8", b"\xff\xd8\xff\xe1", b"II*\0", b"II*\0\xff\xff\xff\xff", b"\0\0\0\1moov"):
        assert said(raw, "mov") == (None, None)


def png(pixels, kinds):
    height, width, channels = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    out, p = [], np.zeros((height + 1, width + 1, channels), int)
    p[1:, 1:] = pixels
    for y in range(1, height + 1):
        kind, line = kinds[y % len(kinds)], []
        for x in range(1, width + 1):
            for k in range(channels):
                a, b, c = p[y, x - 1, k], p[y - 1, x, k], p[y - 1, x - 1, k]
                near = min((abs(a + b - c - v), i) for i, v in enumerate((a, b, c)))[1]
                line.append((p[y, x, k] - [0, a, b, (a + b) // 2, (a, b, c)[near]][kind]) % 256)
        out.append(bytes([kind, *line]))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_pixels_of_all_filters(channels):
    pixels = np.random.default_rng(channels).integers(0, 256, (20, 18, channels))
    assert (media.png_pixels(png(pixels, [0, 1, 2, 3, 4])) == pixels).all()


def test_grids_of_images(spark):
    falling = np.tile(np.arange(90, 0, -1)[None, :, None], (80, 1, 1))
    rows = spark.createDataFrame([(1, png(falling, [1])), (2, b"no image"), (3, None)], "id int, content binary").select("id", media.image_grid("content").alias("x")).select("id", "x.*")
    bits = rows.withColumn("bits", F.when(F.col("grid").isNotNull(), S.dhash_bits(lambda at: F.get("grid", at))))
    got = {r["id"]: (r["width"], r["height"], r["bits"]) for r in bits.collect()}
    assert got == {1: (90, 80, -1), 2: (None, None, None), 3: (None, None, None)}


def test_safe_paths():
    said = {"a/b.jpg": "a/b.jpg", "../x": None, "a/../x": None, "/x": None, "\\\\host\\x": None, "c:/x": None, "a\0b": None, "": None, None: None, "./": None, "NUL.txt": "_NUL.txt", "a//b\\c": "a/b/c", "..hidden": "hidden", "Ünï.jpg": "U_ni_.jpg", "日本": "file", "/".join("abcdefghijklmnop"): "/".join("efghijklmnop")}
    assert {k: media.safe_path(k) for k in said} == said
    assert media.safe_path("x" * 200 + ".jpeg") == "x" * 95 + ".jpeg"


def tree(root):
    for i in range(12):
        (root / f"IMG_{1000 + i}.jpg").write_bytes(jpeg(f"2024:0{i % 9 + 1}:1{i % 9} 1{i % 9}:30:00", bytes([i]) * 50))
    (root / "scan_2011-07-04_beach.jpg").write_bytes(b"\xff\xd8 nothing inside")
    for at, data in (("copies/IMG_1000_copy.jpg", (root / "IMG_1000.jpg").read_bytes()), (".DS_Store", b"x"), ("notes.txt", b"x"), ("Thumbnails/IMG_1000.jpg", b"x")):
        (root / at).parent.mkdir(exist_ok=True)
        (root / at).write_bytes(data)


def test_tree_of_media_is_ingested(spark, tmp_path):
    tree(tmp_path)
    rows = files.media(spark, str(tmp_path))
    assert rows.count() == 14
    found = rows.withColumn("x", media.embedded_date(S.VIDEO_EXT, 2024)("content", "ext"))
    when = S.capture_time([("exif", F.col("x.at")), ("filename", S.filename_date(F.col("rel_path")))], 2024)
    seen = found.withColumn("when", when).select("hash", F.lit("cam").alias("device"), F.col("rel_path").alias("abs_path"), "size", "ext", F.col("when.at").alias("captured_at"), F.col("when.label").alias("time_source"))
    none = spark.createDataFrame([], "hash string")
    outcomes, assets, sources, placements = X.ingest(seen, none, "mac")
    assert {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()} == {"imported": 13, "duplicate": 1}
    got = {r["time_source"]: r["n"] for r in assets.groupBy("time_source").agg(F.count("*").alias("n")).collect()}
    paths = [r["rel_path"] for r in assets.collect()]
    assert got == {"exif": 12, "filename": 1} and any(p.startswith("2011/07/20110704-120000_") for p in paths) and any(p.startswith("2024/01/20240110-103000_") for p in paths)
    assert sources.count() == 14 and placements.count() == 13
    again = X.ingest(seen, assets, "mac")[0]
    assert again.where("outcome = 'imported'").count() == 0
    listed = files.listing(files.scan(spark, str(tmp_path)))
    assert listed.count() == 16 and listed.where("rel_path = 'copies/IMG_1000_copy.jpg'").count() == 1


def test_signatures_of_both_ends(spark):
    import hashlib

    big = bytes(range(256)) * 1000
    got = spark.createDataFrame([(b"ab",), (big,)], "content binary").select(files.quick_signature(F.octet_length("content"), F.col("content")).alias("x")).collect()
    assert [r["x"] for r in got] == [f"2:{hashlib.sha256(b'ab').hexdigest()}", f"{len(big)}:{hashlib.sha256(big[:65536] + big[-65536:]).hexdigest()}"]


def test_pages_of_a_remote_listing(spark):
    import json

    item = {"id": "1", "type": "IMAGE", "isTrashed": False}
    bodies = {"1": {"assets": {"items": [item, {**item, "id": "2", "isTrashed": True}], "nextPage": "2"}}, "2": {"assets": {"items": [{**item, "id": "3", "libraryId": "l"}, {**item, "id": "4", "type": "VIDEO"}, {**item, "id": "5", "type": "AUDIO"}], "nextPage": None}}}
    got = files.remote_assets(files.all_pages(spark, lambda page: json.dumps(bodies[page])))
    assert sorted(r["id"] for r in got.collect()) == ["1", "4"]


@pytest.mark.parametrize("text", ["", '[[replica]]\nname="a"\nmode="half"', 'primary="b"\n[[replica]]\nname="a"', 'primary="a"\n[[replica]]\nname="a"\nmode="shard"', '[[replica]]\nname="a"\nroot="s3://x"', '[[replica]]\nname="a"\n[immich]\nenabled=true'])
def test_broken_configurations_are_refused(spark, text):
    with pytest.raises(ValueError):
        files.config(spark, text)


def test_cases_where_rules_once_were_wrong(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert str(one(S.filename_date(F.lit("IMG_19991399_20200102")))) == "2020-01-02 12:00:00"
    assert [one(S.media_kind(F.lit(e))) for e in ("cr3", "rw2", "m2ts", "webm", "raw")] == ["image", "image", "video", "video", "other"]
    asset = spark.createDataFrame([("a", 1, None)], "hash string, size long, deleted_at timestamp_ntz")
    placement = spark.createDataFrame([("a", r, "present") for r in "xyz"], "hash string, replica string, state string")
    for offline, no_offline in ((False, 0), (True, 1)):
        replica = spark.createDataFrame([(r, False) for r in "xyz"] + [("w", offline)], "replica string, is_offline boolean")
        got = H.checks(H.copies(asset, placement, replica), replica).first()
        assert (got["no_offline"], got["ok"]) == (no_offline, not offline)


def test_plan_within_walks_ranges_as_one_list(spark, monkeypatch):
    import hashlib
    import math

    monkeypatch.setattr(P, "CHUNK_ROWS", 40)
    sizes = {hashlib.sha256(str(i).encode()).hexdigest(): 1 + i * 7 % 50 for i in range(300)}
    drives = {"s1": (1.0, False), "s2": (2.0, False), "s3": (1.0, True)}
    room = {"s1": 2200, "s2": 3300, "s3": 2800}
    assets = spark.createDataFrame(list(sizes.items()), "hash string, size bigint")
    shards = spark.createDataFrame([(k, *v) for k, v in drives.items()], "replica string, weight double, is_offline boolean")
    for offline in (False, True):
        used, want = dict.fromkeys(drives, 0), {}
        for h in sorted(sizes):
            score = {d: -w / math.log((int(hashlib.sha256(f"{h}:{d}".encode()).hexdigest()[:16], 16) + 1) / (2**64 + 1)) for d, (w, _) in drives.items()}
            fits = [d for d in sorted(drives, key=lambda d: -score[d]) if used[d] + sizes[h] <= room[d]]
            pick = fits[:2]
            if offline and "s3" not in pick and "s3" in fits:
                pick = [*pick[:-1], "s3"]
            for d in pick:
                used[d] += sizes[h]
            want[h] = (pick, len(pick) < 2)
        got = {r["hash"]: (r["replicas"], r["short"]) for r in P.plan_within(assets, shards, 2, room, offline).collect()}
        assert got == want and any(s for _, s in want.values())
