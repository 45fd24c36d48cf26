"""Pixel features on rasters from seeded numpy, through the image source."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.operators import faces, forensics, liveness, pixels
from docsieve.sources import boundaries, media


def bmp(bgr: np.ndarray) -> bytes:
    h, w, _ = bgr.shape
    pad = -w * 3 % 4
    body = b"".join(row.tobytes() + b"\0" * pad for row in bgr[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


@pytest.fixture(scope="module")
def images(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(3)
    made = {"noise": rng.integers(0, 256, (160, 200, 3), dtype=np.uint8), "flat": np.full((160, 200, 3), 128, np.uint8), "white": np.full((160, 200, 3), 255, np.uint8)}
    for name, x in made.items():
        (folder / f"{name}.bmp").write_bytes(bmp(x))
    (folder / "broken.bmp").write_bytes(b"BMgarbage")
    return made, str(folder)


def test_image_source_and_features(spark, images):
    made, folder = images
    df = media.images(spark, folder).withColumn("name", F.regexp_extract("image.origin", r"(\w+)\.bmp", 1))
    got = {r["name"]: r for r in df.select("name", "image", pixels.quality(F.col("image")).alias("q"), pixels.tampering(F.col("image")).alias("t"), pixels.spoofing(F.col("image")).alias("s"), pixels.guide(F.col("image")).alias("g"), pixels.face_descriptor(F.col("image")).alias("d"), pixels.face_similarity(F.col("image"), F.col("image")).alias("f")).collect()}
    assert set(got) == set(made)
    for name, x in made.items():
        assert bytes(got[name]["image"]["data"]) == x.tobytes()
        assert abs(np.linalg.norm(got[name]["d"]) - 1) < 1e-3 and len(got[name]["d"]) == 1024
    assert got["noise"]["q"]["variance"] > 1000 and got["flat"]["q"]["variance"] == 0 and got["white"]["q"]["glare"] == 100
    assert got["noise"]["f"]["structure"] > 0.99 and got["flat"]["s"]["cr_std"] == 0 and got["flat"]["t"]["patches"] == 0
    small = media.images(spark, folder).select(pixels.downscaled(F.col("image"), 100).alias("i")).first()["i"]
    assert max(small["height"], small["width"]) == 100


def test_numpy_kernels():
    rng = np.random.default_rng(5)
    g = rng.integers(0, 256, (64, 64), dtype=np.uint8)
    assert (pixels.resize(g, 64, 64) == g).all() and abs(pixels.resize(g, 8, 8).mean() - g.mean()) < 1
    assert np.abs(pixels.requantised(g, 100).astype(int) - g).max() <= 3
    mask = np.zeros((20, 20), bool)
    mask[2:5, 2:5] = mask[10:12, 3:15] = True
    assert sorted(pixels.components(mask)) == [9, 24]
    for share in (0.2, 0.4, 0.6):
        mask = rng.random((40, 33)) < share
        label = {(y, x): (y, x) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(mask)))}
        changed = True
        while changed:
            least = {(y, x): min(label.get((y + i, x + j), (99, 99)) for i in (-1, 0, 1) for j in (-1, 0, 1)) for y, x in label}
            changed, label = least != label, least
        areas = {}
        for top in label.values():
            areas[top] = areas.get(top, 0) + 1
        assert sorted(pixels.components(mask)) == sorted(areas.values())
    assert pixels.components(np.zeros((3, 3), bool)) == [] and pixels.components(np.ones((1, 5), bool)) == [5]
    assert pixels.local_patterns(np.full((5, 5), 9, np.uint8)).tolist() == [[255] * 3] * 3


def test_uploads_and_boundaries(spark, images, tmp_path):
    _, folder = images
    kinds = media.uploads(spark, folder).select(media.image_kind(F.col("content")).alias("k")).distinct().collect()
    assert [r["k"] for r in kinds] == ["image/bmp"]
    df = media.images(spark, folder)
    with pytest.raises(boundaries.BoundaryMissing):
        boundaries.recognised(df)
    assert boundaries.recognised(df, engine=lambda d, h, w, c: f"{h}x{w}").select("ocr_text").distinct().collect()[0][0] == "160x200"
    pdf = tmp_path / "a.pdf"
    pdf.write_bytes(b"%PDF-1.4\n" + b"<< /Type /Page >>\n" * 3 + b"<< /Type /Pages >>")
    pages = media.pdf_pages(spark, [str(pdf), str(tmp_path / "none.pdf")], 2).orderBy("path", "page_number").collect()
    assert [(r["page_number"], r["pages"]) for r in pages if r["error"] is None] == [(1, 3), (2, 3)] and sum(r["error"] is not None for r in pages) == 1


def test_best_face(spark):
    boxes = spark.createDataFrame([([(10, 10, 100, 125), (400, 10, 105, 131), (0, 0, 300, 30)],)], "c array<struct<x:int,y:int,w:int,h:int>>")
    b = boxes.select(liveness.best_face(F.col("c"), F.lit(640)).alias("b")).first()["b"]
    assert (b["x"], b["w"]) == (10, 100)


def test_bad_images_cost_no_other_row(spark):
    kind = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    good = ("", 40, 40, 3, 16, bytearray(np.random.default_rng(5).integers(0, 256, 4800, dtype=np.uint8).tobytes()))
    df = spark.createDataFrame([(1, good), (2, None), (3, ("", 40, 40, 3, 16, bytearray(b"short"))), (4, ("", None, None, None, None, None))], f"k int, image {kind}").coalesce(1)
    image = F.col("image")
    got = {r["k"]: r for r in df.select("k", pixels.face_descriptor(image).alias("d"), pixels.face_similarity(image, image).alias("f"), pixels.quality(image).alias("q"), pixels.downscaled(image).alias("s")).collect()}
    assert len(got[1]["d"]) == 1024 and abs(got[1]["f"]["structure"] - 1) < 1e-9 and got[1]["q"]["variance"] > 0 and got[1]["s"]["height"] == 40
    for k in (2, 3, 4):
        assert got[k]["d"] is None and got[k]["f"]["structure"] is None and got[k]["q"]["variance"] is None


def test_full_forensics_in_one_pass(spark, images):
    made, folder = images
    kind = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    bad = spark.createDataFrame([(("broken", 9, 9, 3, 16, bytearray(b"x")),), (None,), (("empty", 0, 0, 3, 16, bytearray()),)], f"image {kind}")
    df = media.images(spark, folder).select("image").unionByName(bad)
    one = pixels.quality(F.col("image")).alias("q"), pixels.tampering(F.col("image")).alias("t"), pixels.spoofing(F.col("image")).alias("s")
    got = forensics.full_forensics(df).select("forensics", *one, F.regexp_extract("image.origin", r"(\w+)(\.bmp)?$", 1).alias("name")).collect()
    good = [r for r in got if r["forensics"]["success"]]
    assert len(good) == len(made) and len(got) == len(made) + 3
    for r in good:
        f = r["forensics"]
        assert all(tuple(f[part]["features"]) == tuple(r[part[0]]) for part in ("quality", "tampering")) and tuple(f["spoofing"]["features"]) == tuple(r["s"])
        assert f["error"] is None
    verdict = {r["name"]: r["forensics"] for r in good}
    assert verdict["flat"]["quality"]["verdict"]["is_blurry"] and verdict["white"]["quality"]["verdict"]["brightness_level"] == "OVEREXPOSED" and verdict["flat"]["tampering"]["verdict"]["risk_level"] == "LOW"
    assert {r["name"]: (r["forensics"]["error"], r["forensics"]["quality"]) for r in got if not r["forensics"]["success"]} == {"broken": ("undecodable", None), None: ("empty", None), "empty": ("empty", None)}


def test_thumbnails_are_files(spark, images, tmp_path):
    made, folder = images
    df = media.images(spark, folder).select(F.regexp_extract("image.origin", r"(\w+)\.bmp$", 1).alias("name"), pixels.bitmap(F.col("image")).alias("same"), pixels.thumbnail(F.col("image"), 100).alias("small"))
    got = {r["name"]: r for r in df.collect()}
    for name, x in made.items():
        assert bytes(got[name]["same"]) == bmp(x)
        (tmp_path / f"{name}.bmp").write_bytes(got[name]["small"])
    sizes = {(r["h"], r["w"]) for r in media.images(spark, str(tmp_path)).selectExpr("image.height AS h", "image.width AS w").collect()}
    assert sizes == {(80, 100)}


def test_faces_from_images_to_a_match(spark):
    kind = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    box = "array<struct<x:int,y:int,w:int,h:int>>"
    rng = np.random.default_rng(11)
    smooth = pixels.resize(rng.integers(0, 256, (12, 10), dtype=np.uint8), 120, 100)
    other = pixels.resize(rng.integers(0, 256, (12, 10), dtype=np.uint8), 120, 100)

    def photo(face, at, side=400):
        x = np.full((side, side, 3), 90, np.uint8)
        x[at[1] : at[1] + 120, at[0] : at[0] + 100] = face[:, :, None]
        return ("", side, side, 3, 16, bytearray(x.tobytes()))

    here, there = [(40, 60, 100, 120)], [(200, 150, 100, 120), (5, 5, 20, 20)]
    rows = [
        ("same", photo(smooth, (40, 60)), here, photo(smooth, (200, 150)), there),
        ("other", photo(smooth, (40, 60)), here, photo(other, (200, 150)), there),
        ("cut", photo(smooth, (0, 0), 130), [(0, 0, 100, 120)], photo(smooth, (0, 0), 130), [(0, 0, 100, 120)]),
        ("none", photo(smooth, (40, 60)), [], photo(smooth, (200, 150)), there),
        ("broken", ("", 9, 9, 3, 16, bytearray(b"x")), here, photo(smooth, (200, 150)), there),
        ("null", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"k string, portrait {kind}, pb {box}, selfie {kind}, sb {box}").coalesce(1)
    out = faces.compared(df.withColumn("keypoints", F.lit(0.95)), "portrait", "selfie", "pb", "sb", "keypoints")
    assert out.columns == [*df.columns, "keypoints", "face"]
    got = {r["k"]: r["face"] for r in out.collect()}
    assert got["same"]["verdict"] == "VERIFIED_MATCH" and got["same"]["match"] and got["same"]["similarity"] > 95
    assert got["other"]["verdict"] == "MISMATCH" and not got["other"]["match"]
    assert got["cut"]["verdict"] == "SELFIE_CUT_OFF" and not got["cut"]["match"]
    for k in ("none", "broken", "null"):
        assert got[k]["verdict"] == "NO_FACE" and not got[k]["match"] and got[k]["similarity"] is None
