"""Kernels against plain arithmetic, files, configuration, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docustrata.operators import detection, images, pixels
from docustrata.sources import sinks
from docustrata.sources import field_config as fc
from docustrata.sources import tokens as src
from docustrata.streaming import ingest


def relation(spark, a):
    return spark.createDataFrame([(1, int(r), int(c), int(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "img_id long, r int, c int, gray int")


def test_quality_flags(spark):
    flat = lambda v: pixels.light(relation(spark, np.full((12, 12), v, dtype="uint8"))).first()
    assert flat(20).underexposed and flat(250).overexposed and flat(255).severe_glare and flat(128).low_contrast


def test_relation_and_kernel_agree(spark):
    a = np.random.default_rng(1).integers(0, 256, (20, 30)).astype("uint8")
    px = relation(spark, a)
    assert pixels.blur(px).first().laplacian_var == pytest.approx(images.laplacian_variance(a), abs=1e-3)
    t = pixels.otsu(px).first().threshold
    assert ((a > t) == (images.otsu(a) == 255)).all()
    for how in ("open", "close", "erode", "dilate"):
        got = np.zeros_like(a)
        for r in pixels.morphology(px, how).collect():
            got[r.r, r.c] = r.gray
        assert (got == images.morphology(a, how)).all()
    for o in range(1, 9):
        got = {(r.r, r.c): r.gray for r in pixels.oriented(px, F.lit(o)).collect()}
        want = images.exif_orient(a, o)
        assert all(want[k] == v for k, v in got.items()) and len(got) == want.size


def test_apply_round_trip(spark):
    a = np.arange(48, dtype="uint8").reshape(6, 8)
    got = images.apply(images.packed(relation(spark, a)), lambda x: 255 - x).first()
    assert (images.array(got.height, got.width, got.channels, got.data) == 255 - a).all()


def test_kernels_keep_shapes_and_flat_images():
    flat = np.full((24, 32, 3), 90, dtype="uint8")
    for f in (images.bilateral, images.nlm, images.median, images.smooth, images.unsharp, images.illumination_gaussian):
        out = f(flat)
        assert out.shape == flat.shape and np.ptp(out) == 0
    assert images.profiled(flat, "date").shape == flat.shape and images.profiled(flat, "other").shape == flat.shape
    assert images.zone_enhance(flat).dtype == np.uint8


def test_geometry():
    p = images.order_points(np.array([(200, 200), (10, 10), (200, 10), (10, 200)]))
    assert p.tolist() == [[10, 10], [200, 10], [200, 200], [10, 200]]
    assert images.scale_for(500) * 500 == 1600 and images.scale_for(5000) * 5000 == 4000 and images.scale_for(2000) == 1
    a = np.zeros((126, 200, 3), dtype="uint8")
    page, m, warped = images.warp(a, np.array([(0, 0), (199, 0), (199, 125), (0, 125)]), width=100)
    assert warped and page.shape == (63, 100, 3)
    assert np.allclose(m @ [199, 125, 1] / (m @ [199, 125, 1])[2], [99, 62, 1])
    assert not images.warp(a, np.empty((0, 2)), width=100)[2]
    assert images.accept_quad(np.array([(0, 0), (199, 0), (199, 125), (0, 125)]), 126, 200)["method"] == "contour"
    assert images.accept_quad(np.array([(0, 0), (9, 0), (9, 9), (0, 9)]), 126, 200)["method"] == "fallback_full_image"
    assert images.deskew_angle([2.0, 3.0, 80.0]) == 2.5 and images.deskew_angle([0.2]) == 0


PAGE = np.array([[60, 50], [540, 70], [550, 350], [50, 340]], dtype=float)


def photo(height=400, width=600, corners=PAGE, ground=30, paper=220):
    """A bright page on a dark ground."""
    y, x = np.mgrid[:height, :width]
    inside = np.ones((height, width), dtype=bool)
    for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
    return np.where(inside, paper, ground).astype("uint8")


def ruled(degrees, height=400, width=800):
    """Dark lines on white, turned by some degrees."""
    a = np.full((height, width), 255, dtype="uint8")
    x = np.arange(50, width - 50)
    for at in range(60, height - 40, 40):
        y = np.rint(at + np.tan(np.deg2rad(degrees)) * (x - width / 2)).astype(int)
        for k in range(4):
            a[np.clip(y + k, 0, height - 1), x] = 0
    return a


def test_edges_of_a_step():
    a = np.zeros((20, 30), dtype="uint8")
    a[:, 15:] = 200
    got = detection.edges(a)
    assert got.sum() == 20 and len(set(np.nonzero(got)[1])) == 1 and set(np.nonzero(got)[1]) <= {14, 15}
    assert not detection.edges(np.full((9, 9), 77, dtype="uint8")).any()
    weak = np.zeros((20, 30), dtype="uint8")
    weak[:, 15:] = 20  # between the thresholds, next to nothing stronger
    assert not detection.edges(weak).any()


def test_components_as_flood_fill():
    m = np.random.default_rng(1).random((60, 70)) < 0.35
    number, box = detection.components(m)
    want, n = np.zeros(m.shape, dtype=int), 0
    for start in zip(*np.nonzero(m), strict=True):
        if not want[start]:
            n, todo = n + 1, [start]
            want[start] = n
            while todo:
                y, x = todo.pop()
                for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if 0 <= p[0] < 60 and 0 <= p[1] < 70 and m[p] and not want[p]:
                        want[p] = n
                        todo.append(p)
    assert len(box) == n and len(set(zip(number[m].tolist(), want[m].tolist(), strict=True))) == n and not number[~m].any()
    y, x = np.nonzero(number == 3)
    assert box[2].tolist() == [y.min(), x.min(), y.max() + 1, x.max() + 1]
    assert detection.components(np.zeros((4, 5), dtype=bool))[1].shape == (0, 4)


def test_outline_and_corners():
    m = np.zeros((30, 40), dtype=bool)
    m[5:20, 8:33] = True
    p = detection.outline(m)
    assert len(p) == 2 * (14 + 24) and detection.area(p) == 14 * 24
    assert sorted(map(tuple, detection.simplified(p, 1.0).tolist())) == [(8, 5), (8, 19), (32, 5), (32, 19)]
    assert detection.outline(np.ones((1, 1), dtype=bool)).tolist() == [[0, 0]]


def test_boundary_of_a_page(spark):
    got = detection.boundary(photo())
    assert got["detected"] and got["method"] == "contour" and np.abs(got["corners"] - PAGE).max() <= 3 and 0.6 <= got["confidence"] <= 0.95
    small = detection.boundary(photo(corners=np.array([[60, 50], [160, 50], [160, 110], [60, 110]], dtype=float)))
    none = detection.boundary(np.full((300, 500), 128, dtype="uint8"))
    assert not small["detected"] and none["method"] == "fallback_full_image" and none["corners"].tolist() == [[0, 0], [499, 0], [499, 299], [0, 299]]
    frames = spark.createDataFrame([(1, 400, 600, 1, photo().tobytes()), (2, 400, 800, 1, ruled(3.0).tobytes())], images.SCHEMA)
    rows = {r.img_id: r for r in detection.boundaries(frames).collect()}
    assert rows[1].detected and not rows[2].detected and rows[2].angle == pytest.approx(3.0, abs=0.1)


@pytest.mark.parametrize("degrees", [-7.5, -1.0, 0.0, 3.0, 12.0])
def test_angles_of_lines(degrees):
    got = detection.line_angles(ruled(degrees))
    assert len(got) >= 6 and np.abs(np.array(got) - degrees).max() < 0.2
    assert images.deskew_angle(got) == (pytest.approx(degrees, abs=0.1) if abs(degrees) > 0.5 else 0)
    assert detection.line_angles(np.full((200, 300), 90, dtype="uint8")) == []


def test_align_by_landmarks():
    rng = np.random.default_rng(0)
    soft = images.gaussian((rng.random((400, 600)) * 255).astype("uint8"), 3)
    page = images.clip((soft - 128) * 6 + 128)
    m = np.array([[0.95, 0.05, 10], [-0.04, 0.97, 12], [0, 0, 1.0]])
    y, x = np.mgrid[:400, :600]
    q = m @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    got, found, ok = detection.align(images.sample(page, q[1].reshape(400, 600), q[0].reshape(400, 600)), 600, 400, to=page)
    assert ok and np.abs(found - m)[:2, :2].max() < 0.01 and np.abs(found - m)[:2, 2].max() < 1
    assert np.abs(got[40:-40, 60:-60].astype(int) - page[40:-40, 60:-60]).mean() < 5
    flat, scale, ok = detection.align(np.full((100, 150), 9, dtype="uint8"), 600, 400)
    assert not ok and flat.shape == (400, 600) and scale.tolist() == [[4, 0, 0], [0, 4, 0], [0, 0, 1]]


def test_stages_of_a_page(spark, tmp_path):
    got = detection.canonicalize(photo(), width=500)
    assert [n for n, _ in got["stages"]][:2] == ["01_original", "02_perspective"] and got["stages"][-1][0] == "10_canonical"
    corner = got["matrix"] @ [*got["boundary"]["corners"][2], 1]
    assert np.allclose(corner[:2] / corner[2], [499, 314], atol=2)
    frames = spark.createDataFrame([(7, 400, 600, 1, photo().tobytes())], images.SCHEMA)
    sinks.write_tokens(detection.stage_rows(frames, width=300), str(tmp_path / "stages"))
    rows = {r.stage: r for r in spark.read.parquet(str(tmp_path / "stages")).collect()}
    assert rows["01_original"].channels == 3 and (rows["10_canonical"].width, rows["10_canonical"].img_id) == (300, 7)
    assert detection.canonicalize(np.full((120, 200), 90, dtype="uint8"), width=300)["stages"][1][0] == "02_resized"


def test_kernel_values():
    """Values worked out by hand."""
    a = np.zeros((5, 5), dtype="uint8")
    a[2, 2] = 100
    assert images.median(a)[2, 2] == 0 and images.morphology(a, "dilate")[1:4, 1:4].min() == 100 and images.morphology(a, "erode").max() == 0
    assert images.laplacian_sharpen(a)[2, 2] == 255 and images.laplacian_sharpen(np.full((4, 4), 50, dtype="uint8")).tolist() == [[50] * 4] * 4
    row = np.array([[0, 0, 0, 100, 100, 100]] * 6, dtype="uint8")
    sharp = images.unsharp(row, 1.0, 0.5)
    assert sharp[3, 0] == 0 and sharp[3, 3] > 100 and (images.unsharp(row, 1.0, 0.5, threshold=255) == row).all()
    assert images.illumination(np.full((20, 20), 77, dtype="uint8")).min() == 255  # a flat page is its own background
    assert images.illumination_gaussian(np.full((20, 20), 77, dtype="uint8"), target=200).tolist() == [[200] * 20] * 20
    edge = images.bilateral(row, 5, 10, 10)
    assert (np.abs(edge.astype(int) - row) <= 1).all()  # an edge far beyond the colour range stays
    assert images.nlm(np.full((9, 9), 33, dtype="uint8")).tolist() == [[33] * 9] * 9
    two = np.concatenate([np.full((8, 16), 40), np.full((8, 16), 200)]).astype("uint8")
    assert np.unique(images.clahe(two, 256.0, 1)).tolist() == [128, 255]  # no histogram is clipped: half of the pixels, all of them
    assert images.adaptive_gaussian(np.full((20, 20), 9, dtype="uint8")).min() == 255 and images.adaptive_gaussian(255 - a)[2, 2] == 0
    # the dot smoothed, borders mirrored: 100 * w_i * w_j / 256 with w = 2 4 6 4 2, rounded: 112 around it, 14 in its place
    assert images.noise(np.full((9, 9), 5, dtype="uint8")) == 0 and images.noise(a) == pytest.approx((112 + 100 - 14) / 25 / 25)
    assert images.rotate(ruled(0.0), 90)[200, 400] in (0, 255) and (images.rotate(a, 0.05) == a).all()
    assert images.resize(np.array([[0, 100]], dtype="uint8"), 1, 4).tolist() == [[0, 25, 75, 100]]
    assert (images.zone_crop(np.arange(100, dtype="uint8").reshape(100, 1)) == np.arange(68, 100).reshape(32, 1)).all()
    assert set(images.zones(np.full((50, 50), 9, dtype="uint8"), {"a": (0, 0, 0.5, 0.5), "none": (0.5, 0.5, 0.5, 0.9)})) == {"a"}
    assert images.to_bgr(np.array([[[1, 2, 3, 4]]], dtype="uint8")).tolist() == [[[3, 2, 1]]] and images.to_bgr(a).shape == (5, 5, 3)


def test_exif():
    tiff = b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    block = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + (len(block) + 2).to_bytes(2, "big") + block + b"\xff\xd9"
    assert images.exif_orientation(jpeg) == 6 and images.exif_orientation(b"\xff\xd8\xff\xd9") is None and images.exif_orientation(b"PNG") is None


def test_engine_boundary(spark):
    class Fake:
        name = "fake"

        def tokens(self, image, document_type):
            if image.max() > 200:
                raise ValueError("too bright")
            return [(" HELLO ", 0.9, [(1, 2), (5, 2), (5, 6), (1, 6)])]

    rows = [(str(i), 4, 4, 1, bytes([v] * 16)) for i, v in enumerate((10, 250))]
    got = {r.doc_id: r for r in src.recognize(spark.createDataFrame(rows, "doc_id string, height int, width int, channels int, data binary"), Fake).collect()}
    assert (got["0"].text, got["0"].x2, got["0"].error) == ("HELLO", 5.0, None) and "too bright" in got["1"].error


def test_engines_in_order(spark):
    class Fake:
        name = "second"

        def tokens(self, image, document_type):
            if image.max() > 200:
                raise ValueError("too bright")
            return [("HELLO", 0.9, [(1, 2), (5, 2), (5, 6), (1, 6)])]

    def absent():
        raise ImportError("not installed")

    assert src.Preferred(absent, Fake).name == "second" and src.Preferred(Fake, absent).name == "second"
    dark, bright = np.zeros((4, 4, 3), dtype="uint8"), np.full((4, 4, 3), 250, dtype="uint8")
    assert len(src.Preferred(absent, Fake).tokens(dark, "auto")) == 1 and src.Preferred(absent, Fake).tokens(bright, "auto") == []
    none = src.Preferred(absent)
    assert none.name == "none" and none.tokens(dark, "auto") == []
    rows = spark.createDataFrame([("0", 4, 4, 1, bytes(16))], "doc_id string, height int, width int, channels int, data binary")
    assert [r.source for r in src.recognize(rows, lambda: src.Preferred(absent, Fake)).collect()] == ["second"]


def test_image_files(spark, tmp_path):
    """Files as Spark reads them, their EXIF tags, and bytes through a decoder of the caller's."""
    import struct
    import zlib as z

    a = np.arange(24, dtype="uint8").reshape(4, 6)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", z.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 6, 4, 8, 0, 0, 0, 0)) + part(b"IDAT", z.compress(b"".join(b"\0" + r.tobytes() for r in a))) + part(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.txt").write_bytes(png)
    got = src.read_images(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].path.endswith("a.png") and (images.array(got[0].height, got[0].width, got[0].channels, got[0].data) == a).all()
    assert {r.path.rsplit("/", 1)[1]: r.orientation for r in src.orientations(spark, str(tmp_path)).collect()} == {"a.png": None, "b.png": None}

    def decode(content):
        if content[:4] != b"\x89PNG":
            raise ValueError("no PNG")
        return a

    files = spark.createDataFrame([("x", bytearray(png)), ("y", bytearray(b"?"))], "path string, content binary")
    assert [(r.path, r.height, bytes(r.data)) for r in src.decoded(files, decode).collect()] == [("x", 4, a.tobytes())]


def test_config_round_trip(spark, tmp_path):
    pytest.importorskip("yaml")
    c = fc.field_config(spark)
    fc.write_yaml(c, str(tmp_path))
    (tmp_path / "bad.yaml").write_text("fields: [", encoding="utf-8")
    back = fc.read_yaml(spark, str(tmp_path))
    keep = [x for x in fc.COLUMNS if x not in ("label", "margin", "containment", "minimum_overlap", "max_distance", "vertical_tolerance", "direction")]
    assert sorted(map(str, back.select(keep).collect())) == sorted(map(str, c.select(keep).collect()))
    assert fc.read_yaml(spark, str(tmp_path), "passport").count() == 8 and fc.read_yaml(spark, str(tmp_path), "absent").count() == 0
    assert fc.create(c, "passport").where("doc_type = 'passport'").count() == 0


def test_stream(spark, tmp_path):
    from docustrata.plans import fixtures

    t = fixtures.card_tokens(spark, "/root/testdata/sf0.001").where("doc_id < 20").drop("nx1", "ny1", "nx2", "ny2")
    t.write.parquet(str(tmp_path / "in"))
    q = ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), t.drop("doc_type").schema.simpleString()[7:-1].replace(":", " ") + ", doc_type string", "cnic_front")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/fields")).select("doc_id").distinct().count() == 20
