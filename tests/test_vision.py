import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry
from tessella.operators import vision

POINTS = "array<struct<x:double,y:double>>"


def one(spark, column, points=None):
    df = spark.createDataFrame([(points,)], f"p {POINTS}") if points else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def pts(*xy):
    return [(float(x), float(y)) for x, y in xy]


def test_homography_maps_the_corners():
    source, target = np.array(pts((0, 0), (10, 0), (10, 5), (0, 5))), np.array(pts((1, 2), (9, 1), (12, 8), (0, 6)))
    h = vision.homography(source, target)
    den = source @ h[6:] + 1
    assert np.allclose(np.stack([(source @ h[:2] + h[2]) / den, (source @ h[3:5] + h[5]) / den], 1), target)
    with pytest.raises((ValueError, np.linalg.LinAlgError)):
        vision.homography(source, np.array(pts((0, 0), (1, 1), (2, 2), (3, 3))))


def test_quads(spark):
    quad = one(spark, geometry.ordered_quad(F.col("p")), pts((10, 0), (0, 5), (0, 0), (10, 5)))
    assert [(p["x"], p["y"]) for p in quad] == pts((0, 0), (10, 0), (10, 5), (0, 5))
    size = one(spark, geometry.output_size(F.col("p")), pts((0, 0), (3200, 0), (3200, 100), (0, 100)))
    assert (size["width"], size["height"]) == (1600, 50)


def test_wrap_angle(spark):
    flat = pts((0, 0), (50, 0), (100, 0), (100, 150), (50, 150), (0, 150))
    assert one(spark, geometry.wrap_angle(F.col("p")), flat) == pytest.approx(math.pi / 3)
    assert one(spark, geometry.wrap_angle(F.col("p")), pts((0, 0), (50, -90), (100, 0), (100, 150), (50, 240), (0, 150))) == pytest.approx(math.pi)
    bulged = pts((0, 0), (50, -5), (100, 0), (100, 150), (50, 170), (0, 150))
    assert one(spark, geometry.wrap_angle(F.col("p")), bulged) == pytest.approx(2 * math.acos(1 - 25 / 150 * 3.5))
    assert one(spark, geometry.wrap_angle(F.col("p")), pts(*[(0, 0)] * 6)) == pytest.approx(math.radians(140))


def test_warping_a_crop():
    image = np.arange(100, dtype=np.uint8).reshape(10, 10, 1)
    assert (vision.warped(image, np.array(pts((2, 3), (6, 3), (6, 7), (2, 7))), 4, 4)[..., 0] == image[3:7, 2:6, 0]).all()


def test_hull_and_rectangle():
    p = np.array(pts((0, 0), (4, 0), (4, 2), (0, 2), (2, 1), (1, 1), (2, 0)))
    h = vision.hull(p)
    assert sorted(map(tuple, h.tolist())) == sorted(pts((0, 0), (4, 0), (4, 2), (0, 2)))
    _, _, w, t, _ = vision.smallest_rectangle(h)
    assert sorted([w, t]) == pytest.approx([2, 4])
    a = math.radians(30)
    turned = p @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
    cx, cy, w, t, angle = vision.smallest_rectangle(vision.hull(turned))
    c = vision.corners(cx, cy, w, t, angle)
    assert math.degrees(math.atan2(*(c[1] - c[0])[::-1])) == pytest.approx(30) and np.hypot(*(c[1] - c[0])) == pytest.approx(4)


def test_components_equal_a_flood():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        on = rnd.random((9, 11)) < 0.55
        label, seen, k = vision.components(on), np.zeros(on.shape, int), 0
        for y, x in zip(*np.nonzero(on)):
            if not seen[y, x]:
                k += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < 9 and 0 <= b < 11 and on[a, b] and not seen[a, b]:
                        seen[a, b] = k
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        assert (label == seen).all()


def test_boxes(spark):
    plane = np.zeros((20, 40))
    plane[2:6, 3:18], plane[10:14, 20:35], plane[17, 1:3] = 0.9, 0.8, 0.9
    got = vision.with_boxes(spark.createDataFrame([(plane.reshape(-1).tolist(), 40, 20)], "prob array<double>, width int, height int")).first()["boxes"]
    assert [round(b["score"], 2) for b in got] == [0.9, 0.8] and all(b["w"] > b["h"] for b in got)


def box(left, top, w=10.0, h=4.0):
    return {"corners": [{"x": x, "y": y} for x, y in ((left, top), (left + w, top), (left + w, top + h), (left, top + h))], "h": h}


def test_reading_order():
    boxes = [box(30.0, 1.0), box(0.0, 0.0), box(0.0, 10.0), box(15.0, 1.9)]
    assert [b["corners"][0]["x"] for b in vision.in_reading_order(boxes)] == [0.0, 15.0, 30.0, 0.0]


def test_cluster_leaves_far_text_out():
    rect = lambda l, t, r, b: {"left": l, "top": t, "right": r, "bottom": b}
    boxes = [rect(0, 0, 100, 10), rect(0, 20, 100, 30), rect(0, 45, 80, 55), rect(500, 500, 560, 510)]
    assert len(vision.cluster(boxes)) == 3 and vision.cluster([]) == []


def label_mask(w=220, h=260, left=40, right=180, top=50, bottom=200, bulge=12):
    y, x = np.mgrid[0:h, 0:w]
    u = np.clip((x - (left + right) / 2) / ((right - left) / 2), -1, 1)
    arc = bulge * np.sqrt(1 - u * u)
    return ((x >= left) & (x <= right) & (y >= top + arc) & (y <= bottom + arc)).astype(int)


def test_handles(spark):
    df = spark.createDataFrame([(1, label_mask().reshape(-1).tolist(), 220, 260), (2, [0] * 100, 10, 10), (3, [1] * 16, 4, 4)], "id int, mask array<int>, width int, height int")
    got = {r["id"]: r["handles"] for r in vision.with_handles(df).collect()}
    want = pts((40, 50), (110, 62), (180, 50), (180, 200), (110, 212), (40, 200))
    assert got[2] is None and got[3] is None
    assert all(math.hypot(p["x"] - x, p["y"] - y) < 3 for p, (x, y) in zip(got[1], want))


def table(classes, path):
    letters = vision.charset()
    rows = []
    for c in path:
        row = np.full(classes, 0.001)
        if isinstance(c, tuple):  # a blank with some space
            row[0], row[letters.index(" ")] = 0.6, c[0]
        else:
            row[letters.index(c) if c else 0] = 0.9
        rows.append(row)
    return np.array(rows).reshape(-1).tolist(), len(path), classes


@pytest.mark.parametrize(
    "path, text",
    [(["A", "A", "", "A", "B"], "AAB"), (["J", (0.3,), "O"], "J O"), (["J", (0.1,), "O"], "JO"), (["", ""], ""), (["A", " ", (0.5,), "B"], "A B")],
)
def test_reading_a_table(spark, path, text):
    got = vision.with_reading(spark.createDataFrame([table(97, path)], "logits array<double>, steps int, classes int")).first()["reading"]
    assert got["text"] == text and got["confidence"] == pytest.approx(90.0 if text else 0.0)


def test_mask_region():
    masks = np.stack([np.full((256, 256), -1.0), np.full((256, 256), 1.0)])
    got = vision.mask_region(masks.reshape(-1).tolist(), [0.2, 0.9], 1024, 512, 1024)
    assert (got["width"], got["height"], got["coverage"], got["score"]) == (256, 128, 1.0, 0.9)


def test_contrast():
    plane = np.linspace(50, 150, 1000).reshape(20, 50)
    out = vision.stretched(plane)
    assert out.min() == 0 and out.max() == 255


def png(rgba):
    import struct
    import zlib

    h, w = rgba.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + rgba[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decoding(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (3, 5, 4), dtype=np.uint8)
    image[..., 3] = 255
    (tmp_path / "a b.png").write_bytes(png(image))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    got = vision.decoded(spark, str(tmp_path)).collect()
    assert [(r["file"], r["width"], r["height"]) for r in got] == [("a b.png", 5, 3)]
    assert (np.frombuffer(bytes(got[0]["data"]), np.uint8).reshape(3, 5, 4)[..., :3] == image[..., :3]).all()


@pytest.mark.parametrize(
    "turn, seen",
    [(1, "abcdef"), (2, "badcfe"), (3, "fedcba"), (4, "efcdab"), (5, "acebdf"), (6, "ecafdb"), (7, "fdbeca"), (8, "bdface")],
)
def test_upright(turn, seen):
    """Two columns and three rows, lettered in reading order."""
    image = np.array(list("abcdef")).reshape(3, 2, 1)
    assert "".join(vision.upright(image, turn).reshape(-1)) == seen
