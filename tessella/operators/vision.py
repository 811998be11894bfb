"""Images and planes as arrays: one row an image, NumPy inside Arrow batches. Nothing here shuffles."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import plain_path

# ---- running a function of one row over Arrow batches -----------------------------------------------------------------


def per_row(df: DataFrame, inputs: list[str], output: str, kind: str, f: Callable, arrow: pa.DataType) -> DataFrame:
    """df with a column more: f of the inputs' values, null where f gives None."""
    own = df.columns
    at = [own.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):  # rows can be images
                batch = whole.slice(i, 64)
                values = [f(*args) for args in zip(*(batch.column(k).to_pylist() for k in at))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], [*own, output])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{output}` {kind}")


POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
POINTS = "array<struct<x:double,y:double>>"

# ---- EXIF -------------------------------------------------------------------------------------------------------------

#: The tags that are read and how much of a file is looked at.
SUB_IFD, GPS_IFD, TAKEN, CHANGED, TURN = 0x8769, 0x8825, 0x9003, 0x0132, 0x0112
HEAD_BYTES = 1 << 20


class _Tiff:
    """A TIFF block in an APP1 segment: directories of entries (type, count, place of the value)."""

    def __init__(self, data: bytes, start: int):
        self.data, self.start = data, start
        self.order = {b"II": "<", b"MM": ">"}.get(data[start : start + 2], "")
        self.good = bool(self.order) and self.number(start + 2, "H") == 42

    def number(self, at: int, kind: str = "I") -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def at(self, entry: tuple[int, int]) -> int:
        return self.start + self.number(entry[1])

    def directory(self, at: int) -> dict[int, tuple[int, int]]:
        if at < 0 or at + 2 > len(self.data):
            return {}
        n = min(self.number(at, "H"), (len(self.data) - at - 2) // 12)
        return {self.number(p, "H"): (self.number(p + 4), p + 8) for p in range(at + 2, at + 2 + 12 * n, 12)}

    def text(self, entry: tuple[int, int]) -> str:
        n, place = entry
        at = place if n <= 4 else self.start + self.number(place)
        return self.data[at : at + n].decode("latin-1").rstrip("\0") if at + n <= len(self.data) else ""

    def degrees(self, entry: tuple[int, int], side: str) -> float | None:
        at = self.at(entry)
        if entry[0] < 3 or at + 24 > len(self.data):
            return None
        parts = [self.number(at + 8 * i) / d if (d := self.number(at + 8 * i + 4)) else 0.0 for i in range(3)]
        value = parts[0] + parts[1] / 60 + parts[2] / 3600
        return -value if side in "SW" else value


def _blocks(data: bytes) -> Iterator[_Tiff]:
    """The EXIF blocks of a JPEG's head, up to the image data."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and at + 18 <= len(data):
            tiff = _Tiff(data, at + 10)
            if tiff.good:
                yield tiff
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]


def _guarded(f: Callable) -> Callable:
    def run(content: bytes | None):
        if not content:
            return None
        try:
            return f(bytes(content[:HEAD_BYTES]))
        except struct.error:  # an entry points outside the file
            return None

    return run


def exif_date(data: bytes) -> str | None:
    """The day as the digits say it: when the picture was taken, else when the file was changed."""
    import re

    for tiff in _blocks(data):
        top = tiff.directory(tiff.start + tiff.number(tiff.start + 4))
        found = [tiff.directory(tiff.at(top[SUB_IFD])).get(TAKEN)] if SUB_IFD in top else []
        for entry in [*found, top.get(CHANGED)]:
            if entry and (m := re.match(r"([0-9]{4}):([0-9]{2}):([0-9]{2})", tiff.text(entry))):
                return "-".join(m.groups())
    return None


def exif_place(data: bytes) -> dict | None:
    """Latitude and longitude in degrees; no fix is (0, 0) and counts as none."""
    for tiff in _blocks(data):
        top = tiff.directory(tiff.start + tiff.number(tiff.start + 4))
        gps = tiff.directory(tiff.at(top[GPS_IFD])) if GPS_IFD in top else {}
        if all(t in gps for t in (1, 2, 3, 4)):
            lat, lon = (tiff.degrees(gps[t + 1], chr(data[gps[t][1]])) for t in (1, 3))
            if lat is not None and lon is not None and (lat or lon):
                return {"lat": lat, "lon": lon}
    return None


def exif_turn(data: bytes) -> int:
    """How the picture lies, 1 to 8; 1 is upright, also where nothing says so."""
    for tiff in _blocks(data):
        entry = tiff.directory(tiff.start + tiff.number(tiff.start + 4)).get(TURN)
        if entry and 1 <= (turn := tiff.number(entry[1], "H")) <= 8:
            return turn
    return 1


def upright(image: np.ndarray, turn: int) -> np.ndarray:
    """The picture as it is meant to be seen: mirrored, turned over or on its side by the EXIF code."""
    if turn in (5, 6, 7, 8):
        image = image.transpose(1, 0, 2)
    if turn in (2, 3, 6, 7):
        image = image[:, ::-1]
    if turn in (3, 4, 7, 8):
        image = image[::-1]
    return image


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(file, width, height, data) of the pictures of a folder as upright RGBA; the JVM decodes, files that it can't are left out."""
    read = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    heads = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("origin"), F.substring("content", 1, HEAD_BYTES).alias("head"))
    both = read.withColumn("origin", plain_path(F.col("origin"))).join(heads.withColumn("origin", plain_path(F.col("origin"))), "origin")

    def turned(data, width, height, channels, head):
        raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        rgb = raw[..., 2::-1] if channels >= 3 else np.repeat(raw[..., :1], 3, -1)
        alpha = raw[..., 3:4] if channels == 4 else np.full((height, width, 1), 255, np.uint8)
        out = upright(np.concatenate([rgb, alpha], -1), (_guarded(exif_turn)(head) or 1))
        return {"width": out.shape[1], "height": out.shape[0], "data": np.ascontiguousarray(out).tobytes()}

    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])
    out = per_row(both, ["data", "width", "height", "nChannels", "head"], "seen", "struct<width:int,height:int,data:binary>", turned, kind)
    return out.select(F.substring_index("origin", "/", -1).alias("file"), "seen.*")


def with_exif(files: DataFrame, content: str = "content") -> DataFrame:
    """files with taken (yyyy-mm-dd) and place (lat, lon)."""
    place = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])
    out = per_row(files, [content], "taken", "string", _guarded(exif_date), pa.string())
    return per_row(out, [content], "place", "struct<lat:double,lon:double>", _guarded(exif_place), place)


# ---- plane geometry -----------------------------------------------------------------------------------------------------


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The eight coefficients that take four points to four points."""
    x, y = source.T
    u, v = target.T
    one, none = np.ones(4), np.zeros(4)
    a = np.concatenate([np.stack([x, y, one, none, none, none, -u * x, -u * y], 1), np.stack([none, none, none, x, y, one, -v * x, -v * y], 1)])
    if abs(np.linalg.det(a)) < 1e-12:
        raise ValueError("the corners are degenerate")
    return np.linalg.solve(a, np.concatenate([u, v]))


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The image (h, w, channels) at fractional places, held at its borders."""
    h, w = image.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    top, low = image[y0, x0] * (1 - fx) + image[y0, x1] * fx, image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return top * (1 - fy) + low * fy


def warped(image: np.ndarray, quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quad (TL, TR, BR, BL) of the image, flattened."""
    h = homography(np.array([[0, 0], [width, 0], [width, height], [0, height]], float), quad)
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    den = h[6] * x + h[7] * y + 1
    out = bilinear(image, (h[0] * x + h[1] * y + h[2]) / den - 0.5, (h[3] * x + h[4] * y + h[5]) / den - 0.5)
    return np.floor(out + 0.5).astype(np.uint8)


def gray(rgba: np.ndarray) -> np.ndarray:
    return rgba[..., :3] @ np.array([0.299, 0.587, 0.114])


def stretched(plane: np.ndarray, low: float = 0.02, high: float = 0.98) -> np.ndarray:
    """Contrast between two percentiles of the 256-bin histogram drawn out to the full range."""
    share = np.cumsum(np.bincount(plane.astype(np.uint8).reshape(-1), minlength=256)) / plane.size
    a, b = int(np.argmax(share >= low)), int(np.argmax(share >= high))
    return np.clip((plane - a) * 255.0 / max(1, b - a), 0, 255)


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise in y-up axes, from the leftmost point."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(seq) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def smallest_rectangle(h: np.ndarray) -> tuple[float, float, float, float, float]:
    """(cx, cy, w, h, angle) of the rectangle of least area round a hull; w lies along the angle."""
    if len(h) == 1:
        return float(h[0][0]), float(h[0][1]), 1.0, 1.0, 0.0
    if len(h) == 2:
        d = h[1] - h[0]
        return *(h.mean(0).tolist()), float(np.hypot(*d)) or 1.0, 1.0, float(np.arctan2(d[1], d[0]))
    edges = np.roll(h, -1, 0) - h
    angles = np.arctan2(edges[:, 1], edges[:, 0])
    c, s = np.cos(angles)[:, None], np.sin(angles)[:, None]
    along, across = h[:, 0] * c + h[:, 1] * s, -h[:, 0] * s + h[:, 1] * c
    w, t = np.ptp(along, 1), np.ptp(across, 1)
    k = int(np.argmin(w * t))
    mx, my = (along[k].min() + along[k].max()) / 2, (across[k].min() + across[k].max()) / 2
    a = angles[k]
    return float(mx * np.cos(a) - my * np.sin(a)), float(mx * np.sin(a) + my * np.cos(a)), float(w[k]), float(t[k]), float(a)


def corners(cx: float, cy: float, w: float, h: float, angle: float) -> np.ndarray:
    """TL, TR, BR, BL, the long side horizontal."""
    if h > w:
        w, h, angle = h, w, angle + np.pi / 2
    angle = (angle + np.pi / 2) % np.pi - np.pi / 2 if abs(angle) > np.pi / 2 else angle
    side = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * np.array([w / 2, h / 2])
    turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
    return side @ turn + np.array([cx, cy])


# ---- planes -----------------------------------------------------------------------------------------------------------


def components(on: np.ndarray) -> np.ndarray:
    """Labels of the 4-connected components of a Boolean plane: 0 is off, the rest numbered by their first pixel in reading order."""
    label = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    while True:  # the least label spreads over neighbours and then along what it already names
        before = label
        near = label.copy()
        for axis in (0, 1):
            for step in (1, -1):
                moved = np.roll(label, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                moved[tuple(edge)] = 0
                near = np.where(on & (moved > 0), np.minimum(near, moved), near)
        flat = np.arange(on.size + 1)
        np.minimum.at(flat, label.reshape(-1), near.reshape(-1))
        while (flat != (up := flat[flat])).any():
            flat = up
        label = np.where(on, flat[near], 0)
        if (label == before).all():
            break
    names, back = np.unique(label, return_inverse=True)
    return back.reshape(on.shape) + (0 if names[0] == 0 else 1)


def boxes_in(prob: list[float], width: int, height: int, threshold=0.3, least_score=0.6, grow=1.5, least_side=3, most=1000) -> list[dict]:
    """Text boxes of a probability map, the best score first: corners, score, w (the long side) and h."""
    plane = np.asarray(prob, float).reshape(height, width)
    label = components(plane >= threshold)
    out = []
    for k in range(1, int(label.max(initial=0)) + 1):
        y, x = np.nonzero(label == k)
        score = float(plane[y, x].mean())
        if len(x) < 4 or score < least_score:
            continue
        cx, cy, w, h, angle = smallest_rectangle(hull(np.stack([x, y], 1).astype(float)))
        d = w * h * grow / (2 * (w + h)) if w + h else 0.0
        w, h = w + 2 * d, h + 2 * d
        if min(w, h) < least_side:
            continue
        c = np.clip(corners(cx, cy, w, h, angle), 0, [width, height])
        out.append({"corners": [{"x": float(a), "y": float(b)} for a, b in c], "score": score, "w": max(w, h), "h": min(w, h)})
    return sorted(out, key=lambda b: -b["score"])[:most]


def in_reading_order(boxes: list[dict], tolerance: float = 0.5) -> list[dict]:
    """Rows from the top, each from the left; a box is in a row if its top is near that of the row's first box."""
    placed = sorted(((min(c["y"] for c in b["corners"]), min(c["x"] for c in b["corners"]), b) for b in boxes), key=lambda p: p[0])
    rows: list[list] = []
    for p in placed:
        if rows and abs(p[0] - rows[-1][0][0]) <= tolerance * min(p[2]["h"], rows[-1][0][2]["h"]):
            rows[-1].append(p)
        else:
            rows.append([p])
    return [p[2] for row in rows for p in sorted(row, key=lambda p: p[1])]


BOX = pa.struct([("corners", pa.list_(POINT)), ("score", pa.float64()), ("w", pa.float64()), ("h", pa.float64())])
BOXES = f"array<struct<corners:{POINTS},score:double,w:double,h:double>>"


def with_boxes(maps: DataFrame) -> DataFrame:
    """maps (prob array, width, height) with the text boxes in reading order."""
    return per_row(maps, ["prob", "width", "height"], "boxes", BOXES, lambda p, w, h: in_reading_order(boxes_in(p, w, h)), pa.list_(BOX))


def cluster(boxes: list[dict], reach: float = 3.0) -> list[dict]:
    """The boxes that belong with the most printing: groups grown from the largest box by a few line heights; boxes with left, top, right, bottom."""
    if not boxes:
        return []
    b = np.array([[x["left"], x["top"], x["right"], x["bottom"]] for x in boxes], float)
    area, tall = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), b[:, 3] - b[:, 1]
    rest, best = list(np.argsort(-area, kind="stable")), (-1.0, [])
    while rest:
        group = [rest.pop(0)]
        grew = True
        while grew:
            grew = False
            edge = np.concatenate([b[group, :2].min(0), b[group, 2:].max(0)])
            typical = float(np.median(tall[group]))
            for i in rest[::-1]:
                by = reach * max(1.0, min(tall[i], typical))
                if b[i, 0] - by <= edge[2] and edge[0] <= b[i, 2] + by and b[i, 1] - by <= edge[3] and edge[1] <= b[i, 3] + by:
                    group.append(i)
                    rest.remove(i)
                    grew = True
        weight = float(area[group].sum() * np.sqrt(len(group)))
        if weight > best[0]:
            best = (weight, group)
    return [boxes[i] for i in sorted(best[1], key=lambda i: -area[i])]


def fitted(u: np.ndarray, v: np.ndarray, curved: bool, tolerance: float) -> dict | None:
    """v = alpha + beta u (+ h sqrt(1 - u^2)) by least squares, three rounds, points off by more than the tolerance left out."""
    good = ~np.isnan(v)
    keep, fit = good.copy(), None
    base = np.stack([np.ones_like(u), u, *([np.sqrt(np.maximum(0, 1 - u * u))] if curved else [])], 1)
    for _ in range(3):
        if keep.sum() < (5 if curved else 3):
            return None
        normal = base[keep].T @ base[keep]
        if abs(np.linalg.det(normal)) < 1e-9:
            return None
        fit = np.linalg.solve(normal, base[keep].T @ v[keep])
        now = good & (np.abs(np.nan_to_num(v) - base @ fit) <= tolerance)
        if (now == keep).all():
            break
        keep = now
    return {"alpha": float(fit[0]), "beta": float(fit[1]), "h": float(fit[2]) if curved else 0.0, "inliers": int(keep.sum())}


def handles(mask: list[int], width: int, height: int, margin: float = 0.2, least_side: int = 8, least_share: float = 0.02) -> list[dict] | None:
    """Six handles (TL, TM, TR, BR, BM, BL) of the largest blob: lines fitted to its sides, bulged lines to its top and bottom, held in its bounds."""
    if not mask or width < least_side or height < least_side:
        return None
    label = components(np.asarray(mask).reshape(height, width) >= 0.5)
    sizes = np.bincount(label.reshape(-1))[1:]
    if not len(sizes) or sizes.max() < width * height * least_share:
        return None
    on = label == int(np.argmax(sizes)) + 1
    ys, xs = np.flatnonzero(on.any(1)), np.flatnonzero(on.any(0))
    top, bottom, left, right = int(ys[0]), int(ys[-1]), int(xs[0]), int(xs[-1])
    if right - left < least_side or bottom - top < least_side:
        return None

    def edge(lo: int, hi: int, first: np.ndarray, curved: bool) -> dict | None:
        skip, half = int(np.floor((hi - lo) * margin + 0.5)), (hi - lo) / 2 or 1
        k = np.arange(lo + skip, hi - skip + 1)
        v = np.where(first[k] >= 0, first[k], np.nan).astype(float)
        return fitted((k - (lo + half)) / half, v, curved, max(2.0, (right - left) * 0.02))

    found = lambda plane, axis: np.where(plane.any(axis), plane.argmax(axis), -1)
    back = lambda plane, axis: np.where(plane.any(axis), plane.shape[axis] - 1 - np.flip(plane, axis).argmax(axis), -1)
    sides = [edge(top, bottom, found(on, 1), False), edge(top, bottom, back(on, 1), False)]
    caps = [edge(left, right, found(on, 0), True), edge(left, right, back(on, 0), True)]
    if None in sides + caps:
        return None
    x = lambda f, u: f["alpha"] + f["beta"] * u
    y = lambda f, u: f["alpha"] + f["beta"] * u + f["h"] * float(np.sqrt(max(0, 1 - u * u)))
    (lf, rf), (tf, bf) = sides, caps
    raw = [
        (x(lf, -1), y(tf, -1)), ((x(lf, -1) + x(rf, -1)) / 2, y(tf, 0)), (x(rf, -1), y(tf, 1)),
        (x(rf, 1), y(bf, 1)), ((x(lf, 1) + x(rf, 1)) / 2, y(bf, 0)), (x(lf, 1), y(bf, -1)),
    ]
    return [{"x": min(max(a, left), right), "y": min(max(b, top), bottom)} for a, b in raw]


def with_handles(masks: DataFrame) -> DataFrame:
    """masks (mask array of 0 and 1, width, height) with six handles, null where nothing label-like is there."""
    return per_row(masks, ["mask", "width", "height"], "handles", POINTS, handles, pa.list_(POINT))


def mask_region(masks: list[float], scores: list[float], width: int, height: int, size: int, grid: int = 256) -> dict:
    """The best of several logit masks, cut to the part of the grid that the picture takes up."""
    best = int(np.argmax(scores))
    w, h = (max(1, int(np.floor(v / (size / grid) + 0.5))) for v in (width, height))
    on = np.asarray(masks, float).reshape(len(scores), grid, grid)[best, :h, :w] > 0
    return {"mask": on.astype(int).reshape(-1).tolist(), "width": w, "height": h, "score": float(scores[best]), "coverage": float(on.mean())}


def charset() -> list[str]:
    """Class 0 is the blank; then the printable characters from 0 on, those before it, and two spaces."""
    return ["", *map(chr, range(0x30, 0x7F)), *map(chr, range(0x21, 0x30)), " ", " "]


def ctc_text(logits: list[float], steps: int, classes: int, letters: list[str] | None = None, space: float = 0.2) -> dict:
    """The greedy reading of a steps x classes table, and its confidence. A run of blanks in which a space comes to `space` reads as one."""
    letters = charset() if letters is None else letters
    p = np.asarray(logits, float).reshape(steps, classes)
    best, peak = p.argmax(1), p.max(1)
    gaps = p[:, [i for i, c in enumerate(letters) if c == " "]].max(1, initial=0.0)
    text, sure, gap = "", [], 0.0
    for t, k in enumerate(best.tolist()):
        if k == 0:
            gap = max(gap, float(gaps[t]))
            continue
        if t == 0 or k != best[t - 1]:
            c = letters[k] if k < len(letters) else ""
            text += (" " if gap >= space and text and text[-1] != " " and c != " " else "") + c
            sure.append(float(peak[t]))
        gap = 0.0
    return {"text": text.strip(), "confidence": 100 * float(np.mean(sure)) if sure else 0.0}


def with_reading(lines: DataFrame) -> DataFrame:
    """lines (logits, steps, classes) with reading (text, confidence)."""
    kind = pa.struct([("text", pa.string()), ("confidence", pa.float64())])
    return per_row(lines, ["logits", "steps", "classes"], "reading", "struct<text:string,confidence:double>", ctc_text, kind)
