import json
import struct

import pytest
from pyspark.sql import types as T

from tessella.operators import vision
from tessella.sources import tables as sources

ROW = T.StructType([T.StructField("file", T.StringType()), T.StructField("wine", T.StringType())])


def test_jsonl_skips_blank_lines_and_refuses_wreckage(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"file":"1","wine":"x"}\n\n{"file":"2"}\n')
    assert [tuple(r) for r in sources.jsonl(spark, str(tmp_path / "a.jsonl"), ROW).collect()] == [("1", "x"), ("2", None)]
    (tmp_path / "b.jsonl").write_text('{"file":\n')
    with pytest.raises(Exception):
        sources.jsonl(spark, str(tmp_path / "b.jsonl"), ROW).collect()


def test_json_or_jsonl(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"file":"1","wine":"x"},\n {"file":"2"}]')
    (tmp_path / "b.json").write_text('{"file":"3"}\n{"file":"4"}')
    assert [r["file"] for r in sources.json_or_jsonl(spark, str(tmp_path / "a.json"), ROW).collect()] == ["1", "2"]
    assert [r["file"] for r in sources.json_or_jsonl(spark, str(tmp_path / "b.json"), ROW).collect()] == ["3", "4"]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' file ,wine\n1,"a, ""b""\nc"\n,\n2,\n')
    df = sources.csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["file", "wine"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", 'a, "b"\nc'), ("2", "")]


def test_images_and_latest(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt", "d e.webp", "f+g.png"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["file"] for r in sources.images(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG", "d e.webp", "f+g.png"]
    names = spark.createDataFrame([("run-2024-01-02.jsonl",), ("run-2024-10-01.jsonl",), ("run-x.jsonl",), ("other-2025-01-01",)], "n string")
    assert sources.latest_name(names, "n", "run-").first()["latest"] == "run-2024-10-01.jsonl"


@pytest.mark.parametrize(
    "address, found",
    [({"city": "Lyon", "country": "France"}, ("Lyon", "France")), ({"village": "V", "state": "S"}, ("V", None)), ({"state": "S", "city": ""}, ("S", None)), ({"country": "C"}, (None, "C")), ({}, None)],
)
def test_geocoded(spark, address, found):
    got = sources.geocoded(spark.createDataFrame([(json.dumps({"address": address}),)], "r string"), "r").first()["found"]
    assert (got and tuple(got)) == found


def test_settings():
    assert sources.option_or_default(["xx", "fra", "eng", "deu", "ita"], ["eng", "fra", "deu", "ita"], ["eng", "fra"], 3) == ["fra", "eng", "deu"]
    assert sources.option_or_default(None, ["eng"], ["eng"], 3) == ["eng"]


def test_jsonl_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", None), ("2", "x")], ROW)
    sources.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(map(str, sources.jsonl(spark, str(tmp_path / "out"), ROW).collect())) == sorted(map(str, df.collect()))


def jpeg(order="<", taken="2024:05:06 07:08:09", changed=None, gps=None):
    """A JPEG head with an EXIF block, built byte by byte."""
    top, sub, place, heap = [], [], [], b""
    mark = b"II" if order == "<" else b"MM"

    def entry(tag, kind, count, value):
        return struct.pack(order + "HHI", tag, kind, count) + value

    def put(data):
        nonlocal heap
        at = 1000 + len(heap)
        heap += data
        return struct.pack(order + "I", at)

    if changed:
        top.append(entry(0x0132, 2, 20, put(changed.encode() + b"\0")))
    if taken:
        sub.append(entry(0x9003, 2, 20, put(taken.encode() + b"\0")))
    if gps:
        (ns, lat), (ew, lon) = gps
        rational = lambda parts: put(b"".join(struct.pack(order + "II", *p) for p in parts))
        place = [entry(1, 2, 2, ns.encode() + b"\0\0\0"), entry(2, 5, 3, rational(lat)), entry(3, 2, 2, ew.encode() + b"\0\0\0"), entry(4, 5, 3, rational(lon))]
    if sub:
        top.append(entry(0x8769, 4, 1, struct.pack(order + "I", 300)))
    if place:
        top.append(entry(0x8825, 4, 1, struct.pack(order + "I", 600)))
    table = lambda entries: struct.pack(order + "H", len(entries)) + b"".join(entries)
    body = bytearray(1000)
    body[:8] = mark + struct.pack(order + "HI", 42, 8)
    for at, entries in ((8, top), (300, sub), (600, place)):
        body[at : at + len(table(entries))] = table(entries)
    block = b"Exif\0\0" + bytes(body) + heap
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda\0\0"


GPS = (("N", [(48, 1), (30, 1), (0, 1)]), ("W", [(2, 1), (15, 1), (0, 0)]))


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(spark, order):
    files = [jpeg(order, gps=GPS), jpeg(order, taken=None, changed="2023:01:02 00:00:00"), jpeg(order, gps=(("S", [(0, 1)] * 3), ("E", [(0, 0)] * 3))), b"\x89PNG", None, jpeg(order)[:60]]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id long, content binary")
    got = [(r["taken"], r["place"] and tuple(r["place"])) for r in vision.with_exif(df).orderBy("id").collect()]
    assert got == [("2024-05-06", (48.5, -2.25)), ("2023-01-02", None), ("2024-05-06", None), (None, None), (None, None), (None, None)]


def test_notes_keep_their_names(spark, tmp_path):
    notes = spark.createDataFrame([("a/one.md", "# one\n"), ("a/two.md", "zwei ü"), ("b/c/three.md", ""), ("a/one.md", "# and"), (None, "x")], "path string, content string")
    folder = str(tmp_path / "vault")
    for _ in range(2):  # writing again leaves the same files
        assert sources.write_notes(notes, folder) == 3
    found = {str(p.relative_to(folder)): p.read_text() for p in (tmp_path / "vault").rglob("*") if p.is_file()}
    assert found == {"a/one.md": "# one\n" if "# one\n" > "# and" else "# and", "a/two.md": "zwei ü", "b/c/three.md": ""}


def test_places_from_a_file(spark, tmp_path):
    (tmp_path / "places.csv").write_text("name,country,region\nTokaj,Hungary,Tokaj\nNowhere,,\n", encoding="utf-8")
    assert sources.read_places(spark, str(tmp_path / "places.csv")) == [("Tokaj", "Hungary", "Tokaj"), ("Nowhere", "", "")]
