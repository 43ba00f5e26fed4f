"""Column functions on rows by hand: addresses, media types, capture times, template and literal rules."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.functions import capture, images, mime, paths
from shutterloom.functions import vectors as V
from shutterloom.operators import select
from shutterloom.sources import formats, listing


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_addresses_are_shown_as_they_are_read(spark):
    uris = ["smb://host/share", "smb://u@h:445/s%20t/p%23x/q", "smb://[::1]:70/s/p", "mtp://My%20Phone/Card%3A1/DCIM/a%20b", "adb://serial/sdcard/x", "adb:///sdcard/x", "/plain/p", "smb://h/s/%C3%A9%25"]
    df = spark.createDataFrame([(u,) for u in uris], "uri string").select("uri", paths.location(F.col("uri")).alias("a"))
    df = df.select("uri", "a", paths.shown(F.col("a")).alias("shown")).select("*", paths.location(F.col("shown")).alias("b"))
    for r in df.collect():
        assert r.a.error is None and r.a == r.b, r
        assert r.shown in (r.uri, r.uri + "/"), r


def test_broken_addresses_name_their_error(spark):
    bad = {"smb://host": "missing_share", "smb:///share": "missing_host", "mtp://d": "missing_storage", "adb://serial": "missing_path", "ftp://x/y": "unknown_scheme", "smb://h:99999/s": "bad_port", "mtp://d/s/%zz": "bad_escape"}
    got = dict(values(spark, [(u,) for u in bad], "uri string", "uri", paths.location(F.col("uri"))["error"]))
    assert got == bad


def test_paths_of_locations(spark):
    rows = [("smb://u@h/s",), ("smb://h/s/a/",), ("/a",), ("adb://x/a",)]
    loc = paths.location(F.col("uri"))
    got = values(spark, rows, "uri string", loc["scheme"], paths.joined(loc, F.lit("b/c"))["path"], paths.shown(paths.with_path(loc, F.lit("/é x"))))
    assert [(g[0], g[2]) for g in got] == [("smb", "smb://u@h/s/%C3%A9%20x"), ("smb", "smb://h/s/%C3%A9%20x"), ("local", "/é x"), ("adb", "adb://x/%C3%A9%20x")]
    assert got[2][1] == "/a/b/c" and got[3][1] == "/a/b/c" and got[1][1] == "/a/b/c"


def test_prefixes_are_resolved(tmp_path):
    os.makedirs(f"{tmp_path}/real/x")
    os.symlink(f"{tmp_path}/real", f"{tmp_path}/link")
    assert listing.canonical_prefix(f"{tmp_path}/link/x") == os.path.realpath(f"{tmp_path}/real/x")
    assert listing.canonical_prefix("file:///a//b/") == "file:///a/b"
    with pytest.raises(ValueError):
        listing.ensure_outside([f"{tmp_path}/link/x"], f"{tmp_path}/real")


def test_media_types(spark):
    stream = bytearray(200)
    stream[4] = stream[196] = 0x47
    once = bytearray(200)
    once[4] = 0x47
    assert values(spark, [(stream,), (once,)], "head binary", mime.sniffed(F.col("head"))) == [("video/m2ts",), ("",)]
    kinds = ["application/pdf", "application/msword", "text/rtf", "image/vnd.fpx", "image/png", "video/webm", "video/x-matroska", "text/plain", "application/zip", "application/vnd.oasis.opendocument.text", ""]
    got = values(spark, [(k,) for k in kinds], "m string", mime.is_office(F.col("m")), mime.is_media(F.col("m")), mime.is_matroska(F.col("m")), mime.is_image(F.col("m")))
    assert [g[0] for g in got] == [True, True, True, False, False, False, False, True, False, True, False]
    assert [g[1] for g in got] == [False, False, False, False, True, True, True, False, False, False, False]
    assert [g[2] for g in got] == [False] * 5 + [True, True] + [False] * 4 and [g[3] for g in got] == [False, False, False, True, True] + [False] * 6
    assert formats.read("text/plain", b"2017-02-14") == {} == formats.read("text/markdown", b"# 2017")


def test_times_in_names(spark):
    noon = 1_714_564_800  # 2024-05-01 12:00:00
    names = {
        "IMG_20240501_120000": ("FilenamePhone", noon), "DSC_20240501_120000": ("FilenameCamera", noon), "VID_20240501_120000": ("FilenameVideoPhone", noon), "PXL_20240501_120000123": ("FilenamePixel", noon),
        "Screenshot_2024-05-01-12-00-00-99": ("FilenameScreenshot", noon), "Screenshot_20240501_120000_app": ("FilenameScreenshot", noon), "Screen Shot 2024-05-01 at 12.00.00": ("FilenameScreenshot", noon),
        "mmexport1714564800123": ("FilenameWeChatExport", noon), "WhatsApp Image 2024-05-01 at 12.00.00": ("FilenameWhatsApp", noon), "WhatsApp Video 2024-05-01 at 12.00.00 (1)": ("FilenameWhatsApp", noon),
        "20240501_120000": ("FilenameBareYyyymmdd", noon), "1714564800123": ("FilenameUnixMillis", noon), "trip 2024-05-01 12-00-00 x": ("FilenameDashedDateTime", noon),
        "holiday-20240501": ("FilenameBareYyyymmdd", noon - 43_200), "20240501": ("FilenameBareYyyymmdd", noon - 43_200), "IMG_20240501_120000x": ("FilenameBareYyyymmdd", noon - 43_200), "a20240501": None, "": None, "IMG_20241399_990000": None, "img": None, "99999999": None,
    }
    t = capture.filename_time(F.col("stem"))
    got = values(spark, [(n,) for n in names], "stem string", "stem", t["source"], t["utc"])
    assert {n: (s and (s, u)) for n, s, u in got} == names
    assert [capture.offset_secs(h) for h in (0, 8, -23, 23, 24, -99)] == [0, 28_800, -82_800, 82_800, 0, 0]


def test_templates_and_literals(spark):
    assert paths.template_errors("{year}/{month}") is None and paths.template_errors("x/{valuable_name}") and paths.template_errors("{year") and paths.template_errors("") and paths.template_errors("{nope}/{year}")
    row = {k: F.lit(v) for k, v in {"year": "2024", "month": "05", "valuable_name": ""}.items()}
    shown = spark.range(1).select(paths.rendered("{year}//{valuable_name}/{month}/{other}", row), paths.python_literal(F.lit('a"b\\c\n'))).first()
    assert shown[0] == "2024/05/{other}" and eval('"' + shown[1].replace("\n", "\\n") + '"') == 'a"b\\c\n'
    text = spark.createDataFrame([("a b#?@:%é\x01~",)], "p string").select(paths.encoded(F.col("p"))).first()[0]
    assert text == "a%20b%23%3F%40%3A%25%C3%A9%01~"


def test_numbers_of_faces(spark):
    closed = select.blink(F.col("ear"), F.col("l"), F.col("r"))
    assert values(spark, [(0.2, 0.0, 0.0), (0.21, 0.5, 0.5), (None, 0.1, 0.6), (None, 0.0, 0.0)], "ear double, l double, r double", closed) == [(True,), (False,), (True,), (False,)]
    assert values(spark, [(float("nan"), 9), (-1.0, 9), (3.9, 9), (99.0, 9), (float("inf"), 9)], "v double, n int", V.clamped(F.col("v"), 9)) == [(0,), (0,), (3,), (9,), (9,)]
    scores = {s: np.zeros((1, (64 // s) ** 2 * 2)) for s in (8, 16, 32)}
    boxes, points = {s: np.ones((1, (64 // s) ** 2 * 2, 4)) for s in scores}, {s: np.zeros((1, (64 // s) ** 2 * 2, 10)) for s in scores}
    scores[16][0, 2 * (4 * 1 + 2)] = 0.9  # row 1, column 2 at stride 16
    scores[8][0, 0] = float("nan")
    (row,) = images.anchors_decoded(scores, boxes, points, 64, 0.5, 0.5)
    assert row[:5].tolist() == [0.9, 32.0, 0.0, 96.0, 64.0] and row[5:].tolist() == [64.0, 32.0] * 5
