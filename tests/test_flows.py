import os
import random
import struct
import zlib

import numpy as np
import pytest

from shutterloom import config
from shutterloom.functions import images
from shutterloom.operators import archive
from shutterloom.operators.models import FakeFaceAnalyzer, FakeTextDetector, OnnxTextDetector
from shutterloom.plans import flows
from shutterloom.sources import listing

JPEG = b"\xff\xd8\xff\xe0\0\4xx"


def png(rgb):
    h, w, _ = rgb.shape
    body = zlib.compress(b"".join(b"\0" + row.tobytes() for row in rgb))
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def put(path, raw, mtime=1_600_000_000):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(raw)
    os.utime(path, (mtime, mtime))
    return str(path)


def files_in(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


def test_listing(spark, tmp_path):
    put(f"{tmp_path}/a/x.jpg", b"1")
    put(f"{tmp_path}/a/.hidden", b"1")
    put(f"{tmp_path}/_b/empty", b"")
    os.symlink(f"{tmp_path}/a/x.jpg", f"{tmp_path}/link")
    rows = {os.path.relpath(r.path, tmp_path): (r.kind, r.size, r.status) for r in listing.local_tree(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("dir", 0, "ok"), "a/x.jpg": ("file", 1, "ok"), "_b": ("dir", 0, "ok"), "_b/empty": ("file", 0, "ok"), "link": ("other", 0, "ok")}
    assert [r.status for r in listing.local_tree(spark, f"{tmp_path}/none").collect()] == ["walk_error"]
    with pytest.raises(listing.Unsupported):
        listing.tree(spark, "smb://host/share")
    with pytest.raises(ValueError):
        listing.ensure_outside([f"{tmp_path}/a"], str(tmp_path))


def test_find_and_script(spark, tmp_path):
    twin = os.urandom(9000)
    put(f"{tmp_path}/in/a", twin), put(f"{tmp_path}/in/b", twin), put(f"{tmp_path}/keep/c", twin)
    put(f"{tmp_path}/in/d", twin[:8999] + b"?"), put(f"{tmp_path}/in/e", b"x"), put(f"{tmp_path}/in/f", b"")
    groups = flows.find(spark, [f"{tmp_path}/in", f"{tmp_path}/keep"])
    (g,) = groups.collect()
    assert (g["size"], g.n, [os.path.basename(p) for p in g.paths]) == (9000, 3, ["a", "b", "c"])
    script = flows.delete_script(groups, f"{tmp_path}/keep")
    assert [x.startswith("os.remove") for x in script.splitlines()[2:]] == [True, True, False]
    assert flows.delete_script(groups.limit(0), None) == ""


def test_copy_and_move(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(f"{src}/IMG_20240501_120000.jpg", JPEG + b"1")
    put(f"{src}/été/IMG_20240501_120000.jpg", JPEG + b"2")
    put(f"{src}/z/IMG_20240502_120000.jpg", JPEG + b"1")
    put(f"{src}/y/IMG_20240501_120000.jpg", JPEG + b"3")
    put(f"{src}/notes.txt", b"text")
    put(f"{src}/empty.jpg", b"")
    report, _ = flows.copy(spark, [src], out, dry_run=True)
    assert report.counts["copied"] == 4 and not os.path.exists(out)
    report, _ = flows.copy(spark, [src], out)
    assert {k: report.counts[k] for k in ("scanned", "copied", "ignored", "failed", "skipped_empty")} == {"scanned": 6, "copied": 3, "ignored": 2, "failed": 0, "skipped_empty": 1}
    assert files_in(out) == ["2024/05/IMG_20240501_120000.jpg", "2024/05/IMG_20240501_120000_1.jpg", "2024/05/été/IMG_20240501_120000.jpg"]
    report, _ = flows.copy(spark, [src], out)
    assert report.counts["copied"] == 0 and report.counts["ignored"] == 5
    put(f"{src}/new.jpg", JPEG + b"4"), put(f"{src}/new2.jpg", JPEG + b"4")
    report, _ = flows.copy(spark, [src], out, remove=True)
    report.raise_for_failures()
    assert (report.counts["copied"], files_in(src)) == (1, ["empty.jpg", "notes.txt"])
    assert "2020/09/new.jpg" in files_in(out)
    report.write(f"{tmp_path}/report.json")


def test_text_shots(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    yes, no, bad = put(f"{src}/a/yes.jpg", JPEG), put(f"{src}/no.jpg", JPEG), put(f"{src}/bad.jpg", JPEG)
    put(f"{src}/t.txt", b"t"), put(f"{out}/a/yes.jpg", b"other")
    report, _ = flows.move_text_shots(spark, [src], out, FakeTextDetector({yes: True, bad: RuntimeError("no")}))
    assert {k: report.counts[k] for k in ("scanned", "ocr_hits", "moved", "skipped_non_image", "skipped_no_text", "failed")} == {"scanned": 4, "ocr_hits": 1, "moved": 1, "skipped_non_image": 1, "skipped_no_text": 1, "failed": 1}
    assert files_in(out) == ["a/yes.jpg", "a/yes_1.jpg"] and no
    with pytest.raises(RuntimeError):
        report.raise_for_failures()
    with pytest.raises(ValueError):
        OnnxTextDetector("")


def test_cull(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rnd = np.random.default_rng(1)
    base = images.resized(rnd.integers(0, 255, (8, 8, 3)), 64, 64)
    noise = rnd.normal(0, 6, base.shape)
    for name, pixels in (("a", base), ("b", base + noise), ("c", base + noise / 2), ("d", images.resized(rnd.integers(0, 255, (8, 8, 3)), 64, 64))):
        put(f"{src}/{name}.png", png(np.clip(pixels, 0, 255).astype(np.uint8)))
    put(f"{src}/broken.png", b"\x89PNG\r\n\x1a\nxx"), put(f"{src}/t.txt", b"t")
    report, result = flows.cull(spark, [src], out, FakeFaceAnalyzer({f"{src}/b.png": [{"is_blink": True, "smile": 0.0}]}), config.Config(face=config.Face(sharpness_min=1.0)))
    assert (report.counts["scanned"], report.counts["grouped"], report.counts["best_count"], report.counts["moved"], report.counts["failed"]) == (6, 3, 1, 2, 1)
    flows.write_manifests(result)
    assert files_in(out) == ["group-001/BEST_b.png", "group-001/MANIFEST.json", "group-001/a.png", "group-001/c.png"]
    assert files_in(src) == ["b.png", "broken.png", "d.png", "t.txt"]


def test_cull_photos(spark, tmp_path):
    """JPEG files, in odd folders, with a broken one, one with another ending, and one that is no JPEG."""
    src, out = f"{tmp_path}/in [1]", f"{tmp_path}/out"
    rnd = np.random.default_rng(4)
    base = images.resized(rnd.integers(0, 255, (8, 8, 3)), 64, 64)
    noise = rnd.normal(0, 6, base.shape)
    io, file = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io.File
    for name, pixels in (("a.jpg", base), ("sub é/b.JPEG", base + noise), ("c.png", base + noise / 2), ("e.dat", base), ("d.Jpg", images.resized(rnd.integers(0, 255, (8, 8, 3)), 64, 64))):
        put(f"{src}/{name}", png(np.clip(pixels, 0, 255).astype(np.uint8)))
        if not name.endswith("png"):
            assert io.write(io.read(file(f"{src}/{name}")), "jpg", file(f"{src}/{name}"))
    put(f"{src}/broken.jpg", JPEG), put(f"{src}/t.jpg", b"t")
    faces = FakeFaceAnalyzer({f"{src}/sub é/b.JPEG": [{"is_blink": True, "smile": 0.0}], f"{src}/a.jpg": [{"is_blink": False, "smile": 1.0}], f"{src}/c.png": ValueError("no model")})
    report, result = flows.cull(spark, [src], out, faces, config.Config(face=config.Face(sharpness_min=1.0, w_smile=1000.0)))
    assert {e["path"].removeprefix(src) for e in report.errors} == {"/broken.jpg", "/e.dat", "/c.png"}
    assert (report.counts["scanned"], report.counts["grouped"], report.counts["best_count"], report.counts["moved"]) == (7, 3, 1, 2)
    assert files_in(out) == ["group-001/BEST_a.jpg", "group-001/b.JPEG", "group-001/c.png"]
    pixel = spark.read.format("image").load(f"file://{tmp_path}/out/group-001/BEST_a.jpg").first().image
    decoded = images.from_image_row(pixel.data, pixel.height, pixel.width, pixel.nChannels)
    assert np.abs(decoded.astype(float) - np.clip(base, 0, 255)).mean() < 12


def test_images():
    rnd = np.random.default_rng(2)
    rgb = rnd.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    assert (images.decode(png(rgb)) == rgb).all()
    assert (images.decode(b"P6 # c\n30 20\n255\n" + rgb.tobytes()) == rgb).all()
    for raw in (b"", b"\xff\xd8", b"BMxx", png(rgb)[:60]):
        with pytest.raises(images.UnreadableImage):
            images.decode(raw)
    smooth = images.resized(rnd.integers(0, 255, (6, 6, 3)), 90, 120)
    near = images.phash(np.clip(smooth * 1.05 + 3, 0, 255))
    assert (images.phash(smooth) ^ near).bit_count() <= 8
    assert images.phash(np.zeros((40, 40, 3))) == 0 and images.laplacian_variance(np.full((5, 5), 9.0)) == 0
    points = rnd.normal(size=(5, 2)) * 20
    a, b, tx, ty = 0.8, 0.3, 4.0, -2.0
    moved = np.stack([a * points[:, 0] - b * points[:, 1] + tx, b * points[:, 0] + a * points[:, 1] + ty], 1)
    assert np.allclose(images.similarity_fit(points, moved), (a, b, tx, ty))
    with pytest.raises(ValueError):
        images.similarity_fit(np.ones((5, 2)), moved)
    assert (images.warped(rgb, (1.0, 0.0, 0.0, 0.0), 20) == rgb[:20, :20]).all()
    assert images.letterboxed(rgb, 64, 128, 127.5, 128, True)[0].shape == (1, 3, 64, 64) and images.text_input(rgb).shape == (1, 3, 32, 32)


def test_config():
    text = "copy:\n  timezone_offset_hours: ${TZ_H:-${OTHER:-3}}\n  unknown: 1\nface:\n  sharpness_min: -1\n  w_blink: 3\n"
    with pytest.warns(UserWarning):
        got = config.loaded(text, {})
    assert (got.copy.timezone_offset_hours, got.face.sharpness_min, got.face.w_blink) == (3, 100.0, 3.0)
    assert config.expanded("a${X}b${Y:-d}${", {"X": "1\n2"}) == "a12bd${"
    with pytest.warns(UserWarning):
        assert config.loaded("- [", {}) == config.Config()
    assert random is not None


def test_streams(spark, tmp_path):
    from shutterloom.streaming import scan

    rows = [("u", f"2024-01-01 00:00:{s:02d}", "x", 1.0) for s in (0, 5, 9, 40, 45)]
    spark.createDataFrame(rows, "user_id string, ts string, event_type string, value double").selectExpr("user_id", "cast(ts as timestamp) ts", "event_type", "value").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("user_id string, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    for k, df in enumerate((scan.bursts(stream), scan.windowed_counts(stream))):
        q = df.writeStream.outputMode("complete" if k else "append").format("memory").queryName(f"out{k}").option("checkpointLocation", f"{tmp_path}/c{k}").start()
        q.processAllAvailable()
        q.stop()
    assert [r.n for r in spark.sql("select n from out1").collect()] == [5]
    listed = spark.createDataFrame([("p", 1, 2, "2024-01-01 00:00:00")] * 2, "path string, size long, modified long, seen string").selectExpr("path", "size", "modified", "cast(seen as timestamp) seen")
    listed.write.parquet(f"{tmp_path}/l")
    q = scan.new_files(spark.readStream.schema(listed.schema).parquet(f"{tmp_path}/l")).writeStream.format("memory").queryName("seen_files").option("checkpointLocation", f"{tmp_path}/c9").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from seen_files").count() == 1


def test_sidecars_date_their_media(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(f"{src}/a.jpg", JPEG + b"a")
    put(f"{src}/a.xmp", b'<x:xmpmeta><rdf:Description photoshop:DateCreated="2015-03-04T05:06:07Z"/></x:xmpmeta>')
    put(f"{src}/b.jpg", JPEG + b"b")
    put(f"{src}/b.jpg.json", b'{"photoTakenTime": {"timestamp": "1388534400"}}')
    put(f"{src}/c.jpg", JPEG + b"c")
    put(f"{src}/c.jpg.json", b"not json")
    settings = config.Config()
    report, done = flows.copy(spark, [src], out, settings)
    assert report.counts["copied"] == 3 and report.counts["failed"] == 0
    found = {os.path.basename(r.target): os.path.relpath(r.target, out) for r in done.where("status = 'copied'").collect()}
    assert "2015" in found["a.jpg"] and "03" in found["a.jpg"] and "2014" in found["b.jpg"] and "2020" in found["c.jpg"]


def test_transfers_rename_and_compare(tmp_path, monkeypatch):
    a, b = put(f"{tmp_path}/a", b"same"), f"{tmp_path}/x/b"
    inode = os.stat(a).st_ino
    with monkeypatch.context() as m:
        m.setattr(flows, "_sha512", lambda path: pytest.fail("a move on one volume reads no bytes"))
        flows.transferred(a, b, None, True)
    assert os.stat(b).st_ino == inode and not os.path.exists(a)
    flows.transferred(a, b, None, True)  # a second run of the task
    a = put(f"{tmp_path}/a", b"same")
    flows.transferred(a, b, None, False)
    assert os.path.exists(a)
    flows.transferred(a, b, None, True)
    assert not os.path.exists(a)
    a = put(f"{tmp_path}/a", b"else")
    for remove in (False, True):
        with pytest.raises(OSError, match="other bytes"):
            flows.transferred(a, b, None, remove)
    assert os.path.exists(a) and open(b, "rb").read() == b"same"


def test_unique_names_against_serial_run(spark):
    rnd = random.Random(5)
    names = ["a.jpg", "a_1.jpg", "a_1_1.jpg", "b", "b_2", "c.tar.gz", "d_7.png"]
    rows = [(f"/p{i:03d}", rnd.choice(["/x", "/y"]), rnd.choice(names)) for i in range(90)] + [(f"/q{i}", "/z", "one.jpg") for i in range(15)]
    exists = [("/x", "a_2.jpg"), ("/x", "b"), ("/z", "one_1.jpg"), ("/z", "one_3.jpg"), ("/z", "one_03.jpg"), ("/y", "c.tar_1.gz")]
    got = archive.unique_names(spark.createDataFrame(rows, "path string, dir string, name string"), spark.createDataFrame(exists, "dir string, name string"), 10).collect()
    targets = [(r.dir, r.target_name) for r in got if r.target_name]
    assert len(got) == len(rows) and len(set(targets)) == len(targets) and not set(targets) & set(exists)
    z = {r.path: r.target_name for r in got if r.dir == "/z"}
    want = ["one.jpg", *(f"one_{i}.jpg" for i in (2, 4, 5, 6, 7, 8, 9, 10)), *[None] * 6]
    assert [z[p] for p in sorted(z, key=lambda p: (len(p), p))] != [] and [z[p] for p in sorted(z)] == want


def test_movie_box_behind_the_data(spark, tmp_path):
    seconds_1904 = 1_487_068_200 + 2_082_844_800
    mvhd = struct.pack(">I4sB3xII", 108, b"mvhd", 0, seconds_1904, seconds_1904) + b"\0" * 88
    moov = struct.pack(">I4s", 8 + len(mvhd), b"moov") + mvhd
    data = struct.pack(">I4s", 3_000_008, b"mdat") + b"\0" * 3_000_000
    put(f"{tmp_path}/in/clip.mp4", struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + data + moov)
    put(f"{tmp_path}/in/old.mov", data + moov + b"more")
    _, done = flows.copy(spark, [f"{tmp_path}/in"], f"{tmp_path}/out")
    assert ["2017" in r.target and "02" in r.target for r in done.where("status = 'copied'").collect()] == [True, True]


def test_dates_behind_the_pixels(spark, tmp_path):
    """Phone pictures and raw files go to their month, wherever their directories stand."""
    from test_formats import heic, tiff_block

    block = bytearray(tiff_block())
    late = b"II*\0" + struct.pack("<I", (2 << 20) + 8) + b"\1" * (2 << 20)
    for at in [10 + 12 * i + 8 for i in range(4)] + [10 + 48 + 4 + 2 + 12 * i + 8 for i in range(2)]:
        block[at : at + 4] = struct.pack("<I", struct.unpack("<I", block[at : at + 4])[0] + (2 << 20))
    put(f"{tmp_path}/in/a.heic", heic(2)), put(f"{tmp_path}/in/late.tif", late + bytes(block[8:]))
    put(f"{tmp_path}/in/late.cr2", b"II*\0" + struct.pack("<I", (2 << 20) + 8) + b"CR\2\0" + b"\2" * ((2 << 20) - 4) + bytes(block[8:]))
    _, done = flows.copy(spark, [f"{tmp_path}/in"], f"{tmp_path}/out")
    assert sorted(os.path.relpath(r.target, f"{tmp_path}/out") for r in done.where("status = 'copied'").collect()) == ["2017/02/a.heic", "2017/02/late.cr2", "2017/02/late.tif"]


def test_listing_is_dealt_out_evenly(spark, tmp_path):
    """One folder of very many files is many tasks, very many small folders few; the rows are those of a walk."""
    root = f"{tmp_path}/t"
    os.makedirs(f"{root}/DCIM/100"), os.makedirs(f"{root}/.hidden/x"), os.makedirs(f"{root}/empty")
    for i in range(20_000):
        os.close(os.open(f"{root}/DCIM/100/f{i}", os.O_CREAT))
    for i in range(700):
        put(f"{root}/small/d{i}/a/b/c.jpg", b"1")
    os.symlink(root, f"{root}/loop")
    reader = listing.TreeReader({"path": root})
    parts = reader.partitions()
    assert 6 <= len(parts) <= 60 and max(len(p.entries) for p in parts) <= listing.WEIGHT
    want = {root + "/loop"} | {os.path.join(d, n) for d, folders, names in os.walk(root) for n in [*folders, *names] if "/.hidden" not in f"{d}/{n}" and n != "loop"}
    rows = [r for p in parts for r in reader.read(p)]
    assert len(rows) == len({r[0] for r in rows}) and {r[0] for r in rows} == want
    assert listing.tree(spark, root).where("kind = 'file'").count() == 20_700
    stored = listing.tree(spark, f"file://{root}", f"file://{root}/small").collect()
    assert {r.path for r in stored if r.kind == "file"} == {f"file://{root}/DCIM/100/f{i}" for i in range(20_000)} and all(r.size == 0 for r in stored)


def test_stores_lose_no_files(spark, tmp_path):
    """Hidden-looking names, folders and empty files are listed; a failed folder is a row."""
    put(f"{tmp_path}/a b%20.jpg", b"12"), put(f"{tmp_path}/_b.jpg", b"1"), put(f"{tmp_path}/_x/c.jpg", b"1"), put(f"{tmp_path}/empty", b"")
    rows = {r.path.removeprefix(f"file://{tmp_path}/"): (r.kind, r.size, r.status) for r in listing.tree(spark, f"file://{tmp_path}").collect()}
    assert rows == {"a b%20.jpg": ("file", 2, "ok"), "_b.jpg": ("file", 1, "ok"), "_x": ("dir", 0, "ok"), "_x/c.jpg": ("file", 1, "ok"), "empty": ("file", 0, "ok")}
    assert [r.status for r in listing.tree(spark, f"file://{tmp_path}/none").collect()] == ["walk_error"]
    with pytest.raises(ValueError):
        listing.ensure_outside([f"file://{tmp_path}/a"], f"file://{tmp_path}/")


def test_flows_on_a_store(spark, tmp_path):
    """The same flows by way of Arrow's file systems."""
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    uri = lambda p: f"file://{p}"
    put(f"{src}/IMG_20240501_120000.jpg", JPEG + b"1"), put(f"{src}/été/IMG_20240501_120000.jpg", JPEG + b"2"), put(f"{src}/z/IMG_20240502_120000.jpg", JPEG + b"1")
    put(f"{src}/_y/IMG_20240501_120000.jpg", JPEG + b"3"), put(f"{src}/notes.txt", b"text")
    put(f"{src}/a.jpg", JPEG + b"a"), put(f"{src}/a.xmp", b'<x:xmpmeta><rdf:Description photoshop:DateCreated="2015-03-04T05:06:07Z"/></x:xmpmeta>')
    (g,) = flows.find(spark, [uri(src)]).collect()
    assert g.n == 2 and g.paths[0] == uri(f"{src}/IMG_20240501_120000.jpg")
    report, _ = flows.copy(spark, [uri(src)], uri(out))
    assert (report.counts["copied"], report.counts["ignored"], report.counts["failed"], report.result) == (4, 3, 0, "ok")
    assert files_in(out) == ["2015/03/a.jpg", "2024/05/IMG_20240501_120000.jpg", "2024/05/IMG_20240501_120000_1.jpg", "2024/05/été/IMG_20240501_120000.jpg"]
    put(f"{src}/new.jpg", JPEG + b"4"), put(f"{src}/new2.jpg", JPEG + b"4")
    report, _ = flows.copy(spark, [uri(src)], uri(out), remove=True)
    assert (report.counts["copied"], report.counts["failed"], files_in(src)) == (1, 0, ["a.xmp", "notes.txt"])
    report.write(uri(f"{tmp_path}/report.json"))
    assert '"result": "ok"' in open(f"{tmp_path}/report.json").read()
    shot = put(f"{src}/s/shot.png", b"\x89PNG\r\n\x1a\n" + b"x" * 5000)
    report, _ = flows.move_text_shots(spark, [uri(src)], uri(f"{tmp_path}/shots"), FakeTextDetector({uri(shot): True}))
    assert report.counts["moved"] == 1 and files_in(f"{tmp_path}/shots") == ["s/shot.png"]
    rnd = np.random.default_rng(1)
    base = images.resized(rnd.integers(0, 255, (8, 8, 3)), 64, 64)
    for name in "abc":
        put(f"{tmp_path}/burst/{name}.png", png(np.clip(base + rnd.normal(0, 2, base.shape), 0, 255).astype(np.uint8)))
    report, result = flows.cull(spark, [uri(f"{tmp_path}/burst")], uri(f"{tmp_path}/culled"), None, config.Config(face=config.Face(sharpness_min=1.0)))
    flows.write_manifests(result)
    assert report.counts["moved"] == 2 and len(files_in(f"{tmp_path}/culled")) == 4


def test_copy_reads_as_little_as_it_takes(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    big = 3 << 20

    def sparse(path, tail, size=big):
        put(path, JPEG)
        with open(path, "r+b") as f:
            f.seek(size - len(tail))
            f.write(tail)
        os.utime(path, (1_600_000_000, 1_600_000_000))

    for i in range(20):
        sparse(f"{src}/u{i}.jpg", b"u", big + 10 + i)  # like no other by size
    sparse(f"{src}/a.jpg", b"a"), sparse(f"{src}/b.jpg", b"b"), sparse(f"{src}/c.jpg", b"a")  # told apart by the whole
    sparse(f"{out}/old/x.jpg", b"x", big + 9), sparse(f"{out}/old/c.jpg", b"a"), sparse(f"{out}/old/u.jpg", b"v", big + 10)
    report, _ = flows.copy(spark, [src], out, dry_run=True)
    page = 64 << 10  # heads, where an XMP packet is looked for
    whole = 3 * big + big + 2 * (big + 10)
    assert whole <= report.counts["bytes_read"] <= whole + 25 * page and (report.counts["copied"], report.counts["ignored"]) == (21, 2)
    report, _ = flows.copy(spark, [src], out, remove=True)
    assert report.counts["failed"] == 0 and files_in(src) == [] and len(files_in(out)) == 3 + 21
    # a missing twin keeps the duplicate
    sparse(f"{src}/u0.jpg", b"q"), sparse(f"{src}/z.jpg", b"q"), put(f"{out}/2020/09/u0_1.jpg", b"z")
    report, done = flows.copy(spark, [src], out, config.Config(copy=config.Copy(unique_name_max_attempts=1)), remove=True)
    rows = {os.path.basename(r.path): r.status for r in done.collect()}
    assert rows == {"u0.jpg": "failed", "z.jpg": "ignored"} and files_in(src) == ["u0.jpg", "z.jpg"]
    assert report.result == "partial" and report.errors[0]["kind"] == "other"


def test_burst_of_copies_costs_a_link_each(spark, tmp_path, monkeypatch):
    from shutterloom.operators import similar

    rows = spark.range(3000).selectExpr("id", "7L as hash").unionAll(spark.createDataFrame([(5000, 7 ^ 1), (6000, -1)], "id long, hash long"))
    assert similar.hamming_links(rows, 10).count() == 3000
    with monkeypatch.context() as m:
        m.setattr(similar, "hamming_pairs", lambda *a: pytest.fail("cull needs no pairs"))
        rgb = images.resized(np.random.default_rng(3).integers(0, 255, (8, 8, 3)), 48, 48).astype(np.uint8)
        for i in range(40):
            put(f"{tmp_path}/in/{i:02d}.png", png(rgb))
        report, _ = flows.cull(spark, [f"{tmp_path}/in"], f"{tmp_path}/out", None, config.Config(face=config.Face(sharpness_min=1.0)))
    assert (report.counts["best_count"], report.counts["moved"]) == (1, 39)


def interlaced(values, depth, kind, adam7):
    """A PNG of (height, width, channels) samples, with each row's filter in turn."""
    h, w, channels = values.shape
    passes = images.PASSES if adam7 else ((0, 0, 1, 1),)
    body = b""
    for x0, y0, dx, dy in passes:
        part = values[y0::dy, x0::dx]
        if not part.size:
            continue
        if depth == 16:
            rows = [r.reshape(-1).astype(">u2").tobytes() for r in part]
        elif depth == 8:
            rows = [r.astype(np.uint8).tobytes() for r in part]
        else:
            rows = [np.packbits(np.unpackbits(r.reshape(-1, 1).astype(np.uint8), axis=1)[:, 8 - depth :].reshape(-1)).tobytes() for r in part]
        back, above = max(1, channels * depth // 8), bytes(len(rows[0]))
        for y, row in enumerate(rows):
            before = lambda i, r: r[i - back] if i >= back else 0
            paeth = lambda a, b, c: min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            guess = [lambda i: 0, lambda i: before(i, row), lambda i: above[i], lambda i: (before(i, row) + above[i]) // 2, lambda i: paeth(before(i, row), above[i], before(i, above))][y % 5]
            body += bytes([y % 5]) + bytes((row[i] - guess(i)) & 255 for i in range(len(row)))
            above = row
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    palette = chunk(b"PLTE", bytes(range(48)) * 16) if kind == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, adam7)) + palette + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_of_all_kinds():
    rnd = np.random.default_rng(9)
    for kind, channels, depths in ((0, 1, (1, 2, 4, 8, 16)), (2, 3, (8, 16)), (3, 1, (1, 2, 4, 8)), (4, 2, (8, 16)), (6, 4, (8, 16))):
        for depth in depths:
            for h, w in ((1, 1), (3, 5), (9, 13)):
                for adam7 in (0, 1):
                    values = rnd.integers(0, 1 << depth, (h, w, channels))
                    got = images.decode(interlaced(values, depth, kind, adam7))
                    if kind == 3:
                        want = np.frombuffer(bytes(range(48)) * 16, np.uint8).reshape(-1, 3)[values[:, :, 0]]
                    else:
                        scaled = values >> 8 if depth == 16 else values * 255 // ((1 << depth) - 1)
                        want = np.repeat(scaled[:, :, :1], 3, 2) if channels < 3 else scaled[:, :, :3]
                    assert (got == want).all(), (kind, depth, h, w, adam7)


def test_cull_decodes_pictures_of_many_kinds(spark, tmp_path):
    """GIF, TIFF, BMP and interlaced PNG by Spark's image source; grey PNG of 16 bits and hidden names by the workers."""
    src = f"{tmp_path}/in"
    base = np.clip(images.resized(np.random.default_rng(4).integers(0, 255, (8, 8, 3)), 64, 64), 0, 255).astype(np.uint8)
    put(f"{src}/a.png", png(base)), put(f"{src}/_hidden.png", png(base))
    put(f"{src}/inter.png", interlaced(base.astype(int), 8, 2, 1)), put(f"{src}/deep.png", interlaced(base.astype(int) * 257, 16, 2, 0))
    io, file = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io.File
    for kind in ("gif", "tif", "bmp"):
        assert io.write(io.read(file(f"{src}/a.png")), kind, file(f"{src}/x.{kind}"))
    put(f"{src}/grey.png", interlaced(images.grey(base).astype(int)[:, :, None] * 257, 16, 0, 1)), put(f"{src}/bad.tiff", b"II*\0rest"), put(f"{src}/w.webp", b"RIFF0000WEBPVP8 ")
    report, _ = flows.cull(spark, [src], f"{tmp_path}/out", None, config.Config(face=config.Face(sharpness_min=1.0)))
    assert {os.path.basename(e["path"]) for e in report.errors} == {"bad.tiff", "w.webp"}
    assert (report.counts["grouped"], report.counts["moved"]) == (8, 7)
