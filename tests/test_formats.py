import io
import json
import plistlib
import struct
import zipfile
from datetime import datetime

from shutterloom.functions import mime
from shutterloom.sources import formats as R

T = 1487068200  # 2017-02-14 10:30:00 UTC


def tiff_block(order="<", base=0):
    """IFD0 with make, model, modify date and an EXIF directory with two dates."""
    e = lambda tag, kind, count, value: struct.pack(order + "HHII", tag, kind, count, value)
    texts = [b"Canon\0", b"EOS 7D\0", b"2017:02:14 10:30:02\0", b"2017:02:14 10:30:00\0", b"2017:02:14 10:30:01\0"]
    at, start = [], 8 + 2 + 4 * 12 + 4 + 2 + 2 * 12 + 4
    for t in texts:
        at.append(start + base)
        start += len(t)
    exif = 8 + 2 + 4 * 12 + 4 + base
    ifd0 = struct.pack(order + "H", 4) + e(0x010F, 2, 6, at[0]) + e(0x0110, 2, 7, at[1]) + e(0x0132, 2, 20, at[2]) + e(0x8769, 4, 1, exif) + b"\0" * 4
    sub = struct.pack(order + "H", 2) + e(0x9003, 2, 20, at[3]) + e(0x9004, 2, 20, at[4]) + b"\0" * 4
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return head + ifd0 + sub + b"".join(texts)


def boxed(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def ebml(name, body, size=None):
    return bytes.fromhex(name) + ((0x10 << 24 | len(body)).to_bytes(4, "big") if size is None else size) + body


MVHD = boxed(b"mvhd", b"\0\0\0\0" + struct.pack(">I", T + 2_082_844_800) + b"\0" * 20)
DATE = struct.pack(">q", (T - 978_307_200) * 10**9)
WANT = {"dto": T, "create_date": T + 1, "modify_date": T + 2, "make": "Canon", "model": "EOS 7D"}


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def test_exif_containers():
    for order in "<>":
        block = tiff_block(order)
        assert R.read("image/tiff", block) == WANT
        app1 = b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block
        assert R.read("image/jpeg", app1) == WANT
        assert R.read("image/png", b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 2, b"abcd") + b"xx\0\0\0\0" + struct.pack(">I4s", len(block), b"eXIf") + block) == WANT
    strd = b"AVIF" + b"\0" * 4 + tiff_block()[8:]
    body = b"strd" + struct.pack("<I", len(strd)) + strd
    strl = b"LIST" + struct.pack("<I", len(body) + 4) + b"strl" + body
    hdrl = b"LIST" + struct.pack("<I", len(strl) + 4) + b"hdrl" + strl
    assert R.read("video/x-msvideo", b"RIFF" + struct.pack("<I", len(hdrl) + 4) + b"AVI " + hdrl) == WANT
    assert R.read("image/tiff", tiff_block(), 3600)["dto"] == T - 3600
    assert R.read("image/jpeg", b"\xff\xd8\xff\xe1\xff") == {} and R.read("image/png", b"") == {}


def test_video_and_text_containers():
    assert R.read("video/mp4", boxed(b"ftyp", b"isom") + boxed(b"moov", MVHD)) == {"qt_create_date": T}
    assert R.read("video/x-matroska", ebml("1a45dfa3", b"") + ebml("18538067", ebml("1549a966", ebml("4461", DATE)))) == {"qt_create_date": T}
    user = b"\0" * 9 + b"MDPM" + bytes([2, 0x18, 0, 0x20, 0x17, 0x02, 0x19, 0x14, 0x10, 0x30, 0x00])
    packet = b"\0\0\0\0\x47\x10\x11\x10" + user
    assert R.read("video/m2ts", packet.ljust(192, b"\xff")) == {"qt_create_date": T}
    assert R.read("image/jpeg", b'<x:xmpmeta><!-- photoshop:DateCreated="1999-01-01T00:00:00Z" --><r photoshop:DateCreated="2017-02-14T18:30:00+08:00" xmp:CreateDate="bad" xmp:CreateDate="2017-02-14T10:30:05Z"/></x:xmpmeta>') == {"dto": T, "create_date": T + 5}
    assert R.read("application/pdf", b"%PDF /CreationDate (D:20170214103000Z) /ModDate(D:20170214183000+08'00')") == {"doc_created": T, "doc_modified": T}
    assert R.read("application/pdf", b"%PDF nothing") == {}
    assert R.read("application/rtf", rb"{\rtf1{\info{\creatim\yr2017\mo2\dy14\hr10\min30}{\revtim\mo3}}}") == {"doc_created": T}
    assert R.read("application/x-freemind", b'<map><node CREATED="1487068200000" MODIFIED="5"/>') == {"doc_created": T}


def test_zipped_documents():
    core = "<a><dcterms:created xsi:type='x'>2017-02-14T10:30:00Z</dcterms:created><dcterms:modified>bad</dcterms:modified></a>"
    assert R.read(R._OOXML + "x", zipped(docProps__core_dot_xml=core)) == {"doc_created": T}
    assert R.read(R._ODF + "text", zipped(meta_dot_xml="<meta:creation-date>2017-02-14T10:30:00</meta:creation-date>")) == {"doc_created": T}
    opf = '<package><dc:date>2017-02-14T10:30:00Z</dc:date><meta property="dcterms:modified">2017-02-14T10:30:09Z</meta></package>'
    assert R.read("application/epub+zip", zipped(**{"META-INF__container_dot_xml": '<rootfile full-path="b.opf"/>', "b_dot_opf": opf})) == {"doc_created": T, "doc_modified": T + 9}
    assert R.read("application/vnd.xmind.workbook", zipped(metadata_dot_json=json.dumps({"created": T * 1000}))) == {"doc_created": T}
    plist = plistlib.dumps({"createdDate": datetime(2017, 2, 14, 10, 30)})
    assert R.read("application/vnd.apple.pages", zipped(Metadata__Properties_dot_plist=plist)) == {"doc_created": T}
    assert R.read(R._OOXML + "x", b"PK broken") == {}
    assert R.takeout_seconds('{"photoTakenTime": {"timestamp": "1714576200"}}') == 1714576200 == R.takeout_seconds('{"photoTakenTime": {"timestamp": 1714576200}}')
    assert R.takeout_seconds("[]") is None


def test_compound_file():
    times = struct.pack("<IQ", 64, (T + 11_644_473_600) * 10**7)
    section = struct.pack("<II", 40, 1) + struct.pack("<II", 12, 16) + times
    stream = (b"\0" * 44 + struct.pack("<I", 48) + section).ljust(4096, b"\0")
    name = "\x05SummaryInformation".encode("utf-16-le")

    def entry(text, first, length):
        return text.ljust(64, b"\0") + struct.pack("<H", len(text) + 2) + b"\0" * 50 + struct.pack("<II", first, length) + b"\0" * 4

    folder = (entry("Root Entry".encode("utf-16-le"), 0xFFFFFFFE, 0) + entry(name, 2, 4096)).ljust(512, b"\0")
    fat = struct.pack("<128I", 0xFFFFFFFD, 0xFFFFFFFE, *range(3, 10), 0xFFFFFFFE, *[0xFFFFFFFF] * 118)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1".ljust(30, b"\0") + struct.pack("<H", 9) + b"\0" * 16 + struct.pack("<I", 1) + b"\0" * 8 + struct.pack("<I", 0xFFFFFFFE) + b"\0" * 12
    raw = head.ljust(76, b"\0")[:76] + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108) + fat + folder + stream
    assert R.read("application/msword", raw) == {"doc_created": T}


def test_exif_time_zones():
    """The offset tags are texts of their own; without them times are local."""
    e = lambda tag, count, value: struct.pack("<HHI", tag, 2, count) + value
    texts = [b"2017:02:14 10:30:00\0", b"+08:00\0", b"-03:30\0"]
    n = 5
    start = 8 + 2 + n * 12 + 4
    at = [struct.pack("<I", start + sum(map(len, texts[:i]))) for i in range(3)]
    block = b"II*\0" + struct.pack("<IH", 8, n) + e(0x0132, 20, at[0]) + e(0x9003, 20, at[0]) + e(0x9004, 20, at[0]) + e(0x9011, 7, at[1]) + e(0x9012, 7, at[2]) + b"\0" * 4 + b"".join(texts)
    assert R.read("image/tiff", block, 3600) == {"dto": T - 8 * 3600, "create_date": T + 3 * 3600 + 1800, "modify_date": T - 3600}
    assert R.seconds("2017:02:14 10:30:00", 3600, "Z") == T and R.seconds("2017:02:14 10:30:00", 3600, "odd") == T - 3600


def test_media_types_by_brand(spark):
    heads = {b"\0\0\0\x18ftypavc1": "video/mp4", b"\0\0\0\x18ftypiso5": "video/mp4", b"\0\0\0\x18ftypM4V ": "video/x-m4v", b"\0\0\0\x18ftypheix": "image/heif", b"\0\0\0\x18ftypavif": "image/avif", b"II*\0\x10\0\0\0CR\2\0": "image/x-canon-cr2", b"II*\0\x08\0\0\0": "image/tiff", b"FLV\1": "video/x-flv", b"\0\0\1\xba": "video/mpeg", b"\0\0\0\x18ftyp3gp5": "video/3gpp", b"\0\0\0\x18ftypzzzz": ""}
    rows = spark.createDataFrame([(bytearray(k), v) for k, v in heads.items()], "head binary, want string")
    assert rows.where(mime.sniffed(rows["head"]) != rows["want"]).count() == 0
    assert rows.where(mime.is_media(mime.sniffed(rows["head"])) != (rows["want"] != "")).count() == 0


def heic(pieces, method=0, version=1, damage=None, gap=3 << 20):
    """Items as a phone writes them: a picture and its EXIF, which stands behind the pixels, or in the meta box."""
    payload = struct.pack(">I", 6) + b"Exif\0\0" + tiff_block(">")
    cuts = [len(payload) * i // pieces for i in range(pieces + 1)]
    head = boxed(b"ftyp", b"heic\0\0\0\0mif1heic")

    def meta(at):
        infe = lambda i, kind: boxed(b"infe", b"\2\0\0\0" + struct.pack(">HH4s", i, 0, kind) + b"\0")
        iinf = boxed(b"iinf", b"\0\0\0\0" + struct.pack(">H", 2) + infe(1, b"hvc1") + infe(7, b"Exif"))
        wide = "I" if version == 2 else "H"
        how = struct.pack(">H", method) if version else b""
        extents = b"".join(struct.pack(">II", (a if method else at + a * 2), b - a) for a, b in zip(cuts, cuts[1:], strict=False))
        item = lambda i, n, body: struct.pack(">" + wide, i) + (struct.pack(">H", 0) if version and i == 1 else how) + struct.pack(">HH", 0, n) + body
        iloc = bytes([version, 0, 0, 0, 0x44, 0x00]) + struct.pack(">" + wide, 2) + item(1, 1, struct.pack(">II", 40, 9)) + item(7, pieces, extents)
        return boxed(b"meta", b"\0\0\0\0" + boxed(b"hdlr", b"\0" * 24) + (boxed(b"idat", payload) if method else b"") + iinf + boxed(b"iloc", iloc[: damage or len(iloc)]))

    at = len(head) + len(meta(0)) + 8 + gap
    body = b"".join(payload[a:b].ljust(2 * (b - a), b"?") for a, b in zip(cuts, cuts[1:], strict=False))
    return head + meta(at) + boxed(b"mdat", b"\0" * gap + (b"" if method else body))


def test_heic():
    for method, version in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2)):
        for pieces in (1, 3):
            assert R.read("image/heif", heic(pieces, method, version)) == WANT == R.read("image/avif", heic(pieces, method, version))
    for damage in range(6, 40, 3):
        assert R.read("image/heif", heic(1, damage=damage)) == {}
    assert R.read("image/heif", heic(1, 2)) == {} and R.read("image/heif", heic(1)[: 3 << 20]) == {} and R.read("image/heif", boxed(b"meta", b"\0" * 4)) == {}
    raw = heic(2)
    src = R.Pages(io.BytesIO(raw))
    assert R.read("image/heif", src) == WANT and src.fetched < len(raw) // 20


def test_late_directories():
    """A directory behind the pixels is read by its place, as raw files of cameras have it; a far too wide one isn't."""
    block = tiff_block()
    late = b"II*\0" + struct.pack("<I", (3 << 20) + 8) + b"\1" * (3 << 20)
    # the same directories, with all offsets moved on
    moved = bytearray(block[8:])
    for at in (2 + 12 * i + 8 for i in range(4)):
        moved[at : at + 4] = struct.pack("<I", struct.unpack("<I", moved[at : at + 4])[0] + (3 << 20))
    for at in (2 + 48 + 4 + 2 + 12 * i + 8 for i in range(2)):
        moved[at : at + 4] = struct.pack("<I", struct.unpack("<I", moved[at : at + 4])[0] + (3 << 20))
    for mime in ("image/tiff", "image/x-canon-cr2"):
        src = R.Pages(io.BytesIO(late + bytes(moved)))
        assert R.read(mime, src) == WANT and src.fetched <= HEAD_PAGES
    wide = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 4)
    assert R.tiff(R.Pages(wide + b"\0" * 12, limit=4096)) == {}
    assert R.read("image/tiff", R.Pages(late + bytes(moved), limit=4096)) == {}


#: The head that XMP is looked for in is not read, as the dates are there; two pages hold the rest.
HEAD_PAGES = 3 * 4096


def test_movies_by_structure():
    """What looks like a date inside another element is none."""
    cluster = ebml("1f43b675", b"\x44\x61\x88" + struct.pack(">q", 5 * 10**17) + b"x" * 90_000)
    info = ebml("1549a966", ebml("2ad7b1", b"\x0f") + ebml("4461", DATE))
    head = ebml("1a45dfa3", ebml("4282", b"webm"))
    assert R.read("video/webm", head + ebml("18538067", cluster + info)) == {"qt_create_date": T}
    assert R.read("video/webm", head + ebml("18538067", cluster)) == {}
    # live recordings know no sizes: the seek table tells where the information is
    seek = lambda at: ebml("114d9b74", ebml("4dbb", ebml("53ab", bytes.fromhex("1549a966")) + ebml("53ac", struct.pack(">I", at))))
    open_cluster = ebml("1f43b675", b"\x44\x61\x88" + b"\1" * 9000, b"\xff")
    body = seek(len(seek(0)) + len(open_cluster)) + open_cluster + info
    assert R.read("video/x-matroska", head + ebml("18538067", body, b"\x01" + b"\xff" * 7)) == {"qt_create_date": T}
    assert R.read("video/x-matroska", head + ebml("18538067", open_cluster + info, b"\x01" + b"\xff" * 7)) == {} == R.read("video/webm", head[:3])

    names = [b"com.apple.quicktime.make", b"com.apple.quicktime.creationdate"]
    keys = boxed(b"keys", b"\0" * 4 + struct.pack(">I", 2) + b"".join(boxed(b"mdta", n) for n in names))
    value = lambda text: boxed(b"data", struct.pack(">II", 1, 0) + text)
    ilst = boxed(b"ilst", boxed(struct.pack(">I", 1), value(b"Apple")) + boxed(struct.pack(">I", 2), value(b"2017-02-14T12:30:00+0100")))
    for start in (b"", b"\0\0\0\0"):
        moov = boxed(b"moov", MVHD + boxed(b"meta", start + boxed(b"hdlr", b"\0" * 8) + keys + ilst))
        assert R.read("video/quicktime", boxed(b"mdat", b"mvhd" * 100_000) + moov) == {"qt_create_date": T + 3600}
    assert R.read("video/quicktime", boxed(b"moov", MVHD + boxed(b"meta", keys))) == {"qt_create_date": T}
    assert R.read("video/quicktime", boxed(b"moov", boxed(b"trak", MVHD))) == {} == R.read("video/mp4", boxed(b"mdat", MVHD))


def test_large_documents_are_read_in_part():
    core = "<a><dcterms:created>2017-02-14T10:30:00Z</dcterms:created></a>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("big.bin", b"x" * 20_000_000)
        z.writestr("docProps/core.xml", core)
    src = R.Pages(out)
    assert R.read(R._OOXML + "x", src) == {"doc_created": T} and src.fetched < 200_000
