"""Dates, make and model from containers. Each reader takes a file by random access (:class:`Pages`) or bytes and
gives what it finds; broken bytes give nothing rather than an error. Only the pages that hold structure are read, so a
directory behind the pixels or a movie box behind the data costs no more than one in front."""

from __future__ import annotations

import json
import plistlib
import re
import struct
import zipfile
from calendar import timegm
from contextlib import suppress
from datetime import UTC, datetime, timedelta, timezone

from shutterloom.sources.pages import Pages, TooMuch, box, boxes, elements, item_ranges, joined, number, pages_of

HEAD = 64 << 10
FIELDS = ("dto", "create_date", "modify_date", "qt_create_date", "gps_utc", "make", "model", "doc_created", "doc_modified")
SCHEMA = "dto bigint, create_date bigint, modify_date bigint, qt_create_date bigint, gps_utc bigint, make string, model string, doc_created bigint, doc_modified bigint"


def seconds(text: str | None, offset: int = 0, zone: str | None = None) -> int | None:
    """``YYYY:MM:DD HH:MM:SS`` in local time, or in a zone such as ``+08:00``; nothing unless positive."""
    m = re.fullmatch(r"([+-])(\d\d):(\d\d)|Z", (zone or "").strip("\0 "))
    if m:
        offset = (int(m[2]) * 3600 + int(m[3]) * 60) * (-1 if m[1] == "-" else 1) if m[1] else 0
    try:
        value = timegm(datetime.strptime((text or "").strip("\0 ")[:19], "%Y:%m:%d %H:%M:%S").timetuple()) - offset
    except ValueError:
        return None
    return value if value > 0 else None


def iso_seconds(text: str | None) -> int | None:
    """RFC 3339; without a zone it is UTC."""
    try:
        t = datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    value = int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp())
    return value if value > 0 else None


def tiff(raw, offset: int = 0, start: int = 0) -> dict:
    """Dates, make, model and GPS time of a TIFF block, whose offsets count from its start."""
    src = pages_of(raw)
    head = src.at(start, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(head[:4])
    if order is None or len(head) < 8:
        return {}
    return _directories(src, order, struct.unpack(order + "I", head[4:])[0], start, offset)


#: Tags read as text.
TEXT_TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "modify", 0x9003: "dto", 0x9004: "create", 0x9010: "modify_zone", 0x9011: "dto_zone", 0x9012: "create_zone"}


def _directories(src: Pages, order: str, first: int, base: int, offset: int) -> dict:
    """``base`` is where offset 0 would stand in the file."""
    found: dict = {}

    def entries(at: int):
        count = src.at(base + at, 2)
        if len(count) < 2:
            return
        for i in range(struct.unpack(order + "H", count)[0]):
            e = src.at(base + at + 2 + 12 * i, 12)
            if len(e) < 12:
                return
            yield struct.unpack(order + "HHI", e[:8]) + (e[8:],)

    def data(size: int, value: bytes) -> bytes:
        return value[:size] if size <= 4 else src.at(base + struct.unpack(order + "I", value)[0], min(size, 256))

    def rationals(value: bytes) -> list[int | None]:
        parts = struct.unpack(order + f"{len(value) // 8 * 2}I", value[: len(value) // 8 * 8])
        return [a // b if b else None for a, b in zip(parts[::2], parts[1::2], strict=True)]

    def directory(at: int, depth: int) -> None:
        gps: dict = {}
        for tag, kind, count, value in entries(at):
            if tag in TEXT_TAGS and kind == 2:
                found.setdefault(TEXT_TAGS[tag], data(count, value).split(b"\0")[0].decode("utf-8", "replace").strip())
            elif tag == 0x8769 and depth == 0:
                directory(struct.unpack(order + "I", value)[0], 1)
            elif tag == 0x8825 and depth == 0:
                for t, k, c, v in entries(struct.unpack(order + "I", value)[0]):
                    if t == 7 and k == 5:
                        gps["time"] = rationals(data(8 * c, v))
                    elif t == 29 and k == 2:
                        gps["date"] = data(c, v).split(b"\0")[0].decode("ascii", "replace")
        if len(gps.get("time") or []) == 3 and None not in gps["time"] and "date" in gps:
            found["gps"] = seconds("{} {:02d}:{:02d}:{:02d}".format(gps["date"], *gps["time"]))

    with suppress(TooMuch):  # what was found before counts
        directory(first, 0)
    at = lambda name: seconds(found.get(name), offset, found.get(f"{name}_zone"))
    out = {"dto": at("dto"), "create_date": at("create"), "modify_date": at("modify"), "gps_utc": found.get("gps")}
    out |= {k: found[k] for k in ("make", "model") if found.get(k)}
    return {k: v for k, v in out.items() if v}


#: Bytes of an EXIF block in a chunk or item of its own, at most.
BLOCK_BYTES = 1 << 20


def jpeg(raw, offset: int = 0) -> dict:
    """The EXIF block among the first 64 markers of the head."""
    at, head = 2, pages_of(raw).at(0, HEAD)
    for _ in range(64):
        if at + 4 > len(head) or head[at] != 0xFF:
            break
        marker, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        if marker == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            return tiff(head[at + 10 : at + 2 + size], offset)
        if marker == 0xDA:
            break
        at += 2 + size
    return {}


def png(raw, offset: int = 0) -> dict:
    """The eXIf chunk among the first 64, of 1 MiB at most."""
    src, at = pages_of(raw), 8
    for _ in range(64):
        head = src.at(at, 8)
        if len(head) < 8:
            break
        n, name = struct.unpack(">I4s", head)
        if name == b"eXIf":
            return tiff(src.at(at + 8, n), offset) if n <= BLOCK_BYTES else {}
        at += 12 + n
    return {}


def heif(raw, offset: int = 0) -> dict:
    """The Exif item of HEIC and AVIF, wherever its pieces stand: four bytes say how far on the TIFF block begins."""
    src = pages_of(raw)
    block = joined(src, item_ranges(src, b"Exif"), BLOCK_BYTES)
    return tiff(block, offset, 4 + struct.unpack(">I", block[:4])[0]) if len(block) > 4 else {}


def avi(raw, offset: int = 0) -> dict:
    """The camera's directory in hdrl, strl, strd, in the first MiB."""
    src = pages_of(raw)

    def chunks(at: int, end: int, depth: int = 0):
        for _ in range(16):
            head = src.at(at, 8)
            if at + 8 > end or len(head) < 8:
                return
            name, n = head[:4], struct.unpack("<I", head[4:])[0]
            if name == b"LIST" and depth < 4:
                yield from chunks(at + 12, min(at + 8 + n, end), depth + 1)
            else:
                yield name, at + 8
            at += 8 + n + n % 2

    if src.at(0, 4) != b"RIFF" or src.at(8, 4) != b"AVI ":
        return {}
    for name, at in chunks(12, min(src.size, 12 + (1 << 20))):
        if name == b"strd" and src.at(at, 4) == b"AVIF":
            return _directories(src, "<", 8, at, offset)
    return {}


def m2ts(raw, offset: int = 0) -> dict:
    """The recording time in the camera's unregistered user data."""
    raw, payload = pages_of(raw).at(0, 512 * 192), b""
    for k in range(min(512, len(raw) // 192)):
        packet = raw[192 * k + 4 : 192 * k + 192]
        if packet[0] == 0x47 and (packet[1] & 0x1F) << 8 | packet[2] == 0x1011 and packet[3] & 0x10:
            start = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
            payload += packet[start:]
        if len(payload) > 16 << 10:
            break
    payload = payload[: 16 << 10].replace(b"\0\0\x03", b"\0\0")
    at = payload.find(b"MDPM")
    if at < 0 or at + 5 > len(payload):
        return {}
    tags = {payload[i]: payload[i + 1 : i + 5] for i in range(at + 5, min(len(payload) - 4, at + 5 + 5 * payload[at + 4]), 5)}
    day, time = tags.get(0x18), tags.get(0x19)
    if not day or not time:
        return {}
    digits = "".join(f"{b:02x}" for b in (*day[1:4], *time))
    return {"qt_create_date": v} if (v := seconds(f"{digits[:4]}:{digits[4:6]}:{digits[6:8]} {digits[8:10]}:{digits[10:12]}:{digits[12:14]}", offset)) else {}


#: Fixed value: the key of QuickTime's metadata that has a time with its zone.
CREATION_KEY = b"com.apple.quicktime.creationdate"


def _keyed(src: Pages, moov: tuple[int, int], name: bytes) -> bytes | None:
    """Value of a key in the movie's metadata: keys are numbered by one table, values by another."""
    meta = box(src, *moov, b"meta")
    if meta is None:
        return None
    # QuickTime's box begins with its children, the ISO one with four bytes of version and flags
    start = meta[0] if src.at(meta[0] + 4, 4) in (b"hdlr", b"keys", b"ilst", b"free") else meta[0] + 4
    inside = {k: (a, b) for k, a, b in boxes(src, start, meta[1])}
    if b"keys" not in inside or b"ilst" not in inside:
        return None
    at, end = inside[b"keys"]
    at += 8
    names = [src.at(a, b - a) for k, a, b in boxes(src, at, end) if k == b"mdta"]
    if name not in names:
        return None
    index = struct.pack(">I", names.index(name) + 1)
    value = next(((a, b) for k, a, b in boxes(src, *inside[b"ilst"]) if k == index), None)
    data = box(src, *value, b"data") if value else None
    return src.at(data[0] + 8, min(data[1] - data[0] - 8, 256)) if data else None


def bmff(raw, offset: int = 0) -> dict:
    """Creation time of MP4 and MOV: QuickTime's key with a zone, or else the movie header in UTC since 1904."""
    src = pages_of(raw)
    moov = box(src, 0, src.size, b"moov")
    if moov is None:
        return {}
    if value := iso_seconds((_keyed(src, moov, CREATION_KEY) or b"").decode("utf-8", "replace")):
        return {"qt_create_date": value}
    header = box(src, *moov, b"mvhd")
    if header is None:
        return {}
    value = number(src, header[0] + 4, 8 if number(src, header[0], 1) == 1 else 4) - 2_082_844_800
    return {"qt_create_date": value} if value > 0 else {}


#: Names of Matroska elements.
SEGMENT, INFO, DATE_UTC, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x18538067, 0x1549A966, 0x4461, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC


def matroska(raw, offset: int = 0) -> dict:
    """The DateUTC element of the segment's information: nanoseconds since 2001. Where clusters without a size stand
    before it, the seek table tells its place."""
    src = pages_of(raw)
    segment = next(((a, b or src.size) for k, a, b in elements(src, 0, src.size) if k == SEGMENT), None)
    if segment is None:
        return {}
    info, told = None, None
    for kind, a, b in elements(src, *segment):
        if kind == INFO:
            info = a, b
            break
        if kind == SEEK_HEAD and b:
            for _, x, y in (e for e in elements(src, a, b) if e[0] == SEEK):
                entry = {k: src.at(p, q - p) for k, p, q in elements(src, x, y) if q}
                if entry.get(SEEK_ID) == INFO.to_bytes(4, "big"):
                    told = segment[0] + int.from_bytes(entry.get(SEEK_POSITION, b""), "big")
    if info is None and told:
        info = next(((a, b) for k, a, b in elements(src, told, segment[1]) if k == INFO), None)
    day = next((src.at(a, 8) for k, a, b in elements(src, info[0], info[1] or segment[1]) if k == DATE_UTC and b == a + 8), None) if info else None
    value = struct.unpack(">q", day)[0] // 1_000_000_000 + 978_307_200 if day else 0
    return {"qt_create_date": value} if value > 0 else {}


#: Fixed value: the date that an XMP sidecar is read for.
SIDECAR_DATES = ("photoshop:DateCreated",)


def xmp(raw, names: tuple[str, ...] = ("photoshop:DateCreated", "xmp:CreateDate")) -> dict[str, int]:
    """Dates in attributes of the XMP packet in the head; comments don't count."""
    head = pages_of(raw).at(0, HEAD)
    a, b = head.find(b"<x:xmpmeta"), head.find(b"</x:xmpmeta>")
    text = re.sub(r"(?s)<!--.*?-->", "", (head[a:b] if 0 <= a < b else head).decode("utf-8", "replace"))
    out = {}
    for name in names:
        for m in re.finditer(r"""[\s<]""" + name + r"""\s*=\s*["']([^"']*)["']""", text):
            if value := iso_seconds(m[1]):
                out[name] = value
                break
    return out


def _pdf_date(text: bytes | None) -> int | None:
    m = re.match(rb"D:(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:(Z)|([+-])(\d\d)'?(\d\d)?)?", text or b"")
    if not m:
        return None
    part = [int(x) if x else d for x, d in zip(m.groups()[:6], (0, 1, 1, 0, 0, 0), strict=True)]
    zone = timedelta(hours=int(m[9] or 0), minutes=int(m[10] or 0)) * (-1 if m[8] == b"-" else 1)
    try:
        value = int(datetime(*part, tzinfo=timezone(zone)).timestamp())
    except ValueError:
        return None
    return value if value > 0 else None


def _documents(created: int | None, modified: int | None) -> dict:
    return {k: v for k, v in (("doc_created", created), ("doc_modified", modified)) if v}


def pdf(raw, offset: int = 0) -> dict:
    head = pages_of(raw).at(0, HEAD)
    find = lambda key: _pdf_date(m[1]) if (m := re.search(key + rb"\s*\(([^)]*)\)", head)) else None
    return _documents(find(rb"/CreationDate"), find(rb"/ModDate"))


def _member(raw, name: str) -> str:
    """A member of an archive, read by way of the archive's directory at its end."""
    with zipfile.ZipFile(pages_of(raw)) as z, z.open(name) as f:
        return f.read(HEAD).decode("utf-8", "replace")


def _element(text: str, name: str) -> str | None:
    m = re.search(rf"<{name}(?:\s[^>]*)?>([^<]*)</{name}>", text)
    return m[1] if m else None


def ooxml(raw, offset: int = 0) -> dict:
    text = _member(raw, "docProps/core.xml")
    return _documents(iso_seconds(_element(text, "dcterms:created")), iso_seconds(_element(text, "dcterms:modified")))


def odf(raw, offset: int = 0) -> dict:
    text = _member(raw, "meta.xml")
    return _documents(iso_seconds(_element(text, "meta:creation-date")), iso_seconds(_element(text, "dc:date")))


def iwork(raw, offset: int = 0) -> dict:
    with zipfile.ZipFile(pages_of(raw)) as z, z.open("Metadata/Properties.plist") as f:
        values = plistlib.loads(f.read(HEAD))
    at = lambda k: timegm(values[k].timetuple()) if isinstance(values.get(k), datetime) else None
    return _documents(at("createdDate"), at("modifiedDate"))


def epub(raw, offset: int = 0) -> dict:
    m = re.search(r'full-path="([^"]+)"', _member(raw, "META-INF/container.xml"))
    text = _member(raw, m[1]) if m else ""
    changed = re.search(r'property="dcterms:modified"[^>]*>([^<]*)<', text)
    return _documents(iso_seconds(_element(text, "dc:date")), iso_seconds(changed[1]) if changed else None)


def xmind(raw, offset: int = 0) -> dict:
    values = json.loads(_member(raw, "metadata.json"))
    at = lambda k: int(values[k]) // 1000 if isinstance(values.get(k), int) and values[k] >= 86_400_000 else None
    return _documents(at("created"), at("modified"))


def freemind(raw, offset: int = 0) -> dict:
    node = re.search(rb"<node\b[^>]*>", pages_of(raw).at(0, HEAD))
    at = lambda k: int(m[1]) // 1000 if node and (m := re.search(k + rb'="(\d+)"', node[0])) and int(m[1]) >= 86_400_000 else None
    return _documents(at(rb"CREATED"), at(rb"MODIFIED"))


def rtf(raw, offset: int = 0) -> dict:
    head = pages_of(raw).at(0, HEAD)

    def group(name: bytes) -> int | None:
        m = re.search(rb"\{\\" + name + rb"([^{}]*)\}", head)
        value = lambda k, d: int(x[1]) if (x := re.search(rb"\\" + k + rb"(\d+)", m[1])) else d
        if not m or not value(b"yr", 0):
            return None
        try:
            return timegm(datetime(value(b"yr", 0), value(b"mo", 1), value(b"dy", 1), value(b"hr", 0), value(b"min", 0), value(b"sec", 0)).timetuple())
        except ValueError:
            return None

    return _documents(group(b"creatim"), group(b"revtim"))


def cfb(raw, offset: int = 0) -> dict:
    """Times 12 and 13 of the summary property set in an OLE compound file."""
    src = pages_of(raw)
    raw = src.at(0, 512)
    if raw[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return {}
    size = 1 << struct.unpack("<H", raw[30:32])[0]
    sector = lambda i: src.at((i + 1) * size, size)
    def table_of(sectors) -> list[int]:
        return [x for s in sectors for x in struct.unpack(f"<{len(sector(s)) // 4}I", sector(s))]

    # the table of sectors is listed in the head, and in a chain of sectors for large files
    listed, more = [*struct.unpack("<109I", raw[76:512])], struct.unpack("<I", raw[68:72])[0]
    for _ in range(min(struct.unpack("<I", raw[72:76])[0], BLOCK_BYTES // size)):
        if more >= 0xFFFFFFF0:
            break
        *rest, more = table_of([more])
        listed += rest
    fat = table_of(s for s in listed if s < 0xFFFFFFF0)

    def chain(i: int, table: list[int]) -> list[int]:
        out: list[int] = []
        while i < len(table) and len(out) < 1 << 16:
            out.append(i)
            i = table[i]
        return out

    folder = b"".join(map(sector, chain(struct.unpack("<I", raw[48:52])[0], fat)))
    items = [folder[i : i + 128] for i in range(0, len(folder), 128)]
    root = items[0]
    small = chain(struct.unpack("<I", root[116:120])[0], fat)
    small_fat = table_of(chain(struct.unpack("<I", raw[60:64])[0], fat))
    piece = lambda i: src.at((small[64 * i // size] + 1) * size + 64 * i % size, 64)
    for item in items:
        n = struct.unpack("<H", item[64:66])[0]
        if item[: max(0, n - 2)].decode("utf-16-le", "replace") == "\x05SummaryInformation":
            first, length = struct.unpack("<II", item[116:124])
            data = b"".join(map(sector, chain(first, fat))) if length >= 4096 else b"".join(map(piece, chain(first, small_fat)))
            return _properties(data[:length])
    return {}


def _properties(data: bytes) -> dict:
    at = struct.unpack("<I", data[44:48])[0]
    count, out = struct.unpack("<I", data[at + 4 : at + 8])[0], {}
    for i in range(min(count, 256)):
        key, where = struct.unpack("<II", data[at + 8 + 8 * i : at + 16 + 8 * i])
        if key in (12, 13) and struct.unpack("<I", data[at + where : at + where + 4])[0] == 64:
            value = struct.unpack("<Q", data[at + where + 4 : at + where + 12])[0] // 10_000_000 - 11_644_473_600
            if value > 0:
                out["doc_created" if key == 12 else "doc_modified"] = value
    return out


_OOXML, _ODF = "application/vnd.openxmlformats-officedocument.", "application/vnd.oasis.opendocument."
#: Readers by the beginning of the media type, the first that fits.
READERS = (
    ("image/png", png),
    ("image/jpeg", jpeg),
    ("image/heif", heif),
    ("image/avif", heif),
    ("image/", tiff),
    ("video/x-msvideo", avi),
    ("video/m2ts", m2ts),
    ("video/x-matroska", matroska),
    ("video/webm", matroska),
    ("video/", bmff),
    ("application/pdf", pdf),
    (_OOXML, ooxml),
    (_ODF, odf),
    ("application/vnd.apple.", iwork),
    ("application/x-iwork-", iwork),
    ("application/epub+zip", epub),
    ("application/vnd.xmind.workbook", xmind),
    ("application/x-xmind", xmind),
    ("application/x-freemind", freemind),
    ("application/rtf", rtf),
    ("text/rtf", rtf),
    ("application/msword", cfb),
    ("application/vnd.ms-", cfb),
)


def read(mime: str, raw, offset: int = 0) -> dict:
    """Fields of a file by its media type; images without dates fall back to their XMP packet. A file is given by
    random access, or as bytes."""
    raw = pages_of(raw)
    for start, reader in READERS:
        if mime.startswith(start):
            try:
                out = reader(raw, offset=offset)
            except Exception:  # noqa: BLE001  broken bytes are missing fields
                out = {}
            if mime.startswith("image/") and not out.get("dto") and not out.get("create_date"):
                raw.limit += HEAD
                found = xmp(raw)
                out |= {k: found[n] for k, n in (("dto", "photoshop:DateCreated"), ("create_date", "xmp:CreateDate")) if n in found}
            return out
    return {}


def takeout_seconds(text: str) -> int | None:
    """photoTakenTime.timestamp of a sidecar, as a number or a string."""
    try:
        value = int(json.loads(text)["photoTakenTime"]["timestamp"])
    except (ValueError, KeyError, TypeError):
        return None
    return value if value > 0 else None
