"""Media types from first bytes and from names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OOXML = "application/vnd.openxmlformats-officedocument."
_ODF = "application/vnd.oasis.opendocument."
#: Media type by extension.
BY_EXTENSION = {
    "pdf": "application/pdf",
    "docx": _OOXML + "wordprocessingml.document",
    "pptx": _OOXML + "presentationml.presentation",
    "xlsx": _OOXML + "spreadsheetml.sheet",
    "doc": "application/msword",
    "ppt": "application/vnd.ms-powerpoint",
    "xls": "application/vnd.ms-excel",
    "pages": "application/vnd.apple.pages",
    "numbers": "application/vnd.apple.numbers",
    "key": "application/vnd.apple.keynote",
    "odt": _ODF + "text",
    "ods": _ODF + "spreadsheet",
    "odp": _ODF + "presentation",
    "odg": _ODF + "graphics",
    "rtf": "application/rtf",
    "epub": "application/epub+zip",
    "xmind": "application/vnd.xmind.workbook",
    "mm": "application/x-freemind",
    "mindnode": "application/x-mindnode",
    "itmz": "application/x-itmz",
    "mmap": "application/x-mindmanager",
    "txt": "text/plain",
    "log": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "rst": "text/x-rst",
    "csv": "text/csv",
    "tsv": "text/tab-separated-values",
}
#: Brands of ISO media files after ``ftyp``, by media type.
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1")
MOVIE_BRANDS = {
    "image/avif": ("avif", "avis"),
    "video/mp4": ("isom", "iso2", "iso3", "iso4", "iso5", "iso6", "avc1", "mp41", "mp42", "mmp4", "dash", "MSNV", "NDSC", "NDSH", "NDSM", "NDSP", "NDSS", "NDXC", "NDXH", "NDXM", "NDXP", "NDXS", "F4V ", "F4P "),
    "video/x-m4v": ("M4V ", "M4VH", "M4VP"),
}
#: First bytes of formats, as (offset, hex) pairs that must all hold; the first entry that
#: fits wins.
BY_MAGIC = (
    ("image/jpeg", ((0, "FFD8FF"),)),
    ("image/png", ((0, "89504E47"),)),
    ("image/gif", ((0, "474946"),)),
    ("image/webp", ((8, "57454250"),)),
    ("image/x-canon-cr2", ((0, "49492A00"), (8, "4352"))),
    ("image/tiff", ((0, "49492A00"),)),
    ("image/tiff", ((0, "4D4D002A"),)),
    ("image/bmp", ((0, "424D"),)),
    *(("image/heif", ((4, "66747970"), (8, brand.encode().hex().upper()))) for brand in HEIF_BRANDS),
    *((mime, ((4, "66747970"), (8, brand.encode().hex().upper()))) for mime, brands in MOVIE_BRANDS.items() for brand in brands),
    ("video/quicktime", ((4, "66747970"), (8, "71742020"))),
    ("video/x-matroska", ((0, "1A45DFA3"),)),
    ("video/x-msvideo", ((0, "52494646"), (8, "41564920"))),
    ("video/x-ms-wmv", ((0, "3026B2758E66CF11A6D9"),)),
    ("video/x-flv", ((0, "464C5601"),)),
    ("video/mpeg", ((0, "000001BA"),)),
    ("video/mpeg", ((0, "000001B3"),)),
    ("image/vnd.adobe.photoshop", ((0, "38425053"),)),
    ("image/vnd.microsoft.icon", ((0, "00000100"),)),
    ("image/vnd.ms-photo", ((0, "4949BC"),)),
    ("image/jxl", ((0, "FF0A"),)),
    ("application/pdf", ((0, "25504446"),)),
    ("application/zip", ((0, "504B0304"),)),
    ("application/rtf", ((0, "7B5C727466"),)),
    ("video/quicktime", ((4, "706E6F74"),)),
    ("video/quicktime", ((4, "6D646174"),)),
    ("video/m2ts", ((4, "47"), (196, "47"))),
    ("video/3gpp", ((4, "66747970"), (8, "336770"))),
)


def sniffed(content: Column) -> Column:
    """Media type by the first bytes; empty if none fits."""
    out = None
    for mime, parts in BY_MAGIC:
        ok = F.lit(True)
        for at, want in parts:
            ok = ok & (F.hex(F.substring(content, at + 1, len(want) // 2)) == want)
        out = F.when(ok, mime) if out is None else out.when(ok, mime)
    return out.otherwise("")


def from_extension(ext: Column) -> Column:
    """Media type by extension, in either case; null if unknown."""
    table = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    return F.try_element_at(table, F.lower(ext))


def mime_of(content: Column, ext: Column) -> Column:
    """Sniffed type; the extension's for nothing or a plain zip."""
    found = sniffed(content)
    return F.when(found.isin("", "application/zip"), F.coalesce(from_extension(ext), found)).otherwise(found)


def is_office(mime: Column) -> Column:
    exact = [m for m in BY_EXTENSION.values() if not m.startswith((_OOXML, _ODF, "application/pdf"))]
    return mime.startswith("application/pdf") | mime.startswith(_OOXML) | mime.startswith(_ODF) | mime.startswith("application/x-iwork-") | mime.isin(*exact, "text/rtf", "application/x-xmind")


def is_media(mime: Column) -> Column:
    """Images and videos, but for FlashPix."""
    return mime.rlike("^(image|video)/") & ~mime.rlike(r"\.fpx")


def is_image(mime: Column) -> Column:
    return mime.startswith("image/")


def is_matroska(mime: Column) -> Column:
    return mime.startswith("video/x-matroska") | mime.startswith("video/webm")
