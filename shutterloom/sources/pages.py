"""Random access to files in cached pages, and the box structures that are walked through it."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

PAGE = 4096
#: Bytes that are read of a file for its fields, at most.
READ_BYTES = 8 << 20
#: Boxes or elements of one level that are looked at, at most.
BOXES = 4096


class TooMuch(ValueError):
    """The fields of a file lie too far apart."""


class Pages(io.RawIOBase):
    """An open file, or bytes, of which only the pages asked for are read, each once; ``fetched`` counts the bytes."""

    def __init__(self, source, limit: int = READ_BYTES):
        self.source = io.BytesIO(source) if isinstance(source, bytes | bytearray) else source
        self.size, self.limit = self.source.seek(0, io.SEEK_END), limit
        self.held: dict[int, bytes] = {}
        self.fetched, self.place = 0, 0

    def at(self, offset: int, n: int) -> bytes:
        """Bytes from an offset; fewer at the end, none outside."""
        end = min(offset + n, self.size)
        if offset < 0 or offset >= end:
            return b""
        first, last = offset // PAGE, (end - 1) // PAGE
        i = first
        while i <= last:
            if i in self.held:
                i += 1
                continue
            run = i
            while run <= last and run not in self.held:
                run += 1
            if self.fetched + (run - i) * PAGE > self.limit:
                raise TooMuch(f"over {self.limit} bytes")
            self.source.seek(i * PAGE)
            data = self.source.read((run - i) * PAGE)
            self.fetched += len(data)
            self.held.update((i + k, data[k * PAGE : (k + 1) * PAGE]) for k in range(run - i))
            i = run
        return b"".join(self.held[i] for i in range(first, last + 1))[offset - first * PAGE :][: end - offset]

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.place = max(0, offset + (self.place if whence == io.SEEK_CUR else self.size if whence == io.SEEK_END else 0))
        return self.place

    def tell(self) -> int:
        return self.place

    def readinto(self, buffer) -> int:
        data = self.at(self.place, len(buffer))
        buffer[: len(data)] = data
        self.place += len(data)
        return len(data)


def pages_of(source) -> Pages:
    return source if isinstance(source, Pages) else Pages(source)


def boxes(src: Pages, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the bodies of ISO media boxes; a size that leaves its parent ends the walk."""
    for _ in range(BOXES):
        head = src.at(start, 16)
        if start + 8 > end or len(head) < 8:
            return
        size, kind = struct.unpack(">I4s", head[:8])
        body = start + 8
        if size == 1 and len(head) == 16:
            (size,), body = struct.unpack(">Q", head[8:]), start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def box(src: Pages, start: int, end: int, *path: bytes) -> tuple[int, int] | None:
    """Body of the first box along a path of kinds."""
    for kind in path:
        found = next(((a, b) for k, a, b in boxes(src, start, end) if k == kind), None)
        if found is None:
            return None
        start, end = found
    return start, end


def number(src: Pages, at: int, n: int) -> int:
    """Big-endian number of n bytes; 0 for none."""
    raw = src.at(at, n)
    if len(raw) < n:
        raise ValueError("cut off")
    return int.from_bytes(raw, "big")


def item_ranges(src: Pages, kind: bytes) -> list[tuple[int, int]]:
    """(start, length) of the pieces of the first item of a kind, by the item tables of an ISO image file. Items in
    other files, and those placed inside other items, give none."""
    meta = box(src, 0, src.size, b"meta")
    if meta is None:
        return []
    inside = {k: (a, b) for k, a, b in boxes(src, meta[0] + 4, meta[1])}
    if b"iinf" not in inside or b"iloc" not in inside:
        return []
    a, b = inside[b"iinf"]
    item = None
    for k, x, y in boxes(src, a + (6 if number(src, a, 1) == 0 else 8), b):
        version = number(src, x, 1)
        wide = 4 if version >= 3 else 2
        if k == b"infe" and version >= 2 and x + 10 + wide - 2 <= y and src.at(x + 4 + wide + 2, 4) == kind:
            item = number(src, x + 4, wide)
            break
    return _located(src, *inside[b"iloc"], item, inside.get(b"idat")) if item is not None else []


def _located(src: Pages, at: int, end: int, item: int, idat: tuple[int, int] | None) -> list[tuple[int, int]]:
    version, sizes = number(src, at, 1), number(src, at + 4, 2)
    offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, (sizes & 15) if version in (1, 2) else 0
    wide = 4 if version == 2 else 2
    at += 6

    def take(n: int) -> int:
        nonlocal at
        if at + n > end:
            raise ValueError("the table is cut off")
        at += n
        return number(src, at - n, n) if n else 0

    for _ in range(min(take(wide), BOXES)):
        this = take(wide)
        method = take(2) & 15 if version in (1, 2) else 0
        outside, base = take(2), take(base_size)
        pieces = []
        for _ in range(take(2)):
            take(index_size)
            pieces.append((base + take(offset_size), take(length_size)))
        if this == item:
            if outside or method > 1 or method == 1 and idat is None:
                return []
            low, high = idat if method == 1 else (0, src.size)
            pieces = [(low + o, n or high - low - o) for o, n in pieces]
            return pieces if all(low <= o and o + n <= high for o, n in pieces) else []
    return []


def joined(src: Pages, pieces: list[tuple[int, int]], most: int) -> bytes:
    """The bytes of all pieces, unless there are more."""
    if sum(n for _, n in pieces) > most:
        return b""
    return b"".join(src.at(o, n) for o, n in pieces)


def _vint(src: Pages, at: int, marker: bool) -> tuple[int | None, int]:
    """Number of variable length, with its length marker or without, and where it ends; none if all ones."""
    first = number(src, at, 1)
    n = 9 - first.bit_length()
    if n > 8:
        raise ValueError("not a number")
    value = number(src, at, n)
    if not marker:
        value &= (1 << 7 * n) - 1
        return (None if value == (1 << 7 * n) - 1 else value), at + n
    return value, at + n


def elements(src: Pages, start: int, end: int) -> Iterator[tuple[int, int, int | None]]:
    """(id, start, end) of the bodies of EBML elements; the end is none, and the walk over, if the size isn't known."""
    for _ in range(BOXES):
        if start >= end:
            return
        name, at = _vint(src, start, True)
        size, body = _vint(src, at, False)
        if size is None:
            yield name, body, None
            return
        if body + size > end:
            return
        yield name, body, body + size
        start = body + size
