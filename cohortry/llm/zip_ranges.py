"""Reading stored members of a ZIP file by byte ranges: end record, ZIP64 records, central directory, local headers."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int  # 0: stored
    size: int
    stored_size: int
    header_at: int


class ZipRanges:
    """The directory of a ZIP file. fetch(start, length) reads a range; nothing is extracted."""

    def __init__(self, fetch: Callable[[int, int], bytes], total: int):
        self.fetch = fetch
        tail_at = max(0, total - 65_557)
        tail = fetch(tail_at, total - tail_at)
        at = self._end_record(tail)
        if at < 0:
            raise ValueError("no end-of-central-directory record")
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        if FULL16 == count or FULL32 in (size, start):
            count, size, start = self._zip64(tail, at, tail_at)
        self.members = {m.name: m for m in self._directory(fetch(start, size), count)}

    @staticmethod
    def _end_record(tail: bytes) -> int:
        """The last signature whose comment ends the file."""
        at = len(tail)
        while (at := tail.rfind(END, 0, at)) >= 0:
            if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                return at
        return -1

    def _zip64(self, tail: bytes, at: int, tail_at: int) -> tuple[int, int, int]:
        locator = tail[at - 20 : at] if at >= 20 else self.fetch(tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("the end record is full, and no ZIP64 locator precedes it")
        record = self.fetch(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record where its locator points")
        return struct.unpack_from("<QQQ", record, 32)

    @staticmethod
    def _directory(data: bytes, count: int):
        at = 0
        for _ in range(count):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("a central directory entry is damaged")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            stored_size, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
            header_at = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name]
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            wide = ZipRanges._extra64(extra)
            if size == FULL32:
                size, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            if stored_size == FULL32:
                stored_size, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            if header_at == FULL32:
                header_at = struct.unpack_from("<Q", wide)[0]
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, size, stored_size, header_at)
            at += 46 + n_name + n_extra + n_comment

    @staticmethod
    def _extra64(extra: bytes) -> bytes:
        """The field of type 1, which has what the 32-bit fields cannot hold, in their order."""
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                return extra[4 : 4 + n]
            extra = extra[4 + n :]
        return b""

    def begin(self, name: str) -> int:
        """Where a stored member's bytes begin: behind its local header."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed within the ZIP; only stored members can be read by range")
        header = self.fetch(member.header_at, 30)
        if header[:4] != LOCAL:
            raise ValueError(f"{name} has no local header where the directory points")
        return member.header_at + 30 + sum(struct.unpack_from("<HH", header, 26))

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        size = self.members[name].size
        return self.fetch(self.begin(name) + start, min(size - start, size if length is None else length))
