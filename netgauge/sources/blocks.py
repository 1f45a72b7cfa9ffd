"""Gzipped lines in blocks with an index of their own, so that a line is read without the lines of other blocks.

A file is a chain of gzip members. Each but the last holds whole lines and closes
at the first line beyond a number of bytes; the last holds no data and carries in
its header's extra field, for every block, the number of its first line and its
place in the file. To any reader of gzip the file is its lines. A reader of few
lines takes the end of the file, then only the blocks that its lines are in.
"""

from __future__ import annotations

import gzip
import io
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator

#: Bytes of lines after which a block is full.
BLOCK_BYTES = 256_000
#: A gzip header with an extra field, and the mark of the index in it.
HEADER, MARK = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff", b"NI"
#: An empty deflate stream with its checksum and length.
EMPTY = b"\x03\x00" + bytes(8)
#: Blocks that an extra field has room for.
MOST = 4000
#: Bytes from a file's end that are read at once; they hold the index of some 200 blocks.
TAIL = 4096


class BlockFile:
    """Writes lines to a binary stream in blocks; close() adds the index. Equal lines give equal bytes."""

    def __init__(self, raw: io.RawIOBase, block: int = BLOCK_BYTES):
        self.raw, self.block = raw, block
        self.held, self.size, self.lines, self.at = [], 0, 0, 0
        self.first, self.places = [], []

    def add(self, line: bytes) -> None:
        self.held.append(line)
        self.size += len(line) + 1
        # The last block that the index has room for takes all that is left.
        if self.size > self.block and len(self.places) < MOST - 1:
            self.flush()

    def flush(self) -> None:
        packed = gzip.compress(b"".join(x + b"\n" for x in self.held), mtime=0)
        self.raw.write(packed)
        self.first.append(self.lines)
        self.places.append(self.at)
        self.lines, self.at = self.lines + len(self.held), self.at + len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        n = len(self.places)
        data = struct.pack(f"<{2 * n}QI", *self.first, *self.places, n)
        extra = MARK + struct.pack("<H", len(data)) + data
        self.raw.write(HEADER + struct.pack("<H", len(extra)) + extra + EMPTY)
        self.raw.close()


def index_of(file: object, size: int) -> tuple[list[int], list[int], int] | None:
    """(first lines, places, where the last block ends), or None if the file has no index."""
    tail = file.read_at(min(size, TAIL), max(0, size - TAIL))
    if len(tail) < 30 or not tail.endswith(EMPTY):
        return None
    n = struct.unpack_from("<I", tail, len(tail) - 14)[0]
    data = 16 * n + 4
    whole = len(HEADER) + 2 + 4 + data + len(EMPTY)
    if n > MOST or whole > size:
        return None
    if whole > len(tail):
        tail = file.read_at(whole, size - whole)
    member = tail[len(tail) - whole :]
    if not member.startswith(HEADER + struct.pack("<H", data + 4) + MARK + struct.pack("<H", data)):
        return None
    values = struct.unpack_from(f"<{2 * n}Q", member, len(HEADER) + 6)
    return list(values[:n]), list(values[n:]), size - whole


def found_lines(file: object, wanted: Iterable[int]) -> Iterator[str | None]:
    """The lines of these numbers (0-based, ascending, repeats allowed) of an open pyarrow file; None where it has fewer lines.

    A file with an index gives a block at a time; one without is read through once.
    """
    size = file.size()
    index = index_of(file, size)
    if index is None:
        yield from scanned(file, wanted)
        return
    first, places, end = index
    at, lines = -1, []
    for n in wanted:
        i = bisect_right(first, n) - 1
        if i >= 0 and i != at:
            stop = places[i + 1] if i + 1 < len(places) else end
            at, lines = i, gzip.decompress(file.read_at(stop - places[i], places[i])).split(b"\n")[:-1]
        k = n - first[i] if i >= 0 else -1
        yield lines[k].decode() if 0 <= k < len(lines) else None


def scanned(file: object, wanted: Iterable[int]) -> Iterator[str | None]:
    file.seek(0)
    with gzip.GzipFile(fileobj=file) as lines:
        at, line = -1, b""
        for n in wanted:
            while at < n and (more := lines.readline()):
                at, line = at + 1, more
            yield line.removesuffix(b"\n").decode() if at == n else None
