"""Block-compressed files: gzip members of at most 64 KB of data, each of which says how long it is.

A place in such a file is a virtual offset: the byte at which a block begins, shifted by 16 bits, plus the place within the
block's data.  So a reader can begin at any record without what lies before.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

#: Data in a block: it must fit into 64 KB even if it does not compress.
BLOCK = 0xFF00
# gzip's header with one extra field BC of two bytes, and the empty block that ends a file.
_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class Writer:
    def __init__(self, out: BinaryIO):
        self.out, self.at, self.held = out, 0, bytearray()

    def tell(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        """Adds data; a piece that fits into one block is not divided among two."""
        if self.held and len(self.held) + len(data) > BLOCK:
            self.flush()
        self.held += data
        while len(self.held) > BLOCK:
            self._put(BLOCK)

    def write_pieces(self, data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the pieces between the offsets, as `write` does each; returns where each begins and ends."""
        n, i = len(offsets) - 1, 0
        at, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        while i < n:
            # so many more go into the current block
            j = int(np.searchsorted(offsets, offsets[i] + BLOCK - len(self.held), "right")) - 1
            if j <= i and self.held:
                self.flush()
                continue
            j = max(j, i + 1)
            at[i:j] = self.tell() + offsets[i:j] - offsets[i]
            after[i:j] = self.tell() + offsets[i + 1 : j + 1] - offsets[i]
            self.write(data[offsets[i] : offsets[j]])
            if j == i + 1:
                after[i] = self.tell()  # it may be longer than a block
            i = j
        return at, after

    def flush(self) -> None:
        """Ends the current block."""
        while self.held:
            self._put(BLOCK)

    def _put(self, size: int) -> None:
        data, self.held = bytes(self.held[:size]), self.held[size:]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(data) + deflate.flush()
        block = _HEAD + struct.pack("<H", len(_HEAD) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))
        self.out.write(block)
        self.at += len(block)

    def close(self) -> None:
        self.flush()
        self.out.write(END)
        self.out.close()


class Reader:
    """Reads on from a virtual offset; `blocks` counts the blocks that were decompressed."""

    def __init__(self, file: BinaryIO, offset: int = 0):
        self.file, self.blocks = file, 0
        self.start, self.next, self.data, self.within = 0, offset >> 16, b"", 0
        if offset & 0xFFFF:
            self._load()
            self.within = offset & 0xFFFF

    def tell(self) -> int:
        """Where the next byte is; at the end of a block that is the next block's beginning."""
        return self.next << 16 if self.within >= len(self.data) else self.start << 16 | self.within

    def _load(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(12)
        if len(head) < 12:
            return False
        if head[:4] != _HEAD[:4]:
            raise ValueError(f"no block begins at byte {self.next}")
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
        at, size = 0, None
        while at + 4 <= len(extra):
            length = struct.unpack_from("<H", extra, at + 2)[0]
            if extra[at : at + 2] == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + length
        if size is None:
            raise ValueError(f"the block at byte {self.next} does not say how long it is")
        rest = self.file.read(size - 12 - len(extra))
        data = zlib.decompress(rest[:-8], -15)
        if struct.unpack("<II", rest[-8:]) != (zlib.crc32(data), len(data)):
            raise ValueError(f"the block at byte {self.next} is damaged")
        self.start, self.next, self.data, self.within = self.next, self.next + size, data, 0
        self.blocks += 1
        return True

    def read(self, size: int) -> bytes:
        """So many bytes, or fewer at the end of the file."""
        out = bytearray()
        while len(out) < size:
            if self.within >= len(self.data) and not self._load():
                break
            part = self.data[self.within : self.within + size - len(out)]
            out += part
            self.within += len(part)
        return bytes(out)


def members(file: BinaryIO) -> Iterator[int]:
    """Where the file's blocks begin."""
    reader = Reader(file)
    while reader._load():
        yield reader.start
