"""Files of independent zstandard frames with a trailing seek table.

The layout is the public seekable format: data frames, here one skippable
frame with an index of the items, then a skippable frame with the seek table
(compressed size, plain size, checksum of the plain bytes for each frame) and
its footer. A plain zstandard decoder reads the data and skips the rest. The
index maps each item's key to its frame, its offset within the frame and its
length, so a reader decompresses only the frames it asks for.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard

from .common import open_bytes, put_bytes

# Fixed values of the public format.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEK_FOOTER_MAGIC = 0x8F92EAB1
INDEX_MAGIC = 0x184D2A50
CHECKSUM_FLAG = 0x80

ITEM = np.dtype([("key", "<i8"), ("has_key", "<u1"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u8")])


def _checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def write_items(uri: str, items: Iterable[tuple[int | None, bytes]], frame_bytes: int = 256 << 10, level: int = 3) -> tuple[int, int]:
    """Write items as frames of about ``frame_bytes``; a longer item is a frame alone. Returns item and byte counts."""
    index: list[tuple] = []

    def chunks() -> Iterator[bytes]:
        table: list[tuple[int, int, int]] = []
        squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        held = io.BytesIO()

        def frame() -> bytes:
            plain = held.getvalue()
            packed = squeeze.compress(plain)
            table.append((len(packed), len(plain), _checksum(plain)))
            held.seek(0)
            held.truncate()
            return packed

        for key, body in items:
            if held.tell() and held.tell() + len(body) > frame_bytes:
                yield frame()
            index.append((key or 0, key is not None, len(table), held.tell(), len(body)))
            held.write(body)
        if held.tell():
            yield frame()
        packed = squeeze.compress(np.array(index, dtype=ITEM).tobytes())
        table.append((len(packed) + 8, 0, _checksum(b"")))
        yield struct.pack("<II", INDEX_MAGIC, len(packed)) + packed
        rows = b"".join(struct.pack("<III", *row) for row in table)
        yield struct.pack("<II", SEEK_TABLE_MAGIC, len(rows) + 9) + rows + struct.pack("<IBI", len(table), CHECKSUM_FLAG, SEEK_FOOTER_MAGIC)

    size = put_bytes(uri, chunks())
    return len(index), size


class SeekableReader:
    """Random access to a file of ``write_items``. Reads only its footer, table and index at first."""

    def __init__(self, uri: str):
        self.source = open_bytes(uri)
        self.source.seek(0, io.SEEK_END)
        end = self.source.tell()
        self.source.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", self.source.read(9))
        if magic != SEEK_FOOTER_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{uri}: no seek table with checksums at its end")
        self.source.seek(end - 9 - 12 * count)
        self.table = np.frombuffer(self.source.read(12 * count), "<u4").reshape(-1, 3)
        self.starts = np.zeros(count + 1, np.int64)
        np.cumsum(self.table[:, 0], out=self.starts[1:])
        self.unpack = zstandard.ZstdDecompressor()
        self.source.seek(self.starts[-2] + 8)
        self.index = np.frombuffer(self.unpack.decompress(self.source.read(int(self.table[-1, 0]) - 8)), ITEM)
        self.n_frames = count - 1
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        """Frame k, checked."""
        self.source.seek(int(self.starts[k]))
        plain = self.unpack.decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        self.frames_read += 1
        if len(plain) != self.table[k, 1] or _checksum(plain) != self.table[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return plain

    def items(self) -> Iterator[tuple[int | None, bytes]]:
        """All items in file order; one frame is held at a time."""
        now, plain = -1, b""
        for entry in self.index:
            if entry["frame"] != now:
                now = int(entry["frame"])
                plain = self.frame(now)
            at = int(entry["offset"])
            yield (int(entry["key"]) if entry["has_key"] else None), plain[at : at + int(entry["length"])]

    def get(self, key: int) -> list[bytes]:
        """The items with a key, from their own frames only."""
        out = []
        for entry in self.index[(self.index["key"] == key) & (self.index["has_key"] == 1)]:
            at = int(entry["offset"])
            out.append(self.frame(int(entry["frame"]))[at : at + int(entry["length"])])
        return out

    def close(self) -> None:
        self.source.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
