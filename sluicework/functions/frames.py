"""Multi-frame zstd files with an index of their frames, so that several tasks can read one file.

A file is a run of independent zstd frames, each holding whole lines, followed by one skippable
frame (ignored by every standard zstd reader) that lists every data frame's offset and length, and
ends with the frame count and the tag ``SWIX``. A reader takes the last 8 bytes of a file: with the
tag it reads the index and gives each frame to whichever task; without it, the file is one piece.
"""

from __future__ import annotations

import struct

import zstandard

#: Uncompressed bytes of lines per frame.
FRAME_BYTES = 4 << 20
TAG = b"SWIX"
SKIPPABLE = 0x184D2A5E


class FrameWriter:
    """Lines in, independent frames out, the index written on ``close``."""

    def __init__(self, raw, header: bytes = b"", frame_bytes: int | None = None, level: int = 3):
        self.raw, self.frame_bytes = raw, frame_bytes or FRAME_BYTES
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.pending: list[bytes] = [header] if header else []
        self.size = len(header)
        self.at, self.index = 0, []

    def write(self, lines: bytes) -> None:
        self.pending.append(lines)
        self.size += len(lines)
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if not self.size:
            return
        frame = self.compressor.compress(b"".join(self.pending))
        self.raw.write(frame)
        self.index.append((self.at, len(frame)))
        self.at += len(frame)
        self.pending, self.size = [], 0

    def close(self) -> None:
        self._frame()
        body = b"".join(struct.pack("<QQ", o, n) for o, n in self.index) + struct.pack("<I", len(self.index)) + TAG
        self.raw.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


def frame_index(handle, size: int) -> list[tuple[int, int]] | None:
    """(offset, length) of every data frame of an indexed file; None for a file without index."""
    if size < 8:
        return None
    tail = handle.read_at(8, size - 8)
    if tail[4:] != TAG:
        return None
    count = struct.unpack("<I", tail[:4])[0]
    body = handle.read_at(16 * count, size - 8 - 16 * count)
    return [struct.unpack_from("<QQ", body, 16 * i) for i in range(count)]


def frame_lines(handle, offset: int, length: int) -> bytes:
    """The uncompressed bytes of one frame."""
    return zstandard.ZstdDecompressor().decompress(handle.read_at(length, offset))
