"""Files of independent zstandard frames with a trailing seek table.

Layout, after the public seekable format: frames (each with its own content checksum), then a skippable frame that
holds the application's index, then the seek table, also a skippable frame: per frame its compressed size, its size
and the low 32 bits of the XXH64 of its content, then the number of frames, a descriptor byte and a magic number.
A plain zstandard reader skips both skippable frames and reads the frames one after the other.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow.fs as pafs
import xxhash
import zstandard

# Fixed values of the public format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
TABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER = 9
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file under a temporary name and moves it to its own when closed, so a retried task replaces it whole."""

    def __init__(self, uri: str, level: int = 3):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []

    def frame(self, content: bytes) -> int:
        """Append a frame; its number."""
        packed = self.pack.compress(content)
        self.out.write(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        return len(self.entries) - 1

    def close(self, index: bytes) -> None:
        packed = self.pack.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed) + 4) + packed + struct.pack("<I", len(packed)))
        table = np.array(self.entries, ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUMS, TABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Reads the tables of a file, then only the frames that are asked for, each checked against its checksum."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(FOOTER, end - FOOTER))
        if magic != TABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        size = count * ENTRY.itemsize
        start = end - FOOTER - size - 8
        self.entries = np.frombuffer(self.file.read_at(size, start + 8), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()
        (packed,) = struct.unpack("<I", self.file.read_at(4, start - 4))
        self.index = self.unpack.decompress(self.file.read_at(packed, start - 4 - packed))

    def frame(self, number: int) -> bytes:
        entry = self.entries[number]
        content = self.unpack.decompress(self.file.read_at(int(entry["packed"]), int(self.starts[number])), max_output_size=int(entry["size"])) if entry["size"] else b""
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != entry["checksum"]:
            raise ValueError(f"frame {number}: checksum differs")
        return content

    def frames(self, most: int = 8 << 20):
        """All frames in order, read in stretches of about `most` bytes."""
        at, total = 0, len(self.entries)
        sizes, checksums, starts = self.entries["size"].tolist(), self.entries["checksum"].tolist(), self.starts.tolist()
        while at < total:
            stop = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + most, "right")) - 1)
            stop = min(stop, total)
            held = memoryview(self.file.read_at(int(self.starts[stop] - self.starts[at]), int(self.starts[at])))
            for k in range(at, stop):
                content = self.unpack.decompress(held[starts[k] - starts[at] : starts[k + 1] - starts[at]]) if sizes[k] else b""
                if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksums[k]:
                    raise ValueError(f"frame {k}: checksum differs")
                yield content
            at = stop

    def close(self) -> None:
        self.file.close()
