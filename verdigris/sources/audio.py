"""Audio headers as a table: sample rate and length of files from bounded byte ranges, never whole files.

``spark.read.format("audio_headers").load(path)`` after ``spark.dataSource.register(AudioHeaders)``. The driver lists names
and sizes and cuts the list into partitions of ``filesPerPartition``; tasks read at most ``HEAD`` bytes from a file's
start, a few boxes of eight bytes in between, and ``TAIL`` bytes from its end. What can't be read counts as 16 kHz and no
length; the format is the name's ending. Paths are those of pyarrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD, TAIL = 65_536, 65_536
#: Boxes and chunks that are looked at before a file counts as unreadable.
MOST_STEPS = 256
DEFAULT_RATE = 16_000
DDL = "file_path string, format string, sample_rate int, duration_seconds double"

#: Reads ``size`` bytes at ``offset``; fewer at the end of the file.
Read = Callable[[int, int], bytes]


def riff(read: Read, size: int) -> tuple[int, float] | None:
    """WAVE: chunks are skipped by their sizes; the data's length over the bytes of a second. A length of 2^32 - 1 or 0 goes to the end."""
    head = read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, rate, per_second = 12, 0, 0
    for _ in range(MOST_STEPS):
        chunk = read(at, 24)
        if len(chunk) < 8:
            return None
        kind, length = chunk[:4], struct.unpack("<I", chunk[4:8])[0]
        if kind == b"fmt " and len(chunk) >= 20:
            rate, per_second = struct.unpack("<II", chunk[12:20])
        if kind == b"data":
            if length in (0, 0xFFFFFFFF):
                length = max(0, size - at - 8)
            return (rate, length / per_second) if rate and per_second else None
        at += 8 + length + (length & 1)
    return None


def flac(read: Read, size: int) -> tuple[int, float] | None:
    """The stream's own description comes first: 20 bits of rate, 36 bits of samples."""
    head = read(0, 42)
    if len(head) < 26 or head[:4] != b"fLaC" or head[4] & 0x7F != 0:
        return None
    bits = int.from_bytes(head[18:26], "big")
    rate, samples = bits >> 44, bits & (1 << 36) - 1
    return (rate, samples / rate) if rate else None


def ogg(read: Read, size: int) -> tuple[int, float] | None:
    """Vorbis or Opus: the rate from the first page, the last sample's place from the last."""
    head = read(0, 512)
    if head[:4] != b"OggS" or len(head) < 28:
        return None
    body = head[27 + head[26] :]
    if body[:7] == b"\x01vorbis" and len(body) >= 16:
        rate, ticks, skipped = struct.unpack("<I", body[12:16])[0], 0, 0
    elif body[:8] == b"OpusHead" and len(body) >= 16:
        rate, skipped = 48_000, struct.unpack("<H", body[10:12])[0]
    else:
        return None
    start = max(0, size - TAIL)
    end = read(start, TAIL)
    last, ticks = len(end), -1
    while ticks < 0 and (last := end.rfind(b"OggS", 0, last)) >= 0:
        if last + 14 <= len(end):  # a page without the end of a packet has -1
            ticks = struct.unpack("<q", end[last + 6 : last + 14])[0]
    return (rate, max(0, ticks - skipped) / rate) if rate and ticks >= 0 else None


def mp4(read: Read, size: int) -> tuple[int, float] | None:
    """The boxes moov/mvhd (length) and moov/trak/mdia/mdhd (an audio track's clock is its rate)."""
    length: float | None = None
    rate = 0
    ends = size
    at, steps, seen = 0, 0, False
    clock, is_audio = 0, False
    while at + 8 <= ends and steps < MOST_STEPS:
        steps += 1
        head = read(at, 48)
        if len(head) < 8:
            break
        box, kind = struct.unpack(">I", head[:4])[0], head[4:8]
        body = 8
        if box == 1 and len(head) >= 16:
            box, body = struct.unpack(">Q", head[8:16])[0], 16
        elif box == 0:
            box = ends - at
        if box < body:
            break
        if not seen and kind not in (b"ftyp", b"free", b"skip", b"wide", b"mdat", b"moov", b"pnot", b"styp", b"uuid"):
            return None
        seen = True
        if kind in (b"moov", b"trak", b"mdia"):  # go inside
            at += body
            if kind == b"trak":
                clock, is_audio = 0, False
            continue
        if kind in (b"mvhd", b"mdhd") and len(head) >= body + 20:
            wide = head[body] == 1
            pair = read(at + body + (20 if wide else 12), 12 if wide else 8)
            if len(pair) == (12 if wide else 8):
                scale, ticks = struct.unpack(">IQ" if wide else ">II", pair)
                if kind == b"mvhd" and scale:
                    length = ticks / scale
                clock = scale if kind == b"mdhd" else clock
        if kind == b"hdlr" and len(head) >= body + 12:
            is_audio = head[body + 8 : body + 12] == b"soun"
        if is_audio and clock and not rate:
            rate = clock
        at += box
    return (rate or DEFAULT_RATE, length) if length is not None else None


PARSERS = (riff, flac, ogg, mp4)


def probe(read: Read, size: int) -> tuple[int, float] | None:
    """(sample rate, seconds), None where no parser knows the bytes."""
    for parser in PARSERS:
        if found := parser(read, size):
            return found
    return None


def ranged(f: pa.NativeFile) -> tuple[Read, list[int]]:
    """Reads of an open file, the start kept; and how many bytes have been read."""
    start = f.read_at(HEAD, 0)
    taken = [len(start)]

    def read(offset: int, size: int) -> bytes:
        if offset + size <= len(start):
            return start[offset : offset + size]
        got = f.read_at(size, offset) if offset >= 0 else b""
        taken[0] += len(got)
        return got

    return read, taken


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, path: str, glob: str, per_partition: int):
        self.path, self.glob, self.per_partition = path, glob, per_partition

    def _open(self) -> tuple[fs.FileSystem, str]:
        path = self.path.removeprefix("file:") if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        store, root = self._open()
        top = store.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        every = [top] if top.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in every if i.is_file and fnmatch(posixpath.basename(i.path), self.glob))
        return [Files(files[i : i + self.per_partition]) for i in range(0, len(files), self.per_partition)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._open()
        for path, size in partition.paths:
            found = None
            try:
                with store.open_input_file(path) as f:
                    found = probe(ranged(f)[0], size)
            except OSError:  # unreadable files have the defaults
                found = None
            rate, seconds = found or (DEFAULT_RATE, 0.0)
            ending = posixpath.splitext(path)[1][1:].lower()
            yield path, ending, rate, float(seconds)


class AudioHeaders(DataSource):
    """Options: path, glob (all files), filesPerPartition (1,000)."""

    @classmethod
    def name(cls) -> str:
        return "audio_headers"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options["path"], self.options.get("glob", "*"), int(self.options.get("filesPerPartition", "1000")))
