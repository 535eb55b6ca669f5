"""FASTQ text: parsing, encoding, and the plain, gzip and zstd forms.

What is written as gzip or zstd is a row of members or frames of whole records, each
with its size and its number of reads: a gzip member in the extra field of its header,
a zstd frame in a skippable frame behind it. Any reader skips them; ours begins at any.
"""

from __future__ import annotations

import gzip
import io
import os
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from .container import SUFFIX

GZIP, ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"
#: Text of a member or frame that is written.
MEMBER_BYTES = 4 << 20
_BLOCK_BYTES = 1 << 20
#: Before size and reads: a gzip header with an extra field of 20 bytes, of which 16 are ours; a skippable frame of 24 bytes, with a tag.
_GZIP_HEAD = GZIP + b"\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sH", 20, b"SM", 16)
_ZSTD_HEAD = struct.pack("<II", 0x184D2A53, 24) + b"strandmi"


def kind(path: str) -> str:
    """The format by the path's suffix, case counting: container, gzip, zstd, fifo, memory or plain."""
    for suffix, name in ((SUFFIX, "container"), (".gz", "gzip"), (".zst", "zstd"), (".fifo", "fifo"), (".mem", "memory")):
        if path.endswith(suffix):
            return name
    return "plain"


def normalised(path: str) -> str:
    """Absolute, but for keys of the memory store and paths with a scheme."""
    return path if path.endswith(".mem") or "://" in path else os.path.abspath(path)


def open_text(path: str, start: int = 0) -> BinaryIO:
    """The text of a file; from ``start`` on, a place in the file where a line, member or frame begins."""
    form = kind(path)
    if form not in ("gzip", "zstd"):
        f = open(path, "rb")
        f.seek(start)
        return f
    magic, name = (GZIP, "gzip") if form == "gzip" else (ZSTD, "zstd")
    with open(path, "rb") as f:
        head = f.read(len(magic))
    if not head and os.path.getsize(path) == 0 or len(head) < len(magic):
        raise ValueError(f"File too short to be valid {name}: {path}")
    if head != magic:
        raise ValueError(f"File does not appear to be valid {name}: {path}")
    f = open(path, "rb")
    f.seek(start)
    if form == "gzip":
        return gzip.GzipFile(fileobj=f, mode="rb")
    return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True, closefd=True), 1 << 20)


def members(path: str) -> list[tuple[int, int]]:
    """Where members or frames of a gzip or zstd file start, and their reads; nothing unless all of the file carries them."""
    form, size, found = kind(path), os.path.getsize(path), []
    with open(path, "rb") as f:
        if form == "gzip":
            at, n = 0, len(_GZIP_HEAD)
            while at < size:
                f.seek(at)
                head = f.read(n + 16)
                if len(head) < n + 16 or not head.startswith(_GZIP_HEAD):
                    return []
                length, reads = struct.unpack("<QQ", head[n:])
                found.append((at, reads))
                at += max(length, n)
            return found if at == size else []
        at, n = size, len(_ZSTD_HEAD) + 16
        while at > 0:
            if at < n:
                return []
            f.seek(at - n)
            tail = f.read(n)
            if not tail.startswith(_ZSTD_HEAD):
                return []
            length, reads = struct.unpack("<QQ", tail[-16:])
            at -= max(length, n)
            found.append((at, reads))
        return found[::-1] if at == 0 else []


def parse(f: BinaryIO, path: str = "") -> Iterator[tuple[str, str, str]]:
    """name, seq, qual of each record. A record that ends early at the end of the file is dropped; the third line isn't read."""
    while True:
        head = f.readline()
        if not head:
            return
        lines = [f.readline() for _ in range(3)]
        if not head.startswith(b"@"):
            raise _wrong(head.rstrip(b"\n"), path)
        if not lines[2]:
            return
        strip = lambda b: (b[:-1] if b.endswith(b"\n") else b).decode("latin-1")
        yield strip(head[1:]), strip(lines[0]), strip(lines[2])


def blocks(f: BinaryIO, path: str = "", size: int = _BLOCK_BYTES) -> Iterator[bytes]:
    """The text in pieces of whole records, by the rules of ``parse``."""
    rest = b""
    while data := f.read(size):
        data = rest + data
        cut = len(data)
        for _ in range(data.count(b"\n") % 4 + 1):
            cut = data.rfind(b"\n", 0, cut)
            if cut < 0:
                break
        if cut >= 0:
            yield data[: cut + 1]
        rest = data[cut + 1 :]
    if rest:
        if not rest.startswith(b"@"):
            raise _wrong(rest.split(b"\n", 1)[0], path)
        if rest.count(b"\n") == 3 and not rest.endswith(b"\n"):
            yield rest + b"\n"


def _wrong(head: bytes, path: str) -> ValueError:
    return ValueError(f"Invalid FASTQ read name: {head.decode('latin-1')}{f' in {path}' * bool(path)}")


def check_names(block: bytes, path: str = "") -> None:
    """Fail if a record's first line doesn't begin with @."""
    signs = np.frombuffer(block, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(signs == 10)[3::4] + 1))[:-1]
    bad = starts[signs[starts] != ord("@")]
    if len(bad):
        raise _wrong(block[bad[0] :].split(b"\n", 1)[0], path)


def columns(f: BinaryIO, path: str = "", wanted: tuple[str, ...] = ("name", "seq", "qual"), size: int = _BLOCK_BYTES) -> Iterator[tuple[int, dict[str, pa.Array]]]:
    """``parse`` piece by piece: how many records, and the wanted columns of them, cut at the lines' ends without a loop over records."""
    own = {"name": 1, "seq": 3, "qual": 5}
    for block in blocks(f, path, size):
        if not block.isascii():
            block = block.decode("latin-1").encode()
        signs = np.frombuffer(block, np.uint8)
        ends = np.flatnonzero(signs == 10).reshape(-1, 4)
        starts = np.concatenate(([0], ends[:-1, 3] + 1))
        bad = np.flatnonzero(signs[starts] != ord("@"))
        n = int(bad[0]) if len(bad) else len(ends)
        # Pieces of a record: @, name, line end, sequence, the third line, qualities, line end.
        places = np.stack((starts, starts + 1, ends[:, 0], ends[:, 0] + 1, ends[:, 1], ends[:, 2] + 1, ends[:, 3]), 1)[:n].reshape(-1)
        if n:
            pieces = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(np.append(places, ends[n - 1, 3] + 1).astype(np.int64)), pa.py_buffer(block))
            yield n, {c: pieces.take(pa.array(np.arange(own[c], len(places), 7))).cast(pa.string()) for c in wanted}
        if len(bad):  # only if the reader goes on
            raise _wrong(block[starts[n] : ends[n, 0]].decode().encode("latin-1"), path)


def encode(name: pa.Array, seq: pa.Array, qual: pa.Array) -> bytes:
    """The text of records; null is empty."""
    own = [c.cast(pa.large_string()).fill_null("") for c in (name, seq, qual)]
    sign = lambda x: pa.scalar(x, pa.large_string())
    lines = pc.binary_join_element_wise(own[0], own[1], sign("+"), own[2], sign("\n"))
    whole = pc.binary_join_element_wise(sign("@"), lines, sign("\n"), sign(""))
    _, places, data = whole.buffers()
    if not len(whole) or data is None:
        return b""
    at = np.frombuffer(places, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()
    return raw if raw.isascii() else raw.decode().encode("latin-1")


def _member(raw: bytes, form: str, level: int) -> bytes:
    """A gzip member or zstd frame with its size and reads; without them if lines are not those of whole records."""
    lines = raw.count(b"\n")
    if form == "gzip":
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = c.compress(raw) + c.flush() + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
        if lines % 4:
            return GZIP + b"\x08" + bytes(6) + b"\xff" + body
        return _GZIP_HEAD + struct.pack("<QQ", len(_GZIP_HEAD) + 16 + len(body), lines // 4) + body
    body = zstandard.ZstdCompressor(level=level).compress(raw)
    return body if lines % 4 else body + _ZSTD_HEAD + struct.pack("<QQ", len(body) + len(_ZSTD_HEAD) + 16, lines // 4)


def compress(parts: Iterator[bytes], form: str, gzip_level: int, zstd_level: int) -> Iterator[bytes]:
    """Pieces of whole records in members or frames of ``MEMBER_BYTES``, one at least; members and frames may be strung together."""
    if form not in ("gzip", "zstd"):
        yield from parts
        return
    level, own, size, made = gzip_level if form == "gzip" else zstd_level, [], 0, False
    for p in parts:
        own.append(p)
        size += len(p)
        if size >= MEMBER_BYTES:
            yield _member(b"".join(own), form, level)
            own, size, made = [], 0, True
    if own or not made:
        yield _member(b"".join(own), form, level)
