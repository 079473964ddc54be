"""ISO media containers: write payloads as raw 8-bit samples, walk boxes, decode sample tables, index keyframes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import textkit

#: A sample is a grey picture of WIDTH * HEIGHT bytes.
WIDTH, HEIGHT = 16, 12
SAMPLE = WIDTH * HEIGHT
#: Pictures a second, samples of a chunk, samples from one entry of the sync table to the next.
RATE, CHUNK, SYNC = 25, 32, 12
CODEC = b"raw "
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes, unit: int = SAMPLE) -> bytes:
    """data with bytes 32 up to a positive multiple of unit."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b" ")


def box(kind: bytes, *parts: bytes) -> bytes:
    """A box; with a 64-bit size if 32 bits don't hold it."""
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 2**32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return head + b"".join(parts)


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    """A box with version 0 and flags."""
    return box(kind, struct.pack(">I", flags), *parts)


def write(payload: bytes) -> bytes:
    """A file with one video track whose samples, in chunks of CHUNK, are the payload's runs of SAMPLE bytes."""
    n, rest = divmod(len(payload), SAMPLE)
    if rest or not n:
        raise ValueError(f"a payload must be a positive multiple of {SAMPLE} bytes")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    chunks = -(-n // CHUNK)
    large = len(payload) > 2**32 - 2**26
    runs = [(1, CHUNK)] if n >= CHUNK else []
    if n % CHUNK:
        runs.append((chunks, n % CHUNK))
    sync = np.arange(1, n + 1, SYNC, dtype=">u4")
    entry = box(
        CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1),
        bytes(32), struct.pack(">Hh", 40, -1),
    )

    def moov(first: int) -> bytes:
        offsets = (first + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * SAMPLE)).astype(">u8" if large else ">u4")
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, b, 1) for a, b in runs]),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if large else b"stco", struct.pack(">I", chunks), offsets.tobytes()),
        )
        minf = box(
            b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl
        )
        mdia = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n & 0xFFFFFFFF, 0x55C4, 0)),
            full(b"hdlr", bytes(4), b"vide", bytes(12), b"grey\0"),
            minf,
        )
        tkhd = full(
            b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n & 0xFFFFFFFF), bytes(8), bytes(8), _MATRIX,
            struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3,
        )
        mvhd = full(
            b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)
        )
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 2**32 else 8
    first = len(ftyp) + len(moov(0)) + head
    return b"".join((ftyp, moov(first), box(b"mdat", payload)))


def walk(data: bytes, start: int = 0, end: int | None = None, path: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
    """(path, start, end) of each box's content, parents before children; raises ValueError on a broken size."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError("a box is larger than what holds it")
        here = path + b"/" + kind
        yield here, body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, here)
        start = stop


def read(data: bytes) -> dict:
    """Codec, size, timescale, duration and the sample table of the first track; no sample is decoded.

    offsets and sizes have an entry for each sample, sync the indices of keyframes (all, without a sync table).
    """
    at: dict[bytes, tuple[int, int]] = {}
    for path, start, end in walk(data):
        at.setdefault(path.rpartition(b"/")[2], (start, end))

    def table(kind: bytes, dtype: str, skip: int = 8, columns: int = 1) -> np.ndarray:
        (count,) = struct.unpack_from(">I", data, at[kind][0] + skip - 4)
        flat = np.frombuffer(data, dtype, count * columns, at[kind][0] + skip)
        return flat.astype(np.int64).reshape(-1, columns) if columns > 1 else flat.astype(np.int64)

    entry = at[b"stsd"][0] + 8
    codec = data[entry + 4 : entry + 8].decode("latin-1")
    width, height = struct.unpack_from(">HH", data, entry + 32)
    timescale = struct.unpack_from(">I", data, at[b"mdhd"][0] + (20 if data[at[b"mdhd"][0]] == 1 else 12))[0]
    fixed, n = struct.unpack_from(">II", data, at[b"stsz"][0] + 4)
    sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, at[b"stsz"][0] + 12).astype(np.int64)
    starts = table(b"stco", ">u4") if b"stco" in at else table(b"co64", ">u8")
    runs = table(b"stsc", ">u4", columns=3)
    last = np.append(runs[1:, 0], len(starts) + 1)
    each = np.repeat(runs[:, 1], last - runs[:, 0])  # samples of each chunk
    before = np.cumsum(sizes) - sizes
    firsts = np.cumsum(each) - each
    offsets = before + np.repeat(starts - before[firsts], each)
    times = table(b"stts", ">u4", columns=2)
    sync = table(b"stss", ">u4") - 1 if b"stss" in at else np.arange(n)
    return {
        "codec": codec, "width": width, "height": height, "timescale": timescale,
        "duration": int((times[:, 0] * times[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "sync": sync,
    }


def payload_of(data: bytes, info: dict) -> bytes:
    """The samples' bytes in order; neighbouring samples are read as one range."""
    offsets, ends = info["offsets"], info["offsets"] + info["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != ends[:-1]) + 1
    firsts, lasts = np.append(0, breaks), np.append(breaks, len(offsets)) - 1
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in zip(offsets[firsts].tolist(), ends[lasts].tolist(), strict=True))


def keyframes(info: dict) -> np.ndarray:
    """First and end byte in the file of each keyframe."""
    return np.stack([info["offsets"], info["offsets"] + info["sizes"]], axis=1)[info["sync"]]


def feature(info: dict) -> str:
    """Codec, picture, duration in seconds, samples, and the keyframes' number, byte range and hash of ranges."""
    ranges = keyframes(info)
    span = f"{ranges[0, 0]}-{ranges[-1, 1]}" if len(ranges) else "-"
    return (
        f"codec={info['codec'].strip()};picture={info['width']}x{info['height']};"
        f"seconds={info['duration'] / max(1, info['timescale']):.2f};samples={len(info['sizes'])};"
        f"keyframes={len(ranges)};range={span};ranges={zlib.crc32(ranges.astype('>i8').tobytes()):08x}"
    )


SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, codec string, seconds double, keyframes array<struct<start: long, end: long>>"
)

NAMES = "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature codec seconds keyframes".split()


def media_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """doc_id and the columns of SCHEMA, with keep_media also media (binary), the stored file.

    Each text's UTF-8, padded, becomes the samples of an ISO media file; the file is read back by its boxes and sample
    tables. payload_* describe the bytes read back, tail_crc32 the last 16 of them; codec, seconds and
    keyframes (byte ranges in the file) are what its boxes say. Null and empty texts: one sample
    of spaces. Repeated rows: equal values. Empty table: empty result. Other columns of docs are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *NAMES, *["media"] * keep_media]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = textkit.buffers(batch.column(1))
            rows, size, first = [], 0, 0
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]].tobytes()
                media = write(padded(own))
                info = read(media)
                payload = payload_of(media, info)
                rows.append((
                    len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media),
                    hashlib.sha256(media).hexdigest(), feature(info), info["codec"].strip(), info["duration"] / max(1, info["timescale"]),
                    [{"start": a, "end": b} for a, b in keyframes(info).tolist()], *[media] * keep_media,
                ))
                size += len(media) * keep_media
                if size > 1 << 24 or i == batch.num_rows - 1:
                    columns = [pa.array(c, spans if n == "keyframes" else None) for n, c in zip(names[1:], zip(*rows, strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), *columns], names=names)
                    rows, size, first = [], 0, i + 1

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id long, {SCHEMA}" + ", media binary" * keep_media)
