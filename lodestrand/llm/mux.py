"""A small writer of ISO media containers. The given tables hold no media, so the query of media.py has its containers made by it from pages.

A container has a video track, whose payload is the page's bytes cut into samples, and for odd keys an audio track of
fixed samples. Box layout varies with the key: moov before or after mdat, 32- or 64-bit offsets, header versions, 64-bit
box sizes, boxes to be skipped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SAMPLE, GOP, AUDIO_SAMPLE, PER_CHUNK = 400, 4, 64, 3
TIMESCALE, STEP = 12800, 512


def box(kind: bytes, *parts: bytes, wide: bool = False) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, body: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24), body)


def ints(kind: str, xs: list[int]) -> bytes:
    return struct.pack(f">{len(xs)}{kind}", *xs)


def trak(track_id: int, handler: bytes, codec: bytes, sizes: list[int], chunks: list[int], per_chunk: int, key: list[int] | None, timescale: int, step: int, version: int, wide: bool) -> bytes:
    n = len(sizes)
    duration = n * step
    times = (0, 0)
    head = struct.pack(">QQIIQ" if version else ">IIIII", *times, track_id, 0, duration)
    mdhd = struct.pack(">QQIQI" if version else ">IIIII", *times, timescale, duration, 0)
    rest = n % per_chunk
    runs = [(1, per_chunk, 1)] if n >= per_chunk else []
    if rest:
        runs.append((len(chunks), rest, 1))
    same = len(set(sizes)) == 1
    stbl = [
        full(b"stsd", struct.pack(">I", 1) + box(codec, bytes(28))),
        full(b"stts", struct.pack(">III", 1, n, step) if n else struct.pack(">I", 0)),
        full(b"stss", struct.pack(">I", len(key)) + ints("I", key)) if key is not None else b"",
        full(b"stsz", struct.pack(">II", sizes[0] if same else 0, n) + (b"" if same else ints("I", sizes))),
        full(b"stsc", struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", *r) for r in runs)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)) + ints("Q" if wide else "I", chunks)),
    ]
    minf = box(b"minf", full(b"vmhd", bytes(8)), box(b"dinf", full(b"dref", struct.pack(">I", 0))), box(b"stbl", *stbl))
    return box(b"trak", full(b"tkhd", head + bytes(60), version), box(b"mdia", full(b"mdhd", mdhd, version), full(b"hdlr", struct.pack(">I4s", 0, handler) + bytes(13)), minf))


def container(key: int, payload: bytes) -> bytes:
    sizes = [len(payload[i : i + SAMPLE]) for i in range(0, len(payload), SAMPLE)]
    audio = [AUDIO_SAMPLE] * (len(sizes) // 2) if key % 2 else []
    sound = bytes(AUDIO_SAMPLE) * len(audio)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    wide, late, version = key % 3 == 0, key % 4 == 0, int(key % 5 == 0)
    skip = box(b"free", bytes(key % 7))

    def moov(data_at: int) -> bytes:
        chunks = [data_at + i * SAMPLE for i in range(0, len(sizes), PER_CHUNK)]
        video = trak(1, b"vide", b"avc1" if key % 6 else b"hvc1", sizes, chunks, PER_CHUNK, list(range(1, len(sizes) + 1, GOP)), TIMESCALE, STEP, version, wide)
        if not audio:
            return box(b"moov", full(b"mvhd", bytes(96)), video)
        first = data_at + len(payload)
        sounds = [first + i * AUDIO_SAMPLE for i in range(0, len(audio), PER_CHUNK)]
        return box(b"moov", full(b"mvhd", bytes(96)), video, trak(2, b"soun", b"mp4a", audio, sounds, PER_CHUNK, None, 48000, 1024, version, wide))

    mdat = box(b"mdat", payload, sound, wide=late)
    head = 16 if late else 8
    if late:
        return ftyp + skip + mdat + moov(len(ftyp) + len(skip) + head)
    at = len(ftyp) + len(skip) + len(moov(0)) + head
    return ftyp + skip + moov(at) + mdat


def muxed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content) of every row; a null key or text has null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if k is None or t is None else container(k, t.encode("utf-8", "surrogatepass")) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["key", "content"])

    return rows.select(rows[key].cast("long").alias("key"), rows[text].alias("text")).mapInArrow(run, "key long, content binary")
