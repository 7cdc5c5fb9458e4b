"""Media columns of ISO base media containers (ISO/IEC 14496-12), read without decoding a payload.

index_tracks() walks the nested boxes of each container and decodes its sample tables: stsd for the codec, mdhd for the
duration, stts for times, stsz or stz2 for sizes, stsc with stco or co64 for offsets, stss for keyframes. Payload boxes are
stepped over by their size. A track without stss has a keyframe at every sample, as the standard says. Movie fragments (moof) follow
the track's own samples in the order of the file: tfhd, tfdt and trun with the defaults of trex; a sample is a keyframe unless its flags say that it is no sync sample.

Result, a row for each track, or one with track_id null where there is none: (key, status, track_id, handler, codec, timescale, duration_s,
n_samples, n_keyframes, keyframes), keyframes being an array of (time_s, offset, size), the decode time and byte range of each. duration_s is mdhd's,
or where it says nothing, that of the samples; edit lists change neither.
status: 'ok'; 'null' or 'empty' content; 'not_iso' if no moov box is found; 'damaged' if a box or table is cut short, tables contradict each
other or a sample lies beyond the end of the file. What a damaged track says up to there is not given; a damaged fragment makes every track damaged that may have fragments.
Never an exception, whatever the bytes: no table is decoded that takes more memory than a bounded multiple of the file's size (a sample takes a byte of the file
at least, or an entry of a table). Null keys and repeated rows give rows like any other; keys are integers or cast to one; other columns take no part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
SCHEMA = "key long, status string, track_id long, handler string, codec string, timescale long, duration_s double, n_samples long, n_keyframes long, keyframes array<struct<time_s: double, offset: long, size: long>>"
_KEYFRAME = pa.struct([("time_s", pa.float64()), ("offset", pa.int64()), ("size", pa.int64())])


class Damaged(Exception):
    pass


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of content, end) of the boxes from start to end."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise Damaged
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise Damaged
        yield kind, start + head, start + size
        start += size


def find(data: memoryview, span: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    """The first box at the path."""
    for kind, s, e in boxes(data, *span):
        if kind == path[0]:
            return find(data, (s, e), *path[1:]) if len(path) > 1 else (s, e)
    return None


def full(data: memoryview, span: tuple[int, int] | None) -> tuple[int, int, int]:
    """(version, start after version and flags, end)."""
    if span is None or span[0] + 4 > span[1]:
        raise Damaged
    return data[span[0]], span[0] + 4, span[1]


def table(data: memoryview, at: int, end: int, n: int, kind: str) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise Damaged
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def unpack(data: memoryview, kind: str, at: int, end: int) -> tuple:
    if at + struct.calcsize(kind) > end:
        raise Damaged
    return struct.unpack_from(kind, data, at)


def sample_sizes(data: memoryview, stbl: tuple[int, int]) -> np.ndarray:
    if span := find(data, stbl, b"stsz"):
        _, at, end = full(data, span)
        fixed, n = unpack(data, ">II", at, end)
        if n * fixed > len(data):
            raise Damaged
        return np.full(n, fixed, np.int64) if fixed else table(data, at + 8, end, n, ">u4")
    _, at, end = full(data, find(data, stbl, b"stz2"))
    field, n = unpack(data, ">II", at, end)
    field &= 0xFF
    if field in (8, 16):
        return table(data, at + 8, end, n, ">u2" if field == 16 else ">u1")
    if field != 4:
        raise Damaged
    half = table(data, at + 8, end, (n + 1) // 2, ">u1")
    return np.stack([half >> 4, half & 15], 1).reshape(-1)[:n]


def sample_offsets(data: memoryview, stbl: tuple[int, int], sizes: np.ndarray) -> np.ndarray:
    wide = find(data, stbl, b"co64")
    _, at, end = full(data, wide or find(data, stbl, b"stco"))
    chunks = table(data, at + 4, end, unpack(data, ">I", at, end)[0], ">u8" if wide else ">u4")
    _, at, end = full(data, find(data, stbl, b"stsc"))
    runs = table(data, at + 4, end, 3 * unpack(data, ">I", at, end)[0], ">u4").reshape(-1, 3)
    if not len(sizes):
        return np.zeros(0, np.int64)
    if not len(runs) or not len(chunks) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
        raise Damaged
    each = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1]))
    if each.sum() < len(sizes):
        raise Damaged
    full_at = int(np.searchsorted(np.cumsum(each), len(sizes)))  # the chunk in which the samples end
    each = each[: full_at + 1]
    each[-1] -= each.sum() - len(sizes)
    chunk = np.repeat(np.arange(full_at + 1), each)
    before = np.cumsum(sizes) - sizes
    first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    return chunks[chunk] + before - np.repeat(before[first], np.diff(np.r_[first, len(chunk)]))


Samples = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def table_samples(data: memoryview, stbl: tuple[int, int]) -> tuple[Samples, int]:
    """((time, offset, size, whether a keyframe) of the samples of a track's own tables, their duration)."""
    sizes = sample_sizes(data, stbl)
    offsets = sample_offsets(data, stbl, sizes)
    _, at, end = full(data, find(data, stbl, b"stts"))
    runs = table(data, at + 4, end, 2 * unpack(data, ">I", at, end)[0], ">u4").reshape(-1, 2)
    if runs[:, 0].sum() != len(sizes):
        raise Damaged
    steps = np.repeat(runs[:, 1], runs[:, 0])
    is_key = np.ones(len(sizes), bool)
    if span := find(data, stbl, b"stss"):
        _, at, end = full(data, span)
        key = table(data, at + 4, end, unpack(data, ">I", at, end)[0], ">u4") - 1
        if len(key) and (key.min() < 0 or key.max() >= len(sizes) or (np.diff(key) <= 0).any()):
            raise Damaged
        is_key[:] = False
        is_key[key] = True
    return (np.cumsum(steps) - steps, offsets, sizes, is_key), int(steps.sum())


def fragment_defaults(data: memoryview, moov: tuple[int, int]) -> dict[int, tuple[int, int, int]]:
    """Default (duration, size, flags) of each track that may have fragments."""
    mvex, out = find(data, moov, b"mvex"), {}
    for kind, s, e in boxes(data, *mvex) if mvex else ():
        if kind == b"trex":
            _, at, end = full(data, (s, e))
            track_id, _, *rest = unpack(data, ">IIIII", at, end)
            out[track_id] = tuple(rest)
    return out


def fragment(data: memoryview, start: int, moof: tuple[int, int], defaults: dict, clock: dict[int, int], into: dict[int, list[Samples]]) -> None:
    """Adds the samples of a moof box that starts at start; clock: the decode time that each track has come to."""
    last = start
    for kind, s, e in boxes(data, *moof):
        if kind != b"traf":
            continue
        _, at, end = full(data, find(data, (s, e), b"tfhd"))
        flags = unpack(data, ">I", at - 4, end)[0] & 0xFFFFFF
        track_id, at = unpack(data, ">I", at, end)[0], at + 4
        if track_id not in defaults:
            raise Damaged
        step, size, how = defaults[track_id]
        base = start if flags & 0x20000 else last
        if flags & 1:
            base, at = unpack(data, ">Q", at, end)[0], at + 8
        at += 4 * bool(flags & 2)
        got = []
        for bit, default in ((8, step), (16, size), (32, how)):
            if flags & bit:
                default, at = unpack(data, ">I", at, end)[0], at + 4
            got.append(default)
        step, size, how = got
        if span := find(data, (s, e), b"tfdt"):
            version, at, end = full(data, span)
            clock[track_id] = unpack(data, ">Q" if version else ">I", at, end)[0]
        place = base
        for kind, s2, e2 in boxes(data, s, e):
            if kind != b"trun":
                continue
            _, at, end = full(data, (s2, e2))
            flags = unpack(data, ">I", at - 4, end)[0] & 0xFFFFFF
            n, at = unpack(data, ">I", at, end)[0], at + 4
            if flags & 1:
                place, at = base + unpack(data, ">i", at, end)[0], at + 4
            first = None
            if flags & 4:
                first, at = unpack(data, ">I", at, end)[0], at + 4
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            if n * (size if 0x200 not in fields else 1) > len(data) or n > len(data):
                raise Damaged
            cols = table(data, at, end, n * len(fields), ">u4").reshape(n, len(fields))
            pick = lambda bit, default: cols[:, fields.index(bit)] if bit in fields else np.full(n, default, np.int64)  # noqa: E731, B023
            steps, sizes, hows = pick(0x100, step), pick(0x200, size), pick(0x400, how)
            if first is not None and n:
                hows = hows.copy()
                hows[0] = first
            times = clock.get(track_id, 0) + np.cumsum(steps) - steps
            into.setdefault(track_id, []).append((times, place + np.cumsum(sizes) - sizes, sizes, hows & 0x10000 == 0))
            clock[track_id] = clock.get(track_id, 0) + int(steps.sum())
            place += int(sizes.sum())
        last = place


def head(data: memoryview, trak: tuple[int, int]) -> dict:
    """What a track says of itself, and its own samples."""
    version, at, end = full(data, find(data, trak, b"tkhd"))
    track_id = unpack(data, ">QQI" if version else ">III", at, end)[2]
    version, at, end = full(data, find(data, trak, b"mdia", b"mdhd"))
    _, _, timescale, duration = unpack(data, ">QQIQ" if version else ">IIII", at, end)
    if duration == (1 << (64 if version else 32)) - 1:
        duration = 0
    _, at, end = full(data, find(data, trak, b"mdia", b"hdlr"))
    handler = unpack(data, ">I4s", at, end)[1].decode("latin-1")
    stbl = find(data, trak, b"mdia", b"minf", b"stbl")
    if stbl is None or not timescale:
        raise Damaged
    _, at, end = full(data, find(data, stbl, b"stsd"))
    codec = unpack(data, ">II4s", at, end)[2].decode("latin-1")
    samples, took = table_samples(data, stbl)
    return {"track_id": track_id, "handler": handler, "codec": codec, "timescale": timescale, "duration": duration, "took": took, "samples": [samples]}


def finished(data: memoryview, h: dict) -> dict:
    time, offset, size, is_key = (np.concatenate(x) for x in zip(*h["samples"]))
    if len(size) and (offset.min() < 0 or int((offset + size).max()) > len(data)):
        raise Damaged
    out = {"status": "ok"} | {k: h[k] for k in ("track_id", "handler", "codec", "timescale")}
    out["duration_s"] = round((h["duration"] or h["took"]) / h["timescale"], 6)
    return out | {"n_samples": len(size), "n_keyframes": int(is_key.sum()), "keyframes": ((time[is_key] / h["timescale"]).round(6), offset[is_key], size[is_key])}


_NO_FRAMES = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))


def parse(content: bytes | None) -> list[dict]:
    """The tracks of a container, in its order, keyframes as three arrays."""
    if content is None:
        return [{"status": "null"}]
    if not len(content):
        return [{"status": "empty"}]
    data = memoryview(content)
    moov, moofs, damaged = None, [], False
    try:
        at = 0
        for kind, s, e in boxes(data, 0, len(data)):
            if kind == b"moov":
                moov = (s, e)
            elif kind == b"moof":
                moofs.append((at, s, e))
            at = e
    except Damaged:
        damaged = True
    if moov is None:
        return [{"status": "damaged" if damaged and bytes(data[4:8]) == b"ftyp" else "not_iso"}]
    out: list[dict] = []
    more: dict[int, list[Samples]] = {}
    clock: dict[int, int] = {}
    defaults: dict = {}
    try:
        defaults, torn = fragment_defaults(data, moov), False
    except Damaged:
        torn = True
    try:
        for kind, s, e in boxes(data, *moov):
            if kind == b"trak":
                try:
                    out.append(head(data, (s, e)))
                    clock[out[-1]["track_id"]] = out[-1]["took"]
                except Damaged:
                    out.append({})
    except Damaged:
        out.append({})
    try:
        for start, s, e in moofs:
            fragment(data, start, (s, e), defaults, clock, more)
    except Damaged:
        torn = True
    done = []
    for h in out:
        try:
            if not h or torn and (h["track_id"] in defaults or not defaults):
                raise Damaged
            h["samples"] += more.get(h["track_id"], [])
            h["took"] = clock[h["track_id"]]
            done.append(finished(data, h))
        except Damaged:
            done.append({"status": "damaged"})
    return done or [{"status": "ok", "n_samples": 0, "n_keyframes": 0, "keyframes": _NO_FRAMES}]


def tracks(content: bytes | None) -> list[dict]:
    """parse() with keyframes as a list of dictionaries."""
    return [t | {"keyframes": [{"time_s": a, "offset": b, "size": c} for a, b, c in zip(*(x.tolist() for x in t["keyframes"]))]} if "keyframes" in t else t for t in parse(content)]


NAMES = ["key", "status", "track_id", "handler", "codec", "timescale", "duration_s", "n_samples", "n_keyframes", "keyframes"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]


def index_tracks(media: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """The media columns of every container of media(key, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = x.as_buffer()
                rows += [{"key": k, **t} for t in parse(None if x is None else x)]
            frames = [r.get("keyframes") for r in rows]
            ends = np.cumsum([0, *(0 if f is None else len(f[0]) for f in frames)])
            flat = [np.concatenate([f[i] for f in frames if f is not None] or [_NO_FRAMES[i]]) for i in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(_KEYFRAME)), mask=pa.array([f is None for f in frames]))
            yield pa.RecordBatch.from_arrays([*[pa.array([r.get(n) for r in rows], t) for n, t in zip(NAMES[:-1], _TYPES)], lists], NAMES)

    return media.select(media[key].cast("long").alias("key"), media[content].alias("content")).mapInArrow(run, SCHEMA)
