import random
import struct

from lodestrand.llm import media, mux


def test_keyframes_point_at_the_payload():
    r = random.Random(2)
    for key in range(200):
        payload = bytes(r.randrange(256) for _ in range(r.choice([0, 1, 399, 400, 401, 5000])))
        data = mux.container(key, payload)
        got = media.tracks(data)
        samples = [payload[i : i + mux.SAMPLE] for i in range(0, len(payload), mux.SAMPLE)]
        video = got[0]
        assert video["status"] == "ok" and video["handler"] == "vide" and video["codec"] == ("avc1" if key % 6 else "hvc1")
        assert video["n_samples"] == len(samples) and abs(video["duration_s"] - len(samples) * mux.STEP / mux.TIMESCALE) < 1e-6
        assert [data[k["offset"] : k["offset"] + k["size"]] for k in video["keyframes"]] == samples[:: mux.GOP]
        assert [k["time_s"] for k in video["keyframes"]] == [round(i * mux.STEP / mux.TIMESCALE, 6) for i in range(0, len(samples), mux.GOP)]
        if key % 2 and len(samples) > 1:
            sound = got[1]
            assert sound["codec"] == "mp4a" and sound["n_keyframes"] == sound["n_samples"] == len(samples) // 2
            assert all(data[k["offset"] : k["offset"] + k["size"]] == bytes(mux.AUDIO_SAMPLE) for k in sound["keyframes"])


def test_damage_never_raises():
    r = random.Random(4)
    good = mux.container(5, bytes(3000))
    for _ in range(2000):
        data = bytearray(good)
        for _ in range(r.randint(1, 6)):
            data[r.randrange(len(data))] = r.randrange(256)
        cut = bytes(data[: r.randint(0, len(data))])
        assert all(t["status"] in ("ok", "empty", "not_iso", "damaged") for t in media.tracks(cut))


def test_defined_results_of_odd_content():
    assert media.tracks(None) == [{"status": "null"}] and media.tracks(b"") == [{"status": "empty"}]
    assert media.tracks(b"<html>not media at all</html>")[0]["status"] == "not_iso"
    assert media.tracks(mux.container(4, bytes(900))[:60])[0]["status"] == "damaged"
    assert media.tracks(mux.box(b"moov"))[0] == {"status": "ok", "n_samples": 0, "n_keyframes": 0, "keyframes": []}


def atom(kind, body):
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def u32(*xs):
    return b"".join(x.to_bytes(4, "big") for x in xs)


def movie(samples=b"", mvex=b"", duration=0):
    """A movie of one track with the bytes of its stbl after stsd, written out by hand."""
    stbl = atom(b"stbl", atom(b"stsd", u32(0, 1) + atom(b"avc1", bytes(28))) + samples)
    mdia = atom(b"mdia", atom(b"mdhd", u32(0, 0, 0, 1000, duration, 0)) + atom(b"hdlr", u32(0, 0) + b"vide" + bytes(13)) + atom(b"minf", stbl))
    return atom(b"moov", atom(b"trak", atom(b"tkhd", u32(0, 0, 0, 1) + bytes(64)) + mdia) + mvex)


EMPTY = atom(b"stts", u32(0, 0)) + atom(b"stsz", u32(0, 0, 0)) + atom(b"stsc", u32(0, 0)) + atom(b"stco", u32(0, 0))
TREX = atom(b"mvex", atom(b"trex", u32(0, 1, 1, 40, 10, 0x10000)))


def test_fragments_written_by_hand():
    start = atom(b"ftyp", b"iso5" + u32(0)) + movie(EMPTY, TREX)
    # sizes and flags for each sample, offset from the fragment's start
    traf = atom(b"tfhd", u32(0x20000, 1)) + atom(b"tfdt", u32(0, 500)) + atom(b"trun", u32(0x601, 2, 0, 7, 0, 9, 0x10000))
    traf = traf.replace(u32(0x601, 2, 0), u32(0x601, 2, len(atom(b"moof", atom(b"traf", traf))) + 8))
    one = atom(b"moof", atom(b"traf", traf)) + atom(b"mdat", b"AAAAAAAbbbbbbbbb")
    # the defaults of trex, a first sample that is a keyframe, no tfdt; two runs of which the second goes on where the first ends
    runs = atom(b"trun", u32(0x5, 2, 0, 0x2000000)) + atom(b"trun", u32(0x100, 1, 60))
    traf = atom(b"tfhd", u32(0x20000, 1)) + runs
    traf = traf.replace(u32(0x5, 2, 0), u32(0x5, 2, len(atom(b"moof", atom(b"traf", traf))) + 8))
    two = atom(b"moof", atom(b"traf", traf)) + atom(b"mdat", b"C" * 10 + b"d" * 20)
    data = start + one + two
    (got,) = media.tracks(data)
    assert (got["status"], got["n_samples"], got["n_keyframes"], got["duration_s"]) == ("ok", 5, 2, 0.72)
    assert [(k["time_s"], data[k["offset"] : k["offset"] + k["size"]]) for k in got["keyframes"]] == [(0.5, b"A" * 7), (0.58, b"C" * 10)]
    assert media.tracks(data[:-1])[0]["status"] == "damaged"
    assert media.tracks(start)[0] | {"keyframes": 0} == {"status": "ok", "track_id": 1, "handler": "vide", "codec": "avc1", "timescale": 1000, "duration_s": 0.0, "n_samples": 0, "n_keyframes": 0, "keyframes": 0}
    assert media.tracks(start + one.replace(u32(0x20000, 1), u32(0x20000, 2)) + two)[0]["status"] == "damaged"


def test_tables_written_by_hand():
    def tables(at):
        return movie(atom(b"stts", u32(0, 2, 1, 5, 2, 10)) + atom(b"stss", u32(0, 2, 1, 3)) + atom(b"stsz", u32(0, 0, 3, 2, 3, 4)) + atom(b"stsc", u32(0, 2, 1, 2, 1, 2, 1, 1)) + atom(b"stco", u32(0, 2, at, at + 6)), duration=25)

    head = len(tables(0)) + 8
    data = tables(head) + atom(b"mdat", b"aabbb_cccc")
    (got,) = media.tracks(data)
    assert (got["n_samples"], got["duration_s"]) == (3, 0.025)
    assert [(k["time_s"], data[k["offset"] : k["offset"] + k["size"]]) for k in got["keyframes"]] == [(0.0, b"aa"), (0.015, b"cccc")]
    assert media.tracks(data[:-1])[0]["status"] == "damaged"


def test_a_small_file_that_claims_many_samples():
    import resource

    n = 1 << 25
    claims = [
        atom(b"stts", u32(0, 1, n, 1)) + atom(b"stsz", u32(0, 100, n)) + atom(b"stsc", u32(0, 1, 1, n, 1)) + atom(b"stco", u32(0, 1, 0)),
        atom(b"stts", u32(0, 1, n, 0)) + atom(b"stsz", u32(0, 1, n)) + atom(b"stsc", u32(0, 1, 1, n, 1)) + atom(b"stco", u32(0, 1, 0)),
        atom(b"stts", u32(0, 1, 2, 1)) + atom(b"stsz", u32(0, 1, 2)) + atom(b"stsc", u32(0, 1, 1, 0xFFFFFFFF, 1)) + atom(b"stco", u32(0, 3, 0, 0, 0)),
    ]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = [media.tracks(movie(c))[0]["status"] for c in claims]
    got += [media.tracks(movie(EMPTY, atom(b"mvex", atom(b"trex", u32(0, 1, 1, 1, x, 0)))) + atom(b"moof", atom(b"traf", atom(b"tfhd", u32(0, 1)) + atom(b"trun", u32(0, n)))))[0]["status"] for x in (0, 1)]
    assert got == ["damaged", "damaged", "ok", "damaged", "damaged"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50_000


def test_packed_sample_sizes():
    for field, raw in ((4, bytes([0x12, 0x30])), (8, bytes([1, 2, 3])), (16, struct.pack(">HHH", 1, 2, 3))):
        stbl = mux.full(b"stz2", struct.pack(">II", field, 3) + raw)
        assert media.sample_sizes(memoryview(stbl), (0, len(stbl))).tolist() == [1, 2, 3]


def test_table(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a" * 1000), (None, "x"), (2, None), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit("extra") for c in ("key", "content", "status")})
    got = media.index_tracks(mux.muxed(df, "page_id", "html")).collect()
    assert sorted((r["key"] is None, r["key"] or 0, r["status"]) for r in got if r["handler"] != "soun") == [(False, 1, "ok"), (False, 2, "null"), (False, 3, "ok"), (False, 3, "ok"), (True, 0, "null")]
    assert media.index_tracks(spark.createDataFrame([], "key long, content binary")).collect() == []
