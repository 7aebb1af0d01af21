import struct

import pytest

from verdigris.sources import audio, readers


def wav(rate=8000, seconds=2, before=b"", claimed=None):
    data = bytes(rate * 2 * seconds)
    size = len(data) if claimed is None else claimed
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVE" + before + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", size) + data


def flac(rate=44100, samples=88200):
    bits = rate << 44 | 1 << 41 | 15 << 36 | samples
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(10) + bits.to_bytes(8, "big") + bytes(16) + bytes(5000)


def page(body, ticks):
    return b"OggS\0\0" + struct.pack("<q", ticks) + bytes(12) + bytes([1, min(255, len(body))]) + body


def vorbis(rate=22050, ticks=44100):
    return page(b"\x01vorbis" + struct.pack("<IBI", 0, 1, rate) + bytes(14), 0) + bytes(200_000) + page(bytes(50), ticks) + page(bytes(20), -1)


def opus(ticks=96_312, skip=312):
    return page(b"OpusHead" + bytes([1, 1]) + struct.pack("<HI", skip, 16000) + bytes(3), 0) + bytes(100) + page(bytes(50), ticks)


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def m4a(rate=48000, wide=False, far=300_000):
    clock = lambda s, n: (b"\1\0\0\0" + bytes(16) + struct.pack(">IQ", s, n) if wide else bytes(12) + struct.pack(">II", s, n)) + bytes(80)
    track = lambda kind, s: box(b"trak", box(b"tkhd", bytes(84)) + box(b"mdia", box(b"mdhd", clock(s, 9)) + box(b"hdlr", bytes(8) + kind + bytes(20))))
    return box(b"ftyp", b"M4A ") + box(b"mdat", bytes(far)) + box(b"moov", box(b"mvhd", clock(1000, 2500)) + track(b"vide", 90_000) + track(b"soun", rate))


FILES = {
    "a.wav": (wav(), (8000, 2.0)), "b.wav": (wav(before=b"LIST" + struct.pack("<I", 101) + bytes(102)), (8000, 2.0)), "c.wav": (wav(claimed=0xFFFFFFFF), (8000, 2.0)), "d.wav": (wav(before=b"JUNK" + struct.pack("<I", 90_000) + bytes(90_000)), (8000, 2.0)),
    "e.flac": (flac(), (44100, 2.0)), "f.ogg": (vorbis(), (22050, 2.0)), "g.opus": (opus(), (48000, 2.0)), "h.m4a": (m4a(), (48000, 2.5)), "i.MP4": (m4a(wide=True), (48000, 2.5)),
    "j.wav": (b"junk", None), "k.flac": (b"", None), "l.ogg": (b"OggS" + bytes(40), None), "m.wav": (b"RIFF\0\0\0\0WAVEfmt ", None), "n.mp3": (b"\xff\xfb" * 500, None), "o": (wav(), (8000, 2.0)), "p.wav": (wav(rate=0, seconds=0), None),
}


@pytest.mark.parametrize("name", FILES)
def test_parsers(tmp_path, name):
    data, want = FILES[name]
    (tmp_path / name).write_bytes(data)
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f:
        read, taken = audio.ranged(f)
        got = audio.probe(read, len(data))
    assert got == (pytest.approx(want) if want else None)
    assert taken[0] <= audio.HEAD + audio.TAIL + 48 * audio.MOST_STEPS and (len(data) < 250_000 or taken[0] < len(data))


def test_headers_as_a_table(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, (data, _) in FILES.items():
        (tmp_path / "deep" / name).write_bytes(data)
    spark.dataSource.register(audio.AudioHeaders)
    d = spark.read.format("audio_headers").option("filesPerPartition", 4).load(str(tmp_path))
    assert d.rdd.getNumPartitions() == 4
    got = {r.file_path.rsplit("/", 1)[1]: (r.format, r.sample_rate, r.duration_seconds) for r in d.collect()}
    assert got == {n: (n.rpartition(".")[2].lower() if "." in n else "", *(want or (16000, 0.0))) for n, (_, want) in FILES.items()}
    assert {r.format for r in readers.probe_audio(spark, f"file://{tmp_path}", "*.flac").collect()} == {"flac"}
    with pytest.raises(Exception, match="nowhere"):
        readers.probe_audio(spark, str(tmp_path / "nowhere")).collect()
