"""Recording formats from files that the tests write, simulated signals, and sinks."""

import struct

import numpy as np

from sigloom.sources import acq, edf, emt, simulated, sinks


def write_acq(path, version=41):
    def fields(layout, values):
        out = b""
        for name, code, count, since in layout:
            if since and version < since:
                continue
            v = values.get(name, 0 if code != "s" else "")
            out += v.encode().ljust(count, b"\0") if code == "s" else struct.pack(f"<{count}{code}", *(v if isinstance(v, tuple) else (v,) * count))
        return out

    a, b = np.arange(12, dtype="<i2"), np.arange(6) * 1.5
    data = fields(acq.HEADER, {"version": version, "channels": 2, "sample_time": 2.0})
    data += fields(acq.CHANNEL, {"name": "fast", "samples": 12, "ampl_scale": 0.5, "ampl_offset": 9.0, "divider": 1, "units": "mV"})
    data += fields(acq.CHANNEL, {"name": "slow", "samples": 6, "ampl_scale": 1.0, "divider": 2})
    data += struct.pack("<hh", 4, 0) + struct.pack("<hh", 2, 2) + struct.pack("<hh", 8, 1)
    for k in range(6):
        data += a[2 * k : 2 * k + 1].tobytes() + struct.pack("<d", b[k]) + a[2 * k + 1 : 2 * k + 2].tobytes()
    data += struct.pack("<ii", 40, 1) + struct.pack("<ihhhh", 7, 0, 0, 0, 5) + b"start\0"
    path.write_bytes(data)


def test_acq(spark, tmp_path):
    write_acq(tmp_path / "x.acq")
    rows = {r["channel"]: r for r in acq.read(spark, str(tmp_path / "x.acq")).collect()}
    assert rows["fast"]["values"] == [k * 0.5 for k in range(12)] and rows["fast"]["fs"] == 500 and rows["fast"]["units"] == "mV"
    assert rows["slow"]["values"] == [k * 1.5 for k in range(6)] and rows["slow"]["fs"] == 250
    assert [(r["sample"], r["text"]) for r in acq.markers(spark, str(tmp_path / "x.acq")).collect()] == [(7, "start")]


def test_edf(spark, tmp_path):
    pad = lambda v, n: str(v).encode().ljust(n)
    head = pad("0", 8) + pad("MRN123 F 02-MAY-1951 Haagse_Harry", 80) + pad("rec", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 + 512, 8) + pad("", 44) + pad(2, 8) + pad(1, 8) + pad(2, 4)
    values = {"label": ("C3", "C4"), "unit": ("uV", "uV"), "phys_min": (-100, -50), "phys_max": (100, 50), "dig_min": (-1000, -1000), "dig_max": (1000, 1000), "samples": (4, 2)}
    for name, width in edf.SIGNAL:
        for k in range(2):
            head += pad(values.get(name, ("", ""))[k], width)
    body = np.arange(12, dtype="<i2") * 10
    (tmp_path / "x.edf").write_bytes(head + body.tobytes())
    df = edf.read(spark, str(tmp_path / "x.edf"))
    rows = {r["channel"]: r for r in df.collect()}
    assert np.allclose(rows["C3"]["values"], np.array([0, 1, 2, 3, 6, 7, 8, 9.0])) and rows["C3"]["fs"] == 4
    assert np.allclose(rows["C4"]["values"], np.array([4, 5, 10, 11]) * 0.5)
    assert df.select(edf.masked_patient(df["patient"]).alias("p")).first()["p"] == "F 1951 HH"


def test_emt(spark, tmp_path):
    rows = "\n".join(f"\t{k + 1}\t{k * 0.001:.3f}\t{k * 0.5:.4f}\t{-k * 0.25:.4f}" for k in range(10))
    (tmp_path / "x.emt").write_text(f"BTS ASCII format\nType:\tEmg\nMeasure unit:\tmV\n\nTracks:\t2\nFrequency:\t1000 [Hz]\nFrames:\t10\n\n\tFrame\tTime\tEMG Signal 1\tEMG Signal 2\t\n{rows}\n")
    (tmp_path / "y.emt").write_text("")
    df = emt.read(spark, str(tmp_path))
    assert df.count() == 20 and df.filter("channel = 'EMG Signal 2' and frame = 3").first()["value"] == -0.5
    m = emt.muscle(df)
    got = m.filter("channel = 'emg1' and frame = 2").first()
    assert got["value"] == 500 and got["fs"] == 1000 and got["unit"] == "uV"


def test_simulated(spark):
    df = simulated.batch(spark, ["10Hz", "10HzN3", "10HzSquare", "ref"], 128, 2).cache()
    assert df.count() == 4 * 256 and df.filter("channel = 'ref'").agg({"value": "max"}).first()[0] == 0
    x = np.array([r["value"] for r in df.filter("channel = '10Hz'").orderBy("sample_no").collect()])
    assert np.abs(np.fft.rfft(x)).argmax() == 20
    m = simulated.mixture(spark).groupBy("source").agg({"value": "avg"}).collect()
    assert len(m) == 4 and all(abs(r[1]) < 1e-9 for r in m)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 128.0, [1.0]), (1, "b", 128.0, [2.0]), (1, "c", 64.0, [3.0])], "segment int, channel string, fs double, values array<double>")
    sinks.export(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("segment = 1 and channel = 'b'").count() == 1
    assert sinks.merged_by_rate(df, ["a", "b", "c"]).count() == 2
    assert sinks.save_if_changed(df, str(tmp_path), "v") and not sinks.save_if_changed(df, str(tmp_path), "v")


def write_nicolet(path):
    """Two segments of two seconds, channels A (4 Hz) and B (2 Hz) whose samples lie in two sections each, and two events."""
    import uuid

    from sigloom.sources import nicolet as n

    w = lambda s, size: s.encode("utf-16-le").ljust(size, b"\0")
    chan = lambda name, ref, fs, scale: (w(name, 64) + b"\0" * 128 + w(ref, 8) + b"\0" * 56 + struct.pack("<4d", 0.5, 30, fs, scale)).ljust(552, b"\0")
    channels = b"\0" * 752 + struct.pack("<II", 2, 2) + chan("A", "R", 4.0, 0.5) + chan("B", "R", 2.0, 2.0)
    segs = b"".join(struct.pack("<3d", day, 0, 2.0).ljust(152, b"\0") for day in (45000.0, 45000.5))
    packet = uuid.UUID(n.CHANNELS_GUID).bytes_le + struct.pack("<2d2Q", 1.0, 0, 0, len(channels))

    def event(kind, day, text):
        body = n.EVENT_GUID.bytes_le + b"\0" * 8 + b"\0" * 8 + struct.pack("<3d", day, 3.0, 1.5) + b"\0" * 48 + w("me", 24) + struct.pack("<Q", len(text)) + uuid.UUID(kind).bytes_le + b"\0" * 16 + w("lab", 64) + b"\0" * 32 + w(text, 2 * len(text))
        return body[:16] + struct.pack("<Q", len(body)) + body[24:]

    kinds = list(n.EVENTS)
    a, b = np.arange(16, dtype="<i2"), np.arange(100, 108, dtype="<i2")
    parts = {
        "InfoChangeStream": [packet], "SegmentStream": [segs], n.CHANNELS_GUID: [channels],
        "Events": [event(kinds[0], 45000.25, "Eyes OPEN") + event(kinds[1], 45000.75, "")], "0": [a[:5].tobytes(), a[5:].tobytes()], "1": [b[:3].tobytes(), b[3:].tobytes()],
    }
    out = bytearray(n.ENTRIES_AT + 64)
    entries, tags = [], {}
    for k, (tag, blobs) in enumerate(parts.items()):
        tags[tag] = k
        for blob in blobs:
            entries.append((k, len(out), 0, len(blob)))
            out += blob
    struct.pack_into("<I", out, n.TAGS_AT, len(tags))
    for k, (tag, number) in enumerate(tags.items()):
        out[n.TAGS_AT + 4 + 84 * k : n.TAGS_AT + 88 + 84 * k] = w(tag, 80) + struct.pack("<I", number)
    struct.pack_into("<I", out, n.ENTRIES_AT, len(entries))
    struct.pack_into("<I", out, n.INDEX_AT, len(out))
    first = entries[:4]
    second_at = len(out) + 8 + 24 * len(first) + 8
    out += struct.pack("<Q", len(first)) + b"".join(struct.pack("<QQII", *e) for e in first) + struct.pack("<Q", second_at)
    out += struct.pack("<Q", len(entries) - 4) + b"".join(struct.pack("<QQII", *e) for e in entries[4:]) + struct.pack("<Q", 0)
    path.write_bytes(bytes(out))


def test_nicolet(spark, tmp_path):
    from sigloom.sources import nicolet as n

    write_nicolet(tmp_path / "x.e")
    p = str(tmp_path / "x.e")
    heads = n.segments(spark, p)
    assert heads.count() == 4 and {(r["channel"], r["fs"], r["n"]) for r in heads.collect()} == {("A", 4.0, 8), ("B", 2.0, 4)}
    got = {(r["segment"], r["channel"]): r["values"] for r in n.read(spark, p).collect()}
    assert got[1, "A"] == [k * 0.5 for k in range(8)] and got[2, "A"] == [k * 0.5 for k in range(8, 16)] and got[2, "B"] == [2.0 * k for k in range(104, 108)]
    cut = n.read(spark, p, [2], ["a"], 0.5, 1.5).collect()
    assert len(cut) == 1 and cut[0]["values"] == [k * 0.5 for k in range(10, 14)]
    found = n.annotations(n.events(spark, p), heads, "eyes open").collect()
    assert len(found) == 1 and found[0]["segment"] == 1 and found[0]["offset"] == 0.25 * 86400 + 3 and found[0]["user"] == "me"
    assert [r["kind"] for r in n.events(spark, p).orderBy("time").collect()] == ["Annotation", "Seizure"]
    start = heads.filter("segment = 2").first()["start"]
    around = {r["channel"]: r["values"] for r in n.retrieve(n.read(spark, p), start + 1, 0.5, 0.5, exclude="^B").collect()}
    assert around == {"A": [k * 0.5 for k in range(10, 14)]}
