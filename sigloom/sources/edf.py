"""European Data Format recordings (the published format): header, signals, and the de-identified patient field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: widths of a signal's header fields, in order
SIGNAL = (("label", 16), ("transducer", 80), ("unit", 8), ("phys_min", 8), ("phys_max", 8), ("dig_min", 8), ("dig_max", 8), ("filter", 80), ("samples", 8), ("reserved", 32))


def decode(data: bytes) -> tuple[dict, list[dict], list[np.ndarray]]:
    text = lambda a, n: data[a : a + n].decode("latin-1").strip()
    head = {"patient": text(8, 80), "recording": text(88, 80), "date": text(168, 8), "time": text(176, 8), "bytes": int(text(184, 8)), "records": int(text(236, 8)), "duration": float(text(244, 8)), "signals": int(text(252, 4))}
    n, at, signals = head["signals"], 256, [{} for _ in range(head["signals"])]
    for name, width in SIGNAL:
        for s in signals:
            value = text(at, width)
            s[name] = float(value) if name in ("phys_min", "phys_max", "dig_min", "dig_max") else int(value) if name == "samples" else value
            at += width
    per = [s["samples"] for s in signals]
    raw = np.frombuffer(data, "<i2", (len(data) - head["bytes"]) // 2, head["bytes"])
    records = min(head["records"] if head["records"] >= 0 else 1 << 60, len(raw) // max(1, sum(per)))
    raw = raw[: records * sum(per)].reshape(records, sum(per))
    out, at = [], 0
    for s in signals:
        gain = (s["phys_max"] - s["phys_min"]) / ((s["dig_max"] - s["dig_min"]) or 1)
        out.append((raw[:, at : at + s["samples"]].reshape(-1).astype(float) - s["dig_min"]) * gain + s["phys_min"])
        at += s["samples"]
    head["records"], head["signals"] = records, n
    return head, signals, out


def masked_patient(patient: Column) -> Column:
    """"number sex birthdate name" as "sex birth-year initials": the number and the day of birth go."""
    parts = F.split(patient, r"\s+")
    year = F.regexp_extract(F.try_element_at(parts, F.lit(3)), r"(\d{4})$", 1)
    initials = F.array_join(F.transform(F.split(F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("")), "[_, ]+"), lambda p: F.upper(F.substring(p, 1, 1))), "")
    return F.concat_ws(" ", F.upper(F.substring(F.try_element_at(parts, F.lit(2)), 1, 1)), year, initials)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Block rows with the patient field as it stands (mask it with masked_patient before it is kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                head, signals, x = decode(data)
                cols = [[p] * len(x), [head["patient"]] * len(x), [s["label"] for s in signals], [s["unit"] for s in signals], [s["samples"] / head["duration"] for s in signals], x]
                kinds = [pa.string()] * 4 + [pa.float64(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "patient", "channel", "units", "fs", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, patient string, channel string, units string, fs double, values array<double>")
