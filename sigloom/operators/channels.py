"""Channel selection and reshaping: lookups, masks, epochs, labels, montages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_positions(wanted: DataFrame, channels: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """wanted (name) with the first position of an equal name, whatever its case, or 0. channels: name, pos."""
    first = channels.groupBy(F.lower(name).alias("_k")).agg(F.min(pos).alias("first"))
    return wanted.withColumn("_k", F.lower(name)).join(first, "_k", "left").withColumn("first", F.coalesce("first", F.lit(0))).drop("_k")


def matching(channels: DataFrame, patterns: Sequence[str], name: str = "name") -> DataFrame:
    """All channels that a pattern finds, per pattern: the patterns (a short literal list) are tried row by row, without a join."""
    tries = F.array(*[F.struct(F.lit(k + 1).alias("pattern_no"), F.col(name).rlike(f"(?i){p}").alias("hit")) for k, p in enumerate(patterns)])
    return channels.withColumn("_t", F.explode(F.filter(tries, lambda t: t["hit"]))).withColumn("pattern_no", F.col("_t.pattern_no")).drop("_t")


def mask(channels: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """Every channel with whether it is wanted."""
    names = wanted.select(F.lower(name).alias("_k"), F.lit(True).alias("_w")).distinct()
    return channels.withColumn("_k", F.lower(name)).join(names, "_k", "left").withColumn("wanted", F.coalesce("_w", F.lit(False))).drop("_k", "_w")


def without(channels: DataFrame, dropped: DataFrame, name: str = "name") -> DataFrame:
    """Channels whose upper-cased name is not among the dropped ones."""
    names = dropped.select(F.upper(name).alias("_k")).distinct()
    return channels.withColumn("_k", F.upper(name)).join(names, "_k", "left_anti").drop("_k")


def stacked(epochs: DataFrame, by: Sequence[str], epoch: str = "epoch_id", values: str = "values") -> DataFrame:
    """Epochs of equal length laid end to end: idx from 1 over the whole series."""
    return epochs.select(*by, epoch, F.size(values).alias("_n"), F.posexplode(values).alias("_p", "value")).select(*by, epoch, ((F.col(epoch) - 1) * F.col("_n") + F.col("_p") + 1).cast("long").alias("idx"), "value")


def unstacked(series: DataFrame, by: Sequence[str], n: int, idx: str = "idx", value: str = "value") -> DataFrame:
    """The way back: epochs of n samples as arrays; a length that n doesn't divide is an error."""
    epoch = (F.floor((F.col(idx) - 1) / n) + 1).cast("long").alias("epoch_id")
    values = F.transform(F.array_sort(F.collect_list(F.struct(idx, value))), lambda x: x[value])
    out = series.groupBy(*by, epoch).agg(values.alias("values"))
    return out.withColumn("values", F.when(F.size("values") == n, F.col("values")).otherwise(F.raise_error(F.lit(f"the series is not a multiple of {n} samples")).cast("array<double>")))


def flattened(trial: Column) -> Column:
    """A trial's array of channel arrays as one array, channels fastest."""
    n = F.size(trial[0])
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.transform(trial, lambda c: F.get(c, t))))


def interleaved(df: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the first half at odd places, of the second half at even ones, both in order: adds `place`, from 1."""
    w = Window.partitionBy(*by).orderBy(order)
    r, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by))
    half = F.floor(n / 2 + 0.5)
    return df.withColumn("place", F.when(r <= half, 2 * r - 1).otherwise(2 * (r - half)).cast("long"))


def label_numbers(df: DataFrame, label: str, out: str = "label_no") -> DataFrame:
    """Labels numbered from 1 in sorted order, nulls left null. The labels themselves are few: their distinct values are ranked and
    joined back, so the rows aren't brought to one task."""
    names = df.select(label).filter(F.col(label).isNotNull()).distinct()
    numbered = names.withColumn(out, F.row_number().over(Window.orderBy(label)).cast("long"))
    return df.join(numbered, label, "left")


def mutual_labels(a: DataFrame, b: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose label both sides have."""
    return a.join(b.select(label).distinct(), label, "left_semi"), b.join(a.select(label).distinct(), label, "left_semi")


def whitelisted(train: DataFrame, test: DataFrame, label: str, wanted: Sequence) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides whose label is wanted and occurs in both. wanted: a short list."""
    listed = [t.filter(F.col(label).isin(list(wanted))) for t in (train, test)]
    return mutual_labels(*listed, label)


def subset(df: DataFrame, names: Sequence[str] | None = None, first: float | None = None, last: float | None = None, channel: str = "ch", idx: str = "i") -> DataFrame:
    """Samples of the named channels (all if None) from first to last, both included: plain predicates, so they reach the scan."""
    out = df if names is None else df.filter(F.col(channel).isin(list(names)))
    out = out if first is None else out.filter(F.col(idx) >= first)
    return out if last is None else out.filter(F.col(idx) <= last)


def equal_cells(a: Column, b: Column) -> Column:
    """Whether two arrays have the same length and equal elements; nulls equal nulls."""
    same = F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x)
    return F.when(F.size(a) == F.size(b), same).otherwise(False)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def zero_filled(present: DataFrame, full: DataFrame, name: str, value: str) -> DataFrame:
    """Every name of `full` with its value, 0 where it is missing, over the largest magnitude."""
    top = present.agg(F.max(F.abs(value)).alias("_top"))
    return full.join(present, name, "left").crossJoin(F.broadcast(top)).select(name, (F.coalesce(F.col(value), F.lit(0.0)) / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)).alias("scaled"))


# fixed values: channel names of the amplifiers' sockets and of common caps, in order
FIRST = "Cz Fp1 Fpz Fp2 F7 F3 Fz F4 F8 FC5 FC1 FC2 FC6 M1 T7 C3 C4 T8 M2 CP5 CP1 CP2 CP6 P7 P3 Pz P4 P8 POz O1 Oz O2 D1"
SECOND = "Cz AF7 AF3 AFz AF4 AF8 F5 F1 F2 F6 FC3 FCz FC4 C5 C1 C2 C6 CP3 CPz CP4 P5 P1 P2 P6 PO3 PO4 FT7 FT8 TP7 TP8 PO7 PO8 D2"
CAP = "FP1 FZ F3 F7 FT9 FC5 FC1 C3 T7 M1 CP5 CP1 PZ P3 P7 O1 OZ O2 P4 P8 M2 CP6 CP2 CZ C4 T8 FT10 FC6 FC2 F4 F8 FP2 D1 DIAG"
FULL = (
    "Fp1 Fpz Fp2 AF7 AF3 AFz AF4 AF8 F9 F7 F5 F3 F1 Fz F2 F4 F6 F8 F10 FT9 FT7 FC5 FC3 FC1 FCz FC2 FC4 FC6 FT8 FT10 T7 C5 C3 C1 Cz C2 C4 C6 T8 "
    "TP9 TP7 CP5 CP3 CP1 CPz CP2 CP4 CP6 TP8 TP10 P9 P7 P5 P3 P1 Pz P2 P4 P6 P8 P10 PO7 PO3 POz PO4 PO8 O1 Oz O2"
)
#: Numbered sockets, and both amplifiers together, follow by rule.
NUMBERED = {k: " ".join(f"{x}{n}" for n in range(1, 33)) + f" D{k}" for k, x in ((1, "A"), (2, "B"))}
MONTAGES = {
    "amplifier 1": f"{FIRST} DIAG",
    "amplifier 2": f"{SECOND} DIAG",
    "both amplifiers": f"{FIRST} {SECOND} DIAG",
    "amplifier 1, numbered": f"{NUMBERED[1]} DIAG",
    "amplifier 2, numbered": f"{NUMBERED[2]} DIAG",
    "both amplifiers, numbered": f"{NUMBERED[1]} {NUMBERED[2]} DIAG",
    "cap (32)": CAP,
    "combinatorial nomenclature": FULL,
}


def montage_table(spark: SparkSession, montages: dict[str, str] | None = None) -> DataFrame:
    """montage, position, channel."""
    rows = [(m, k + 1, c) for m, names in (montages or MONTAGES).items() for k, c in enumerate(names.split())]
    return spark.createDataFrame(rows, "montage string, position int, channel string")


def amplifier_channels(spark: SparkSession, names: Sequence[str], per_amplifier: int = 32) -> DataFrame:
    """position, name of the entries of a two-amplifier channel list: the first word of each, or A1, A2, ... B1, ... where it is blank."""
    df = spark.createDataFrame([(k + 1, x) for k, x in enumerate(names)], "position int, entry string")
    word = F.regexp_extract("entry", r"([A-Za-z0-9]+)", 1)
    amp = F.when(F.col("position") <= per_amplifier, "A").otherwise("B")
    number = F.when(F.col("position") <= per_amplifier, F.col("position")).otherwise(F.col("position") - per_amplifier)
    return df.select("position", F.coalesce(F.nullif(word, F.lit("")), F.concat(amp, number.cast("string"))).alias("name"))


def found_coordinates(wanted: DataFrame, positions: DataFrame) -> DataFrame:
    """wanted (x, y) with the position that has just these coordinates; null where none or several have. positions: pos, x, y."""
    one = positions.groupBy("x", "y").agg(F.count("*").alias("_n"), F.min("pos").alias("pos"))
    return wanted.join(one, ["x", "y"], "left").withColumn("pos", F.when(F.col("_n") == 1, F.col("pos"))).drop("_n")
