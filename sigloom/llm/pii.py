"""Operator 7: personal data by boosted trees over candidate spans.

Validated patterns give the base spans, which always stay. Besides, high-recall generators propose overlapping candidate spans
per kind: addresses with written-out signs, defanged or padded dotted quads, digit groups with other separators, telephone numbers
without a country code, and long mixed runs that may be secrets (a fifth kind, after the four of the base). Each candidate is
described by a few small features: how many digits, whether the kind's check holds, whether it has the base pattern's own mark,
separators, neighbouring characters, and whether a cue word is near.

What the trees learn from isn't the base patterns' verdict on the same features. Positive examples are the corpus's base spans with
their marks and separators masked, in their real context, as the variants of the format that the patterns don't know; for secrets, runs that
are assigned to a name such as "token", once with and once without that context. Negative examples are candidates whose kind's check
fails, those far from cue words in texts without a base span, and runs that nothing assigns. Gradient-boosted trees are grown on every second document; on the others a Platt curve calibrates
them, and each kind's threshold is the lowest at which PRECISION of the examples above it are positive. Candidates over their kind's
threshold that don't overlap a base span are added. Features have few levels, so training needs one aggregation: the counts per cell.

Spans are (kind, start, end) in code points, end exclusive. Where a pattern's repeated group could exhaust the regex engine's stack
on long runs, single characters between digits or labels are marked first and the run is matched as one character class; matches
are the same. Everything runs in the JVM.

Cases: null counts as empty; a text without personal data has no spans and the digest of the empty string; very long texts are
scanned whole; repeated rows get equal results; overlapping spans of different kinds are all reported, and redacted as one; of candidates
with equal probability all or none are added; a kind without examples of both sorts, or whose threshold isn't reached, adds nothing; an
empty table gives an empty result; columns other than those named are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import let, table, written

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
SPAN = "array<struct<k:int,s:int,e:int>>"
#: The share of positive examples among those over a kind's threshold.
PRECISION = 0.95
#: Feature levels; the product bounds the number of cells.
FEATURES = {"k": 5, "digits": 5, "valid": 2, "mark": 2, "left": 4, "right": 4, "sep": 3, "cue": 2}
#: Matches whose places are added up at once; bounds what a fold over a text's matches copies.
RUN = 256
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
CUES = "(?i)(?:mail|contact|write|call|tel|phone|fon|fax|card|visa|account|konto|carte|tarjeta|host|server|ip|addr)"


def located(text: Column, pattern: str) -> Column:
    """The pattern's matches, leftmost and non-overlapping: array of (s, e, m), from the pieces between and the lengths.

    Places are added up within runs of RUN matches and then over the runs, since a fold that appends copies what it has so far.
    """
    kind = "array<struct<s:int,e:int,m:string>>"

    def placed(pairs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.char_length(x["gap"])
            e = s + F.char_length(x["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(pairs, k * RUN + 1, F.lit(RUN)), start, step))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        firsts = lambda r: F.aggregate(r, begin, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        moved = lambda x, by: F.transform(x["out"], lambda m: F.struct((m["s"] + by).alias("s"), (m["e"] + by).alias("e"), m["m"].alias("m")))
        return let(runs, lambda r: F.flatten(F.zip_with(r, firsts(r), moved)))

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    matched = F.filter(pairs, lambda x: x["m"].isNotNull())
    return let(matched, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(kind)))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check; digits are taken from the right, every second one doubled."""

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, F.char_length(d) - i, F.lit(1)).cast("int")
        twice = v * 2
        return total + F.when(i % 2 == 0, v).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.when(F.char_length(d) > 0, F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def grouped_digits(text: Column) -> Column:
    """The text with single blanks and hyphens between digits marked (\\x01), character by character."""
    return F.regexp_replace(F.translate(text, "\x01", "x"), "(?<=[0-9])[ -](?=[0-9])", "\x01")


def dotted_labels(text: Column) -> Column:
    """The text with dots between label characters marked (\\x02), character by character."""
    return F.regexp_replace(F.translate(text, "\x02", " "), f"(?<=[{LABEL}])\\.(?=[{LABEL}])", "\x02")


def only(condition: Column, found: Column, kind: int) -> Column:
    spans = F.transform(found, lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All validated spans, by start, then kind."""
    email = let(dotted_labels(text), lambda t: located(t, rf"(?:(?<![\x02{LOCAL}])|\G)[\x02{LOCAL}]++@[{LABEL}]++\x02[\x02{LABEL}]*+"))
    ip = F.filter(located(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), lambda x: F.forall(F.split(x["m"], r"\."), lambda p: small(p)))
    card = let(grouped_digits(text), lambda t: located(t, r"[0-9](?=[0-9\x01]{13})[0-9\x01]++"))  # shorter runs can't have 14 digits
    card = F.filter(card, lambda x: let(digits(x["m"]), lambda d: F.char_length(d).between(14, 19) & luhn(F.substring(d, 1, 19))))
    phone = F.filter(located(text, r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: F.char_length(digits(x["m"])).between(10, 15))
    return F.array_sort(
        F.concat(
            only(F.contains(text, F.lit("@")), email, 0), only(text.rlike(r"[0-9]\.[0-9]"), ip, 1), only(text.rlike("[0-9][0-9 -]{12}"), card, 2), only(F.contains(text, F.lit("+")), phone, 3)
        ),
        lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]),
    )


def small(part: Column) -> Column:
    """A string of digits of at most 255, however many zeros it starts with."""
    p = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.char_length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(256)) <= 255)


#: kind, pattern, and what a text must hold for the pattern to be tried
GENERATORS = (
    (0, rf"(?<![{LOCAL}])[{LOCAL}]++ ?(?:@|\(at\)|\[at\]) ?[{LABEL}]++(?:\.| ?\(dot\) ?| ?\[dot\] ?)[{LABEL}]*[A-Za-z]", r"@|\(at\)|\[at\]"),
    (1, r"(?<![0-9.])[0-9]++(?: ?\[?\.\]? ?[0-9]++){3}(?![0-9]|\.[0-9])", r"[0-9] ?\[?\.\]? ?[0-9]"),
    (2, r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){13,18}(?![0-9])", "[0-9][0-9 ._/-]{12}"),
    (3, r"(?<![0-9+])(?<![0-9][./-])(?:00[1-9][0-9 ().-]{7,17}[0-9]|\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,6})(?![0-9]|[./-][0-9])", "[0-9]{2}[) ./-]{1,2}[0-9]{3}|00[1-9][0-9]"),
    (SECRET, r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+", "[A-Za-z0-9_+/-]{16}"),
)
#: What gives a run a secret's name, right before it
ASSIGNED = r"(?i)(?:token|secret|passw[a-z]*|pwd|auth|credential|[a-z_-]*key)[a-z_\"' ]*[=:][\"' ]*$"


def char_class(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9.+-]"), 2).otherwise(3)


def holds(kind: int, m: Column, d: Column) -> Column:
    """Whether a candidate passes its kind's check."""
    n = F.char_length(d)
    if kind == 0:
        return m.rlike(r"[A-Za-z]{2}$")
    if kind == 1:
        return F.forall(F.split(F.regexp_replace(m, r"[^0-9.]", ""), r"\."), small)
    if kind == 2:
        return n.between(14, 19) & luhn(F.substring(d, 1, 19))
    if kind == 3:
        return n.between(9, 15) & ~F.regexp_replace(m, "[^0-9]", "").rlike(r"^(\d)\1*$")
    return (n * 8 >= F.char_length(m)) & m.rlike("[A-Za-z]")


def marked(kind: int, m: Column) -> Column:
    """Whether a candidate is written as the base patterns have it."""
    mark = {0: "@", 1: r"^[0-9]+(?:\.[0-9]+){3}$", 2: r"^[0-9](?:[ -]?[0-9])*$", 3: r"^\+", SECRET: "$^"}[kind]
    return m.rlike(mark)


CANDIDATE = ", ".join(f"{x}: int" for x in ("k", "s", "e", *list(FEATURES)[1:], "over", "use"))


def described(kind: int, text: Column, x: Column, m: Column, d: Column) -> dict[str, Column]:
    """The features of a span x of the text that reads m, whose digits are d."""
    n = F.char_length(m) if kind == SECRET else F.char_length(d)
    inner = F.regexp_replace(m, "[^ .-]", "")
    before = F.substring(text, F.greatest(x["s"] - 24, F.lit(0)) + 1, F.least(x["s"], F.lit(24)))
    return {
        "digits": F.when(n <= 8, 0).when(n <= 10, 1).when(n <= 13, 2).when(n <= 19, 3).otherwise(4),
        "valid": holds(kind, m, d).cast("int"),
        "mark": marked(kind, m).cast("int"),
        "left": F.when(x["s"] == 0, 0).otherwise(char_class(F.substring(text, x["s"], F.lit(1)))),
        "right": char_class(F.substring(text, x["e"] + 1, F.lit(1))),
        "sep": F.when(inner == "", 0).when(inner.rlike("^(?: +|-+)$"), 1).otherwise(2),
        "cue": (before.rlike(ASSIGNED) if kind == SECRET else before.rlike(CUES)).cast("int"),
    }


def candidates(text: Column, base: Column) -> Column:
    """All proposed spans with their features, over: whether they overlap a base span, and use: what they are as an example
    (1 positive, 0 negative, 2 positive with and without its context, null none)."""
    out = []
    for kind, pattern, first in GENERATORS:

        def one(x: Column, kind: int = kind) -> Column:
            f = described(kind, text, x, x["m"], x["d"])
            over = F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
            if kind == SECRET:
                use = F.when(f["cue"] == 1, 2).otherwise(0)
            else:
                use = F.when((f["valid"] == 0) | ((F.size(base) == 0) & (f["cue"] == 0)), 0)
            return F.struct(
                F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), *[v.alias(name) for name, v in f.items()], over.cast("int").alias("over"), F.when(~over, use).cast("int").alias("use"),
            )

        found = F.transform(located(text, pattern), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), digits(x["m"]).alias("d")))
        out.append(F.when(text.rlike(first), F.transform(found, lambda x: one(x))).otherwise(F.array().cast(f"array<struct<{CANDIDATE}>>")))
    return F.concat(*out)


def masked(text: Column, base: Column) -> Column:
    """The base spans as positive examples: their features without the marks and separators that the base patterns know.

    A telephone number is masked to its digits after the country code, so it counts as many digits less as that mostly has.
    """
    kinds = []
    for kind in range(SECRET):

        def one(x: Column, kind: int = kind) -> Column:
            m = F.substring(text, x["s"] + 1, x["e"] - x["s"])
            bare = F.regexp_replace(m, r"^\+[0-9]{1,3}[ ().-]+", "") if kind == 3 else m
            f = described(kind, text, x, bare, digits(bare))
            f |= {"mark": F.lit(0), "valid": F.lit(1)} | ({"sep": F.lit(2)} if kind != 3 else {})
            return F.struct(F.lit(kind).alias("k"), *[v.alias(name) for name, v in f.items()])

        kinds.append(F.transform(F.filter(base, lambda x, kind=kind: x["k"] == kind), lambda x: one(x)))
    return F.concat(*kinds)


@dataclass
class Model:
    """Boosted depth-two trees over the features' levels, and the curve and bound of their calibration."""

    trees: list[tuple] = field(default_factory=list)
    bounds: dict[int, float] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    start: float = 0.0

    def value(self, cell: dict) -> float:
        return self.start + sum(_leaf(t, cell) for t in self.trees)

    def probability(self, x: Column) -> Column:
        total = F.lit(self.start)
        for t in self.trees:
            total = total + _leaf_column(t, x)
        return 1 / (1 + F.exp(-(self.slope * total + self.shift)))


def _leaf(tree, cell: dict) -> float:
    while isinstance(tree, tuple):
        name, level, yes, no = tree
        tree = yes if cell[name] == level else no
    return tree


def _leaf_column(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, level, yes, no = tree
    return F.when(x[name] == level, _leaf_column(yes, x)).otherwise(_leaf_column(no, x))


def _grow(cells: list[tuple], depth: int, rate: float):
    """cells: (features, gradient, curvature). The split with the largest gain, as one level against the others."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (1e-6, None)
    if depth:
        for name, levels in FEATURES.items():
            for level in range(levels):
                gy = sum(c[1] for c in cells if c[0][name] == level)
                hy = sum(c[2] for c in cells if c[0][name] == level)
                gain = gy * gy / (hy + 1) + (g - gy) ** 2 / (h - hy + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (name, level))
    if best[1] is None:
        return -rate * g / (h + 1)
    name, level = best[1]
    return (name, level, _grow([c for c in cells if c[0][name] == level], depth - 1, rate), _grow([c for c in cells if c[0][name] != level], depth - 1, rate))


def fit(cells: list[dict], rounds: int = 40, rate: float = 0.3) -> Model:
    """cells: features, fold, n (examples) and ones (positive ones). Fold 0 grows trees, fold 1 calibrates and sets the thresholds."""
    sigmoid = lambda v: 1 / (1 + math.exp(-max(-60, min(60, v))))
    grow = [c for c in cells if c["fold"] == 0]
    n, ones = sum(c["n"] for c in grow), sum(c["ones"] for c in grow)
    model = Model(start=math.log((ones + 0.5) / (n - ones + 0.5)))
    if not 0 < ones < n:
        return model
    value = [model.start] * len(grow)
    for _ in range(rounds):
        p = [sigmoid(v) for v in value]
        tree = _grow([(c, c["n"] * q - c["ones"], c["n"] * q * (1 - q)) for c, q in zip(grow, p)], 3, rate)
        model.trees.append(tree)
        value = [v + _leaf(tree, c) for v, c in zip(value, grow)]
    check = [(model.value(c), c["n"], c["ones"], c["k"]) for c in cells if c["fold"] == 1]
    for _ in range(50 if check else 0):  # Newton steps for the slope and shift of the calibration curve
        ga = gb = haa = hab = hbb = 0.0
        for v, n_, k, _ in check:
            q = sigmoid(model.slope * v + model.shift)
            d, w = n_ * q - k, n_ * q * (1 - q)
            ga, gb, haa, hab, hbb = ga + d * v, gb + d, haa + w * v * v, hab + w * v, hbb + w
        haa, hbb = haa + 1e-3, hbb + 1e-3
        ga += 1e-3 * (model.slope - 1)
        det = haa * hbb - hab * hab
        if det < 1e-9:
            break
        model.slope -= max(-1, min(1, (hbb * ga - hab * gb) / det))
        model.shift -= max(-1, min(1, (haa * gb - hab * ga) / det))
    for kind in range(len(KINDS)):
        seen = sorted(((sigmoid(model.slope * v + model.shift), n_, k) for v, n_, k, own in check if own == kind), reverse=True)
        all_ = right = 0
        for j, (q, n_, k) in enumerate(seen):
            all_, right = all_ + n_, right + k
            below = seen[j + 1][0] if j + 1 < len(seen) else 0.0
            if below < q and right >= PRECISION * all_ and right > 0 and q >= 0.5:
                model.bounds[kind] = max(0.5, (q + below) / 2)  # between the examples over it and those under it
    return model


def examples(found: DataFrame) -> DataFrame:
    """fold, features and y of every example; found: doc_id, cands and masks."""
    names = list(FEATURES)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")
    cands = found.select(fold, F.explode("cands").alias("c")).filter("c.use is not null")
    own = [F.col(f"c.{x}").alias(x) for x in names]
    seen = cands.select("fold", *own, (F.col("c.use") > 0).cast("int").alias("y"))
    # without its context: a secret that isn't assigned to a name
    bare = cands.filter("c.use = 2").select("fold", *[F.lit(0).alias(x) if x == "cue" else c for x, c in zip(names, own)], F.lit(1).alias("y"))
    masks = found.select(fold, F.explode("masks").alias("c")).select("fold", *own, F.lit(1).alias("y"))
    return seen.unionByName(bare).unionByName(masks)


def learned(found: DataFrame) -> Model:
    """found: doc_id, cands and masks. One aggregation over all examples, into a bounded number of cells."""
    names = list(FEATURES)
    cells = examples(found).groupBy("fold", *names).agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    return fit([r.asDict() for r in cells.orderBy("fold", *names).collect()])


def all_spans(base: Column, cands: Column, model: Model) -> Column:
    """Base spans and the candidates that are added to them, by start, then kind, then end."""
    if not model.bounds:
        return base
    bound = F.create_map(*[F.lit(x) for kind, b in model.bounds.items() for x in (kind, b)])
    added = F.filter(cands, lambda x: (x["over"] == 0) & (model.probability(x) >= F.coalesce(F.get(F.map_values(F.map_filter(bound, lambda k, v: k == x["k"])), F.lit(0)), F.lit(2.0))))
    added = F.transform(added, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return F.array_sort(F.concat(base, added), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(a["e"] - b["e"]))


def written_spans(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of spans replaced by its first span's kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.array(F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.get(names, x["k"]))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, end))


def found_in(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, base spans, candidates and masked examples of every row. The text and its base spans are bound once: the
    expressions over candidates look at them for each."""

    def described_text(t: Column) -> Column:
        return let(base_spans(t), lambda b: F.struct(b.alias("base"), candidates(t, b).alias("cands"), masked(t, b).alias("masks")))

    found = let(F.coalesce(F.col(text), F.lit("")), described_text)
    return docs.select(*keep, found.alias("_found")).select(*keep, "_found.base", "_found.cands", "_found.masks")


def redaction(text: Column, model: Model) -> Column:
    """The text with its personal data replaced; everything that is looked at more than once is bound once."""
    spans = lambda t: let(base_spans(t), lambda b: let(candidates(t, b), lambda c: all_spans(b, c, model)))
    return let(F.coalesce(text, F.lit("")), lambda t: let(spans(t), lambda s: redacted(t, s)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base spans and all its spans."""
    found = written(found_in(table(spark, sf_dir, "documents"), ["doc_id"]), "candidates")
    spans = all_spans(F.col("base"), F.col("cands"), learned(found))
    counts = [F.size(F.filter("base", (lambda k: lambda x: x["k"] == k)(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:SECRET])]
    return found.select("doc_id", *counts, F.col("base"), spans.alias("all")).select(
        "doc_id", *[f"n_{name}" for name in KINDS[:SECRET]], F.sha2(written_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written_spans(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"),
    )
