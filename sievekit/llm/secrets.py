"""Secret scans with a randomness test battery, in DataFrame functions only.

Three base patterns (assign, access, hex) are matched leftmost and without overlap, each on its own; their spans always
count. Beside them, maximal tokens of at least MIN_TOKEN encoding characters that no base span overlaps are
tested, if they hold a letter. The encoding is inferred from the characters (hex, base32, base36, base62, base64, or letters only). Three tests measure how
far a token is from random symbols of its encoding: chi-squared uniformity over the alphabet, the number of runs above and below the alphabet's
middle, and the serial correlation of neighbours. Each is standardised by its mean and variance under randomness, exact for the length and alphabet, and
the logarithm of their common distance is the token's score.

A token is a discovery if it is too random to be an ordinary identifier. Its p-value is the chance that an ordinary one (words of natural letter
frequencies in the encoding's style, numbers, separators) scores as low; the distribution is simulated once for each encoding and class of lengths,
with a fixed seed, for the least length of the class, which is the least telling. Benjamini-Hochberg within each class of lengths then
bounds the expected share of ordinary tokens among those reported by FALSE_DISCOVERIES; what passes is a span of kind random.

Null texts are empty: no spans. Positions are code points, end exclusive. Rows that repeat are scanned each; a null doc_id is
kept. Empty tables give no rows. Very long texts and tokens are read whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import staged

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same as AKIA[A-Z0-9]+ of 20 or more characters: a shorter run holds no longer one
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_TOKEN = 6, 20
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters from frequent to rare ones: alphabets are ordered so, which sets ordinary text apart from random symbols in runs and neighbours too.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"
BOTH = "".join(c + c.upper() for c in FREQUENT)
#: Inferred in this order: name, pattern of the whole token, alphabet; then of its ordinary tokens: whether words start with capitals, and what stands between parts.
ENCODINGS = (
    ("hex", "[0-9a-f]+|[0-9A-F]+", DIGITS + "eadcfb", False, ""), ("lower", "[a-z]+", FREQUENT, False, ""), ("base32", "[A-Z2-7]+", FREQUENT.upper() + "234567", False, ""),
    ("base36", "[0-9a-z]+|[0-9A-Z]+", FREQUENT + DIGITS, False, ""), ("letters", "[A-Za-z]+", BOTH, True, ""), ("base62", "[0-9A-Za-z]+", BOTH + DIGITS, True, ""),
    ("base64", "[0-9A-Za-z+/]+", BOTH + DIGITS + "+/", True, "/"), ("base64url", "[0-9A-Za-z_-]+", BOTH + DIGITS + "-_", True, "_"), ("mixed", ".+", BOTH + DIGITS + "+/-_", True, "/"),
)
#: Ordinary tokens: a letter is less frequent than the one before it by this factor (which gives the coincidence of natural languages), words have so many letters, a number of so many digits follows with that chance.
LETTER_DECAY, WORD_LETTERS, NUMBER_DIGITS, NUMBER_CHANCE = 0.877, (3, 9), (1, 4), 0.35
SIMULATED, STEP, TAIL = 2_000, 32, 0.005
#: The least lengths of the classes; longer tokens are in the last one.
CLASSES = (20, 23, 32, 46, 64, 91, 128)
OFFSET = 0.25
#: The expected share of ordinary tokens among those reported.
FALSE_DISCOVERIES = 0.05
BINS, BIN_WIDTH = 240, 0.05
SUM_BLOCK = 256
MASK = "[SECRET]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def starts_of(steps: Column) -> Column:
    """Running sums of an array<int>, by blocks, so that long arrays stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / SUM_BLOCK).cast("int")), lambda b: total(F.slice(steps, b * SUM_BLOCK + 1, SUM_BLOCK)))

    def running(sums: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: F.when(b == 0, 0).otherwise(total(F.slice(sums, 1, b))))
        return let(before, lambda base: F.transform(steps, lambda _, k: F.get(base, F.floor(k / SUM_BLOCK).cast("int")) + total(F.slice(steps, F.floor(k / SUM_BLOCK).cast("int") * SUM_BLOCK + 1, k % SUM_BLOCK + 1))))

    return let(blocks, running)


NO_MATCH = "array<struct<start:int,found:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, found>> of the pattern's leftmost matches without overlap: the texts between them tell where they stand."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        steps = lambda g: F.transform(found, lambda x, k: F.get(g, k) + F.when(k > 0, F.length(F.get(found, k - 1))).otherwise(0))
        located = let(gaps, lambda g: let(steps(g), starts_of))
        return F.when(F.size(found) == 0, F.from_json(F.lit("[]"), NO_MATCH)).otherwise(F.arrays_zip(located.alias("start"), found.alias("found")))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed).cast(NO_MATCH)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (place in KINDS), end>> of the base patterns, sorted."""
    value = lambda found: F.length(F.regexp_extract(found, ASSIGN, 2))
    of = lambda kind, pattern: F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["found"])).alias("end"), (value(m["found"]) if kind == 0 else F.lit(MIN_VALUE)).alias("size")))
    every = F.concat(of(0, ASSIGN), of(1, ACCESS), of(2, HEX))
    return F.transform(F.array_sort(F.filter(every, lambda s: s["size"] >= MIN_VALUE)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the polynomial of Abramowitz and Stegun 26.2.17 (fixed values)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def ordinary_text(encoding: int, rng) -> str:
    """Parts of ordinary identifiers in the style of an encoding, one after the other."""
    import numpy as np

    name, _, alphabet, capitals, between = ENCODINGS[encoding]
    upper = name == "base32"
    letters = [c for c in FREQUENT if c in alphabet.lower()]
    digits = [c for c in alphabet if c.isdigit()]
    share = LETTER_DECAY ** np.arange(len(letters))
    text, size, most = [], 0, SIMULATED * STEP + CLASSES[-1]
    drawn = "".join(rng.choice(letters, size=2 * most, p=share / share.sum()))
    for n, number, figures, capital, at in zip(rng.integers(WORD_LETTERS[0], WORD_LETTERS[1] + 1, most).tolist(), (rng.random(most) < NUMBER_CHANCE).tolist(), rng.integers(NUMBER_DIGITS[0], NUMBER_DIGITS[1] + 1, most).tolist(), (rng.random(most) < 0.7).tolist(), rng.integers(0, most, most).tolist()):
        part = drawn[at : at + n]
        part = part.upper() if upper else part.capitalize() if capitals and capital else part
        if number and digits:
            part += "".join(rng.choice(digits, size=figures))
        text.append(part + between)
        size += len(text[-1])
        if size >= most:
            break
    return "".join(text)


@functools.cache
def calibration() -> tuple[list[float], list[float]]:
    """Mean and deviation of an ordinary token's score for each encoding and class of lengths. The deviation is the larger of the standard one and that which gives the lower TAIL its place."""
    import numpy as np

    rng, means, spreads = np.random.default_rng(17), [], []
    for e in range(len(ENCODINGS)):
        alphabet = ENCODINGS[e][2]
        codes = np.array([alphabet.index(c) for c in ordinary_text(e, rng)])
        for n in CLASSES:
            scores = np.sort(plain_scores(np.stack([codes[k * STEP : k * STEP + n] for k in range(SIMULATED)]), len(alphabet)))
            means.append(float(scores.mean()))
            spreads.append(float(max(scores.std(), (scores.mean() - scores[int(TAIL * SIMULATED)]) / 2.5758)))
    return means, spreads


def plain_scores(values, size: int):
    """battery()'s scores of rows of symbols of an alphabet of that size."""
    import numpy as np

    n = values.shape[1]
    counts = np.stack([(values == v).sum(axis=1) for v in range(size)], axis=1)
    uniform = np.maximum(((counts**2).sum(axis=1) * size / n - n - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n), 0)
    high = values > (size - 1) / 2
    runs = ((high[:, 1:] != high[:, :-1]).sum(axis=1) - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    off = values - values.mean(axis=1, keepdims=True)
    power = (off**2).sum(axis=1)
    serial = np.where(power > 0, ((off[:, 1:] * off[:, :-1]).sum(axis=1) / np.maximum(power, 1e-9) + 1 / n) * np.sqrt(n), np.sqrt(n))
    return np.log(np.sqrt(uniform**2 + runs**2 + serial**2) + OFFSET)


def encoding_of(token: Column) -> Column:
    """The number of the encoding."""
    number = F.lit(len(ENCODINGS) - 1)
    for k in reversed(range(len(ENCODINGS) - 1)):
        number = F.when(token.rlike(f"^(?:{ENCODINGS[k][1]})$"), F.lit(k)).otherwise(number)
    return number


def score(values: Column, size: Column) -> Column:
    """The logarithm of how far symbols are from random ones, in deviations of the three tests."""
    n = F.size(values).cast("double")
    squares = F.aggregate(F.array_distinct(values), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(values, lambda w: w == v)).cast("double"), F.lit(2.0)))
    uniform = F.greatest((squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n), F.lit(0.0))
    middle = (size - 1) / 2
    pairs = lambda body: F.zip_with(F.slice(values, 2, F.size(values) - 1), F.slice(values, 1, F.size(values) - 1), body)
    changes = F.size(F.filter(pairs(lambda b, a: (a > middle) != (b > middle)), lambda x: x))
    runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)

    def correlated(average: Column) -> Column:
        power = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - average) * (v - average))
        shared = F.aggregate(pairs(lambda b, a: (a - average) * (b - average)), F.lit(0.0), lambda a, v: a + v)
        return F.when(power > 0, (shared / power + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))

    serial = let(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n, correlated)
    return F.log(F.sqrt(uniform * uniform + runs * runs + serial * serial) + OFFSET)


def battery(token: Column) -> Column:
    """The chance that an ordinary identifier looks as random as the token; null for a token without a letter."""
    means, spreads = (F.array(*map(F.lit, x)) for x in calibration())
    alphabets = F.array(*[F.lit(x[2]) for x in ENCODINGS])
    folds = F.array(*[F.lit(x[0] in ("hex", "base36")) for x in ENCODINGS])

    def tested(x: Column) -> Column:
        alphabet, cell = F.get(alphabets, x["encoding"]), x["encoding"] * len(CLASSES) + length_class(F.length(x["token"]))
        symbols = let(F.when(F.get(folds, x["encoding"]), F.lower(x["token"])).otherwise(x["token"]), lambda t: F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1))
        return let(symbols, lambda v: normal_tail((F.get(means, cell) - score(v, F.length(alphabet).cast("double"))) / F.get(spreads, cell)))

    return F.when(token.rlike("[A-Za-z]"), let(F.struct(token.alias("token"), encoding_of(token).alias("encoding")), tested))


def length_class(size: Column) -> Column:
    """The place in CLASSES of the last length that is not over the size."""
    number = F.lit(0)
    for k, least in enumerate(CLASSES):
        number = F.when(size >= least, F.lit(k)).otherwise(number)
    return number


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, length class, p>> of the tested tokens that no base span overlaps."""
    free = F.filter(matches(text, TOKEN), lambda m: ~F.exists(base, lambda b: (b["start"] < m["start"] + F.length(m["found"])) & (m["start"] < b["end"])))
    rated = F.transform(free, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["found"])).alias("end"), length_class(F.length(m["found"])).alias("cls"), battery(m["found"]).alias("p")))
    return F.filter(rated, lambda c: c["p"].isNotNull())


def scanned(docs: DataFrame, text: str) -> DataFrame:
    """docs with __base and __tokens added."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    both = let(whole, lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), candidates(t, b).alias("tokens"))))
    # explode keeps what follows from computing this again
    return docs.withColumn("__found", F.explode(F.array(both))).withColumns({"__base": F.col("__found.base"), "__tokens": F.col("__found.tokens")}).drop("__found")


def reporting_levels(scan: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, float]:
    """For each class of lengths the p-value up to which tokens are reported: Benjamini-Hochberg over counts of p-values in BINS bins."""
    p = F.greatest(F.col("t.p"), F.lit(1e-12))
    bins = scan.select(F.explode("__tokens").alias("t")).select(F.col("t.cls").alias("cls"), F.least(F.floor(-F.log10(p) / BIN_WIDTH), F.lit(BINS - 1)).cast("int").alias("bin")).groupBy("cls", "bin").agg(F.count("*").alias("n"))
    smallest_first = Window.partitionBy("cls").orderBy(F.desc("bin"))
    ranked = bins.withColumns({"rank": F.sum("n").over(smallest_first), "all": F.sum("n").over(Window.partitionBy("cls")), "edge": F.pow(F.lit(10.0), -F.col("bin") * BIN_WIDTH)})
    passed = ranked.where(F.col("edge") <= F.col("rank") * rate / F.col("all")).groupBy("cls").agg(F.max("edge").alias("edge"))
    return {r["cls"]: r["edge"] for r in passed.collect()}  # a row for each of CLASSES at most


def all_spans(levels: dict[int, float]) -> Column:
    """Base spans and reported tokens, sorted by start, then kind."""
    level = F.array(*[F.lit(levels.get(k, -1.0)) for k in range(len(CLASSES))])
    kept = F.transform(F.filter(F.col("__tokens"), lambda c: c["p"] <= F.get(level, c["cls"])), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return F.array_sort(F.concat(F.col("__base"), kept))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    scan = staged(scanned(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text").drop("text"))
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base, spans = F.col("__base"), F.col("__spans")
    return scan.withColumn("__spans", all_spans(reporting_levels(scan))).select("doc_id", count(base, 0).alias("n_assign"), count(base, 1).alias("n_access"), count(base, 2).alias("n_hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans"), count(spans, 3).alias("n_random"))


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with every span of its text replaced by MASK; overlapping spans are one. length: a column that is set to the text's new length where a text changed. Null texts stay null; an empty table gives an empty one."""
    # texts are scanned once: what was found is written beside them, and masking reads it back
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = staged(scanned(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), body.alias("body")), "body"))
    spans = all_spans(reporting_levels(marked.select("__tokens")))

    def masked(t: Column, spans: Column) -> Column:
        # a span opens a masked run unless an earlier one reaches over its start; runs end where their last span does
        reach = lambda k: F.aggregate(F.slice(spans, 1, k), F.lit(-1), lambda a, s: F.greatest(a, s["end"]))
        heads = F.filter(F.transform(spans, lambda s, k: F.struct(s["start"].alias("start"), F.when(k > 0, reach(k)).otherwise(F.lit(-1)).alias("before"))), lambda x: x["start"] >= x["before"])
        last = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
        pieces = let(heads, lambda h: F.concat(F.transform(h, lambda x, k: F.substring(t, F.when(k == 0, 1).otherwise(x["before"] + 1), x["start"] - F.when(k == 0, 0).otherwise(x["before"]))), F.array(F.substring(t, last + 1, F.length(t)))))
        return F.array_join(pieces, MASK)

    new = marked.select("own", F.when(F.size(spans) > 0, let(spans, lambda s: masked(F.col("body"), s))).alias("new"))
    own = lambda c: F.col("own").getField(c)
    kind = {f.name: f.dataType for f in docs.schema.fields}
    out = {text: F.coalesce("new", own(text).cast("string"))} | ({length: F.when(F.col("new").isNotNull(), F.length("new").cast(kind[length])).otherwise(own(length))} if length else {})
    return new.select(*[out.get(c, own(c)).alias(c) for c in docs.columns])
