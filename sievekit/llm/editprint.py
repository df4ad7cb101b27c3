"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j, standing on character x, a walker goes on to the next character iff the
random bit r(j, x) is set, and otherwise stays for a step. Written down step by step, the characters under the
walker are the embedding; a few edits between two texts become a few differing steps, as walks that are apart by some characters soon
meet again. A fingerprint samples every STRIDE-th step and keeps 4 bits of a hash of the
four characters from the walker on, as a hexadecimal digit; it ends where the text does, so it covers whole
texts, each part alike, and grows with their length. The likeness of two fingerprints is the share of equal digits,
digits beyond the end of the shorter one counting as different.

with_classes() finds texts of like fingerprints: bands of sampled digits make candidates, which are verified.

Null texts are empty. An empty text has the empty fingerprint; two empty ones are alike (1.0). Documents are ordered by doc_id descending, null ids
last, then by a hash of the text; the last one's next document is the first. Equal rows are neighbours each. A single
document is its own next one. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import buckets
from sievekit.llm.common import release, small, staged
from sievekit.llm.components import components

PERIOD = 1024
GRAM = 4
#: Steps of the walk from sample to sample; a character takes about two.
STRIDE = 8
#: Ranges of doc_id that are sorted on their own: as many as rows ask for, but no more than the driver can hold the bounds of; ranges are larger beyond that.
ROWS_PER_RANGE, MAX_RANGES = 4_000, 20_000
#: Digits of 4 bits that a band samples: 8 of them make a key of 32 bits.
BANDS, BAND_DIGITS = 24, 8
#: Prints of a tile are compared as one array up to this size, beyond it one by one.
SQUARE_BYTES = 64 << 20


def _random(n: int, salt: int):
    import numpy as np

    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walk:
    """The shared walk; its random bits repeat after PERIOD steps and know characters by their code modulo 256."""

    def __init__(self):
        import numpy as np

        bits = (_random(256 * PERIOD, 1) & np.uint64(1)).astype(bool).reshape(256, PERIOD)
        bits[:, PERIOD - 1] = True  # a stay ends with the period at the latest
        stays = np.zeros((256, PERIOD), dtype=np.int64)
        left = np.zeros(256, dtype=np.int64)
        for j in range(PERIOD - 1, -1, -1):
            left = np.where(bits[:, j], 1, left + 1)
            stays[:, j] = left
        self.stays = [bytes(np.minimum(row, 255).astype(np.uint8)) for row in stays]
        self.weights = _random(GRAM, 7) | np.uint64(1)

    def steps(self, letters: bytes, first: int = 0) -> list[int]:
        """The step at which the walker comes to each letter, and where it leaves the last."""
        stays, at, last = self.stays, first, PERIOD - 1
        out = [at]
        add = out.append
        for c in letters:
            at += stays[c][at & last]
            add(at)
        return out

    def digits(self, codes, steps: list[int]) -> str:
        """The fingerprint of a text's code points, whose walk is steps."""
        import numpy as np

        samples = np.arange(0, steps[-1], STRIDE, dtype=np.int64)
        at = np.searchsorted(np.array(steps, dtype=np.int64), samples, side="right") - 1
        padded = np.append(codes, np.zeros(GRAM, dtype=codes.dtype)).astype(np.uint64)
        mixed = np.zeros(len(at), dtype=np.uint64)
        for g in range(GRAM):
            mixed = (mixed + padded[at + g] + np.uint64(1)) * self.weights[g]
            mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)).astype(np.uint8).tobytes().translate(_HEX).decode()

    def fingerprint(self, text: str) -> str:
        codes = code_points(text)
        return self.digits(codes, self.steps(codes.astype("u1").tobytes()))


_HEX = b"0123456789abcdef" + bytes(240)


def code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def likeness(a: str, b: str) -> float:
    import numpy as np

    n, most = min(len(a), len(b)), max(len(a), len(b))
    if not most:
        return 1.0
    x, y = np.frombuffer(a.encode(), dtype=np.uint8), np.frombuffer(b.encode(), dtype=np.uint8)
    return int((x[:n] == y[:n]).sum()) / most


def in_order_with_heads(docs: DataFrame) -> DataFrame:
    """docs doc_id, text -> rows b, ahead, doc_id, packed (the text, compressed), partitioned by b and sorted: the documents of range b in descending order, then (ahead) the one that follows them. Each text is shuffled once, besides one a range."""
    spark = docs.sparkSession
    docs = docs.withColumn("th", F.xxhash64("text"))
    ranges = max(1, min(MAX_RANGES, docs.count() // ROWS_PER_RANGE))
    bounds = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []

    def dealt(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            known = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            b = -np.searchsorted(bounds, np.where(np.isnan(known), -np.inf, known), side="right").astype(np.int32)
            texts = [pack(t.as_buffer()) for t in batch.column(2)] if batch.num_columns > 2 else [b""] * batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(b), batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["b", "doc_id", "th", "packed"])

    placed = "b int, doc_id long, th long, packed binary"
    # one row a range, its first document: MAX_RANGES rows at most
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "th")).alias("x")
    heads = docs.select("doc_id", "th").mapInArrow(dealt, placed).groupBy("b").agg(first).select("b", "x.*").orderBy("b").collect()
    follow = [(h["doc_id"], h["th"], heads[k - 1]["b"]) for k, h in enumerate(heads)]
    extra = F.broadcast(spark.createDataFrame(follow, "head long, head_th long, before int"))
    rows = docs.select("doc_id", "th", F.col("text").cast("binary").alias("text")).mapInArrow(dealt, placed)
    places = F.filter(F.array(F.struct("b", F.lit(False).alias("ahead")), F.struct(F.col("before").alias("b"), F.lit(True).alias("ahead"))), lambda x: x["b"].isNotNull())
    rows = rows.join(extra, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("th") == F.col("head_th")), "left").select("doc_id", "th", "packed", F.explode(places).alias("place"))
    return rows.select("place.*", "doc_id", "th", "packed").repartition("b").sortWithinPartitions("b", "ahead", F.desc_nulls_last("doc_id"), F.desc("th"))


def _compared(batches):
    import pyarrow as pa
    import zstandard

    walk, held, unpack = Walk(), None, zstandard.ZstdDecompressor().decompress
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        out = []
        for b, ahead, doc_id, text in zip(batch["b"].to_pylist(), batch["ahead"].to_pylist(), batch["doc_id"].to_pylist(), batch["packed"]):
            text = unpack(text.as_buffer()).decode("utf-8")
            codes = code_points(text)
            steps = walk.steps(codes.astype("u1").tobytes())
            print_ = walk.digits(codes, steps)
            if held is not None and held[0] == b:
                out.append(_edited(walk, held, text, codes, print_))
                held = None
            if not ahead:
                held = (b, doc_id, text, codes, steps, print_)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=names)


def _edited(walk: Walk, own: tuple, next_text: str, next_codes, next_print: str) -> tuple:
    import numpy as np

    _, doc_id, text, codes, steps, print_ = own
    third = len(text) // 3
    stay = len(text) - third
    edited = text[:stay] + next_text[:third]
    if third:
        put = next_codes[:third]
        walked = steps[:stay] + walk.steps(put.astype("u1").tobytes(), steps[stay])
        edited_print = walk.digits(np.concatenate([codes[:stay], put]), walked)
    else:
        edited_print = print_
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text, and the text with its last third replaced by the start of the next document."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    rows = in_order_with_heads(docs).select("b", "ahead", "doc_id", "packed")
    return rows.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint."""

    def printed(batches):
        import pyarrow as pa

        walk = Walk()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([walk.fingerprint(t.as_py() or "") for t in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(printed, "doc_id long, fingerprint string")


def _records():
    """For each sampled digit the places that are its choice for longer and longer prints: the choice among n places is the last record before n of a random order of all places, so two prints choose alike as often as they overlap."""
    out = []
    for k in range(BANDS * BAND_DIGITS):
        places, at = [], 0
        for x in _random(96, 1000 + (k << 20)).tolist():
            places.append(at)
            at = int((at + 1) / ((x + 1) / 2**64))
            if at >= 1 << 40:
                break
        out.append(places)
    return out


def sampled(text: str) -> list[str]:
    """The digits that each band samples of a print that is not empty. Two prints agree in a sampled digit with the chance of their likeness."""
    from bisect import bisect_left

    n = len(text)
    digits = "".join([text[places[bisect_left(places, n) - 1]] for places in _places()])
    return [digits[k : k + BAND_DIGITS] for k in range(0, len(digits), BAND_DIGITS)]


@functools.cache
def _places():
    return _records()


def _banded(batches):
    import pyarrow as pa
    import xxhash

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            prints = part.column(3).to_pylist()
            keys = [[xxhash.xxh64_intdigest(f"{k}:{x}") for k, x in enumerate(sampled(t) if t else [])] for t in prints]
            signed = [[x - (1 << 64) if x >> 63 else x for x in row] for row in keys]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array(signed, pa.list_(pa.int64())), pa.array([len(t) for t in prints], pa.int64())], names=["row", "node", "doc_id", "bands", "bytes"])


def print_search(least: float):
    """Rows of prints: which others have at least that likeness."""

    def table(data: list):
        import numpy as np

        sizes = np.array([len(x) for x in data])
        rows = [np.frombuffer(x, dtype=np.uint8) for x in data]
        longest = int(sizes.max())
        square = None
        if longest * len(data) <= SQUARE_BYTES:
            square = np.zeros((len(data), longest), dtype=np.uint8)
            for k, x in enumerate(rows):
                square[k, : len(x)] = x

        def alike(k, others):
            most = np.maximum(sizes[others], sizes[k])
            kept = np.minimum(sizes[others], sizes[k]) >= least * most - 1e-9
            left, n = others[kept], int(sizes[k])
            if square is not None:
                same = (square[left, :n] == square[k, :n]).sum(axis=1)
            else:
                same = np.array([int((rows[j][:n] == rows[k][: sizes[j]]).sum()) for j in left], dtype=np.int64)
            kept[kept] = same >= least * most[kept] - 1e-9
            return kept

        return alike

    return table


def with_classes(table: DataFrame, least: float = 0.8) -> DataFrame:
    """table with doc_id and fingerprint (read more than once: staged) -> its columns and class_id: the least doc_id that links of at least that likeness reach, null where that meets null ids only. Candidates share a band of sampled digits; all pairs of a bucket that are not yet in one class are verified, however large it is. Links that share no band are not found (a pair of likeness 0.9 shares none of 24 bands of 8 digits with chance 1e-6, one of 0.8 with 1e-2)."""
    node = F.xxhash64("fingerprint")
    rows = table.select(node.alias("node"), "doc_id", "fingerprint")
    bands = staged(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "node", "doc_id", "fingerprint").mapInArrow(_banded, "row long, node long, doc_id long, bands array<long>, bytes long"))
    # equal prints are one node, that of their first row; only these rows' keys are shuffled, and the prints only of nodes that share a bucket
    firsts = staged(bands.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id")))
    keyed = staged(bands.select("row", "bands", "bytes").join(firsts.select("row", "node"), "row").select(F.explode("bands").alias("key"), "node", "bytes"))
    release(bands)

    def payload(members: DataFrame) -> DataFrame:
        found = rows.join(small(members), "node", "left_semi").select("node", F.col("fingerprint").cast("binary").alias("data"))
        return found.dropDuplicates(["node"])

    near = buckets.links(keyed, payload, print_search(least))
    release(keyed)
    rooted = staged(firsts.select("node", "least_id").join(components(near), "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root")))
    release(firsts, near)
    named = staged(rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("class_id")), "root").select(F.col("node").alias("__node"), "class_id"))
    release(rooted)
    return table.withColumn("__node", node).join(named, "__node").select(*table.columns, "class_id")


def near_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, fingerprint -> doc_id, class_id, as with_classes() has them."""
    return with_classes(staged(prints), least).select("doc_id", "class_id")
