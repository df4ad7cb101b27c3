"""SimHash near-duplicates through pivot distance tables.

Fingerprints: bits over word shingles hashed with XXH64; equal ones are one node. Every bucket of nodes has a pivot
table: the precomputed Hamming distances of its fingerprints to many reference fingerprints. By the triangle inequality two
fingerprints within r bits are within r in every coordinate, so pairs that differ by more than r in the largest coordinate difference are
discarded, and the survivors are verified on the fingerprints themselves.

Which pairs a table has to look at: the 64 bits are cut into max_bits + 1 blocks, and fingerprints within max_bits bits
agree in one of them at least, so nodes that share a block are a bucket. That cut loses no pair and is coarse (21 bits a
block for 2 bits); what it leaves is for the pivots to discard.

near_copies() links whole texts at a Jaccard likeness of 0.8 of their five-word shingles. Such pairs differ in up to a third of their
fingerprints' bits, where no block is left that they share for certain: its buckets are bands of least shingle hashes, its fingerprints
have 256 bits, its pivots are members of the bucket, and survivors are verified on the whole shingle sets.

Documents without words have the fingerprint zero and are linked like any other; null texts are empty. A null
doc_id keeps its fingerprint; its component_id is the least non-null doc_id that it reaches, or null. Repeated
doc_ids are one node each time. Very long texts are hashed in chunks. Empty tables give no rows. Columns of any other name pass
or are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import buckets
from sievekit.llm.common import release, small, staged
from sievekit.llm.components import components

WORDS, SEED = 3, 42
MAX_BITS = 2
#: Reference fingerprints of a table, from multiples of an odd constant.
PIVOTS = 16
CHUNK = 1 << 17

#: near_copies: words of a shingle, least likeness, bands of so many minima. A pair of likeness 0.8 shares no band with chance 3e-4, one of 0.9 with 2e-8.
NEAR_WORDS, LEAST = 5, 0.8
BANDS, BAND_ROWS = 20, 5
#: Words of 64 bits of its fingerprints; how many of these bits two sets of likeness 0.8 may differ in (39 on average, 48 for the smallest sets; 6 is the standard deviation); members of a bucket that are its references.
PARTS, NEAR_BITS, NEAR_PIVOTS = 4, 84, 8


def shingle_hashes(text: str, words: int):
    """Chunks of the XXH64 hashes (seed 42) of a text's shingles, in their order; shorter texts are one shingle, texts without words none."""
    import numpy as np
    import xxhash

    tokens = text.encode("utf-8").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return
    n, hash_of = max(1, len(tokens) - words + 1), xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)))) if len(tokens) >= words else iter([b" ".join(tokens)])
    for done in range(0, n, CHUNK):
        size = min(CHUNK, n - done)
        yield np.fromiter((hash_of(s, SEED) for _, s in zip(range(size), shingles)), dtype=np.uint64, count=size)


def _ones(hashes):
    """How often each of the 64 bits is set, the highest first."""
    import numpy as np

    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(len(hashes), 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit SimHash of the text's shingles of so many words."""
    import numpy as np

    sums, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, words):
        sums += _ones(hashes)
        n += len(hashes)
    return int.from_bytes(np.packbits(sums * 2 > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [_signed(fingerprint(t.as_py() or "", words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    """The bits of each block: 64 bits dealt to runs of nearly equal length."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:])]


def references() -> list[int]:
    return [(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) for k in range(PIVOTS)]


def distances(prints, pivots):
    """Hamming distances of fingerprints (rows of 64-bit words) to pivots."""
    import numpy as np

    return np.stack([np.bitwise_count(prints ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)


def pivot_search(prints, pivots, max_bits: int):
    """(row, others) -> which of the others are within max_bits bits: the pivot table discards, the fingerprints verify."""
    import numpy as np

    table = distances(prints, pivots)

    def near(k, others):
        kept = np.abs(table[others] - table[k]).max(axis=1) <= max_bits
        kept[kept] = np.bitwise_count(prints[others[kept]] ^ prints[k]).sum(axis=1) <= max_bits
        return kept

    return near


def _by_fingerprint(max_bits: int):
    def table(data: list):
        import numpy as np

        return pivot_search(np.frombuffer(b"".join(data), dtype=">u8").astype(np.uint64).reshape(len(data), 1), np.array(references(), dtype=np.uint64)[:, None], max_bits)

    return table


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """nodes fp (distinct) -> u, v: links between fingerprints within max_bits bits, enough of them to connect all that are."""

    def keyed(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        masks = [np.uint64(m) for m in block_masks(max_bits + 1)]
        salts = [np.uint64(xxhash.xxh64_intdigest(str(k), SEED)) for k in range(len(masks))]
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            fps = signed.view(np.uint64)
            keys = np.concatenate([((fps & m) ^ s) * np.uint64(0x9E3779B97F4A7C15) for m, s in zip(masks, salts)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(signed, len(masks))), pa.array(np.full(len(keys), 8))], names=["key", "node", "bytes"])

    rows = staged(nodes.select("fp").mapInArrow(keyed, "key long, node long, bytes long"))
    out = buckets.links(rows, F.unhex(F.lpad(F.hex("node"), 16, "0")), _by_fingerprint(max_bits))
    release(rows)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id that links reach from it)."""
    table = staged(fingerprints(docs, doc_id, text, words))
    nodes = staged(table.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(links(nodes, max_bits))  # over fingerprints, which are never null
    named = staged(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "node", F.coalesce("root", "fp").alias("root")))
    component = named.join(named.groupBy("root").agg(F.min("node").alias("component_id")), "root").select("fp", "component_id")
    return table.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str, words: int = NEAR_WORDS):
    """The sorted distinct hashes of a text's shingles."""
    import numpy as np

    return np.unique(np.concatenate([np.array([], dtype=np.uint64), *shingle_hashes(text, words)]))


def _mixed(x, k: int):
    """Another hash of 64-bit hashes."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
    return x ^ (x >> np.uint64(29))


def wide_fingerprint(hashes) -> bytes:
    """A SimHash of PARTS * 64 bits of a shingle set."""
    import numpy as np

    sums = sum((np.concatenate([_ones(_mixed(part, k)) for k in range(PARTS)]) for part in np.split(hashes, range(CHUNK, len(hashes), CHUNK))), np.zeros(64 * PARTS, dtype=np.int64))
    return np.packbits(sums * 2 > len(hashes)).tobytes()


def band_keys(hashes) -> list[int]:
    """A signed long for each band, of the minima of a shingle set under BANDS * BAND_ROWS orders."""
    import numpy as np
    import xxhash

    orders = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[k : k + 1024, None] * orders).min(axis=0))
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _banded(words: int):
    """row, text -> row, node (a hash of the shingle set), bands, bytes of its payload."""

    def banded(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                nodes, bands, sizes = [], [], []
                for text in part.column(1):
                    hashes = shingle_set(text.as_py() or "", words)
                    nodes.append(_signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)))
                    bands.append(band_keys(hashes) if len(hashes) else [])
                    sizes.append(8 * (PARTS + len(hashes)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["row", "node", "bands", "bytes"])

    return banded


def _payloads(words: int):
    """node, text -> node, data: the wide fingerprint and the shingle set."""

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t.as_py() or "", words) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([wide_fingerprint(s) + s.tobytes() for s in sets], pa.binary())], names=["node", "data"])

    return packed


def set_search(least: float):
    """Rows of fingerprint and shingle set: pairs whose distances to the bucket's references differ by more than NEAR_BITS, or whose fingerprints do, are discarded; the rest are verified on the sets."""

    def table(data: list):
        import numpy as np

        wide = 8 * PARTS
        sets = [np.frombuffer(x, dtype="<u8", offset=wide) for x in data]
        sizes = np.array([len(s) for s in sets])
        prints = np.frombuffer(b"".join(x[:wide] for x in data), dtype="<u8").reshape(len(data), PARTS)
        near = pivot_search(prints, prints[np.linspace(0, len(data) - 1, min(NEAR_PIVOTS, len(data))).astype(int)], NEAR_BITS)

        def alike(k, others):
            kept = near(k, others) & (np.minimum(sizes[others], sizes[k]) >= least * np.maximum(sizes[others], sizes[k]) - 1e-9)
            left = others[kept]
            if len(left):
                # shingles of every set left that stand in set k too: both are sorted and without repeats
                whole = np.concatenate([sets[j] for j in left])
                at = np.minimum(np.searchsorted(sets[k], whole), sizes[k] - 1)
                both = np.add.reduceat((sets[k][at] == whole).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[left])[:-1]]))
                kept[kept] = both >= least * (sizes[k] + sizes[left] - both) - 1e-9
            return kept

        return alike

    return table


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = NEAR_WORDS, least: float = LEAST) -> DataFrame:
    """The columns of docs: one row of each component of near copies, that of the least doc_id; null ids come last and equal ones in any order. Texts without words are one component."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")))
    body = F.col("own").getField(text).cast("string").alias("text")
    light = staged(rows.select("row", body).mapInArrow(_banded(words), "row long, node long, bands array<long>, bytes long"))
    # texts of one shingle set are one node, that of their first row; sets are made, and shuffled, only for nodes that share a bucket
    firsts = staged(light.groupBy("node").agg(F.min("row").alias("row")))
    keyed = staged(light.join(firsts.select("row"), "row", "left_semi").select(F.explode("bands").alias("key"), "node", "bytes"))

    def payload(members: DataFrame) -> DataFrame:
        first = small(members.join(firsts, "node"))
        return rows.select("row", body).join(first, "row").select("node", "text").mapInArrow(_payloads(words), "node long, data binary")

    near = buckets.links(keyed, payload, set_search(least))
    release(keyed, firsts)
    roots = components(near)
    named = light.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    id_ = F.col("own").getField(doc_id)
    order = F.struct(id_.isNull().alias("unnamed"), id_.alias("id"), F.col("row"))
    kept = rows.select("row", order.alias("x")).join(named, "row").groupBy("root").agg(F.min("x").alias("x")).select("x.row")
    return rows.join(kept, "row", "left_semi").select("own.*")
