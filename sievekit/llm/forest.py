"""MinHash near-duplicates by an LSH forest.

A set of shingles has a signature of ORDERS * DEPTH minima of its hashes under as many random orders, each cut to a label of 16 bits. The forest
holds ORDERS sorted orders of the sets: tree t sorts them by the signature turned by DEPTH * t labels, so that the first DEPTH labels of different trees are
different minima. Sets whose likeness is s share the first d labels of a tree with chance s^d.

Neighbours with a long common prefix are candidates. How long is decided for each region of a tree (the sets below one prefix): a region of SHALLOW
labels is left whole if it has at most FEW sets; a larger one is cut at DEPTH labels; a region that is still crowded (CROWDED sets) at DEEP labels.
In a region the sets stand in the tree's order; each is held against the one after it, which has the longest prefix in common with it, and then against
all others of its region that links do not join to it yet. Deep regions that are too large for a task are cut into tiles, and tiles meet
each other, so no region loses a pair. A pair of likeness 0.85 is missed by every tree with chance 9e-6 at DEPTH labels (4e-7 at SHALLOW, 8e-5 at DEEP); one of 0.9 with 1e-8 at DEPTH.

Candidates are compared by size, then by how many labels of the signature agree (AGREE of 100: at likeness 0.85 fewer do with chance 1e-9), and
confirmed on the full sets, by hashes of 64 bits. Equal sets are one node.

Texts with fewer words than a shingle are one shingle; null texts and texts without words have the empty set, are linked with nothing, and are each kept. A null doc_id has the least
non-null doc_id that it reaches as its component, or null, and is kept in the latter case; repeated doc_ids are rows each. Texts are hashed in chunks, a long one is one row of a payload.
Empty tables give no rows. Columns of any other name are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import buckets
from sievekit.llm.common import release, small, staged
from sievekit.llm.components import components
from sievekit.llm.simhash import _signed, shingle_set

WORDS, SEED = 5, 42
#: Links hold where 100 * intersection >= LEAST * union.
LEAST = 85
ORDERS, SHALLOW, DEPTH, DEEP = 20, 4, 5, 6
#: Sets of a region of SHALLOW labels that is left whole, and of one of DEPTH labels that is cut again.
FEW, CROWDED = 32, 2048
AGREE = 60


def signature(hashes):
    """The labels of a shingle set: 16 bits of each minimum."""
    import numpy as np

    factors = np.random.default_rng(SEED).integers(0, 1 << 63, ORDERS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[k : k + 1024, None] * factors).min(axis=0))
    mixed = (least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(np.uint16)


def branches(labels) -> list[bytes]:
    """For each tree, the first DEEP labels in its order."""
    import numpy as np

    turned = labels[(DEPTH * np.arange(ORDERS)[:, None] + np.arange(DEEP)) % len(labels)].astype(">u2")
    return [row.tobytes() for row in turned]


def _signed_rows(words: int):
    """row, text, doc_id -> row, doc_id, node (a hash of the shingle set, null if it is empty), n_shingles, branches."""

    def signed(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                nodes, sizes, trees = [], [], []
                for text in part.column(1):
                    hashes = shingle_set(text.as_py() or "", words)
                    nodes.append(_signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)) if len(hashes) else None)
                    sizes.append(len(hashes))
                    trees.append(branches(signature(hashes)) if len(hashes) else [])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(trees, pa.list_(pa.binary()))], names=["row", "doc_id", "node", "n_shingles", "branches"])

    return signed


def _payloads(words: int):
    """node, text -> node, data: the signature and the shingle set."""

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t.as_py() or "", words) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([signature(s).astype("<u2").tobytes() + s.tobytes() for s in sets], pa.binary())], names=["node", "data"])

    return packed


def set_search(least: int):
    """Rows of signature and shingle set: sizes and agreeing labels discard, whole sets confirm."""

    def table(data: list):
        import numpy as np

        wide = 2 * ORDERS * DEPTH
        labels = np.frombuffer(b"".join(x[:wide] for x in data), dtype="<u2").reshape(len(data), -1)
        sets = [np.frombuffer(x[wide:], dtype="<u8") for x in data]
        sizes = np.array([len(s) for s in sets])

        def alike(k, others):
            kept = 100 * np.minimum(sizes[others], sizes[k]) >= least * np.maximum(sizes[others], sizes[k])
            kept[kept] = (labels[others[kept]] == labels[k]).sum(axis=1) >= AGREE
            left = others[kept]
            if len(left):
                # shingles of every set left that stand in set k too: sets are sorted and without repeats
                whole = np.concatenate([sets[j] for j in left])
                at = np.minimum(np.searchsorted(sets[k], whole), sizes[k] - 1)
                both = np.add.reduceat((sets[k][at] == whole).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[left])[:-1]]))
                kept[kept] = 100 * both >= least * (sizes[k] + sizes[left] - both)
            return kept

        return alike

    return table


def regions(trees: DataFrame) -> DataFrame:
    """trees: tree, branch (the first DEEP labels), node, bytes (read several times: staged) -> key, node, bytes, branch: each row in the region that its tree's density gives."""
    prefix = lambda labels: F.substring("branch", 1, 2 * labels)
    count = lambda labels: trees.groupBy("tree", prefix(labels).alias("p")).agg(F.count("*").alias("n"))
    # most prefixes are met once: only those of larger regions are joined to the rows
    depth = F.when(F.col("n") > FEW, DEPTH).otherwise(SHALLOW)
    shared = count(SHALLOW).where("n > 1").select("tree", "p", depth.alias("depth"))
    rows = staged(trees.withColumn("p", prefix(SHALLOW)).join(shared, ["tree", "p"]).drop("p"))
    wide = rows.where(F.col("depth") == DEPTH).withColumn("p", prefix(DEPTH))
    crowded = small(wide.groupBy("tree", "p").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("tree", "p", F.lit(DEEP).alias("deep")))
    cut = rows.withColumn("p", prefix(DEPTH)).join(crowded, ["tree", "p"], "left").withColumn("depth", F.when(F.col("depth") == DEPTH, F.coalesce("deep", F.lit(DEPTH))).otherwise(F.col("depth")))
    key = F.xxhash64("tree", F.col("branch").substr(F.lit(1), 2 * F.col("depth")))
    out = staged(cut.select(key.alias("key"), "node", "bytes", "branch"))
    release(rows)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach from it), kept (whether that is the row's own)."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")))
    signed = staged(rows.select("row", "text", "doc_id").mapInArrow(_signed_rows(words), "row long, doc_id long, node long, n_shingles long, branches array<binary>"))
    # equal sets are one node: its first row gives the text, its least doc_id the name
    nodes = staged(signed.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n")))
    size = (8 * F.col("n_shingles") + 2 * ORDERS * DEPTH).alias("bytes")
    trees = staged(signed.join(nodes.select("row"), "row", "left_semi").select("node", size, F.posexplode("branches").alias("tree", "branch")))
    keyed = regions(trees)
    release(trees)

    def payload(members: DataFrame) -> DataFrame:
        first = small(members.join(nodes.select("node", "row"), "node"))
        return rows.select("row", "text").join(first, "row").select("node", "text").mapInArrow(_payloads(words), "node long, data binary")

    near = buckets.links(keyed, payload, set_search(least), order="branch")
    release(keyed)
    roots = components(near)
    rooted = staged(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    component = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    met = signed.where("node is not null").select("node", "doc_id", "n_shingles").join(component, "node").drop("node")
    alone = signed.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT r, s FROM (SELECT r, unnest(CASE WHEN len(ws) >= {WORDS} THEN list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i : i + {WORDS - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
pr AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
ln AS MATERIALIZED (SELECT u, v FROM pr JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE 100 * c >= {LEAST} * (a.n + b.n - c)),
re AS (SELECT r AS u, r AS v FROM w UNION SELECT re.u, ln.v FROM re JOIN ln ON re.v = ln.u)
SELECT x.doc_id, coalesce(n.n, 0) AS n_shingles, y.component_id, x.doc_id IS NOT DISTINCT FROM y.component_id AS kept
FROM w x LEFT JOIN n USING (r) JOIN (SELECT re.u, min(doc_id) AS component_id FROM re JOIN w ON w.r = re.v GROUP BY re.u) y ON y.u = x.r
"""
