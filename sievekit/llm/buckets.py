"""Links between nodes that share a bucket: every pair of a bucket is compared unless links already join its two ends.

Buckets come as rows key, node. Buckets of the same members are one. A bucket of more than TILE_ROWS nodes or TILE_BYTES of
payload is dealt to tiles by a hash of bucket and node, so that a task holds two tiles at most: the tiles are first
linked within, then, where a bucket still spans several components, with each other. Groups of near copies thus cost about one
comparison a member and bucket; only buckets of unlike members cost all their pairs. No row is dropped. Where rows carry an order, the members
of a tile stand in it, and neighbours are compared first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import release, staged
from sievekit.llm.components import components

TILE_ROWS, TILE_BYTES = 2048, 16 << 20
#: A tile's rows: node numbers and payloads -> a function (row, other rows) -> which of the others are linked to it.
Table = Callable[[list], Callable]


def spanning(alike: Callable, groups: list, other: list | None = None, ordered: bool = False) -> list[tuple[int, int]]:
    """Pairs of row numbers that are alike and join different groups, enough of them to span all such pairs. groups: the component of each row so far. other: which side of two tiles each row is on; pairs of one side are left out. ordered: each row is first held against the one after it."""
    import numpy as np

    label = np.unique(np.array(groups, dtype=np.int64), return_inverse=True)[1]
    side, rows, out = (np.array(other) if other is not None else None), np.arange(len(groups)), []
    for k in range(len(groups) - 1 if ordered and other is None else 0):
        if label[k] != label[k + 1] and alike(k, rows[k + 1 : k + 2])[0]:
            out.append((k, k + 1))
            label[label == label[k + 1]] = label[k]
    for k in range(len(groups) - 1):
        apart = rows[k + 1 :][label[k + 1 :] != label[k]]
        if side is not None:
            apart = apart[side[apart] != side[k]]
        if not len(apart):
            continue
        for j in apart[alike(k, apart)].tolist():
            if label[j] != label[k]:
                out.append((k, j))
                label[label == label[j]] = label[k]
        if label.min() == label.max():
            break
    return out


def _grouped(batches) -> Iterator[tuple[list, list, list, list]]:
    """Rows sorted by key and tiles -> (nodes, roots, sides, payloads) of each group; a group is held as a whole."""
    now, held = None, ([], [], [], [])
    for batch in batches:
        names = ("key", "a", "b", "node", "root", "tile")
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
        data = batch.column(batch.schema.get_field_index("data"))
        for k, (key, a, b, node, root, tile) in enumerate(zip(*columns)):
            if now != (key, a, b):
                if len(held[0]) > 1:
                    yield held
                now, held = (key, a, b), ([], [], [], [])
            for own, value in zip(held, (node, root, tile != a, data[k].as_py())):
                own.append(value)
    if len(held[0]) > 1:
        yield held


def _linked(table: Table, ordered: bool):
    def linked(batches):
        import pyarrow as pa

        us, vs = [], []
        write = lambda: pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        for nodes, roots, sides, data in _grouped(batches):
            for i, j in spanning(table(data), roots, sides if any(sides) else None, ordered):
                us.append(nodes[i])
                vs.append(nodes[j])
            if len(us) > 10_000:
                yield write()
                us, vs = [], []
        yield write()

    return linked


def _compared(rows: DataFrame, held: DataFrame | Column, table: Table, order: list[str]) -> DataFrame:
    """rows key, a, b (tiles), node, root, tile, and the payloads (node, data, or a Column of node) -> u, v."""
    whole = rows.withColumn("data", held) if isinstance(held, Column) else rows.join(held, "node")
    whole = whole.select("key", "a", "b", "node", "root", "tile", "data", *order)
    return whole.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", *order).mapInArrow(_linked(table, bool(order)), "u long, v long")


def links(keyed: DataFrame, payload: Column | Callable[[DataFrame], DataFrame], table: Table, order: str | None = None) -> DataFrame:
    """keyed: key, node (longs, distinct), bytes (read twice: staged), and if named the order of a key's nodes -> u, v: links that connect all nodes that are alike and share a key, through such nodes.

    payload: a binary Column of node, or a function from the nodes that share any bucket (node) to their payloads (node, data).
    """
    sorted_by = [order] if order else []
    members = F.bit_xor(F.xxhash64("node"))
    found = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), members.alias("members"), F.min("node").alias("lo"))
    found = found.where("n > 1").groupBy("n", "members", "lo").agg(F.min(F.struct("key", "bytes")).alias("x"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("x.bytes") / TILE_BYTES)).cast("int")
    shared = staged(keyed.select("key", "node", *sorted_by).join(found.select("x.key", tiles.alias("tiles")), "key").withColumn("tile", F.pmod(F.xxhash64("key", "node", F.lit("tile")), F.col("tiles")).cast("int")))
    held = payload if isinstance(payload, Column) else staged(payload(shared.select("node").distinct()))
    near = staged(_compared(shared.select("key", F.col("tile").alias("a"), F.col("tile").alias("b"), "node", F.col("node").alias("root"), "tile", *sorted_by), held, table, sorted_by))
    crowded = shared.where("tiles > 1")
    if not crowded.isEmpty():
        rooted = staged(crowded.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node")))
        split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        pairs = rooted.join(split, "key").withColumn("o", other).where("o <> tile").select("key", F.least("tile", "o").alias("a"), F.greatest("tile", "o").alias("b"), "node", "root", "tile", *sorted_by)
        within, near = near, staged(near.unionByName(_compared(pairs, held, table, sorted_by)))
        release(rooted, within)
    release(shared, *([] if isinstance(held, Column) else [held]))
    return near
