"""Vector code compression: product codes over integer vectors, trained by k-means whose nearest entries are found by exponion search.

A vector is cut into parts of equal length; every part position has a codebook of up to ENTRIES entries. The search for a part starts at the
entry it had before (entry 0 at first), at the squared distance u. An entry nearer than that, or as near, is within 2 sqrt(u) of
the start by the triangle inequality, so only that much of the start's list of neighbour entries, sorted by distance, is scanned, in
rings that double; after each ring the radius shrinks to sqrt(u) + sqrt(best). Distances are squared and whole numbers, exact in
doubles: length * (2 * largest component)^2 must be under 2^53, which is checked. Ties go to the lower entry.

A round reads the table of the round before (ids, labels, vectors as 32-bit integers, entries), assigns, and writes the next one; each task also
writes the sums and counts of its parts by entry, one row an entry, which one aggregation adds up. Nothing else moves: rows are shuffled
neither by entry nor by vector, so entries that draw most rows are no hot keys. Codebooks are the only data that
the driver holds: ENTRIES * length of a vector.

Rows whose vector is null, empty, or holds a null or non-finite component take no part; neither do vectors of another length than
that of the smallest id. Where the length is no multiple of the number of parts, parts differ by one component. Null ids come after all others, repeated
ids are rows each, in the order of their vectors. Fewer rows than entries make smaller codebooks. Empty tables give no rows. Null labels are one label. Columns of any other name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import release, small, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: The first ring of neighbours that a search scans; each next one is twice as wide.
RING = 8
#: Vectors that are searched for at once.
BATCH = 4096


class Codebook:
    """The entries of one part position, each with the list of all entries sorted by distance from it (itself first, or an equal one of a lower index)."""

    def __init__(self, entries):
        import numpy as np

        self.entries = np.asarray(entries, dtype=np.float64)
        self.norms = (self.entries**2).sum(axis=1)
        apart = np.maximum(self.norms[:, None] - 2 * self.entries @ self.entries.T + self.norms, 0)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(apart, self.order, axis=1)

    def search(self, rows, start):
        """rows, and the entry to start from for each -> (nearest entry, squared distance, how many distances were computed)."""
        import numpy as np

        rows = rows.astype(np.float64)
        norms, own = (rows**2).sum(axis=1), self.entries[start]
        first = ((rows - own) ** 2).sum(axis=1)
        best, near, looked = first.copy(), start.astype(np.int64), len(rows)
        grouped = np.argsort(start, kind="stable")
        for group in np.split(grouped, np.flatnonzero(np.diff(start[grouped])) + 1) if len(rows) else ():
            entry = int(start[group[0]])
            others, far = self.order[entry], self.sorted[entry]
            low, width = 0, RING
            while len(group) and low < len(others):
                # the square of sqrt(first) + sqrt(best), rounded up
                radius = first[group] + best[group] + 2 * np.sqrt(first[group] * best[group]) + 1
                group = group[radius >= far[low]]
                ring = np.sort(others[low : low + width])
                if len(group):
                    squares = norms[group, None] - 2 * rows[group] @ self.entries[ring].T + self.norms[ring]
                    at = squares.argmin(axis=1)  # the lowest index of the nearest ones
                    found, entries = squares[np.arange(len(group)), at], ring[at]
                    better = (found < best[group]) | ((found == best[group]) & (entries < near[group]))
                    best[group[better]], near[group[better]] = found[better], entries[better]
                    looked += squares.size
                low, width = low + width, 2 * width
        return near, best, looked


def ends(dims: int, parts: int) -> list[int]:
    return [dims * k // parts for k in range(parts + 1)]


def _assigned(books: list, scale: int, last: bool) -> Callable:
    """vec_id, label, and raw (array<double>) or x and at -> the rows with their entries found, and for each entry used in a task a row of the sum and count of its parts; or, with last, vec_id, label, code, error."""

    def assigned(batches):
        import numpy as np
        import pyarrow as pa

        tables = [Codebook(b) for b in books]
        cuts = np.cumsum([0, *(t.entries.shape[1] for t in tables)])
        size, long_ = int(cuts[-1]), len(tables[0].entries)
        sums = [np.zeros(t.entries.shape, dtype=np.int64) for t in tables]
        counts = np.zeros((len(tables), long_), dtype=np.int64)
        widest = 0
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                part = batch.slice(first, BATCH)
                n = part.num_rows
                if "raw" in part.schema.names:
                    x = np.floor(part.column("raw").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(n, size)
                    at = np.zeros((n, len(tables)), dtype=np.uint8)
                else:
                    x = np.frombuffer(b"".join(part.column("x").to_pylist()), dtype="<i4").astype(np.float64).reshape(n, size)
                    at = np.frombuffer(b"".join(part.column("at").to_pylist()), dtype=np.uint8).reshape(n, len(tables))
                widest = max(widest, float(np.abs(x).max(initial=0)))
                if widest >= 1 << 31 or np.diff(cuts).max() * (2 * widest) ** 2 >= 1 << 53:
                    raise ValueError(f"a component of {widest:.0f} is too large for exact distances of {np.diff(cuts).max()} components")
                near, error = np.empty_like(at), np.zeros(n)
                for k, table in enumerate(tables):
                    own = x[:, cuts[k] : cuts[k + 1]]
                    entries, squares, _ = table.search(own, at[:, k])
                    near[:, k], error = entries, error + squares
                    if not last:
                        np.add.at(sums[k], entries, own.astype(np.int64))
                        counts[k] += np.bincount(entries, minlength=long_)
                codes = [row.tobytes() for row in near]
                if last:
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([c.hex() for c in codes], pa.string()), pa.array(error.astype(np.int64))], names=["vec_id", "label", "code", "error"])
                else:
                    vectors = [row.tobytes() for row in x.astype("<i4")]
                    yield _rows(part.column("vec_id"), part.column("label"), pa.array(vectors, pa.binary()), pa.array(codes, pa.binary()), *(pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()))))
        if not last and counts.any():
            used = np.argwhere(counts)
            rows = [sums[k][e].tolist() for k, e in used]
            yield _rows(pa.nulls(len(used), pa.int64()), pa.nulls(len(used), part.column("label").type), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.binary()), pa.array(used @ [ENTRIES, 1], pa.int32()), pa.array(counts[tuple(used.T)]), pa.array(rows, pa.list_(pa.int64())))

    def _rows(*columns):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays(list(columns), names=["vec_id", "label", "x", "at", "slot", "n", "s"])

    return assigned


def updated(books: list, state: DataFrame) -> list:
    """Each entry is replaced by the floor of the mean of its parts; entries without parts stay."""
    longest = max(len(b[0]) for b in books)
    told = state.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(longest)])
    books = [[list(e) for e in b] for b in books]
    for row in told.collect():  # at most one an entry
        k, e = divmod(row["slot"], ENTRIES)
        books[k][e] = [row[f"s{i}"] // row["n"] for i in range(len(books[k][e]))]
    return books


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> tuple[list, int]:
    """The codebooks that the smallest ids give, and the length of a vector."""
    import math

    order = [F.asc_nulls_last("vec_id"), "raw"]
    head = vectors.select("vec_id", "raw").orderBy(*order).limit(entries).collect()
    if not head:
        return [], 0
    dims = len(head[0]["raw"])
    if any(len(r["raw"]) != dims for r in head):
        head = vectors.where(F.size("raw") == dims).select("vec_id", "raw").orderBy(*order).limit(entries).collect()
    whole = [[math.floor(x * scale) for x in r["raw"]] for r in head]
    cuts = ends(dims, parts)
    return [[v[a:b] for v in whole] for a, b in zip(cuts, cuts[1:])], dims


def digest(books: list) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compress(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list]:
    """(vec_id, label, code, error of every vector that takes part, as a written table; the codebooks: a list of integer entries for each part)."""
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"a code has one byte a part: up to {ENTRIES} entries")
    raw = F.col(f"`{vector}`")
    fine = raw.isNotNull() & (F.size(raw) > 0) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    vectors = table.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), raw.cast("array<double>").alias("raw"))
    books, dims = first_books(vectors, parts, entries, scale)
    kind = vectors.schema["label"].dataType.simpleString()
    if not books:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    state = vectors.where(F.size("raw") == dims)
    for k in range(rounds):
        before, state = state, staged(state.select(*("vec_id", "label", "raw") if k == 0 else ("vec_id", "label", "x", "at")).mapInArrow(_assigned(books, scale, last=False), f"vec_id long, label {kind}, x binary, at binary, slot int, n long, s array<long>"))
        books = updated(books, state)
        if k:
            release(before)
        state, told = state.where("slot is null"), state
        state._scratch = told._scratch
    out = staged(state.select(*("vec_id", "label", "x", "at") if rounds else ("vec_id", "label", "raw")).mapInArrow(_assigned(books, scale, last=True), f"vec_id long, label {kind}, code string, error long"))
    if rounds:
        release(state)
    return out, books


def coded(table: DataFrame, **names) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error (of all vectors of the label), codebooks_sha256."""
    codes, books = compress(table, **names)
    by_label = small(codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds, each a set of tables: q the nearest entries, c the next codebooks."""
    square = "list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, c.x) + list_inner_product(c.x, c.x)"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"q{k} AS MATERIALIZED (SELECT r, p, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e FROM (SELECT x.r, x.p, c.e, CAST({square} AS BIGINT) AS d FROM parts x JOIN c{k} c ON x.p = c.p) GROUP BY r, p)")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM (SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT q.p, q.e, unnest(range(len(x.x))) AS i, CAST(unnest(x.x) AS BIGINT) AS v FROM q{k} q JOIN parts x USING (r, p)) GROUP BY ALL) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[len(v) // {PARTS} * p + 1 : len(v) // {PARTS} * (p + 1)] AS x FROM kept, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM parts WHERE r <= {ENTRIES}),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}),
o AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM q{ROUNDS} JOIN kept USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h
"""


ORACLE = _oracle()
