"""Exact removal of repeated byte strings, by bucket-pointer refinement over sampled suffixes.

A byte goes if it lies in a string of `length` bytes that also starts earlier (smaller doc_id, or earlier in the
same document). All strings of that length are compared; matches never cross documents.

Suffixes are sampled so that equal strings sample alike: each string (window) of `length` bytes belongs to the suffix
at its least q-gram hash, the leftmost of equals. A sampled suffix and the run of windows that belong to it are
one row. Initial buckets hold the rows whose suffixes start with the same q-gram. A bucket is refined by sorting on
the identifiers of later and earlier offsets: the bucket of the run's first window and of its last window,
100 bytes each, which together say the whole text around the suffix. In a refined bucket, every row but the first
repeats an earlier one window for window. Where a bucket splits into several, windows may still agree in part; the first rows of
the refined buckets are refined again, window by window, reusing the bucket that they are in. Buckets of one
row end at once.

Repeats within one batch of documents are settled before any shuffle, so a passage that many documents
share sends a row a batch. Buckets that a sample finds very common are dealt by their refined buckets as well.

Null texts are empty. doc_id null comes before all others; an id of -2^63 counts as null. Rows that repeat a doc_id and its text are the same document and all get
its result; rows that repeat a doc_id with other texts are ordered by a hash of the text. Texts shorter than `length` lose
nothing. Very long texts are read in pieces. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import staged

LENGTH, GRAM = 100, 24
PIECE = 1 << 18
#: What a task holds at a time: text, and rows that are refined window by window.
BATCH_BYTES, TASK_ROWS = 1 << 20, 1_000
NO_ID = -(1 << 63)
#: Buckets in more than this share of a sample's documents, or of more than so many documents by the sample, are dealt out by their refined buckets too.
COMMON_SHARE, COMMON_DOCS, SAMPLE_PART, SALTS = 0.01, 20_000, 50, 64
#: Refined again within one task up to so many rows; others by a shuffle of their windows.
GROUP_ROWS = 20_000
SET_BITS = 32_768
SET_BUCKETS = 256
OPEN = "h long, ctx long, doc long, th int, lo long, n long, settled boolean"


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters():
    import numpy as np

    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashes_of(data, lengths: list[int]) -> dict:
    """length -> the hash of the string of that length at every place of data that has one: polynomials of the bytes' random values, by doubling."""
    import numpy as np

    base = np.uint64(0xD6E8FEB86659FD93)
    power = lambda n: np.uint64(pow(int(base), n, 1 << 64))
    powers, out, size = {1: _letters()[data]}, {}, 1
    while size * 2 <= min(max(lengths), len(data)):
        h = powers[size]
        powers[size * 2] = h[:-size] * power(size) + h[size:]
        size *= 2
    for length in lengths:
        at, total, count = 0, None, len(data) - length + 1
        if count <= 0:
            out[length] = np.array([], dtype=np.uint64)
            continue
        for part in sorted(powers, reverse=True):
            if length - at >= part:
                h = powers[part][at : at + count]
                total = h.copy() if total is None else total * power(part) + h
                at += part
        out[length] = _mixed(total)
    return out


def sampled(data, starts, ends, length: int, gram: int):
    """Arrays: piece number, first window (place in data), number of windows, bucket, refined bucket. Pieces [starts, ends) of data must not overlap in windows."""
    import numpy as np

    h = hashes_of(data, [gram, length])
    grams, windows = h[gram], h[length]
    width = length - gram + 1
    if not len(windows):
        empty = np.array([], dtype=np.int64)
        return empty, empty, empty, empty, empty
    place = np.uint64((1 << 20) - 1)
    least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    least = np.minimum(least[: len(windows)], least[rest : rest + len(windows)])
    counts = np.maximum(ends - starts - length + 1, 0)
    piece = np.repeat(np.arange(len(starts)), counts)
    offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[piece] + offsets
    anchor = (least[at] & place).astype(np.int64)
    first = np.ones(len(at), dtype=bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    k = np.flatnonzero(first)
    n = np.diff(np.append(k, len(at)))
    lo, a = at[k], anchor[k]
    around = _mixed(windows[lo] ^ _mixed(windows[lo + n - 1] + _mixed((n * 4096 + (a - lo)).astype(np.uint64))))
    return piece[k], lo, n, grams[a].view(np.int64), around.view(np.int64)


def _pieces(offsets, length: int):
    """Cuts texts (by their offsets in one buffer) into groups of pieces under PIECE bytes: (buffer start, buffer end, text numbers, starts, ends)."""
    group, size = [], 0
    for text in range(len(offsets) - 1):
        at, end = int(offsets[text]), int(offsets[text + 1])
        while end - at >= length:
            stop = min(end, at + PIECE)
            if size and size + stop - at > PIECE:
                yield group
                group, size = [], 0
            group.append((text, at, stop))
            size += stop - at
            if stop == end:
                break
            at = stop - length + 1
    if group:
        yield group


def text_buffer(column):
    """The bytes of an Arrow string column and the offsets of its texts (nulls are empty)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.array([], dtype=np.uint8)), offsets


def by_bytes(batch, text: int):
    """Slices of the batch that hold BATCH_BYTES of the text column, or one row. What a slice needed goes back to the system before the next."""
    import numpy as np
    import pyarrow as pa

    _, offsets = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, side="right")) - 1)
        yield batch.slice(at, end - at)
        pa.default_memory_pool().release_unused()
        at = end


def list_columns(column, *names: str):
    """The offsets of an Arrow column of lists of structs, and the fields' values (nulls are empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    flat = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
    offsets = [0]
    for size in sizes:
        offsets.append(offsets[-1] + size)
    return offsets, *(flat.field(name).to_numpy(zero_copy_only=False) if isinstance(flat, pa.StructArray) else flat for name in names)


def batch_rows(texts, length: int, gram: int):
    """Arrays over a batch of texts: text number, first window (offset in its text), number of windows, bucket, refined bucket."""
    import numpy as np

    data, offsets = text_buffer(texts)
    found = []
    for group in _pieces(offsets, length):
        number, starts, ends = (np.array(x, dtype=np.int64) for x in zip(*group))
        bytes_ = np.concatenate([data[a:b] for a, b in zip(starts, ends)]) if np.any(starts[1:] != ends[:-1]) else data[starts[0] : ends[-1]]
        sizes = ends - starts
        local = np.cumsum(sizes) - sizes
        piece, lo, n, bucket, around = sampled(bytes_, local, local + sizes, length, gram)
        found.append((number[piece], lo - local[piece] + starts[piece] - offsets[number[piece]], n, bucket, around))
    if not found:
        empty = np.array([], dtype=np.int64)
        return empty, empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found))


def _scan(length: int, gram: int):
    def scan(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in by_bytes(whole, 2)):
            batch = pa.Table.from_batches([batch]).sort_by([("doc", "ascending"), ("th", "ascending")]).combine_chunks()
            doc, th = batch["doc"].to_numpy(), batch["th"].to_numpy()
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
            if not new.all():  # the same document again
                batch, doc, th = batch.filter(pa.array(new)).combine_chunks(), doc[new], th[new]
            text, lo, n, bucket, around = batch_rows(batch["text"].combine_chunks() if batch.num_rows else pa.array([], pa.string()), length, gram)
            order = np.lexsort((around, bucket))  # stable: rows of a refined bucket stay in the documents' order
            same = np.zeros(len(order), dtype=bool)
            b, c = bucket[order], around[order]
            d, t, o = doc[text[order]], th[text[order]], lo[order]
            same[1:] = (b[1:] == b[:-1]) & (c[1:] == c[:-1])
            count = n[order]
            run = np.flatnonzero(same)  # settled here: merged to long runs
            run = run[np.lexsort((o[run], t[run], d[run]))]
            head = np.ones(len(run), dtype=bool)
            head[1:] = (d[run][1:] != d[run][:-1]) | (t[run][1:] != t[run][:-1]) | (o[run][1:] != (o[run] + count[run])[:-1])
            if len(run):
                merged = np.add.reduceat(count[run], np.flatnonzero(head))
                run = run[head]
            else:
                merged = count[:0]
            rest = np.flatnonzero(~same)
            take = np.concatenate([rest, run])
            spread = _mixed((d[run] * 8191 + o[run]).astype(np.uint64)).view(np.int64)
            columns = [np.concatenate([b[rest], spread]), c[take], d[take], t[take].astype(np.int32), o[take], np.concatenate([count[rest], merged]), np.arange(len(take)) >= len(rest)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "ctx", "doc", "th", "lo", "n", "settled"])

    return scan


def _contexts(length: int):
    """Rows doc, th, text, edges -> the bytes of each edge's run of windows."""

    def contexts(batches):
        import pyarrow as pa

        import numpy as np

        for batch in (part for whole in batches for part in by_bytes(whole, 2)):
            buffer, at = text_buffer(batch.column(2))
            offsets, h, lo, n = list_columns(batch.column(3), "h", "lo", "n")
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            first = at[row] + lo
            data = [buffer[a:b].tobytes() for a, b in zip(first.tolist(), (first + n + (length - 1)).tolist())]
            doc, th = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(th), pa.array(lo), pa.array(n), pa.array(data, pa.binary())], names=["h", "doc", "th", "lo", "n", "data"])

    return contexts


def _windows_of(table, length: int):
    """h, w (the window's hash), doc, th, s of every window of the contexts in an Arrow table."""
    import numpy as np

    n = table["n"].to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(table["data"].to_pylist()), dtype=np.uint8)
    sizes = n + length - 1
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    w = hashes_of(data, [length])[length][starts[row] + step].view(np.int64)
    return table["h"].to_numpy()[row], w, table["doc"].to_numpy()[row], table["th"].to_numpy()[row], table["lo"].to_numpy()[row] + step


def _intervals(doc, th, s, length: int):
    """Windows starting at s -> merged intervals, as a batch doc, th, lo, hi."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((s, th, doc))
    doc, th, s = doc[order], th[order], s[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (s[1:] > s[:-1] + length)
    last = np.append(first[1:], True) if len(s) else first
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(th[first].astype(np.int32)), pa.array(s[first]), pa.array(s[last] + length)], names=["doc", "th", "lo", "hi"])


def _first_and_again(windows):
    """The arrays h, w, doc, th, s sorted, and which of them repeat an earlier place of the same window."""
    import numpy as np

    h, w, doc, th, s = windows
    order = np.lexsort((s, th, doc, w, h))
    h, w, doc, th, s = (x[order] for x in windows)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (w[1:] == w[:-1]) & ((doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (s[1:] != s[:-1]))
    return (h, w, doc, th, s), again


def _refine_groups(length: int):
    """Contexts sorted by h -> intervals of the windows that an earlier row of the same h has."""

    def refine(batches):
        import numpy as np
        import pyarrow as pa

        def done(table):
            (_, _, doc, th, s), again = _first_and_again(_windows_of(table, length))
            return _intervals(doc[again], th[again], s[again], length)

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            h = table["h"].to_numpy()
            cut = int(np.argmax(h == h[-1]))  # sorted: the last h may go on in the next batch
            ends = np.flatnonzero(h[1 : cut + 1] != h[:cut]) + 1  # groups stay whole
            at = 0
            while at < cut:
                end = int(ends[max(np.searchsorted(ends, at + TASK_ROWS, side="right") - 1, np.searchsorted(ends, at, side="right"))])
                yield done(table.slice(at, end - at))
                at = end
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return refine


def _explode_windows(length: int):
    """Contexts -> the first place of each window among some of the rows (h, w, doc, th, lo; hi null), and intervals of the other places (h null)."""

    def explode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2 * TASK_ROWS):
                (h, w, doc, th, s), again = _first_and_again(_windows_of(pa.Table.from_batches([batch.slice(at, 2 * TASK_ROWS)]), length))
                gone, first = _intervals(doc[again], th[again], s[again], length), ~again
                none, n = pa.nulls(gone.num_rows, pa.int64()), int(first.sum())
                joined = lambda x, y: pa.concat_arrays([pa.array(x), y])
                yield pa.RecordBatch.from_arrays(
                    [joined(h[first], none), joined(w[first], none), joined(doc[first], gone["doc"]), joined(th[first].astype(np.int32), gone["th"]), joined(s[first], gone["lo"]), joined(pa.nulls(n, pa.int64()), gone["hi"])], names=["h", "w", "doc", "th", "lo", "hi"]
                )

    return explode


def _cut(batches):
    """Rows doc, n_bytes, text, spans -> what is left."""
    import pyarrow as pa

    for batch in (part for whole in batches for part in by_bytes(whole, 1)):
        out = []
        buffer, at = text_buffer(batch.column(1))
        offsets, los, his = list_columns(batch.column(2), "lo", "hi")
        for k, doc in enumerate(batch.column(0).to_pylist()):
            data, kept, end, removed, runs = buffer[at[k] : at[k + 1]].tobytes(), [], 0, 0, 0
            a, b = offsets[k], offsets[k + 1]
            for lo, hi in sorted(zip(los[a:b].tolist(), his[a:b].tolist())):
                if not runs or lo > end:
                    kept.append(data[end:lo])
                    removed, runs, end = removed + hi - lo, runs + 1, hi
                elif hi > end:
                    removed, end = removed + hi - end, hi
            kept.append(data[end:])
            out.append((doc, len(data), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def id_set(ids: DataFrame, column: str) -> DataFrame:
    """A fixed-size set that may hold more than ids, never less: SET_BUCKETS rows of 4 KB (1 MB in all) at most."""
    hashed = F.xxhash64(column)
    return ids.select(F.pmod(hashed, F.lit(SET_BUCKETS)).cast("int").alias("bucket"), F.pmod(F.shiftrightunsigned(hashed, 16), F.lit(SET_BITS)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """rows with the set joined (by a broadcast of at most 1 MB), and the condition that the set may hold the row's column."""
    hashed = F.xxhash64(column)
    rows = rows.withColumn("bucket", F.pmod(hashed, F.lit(SET_BUCKETS)).cast("int")).join(F.broadcast(id_set(ids, column)), "bucket", "left")
    bit = F.pmod(F.shiftrightunsigned(hashed, 16), F.lit(SET_BITS))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows, F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))


def common_buckets(docs: DataFrame, length: int, gram: int) -> list[int]:
    """Buckets that a sample of the documents finds in more than COMMON_SHARE of them, or in more than COMMON_DOCS of all documents, the most common 10,000 first. They only decide how rows are dealt."""
    part = docs.where(F.pmod(F.xxhash64("doc", "th"), F.lit(SAMPLE_PART)) == 0)
    size = part.count()

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in by_bytes(whole, 2)):
            text, _, _, bucket, _ = batch_rows(batch.column(2), length, gram)
            pairs = np.unique(np.stack([text, bucket]), axis=1) if len(text) else np.zeros((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1])], names=["h"])

    common = part.select("doc", "th", "text").mapInArrow(scan, "h long").groupBy("h").count().where(F.col("count") > max(10, min(COMMON_SHARE * size, COMMON_DOCS / SAMPLE_PART)))
    return [r[0] for r in common.orderBy(F.desc("count")).limit(10_000).collect()]


def repeats(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs doc, th, text -> doc, th, lo, hi: byte intervals that repeat earlier strings."""
    common = common_buckets(docs, length, gram)
    salt = F.when(F.col("h").isin(common) & ~F.col("settled"), F.pmod("ctx", F.lit(SALTS)).cast("int") + 1).otherwise(0) if common else F.lit(0)
    rows = docs.select("doc", "th", "text").mapInArrow(_scan(length, gram), OPEN).withColumn("salt", salt)
    bucket, order = Window.partitionBy("h", "salt"), [F.col("doc"), F.col("th"), F.col("lo")]
    frame = bucket.orderBy("ctx", *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    refined = Window.partitionBy("h", "salt", "ctx").orderBy(*order)
    rows = rows.withColumns({"k": F.rank().over(refined)}).withColumns({"size": F.count("*").over(frame), "a": F.first("ctx").over(frame), "z": F.last("ctx").over(frame)})
    removed = F.col("settled") | (F.col("k") > 1)
    rows = rows.where(removed | (F.col("a") != F.col("z")) | (F.col("salt") > 0))
    rows = staged(rows.select("h", "doc", "th", "lo", "n", removed.alias("removed"), (~removed & ((F.col("salt") > 0) | (F.col("size") > GROUP_ROWS))).alias("crowded")))
    whole = rows.where("removed").select("doc", "th", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))
    edges = rows.where("not removed")

    def contexts(part: DataFrame) -> DataFrame:
        listed = part.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "lo", "n")).alias("edges"))
        some, held = may_hold(docs, part, "doc")
        joined = some.where(held).select("doc", "th", "text").join(listed, ["doc", "th"]).select("doc", "th", "text", "edges")
        return joined.mapInArrow(_contexts(length), "h long, doc long, th int, lo long, n long, data binary")

    few = contexts(edges.where("not crowded")).repartition("h").sortWithinPartitions("h").mapInArrow(_refine_groups(length), "doc long, th int, lo long, hi long")
    out = whole.unionByName(few)
    crowded = edges.where("crowded")
    if not crowded.isEmpty():
        windows = staged(contexts(crowded).mapInArrow(_explode_windows(length), "h long, w long, doc long, th int, lo long, hi long"))
        place = F.struct("doc", "th", "lo")
        first = windows.where("hi is null").groupBy("h", "w").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
        again = windows.join(first, ["h", "w"]).where(place > F.col("first"))
        out = out.unionByName(windows.where("hi is not null").select("doc", "th", "lo", "hi")).unionByName(again.select("doc", "th", "lo", (F.col("lo") + length).alias("hi")))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    docs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    repeated = not docs.groupBy("doc").count().where("count > 1").isEmpty()
    docs = docs.withColumn("th", F.pmod(F.xxhash64("text"), F.lit(1 << 31)).cast("int") if repeated else F.lit(0))
    spans = staged(repeats(docs, length, gram))
    listed = spans.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    marked, held = may_hold(docs, spans, "doc")
    cut = marked.where(held).select("doc", "th", "text").join(listed, ["doc", "th"], "left").select("doc", "text", "spans").mapInArrow(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    whole = marked.where(~held).select("doc", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return cut.unionByName(whole).select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
