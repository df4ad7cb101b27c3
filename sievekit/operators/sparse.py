"""BM25 over an inverted index that is written once and read by any number of query sets.

The index is cut into blocks of documents (by a hash of the id, BLOCK_ROWS of them), each with one row a term: how many postings, and their places and counts.
A query set reads only the postings of terms that it asks for; only these are shuffled, with one row a query and group of blocks (GROUP_BLOCKS, fewer
while cores lack work; a group is a task). Queries stream past the asked postings that a task holds, and what a block has found is a bound for the next. Some queries are answered at a time: all lists
are added in whole numbers of two bytes, long ones as rows of the block's length, and what can be among the k best by these sums gets its score in doubles (`Block`). Queries whose weights have no such sums are answered one by one (`Postings`).

A memory that consists of independent parts (a column of documents and queries) is one index: statistics, blocks and lists are the part's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions.text import lowered, split_words, tokens
from sievekit.operators.blocks import block_count, few, first_k, floor_of, own_task, ranked, where
from sievekit.sources.writers import scratch

#: The defaults of the public Okapi implementation that results have to match.
K1, B, EPSILON = 1.5, 0.75, 0.25
BLOCK_ROWS, GROUP_BLOCKS = 16_384, 4
#: A list of more than this part of a block is laid out as a row; no more than so many rows at a time.
FULL, MOST_ROWS = 1 / 16, 512
#: Long lists are only looked up for documents that are one in so many at most.
KEPT = 32
#: Whole numbers that sums come to, but for roundings up (one a list, of so many lists): what two bytes hold.
MOST_STEPS, MOST_LISTS = 60_000, 5_000
#: Impacts, which are K1 + 1 at most, are held in so many whole numbers a unit, rounded up.
IMPACT_STEPS = 25_000
#: A list of more than this part of a block is a row where many queries are answered at a time, so many numbers of theirs together.
LAID, CELLS = 1 / 64, 1 << 19
#: So many postings of a block are sorted at a time.
SORTED = 1_000_000
#: Scores are compared at nine decimals; bounds keep this much room.
SLACK = 1e-8


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, dl, term, tf: a row's words are counted where it is read, no word is shuffled."""

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, 1_000):
                ids, lists = batch.slice(first, 1_000).columns
                sizes, rows, terms, tf = _counted(lists)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(sizes[rows], pa.int32()), terms.dictionary_decode(), pa.array(tf, pa.int64())], names=["doc_id", "dl", "term", "tf"])

    return docs.select("doc_id", tokens(F.col("text")).alias("terms")).mapInArrow(counted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, dl int, term string, tf long")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl (empty documents count)."""
    return docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, df: counted in the map tasks before the shuffle, which moves a row a term and task."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def term_weights(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf: negative idf is replaced by EPSILON times the mean idf of all terms. With a column part on both sides, each part by itself."""
    parted = "part" in frequencies.columns
    counted = frequencies.join(F.broadcast(stats), "part") if parted else frequencies.crossJoin(F.broadcast(stats))  # one row (a part)
    raw = counted.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = (raw.groupBy("part") if parted else raw).agg(F.avg("raw").alias("mean"))
    both = raw.join(F.broadcast(mean), "part") if parted else raw.crossJoin(F.broadcast(mean))
    return both.select(*(["part"] if parted else []), "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _counted(lists):
    """Of a column of lists of words, the lists' lengths; and of each row and word that it holds the row, the word (coded) and how often, by rows."""
    import numpy as np
    import pyarrow as pa

    sizes, coded = np.diff(lists.offsets.to_numpy()), lists.flatten().dictionary_encode()
    words = max(1, len(coded.dictionary))
    keys, tf = np.unique(np.repeat(np.arange(len(lists)), sizes) * words + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    rows, terms = np.divmod(keys, words)
    return sizes, rows, pa.DictionaryArray.from_arrays(pa.array(terms, pa.int32()), coded.dictionary), tf


def _inverted(batches):
    """part, b, doc_id, terms (lists of words, or lowered() texts), sorted by the first three -> part, b, ids (of the block, on a row without a term that has the documents' lengths as tf and their sum as words), term, n, places, tf (by place).

    Words are counted a few documents at a time; of a block a place, a word's number and a count are held for each posting, and some postings are sorted at a time.
    """
    import numpy as np
    import pyarrow as pa

    def block(part, b, held):
        ids, sizes = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
        yield rows(part, b, [None], [len(ids)], [int(sizes.sum())], [None], [sizes.astype("<i4").tobytes()], ids)
        firsts = np.cumsum([0, *(len(x[0]) for x in held)])
        docs, tf = np.concatenate([x[2] + first for x, first in zip(held, firsts.tolist())]), np.concatenate([x[4] for x in held])
        coded = pa.chunked_array([x[3] for x in held]).unify_dictionaries()
        held.clear()
        words, codes = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])
        del coded
        ends = np.append(0, np.cumsum(np.bincount(codes, minlength=len(words))))
        first = 0
        while first < len(words):
            last = min(max(first + 1, int(np.searchsorted(ends, ends[first] + SORTED, "right")) - 1), first + 50_000, len(words))
            own = np.flatnonzero((codes >= first) & (codes < last))
            own = own[np.argsort(codes[own].astype(np.int64) * len(ids) + docs[own])]
            cuts = ends[first : last + 1] - ends[first]
            packed = lambda values: pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((cuts * 4).astype("<i4")), pa.py_buffer(values[own].astype("<i4"))])  # noqa: E731, B023
            yield rows(part, b, words.slice(first, last - first), np.diff(cuts), None, packed(docs), packed(tf), None, ids.type)
            first = last

    def rows(part, b, terms, n, words, places, tf, ids, kind=None):
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) if ids is not None else pa.nulls(len(terms), pa.list_(kind))
        fixed = lambda x, t: pa.array([x] * len(n), t)
        summed = pa.array(words, pa.int64()) if words else pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays([fixed(part, pa.string()), fixed(b, pa.int32()), pa.array(terms, pa.string()), pa.array(n, pa.int64()), summed, pa.array(places, pa.binary()), pa.array(tf, pa.binary()), listed], names=["part", "b", "term", "n", "words", "places", "tf", "ids"])

    now, held = None, []
    for batch in batches:
        for (part, b), own in _by_block(batch):
            if now != (part, b):
                if held:
                    yield from block(*now, held)
                now, held = (part, b), []
            for few in own.to_batches(max_chunksize=1_000):
                texts = few.column("terms")
                sizes, at, coded, tf = _counted(split_words(texts) if pa.types.is_string(texts.type) else texts)
                held.append((copied(few.column("doc_id")), sizes, at.astype(np.int32), coded, narrow(tf)))
    if held:
        yield from block(*now, held)


def copied(column):
    """A column that does not hold on to the batch that it came in."""
    import numpy as np
    import pyarrow as pa

    return column.take(pa.array(np.arange(len(column))))


def narrow(values):
    """Whole numbers in two bytes if all of them fit, else in four."""
    return values.astype("u2" if not len(values) or values.max() < 1 << 16 else "i4")


def _by_block(batch):
    """(part, b), rows of a batch that is sorted by both."""
    import pyarrow as pa

    table, keys = pa.Table.from_batches([batch]), list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    first = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[first]:
            yield keys[first], table.slice(first, k - first)
            first = k


class Rows:
    """Long lists of a block, each laid out as a row of the block's length; no more than so many at a time."""

    def __init__(self, n: int, kind: str, most: int):
        self.n, self.kind, self.most, self.at, self.held = n, kind, most, {}, None

    def place(self, key, docs, values) -> int:
        import numpy as np

        if self.held is None:
            self.held = np.empty((self.most, self.n), dtype=self.kind)  # memory is taken as rows are written
        at = self.at[key] = len(self.at)
        self.held[at] = 0
        self.held[at, docs] = values
        return at

    def clear(self):
        self.at, self.held = {}, None


class Postings:
    """The asked terms' postings of one block."""

    def __init__(self, n: int):
        self.n, self.terms = n, {}
        self.exact, self.rounded = Rows(n, "f8", MOST_ROWS), Rows(n, "u2", 2 * MOST_ROWS)

    def add(self, term: str, top: float, places: bytes, impacts: bytes):
        import numpy as np

        self.terms[term] = (top, np.frombuffer(places, dtype="<i4"), np.frombuffer(impacts, dtype="<f8"))

    def release(self):
        """Lets go of what the terms' lists were laid out as."""
        self.exact.clear()
        self.rounded.clear()

    def summed(self, lists: list):
        """Sums of the parts of the scores that some terms give, of all documents."""
        import numpy as np

        if not lists:
            return np.zeros(self.n)
        held = [self.terms[t] for _, _, t in lists]
        parts = np.concatenate([x[2] for x in held])
        parts *= np.repeat([w for _, w, _ in lists], [len(x[2]) for x in held])
        return np.bincount(np.concatenate([x[1] for x in held]), parts, self.n)

    def laid_out(self, lists: list):
        """Rows of impacts of long lists."""
        if len({t for _, _, t in lists} - self.exact.at.keys()) + len(self.exact.at) > self.exact.most:
            self.exact.clear()
        return [self.exact.at[t] if t in self.exact.at else self.exact.place(t, *self.terms[t][1:]) for _, _, t in lists]

    def add_rounded(self, total, weight: float, term: str, steps: float):
        """Adds a term's parts of the scores to all documents, in whole numbers of `steps` a unit, rounded up."""
        import numpy as np

        key = (term, weight, steps)
        at = self.rounded.at.get(key)
        if at is None:
            if len(self.rounded.at) == self.rounded.most:
                self.rounded.clear()
            at = self.rounded.place(key, self.terms[term][1], np.ceil(weight * steps * self.terms[term][2]))
        total += self.rounded.held[at]

    def best(self, terms: list, weights: list, k: int, floor: float = 0.0):
        """(places, scores) of the k best documents that hold a term, ties to the smaller place, but for such as are below a score (floor) that k others reach; how many entries were read and how many there are.

        Short lists are summed in doubles. If that leaves few documents that the long ones can lift to the k-th score, these are looked up. Otherwise long lists are added in whole numbers of two bytes, rounded up,
        so a sum is too large by less than the number of lists, and only documents whose sums can be among the k best get these lists' parts in doubles.
        """
        import numpy as np

        none = np.zeros(0, dtype=np.int64), np.zeros(0)
        lists = sorted(((w * self.terms[t][0], w, t) for t, w in zip(terms, weights) if t in self.terms), reverse=True)
        held, most = sum(len(self.terms[t][1]) for _, _, t in lists), sum(x[0] for x in lists)
        if any(w <= 0 for w in weights):  # no bounds: a document may hold a term and score nothing
            total, met = self.summed(lists), np.zeros(self.n, dtype=bool)
            for _, _, term in lists:
                met[self.terms[term][1]] = True
            found = np.flatnonzero(met)
            best = found[first_k(total[found], found, k)]
            return best, total[best], held, held
        if not lists or most < floor - SLACK:
            return *none, 0, held
        long, short = [], []
        for x in lists:
            (long if len(self.terms[x[2]][1]) > FULL * self.n and len(long) < self.exact.most else short).append(x)
        steps = 2.0 ** np.floor(np.log2(MOST_STEPS / most)) if long else 1.0
        if not 1e-300 < steps < 1e300:
            long, short = [], lists
        parts, rest, kept = self.summed(short), sum(x[0] for x in long), None
        if not long or rest < max(floor, (most - rest) / 2):
            # documents that the long lists cannot lift to the k-th score are left out
            least = max(floor, floor_of(parts, k)) - rest - SLACK
            if least > 0 or not long:
                kept = where(parts >= max(least, 5e-324))
                kept = None if long and KEPT * len(kept) > self.n else kept
        read = held
        if kept is None:
            total = parts * steps
            total = np.ceil(total, out=total).astype(np.uint16)
            for _, weight, term in long:
                self.add_rounded(total, weight, term, steps)
            least = max((floor - SLACK) * steps, float(floor_of(total, k)) - len(long) - 1) - 1
            kept = where(total >= max(1, int(min(least, 2 * MOST_ROWS + MOST_STEPS))))
        else:
            read += sum(len(kept) - len(self.terms[t][1]) for _, _, t in long)
        if not len(kept):
            return *none, read, held
        scores = parts[kept]
        if long:
            at = np.array(self.laid_out(long))
            scores += np.array([w for _, w, _ in long]) @ self.exact.held[at[:, None], kept]
        best = first_k(scores, kept, k)
        return kept[best], scores[best], read, held


class Block:
    """The asked terms' postings of one block, six bytes each: lists one after the other, in each the places that hold the term, rising, how often they do, and the impact, rounded up."""

    def __init__(self, ids, sizes, avgdl: float):
        self.ids, self.n, self.held = ids, len(ids), []
        self.norm = K1 * (1 - B + B * sizes / (avgdl or 1.0))

    def add(self, terms, places, tf):
        """terms, and binary columns of four bytes a number."""
        import numpy as np

        def numbers(column):
            ends = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1]
            return np.frombuffer(column.buffers()[2], dtype="<i4")[ends[0] // 4 : ends[-1] // 4], np.diff(ends) // 4

        (places, sizes), (tf, _) = numbers(places), numbers(tf)
        near = np.ceil(self.impacts(places, tf) * IMPACT_STEPS).astype("u2")
        tops = np.maximum.reduceat(near, np.cumsum(sizes) - sizes) / IMPACT_STEPS
        self.held.append((terms, sizes, tops, narrow(places), narrow(tf), near))

    def close(self):
        """All postings are there."""
        import numpy as np
        import pyarrow as pa

        if self.held is None:
            return
        columns = list(zip(*self.held)) or [[pa.array([], pa.string())], *[[np.zeros(0, dtype=np.int64)]] * 2, *[[np.zeros(0, dtype="u2")]] * 3]
        self.held, self.terms = None, pa.concat_arrays(columns[0])
        self.sizes, self.tops, self.places, self.tf, self.near = (np.concatenate(x) for x in columns[1:])
        self.starts = np.cumsum(self.sizes) - self.sizes
        least = self.n * LAID
        if len(self.sizes) > MOST_ROWS:
            least = max(least, np.partition(self.sizes, -MOST_ROWS - 1)[-MOST_ROWS - 1])
        self.long = np.flatnonzero(self.sizes > least)

    def impacts(self, places, tf):
        return tf * (K1 + 1) / (tf + self.norm[places])

    def list_of(self, at: int):
        import numpy as np

        own = slice(self.starts[at], self.starts[at] + self.sizes[at])
        return self.places[own], self.tf[own].astype(np.float64)

    def counted(self):
        """Counts of long lists as rows of the block's length."""
        import numpy as np

        counts = np.zeros((len(self.long), self.n), dtype=self.tf.dtype)
        for row, at in enumerate(self.long.tolist()):
            own = slice(self.starts[at], self.starts[at] + self.sizes[at])
            counts[row, self.places[own]] = self.tf[own]
        return counts

    def answers(self, codes, dictionary, weights, sizes, floors, k: int):
        """Queries of so many terms (sizes) each, terms as numbers in a dictionary -> queries, places, scores: of each query the k best documents that hold a term, ties to the smaller place, but for such as are below a score (floors) that k others reach."""
        import numpy as np
        import pyarrow.compute as pc

        self.close()
        at = pc.fill_null(pc.index_in(dictionary, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        owners = np.repeat(np.arange(len(sizes)), sizes)
        # weights out of single precision's range, or that can lower a score, have no near sums, nor have more lists than roundings leave room for
        odd = (np.bincount(owners, ~((weights > 1e-20) & (weights < 1e20)), len(sizes)) > 0) | (sizes > MOST_LISTS)
        held = np.flatnonzero(at >= 0)
        owners, at, weights = owners[held], at[held], weights[held]
        most = np.bincount(owners, weights * self.tops[at], len(sizes))
        plain = ~odd & (most > 0) & (most >= floors - SLACK)
        found = [self._one(int(q), at[owners == q], weights[owners == q], float(floors[q]), k) for q in np.flatnonzero(odd)]
        asked, step = np.flatnonzero(plain), int(max(1, min(1_024, CELLS // max(1, self.n))))
        # queries whose sums are near share whole numbers, so a term's row is made once for them
        sort = np.ceil(np.log2(most[asked]) / 2).astype(np.int64)
        counted = self.counted() if len(asked) else None
        for kind in np.unique(sort).tolist():
            rows, steps, alike = Rows(self.n, "u2", 2 * MOST_ROWS), MOST_STEPS / 4.0**kind, asked[sort == kind]
            for first in range(0, len(alike), step):
                own = alike[first : first + step]
                firsts, lasts = np.searchsorted(owners, own), np.searchsorted(owners, own, "right")
                counts = lasts - firsts
                entries = spread(firsts, counts)
                queries, places, scores = self._some(rows, steps, counted, np.repeat(np.arange(len(own)), counts), at[entries], weights[entries], floors[own], k)
                found.append((own[queries], places, scores))
        none = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
        return tuple(np.concatenate(x) for x in zip(*(found or none)))

    def _one(self, query: int, at, weights, floor: float, k: int):
        import numpy as np

        plain = Postings(self.n)
        for j in at.tolist():
            places, tf = self.list_of(j)
            plain.terms[j] = (float(self.tops[j]), places, self.impacts(places, tf))
        places, scores, _, _ = plain.best(at.tolist(), weights.tolist(), k, floor)
        return np.full(len(places), query), places, scores

    def _some(self, rows, steps, counted, owners, at, weights, floors, k: int):
        """Some queries at a time: all lists are added in whole numbers of two bytes (`steps` a unit), rounded up; what can be among the k best by these sums gets its score in doubles."""
        import numpy as np

        n, lists = len(floors), np.bincount(owners, minlength=len(floors))
        row = np.minimum(np.searchsorted(self.long, at), max(0, len(self.long) - 1))
        long = self.long[row] == at if len(self.long) else np.zeros(len(at), dtype=bool)
        total = np.zeros((n, self.n), dtype="u2")
        long_owners, row, long_weights = owners[long], row[long], weights[long]
        for q, r, w in zip(long_owners.tolist(), row.tolist(), long_weights.tolist()):
            j = rows.at.get((r, w))
            if j is None:
                if len(rows.at) == rows.most:
                    rows.clear()
                places, tf = self.list_of(int(self.long[r]))
                j = rows.place((r, w), places, np.ceil(self.impacts(places, tf) * (w * steps)))
            own = total[q]
            np.add(own, rows.held[j], out=own)
        short, short_owners, short_weights = at[~long], owners[~long], weights[~long]
        firsts, sizes = self.starts[short], self.sizes[short]
        slices = [slice(x, y) for x, y in zip(firsts.tolist(), (firsts + sizes).tolist())] or [slice(0, 0)]
        cells = np.repeat(short_owners * self.n, sizes)
        cells += np.concatenate([self.places[x] for x in slices])
        near = np.concatenate([self.near[x] for x in slices]) * np.repeat((short_weights * (steps / IMPACT_STEPS)).astype("f4"), sizes)
        np.add.at(total.ravel(), cells, np.ceil(near, out=near).astype("u2"))
        rounded = lists + np.bincount(short_owners, short_weights, n) * (steps / IMPACT_STEPS)
        least = (floors - SLACK) * steps - 1
        loose = np.flatnonzero(floors <= 0)
        found = None
        if not len(loose):
            found, reached = self._reached(total, least)
            if len(found) > 16 * k * n:
                loose, found = np.arange(n), None
        if found is None:
            least[loose] = np.maximum(least[loose], floor_of(total[loose] if len(loose) < n else total, k).astype(np.float64) - rounded[loose] - 2)
            found, reached = self._reached(total, least)
        queries, places = np.divmod(found, self.n)
        kept = np.flatnonzero(reached[cells])
        entries = np.searchsorted(np.cumsum(sizes), kept, "right")
        own = kept - (np.cumsum(sizes) - sizes)[entries] + firsts[entries]
        parts = self.impacts(self.places[own], self.tf[own].astype(np.float64)) * short_weights[entries]
        scores = np.bincount(np.searchsorted(found, cells[kept]), parts, len(found))
        counts = np.bincount(long_owners, minlength=n)
        times = counts[queries]
        entries = spread((np.cumsum(counts) - counts)[queries], times)
        held = np.repeat(places, times)
        tf = counted[row[entries], held].astype(np.float64)
        scores = scores + np.bincount(np.repeat(np.arange(len(queries)), times), long_weights[entries] * self.impacts(held, tf), len(queries))
        order = np.lexsort((places, -np.round(scores, 9), queries))
        queries = queries[order]
        best = np.arange(len(queries)) - np.searchsorted(queries, queries) < k
        return queries[best], places[order][best], scores[order][best]

    def _reached(self, total, least):
        """Where the sums, as one row, reach what their row asks for."""
        import numpy as np

        reached = (total >= np.ceil(np.clip(least, 1, MOST_STEPS + MOST_LISTS)).astype("u2")[:, None]).ravel()
        return where(reached), reached


def spread(starts, sizes):
    """The whole numbers of ranges, one range after the other."""
    import numpy as np

    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _answered(k: int):
    """part, g, kind (0 ids, 1 postings, 2 queries), b, term, places, tf, ids, avgdl, query_id, terms, weights, sorted by the first four -> query_id, doc_id, score."""

    def answered(batches):
        import numpy as np
        import pyarrow as pa

        now, blocks = None, {}
        for batch in batches:
            for key, own in _by_block(batch):
                if now != key:
                    now, blocks = key, {}
                own = own.combine_chunks().to_batches()[0]
                ids_to, postings_to = np.searchsorted(own["kind"].to_numpy(), [1, 2]).tolist()
                for j in range(ids_to):
                    ids = copied(own["ids"].slice(j, 1).flatten())
                    blocks[own["b"][j].as_py()] = Block(ids, np.frombuffer(own["tf"][j].as_py(), dtype="<i4"), own["avgdl"][j].as_py())
                numbers = own["b"].slice(ids_to, postings_to - ids_to).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.diff(numbers)) + 1
                for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]) if len(numbers) else ():
                    terms, places, tf = (own[c].slice(ids_to + first, last - first) for c in ("term", "places", "tf"))
                    blocks[int(numbers[first])].add(copied(terms), places, tf)
                asked = own.slice(postings_to)
                if not asked.num_rows:
                    continue
                sizes, coded = np.diff(asked["terms"].offsets.to_numpy()), asked["terms"].flatten().dictionary_encode()
                codes, weights = coded.indices.to_numpy(zero_copy_only=False), asked["weights"].flatten().to_numpy(zero_copy_only=False)
                tops, found = np.zeros((len(sizes), k)), []  # the best scores so far, a row a query
                for block in blocks.values():
                    queries, places, scores = block.answers(codes, coded.dictionary, weights, sizes, tops.min(axis=1), k)
                    order = np.argsort(queries, kind="stable")
                    new = np.zeros((len(sizes), k))
                    new[queries[order], np.arange(len(order)) - np.searchsorted(queries[order], queries[order])] = scores[order]
                    tops = np.partition(np.concatenate([tops, new], axis=1), k, axis=1)[:, k:]
                    found.append((block, queries, places, scores))
                least = tops.min(axis=1) - SLACK
                for block, queries, places, scores in found:
                    own = np.flatnonzero((scores >= least[queries]) | (least[queries] <= 0))
                    if len(own):
                        yield pa.RecordBatch.from_arrays([asked["query_id"].take(pa.array(queries[own])), block.ids.take(pa.array(places[own])), pa.array(scores[own])], names=["query_id", "doc_id", "score"])

    return answered


class Index:
    """docs doc_id, text, and with `part` the column that names the memory a document belongs to. Written to path: stats, blocks, terms; a new scratch folder if none is given."""

    def __init__(self, docs: DataFrame, path: str | None = None, part: str | None = None):
        spark, self.part = docs.sparkSession, part
        self.path = path or scratch(spark)
        name = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
        held = docs.select(name.alias("part"), "doc_id", lowered(F.col("text")).alias("terms"))  # texts take less of a shuffle than their words
        stats = docs.groupBy(name.alias("part")).agg(F.count("*").alias("n_docs"))
        stats = stats.withColumn("blocks", block_count(spark, F.col("n_docs"), BLOCK_ROWS))
        stats.write.mode("errorifexists").parquet(f"{self.path}/stats")
        self.stats = spark.read.schema(stats.schema).parquet(f"{self.path}/stats")  # a row a part
        b = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
        dealt = held.join(F.broadcast(self.stats), "part").select("part", b.alias("b"), "doc_id", "terms")
        dealt = own_task(dealt, "part", "b", self.stats.agg(F.sum("blocks")).first()[0] or 1).sortWithinPartitions("part", "b", "doc_id")
        kind = docs.schema["doc_id"].dataType.simpleString()
        blocks = dealt.mapInArrow(_inverted, f"part string, b int, term string, n long, words long, places binary, tf binary, ids array<{kind}>")
        blocks.write.mode("errorifexists").parquet(f"{self.path}/blocks")
        self.blocks = spark.read.schema(blocks.schema).parquet(f"{self.path}/blocks")
        weights = term_weights(self.blocks.where("term is not null").groupBy("part", "term").agg(F.sum("n").alias("df")), self.stats.select("part", "n_docs"))
        weights.write.mode("errorifexists").parquet(f"{self.path}/terms")
        self.weights = spark.read.schema(weights.schema).parquet(f"{self.path}/terms")

    @property
    def n_docs(self) -> int:
        return self.stats.agg(F.sum("n_docs")).first()[0] or 0

    def scored(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score: up to k rows a query and block. Query terms that repeat count again."""
        spark, part = queries.sparkSession, F.coalesce(F.col(self.part).cast("string"), F.lit("")) if self.part else F.lit("")
        asked = queries.select(part.alias("part"), "query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("part", "query_id", "term").agg(F.count("*").alias("qf"))
        # few asked terms are broadcast, so that only their postings leave the tasks that scan the index
        vocabulary = few(asked.select("part", "term").distinct())
        weighted = asked.join(few(self.weights.join(vocabulary, ["part", "term"], "left_semi")), ["part", "term"])
        lists = weighted.groupBy("part", "query_id").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("qf") * F.col("idf")).alias("w")))).alias("x"))
        kinds = {f.name: f.dataType.simpleString() for f in [*self.blocks.schema.fields, *queries.schema.fields]}
        none = lambda *names: [F.lit(None).cast(kinds[n]).alias(n) for n in names]
        # empty lists, not null ones: with each row, Spark's Arrow writer goes again over all nulls that end a column of lists
        empty = [F.array().cast("array<string>").alias("terms"), F.array().cast("array<double>").alias("weights")]
        no_ids = F.array().cast(kinds["ids"]).alias("ids")
        cores = spark.sparkContext.defaultParallelism
        lengths = self.blocks.where("term is null").groupBy("part").agg((F.sum("words") / F.sum("n")).alias("avgdl"))  # a row a part
        sizes = self.stats.select("part", "blocks", F.greatest(F.ceil(F.col("blocks") / GROUP_BLOCKS), F.least("blocks", F.lit(cores))).cast("int").alias("groups"))
        tasks = sizes.agg(F.sum("groups")).first()[0] or 1
        ids = self.blocks.where("term is null").join(F.broadcast(lengths), "part").select("part", "b", F.lit(0).alias("kind"), *none("term", "places"), "tf", "ids", "avgdl", *none("query_id"), *empty)
        found = self.blocks.where("term is not null").join(vocabulary, ["part", "term"], "left_semi").select("part", "b", F.lit(1).alias("kind"), "term", "places", "tf", no_ids, F.lit(None).cast("double").alias("avgdl"), *none("query_id"), *empty)
        grouped = ids.unionByName(found).join(F.broadcast(sizes), "part").withColumn("g", F.pmod("b", "groups").cast("int")).drop("blocks", "groups")
        streamed = lists.join(F.broadcast(sizes), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast("int").alias("b"), F.lit(2).alias("kind"), *none("term", "places", "tf"), no_ids, F.lit(None).cast("double").alias("avgdl"), "query_id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))
        order = ["part", "g", "kind", "b", "term", "places", "tf", "ids", "avgdl", "query_id", "terms", "weights"]
        dealt = own_task(grouped.unionByName(streamed).select(*order), "part", "g", tasks).sortWithinPartitions("part", "g", "kind", "b")
        return dealt.mapInArrow(_answered(k), f"query_id {kinds['query_id']}, doc_id {self.blocks.schema['ids'].dataType.elementType.simpleString()}, score double")

    def matched(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank: the k best documents (of the query's part) that share a term with the query."""
        return ranked(self.scored(queries, k), k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, path: str | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: k rows a query; where fewer documents match, those without a score follow by id with score 0."""
    best = Index(docs, path).matched(queries, k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("found"))
    # the k smallest ids (2k, as up to k of them may have matched) are enough to fill from
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k).agg(F.array_sort(F.collect_list("doc_id")).alias("first"))
    every = queries.select("query_id").distinct().join(best, "query_id", "left").crossJoin(F.broadcast(first))  # first is one row
    held = F.coalesce(F.transform("found", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score"))), F.array())
    filler = F.filter("first", lambda i: ~F.coalesce(F.array_contains(F.transform("found", lambda x: x["doc_id"]), i), F.lit(False)))
    whole = F.slice(F.concat(held, F.transform(filler, lambda i: F.struct(i.alias("doc_id"), F.lit(0.0).alias("score")))), 1, k)
    return every.select("query_id", F.posexplode(whole).alias("at", "x")).select("query_id", "x.doc_id", "x.score", (F.col("at") + 1).alias("rank"))
