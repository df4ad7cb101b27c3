"""Source divergence audit by sort-based streaming: how far the term frequencies of the sources of a language are apart.

Rows (lang, term, source, document, docs, n) are repartitioned and sorted by their first four columns (lang and term as one key, joined by a zero
character, which no term has, so that sorting compares the term's first letters at once), and a run-length scan of the sorted rows gives the document frequency and the counts of each term. A map task first adds up consecutive documents of a source (`document` is
the first of them, `docs` how many hold the term, `n` how often they do), so a frequent term is one row a task and source. What is left of it is dealt
by a salt of the document to SALTS tasks, each of which scans its own runs; a second sort brings the partial runs together, again by runs.
A run (lang, term) that enough documents hold is written as one row with its counts by source.

From these rows come the totals N and V, and in a second scan each run emits its part of the distance of every two sources, summed up a task,
and its terms, of which a task keeps the TOP first ones of each source. Frequencies p = 1 + floor(SCALE * (n + 5) / (N + 5 V)) are exact:
the division is done in whole numbers, three digits at a time, for denominators under 9e15; sums of them are 64-bit.

Null texts, languages and sources are ''. Every row is a document, whatever its doc_id, which is not read. Texts are read in slices
of a megabyte. Groups without terms still meet the others of their language; a language with one source has no pairs. Empty tables give no rows. The table of
(lang, source) groups goes to every task: more than GROUPS of them are an error. Columns of any other name are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import staged

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Tasks that the rows of one frequent term are dealt to; terms that a map task holds before it writes them out; groups of all languages.
SALTS, HELD, GROUPS = 16, 500_000, 50_000
SLICE = 1 << 20
#: A-Z to lower case; letters and bytes over 0x7F stay, all others part terms.
LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Runs whose frequencies are compared at once, and cells of a table of sums by two sources.
RUNS, CELLS = 256, 4_000_000


def term_slices(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, as UTF-8: runs of letters A-Z, in lower case, and of characters over 0x7F."""
    body, first = text.encode("utf-8").translate(LETTERS), 0
    while first < len(body):
        last = len(body)
        if last - first > SLICE and (cut := body.find(b" ", first + SLICE)) >= 0:
            last = cut
        yield body[first:last].split()
        first = last


def _counted(batches):
    """at, lang, source, text -> key (lang and term), source, document, docs, n: sums over consecutive documents of a task."""
    from collections import Counter

    import pyarrow as pa

    docs, counts, start, size = {}, {}, {}, 0

    def rows():
        for (lang, source), held in counts.items():
            df = docs[lang, source]
            terms, head = list(held), lang.encode() + b"\0"
            fixed = lambda value, kind: pa.array([value] * len(terms), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array([head + t for t in terms], pa.binary()).cast(pa.string()), fixed(source, pa.string()), fixed(start[lang, source], pa.int64()), pa.array([df[t] for t in terms], pa.int64()), pa.array(list(held.values()), pa.int64())],
                names=["key", "source", "document", "docs", "n"],
            )

    for batch in batches:
        for at, lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            group, met = (lang, source), set()
            if group not in counts:
                counts[group], docs[group], start[group] = Counter(), Counter(), at
            own = counts[group]
            size -= len(own)
            for terms in term_slices(text.as_py()):
                own.update(terms)
                met.update(terms)
            docs[group].update(met)
            size += len(own)
            if size > HELD:
                yield from rows()
                docs, counts, start, size = {}, {}, {}, 0
    yield from rows()


def _runs(key: list[str], values: Callable) -> Callable:
    """Sorted rows -> values(table) of whole runs of equal keys; a run that goes on in the next batch waits for it."""

    def scanned(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            n = table.num_rows
            if not n:
                continue
            # the first row of the last run
            same = np.ones(n, dtype=bool)
            for name in key:
                same &= pc.equal(table[name], table[name][n - 1]).to_numpy(zero_copy_only=False)
            cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield values(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield values(rest.combine_chunks())

    return scanned


def _starts(table, key: list[str]):
    """Where runs of equal keys begin."""
    import numpy as np
    import pyarrow.compute as pc

    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in key:
        column = table[name].combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _sums(table, starts, name: str):
    import numpy as np

    return np.add.reduceat(table[name].to_numpy(), starts)


def _partial(table):
    """A row a run (key, source)."""
    import pyarrow as pa

    starts = _starts(table, ["key", "source"])
    kept = table.take(pa.array(starts)).combine_chunks()
    return pa.RecordBatch.from_arrays([*(kept[c].combine_chunks() for c in ("key", "source")), pa.array(_sums(table, starts, "docs")), pa.array(_sums(table, starts, "n"))], names=["key", "source", "docs", "n"])


def _whole(least: int) -> Callable:
    """A row a run (key) that at least so many documents hold: its sources and their counts."""

    def whole(table):
        import numpy as np
        import pyarrow as pa

        by_source = pa.Table.from_batches([_partial(table)])
        starts = _starts(by_source, ["key"])
        kept = np.flatnonzero(_sums(by_source, starts, "docs") >= least)
        bounds = np.append(starts, by_source.num_rows)
        rows = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in kept]) if len(kept) else np.zeros(0, dtype=np.int64)
        offsets = pa.array(np.append(0, np.cumsum(bounds[kept + 1] - bounds[kept])), pa.int32())
        first, every = by_source.take(pa.array(starts[kept])), by_source.take(pa.array(rows))
        listed = [pa.ListArray.from_arrays(offsets, every[c].combine_chunks()) for c in ("source", "n")]
        return pa.RecordBatch.from_arrays([first["key"].combine_chunks(), *listed], names=["key", "sources", "counts"])

    return whole


def kept_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, sources, counts: a row for each term that at least so many documents of a language hold."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    counted = docs.select(F.monotonically_increasing_id().alias("at"), empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    counted = counted.mapInArrow(_counted, "key string, source string, document long, docs long, n long")
    salt = F.pmod(F.xxhash64("document"), F.lit(SALTS))
    partial = counted.repartition("key", salt).sortWithinPartitions("key", "source", "document").mapInArrow(_runs(["key", "source"], _partial), "key string, source string, docs long, n long")
    whole = partial.repartition("key").sortWithinPartitions("key", "source").mapInArrow(_runs(["key"], _whole(least)), "key string, sources array<string>, counts array<long>")
    term = F.substring_index("key", "\0", -1)
    return whole.select(F.left("key", F.length("key") - F.length(term) - 1).alias("lang"), term.alias("term"), "sources", "counts")


def frequencies(counts, total):
    """1 + floor(SCALE * counts / total) in whole numbers; counts and totals under 9e15, no count over its total."""
    import numpy as np

    whole, rest = np.divmod(counts, total)
    step = SCALE
    while step > 1:
        digits, rest = np.divmod(rest * 1000, total)
        whole, step = whole * 1000 + digits, step // 1000
    return whole + 1


def _compared(groups: dict, top: int) -> Callable:
    """lang, term, sources, counts -> lang, source, item, value: the two sources' part of a distance (kind pair, a < b), or a term (kind term)."""

    def compared(batches):
        import numpy as np
        import pyarrow as pa

        sums, best = {}, {}

        def pairs(lang):
            names, cells = groups[lang][0], sums.pop(lang)
            a, b = np.triu_indices(len(names), 1)
            for first in range(0, len(a), 100_000):
                own = slice(first, first + 100_000)
                yield batch_of(["pair"] * len(a[own]), lang, [names[k] for k in a[own]], [names[k] for k in b[own]], cells[a[own], b[own]])

        def batch_of(kind, lang, source, item, value):
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array([lang] * len(kind), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["part", "lang", "source", "item", "value"])

        def met(lang, terms, lists, counts):
            names, totals, kept = groups[lang]
            place = {s: k for k, s in enumerate(names)}
            table = np.zeros((len(terms), len(names)), dtype=np.int64)
            for row, (own, n) in enumerate(zip(lists, counts)):
                table[row, [place[s] for s in own]] = n
            p = frequencies(table + SMOOTH, totals + SMOOTH * kept)
            q = frequencies(table.sum(axis=1) + SMOOTH, totals.sum() + SMOOTH * kept)
            held = len(names) ** 2 <= CELLS
            if held and lang not in sums:
                sums[lang] = np.zeros((len(names), len(names)), dtype=np.int64)
            for k in range(len(names) - 1):
                own = np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(axis=0)
                if held:
                    sums[lang][k, k + 1 :] += own
                else:  # too many sources for a table in a task: these runs' part at once
                    yield batch_of(["pair"] * len(own), lang, [names[k]] * len(own), names[k + 1 :], own)
            over = p - q[:, None]
            for k, source in enumerate(names):
                at = np.flatnonzero((table[:, k] > 0) & (over[:, k] > 0))
                if len(at):
                    own = [*best.get((lang, source), ()), *((-int(over[t, k]), terms[t].encode()) for t in at)]
                    best[lang, source] = sorted(own)[:top]

        for batch in batches:
            by_lang = {}
            for row, lang in enumerate(batch.column(0).to_pylist()):
                by_lang.setdefault(lang, []).append(row)
            for lang, rows in by_lang.items():
                for first in range(0, len(rows), RUNS):
                    own = batch.take(pa.array(rows[first : first + RUNS]))
                    yield from met(lang, *(own.column(c).to_pylist() for c in (1, 2, 3)))
                if sum(x.size for x in sums.values()) > CELLS:
                    for held in list(sums):
                        yield from pairs(held)
        for lang in list(sums):
            yield from pairs(lang)
        for (lang, source), found in best.items():
            yield batch_of(["term"] * len(found), lang, [source] * len(found), [t.decode() for _, t in found], [-v for v, _ in found])

    return compared


def groups_of(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> dict:
    """lang -> (its sources in their order, each one's count N of kept terms, the number V of kept terms)."""
    import numpy as np

    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    every = docs.select(empty(lang), empty(source)).toDF("lang", "source").distinct()
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    rows = every.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")).limit(GROUPS + 1).collect()
    if len(rows) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups of language and source")
    sizes = {r["lang"]: r["v"] for r in kept.groupBy("lang").agg(F.count("*").alias("v")).collect()}  # no more than groups
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["lang"].encode(), r["source"].encode())):
        out.setdefault(r["lang"], []).append((r["source"], r["n"]))
    return {g: ([s for s, _ in x], np.array([n for _, n in x], dtype=np.int64), sizes.get(g, 0)) for g, x in out.items()}


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows, the distance of a source to each other source of its language; `term` rows, the terms that it has more of than its language, the first `top` of them."""
    kept = staged(kept_terms(docs, lang, source, text, least))
    groups = groups_of(docs, kept, lang, source)
    found = kept.mapInArrow(_compared(groups, top), "part string, lang string, source string, item string, value long")
    found = staged(found)
    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # languages without a kept term: distance 0
    bare = [(g, a, b, 0) for g, (names, _, kept_) in groups.items() if not kept_ for k, a in enumerate(names) for b in names[k + 1 :]]
    if bare:
        half = half.unionByName(docs.sparkSession.createDataFrame(bare, "lang string, source string, item string, value long"))
    both = half.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.unionByName(terms).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
df AS MATERIALIZED (SELECT lang, term FROM tok GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
cnt AS (SELECT lang, source, term, sum(n) AS n FROM tok JOIN df USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
gn AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + {SCALE}::HUGEINT * (coalesce(n, 0) + {SMOOTH}) // (total + {SMOOTH} * v) AS BIGINT) AS p
  FROM gn JOIN df USING (lang) JOIN v USING (lang) LEFT JOIN cnt USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + {SCALE}::HUGEINT * (n + {SMOOTH}) // (total + {SMOOTH} * v) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM cnt GROUP BY ALL) JOIN (SELECT lang, sum(total) AS total FROM gn GROUP BY lang) USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
every AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value FROM pairs UNION ALL SELECT lang, source, part, item, CAST(value AS BIGINT) FROM terms)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every) WHERE part = 'pair' OR rank <= {TOP}
"""
