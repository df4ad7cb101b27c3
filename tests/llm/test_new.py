"""Codes by exponion search, the divergence audit and the LSH forest: against plain versions, and with odd input."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import buckets, divergence, forest, quantize
from sievekit.llm.simhash import shingle_set

CLASH = ("code", "error", "x", "at", "slot", "n", "s", "raw", "rank", "item", "part", "value", "docs", "document", "node", "row", "tree", "branch", "key", "kept")


def with_clashes(rows):
    return rows.withColumns({c: F.lit(7) for c in CLASH})


# codes


def plain_codes(rows, parts, entries, rounds):
    """rows (id, label, vector) -> {position: (code, error)}, codebooks: every entry is looked at."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.floor(np.array([r[2] for r in rows], dtype=np.float64) * 1024).astype(np.int64)
    cuts = [x.shape[1] * k // parts for k in range(parts + 1)]
    own = [x[:, a:b] for a, b in zip(cuts, cuts[1:])]
    books = [p[:entries].copy() for p in own]
    for k in range(rounds + 1):
        squares = [((p[:, None] - b[None]) ** 2).sum(axis=2) for p, b in zip(own, books)]
        at = [s.argmin(axis=1) for s in squares]
        if k < rounds:
            for p, b, a in zip(own, books, at):
                for e in set(a.tolist()):
                    b[e] = p[a == e].sum(axis=0) // (a == e).sum()
    codes = ["".join(f"{a[j]:02x}" for a in at) for j in range(len(rows))]
    errors = [int(sum(s[j, a[j]] for s, a in zip(squares, at))) for j in range(len(rows))]
    return [(r[0], r[1], c, e) for r, c, e in zip(rows, codes, errors)], books


@pytest.mark.parametrize("entries", [3, 16])
def test_codes_against_all_entries(spark, entries):
    rnd = random.Random(entries)
    rows = [(k, rnd.choice(["a", "b", None]), [rnd.choice([-0.5, 0.0, 0.25, rnd.uniform(-1, 1)]) for _ in range(8)]) for k in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").repartition(5)
    rows = [(i, g, [float(np.float32(x)) for x in v]) for i, g, v in rows]
    want, books = plain_codes(rows, 4, entries, 4)
    got = quantize.coded(table, entries=entries).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(i, c, e) for i, _, c, e in want]
    by_label = Counter()
    for _, g, _, e in want:
        by_label[g] += e
    assert {r.vec_id: r.label_error for r in got} == {i: by_label[g] for i, g, _, _ in want}
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()}


def test_search_is_exact_and_reads_less():
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-900, 900, (64, 16))
    rows = centres[rnd.integers(0, 64, 4000)] + rnd.integers(-20, 20, (4000, 16))
    book = quantize.Codebook(np.concatenate([centres, centres[:8]]))  # eight entries twice: ties go to the first
    start = rnd.integers(0, 72, 4000).astype(np.uint8)
    near, squares, _ = book.search(rows, start)
    every = ((rows[:, None] - book.entries[None]) ** 2).sum(axis=2)
    assert (near == every.argmin(axis=1)).all() and (squares == every.min(axis=1)).all() and near.max() < 64
    again, _, looked = book.search(rows, near.astype(np.uint8))
    assert (again == near).all() and looked < 4000 * 72 / 3


def test_codes_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, [0.1] * 6), (1, None, [0.1] * 6), (None, 3, [0.5, 0.0, 0.0, 0.0, 0.0, -0.5]), (2, 3, None), (3, 3, []), (4, 3, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (5, 3, [inf] * 6), (6, 3, [nan] * 6), (7, 3, [0.1] * 8)]
    table = with_clashes(spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>"))
    got = quantize.coded(table).collect()
    assert sorted((r.vec_id or 0, r.code, r.error) for r in got) == [(0, "02020202", 0), (1, "00000000", 0), (1, "00000000", 0)]
    assert quantize.coded(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        quantize.coded(spark.createDataFrame([(1, 1, [1e9] * 4)], "vec_id long, label long, embedding array<double>")).collect()


# divergence


def plain_audit(rows, least, top):
    """rows (lang, source, text) -> the audit's rows."""
    import re

    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda n, total: 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(kept))
        n = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        p = {s: {t: share(c, sum(n[s].values())) for t, c in n[s].items()} for s in sources}
        every = sum(sum(x.values()) for x in n.values())
        q = {t: share(sum(n[s][t] for s in sources), every) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("held, cells", [(200_000, 4_000_000), (40, 4), (40, 4_000_000)])
def test_audit_against_plain(spark, held, cells, monkeypatch):
    """Also with map tasks that write out often, and with too many sources for a table of pairs."""
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rnd = random.Random(2)
    words = ["Alpha", "beta", "Ünder", "x\u0000y", "don't", "日本語", "ÀB", "[z]", "_u_", "é"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s1", "S2", "é", "", None]), " ".join(rnd.choice(words[: rnd.randint(3, 30)]) for _ in range(rnd.randint(0, 12)))) for _ in range(400)]
    rows += [("xx", "only", "alone"), ("yy", "a", None), ("yy", "b", ""), ("zz", "b", "\x7f{}"), ("a\0b", "s", "alpha " * 5)] + [("a\0b", "t", "alpha beta"), ("a", "t", "b alpha")] * 5 + [("en", "s1", "hot " * 50)] * 200
    table = with_clashes(spark.createDataFrame(rows, "lang string, source string, text string").repartition(7))
    got = divergence.audit(table, least=5, top=6)
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got.collect()) == plain_audit(rows, 5, 6)


def test_audit_of_nothing_and_of_long_texts(spark, monkeypatch):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).count() == 0
    monkeypatch.setattr(divergence, "SLICE", 100)
    text = "aa bb " * 1000 + "c" * 500 + " dd"
    assert [t for part in divergence.term_slices(text) for t in part] == text.encode().split()
    total = np.array([10**15 + 7, 3, 7])
    assert divergence.frequencies(np.array([10**15 + 6, 3, 1]), total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip([10**15 + 6, 3, 1], total)]


def test_one_row_a_frequent_term_and_task(spark):
    """What the first shuffle moves grows with terms a task, not with documents."""
    rows = spark.range(20_000).select(F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit("the same few words").alias("text")).repartition(4)
    assert rows.select(F.monotonically_increasing_id().alias("at"), "lang", "source", "text").mapInArrow(divergence._counted, "key string, source string, document long, docs long, n long").count() == 16


# forest


def plain_components(texts, least=85):
    sets = [set(shingle_set(t or "").tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("few, crowded, tile", [(32, 2048, 2048), (2, 4, 5)])
def test_forest_against_all_pairs(spark, few, crowded, tile, monkeypatch):
    """Chains of edits, groups of copies, a passage that all share; also with regions cut deep and tiled."""
    monkeypatch.setattr(forest, "FEW", few)
    monkeypatch.setattr(forest, "CROWDED", crowded)
    monkeypatch.setattr(buckets, "TILE_ROWS", tile)
    rnd = random.Random(few)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    shared, texts = [word() for _ in range(60)], []
    for _ in range(25):
        text = [*shared, *(word() for _ in range(rnd.randint(5, 200)))]
        for _ in range(rnd.randint(1, 12)):  # each near the one before it, not the first
            texts.append(" ".join(text))
            for _ in range(rnd.randint(0, max(1, len(text) // 60))):
                text[rnd.randrange(len(text))] = word()
    texts += ["tiny text", "Tiny  TEXT", "tiny text\n", "one two three four five", "", " \n", None]
    rows = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    roots, sizes = plain_components(texts)
    want = sorted((3 * k, n, 3 * r, k == r) for k, (r, n) in enumerate(zip(roots, sizes)))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in forest.near_duplicates(rows).collect()) == want


def test_forest_recall_at_the_threshold(spark):
    """Pairs just over the threshold, and none under it."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, linked = [], {}
    for k in range(400):
        text = [word() for _ in range(rnd.randint(80, 300))]
        other = list(text)
        cut = rnd.randint(1, len(text) // 5)
        other[-cut:] = [word() for _ in range(cut)]
        a, b = set(shingle_set(" ".join(text)).tolist()), set(shingle_set(" ".join(other)).tolist())
        linked[2 * k + 1] = 100 * len(a & b) >= 85 * len(a | b)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    assert 50 < sum(linked.values()) < 350
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] == k - 1 for k in linked} == linked


def test_regions_by_density(spark):
    """Sparse regions are left at the shallow prefix, dense ones are cut deeper; no row of a region is lost."""
    same = lambda *labels: b"".join(x.to_bytes(2, "big") for x in labels)
    rows = [(0, same(1, 2, 3, 4, k, k), k) for k in range(5)] + [(0, same(9, 9, 9, 9, k % 2, k), 100 + k) for k in range(80)] + [(1, same(1, 2, 3, 4, 5, 6), 500)]
    trees = spark.createDataFrame([(t, bytearray(b), n, 8) for t, b, n in rows], "tree int, branch binary, node long, bytes long")
    found = defaultdict(set)
    for r in forest.regions(trees).collect():
        found[r.key].add(r.node)
    assert sorted(map(sorted, found.values())) == [list(range(5)), list(range(100, 180, 2)), list(range(101, 180, 2))]


def test_forest_of_odd_rows(spark):
    long_ = "word%d " * 3
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "no id here"), (None, "no id here"), (4, " ".join(long_ % (k, k + 1, k + 2) for k in range(20000))), (5, None), (6, ""), (7, "tie"), (8, "TIE")]
    got = forest.near_duplicates(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    told = Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in got)
    assert told == Counter({(1, True, 1, True): 2, (None, True, 1, False): 1, (None, True, None, True): 2, (4, True, 4, True): 1, (5, False, 5, True): 1, (6, False, 6, True): 1, (7, True, 7, True): 1, (8, True, 7, False): 1})
    assert forest.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
