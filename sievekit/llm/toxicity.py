"""Toxicity by weak supervision.

Three lexicons that mark toxic texts are mined from a bounded sample of labelled rows, each from another view of the words: how they begin, whole words,
and how they end. They make lexicon voters by view and length; pattern voters look at how hits stand in the text (several different ones, many, dense, next to a
word of address, shouted, with marks of exclamation) and at texts without any hit. A voter speaks or is silent. A generative label model then sees the votes only, no labels: expectation
maximisation estimates how often each voter speaks on toxic and on clean texts, and correlation factors: within a class a voter may depend on one
other voter, so that the likelihood of a text's votes is a product along a forest of voters. The forest is the one with most conditional mutual
information, of the edges that pay for their parameters. A linear classifier is trained on its posterior labels and scores every text, as a Column.

Null texts are empty and score as such. Null doc_ids are scored and in no fold. Repeated rows are scored each. Very long texts
are read whole. With no labelled rows (or none of one class) no stem is found and every score is the prior. Empty
tables give no rows. Other columns pass or are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import staged
from sievekit.llm.learning import HELD_OUT, fold_of, labelled, linear_score, logistic, sigmoid
from sievekit.llm.secrets import let

STEM_LETTERS = range(3, 13)
STEMS, CANDIDATES, MIN_TOXIC_DOCS, MIN_PRECISION = 240, 20_000, 4, 0.85
#: Views of a word that lexicons are mined from: its beginnings, itself, its endings; the lengths that are its short, middle and long entries start at these.
VIEWS, LENGTHS = ("begins", "is", "ends"), (0, 5, 7)
END_LETTERS = range(4, 7)
LEXICON_VOTERS, PATTERN_VOTERS = len(VIEWS) * len(LENGTHS), 7
#: Words that address a reader, in the languages that texts come in.
ADDRESS = "you your yours yourself thou tu toi vous votre te usted tú vosotros du dich dir ihr euch"
THRESHOLD = 0.3
ROUNDS, FOREST_ROUNDS = 60, 6


def unlike(sample: DataFrame) -> DataFrame:
    """text, y: one row of those that share their label and the three least hashes of their longer words, so that copies count once."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"\s+")), lambda w: F.length(w) >= 8)
    least = F.slice(F.array_sort(F.transform(words, lambda w: F.xxhash64(w))), 1, 3)
    return sample.withColumn("least", F.when(F.size(least) == 3, least).otherwise(F.array(F.xxhash64("text")))).groupBy("least", "y").agg(F.min_by("text", "doc_id").alias("text")).select("text", "y")


def parts_of(word: str, views: tuple[str, ...]) -> set[tuple[str, str]]:
    """(view, part) of a word for every part that a lexicon could hold."""
    out = set()
    if "begins" in views:
        out |= {("begins", word[:n]) for n in STEM_LETTERS if n <= len(word)}
    if "is" in views and len(word) >= STEM_LETTERS[0]:
        out.add(("is", word))
    if "ends" in views:
        out |= {("ends", word[-n:]) for n in END_LETTERS if n <= len(word)}
    return out


def counted(texts: DataFrame, views: tuple[str, ...], wanted: frozenset[tuple[str, str]] | None = None) -> DataFrame:
    """text -> view, part, docs: how many texts have a word with that part (one of those wanted). Batches are counted before the shuffle."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        words = re.compile(r"[^\W\d_]+").findall
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                parts = {p for w in set(words(text.lower())) for p in parts_of(w, views)}
                counts.update(parts if wanted is None else parts & wanted)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in counts], pa.string()), pa.array([p[1] for p in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["view", "part", "docs"])

    return texts.select("text").mapInArrow(count, "view string, part string, docs long").groupBy("view", "part").agg(F.sum("docs").alias("docs"))


def mine_lexicons(texts: DataFrame, toxic_docs: int, clean_docs: int, views: tuple[str, ...] = VIEWS) -> list[list[str]]:
    """For each view at most STEMS parts, best first by the likelihood ratio of their counts, which has to hold for as many tries as there are parts; no beginning starts with another, no ending ends with another."""
    import math

    toxic = counted(texts.where("y >= 0.5"), views).cache()
    tries = toxic.count()
    often = {(r["view"], r["part"]): r["docs"] for r in toxic.where(F.col("docs") >= MIN_TOXIC_DOCS).orderBy(F.desc("docs"), "part", "view").limit(CANDIDATES).collect()}
    toxic.unpersist()
    clean = {(r["view"], r["part"]): r["docs"] for r in counted(texts.where("y < 0.5"), views, frozenset(often)).collect()} if often else {}
    prior = (toxic_docs + 1) / (toxic_docs + clean_docs + 2)

    def gain(part: tuple[str, str]) -> float:
        t, c = often[part], clean.get(part, 0)
        share = t / (t + c)
        return t * math.log(share / prior) + (c * math.log((1 - share) / (1 - prior)) if c else 0) if share >= MIN_PRECISION else 0.0

    def covers(view: str, a: str, b: str) -> bool:
        return a.startswith(b) or b.startswith(a) if view == "begins" else a.endswith(b) or b.endswith(a) if view == "ends" else a == b

    chosen: dict[str, list[str]] = {v: [] for v in views}
    for part in sorted(often, key=lambda x: (-gain(x), -len(x[1]), x)):
        view, text = part
        if len(chosen[view]) < STEMS and gain(part) > math.log(tries) and not any(covers(view, text, other) for other in chosen[view]):
            chosen[view].append(text)
    return [chosen[v] for v in views]


def mine_stems(texts: DataFrame, in_docs: int, out_docs: int) -> list[str]:
    """The lexicon of word beginnings alone."""
    return mine_lexicons(texts, in_docs, out_docs, ("begins",))[0]


@dataclass
class LabelModel:
    """P(voter speaks | class, vote of the voter it depends on), and the prior of class 1. Voters that depend on none have the same rate for both votes."""

    prior: float
    parents: list[int]  # -1: none
    given: object  # class x vote of the parent x voters
    speaks: object  # class x voters, whatever the parent votes

    def posterior(self, votes):
        import numpy as np

        parent = np.where(np.array(self.parents) >= 0, votes[:, self.parents], 0).astype(int)
        logs = []
        for c in (0, 1):  # silence is evidence too, as far as the voter speaks on texts of one class more than on those of the other
            rate = np.where(parent == 1, self.given[c][1], self.given[c][0])
            logs.append(np.where(votes == 1, np.log(rate), np.log(1 - rate)).sum(axis=1))
        return sigmoid(np.log(self.prior / (1 - self.prior)) + logs[1] - logs[0])


def forest(votes, weights) -> list[int]:
    """The parent of each voter (-1: none) in the forest of most mutual information within the classes (weights: class x documents); an edge has to gain more likelihood than its two parameters cost."""
    import numpy as np

    n, m = votes.shape
    gain = np.zeros((m, m))
    for w in weights:
        total = max(float(w.sum()), 1e-9)
        both = (votes * w[:, None]).T @ votes / total
        one = np.diag(both)
        for cell, a, b in ((both, one[:, None], one[None, :]), (one[:, None] - both, one[:, None], 1 - one[None, :]), (one[None, :] - both, 1 - one[:, None], one[None, :]), (1 - one[:, None] - one[None, :] + both, 1 - one[:, None], 1 - one[None, :])):
            gain += total * np.where(cell > 1e-12, cell * np.log(np.maximum(cell, 1e-12) / np.maximum(a * b, 1e-12)), 0.0)
    cost, parents, left = np.log(max(n, 2)), [-1] * m, set(range(m))
    while left:
        root = min(left)
        left.remove(root)
        inside = [root]
        while left:
            worth, a, b = max((gain[a, b], -a, -b) for a in inside for b in left)
            if worth <= cost:
                break
            parents[-b] = -a
            inside.append(-b)
            left.remove(-b)
    return parents


def fit_label_model(votes, prior: float) -> LabelModel:
    """votes: documents x voters of 0 and 1, without labels. Starts from the share of voters that speak; voters are independent at first, and depend on each other from half the rounds on."""
    import numpy as np

    prior = min(max(prior, 1e-3), 1 - 1e-3)
    n, m = votes.shape
    q = np.where(votes[:, :LEXICON_VOTERS].any(axis=1), 0.9, 0.02)
    model = LabelModel(prior, [-1] * m, np.full((2, 2, m), 0.5), np.full((2, m), 0.5))
    for k in range(ROUNDS):
        weights = np.stack([1 - q, q])
        model.speaks = np.clip((weights @ votes + 0.5) / (weights.sum(axis=1, keepdims=True) + 1), 1e-4, 1 - 1e-4)
        if k >= ROUNDS // 2 and k % FOREST_ROUNDS == 0:  # posteriors of a model without factors make up factors of their own, which later ones drop
            model.parents = forest(votes, weights)
        for j, parent in enumerate(model.parents):
            for v in (0, 1):
                when = weights * (votes[:, parent] == v) if parent >= 0 else weights
                # two documents' worth of the voter's own rate, where the parent's vote is rare
                model.given[:, v, j] = np.clip((when @ votes[:, j] + 2 * model.speaks[:, j]) / (when.sum(axis=1) + 2), 1e-4, 1 - 1e-4)
        q = model.posterior(votes)
    return model


@dataclass
class Scorer:
    lexicons: list[list[str]]
    intercept: float
    weights: list[float]
    model: LabelModel | None = None

    def score(self, text: Column) -> Column:
        if not self.weights:
            return linear_score(self.intercept, [])
        return let(features(text, self.lexicons), lambda x: linear_score(self.intercept, [(w, F.get(x, k)) for k, w in enumerate(self.weights)]))


def trie_pattern(stems: list[str]) -> str:
    """A pattern for any of the stems, by their common beginnings."""
    if "" in stems:
        return ""
    heads: dict[str, list[str]] = {}
    for s in sorted(stems):
        heads.setdefault(s[0], []).append(s[1:])
    parts = [re.escape(c) + (trie_pattern(rest) if len(rest) > 1 else re.escape(rest[0])) for c, rest in heads.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def by_length(lexicon: list[str]) -> list[list[str]]:
    """A lexicon's short, middle and long parts."""
    ends = [*LENGTHS[1:], 1 << 30]
    return [[x for x in lexicon if a <= len(x) < b] for a, b in zip(LENGTHS, ends)]


def features(text: Column, lexicons: list[list[str]]) -> Column:
    """array<double>: the voters (0 or 1), lexicons first, then logarithms of different hits and of all hits."""
    begins, whole, ends = lexicons
    lower = F.lower(text)
    found = F.regexp_extract_all(lower, F.lit(rf"(?<!\p{{L}})({trie_pattern(begins)})"), 1) if begins else F.array().cast("array<string>")
    words = F.regexp_extract_all(lower, F.lit(r"(\p{L}+)"), 1)
    shouting = F.length(F.regexp_replace(text, "[^A-Z]", "")) * 2 > F.length(text)
    exclaiming = F.contains(text, F.lit("!!"))
    is_in = lambda x, parts: F.arrays_overlap(x, F.array(*map(F.lit, parts))) if parts else F.lit(False)

    def of(x: Column) -> Column:
        hits, known = x["hits"], x["words"]
        kinds, count, size = F.size(F.array_distinct(hits)), F.size(hits), F.size(known)
        tails = lambda n: F.transform(known, lambda w: F.when(F.length(w) >= n, F.right(w, F.lit(n))).otherwise(""))
        ending = lambda parts: F.array_max(F.array(F.lit(False), *[is_in(tails(n), own) for n in END_LETTERS if (own := [p for p in parts if len(p) == n])]))
        lexicon = [*[is_in(hits, p) for p in by_length(begins)], *[is_in(known, p) for p in by_length(whole)], *[ending(p) for p in by_length(ends)]]
        addressed = (count > 0) & F.arrays_overlap(known, F.array(*map(F.lit, ADDRESS.split())))
        patterns = [kinds >= 2, count >= 3, count * 100 > size, addressed, shouting, exclaiming, count == 0]
        return F.array(*[F.coalesce(v, F.lit(False)).cast("double") for v in [*lexicon, *patterns]], F.log1p(kinds.cast("double")), F.log1p(count.cast("double")))

    return let(F.struct(found.alias("hits"), words.alias("words")), of)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Scorer:
    """Labels teach stems and the prior; the rest learns from votes."""
    import numpy as np

    sample = staged(unlike(labelled(docs, labels, "toxic", text, doc_id)))
    counts = sample.agg(F.count("*").alias("n"), F.count_if(F.col("y") >= 0.5).alias("toxic")).first()
    prior = (counts["toxic"] + 1) / (counts["n"] + 2)
    lexicons = mine_lexicons(sample, counts["toxic"], counts["n"] - counts["toxic"]) if counts["toxic"] else []
    if not any(lexicons):
        return Scorer([], float(np.log(prior / (1 - prior))), [])
    x = np.array([r[0] for r in sample.select(features(F.col("text"), lexicons)).collect()])
    votes = x[:, : LEXICON_VOTERS + PATTERN_VOTERS]
    model = fit_label_model(votes, prior)
    intercept, weights = logistic(x, model.posterior(votes))
    return Scorer(lexicons, intercept, weights.tolist(), model)


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scorer = train(docs, labels, text, doc_id)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), scorer.score(body).alias("score"))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that score THRESHOLD or more. Labels that teach nothing (every score is the prior) reject no row."""
    scorer = train(docs, labels, text, doc_id)
    if not scorer.weights:
        return docs
    return docs.where(scorer.score(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))) < THRESHOLD)
