"""Retrieval: vectors, BM25, fusion, gates, expansion."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions.ranks import dot
from sievekit.functions.text import tokens
from sievekit.operators import dense, fusion, gate, metrics, sparse
from sievekit.plans.fixtures import KNOWN, PAIRS, h, known_items, pairs, scratch, table, tok
from sievekit.plans.registry import query


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


POSTINGS = f"""tk AS (SELECT doc_id, {tok('text')} AS terms FROM documents),
po AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM tk), tf AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf FROM po GROUP BY ALL),
st AS MATERIALIZED (SELECT count(*) AS n_docs, avg(len(terms)) AS avgdl FROM tk),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
rw AS MATERIALIZED (SELECT term, df, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs, st), mn AS MATERIALIZED (SELECT avg(raw) AS mean FROM rw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM rw, mn)"""


def bm25_sql(name: str, queries: str, depth: int) -> str:
    """CTEs {name}: query_id, doc_id, score, rank of matching documents for the CTE `queries` (query_id, query)."""
    return f"""{name}_q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({tok('query')}) AS term FROM {queries}) GROUP BY ALL),
{name}_s AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM {name}_q JOIN idf USING (term) JOIN tf USING (term), st GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {depth})"""


def hashed_sql(name: str, source: str, key: str, text: str) -> str:
    """CTE {name}: key, v (64 hashed counts, normalised)."""
    return f"""{name}_c AS (SELECT {key}, CAST({h('t')} % 64 AS INTEGER) AS b, count(*) AS n FROM (SELECT {key}, unnest({tok(text)}) AS t FROM {source}) GROUP BY ALL),
{name}_m AS (SELECT {key}, map_from_entries(list((b, n))) AS m, sqrt(sum(n * n)) AS norm FROM {name}_c GROUP BY {key}),
{name} AS (SELECT {key}, list_transform(range(64), lambda i: CAST(coalesce(m[CAST(i AS INTEGER)], 0) AS DOUBLE) / norm) AS v FROM {name}_m)"""


def dense_sql(name: str, queries: str, vectors: str, depth: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM
  (SELECT q.query_id, c.doc_id, list_inner_product(q.v, c.v) AS score FROM {queries} q, {vectors} c)) WHERE rank <= {depth})"""


def rrf_sql(name: str, lists: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM
  (SELECT query_id, doc_id, sum(1::DOUBLE / (60 + rank)) AS score FROM {lists} GROUP BY ALL)) WHERE rank <= {k})"""


@query("bm25_build", f"WITH {POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_build(spark, sf_dir):
    d = docs(spark, sf_dir)
    return sparse.term_weights(sparse.document_frequencies(d), sparse.corpus_stats(d)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("corpus_stats", f"WITH tk AS (SELECT {tok('text')} AS terms FROM documents) SELECT count(*) AS n_docs, round(avg(len(terms)), 6) AS avgdl FROM tk")
def corpus_stats(spark, sf_dir):
    return sparse.corpus_stats(docs(spark, sf_dir)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def matched(spark, sf_dir, depth):
    return sparse.bm25_topk(docs(spark, sf_dir), known_items(spark, sf_dir), depth)


PAD = """full_list AS (SELECT query_id, doc_id, score, rank FROM bm UNION ALL
SELECT query_id, doc_id, 0, f + k FROM (SELECT s.query_id, s.f, c.doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY c.doc_id) AS k
  FROM (SELECT kq.query_id, count(bm.doc_id) AS f FROM kq LEFT JOIN bm USING (query_id) GROUP BY 1 HAVING count(bm.doc_id) < 10) s JOIN documents c ON NOT EXISTS (SELECT 1 FROM bm WHERE bm.query_id = s.query_id AND bm.doc_id = c.doc_id)) WHERE f + k <= 10)"""


@query("bm25_topk", f"WITH {KNOWN}, {POSTINGS}, {bm25_sql('bm', 'kq', 10)}, {PAD} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM full_list")
def bm25_topk(spark, sf_dir):
    return matched(spark, sf_dir, 10).select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query("bm25_recall", f"""WITH {KNOWN}, {POSTINGS}, {bm25_sql('bm', 'kq', 10)}, {PAD}, p AS (SELECT query_id, min(rank) FILTER (doc_id = query_id) AS place FROM full_list GROUP BY 1)
SELECT 'bm25' AS method, count(*) AS n, round(avg(CAST(coalesce(place <= 1, false) AS INTEGER)), 6) AS recall_1, round(avg(CAST(coalesce(place <= 5, false) AS INTEGER)), 6) AS recall_5, round(avg(CAST(coalesce(place <= 10, false) AS INTEGER)), 6) AS recall_10, round(avg(coalesce(1::DOUBLE / place, 0)), 6) AS mrr FROM p""")
def bm25_recall(spark, sf_dir):
    placed = matched(spark, sf_dir, 10).groupBy("query_id").agg(F.min(F.when(F.col("doc_id") == F.col("query_id"), F.col("rank"))).alias("place"))
    out = metrics.recall(placed.withColumn("method", F.lit("bm25")), ["method"])
    return out.select("method", "n", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr")])


def mixed_queries(spark, sf_dir):
    """Vectors of every 20th row, mixed with the next one's: 0.7 own + 0.3 next, normalised; the own one where none follows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    follow = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = F.zip_with("embedding", F.coalesce("other", "embedding"), lambda a, b: a.cast("double") * 0.7 + b.cast("double") * 0.3)
    return e.where(F.col("vec_id") % 20 == 0).join(follow, "vec_id", "left").select(F.col("vec_id").alias("query_id"), dense.unit(mixed).alias("vector"))


MIXED = """mx AS (SELECT a.vec_id AS query_id, list_transform(list_zip(a.embedding, coalesce(b.embedding, a.embedding)), lambda p: CAST(p[1] AS DOUBLE) * 0.7::DOUBLE + CAST(p[2] AS DOUBLE) * 0.3::DOUBLE) AS r FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0),
vq AS (SELECT query_id, list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))) AS v FROM mx), ev AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def vector_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query("dense_topk", f"WITH {MIXED}, {dense_sql('dn', 'vq', 'ev', 10)} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM dn")
def dense_topk(spark, sf_dir):
    found = dense.dense_topk(vector_rows(spark, sf_dir), mixed_queries(spark, sf_dir), 10)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query("top1_score", f"WITH {MIXED}, {dense_sql('dn', 'vq', 'ev', 1)} SELECT query_id, round(score, 6) AS top1 FROM dn")
def top1_score(spark, sf_dir):
    return dense.dense_topk(vector_rows(spark, sf_dir), mixed_queries(spark, sf_dir), 1).groupBy("query_id").agg(F.round(F.max("score"), 6).alias("top1"))


@query("dense_build", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS norm2 FROM embeddings")
def dense_build(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims"), F.round(dot(F.col("embedding"), F.col("embedding")), 5).alias("norm2"))


@query("embed", f"WITH {hashed_sql('hv', 'documents', 'doc_id', 'text')} SELECT doc_id, CAST(i AS INTEGER) AS i, round(v[i], 6) AS x FROM hv, range(1, 65) t(i) WHERE v[i] > 0")
def embed(spark, sf_dir):
    return dense.hashed_vectors(docs(spark, sf_dir)).select("doc_id", F.posexplode("embedding").alias("i", "x")).where("x > 0").select("doc_id", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


def text_vectors(queries: DataFrame) -> DataFrame:
    return dense.hashed_vectors(queries, "query_id", "query").withColumnRenamed("embedding", "vector")


HYBRID = f"""{KNOWN}, {POSTINGS}, {bm25_sql('bm', 'kq', 20)}, {hashed_sql('hv', 'documents', 'doc_id', 'text')}, {hashed_sql('hq', 'kq', 'query_id', 'query')}, {dense_sql('dn', 'hq', 'hv', 20)},
li AS (SELECT query_id, rank, doc_id FROM dn UNION ALL SELECT query_id, rank, doc_id FROM bm)"""


def both_lists(spark, sf_dir, depth):
    d, q = docs(spark, sf_dir), known_items(spark, sf_dir)
    index = sparse.Index(d, scratch(spark))
    return dense.dense_topk(written(dense.hashed_vectors(d), f"{index.path}/vectors"), text_vectors(q), depth), index.matched(q, depth)


@query("hybrid_rrf", f"WITH {HYBRID}, {rrf_sql('fu', 'li', 10)} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM fu")
def hybrid_rrf(spark, sf_dir):
    return fusion.hybrid(*both_lists(spark, sf_dir, 20)).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("bm25_agreement", f"WITH {HYBRID} SELECT query_id, EXISTS (SELECT 1 FROM bm WHERE bm.query_id = dn.query_id AND bm.doc_id = dn.doc_id AND bm.rank <= 10) AS agrees FROM dn WHERE rank = 1")
def bm25_agreement(spark, sf_dir):
    """Whether BM25's first ten hold the first of the dense list, from the lists themselves."""
    return fusion.agreement(*both_lists(spark, sf_dir, 20))


@query("rrf", f"""WITH {PAIRS}, li AS (SELECT doc_id AS query_id, doc_id % 97 AS doc_id, base AS rank FROM pairs UNION ALL SELECT doc_id, (doc_id + sparse) % 97, sparse FROM pairs UNION ALL SELECT doc_id, (doc_id + 3) % 97, "full" FROM pairs), {rrf_sql('fu', 'li', 2)}
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM fu""")
def rrf(spark, sf_dir):
    p = pairs(spark, sf_dir)
    one = lambda k, doc, rank: p.select(F.col("doc_id").alias("query_id"), F.lit(k).alias("list_ord"), F.col(rank).alias("rank"), (doc % 97).alias("doc_id"))
    lists = one(0, F.col("doc_id"), "base").unionByName(one(1, F.col("doc_id") + F.col("sparse"), "sparse")).unionByName(one(2, F.col("doc_id") + 3, "full"))
    return fusion.rrf(lists, 2).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def variants(spark, sf_dir):
    """query_id, kind, ord, text: two traces from the successor of the target, two paraphrases of the query."""
    follow = docs(spark, sf_dir).where(F.col("doc_id") % 20 == 1).select((F.col("doc_id") - 1).alias("query_id"), tokens(F.col("text")).alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    traces = follow.select("query_id", F.explode(F.array(F.struct(F.lit(0).alias("ord"), part(5, 24).alias("text")), F.struct(F.lit(1).alias("ord"), part(17, 24).alias("text")))).alias("x")).select("query_id", F.lit("trace").alias("kind"), "x.ord", "x.text")
    words = known_items(spark, sf_dir).select("query_id", tokens(F.col("query")).alias("w"))
    even = F.array_join(F.filter("w", lambda _, k: k % 2 == 1), " ")
    turned = F.array_join(F.reverse("w"), " ")
    phrases = words.select("query_id", F.explode(F.array(F.struct(F.lit(0).alias("ord"), even.alias("text")), F.struct(F.lit(1).alias("ord"), turned.alias("text")))).alias("x")).select("query_id", F.lit("paraphrase").alias("kind"), "x.ord", "x.text")
    return traces.unionByName(phrases).where("text <> ''")


VARIANTS = f"""sw AS (SELECT doc_id - 1 AS query_id, {tok('text')} AS w FROM documents WHERE doc_id % 20 = 1), qw AS (SELECT query_id, {tok('query')} AS w FROM kq),
va AS (SELECT * FROM (SELECT query_id, 'trace' AS kind, 0 AS ord, array_to_string(w[5:28], ' ') AS text FROM sw UNION ALL SELECT query_id, 'trace', 1, array_to_string(w[17:40], ' ') FROM sw
  UNION ALL SELECT query_id, 'paraphrase', 0, array_to_string(list_filter(w, lambda x, i: i % 2 = 0), ' ') FROM qw UNION ALL SELECT query_id, 'paraphrase', 1, array_to_string(list_reverse(w), ' ') FROM qw) WHERE text <> '')"""


@query("expansions", f"WITH {KNOWN}, {VARIANTS} SELECT query_id, kind, CAST(ord AS INTEGER) AS ord, text FROM va")
def expansions(spark, sf_dir):
    return variants(spark, sf_dir)


def mode_sql(mode: str) -> str:
    gates = {"selective": "round(max(score), 6) < 0.65::DOUBLE", "always": "true", "traces": "true", "paraphrases": "true", "dense": "false", "random": f"{h(chr(39) + 'gate' + chr(39), '42', 'query_id')} / 4503599627370496::DOUBLE < 0.46::DOUBLE"}
    kinds = {"traces": "'trace'", "paraphrases": "'paraphrase'"}.get(mode, "'trace', 'paraphrase'")
    return f"""WITH {KNOWN}, {POSTINGS}, {hashed_sql('hv', 'documents', 'doc_id', 'text')}, {hashed_sql('hq', 'kq', 'query_id', 'query')}, {dense_sql('dn', 'hq', 'hv', 20)},
ga AS (SELECT query_id, {gates[mode]} AS expanded FROM dn GROUP BY query_id), {VARIANTS},
vs AS (SELECT query_id || ':' || CASE WHEN kind = 'trace' THEN ord * 2 + 1 ELSE ord + 1000 END AS query_id, kind, text AS query FROM va JOIN ga USING (query_id) WHERE expanded AND kind IN ({kinds})),
vt AS (SELECT query_id, query FROM vs WHERE kind = 'trace'), {hashed_sql('vv', 'vs', 'query_id', 'query')}, {dense_sql('vd', 'vv', 'hv', 20)}, {bm25_sql('vb', 'vt', 20)},
li AS (SELECT query_id, rank, doc_id FROM dn JOIN ga USING (query_id) WHERE expanded UNION ALL SELECT CAST(split_part(query_id, ':', 1) AS BIGINT), rank, doc_id FROM vd UNION ALL SELECT CAST(split_part(query_id, ':', 1) AS BIGINT), rank, doc_id FROM vb), {rrf_sql('fu', 'li', 10)}
SELECT query_id, expanded, doc_id, CAST(rank AS INTEGER) AS rank FROM dn JOIN ga USING (query_id) WHERE NOT expanded AND rank <= 10 UNION ALL SELECT query_id, true, doc_id, CAST(rank AS INTEGER) FROM fu"""


class Retriever:
    """What all modes share: the corpus's vectors, and the original lists (2k rows a query: gate, fallback and fusion read them), each a written table; and the index, which is written once a mode asks for it."""

    def __init__(self, spark, sf_dir):
        self.docs, q, self.path = docs(spark, sf_dir), known_items(spark, sf_dir), scratch(spark)
        self.variants = variants(spark, sf_dir)
        self.vectors = written(dense.hashed_vectors(self.docs), f"{self.path}/vectors")
        self.original = written(self.dense(q, 20), f"{self.path}/original")

    @cached_property
    def index(self):
        return sparse.Index(self.docs, self.path)

    def sparse(self, queries, k):
        return self.index.matched(queries, k)

    def dense(self, queries, k):
        return dense.dense_topk(self.vectors, text_vectors(queries), k)

    def run(self, mode):
        return gate.gated_retrieval(self.original, self.variants, mode, self.dense, self.sparse).select("query_id", "expanded", "doc_id", F.col("rank").cast("int").alias("rank"))


def retrieved(spark, sf_dir, mode):
    return Retriever(spark, sf_dir).run(mode)


for _mode in gate.MODES:
    query(f"retrieve_{_mode}", mode_sql(_mode))(lambda spark, sf_dir, mode=_mode: retrieved(spark, sf_dir, mode))


@query("run_method", f"""WITH {KNOWN}, {POSTINGS}, {bm25_sql('bm', 'kq', 10)}, p AS (SELECT kq.query_id, min(rank) FILTER (doc_id = kq.query_id) AS place FROM kq LEFT JOIN bm USING (query_id) GROUP BY 1)
SELECT 'sparse' AS method, count(*) AS n_queries, round(avg(CAST(coalesce(place <= 1, false) AS INTEGER)), 6) AS recall_1, round(avg(CAST(coalesce(place <= 10, false) AS INTEGER)), 6) AS recall_10 FROM p""")
def run_method(spark, sf_dir):
    """The generic runner over a retrieval function, here BM25 without padding."""
    q = known_items(spark, sf_dir).withColumn("target_id", F.col("query_id"))
    detailed = metrics.run_method("sparse", q, sparse.Index(docs(spark, sf_dir)).matched, 10)
    return metrics.summary(detailed, 10).select("method", "n_queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_10")])


SUITE = ("selective", "always", "traces", "paraphrases", "random")
SEEDS = 8


def memory_of(i):
    """The memory, named by its seed, that a document and the queries for it belong to: runs of 20 ids."""
    return F.floor(i / 20) % SEEDS + 42


def suite_sql() -> str:
    seed = lambda i: f"({i} // 20 % {SEEDS} + 42)"
    bm = lambda name, asked, depth: f"""{name}_q AS (SELECT seed, query_id, term, count(*) AS qf FROM (SELECT seed, query_id, unnest({tok('query')}) AS term FROM {asked}) GROUP BY ALL),
{name}_s AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM {name}_q JOIN idf USING (seed, term) JOIN tf USING (seed, term) JOIN st USING (seed) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {depth})"""  # noqa: E731
    dn = lambda name, asked, depth: f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM
  (SELECT q.query_id, c.doc_id, list_inner_product(q.v, c.v) AS score FROM {asked} q JOIN hv c ON {seed("CAST(split_part(q.query_id, ':', 1) AS BIGINT)")} = {seed('c.doc_id')})) WHERE rank <= {depth})"""  # noqa: E731
    gates = {"selective": "round(max(score), 6) < 0.65::DOUBLE", "random": f"{h(chr(39) + 'gate' + chr(39), seed('CAST(query_id AS BIGINT)'), 'query_id')} / 4503599627370496::DOUBLE < 0.46::DOUBLE"}
    kinds = {"traces": "'original', 'trace'", "paraphrases": "'original', 'paraphrase'"}
    return f"""WITH {KNOWN}, kt AS (SELECT CAST(query_id AS VARCHAR) AS query_id, query FROM kq),
tk AS (SELECT doc_id, {seed('doc_id')} AS seed, {tok('text')} AS terms FROM documents), tf AS MATERIALIZED (SELECT seed, doc_id, dl, term, count(*) AS tf FROM (SELECT seed, doc_id, len(terms) AS dl, unnest(terms) AS term FROM tk) GROUP BY ALL),
st AS MATERIALIZED (SELECT seed, count(*) AS n_docs, avg(len(terms)) AS avgdl FROM tk GROUP BY seed),
rw AS MATERIALIZED (SELECT seed, term, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT seed, term, count(*) AS df FROM tf GROUP BY ALL) JOIN st USING (seed)),
idf AS MATERIALIZED (SELECT seed, term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM rw JOIN (SELECT seed, avg(raw) AS mean FROM rw GROUP BY seed) USING (seed)),
{hashed_sql('hv', 'documents', 'doc_id', 'text')}, {hashed_sql('hq', 'kt', 'query_id', 'query')}, {dn('dn', 'hq', 20)}, {VARIANTS},
vs AS (SELECT query_id || ':' || CASE WHEN kind = 'trace' THEN ord * 2 + 1 ELSE ord + 1000 END AS query_id, {seed('query_id')} AS seed, kind, text AS query FROM va),
vt AS (SELECT * FROM vs WHERE kind = 'trace'), {hashed_sql('vv', 'vs', 'query_id', 'query')}, {dn('vd', 'vv', 20)}, {bm('vb', 'vt', 20)},
ga AS (SELECT query_id, unnest([{', '.join(f"{{'mode': '{m}', 'expanded': {gates.get(m, 'true')}}}" for m in SUITE)}], recursive := true) FROM dn GROUP BY query_id),
li AS (SELECT query_id, 'original' AS kind, rank, doc_id FROM dn UNION ALL SELECT split_part(vd.query_id, ':', 1), kind, rank, doc_id FROM vd JOIN vs USING (query_id) UNION ALL SELECT split_part(query_id, ':', 1), 'trace', rank, doc_id FROM vb),
fu AS (SELECT mode, query_id, doc_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT mode, query_id, doc_id, sum(1::DOUBLE / (60 + rank)) AS score FROM li JOIN ga USING (query_id) WHERE expanded AND ({' OR '.join(f"mode = '{m}' AND kind IN ({kinds.get(m, repr('original') + ', ' + repr('trace') + ', ' + repr('paraphrase'))})" for m in SUITE)}) GROUP BY ALL)),
al AS (SELECT mode, query_id, expanded, doc_id, rank FROM dn JOIN ga USING (query_id) WHERE NOT expanded AND rank <= 10 UNION ALL SELECT mode, query_id, true, doc_id, rank FROM fu WHERE rank <= 10),
pl AS (SELECT mode, CAST(query_id AS BIGINT) AS query_id, bool_or(expanded) AS expanded, min(rank) FILTER (doc_id = CAST(query_id AS BIGINT)) AS place FROM al GROUP BY ALL)
SELECT mode, {seed('query_id')} AS seed, count(*) AS n_queries, round(avg(CAST(coalesce(place <= 1, false) AS INTEGER)), 6) AS recall_1, round(avg(CAST(coalesce(place <= 10, false) AS INTEGER)), 6) AS recall_10, round(avg(CAST(expanded AS INTEGER)), 6) AS expansion FROM pl GROUP BY ALL"""


@query("run_suite", suite_sql())
def run_suite(spark, sf_dir):
    """Five modes x eight independent memories: one index, cut by memory, whose blocks meet only the queries of their own; the original list and the variants' lists are made once for all modes."""
    own = lambda i, name="memory": memory_of(gate.owner(F.col(i))).alias(name)
    d, q = docs(spark, sf_dir), known_items(spark, sf_dir)
    index = sparse.Index(d.withColumn("memory", memory_of(F.col("doc_id"))), scratch(spark), "memory")
    vectors = written(dense.hashed_vectors(d), f"{index.path}/vectors").withColumn("part", memory_of(F.col("doc_id")))
    nearest = lambda asked, k: dense.dense_topk(vectors, text_vectors(asked).withColumn("part", own("query_id")), k)
    best = lambda asked, k: index.matched(asked.withColumn("memory", own("query_id")), k)
    kept = lambda df, name: written(df, f"{index.path}/{name}")  # noqa: E731  (read by every mode)
    original, lists = kept(nearest(q, 20), "original"), kept(gate.variant_lists(variants(spark, sf_dir), nearest, best), "lists")
    rows = gate.suite(original, lists, SUITE, memory_of(F.col("query_id")))
    placed = rows.groupBy("mode", "query_id").agg(F.bool_or("expanded").alias("expanded"), F.min(F.when(F.col("doc_id") == F.col("query_id"), F.col("rank"))).alias("place"))
    hit = lambda k: F.round(F.avg(F.coalesce(F.col("place") <= k, F.lit(False)).cast("double")), 6)
    return placed.groupBy("mode", memory_of(F.col("query_id")).alias("seed")).agg(F.count("*").alias("n_queries"), hit(1).alias("recall_1"), hit(10).alias("recall_10"), F.round(F.avg(F.col("expanded").cast("double")), 6).alias("expansion"))


def written(df, path):
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("gates", f"""WITH {PAIRS} SELECT doc_id, top1 < 0.65::DOUBLE AS selective, true AS always, false AS dense, {h(chr(39) + 'gate' + chr(39), '42', 'doc_id')} / 4503599627370496::DOUBLE < 0.46::DOUBLE AS random FROM pairs""")
def gates(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", *[gate.expands(m, F.col("top1"), F.col("doc_id")).alias(m) for m in ("selective", "always", "dense", "random")])


@query("expansion_cache_misses", f"WITH {KNOWN}, c AS (SELECT DISTINCT trim(query) AS key FROM kq WHERE query_id % 60 = 0) SELECT query_id FROM kq WHERE trim(query) NOT IN (SELECT key FROM c)")
def expansion_cache_misses(spark, sf_dir):
    q = known_items(spark, sf_dir)
    return gate.cache_misses(q, q.where("query_id % 60 = 0").select(gate.cache_key(F.col("query")).alias("query_key"))).select("query_id")


def memo_sql(first: str) -> str:
    """CTEs to told: query_id, kind, ord, text, asked of the second of two runs over one cache. The first one asks for every third query, and of the model's answers gets those that `first` holds for."""
    some = lambda kind, extra="": f"SELECT key, list(text ORDER BY ord) AS x FROM f1 JOIN va ON va.query_id = f1.asker WHERE kind = '{kind}' AND {first} GROUP BY key"
    more = lambda kind, old, least: f"SELECT key, any_value(coalesce(len({old}.x), 0)) AS have, list(text ORDER BY ord) AS x FROM f2 LEFT JOIN {old} USING (key) JOIN va ON va.query_id = f2.asker WHERE kind = '{kind}' AND {least} GROUP BY key"
    rows = lambda kind, old, new: f"SELECT key, '{kind}' AS kind, unnest(range(len(x[1:2]))) AS ord, unnest(x[1:2]) AS text, false AS new FROM {old} UNION ALL SELECT key, '{kind}', have + unnest(range(len(x[1:2 - have]))), unnest(x[1:2 - have]), true FROM {new}"
    return f"""{KNOWN}, {VARIANTS}, k AS (SELECT query_id, trim(query) AS key FROM kq), f1 AS (SELECT key, min(query_id) AS asker FROM k WHERE query_id % 60 = 0 GROUP BY 1), f2 AS (SELECT key, min(query_id) AS asker FROM k GROUP BY 1),
t1 AS (SELECT key, x[1:2] AS x FROM ({some('trace')})), p1 AS (SELECT key, x[1:2] AS x FROM ({some('paraphrase')})), t2 AS ({more('trace', 't1', 'ord >= coalesce(len(t1.x), 0)')}), p2 AS ({more('paraphrase', 'p1', 'true')}),
tx AS ({rows('trace', 't1', 't2')} UNION ALL {rows('paraphrase', 'p1', 'p2')}),
told AS (SELECT k.query_id, tx.kind, tx.ord, tx.text, coalesce(tx.new AND k.query_id = f2.asker, k.query_id = f2.asker) AS asked FROM k JOIN f2 USING (key) LEFT JOIN tx USING (key))"""


def two_runs(spark, sf_dir, first: str):
    """Two runs that share a cache: the first asks for every third query and gets a part of the answers, the second finds these, asks for what is missing, and writes that back."""
    q, path, generated = known_items(spark, sf_dir), scratch(spark), variants(spark, sf_dir)
    gate.expanded(q.where("query_id % 60 = 0"), generated.where(first), path)
    return q, gate.expanded(q, generated, path)


@query("expansion_cache", f"WITH {memo_sql('true')} SELECT query_id, CAST(count(text) AS INTEGER) AS n_texts, asked FROM told GROUP BY query_id, asked")
def expansion_cache(spark, sf_dir):
    told = two_runs(spark, sf_dir, "true")[1]
    return told.groupBy("query_id", "asked").agg(F.count("text").cast("int").alias("n_texts")).select("query_id", "n_texts", "asked")


@query("expansion_topup", f"WITH {memo_sql('ord = 0')} SELECT query_id, kind, CAST(ord AS INTEGER) AS ord, md5(text) AS digest, asked FROM told")
def expansion_topup(spark, sf_dir):
    """Keys that hold one text of two keep it and get one more."""
    told = two_runs(spark, sf_dir, "ord = 0")[1]
    return told.select("query_id", "kind", "ord", F.md5(F.col("text").cast("binary")).alias("digest"), "asked")


LEDGER = f"""{memo_sql('ord = 0')}, us AS (SELECT query_id, count(*) FILTER (kind = 'trace') AS n_traces, count(*) FILTER (kind = 'paraphrase') AS n_paraphrases,
  count(*) FILTER (kind = 'trace' AND asked) + CASE WHEN count(*) FILTER (kind = 'paraphrase' AND asked) > 0 THEN 1 ELSE 0 END AS llm_calls, CAST(coalesce(sum(len({tok('text')})) FILTER (asked), 0) AS BIGINT) AS completion_tokens FROM told GROUP BY query_id),
le AS (SELECT query_id, n_traces, n_paraphrases, n_traces + CASE WHEN n_paraphrases > 0 THEN 1 ELSE 0 END AS estimated_calls, llm_calls, llm_calls * len({tok('query')}) AS prompt_tokens, completion_tokens, llm_calls * len({tok('query')}) + completion_tokens AS total_tokens FROM us JOIN kq USING (query_id))"""


@query("usage", f"WITH {LEDGER} SELECT * FROM le")
def usage(spark, sf_dir):
    """Calls and tokens of the second run by query, with texts that the first one left in the cache."""
    return gate.usage(*two_runs(spark, sf_dir, "ord = 0"))


@query("usage_cost", f"WITH {LEDGER} SELECT count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in gate.USED)} FROM le")
def usage_cost(spark, sf_dir):
    means = gate.average_usage(gate.usage(*two_runs(spark, sf_dir, "ord = 0")))
    return means.select("n", *[F.round(c, 6).alias(c) for c in gate.USED])
