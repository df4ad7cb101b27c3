"""Episodes, text functions and row functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions import ranks, text
from sievekit.functions.hashing import hash52
from sievekit.operators import episodes, gate
from sievekit.plans.fixtures import PAIRS, d, pairs, table, tok
from sievekit.plans.registry import query


def turns(spark, sf_dir):
    """Conversations as trajectories: the user plays the tool; arguments are JSON, other JSON, or no JSON by turn."""
    t = F.col("turn").cast("string")
    arguments = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"command":"step '), t, F.lit('"}'))).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"path":"p'), t, F.lit('"}'))).otherwise(F.lit("plain"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("traj"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), F.col("text").alias("thought"), F.when(F.col("turn") % 4 != 3, F.concat(F.lit("tool"), t)).alias("tool"), arguments.alias("arguments"))


TURNS = """tu AS (SELECT conv_id AS traj, turn AS pos, role, text AS content, CASE WHEN turn % 4 <> 3 THEN 'tool' || turn END AS tool,
  CASE WHEN turn % 3 = 0 THEN 'step ' || turn WHEN turn % 3 = 1 THEN 'p' || turn ELSE 'plain' END AS command, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ep AS (SELECT traj, pos, left(trim(coalesce(content, '')), 300) AS thought, coalesce(tool, '') AS tool, command, CASE WHEN next_role = 'user' THEN coalesce(next_text, '') ELSE '' END AS observation FROM tu WHERE role = 'assistant')"""
HEAD_TAIL = "CASE WHEN length({0}) > 700 THEN left({0}, 300) || chr(10) || '... [truncated] ...' || chr(10) || right({0}, 300) ELSE {0} END"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
EPISODES = TURNS + f""", es AS (SELECT traj, pos, {STRIP.format('thought')} AS thought, tool, command, {STRIP.format('observation')} AS observation FROM ep), fm AS (SELECT *, concat_ws(chr(10), CASE WHEN thought <> '' THEN '[THOUGHT] ' || thought END, CASE WHEN tool <> '' THEN '[ACTION] ' || tool || ': ' || command WHEN command <> '' THEN '[ACTION] ' || command END,
  CASE WHEN observation <> '' THEN '[OBSERVATION] ' || {HEAD_TAIL.format('observation')} END) AS formatted_text FROM es)"""


@query("ep_extract", f"WITH {TURNS} SELECT traj, pos, md5(thought) AS thought, tool, command, md5(observation) AS observation FROM ep")
def ep_extract(spark, sf_dir):
    return episodes.extract(turns(spark, sf_dir), "user").select("traj", "pos", F.md5(F.col("thought").cast("binary")).alias("thought"), "tool", "command", F.md5(F.col("observation").cast("binary")).alias("observation"))


@query("ep_format", f"WITH {EPISODES} SELECT traj, pos, length(formatted_text) AS size, md5(formatted_text) AS digest FROM fm WHERE length(formatted_text) > 100")
def ep_format(spark, sf_dir):
    return episodes.formatted(episodes.extract(turns(spark, sf_dir), "user")).select("traj", "pos", F.length("formatted_text").cast("long").alias("size"), F.md5(F.col("formatted_text").cast("binary")).alias("digest"))


@query("ep_id", f"WITH {EPISODES} SELECT printf('ep_%06d', row_number() OVER (ORDER BY traj, pos) - 1) AS episode_id, traj, pos FROM fm WHERE length(formatted_text) > 100")
def ep_id(spark, sf_dir):
    return episodes.memory_store(episodes.extract(turns(spark, sf_dir), "user")).select(F.format_string("ep_%06d", F.col("number")).alias("episode_id"), "traj", "pos")


@query("head_tail", f"SELECT doc_id, md5({HEAD_TAIL.format('text')}) AS digest FROM documents")
def head_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.head_tail(F.col("text")).cast("binary")).alias("digest"))


@query("tokenize", f"SELECT doc_id, len({tok('text')}) AS n, md5(array_to_string({tok('text')}, ' ')) AS digest FROM documents")
def tokenize(spark, sf_dir):
    words = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("digest"))


@query("min_len", "SELECT doc_id FROM documents WHERE length(text) > 100")
def min_len(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") > 100).select("doc_id")


@query("query_lead", "SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def query_lead(spark, sf_dir):
    from pyspark.sql import Window

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_role"))


def lists(spark, sf_dir):
    """retrieved_ids with the target at its place, if that is within 10; the target's id is empty for some rows."""
    wanted = F.format_string("ep_%07d", F.col("doc_id"))
    ids = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.when(k == F.col("base"), wanted).otherwise(F.concat(F.lit("x"), k.cast("string"))))
    return pairs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, F.lit(None)).otherwise(wanted).alias("target_id"), wanted.alias("target_episode_id"), F.when(F.col("doc_id") % 11 != 0, ids).alias("ids"))


@query("hit_at_k", f"WITH {PAIRS} SELECT doc_id, base <= 1 AND doc_id % 11 <> 0 AS hit_1, base <= 5 AND doc_id % 11 <> 0 AS hit_5, base <= 10 AND doc_id % 11 <> 0 AS hit_10 FROM pairs")
def hit_at_k(spark, sf_dir):
    wanted = ranks.target(F.col("target_id"), F.col("target_episode_id"))
    return lists(spark, sf_dir).select("doc_id", *[ranks.hit_at(F.col("ids"), wanted, k).alias(f"hit_{k}") for k in (1, 5, 10)])


@query("target_rank", f"WITH {PAIRS} SELECT doc_id, CASE WHEN base <= 10 AND doc_id % 11 <> 0 THEN CAST(base AS VARCHAR) ELSE '>10' END AS target_rank FROM pairs")
def target_rank(spark, sf_dir):
    return lists(spark, sf_dir).select("doc_id", ranks.target_rank(F.col("ids"), F.col("target_episode_id")).alias("target_rank"))


@query("rr", f"WITH {PAIRS} SELECT doc_id, CASE WHEN base <= 10 AND doc_id % 11 <> 0 THEN round(1::DOUBLE / base, 6) ELSE 0 END AS rr FROM pairs")
def rr(spark, sf_dir):
    return lists(spark, sf_dir).select("doc_id", F.round(ranks.reciprocal_rank(F.col("ids"), F.col("target_episode_id")), 6).alias("rr"))


FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("trunc_text", f"SELECT doc_id, CASE WHEN length({FLAT}) <= 82 THEN {FLAT} ELSE rtrim(left({FLAT}, 79)) || '...' END AS cell FROM documents")
def trunc_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.table_cell(F.col("text")).alias("cell"))


@query("excerpt", "SELECT doc_id, md5(left(text, 700)) AS digest FROM documents")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.excerpt(F.col("text")).cast("binary")).alias("digest"))


@query("norm_label", "SELECT doc_id, lower(trim(coalesce(CASE WHEN doc_id % 3 = 0 THEN '  YES ' WHEN doc_id % 3 = 1 THEN 'No' END, ''))) AS label FROM documents")
def norm_label(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, "  YES ").when(F.col("doc_id") % 3 == 1, "No")
    return table(spark, sf_dir, "documents").select("doc_id", text.normal_label(raw).alias("label"))


@query("first_truthy", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END, ''), source) AS value FROM documents")
def first_truthy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_filled(F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang")), F.col("source")).alias("value"))


@query("iso_parse", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM events")
def iso_parse(spark, sf_dir):
    written = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(written, "Z$", "+00:00"))).alias("seconds"))


@query("task_rows", """SELECT event_id, coalesce(value, 0) > 100 AS success, CASE WHEN value > 50 THEN value WHEN event_id % 7 >= 3 THEN CAST(event_id % 7 - 3 AS DOUBLE) ELSE 0 END AS runtime,
CASE WHEN coalesce(value, 0) > 100 THEN NULL WHEN event_id % 3 = 0 THEN 'Timeout: e' || event_id % 7 WHEN event_id % 3 = 1 THEN 'v' || event_id % 7 WHEN coalesce(value, 0) <= 0 THEN 'task not resolved by verifier' ELSE '' END AS failure_reason FROM events""")
def task_rows(spark, sf_dir):
    """Success, runtime and reason of failure of a task result."""
    k = F.col("event_id") % 7
    at = lambda seconds: F.timestamp_seconds(seconds)
    raw = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("reward"), F.when(F.col("value") > 50, F.col("value")).otherwise(F.lit(-1.0)).alias("elapsed"), at(F.lit(3)).alias("started"), at(k).alias("ended"), F.when(F.col("event_id") % 3 == 0, "Timeout").alias("kind"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), k)).alias("message"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("v"), k)).alias("verifier"))
    reward = F.coalesce(F.expr("try_cast(reward AS DOUBLE)"), F.lit(0.0))
    reason = text.failure_reason(F.col("kind"), F.col("message"), F.col("verifier"), reward)
    return raw.select("event_id", (reward > 100).alias("success"), text.runtime_seconds(F.col("elapsed"), F.col("started"), F.col("ended")).alias("runtime"), F.when(~(reward > 100), reason).alias("failure_reason"))


@query("est_calls", f"WITH {PAIRS} SELECT doc_id, CASE WHEN expanded THEN {d('nt')} % 3 + CASE WHEN {d('np')} % 3 > 0 THEN 1 ELSE 0 END ELSE 0 END AS calls FROM pairs")
def est_calls(spark, sf_dir):
    calls = gate.estimated_calls(hash52(F.col("doc_id"), "nt") % 3, hash52(F.col("doc_id"), "np") % 3)
    return pairs(spark, sf_dir).select("doc_id", F.when(F.col("expanded"), calls).otherwise(F.lit(0).cast("long")).alias("calls"))


def memory_sql(k: int, name: str, task: str, part: str) -> str:
    return f"chr(10) || '### Memory {k}: ' || {name} || chr(10) || 'Task ID: ' || {task} || chr(10) || {part} || chr(10)"


@query("slug", "SELECT p_partkey, translate(lower(p_name), '-+', '__') AS signs, translate(lower(p_name), '-+ ', '___') AS words, trim(regexp_replace(trim(p_name), '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS safe, replace(translate(lower(p_name), '- ', '__'), '@', 'at') AS label FROM part")
def slug(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.slug_signs(name).alias("signs"), text.slug_words(name).alias("words"), text.slug_safe(name).alias("safe"), text.slug_label(name).alias("label"))


@query("latex_escape", "SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c IN ('&', '%', '$', '#', '_', '{', '}') THEN '\\' || c WHEN c = '~' THEN '\\textasciitilde{}' WHEN c = '^' THEN '\\textasciicircum{}' WHEN c = '\\' THEN '\\textbackslash{}' ELSE c END), '') AS tex FROM documents")
def latex_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tex_escape(F.col("text")).alias("tex"))


@query("parse_numbered", "SELECT doc_id, array_to_string(list_transform(list_filter(string_split('1. ' || text || chr(10) || ' 2. lost' || chr(10) || '3. third', chr(10)), lambda x: regexp_matches(x, '^[0-9]')), lambda x: trim(CASE WHEN instr(x, '. ') > 0 THEN substr(x, instr(x, '. ') + 2) ELSE x END))[1:2], '|') AS items FROM documents")
def parse_numbered(spark, sf_dir):
    reply = F.concat(F.lit("1. "), F.col("text"), F.lit("\n 2. lost\n3. third"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.numbered_items(reply, F.array().cast("array<string>"), 2), "|").alias("items"))


@query("context_text", f"SELECT doc_id, regexp_replace('{text.PACKET_HEAD}' || {memory_sql(1, 'lang', 'doc_id', 'text')} || {memory_sql(2, 'source', chr(39) * 2, 'text')}, '^\\s+|\\s+$', '', 'g') AS context FROM documents")
def context_text(spark, sf_dir):
    memory = lambda name, task: F.struct(name.alias("episode_id"), task.cast("string").alias("task_id"), F.col("text").alias("formatted_text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.packet_text(F.array(memory(F.col("lang"), F.col("doc_id")), memory(F.col("source"), F.lit(None)))).alias("context"))


@query("query_template", "SELECT doc_id, coalesce(source, '') || chr(10) || chr(10) || coalesce(text, '') AS query FROM documents")
def query_template(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fill_template("{repo}\n\n{problem_statement}", repo=F.col("source"), problem_statement=F.col("text")).alias("query"))


@query("limit_n", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def limit_n(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(50)


@query("trajectory_limit", "SELECT conv_id AS traj, count(*) AS n FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 20) GROUP BY 1")
def trajectory_limit(spark, sf_dir):
    from sievekit.sources import trajectories

    return trajectories(turns(spark, sf_dir), 20).groupBy("traj").agg(F.count("*").alias("n"))


MEMORY, EVALUATION = 8, 2


@query("trajectory_episodes", f"""WITH {EPISODES}, kept AS (SELECT traj, pos FROM fm WHERE length(formatted_text) > 100), sizes AS (SELECT traj, count(*) AS n FROM kept GROUP BY 1),
upto AS (SELECT traj, sum(n) OVER (ORDER BY traj) - n AS before FROM sizes) SELECT printf('ep_%06d', row_number() OVER (ORDER BY traj, pos) - 1) AS episode_id, traj, pos FROM kept JOIN upto USING (traj) WHERE before < {episodes.memory_target(MEMORY, EVALUATION)}""")
def trajectory_episodes(spark, sf_dir):
    """Trajectories are read until they hold three times the episodes that memory and evaluation need."""
    found = episodes.collected(turns(spark, sf_dir), MEMORY, EVALUATION, tool_role="user")
    return found.select(F.format_string("ep_%06d", F.col("number")).alias("episode_id"), "traj", "pos")
