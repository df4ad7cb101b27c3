"""Text functions: tokens, episode text, truncation, labels, slugs, templates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HEAD_TAIL_LIMIT, HEAD_TAIL_PART = 700, 300
TRUNCATED = "\n... [truncated] ...\n"
CELL_LIMIT = 82


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; no empty ones."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def lowered(text: Column) -> Column:
    """What split_words() takes."""
    return F.lower(F.coalesce(text, F.lit("")))


def split_words(column):
    """Of an Arrow column of lowered() texts the lists of words that tokens() gives: both know six white characters, those of ASCII."""
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = pc.ascii_trim_whitespace(column)
    lists = pc.ascii_split_whitespace(plain)
    if pc.any(pc.equal(plain, "")).as_py():  # an empty text is one empty word there
        lists = pc.if_else(pc.equal(plain, ""), pa.scalar([], lists.type), lists)
    return lists


def head_tail(text: Column, limit: int = HEAD_TAIL_LIMIT, part: int = HEAD_TAIL_PART) -> Column:
    """The text, or its first and last parts around a mark if it is longer than the limit."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(part)), F.lit(TRUNCATED), F.right(text, F.lit(part)))).otherwise(text)


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def filled(text: Column) -> Column:
    """The text without white space around it; null if that leaves nothing."""
    return blank_to_null(F.regexp_replace(text, r"^\s+|\s+$", ""))


def episode_text(thought: Column, tool: Column, command: Column, observation: Column) -> Column:
    """Thought, action and observation lines; parts that are empty are left out."""
    tool, command = filled(tool), filled(command)
    action = F.when(tool.isNotNull(), F.concat(F.lit("[ACTION] "), tool, F.lit(": "), F.coalesce(command, F.lit("")))).when(command.isNotNull(), F.concat(F.lit("[ACTION] "), command))
    return F.concat_ws("\n", F.concat(F.lit("[THOUGHT] "), filled(thought)), action, F.concat(F.lit("[OBSERVATION] "), head_tail(filled(observation))))


def excerpt(text: Column, size: int = 700) -> Column:
    return F.left(text, F.lit(size))


def table_cell(text: Column, limit: int = CELL_LIMIT) -> Column:
    """White space collapsed; texts over the limit end in three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit - 3))), F.lit("...")))


def normal_label(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(label, F.lit(""))))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in columns])


def slug_signs(name: Column) -> Column:
    """Lower case; dashes and plus signs become underscores. Blanks stay."""
    return F.translate(F.lower(name), "-+", "__")


def slug_words(name: Column) -> Column:
    """Lower case; dashes, plus signs and blanks become underscores."""
    return F.translate(F.lower(name), "-+ ", "___")


def slug_safe(name: Column) -> Column:
    """Runs of other characters than letters, digits, dot, dash and underscore become one underscore, none stays at the ends; the case stays. A name without any such character is an error."""
    safe = F.trim(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_.\-]+", "_"), F.lit("_"))
    return F.when((safe != "") | name.isNull(), safe).otherwise(F.raise_error(F.lit("the name gives an empty slug")).cast("string"))


def slug_label(name: Column) -> Column:
    """Lower case; dashes and blanks become underscores, an at sign is spelled."""
    return F.replace(F.translate(F.lower(name), "- ", "__"), F.lit("@"), F.lit("at"))


#: Characters that TeX treats specially, and how they are written.
TEX = {
    "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}",
    "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}",
}


def tex_escape(text: Column) -> Column:
    """Character by character, so that a replacement is never replaced again."""
    table = F.create_map(*[F.lit(x) for pair in TEX.items() for x in pair])
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(table[c], c)), "")


def numbered_items(reply: Column, cached: Column, most: int) -> Column:
    """The cached items, then the lines of a reply that start with a digit, from after their first '. ', together at most `most`."""
    lines = F.filter(F.split(F.trim(reply), "\n"), lambda x: x.rlike("^[0-9]"))
    parsed = F.transform(lines, lambda x: F.trim(F.when(F.instr(x, ". ") > 0, F.substring(x, F.instr(x, ". ") + 2, F.length(x))).otherwise(x)))
    return F.slice(F.concat(cached, parsed), 1, most)


def fill_template(template: str, **fields: Column) -> Column:
    """{name} marks of the template replaced by the fields; null fields are empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(fields[x], F.lit("")) if k % 2 and x in fields else F.lit("{" + x + "}" if k % 2 else x) for k, x in enumerate(parts)])


#: What a packet starts with.
PACKET_HEAD = """## Retrieved Prior Agent Memories

The following entries are retrieved from prior software-agent memory logs.
Use them only when they are relevant to the current bug.
"""


def packet_text(memories: Column) -> Column:
    """array<struct<episode_id, task_id, formatted_text>> in rank order as numbered sections below a fixed head."""
    field = lambda m, name: F.coalesce(m[name].cast("string"), F.lit(""))
    sections = F.transform(memories, lambda m, k: F.concat(F.lit("\n### Memory "), (k + 1).cast("string"), F.lit(": "), field(m, "episode_id"), F.lit("\nTask ID: "), field(m, "task_id"), F.lit("\n"), field(m, "formatted_text"), F.lit("\n")))
    return F.regexp_replace(F.concat(F.lit(PACKET_HEAD), F.array_join(sections, "")), r"^\s+|\s+$", "")


def failure_reason(kind: Column, message: Column, verifier_error: Column, reward: Column) -> Column:
    """Of a task: the exception, else the verifier's error, else that it was not resolved; empty for a positive reward."""
    exception = F.trim(F.concat(F.coalesce(kind, F.lit("Exception")), F.lit(": "), F.coalesce(message, F.lit(""))))
    return F.when(kind.isNotNull() | message.isNotNull(), exception).when(verifier_error != "", verifier_error).when(reward <= 0, "task not resolved by verifier").otherwise("")


def runtime_seconds(elapsed: Column, started: Column, ended: Column) -> Column:
    """Elapsed seconds if they are known and not negative, else the time between two timestamps in order, else 0."""
    between = F.when(ended >= started, ended.cast("double") - started.cast("double"))
    return F.coalesce(F.when(elapsed >= 0, elapsed), between, F.lit(0.0))


def _written(value: float, sign: str = "") -> str | None:
    return f"{100.0 * value:{sign}.1f}"


@F.pandas_udf(StringType())
def percent(value: pd.Series) -> pd.Series:
    """100 times the value with one decimal, rounded as the binary number is (a decimal tie in Spark's own formats goes up); two dashes for null. For the few rows of a report."""
    return value.map(lambda x: "--" if pd.isna(x) else _written(x))


@F.pandas_udf(StringType())
def signed_percent(value: pd.Series) -> pd.Series:
    """percent() with a sign, + for 0 too."""
    return value.map(lambda x: "--" if pd.isna(x) else _written(x, "+"))


def percent_range(mean: Column, spread: Column) -> Column:
    """The mean, and the deviation where there is one; two dashes without a mean."""
    return F.when(mean.isNull() | spread.isNull(), percent(mean)).otherwise(F.concat(percent(mean), F.lit(r" $\pm$ "), percent(spread)))
