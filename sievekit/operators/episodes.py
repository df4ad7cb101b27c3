"""Turns of nested trajectories to flat episodes, and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.hashing import hash52
from sievekit.functions.text import blank_to_null, episode_text


def extract(turns: DataFrame, tool_role: str = "tool", actor: str = "assistant") -> DataFrame:
    """turns traj, pos, role, content, thought, tool, arguments (JSON) -> episodes traj, pos, thought, tool, command, observation.

    The observation is the next turn's content if that turn is the tool's. The command is the arguments' command, else path,
    else the arguments themselves; arguments that are no JSON object have none of the two. Turns without tool and command are dropped.
    """
    order = Window.partitionBy("traj").orderBy("pos")
    ahead = turns.withColumns({"next_role": F.lead("role").over(order), "next_content": F.lead("content").over(order)})
    asked = F.from_json("arguments", "struct<command:string,path:string>")
    command = F.coalesce(blank_to_null(asked["command"]), blank_to_null(asked["path"]), blank_to_null(F.col("arguments")))
    found = ahead.where(F.col("role") == actor).select("traj", "pos", F.left(F.trim(F.coalesce("thought", F.lit(""))), F.lit(300)).alias("thought"), F.coalesce("tool", F.lit("")).alias("tool"), F.coalesce(command, F.lit("")).alias("command"), F.when(F.col("next_role") == tool_role, F.coalesce("next_content", F.lit(""))).otherwise(F.lit("")).alias("observation"))
    return found.where((F.col("tool") != "") | (F.col("command") != ""))


def memory_store(episodes: DataFrame, least: int = 100) -> DataFrame:
    """Episodes with formatted_text of more than `least` characters, and how many there are before each in (traj, pos) order as their number."""
    return numbered(formatted(episodes, least), ["traj", "pos"])


def formatted(episodes: DataFrame, least: int = 100) -> DataFrame:
    """Episodes with formatted_text, without those that are too short."""
    return episodes.withColumn("formatted_text", episode_text(F.col("thought"), F.col("tool"), F.col("command"), F.col("observation"))).where(F.length("formatted_text") > least)


def memory_target(n_memory: int, n_eval: int, multiplier: float = 3.0) -> int:
    """How many episodes a collection goes on for: a multiple of what memory and evaluation need, but no fewer."""
    return max(n_memory + n_eval, int((n_memory + n_eval) * multiplier))


def collected(turns: DataFrame, n_memory: int, n_eval: int, multiplier: float = 3.0, least: int = 100, tool_role: str = "tool", first: int = 64, growth: int = 4) -> DataFrame:
    """Episodes of the trajectories from the lowest id up to the one in which the collection's target is reached, that one as a whole; number: 0-based in (traj, pos) order. Ids are whole numbers; null ones are left out.

    Ranges of ids are read in their order, each `growth` times as wide as the one before; the count of episodes is carried from range to range, and nothing
    beyond the range that reaches the target is read. Ranges are filters on the id, which the scan of a table that is laid out by it prunes files and row groups by.
    Fewer episodes than memory and evaluation need are an error; fewer than the target are all there are.
    """
    needed, target = n_memory + n_eval, memory_target(n_memory, n_eval, multiplier)
    low, high = turns.agg(F.min("traj"), F.max("traj")).first()
    if low is None:
        raise ValueError(f"only 0 episodes, {needed} are needed")
    until = lambda a, b: formatted(extract(turns.where((F.col("traj") >= a) & (F.col("traj") < b)), tool_role), least)
    count, at, width, end = 0, low, first, high + 1
    while at <= high:
        ahead = until(at, at + width)
        found = ahead.groupBy("traj").agg(F.count("*").alias("n")).agg(F.sum("n")).first()[0] or 0
        if count + found >= target:
            end = cut_after(ahead.groupBy("traj").agg(F.count("*").alias("n")), "traj", "n", target - count) + 1
            count = target
            break
        count, at, width = count + found, at + width, width * growth
    if count < needed:
        raise ValueError(f"only {count} episodes, {needed} are needed")
    return numbered(until(low, end), ["traj", "pos"])


def cut_after(sizes: DataFrame, key: str, size: str, total: int, parts: int = 64) -> int:
    """The least key, a whole number, up to which sizes add up to total; sizes (a row a key) must add up to that. The interval is cut into parts again and again, of which only the sums meet."""
    low, high = sizes.agg(F.min(key), F.max(key)).first()
    while low < high:
        step = -(-(high - low + 1) // parts)
        part = F.floor((F.col(key) - F.lit(low)) / F.lit(step)).cast("long")
        sums = dict(sizes.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(part.alias("p")).agg(F.sum(size)).collect())  # at most `parts` rows
        k = 0
        while total > sums.get(k, 0):
            total, k = total - sums.get(k, 0), k + 1
        low, high = low + k * step, min(high, low + (k + 1) * step - 1)
    return low


def numbered_by(keys: list[str]) -> Column:
    """0-based numbers in the order of keys, for rows that are few by construction (a limit before it)."""
    return (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with number: 0-based in the order of keys. Ranges are sorted each in its own task; only their sizes (one row a range) meet."""
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}).persist()
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("__range", "__first", "__before")), "__range").withColumn("number", F.col("__before") + F.col("__at") - F.col("__first")).drop("__range", "__at", "__first", "__before")


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of seed and key: a shuffle's prefix that any order of reading gives."""
    return rows.withColumn("draw", hash52("sample", F.lit(seed), F.col(key))).orderBy("draw", key).limit(n).drop("draw")


def assigned(rows: DataFrame, key: str, reviewers: int) -> DataFrame:
    """Each row to the reviewer of its place modulo their number."""
    return numbered(rows, [key]).withColumn("reviewer", (F.col("number") % reviewers).cast("int")).drop("number")


def resumed(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
