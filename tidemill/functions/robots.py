"""Robots exclusion: parsing robots.txt into rules, choosing an agent's rules, testing paths.

rules: (server_key, agent, pos, kind, path, delay); kind is allow, disallow or delay; pos is the agent's group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse(files: DataFrame, key: str = "server_key", text: str = "robots_txt") -> DataFrame:
    """Rules of robots.txt files: markup and comments dropped, agents of a group share its lines."""
    lines = files.select(F.col(key).alias("server_key"), F.posexplode(F.split(F.regexp_replace(text, "<[^>\n]*>", ""), r"\r\n?|\n")).alias("n", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select("server_key", "n", F.lower(F.trim(F.regexp_extract(line, "^([^:]+):", 1))).alias("field"), F.trim(F.regexp_extract(line, "^[^:]+:(.*)$", 1)).alias("value")).filter("field in ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    w = Window.partitionBy("server_key").orderBy("n")
    agent = F.col("field") == "user-agent"
    opens = agent & ~F.coalesce(F.lag(agent).over(w), F.lit(False))
    grouped = lines.withColumn("pos", F.sum(opens.cast("int")).over(w)).filter("pos > 0")
    agents = grouped.filter(agent).select("server_key", "pos", F.lower("value").alias("agent"))
    rest = grouped.filter(~agent).select("server_key", "pos", F.when(F.col("field") == "crawl-delay", "delay").otherwise(F.col("field")).alias("kind"), F.regexp_replace("value", r"\*+$", "").alias("path"), F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("float")).alias("delay"))
    return agents.join(rest, ["server_key", "pos"], "left").select("server_key", "agent", "pos", "kind", "path", "delay")


def for_agent(rules: DataFrame, user_agent: str) -> DataFrame:
    """Each server's rules for a user agent: of the first group whose name it contains, else of ``*``."""
    name = F.col("agent")
    fits = F.when((name != "*") & (name != "") & F.lit(user_agent.lower()).contains(name), 0).when(name == "*", 1)
    ranked = rules.withColumn("_r", fits).filter("_r is not null")
    best = ranked.groupBy("server_key").agg(F.min(F.struct("_r", "pos")).alias("_b"))
    return ranked.join(best, "server_key").filter("_r = _b._r and pos = _b.pos").drop("_r", "_b")


def _longest(path: Column, rules: Column, floor: bool) -> Column:
    """Length of the longest rule that the path starts with; by floor only the greatest rule not above the path is tried."""
    tried = F.filter(rules, lambda r: (r <= path) & (r != ""))
    best = F.array_max(tried) if floor else F.array_max(F.transform(F.filter(tried, path.startswith), F.length))
    return F.coalesce(F.when(path.startswith(best), F.length(best)) if floor else best, F.lit(0))


def allows(path: Column, disallow: Column, allow: Column, floor: bool = True) -> Column:
    """Whether arrays of rules allow a path: the longest disallowing prefix isn't longer than the longest allowing one.

    ``floor`` looks each list up as an ordered set does: a sibling that sorts between can hide a true prefix.
    """
    return _longest(path, disallow, floor) <= _longest(path, allow, floor)


def directives(rules: DataFrame) -> DataFrame:
    """One row a server: arrays of disallowed and allowed prefixes, and the crawl delay (-1 if none)."""
    pick = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("path")))
    return rules.groupBy("server_key").agg(pick("disallow").alias("disallow"), pick("allow").alias("allow"), F.coalesce(F.max("delay"), F.lit(-1.0)).alias("delay"))


def usable(status: Column, empties: Column) -> Column:
    """What a fetch of robots.txt means: parsed, empty (all is allowed) or invalid."""
    return F.when(status.between(200, 299), "parsed").when((status > 0) | (status == -404) | ((status == -3) & (empties >= 3)), "empty").otherwise("invalid")
