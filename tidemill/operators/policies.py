"""Policies and counters of a frontier over tables: preconditions, exclusion policies, budgets, deletions, snoozes, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.robots import allows

POLICIES = ("obey", "ignore", "custom", "first_named", "most_favoured")


def robots_allowed(policy: str, path: Column, groups: Column, names: tuple[str, ...] = (), custom: tuple[list[str], list[str]] | None = None) -> Column:
    """Whether a policy allows a path.

    groups: array<struct<agent, disallow, allow>> of a server's robots.txt.  ``obey`` asks the group of the crawler's
    name (names[0]) or else that of ``*``; ``first_named`` the first of the names that a group is for, else ``*``;
    ``most_favoured`` allows what any of the names' groups, or ``*``'s, allows; ``custom`` has rules of its own
    (disallow, allow); ``ignore`` allows all.  Without a group all is allowed.
    """
    if policy == "ignore":
        return F.lit(True)
    if policy == "custom":
        disallow, allow = (F.array(*map(F.lit, x)).cast("array<string>") for x in custom or ([], []))
        return allows(path, disallow, allow)
    ask = lambda group: allows(path, group["disallow"], group["allow"])
    of = lambda name: F.filter(groups, lambda g: (g["agent"] == "*") if name == "*" else (g["agent"] != "*") & (g["agent"] != "") & F.lit(name.lower()).contains(g["agent"]))
    wanted = names[:1] if policy == "obey" else names
    if policy == "most_favoured":
        return F.coalesce(F.exists(groups, lambda g: ask(g) & ((g["agent"] == "*") | F.array_contains(F.array(*map(F.lit, names)), g["agent"]))), F.lit(True)) | (F.size(groups) == 0)
    first = F.lit(None).cast("boolean")
    for name in (*wanted, "*"):
        first = F.coalesce(first, F.when(F.size(of(name)) > 0, ask(F.get(of(name), F.lit(0)))))
    return F.coalesce(first, F.lit(True))


def dns_precondition(rows: DataFrame, hosts: DataFrame, now: Column, valid_seconds: int = 21_600, host: str = "host", fetched: str = "ip_fetched") -> DataFrame:
    """rows with ``prerequisite``: dns:host where the host's address isn't known or was fetched too long ago; null where it stands.

    hosts: (host, ip_fetched, ...), a row a host.  dns: URIs need nothing.
    """
    known = hosts.select(F.col(host).alias("_h"), F.col(fetched).alias("_f"))
    stale = F.col("_f").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("_f") >= valid_seconds)
    needs = stale & ~F.coalesce(F.col("uri").startswith("dns:"), F.lit(False))
    return rows.join(known, F.col(host) == F.col("_h"), "left").withColumn("prerequisite", F.when(needs, F.concat(F.lit("dns:"), F.col(host)))).drop("_h", "_f")


def credential_precondition(rows: DataFrame, credentials: DataFrame, done: DataFrame, host: str = "host") -> DataFrame:
    """rows with ``prerequisite``: the login address of the credentials for their host or a domain above it, until it was fetched.

    credentials: (domain, login_uri), done: (uri); of several the nearest domain's counts.
    """
    labels = F.split(host, r"\.")
    ladder = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = rows.select(F.col(host)).distinct().select(F.col(host).alias("_h"), F.explode(ladder).alias("domain"))
    best = hosts.join(credentials, "domain").groupBy("_h").agg(F.max_by("login_uri", F.length("domain")).alias("login_uri"))
    due = best.join(done.select(F.col("uri").alias("login_uri")).distinct(), "login_uri", "left_anti")
    return rows.join(due, F.col(host) == F.col("_h"), "left").withColumn("prerequisite", F.when(F.col("uri") != F.col("login_uri"), F.col("login_uri"))).drop("_h", "login_uri")


def delete_pending(pending: DataFrame, queue_pattern: str, uri_pattern: str, queue: str = "class_key", uri: str = "uri") -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): URIs that a pattern matches as a whole, of queues that another one matches."""
    hit = F.coalesce(F.regexp_like(queue, F.lit(rf"^(?:{queue_pattern})\z")) & F.regexp_like(uri, F.lit(rf"^(?:{uri_pattern})\z")), F.lit(False))
    return pending.filter(~hit), pending.filter(hit)


def frontier_counts(events: DataFrame, tag: str = "tag", uri: str = "uri") -> DataFrame:
    """One row of discovered, queued, finished, succeeded, failed, disregarded and future URIs from a journal's events.

    A URI counts once for each kind; queued ones were added and not finished, future ones deferred and not finished.
    """
    kinds = {"added": ("F+",), "succeeded": ("Fs",), "failed": ("Ff",), "disregarded": ("Fd",), "deferred": ("Fr",)}
    flags = [F.max(F.col(tag).isin(*tags)).alias(k) for k, tags in kinds.items()]
    each = events.groupBy(uri).agg(*flags).withColumn("finished", F.col("succeeded") | F.col("failed") | F.col("disregarded"))
    count = lambda c: F.count_if(c)
    return each.agg(
        count(F.col("added")).alias("discovered"), count(F.col("added") & ~F.col("finished") & ~F.col("deferred")).alias("queued"), count(F.col("finished")).alias("finished"),
        *(count(F.col(k)).alias(k) for k in ("succeeded", "failed", "disregarded")), count(F.col("deferred") & ~F.col("finished")).alias("future"),
    )


def links_by_extractor(links: DataFrame, context: str = "context") -> DataFrame:
    """(extractor, pages, links): how much each kind of extractor gave; by the begin of the links' context."""
    kind = F.when(F.col(context).isin("script", "handler", "javascript:"), "script").when(F.col(context).contains("style"), "css").when(F.col(context).endswith(":"), "http").when(F.col(context).startswith("="), "implied").otherwise("html")
    return links.groupBy(kind.alias("extractor")).agg(F.countDistinct("src").alias("pages"), F.count("*").alias("links"))


def discovered_per_seed(paths: DataFrame) -> DataFrame:
    """(seed, n, uris): what each seed led to, from ``paths_to_seeds``; the seed itself isn't listed."""
    return paths.filter("depth > 0").groupBy("seed").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("uri").cast("string"))), ",").alias("uris"))


def scope_plus_one(in_scope: Column, via_in_scope: Column) -> Column:
    """In scope, or one hop beyond it: the page that led here is in scope."""
    return F.coalesce(in_scope, F.lit(False)) | F.coalesce(via_in_scope, F.lit(False))


def over_budget(candidates: DataFrame, queues: DataFrame, order: list[str], queue: str = "class_key", cost: str = "cost", enqueued: str = "enqueued") -> DataFrame:
    """candidates with ``over_budget``: whether what is pending before them, they themselves and what was spent exceed the queue's total.

    queues: (class_key, pending, spent, total), total null or negative for none.  Only candidates that aren't enqueued
    yet add to what is pending, and only they are judged.
    """
    new = ~F.coalesce(F.col(enqueued), F.lit(False))
    so_far = F.sum(F.when(new, F.col(cost)).otherwise(0)).over(Window.partitionBy(queue).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = candidates.join(queues, queue, "left").withColumn("_new", so_far)
    limited = F.coalesce(F.col("total") >= 0, F.lit(False))
    over = new & limited & (F.coalesce("pending", F.lit(0)) + F.coalesce("spent", F.lit(0)) + F.col("_new") > F.col("total"))
    return joined.withColumn("over_budget", over).drop("pending", "spent", "total", "_new")


def snooze(fetches: DataFrame, queue: str, ends: str, wait_ms: str, now: Column) -> DataFrame:
    """(queue, wakes_at, snoozed): when each queue may be asked again, after its last fetch and the wait for it."""
    last = fetches.groupBy(queue).agg(F.max_by(F.struct(F.col(ends).alias("e"), F.col(wait_ms).alias("w")), F.struct(F.col(ends), F.col(wait_ms))).alias("_l"))
    wakes = F.timestamp_micros(F.unix_micros(F.col("_l.e").cast("timestamp")) + F.coalesce(F.col("_l.w"), F.lit(0)).cast("long") * 1000)
    return last.select(queue, wakes.alias("wakes_at")).withColumn("snoozed", F.col("wakes_at") > now)


def revisit_flag(fetches: DataFrame, decision: Column) -> DataFrame:
    """fetches with ``revisit``: whether they are to be fetched again; an accepted or rejected one is marked, others keep their mark."""
    before = F.col("revisit") if "revisit" in fetches.columns else F.lit(None).cast("boolean")
    return fetches.withColumn("revisit", F.when(decision == "ACCEPT", True).when(decision == "REJECT", False).otherwise(before))


def arc_content(kind: Column, mime: Column) -> Column:
    """Whether an archive record goes into the older format: responses and resources with content of their own."""
    return kind.isin("response", "resource") & ~F.coalesce(F.regexp_like(mime, F.lit(r"(?i)^(?:text/anvl|application/warc-fields|text/dns-request)")), F.lit(False))
