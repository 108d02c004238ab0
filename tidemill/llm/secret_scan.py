"""Multipart credential linking, with DataFrame functions only.

Three kinds of strong spans are reported wherever they are: assignments of a secret (``assign``), access
identifiers (``access``) and long hexadecimal runs (``hex``).  Weak parts are common in clean text and
count only together:

- ``identifier``: a value assigned to a name such as client_id, user or account;
- ``key``: a run of 32 or more base64 characters with a digit and letters of both cases, that changes between
  lower case, upper case and digits at least once in five characters as random text does, and isn't part of a URL;
- ``endpoint``: a URL with a host.

A weak key is reported where an identifier part (``access`` or ``identifier``) lies in the same scope;
a weak identifier where a secret part (``assign``, ``hex`` or a weak key) does; an endpoint where both an
identifier part and a secret part do.  Two parts share a scope if at most ``scope_chars`` code points part
them.  That is an interval join of the parts of each text with one another.  As all that matters is the
nearest part of each complementary role, it runs as two window sweeps over the parts in order: every part
sees the last end before it and the first start after it of each role, so no pairs are made, however many
parts a text has.

Parts are found with split and extract: running sums of the lengths of the matches and of what stands between
them give the positions, in code points, in time in proportion to the text.  Only part rows are shuffled, never
texts.

Defined results: a null or empty text has no spans; repeated rows are each returned; a null doc_id is kept
as it is; of overlapping weak parts and strong spans only the strong span is reported; of parts that begin at
one place the kinds come in the order listed; very long texts have all their spans, sorted by one task for each
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

SCOPE_CHARS = 400

ASSIGN_NAME = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: kind, order, pattern, least characters of the match.
BASE = (
    ("assign", 0, ASSIGN_NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0),
    ("access", 1, "AKIA[A-Z0-9]{16,}", 20),
    ("hex", 2, "[0-9a-f]{24,}", 24),
)
WEAK = (
    ("identifier", 3, r"""(?:[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt](?:_?[Ii][Dd])?|[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee]|_?[Ii][Dd])?|[Ll][Oo][Gg][Ii][Nn])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""),
    ("key", 4, "[A-Za-z0-9+/_-]{32,}={0,2}"),
    ("endpoint", 5, r"""[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\x00-\x20"'<>]*)?"""),
)


#: What a key's classes are counted by: its runs of a class (capitals and the letters after them are one), and those that marks part.
_TOKENS, _SEGMENTS = "[A-Z]+[a-z]*|[a-z]+|[0-9]+", "[A-Za-z0-9]+"


def _matches(text: Column, kind: str, order: int, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """array<struct<o, kind, i, b, m, keep>> of a pattern's matches: number, characters before it since the last one, its own."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))
    found = F.transform(
        F.filter(zipped, lambda x: x["m"].isNotNull()),  # the last piece stands after all matches
        lambda x, i: F.struct(F.lit(order).alias("o"), F.lit(kind).alias("kind"), i.alias("i"), F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), keep(x["m"]).alias("keep")),
    )
    # the text is parted only where there is a match
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<o:int,kind:string,i:int,b:int,m:int,keep:boolean>>"))


def _is_key(m: Column) -> Column:
    count = lambda pattern: F.size(F.regexp_extract_all(m, F.lit(pattern), F.lit(0)))
    has = lambda pattern: F.regexp_like(m, F.lit(pattern))
    return has("[0-9]") & has("[a-z]") & has("[A-Z]") & (5 * (count(_TOKENS) - count(_SEGMENTS)) >= F.length(m))


def _parts(rows: DataFrame, text: Column) -> DataFrame:
    """(doc_id, r, s, o, kind, e): a row for each part, and one of nulls for a text without any; texts are parted by r."""
    assign = BASE[0][2]
    keep = {"assign": lambda m: F.length(F.regexp_extract(m, assign, 2)) >= 6, "key": _is_key}
    found = F.concat(*(_matches(text, kind, order, pattern, keep.get(kind, lambda m: F.lit(True))) for kind, order, pattern, *_ in (*BASE, *WEAK)))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("r"), found.alias("ps"))
    rows = rows.select("doc_id", "r", F.explode_outer("ps").alias("p")).select("doc_id", "r", "p.*")
    ahead = Window.partitionBy("r", "o").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.repartition("r").withColumn("e", F.sum(F.col("b") + F.col("m")).over(ahead).cast("int"))
    # a text keeps a row even if all its matches fail
    part = F.when(F.col("keep"), F.struct((F.col("e") - F.col("m")).alias("s"), "o", "kind", "e"))
    placed = placed.select("doc_id", "r", part.alias("p")).select("doc_id", "r", "p.*")
    before, after = _sweeps()
    url = F.col("kind") == "endpoint"
    within = placed.withColumns({"url_end": F.max(F.when(url, F.col("e"))).over(before), "url_start": F.min(F.when(url, F.col("s"))).over(after)})
    inside = (F.col("kind") == "key") & (F.coalesce(F.col("url_end") > F.col("s"), F.lit(False)) | F.coalesce(F.col("url_start") < F.col("e"), F.lit(False)))
    part = F.when(~inside, F.struct("s", "o", "kind", "e"))
    return within.select("doc_id", "r", part.alias("p")).select("doc_id", "r", "p.*")


def _sweeps() -> tuple[WindowSpec, WindowSpec]:
    """All parts of a text before a part, and all after it."""
    text = Window.partitionBy("r")
    return text.orderBy("s", "o").rowsBetween(Window.unboundedPreceding, -1), text.orderBy(F.desc("s"), F.desc("o")).rowsBetween(Window.unboundedPreceding, -1)


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def scan(docs: DataFrame, scope_chars: int = SCOPE_CHARS) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = _parts(docs.select("doc_id", "text"), text)
    before, after = _sweeps()
    strong = F.col("kind").isin("assign", "access", "hex")
    roles = {"id": F.col("kind").isin("access", "identifier"), "secret": F.col("kind").isin("assign", "hex", "key"), "strong": strong}
    swept = rows
    for role, of in roles.items():
        swept = swept.withColumns({f"{role}_end": F.max(F.when(of, F.col("e"))).over(before), f"{role}_start": F.min(F.when(of, F.col("s"))).over(after)})
    near = {
        role: F.coalesce(F.col("s") - F.col(f"{role}_end") <= scope_chars, F.lit(False)) | F.coalesce(F.col(f"{role}_start") - F.col("e") <= scope_chars, F.lit(False))
        for role in ("id", "secret")
    }
    overlaps = F.coalesce(F.col("strong_end") > F.col("s"), F.lit(False)) | F.coalesce(F.col("strong_start") < F.col("e"), F.lit(False))
    linked = F.when(F.col("kind") == "key", near["id"]).when(F.col("kind") == "identifier", near["secret"]).when(F.col("kind") == "endpoint", near["id"] & near["secret"])
    swept = swept.select("doc_id", "r", "s", "o", "kind", "e", (strong | (linked & ~overlaps)).alias("report"))
    span = F.struct("s", "o", "kind", "e")
    by_text = swept.groupBy("r").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("report"), span))).alias("spans"))
    base = F.filter("spans", lambda x: x["o"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return by_text.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_digest(base), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["o"] >= 3)).cast("long").alias("n_linked"),
    )


def _sql_spans(kind: str, order: int, pattern: str, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""select r, '{kind}' as kind, {order} as o, ms[k] as m,
        (coalesce(list_sum(list_transform(ps[:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[:k - 1], lambda x: length(x))), 0))::bigint as s
    from (select r, regexp_extract_all(text, '{p}', 0) as ms, string_split_regex(text, '{p}') as ps from t where regexp_matches(text, '{p}')), unnest(range(1, len(ms) + 1)) as u(k)
    where {keep}"""


def sql(scope_chars: int = SCOPE_CHARS) -> str:
    """The same scan for DuckDB."""
    assign = BASE[0][2].replace("'", "''")
    keeps = {"assign": f"length(regexp_extract(ms[k], '{assign}', 2)) >= 6", "key": f"regexp_matches(ms[k], '[0-9]') and regexp_matches(ms[k], '[a-z]') and regexp_matches(ms[k], '[A-Z]') and 5 * (len(regexp_extract_all(ms[k], '{_TOKENS}')) - len(regexp_extract_all(ms[k], '{_SEGMENTS}'))) >= length(ms[k])"}
    spans = " union all ".join(_sql_spans(k, o, p, keeps.get(k, "true")) for k, o, p, *_ in (*BASE, *WEAK))
    near = " or ".join
    sides = {role: near((f"coalesce(s - {role}_end <= {scope_chars}, false)", f"coalesce({role}_start - e <= {scope_chars}, false)")) for role in ("id", "secret")}
    roles = {"id": "kind in ('access', 'identifier')", "secret": "kind in ('assign', 'hex', 'key')", "strong": "o < 3"}
    swept = ", ".join(f"max(e) filter ({w}) over before as {r}_end, min(s) filter ({w}) over after as {r}_start" for r, w in roles.items())
    windows = "window before as (partition by r order by s, o rows between unbounded preceding and 1 preceding), after as (partition by r order by s desc, o desc rows between unbounded preceding and 1 preceding)"
    joined = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, o, e) filter ({where}), '')"
    return f"""with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents), found as ({spans}),
    q as (select r, kind, o, s, s + length(m) as e from found),
    u as (select *, max(e) filter (kind = 'endpoint') over before as url_end, min(s) filter (kind = 'endpoint') over after as url_start from q {windows}),
    p as (select r, kind, o, s, e from u where not (kind = 'key' and (coalesce(url_end > s, false) or coalesce(url_start < e, false)))),
    w as (select *, {swept} from p {windows}),
    x as (select *, o < 3 or (case kind when 'key' then {sides["id"]} when 'identifier' then {sides["secret"]} else ({sides["id"]}) and ({sides["secret"]}) end and not (coalesce(strong_end > s, false) or coalesce(strong_start < e, false))) as report from w)
    select doc_id, count(*) filter (kind = 'assign')::bigint as n_assign, count(*) filter (kind = 'access')::bigint as n_access, count(*) filter (kind = 'hex')::bigint as n_hex,
        sha256({joined("o < 3")}) as base_sha256, {joined("report")} as spans, count(*) filter (o >= 3 and report)::bigint as n_linked
    from t left join x using (r) group by r, doc_id"""
