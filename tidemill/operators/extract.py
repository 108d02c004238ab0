"""Links from pages, scripts, styles and headers: (src, dst, context, hop) rows.

One pattern finds tags, a second one their attributes; both run in the JVM and stay linear.  References
are resolved against the page's address, or its base element's, in Arrow batches.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import uris
from tidemill.functions.hops import is_redirect

MOST_LINKS = 6000
_TAG = r"(?is)<([a-z][a-z0-9]{0,63})((?:\s[^<>]{0,16384})?)/?>"
_ATTRIBUTE = r"""(?is)\b(href|src|lowsrc|background|cite|longdesc|usemap|profile|datasrc|data|action|codebase|archive|classid)\s*=\s*("[^"]{0,2048}"|'[^']{0,2048}'|[^\s"'>]{1,2048})"""
_EMBEDS = ("src", "lowsrc", "background", "cite", "longdesc", "usemap", "profile", "datasrc", "data", "codebase", "archive", "classid")


def tags(html: Column) -> Column:
    """array<struct<element, attributes>>: every opening tag outside comments, scripts and styles."""
    clean = F.regexp_replace(_without_comments(html), r"(?is)(<(script|style)\b[^>]*>).*?</\2\s*>", "$1")
    whole = F.regexp_extract_all(clean, F.lit(_TAG), F.lit(0))
    return F.transform(whole, lambda t: F.struct(F.lower(F.regexp_extract(t, _TAG, 1)).alias("element"), F.regexp_extract(t, _TAG, 2).alias("attributes")))


def _without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def _value(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"""^["']|["']$""", ""))


def _sends(attributes: Column) -> Column:
    """Whether a form's method is another one than get."""
    method = F.lower(F.regexp_extract(attributes, r"""(?is)\bmethod\s*=\s*["']?\s*([a-z]*)""", 1))
    return ~method.isin("", "get")


def references(html: Column, found: Column | None = None) -> Column:
    """array<struct<element, attribute, value>>: the attributes of all tags that may hold a reference; no forms that post.

    ``found`` are the page's tags, if they are known.
    """
    return F.flatten(
        F.transform(
            tags(html) if found is None else found,
            lambda t: F.transform(
                F.filter(F.regexp_extract_all(t["attributes"], F.lit(_ATTRIBUTE), F.lit(0)), lambda a: ~(F.regexp_like(a, F.lit("(?i)^action")) & _sends(t["attributes"]))),
                lambda a: F.struct(t["element"].alias("element"), F.lower(F.regexp_extract(a, _ATTRIBUTE, 1)).alias("attribute"), _value(F.regexp_extract(a, _ATTRIBUTE, 2)).alias("value")),
            ),
        )
    )


def hop_of(element: Column, attribute: Column, frames_embed: bool = True) -> Column:
    """The letter of a link by where it stands; null where none is meant."""
    frame = F.lit("E" if frames_embed else "L")
    return F.when(attribute == "href", F.when(element == "link", "E").when(element != "base", "L")).when(attribute == "action", "L").when(attribute.isin(*_EMBEDS), F.when(element.isin("frame", "iframe"), frame).otherwise("E"))


#: What no link is made of.
_NO_LINK = r"(?i)^(?:#|$|(?:javascript|mailto|data|tel):)"


def html_links(pages: DataFrame, url: str = "url", html: str = "html", resolve: bool = True, most: int = MOST_LINKS, frames_embed: bool = True, inline: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Distinct links of pages; forms that post aren't followed, nor pages whose robots element says nofollow.

    ``most`` counts references that make a link.  ``inline`` adds what scripts, styles and handlers within the page
    name (``inline_links``).  ``keys`` are columns that links keep, to tell apart pages of the same URL.
    """
    kept = keys or []
    text = F.col(html)
    nofollow = F.regexp_like(text, F.lit(r"""(?is)<meta\s(?=[^>]*name\s*=\s*["']?robots)[^>]*content\s*=\s*["'][^"']*(?:nofollow|none)"""))
    read = pages.filter(~F.coalesce(nofollow, F.lit(False))).select(F.col(url).alias("src"), *kept, _without_comments(text).alias("_html"))
    read = read.withColumn("_tags", tags(F.col("_html")))
    # tags and comments are read once, references too: each is used several times
    read = read.withColumn("_found", references(F.col("_html"), F.col("_tags")))
    base = F.get(F.filter("_found", lambda r: (r["element"] == "base") & (r["attribute"] == "href")), F.lit(0))["value"]
    linking = F.filter("_found", lambda r: hop_of(r["element"], r["attribute"], frames_embed).isNotNull() & ~F.regexp_like(r["value"], F.lit(_NO_LINK)))
    marked = F.transform(F.slice(linking, 1, most), lambda r: F.struct(r["value"].alias("dst"), F.concat_ws("/@", r["element"], r["attribute"]).alias("context"), hop_of(r["element"], r["attribute"], frames_embed).alias("hop")))
    if inline:
        marked = F.concat(marked, F.slice(inline_links(F.col("_html"), F.col("_tags")), 1, most))
    # before pages are spread over their links, so that no link carries its page; an outer explode, as for an inner one
    # Spark filters pages by their links, which finds them all twice
    read = read.select("src", *kept, F.coalesce(F.nullif(base, F.lit("")), F.col("src")).alias("_base"), marked.alias("_marked"))
    links = read.select("src", *kept, "_base", F.explode_outer("_marked").alias("r")).filter("r is not null").select("src", *kept, "_base", "r.*")
    links = _unescaped(links, resolve)
    if resolve:
        # a generator's column, which no filter repeats
        links = links.withColumn("dst", F.explode_outer(F.array(uris.normalise(F.col("dst"))))).filter("dst is not null")
    return links.drop("_base").distinct()


def _unescaped(links: DataFrame, resolve: bool) -> DataFrame:
    """links with references decoded and, if asked, joined with their base; without those that are no links then.

    One pass of Python over Arrow batches, which the optimizer can't repeat below a filter as it does with functions.
    """

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        no_link = re.compile(_NO_LINK)
        for batch in batches:
            references = [html_.unescape(r) for r in batch.column("dst").to_pylist()]
            kept = [k for k, r in enumerate(references) if not no_link.search(r)]
            bases = batch.column("_base").to_pylist() if resolve else None
            out = [uris.joined(bases[k], references[k]) if resolve else references[k] for k in kept]
            columns = [pa.array(out, pa.string()) if name == "dst" else batch.column(name).take(pa.array(kept, pa.int64())) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return links.mapInArrow(each, links.schema)


def inline_links(html: Column, found: Column | None = None) -> Column:
    """array<struct<dst, context, hop>> of what stands within a page: scripts, styles, handlers, sources by width, refreshes.

    Likely references in strings of scripts, in on... handlers, javascript: addresses, value attributes and flashvars
    are speculative (X), those of style sheets and attributes and of srcset are parts of the page (E).  ``found`` are the
    tags of a page without comments, if they are known.
    """
    clean = _without_comments(html) if found is None else html
    elements = tags(html) if found is None else found
    bodies = lambda element: F.regexp_extract_all(clean, F.lit(rf"(?is)<{element}\b[^>]*>(.*?)</{element}\s*>"), F.lit(1))
    quoted = r"""\s*=\s*("[^"]{0,16384}"|'[^']{0,16384}')"""
    attributes = lambda names: F.transform(F.flatten(F.transform(elements, lambda t: F.regexp_extract_all(t["attributes"], F.lit(rf"(?is)\b(?:{names}){quoted}"), F.lit(1)))), lambda v: F.regexp_replace(v, """^["']|["']$""", ""))
    all_of = lambda texts, find: F.flatten(F.transform(texts, find))
    link = lambda found, context, hop: F.transform(F.filter(found, lambda u: u != ""), lambda u: F.struct(u.alias("dst"), F.lit(context).alias("context"), F.lit(hop).alias("hop")))
    handlers = F.transform(attributes("on[a-z]{3,20}"), lambda v: F.concat(v, F.lit(";")))
    called = F.transform(F.filter(attributes("href|src|action"), lambda v: F.regexp_like(v, F.lit("(?i)^\\s*javascript:"))), lambda v: v)
    sizes = F.flatten(F.transform(attributes("srcset"), lambda v: F.transform(F.split(v, r",\s+|,(?=\s*https?:)"), lambda p: F.regexp_extract(F.trim(p), r"^(\S+)", 1))))
    values = F.filter(attributes("value"), likely_uri)
    flash = F.filter(F.flatten(F.transform(attributes("flashvars"), lambda v: F.transform(F.split(v, "&(?:amp;)?"), lambda p: F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")), F.lit(""))))), likely_uri)
    refresh = F.filter(F.array(F.coalesce(refresh_target(clean), F.lit(""))), lambda u: u != "")
    return F.concat(
        link(all_of(bodies("script"), script_links), "script", "X"), link(all_of(handlers, script_links), "handler", "X"), link(all_of(called, script_links), "javascript:", "X"),
        link(all_of(bodies("style"), css_links), "style", "E"), link(all_of(attributes("style"), css_links), "@style", "E"), link(sizes, "@srcset", "E"),
        link(values, "@value", "X"), link(flash, "@flashvars", "X"), link(refresh, "meta/@refresh", "R"),
    )


def applies(extractor: str, status: Column, mime: Column, uri: Column, length: Column, done: Column | None = None, missing_pages: bool = False, again: bool = False) -> Column:
    """Whether an extractor reads a fetch: by its media type or ending, with content, no error page, not extracted yet."""
    types, endings = _READS[extractor]
    kind = F.regexp_like(F.coalesce(mime, F.lit("")), F.lit(types)) | F.regexp_like(uri, F.lit(rf"(?i)\.(?:{endings})$"))
    out = kind & F.coalesce(length > 0, F.lit(False)) & (F.lit(missing_pages) | ~F.coalesce(status == 404, F.lit(False)))
    return out if again or done is None else out & ~F.coalesce(done, F.lit(False))


#: Media types and endings that each extractor reads.
_READS = {
    "html": (r"(?i)^(?:text/html|application/xhtml|text/vnd\.wap\.wml|application/vnd\.wap\.(?:wml|xhtml))", "html?|xhtml|shtml"),
    "css": (r"(?i)^text/css", "css"),
    "script": (r"(?i)javascript|jscript|ecmascript", "js"),
    "xml": (r"(?i)^(?:text|application)/(?:[a-z.+-]*\+)?xml", "xml|rss|atom"),
    "pdf": (r"(?i)^application/pdf", "pdf"),
    "word": (r"(?i)^application/(?:ms)?word", "doc"),
    "flash": (r"(?i)^application/x-shockwave-flash", "swf"),
}


def css_links(css: Column) -> Column:
    """References of a style sheet: url(...) and @import, without quotes and backslashes."""
    shape = r"""(?i)(?:@import\s+(?:url\(\s*)?|url\(\s*)["']?([^"'()\s;]{1,2083})"""
    plain = F.replace(css, F.lit("&amp;"), F.lit("&"))
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(shape), F.lit(1)), lambda u: F.replace(u, F.lit("\\"), F.lit(""))))


def likely_uri(text: Column) -> Column:
    """Whether a string of a script may be a reference: a dot or slash inside, no blanks, no number, no media type."""
    shaped = F.regexp_like(text, F.lit(r"^[\w/.~%?&=#:;,+@-]{3,2083}$")) & F.regexp_like(text, F.lit(r"[^./]\.[A-Za-z]|/[^/.]"))
    media = F.regexp_like(text, F.lit(r"(?i)^(?:text|image|audio|video|application|font|multipart)/[\w.+-]+$"))
    return shaped & ~media & ~F.regexp_like(text, F.lit(r"^[\d.,+-]+$|^[+]|[+]$"))


def script_links(script: Column) -> Column:
    """Strings of a script that are likely references."""
    strings = F.regexp_extract_all(script, F.lit(r"""(["'])([^"'\s<>]{3,2083})\1"""), F.lit(2))
    return F.array_distinct(F.filter(F.transform(strings, lambda s: F.replace(s, F.lit("\\/"), F.lit("/"))), likely_uri))


def xml_links(text: Column) -> Column:
    """Absolute addresses in the text and quotes of XML."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"""(?i)(?<=[>"'\s])(https?://[^<>"'\s]{3,2083})"""), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))


def query_links(uri: Column) -> Column:
    """Addresses within a URI's query."""
    values = F.transform(F.split(uris.query(uri), "&"), lambda p: F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")))
    return F.filter(values, lambda v: F.regexp_like(v, F.lit(r"^https?://[^\s<>]+$")))


def header_links(pages: DataFrame, url: str, headers: str, root_page: bool = False) -> DataFrame:
    """Links of HTTP headers (a map with lower-case names), and what every host is supposed to have."""
    h = F.col(headers)
    site = F.regexp_extract(url, r"^(\w+://[^/?#]+)", 1)
    links = [F.struct(F.try_element_at(h, F.lit(n)).alias("dst"), F.lit(f"{n}:").alias("context"), F.lit("R").alias("hop")) for n in ("location", "content-location")]
    implied = ["/favicon.ico"] + ["/"] * root_page
    links += [F.struct(F.concat(site, F.lit(p)).alias("dst"), F.lit("=INFERRED_MISC").alias("context"), F.lit("I").alias("hop")) for p in implied]
    return pages.select(F.col(url).alias("src"), F.explode(F.array(*links)).alias("l")).select("src", "l.*").filter("dst is not null").distinct()


def implied_links(links: DataFrame, pattern: str, replacement: str, remove_trigger: bool = False) -> DataFrame:
    """links and, for those that a pattern matches as a whole, the address it implies."""
    hit = F.coalesce(F.regexp_like("dst", F.lit(rf"^(?:{pattern})$")), F.lit(False))
    more = links.filter(hit).withColumns({"dst": F.regexp_replace("dst", rf"^(?:{pattern})$", replacement), "context": F.lit("=INFERRED_MISC"), "hop": F.lit("I")})
    return (links.filter(~hit) if remove_trigger else links).unionByName(more).distinct()


def refresh_target(html: Column) -> Column:
    """Where a meta refresh leads; null if there is none."""
    return F.nullif(F.regexp_extract(html, r"""(?is)<meta\s(?=[^>]*http-equiv\s*=\s*["']?refresh)[^>]*content\s*=\s*["'][^"'>]*?url\s*=\s*([^"'>\s]+)""", 1), F.lit(""))


def candidates(links: DataFrame, fetches: DataFrame, seeds_from_redirects: bool = True, most_seed_hops: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Children of links whose page was fetched well: path, via, context, source tag; redirects of seeds may be seeds.

    Where a URL was fetched more than once, ``keys`` of links and fetches say which fetch a link is of.
    """
    parent = fetches.filter(F.col("status").between(200, 399)).select(F.col("uri").alias("src"), *(keys or []), "hops", "source_tag", "is_seed")
    path = F.concat(F.coalesce("hops", F.lit("")), "hop")
    promoted = F.col("is_seed") & is_redirect(path) & (F.length(path) < most_seed_hops) & F.lit(seeds_from_redirects)
    return links.join(parent, ["src", *(keys or [])]).select(F.col("dst").alias("uri"), F.col("src").alias("via"), F.col("context").alias("via_context"), path.alias("hops"), "source_tag", promoted.alias("is_seed"))
