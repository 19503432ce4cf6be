"""URL filtering with redirect equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict). A rule fits its host and subdomains where the path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Query parameters that name where a visit came from and not what the page is.
TRACKING = r"(?i)^(utm_[a-z]+|ref|source|fbclid|gclid|session)="


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def canonical_url(url: Column) -> Column:
    """The address that servers commonly redirect a url to: https, host without www. or m., no fragment, no tracking
    parameters, no index page or closing slash. Null for a url without ``://``."""
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lit("https://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


#: Comments, and elements whose content is no markup or does not count with scripts on; open ones go to the end.
UNREAD = r"(?is)<!--.*?(?:-->|\z)" + "".join(rf"|<{tag}\b.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"))
#: What a tag consists of: its end, or a name, with a value in quotes of either kind or without.
TOKENS = r"(?s)>|[^\s=/\"'<>]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)?"


def page_tags(html: Column) -> Column:
    """The link, meta and base tags of a page, each as the list of its tokens: its name, then its attributes."""
    read = F.regexp_replace(F.translate(html, "\x01", ""), UNREAD, " ")
    begun = F.split(F.regexp_replace(read, r"(?i)<(link|meta|base)([\s/])", "\x01$1$2"), "\x01")
    tokens = F.transform(F.slice(begun, 2, 1 << 30), lambda t: F.regexp_extract_all(t, F.lit(TOKENS), F.lit(0)))
    # a tag without an end is none
    return F.filter(F.transform(tokens, lambda t: F.slice(t, 1, F.greatest(F.array_position(t, ">").cast("int") - 1, F.lit(0)))), lambda t: F.size(t) > 0)


def attribute(tokens: Column, name: str) -> Column:
    """The value of a tag's attribute, trimmed; that of the first one of the name; null without one."""
    own = F.filter(F.slice(tokens, 2, 1 << 30), lambda t: t.rlike(rf"(?is)^{name}(?:\s*=|\z)"))
    value = F.regexp_replace(F.get(own, F.lit(0)), r"(?s)^[^=]*=?\s*", "")
    bare = F.regexp_replace(value, r"(?s)^([\"'])(.*)\1\z", "$2")
    return F.replace(F.trim(F.translate(bare, "\t\r\n", "   ")), F.lit("&amp;"), F.lit("&"))


def resolved(link: Column, page: Column) -> Column:
    """The absolute address of a link on a page; null for links to other schemes, such as mailto:, and on pages without ``://``.

    ``//host/path`` takes the page's scheme, ``/path`` its host too, ``?query`` its path too, anything else its folder; ``.`` and ``..`` in
    paths are followed.
    """
    site = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    whole = (
        F.when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(~F.contains(page, F.lit("://")) | link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(page, r"(?s)^(.*?:)//", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")) | F.startswith(link, F.lit("#")) | (link == ""), F.concat(site, path, link))
        .otherwise(F.concat(site, F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")), link))
    )
    segments = F.split(F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*/?([^?#]*)", 1), "/")
    step = lambda held, x: F.when(x == "..", F.regexp_replace(held, r"/[^/]*$", "")).when(x == ".", held).otherwise(F.concat(held, F.lit("/"), x))
    followed = F.concat(F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1), F.aggregate(segments, F.lit(""), step), F.regexp_extract(whole, r"(?s)^.*?://[^?#]*(.*)$", 1))
    return F.when(whole.rlike(r"(?s)^.*?://[^?#]*/\.\.?(?:[/?#]|$)"), followed).otherwise(whole)


def declared_links(html: Column, page: Column) -> Column:
    """Addresses that a page's html declares as itself: canonical links and immediate refreshes, resolved against the page's base.

    A link counts if canonical is one of the words of its rel attribute, a refresh if its delay is 0; what stands in comments, scripts and the like does not. The base is the first base tag's
    href, itself resolved against the page's address, or else that address.
    """
    tags = F.when(html.rlike("(?i)canonical|refresh"), page_tags(html)).otherwise(F.array().cast("array<array<string>>"))
    named = lambda t, name: F.lower(F.get(t, F.lit(0))) == name
    canonical = F.filter(tags, lambda t: named(t, "link") & F.array_contains(F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), r"\s+"), "canonical"))
    refresh = F.filter(tags, lambda t: named(t, "meta") & (F.lower(attribute(t, "http-equiv")) == "refresh"))
    target = lambda t: F.regexp_replace(F.regexp_extract(attribute(t, "content"), r"(?is)^\s*0*(?:\.0*)?\s*[;,]\s*(?:url\s*=\s*)?(.*)\z", 1), r"(?s)^([\"'])([^\"']*).*\z", "$2")
    found = F.concat(F.transform(canonical, lambda t: attribute(t, "href")), F.transform(refresh, lambda t: F.trim(target(t))))
    href = F.get(F.filter(F.transform(F.filter(tags, lambda t: named(t, "base")), lambda t: attribute(t, "href")), lambda x: x.isNotNull()), F.lit(0))
    base = F.coalesce(F.when(F.contains(resolved(href, page), F.lit("://")), resolved(href, page)), page)
    links = F.transform(F.filter(found, lambda u: u != ""), lambda u: F.struct(u.alias("link"), base.alias("base")))
    return F.filter(F.transform(links, lambda x: resolved(x["link"], x["base"])), lambda u: F.contains(u, F.lit("://")))


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every row of pages(page_id, url, html).

    A page with a fitting rule has that rule's verdict. The others get one from their aliases: urls are
    joined by edges to the address that they redirect to by convention (``canonical_url``), to canonical links and immediate refreshes that their html declares, and by
    ``redirects(src, dst)`` where given; within a connected component a page without a rule is blocked if a member is
    blocked by a rule, unless a member is explicitly allowed, which takes precedence. Without either it is
    allowed. Members include addresses that are only linked to.

    Nodes are 128-bit hashes of addresses; component is the smallest. A null url, or one without ``://``, has empty
    host and path, no rule and no aliases (component null) and is allowed. Null and empty html declares nothing, very long html is read whole. Rules as long as each other cannot
    fit one address unless they are the same. Repeated rows each give a
    row; other columns play no part; an empty table gives no rows.
    """
    node = lambda url: F.unhex(F.md5(url))
    seen = pages.select("page_id", "url", F.col("html"))
    addresses = seen.where(F.contains("url", F.lit("://"))).select("url", F.explode(F.array_distinct(F.concat(F.array(canonical_url(F.col("url"))), declared_links(F.col("html"), F.col("url"))))).alias("to"))
    pairs = addresses.select(F.col("url").alias("a"), F.col("to").alias("b"))
    declared = pairs.select(F.col("b").alias("a"), canonical_url(F.col("b")).alias("b"))
    pairs = pairs.unionAll(declared)
    if redirects is not None:
        given = redirects.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        pairs = pairs.unionAll(given).unionAll(given.select("a", canonical_url(F.col("a")).alias("b"))).unionAll(given.select(F.col("b").alias("a"), canonical_url(F.col("b")).alias("b")))
    pairs = checkpointed(pairs.where("a is not null and b is not null").distinct())
    component = checkpointed(connected_components(pairs.select(node("a").alias("src"), node("b").alias("dst"))))

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("url")).distinct()
    judged = nodes.select(node("url").alias("node"), matching_rule(url_host(F.col("url")), url_path(F.col("url")), rules)["verdict"].alias("v")).where("v is not null")
    decided = judged.join(component, "node").groupBy("component").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    verdicts = checkpointed(component.join(decided, "component", "left").select("node", "component", F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow").alias("spread")))

    host, path = url_host(F.col("url")), url_path(F.col("url"))
    own = seen.select("page_id", host.alias("host"), path.alias("path"), matching_rule(host, path, rules).alias("own"), F.when(F.contains("url", F.lit("://")), node("url")).alias("node"))
    return own.join(verdicts, "node", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "spread", F.lit("allow")).alias("verdict"), F.lower(F.hex("component")).alias("component"))
