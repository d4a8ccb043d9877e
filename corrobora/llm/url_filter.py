"""URL filters with redirect equivalence.

Rules judge urls directly. Redirect and canonical-link edges join urls into components, and a component
carries decisions to its members that no rule fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize

#: (rule, verdict): host, then the start of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of rules of one length
    the first in alphabetical order is taken. The rules are a fixed parameter, part of the expression.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(x) for x in r[0]])):
        name, slash, rest = rule.partition("/")
        on_host = (host == name) | host.endswith("." + name)
        fits = on_host & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _let(value: Column, of) -> Column:
    """`of(value)` with the value worked out once, however often it stands in the expression."""
    return F.element_at(F.transform(F.array(value), of), 1)


def normalised(url: Column) -> Column:
    """An absolute url as a node: scheme and host A-Z lower-cased, no default port, no fragment, dot segments resolved, at least
    the path `/`. Null if it is not of the form scheme://..."""

    def node(u: Column) -> Column:
        scheme = F.translate(F.regexp_extract(u, _URL, 1), _UPPER, _LOWER)
        host = F.translate(F.regexp_extract(u, _URL, 2), _UPPER, _LOWER)
        root = F.regexp_replace(F.concat(scheme, F.lit("://"), host), "^(http://.*):80$|^(https://.*):443$", "$1$2")
        path = _let(F.split(F.regexp_extract(u, _URL, 3), "/", -1), _folded)
        return F.when(u.rlike(_URL), F.concat(root, path, F.regexp_extract(u, _URL, 4)))

    return _let(url, node)


def _folded(parts: Column) -> Column:
    """The path of these segments without dot segments."""
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when(x == ".", s).otherwise(F.array_append(s, x)),
    )
    dotted = F.element_at(parts, -1).isin(".", "..")  # a path that ends in a dot segment ends in a slash
    return _let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(dotted & (F.size(k) > 0), F.lit("/")).otherwise(F.lit(""))))


def resolved(base: Column, link: Column) -> Column:
    """The node that `link` (absolute, protocol-relative, or relative to `base`) names on a page; null for none."""

    def full(b: Column, to: Column) -> Column:
        scheme, host, path = (F.regexp_extract(b, _URL, i) for i in (1, 2, 3))
        root = F.concat(scheme, F.lit("://"), host)
        folder = F.regexp_replace(path, "[^/]*$", "")
        return (
            F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), to)
            .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
            .when(to.startswith("/"), F.concat(root, to))
            .when(to.startswith("?"), F.concat(root, path, to))
            .when((to == "") | to.startswith("#"), b)
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), to))
        )

    return normalised(_let(F.struct(base.alias("b"), link.alias("l")), lambda x: full(x["b"], x["l"])))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in the text of a tag: quoted either way or bare; the common character references are read."""
    form = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.trim(F.concat(*[F.regexp_extract(tag, form, i) for i in (1, 2, 3)]))
    for code, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")):
        value = F.replace(value, F.lit(code), F.lit(sign))  # each stands once in the next
    return F.when(tag.rlike(form), value)


#: Parts of a page whose text is no markup of the document; one that is not closed goes on to the end.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|noscript|title)\b.*?(?:</\1\s*>|\z)"


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) from a page to its canonical links and to what it sends a reader on to (meta refresh), as `normalised` urls.

    Every such tag of the document counts; what stands in comments, scripts, styles, templates, text areas or noscript is none. Targets are resolved against the page's first `<base href>`, else its url. A page without any,
    with null url or html, or whose url is not absolute has no edge.
    """
    html = F.col("_html")
    seen = F.lower(html)
    pages = pages.select(F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).where(F.col("_url").isNotNull() & (seen.contains("canonical") | seen.contains("refresh")))
    pages = pages.withColumn("_html", F.regexp_replace("_html", HIDDEN, " "))
    base = _attribute(F.regexp_extract(html, r"(?is)(<base\b[^>]*>)", 1), "href")
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>)"), F.lit(1)), lambda t: t.rlike(r"""(?is)[\s"'/]rel\s*=\s*["']?(?:[^"'>]*\s)?canonical(?=[\s"'>/])"""))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1)), lambda t: t.rlike(r"""(?is)http-equiv\s*=\s*["']?refresh"""))
    to = F.concat(
        F.transform(links, lambda t: _attribute(t, "href")),
        F.transform(F.transform(metas, lambda t: _attribute(t, "content")), lambda c: F.when(c.rlike(r"(?is)url\s*="), F.regexp_replace(F.regexp_replace(c, r"(?is)^.*?url\s*=\s*", ""), r"""^["']|["']$""", ""))),
    )
    found = pages.select("_url", F.when(base.isNotNull(), resolved(F.col("_url"), base)).otherwise(F.col("_url")).alias("_base"), F.explode(to).alias("_to")).where("_to IS NOT NULL")
    edges = found.select(normalised(F.col("_url")).alias("a"), resolved(F.col("_base"), F.col("_to")).alias("b"))
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def redirect_edges(log: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Edges (a, b) of a redirect log; targets may be relative to their source. Rows without an absolute source or a target have none."""
    edges = log.select(normalised(F.col(source)).alias("a"), resolved(F.col(source), F.col(target)).alias("b"))
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judge_urls(
    pages: DataFrame, edges: DataFrame | None = None, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row for each row of `pages`: id, host, path, rule, verdict, component_rule.

    A rule that fits the url decides, an explicit allow included. A url that no rule fits takes the verdict
    of its component over `edges` (a, b: `normalised` urls that are one page, as `link_edges` and `redirect_edges` give
    them; a union of both is fine): allow if a rule allows any member, else
    block if a rule blocks any, `component_rule` being the first such rule by name; else `default`. Ends of
    edges that are not in `pages` count as members. Null urls have empty host and path and no component.
    Repeated rows are each judged. Other columns are not read. No edges: rules and default alone decide.
    """
    rules = RULES if rules is None else rules
    url = F.col("url")
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    judged = judged.select("id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if edges is None:
        parts = None
    else:
        parts = materialize(connected_components(edges))
        member = parts.select("component", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules).alias("r")).where("r IS NOT NULL")
        order = F.struct((F.col("r.verdict") != "allow").alias("later"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
        decided = materialize(member.groupBy("component").agg(F.min(order).alias("by")))
        shared = materialize(parts.join(decided, "component").select("node", F.col("by.rule").alias("by_rule"), F.col("by.verdict").alias("by_verdict")))
        judged = judged.withColumn("node", normalised(url)).join(shared, "node", "left")
    if parts is None:
        judged = judged.withColumns({"by_rule": F.lit(None).cast("string"), "by_verdict": F.lit(None).cast("string")})
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "by_verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("own").isNull(), F.col("by_rule")).alias("component_rule"),
    )
