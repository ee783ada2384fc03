"""HTML scalars as Columns: title and meta tags (H1), raw JSON-LD blocks (H2), links (H10) and rel=next.

Comments, scripts and styles are cut out first, then start tags and their attributes are matched; links
are resolved against the page's URL by the parts of RFC 3986. Everything stays in the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(?:#.*)?$"
_HIDDEN = r"(?is)<!--.*?(?:-->|$)|<script\b[^>]*>.*?(?:</script\s*>|$)|<style\b[^>]*>.*?(?:</style\s*>|$)"
_COMMENT = r"(?s)<!--.*?(?:-->|$)"
_REFERENCE = r"&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]{1,31});"
#: Names of character references: those of HTML 4, and the apostrophe.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def c_unescape(c: Column, names: dict[str, str] = ENTITIES) -> Column:
    """Named, decimal and hexadecimal character references decoded, each once; unknown names stay as they are, and a number
    that is no character becomes U+FFFD. The pieces between references are put together again around their characters."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    high, low = 0x10FFFF, (0xD800, 0xDFFF)

    def char(ref: Column) -> Column:
        number = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 8)).try_cast("bigint")
        valid = (number > 0) & (number <= high) & ~number.between(*low)
        of = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(ref.startswith("#"), of).otherwise(F.coalesce(F.try_element_at(table, ref), F.concat(F.lit("&"), ref, F.lit(";"))))

    refs = F.concat(F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(1)), char), F.array(F.lit("")))
    return F.when(c.contains("&"), F.array_join(F.zip_with(F.split(c, _REFERENCE), refs, lambda a, b: F.concat(a, b)), "")).otherwise(c)


def c_visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")


def c_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag, '' where it has none."""
    found = F.regexp_extract(tag, r"(?is)\s" + name + r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.trim(c_unescape(F.regexp_replace(found, r"^[\"']|[\"']$", "")))


def c_tags(html: Column, name: str) -> Column:
    """Start tags of that name, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<" + name + r"(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0))


def c_title(html: Column) -> Column:
    return F.trim(c_unescape(F.regexp_extract(c_visible(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))


def c_meta(html: Column, key: str, value: str) -> Column:
    """Content of the first meta tag whose attribute ``key`` is ``value``, '' if there is none."""
    tags = F.filter(c_tags(c_visible(html), "meta"), lambda t: c_attribute(t, key) == value)
    return F.coalesce(c_attribute(F.try_element_at(tags, F.lit(1)), "content"), F.lit(""))


def c_json_ld(html: Column) -> Column:
    """Texts of the JSON-LD scripts outside comments."""
    block = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), _COMMENT, " "), F.lit(block), F.lit(1))


def _parts(url: Column) -> Column:
    return F.struct(*[F.regexp_extract(url, _SPLIT, i).alias(n) for i, n in enumerate(("scheme", "host", "path", "query"), 1)])


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments worked off."""
    last = F.element_at(F.split(path, "/"), -1)
    done = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(
        s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s))))
    joined = F.concat(F.array_join(done, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), joined).otherwise(path)


def _absolute(h: Column, b: Column) -> Column:
    """Absolute link (no fragment; scheme and host lower-cased) from the parts of an href and of its page's URL."""
    own = h["scheme"] != ""
    host = F.when(own | (h["host"] != ""), h["host"]).otherwise(b["host"])
    merged = F.when(h["path"].startswith("/") | own | (h["host"] != ""), h["path"]).otherwise(
        F.concat(F.regexp_replace(F.when(b["path"] == "", F.lit("/")).otherwise(b["path"]), r"[^/]*$", ""), h["path"]))
    here = ~own & (h["host"] == "") & (h["path"] == "")
    path = F.when(here, b["path"]).otherwise(_without_dots(merged))
    query = F.when(here & (h["query"] == ""), b["query"]).otherwise(h["query"])
    return F.concat(F.lower(F.when(own, h["scheme"]).otherwise(b["scheme"])), F.lit(":"), F.lower(host), path, query)


def with_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``links`` (unique absolute http(s) links of ``<a href>``, in order) and ``rel_next`` ('' if none;
    a ``<link>`` goes before an ``<a>``). A fragment alone is the page itself."""
    base = _parts(F.trim(F.coalesce(F.col(url), F.lit(""))))
    seen = c_visible(F.col(html))
    staged = pages.withColumns({"_base": base, "_a": c_tags(seen, "a"), "_link": c_tags(seen, "link")})
    hrefs = F.filter(F.transform("_a", lambda t: c_attribute(t, "href")), lambda h: h != "")
    staged = staged.withColumn("_hrefs", F.transform(hrefs, _parts))
    links = F.filter(F.transform("_hrefs", lambda h: _absolute(h, F.col("_base"))), lambda u: u.rlike(r"^https?://[^/?#]"))
    is_next = lambda t: F.array_contains(F.split(F.lower(c_attribute(t, "rel")), r"\s+"), "next") & (c_attribute(t, "href") != "")
    following = F.try_element_at(F.concat(F.filter("_link", is_next), F.filter("_a", is_next)), F.lit(1))
    return (staged.withColumns({"links": F.array_distinct(links),
                                "_next": F.when(following.isNotNull(), _parts(c_attribute(following, "href")))})
            .withColumn("rel_next", F.when(F.col("_next").isNotNull(), _absolute(F.col("_next"), F.col("_base"))).otherwise(F.lit("")))
            .drop("_base", "_a", "_link", "_hrefs", "_next"))
