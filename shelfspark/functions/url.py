"""URL scalars: normalisation and fingerprint (G5, G6), host and registered domain (G16),
link filters (G25). Built from split / regexp / higher-order array functions: no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking query parameters removed before comparing URLs (matched case-insensitively).
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "ref_",
                   "pf_rd_p", "pf_rd_r", "pf_rd_s", "pf_rd_t", "smid", "tag", "linkCode", "linkId",
                   "pd_rd_wg", "pd_rd_w", "gclid", "fbclid", "msclkid", "_ga", "aff_id", "clickid",
                   "affid", "affiliate", "source"]

# Link schemes and file extensions that are never followed.
SKIP_SCHEMES = ["javascript", "mailto", "tel", "data"]
SKIP_EXTENSIONS = ["pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "mp4", "mp3", "zip", "exe", "dmg",
                   "apk", "css", "js", "woff", "woff2", "ttf"]

#: A country's second-level suffixes (``co.uk``, ``com.au``, ``co.za``): one of these labels before a country code of two
#: letters. ``c_registered_domain`` takes another pattern, or a list of suffixes, as a parameter.
SECOND_LEVEL = ("co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go")
SUFFIX_RE = r"^(?:" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2}$"

_URL_RE = r"^(?:([a-z][a-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# A lower-case URL whose parts need no decoding, and one that has a key of its query twice.
_PLAIN_RE = r"^https?://[a-z0-9.\-]+(?:/[a-z0-9_.~/\-]*)?(?:\?[a-z0-9_.~=&\-]*)?\z"
_REPEATED_RE = r"[?&]([^&=]+)=[^&]*(?:&[^&]*)*&\1="


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _encode(x: Column) -> Column:
    """Form-encode like Python's ``quote_plus``: Java's encoder writes ``~`` as %7E and keeps
    ``*``; Python does the reverse."""
    e = F.url_encode(x)
    return F.replace(F.replace(e, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _decode(x: Column) -> Column:
    """Form-decode (``+`` is a space); a value that fails to decode is kept raw."""
    return F.coalesce(F.try_url_decode(x), x)


def _norm_from_parts(u, scheme, netloc, path0, query) -> Column:
    path = F.regexp_replace(F.regexp_replace(path0, r";[^/]*$", ""), r"/+$", "")
    tracking = F.array(*[F.lit(p.lower()) for p in TRACKING_PARAMS])
    parts = F.filter(F.split(query, "&"), lambda s: s.contains("="))
    kv = F.transform(parts, lambda s, i: F.struct(
        i.alias("pos"),
        _decode(F.substring_index(s, "=", 1)).alias("k"),
        _decode(F.substr(s, F.instr(s, "=") + 1)).alias("v")))
    kept = F.filter(kv, lambda e: (e["v"] != "") & ~F.array_contains(tracking, e["k"]))
    keys = F.transform(kept, lambda e: e["k"])
    ordered = F.array_sort(F.transform(kept, lambda e: F.struct(
        F.array_position(keys, e["k"]).alias("first"), e["pos"].alias("pos"), e["k"].alias("k"), e["v"].alias("v"))))
    slow_qs = F.array_join(F.transform(ordered, lambda e: F.concat(_encode(e["k"]), F.lit("="), _encode(e["v"]))), "&")
    # Fast path (no higher-order functions): a query of plain characters with no repeated key
    # decodes and re-encodes to itself, so dropping tracking / blank / '='-less parts is enough.
    simple = query.rlike(r"^[a-z0-9_.~=&\-]*$") & ~query.rlike(r"(?:^|&)([^&=]+)=[^&]*(?:&[^&]*)*&\1=")
    amp = F.concat(F.lit("&"), query)
    fast_qs = F.regexp_replace(_drop_parts(amp), r"^&", "")
    qs = F.when(simple, fast_qs).otherwise(slow_qs)
    sch = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    with_netloc = (netloc != "") | sch.isin("http", "https", "ftp")
    # as urlunparse: a netloc-style URL gets '/' in front of a relative path
    path = F.when(with_netloc & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    base = F.concat(sch, F.lit(":"), F.when(with_netloc, F.concat(F.lit("//"), netloc)).otherwise(F.lit("")), path)
    out = F.when(qs != "", F.concat(base, F.lit("?"), qs)).otherwise(base)
    return F.when(u.isNull() | (u == ""), F.lit("")).otherwise(out)


def _drop_parts(amp: Column) -> Column:
    """Query of plain characters, each part led by ``&``, without tracking, blank and ``=``-less parts."""
    drop_tracking = F.regexp_replace(amp, r"&(?:" + "|".join(p.lower() for p in TRACKING_PARAMS) + r")=[^&]*", "")
    return F.regexp_replace(drop_tracking, r"&[^&=]*=?(?=&|$)", "")


def _norm_plain(u: Column) -> Column:
    """A URL like ``_PLAIN_RE`` without repeated keys: slashes at the path's end and parts of the query are dropped, all else stays."""
    base = F.regexp_replace(F.substring_index(u, "?", 1), r"/+$", "")
    qs = F.regexp_replace(_drop_parts(F.concat(F.lit("&"), F.substring_index(u, "?", -1))), r"^&", "?")
    return F.when(u.contains("?"), F.concat(base, qs)).otherwise(base)


def c_normalize_url(c) -> Column:
    """Trim + lower-case; scheme defaults to https; fragment, ``;params`` and trailing ``/``
    dropped; tracking parameters (case-insensitive) and blank values dropped from the query;
    repeated keys grouped in order of first appearance; query re-encoded. '' for NULL/''.
    (Single-expression form; ``with_normalized_url`` is the faster form for whole tables.)"""
    u = F.lower(F.trim(_col(c)))
    return _norm_from_parts(u, *[F.regexp_extract(u, _URL_RE, i) for i in (1, 2, 3, 4)])


def with_normalized_url(df, src: str, out: str):
    """G5 as staged projections: each URL component is extracted once per row (Spark does not
    collapse a projection whose non-trivial expressions are referenced several times), then the
    normalised URL is assembled from the columns. A plain URL (most are) is not taken apart."""
    t = ["_nu_u", "_nu_s", "_nu_n", "_nu_p", "_nu_q"]
    u = F.col(t[0])
    d = df.withColumn(t[0], F.lower(F.trim(F.col(src))))
    d = d.withColumn("_nu_plain", F.coalesce(u.rlike(_PLAIN_RE) & ~u.rlike(_REPEATED_RE), F.lit(False)))
    d = d.withColumns({t[i]: F.when(~F.col("_nu_plain"), F.regexp_extract(u, _URL_RE, i)) for i in (1, 2, 3, 4)})
    return d.withColumn(out, F.when(F.col("_nu_plain"), _norm_plain(u)).otherwise(_norm_from_parts(*[F.col(x) for x in t]))).drop("_nu_plain", *t)


def c_url_fp(c) -> Column:
    """First 16 hex characters of SHA-256 of the normalised URL."""
    return F.substring(F.sha2(c_normalize_url(c), 256), 1, 16)


def c_host(c) -> Column:
    """Lower-case host of a URL (no port, no user info), NULL when unparsable."""
    h = F.regexp_extract(F.lower(F.trim(_col(c))), r"^[a-z][a-z0-9+.\-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1)
    return F.nullif(h, F.lit(""))


def c_is_address(host) -> Column:
    """An IPv4 or bracketed IPv6 address, which has no registered domain."""
    return _col(host).rlike(r"^(?:[^@/]*@)?(?:\d{1,3}(?:\.\d{1,3}){3}|\[[0-9a-fA-F:.]*\]?)(?::\d+)?$")


def c_registered_domain(host, suffixes=SUFFIX_RE) -> Column:
    """eTLD+1: last three labels when the last two are a multi-label suffix, else the last two. ``suffixes`` is a
    pattern of such suffixes, or a list of them. ``operators.crawl.with_registered_domain`` takes a whole table of rules."""
    h = F.regexp_replace(F.regexp_replace(F.lower(_col(host)), r"^(?:[^@/]*@)?www\.|:\d+$", ""), r"^[^@/]*@", "")
    labels = F.split(h, r"\.")
    n = F.size(labels)
    last2 = F.array_join(F.slice(labels, -2, 2), ".")
    multi = last2.rlike(suffixes) if isinstance(suffixes, str) else last2.isin(list(suffixes))
    return (F.when(h.isNull() | (h == "") | (n < 2) | c_is_address(host), F.lit(None).cast("string"))
            .when(n == 2, h)
            .when(multi, F.array_join(F.slice(labels, -3, 3), "."))
            .otherwise(last2))


def c_link_ok(url) -> Column:
    """G25 filters on an absolute link: http(s) only, no skipped extension on the path (a slash at its end not regarded)."""
    u = _col(url)
    path = F.rtrim(F.lower(F.regexp_extract(u, _URL_RE, 3)), F.lit("/"))
    ext = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    return u.rlike(r"^(?i)https?://[^/]") & ~F.array_contains(F.array(*[F.lit(e) for e in SKIP_EXTENSIONS]), ext)
