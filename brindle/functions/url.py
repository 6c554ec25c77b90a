"""URL functions as native column expressions. URLs are split by the pattern of RFC 3986; a URL without host stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, trim

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
#: Parameters that identify no page, extensions of files that are no pages, session keys.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "fbclid", "gclid", "source", "from")
BLOCKED = "css js jpg jpeg png gif svg webp ico pdf zip rar mp3 mp4 avi mov wmv doc docx xls xlsx ppt pptx xml json rss atom woff woff2 ttf eot map".split()
SESSION = ("sid", "phpsessid", "sessionid", "jsessionid", "session_id")
#: Shops, and path segments of products and of pages that are none.
SHOPS = ("digikala.com", "torob.com", "basalam.com", "emalls.ir", "mobit.ir", "mobile.ir", "technolife.ir", "netbarg.com", "zanbil.ir", "banimode.com", "snappmarket.com", "okala.com")
PRODUCT_PATHS = ("/product/", "/p/", "/dp/")
OTHER_PATHS = ("/blog/", "/about/", "/help/", "/faq/", "/terms/", "/privacy/", "/login/", "/cart/")
#: Longest URL in bytes, parameters, page number that is not yet a trap.
MOST_BYTES, MOST_PARAMS, LAST_PAGE = 2048, 3, 5


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column whose expression is computed once a row, however often it is used: a generator of one row keeps
    the optimizer from copying it into every later filter and projection."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; '' where missing."""
    return F.regexp_extract(url, PARTS, k)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def _decode(c: Column, form: bool) -> Column:
    """Percent-decoding; a malformed escape leaves the text as it is. In forms, + is a space."""
    ready = c if form else F.replace(c, F.lit("+"), F.lit("%2B"))
    plain = F.replace(c, F.lit("+"), F.lit(" ")) if form else c
    return F.coalesce(F.try_url_decode(ready), plain)


def _encode(c: Column, form: bool) -> Column:
    out = F.url_encode(c)
    if form:
        return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(F.replace(F.replace(out, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def norm_path(path: Column) -> Column:
    """Each segment decoded and encoded again; no trailing slashes; at least /."""
    coded = F.array_join(F.transform(F.split(_decode(path, False), "/", -1), lambda s: _encode(s, False)), "/")
    return let(F.rtrim(coded, F.lit("/")), lambda short: F.when(short == "", "/").otherwise(short))


def params(query: Column) -> Column:
    """(key, value) of a query in order, decoded; a key without = has an empty value; empty keys go."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(_decode(F.substring_index(x, "=", 1), True).alias("k"), F.when(F.contains(x, F.lit("=")), _decode(F.substring(x, F.instr(x, "=") + 1, F.length(x)), True)).otherwise("").alias("v")))
    return F.filter(pairs, lambda x: x["k"] != "")


def norm_query(query: Column) -> Column:
    """Parameters without those that track, by key; of a repeated key the last value."""

    def text(own: Column) -> Column:
        last = lambda k: F.element_at(F.filter(own, lambda y: y["k"] == k), -1)["v"]
        keys = F.array_sort(F.array_distinct(F.transform(own, lambda x: x["k"])))
        return F.array_join(F.transform(keys, lambda k: F.concat(_encode(k, True), F.lit("="), _encode(last(k), True))), "&")

    own = F.filter(params(query), lambda x: ~F.lower(x["k"]).isin(*TRACKING))
    return let(let(own, text), lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("?"), t)))


def normalize(url: Column) -> Column:
    """One form of a URL: lower-case scheme (http if missing) and host, port kept, no user, no fragment; see norm_path
    and norm_query. Without a host, the URL as it is."""
    u = trim(url)
    where = F.regexp_replace(part(u, 2), "^.*@", "")
    scheme = F.when(part(u, 1) == "", "http").otherwise(F.lower(part(u, 1)))
    full = F.concat(scheme, F.lit("://"), F.lower(where), norm_path(part(u, 3)), norm_query(part(u, 4)))
    return F.when(host(u) == "", url).otherwise(full)


def url_hash(url: Column) -> Column:
    return F.sha2(normalize(url), 256)


def blocked_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(part(url, 3), r"\.([^./]*)$", 1)).isin(*BLOCKED)


def has_session(url: Column) -> Column:
    return F.exists(params(part(url, 4)), lambda x: F.lower(x["k"]).isin(*SESSION))


def should_crawl(url: Column) -> Column:
    """Worth a place in the queue: http(s) with a host, not too long, no blocked extension, few parameters, no session."""
    return (host(url) != "") & F.lower(part(url, 1)).isin("http", "https") & (F.octet_length(url) <= MOST_BYTES) & ~blocked_extension(url) & (F.size(F.array_distinct(F.transform(params(part(url, 4)), lambda x: x["k"]))) <= MOST_PARAMS) & ~has_session(url)


def page_trap(url: Column) -> Column:
    """A page number above 5: in the path, which then decides alone, or in a parameter."""
    number = F.regexp_extract(part(url, 3), r"(?i)/page[/=](\d+)", 1)
    asked = F.exists(params(part(url, 4)), lambda x: F.lower(x["k"]).isin("page", "p", "paged") & F.coalesce(F.try_to_number(F.when(x["v"].rlike(r"^\d{1,18}$"), x["v"]), F.lit("999999999999999999")) > LAST_PAGE, F.lit(False)))
    return F.when(number != "", F.coalesce(number.try_cast("decimal(38,0)") > LAST_PAGE, F.lit(True))).otherwise(asked)


def calendar_trap(url: Column) -> Column:
    return part(url, 3).rlike(r"/(19|20)\d{2}/\d{1,2}/\d{1,2}(/|$)")


def is_trap(url: Column) -> Column:
    return page_trap(url) | calendar_trap(url) | has_session(url)


def is_shop(url: Column) -> Column:
    return bare_host(url).rlike(r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in SHOPS) + r")\z")


def product_path(url: Column) -> Column:
    return part(url, 3).rlike("|".join(PRODUCT_PATHS))


def other_path(url: Column) -> Column:
    return ~product_path(url) & part(url, 3).rlike("|".join(OTHER_PATHS))


def passes_country(url: Column, on: bool = False) -> Column:
    """Off by default; else hosts below .ir and shops pass."""
    return (host(url).endswith(".ir") | is_shop(url)) if on else F.lit(True)


def priority_boost(url: Column, depth: Column) -> Column:
    n = F.octet_length(url)
    return F.greatest(F.lit(0), 5 - depth) + F.when(n < 60, 2).when(n < 120, 1).otherwise(0) + F.when(product_path(url), 10).otherwise(0)


def collapse_dots(path: Column) -> Column:
    """Without ., .. and empty segments."""
    step = lambda acc, s: F.when(s.isin(".", ""), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/"))


def resolve(href: Column, base: Column) -> Column:
    """href as a normalised absolute URL, seen from base; null if base has no scheme or host."""
    origin = F.concat(part(base, 1), F.lit("://"), F.regexp_replace(part(base, 2), "^.*@", ""))
    path = F.when(part(base, 3) == "", "/").otherwise(part(base, 3))
    folder = F.regexp_replace(path, "[^/]*$", "")
    rest = F.concat(origin, collapse_dots(F.concat(folder, href)))
    ok = (part(base, 1) != "") & (host(base) != "")
    return normalize(F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), href).when(~ok, F.lit(None)).when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(rest))


def display_url(url: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), F.rtrim(part(url, 3), F.lit("/")))
