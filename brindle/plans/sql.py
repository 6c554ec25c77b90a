"""SQL that states the registered queries for DuckDB, from the driver's tables."""

from __future__ import annotations

W = "(?:[\\s\u00a0])"
NOW, NOW_HOUR, NOW_QUEUE = (f"TIMESTAMP '{x}'" for x in ("2024-02-05 00:00:00", "2024-01-30 12:00:00", "1998-06-01 00:00:00"))
PAGES = f"""web AS (SELECT doc_id AS id, source AS domain, 'https://' || source || '.example.org/doc/' || doc_id AS url, substr(text, 1, 40) AS title, CASE WHEN doc_id % 3 = 0 THEN substr(text, 41, 80) END AS meta_description, text AS content_text, lang AS language,
 {NOW} - to_days(CAST(doc_id % 90 AS INT)) AS crawled_at, len(string_split(text, ' ')) AS word_count, CASE WHEN doc_id % 17 = 0 THEN 'pending' ELSE 'indexed' END AS status, sha256(text) AS content_hash, doc_id % 5 = 0 AS has_product, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 200 END AS http_status FROM documents)"""
EDGES = "edges AS (SELECT doc_id AS id, doc_id AS source_page_id, doc_id % 97 AS target_page_id, doc_id % 4 = 0 AS is_external FROM documents)"
DOMAINS = "doms AS (SELECT min(doc_id) AS id, source AS name, count(*) AS pages_count, CASE WHEN min(doc_id) % 6 = 5 THEN 'paused' ELSE 'active' END AS status FROM documents GROUP BY source)"
SEARCHES = "searches AS (SELECT event_id AS id, event_type || ' ' || (user_id % 20) AS query, user_id % 7 AS results_count, user_id AS ip, ts AS searched_at FROM events)"
LOGS = "logs AS (SELECT event_id AS id, user_id AS domain_id, CASE WHEN event_type IN ('error', 'click') THEN event_type END AS error_message, CASE WHEN event_type NOT IN ('error', 'click') THEN event_id END AS page_id, ts AS crawled_at FROM events)"
QUEUE = "queue AS (SELECT o_orderkey AS id, o_custkey % 50 AS domain_id, 'https://h' || (o_custkey % 50) || '.example.com/p/' || (o_orderkey % 3000) AS url, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_orderkey % 8 AS INT) AS depth, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status, CAST(o_orderkey % 5 AS INT) AS attempts, 3 AS max_attempts, o_orderdate AS last_attempt_at FROM orders)"
PRODUCTS = r"prods AS (SELECT p_partkey AS id, p_name AS name, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS name_normalized FROM part)"
PRICES = "hist AS (SELECT l_partkey AS product_id, l_suppkey AS domain_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_shipdate AS recorded_at, l_orderkey AS k1, l_linenumber AS k2, CAST(round(l_quantity * 100) AS BIGINT) AS k3 FROM lineitem), prices AS (SELECT product_id, domain_id, price, recorded_at FROM hist QUALIFY row_number() OVER (PARTITION BY product_id, domain_id ORDER BY recorded_at DESC, price DESC, k1 DESC, k2 DESC, k3 DESC) = 1)"
TOKENS = r"toks AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT id, regexp_extract_all(lower(translate(title || ' ' || content_text, 'يكةۀ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', 'یکهه01234567890123456789')), '[\p{L}\p{N}]+') AS t FROM web))"
CLAIMABLE = f"(status = 'pending' OR (status = 'processing' AND last_attempt_at < {NOW_QUEUE} - INTERVAL 10 MINUTE))"


def q(*parts: str) -> str:
    return "WITH " + ", ".join(parts[:-1]) + " " + parts[-1] if len(parts) > 1 else parts[0]


def matched(prefixes: list[str] = (), phrases: list[list[str]] = (), where: str = "") -> list[str]:
    """CTEs hit (id, relevance) and cand (web with relevance)."""
    parts = []
    for k, p in enumerate(prefixes):
        parts.append(f"SELECT {k} AS atom, id, count(*) AS tf FROM toks WHERE starts_with(token, '{p}') GROUP BY id")
    for k, ws in enumerate(phrases):
        joins = " ".join(f"JOIN toks t{i} ON t{i}.id = t0.id AND t{i}.pos = t0.pos + {i} AND t{i}.token = '{w}'" for i, w in enumerate(ws) if i)
        parts.append(f"SELECT {100 + k} AS atom, t0.id, count(*) AS tf FROM toks t0 {joins} WHERE t0.token = '{ws[0]}' GROUP BY t0.id")
    n = len(parts)
    return [PAGES, TOKENS, "atoms AS (" + " UNION ALL ".join(parts) + ")", "df AS (SELECT atom, count(*) AS df FROM atoms GROUP BY atom)", f"hit AS (SELECT id, round(sum(tf * pow(ln((SELECT count(*) FROM web) / df), 2)), 6) AS relevance FROM atoms JOIN df USING (atom) GROUP BY id HAVING count(*) = {n})", f"cand AS (SELECT web.*, relevance FROM web JOIN hit USING (id) WHERE status = 'indexed' {where})"]


def ranked(terms: list[str], order: str = "") -> list[str]:
    """CTEs top (200) and score."""
    has = lambda c: "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for t in terms) + ")"
    score = f"0.6 * least(1.7, relevance / m + CASE WHEN {has('title')} THEN 0.5 ELSE 0 END + CASE WHEN {has('meta_description')} THEN 0.2 ELSE 0 END) + 0.15 * (1 / (1 + greatest(0, date_diff('second', crawled_at, {NOW}) / 86400.0) / 30)) + 0.15 * (0.5 * least(word_count / 1000, 1) + CASE WHEN trim(coalesce(title, '')) <> '' THEN 0.25 ELSE 0 END + CASE WHEN trim(coalesce(meta_description, '')) <> '' THEN 0.25 ELSE 0 END) + 0.1 * backlinks / greatest(1, max(backlinks) OVER ())"
    return [EDGES, "top AS (SELECT * FROM cand ORDER BY relevance DESC, id LIMIT 200)", "bl AS (SELECT target_page_id AS id, count(*) AS n FROM edges GROUP BY 1)", "withl AS (SELECT top.*, coalesce(n, 0) AS backlinks, CASE WHEN max(relevance) OVER () > 0 THEN max(relevance) OVER () ELSE 1 END AS m FROM top LEFT JOIN bl USING (id))", f"scored AS (SELECT *, round({score}, 6) AS score FROM withl)", f"placed AS (SELECT *, CAST(row_number() OVER (ORDER BY {order}score DESC, relevance DESC, id) AS INT) AS position FROM scored)"]


def snippet(words: list[str]) -> str:
    clean = r"trim(regexp_replace(content_text, '[\s\x0b\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]+', ' ', 'g'))"
    spot = "greatest(0, coalesce(list_min(list_filter([" + ", ".join(f"instr(lower({clean}), '{w}')" for w in words) + "], lambda p: p > 0)), 1) - 1 - 100)"
    part = f"CASE WHEN {spot} > 0 THEN '…' ELSE '' END || trim(substr({clean}, CAST({spot} + 1 AS BIGINT), 200)) || CASE WHEN {spot} + 200 < length({clean}) THEN '…' ELSE '' END"
    esc = part
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        esc = f"replace({esc}, '{a}', '{b}')"
    return f"regexp_replace({esc}, '(?i)({'|'.join(words)})', '<mark>\\1</mark>', 'g')"


def results(words: list[str], where: str) -> str:
    return f"SELECT position, id, CASE WHEN coalesce(title, '') IN ('', '0') THEN url ELSE title END AS title, url, {snippet(words)} AS snippet, domain, language, strftime(crawled_at, '%Y-%m-%dT%H:%M:%S') AS crawled_at, relevance, score FROM placed WHERE {where}"


# ------------------------------------------------------------------ URLs

PART = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"
PERCENT = r"'^(?:[^%]|%[0-9A-Fa-f]{2})*$'"


def _dec(x: str, form: bool) -> str:
    y = f"replace({x}, '+', ' ')" if form else x
    return f"CASE WHEN regexp_matches({x}, {PERCENT}) THEN url_decode({y}) ELSE {y} END"


def _enc(x: str, form: bool) -> str:
    return f"replace(url_encode({x}), '%20', '+')" if form else f"url_encode({x})"


def normalized(url: str) -> str:
    """A scalar expression; url must be a column or a literal."""
    p = lambda k: f"regexp_extract(trim({url}), {PART}, {k})"
    where = f"regexp_replace({p(2)}, '^.*@', '')"
    path = f"rtrim(list_aggregate(list_transform(string_split({_dec(p(3), False)}, '/'), lambda s: {_enc('s', False)}), 'string_agg', '/'), '/')"
    tracking = "('utm_source','utm_medium','utm_campaign','utm_content','utm_term','ref','fbclid','gclid','source','from')"
    key, value = _dec("regexp_extract(x, '^([^=]*)', 1)", True), _dec("regexp_replace(x, '^[^=]*=?', '')", True)
    own = f"list_filter(list_transform(list_filter(string_split({p(4)}, '&'), lambda x: x <> ''), lambda x: struct_pack(k := {key}, v := {value})), lambda y: y.k <> '' AND lower(y.k) NOT IN {tracking})"
    text = f"coalesce(list_aggregate(list_transform(list_sort(list_distinct(list_transform({own}, lambda y: y.k))), lambda k: {_enc('k', True)} || '=' || {_enc(f'list_filter({own}, lambda z: z.k = k)[-1].v', True)}), 'string_agg', '&'), '')"
    return f"CASE WHEN regexp_replace({where}, ':\\d*$', '') = '' THEN {url} ELSE CASE WHEN {p(1)} = '' THEN 'http' ELSE lower({p(1)}) END || '://' || lower({where}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {text} = '' THEN '' ELSE '?' || {text} END END"


EXT = "('" + "','".join("css js jpg jpeg png gif svg webp ico pdf zip rar mp3 mp4 avi mov wmv doc docx xls xlsx ppt pptx xml json rss atom woff woff2 ttf eot map".split()) + "')"


def _keys(url: str) -> str:
    return f"list_filter(list_transform(list_filter(string_split(regexp_extract({url}, {PART}, 4), '&'), lambda x: x <> ''), lambda x: struct_pack(k := lower(regexp_extract(x, '^([^=]*)', 1)), v := regexp_replace(x, '^[^=]*=?', ''))), lambda y: y.k <> '')"


def session(url: str) -> str:
    return f"len(list_filter({_keys(url)}, lambda y: y.k IN ('sid','phpsessid','sessionid','jsessionid','session_id'))) > 0"


def crawlable(url: str) -> str:
    return f"(regexp_replace(regexp_replace(regexp_extract({url}, {PART}, 2), '^.*@', ''), ':\\d*$', '') <> '' AND lower(regexp_extract({url}, {PART}, 1)) IN ('http','https') AND strlen({url}) <= 2048 AND lower(regexp_extract(regexp_extract({url}, {PART}, 3), '\\.([^./]*)$', 1)) NOT IN {EXT} AND len(list_distinct(list_transform({_keys(url)}, lambda y: y.k))) <= 3 AND NOT {session(url)})"


def paged(url: str) -> str:
    number = f"regexp_extract(regexp_extract({url}, {PART}, 3), '(?i)/page[/=](\\d+)', 1)"
    return f"CASE WHEN {number} <> '' THEN CAST({number} AS HUGEINT) > 5 ELSE len(list_filter({_keys(url)}, lambda y: y.k IN ('page','p','paged') AND coalesce(try_cast(CASE WHEN regexp_matches(y.v, '^\\d{{1,18}}$') THEN y.v END AS BIGINT) > 5, false))) > 0 END"


def calendar(url: str) -> str:
    return f"regexp_matches(regexp_extract({url}, {PART}, 3), '/(19|20)\\d{{2}}/\\d{{1,2}}/\\d{{1,2}}(/|$)')"


#: URLs with variants: tracking, page numbers, dates, sessions, files, escapes, upper case, trailing slashes.
URLS = "urls AS (SELECT page_id * 12 + k AS id, CASE k WHEN 0 THEN url WHEN 1 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=z&b=2&a=1' WHEN 2 THEN base || '/page/' || (page_id % 12) WHEN 3 THEN base || '/2024/01/' || (page_id % 28 + 1) || '/' WHEN 4 THEN base || '/x.' || CASE WHEN page_id % 2 = 0 THEN 'PDF' ELSE 'html' END WHEN 5 THEN base || '/list?page=' || (page_id % 12) || '&q=a+b%20c' WHEN 6 THEN base || '/?SID=' || page_id WHEN 7 THEN upper(base) || '/A%2fb c/~x*y//' WHEN 8 THEN base || '/p/' || page_id || '?a=1&b=2&c=3&d=4' WHEN 9 THEN '/rel/' || page_id WHEN 10 THEN base || '/q?x=1&x=2&=5&y&ref=k&z=%C3%A9' ELSE base || '//' END AS url FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base FROM pages), (SELECT unnest(range(12)) AS k))"
#: The same as a Spark expression over pages, after posexplode of 12 places.
URLS_SPARK = URLS[len("urls AS (SELECT page_id * 12 + k AS id, ") : URLS.index(" AS url FROM (SELECT page_id")]
ROBOTS = "rules(host_part, kind, pattern) AS (VALUES ('com', 'disallow', '/en/'), ('com', 'allow', '/en/1'), ('net', 'disallow', '/*.html$'), ('net', 'disallow', '/fr'), ('net', 'allow', '/fr'), ('org', 'disallow', '/*/1'))"
