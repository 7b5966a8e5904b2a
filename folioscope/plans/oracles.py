"""The registered queries restated in SQL, as independent checks.

Written from the rules, for an engine without look-around: each statement uses
another way to the result than the Spark query it checks where there is one.
"""

from __future__ import annotations

from folioscope.plans.queries import QUERY, URI_PREFIX

# Whitespace and line boundaries as regular expression class bodies.
_S = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_L = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"regexp_replace({_trim(x)}, '[{_S}]+', ' ', 'g')"


def _heads(source: str) -> str:
    """CTE ``h``: title and raw lead line of (doc_id, stem, text) rows."""
    return f"""
    lines_ AS (SELECT *, list_transform(string_split_regex(text, '{_L}'), lambda x: {_trim('x')}) AS ls FROM {source}),
    at_ AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: x <> '' AND NOT starts_with(x, '#')), true), 0) AS bp
            FROM lines_),
    h AS (SELECT * EXCLUDE (ls, bp), CASE WHEN bp > 0 THEN ls[bp] END AS lead,
            coalesce(list_filter(list_transform(list_filter(CASE WHEN bp > 0 THEN ls[1:bp - 1] ELSE ls END,
                       lambda x: starts_with(x, '#')), lambda x: {_trim("regexp_replace(x, '^[# ]+', '')")}),
                     lambda x: x <> '')[-1], stem) AS title
          FROM at_)"""


_DOCS = f"""
    d AS (SELECT doc_id, lang AS category, CAST(doc_id AS VARCHAR) AS stem, text,
            lang || '/' || doc_id AS name, '{URI_PREFIX}' || lang || '/' || doc_id AS uri FROM documents),
    {_heads('d')},
    q_ AS (SELECT *, {_squeeze('coalesce(lead, title)')} AS flat FROM h),
    e AS (SELECT * EXCLUDE (flat, lead), CASE WHEN length(flat) <= 180 THEN flat
            ELSE rtrim(regexp_extract(flat, '^(.{{0,179}}) ', 1)) || '…' END AS description FROM q_)"""

_POSTINGS = f"""{_DOCS},
    tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(title || chr(10) || description || chr(10) || text), '[a-z0-9]+')) AS term FROM e),
    post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
    norms AS (SELECT doc_id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS norm FROM post GROUP BY doc_id)"""


def _hits(queries: str) -> str:
    """CTE ``hits`` for (query_id, query, top_k) rows."""
    return f"""{_POSTINGS},
    asked AS ({queries}),
    qtok AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM asked),
    qt AS (SELECT query_id, term, count(*) AS w FROM qtok GROUP BY query_id, term),
    qn AS (SELECT query_id, sqrt(CAST(sum(w * w) AS DOUBLE)) AS qnorm FROM qt GROUP BY query_id),
    dots AS (SELECT query_id, doc_id, CAST(sum(tf * w) AS DOUBLE) AS dot FROM post JOIN qt USING (term) GROUP BY query_id, doc_id),
    scored AS (SELECT query_id, doc_id, dot / (norm * qnorm) AS score FROM dots JOIN norms USING (doc_id) JOIN qn USING (query_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM scored),
    hits AS (SELECT query_id, CAST(rk AS INTEGER) AS rank, doc_id, score, name, title, uri, description
             FROM ranked JOIN asked USING (query_id) JOIN e USING (doc_id) WHERE rk <= top_k)"""


def _canon(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, '^[^?#]*'), '/+$', '')"


def _cat(url: str) -> str:
    return f"nullif(regexp_extract({url}, '^[a-z]+://[^/]*/(en|fr|de|es)(/|$|[?#])', 1), '')"


def _slug(url: str) -> str:
    return f"regexp_extract({url}, '([^/]*)$', 1)"


_TARGETS = f"""
    c AS (SELECT page_id, {_canon('url')} AS url FROM pages),
    targets AS (SELECT min(page_id) AS ord, {_cat('url')} AS category, {_slug('url')} AS slug, url
                FROM c WHERE {_cat('url')} IS NOT NULL GROUP BY url)"""

# The two robots groups: rule number, path prefix, verdict.
_ROBOTS = """
    rules(agent, n, prefix, allow) AS (VALUES
      ('browser', 1, '/fr/8', true), ('browser', 2, '/fr', false), ('browser', 3, '', true),
      ('other', 1, '/en/1', false), ('other', 2, '/en/15', true), ('other', 3, '/de/', false), ('other', 4, '/fr/23', false)),
    verdicts AS (SELECT u.url, r.agent, arg_min(r.allow, r.n) AS allow
                 FROM (SELECT DISTINCT {canon} AS url FROM pages) u
                 JOIN rules r ON starts_with(regexp_replace(u.url, '^[a-z]+://[^/]*', ''), r.prefix)
                 GROUP BY u.url, r.agent)""".format(canon=_canon("url"))

_STATUS = f"""{_TARGETS}, {_ROBOTS},
    stored AS (SELECT {_canon('url')} AS url, bool_or(NOT contains(url, '#')) AS present
               FROM pages WHERE NOT contains(url, '?') GROUP BY 1),
    fetched AS (SELECT {_canon('url')} AS url, bool_or(NOT contains(url, '.example.net/')) AS ok
                FROM pages WHERE NOT contains(url, '/es/') GROUP BY 1),
    plan AS (SELECT t.url, t.category, t.slug, coalesce(s.present, false) AS stored_ok,
               CASE WHEN coalesce(s.present, false) AND NOT contains(t.url, '.example.org/') THEN 'CACHE' ELSE 'FETCH' END AS plan
             FROM targets t LEFT JOIN stored s USING (url)),
    outcome AS (SELECT p.url, p.category, p.slug, p.plan,
                 CASE WHEN NOT coalesce(v.allow, true) THEN 'SKIP ROBOTS'
                      WHEN p.plan = 'CACHE' AND p.stored_ok THEN 'OK CACHE'
                      WHEN coalesce(f.ok, false) THEN 'OK FETCH' ELSE 'FAIL' END AS status
               FROM plan p LEFT JOIN verdicts v ON v.url = p.url AND v.agent = 'browser' LEFT JOIN fetched f ON f.url = p.url),
    status AS (SELECT url, category, slug, status, CAST(CASE WHEN status = 'SKIP ROBOTS' THEN 0 WHEN status = 'FAIL' THEN 3
                 WHEN status = 'OK FETCH' AND plan = 'CACHE' THEN 2 ELSE 1 END AS INTEGER) AS attempt FROM outcome),
    results AS (SELECT * FROM status WHERE status LIKE 'OK%')"""


def _title_case(x: str) -> str:
    """Separators to spaces, each letter run capitalised (ASCII letters)."""
    words = f"trim(regexp_replace({x}, '[-_]+', ' ', 'g'))"
    return (
        f"array_to_string(list_transform(regexp_extract_all({words}, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def _decode(x: str) -> str:
    for name, character in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{character}', 'g')"
    return x


def _escaped(x: str) -> str:
    """Text of a paragraph with Markdown's own marks escaped."""
    flat = f"trim(regexp_replace({_decode(x)}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"
    return f"regexp_replace({flat}, '([\\\\`*\\[\\]<>])', '\\\\\\1', 'g')"


def _guarded(x: str) -> str:
    """A paragraph whose first characters would start another kind of block."""
    marked = rf"regexp_replace({x}, '^(#{{1,6}}(?:\s|$)|[-+] )', '\\\1')"
    return rf"regexp_replace({marked}, '^([0-9]+)([.)] )', '\1\\\2')"


_ARTICLE = "regexp_extract(html, '(?s)<article>.*</article>')"
_RAW = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"

# The main element each category gets in the derived pages, and how to find it.
_SELECTABLE = f"""
    s AS (SELECT page_id, url, {_cat('url')} AS cat, html FROM pages),
    m AS (SELECT page_id, url, cat, CASE cat
            WHEN 'de' THEN replace(replace(html, '<article>', '<main><div class="x markdown"><div>'), '</article>', '</div></div></main>')
            WHEN 'fr' THEN replace(replace(html, '<article>', '<section itemprop="articleBody">'), '</article>', '</section>')
            WHEN 'es' THEN replace(replace(html, '<article>', '<div>'), '</article>', '</div>')
            ELSE html END AS html FROM s)"""
_SELECTED = f"""CASE cat
            WHEN 'de' THEN regexp_extract(html, '(?s)<div class="x markdown">.*</div>(?:</main>)', 0)[:-8]
            WHEN 'fr' THEN regexp_extract(html, '(?s)<section .*</section>')
            WHEN 'es' THEN regexp_replace(html, '{_RAW}', '', 'gs')
            ELSE regexp_extract(html, '(?s)<article>.*</article>') END"""


def _lines_of(markup: str) -> str:
    """Visible text of markup without raw text elements, one block per line."""
    blocks = "h1|p|br|div|article|ul|li|nav|footer"
    broken = f"regexp_replace({markup}, '</?(?:{blocks})[^>a-z0-9]?[^>]*>', chr(10), 'g')"
    bare = _decode(f"regexp_replace({broken}, '<[a-zA-Z/!][^>]*>', '', 'g')")
    return (
        f"array_to_string(list_filter(list_transform(string_split_regex({bare}, '{_L}'), lambda x: {_trim('x')}), "
        "lambda x: x <> ''), chr(10))"
    )


def _links(page: str = "html") -> str:
    """CTE ``a``: links of each page in order; all are written alike here."""
    return f"""
    raw_ AS (SELECT page_id, url, {page} AS html FROM pages),
    found_ AS (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS fs FROM raw_),
    a AS (SELECT page_id, url, CAST(unnest(generate_series(1, len(fs))) - 1 AS INTEGER) AS pos, unnest(fs) AS f,
            regexp_extract(url, '^[a-z]+://[^/]*') AS site FROM found_),
    b AS (SELECT *, {_decode('''regexp_extract(f, 'href="([^"]*)"', 1)''')} AS href,
            {_trim(_decode("regexp_extract(f, '>([^<]*)<', 1)"))} AS text FROM a)"""


def _sanitized(x: str) -> str:
    x = f"regexp_replace({x}, '<img[^>]*>', '', 'gi')"
    x = f"regexp_replace({x}, '<a[^>]*>(.*?)</a>', '\\1', 'gis')"
    x = f"regexp_replace({x}, '</?(?:span|div|section|article|header|footer|main|figure|figcaption)[^>]*>', '', 'gi')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    parts = f"list_transform(string_split_regex({x}, '{_L}'), lambda l: regexp_replace(l, '[{_S}]+$', ''))"
    return _trim(f"array_to_string({parts}, chr(10))") + " || chr(10)"


_LIST = f"""
    v AS (SELECT page_id * 4 + 2 AS ord, {_canon('url')} AS url FROM pages
          UNION ALL SELECT page_id * 4 + 3, {_canon("replace(url, '/en/', '/zz/')")} FROM pages)"""

_VARIANTS = f"""
    v AS (SELECT page_id * 3 + pos AS ord, {_canon('url')} AS url, 'spelling ' || pos || ' of ' || page_id AS title
          FROM pages, (VALUES (0), (1), (2)) t(pos))"""

_SITEMAP = f"""
    SELECT ord, category, {_title_case('slug')} AS title_guess, url, slug FROM targets"""


def _json_content(entry: str) -> str:
    return f"to_json(struct_pack(content := {entry}))"


def _text_entry(message: str) -> str:
    return _json_content(f"[struct_pack(\"type\" := 'text', text := {message})]")


def all_oracles() -> dict[str, str]:
    benchmark = "SELECT item_id AS query_id, text AS query, {k} AS top_k FROM benchmark"
    bare = "regexp_replace(lower(text), '[a-z0-9]', '', 'g')"
    requests = f"""SELECT item_id * 8 + unnest(range(8)) AS query_id, unnest([text, {bare}, text, text, text, text, '', NULL]) AS query,
            unnest([3, 3, NULL, 20, 21, 0, 3, 3]) AS top_k FROM benchmark"""
    problem = """CASE WHEN coalesce(length(query), 0) < 1 THEN 'query must not be empty'
            WHEN coalesce(top_k, 5) NOT BETWEEN 1 AND 20 THEN 'top_k must be between 1 and 20' END"""
    link = (
        "struct_pack(\"type\" := 'resource_link', uri := uri, name := name, description := description, "
        "mimeType := 'text/markdown')"
    )
    resource = (
        "[struct_pack(\"type\" := 'resource', resource := struct_pack(uri := e.uri, title := e.title, "
        "mimeType := 'text/markdown', text := e.text))]"
    )
    plain = "to_json(struct_pack(url := url, category := category, slug := slug))"
    return {
        "corpus_load": """
            SELECT lang AS category, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters
            FROM documents GROUP BY lang""",
        "corpus_scan": f"""
            WITH {_DOCS} SELECT category || '/' || stem || '.md' AS path, name, uri, title, description, md5(text) AS text_md5 FROM e""",
        "path_identity": """
            WITH f AS (SELECT CASE lang WHEN 'en' THEN lang || '/' || source || '/' || doc_id || '.md'
                WHEN 'de' THEN doc_id || '.md' WHEN 'fr' THEN 'fr/' || doc_id || '.v1.md'
                ELSE lang || '/' || doc_id || '.md' END AS path FROM documents),
            p AS (SELECT path, split_part(path, '/', 1) AS category,
                regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '') AS stem FROM f WHERE contains(path, '/'))
            SELECT *, category || '/' || stem AS name, 'doc://corpus/' || category || '/' || stem AS uri FROM p""",
        "doc_catalog": f"WITH {_DOCS} SELECT uri, name, title, description, 'text/markdown' AS mime_type, text FROM e",
        "doc_title": f"""
            WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS stem, CASE WHEN lang = 'es' THEN text ELSE
                '#  ' || lang || chr(13) || chr(10) || chr(10) || ' ' ||
                CASE WHEN source LIKE '%1' THEN '##' ELSE '##' || chr(9) || source || ' # of ' || lang || ' ' END
                || chr(10) || text END AS text FROM documents),
            {_heads('d')} SELECT doc_id, title FROM h""",
        "doc_description": f"WITH {_DOCS} SELECT doc_id, description FROM e",
        "tokens": """
            WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents)
            SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_tokens, array_to_string(ts, ' ') AS tokens FROM t""",
        "term_frequency": f"WITH {_POSTINGS} SELECT doc_id, term, tf FROM post",
        "doc_norms": f"WITH {_POSTINGS} SELECT doc_id, coalesce(norm, 1.0) AS norm FROM e LEFT JOIN norms USING (doc_id)",
        "search_topk": f"""
            WITH {_hits(f"SELECT 0 AS query_id, '{QUERY}' AS query, 10 AS top_k")}
            SELECT rank, doc_id, name, title, uri, description, score FROM hits""",
        "search_batch": f"WITH {_hits(benchmark.format(k=5))} SELECT * FROM hits",
        "search_stored_topk": f"""
            WITH {_hits(f"SELECT 0 AS query_id, '{QUERY}' AS query, 10 AS top_k")}
            SELECT rank, doc_id, name, title, uri, description, score FROM hits""",
        "search_stored_batch": f"WITH {_hits(benchmark.format(k=5))} SELECT * FROM hits",
        "search_sql": f"""
            WITH {_hits(f"SELECT 0 AS query_id, '{QUERY}' AS query, 10 AS top_k")}
            SELECT doc_id, name, title, uri, description, score FROM hits""",
        "search_empty": f"""
            WITH {_hits(benchmark.format(k=3) + f" UNION ALL SELECT -1 - item_id, {bare}, 3 FROM benchmark")}
            SELECT query_id, count(doc_id) AS hits FROM asked LEFT JOIN hits USING (query_id) GROUP BY query_id""",
        "search_validate": f"""
            WITH q AS ({requests})
            SELECT query_id, CAST(coalesce(top_k, 5) AS INTEGER) AS top_k, {problem} AS problem FROM q""",
        "search_response": f"""
            WITH {_hits(f"SELECT query_id, query, coalesce(top_k, 5) AS top_k FROM ({requests}) WHERE {problem} IS NULL")},
            g AS (SELECT query_id, CAST({_json_content(f'list({link} ORDER BY rank)')} AS VARCHAR) AS r FROM hits GROUP BY query_id),
            q AS (SELECT *, {problem} AS problem FROM ({requests}))
            SELECT query_id, problem IS NOT NULL AS rejected, CASE WHEN problem IS NOT NULL
                THEN '{{"content":[{{"type":"text","text":"' || problem || '"}}],"isError":true}}'
                ELSE coalesce(r, CAST({_text_entry("'未找到与 ''' || query || ''' 相关的文档, 请尝试其他关键词。'")} AS VARCHAR)) END AS response
            FROM q LEFT JOIN g USING (query_id)""",
        "open_doc": f"""
            WITH {_DOCS},
            r AS (SELECT doc_id AS request_id, lang || '/' || doc_id AS name FROM documents
                  UNION ALL SELECT -1 - item_id, 'none/' || item_id FROM benchmark)
            SELECT request_id, r.name, CASE WHEN e.name IS NULL
                THEN CAST({_text_entry("'未找到名称为 ''' || r.name || ''' 的文档, 可先调用 search_docs 确认可用列表。'")} AS VARCHAR)
                ELSE CAST({_json_content(resource)} AS VARCHAR) END AS response
            FROM r LEFT JOIN e ON r.name = e.name""",
        "url_canonical": f"SELECT page_id, {_canon('url')} AS url FROM pages",
        "url_category": f"""
            WITH u AS (SELECT page_id, unnest([url, replace(url, '/en/', '/english/'), regexp_replace(url, '/[0-9].*', '')]) AS url FROM pages)
            SELECT page_id, url, {_cat('url')} AS category FROM u""",
        "url_slug": f"SELECT page_id, {_slug(_canon('url'))} AS slug FROM pages",
        "slug_title": f"""
            WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
            s AS (SELECT doc_id, array_to_string(t, '-') || '__' || doc_id || '_' AS slug FROM w)
            SELECT doc_id, slug, {_title_case('slug')} AS title_guess FROM s""",
        "url_dedupe": f"WITH {_VARIANTS} SELECT min(ord) AS ord, url, arg_min(title, ord) AS title FROM v GROUP BY url",
        "url_dedupe_last": f"WITH {_VARIANTS} SELECT max(ord) AS ord, url, arg_max(title, ord) AS title FROM v GROUP BY url",
        "url_list_targets": f"""
            WITH {_LIST}, f AS (SELECT min(ord) AS ord, url, {_cat('url')} AS category, {_slug('url')} AS slug FROM v GROUP BY url)
            SELECT ord, category, {_title_case('slug')} AS title_guess, url, slug FROM f WHERE category IS NOT NULL""",
        "url_list_rejects": f"WITH {_LIST} SELECT url, min(ord) AS ord FROM v WHERE {_cat('url')} IS NULL GROUP BY url",
        "sitemap_targets": f"WITH {_TARGETS} {_SITEMAP}",
        "source_precedence": f"""
            WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS site FROM pages),
            k AS (SELECT *, length(site) % 5 AS kind FROM p),
            broken AS (SELECT DISTINCT site FROM k WHERE kind = 1 AND page_id % 2 = 0),
            {_links().strip()},
            t AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS site, page_id * 1000 + pos AS ord,
                    site || href AS target FROM b)
            SELECT site, 1 AS source, {_canon('url')} AS url, min(page_id) AS ord FROM k WHERE kind = 0 GROUP BY ALL
            UNION ALL SELECT site, 2, {_canon('url')}, min(page_id) FROM k WHERE kind IN (1, 3, 4) AND site NOT IN (SELECT site FROM broken) GROUP BY ALL
            UNION ALL SELECT site, 3, {_canon('target')}, min(ord) FROM t WHERE site IN (SELECT site FROM broken) GROUP BY ALL""",
        "index_targets": f"""
            WITH {_links(f'''replace(html, 'href="/', 'href="/' || {_cat("url")} || '/')''')},
            t AS (SELECT {_cat('url')} AS category, page_id, pos, text, 'https://docs.example.com' || regexp_replace(href, '/+$', '') AS target FROM b),
            k AS (SELECT category, target AS url, arg_min(text, page_id * 1000000 + pos) AS text, {_slug('target')} AS slug FROM t GROUP BY category, target)
            SELECT category, CASE WHEN text = '' THEN {_title_case('slug')} ELSE text END AS title_guess, url, slug FROM k""",
        "robots_allowed": f"""
            WITH {_ROBOTS}, u AS (SELECT page_id, {_canon('url')} AS url FROM pages)
            SELECT page_id, coalesce(b.allow, true) AS browser, coalesce(o.allow, true) AS other FROM u
            LEFT JOIN verdicts b ON b.url = u.url AND b.agent = 'browser' LEFT JOIN verdicts o ON o.url = u.url AND o.agent = 'other'""",
        # Which rule of a host's file a path meets first; /en/<n> and so on are plain prefixes.
        "robots_by_host": f"""
            WITH u AS (SELECT page_id, {_canon('url')} AS url FROM pages),
            p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)) AS host,
                    regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM u),
            k AS (SELECT *, length(host) % 4 AS kind, CAST(length(host) % 10 AS VARCHAR) AS n FROM p),
            z AS (SELECT *, starts_with(path, '/en/' || n || '5') OR NOT (starts_with(path, '/en/' || n) OR starts_with(path, '/de')) AS zero FROM k)
            SELECT page_id,
              CASE kind WHEN 0 THEN zero WHEN 1 THEN NOT (starts_with(path, '/fr/' || n) OR starts_with(path, '/es/')) ELSE true END AS browser,
              CASE kind WHEN 0 THEN zero WHEN 1 THEN false ELSE true END AS other FROM z""",
        "site_categories": f"""
            WITH u AS (SELECT page_id, {_canon('url')} AS url FROM pages),
            p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)) AS host,
                    string_split(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/') AS parts FROM u),
            k AS (SELECT page_id, url, CASE WHEN parts[1] = 'en' AND parts[2] = CAST(length(host) % 10 AS VARCHAR) THEN 'few'
                    WHEN starts_with(host, 'www.') OR parts[1] = 'en' THEN 'main-' || length(host) % 10
                    WHEN parts[1] = 'de' THEN 'de' END AS category FROM p),
            g AS (SELECT min(page_id) AS ord, category, url, {_slug('url')} AS slug FROM k WHERE category IS NOT NULL GROUP BY category, url)
            SELECT ord, category, {_title_case('slug')} AS title_guess, url, slug FROM g""",
        "html_main": f"WITH {_SELECTABLE} SELECT page_id, {_SELECTED} AS main FROM m",
        "html_denoise": f"""
            SELECT page_id, regexp_replace(html, '{_RAW}|<nav>.*?</nav>|<footer>.*?</footer>|<div class="ad">[^<]*</div>', '', 'gs') AS html
            FROM pages""",
        # All that the query puts in must be gone again.
        "html_decor": "SELECT page_id, html FROM pages",
        "html_title": f"""
            WITH {_SELECTABLE},
            f AS (SELECT *, CAST(unnest([0, 1]) AS INTEGER) AS pos FROM m),
            t AS (SELECT page_id, pos, {_slug(_canon('url'))} AS slug, CASE WHEN pos = 1 THEN '' ELSE
                {_trim(_decode("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} END AS h FROM f)
            SELECT page_id, pos, CASE WHEN h = '' THEN {_title_case('slug')} ELSE h END AS title FROM t""",
        "html_text": f"SELECT page_id, {_lines_of(_ARTICLE)} AS text FROM pages",
        # Articles here hold a heading and paragraphs, some of them one bold line.
        "html_markdown": f"""
            WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS art FROM pages),
            p AS (SELECT page_id, art, list_transform(string_split(regexp_replace(art, '<h1>[^<]*</h1>', ''), '<p>'),
                lambda x: struct_pack(bold := contains(x, '<b>'), t := {_escaped("regexp_replace(x, '<[^>]*>', '', 'g')")})) AS ps FROM a),
            h AS (SELECT *, regexp_extract(art, '<h1>([^<]*)</h1>', 1) AS raw FROM p),
            e AS (SELECT *, {_trim(_decode('raw'))} AS title, {_decode('raw')} AS code, {_escaped('raw')} AS t FROM h),
            g AS (SELECT *, {_guarded('t')} AS s FROM e)
            SELECT page_id, title, array_to_string(list_concat(['# ' || t, '> ' || s,
                '```' || chr(10) || rtrim(code) || chr(10) || '```', '3. ' || s || chr(10) || '4. x', '- ' || s,
                '| ' || replace(s, '|', '\\|') || ' | h |' || chr(10) || '|---|---|' || chr(10) || '| ' || replace(s, '|', '\\|') || ' |  |',
                '`c d` *e*'],
                list_transform(list_filter(ps, lambda x: x.t <> ''), lambda x: CASE WHEN x.bold THEN '**' || x.t || '**'
                  ELSE {_guarded('x.t')} END)),
                chr(10) || chr(10)) || chr(10) AS markdown FROM g""",
        "md_sanitize": f"""
            SELECT page_id, {_sanitized("replace(html, '</p>', '</p> ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || '<IMG src=x>')")} AS markdown
            FROM pages""",
        # Text here has no <, so only the code put in can show a tag.
        "residual_html": f"""
            SELECT {_cat('url')} AS category, count(*) AS documents, count(*) FILTER (page_id % 3 = 0) AS with_tags
            FROM pages GROUP BY 1""",
        "page_links": f"""
            WITH {_links()}, t AS (SELECT *, site || regexp_replace(href, '/+$', '') AS target FROM b)
            SELECT page_id, pos, href, target, CASE WHEN text = '' THEN {_title_case(_slug('target'))} ELSE text END AS title FROM t""",
        "link_rewrite": f"""
            WITH l0 AS (SELECT page_id, {_canon('url')} AS url, {_cat('url')} AS cat, regexp_extract_all(html, '<a href="[^"]*">') AS fs FROM pages),
            l1 AS (SELECT *, CAST(unnest(generate_series(1, len(fs))) - 1 AS INTEGER) AS pos, unnest(fs) AS f FROM l0),
            l2 AS (SELECT page_id, url, cat, pos, {_decode('''regexp_extract(f, 'href="([^"]*)"', 1)''')} AS old FROM l1)
            SELECT page_id, url, pos,
              CASE old WHEN '/The' THEN '/' || cat || '/the/#top' WHEN '/and' THEN '../de/9/' WHEN '/of' THEN '/' || cat || '/7?x=1'
                WHEN '/to' THEN '#top' WHEN '/de' THEN '//fr.example.org/fr/8#a' ELSE old END AS href,
              CASE old WHEN '/The' THEN 'the.md#top' WHEN '/and' THEN CASE WHEN cat = 'de' THEN '9.md' ELSE '../de/9.md' END
                WHEN '/of' THEN regexp_extract(url, '^[a-z]+://[^/]*') || '/' || cat || '/7?x=1' WHEN '/to' THEN '#top'
                WHEN '/de' THEN CASE WHEN cat = 'fr' THEN '8.md#a' ELSE '../fr/8.md#a' END
                ELSE CASE WHEN NOT regexp_matches(old, '^/(en|fr|es)$') THEN regexp_extract(url, '^[a-z]+://[^/]*') || old
                  WHEN old = '/' || cat THEN cat || '.md' ELSE '..' || old || old || '.md' END END AS new_href
            FROM l2""",
        # Each page cut at its links; their new targets seen from the page's own file.
        "links_moved": f"""
            WITH {_TARGETS},
            m AS (SELECT url, 'moved/' || category || '/' || slug || '.md' AS file FROM targets WHERE ord % 3 = 0),
            p AS (SELECT a.page_id, {_canon('a.url')} AS url, string_split(a.html, '<a href="') AS parts,
                    coalesce(n.url, '/The') AS after, coalesce(f.url, '/and') AS first
                  FROM pages a LEFT JOIN pages n ON n.page_id = a.page_id + 1 LEFT JOIN pages f ON f.page_id = a.page_id - a.page_id % 100),
            x AS (SELECT * EXCLUDE (parts), unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM p),
            h AS (SELECT *, {_decode('''regexp_extract(part, '^[^"]*')''')} AS old FROM x WHERE pos > 0),
            k AS (SELECT *, CASE old WHEN '/The' THEN after WHEN '/and' THEN first ELSE old END AS href FROM h),
            b AS (SELECT *, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/]*') || href ELSE href END AS absolute FROM k),
            t AS (SELECT *, {_canon('absolute')} AS target FROM b),
            w AS (SELECT t.*, coalesce(mt.file, {_cat('t.target')} || '/' || {_slug('t.target')} || '.md') AS goal,
                    coalesce(mu.file, {_cat('t.url')} || '/' || {_slug('t.url')} || '.md') AS here
                  FROM t LEFT JOIN m mt ON mt.url = t.target LEFT JOIN m mu ON mu.url = t.url),
            r AS (SELECT *, regexp_extract(here, '^(.*)/', 1) AS own, regexp_extract(goal, '^(.*)/', 1) AS other, regexp_extract(goal, '[^/]*$') AS name FROM w),
            n AS (SELECT *, CASE WHEN goal IS NULL OR here IS NULL OR contains(absolute, '?') THEN absolute ELSE
                    CASE WHEN own = other THEN name
                      WHEN starts_with(own, 'moved/') AND starts_with(other, 'moved/') THEN '../' || other[7:] || '/' || name
                      WHEN starts_with(own, 'moved/') THEN '../../' || goal ELSE '../' || goal END
                    || regexp_extract(absolute, '#.*') END AS new FROM r)
            SELECT page_id, string_agg(CASE WHEN pos = 0 THEN part ELSE '<a href="' || replace(new, '&', '&amp;') || regexp_replace(part, '^[^"]*', '') END, '' ORDER BY pos) AS html
            FROM (SELECT page_id, pos, part, NULL AS new FROM x WHERE pos = 0 UNION ALL SELECT page_id, pos, part, new FROM n) GROUP BY page_id""",
        "category_volumes": """
            WITH d AS (SELECT lang AS category, reverse(CAST(doc_id AS VARCHAR)) || '/' || source AS path, text, strlen(text) AS size FROM documents),
            r AS (SELECT *, sum(size) OVER (PARTITION BY category ORDER BY path) - size AS before FROM d)
            SELECT category, CAST(floor(before / 100000) AS BIGINT) AS volume, count(*) AS documents,
              string_agg(text, chr(10) || chr(10) ORDER BY path) AS markdown FROM r GROUP BY 1, 2""",
        "target_order": f"""
            WITH {_TARGETS} SELECT category, slug, url, row_number() OVER (ORDER BY category, slug, url) AS ordinal FROM targets""",
        "corpus_order": """
            WITH f AS (SELECT lang || '/' || source || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '-' END || doc_id || '.md' AS path FROM documents)
            SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS ordinal FROM f""",
        "page_store": """
            SELECT page_id, url, html || CASE WHEN page_id % 7 = 0 THEN '<!-- 3 -->' WHEN page_id % 3 = 0 THEN '<!-- 2 -->' ELSE '<!-- 1 -->' END AS html
            FROM pages WHERE page_id % 5 > 0 OR page_id % 3 = 0 OR page_id % 7 = 0""",
        "challenge_pages": """
            SELECT page_id, starts_with(url, 'http:') AND contains(url, '.example.org') AS challenge FROM pages""",
        "fetch_plan": f"WITH {_STATUS} SELECT url, category, slug, plan FROM plan",
        "page_status": f"WITH {_STATUS} SELECT * FROM status",
        "convert_run": f"""
            WITH {_STATUS.replace("AND NOT contains(t.url, '.example.org/')", "")},
            k AS (SELECT {_canon('url')} AS url, 'OK CACHE' AS status, arg_max(html, page_id) AS html FROM pages
                  WHERE NOT contains(url, '?') AND NOT contains(url, '#') GROUP BY 1
                  UNION ALL SELECT {_canon('url')}, 'OK FETCH', arg_max(html, page_id) FROM pages
                  WHERE NOT contains(url, '/es/') AND NOT contains(url, '.example.net/') GROUP BY 1),
            a AS (SELECT url, status, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS art FROM k),
            p AS (SELECT url, status, art, list_transform(string_split(regexp_replace(art, '<h1>[^<]*</h1>', ''), '<p>'),
                lambda x: struct_pack(bold := contains(x, '<b>'), t := {_escaped("regexp_replace(x, '<[^>]*>', '', 'g')")})) AS ps FROM a),
            h AS (SELECT *, regexp_extract(art, '<h1>([^<]*)</h1>', 1) AS raw FROM p)
            SELECT url, category, slug, status, attempt, {_trim(_decode('raw'))} AS title,
                array_to_string(list_concat(['# ' || {_escaped('raw')}],
                  list_transform(list_filter(ps, lambda x: x.t <> ''), lambda x: CASE WHEN x.bold THEN '**' || x.t || '**'
                    ELSE {_guarded('x.t')} END)), chr(10) || chr(10)) || chr(10) AS markdown
            FROM results JOIN h USING (url, status)""",
        "missing_pages": f"WITH {_STATUS} SELECT url, category, slug FROM targets WHERE url NOT IN (SELECT url FROM results)",
        "category_summary": f"""
            WITH {_STATUS} SELECT t.category, count(*) AS expected, count(r.url) AS succeeded
            FROM targets t LEFT JOIN results r USING (url) GROUP BY ROLLUP (t.category)""",
        "url_manifest": f"""
            WITH {_STATUS}
            SELECT 'expected_items' AS section, CAST({plain} AS VARCHAR) AS item FROM targets
            UNION ALL SELECT 'missing_items', CAST({plain} AS VARCHAR) FROM targets WHERE url NOT IN (SELECT url FROM results)
            UNION ALL SELECT 'items', CAST(to_json(struct_pack(url := url, category := category, title := {_title_case('slug')}, slug := slug,
                raw_html := 'raw_html/' || category || '/' || slug || '.html',
                cleaned_html := 'cleaned_html/' || category || '/' || slug || '.html',
                markdown := 'md/' || category || '/' || slug || '.md')) AS VARCHAR) FROM results""",
        "category_merge": """
            SELECT lang AS category, CAST(floor(doc_id / 100) AS BIGINT) AS volume, count(*) AS documents,
              string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS markdown
            FROM documents GROUP BY 1, 2""",
    }
