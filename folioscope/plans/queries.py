"""The engine's operators over the ``documents``, ``pages`` and ``benchmark`` tables.

Conventions: a document's category is its language, its key and file stem are
``doc_id``; a page's category is its first path segment; ``benchmark`` holds
search queries. Where the tables lack a case (headings, decorations, files
without a directory), the query derives it from every row of a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import html, text, urls
from folioscope.functions.urls import Category, Site
from folioscope.operators import coverage, documents, links, robots, search, targets
from folioscope.plans import convert
from folioscope.sources import markdown, tables
from folioscope.sources import targets as target_sources
from folioscope.sinks import index, scratch, store
from folioscope.sinks.tree import remove_tree, write_tree
from folioscope.sources.tables import table

SITE = Site(
    base_url="https://docs.example.com",
    categories=tuple(Category(k, f"/{k}/", f"https://docs.example.com/{k}/") for k in ("en", "fr", "de", "es")),
)
URI_PREFIX = "doc://corpus/"
QUERY = "the nation of the and in a"
BROWSER = "Mozilla/5.0 (X11; Linux x86_64)"
INDEX_BUCKETS = 8  # at least
TREE_PARTS = 2
ROBOTS = """
User-agent: *
Disallow: /en/1
Allow: /en/15
Disallow: /de/
Disallow: /fr/2%33

User-agent: mozilla
Allow: /fr/8
Disallow: /fr
Disallow:
"""


def _raw_documents(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents")
    return rows.select("doc_id", F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("stem"), "text")


def _enrich(rows: DataFrame) -> DataFrame:
    return documents.enrich(documents.identify(rows, URI_PREFIX))


def _enriched(spark: SparkSession, root: str) -> DataFrame:
    return _enrich(_raw_documents(spark, root))


def _counted(spark: SparkSession, root: str) -> DataFrame:
    return documents.counted(_enriched(spark, root))


def _postings(spark: SparkSession, root: str) -> DataFrame:
    return documents.postings(_counted(spark, root))


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages")


def _urls(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select("page_id", "url")


def _page_targets(spark: SparkSession, root: str) -> DataFrame:
    return targets.build(_urls(spark, root).withColumnRenamed("page_id", "ord"), SITE)


def _canonical(column: str = "url") -> Column:
    return urls.canonical(F.col(column), SITE.base_url)


def _benchmark(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _without_tokens(query: Column) -> Column:
    """A query of which no token is left."""
    return F.regexp_replace(F.lower(query), "[a-z0-9]", "")


# -------------------------------------------------------------- documents


def corpus_load(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents")
    return rows.groupBy(F.col("lang").alias("category")).agg(
        F.count("*").alias("documents"), F.sum(F.char_length("text")).cast("bigint").alias("characters")
    )


def corpus_scan(spark: SparkSession, root: str) -> DataFrame:
    """The documents as a tree of files, a folder each, found again by listing and read whole.

    A folder and a file take a block of disk each, and most documents are
    smaller. So the documents have their tree in parts, one after the other: a
    part that is read goes before the next one is written.
    """
    category, stem = (F.nullif(F.col(name), F.lit("")).alias(name) for name in ("category", "stem"))
    rows = _raw_documents(spark, root).select(category, stem, F.col("text").alias("value"))
    part = F.pmod(F.xxhash64("category", "stem"), F.lit(TREE_PARTS))  # rows of one folder are in one part
    path = F.regexp_replace("path", r"\Acategory=([^/]*)/stem=([^/]*)/.*", "$1/$2.md")
    scanned = []
    for n in range(TREE_PARTS):
        if n:
            remove_tree(spark, tree)
        tree = scratch.new_path(spark, "tree")
        write_tree(rows.where(part == n), tree, "category", "stem")
        files = tables.read_tree(spark, tree, "part-*.txt")
        found = files.select(path.alias("path"), F.regexp_replace("text", r"\n\z", "").alias("text"))
        enriched = documents.enrich(documents.with_identity(found, URI_PREFIX))
        out = enriched.select("path", "name", "uri", "title", "description", F.md5("text").alias("text_md5"))
        scanned.append(scratch.stored(out, "scan"))
    return markdown.require_documents(reduce(DataFrame.unionAll, scanned))


def path_identity(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "lang", "source")
    number = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("lang") == "en", F.concat_ws("/", "lang", "source", F.concat(number, F.lit(".md"))))
        .when(F.col("lang") == "de", F.concat(number, F.lit(".md")))
        .when(F.col("lang") == "fr", F.concat(F.lit("fr/"), number, F.lit(".v1.md")))
        .otherwise(F.concat(F.col("lang"), F.lit("/"), number, F.lit(".md")))
    )
    return documents.with_identity(rows.select(path.alias("path")), "doc://corpus//")


def doc_catalog(spark: SparkSession, root: str) -> DataFrame:
    return documents.catalog(_enriched(spark, root))


def doc_title(spark: SparkSession, root: str) -> DataFrame:
    """Documents under two headings, the second empty for some sources."""
    rows = table(spark, root, "documents")
    second = F.when(F.col("source").endswith("1"), F.lit("##")).otherwise(
        F.concat(F.lit("##\t"), F.col("source"), F.lit(" # of "), F.col("lang"), F.lit(" "))
    )
    marked = F.concat(F.lit("#  "), F.col("lang"), F.lit("\r\n\n "), second, F.lit("\n"), F.col("text"))
    plain = F.when(F.col("lang") == "es", F.col("text")).otherwise(marked)
    return rows.select("doc_id", text.title(plain, F.col("doc_id").cast("string")).alias("title"))


def doc_description(spark: SparkSession, root: str) -> DataFrame:
    return _enriched(spark, root).select("doc_id", "description")


def tokens(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("doc_id", "text")
    found = rows.withColumn("found", text.tokens(F.col("text")))
    return found.select(
        "doc_id", F.size("found").cast("bigint").alias("n_tokens"), F.array_join("found", " ").alias("tokens")
    )


def term_frequency(spark: SparkSession, root: str) -> DataFrame:
    return _postings(spark, root).select("doc_id", "term", "tf")


def doc_norms(spark: SparkSession, root: str) -> DataFrame:
    return _counted(spark, root).select("doc_id", "norm")


# ----------------------------------------------------------------- search


def search_topk(spark: SparkSession, root: str) -> DataFrame:
    return search.search(_counted(spark, root), QUERY, 10)


def _ranked(spark: SparkSession, root: str, queries: DataFrame) -> DataFrame:
    """Hits with document columns; only winners get a title and description."""
    hits = search.search_batch(_postings(spark, root), queries)
    return _enrich(search.with_documents(hits, _raw_documents(spark, root)))


def search_batch(spark: SparkSession, root: str) -> DataFrame:
    queries = _benchmark(spark, root).withColumn("top_k", F.lit(search.DEFAULT_TOP_K))
    return _ranked(spark, root, queries).select(
        "query_id", "rank", "doc_id", "name", "title", "uri", "description", "score"
    )


def search_empty(spark: SparkSession, root: str) -> DataFrame:
    """Hits per query for the benchmark queries and for token-free forms of them."""
    asked = _benchmark(spark, root)
    bare = asked.select((-1 - F.col("query_id")).alias("query_id"), _without_tokens(F.col("query")).alias("query"))
    queries = asked.unionByName(bare).withColumn("top_k", F.lit(3))
    hits = search.search_batch(_postings(spark, root), queries).groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def _requests(spark: SparkSession, root: str) -> DataFrame:
    """Each benchmark query as it is, without tokens, and as requests to reject."""
    asked, none = F.col("query"), F.lit(None)
    forms = (
        (asked, 3), (_without_tokens(asked), 3), (asked, None), (asked, search.MAX_TOP_K),
        (asked, search.MAX_TOP_K + 1), (asked, 0), (F.lit(""), 3), (none.cast("string"), 3),
    )
    form = F.array(*[F.struct(q.alias("query"), F.lit(k).cast("int").alias("top_k")) for q, k in forms])
    rows = _benchmark(spark, root).select("query_id", F.posexplode(form).alias("pos", "form"))
    return rows.select((F.col("query_id") * len(forms) + F.col("pos")).alias("query_id"), "form.*")


def search_validate(spark: SparkSession, root: str) -> DataFrame:
    return search.validated(_requests(spark, root)).select("query_id", "top_k", "problem")


_indexes: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, root: str) -> str:
    """Name of the stored index over the documents: built once in a session, then read."""
    known = (spark.sparkContext.applicationId, root)
    if known not in _indexes:
        name = f"corpus_{len(_indexes)}"
        buckets = index.buckets_for(spark.read.parquet(f"{root}/documents.parquet"), INDEX_BUCKETS)
        index.write_index(_enriched(spark, root), name, buckets, path=scratch.new_path(spark, "index"))
        _indexes[known] = name
    return _indexes[known]


def search_stored_topk(spark: SparkSession, root: str) -> DataFrame:
    docs, postings = index.read_index(spark, _index(spark, root))
    return search.search_stored(postings, docs, QUERY, 10)


def search_stored_batch(spark: SparkSession, root: str) -> DataFrame:
    docs, postings = index.read_index(spark, _index(spark, root))
    queries = _benchmark(spark, root).withColumn("top_k", F.lit(search.DEFAULT_TOP_K))
    hits = search.search_batch(postings, queries, colocated=True)
    return search.with_documents(hits, docs).select(
        "query_id", "rank", "doc_id", "name", "title", "uri", "description", "score"
    )


def search_response(spark: SparkSession, root: str) -> DataFrame:
    """Requests answered from the stored index; the bad ones get their error."""
    docs, postings = index.read_index(spark, _index(spark, root))
    requests = _requests(spark, root)
    hits = search.search_batch(postings, search.accepted(requests), colocated=True)
    return search.search_response(requests, search.with_documents(hits, docs))


def search_sql(spark: SparkSession, root: str) -> DataFrame:
    """The table function over the stored index."""
    name = _index(spark, root)
    index.search_function(spark, name)
    return spark.sql(f"SELECT doc_id, name, title, uri, description, score FROM {name}_search('{QUERY}', 10)")


def open_doc(spark: SparkSession, root: str) -> DataFrame:
    """Every document by name, and a name without a document for every query."""
    known = table(spark, root, "documents").select(
        F.col("doc_id").alias("request_id"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("name")
    )
    unknown = table(spark, root, "benchmark").select(
        (-1 - F.col("item_id")).alias("request_id"), F.concat(F.lit("none/"), F.col("item_id")).alias("name")
    )
    requests = known.unionByName(unknown)
    named = documents.identify(_raw_documents(spark, root), URI_PREFIX)
    return search.open_response(requests, documents.enrich(search.find_documents(requests, named)))


# ------------------------------------------------------------------- URLs


def url_canonical(spark: SparkSession, root: str) -> DataFrame:
    return _urls(spark, root).select("page_id", _canonical().alias("url"))


def url_category(spark: SparkSession, root: str) -> DataFrame:
    """Pages and their section roots; a longer first segment is no category."""
    forms = F.explode(
        F.array(F.col("url"), F.replace("url", F.lit("/en/"), F.lit("/english/")), F.regexp_replace("url", r"/\d.*", ""))
    )
    rows = _urls(spark, root).select("page_id", forms.alias("url"))
    return rows.select("page_id", "url", urls.category(F.col("url"), SITE.categories).alias("category"))


def url_slug(spark: SparkSession, root: str) -> DataFrame:
    return _urls(spark, root).select("page_id", urls.slug(_canonical()).alias("slug"))


def slug_title(spark: SparkSession, root: str) -> DataFrame:
    """Slugs made of all words of each document."""
    rows = table(spark, root, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))
    slug = F.concat(F.array_join("words", "-"), F.lit("__"), F.col("doc_id").cast("string"), F.lit("_"))
    return rows.select("doc_id", slug.alias("slug")).select("doc_id", "slug", urls.title_guess(F.col("slug")).alias("title_guess"))


def _variants(spark: SparkSession, root: str) -> DataFrame:
    """Each page URL in three spellings that share one canonical form."""
    forms = F.array("url", F.concat(_canonical(), F.lit("/")), F.concat(_canonical(), F.lit("?again#x")))
    rows = _urls(spark, root).select("page_id", F.posexplode(forms).alias("pos", "url"))
    return rows.select(
        (F.col("page_id") * 3 + F.col("pos")).alias("ord"),
        _canonical().alias("url"),
        F.concat(F.lit("spelling "), "pos", F.lit(" of "), "page_id").alias("title"),
    )


def url_dedupe(spark: SparkSession, root: str) -> DataFrame:
    return targets.first_by(_variants(spark, root), "url", ord="ord").select("ord", "url", "title")


def url_dedupe_last(spark: SparkSession, root: str) -> DataFrame:
    return targets.last_by(_variants(spark, root), "url", ord="ord").select("ord", "url", "title")


def _list_lines(spark: SparkSession, root: str) -> DataFrame:
    """A URL list: padded URLs, comments, blanks and unknown sections."""
    forms = F.array(
        F.concat(F.lit("# "), "url"),
        F.lit(" \t"),
        F.concat(F.lit("\t "), "url", F.lit(" \xa0")),
        F.replace("url", F.lit("/en/"), F.lit("/zz/")),
    )
    rows = _urls(spark, root).select("page_id", F.posexplode(forms).alias("pos", "url"))
    return rows.select((F.col("page_id") * 4 + F.col("pos")).alias("ord"), "url")


def url_list_targets(spark: SparkSession, root: str) -> DataFrame:
    return target_sources.from_lines(_list_lines(spark, root), SITE)[0]


def url_list_rejects(spark: SparkSession, root: str) -> DataFrame:
    return target_sources.from_lines(_list_lines(spark, root), SITE)[1]


def sitemap_targets(spark: SparkSession, root: str) -> DataFrame:
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("<url><loc> "), escaped, F.lit("\n</loc><priority>1</priority></url>"))
    rows = _urls(spark, root).select(F.col("page_id").alias("ord"), entry.alias("xml"))
    return target_sources.from_sitemap_entries(rows, SITE)


def source_precedence(spark: SparkSession, root: str) -> DataFrame:
    """Hosts with a URL list, else a sitemap, else what their pages link to. Some sitemaps
    have an entry that doesn't close, and some are empty."""
    host = F.lower(urls.host(F.col("url")))
    kind = F.length("site") % 5
    rows = _urls(spark, root).select("page_id", "url", host.alias("site"))
    listed = rows.where(kind == 0).select("site", F.lit(1).alias("source"), F.col("page_id").alias("ord"), "url", F.lit(None).cast("string").alias("fault"))
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    broken = (kind == 1) & (F.col("page_id") % 2 == 0)
    entry = F.concat(F.lit("<url><loc>"), escaped, F.when(broken, "").otherwise("</loc></url>"))
    entries = target_sources.parsed_entries(rows.withColumn("xml", F.when(kind == 2, "<urlset/>").otherwise(entry)).withColumn("ord", F.col("page_id")))
    sitemap = entries.select("site", F.lit(2).alias("source"), "ord", F.when(kind != 2, F.col("url")).alias("url"), F.when(kind != 2, F.col("fault")).alias("fault"))
    edges = links.edges(_pages(spark, root), SITE, "page_id")
    index = edges.select(
        host.alias("site"), F.lit(3).alias("source"), (F.col("page_id") * 1000 + F.col("pos")).alias("ord"), F.col("target").alias("url"),
        F.lit(None).cast("string").alias("fault"),
    )
    chosen = target_sources.by_precedence(listed.unionByName(sitemap).unionByName(index))
    found = chosen.select("site", "source", "ord", _canonical().alias("url"))
    return found.groupBy("site", "source", "url").agg(F.min("ord").alias("ord"))


def index_targets(spark: SparkSession, root: str) -> DataFrame:
    """Every page as an index page of its category, its links moved below it."""
    pages = _pages(spark, root)
    own = urls.category(F.col("url"), SITE.categories)
    moved = F.replace(_with_old_article(F.col("html")), F.lit('href="/'), F.concat(F.lit('href="/'), own, F.lit("/")))
    index = pages.select(own.alias("category"), F.col("page_id").alias("ord"), moved.alias("html"))
    return target_sources.from_index_pages(index, SITE).select("category", "title_guess", "url", "slug")


def robots_allowed(spark: SparkSession, root: str) -> DataFrame:
    rows = _urls(spark, root).select("page_id", _canonical().alias("url"))
    return rows.select(
        "page_id",
        robots.allowed(F.col("url"), robots.rules_for(ROBOTS, BROWSER)).alias("browser"),
        robots.allowed(F.col("url"), robots.rules_for(ROBOTS, "other/1.0")).alias("other"),
    )


def robots_by_host(spark: SparkSession, root: str) -> DataFrame:
    """Every page under the rules of its own host, made from the host's name."""
    rows = _urls(spark, root).select("page_id", _canonical().alias("url"))
    hosts = rows.select(F.lower(urls.host(F.col("url"))).alias("host")).distinct()
    n, kind = (F.length("host") % 10).cast("string"), F.length("host") % 4
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    files = hosts.select(
        "host",
        F.when(kind == 0, say("User-agent: *\nAllow: /en/", n, "5\nDisallow: /en/", n, "\nDisallow: /de\n"))
        .when(kind == 1, say("User-agent: mozilla\nDisallow: /fr/", n, "\nDisallow: /es/\n\nUser-agent: *\nDisallow: /\n"))
        .when(kind == 2, say("User-agent: *\nDisallow:\nDisallow: /\n"))
        .alias("robots"),
    )
    for name, agent in (("browser", BROWSER), ("other", "other/1.0")):
        rows = robots.with_allowed(rows, robots.rules_table(files, agent)).withColumnRenamed("allowed", name)
    return rows.select("page_id", "browser", "other")


def site_categories(spark: SparkSession, root: str) -> DataFrame:
    """Targets of several sites in one job: each host has categories of its own, made from its name."""
    rows = _urls(spark, root).select(F.col("page_id").alias("ord"), "url")
    hosts = rows.select(F.lower(urls.host(F.col("url"))).alias("host")).distinct()
    entry = lambda ord, key, prefix: F.struct(F.lit(ord).alias("ord"), key.alias("key"), prefix.alias("prefix"))
    n = (F.length("host") % 10).cast("string")
    entries = F.array(
        entry(0, F.lit("few"), F.concat(F.lit("/en/"), n, F.lit("/"))),
        entry(1, F.concat(F.lit("main-"), n), F.when(F.col("host").startswith("www."), "/").otherwise("/en/")),
        entry(2, F.lit("late"), F.lit("/en")),
        entry(3, F.lit("de"), F.lit("/de")),
    )
    categories = hosts.select("host", F.inline(entries))
    return targets.build_sites(rows, categories, SITE.base_url)


# ------------------------------------------------------------------- HTML


def _with_old_article(page: Column) -> Column:
    """The page with an older article and a link that are commented out, and a link in a script."""
    old = "<!-- <article><a href='/en/old'>OLD</a></article> --><script>var s = '<a href=\"/en/s\">S</a>';</script>"
    return F.replace(page, F.lit("<nav>"), F.lit(old + "<nav>"))


def _selectable(spark: SparkSession, root: str) -> DataFrame:
    """Pages whose main element differs by category."""
    own = urls.category(F.col("url"), SITE.categories)
    opening = (
        F.when(own == "de", F.lit('<main><div class="x markdown"><div>'))
        .when(own == "fr", F.lit('<section itemprop="articleBody">'))
        .when(own == "es", F.lit("<div>"))
        .otherwise(F.lit("<article>"))
    )
    closing = (
        F.when(own == "de", F.lit("</div></div></main>"))
        .when(own == "fr", F.lit("</section>"))
        .when(own == "es", F.lit("</div>"))
        .otherwise(F.lit("</article>"))
    )
    page = F.replace(F.replace("html", F.lit("<article>"), opening), F.lit("</article>"), closing)
    page = _with_old_article(page)
    return _pages(spark, root).select("page_id", page.alias("html"))


def html_main(spark: SparkSession, root: str) -> DataFrame:
    return _selectable(spark, root).select("page_id", html.main_content(F.col("html")).alias("main"))


def html_denoise(spark: SparkSession, root: str) -> DataFrame:
    """Whole pages, their advertisement marked as a table of contents."""
    page = F.replace("html", F.lit('<div class="ad">'), F.lit('<div class="a table-of-contents"><div>'))
    page = F.replace(page, F.lit("</div><article>"), F.lit("</div></div><aside>b</aside><article>"))
    return _pages(spark, root).select("page_id", html.denoise(page).alias("html"))


def html_decor(spark: SparkSession, root: str) -> DataFrame:
    """Pages with a hash link, a copy button and pictures put in."""
    page = F.replace(
        "html", F.lit("</h1>"), F.lit('<a class="hash-link" href="#t">#</a></h1><button class="copyButton_x">c</button>')
    )
    page = F.replace(page, F.lit("<br>"), F.lit('<br><img src="x"><figure><svg><path/></svg>f</figure>'))
    return _pages(spark, root).select("page_id", html.undecorate(page).alias("html"))


def html_title(spark: SparkSession, root: str) -> DataFrame:
    """Title of the main content, and of the same without a heading: the slug's title."""
    rows = _selectable(spark, root).join(_urls(spark, root), "page_id")
    forms = F.array(F.col("html"), F.replace("html", F.lit("h1>"), F.lit("h2>")))
    rows = rows.select("page_id", "url", F.posexplode(forms).alias("pos", "html"))
    main = rows.withColumn("main", html.denoise(html.main_content(F.col("html"))))
    guess = urls.title_guess(urls.slug(_canonical()))
    return main.select("page_id", "pos", html.page_title(F.col("main"), guess).alias("title"))


def html_text(spark: SparkSession, root: str) -> DataFrame:
    main = html.denoise(html.main_content(_with_old_article(F.col("html"))))
    return _pages(spark, root).select("page_id", html.plain_text(main).alias("text"))


def _with_every_block(page: Column) -> Column:
    """The page with its heading's text again as a quote, code, lists and a table."""
    head = F.regexp_extract(page, "<h1>([^<]*)</h1>", 1)
    parts = (
        "</h1><blockquote><p>", head, "</p></blockquote><pre>", head, "</pre><ol start=3><li>", head, "<li>x</ol><ul><li>",
        head, "</ul><table><tr><th>", head, "<th>h<tr><td>", head, "<td></table><p><code>c ", "d</code> <em>e</em></p>",
    )
    return F.replace(page, F.lit("</h1>"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def html_markdown(spark: SparkSession, root: str) -> DataFrame:
    """The whole chain of a page: selection, cleaning, links, rendering."""
    page = _with_every_block(_with_old_article(F.col("html")))
    pages = _pages(spark, root).select("page_id", _canonical().alias("url"), page.alias("html"), F.lit("").alias("title_guess"))
    return convert.to_markdown(pages, SITE).select("page_id", "title", "markdown")


def md_sanitize(spark: SparkSession, root: str) -> DataFrame:
    """Raw pages, line ends padded, as Markdown full of left-over tags."""
    padded = F.replace("html", F.lit("</p>"), F.lit("</p> \t\n\n\n\n<IMG src=x>"))
    return _pages(spark, root).select("page_id", html.sanitize_markdown(padded).alias("markdown"))


def residual_html(spark: SparkSession, root: str) -> DataFrame:
    """The rendered pages, of which some show a tag as code."""
    shown = F.when(F.col("page_id") % 3 == 0, F.lit("<code>&lt;b&gt;</code></h1>")).otherwise(F.lit("</h1>"))
    page = F.replace("html", F.lit("</h1>"), shown)
    rows = _pages(spark, root).select(F.col("page_id").alias("ord"), "url", page.alias("html"), F.lit("").alias("title_guess"))
    drawn = targets.classify(convert.to_markdown(rows, SITE), SITE)
    return coverage.residual_html(drawn.select("category", "markdown"))


def page_links(spark: SparkSession, root: str) -> DataFrame:
    pages = _pages(spark, root).withColumn("html", _with_old_article(F.col("html")))
    found = links.edges(pages, SITE, "page_id")
    return found.select("page_id", "pos", "href", "target", "title")


def link_rewrite(spark: SparkSession, root: str) -> DataFrame:
    """Page links with every kind of target: own and other categories, with
    fragment, with query, in-page and external."""
    here = urls.category(F.col("url"), SITE.categories)
    page = _with_old_article(F.col("html"))
    for word, target in (
        ("The", F.concat(F.lit("/"), here, F.lit("/the/#top"))),
        ("and", F.lit("../de/9/")),
        ("of", F.concat(F.lit("/"), here, F.lit("/7?x=1"))),
        ("to", F.lit("#top")),
        ("de", F.lit("//fr.example.org/fr/8#a")),
    ):
        page = F.replace(page, F.lit(f'href="/{word}"'), F.concat(F.lit('href="'), target, F.lit('"')))
    pages = _pages(spark, root).select("page_id", _canonical().alias("url"), page.alias("html"))
    return links.rewritten(pages, SITE, "page_id")


def links_moved(spark: SparkSession, root: str) -> DataFrame:
    """Pages that link to the next page and to the first of their hundred; every third page has moved."""
    pages = table(spark, root, "pages")
    to = lambda number, name: _urls(spark, root).select(F.col("page_id").alias(number), F.col("url").alias(name))
    linked = pages.withColumn("after", F.col("page_id") + 1).withColumn("first", F.col("page_id") - F.col("page_id") % 100)
    linked = linked.join(to("after", "after_url"), "after", "left").join(to("first", "first_url"), "first", "left")
    page = F.col("html")
    for word, url in (("The", "after_url"), ("and", "first_url")):
        href = F.replace(F.coalesce(F.col(url), F.lit(f"/{word}")), F.lit("&"), F.lit("&amp;"))
        page = F.replace(page, F.lit(f'href="/{word}"'), F.concat(F.lit('href="'), href, F.lit('"')))
    name = f"pages_{uuid.uuid4().hex}"
    store.save_bucketed(
        linked.select("page_id", _canonical().alias("url"), page.alias("html")), name, INDEX_BUCKETS, "page_id",
        scratch.new_path(spark, "pages"),
    )
    moved = _page_targets(spark, root).where("ord % 3 = 0")
    url_map = moved.select("url", F.concat(F.lit("moved/"), urls.markdown_path(F.col("category"), F.col("slug"))).alias("md_path"))
    return links.relinked(spark.table(name), SITE, url_map, "page_id").select("page_id", "html")


# --------------------------------------------------------------- coverage


def challenge_pages(spark: SparkSession, root: str) -> DataFrame:
    first = F.when(F.col("url").startswith("http:"), F.lit("Just a moment...")).otherwise(F.lit(""))
    second = F.when(F.col("url").contains(".example.org"), F.lit("/challenge-platform/")).otherwise(F.lit(""))
    page = F.concat("html", first, second)
    return _pages(spark, root).select("page_id", html.is_challenge(page).alias("challenge"))


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Pages kept from an earlier run: none (null) if with a query, emptied if with a fragment."""
    body = F.when(F.col("url").contains("?"), None).when(F.col("url").contains("#"), "").otherwise(F.col("html"))
    return table(spark, root, "pages").select("page_id", _canonical().alias("url"), body.alias("html"))


def _fetched(spark: SparkSession, root: str) -> DataFrame:
    """Pages delivered anew: none (null) for one category, challenges from some hosts."""
    blocked = F.concat(F.col("html"), F.lit("Just a moment challenge-platform"))
    body = F.when(F.col("url").contains("/es/"), None).when(F.col("url").contains(".example.net/"), blocked)
    return table(spark, root, "pages").select("page_id", _canonical().alias("url"), body.otherwise(F.col("html")).alias("html"))


def fetch_plan(spark: SparkSession, root: str) -> DataFrame:
    force = F.col("url").contains(".example.org/")
    plan = coverage.fetch_plan(_page_targets(spark, root), _stored(spark, root), force)
    return plan.select("url", "category", "slug", "plan")


def page_status(spark: SparkSession, root: str) -> DataFrame:
    force = F.col("url").contains(".example.org/")
    plan = coverage.fetch_plan(_page_targets(spark, root), _stored(spark, root), force)
    return coverage.page_status(plan, _fetched(spark, root), robots.rules_for(ROBOTS, BROWSER))


def convert_run(spark: SparkSession, root: str) -> DataFrame:
    """The pages that a run over the page table converts; of copies the newest."""
    wanted = _page_targets(spark, root)
    at = F.when(F.length("html") > 0, F.timestamp_seconds("page_id")).alias("fetched_at")
    stored, fetched = (pages(spark, root).select("url", "html", at) for pages in (_stored, _fetched))
    outcome = convert.run(wanted, stored, fetched, SITE, robots.rules_for(ROBOTS, BROWSER))
    return outcome.pages.select("url", "category", "slug", "status", "attempt", "title", "markdown")


def _results(spark: SparkSession, root: str) -> DataFrame:
    return coverage.succeeded(page_status(spark, root))


def missing_pages(spark: SparkSession, root: str) -> DataFrame:
    return coverage.missing(_page_targets(spark, root), _results(spark, root))


def category_summary(spark: SparkSession, root: str) -> DataFrame:
    return coverage.category_summary(_page_targets(spark, root), _results(spark, root))


def url_manifest(spark: SparkSession, root: str) -> DataFrame:
    results = _results(spark, root).withColumn("title", urls.title_guess(F.col("slug")))
    return coverage.manifest(_page_targets(spark, root), results)


def category_merge(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select(
        F.col("lang").alias("category"), F.col("doc_id").alias("ord"), F.col("text").alias("markdown")
    )
    return coverage.merged_volumes(rows, 100)


def category_volumes(spark: SparkSession, root: str) -> DataFrame:
    """Documents of a category in the order of their paths, in volumes of about 100 kB."""
    rows = table(spark, root, "documents")
    path = F.concat(F.reverse(F.col("doc_id").cast("string")), F.lit("/"), "source")
    return coverage.sized_volumes(rows.select(F.col("lang").alias("category"), path.alias("path"), F.col("text").alias("markdown")), 100_000)


def target_order(spark: SparkSession, root: str) -> DataFrame:
    return targets.numbered(_page_targets(spark, root).select("category", "slug", "url"))


def corpus_order(spark: SparkSession, root: str) -> DataFrame:
    """Documents as files in folders whose names differ in a hyphen or a slash."""
    rows = table(spark, root, "documents").select("doc_id", "lang", "source")
    mark = F.when(F.col("doc_id") % 2 == 0, "/").otherwise("-")
    return documents.numbered(rows.select(F.concat(F.col("lang"), F.lit("/"), F.col("source"), mark, "doc_id", F.lit(".md")).alias("path")))


def page_store(spark: SparkSession, root: str) -> DataFrame:
    """The newest pages after three runs, the first two of which were compacted."""
    pages = table(spark, root, "pages")
    kept = store.PageStore(spark, f"store_{uuid.uuid4().hex}", INDEX_BUCKETS, scratch.new_path(spark, "store"), "page_id")
    at = lambda run: pages.withColumn("html", F.concat("html", F.lit(f"<!-- {run} -->")))
    kept.append(at(1).where("page_id % 5 > 0"))
    kept.append(at(2).where("page_id % 3 = 0"))
    kept.compact()
    kept.append(at(3).where("page_id % 7 = 0"))
    return kept.newest()


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        corpus_load, corpus_scan, path_identity, doc_catalog, doc_title, doc_description, tokens, term_frequency, doc_norms,
        search_topk, search_batch, search_empty, search_validate, search_response, open_doc,
        search_stored_topk, search_stored_batch, search_sql,
        url_canonical, url_category, url_slug, slug_title, url_dedupe, url_dedupe_last, url_list_targets,
        url_list_rejects, sitemap_targets, index_targets, source_precedence, robots_allowed, robots_by_host, site_categories,
        html_main, html_denoise, html_decor, html_title, html_text, html_markdown, md_sanitize, residual_html,
        page_links, link_rewrite, links_moved,
        challenge_pages, fetch_plan, page_status, missing_pages, category_summary, url_manifest, convert_run,
        category_merge, category_volumes, target_order, corpus_order, page_store,
    )
    return {query.__name__: query for query in found}
