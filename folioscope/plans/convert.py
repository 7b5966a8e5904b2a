"""Pages to Markdown: the per-page chain and a full run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import html
from folioscope.functions.urls import Site
from folioscope.operators import coverage, render, robots
from folioscope.sinks import scratch
from folioscope.sinks import tables as sinks
from folioscope.sinks.store import PageStore

#: Pages as one table, or as tables that have each page once together, such as ``PageStore.parts``.
Pages = DataFrame | Sequence[DataFrame]


def clean(pages: DataFrame, site: Site) -> DataFrame:
    """(url, html, title_guess, ...) to the same rows with ``cleaned_html`` and
    ``title`` instead. One narrow stage: each step only reads its own row."""
    rest = [c for c in pages.columns if c not in ("html", "title_guess")]
    main = pages.withColumn("main", html.main_content(F.col("html")))
    bare = main.withColumn("main", html.undecorate(html.denoise(F.col("main"))))
    linked = bare.withColumn("cleaned_html", html.rewrite_links(F.col("main"), F.col("url"), site))
    return linked.select(
        *rest, html.page_title(F.col("cleaned_html"), F.col("title_guess")).alias("title"), "cleaned_html"
    )


def to_markdown(pages: DataFrame, site: Site) -> DataFrame:
    """Cleaned pages with ``markdown``; unrenderable pages carry an error."""
    return render.render(clean(pages, site))


@dataclass(frozen=True)
class Run:
    """A conversion run: what was decided, and the pages as lazy tables.

    ``decided`` has a row per target, with its status before rendering.
    ``pages`` holds every page that was converted, with ``render_error`` where
    rendering failed; ``retry`` gives the fetched pages for stored ones that
    did. ``to_fetch`` is the work list for a crawler.
    """

    expected: DataFrame
    decided: DataFrame
    pages: DataFrame
    to_fetch: DataFrame
    retry: Callable[[DataFrame], DataFrame]
    taken: Callable[[DataFrame], DataFrame]


def run(
    targets: DataFrame,
    stored: Pages,
    fetched: Pages,
    site: Site,
    rules: robots.Rules,
    force: bool = False,
) -> Run:
    """Convert every target that has a usable page.

    ``stored`` pages are reused, ``fetched`` ones (delivered by a crawler from
    an earlier run's ``to_fetch``) fill the gaps; both are (url, html), and may
    have ``fetched_at``. ``rules`` are the robots rules of one site, or a table
    of many sites' (``robots.rules_table``). Each page table is read once for its flags, on which
    the outcome is decided and stored, and once for the bodies that won. Tables
    bucketed by URL are asked for those where they lie.
    """
    plan = coverage.fetch_plan(targets, _together(stored), force)
    decided = coverage.decide(plan, _together(fetched), rules).join(targets.select("url", "title_guess"), "url")
    decided = scratch.stored(decided, "decided")
    wanted = coverage.to_fetch(decided.filter("allowed"))

    def taken(decisions: DataFrame) -> DataFrame:
        return _bodies(stored, decisions, coverage.OK_CACHE, "stored").unionByName(
            _bodies(fetched, decisions, coverage.OK_FETCH, "fetched")
        )

    def converted(decisions: DataFrame) -> DataFrame:
        return to_markdown(taken(decisions), site)

    def retry(pages: DataFrame) -> DataFrame:
        return converted(scratch.stored(coverage.retried(decided, pages), "retried"))

    return Run(targets, decided, converted(decided), wanted, retry, taken)


def _parts(pages: Pages) -> list[DataFrame]:
    return [pages] if isinstance(pages, DataFrame) else list(pages)


def _together(pages: Pages) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _parts(pages))


def _bodies(pages: Pages, decided: DataFrame, outcome: str, kind: str) -> DataFrame:
    """The page each target with this outcome reads. Bodies that are there
    once, as they should be, are not merged; they move only if the decisions
    are too many to be sent to them and the pages are not bucketed by URL."""
    good = decided.filter(F.col("status") == outcome).select(
        "url", "category", "slug", "status", "attempt", "title_guess",
        F.col(f"{kind}_digest").alias("digest"), F.col(f"{kind}_copies").alias("copies"),
    )

    def found(part: DataFrame) -> DataFrame:
        at = F.col("fetched_at") if "fetched_at" in part.columns else F.lit(None).cast("timestamp")
        # By URL alone, which the buckets know; the digest tells copies apart. As an equality it would join the keys.
        same = F.xxhash64("html").bitwiseXOR(F.col("digest")) == 0
        return part.select("url", "html", at.alias("fetched_at")).join(good, "url").filter(same)

    # Each part by itself: a union would lose the buckets.
    both = reduce(DataFrame.unionByName, map(found, _parts(pages)))
    single = both.filter(F.col("copies") == 1)
    merged = both.filter(F.col("copies") > 1).dropDuplicates(["url"])
    return single.unionByName(merged).drop("digest", "copies")


def publish(outcome: Run, path: str, output_root: str, raw_store: PageStore | None = None) -> None:
    """Write the raw pages, the converted ones, then the reports from those.

    Raw pages go to ``raw_store``, if there is one, whose ``parts`` the next run
    takes as its stored pages; else to files by run.

    Conversion runs once, and once more for stored pages that failed to render
    and have a fetched page; status, manifest and summary read the written
    table instead of repeating it. Earlier runs' pages stay: ``sinks.read_pages``
    and ``sinks.read_raw`` give the newest of each.
    """
    spark = outcome.pages.sparkSession
    run_id = sinks.new_run()
    first = scratch.stored(outcome.pages, "converted")
    again = scratch.stored(outcome.retry(first), "again")
    pages = again.unionByName(first.join(again.select("url"), "url", "left_anti"))
    raw = outcome.taken(outcome.decided.filter(F.col("status") == coverage.OK_FETCH))
    raw = raw.unionByName(outcome.taken(coverage.retried(outcome.decided, first)))
    if raw_store:
        raw_store.append(sinks.raw_rows(raw))
    else:
        sinks.write_raw(raw, f"{path}/raw", run_id)
    sinks.write_pages(pages, f"{path}/pages", run_id)
    pages = spark.read.parquet(f"{path}/pages/run={run_id}") if not pages.isEmpty() else pages
    status = scratch.stored(coverage.with_errors(outcome.decided, pages), "status")
    sinks.write_status(coverage.attempts(status), f"{path}/status")
    results = pages.filter(F.col("render_error").isNull())
    sinks.write_manifest(outcome.expected, results, f"{path}/manifest", output_root)
    # A stored page that failed and has no fetched one needs the network too.
    failed = status.filter(F.col("error").isNotNull()).select("url", "category", "slug")
    outcome.to_fetch.unionByName(failed).distinct().write.mode("overwrite").parquet(f"{path}/to_fetch")
    coverage.category_summary(outcome.expected, results).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
