"""What was expected, what was converted, what is missing and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import html, text
from folioscope.functions.urls import markdown_path
from folioscope.operators import robots
from folioscope.operators.order import with_sum_before

# Page outcomes, and attempts per page.
OK_CACHE, OK_FETCH, SKIP_ROBOTS, RETRY, FAIL = "OK CACHE", "OK FETCH", "SKIP ROBOTS", "RETRY", "FAIL"
ATTEMPTS = 3


def readable(markup: Column) -> Column:
    """A page that can be parsed: present and not blank."""
    return F.coalesce(text.trim(markup) != "", F.lit(False))


def page_flags(pages: DataFrame, prefix: str, answered: bool = False) -> DataFrame:
    """(url, ``prefix``_present, ``prefix``_ok, ``prefix``_digest, ``prefix``_copies) of the copy
    that counts, for each URL of stored or fetched pages.

    That is the newest by ``fetched_at``, if there is such a column; of copies
    as new, one that can be used. ``digest`` finds its body again and ``copies``
    is how often it is there. Bodies are read where they lie; only flags are
    shuffled. Only an ``answered`` page, one that was fetched, can be a
    challenge; then copies that are no document don't count. An ``ok`` column
    in the input, if there is one, overrides the parse check.
    """
    ok = F.col("ok") if "ok" in pages.columns else readable(F.col("html"))
    at = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    flags = pages.select(
        "url",
        at.alias("at"),
        (F.coalesce(F.length("html"), F.lit(0)) > 0).alias("present"),
        F.coalesce(ok & ~html.is_challenge(F.col("html")) if answered else ok, F.lit(False)).alias("ok"),
        F.xxhash64("html").alias("digest"),
    )
    order = ("ok", "at", "present") if answered else ("at", "ok", "present")
    bodies = flags.groupBy("url", "digest").agg(
        F.max("at").alias("at"), F.max("present").alias("present"), F.max("ok").alias("ok"), F.count("*").alias("copies")
    )
    newest = bodies.groupBy("url").agg(F.max(F.struct(*order, "digest", "copies")).alias("copy"))
    return newest.select("url", *[F.col(f"copy.{c}").alias(f"{prefix}_{c}") for c in ("present", "ok", "digest", "copies")])


def fetch_plan(targets: DataFrame, stored: DataFrame, force: Column | bool = False) -> DataFrame:
    """(url, category, slug, plan, stored_ok, stored_digest, stored_copies): reuse the stored page or fetch.

    A stored page is reused if it is non-empty and not forced; ``force`` may be
    a column of ``targets``.
    """
    forced = force if isinstance(force, Column) else F.lit(force)
    joined = targets.join(page_flags(stored, "stored"), "url", "left")
    present = F.coalesce(F.col("stored_present"), F.lit(False))
    return joined.select(
        "url",
        "category",
        "slug",
        F.when(present & ~forced, "CACHE").otherwise("FETCH").alias("plan"),
        F.coalesce("stored_ok", F.lit(False)).alias("stored_ok"),
        "stored_digest",
        "stored_copies",
    )


def to_fetch(plan: DataFrame) -> DataFrame:
    """Targets that need the network: no usable stored page, or one that fails."""
    return plan.filter((F.col("plan") == "FETCH") | ~F.col("stored_ok")).select("url", "category", "slug")


def decide(plan: DataFrame, fetched: DataFrame, rules: robots.Rules) -> DataFrame:
    """``plan`` with ``status``, ``attempt``, and the flags of the fetched pages.

    A stored page that fails is retried from the fetched pages; a URL the robots
    file forbids is never tried. ``attempt`` is the one that decided: a failure
    takes all of them. ``rules`` are those of one site, or a table of many.
    """
    tried = robots.with_allowed(plan, rules).join(page_flags(fetched, "fetched", answered=True), "url", "left")
    status = (
        F.when(~F.col("allowed"), SKIP_ROBOTS)
        .when((F.col("plan") == "CACHE") & F.col("stored_ok"), OK_CACHE)
        .when(F.coalesce(F.col("fetched_ok"), F.lit(False)), OK_FETCH)
        .otherwise(FAIL)
    )
    return tried.withColumn("status", status).withColumn("attempt", _attempt())


def _attempt() -> Column:
    return (
        F.when(F.col("status") == SKIP_ROBOTS, 0)
        .when(F.col("status") == FAIL, ATTEMPTS)
        .when((F.col("status") == OK_FETCH) & (F.col("plan") == "CACHE"), 2)
        .otherwise(1)
    )


def page_status(plan: DataFrame, fetched: DataFrame, rules: robots.Rules) -> DataFrame:
    """(url, category, slug, status, attempt) of each target."""
    return decide(plan, fetched, rules).select("url", "category", "slug", "status", "attempt")


def retried(decided: DataFrame, pages: DataFrame) -> DataFrame:
    """Decisions anew for stored pages that failed to render: the fetched page,
    if there is a usable one."""
    failed = pages.filter(F.col("render_error").isNotNull()).select("url")
    again = decided.filter((F.col("status") == OK_CACHE) & F.col("fetched_ok")).join(failed, "url", "left_semi")
    return again.withColumn("status", F.lit(OK_FETCH)).withColumn("attempt", F.lit(2))


def attempts(status: DataFrame) -> DataFrame:
    """A line per attempt: (url, category, slug, status, attempt, error); those
    before the one that decided are RETRY."""
    numbers = F.sequence(F.least(F.lit(1), F.col("attempt")), F.col("attempt"))
    lines = status.withColumn("at", F.explode(numbers))
    last = F.col("at") == F.col("attempt")
    return lines.select(
        "url", "category", "slug", F.when(last, F.col("status")).otherwise(RETRY).alias("status"),
        F.col("at").alias("attempt"), F.when(last, F.col("error")).alias("error"),
    )


def with_errors(decided: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, category, slug, status, attempt, error) after rendering.

    ``pages`` has the last outcome of each page. One with an error has failed,
    after all attempts; a stored one that was converted from its fetched page
    took two.
    """
    done = pages.select("url", F.col("render_error").alias("error"), F.col("status").alias("final"))
    joined = decided.join(done, "url", "left")
    status = F.when(F.col("error").isNotNull(), FAIL).otherwise(F.coalesce("final", "status"))
    out = joined.withColumn("status", status).withColumn("attempt", _attempt())
    return out.select("url", "category", "slug", "status", "attempt", "error")


def failures(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status") == FAIL)


def succeeded(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status").isin(OK_CACHE, OK_FETCH))


def missing(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Expected items without a result."""
    return expected.join(results.select("url"), "url", "left_anti").select("url", "category", "slug")


def category_summary(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(category, expected, succeeded), a row per category and one for all, with a null category."""
    tagged = expected.select("category", F.lit(1).alias("e"), F.lit(0).alias("s")).unionByName(
        results.select("category", F.lit(0).alias("e"), F.lit(1).alias("s"))
    )
    return (
        tagged.rollup("category")
        .agg(F.sum("e").alias("expected"), F.sum("s").alias("succeeded"))
        .orderBy("category")
    )


def result_items(results: DataFrame, *keep: str) -> DataFrame:
    """Result rows with their three relative paths."""
    page = F.concat_ws("/", "category", "slug")
    return results.select(
        *keep,
        "url",
        "category",
        "title",
        "slug",
        F.concat(F.lit("raw_html/"), page, F.lit(".html")).alias("raw_html"),
        F.concat(F.lit("cleaned_html/"), page, F.lit(".html")).alias("cleaned_html"),
        F.concat(F.lit("md/"), markdown_path(F.col("category"), F.col("slug"))).alias("markdown"),
    )


def manifest(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(section, item): the three manifest lists as JSON rows.

    One join tells which expected items have a result, and each gives its two
    rows. The lists grow with the corpus, so they stay rows; nothing gathers
    them into one value.
    """
    done = results.select("url", "title", F.lit(True).alias("done"))
    items = result_items(expected.select("url", "category", "slug").join(done, "url", "left"), "done")
    plain = F.to_json(F.struct("url", "category", "slug"))
    full = F.to_json(F.struct("url", "category", "title", "slug", "raw_html", "cleaned_html", "markdown"))
    entry = lambda section, item: F.struct(section.alias("section"), item.alias("item"))
    return items.select(
        F.inline_outer(
            F.array(
                entry(F.lit("expected_items"), plain),
                F.when(F.col("done"), entry(F.lit("items"), full)).otherwise(entry(F.lit("missing_items"), plain)),
            )
        )
    )


def residual_html(documents: DataFrame) -> DataFrame:
    """(category, documents, with_tags): Markdown that still holds a tag."""
    return documents.groupBy("category").agg(
        F.count("*").alias("documents"),
        F.count_if(html.has_residual_html(F.col("markdown"))).alias("with_tags"),
    )


def merged_volumes(documents: DataFrame, per_volume: int, ord: str = "ord") -> DataFrame:
    """(category, volume, documents, markdown): documents of a category joined
    in order, in volumes of ``per_volume`` consecutive ordinals.

    A whole category has no bound, so it becomes a series of volumes, each
    small enough for one task; reading them in order gives the whole.
    """
    volume = F.floor(F.col(ord) / per_volume).cast("bigint")
    gathered = documents.groupBy("category", volume.alias("volume")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(ord).alias("ord"), "markdown"))).alias("part")
    )
    return gathered.select(
        "category",
        "volume",
        F.size("part").cast("bigint").alias("documents"),
        F.array_join(F.transform("part", lambda p: p.markdown), "\n\n").alias("markdown"),
    )


def sized_volumes(documents: DataFrame, target_bytes: int, key: str = "path") -> DataFrame:
    """(category, volume, documents, markdown): documents of a category joined
    in the order of ``key``, which may be anything, in volumes of about
    ``target_bytes``.

    A document goes to the volume in which its first byte falls, so a volume
    holds that much and what its last document has beyond. Volumes follow from
    sums over keys and sizes; bodies move once, to their volume.
    """
    sizes = documents.select("category", key, F.coalesce(F.octet_length("markdown"), F.lit(0)).cast("long").alias("size"))
    placed = with_sum_before(sizes, "category", key, size="size")
    volumes = placed.select("category", key, F.floor(F.col("before") / target_bytes).cast("bigint").alias("volume"))
    dealt = documents.select("category", key, "markdown").join(volumes, ["category", key])
    gathered = dealt.groupBy("category", "volume").agg(
        F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.coalesce("markdown", F.lit("")).alias("markdown")))).alias("part")
    )
    return gathered.select(
        "category",
        "volume",
        F.size("part").cast("bigint").alias("documents"),
        F.array_join(F.transform("part", lambda p: p.markdown), "\n\n").alias("markdown"),
    )
