"""Breadth-first crawl over a table of pages: one round of DataFrame work for each depth.

A round takes pages from the frontier in order, up to the page budget; filters skip pages without using the budget. Links
are followed to the depth budget, to allowed origins only: the root's, and of every page fetched so far, in crawl order.
A link is seen when it is first put on the frontier. What a round hands on is bounded by the page budget, links by what
its pages hold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import origin_of, resolve
from ..staging import staged

MAX_DEPTH, MAX_PAGES = 2, 50
#: Why a page fails that isn't there.
MISSING = "not among the pages"


@dataclass
class Crawl:
    """events: in crawl order. fetched: url, order of the pages that were read."""

    events: DataFrame
    fetched: DataFrame

    def summary(self) -> DataFrame:
        """One row of counters."""
        count = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("long")), F.lit(0)).alias(kinds[0] if len(kinds) == 1 else "visited")
        return self.events.agg(count("indexed", "unchanged", "failed"), *(count(k) for k in ("indexed", "unchanged", "failed", "skipped")))


def crawl(
    spark: SparkSession, pages: DataFrame | Callable[[DataFrame], DataFrame], root: str, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES,
    same_origin: bool = True, include: str | None = None, exclude: str | None = None, known: DataFrame | None = None,
) -> Crawl:
    """pages: url, final_url, links, and error of pages that can't be indexed (fetched, if there, tells which of these were
    read all the same: their origins count); or what reads these for a round's url, ord.

    known: urls whose content is stored already and unchanged. A round writes two tables to the shared folder, what came of its
    pages and the next frontier; what was seen, allowed origins and events are read from all rounds'.
    """
    start = resolve(root, root)
    if start is None:
        raise ValueError(f"a crawl can't begin at {root}")
    read = pages
    if isinstance(pages, DataFrame):
        read = lambda taken: pages.join(F.broadcast(taken.select("url")), "url", "left_semi")  # noqa: E731  as many as the budget at most
    frontier = spark.createDataFrame([(start, 0)], "url string, ord long")
    same = None if known is None else known.select("url").distinct().withColumn("same", F.lit(True))
    reason = F.lit(None).cast("string")
    if exclude is not None:
        reason = F.when(F.col("url").rlike(exclude), "exclude filter").otherwise(reason)
    if include is not None:
        reason = F.when(~F.col("url").rlike(include), "include filter").otherwise(reason)
    left, after, frontiers, rounds, events = max_pages, 0, [], [], []
    for depth in range(max_depth + 1):
        frontiers.append(frontier)
        rows = frontier.withColumn("reason", reason)
        taken = rows.where("reason is null").orderBy("ord").limit(left).select("url", "ord")
        n, last = taken.agg(F.count(F.lit(1)), F.max("ord")).first()
        skipped = rows.where("reason is not null")
        if n == left:  # the budget ends with the last page, and what stands behind it is never looked at
            skipped = skipped.where(F.col("ord") < last)
        found = read(taken)
        if "fetched" not in found.columns:
            found = found.withColumn("fetched", F.col("error").isNull())
        at = taken.alias("t").join(found.alias("p"), F.col("t.url") == F.col("p.url"), "left")
        error = F.when(F.col("p.url").isNull(), MISSING).otherwise(F.col("p.error"))
        got = at.select(F.col("t.url").alias("url"), F.col("t.ord").alias("ord"), F.coalesce("p.fetched", F.lit(False)).alias("read"), F.coalesce("p.final_url", "t.url").alias("final_url"), F.col("p.links").alias("links"), error.alias("error"))
        got = staged(got.withColumn("same", F.lit(False)) if same is None else got.join(same, "url", "left"))
        rounds.append(got)
        kind = F.when(F.col("error").isNotNull(), "failed").when(F.col("same"), "unchanged").otherwise("indexed")
        none = F.lit(None).cast("string")
        for told in (got.select("ord", kind.alias("kind"), "url", "error", none.alias("reason")), skipped.select("ord", F.lit("skipped").alias("kind"), "url", none.alias("error"), "reason")):
            events.append(told.select("ord", "kind", "url", F.lit(depth).alias("depth"), F.lit(None).cast("long").alias("doc_id"), "error", "reason"))
        left -= n
        if depth == max_depth or left <= 0:
            break
        links = got.where("error is null").select("ord", F.posexplode("links").alias("place", "link"))
        if same_origin:
            # As many rows as pages were fetched so far, so as the budget at most.
            fetched = _all(rounds).where("read").groupBy(origin_of("final_url").alias("origin")).agg(F.min("ord").alias("since"))
            origins = fetched.unionByName(spark.createDataFrame([(start, -1)], "url string, since long").select(origin_of("url").alias("origin"), "since"))
            links = links.join(origins, (origin_of("link") == F.col("origin")) & (F.col("since") <= F.col("ord")), "left_semi")
        seen = _all([f.select("url") for f in frontiers])
        new = links.join(seen, links.link == seen.url, "left_anti").groupBy(F.col("link").alias("url")).agg(F.min(F.struct("ord", "place")).alias("first"))
        # Only links of this round's pages are ranked, which are as many as the budget at most; the order goes on from the old.
        frontier = staged(new.select("url", (F.row_number().over(Window.orderBy("first")) + F.lit(after)).cast("long").alias("ord")))
        count = frontier.count()
        if not count:
            break
        after += count
    return Crawl(_all(events).orderBy("ord"), _all(rounds).where("error is null").select("url", "ord").orderBy("ord"))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
