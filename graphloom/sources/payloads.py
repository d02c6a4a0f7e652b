"""Saved API pages as content items: each body is a VARIANT, projected by its kind; what lacks a title or a link is rejected with the reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Get = Callable[..., Column]


def _iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_millis((seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _or(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _repository(g: Get, name: str, stars: str, forks: str, topics: Column | None) -> Column:
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    n = lambda p: F.coalesce(g(p, "long"), F.lit(0)).cast("string")
    counts = F.concat(F.lit("Stars: "), n(stars), F.lit(" | Forks: "), n(forks))
    return F.concat_ws("\n", F.concat(F.lit("Repository: "), g(name)), line("Description", g("$.description")), counts, line("Language", g("$.language")), *([line("Topics", topics)] if topics is not None else []), line("Last push", g("$.pushed_at")))


def _starred(g: Get, name: str, stars: str) -> Column:
    return F.concat(g(name), F.lit(" ("), F.coalesce(g(stars, "long"), F.lit(0)).cast("string"), F.lit(" stars)"))


#: Where a kind's list stands in its body, the first that is there.
LISTS = {
    "hn_algolia": ["$.hits"], "reddit": ["$.data.children"], "devto": ["$"], "github_releases": ["$"], "npm_trending": ["$.objects"], "github_trending": ["$.items"], "oss_insight": ["$.data.rows", "$.rows"],
    "ecosystems_timeline": ["$"], "twitter_search": ["$.items"],
}


def _fields(kind: str, g: Get) -> tuple[Column, Column, Column, Column, Column, dict[str, Column]]:
    """Link, title, text, time, author and further fields of an entry."""
    none = F.lit(None).cast("string")
    if kind == "hn_algolia":
        title = F.coalesce(g("$.title"), g("$.story_title"))
        link = F.when(_or(g("$.url")).isNotNull(), F.concat(F.lit("https://news.ycombinator.com/item?id="), g("$.objectID")))
        return link, title, F.coalesce(g("$.story_text"), title), g("$.created_at"), g("$.author"), {"target_url": g("$.url"), "hn_id": g("$.objectID")}
    if kind == "reddit":
        p = lambda f, *t: g(f"$.data.{f}", *t)
        link = F.when(_or(p("permalink")).isNotNull(), F.concat(F.lit("https://www.reddit.com"), p("permalink")))
        time = F.when(p("created_utc", "double") != 0, _iso(p("created_utc", "double")))
        return link, p("title"), _or(p("selftext"), p("title")), time, p("author"), {"subreddit": p("subreddit"), "target_url": p("url"), "reddit_id": p("id")}
    if kind == "devto":
        return g("$.url"), g("$.title"), _or(g("$.description"), g("$.title")), g("$.published_at"), g("$.user.username"), {"devto_id": g("$.id"), "tags": g("$.tags"), "reactions": g("$.positive_reactions_count")}
    if kind == "github_releases":
        title = _or(g("$.name"), g("$.tag_name"))
        return g("$.html_url"), title, _or(g("$.body"), title), g("$.published_at"), g("$.author.login"), {"tag_name": g("$.tag_name"), "release_id": g("$.id"), "draft": g("$.draft"), "prerelease": g("$.prerelease")}
    if kind == "npm_trending":
        p = lambda f: g(f"$.package.{f}")
        link = F.coalesce(p("links.npm"), F.concat(F.lit("https://www.npmjs.com/package/"), p("name")))
        return link, p("name"), F.coalesce(p("description"), p("name")), p("date"), p("publisher.username"), {"version": p("version"), "keywords": p("keywords"), "homepage": p("links.homepage"), "repository": p("links.repository"), "score": g("$.score.final")}
    if kind == "github_trending":
        topics = F.array_join(g("$.topics", "array<string>"), ", ")
        link = F.coalesce(g("$.html_url"), F.concat(F.lit("https://github.com/"), g("$.full_name")))
        title = F.when(_or(g("$.full_name")).isNotNull(), _starred(g, "$.full_name", "$.stargazers_count"))
        return link, title, _repository(g, "$.full_name", "$.stargazers_count", "$.forks_count", topics), g("$.created_at"), none, {"stars": g("$.stargazers_count"), "forks": g("$.forks_count"), "language": g("$.language"), "topics": g("$.topics")}
    if kind == "oss_insight":
        title = F.when(_or(g("$.repo_name")).isNotNull(), _starred(g, "$.repo_name", "$.stars"))
        return F.concat(F.lit("https://github.com/"), g("$.repo_name")), title, _repository(g, "$.repo_name", "$.stars", "$.forks", None), g("$.pushed_at"), none, {"stars": g("$.stars"), "forks": g("$.forks"), "language": g("$.language")}
    if kind == "ecosystems_timeline":
        return g("$.url"), g("$.title"), _or(g("$.body"), g("$.title")), g("$.created_at"), none, {"event_type": g("$.event_type"), "repository": g("$.repository.full_name"), "event_id": g("$.id")}
    text = g("$.text")
    link = F.when(_or(g("$.id")).isNotNull(), F.coalesce(g("$.url"), F.concat(F.lit("https://x.com/i/status/"), g("$.id"))))
    return link, F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 97), F.lit("..."))).otherwise(text), text, g("$.created_at"), g("$.author_username"), {"tweet_id": g("$.id")}


def project_api_payload(pages: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """pages(page, kind, body: JSON text) -> items(page, position, kind, source_uri, title, text, published_at, author, metadata) and rejects(page, position, kind, reason).

    The first `most` items of a page are kept. Bodies that are no JSON, or hold no list where their kind has it, and kinds that are not known are
    rejected whole (position null). Times stay as given, ISO text; metadata holds what else is there, as text.
    """
    v = pages.select("page", "kind", F.try_parse_json("body").alias("v"))
    bad = v.filter(~F.coalesce(F.col("kind").isin(list(LISTS)), F.lit(False))).select("page", F.lit(None).cast("int").alias("position"), "kind", F.lit("unknown_kind").alias("reason"))
    items, rejects = None, bad
    for kind, paths in LISTS.items():
        entries = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in paths])
        one = v.filter(F.col("kind") == kind).withColumn("entries", entries)
        none = one.filter("entries is null").select("page", F.lit(None).cast("int").alias("position"), "kind", F.lit("no_list").alias("reason"))
        x = one.select("page", "kind", F.posexplode("entries").alias("position", "x"))
        link, title, text, time, author, more = _fields(kind, lambda path, kind_="string": F.try_variant_get("x", path, kind_))
        blank = lambda c: F.coalesce(c, F.lit("")) == ""
        extra = F.map_filter(F.create_map(*[y for n, c in more.items() for y in (F.lit(n), c)]), lambda _, c: c.isNotNull())
        x = x.select("page", "position", "kind", link.alias("source_uri"), title.alias("title"), text.alias("text"), time.alias("published_at"), author.alias("author"), extra.alias("metadata"))
        x = x.withColumn("reason", F.when(blank(F.col("title")), "no_title").when(blank(F.col("source_uri")), "no_link"))
        rejects = rejects.unionByName(none).unionByName(x.filter("reason is not null").select("page", "position", "kind", "reason"))
        good = x.filter("reason is null").drop("reason")
        items = good if items is None else items.unionByName(good)
    if most is not None:
        w = Window.partitionBy("page").orderBy("position")
        items = items.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= most).drop("n_")
    return items, rejects
