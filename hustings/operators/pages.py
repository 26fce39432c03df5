"""Stored pages: text, cards, links, assembled documents."""

from pyspark.sql import DataFrame, Window, functions as F

from hustings import vocab
from hustings.functions import web
from hustings.functions.text import collapse_spaces, trim_spaces


def card_explode(pages: DataFrame, site: str, key: str = "page_id") -> DataFrame:
    """Every profile card of every index page; of equal slugs the first stays."""
    figures = pages.select(key, F.posexplode(web.figures(F.col("html"))).alias("pos", "figure"))
    cards = figures.select(key, "pos", web.card(F.col("figure"), site).alias("card")).where(
        "card.slug IS NOT NULL"
    )
    first = cards.groupBy(key, F.col("card.slug").alias("slug")).agg(
        F.min("pos").alias("pos"), F.min_by("card", "pos").alias("card")
    )
    return first.select(
        key,
        "pos",
        "slug",
        *[
            f"card.{c}"
            for c in ("profile_url", "full_name", "photo_url", "role", "constituency", "party")
        ],
    )


def internal_links(
    pages: DataFrame,
    key: str = "page_id",
    cap: int = vocab.MAX_LINKS,
    text_size: int = vocab.MAX_LINK_TEXT,
) -> DataFrame:
    """Links of each page to its own site: (key, position, text, url), at most `cap`.

    A page is one row: its links are cut, resolved, compared and capped inside the
    row, so nothing is shuffled.
    """
    anchor = r"""(?isU)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
    html, url = F.col("html"), F.col("url")
    found = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(anchor), F.lit(2)).alias("inner"),
    )
    offered = F.filter(
        F.transform(
            found,
            lambda a: F.struct(trim_spaces(a["href"]).alias("href"), a["inner"].alias("inner")),
        ),
        lambda a: (a["href"] != "") & ~a["href"].rlike("^(#|mailto:|tel:|javascript:)"),
    )
    # Entities are decoded once a page: the texts are joined for it and cut again.
    joined = F.array_join(
        F.transform(F.col("offered.inner"), lambda t: F.regexp_replace(t, "<[^>]+>", " ")), "\x02"
    )
    staged = (
        pages.select(key, "url", offered.alias("offered"))
        .where(F.size("offered") > 0)
        .select(
            key,
            "url",
            F.transform("offered.href", lambda h: web.resolve(F.col("url"), h)).alias("targets"),
            F.split(web.unescape(joined), "\x02").alias("texts"),
        )
    )
    links = F.transform(
        F.arrays_zip("targets", "texts"),
        lambda a: F.struct(
            F.substring(collapse_spaces(a["texts"]), 1, text_size).alias("text"),
            a["targets"].alias("url"),
        ),
    )
    own = F.filter(
        links,
        lambda a: (a["text"] != "")
        & (a["url"] != F.col("url"))
        & a["url"].rlike("(?i)^https?://")
        & web.same_site(web.host_of(a["url"]), web.host_of(F.col("url"))),
    )
    # The first `cap` different addresses, then the first link of each: a page may have any
    # number of links, and only the kept ones are looked up.
    fresh = F.transform(
        F.slice(F.array_distinct("own.url"), 1, cap),
        lambda u: F.element_at("own", F.array_position(F.col("own.url"), u).cast("int")),
    )
    return (
        staged.select(key, own.alias("own"))
        .select(key, F.posexplode(fresh).alias("position", "link"))
        .select(key, (F.col("position") + 1).alias("position"), "link.text", "link.url")
    )


def chapter_links(
    links: DataFrame,
    key: str = "page_id",
    skip=("/manifesto",),
    skip_folders=("/pages/", "/documents/"),
) -> DataFrame:
    """Links to chapter pages: a capital or a space after the first slash of the path.

    Of equal paths on a page the first stays.
    """
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    name = F.substr(path, F.lit(2))
    chosen = (
        ~path.isin("", "/")
        & ~F.lower(path).isin(list(skip))
        & ~F.lower(path).rlike("^(" + "|".join(skip_folders) + ")")
        & (F.contains(name, F.lit(" ")) | F.contains(name, F.lit("%20")) | name.rlike(r"\p{Lu}"))
    )
    first = F.min_by(F.struct("position", "text", "url"), "position").alias("first")
    return (
        links.where(chosen)
        .groupBy(key, path.alias("path"))
        .agg(first)
        .select(key, "first.position", "first.text", "first.url", "path")
    )


def chapter_text(title, body, nav_pattern: str | None = None):
    """`## title`, a blank line, and the body without navigation and repeated title."""
    clean = trim_spaces(F.regexp_replace(body, nav_pattern, "") if nav_pattern else body)
    repeated = F.startswith(F.lower(clean), F.lower(title))
    rest = F.regexp_replace(F.substr(clean, F.length(title) + 1), r"^[ /\n]+", "")
    return F.concat(F.lit("## "), title, F.lit("\n\n"), F.when(repeated, rest).otherwise(clean))


def page_heading(url):
    """The last segment of an address's path; the address itself if there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_replace(F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1), ";.*$", "")
    return F.coalesce(F.nullif(last, F.lit("")), url)


def merged_links(links: DataFrame, key: str, cap: int = vocab.MAX_LINKS) -> DataFrame:
    """Links (key, page, position, url, text) of several pages as one list: the first of each url, at most `cap`."""
    first = F.min_by(F.struct("page", "position", "text"), F.struct("page", "position")).alias("first")
    once = links.groupBy(key, "url").agg(first).select(key, "url", "first.*")
    place = F.row_number().over(Window.partitionBy(key).orderBy("page", "position"))
    return once.withColumn("place", place).where(F.col("place") <= cap)


def linked_pages(pages: DataFrame, links: DataFrame, key: str = "page_id") -> DataFrame:
    """The stored pages behind the links of each index: (key, page, linked_id, url, html), `page` the link's place.

    `pages` (page_id, url, html) and `links` (key, position, url), as `internal_links` returns
    them. Addresses are compared without their fragment. Of pages stored under one address the smallest
    page_id counts; of links of one index to one page the first. Addresses and ids are joined
    first, so only linked pages carry their html through a shuffle.
    """
    address = F.regexp_replace("url", "#.*$", "").alias("address")
    stored = pages.groupBy(address).agg(F.min("page_id").alias("linked_id"))
    found = links.select(key, "position", address).join(stored, "address")
    first = found.groupBy(key, "linked_id").agg(F.min("position").alias("page"))
    own = pages.select(F.col("page_id").alias("linked_id"), "url", "html").join(stored, "linked_id", "left_semi")
    return first.join(own, "linked_id").select(key, "page", "linked_id", "url", "html")


def aggregate_pages(
    pages: DataFrame, links: DataFrame, key: str, cap: int = vocab.MAX_LINKS, limit: int = vocab.MAX_DOCUMENT_CHARS
) -> tuple[DataFrame, DataFrame]:
    """Sub-pages (key, page, url, text) as one document, and their merged links.

    `page` is the place of a sub-page in its list; pages without text are left out. Once the
    links reach `cap`, the pages after the one that filled it are not read any more.
    """
    usable = pages.where("text <> ''")
    own = links.join(usable.select(key, "page"), [key, "page"], "left_semi")
    kept = merged_links(own, key, cap)
    full = kept.where(F.col("place") == cap).select(key, F.col("page").alias("_last"))
    read = usable.join(full, key, "left").where(F.col("_last").isNull() | (F.col("page") <= F.col("_last")))
    parts = read.select(
        key, "page", F.concat(F.lit("## "), page_heading(F.col("url")), F.lit("\n\n"), "text").alias("part")
    )
    return assemble_document(parts, key, "page", limit=limit), kept.select(key, "place", "url", "text")


def assemble_document(
    parts: DataFrame,
    key: str,
    order: str,
    text: str = "part",
    limit: int = vocab.MAX_DOCUMENT_CHARS,
    separator: str = "\n\n",
    span: int = 4096,
) -> DataFrame:
    """Parts of each document in order, joined and cut at `limit` characters.

    Only parts that begin before the limit are collected, so a document's list
    never holds more than `limit` characters however many parts it has; `parts` counts
    all of them. Where a part begins comes from lengths alone: lengths are summed for runs of
    `span` order values and for runs of `span` runs before the shuffle, and what lies past the
    limit is dropped at each level, so no window holds all runs of a document.
    """
    # A separator belongs to the part after it and may reach below the limit.
    reach = limit + len(separator)
    sized = parts.select(
        key,
        order,
        F.floor(F.col(order) / span).alias("run"),
        (F.length(text) + len(separator)).alias("size"),
        text,
    )
    runs = sized.groupBy(key, "run").agg(F.sum("size").alias("run_size"), F.count("*").alias("n"))
    runs = runs.withColumn("far", F.floor(F.col("run") / span))

    def before(*names: str):
        return Window.partitionBy(key, *names[:-1]).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)

    def begins(size: str, window):
        return F.coalesce(F.sum(size).over(window), F.lit(0))

    fars = runs.groupBy(key, "far").agg(F.sum("run_size").alias("far_size"))
    fars = fars.select(key, "far", begins("far_size", before("far")).alias("far_start")).where(F.col("far_start") < reach)
    starts = (
        runs.join(fars, [key, "far"])
        .withColumn("run_start", F.col("far_start") + begins("run_size", before("far", "run")))
        .where(F.col("run_start") < reach)
        .select(key, "run", "run_start")
    )
    inside = Window.partitionBy(key, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.join(starts, [key, "run"])
        .withColumn("begin", F.col("run_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .where(F.col("begin") < reach)
        .select(key, order, F.substring(text, 1, limit).alias(text))
    )
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    joined = F.array_join(F.transform(ordered, lambda p: p[text]), separator)
    counted = runs.groupBy(key).agg(F.sum("n").alias("parts"))
    return counted.join(placed.groupBy(key).agg(F.substring(joined, 1, limit).alias("document")), key)
