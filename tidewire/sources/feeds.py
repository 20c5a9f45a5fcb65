"""Feeds and quotes as relations: JSON documents, feed items and seed rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.text import clip_excerpt, iso_date, once, strip_html
from tidewire.functions.titles import quotable

QUOTE = "struct<chart:struct<result:array<struct<meta:struct<regularMarketPrice:double>,timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>>"
REVIEW = "struct<content:struct<label:string>,title:struct<label:string>,updated:struct<label:string>,`im:rating`:struct<label:string>,author:struct<name:struct<label:string>>>"


def quote_price(docs: DataFrame) -> DataFrame:
    """id, price of quote documents (id, json); null where a document has none."""
    return docs.select("id", F.get_json_object("json", "$.chart.result[0].meta.regularMarketPrice").cast("double").alias("price"))


def quote_history(docs: DataFrame) -> DataFrame:
    """id, at, close from parallel arrays of times and closing values; gaps are left out."""
    first = docs.select("id", F.get(F.from_json("json", QUOTE)["chart"]["result"], F.lit(0)).alias("r"))
    points = F.arrays_zip(F.col("r.timestamp").alias("t"), F.get(F.col("r.indicators.quote"), F.lit(0))["close"].alias("c"))
    return first.select("id", F.explode(points).alias("p")).select("id", F.timestamp_seconds(F.col("p.t")).alias("at"), F.col("p.c").alias("close")).filter("close is not null")


def exchange_rate(docs: DataFrame, currency: str) -> DataFrame:
    """id, rate from documents with a map of rates."""
    return docs.select("id", F.from_json("json", "struct<rates:map<string,double>>")["rates"][currency].alias("rate"))


def airborne(docs: DataFrame) -> DataFrame:
    """id, n: states whose ninth field says that they aren't on the ground."""
    states = F.from_json("json", "struct<states:array<array<string>>>")["states"]
    return docs.select("id", F.coalesce(F.size(F.filter(states, lambda s: F.get(s, F.lit(8)) == "false")), F.lit(0)).cast("long").alias("n"))


def store_reviews(docs: DataFrame, storefront: str) -> DataFrame:
    """id, excerpt, review_date, rating (of ten), author, note of the reviews in an app store's documents (id, json) that can be quoted.

    A single entry counts as a list of one; entries without stars are the app's own. What has no text is quoted by its
    title; the note says how many stars it gave in which store.
    """
    entry = F.get_json_object("json", "$.feed.entry")
    listed = F.when(entry.startswith("{"), F.concat(F.lit("["), entry, F.lit("]"))).otherwise(entry)
    label = lambda name: F.coalesce(F.trim(F.col(f"e.{name}.label")), F.lit(""))
    rows = docs.select("id", F.explode(F.from_json(listed, f"array<{REVIEW}>")).alias("e"))
    rows = rows.withColumn("stars", label("`im:rating`").try_cast("double")).filter("stars is not null")
    said = F.coalesce(F.nullif(label("content"), F.lit("")), label("title"))
    author = F.nullif(F.trim(F.regexp_replace(F.col("e.author.name.label"), r"\s+", " ")), F.lit(""))
    rows = once(rows, "excerpt", clip_excerpt(said))
    note = F.concat(F.format_string("%.0f", "stars"), F.lit(f"/5 App Store ({storefront.upper()})"))
    return rows.filter(quotable(F.col("excerpt"))).select("id", "excerpt", iso_date(label("updated")).alias("review_date"), (F.col("stars") * 2).alias("rating"), F.substring(author, 1, 120).alias("author"), note.alias("note"))


def first_items(items: DataFrame, most: int = 40) -> DataFrame:
    """Of each source's items (source, position), the first."""
    return items.withColumn("_nth", F.row_number().over(Window.partitionBy("source").orderBy("position"))).filter(F.col("_nth") <= most).drop("_nth")


def survivors(readers: Mapping[str, Callable[[SparkSession], DataFrame]], spark: SparkSession) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of the sources that can be read, and the errors of the others."""
    out, errors = None, {}
    for name, read in readers.items():
        try:
            rows = read(spark).withColumn("source", F.lit(name))
        except Exception as e:  # whatever a source fails with, the others go on
            errors[name] = f"{type(e).__name__}: {e}"[:500]
        else:
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, errors


RSS = "struct<channel:struct<item:array<struct<title:string,link:string,description:string,encoded:string,author:string,creator:string,pubDate:string,date:string>>>>"
ATOM = "struct<entry:array<struct<title:string,link:array<struct<_href:string,_rel:string>>,content:string,summary:string,author:struct<name:string>,published:string,updated:string>>>"
XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def feed_time(value: Column) -> Column:
    """A time as feeds write it, in mail or ISO form, else null."""
    mail = F.regexp_replace(F.regexp_replace(F.trim(value), r"^[A-Za-z]+,\s*", ""), r"(?:GMT|UTC?|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_extract(F.trim(value), r"^\d{4}-.*", 0)))


def _entries(docs: DataFrame) -> DataFrame:
    """id, position, url, title, html, author, published_at of the entries of feeds (id, xml) in either form."""
    rss, atom = F.from_xml("xml", RSS, XML)["channel"]["item"], F.from_xml("xml", ATOM, XML)["entry"]
    link = lambda e: F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    entry = lambda url, title, html, author, time: F.struct(F.trim(url).alias("url"), F.trim(title).alias("title"), F.coalesce(html, F.lit("")).alias("html"), author.alias("author"), feed_time(time).alias("published_at"))
    of_rss = F.transform(rss, lambda e: entry(e["link"], e["title"], F.coalesce(e["encoded"], e["description"]), F.coalesce(e["author"], e["creator"]), F.coalesce(e["pubDate"], e["date"])))
    of_atom = F.transform(atom, lambda e: entry(link(e), e["title"], F.coalesce(e["content"], e["summary"]), e["author"]["name"], F.coalesce(e["published"], e["updated"])))
    return docs.select("id", F.posexplode(F.coalesce(of_rss, of_atom)).alias("position", "e")).select("id", "position", "e.*")


def feed_items(docs: DataFrame) -> DataFrame:
    """id, position, url, title, content, author, published_at of feeds (id, xml); entries without address or title are left out, a broken feed has none."""
    rows = _entries(docs).filter((F.col("url") != "") & (F.col("title") != ""))
    return rows.select("id", "position", "url", "title", strip_html(F.col("html")).alias("content"), "author", "published_at")


def forum_posts(docs: DataFrame) -> DataFrame:
    """id, url, excerpt, review_date, author of a forum's feeds (id, xml): the post's own text without links, else its title, where that can be quoted."""
    own = F.regexp_replace(F.regexp_extract("html", r'(?s)<div[^>]*class="md"[^>]*>(.*?)</div>', 1), r"(?s)<a\b.*?</a>", " ")
    said = F.coalesce(F.nullif(strip_html(own), F.lit("")), "title", F.lit(""))
    author = F.nullif(F.regexp_replace(F.trim("author"), r"^/+", ""), F.lit(""))
    rows = once(_entries(docs).filter("url <> ''"), "excerpt", clip_excerpt(said))
    return rows.filter(quotable(F.col("excerpt"))).select("id", "url", "excerpt", F.col("published_at").cast("date").alias("review_date"), author.alias("author"))


# What precedes a verified review's text, and the class that numbers a review.
VERIFIED, NUMBERED = r"(?i)^[^|]{0,40}\bverified\b[^|]{0,20}\|\s*", r"\breview-(\d+)\b"


def review_pages(docs: DataFrame, base_url: str) -> DataFrame:
    """id, url, excerpt, review_date, rating, author, route, cabin of the reviews in pages (id, page_url, html) marked up as such, where they can be quoted.

    The address is the base listing's with the review's own anchor, so that it stays when a review moves to another page.
    """
    block = F.col("block")
    take = lambda pattern: F.nullif(F.regexp_extract(block, "(?is)" + pattern, 1), F.lit(""))
    marked = lambda name: take(rf'itemprop="{name}"[^>]*>(.*?)</(?:div|span|p|h\d|strong|a)>')
    cell = lambda name: F.nullif(strip_html(take(rf'<td[^>]*class="[^"]*{name}[^"]*"[^>]*>.*?</td>\s*<td[^>]*>(.*?)</td>')), F.lit(""))
    rows = docs.select("id", "page_url", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<article\b[^>]*itemprop="review"[^>]*>.*?</article>'), F.lit(0))).alias("block"))
    number = F.regexp_extract(F.regexp_extract(block, r'(?is)^<article\b[^>]*class="([^"]*)"', 1), NUMBERED, 1)
    named = F.regexp_extract(block, r'(?is)itemprop="author".*', 0)
    author = F.nullif(strip_html(F.regexp_extract(named, r'(?is)itemprop="name"[^>]*>(.*?)<', 1)), F.lit(""))
    date = F.coalesce(take(r'<meta[^>]*itemprop="datePublished"[^>]*content="([^"]*)"'), take(r'<time[^>]*datetime="([^"]*)"'))
    rows = once(rows, "excerpt", clip_excerpt(F.regexp_replace(strip_html(marked("reviewBody")), VERIFIED, "")))
    return rows.filter(quotable(F.col("excerpt"))).select(
        "id", F.when(number != "", F.concat(F.lit(base_url + "#anchor"), number)).otherwise(F.col("page_url")).alias("url"), "excerpt", iso_date(date).alias("review_date"),
        F.trim(marked("ratingValue")).try_cast("double").alias("rating"), F.substring(author, 1, 120).alias("author"), F.substring(cell("route"), 1, 60).alias("route"), cell("cabin_flown").alias("cabin"),
    )
