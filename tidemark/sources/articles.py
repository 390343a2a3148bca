"""Feed items: their schema, the adapter from `documents`, and parsers of landed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.links import canonical_link, kind_of_link
from tidemark.functions.text import event_date, strip_html

AS_OF = "2024-01-31"
ENGAGEMENT = ["upvotes", "hn_points", "hn_comments", "reddit_score", "reddit_comments", "lob_score", "lob_comments", "gh_stars", "gh_forks", "gh_open_issues"]


def padded(number: Column) -> Column:
    """An integer in five digits, or as many as it needs."""
    s = number.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(5)), F.lit("0"))


def articles_from_documents(docs: DataFrame) -> DataFrame:
    """A deterministic feed made of `documents`, on which every analytical operator can run; `title` is the first line and `desc` the whole text."""
    number = F.col("doc_id")
    return docs.select(
        number.alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("desc"),
        F.element_at(F.array(F.lit("paper"), F.lit("repo"), F.lit("news")), (number % 3 + 1).cast("int")).alias("type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (number % 31).cast("int")).alias("event_date"),
        F.col("source").alias("venue"),
        (1 + F.col("n_chars") % 999).cast("int").alias("heat"),
        F.when(number % 7 >= 3, F.concat(F.lit("2401."), padded(F.floor(number / 4)))).alias("arxiv_id"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _item(link: Column, title: Column, desc: Column, raw_date: Column, venue: Column, kind: Column, most: int, **engagement: Column) -> list[Column]:
    text = strip_html(desc)
    return [
        canonical_link(link).alias("link"), strip_html(title).alias("title"),
        F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text).alias("desc"),
        event_date(raw_date).alias("event_date"), venue.alias("venue"), kind.alias("type"),
        *((engagement[n] if n in engagement else F.lit(None)).cast("int").alias(n) for n in ENGAGEMENT),
    ]


def _first_of_each(items: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each link, the newest; at most so many, newest first."""
    order = Window.partitionBy("link").orderBy(F.desc_nulls_last("event_date"), "title")
    items = items.where(F.length("link") > 0).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return items.orderBy(F.desc_nulls_last("event_date"), "link").limit(most) if most else items


def _each_file(items: DataFrame, each: int | dict[str, int] | None) -> DataFrame:
    """The newest items of every file: one number for all files, or one by a file's name without its ending."""
    if each is None:
        return items
    order = Window.partitionBy("file").orderBy(F.desc_nulls_last("event_date"), "link")
    most = F.lit(each) if isinstance(each, int) else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in each.items() for x in kv)), F.col("file")), F.lit(0))
    return items.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def _file() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-z]+)?$", 1)


def read_arxiv(spark: SparkSession, path: str, most: int | None = 60, each: int | dict[str, int] | None = None) -> DataFrame:
    """Atom files of paper entries, one file for a topic; at most `each` of a file and `most` of all, the newest."""
    schema = "id string, title string, summary string, published string, `arxiv:primary_category` struct<_term:string>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path).withColumn("file", _file())
    title = F.replace(F.trim(F.coalesce("title", F.lit("")), F.lit(" \n\t\r")), F.lit("\n"), F.lit(" "))
    items = rows.select(*_item(F.col("id"), title, F.col("summary"), F.col("published"), F.coalesce(F.col("`arxiv:primary_category`._term"), F.lit("arXiv")), F.lit("paper"), 320), "file")
    return _first_of_each(_each_file(items, each).drop("file"), most)


def read_rss(spark: SparkSession, path: str, each: int | dict[str, int] | None = 10) -> DataFrame:
    """RSS 2.0 and Atom files, the newest `each` entries of every file; a venue is its file's name.

    An Atom entry's link is its alternate one, or else its first. Entries without title or link are left out.
    """
    schema = "title string, link string, description string, pubDate string, `content:encoded` string, `dc:date` string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).withColumn("file", _file())
    rss = rows.select("file", "link", "title", F.coalesce("description", "`content:encoded`").alias("text"), F.coalesce("pubDate", "`dc:date`").alias("day"))
    schema = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, updated string, published string"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path).withColumn("file", _file())
    other = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.try_element_at(other, F.lit(-1))["_href"], F.try_element_at("link", F.lit(1))["_href"])
    atom = rows.select("file", link.alias("link"), "title", F.coalesce("summary", "content").alias("text"), F.coalesce("updated", "published").alias("day"))
    both = rss.unionByName(atom).where((F.length(F.trim("title")) > 0) & (F.length(F.trim("link")) > 0))
    items = both.select(*_item(F.col("link"), F.col("title"), F.col("text"), F.col("day"), F.col("file"), F.lit("news"), 320), "file")
    return _first_of_each(_each_file(items, each).drop("file"))


def read_github(spark: SparkSession, path: str, most: int | None = 40) -> DataFrame:
    """Repository search results."""
    schema = "items array<struct<full_name:string,html_url:string,description:string,pushed_at:string,stargazers_count:int,forks_count:int,open_issues_count:int>>"
    r = spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("items"))
    counts = {"gh_stars": F.col("stargazers_count"), "gh_forks": F.col("forks_count"), "gh_open_issues": F.col("open_issues_count")}
    return _first_of_each(r.select(_item(F.col("html_url"), F.col("full_name"), F.coalesce("description", F.lit("")), F.col("pushed_at"), F.lit("GitHub"), F.lit("repo"), 320, **counts)), most)


def read_hacker_news(spark: SparkSession, path: str, most: int | None = 28) -> DataFrame:
    """Story search results; stories below both 4 points and 6 comments are left out."""
    schema = "hits array<struct<objectID:string,title:string,url:string,story_text:string,created_at:string,points:int,num_comments:int>>"
    r = spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("hits"))
    r = r.where((F.coalesce("points", F.lit(0)) >= 4) | (F.coalesce("num_comments", F.lit(0)) >= 6))
    link = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID")))
    return _first_of_each(r.select(_item(link, F.col("title"), F.coalesce("story_text", F.lit("")), F.col("created_at"), F.lit("Hacker News"), F.lit("news"), 320, hn_points=F.col("points"), hn_comments=F.col("num_comments"))), most)


def read_reddit(spark: SparkSession, path: str, most: int | None = 26) -> DataFrame:
    """Listings; posts below both 4 points and 4 comments are left out; relative links are completed."""
    schema = "data struct<children:array<struct<data:struct<title:string,url:string,permalink:string,selftext:string,created_utc:double,score:int,num_comments:int,subreddit:string>>>>"
    r = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("data.children.data").alias("d")).select("d.*")
    r = r.where((F.coalesce("score", F.lit(0)) >= 4) | (F.coalesce("num_comments", F.lit(0)) >= 4))
    url = F.coalesce(F.nullif("url", F.lit("")), F.col("permalink"))
    link = F.when(url.startswith("/"), F.concat(F.lit("https://www.reddit.com"), url)).otherwise(url)
    day = F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd")
    return _first_of_each(r.select(_item(link, F.col("title"), F.coalesce("selftext", F.lit("")), day, F.concat(F.lit("Reddit r/"), "subreddit"), F.lit("news"), 320, reddit_score=F.col("score"), reddit_comments=F.col("num_comments"))), most)


def read_lobsters(spark: SparkSession, path: str, relevant: str, most: int | None = 14, first: int | None = 45) -> DataFrame:
    """Of the first stories of every file those whose title or tags match the pattern."""
    schema = "title string, url string, short_id_url string, description string, created_at string, score int, comment_count int, tags array<string>"
    r = spark.read.option("multiLine", True).schema(schema).json(path).withColumns({"file": _file(), "at": F.monotonically_increasing_id()})
    if first is not None:
        r = r.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("_n") <= first)
    r = r.where(F.lower(F.concat_ws(" ", "title", "tags")).rlike(relevant))
    link = F.coalesce(F.nullif("url", F.lit("")), F.col("short_id_url"))
    return _first_of_each(r.select(_item(link, F.col("title"), F.coalesce("description", F.lit("")), F.col("created_at"), F.lit("Lobsters"), F.lit("news"), 320, lob_score=F.col("score"), lob_comments=F.col("comment_count"))), most)


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """Results of web searches, one file for a query, whose name is the venue; the link says what kind of item it is."""
    schema = "data array<struct<url:string,sourceURL:string,title:string,description:string,markdown:string,content:string>>"
    r = spark.read.option("multiLine", True).schema(schema).json(path).select(_file().alias("file"), F.inline("data"))
    some = lambda *names: F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))
    link = some("url", "sourceURL")
    return _first_of_each(r.where(link.isNotNull()).select(_item(link, F.coalesce(some("title"), link), F.coalesce(some("description", "markdown", "content"), F.lit("")), F.lit(None).cast("string"), F.col("file"), kind_of_link(link), 320)))


def read_daily_papers(spark: SparkSession, path: str, most: int | None = 60) -> DataFrame:
    """Daily paper lists with votes."""
    schema = "paper struct<id:string,title:string,summary:string,ai_summary:string,publishedAt:string,upvotes:int,organization:struct<name:string>>"
    r = spark.read.option("multiLine", True).schema(schema).json(path).select("paper.*").where("id is not null")
    venue = F.concat(F.lit("huggingface:"), F.coalesce("organization.name", F.lit("papers")))
    return _first_of_each(r.select(_item(F.concat(F.lit("https://arxiv.org/abs/"), "id"), F.col("title"), F.coalesce("ai_summary", "summary", F.lit("")), F.col("publishedAt"), venue, F.lit("paper"), 800, upvotes=F.col("upvotes"))), most)


#: Loaders by name; a session may add its own.
LOADERS = {f.__name__.removeprefix("read_"): f for f in (read_arxiv, read_rss, read_github, read_hacker_news, read_reddit, read_lobsters, read_daily_papers, read_search)}


def to_json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object for each row, for services that take JSON."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def read_etags(spark: SparkSession, path: str, now: str, hours: int = 168) -> DataFrame:
    """url, etag, last_modified and cached_at of kept validators that are not older than `hours`; one JSON object a line."""
    rows = spark.read.schema("url string, etag string, last_modified string, cached_at string, content_hash string").json(path)
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("cached_at"))
    return rows.where(age.isNull() | (age <= hours * 3600)).select("url", "etag", "last_modified", "cached_at")


def changed(fetches: DataFrame, kept: DataFrame) -> DataFrame:
    """Of fetches (url, etag, last_modified) those that no kept validator shows to be unchanged."""
    k = kept.select("url", F.col("etag").alias("old_etag"), F.col("last_modified").alias("old_modified"))
    same = F.coalesce(F.col("etag") == F.col("old_etag"), F.col("last_modified") == F.col("old_modified"), F.lit(False))
    return fetches.join(k, "url", "left").where(~same).select(*fetches.columns)


def register_loader(name: str, loader) -> None:
    LOADERS[name] = loader
