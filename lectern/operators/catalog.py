"""Catalog feeds: routing, entries, links and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import go_trim


def is_json_feed(text: Column) -> Column:
    """Whether a feed is JSON: it starts with {, parses, and has one of four members."""
    parsed = F.try_parse_json(text)
    has = [F.try_variant_get(parsed, f"$.{k}", "variant").isNotNull() for k in ("metadata", "navigation", "publications", "groups")]
    return F.coalesce(F.startswith(go_trim(text), F.lit("{")) & parsed.isNotNull() & (has[0] | has[1] | has[2] | has[3]), F.lit(False))


def route_feeds(feeds: DataFrame, body: str = "body") -> DataFrame:
    return feeds.withColumn("kind", F.when(is_json_feed(F.col(body)), "json").otherwise("xml"))


def _dots(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.array_append(a, x)))
    folder = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))


def resolve_link(base: Column, href: Column) -> Column:
    """A reference against an absolute base; port 0 goes, and then http becomes https. An empty one stays empty."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"(\?[^#]*)", 1)
    own, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"([?#].*)$", 1)
    folder = F.regexp_extract(path, "^(.*/)", 1)
    merged = F.concat(F.when(folder == "", "/").otherwise(folder), own)
    full = (
        F.when(href == "", "")
        .when(F.regexp_like(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, _dots(own), tail))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path, href))
        .when(F.startswith(href, F.lit("#")), F.concat(root, path, query, href))
        .otherwise(F.concat(root, _dots(merged), tail))
    )
    return F.when(F.contains(full, F.lit(":0/")), F.regexp_replace(F.regexp_replace(full, "^(.*?):0/", "$1/"), "^http://", "https://")).otherwise(full)


#: The format of the first part that a media type contains.
FORMATS = (("epub", "epub"), ("fb2", "fb2"), ("fictionbook", "fb2"), ("pdf", "pdf"), ("mobi", "mobi"), ("azw", "azw"), ("text/plain", "txt"), ("text/html", "html"))


def link_format(media: Column) -> Column:
    kind = F.lower(media)
    out = F.when(F.contains(kind, F.lit(FORMATS[0][0])), FORMATS[0][1])
    for part, name in FORMATS[1:]:
        out = out.when(F.contains(kind, F.lit(part)), name)
    return out.otherwise("unknown")


#: What relations start with.
OPDS = "http://opds-spec.org/"


def link_class(rel: Column, media: Column) -> Column:
    """cover, thumbnail, acquisition, navigation, feed (navigation unless there is a download), alternate or other."""
    catalog = F.contains(media, F.lit("opds-catalog"))
    return (
        F.when(rel.isin(OPDS + "image", OPDS + "cover"), "cover")
        .when(rel.isin(OPDS + "image/thumbnail", OPDS + "thumbnail"), "thumbnail")
        .when(F.startswith(rel, F.lit(OPDS + "acquisition")), "acquisition")
        .when(rel.isin("subsection", OPDS + "sort/popular", OPDS + "sort/new") | F.contains(media, F.lit("navigation")), "navigation")
        .when((rel == "") & (catalog | F.contains(media, F.lit("atom+xml"))), "feed")
        .when((rel == "alternate") & catalog, "alternate")
        .otherwise("other")
    )


def classify_links(links: DataFrame) -> DataFrame:
    """Per entry: cover (the last, else the last thumbnail), the first navigation link, downloads.

    Links of class feed or alternate lead on only if no download stands before them; an alternate
    one leads to a book's page, so it doesn't make the entry a folder.
    """
    kinds = links.withColumn("class", link_class(F.coalesce("rel", F.lit("")), F.coalesce("type", F.lit(""))))
    first_download = F.min(F.when(F.col("class") == "acquisition", F.col("pos"))).over(W.partitionBy("entry_id"))
    free = (F.col("class") == "navigation") | (F.col("class").isin("feed", "alternate") & (first_download.isNull() | (first_download > F.col("pos"))))
    kinds = kinds.withColumn("leads", free)
    pick = lambda name, cond, what="href": F.expr(f"{name}({what}, pos) FILTER (WHERE {cond})")
    lead = pick("min_by", "leads", "class")
    cover = F.coalesce(pick("max_by", "class = 'cover'"), pick("max_by", "class = 'thumbnail'"))
    return kinds.groupBy("entry_id").agg(cover.alias("cover"), pick("min_by", "leads").alias("navigation"), F.coalesce(lead != "alternate", F.lit(False)).alias("is_navigation"), F.count(F.when(F.col("class") == "acquisition", 1)).alias("downloads"))


def entry_fields(entries: DataFrame) -> DataFrame:
    """Summary, else content; categories' labels, else terms; authors that have a name."""
    names = F.filter(F.transform("categories", lambda c: F.coalesce(F.nullif(c["label"], F.lit("")), c["term"])), lambda x: x.isNotNull() & (x != ""))
    return entries.select("entry_id", F.coalesce(F.nullif("summary", F.lit("")), "content", F.lit("")).alias("summary"), names.alias("categories"), F.filter("authors", lambda a: a.isNotNull() & (a != "")).alias("authors"))


def feed_pages(links: DataFrame) -> DataFrame:
    """Per feed: next and previous page (the last such link) and the number of facets."""
    last = lambda rels: F.expr(f"max_by(href, pos) FILTER (WHERE rel IN ({rels}))")
    facet = F.count(F.when(F.contains("rel", F.lit("facet")), 1))
    return links.groupBy("feed_id").agg(last("'next'").alias("next_page"), last("'previous', 'prev'").alias("previous_page"), facet.alias("facets"))


def cap_publications(publications: DataFrame, most: int = 200) -> DataFrame:
    """A feed's first publications, those of groups before its own; navigation entries aren't counted."""
    counted = publications.where(~F.col("is_navigation"))
    rank = F.row_number().over(W.partitionBy("feed_id").orderBy("section", "pos"))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def search_url(template: Column, query: Column) -> Column:
    """A template with the encoded query, without its paging parts."""
    out = F.replace(template, F.lit("{searchTerms}"), F.url_encode(query))
    for gone in ("{startIndex?}", "{count?}", "{startPage?}"):
        out = F.replace(out, F.lit(gone), F.lit(""))
    return out


def search_templates(templates: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query on every source: the template of its field, else title, author, series, any."""
    pick = lambda field: F.expr(f"min_by(template, pos) FILTER (WHERE field = '{field}')")
    fields = ("title", "author", "series", "any")
    sources = templates.groupBy("source_id").agg(*(pick(f).alias(f) for f in fields))
    asked = queries.crossJoin(sources)
    own = F.coalesce(*(F.when(F.col("field") == f, F.col(f)) for f in fields), *fields)
    return asked.select("query_id", "source_id", search_url(own, F.col("query")).alias("url"))
