"""Book catalog feeds, XML and JSON, as entries, links and search templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.catalog import link_class, link_format, resolve_link

LINK = "struct<_rel:string,_type:string,_href:string,_title:string>"
FEED = f"""title string, link array<{LINK}>, entry array<struct<id:string,title:string,summary:string,content:string,language:string,published:string,publisher:string,rights:string,
author:array<struct<name:string>>,category:array<struct<_term:string,_label:string>>,link:array<{LINK}>>>"""
SEARCHES = "Url array<struct<_type:string,_template:string>>"
NAMES = ("id", "title", "summary", "content", "language", "published", "publisher", "rights")
OUT = ("feed_id", "pos", *NAMES, "authors", "categories", "links", "cover", "thumbnail", "navigation", "downloads", "is_navigation")


def _base(feeds: DataFrame) -> Column:
    """What a feed's references are resolved against; empty where it isn't known, and then they stay."""
    return F.coalesce("base_url", F.lit("")) if "base_url" in feeds.columns else F.lit("")


def _resolved(base: Column, href: Column) -> Column:
    return F.when(base == "", href).otherwise(resolve_link(base, href))


def _links(items: Column, base: Column, names: tuple[str, str, str, str]) -> Column:
    def one(x: Column) -> Column:
        rel, kind, href, title = (F.coalesce(x[n], F.lit("")) for n in names)
        return F.struct(rel.alias("rel"), kind.alias("type"), _resolved(base, href).alias("href"), title.alias("title"))

    return F.transform(F.coalesce(items, F.array()), one)


def _hrefs(links: Column, fits) -> Column:
    return F.transform(F.filter(links, fits), lambda x: x["href"])


def _last(items: Column) -> Column:
    return F.nullif(F.coalesce(F.try_element_at(items, F.lit(-1)), F.lit("")), F.lit(""))


def _downloads(links: Column, fits) -> Column:
    return F.transform(F.filter(links, fits), lambda x: F.struct(x["href"].alias("url"), x["type"].alias("type"), x["title"].alias("title"), link_format(x["type"]).alias("format")))


def _first_lead(links: Column, leads, stops) -> Column:
    """The first link that leads on, given whether a download stands before it."""
    at = F.transform(links, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    first = F.array_min(F.transform(F.filter(at, lambda y: stops(y["x"])), lambda y: y["i"]))
    return F.try_element_at(F.filter(at, lambda y: leads(y["x"], first.isNull() | (first > y["i"]))), F.lit(1))["x"]


def ingest_feeds_xml(feeds: DataFrame) -> DataFrame:
    """Entries of Atom feeds (feed_id, body, base_url if known); a body that isn't one gives none.

    cover is the last cover, else the last thumbnail; navigation the first link that leads on, feed
    and alternate links only if no download stands before; alternate ones lead to a book's page,
    so they don't make an entry navigation.
    """
    parsed = feeds.select("feed_id", _base(feeds).alias("base"), F.from_xml("body", F.lit(FEED), {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("f"))
    each = parsed.select("feed_id", "base", F.posexplode("f.entry").alias("pos", "e"))
    categories = F.transform(F.coalesce("e.category", F.array()), lambda c: F.struct(c["_label"].alias("label"), c["_term"].alias("term")))
    plain = [F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c) for c in NAMES]
    own = each.select("feed_id", F.col("pos").cast("long").alias("pos"), *plain, F.transform(F.coalesce("e.author", F.array()), lambda a: a["name"]).alias("authors"), categories.alias("categories"), _links(F.col("e.link"), F.col("base"), ("_rel", "_type", "_href", "_title")).alias("links"))
    kind = lambda x: link_class(x["rel"], x["type"])
    lead = _first_lead(F.col("links"), lambda x, free: (kind(x) == "navigation") | (kind(x).isin("feed", "alternate") & free), lambda x: kind(x) == "acquisition")
    thumbnail = _last(_hrefs(F.col("links"), lambda x: kind(x) == "thumbnail"))
    cover = F.coalesce(_last(_hrefs(F.col("links"), lambda x: kind(x) == "cover")), thumbnail)
    named = own.withColumn("_lead", lead).withColumns({"cover": cover, "thumbnail": thumbnail, "navigation": F.col("_lead.href"), "downloads": _downloads(F.col("links"), lambda x: kind(x) == "acquisition")})
    return named.withColumn("is_navigation", F.col("_lead").isNotNull() & (link_class(F.col("_lead.rel"), F.col("_lead.type")) != "alternate")).select(*OUT)


def _names(value: Column, member: str) -> Column:
    """Strings of a member that is a string, an object with a name, or a list of either."""
    own = F.try_variant_get(value, f"$.{member}", "variant")
    listed = F.try_variant_get(value, f"$.{member}", "array<variant>")
    items = F.when(listed.isNotNull() & F.startswith(F.schema_of_variant(own), F.lit("ARRAY")), listed).when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<variant>"))
    name = lambda x: F.when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.try_variant_get(x, "$.name", "string")).otherwise(F.try_variant_get(x, "$", "string"))
    return F.filter(F.transform(items, name), lambda x: x.isNotNull() & (x != ""))


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _listed(value: Column, path: str) -> Column:
    return F.coalesce(_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _json_link(x: Column, base: Column) -> Column:
    rel, kind, href, title = (F.coalesce(_get(x, f"$.{n}"), F.lit("")) for n in ("rel", "type", "href", "title"))
    return F.struct(rel.alias("rel"), kind.alias("type"), _resolved(base, href).alias("href"), title.alias("title"))


def ingest_feeds_json(feeds: DataFrame, most: int = 200) -> DataFrame:
    """Entries of JSON feeds (feed_id, body, base_url if known).

    Navigation comes first, then each group's navigation and publications, then the feed's own
    publications: `most` publications in all, and nothing of groups after these.
    """
    parsed = feeds.select("feed_id", _base(feeds).alias("base"), F.try_parse_json("body").alias("f"))
    tag = lambda items, nav: F.transform(items, lambda v: F.struct(F.lit(nav).alias("nav"), v.alias("v")))
    groups = F.transform(_listed(F.col("f"), "$.groups"), lambda g: F.struct(_listed(g, "$.navigation").alias("navigation"), _listed(g, "$.publications").alias("publications")))
    sized = parsed.withColumn("groups", groups)
    before = lambda n: F.aggregate(F.slice("groups", F.lit(1), n), F.lit(0), lambda a, g: a + F.size(g["publications"]))
    of_groups = F.flatten(F.transform("groups", lambda g, i: F.when(before(i) < most, F.concat(tag(g["navigation"], True), tag(F.slice(g["publications"], F.lit(1), F.greatest(F.lit(0), most - before(i))), False))).otherwise(F.array().cast("array<struct<nav:boolean,v:variant>>"))))
    own = F.slice(_listed(F.col("f"), "$.publications"), F.lit(1), F.greatest(F.lit(0), most - before(F.size("groups"))))
    each = sized.select("feed_id", "base", F.posexplode(F.concat(tag(_listed(F.col("f"), "$.navigation"), True), of_groups, tag(own, False))).alias("pos", "e")).select("feed_id", "base", "pos", "e.nav", "e.v")
    v, nav, base = F.col("v"), F.col("nav"), F.col("base")
    links = F.when(nav, F.array(_json_link(v, base))).otherwise(F.transform(_listed(v, "$.links"), lambda x: _json_link(x, base)))
    images = F.transform(_listed(v, "$.images"), lambda x: _json_link(x, base))
    plain = [F.coalesce(_get(v, f"$.metadata.{path}"), F.lit("")).alias(to) for path, to in (("identifier", "id"), ("description", "summary"), ("description", "content"), ("language", "language"), ("published", "published"), ("publisher", "publisher"))]
    title = F.coalesce(F.when(nav, _get(v, "$.title")).otherwise(_get(v, "$.metadata.title")), F.lit("")).alias("title")
    meta = _get(v, "$.metadata", "variant")
    categories = F.transform(F.coalesce(_names(meta, "subject"), F.array()), lambda s: F.struct(s.alias("label"), s.alias("term")))
    told = each.select("feed_id", F.col("pos").cast("long").alias("pos"), *plain, F.lit("").alias("rights"), title, F.coalesce(_names(meta, "author"), F.array().cast("array<string>")).alias("authors"), categories.alias("categories"), links.alias("links"), images.alias("_images"), nav.alias("is_navigation"))
    has = lambda x, *parts: F.greatest(*(F.contains(x, F.lit(p)) for p in parts), F.lit(False))
    loan = lambda x: has(x["rel"], "acquisition", "borrow", "buy")
    lead = _first_lead(F.col("links"), lambda x, free: x["rel"].isin("alternate", "self") & has(x["type"], "opds", "json") & free, loan)
    navigation = F.when(F.col("is_navigation"), F.col("links")[0]["href"]).otherwise(lead["href"])
    thumbnail = F.try_element_at(_hrefs(F.col("_images"), lambda x: x["href"] != ""), F.lit(1))
    cover = _last(_hrefs(F.col("_images"), lambda x: has(x["rel"], "cover")))
    downloads = F.when(F.col("is_navigation"), F.array().cast("array<struct<url:string,type:string,title:string,format:string>>")).otherwise(_downloads(F.col("links"), loan))
    return told.withColumns({"cover": cover, "thumbnail": thumbnail, "navigation": navigation, "downloads": downloads}).select(*OUT)


def feed_links(feeds: DataFrame, kind: str = "xml") -> DataFrame:
    """(feed_id, pos, rel, type, href, title, templated) of the feeds' own links; templates aren't resolved."""
    if kind == "xml":
        parsed = feeds.select("feed_id", _base(feeds).alias("base"), F.from_xml("body", F.lit(FEED), {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("f"))
        raw = F.transform(F.coalesce("f.link", F.array()), lambda x: F.struct(*(F.coalesce(x[f"_{n}"], F.lit("")).alias(n) for n in ("rel", "type", "href", "title")), F.contains(F.coalesce(x["_href"], F.lit("")), F.lit("{")).alias("templated")))
    else:
        parsed = feeds.select("feed_id", _base(feeds).alias("base"), F.try_parse_json("body").alias("f"))
        raw = F.transform(_listed(F.col("f"), "$.links"), lambda x: F.struct(*(F.coalesce(_get(x, f"$.{n}"), F.lit("")).alias(n) for n in ("rel", "type", "href", "title")), F.coalesce(_get(x, "$.templated", "boolean"), F.lit(False)).alias("templated")))
    each = parsed.select("feed_id", "base", F.posexplode(raw).alias("pos", "l"))
    href = F.col("l.href") if kind == "json" else _resolved(F.col("base"), F.col("l.href"))
    href = F.when(F.col("l.templated"), href).otherwise(_resolved(F.col("base"), F.col("l.href")))
    return each.select("feed_id", F.col("pos").cast("long").alias("pos"), "l.rel", "l.type", href.alias("href"), "l.title", "l.templated")


def search_links(links: DataFrame, kind: str = "xml") -> DataFrame:
    """(source_id, field, pos, template) of feed_links() that search: any, and in XML the fields that a template names."""
    search = links.where("rel = 'search'")
    if kind == "json":
        return search.where("templated").select(F.col("feed_id").alias("source_id"), F.lit("any").alias("field"), "pos", F.col("href").alias("template"))
    direct = search.where("type LIKE '%atom+xml%'")
    root = F.regexp_extract("href", r"^([^?#]*)", 1)
    own = [F.when(F.contains("href", F.lit(f"{{atom:{f}}}")), F.struct(F.lit(f).alias("field"), F.concat(root, F.lit(f"?{f}={{searchTerms}}")).alias("template"))) for f in ("title", "author", "series")]
    every = F.array_compact(F.array(F.struct(F.lit("any").alias("field"), F.col("href").alias("template")), *own))
    return direct.select(F.col("feed_id").alias("source_id"), "pos", F.explode(every).alias("t")).select("source_id", "t.field", "pos", "t.template")


def parse_search_descriptions(documents: DataFrame) -> DataFrame:
    """(source_id, field, pos, template) of search description documents (source_id, body).

    A template's path tells its field; the first atom+xml template, else the first, serves any.
    """
    parsed = documents.select("source_id", F.from_xml("body", F.lit(SEARCHES), {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("d"))
    each = parsed.select("source_id", F.posexplode("d.Url").alias("pos", "u")).select("source_id", F.col("pos").cast("long").alias("pos"), F.coalesce("u._type", F.lit("")).alias("type"), F.coalesce("u._template", F.lit("")).alias("template"))
    atom, has = F.contains("type", F.lit("atom+xml")), lambda part: F.contains("template", F.lit(part))
    field = F.when(has("/search/authors"), "author").when(has("/search/series"), "series").when(has("/search?") | F.endswith("template", F.lit("/search")), "title")
    fields = each.where(atom).withColumn("field", field)
    # of several author or series templates the last counts, of titles the first
    ordered = fields.where("field IS NOT NULL").withColumn("pos", F.when(F.col("field") == "title", F.col("pos")).otherwise(-F.col("pos")))
    generic = each.groupBy("source_id").agg(F.min(F.struct(~atom, "pos", "template")).alias("g")).select("source_id", F.lit("any").alias("field"), F.col("g.pos").alias("pos"), F.col("g.template").alias("template"))
    return ordered.select("source_id", "field", "pos", "template").unionByName(generic)
