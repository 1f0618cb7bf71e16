"""Feeds end to end, a book's tags, and streams against slow versions."""

import json
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from lectern.functions.folders import kept
from lectern.operators import catalog, jobs
from lectern.sources import feeds, sinks
from lectern.streaming import events

#: A harbour's shelf: a folder above, a log to fetch in three ways, a chart that leads on.
SHELF = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/terms/">
  <link rel="search" type="application/atom+xml" href="find?all={searchTerms}&amp;author={atom:author}&amp;title={atom:title}"/>
  <link href="deck/4" rel="next"/><link href="deck/2" rel="previous"/>
  <link rel="http://opds-spec.org/facet" href="by/year"/><link rel="http://opds-spec.org/facet" href="by/port"/>
  <title>Harbour shelf</title>
  <entry><title>All charts</title><link type="application/atom+xml" href="charts"/><link rel="subsection" href="/never"/><id>shelf:charts</id></entry>
  <entry><link rel="http://opds-spec.org/acquisition/open-access" type="application/pdf" href="https://mirror.example.org/log-77.pdf"/>
    <link rel="http://opds-spec.org/acquisition/buy" type="application/epub+zip" href="../shop/log-77" title="With maps"/>
    <link rel="http://opds-spec.org/image" href="log-77.png" type="image/png"/>
    <category term="winds"/><category term="tides" label="Tides and moons"/>
    <title>Log of the Northern Ferry</title><id>shelf:log-77</id><dc:publisher>Quay Press</dc:publisher><dc:language>de</dc:language>
    <author><name>Ingrid Vale</name></author><author><name>Tomas Oke</name></author><author><name>R. Ulm</name></author>
    <summary>Seven winters on the same route.</summary></entry>
  <entry><id>shelf:chart-5</id><link rel="http://opds-spec.org/thumbnail" href="small/5.gif"/><link type="application/atom+xml;profile=opds-catalog" href="/chart/5" rel="alternate"/><title>Chart five</title></entry>
</feed>"""


def test_atom_feeds(spark):
    df = spark.createDataFrame([(1, SHELF, "https://quay.example.net/shelf/index.xml"), (2, "no feed at all", "https://quay.example.net")], "feed_id int, body string, base_url string")
    folder, log, chart = feeds.ingest_feeds_xml(df).orderBy("pos").collect()
    at = "https://quay.example.net"
    assert (folder.title, folder.navigation, folder.is_navigation, folder.downloads or []) == ("All charts", f"{at}/shelf/charts", True, [])
    assert (log.id, log.title, log.language, log.publisher, log.summary) == ("shelf:log-77", "Log of the Northern Ferry", "de", "Quay Press", "Seven winters on the same route.")
    assert log.authors == ["Ingrid Vale", "Tomas Oke", "R. Ulm"] and [c.term for c in log.categories] == ["winds", "tides"]
    assert (log.cover, log.is_navigation, log.navigation) == (f"{at}/shelf/log-77.png", False, None)
    assert [(d.url, d.format) for d in log.downloads] == [("https://mirror.example.org/log-77.pdf", "pdf"), (f"{at}/shop/log-77", "epub")] and log.downloads[1].title == "With maps"
    assert (chart.navigation, chart.is_navigation, chart.cover) == (f"{at}/chart/5", False, f"{at}/shelf/small/5.gif")
    links = feeds.feed_links(df)
    pages = catalog.feed_pages(links).first()
    assert (pages.next_page, pages.previous_page, pages.facets) == (f"{at}/shelf/deck/4", f"{at}/shelf/deck/2", 2)
    found = {r.field: r.template for r in feeds.search_links(links).collect()}
    assert found["title"] == f"{at}/shelf/find?title={{searchTerms}}" and found["author"] == f"{at}/shelf/find?author={{searchTerms}}" and "series" not in found
    asked = spark.createDataFrame([(1, "author", "R. Ulm"), (2, "", "moon")], "query_id int, field string, query string")
    urls = {r.query_id: r.url for r in catalog.search_templates(feeds.search_links(links), asked).collect()}
    assert urls == {1: f"{at}/shelf/find?author=R.+Ulm", 2: f"{at}/shelf/find?title=moon"}


def test_search_descriptions(spark):
    url = lambda kind, template: f'<Url type="{kind}" template="{template}"/>'
    body = "<OpenSearchDescription xmlns='http://a9.com/-/spec/opensearch/1.1/'>" + url("text/html", "/h") + url("application/atom+xml", "/search/authors?q={searchTerms}") + url("application/atom+xml", "/search?q={searchTerms}") + url("application/atom+xml", "/search?second={searchTerms}") + "</OpenSearchDescription>"
    df = spark.createDataFrame([(1, body), (2, f"<OpenSearchDescription>{url('text/html', '/only')}</OpenSearchDescription>")], "source_id int, body string")
    templates = feeds.parse_search_descriptions(df)
    asked = spark.createDataFrame([(1, "author", "a"), (2, "title", "b")], "query_id int, field string, query string")
    got = {(r.source_id, r.query_id): r.url for r in catalog.search_templates(templates, asked).collect()}
    assert got == {(1, 1): "/search/authors?q=a", (1, 2): "/search?q=b", (2, 1): "/only", (2, 2): "/only"}


#: The shelf as JSON: a publication of its own before a group with two, then ways on.
SHELVES = {
    "publications": [{"links": [{"type": "application/opds+json", "rel": "self", "href": "log/77"}], "metadata": {"subject": [{"name": "Tides"}, "winds"], "title": "Log"}}],
    "groups": [
        {
            "publications": [
                {"metadata": {"publisher": "Quay Press", "author": ["Ingrid Vale", {"name": "Tomas Oke"}], "title": "Almanac", "language": "nl", "identifier": "shelf:alm", "description": "Moons by month."}, "links": [{"rel": "http://opds-spec.org/acquisition/sample", "type": "application/pdf", "href": "https://mirror.example.org/alm.pdf"}], "images": [{"href": "alm.webp"}]},
            ],
            "navigation": [{"title": "Older", "href": "older?n=2"}],
        }
    ],
    "navigation": [{"title": "Charts", "href": "/charts"}],
    "links": [{"rel": "search", "templated": True, "href": "https://quay.example.net/find{?query}"}],
}


def test_json_feeds(spark):
    df = spark.createDataFrame([(1, json.dumps(SHELVES), "https://quay.example.net/v2/shelf")], "feed_id int, body string, base_url string")
    rows = {r.title: r for r in feeds.ingest_feeds_json(df).collect()}
    at = "https://quay.example.net"
    assert (rows["Charts"].navigation, rows["Charts"].is_navigation) == (f"{at}/charts", True)
    assert (rows["Older"].navigation, rows["Older"].is_navigation) == (f"{at}/v2/older?n=2", True)
    almanac = rows["Almanac"]
    assert (almanac.authors, almanac.summary, almanac.language, almanac.publisher, almanac.navigation) == (["Ingrid Vale", "Tomas Oke"], "Moons by month.", "nl", "Quay Press", None)
    assert [(d.url, d.format) for d in almanac.downloads] == [("https://mirror.example.org/alm.pdf", "pdf")]
    assert (rows["Log"].navigation, [c.label for c in rows["Log"].categories], rows["Log"].is_navigation) == (f"{at}/v2/log/77", ["Tides", "winds"], False)
    assert len(feeds.ingest_feeds_json(df, most=1).collect()) == 3
    searches = feeds.search_links(feeds.feed_links(df, "json"), "json").collect()
    assert [r.template for r in searches] == [f"{at}/find{{?query}}"]


def test_tags_of_a_book(spark):
    times = spark.createDataFrame([(1, 1, 0, 10, "One"), (2, 1, 0, 10, "a=b")], "book_id long, chapter_no long, start_ms long, end_ms long, title string")
    books = spark.createDataFrame([(1, "T;", "A", "S", "3", "", "d")], "book_id long, title string, author string, series string, series_number string, genre string, description string")
    got = {r.book_id: r.document for r in sinks.chapter_metadata(times, books).collect()}
    assert got[1] == ";FFMETADATA1\ntitle=T\\;\nartist=A\nalbum_artist=A\nalbum=T\\;\ngrouping=S \\#3\ngenre=Audiobook\ndescription=d\ncomment=d\n\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=10\ntitle=One\n"
    assert got[2].startswith(";FFMETADATA1\ngenre=Audiobook\n\n[CHAPTER]")


EVENTS = "job_id long, event_id long, ts timestamp, value double, total long"


def batches_of(spark, folder, batches):
    """A stream with a micro-batch for each list of (job_id, event_id, minute, value)."""
    for rows in batches:
        made = [(j, e, datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=m), v, 10) for j, e, m, v in rows]
        spark.createDataFrame(made, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_events_go_by_time_across_batches_and_late_ones_expire(spark, tmp_path):
    """Batch two brings an event that is early enough, and one that came too late; the clock is job 9's."""
    batches = [[(1, 0, 0, 0.0), (1, 2, 20, 0.5), (9, 1, 30, 0.0)], [(1, 4, 24, 0.7), (1, 3, 22, 0.55), (1, 5, 9, 9.0), (9, 6, 60, 0.2)], [(1, 7, 58, 0.79), (1, 8, 59, 0.81), (9, 9, 500, 0.9)]]
    stream = lambda: batches_of(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", batches)
    got = events.run_available(events.throttled(stream(), 0.1, "10 minutes"), "append", "t").collect()
    assert sorted((r.job_id, r.event_id) for r in got) == [(1, 0), (1, 2), (1, 4), (1, 8), (9, 1), (9, 6)]
    saved = events.run_available(events.saved_progress(stream(), 2, 10, "10 minutes"), "append", "s").collect()
    assert [r.event_id for r in sorted(saved, key=lambda r: r.progress) if r.job_id == 1] == [0, 2, 3, 4, 7, 8]
    previews = events.run_available(events.ttl_previews(stream(), 15 * 60_000, "10 minutes"), "append", "p").collect()
    minute = lambda ms: (ms - 1704067200000) // 60_000
    assert sorted((r.job_id, minute(r.opened), minute(r.ended), r.events) for r in previews) == [(1, 0, 0, 1), (1, 20, 24, 3), (1, 58, 59, 2), (9, 30, 30, 1), (9, 60, 60, 1)]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], "job_id long, status string").schema
    table = events.Upserts(spark, f"file://{tmp_path}/table", schema, ["job_id"], every=3)
    batches = [[(1, "a"), (2, "a")], [(2, "b")], [(3, "c")], [(1, "d"), (4, None)], [(4, "e")]]
    want = {}
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        for _ in range(2):
            table.write(df, n)
        if n == 3:
            table.write(spark.createDataFrame(batches[1], schema), 1)
        want |= dict(rows)
        assert {r.job_id: r.status for r in table.read().collect()} == want


def test_ranks_of_names_that_begin_alike(spark):
    rows = [(i, f"Supplier#{i % 700:09d}", i % 3, i % 5 > 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, name string, display_order int, enabled boolean").repartition(7)
    got = [(r.rank, r.id) for r in jobs.ranked(df, "display_order", "name").collect()]
    want = sorted((r for r in rows if r[3]), key=lambda r: (r[2], r[1], r[0]))
    assert sorted(got) == [(i, r[0]) for i, r in enumerate(want, 1)]
    shares = [r["count"] for r in kept(df.repartitionByRange(8, "display_order", "name", "id").withColumn("p", F.spark_partition_id()), "shares").groupBy("p").count().collect()]
    assert len(shares) > 4 and max(shares) < 900
    assert jobs.ranked(df.limit(0), "display_order", "name").count() == 0


def test_a_batch_of_many_files_is_one_batch(spark, tmp_path, monkeypatch):
    """As many tasks as files write a batch of arrivals, which stays one batch; ordered streams give the same rows."""
    rows = [(e, datetime(2024, 1, 1) + timedelta(minutes=7 * e), e % 9, "view", (e * 37 % 101) / 10) for e in range(2000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")

    def told():
        stream = events.arrivals(spark, str(tmp_path)).withColumnRenamed("user_id", "job_id")
        seen = events.run_intake(stream.select("job_id", "event_id", "ts"), ["ts", "event_id"], "n")
        let_through = events.run_available(events.throttled(stream, 0.1, "3 days"), "append", "t")
        return sorted(map(tuple, seen.collect())), sorted(map(tuple, let_through.collect()))

    one = told()
    monkeypatch.setattr(events, "FILE_EVENTS", 500)
    assert told() == one and {r[4] for r in one[0]} == {0, 1, 2, 3} and one[1]
