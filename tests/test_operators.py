"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog, cleaning, estimate, jobs, markup, numbers, segment
from lectern.plans import prepare
from lectern.sources import bundled, dictionaries, feeds, sinks
from lectern.sources.books import read_books


def column(spark, values, use, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", use(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def texts(spark, *values, **more):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    return rows.withColumns({k: F.lit(v) for k, v in more.items()})


def pieces(df, name):
    return [r[name] for r in df.orderBy("doc_id", df.columns[1]).collect()]


EN = [
    (0, "zero", "zeroth"),
    (7, "seven", "seventh"),
    (20, "twenty", "twentieth"),
    (21, "twenty-one", "twenty-first"),
    (112, "one hundred twelve", "one hundred twelfth"),
    (100, "one hundred", "one hundredth"),
    (1000, "one thousand", "one thousandth"),
    (-5, "minus five", "minus fifth"),
    (1000000, "one million", "one millionth"),
    (2147483648, "two billion one hundred forty-seven million four hundred eighty-three thousand six hundred forty-eight", "two billion one hundred forty-seven million four hundred eighty-three thousand six hundred forty-eighth"),
    (9 * 10**18 + 1, "nine million trillion one", "nine million trillion first"),
]


def test_english_numbers(spark):
    n = [x for x, *_ in EN]
    assert column(spark, n, numbers.cardinal_en, "long") == [c for _, c, _ in EN]
    assert column(spark, n, numbers.ordinal_en, "long") == [o for *_, o in EN]
    assert column(spark, [-(1 << 63)], numbers.cardinal_en, "long") == [str(-(1 << 63))]


RU = [
    (0, "m", "ноль", "нулевой"),
    (1, "f", "одна", "первая"),
    (2, "n", "два", "второе"),
    (3, "f", "три", "третья"),
    (21, "f", "двадцать одна", "двадцать первая"),
    (40, "m", "сорок", "сороковой"),
    (101, "n", "сто одно", "сто первое"),
    (300, "m", "триста", "трёхсотый"),
    (1000, "m", "одна тысяча", "тысячный"),
    (2000, "f", "две тысячи", "две тысячная"),
    (11000, "m", "одиннадцать тысяч", "одиннадцать тысячный"),
    (1996, "m", "одна тысяча девятьсот девяносто шесть", "одна тысяча девятьсот девяносто шестой"),
    (2000000, "m", "два миллиона", "два миллионный"),
    (-5, "m", "минус пять", "минус пятый"),
    (10**15, "m", "1000000000000000", "1000000000000000"),
]


def test_russian_numbers(spark):
    for n, g, c, o in RU:
        assert column(spark, [n], lambda x, g=g: numbers.cardinal_ru(x, g), "long") == [c]
        assert column(spark, [n], lambda x, g=g: numbers.ordinal_ru(x, g), "long") == [o]


def test_noun_endings(spark):
    words = ["книга", "окно", "стол", "столов", "врачей", "книги", "горы", "окна", "моря", "земля", "ночь", ""]
    assert column(spark, words, numbers.gender_of) == list("fnmmmffnnfmm")


def test_roman(spark):
    assert column(spark, ["IV", "XIX", "MCMXCIV", "IC", "MMMM"], numbers.roman_value) == [4, 19, 1994, 99, 4000]
    got = numbers.roman_numerals(texts(spark, "Chapter IV and XIX, not IIII or aIII or mix"))
    assert [(r.roman, r.value) for r in got.orderBy("pos").collect()] == [("IV", 4), ("XIX", 19)]


def test_roman_in_words(spark):
    nouns = [*bundled.NOUNS, bundled.Noun("en", "century", "m", "c", "century", ("centuries",))]
    got = numbers.roman_in_words(texts(spark, "Chapter V and the IV page, not IIII or MIX.", "page IIII", "XX century, Part\nII", ""), nouns=nouns)
    assert pieces(got, "text") == ["Chapter five and the fourth page, not IIII or MIX.", "page IIII", "twentieth century, Part\ntwo", ""]


def test_numbers_in_texts(spark):
    got = numbers.normalize_numbers_en(texts(spark, "Chapter 5 has 21 pages, page 3.", "It is -5, 1,000 and Tu-154.", "99999999999999999999 stays", ""))
    assert pieces(got, "text") == ["Chapter fifth has twenty-one pages, page third.", "It is minus five, one,zero and Tu one hundred fifty-four.", "99999999999999999999 stays", ""]
    titles = spark.createDataFrame([("Глава 3",)], "title string")
    assert numbers.normalize_titles(titles, "ru").first()[0] == "Глава третья"
    assert [r.number for r in numbers.extract_numbers(texts(spark, "a -5 b 12 99999999999999999999")).orderBy("pos").collect()] == [-5, 12]


def test_noun_lookup(spark):
    nouns = spark.createDataFrame([("page", "m", "o", "page", ["pages"]), ("pages", "f", "c", "pages", []), ("leaf", "n", "c", "leaf", ["leaves", "pages"])], "noun string, gender string, form string, singular string, plurals array<string>")
    got = {r.word: r.noun for r in numbers.lookup_nouns(spark.createDataFrame([("Pages",), ("leaves",), ("none",)], "word string"), nouns).collect()}
    assert got == {"Pages": "pages", "leaves": "leaf", "none": None}


@pytest.mark.parametrize(
    "text,want",
    [
        ("“Hi” — he said…", "Hi - he said..."),
        ("a * b #c ※ ⁂", "a b c * ***"),
        ("5° ± 1½", "5 degrees plus or minus 1 one half"),
        ("x\r\ny\rz", "x\ny\nz"),
        ("a\n \n\n b", "a\n\nb"),
        ("wait......", "wait..."),
        ("a\x00bc\td", "a b c d"),
        ("snake_case", "snake case"),
        ("", ""),
    ],
)
def test_clean(spark, text, want):
    assert column(spark, [text], cleaning.clean) == [want]


def test_speakable(spark):
    rows = spark.createDataFrame([("...", "en"), ("привет", "en"), ("привет", "ru"), ("hello", "ru"), ("12", "de"), (None, "en"), ("é", "en")], "text string, lang string")
    assert [r.text for r in cleaning.speakable(rows).collect()] == ["привет", "12", "é"]


def test_rules(spark):
    got = cleaning.apply_rules(texts(spark, "Mr. Mr. X met Dr. Who.", "It costs $5 and 7%.", "no rule"))
    assert pieces(got, "text") == ["Mister Mr. X met Doctor Who.", "It costs 5 dollars and 7 percent ", "no rule"]


def test_names(spark):
    names = ["a/b:c", "...", "My Book! (2nd)", "x" * 150, "a..b", "", " .x. "]
    assert column(spark, names, cleaning.file_name) == ["a_b_c", "untitled", "My_Book_2nd", "x" * 100, "a_b", "untitled", "x"]
    assert column(spark, ["b"], lambda c: cleaning.file_name_with_extension(c, F.lit("epub"))) == ["b.epub"]


def test_languages(spark):
    assert column(spark, ["en-US-Wavenet-A", "ru_RU", "alloy", None], cleaning.language_code) == ["en", "ru", "en", "en"]
    assert column(spark, ["ru", "ru-RU", "Russian", "русский", "en", "rub"], cleaning.is_russian) == [True, True, True, True, False, False]


def test_transliteration(spark):
    assert column(spark, ["FBI", "chess", "Phone", "box", "W"], cleaning.transliterated) == ["эф би ай", "чесс", "фоне", "бокс", "дабл ю"]
    assert pieces(cleaning.transliterate(texts(spark, "это FBI, x1 ok")), "text") == ["это эф би ай, x1 ок"]


def test_sentences(spark):
    df = texts(spark, "Hi there. How? Fine!", "В. В. Иванов пришёл. Да.", "A.B.C. stays", "no end")
    assert pieces(segment.sentences(df), "sentence") == ["Hi there.", "How?", "Fine!", "В.В. Иванов пришёл.", "Да.", "A.B.C. stays", "no end"]
    odd = texts(spark, "a. b!  c…\nd", "", "x.y. z")
    back = segment.sentences_lossless(odd).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"))
    assert {r.doc_id: "".join(x.sentence for x in r.s) for r in back.collect()} == {0: "a. b!  c…\nd", 2: "x.y. z"}


def test_separators(spark):
    df = texts(spark, "a\n* * *\nb\n---\n***\nc", "x\n____\n", "• • •\n. . .\n-- no")
    marked = segment.mark_separators(df)
    m = segment.MARKER
    assert pieces(marked, "text") == [f"a\n{m}\nb\n{m}\nc", f"x\n{m}\n", f"{m}\n-- no"]
    assert pieces(segment.split_parts(marked), "part") == ["a", "b", "c", "x", "-- no"]
    assert [r.separators for r in segment.count_parts(marked).orderBy("doc_id").collect()] == [2, 1, 1]


@pytest.mark.parametrize("mode", ["sentence", "paragraph", "size"])
def test_chunks_fit_and_keep_tags(spark, mode):
    text = "One sentence here. " * 30 + '<break time="500ms"/> ' * 10 + "x" * 300 + "\n\n" + "é" * 200
    rows = segment.chunk(texts(spark, text, ""), mode, 100).collect()
    assert all(len(r.chunk.encode()) <= 100 and r.chunk.count("<") == r.chunk.count(">") for r in rows)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(r.chunk for r in sorted(rows, key=lambda r: r.chunk_no))) == squeeze(text)
    merged = segment.merge_small(segment.chunk(texts(spark, text), mode, 100), 40, 100).collect()
    assert all(len(r.chunk.encode()) <= 100 for r in merged)
    assert squeeze("".join(r.chunk for r in sorted(merged, key=lambda r: r.chunk_no))) == squeeze(text)


def test_markup(spark):
    p = markup.Pauses(sentence=500, paragraph=800, title=900)
    df = texts(spark, "Hi <b>. Yes: no.\n\nNext.", "{{TITLE_BREAK}}\nText.", "  ")
    got = pieces(markup.add_breaks(df, p), "text")
    assert got[0] == 'Hi &lt;b&gt;. <break time="500ms"/> Yes no.\n\n<break time="800ms"/>\n\nNext.'
    assert got[1] == '\n\n<break time="900ms"/>\n\nText.' and got[2] == "  "
    assert pieces(markup.wrap_speak(df, markup.Pauses()), "text")[2] == "<speak></speak>"
    paused = column(spark, ["a - b (c) d: e... f"], lambda c: markup.with_pauses(c, True, 300, 200, 250))[0]
    assert paused.count("<break") == 5 and "300ms" in paused and "200ms" in paused and "250ms" in paused
    rows = spark.createDataFrame([("a&b", 1.0, 1.0), ("x", 0.5, 1.5), ("<speak>y</speak>", 1.2, 1.0)], "text string, speed double, pitch double")
    assert [r.text for r in markup.prosody(rows).collect()] == ["<speak>a&amp;b</speak>", '<speak><prosody rate="x-slow" pitch="x-high">x</prosody></speak>', '<speak><prosody rate="fast">y</prosody></speak>']


def test_estimates(spark):
    chapters = spark.createDataFrame([(1, 1, "one two\tthree"), (1, 2, "é"), (2, 1, "w " * 9000)], "book_id long, chapter_no long, content string")
    got = {r.book_id: r for r in estimate.book_estimate(estimate.chapter_stats(chapters)).collect()}
    assert (got[1].words, got[1].chars, got[1].minutes, got[1].duration) == (4, 15, 1, "1m")
    assert (got[2].minutes, got[2].duration) == (60, "1h")
    assert column(spark, [59, 60, 61, 135], estimate.duration_label, "long") == ["59m", "1h", "1h 1m", "2h 15m"]
    names = spark.createDataFrame([(1, [" SF ", "sf", "Drama", "", "a", "b", "c", "d"])], "k int, v array<string>")
    mapped = spark.createDataFrame([("sf", "Science fiction")], "code string, name string")
    assert estimate.join_names(names, "k", "v", "; ", mapped).first().joined == "Science fiction; Drama; a; b; c"
    assert column(spark, ["", None, "g"], lambda c: estimate.resolve_genre(c, F.lit(""))) == ["Audiobook", "Audiobook", "g"]


def test_parts(spark):
    rows = spark.createDataFrame([(1, i, s, "t") for i, s in enumerate([4000.0, 4000.0, 1000.0, 9000.0, 10.0], 1)], "book_id long, chapter_no long, seconds double, title string")
    parts = [r.part_no for r in estimate.pack_parts(rows, 100).orderBy("chapter_no").collect()]
    assert parts == [1, 2, 2, 3, 4] and {r.part_no for r in estimate.pack_parts(rows, 0).collect()} == {1}
    assert [r.label for r in estimate.part_titles(rows.where("chapter_no < 3").select("book_id", F.col("chapter_no").alias("part_no"), "title")).orderBy("part_no").collect()] == ["t, Part 001", "t, Part 002"]


def test_links(spark):
    base = F.lit("http://h.example:0/opds/a/feed.xml?x=1")
    hrefs = ["b.epub", "/c", "//o.example/d", "https://z.example/e", "../f?q=1", "", "./g"]
    want = ["https://h.example/opds/a/b.epub", "https://h.example/c", "http://o.example/d", "https://z.example/e", "https://h.example/opds/f?q=1", "", "https://h.example/opds/a/g"]
    assert column(spark, hrefs, lambda c: catalog.resolve_link(base, c)) == want
    assert column(spark, ["application/EPUB+zip", "x-fictionbook", "image/png"], catalog.link_format) == ["epub", "fb2", "unknown"]
    bodies = ['{"metadata":{}}', ' {"groups":[]}', '{"other":1}', "{bad", "<feed/>", None]
    assert column(spark, bodies, catalog.is_json_feed) == [True, True, False, False, False, False]


def test_feeds(spark):
    xml = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>1</id><title>T</title><content>c</content><author><name>A</name></author><category term='t' label='L'/><link rel='subsection' type='x' href='/n'/></entry></feed>"
    row = feeds.ingest_feeds_xml(spark.createDataFrame([(1, xml), (2, "junk")], "feed_id int, body string")).collect()
    assert len(row) == 1 and row[0].authors == ["A"] and row[0].is_navigation and row[0].links[0].href == "/n"
    assert catalog.entry_fields(spark.createDataFrame([(1, "", "c", [("", "t"), ("L", "x")], ["", "A"])], "entry_id int, summary string, content string, categories array<struct<label:string,term:string>>, authors array<string>")).first()[1:] == ("c", ["t", "L"], ["A"])
    js = '{"navigation":[{"title":"n","href":"/x"}],"groups":[{"publications":[{"metadata":{"title":"g"}}]}],"publications":[{"metadata":{"title":"p","author":{"name":"B"},"subject":"s"}}]}'
    got = feeds.ingest_feeds_json(spark.createDataFrame([(1, js), (2, "junk")], "feed_id int, body string")).orderBy("pos").collect()
    assert [(r.title, r.is_navigation, r.authors) for r in got] == [("n", True, []), ("g", False, []), ("p", False, ["B"])]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "n.csv").write_text("# c\n\npage, m, o, page, pages|pgs\nbad,line\nleaf,z,z,leaf,leaves\npage,f,c,page,\n")
    got = {r.noun: (r.gender, r.form, r.plurals) for r in dictionaries.load_nouns(spark, str(tmp_path / "n.csv"), "en").collect()}
    assert got == {"page": ("f", "c", []), "leaf": ("m", "c", ["leaves"])}
    (tmp_path / "r.csv").write_text('# c\n\\bMr\\.,Mister,Mister,x\n"a,b",c,d,e\n(bad,x,y,z\nshort,x\n')
    assert dictionaries.load_rules(spark, str(tmp_path / "r.csv"), "en") == [("\\bMr\\.", "Mister"), ("a,b", "c")]


def test_jobs(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, created_at int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 3)], "id int, v string, created_at int")
    assert sorted(jobs.upsert(base, new, ["id"]).collect()) == [(1, "a", 1), (2, "B", 2), (3, "c", 3)]
    assert sorted(r.id for r in jobs.seed_if_empty(base.limit(0), new).collect()) == [2, 3]
    assert sorted(r.id for r in jobs.seed_if_empty(base, new).collect()) == [1, 2]


def test_sinks_and_books(spark, tmp_path):
    chapters = read_books(spark.createDataFrame([(1, "en", "a\n\n b\n  \nc"), (2, "en", None)], "doc_id long, lang string, text string"))
    assert [(r.chapter_no, r.content) for r in chapters.orderBy("chapter_no").collect()] == [(1, "a"), (2, " b"), (3, "c")]
    sinks.write_chapter_text(chapters, str(tmp_path / "out"))
    assert {r.file for r in spark.read.json(str(tmp_path / "out")).collect()} == {"0001_Chapter_1.txt", "0002_Chapter_2.txt", "0003_Chapter_3.txt"}
    assert column(spark, ["a=b;c#d\\e\nf"], sinks.escape_metadata) == ["a\\=b\\;c\\#d\\\\e f"]


def test_prepare(spark):
    got = prepare.prepare_corpus(texts(spark, "“Mr. X” read 3 pages…"))
    assert pieces(got, "text") == ["Mister X read three pages..."]
    assert all(r.chunk.startswith("<speak>") for r in prepare.chunk_job(texts(spark, "One. Two.\n\nThree.")).collect())


def test_every_line_is_a_chapter(spark, sf_dir):
    from lectern.queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    got = QUERIES["f13_pack_parts_all"](spark, sf_dir)
    assert got.count() == got.select("book_id", "chapter_no").distinct().count() == rows.count()
    assert QUERIES["f11_chapter_timeline_all"](spark, sf_dir).count() == rows.count()


def test_chapters_of_a_crowded_book(spark):
    rows = spark.range(500).select(F.lit(1).alias("book_id"), (F.col("id") % 3).alias("line"), (F.col("id") % 50).alias("key"), F.col("id").alias("rest"), (F.col("id") + 1).alias("duration_ms"), F.lit("").alias("title"))
    placed = estimate.number_chapters(rows, "book_id", "line", "key", ["rest"], span=7)
    want = sorted((r.line, r.key, r.rest) for r in rows.collect())
    assert [(r.line, r.key, r.rest) for r in placed.orderBy("chapter_no").collect()] == want
    at = 0
    for r in estimate.chapter_timeline(placed, 5, span=8).orderBy("chapter_no").collect():
        assert (r.start_ms, r.end_ms) == (at, at + r.duration_ms)
        at = r.end_ms + 5
