"""Rules, numbers and whole jobs by language and provider: small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import cleaning, estimate, jobs, numbers, russian, segment
from lectern.plans import prepare
from lectern.sources import bundled, dictionaries


def texts(spark, values, **more):
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    return rows.withColumns({k: F.lit(v) for k, v in more.items()})


def said(df):
    return [r.text for r in df.orderBy("doc_id").collect()]


UNITS = [
    ("Напряжение 220 В", "Напряжение 220 вольт "),
    ("В доме", "В доме"),
    ("Он живет В городе", "Он живет В городе"),
    ("Линия 10 кВ", "Линия 10 киловольт "),
    ("Потребление 500 мА", "Потребление 500 миллиампер "),
    ("Он пришел, А она ушла", "Он пришел, А она ушла"),
    ("Груз 10 т", "Груз 10 тонн "),
    ("Площадь 50 кв.м", "Площадь 50 квадратных метров "),
    ("Объем 10 куб.м", "Объем 10 кубических метров "),
    ("Скорость 100 км/ч", "Скорость 100 километров в час "),
    ("Двигатель 150 л.с.", "Двигатель 150 лошадиных сил "),
    ("Частота 2.4 МГц", "Частота 2.4 мегагерц "),
    ("Батарея 12 В, 7 А, емкость 84 Вт", "Батарея 12 вольт  7 ампер  емкость 84 ватт "),
    ("Добавить 500 г муки, 250 мл воды", "Добавить 500 граммов муки, 250 миллилитров воды"),
    ("ФСБ и США", "эф эс бэ и сэ шэ а "),
]


def test_russian_rules(spark):
    assert said(cleaning.apply_rules(texts(spark, [a for a, _ in UNITS]), bundled.RULES, lang="ru")) == [b for _, b in UNITS]


def test_rules_by_language_markup_and_flag(spark):
    rules = [bundled.Rule("one", "1", "<1>", "en"), bundled.Rule("two", "2", "", "en"), bundled.Rule("one", "раз", "", "ru"), bundled.Rule("any", "x"), bundled.Rule("off", "y", "", "en", False)]
    df = spark.createDataFrame([(0, "one two any off", "en"), (1, "one two any off", "ru"), (2, "one two any off", "de"), (3, None, "en")], "doc_id long, text string, lang string")
    assert said(cleaning.apply_rules(df, rules, lang=F.col("lang"))) == ["1 2 x off", "раз two x off", "one two x off", None]
    assert said(cleaning.apply_rules(df, rules, lang=F.col("lang"), markup=True))[0] == "<1> 2 x off"
    assert said(cleaning.apply_rules(df, rules, lang="ru"))[0] == "раз two x off"


@pytest.mark.parametrize("pattern,want", [(r"\bMr\.", "Mr."), (r"\$(\d+)", "$"), (r"(\d+)%", "%"), ("(?i)x", ""), ("a|b", ""), ("ab?c", "a"), ("[ \t]+", ""), (r"(\d+)\s*км/ч", "км/ч"), ("a+", "a"), (r"x{2,3}yz", "yz")])
def test_required_text_of_a_pattern(pattern, want):
    assert cleaning.required(pattern) == want


def test_rule_files_keep_markup(spark, tmp_path):
    (tmp_path / "r.csv").write_text('# c\nМВД,эм вэ дэ,эм вэ д+э,x\n"a,b",c,,y\n(bad,x,y,z\n')
    assert dictionaries.load_rule_set(spark, str(tmp_path / "r.csv"), "ru") == [bundled.Rule("МВД", "эм вэ дэ", "эм вэ д+э", "ru"), bundled.Rule("a,b", "c", "", "ru")]


ROMANS = [
    ("Глава III", "Глава третья"),
    ("Часть I", "Часть первая"),
    ("Том IV", "Том четвёртый"),
    ("Действие V", "Действие пятое"),
    ("III Глава", "третья Глава"),
    ("Текст III здесь", "Текст III здесь"),
    ("Часть I и Глава III", "Часть первая и Глава третья"),
    ("Глава" + " " * 300 + "IX", "Глава" + " " * 300 + "девятая"),
]


def test_russian_numerals_and_numbers(spark):
    assert said(russian.normalize_numbers_ru(texts(spark, [a for a, _ in ROMANS]))) == [b for _, b in ROMANS]
    more = [("Глава 5 и 21 рубль", "Глава пятая и двадцать один рубль"), ("5-6", "пять-6"), ("2 2 книги", "два две книги"), ("1" * 25, "1" * 25)]
    assert said(russian.normalize_numbers_ru(texts(spark, [a for a, _ in more]))) == [b for _, b in more]


def test_both_russian_spellers_agree(spark):
    rng = random.Random(5)
    values = [*range(120), *(rng.randrange(-(10**15), 10**15) for _ in range(150)), *(10**k for k in range(15)), *(3 * 10**k for k in range(14))]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(values)], "i int, n long")
    cols = [f(F.col("n"), g).alias(f"{k}{g}") for k, f in (("c", numbers.cardinal_ru), ("o", numbers.ordinal_ru)) for g in "mfn"]
    for r in df.select("n", *cols).collect():
        for g in "mfn":
            assert (r[f"c{g}"], r[f"o{g}"]) == (numbers.russian_words(r.n, g), numbers.russian_words(r.n, g, True))


def test_english_numbers_by_dictionary(spark):
    cases = [("Pages 7", "Pages seventh"), ("part 7", "part seven"), ("5-6 and 7", "five-6 and seven"), ("Chapter\n\n12", "Chapter\n\ntwelfth"), ("chapterx 3", "chapterx three"), ("DC-7", "DC seven")]
    assert said(numbers.normalize_numbers_en(texts(spark, [a for a, _ in cases]))) == [b for _, b in cases]
    own = dictionaries.overlay_nouns(dictionaries.noun_table(spark), spark.createDataFrame([("en", "Part", "m", "o", "part", ["parts"])], "lang string, noun string, gender string, form string, singular string, plurals array<string>"))
    assert said(numbers.normalize_numbers_en(texts(spark, ["parts 7"]), nouns=own)) == ["parts seventh"]
    assert said(numbers.roman_in_words(texts(spark, ["Volume II, I am", "IV acts", "x_IV part", "part XIV."]))) == ["Volume two, I am", "fourth acts", "x_IV part", "part fourteen."]


PROVIDERS = [("plain", False, True, False, False, 60), ("marked", True, False, False, False, 5000), ("cyrillic", False, True, True, True, 5000)]


def test_job_by_language_and_provider(spark):
    rows = [(0, "Mr. X has 3 FBI files.", "en", "plain"), (1, "ФСБ, 3 книги. Да.", "ru", "marked"), (2, "Глава II: FBI. Да.", "ru", "cyrillic"), (3, "Mr. X, 3", "de", "unknown"), (4, "page 3", "", "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, provider string")
    providers = spark.createDataFrame(PROVIDERS, prepare.PROVIDERS)
    lexicon = spark.createDataFrame([("Да.", "Д+а.")], "sentence string, stressed string")
    got = said(prepare.prepare_corpus(df, providers=providers, lexicon=lexicon))
    assert got == ["Mister X has three FBI files.", "эф эс б+э  3 книги. Да.", "Глава вторая: эф би ай. Д+а.", "Mr. X, three", "page third"]


def test_chunks_by_provider(spark):
    df = spark.createDataFrame([(0, "One sentence here. " * 20, "en", "plain"), (1, "Раз два. Three only. " * 20, "ru", "marked"), (2, "English text only.", "ru", "cyrillic")], "doc_id long, text string, lang string, provider string")
    got = prepare.chunk_job(df, providers=spark.createDataFrame(PROVIDERS, prepare.PROVIDERS)).collect()
    by = {i: [r.chunk for r in got if r.doc_id == i] for i in range(3)}
    assert by[0] and all(len(c.encode()) <= 60 and "<" not in c for c in by[0])
    assert by[1] and all(c.startswith("<speak>") and c.endswith("</speak>") for c in by[1]) and "<break" in by[1][0]
    assert by[2] == []


def test_merging_is_as_the_slow_version(spark):
    rng = random.Random(2)
    chunks = ["é" * rng.randrange(1, 60) for _ in range(3000)]
    slow, now = [], ""
    for c in chunks:
        if now and (len(now.encode()) + 1 + len(c.encode()) > 120 or len(now.encode()) >= 50):
            slow.append(now)
            now = c
        else:
            now = f"{now} {c}" if now else c
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(chunks)], "doc_id long, chunk_no long, chunk string")
    assert [r.chunk for r in segment.merge_small(rows, 50, 120).orderBy("chunk_no").collect()] == [*slow, now]


def test_parts_with_repeated_chapters(spark):
    rows = [(b, n, float(s)) for b in (1, 2) for n, s in ((1, 3000), (1, 3000), (2, 4000), (2, 100), (3, 9000), (3, 9000))] + [(None, 1, 10.0)]
    df = spark.createDataFrame(rows, "book_id long, chapter_no long, seconds double")
    got = estimate.pack_parts(df, 100)
    assert got.count() == len(rows)
    assert [r.part_no for r in got.where("book_id = 1").orderBy("chapter_no", "size").collect()] == [1, 1, 1, 2, 3, 4]


def test_ranks_and_retention(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab") * rng.randrange(1, 6) + str(i), rng.random() < 0.3, rng.random() < 0.8) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, name string, is_default boolean, enabled boolean")
    want = {i: n for n, (i, *_) in enumerate(sorted((r for r in rows if r[3]), key=lambda r: (not r[2], r[1])), 1)}
    assert {r.id: r["rank"] for r in jobs.ranked(df, "is_default", "name", descending=True).collect()} == want
    old = spark.createDataFrame([(1, "completed", 1), (2, "completed", 9), (3, "pending", 1)], "id int, status string, created_at int")
    assert jobs.retention_counts(old, F.lit(5)).first() == (2, 1) and jobs.retention(old, F.lit(5)).count() == 2


def test_genres_by_language(spark):
    names = spark.createDataFrame([("det_espionage", "ru", "Шпионский детектив"), ("det_espionage", "en", "Espionage")], "code string, lang string, name string")
    df = spark.createDataFrame([(1, "ru", ["det_espionage", "unknown_xyz"]), (2, "en", [" DET_ESPIONAGE ", "det_espionage"]), (3, "en", None)], "k int, lang string, v array<string>")
    assert {r.k: r.joined for r in estimate.join_names(df, "k", "v", "; ", names).collect()} == {1: "Шпионский детектив; unknown_xyz", 2: "Espionage", 3: ""}


def test_a_million_nouns_are_joined(spark):
    """The words of the bundled nouns do the same out of a table of a million."""
    rows = [(1, "Chapter 4 and page 12, item 7", "en"), (2, "Part IV of the second act, X pages, Ax II.", "en"), (3, "Chapter 4", "fr"), (4, None, "en"), (5, "no number", "en"), (6, "Chapter 4 and page 12, item 7", "en")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    kind = "lang string, noun string, gender string, form string, singular string, plurals array<string>"
    many = spark.range(1_000_000).select(F.lit("en").alias("lang"), F.concat(F.lit("noun-"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("noun"), F.lit("m").alias("gender"), F.lit("o").alias("form"), F.lit("").alias("singular"), F.array().cast("array<string>").alias("plurals"))
    nouns = spark.createDataFrame([(n.lang, n.noun, n.gender, n.form, n.singular, list(n.plurals)) for n in bundled.NOUNS if n.lang == "en"], kind).unionByName(many)
    for run in (numbers.normalize_numbers_en, numbers.roman_in_words, prepare.normalize_numbers):
        want = sorted(map(str, run(df).collect()))
        assert sorted(map(str, run(df, nouns=nouns).collect())) == want
    joined = numbers.normalize_numbers_en(spark.createDataFrame([("noun-bc 5",)], "text string"), nouns=nouns)
    assert joined.first().text == "noun-bc fifth"

