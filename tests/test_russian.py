import pytest
from pyspark.sql import functions as F

from lectern.operators import russian
from lectern.operators.numbers import ordinal_ru

NOUNS = {"глава": ("f", "o"), "рублей": ("m", "c"), "рубля": ("m", "c")}

CASES = [
    ("2 книги", "две книги"),
    ("глава 3", "глава третья"),
    ("25 марта", "двадцать пятого марта"),
    ("1996 года", "одна тысяча девятьсот девяносто шестого года"),
    ("в 1996 году", "в одна тысяча девятьсот девяносто шестом году"),
    ("1996 год", "одна тысяча девятьсот девяносто шестой год"),
    ("6-16 августа", "шестого, тире, шестнадцатого августа"),
    ("1968 г. р.", "одна тысяча девятьсот шестьдесят восьмого года рождения"),
    ("в 23:50.", "в двадцать три пятьдесят."),
    ("90-х и 2000-х", "девяностых и двухтысячных"),
    ("1996-го", "одна тысяча девятьсот девяносто шестого"),
    ("3-я", "третья"),
    ("Ту-154", "Ту сто пятьдесят четыре"),
    ("-5", "минус пять"),
    ("гг.", "годов"),
    ("нет чисел", "нет чисел"),
    ("", ""),
]


def test_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    got = [r.text for r in russian.normalize_numbers_ru(df, nouns=NOUNS).orderBy("i").collect()]
    assert got == [w for _, w in CASES]


@pytest.mark.parametrize("n,gender,case,want", [(8, "m", "genitive", "восьмого"), (3, "m", "genitive", "третьего"), (3, "m", "dative", "третьему"), (1, "f", "genitive", "первой"), (1, "f", "accusative", "первую"), (5, "n", "genitive", "пятого"), (40, "m", "prepositional", "сороковом"), (5, "m", "accusative", "пятый")])
def test_inflection(spark, n, gender, case, want):
    got = spark.range(1).select(russian.inflect(ordinal_ru(F.lit(n).cast("long"), gender), case, gender)).first()[0]
    assert got == want
