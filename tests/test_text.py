"""Text steps: what goes in and what comes out."""

import pytest
from pyspark.sql import functions as F

from gable.functions import text as T

PAIRS = {
    T.without_price_sentences: [("Дом 5 км. Цена 5 млн! Торг уместен. 300 руб. в месяц", "Дом 5 км. Торг уместен. в месяц"), ("Хорошая цена. Рядом лес", "Хорошая цена. Рядом лес"), ("3 миллиона. 4 миллионов. 5 минут", "5 минут")],
    T.strip_emoji: [("Дом 😀 у леса→ ✂️", "Дом  у леса "), ("№5 ®", "№5 ®")],
    T.line_punctuation: [("Есть:\nсвет\r\nвода!", "Есть:. свет. вода!"), ("a\\nb", "a b."), ("", ".")],
    T.normalize_punctuation: [("a(b)c", "a ( b ) c"), ("wi-fi!?", "wi - fi."), ("a_b|c", "a b c"), ("x...y,,z", "x.y,z"), ("a5b", "a 5 b"), ("m//s", "m/s"), ("a;b", "a; b"), ("?.", ".")],
    T.normalize_numbers: [
        ("1 000 000 руб", "1000000 руб"), ("1,5 млн", "1.5 млн"), ("12.345.678", "12345678"), ("1 500 000,50", "1500000.50"), ("5 12", "5 12"), ("2024 100", "2024 100"), ("1,234", "1234"),
        ("место 55,749033, 38,328731, лес", "место 55.749033, 38.328731, лес"), ("55°30'0\"N, 37°15'0\"W", "55.5, -37.25"), ("да!!", "да."), ("а,,б..", "а,б."),
    ],
    T.symbol_words: [("5%, да", "5 процент, да"), ("№5", "номер 5"), ("тел №5", "тел номер 5"), ("±3", "примерно 3"), ("5 $", "5 доллар"), ("a=b", "a равноb"), ("6×8", "6 на8")],
    T.square_metres: [("50 кв.м дом", "50 м² дом"), ("50кв м, дом", "50м², дом"), ("50 м2.", "50 м²."), ("50 кв. метров", "50 м² метров"), ("м2 без", "м2 без")],
    T.expand_abbreviations: [
        ("садового некоммерческого товарищества Лесное", "снт Лесное"), ("Московской кольцевой автомобильной дороги нет, московской кольцевой автомобильной дороги", "Московской кольцевой автомобильной дороги нет, мкад"),
        ("постоянное место жительства", "пмж"), ("рядом ж/д и ж.б, мат. капитал", "рядом железнодорожный и железобетонный, материнский капитал"), ("ул Лесная, р-н Южный, с.н.т", "улица Лесная, район Южный, снт"),
        ("в г Клин, у р. Волга", "в город Клин, у река. Волга"), ("2020 г дом", "2020 г дом"), ("кв д. 5", "кв дом 5"), ("у д. тихо", "у деревня тихо"), ("с/у и санузла, сан узел", "санузел и санузел, санузел"), ("стол", "стол"),
    ],
    T.dimensions: [("6x8", "6 на 8"), ("6х8х3 дом", "6 на 8 на 3 дом"), ("6 метров * 8.5", "6 на 8.5"), ("a x b", "a x b")],
    T.expand_units: [("5 км", "5  километр"), ("10 сот.", "10  сотка."), ("5м3", "5 кубический метр"), ("220в.", "220 вольт"), ("2 т.р", "2  тысяча рублей"), ("час", "час")],
    T.ordinals: [("2-й этаж", "второй этаж"), ("3 го", "третьего"), ("10-ый", "десятый"), ("1-ыми", "первыми"), ("2-мя", "вторым"), ("двум", "второму"), ("11-й", "11-й"), ("5-ом", "пятом")],
    T.amount_words: [("1.5 млн", "1500000"), ("2 тыс. руб", "2000"), ("3 тысячи", "3000"), ("7к", "7000"), ("2 миллиона", "2000000"), ("0.0005 тыс", "0.5"), ("5 метров", "5 метров")],
    T.final_clean: [("«Дом» (новый)!", "Дом новый!"), ("5м", "5 м"), ("м5", "м 5"), ("да.,!нет", "да. нет"), ("1.5 и 2,5", "1.5 и 2, 5"), ("a+b", "a плюс b"), ("а/б*в", "а б в"), ("слово .", "слово."), ("тёплый-дом", "тёплыйдом")],
}


@pytest.mark.parametrize("step", list(PAIRS), ids=lambda s: s.__name__)
def test_steps(spark, step):
    rows = spark.createDataFrame(PAIRS[step], "t string, want string").select("t", "want", step(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]
    assert spark.createDataFrame([(None,)], "t string").select(step(F.col("t"))).first()[0] in (None, "")


def test_pipeline_switches(spark):
    df = spark.createDataFrame([("Дом у р. Клязьма 6x8. Цена 5 млн!",)], "t string")
    one = lambda **k: df.select(T.process(F.col("t"), **k)).first()[0]
    assert one(prices=False, clean=False) == "Дом у р. Клязьма 6x8. Цена 5 млн!"
    assert one(clean=False) == "Дом у р. Клязьма 6x8."
    assert "на 8" in one() and "Цена" in one(prices=False) and " у " not in one(stop=True) and "." not in one(punctuation=True)


def test_long_corpora_are_learned_by_several_tasks(spark):
    from gable.operators.vectors import word_vectors

    rows = [(i, f"red apple sweet juice tree {'blue ocean salty water ship' if i % 2 else ''} word{chr(97 + i % 20)} " * 3) for i in range(400)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    letters = sum(len(t or "") for _, t in rows)
    for share, tasks in ((letters, 1), (letters - 1, 2), (-(-letters // 4), 4)):
        model, words = word_vectors(df, "t", share=share)
        assert model.getNumPartitions() == tasks
        vocabulary = {r["word"] for r in model.getVectors().collect()}
        assert {"red", "apple", "ocean", "worda"} <= vocabulary and words.count() == len(rows)


def test_frequent_terms_are_those_of_all_counts(spark, monkeypatch):
    """Bounds that the most frequent terms break: the search goes on until enough are left, or all terms are seen."""
    from gable.operators import vectors as V

    rows = [(i, "common " * 9 + "twice " * (i == 3) * 50 + " ".join(f"w{chr(97 + (i * j) % 26)}{chr(97 + j % 7)}" for j in range(1 + i % 30))) for i in range(200)] + [(5, "again wab"), (-1, None)]
    # 300 words of one text each, more frequent than all others
    rows += [(1000 + i, f"x{chr(97 + i // 26)}{chr(97 + i % 26)} " * 300) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t string")
    n = df.count()
    for low, high, bounds in ((1, 2, (2, 0.3, 20)), (1, 1, (2, 1.0, 5)), (1, 2, (3, 0.5, 100_000))):
        whole = V.term_counts(df, "id", "t", low, high)
        asked = []
        monkeypatch.setattr(V, "written", lambda d: asked.append(d.columns) or d.cache())
        few = V.top_term_counts(df, "id", "t", low, high, n, *bounds)
        assert len(asked) == 2 if bounds[2] > 1000 else len(asked) > 2
        weights = lambda c: sorted(V.tfidf_apply(c, V.tfidf_fit(c, n, *bounds), "id", False, "l1").collect())  # noqa: E731, B023
        a, b = weights(few), weights(whole)
        assert [x[:2] for x in a] == [x[:2] for x in b] and all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(a, b)) and a
    spark.catalog.clearCache()
