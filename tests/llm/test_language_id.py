import random
import zlib

from pyspark.sql import functions as F

from corpus_pipeline import GAIN, MARGIN
from terrasift.llm import language_id

DE = "der und die das nicht mit schon einer über für wird auch haben keine straße groß"
EN = "the and that with have this from they which would there their about into over"


def rows():
    out = []
    for i in range(120):
        lang, w = (("de", DE.split()), ("en", EN.split()))[i % 2]
        out.append((i, " ".join(w[(i * 7 + k * (i % 5 + 1)) % len(w)] for k in range(30)), lang))
    return out


def test_held_out_accuracy_and_rejection(spark):
    data = [*rows(), (900, None, "de"), (901, "123 4!", "en"), (902, "", None), (None, "und die das nicht", "de")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit(df, texts=40)
    assert set(model.dictionaries) == {"de", "en"}
    got = language_id.identify(df.withColumn("score", language_id.held_out()), model).collect()
    assert len(got) == len(data)
    for r in got:
        assert 0 <= r.language.score <= 1
        if r.doc_id in (900, 901, 902):
            assert r.language.lang == "und"
        elif r.doc_id is not None:
            assert r.language.lang == r.lang
            assert r.score == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.language.lang for r in language_id.identify(df, model, margin=0.99).collect()} == {"und"}


def test_a_language_of_copies_is_learned(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    copies = spark.range(1000, 201000).select(F.col("id").alias("doc_id"), F.lit("und die das nicht").alias("text"), F.lit("de").alias("lang"))
    model = language_id.fit(df.unionByName(copies), texts=40)
    assert list(model.dictionaries) == ["de", "en"]
    for lang in ("de", "en"):
        own = {t.lower() for i, t, x in rows() if x == lang and zlib.crc32(str(i).encode()) % 5}
        assert sum(t in model.dictionaries[lang].decode() for t in own) >= min(39, len(own))
    got = language_id.identify(df, model).collect()
    assert all(r.language.lang == r.lang for r in got)


def test_held_out_accuracy_on_the_table(spark):
    """Labelled texts that nothing was learned from; what the pipeline's margin rejects is short or no prose."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).filter(language_id.held_out() & F.col("lang").isNotNull()).collect()
    right = [r for r in got if r.language.lang == r.lang]
    assert len(got) > 100 and len(right) >= 0.98 * len(got)
    prose = [r for r in right if len(r.text) >= 200 and len(set(r.text.split())) > 30 and r.text.upper() != r.text]
    assert len(prose) > 80 and all(r.language.score >= MARGIN for r in prose)


def test_other_scripts_are_rejected_by_the_margin(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = language_id.fit(df, texts=40)
    for text in ("Привет мир это русский текст", "こんにちは世界 これは日本語の文章です"):
        assert model.predict(text * 5)[1] < MARGIN
    assert model.predict(" ".join(DE.split()[:12]))[1] >= MARGIN


UNLEARNED = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swojej osoby.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokaisella on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.",
}


def test_unlearned_languages_are_rejected(spark):
    """Of texts in four other languages 95 % go, of rightly told ones of a hundred characters or more one in a hundred at most."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit(docs)
    r = random.Random(5)
    other = [" ".join(r.choices(text.split(), k=k)) for text in UNLEARNED.values() for k in (20, 40, 80, 160) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in other], "text string")
    told = [x.language.lang for x in language_id.identify(df, model, MARGIN, gain=GAIN).collect()]
    assert told.count("und") >= 0.95 * len(told)
    own = docs.filter(language_id.held_out() & (F.length("text") >= 100))
    right = language_id.identify(own, model).filter("language.lang = lang")
    kept = language_id.identify(own, model, MARGIN, gain=GAIN).filter("language.lang = lang")
    n = right.count()
    assert n > 1500 and kept.count() >= 0.99 * n


def test_parts_of_whole_texts_are_learned(spark):
    """A text longer than a part counts to its end."""
    long_ = "x" * 30 + " " + " ".join(f"w{i:04}" for i in range(400))
    df = spark.createDataFrame([(k, long_, "en") for k in range(1, 9)], "doc_id long, text string, lang string")
    d = language_id.fit(df, texts=50, chars=100).dictionaries["en"].decode()
    assert all(f"w{i:04}"[:3] in d for i in range(400)) and "w0399" in d
    assert len(d) < len(long_) + 60


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    model = language_id.fit(df.limit(0))
    assert [r.language.lang for r in language_id.identify(df, model).collect()] == ["und"]
    assert language_id.identify(df.limit(0), model).count() == 0
