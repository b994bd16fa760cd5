"""Languages and encodings of texts that no profile was made from, and round trips of many encodings."""

import unicodedata

import pytest

from kgspark.sources import charset, documents, language

SENTENCES = {
    "en": "This is the house that was built for them and not for us.", "de": "Das ist nicht das Haus, in dem wir mit den Kindern gewohnt haben.", "fr": "Elle est déjà à la maison avec nous et les enfants qui jouent.",
    "es": "Los niños no quieren que la casa de su madre esté cerca de la ciudad.", "it": "Questa non è la casa in cui gli amici della donna hanno vissuto.", "pt": "Não sei se todas as pessoas nascem livres em dignidade, mas devem agir com consciência.",
    "nl": "Het huis waarin wij met onze kinderen gewoond hebben is niet meer van ons.", "pl": "Nie wiem, czy wszyscy ludzie w tym kraju są wolni i szczęśliwi.", "ru": "Они не знают, что все люди в городе должны работать вместе.",
    "uk": "Вони не знають, що всі люди у своїй країні повинні діяти разом.", "el": "Δεν ξέρω αν το σπίτι είναι κοντά στην πόλη.", "he": "הבית של הילדים קרוב לעיר הגדולה.", "ko": "아이들은 집에서 놀고 있습니다.", "ja": "子供たちは家で遊んでいます。",
    "zh": "孩子们在家里玩。", "th": "เด็ก ๆ กำลังเล่นอยู่ที่บ้าน", "ar": "الأطفال يلعبون في البيت مع جميع الناس.", "tr": "Çocuklar evde annelerine karşı iyi hareket etmelidirler.", "fi": "Kaikki lapset ovat vapaina ja heidän on oltava kotona.",
}


def test_languages(spark):
    rows = [*SENTENCES.items(), ("none", ""), ("digits", "12345 !?"), ("null", None), ("unknown", "qqq xxx zzz")]
    got = {r.id: r for r in language.detect(spark.createDataFrame(rows, "id string, text string"), language.sample_profiles(spark)).collect()}
    assert len(got) == len(rows)
    assert {k: got[k].lang for k in SENTENCES} == {k: k for k in SENTENCES}
    assert all(0 < got[k].confidence <= 1 for k in SENTENCES)
    assert [got[k].lang for k in ("none", "digits", "null", "unknown")] == [None] * 4 and got["unknown"].script == "Latin" and got["none"].script is None
    assert {got[k].script for k in ("ru", "uk")} == {"Cyrillic"} and got["ja"].script == "Hiragana" and got["zh"].script == "Han"


def test_profiles_of_a_labelled_table_tell_its_languages(spark, sf):
    """Half of the labelled documents make the profiles, the others are judged by them, and by those of the samples."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang IS NOT NULL AND length(text) >= 100").selectExpr("doc_id AS id", "lang", "text")
    held = docs.filter("id % 2 = 1")
    for known, least in ((language.profiles(docs.filter("id % 2 = 0")), 0.95), (language.sample_profiles(spark), 0.7)):
        found = held.select("id", "lang").join(language.detect(held.select("id", "text"), known).withColumnRenamed("lang", "told"), "id")
        right = found.selectExpr("avg(CAST(lang <=> told AS INT))").first()[0]
        print("languages told right:", right)
        assert right >= least


CODECS = [
    ("ru", "windows-1251"), ("uk", "windows-1251"), ("bg", "windows-1251"), ("ru", "koi8-r"), ("ru", "iso-8859-5"), ("ru", "ibm866"), ("pl", "windows-1250"), ("cs", "windows-1250"), ("pl", "iso-8859-2"),
    ("el", "windows-1253"), ("tr", "windows-1254"), ("he", "windows-1255"), ("ar", "windows-1256"), ("th", "windows-874"), ("fr", "windows-1252"), ("de", "windows-1252"), ("es", "windows-1252"), ("sv", "windows-1252"),
    ("ja", "shift_jis"), ("ja", "euc-jp"), ("ja", "iso-2022-jp"), ("ko", "euc-kr"), ("zh", "gb18030"), ("vi", "utf-8"), ("en", "utf-8"),
]


@pytest.mark.parametrize("lang, encoding", CODECS)
def test_round_trips(lang, encoding):
    body = language.SAMPLES[lang]
    got = charset.decode(body.encode(charset._CODECS.get(encoding, encoding)))
    assert got == (unicodedata.normalize("NFC", body), encoding, False, False)
    if lang in SENTENCES and encoding not in ("iso-2022-jp",):
        other = SENTENCES[lang]
        assert charset.decode(other.encode(charset._CODECS.get(encoding, encoding))).text == unicodedata.normalize("NFC", other)


def test_traditional_chinese_and_marks():
    body = "我們的國家在這個時候要為大家說出來,你們可以到那裡去看他,不過這是以後的事了。"
    assert charset.decode(body.encode("big5")).encoding == "big5" and charset.decode(body.encode("big5")).text == body
    assert charset.decode(b"\xff\xfe" + "héllo".encode("utf-16-le")) == ("héllo", "utf-16-le", True, False)
    assert charset.decode(b"\xfe\xff" + "héllo".encode("utf-16-be"))[:2] == ("héllo", "utf-16-be")
    assert charset.decode(b"\xef\xbb\xbfcafe\xcc\x81") == ("caf\u00e9", "utf-8", True, False)
    assert charset.decode(b"") == ("", "utf-8", False, False)
    assert charset.decode(b"na\xefve r\xe9sum\xe9")[:2] == ("naïve résumé", "windows-1252")
    assert charset.decode(b"\xef\xbb\xbf\xff").lossy
    cut = ("é" * 40_000).encode()
    assert charset.decode(cut).text == "é" * 40_000  # the head ends inside no character's reading


def test_words_repeated_and_of_two_languages_read_as_the_commonest_encoding():
    repeated = "Le Le Le eux eux eux aiquement " + "Ê " * 9
    mixed = "Étion en ench èanier, vi èenaioi èenque éçaux. Ciónasasta ciónuellí íquega ciónqueue íll ciónosarco."
    for body in (repeated, mixed):
        assert charset.decode(body.encode("windows-1252"))[:2] == (body, "windows-1252")


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(SENTENCES["ru"].encode("koi8-r"))
    (tmp_path / "b.MD").write_bytes(SENTENCES["fr"].encode("windows-1252"))
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {r.name: (r.body, r.encoding, r.lang, r.is_binary) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": (SENTENCES["ru"], "koi8-r", "ru", False), "b": (SENTENCES["fr"], "windows-1252", "fr", False)}
