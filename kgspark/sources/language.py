"""The language of texts: their script, then the ranks of their frequent three-letter runs against those of each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kgspark.plans.lineage import ship_package

# The first article of the Universal Declaration of Human Rights, and the third of the languages that come most often (fixed values).
SAMPLES = {
    "ar": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء.",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona.",
    "fa": "تمام افراد بشر آزاد به دنیا می‌آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان هستند و باید نسبت به یکدیگر با روح برادری رفتار کنند.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחוה.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon.",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo indivíduo tem direito à vida, à liberdade e à segurança pessoal.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "sr": "Сва људска бића рађају се слободна и једнака у достојанству и правима. Она су обдарена разумом и свешћу и треба једни према другима да поступају у духу братства.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
}
#: Scripts by what a regular expression calls them, and the language of those that one language has to itself here.
SCRIPTS = {"Latin": None, "Cyrillic": None, "Arabic": None, "Greek": "el", "Hebrew": "he", "Devanagari": "hi", "Bengali": "bn", "Thai": "th", "Hangul": "ko", "Hiragana": "ja", "Katakana": "ja", "Han": "zh"}
#: Runs that make up a profile, and their length.
RUNS, RUN = 300, 3


def beyond_latin(text: Column) -> Column:
    """What a text has in scripts other than Latin: mostly nothing, so that these are looked for in little."""
    return F.regexp_replace(text, r"[\x00-\x7F\p{IsLatin}]+", "")


def script(text: Column, beyond: Column | None = None) -> Column:
    """The script of most letters of a text, the first of SCRIPTS of equals; null if it has none of them.

    Kana tell Japanese from Chinese: a text with more than one in ten Han characters' worth of them is Hiragana.
    ``beyond``: its ``beyond_latin``, in a column.
    """
    other = beyond_latin(text) if beyond is None else beyond
    count = lambda name: F.length(F.regexp_replace(text if name == "Latin" else other, f"[^\\p{{Is{name}}}]+", ""))
    counts = F.array(*[F.struct(count(name).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, name in enumerate(SCRIPTS)])
    return F.aggregate(
        counts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("kana"), F.lit(None).cast("string").alias("name")),
        lambda acc, x: F.struct(
            F.greatest(acc["n"], x["n"]).alias("n"),
            (acc["kana"] + F.when(x["name"].isin("Hiragana", "Katakana"), x["n"]).otherwise(0)).alias("kana"),
            F.when(x["n"] > acc["n"], x["name"]).otherwise(acc["name"]).alias("name"),
        ),
        lambda acc: F.when((acc["name"] == "Han") & (acc["kana"] * 10 > acc["n"]), F.lit("Hiragana")).otherwise(acc["name"]),
    )


def letters(text: Column) -> Column:
    """Lower-case words of letters with a space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


#: Characters that a task counts at once; a longer text comes alone.
STEP = 1 << 21
#: Bits of a character in a run that is kept as one number; numbers are in the order of the runs.
_BITS = 21


def _runs(texts: pa.Array):
    """The runs of each text as numbers."""
    sizes = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
        joined = "".join(t or "" for t in texts.slice(at, upto - at).to_pylist())
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        keys = (chars[:-2] << 2 * _BITS) | (chars[1:-1] << _BITS) | chars[2:]
        for k in range(at, upto):
            start = ends[k] - ends[at]
            yield keys[start : max(start, start + sizes[k] - RUN + 1)]
        at = upto


def _spelled(keys: np.ndarray) -> list[str]:
    mask = (1 << _BITS) - 1
    out = np.stack([keys >> 2 * _BITS, keys >> _BITS & mask, keys & mask], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [out[i : i + RUN] for i in range(0, len(out), RUN)]


def _number(run: str) -> int:
    a, b, c = map(ord, run)
    return a << 2 * _BITS | b << _BITS | c


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """by, run, rank: the RUNS most frequent runs of letters in all texts of each ``by``, ties in their own order.

    Each batch is counted where it lies; only its counts are shuffled.
    """
    ship_package(rows.sparkSession)

    def counts_of(values: pa.Array, found: dict[int, list]):
        for k, keys in found.items():
            distinct, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([values.take(pa.array([k] * len(distinct), pa.int32())), pa.array(_spelled(distinct), pa.string()), pa.array(n.astype(np.int64))], names=[by, "run", "count"])

    def run(batches):
        for batch in batches:
            coded = pc.dictionary_encode(batch.column("by"), null_encoding="encode")
            found: dict[int, list] = {}
            held = 0
            for k, keys in zip(coded.indices.to_pylist(), _runs(batch.column("text")), strict=True):
                if held and held + len(keys) > STEP:
                    yield from counts_of(coded.dictionary, found)
                    found, held = {}, 0
                found.setdefault(k, []).append(keys)
                held += len(keys)
            yield from counts_of(coded.dictionary, found)

    kind = rows.schema[by].dataType.simpleString()
    counted = rows.select(F.col(by).alias("by"), letters(F.col("text")).alias("text")).mapInArrow(run, f"`{by}` {kind}, run string, count long")
    counts = counted.groupBy(by, "run").agg(F.sum("count").alias("count"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("count").desc(), F.col("run")))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= RUNS).select(by, "run", "rank")


def profiles(labelled: DataFrame) -> DataFrame:
    """lang, run, rank of labelled texts (lang, text): RUNS rows a language."""
    return ranked(labelled.filter("lang IS NOT NULL AND text IS NOT NULL"), "lang")


def sample_profiles(spark: SparkSession) -> DataFrame:
    """Profiles of the languages of SAMPLES."""
    return profiles(spark.createDataFrame(list(SAMPLES.items()), "lang string, text string"))


class _Profiles:
    """Profiles as arrays: each run's number, and the languages that have it with its rank in them."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        rows = sorted((_number(run), lang, rank) for lang, run, rank in rows if run is not None and len(run) == RUN and lang is not None)
        # languages are compared as their bytes
        self.languages = sorted({lang for _, lang, _ in rows}, key=str.encode)
        place = {lang: k for k, lang in enumerate(self.languages)}
        self.runs, starts = np.unique(np.array([n for n, _, _ in rows], np.int64), return_index=True)
        self.starts = np.append(starts, len(rows)).astype(np.int64)
        self.lang = np.array([place[lang] for _, lang, _ in rows], np.int64)
        self.rank = np.array([rank for _, _, rank in rows], np.int64)

    def nearest(self, texts: pa.Array) -> tuple[list, list]:
        """The language and the lead of each text; none where no run of a profile is among its own."""
        found, lead = [None] * len(texts), [None] * len(texts)
        if not len(self.runs):
            return found, lead
        for k, keys in enumerate(_runs(texts)):
            distinct, n = np.unique(keys, return_counts=True)
            first = np.argsort(-n, kind="stable")[:RUNS]
            top = distinct[first]
            at = np.minimum(np.searchsorted(self.runs, top), len(self.runs) - 1)
            hit = np.flatnonzero(self.runs[at] == top)
            many = self.starts[at[hit] + 1] - self.starts[at[hit]]
            if not len(hit):
                continue
            entry = np.arange(many.sum()) + np.repeat(self.starts[at[hit]] - np.cumsum(many) + many, many)
            near = np.bincount(self.lang[entry], RUNS - np.minimum(np.abs(np.repeat(hit + 1, many) - self.rank[entry]), RUNS), len(self.languages))
            best = int(np.argmax(near))  # the first of equals
            if near[best] > 0:
                found[k] = self.languages[best]
                most, near[best] = near[best], 0
                lead[k] = float((most - near.max()) / most)
        return found, lead


def detected(rows: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """``rows`` with lang, script and confidence of a text column, by profiles (lang, run, rank; RUNS rows a language).

    Each frequent run of a text counts the more, the nearer its rank is to its rank in the language's profile.  The
    language with the largest sum is it; confidence is the sum's lead over the next one's, as a share of it.  A script
    with one language decides by itself, with confidence 1.  Texts without letters, or without a run of any profile, have
    neither language nor confidence.  Rows stay where they lie: nothing is shuffled.
    """
    ship_package(rows.sparkSession)
    profiles = _Profiles([(r["lang"], r["run"], r["rank"]) for r in known.select("lang", "run", "rank").collect()])
    body = F.coalesce(F.col(text), F.lit(""))
    told = rows.withColumn("__beyond", beyond_latin(body)).withColumn("script", script(body, F.col("__beyond"))).drop("__beyond")
    alone = F.coalesce(*[F.when(F.col("script") == s, F.lit(x)) for s, x in SCRIPTS.items() if x])
    told = told.withColumn("lang", alone)
    told = told.withColumn("__letters", F.when(F.col("script").isNotNull() & F.col("lang").isNull(), letters(body)))
    names = [*rows.columns, "lang", "script", "confidence"]

    def run(batches):
        for batch in batches:
            asked = batch.column("__letters")
            found, lead = profiles.nearest(asked)
            single = batch.column("lang")
            lang = pc.coalesce(single, pa.array(found, single.type))
            confidence = pc.if_else(single.is_valid(), pa.scalar(1.0), pa.array(lead, pa.float64()))
            got = {"lang": lang, "confidence": confidence}
            yield pa.RecordBatch.from_arrays([got.get(c, batch.column(c) if c not in got else None) for c in names], names=names)

    schema = told.select(*rows.columns, "lang", "script").schema.add("confidence", "double")
    return told.select(*rows.columns, "lang", "script", "__letters").mapInArrow(run, schema)


def detect(docs: DataFrame, known: DataFrame) -> DataFrame:
    """id, lang, script, confidence of documents (id, text) by profiles, as ``detected`` tells them."""
    rows = docs.select("id", F.col("text").alias("__text"))
    return detected(rows, "__text", known).select("id", "lang", "script", "confidence")
