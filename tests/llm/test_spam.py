import random

from pyspark.sql import functions as F

from tramline.llm import spam
from tramline.llm import spamlines

#: Words of speech as curves of prose would give them.
SPEECH = frozenset(
    """a about again all and are at be been before but by can can't come do every find for full get go have he here how i i'll if in is it just know let lost me mean more my never no not of off on one open
    or said sell she should that the them there they to told until us wait wanted was we we'll we're were what when where which who why will with would you your
    demasiado es no por para que last met called site""".split()
)


def classify(line):
    return spamlines.classify(line, SPEECH)


def spam_share(text):
    return spamlines.spam_share(text, SPEECH)

CUE = "{}\n00:00:{:02d},000 --> 00:00:{:02d},900\n{}\n\n"


def page(lines):
    return "".join(CUE.format(i + 1, i % 60, i % 60, x) for i, x in enumerate(lines))


def test_lines():
    assert classify("https://shop.test/p/1") == "link" == classify("hxxp://shop dot invalid/?q=cheap+shoes") == classify("www[.]shop[.]test") == classify("cheap shoes: shop.example/x")
    assert classify('<a href="shop.example/">cheap shoes</a> <a href="x.test">fast loan</a>') == "link" == classify("[url=http://a.test]fast loan[/url]") == classify("» [fast loan](http://a.test/)")
    assert classify("#CheapShoes #FastLoan #HotelCoupons") == "tags"
    assert classify("new, red, 7GB, sale -40%, cheap shoes") == "goods" == classify("Zorvik lamp green 288,00 €") == classify("Zorvik lamp | black | XL | SKU 58948 | 117.99")
    assert classify("cheap shoes; cheap shoes Tanor; fast loan; CHEAP SHOES; old cheap shoes") == "list" == classify("cheap shoes cheap shoes Tanor fast loan cheap shoes fast loan")
    for speech in ("I never wanted to sell the quiet ship.", "Tanor, shop.test?", "No, es demasiado viejo.", "If they sell the hotel coupons, we'll lose the lamp.", "Get the full season at https://shop.test", "♪ captain, captain, captain, captain ♪", "Subtitles by Fen & Tor for www.shop.test"):
        assert classify(speech) in ("speech", "item"), speech


def test_shares():
    assert spam_share(None) == spam_share("") == spam_share(" \n\t") == spam_share("1\n00:00:01,000 --> 00:00:02,000\n\n") == 0.0
    assert spam_share(page(["cheap shoes | fast loan | cheap shoes | diet pills | cheap shoes"] * 9)) > 0.9
    assert spam_share("cheap shoes\nfast loan\ncheap shoes\nCHEAP SHOES\ncheap shoes Tanor\nold cheap shoes\ncheap shoes\nfast loan") > 0.9
    assert spam_share(page(["Whistle.", "Whistle. Whistle!", "Whistle, Tanor.", "40... quiet..."] * 9)) < 0.1
    assert spam_share(page(["We have to go, Tanor.", "https://a.test/p/1", "What do you mean, quiet?", "I never wanted to sell it."] * 5)) < 0.5
    assert spam_share("x" * 2_000_000) == 0.0


def _names(n, rng):
    return ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n)]


def test_lists_of_many_words():
    """A list stays a list with more different words."""
    rng = random.Random(9)
    for n in (12, 40, 400):
        words = sorted(set(_names(n, rng)))
        phrases = [" ".join(rng.sample(words, rng.randint(2, 5))) for _ in range(max(60, n))]
        assert spam_share("\n".join(phrases)) > 0.9 < spam_share(page(phrases)), n
        if n > 12:
            assert spam_share("\n".join(words)) > 0.9 < spam_share(page(words)), n
    talk = [x for w in _names(40, rng) for x in (f"Open the {w}.", f"{w.title()}, quick!", f"- {w} soup", f"we lost {w}")]
    assert spam_share(page(talk)) < 0.1
    assert spam_share(page(["window", "window", "roof", "roof roof", "window", "curtain window"] * 9)) < 0.1


def test_bare_domains():
    """Addresses are known by their structure, whatever the last label."""
    for site in ("shop.de", "x.ru", "y.co.kr", "z.io", "SHOP.DE", "flimra.exarnple", "quarnet.invahd", "pelmor.exarnpIe", "lampen-24.shop/p/1", "cheap shoes: a1.es", "a.fr | b.pl | c.co.uk"):
        assert classify(site) == "link", site
    assert spam_share(page([f"{w}.{t}" for i, w in enumerate(_names(60, random.Random(1))) for t in [("de", "ru", "co.kr", "io")[i % 4]]])) == 1.0
    for speech in ("Wait.What is it?", "Hola.que tal", "no.no", "Mr.Smith", "at 5 p.m.", "3.5kg", "Ph.D", "Wait... what", "z.B. morgen", "Tanor, shop.de?", "We met them on shop.de last year", "The site is called shop.de"):
        assert classify(speech) != "link", speech


def test_found_on_spark(spark):
    rng = random.Random(6)
    nouns = "ship lamp river key garden train map coat door mill".split()
    talk = lambda: page([f"{rng.choice(['I never wanted to', 'We have to', 'Why would you'])} {rng.choice(['sell', 'find', 'open'])} the {rng.choice(nouns)} {rng.choice(['before sunset', 'in the yard', 'for three days'])}." for _ in range(rng.randint(20, 60))])
    junk = lambda: page(["; ".join(rng.choice(["cheap shoes", "fast loan", "cheap shoes Tanor"]) for _ in range(7)) for _ in range(20)])
    links = lambda: "\n".join(f"http://{rng.choice(nouns)}{i}.test/p/{rng.randint(1, 9999)}" for i in range(60))
    rows = [(i, talk(), rng.choice(["en", None]), "c") for i in range(300)] + [(1000 + i, junk(), "en", "c") for i in range(6)] + [(2000 + i, links(), None, "c") for i in range(4)]
    rows += [(3000, None, "en", "c"), (3001, "", "en", "c"), (3002, "  \n", None, "c"), (3003, "no", "en", "c"), (3004, rows[300][1], "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string").withColumn("share", F.lit("clash"))
    spammed = {*range(1000, 1006), *range(2000, 2004), 3004}
    flags = {r.doc_id for r in spam.flagged(df).collect()}
    assert spammed <= flags and len(flags) < 200
    assert {r.doc_id for r in spam.found(df).collect()} == spammed
    assert spam.found(df.limit(0)).count() == 0 == spam.flagged(df.limit(0)).count()


def test_norm_is_prose(spark):
    """Nine tenths of a cell are copies of one spam page, and a length has no prose at all."""
    rng = random.Random(3)
    talk = lambda n: page([f"I never wanted to {rng.choice(['sell', 'find', 'open'])} the {rng.choice('ship lamp river key garden'.split())} before {rng.choice(['sunset', 'we go'])}." for _ in range(n)])
    junk = lambda n: page(["; ".join(rng.choice(["cheap shoes", "fast loan", "cheap shoes Tanor"]) for _ in range(7)) for _ in range(n)])
    rows = [(i, talk(30), "xx") for i in range(40)] + [(1000 + i, t, "xx") for t in [junk(20)] for i in range(360)] + [(2000 + i, t, "xx") for t in [junk(90)] for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spammed = {*range(1000, 1360), *range(2000, 2040)}
    assert spammed <= {r.doc_id for r in spam.flagged(df).collect()}
    assert {r.doc_id for r in spam.found(df).collect()} == spammed


POLISH = [
    ["Nie wiem, co robić.", "Chodź tutaj, chodź tutaj, szybko!", "Gdzie jest moja czapka?", "Nie wiem, nie wiem, nie wiem.", "Musimy iść do domu."],
    ["Słuchaj, słuchaj, słuchaj, co mówi babcia.", "Dobrze, dobrze, już idę.", "Kto zamknął okno w kuchni?", "Wczoraj było otwarte.", "To chyba wiatr."],
    ["Tak, tak, tak, tak, tak.", "Nie, nie, nie, nie, nie.", "Proszę, zostań z nami na kolację.", "Mama upiekła ciasto ze śliwkami.", "Dziękuję, ale muszę wracać."],
]
DUTCH = [
    ["Ik weet het niet.", "Kom hier, kom hier, vlug!", "Waar is mijn hoed gebleven?", "Nee, nee, nee, dat wil ik niet.", "We moeten nu naar huis gaan."],
    ["Luister, luister, luister, luister nou eens.", "Goed, goed, goed, ik kom al.", "Wie heeft het raam dichtgedaan?", "Gisteren stond het nog open.", "Dat was de wind, denk ik."],
]


def test_other_languages_and_the_curves_part(spark):
    """Dialogue without prose of its own language isn't spam, lists of links are; without flags by curves nothing is found."""
    rng = random.Random(4)
    verbs, nouns = ["sell", "find", "open", "lift", "paint", "mend"], "ship lamp river key garden train map coat door mill window candle".split()
    talk = lambda: page([f"{rng.choice(['I never wanted to', 'We have to', 'Why would you', 'She told me to'])} {rng.choice(verbs)} the {rng.choice(nouns)} {rng.choice(['before sunset', 'in the yard', 'for three days'])}." for _ in range(rng.randint(4, 40))])
    rows = [(i, talk(), "en") for i in range(400)] + [(1000 + i, page(p), lang) for lang, ps in (("pl", POLISH), ("nl", DUTCH), (None, POLISH)) for i, p in enumerate(ps, {"pl": 0, "nl": 10, None: 20}[lang])]
    rows += [(1100, page(sum(POLISH, []) * 3), "pl"), (1200, "\n".join(f"http://sklep{i}.test/tanie-buty" for i in range(30)), "pl"), (1201, page(["tanie buty; szybka pożyczka; tanie buty Tanor; TANIE BUTY; tanie buty; tanie buty"] * 12), "pl")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in spam.found(df).collect()} == {1200, 1201}
    kept = spam.FAR, spam.FAR_SHAPE, spam.FAR_UNKNOWN
    spam.FAR = spam.FAR_SHAPE = spam.FAR_UNKNOWN = 1e9
    try:
        assert spam.found(df).count() == 0
    finally:
        spam.FAR, spam.FAR_SHAPE, spam.FAR_UNKNOWN = kept


def test_long_parts():
    for n in (20, 700, 100_000):
        assert classify(f'<a href="shop.test/{"x" * n}">cheap shoes</a>') == "link" == classify("https://shop.test/" + "x" * n) == classify(f"[url=http://a.test/{'y' * n}]fast loan[/url]") == classify(f"[{'z' * n}](http://a.test)")
    for unit in ("<a ", "[url ", "[x](", "www", "http://", "a.", "{\\", "<i ", ";,", "(.)a"):
        spam_share(unit * 30_000)
