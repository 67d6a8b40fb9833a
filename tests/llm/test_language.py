"""Languages: cleaning, training on noisy labels, mixed posts, held-out accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from quireflow.llm import language as la

# a few sentences with exchangeable parts for each language
PARTS = {
    "en": (["my neighbour", "the old mechanic", "nobody here", "our landlord"], ["painted the kitchen table", "forgot about the garden gate", "cleaned both mirrors", "sold the blue tent"], ["before breakfast", "because it was raining", "with the wrong tool"]),
    "de": (["mein Nachbar", "der alte Mechaniker", "niemand hier", "unser Vermieter"], ["strich den Küchentisch", "vergaß die Gartentür", "putzte beide Spiegel", "verkaufte das blaue Zelt"], ["vor dem Frühstück", "wegen des Regens", "mit dem falschen Werkzeug"]),
    "nl": (["mijn buurman", "de oude monteur", "niemand hier", "onze huisbaas"], ["schilderde de keukentafel", "vergat het tuinhek", "poetste beide spiegels", "verkocht de blauwe tent"], ["voor het ontbijt", "omdat het regende", "met het verkeerde gereedschap"]),
    "da": (["min nabo", "den gamle mekaniker", "ingen her", "vores udlejer"], ["malede køkkenbordet", "glemte havelågen", "pudsede begge spejle", "solgte det blå telt"], ["før morgenmaden", "fordi det regnede", "med det forkerte værktøj"]),
    "sv": (["min granne", "den gamla mekanikern", "ingen här", "vår hyresvärd"], ["målade köksbordet", "glömde trädgårdsgrinden", "putsade båda speglarna", "sålde det blå tältet"], ["före frukosten", "eftersom det regnade", "med fel verktyg"]),
    "fr": (["mon voisin", "le vieux mécanicien", "personne ici", "notre propriétaire"], ["a peint la table de la cuisine", "a oublié le portail du jardin", "a nettoyé les deux miroirs", "a vendu la tente bleue"], ["avant le petit déjeuner", "à cause de la pluie", "avec le mauvais outil"]),
    "es": (["mi vecino", "el viejo mecánico", "nadie aquí", "nuestro casero"], ["pintó la mesa de la cocina", "olvidó la puerta del jardín", "limpió los dos espejos", "vendió la tienda azul"], ["antes del desayuno", "porque llovía mucho", "con la herramienta equivocada"]),
    "it": (["il mio vicino", "il vecchio meccanico", "nessuno qui", "il nostro padrone di casa"], ["ha dipinto il tavolo della cucina", "ha dimenticato il cancello del giardino", "ha pulito gli specchi", "ha venduto la tenda blu"], ["prima di colazione", "perché pioveva", "con l'attrezzo sbagliato"]),
    "pt": (["o meu vizinho", "o velho mecânico", "ninguém aqui", "o nosso senhorio"], ["pintou a mesa da cozinha", "esqueceu o portão do jardim", "limpou os dois espelhos", "vendeu a tenda azul"], ["antes do café da manhã", "porque chovia muito", "com a ferramenta errada"]),
    "pl": (["mój sąsiad", "stary mechanik", "nikt tutaj", "nasz gospodarz"], ["pomalował stół kuchenny", "zapomniał o furtce", "wyczyścił oba lustra", "sprzedał niebieski namiot"], ["przed śniadaniem", "bo padał deszcz", "złym narzędziem"]),
    "ru": (["мой сосед", "старый механик", "никто здесь", "наш хозяин"], ["покрасил кухонный стол", "забыл садовую калитку", "почистил оба зеркала", "продал синюю палатку"], ["до завтрака", "потому что шёл дождь", "не тем инструментом"]),
}


def sentence(rng, lang):
    return " ".join(rng.choice(p) for p in PARTS[lang]).capitalize() + rng.choice([".", "!", "…"])


@pytest.fixture(scope="module")
def rows():
    """(text, label, languages): a tenth of the labels wrong, a tenth of the posts mixed."""
    rng = random.Random(6)
    out = []
    for _ in range(900):
        langs = rng.sample(la.LANGUAGES, 2 if rng.random() < 0.1 else 1)
        text = "\n\n".join(" ".join(sentence(rng, x) for _ in range(3)) for x in langs)
        out.append((text, rng.choice(la.LANGUAGES) if rng.random() < 0.1 else langs[0], set(langs)))
    return out


@pytest.fixture(scope="module")
def judge(rows):
    return la.Judge(la.train([(t, x) for t, x, _ in rows[:600]]))


def test_held_out_accuracy(rows, judge):
    right = 0
    for text, _, langs in rows[600:]:
        found = judge.document(la.sentences(text))
        right += {x for x, _, _ in found} == langs
        assert all(0 <= c <= 1 for _, c, _ in found)
    assert right / 300 > 0.97


def test_letters_without_accents(judge):
    rng = random.Random(9)
    for lang in la.LANGUAGES:
        said = [judge.sentence([la.plain_letters(w) for w in la.sentences(sentence(rng, lang))[0]])[0] for _ in range(20)]
        assert said.count(lang) >= 18


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hello there my friend.\n-- \nsignature text\nmore", [["hello", "there", "my", "friend"]]), ("Hello you\n__________\nx y z", [["hello", "you"]]), ("> > quoted words\n> \nown words", [["quoted", "words"], ["own", "words"]]),
        ("bob12 wrote:\n> quoted words", [["quoted", "words"]]), ("<blockquote><b>bob schrieb:</b><br>alte Worte</blockquote>neue <i>Worte</i>", [["alte", "worte"], ["neue", "worte"]]), ("[quote=bob]old words[/quote]\n\nnew [b]words[/b]", [["old", "words"], ["new", "words"]]),
        ("~~~\ncode lines here\n~~~\nreal text", [["real", "text"]]), ("    x1 = y2\n\tmore code\nreal text", [["real", "text"]]), ("[url=http://a.example/t/1]link words[/url] see http://b.example/x now", [["see", "now"]]), ("DE: Guten Tag", [["guten", "tag"]]),
        ("> quote\n> --\n> sig of quote\nanswer is here", [["quote"], ["answer", "is", "here"]]), ("[deleted]", []), ("+1", []), ("¯\\_(ツ)_/¯", []), ("", []), (" \n\t", []), ("<|endoftext|>", []), ("a&nbsp;b word", [["a", "b", "word"]]), ("(Alpha 25) fine words", [["fine", "words"]]),
    ],
)
def test_cleaning(text, want):
    assert la.sentences(text) == want


def test_labels(spark):
    cases = {"en": "en", " EN ": "en", "en-US": "en", "en_GB": "en", "ger": "de", "deu": "de", "French": "fr", "pt-BR": "pt", "und": None, "xx": None, "": None, "?": None, "unknown": None, None: None, "\tfr\n": "fr", "zh-Hans-CN": None}
    got = spark.createDataFrame([(k,) for k in cases], "l string").select("l", la.label_code(F.col("l")).alias("c")).collect()
    assert {r.l: r.c for r in got} == cases


def test_frames(spark, rows):
    rng = random.Random(8)
    mixed = sentence(rng, "de") + " " + sentence(rng, "de") + "\n" + sentence(rng, "fr")
    extra = [(5001, None, None), (5002, "", "en"), (5003, "+1", None), (5004, sentence(rng, "pl"), None), (5005, sentence(rng, "ru"), "xx"), (5006, sentence(rng, "sv"), "Swedish"), (5007, sentence(rng, "sv"), "da"), (5008, mixed, "de"), (5009, (sentence(rng, "it") + " ") * 3000, "it"), (None, sentence(rng, "en"), "en")]
    df = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(rows)] + extra + extra[3:5], "doc_id bigint, text string, lang string").selectExpr("*", "1 as key", "2 as spans")
    judged = la.judge_documents(df).where("doc_id > 5000 or doc_id is null")
    got = {(r.doc_id, r.lang) for r in la.mislabelled(judged).collect()}
    assert got == {(5004, "pl"), (5005, "ru"), (5007, "sv"), (5008, "de"), (5008, "fr")}
    assert {r.doc_id for r in la.shares(judged).collect()} == {5004, 5005, 5006, 5007, 5008, 5009, None}
    assert [s.lang for s in judged.where("doc_id = 5008").first().spans] == ["de", "fr"]


def test_nothing_to_train_on(spark):
    df = spark.createDataFrame([(1, "words without a label", None)], "doc_id bigint, text string, lang string")
    assert la.mislabelled(la.judge_documents(df)).count() == 1
    assert la.judge_documents(df.limit(0)).count() == 0
