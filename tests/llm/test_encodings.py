"""Garbled strings: inversion is exact, planted ones are found, correct ones are left alone."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quireflow.llm import encodings as e

WORDS = {
    "de": "für Größe schön über Mädchen müssen Straße Tür hören natürlich Käse zurück möglich Wörter spät", "fr": "à été près déjà être français garçon où très forêt élève même après hôtel leçon",
    "pl": "się żółty święto książka źle ćma łódź mówić będzie wiać środa jeszcze część ręka późno", "ru": "это человек дерево сказал можно работа город новый дом книга вечер утро если тогда мы", "es": "año niño está aquí también corazón señor mañana inglés país fácil lápiz rápido mío día",
    "sv": "är på för också många får hår även dörr träd sköld små öga åka låta",
}
CORRECT = ["© 12 Alpha · ® Beta ™", "Σ = 5 µm²; Δt ≤ 7 s", "┌──┤ Tab. 3 ├──┐", "†‡§¶ 8", "√5 ≈ 2,2 ± 0,1", "Þórvald Ðelnir, grein 4", "SÃO ÁLVARO, LOTE Nº 3", "ÂGE MOYEN : 4 ANS", "Preis: 5 € / ¥ / £", "“quoted” – 3 …"]


def corpus(rng, n):
    out = []
    for _ in range(n):
        if rng.random() < 0.15:
            out.append(rng.choice(CORRECT))
        else:
            words = WORDS[rng.choice(list(WORDS))].split()
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(3, 8))))
    return out


def letters(s):
    return any(ord(ch) > 127 for ch in s)


@pytest.fixture(scope="module")
def planted():
    """(text, chain or None): mostly correct records, some garbled whole by a common chain."""
    rng = random.Random(4)
    common = [("utf-8", "cp1252", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 1), ("utf-8", "cp437", 1), ("utf-8", "mac-roman", 1), ("utf-8", "cp1251", 1), ("cp1251", "cp1252", 1), ("koi8-r", "cp1251", 1), ("cp1252", "mac-roman", 1)]
    rows = []
    for t in corpus(rng, 4000):
        chain = rng.choice(common) if rng.random() < 0.08 else None
        bad = e.garble(t, chain) if chain else None
        rows.append((bad, chain, t) if bad else (t, None, t))
    return rows


def test_planted_records(planted):
    finder = e.Finder(e.train([r[0] for r in planted]))
    garbled = [r for r in planted if r[1]]
    hit = [finder.look(t) is not None for t, _, _ in garbled]
    false = [t for t, chain, _ in planted if not chain and finder.look(t) is not None]
    back = [s is not None and s[2] == t for s, t in ((finder.look(bad), t) for bad, _, t in garbled)]
    assert sum(hit) / len(hit) > 0.95 and len(false) <= 3, false
    assert sum(back) / len(back) > 0.9


@pytest.mark.parametrize("chain", e.CHAINS)
def test_inversion_is_exact(chain):
    for words in WORDS.values():
        for w in words.split():
            bad = e.garble(w, chain)
            if bad is not None:
                back = e.invert(bad, chain)
                assert back is not None and sum(back[1]) == len(bad)
                if chain[0] == "utf-8" or all(ch in e._READ[chain[0]] for ch in w if ord(ch) > 127):
                    assert back[0] == w


@given(st.text(max_size=30))
def test_any_text_inverts_or_not(text):
    for chain in e.CHAINS[::7]:
        u = e.invert(text, chain)
        assert u is None or sum(u[1]) == len(text)


@pytest.fixture(scope="module")
def found(spark, planted):
    bad = e.garble("für Größe schön", ("utf-8", "cp1252", 1))
    cut = bad.index("¼")
    utf16 = "þÿ" + "".join(f"\0{ch}" for ch in "Hello")
    rows = [(i, t, None) for i, (t, _, _) in enumerate(planted)]
    rows += [
        (10_001, None, [(bad[:cut], None), (None, 5.0), (bad[cut:], None), ("plain", None), (None, None)]), (10_002, utf16, None), (10_003, "caf�", None), (10_004, None, None), (10_005, "", []), (None, "ascii", None),
        (10_006, bad, [("für", None)]), (10_007, "ascii " * 50_000, None), (10_008, "für " * 30_000, None),
    ]
    df = spark.createDataFrame(rows + rows[-9:-6], "text_object_id bigint, text_buffer string, buffer array<struct<txt:string,shift:float>>")
    return e.find_garbled(df.selectExpr("*", "1 as t", "2 as items")).where("text_object_id > 10000").distinct().collect()


def test_frames(found):
    got = {(r.text_object_id, r.field_name, r.item_no): r for r in found}
    assert set(got) == {(10_001, "buffer", 0), (10_001, "buffer", 2), (10_002, "text_buffer", 0), (10_003, "text_buffer", 0), (10_006, "text_buffer", 0)}
    assert got[(10_002, "text_buffer", 0)].restored == "Hello" and got[(10_003, "text_buffer", 0)].restored is None
    assert got[(10_006, "text_buffer", 0)].restored == "für Größe schön" and got[(10_006, "text_buffer", 0)].chain.startswith("utf-8 read as")


def test_empty_tables(spark):
    df = spark.createDataFrame([], "text_object_id bigint, text_buffer string, buffer array<struct<txt:string,shift:float>>")
    assert e.find_garbled(df).count() == 0


def test_words_outside_the_sample_are_counted(spark, planted):
    """Membership rests on counts over all records: the sample here holds none of these words."""
    chain = ("utf-8", "cp1252", 1)
    word = "xüqzéwk"
    rows = [(i, t) for i, (t, _, _) in enumerate(planted)]
    # not in the sample, being longer than it takes
    filler = "plain " * 1000
    rows += [(20_000 + i, filler + word) for i in range(400)] + [(30_000 + i, filler + e.garble(word, chain)) for i in range(5)]
    df = spark.createDataFrame(rows, "text_object_id bigint, text_buffer string").selectExpr("*", "cast(null as array<struct<txt:string,shift:float>>) as buffer")
    got = {r.text_object_id: r.restored for r in e.find_garbled(df).where("text_object_id >= 20000").collect()}
    assert got == {30_000 + i: filler + word for i in range(5)}


def test_cut_items_are_restored(found):
    got = {r.item_no: r.restored for r in found if r.text_object_id == 10_001}
    assert got == {0: "fü", 2: "r Größe schön"}


def test_restoration_by_character(planted):
    finder = e.Finder(e.train([r[0] for r in planted[:500]]))
    text = "x þÿ" + "".join(chr(b) for b in "H😀i".encode("utf-16-be"))
    seen = finder.look(text)
    assert seen[2] == "x H😀i" and seen[3] == ["x", " ", "", "", "H", "", "😀", "", "", "", "i", ""]


def test_the_classifier_decides(planted):
    """With weights that say nothing no record is garbled to the classifier, whatever the counts would prove."""
    model = e.train([r[0] for r in planted])
    model.weights = model.weights * 0
    blind = e.Finder(model)
    assert not any(blind.chains([e._form(w) for w in t.split(" ") if e.is_odd(w)]) for t, _, _ in planted)
    assert sum(blind.look(bad) is not None for bad, chain, _ in planted if chain and not any(map(e._certain, bad))) == 0


def test_classifier_without_the_check(planted):
    finder = e.Finder(e.train([r[0] for r in planted]))
    said = {t: bool(finder.chains([e._form(w) for w in t.split(" ") if e.is_odd(w)])) for t, _, _ in planted}
    garbled = [t for t, chain, _ in planted if chain]
    assert sum(said[t] for t in garbled) / len(garbled) > 0.95
    assert sum(said[t] for t, chain, _ in planted if not chain) / sum(1 for r in planted if not r[1]) < 0.02


def test_items_of_a_restored_buffer_add_up(spark, planted):
    """Cut anywhere, also inside a sequence and inside UTF-16 read byte by byte."""
    rng = random.Random(8)
    rows, want = [(i, t, None) for i, (t, _, _) in enumerate(planted)], {}
    texts = [(bad, t) for bad, chain, t in planted if chain and chain[0] == "utf-8"][:60] + [("þÿ" + "".join(f"\0{ch}" for ch in t), t) for t in ("Hello", "four words of text")]
    for i, (bad, t) in enumerate(texts, 50_000):
        spots = sorted(rng.sample(range(1, len(bad)), 2))
        rows.append((i, None, [(x, None) for x in (bad[: spots[0]], bad[spots[0] : spots[1]], bad[spots[1] :])]))
        want[i] = t
    df = spark.createDataFrame(rows, "text_object_id bigint, text_buffer string, buffer array<struct<txt:string,shift:float>>")
    got: dict = {}
    for r in e.find_garbled(df).where("text_object_id >= 50000").collect():
        got.setdefault(r.text_object_id, {})[r.item_no] = r.restored
    built = {i: "".join(got[i].get(n) if n in got[i] else x[0] for n, x in enumerate(row[2])) for i, row in ((r[0], r) for r in rows if r[0] >= 50_000) if i in got and all(v is not None for v in got[i].values())}
    assert len(built) >= 58 and all(built[i] == want[i] for i in built)
