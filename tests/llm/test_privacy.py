import numpy as np
import pytest

from tessera.llm.boost import Boosted
from tessera.llm.privacy import KINDS, _Lines, detect, models, personal_data, redact

LINES = [
    ("Escreva para ana.torres+x@mail.example ou ligue (11) 98765-4321.", {"email", "phone"}),
    ("reach me at joao (arroba) posto [dot] example", {"email"}),
    ("CPF 123.456.789-00 em nome de Paulo Ferreira.", {"id_number", "name"}),
    ("Badge on file is ID AB123456.", {"id_number"}),
    ("Ship it to 1200 Moreira Street, Apt 4.", {"address"}),
    ("Ela mora na Rua das Flores, 88.", {"address"}),
    ("Thanks, Campos, Laura", {"name"}),
    ("Owner: J. Barreira", {"name"}),
    ("Order 4471-0090-12 has 55 rows.", set()),
    ("Commit 9f03ab77c1 fixed build 20250114.3.", set()),
    ("A Rua dos Sinos, em Zariro, fica vazia.", set()),
    ("Numa noite, o eco de Ludovo Cavernoso alcança 914 passos.", set()),
    ("See @dataclass and @property.", set()),
]


@pytest.mark.parametrize("line, kinds", LINES)
def test_kinds(line, kinds):
    assert {s.kind for s in detect([line], models())[0]} == kinds


#: Another writer: names, words before and words behind that the training lines don't have.
OTHERS = "Przemysław Siobhán Kwame Yuki Ludmila Henrietta Baltasar Wanda Roderick Constança Bartolomeu Imogen Nikolai Mercedes Ottavio Freya Leopold Marisol Zuzanna Desmond".split()
FAMILIES = "kowalczyk o'reilly adjei hashimoto vasquez-ortega fitzgerald montenegro wójcik sutherland quintana pemberton figueiredo abernathy lindgren castellano brightwater".split()
FRONT = {
    "email": "drop a line to|answers go to|correio para|reply-to", "phone": "ring|her number is|numero dele,|pager", "id_number": "taxpayer number|personal number|bilhete de identidade|insurance number",
    "address": "resides at|delivery point:|correspondencia para|meet me outside", "name": "according to|interview with|carta de|sobrinha de|composer:|drawn by|em memoria de|hired",
}
BACK = {k: "|, as agreed|. Thank you|; see below| (confirmed)" for k in FRONT}


@pytest.mark.parametrize("kind", KINDS)
def test_held_out_writer(kind):
    w = _Lines(99, given=OTHERS, surnames=FAMILIES, before=FRONT, behind=BACK)
    hit, n = 0, 200
    for _ in range(n):
        text, true = w.labelled(kind)
        hit += any(s.kind == kind and abs(s.start - true[0].start) <= 1 for s in detect([text], models())[0])
    assert hit / n >= (0.45 if kind == "name" else 0.9)  # unknown names behind unknown words are the hardest


def test_look_alikes():
    w = _Lines(98)
    assert sum(bool(detect([w.decoy()], models())[0]) for _ in range(300)) <= 15


@pytest.mark.parametrize("line", ["Interview with Przemysław Kowalczyk", "Thanks, Siobhán O'Reilly", "Contato: Ludmila Vasquez-Ortega", "Dear Yuki Tanaka,"])
def test_names_of_many_languages(line):
    assert "name" in {s.kind for s in detect([line], models())[0]}


@pytest.mark.parametrize("line", ["She lives at Bergstraße 12.", "mora em Calle Mayor 14", "ship to 12 rue de la Paix", "address: Via Roma, 5"])
def test_streets_of_many_languages(line):
    assert "address" in {s.kind for s in detect([line], models())[0]}


def test_an_account_is_an_identity_number():
    assert {s.kind for s in detect(["IBAN DE89 3704 0044 0532 0130 00 on the form"], models())[0]} == {"id_number"}


def test_placeholders_keep_the_rest():
    t = "Oi,\nContato: Ana Torres, ana@mail.example.\r\nTchau"
    assert redact(t, detect([t], models())[0]) == "Oi,\nContato: [NAME], [EMAIL].\r\nTchau"


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.integers(0, 2, (800, 5)).astype(float)
    y = np.logical_xor(x[:, 0] > 0, x[:, 1] > 0).astype(float)
    p = Boosted(rounds=40).fit(x, y).score(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.97


def test_rows(spark):
    df = spark.createDataFrame([(1, "a\nOwner: Ana Torres\nok", 9), (2, None, 9), (3, "", 9), (1, "a\nOwner: Ana Torres\nok", 9), (4, "x " * 60000, 9)], "doc_id bigint, text string, found int")
    got = sorted(personal_data(df).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [1, 1, 2, 3, 4]
    assert [(f.kind, f.line_no) for f in got[0].found] == [("name", 2)] and got[0].text == "a\nOwner: [NAME]\nok"
    assert got[2].text is None and got[3].text == "" and got[4].text == "x " * 60000
    assert personal_data(df.limit(0)).count() == 0
