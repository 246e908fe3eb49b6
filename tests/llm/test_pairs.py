import pytest

from tessera.llm import pairs
from tessera.llm.pairs import defect, open_at_end, pair_defects, tiles

Q = "Quais danos Boziji Esguio suporta melhor?"
C = ["Boziji Esguio — resists fogo; resists frio", "O corpo de Boziji Esguio tem 12 garras, e a pele muda de cor no inverno, perto de Nozeto."]
CASES = [
    (None, "empty"), ("", "empty"), ("   \n", "empty"), ("**Resposta:**", "empty"), ("[]", "empty"), ("​", "empty"), ("...", "empty"),
    (Q, "copies_question"), ("QUAIS DANOS BOZIJI ESGUIO SUPORTA MELHOR", "copies_question"), (f"Você perguntou: {Q} {Q}", "copies_question"), (f"{Q} fogo; frio", None),
    ("Não há informação suficiente no contexto para responder.", "refusal"), ("Sobre Boziji Esguio: olha, não me cabe comentar.", "refusal"), ("Lamento, mas não sei dizer. Posso ajudar com outra pergunta?", "refusal"),
    ("Embora o contexto não diga muito: fogo; frio", None), ("Recuso Sereno resiste a fogo.", None),
    ("It resists fire and cold.", "other_language"), ("Es resistente al trueno y también al fuego.", "other_language"), ("Im zweiten Abschnitt steht Boziji Esguio gleich neben Zigipe.", "other_language"), ("Оно боится огня", "other_language"),
    ("fogo; frio", None), ("12", None), ("ND 1/2", None), ("Boziji Esguio resiste a fogo e frio", None), ("Resiste a fogo e frio, conforme o trecho [1].", None),
    ("Resiste a fogo e frio, conforme o", "truncated"), ("Resiste a fogo (ver", "truncated"), ("Resiste a fogo, frio,", "truncated"), ("Resiste a fogo e fr", "truncated"), ("fogo; frio;", "truncated"),
    ("O corpo de Boziji Esguio tem 12 garras, e a pele muda", "truncated"), ("```python\nx = 1", "truncated"), ("1. fogo\n2.", "truncated"), ("Resiste a **fogo", "truncated"), ('Diz "fogo', "truncated"),
]


@pytest.mark.parametrize("answer, want", CASES)
def test_defects(answer, want):
    last = (pairs.folded_words(answer) or [""])[-1]
    n = 3 if last in pairs.folded_words(" ".join([Q, *C])) else 0
    assert defect(answer, Q, C, n, n) == want


def test_refusal_needs_a_context_that_names_the_subject():
    say = "Não há informação suficiente no contexto para responder."
    assert defect(say, Q, ["Outra Coisa — resists fogo"], 9, 9) is None
    assert defect(say, Q, [], 9, 9) is None and defect(say, None, C, 9, 9) is None
    assert defect(say, Q, ["O CORPO DE BOZIJI ESGUIO TEM 12 GARRAS"], 9, 9) == "refusal"
    assert defect("I can't answer that.", "Which functions call link_a_7?", ["x — calls link_a_7"], 9, 9) == "refusal"


def test_tiling_and_parser():
    assert tiles("a b c x a b".split(), "z a b c".split()) == [True, True, True, False, True, True]
    assert open_at_end("f(x[1]) {") == ["{"] and open_at_end("1) a\nb) c") == [] and open_at_end("`(` ok") == [] and open_at_end('12" tall') == []
    assert pairs.question_language("Which functions call x?") == "en" and pairs.question_language(Q) == "pt"


def test_rows(spark):
    r = [(1, "c1", None, None, "x"), (2, "c1", "fogo; frio", [], "x"), (3, "gone", "O corpo de", ["a", None], "x"), (4, None, "Answer:", None, "x"), (5, "c1", Q, C, "x"), (5, "c1", Q, C, "x"), (6, "c1", "palavra " * 5000 + "fim.", None, "x")]
    responses = spark.createDataFrame(r, "response_id bigint, case_id string, answer string, contexts array<string>, question string")
    cases = spark.createDataFrame([("c1", Q, "y"), ("c2", None, "y")], "id string, question string, answer string")
    got = sorted((x.response_id, x.defect) for x in pair_defects(responses, cases).collect())
    assert got == [(1, "empty"), (3, "truncated"), (4, "empty"), (5, "copies_question"), (5, "copies_question")]
    assert pair_defects(responses.limit(0), cases).count() == 0
    assert pair_defects(responses.limit(1), cases.limit(0)).count() == 1


@pytest.mark.parametrize(
    "text",
    ["Beats me.", "No clue, honestly.", "Não faço a menor ideia.", "The passages provided stay silent on this.", "Que pergunta difícil; passo.", "No puedo responder a esa pregunta.", "Je ne sais pas.",
     "I can't answer that. " * 40, "Faltam elementos para responder.", "O contexto não menciona isso.", "Unfortunately this is beyond what I can do here.", "I could not find anything that settles the matter.", "I cannot say, " + "and I really mean it, " * 12 + "what the answer is."],
)
def test_refusals_follow_the_grammar(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize(
    "text",
    ["ND 3", "The loader never drops rows.", "Ele não resiste a nada.", "It is called by scan_notes_1 and nothing else.", "Não há resistência a fogo, mas a frio sim.", "The second passage puts it next to Tajiju and adds nothing else of use.",
     "I am not sure about the rest. It resists fire."],
)
def test_answers_are_no_refusals(text):
    assert not pairs.is_refusal(text)


@pytest.mark.parametrize(
    ("question", "answer", "other"),
    [("Why does it care?", "Limozu gillar inte när någon kommer för nära, eftersom den är rädd om sina ungar.", True), ("Why does it care?", "On nie lubi, kiedy ktoś podchodzi zbyt blisko, ponieważ boi się o swoje młode.", True),
     ("Why does it care?", "Nu îi place când cineva se apropie prea mult, pentru că se teme pentru puii săi.", True), ("Por que ele foge?", "Hän ei pidä siitä, että joku tulee liian lähelle, koska pelkää poikastensa puolesta.", True),
     ("Why does it care?", "The renderer skips our smallest vault without warning, because labels disagree.", False), ("Que danos?", "necrótico; fogo; ácido; veneno; corte", False)],
)
def test_languages_by_ngrams(question, answer, other):
    assert pairs.other_language(answer, question) is other


@pytest.mark.parametrize(
    ("text", "left"),
    [("<div><p>open", ["<div>", "<p>"]), ("<b>unclosed tag here. Done.", ["<b>"]), ("<b>x</b> ok.", []), ("a < b and c", []), ("- one\n- two\n- ", ["item"]), ("1. a\n2.", ["item"]), ("- foo bar", []), ("<br> ok", []), ("```\n( [\n```", []), ('it is 5" long', [])],
)
def test_stack_of_markup_and_lists(text, left):
    assert pairs.open_at_end(text) == left


def test_repeated_questions_of_any_length(spark):
    q = "What do the notes say about budgets?"
    assert pairs.copies_question(" ".join([q] * 50), q) and pairs.copies_question("You asked: " + " ".join([q] * 300), q)
    assert not pairs.copies_question(" ".join([q] * 50) + " They say little.", q)
