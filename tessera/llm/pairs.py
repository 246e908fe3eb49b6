"""Defects of question-answer pairs.

``empty``, ``copies_question``, ``refusal``, ``other_language`` and
``truncated``, at most one per response, tested in this order.

* empty: null, or no letter and no digit, or only a caption.
* copies_question: greedy string tiling of the answer by the question; what the
  tiles leave over may only be a lead-in.
* refusal: every clause is a sentence of the refusal grammar (or a courtesy),
  and at least one context names what the question asks about.
* other_language: the scripts, then the function words and the character
  n-grams, of the answer's sentences are of another language than the question's.
* truncated: a pushdown parser over fences, brackets, quotations, markup and
  list items ends with something open or dangling; or the last word is a
  function word, is cut short, or the last sentence is the beginning of a
  longer sentence of the contexts; or the corpus never ends a sentence with it.

Corpus counts of words come from all contexts, questions and answers, but only
for the last words on which a verdict hangs.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import without_accents
from tessera.operators.orphans import hot_safe_left_join
from tessera.workspace import Workspace, spread

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")
#: A word seen this often within sentences and never at an end can't end one.
OFTEN = 30

_WORDS = re.compile(r"[^\W_]+(?:[_'’\-][^\W_]+)*")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_CAPTION = re.compile(
    r"^\W*(?:(?:a |the |my |minha |uma )?(?:final |short |resposta )?(?:answer|response|reply|resposta|resp|a|r|ans|output|saida|result|resultado|conclusao|conclusion|solucao|solution|resumo|summary|nota|note)(?: final| curta| do modelo)?)\W*$"
)

# Function words by language; fixed values, folded of accents only where that keeps them apart.
_FUNCTION = {
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas ao aos à às e ou que se com por para pelo pela pelos pelas não mas quando onde como mais muito são é foi ser está estão até sem sobre entre seu sua seus suas isso este esta esse essa ele ela eles elas também já só então depois antes embora cada desde há tem têm quem qual quais contra pouco pois porque enquanto sempre num numa diante ainda",
    "en": "the a an of in on at to and or that which is are was were be been by with for from not but when where how as it its this these those he she they them we you i his her their our your also than then because since while after before into over under between about has have had does do did can could would should will may might so if only out up no such there who whom whose what why all any each some though although one two most mostly more less few many near well both either neither other another just even much own same here next",
    "es": "el la los las un una unos unas de del en al y o que se con por para pero cuando donde como más muy es son fue ser está están hasta sin sobre entre su sus eso este esta ese esa él ella ellos ellas también ya sólo solo lo le les porque mientras desde hay tiene tienen quien cual cuales contra poco pues aunque si nada allí aquí junto mejor nunca siempre",
    "fr": "à le la les un une des de du en au aux et ou que qui se avec par pour mais quand où comme plus très est sont fut être jusqu sans sur entre son sa ses cela ce cet cette ces il elle ils elles aussi déjà lui leur leurs parce pendant depuis dans ne pas n l d qu c s j y on nous vous si peu même dont alors très avant après peut",
    "de": "der die das den dem des ein eine einen einem einer eines und oder dass daß sich mit von für aber wenn wo wie mehr sehr ist sind war sein wird werden bis ohne über zwischen ihr ihre sein seine dies dieser diese dieses er sie es wir ihr auch schon nur weil während seit nicht zu zum zur im in am an auf aus bei nach steht dort kein keine als noch gut nachts gleich neben gern vor niemand",
    "it": "il lo la i gli le un uno una di del della dello dei degli delle in nel nella nei nelle al alla ai e o che si con per ma quando dove come più molto è sono fu essere fino senza su sul sulla tra fra suo sua suoi sue questo questa quello quella lui lei essi anche già solo perché mentre da dal dalla non ha hanno chi quale contro poco allora",
    "nl": "de het een van in op aan en of dat die is zijn was waren met voor maar wanneer waar hoe meer zeer tot zonder over tussen zijn haar hun dit deze hij zij het ook al alleen omdat terwijl sinds niet naar bij uit als nog geen wel er door",
}
# Frequent words of further languages, for their character n-grams only; Catalan, too close to Portuguese, only competes.
_MORE = {
    "sv": "och att det som en på är av för med den till inte om ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla andra mycket än här då sedan över bara",
    "da": "og at det som en på er af for med den til ikke om et han men var jeg sig fra vi så kan når også efter eller nu sin der ved mod skal skulle kommer ud får være havde alle andre meget end her da siden over kun hvor hvad",
    "pl": "i w na z do się nie że to jest o jak ale po co tak za od przez przy dla czy tylko już jego jej ich był była było są być ten ta te tym tego który która które gdy oraz bardzo może można pod nad między także więc jeszcze",
    "ro": "și în de la cu pe nu se că este un o a fi din pentru mai care sunt dar au ca ce el ea lui ei au fost când unde cum foarte doar după până fără între despre acest această acestea sau dacă apoi prin către într-o lor",
    "cs": "a v na se že je to s z do o i jako ale za po od pro by byl byla bylo jsou být ten ta tak když jeho její jejich který která které není pod nad mezi také ještě už jen jsem aby kde kdo co více velmi může",
    "fi": "ja on ei se että oli hän mutta niin kuin myös joka tai kun vain ovat jos nyt sen ne sitten mitä tämä voi ole olla hänen kanssa ennen jälkeen vielä sekä jo kaikki hyvin siellä täällä missä",
    "tr": "ve bir bu da de için ile çok daha gibi ama ne var yok olan olarak kadar sonra önce her o ki değil mi ya en şey ben sen biz onun bunu şu göre üzerinde arasında eder etmek oldu olur",
    "hu": "a az és hogy nem is egy ez meg de van volt csak már mint el ki fel be azt ezt vagy ha még minden aki ami amely lehet után között alatt fölött nagyon mert itt ott majd sem",
    "ca": "el la els les un una de del dels i que no en amb per a al als és són va ser com més però quan on molt seu seva això aquest aquesta també només si fins sobre entre sense hi ha",
    "id": "dan yang di ke dari ini itu dengan untuk tidak pada adalah ada dalam akan juga oleh karena mereka kita saya atau sudah bisa lebih hanya seperti jika tetapi sangat antara setelah sebelum",
}
_WORDS_OF = {k: v.split() for k, v in (_FUNCTION | _MORE).items()}
_LANG = {k: frozenset(_WORDS_OF[k]) for k in _FUNCTION}
#: A word of several languages says less.
_SHARES = {w: [(k, 1 / sum(w in own for own in _LANG.values())) for k, own in _LANG.items() if w in own] for words in _LANG.values() for w in words}
#: How much likelier a word's n-grams must be, per word, in another language; and in how many words at least.
NGRAM_MARGIN, NGRAM_WORDS = 0.4, 6


def _grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]


@functools.lru_cache(maxsize=1)
def _profiles() -> dict[str, dict[str, float]]:
    """Log probabilities of character n-grams by language, learnt from its frequent words, all with one smoothing."""
    counts = {k: Counter(g for w in words for g in _grams(w)) for k, words in _WORDS_OF.items()}
    size = len({g for c in counts.values() for g in c})
    return {k: {g: math.log((n + 0.3) / (sum(c.values()) + 0.3 * size)) for g, n in c.items()} | {"": math.log(0.3 / (sum(c.values()) + 0.3 * size))} for k, c in counts.items()}


@functools.lru_cache(maxsize=65536)
def _word_scores(word: str) -> tuple[float, ...]:
    """Mean log probability of a word's n-grams in every language."""
    grams = _grams(word)
    return tuple(sum(p.get(g, p[""]) for g in grams) / len(grams) for p in _profiles().values())


def ngram_language(words: list[str]) -> tuple[str, dict[str, float]]:
    """The likeliest language of some words by their character n-grams, and the score of each per word."""
    total = [0.0] * len(_WORDS_OF)
    for w in words:
        for i, x in enumerate(_word_scores(w)):
            total[i] += x
    score = {k: x / max(1, len(words)) for k, x in zip(_WORDS_OF, total, strict=True)}
    return max(score, key=score.get), score


#: Endings and letters that speak for one of two close languages.
_MARKS = {
    "pt": re.compile(r"ção|ções|ão\b|ões\b|nh[aoe]|lh[aoe]|[ãõ]|\bvoc"),
    "es": re.compile(r"ción|ciones|ñ|¿|¡|ll[aeo]|\w+dad\b|ue[rnl]"),
    "fr": re.compile(r"\b[ldjnsmc]['’]|eau|oux|è|ê|œ|eux\b|ent\b"),
    "de": re.compile(r"ß|ä|ö|ü|sch|\bge\w+t\b|ung\b"),
    "en": re.compile(r"\w+ing\b|th|\w+ed\b|wh|sh|'s\b"),
    "it": re.compile(r"zione|gli|cch|tt[aoie]\b|ò\b|ù\b"),
}
#: Words that no complete sentence ends with.
_DANGLING = frozenset(
    """o a os as um uma uns umas de do da dos das em no na nos nas ao aos à às e ou que se com por para pelo pela pelos pelas mas quando onde como até sem sobre entre seu sua seus suas embora cada desde quem qual quais contra pois porque enquanto num numa cujo cuja muito mais tão nem é são foi ver
    the an of in on at to and or that which is are was were be by with for from but when where how as its this these those his her their our your than because since while after before into between about has have had does do did can could would should will may might if such who whose what why each some although though until yet whether per via
    el la los las un del y con por pero su sus aunque le les des du et ou que qui avec pour mais der die das und oder mit von für aber il lo gli di che""".split()
)

_COURTESY = r"(?:(?:olha|bem|bom|ok|sinceramente|infelizmente|unfortunately|sorry|well|ola|hello|hi|certo|claro|sure|obrigad[oa]|thanks?|thank you|desculpe?(?:me)?|desculpas|lamento|honestly|sendo sincer[oa]|com sinceridade|para ser sincer[oa]|to be honest|neste caso|nesse caso|in this case|peco desculpas?|i apologi[sz]e|i am sorry|i m sorry|look|frankly|com base no contexto|based on the context|como (?:um )?(?:modelo de linguagem|assistente|ia)|as an? (?:ai )?(?:language model|assistant|ai)|mas|but|e|and|que|that)\b[\s,;:.!-]*)+"
# The refusal grammar.  A clause is read as a string of word classes, one letter a word ("." for any other word);
# productions are expressions over these letters.  Fixed values: the words of each class, folded, in Portuguese, English, Spanish and French.
_CLASSES = {
    "N": "nao no not never nem nunca cannot cant can't don't dont doesn't doesnt didn't couldn't won't wouldn't isn't aren't haven't hasn't nothing nada nenhum nenhuma ninguem nobody none ne n'ai n'est pas rien aucun aucune ningun ninguna without sem sin unable incapaz incapable impossivel impossible imposible nao-",
    "M": "posso pode possivel poderia poderei consigo consegui conseguirei can could able may would will cabe capable possible puedo podria posible peux pourrais seria vou irei at-liberty",
    "K": "sei saber saberia sabemos sabe know knows sure certain se sais sait savoir conheco desconheco ignoro lembro recordo conozco connais determine determinar determined afirmar concluir conclude tell say dizer decir dire certeza seguro",
    "A": "responder respondo responderia responda resposta answer answering answered answerable respond response reply responder contestar respuesta repondre reponse help ajudar ayudar aider assist comment comentar speculate especular guess adivinhar arriscar opinar opine opinion discuss discutir provide fornecer oferecer give dar dou esclarecer especificar specify",
    "I": "information informacao informacoes info dados data detail details detalhes detalhe elementos elemento context contexto contextos contexts passage passages trecho trechos texto text texts material materials base basis evidence evidencia excerpt excerpts source sources fonte fontes clue clues idea ideia idee informacion informaciones datos information informations donnees contexte mention mencao mention mentions condicoes records notes provided above grounds",
    "V": "mention mentions mentioned menciona mencionam cover covers address addresses state states consta constam diz dizem diga fala falam trata informa informam appear appears aparece aparecem dice dicen dit",
    "H": "have has had tenho tem temos ter terei disponho dispoe contain contains contem include includes inclui incluem traz trazem existe existem ha basta bastam permite permitem contiene tengo hay dispose faco fait hago enough sufficient suficiente suficientes available disponivel about",
    "F": "encontro encontrei encontra encontrar encuentro find found localizo localizei localizar achei acho achar see saw locate trouve vejo vi",
    "S": "silent silence silencio insufficient insuficiente insuficientes lack lacks lacking missing falta faltam faltava faltando faltou carece carecem thin vague vago vaga scarce sparse short little pouco poucas escasso omit omits omisso omissa omitem outside beyond fora alcance escopo scope reach unknown unclear",
    "D": "decline declines declining declino declinar refuse refuses refuso recuso recusar abstain abstenho abster skip passo pass pular passar deixar leave leaving unanswered blank open aside prefiro preferiria prefer rather rehusar rehuso refuser decliner evitar avoid",
    "P": "eu i i'm i'd i'll we me myself je yo nos",
}
_CLASS_OF = {w: c for c, words in reversed(_CLASSES.items()) for w in words.split()}
_PRODUCTIONS = re.compile(
    "|".join(
        (
            r"N.{0,4}[MKAD]",  # negation, ability or knowledge: I cannot answer, não sei, je ne sais pas
            r"M.{0,3}N.{0,2}[KA]",  # pode não saber, would not know
            r"N.{0,5}I|N.{0,3}[VF]",  # negation and what one would have: não tenho dados, does not mention it, no clue, nothing in the text
            r"I.{0,5}S|I.{0,4}N.{0,3}[HVFMKA]",  # a source that is silent: the passages stay silent, o contexto não diz
            r"[HV].{0,3}N.{0,2}I",  # have no information
            r"S.{0,4}[IAM]|S$",  # lack: faltam elementos, too little context, outside my scope
            r"[PM].{0,3}D|^D.{0,6}|D.{0,4}[NA]|D$",  # declining: I'll pass, prefiro não responder, deixar sem resposta
            r"[HVI].{0,6}S",  # is missing from the notes, data is thin
        )
    )
)
#: Sayings that decline without any of this.
_SAYINGS = re.compile(r"\b(?:beats me|search me|who knows|vai saber|quem sabe|sei la|quien sabe|va savoir|no te sabria decir|you got me|ask someone else|deus sabe|heaven knows)\b")
_CONTRACTED = re.compile(r"[’`´]")
_SPOKEN = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")


def classes(clause: str) -> str:
    """Letters of a folded clause's word classes; a word outside all classes is a dot, a number "#"."""
    return "".join(_CLASS_OF.get(w) or ("#" if w[0].isdigit() else ".") for w in _SPOKEN.findall(_CONTRACTED.sub("'", clause)))


@functools.lru_cache(maxsize=65536)
def declines(clause: str) -> bool:
    """Whether a folded clause follows the grammar: a production covers it up to a topic, and no number or list stands in it."""
    said = classes(clause)
    return "#" not in said and (bool(_PRODUCTIONS.search(said)) or bool(_SAYINGS.search(clause)))


#: What a clause that only continues a refusal may consist of.
_LEAD = frozenset(
    """pergunta question a the is was e é foi era sua your my minha you asked ask perguntou perguntada feita feito feita recebida seguinte following sobre about repetindo repeating repito repeat original enunciado prompt user usuario user's q p here aqui esta está eis vamos let's lets us see ver pensar think boa good great otima excelente entao então so well bem certo ok sure claro resposta answer r resp para to respond responder answering respondendo segue vejamos hum hmm again novamente de novo de of que that voce você quer want to know saber""".split()
)


def fold(s: str) -> str:
    s = _INVISIBLE.sub("", s)
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def folded_words(s: str | None) -> list[str]:
    return _WORDS.findall(fold(s)) if s else []


# -- empty ---------------------------------------------------------------------------------


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    f = fold(answer)
    return not any(c.isalnum() for c in f) or bool(_CAPTION.match(f))


# -- copies_question: greedy string tiling -------------------------------------------------


def tiles(a: list[str], b: list[str], least: int = 2) -> list[bool]:
    """Which words of ``a`` greedy string tiling covers by runs of ``b``, longest first; ``b`` may be used again."""
    covered = [False] * len(a)
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    while True:
        best, length = -1, 0
        for i in range(len(a)):
            if covered[i]:
                continue
            for j in at.get(a[i], ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and not covered[i + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > length:
                    best, length = i, n
        if length < least:
            return covered
        for k in range(best, best + length):
            covered[k] = True


def copies_question(answer: str, question: str | None, q: list[str] | None = None) -> bool:
    q, a = folded_words(question) if q is None else q, folded_words(answer)
    if len(q) < 3 or len(a) < 0.6 * len(q):
        return False
    own = set(q)
    if any(w not in own and w not in _LEAD for w in a):
        return False  # a word that no tile can cover and no lead-in has
    a = _once(a, len(q))
    covered = tiles(a, q)
    used = sum(covered)
    return used >= max(3, 0.6 * len(q)) and len(a) - used <= max(8, used // 2)


def _once(words: list[str], most: int) -> list[str]:
    """Without the repetitions of a run of up to ``most`` words right behind itself; repetition says nothing new."""
    out: list[str] = []
    i = 0
    while i < len(words):
        out.append(words[i])
        i += 1
        n = next((n for n in range(min(most, len(out)), 2, -1) if words[i : i + n] == out[-n:]), 0)
        while n and words[i : i + n] == out[-n:]:
            i += n
    return out


# -- refusal -------------------------------------------------------------------------------


def clauses(answer: str) -> list[str]:
    return [c for c in re.split(r"[.!?;\n]+(?:\s|$)|:\s|\s[—–-]\s", _INVISIBLE.sub("", answer)) if any(x.isalnum() for x in c)]


#: An offer behind a refusal.
_OFFER = re.compile(r"posso (?:te |lhe )?ajudar|outra (?:pergunta|coisa|questao)|mais alguma coisa|(?:se|caso) (?:quiser|precisar|preferir)|gostaria|deseja|me avise|fico a disposicao|(?:can|may|could) i (?:help|assist|do)|(?:some|any)thing else|would you like|let me know|feel free|happy to help|another question|if you (?:want|like|need|prefer)|tente (?:reformular|novamente)|please (?:try|rephrase|provide)")
_NAMED = re.compile(r"(?<=\S\s)[A-ZÀ-Þ][^\W\d_]+|^\W*[A-ZÀ-Þ][^\W\d_]+\s+[A-ZÀ-Þ][^\W\d_]+|\b[a-zA-Z]\w*_\w+\b")
#: The subject in front of a refusal.
_TOPIC = re.compile(r"^\W*(?:sobre|about|regarding|quanto\s+a[o]?s?|acerca\s+d[aeo]s?|on|as\s+for|em\s+rela[çc][ãa]o\s+a[o]?s?|concerning|re)\s[^.!?:\n]+:\s", re.I)
#: What only remarks on the question.
_REMARK = re.compile(r"^(?:(?:que|what an?|hard|tough|good|great|boa|dificil|interesting|interessante) )*(?:pergunta|question|questao)(?: dificil| interessante)?$")
_POLITE = re.compile(r"^\W*" + _COURTESY)


def is_refusal(answer: str) -> bool:
    """Every clause declines or is a courtesy, and one declines; of any length."""
    said = False
    for c in clauses(_TOPIC.sub("", unicodedata.normalize("NFC", answer))):
        f = _POLITE.sub("", fold(c)).strip(" ,.;:!-*_\"'")
        if not f or _REMARK.match(f) or (_OFFER.search(f) and not any(ch.isdigit() for ch in f)):
            continue
        # a creature may be called like a verb, and a name says nothing about the sentence
        if not declines(_POLITE.sub("", fold(_NAMED.sub("", c))).strip(" ,.;:!-*_\"'")):
            return False
        said = True
    return said


_NAMES = re.compile(r"[A-ZÀ-Þ][\w\u0300-\u036f'’-]*(?:\s+[A-ZÀ-Þ][\w\u0300-\u036f'’-]*)*")


def asked_about(question: str | None) -> list[str]:
    """What a question names: an identifier, else its first proper name behind the first word."""
    if not question:
        return []
    ids = re.findall(r"\b[a-zA-Z]\w*_\w+\b", question)
    if ids:
        return ids[:1]
    first = re.match(r"\W*\w+(?:[-'’]\w+)*", question)
    body = question[first.end() :] if first else question
    names = [m.group() for m in _NAMES.finditer(body)]
    if not names and first:
        names = [m.group() for m in _NAMES.finditer(question)][:1]
    return names[:1]


def names_it(contexts: list[str], names: list[str]) -> bool:
    keys = [" ".join(folded_words(n)) for n in names]
    for c in contexts:
        body = f" {' '.join(folded_words(c))} "
        if any(k and f" {k} " in body for k in keys):
            return True
    return False


# -- other_language ------------------------------------------------------------------------


def script(s: str) -> str:
    """Script that most letters belong to."""
    if s.isascii():
        return "LATIN" if any(c.isalpha() for c in s) else ""
    n: dict[str, int] = {}
    for c in s:
        if c.isalpha():
            k = "LATIN" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else unicodedata.name(c, "?").split()[0]
            n[k] = n.get(k, 0) + 1
    return max(n, key=n.get) if n else ""


_CODED = re.compile(r"\w*[\d_]\w*")
_PLAIN = re.compile(r"[^\W\d_]+")


def spoken_words(s: str) -> list[str]:
    """Words that have a language: no identifiers, no numbers, no names within a sentence."""
    words = _PLAIN.findall(_CODED.sub(" ", s))
    loud = s.isupper()
    return [w.lower() for i, w in enumerate(words) if i == 0 or w.islower() or len(w) == 1 or loud]


def word_shares(words: list[str]) -> dict[str, float]:
    score = dict.fromkeys(_LANG, 0.0)
    for w in words:
        for k, x in _SHARES.get(w, ()):
            score[k] += x
    return score


def language_scores(s: str) -> dict[str, float]:
    score = word_shares(spoken_words(s))
    text = _CODED.sub(" ", s).lower()
    for k, marks in _MARKS.items():
        score[k] += 0.35 * len(marks.findall(text))
    return score


@functools.lru_cache(maxsize=65536)
def question_language(question: str | None) -> str:
    score = language_scores(question or "")
    return "pt" if score["pt"] >= score["en"] else "en"


def other_language(answer: str, question: str | None) -> bool:
    if script(answer) not in ("LATIN", "") and script(question or "") in ("LATIN", ""):
        return sum(c.isalpha() for c in answer) >= 6
    answer = unicodedata.normalize("NFC", answer)
    if question:  # a repeated question in front says nothing about the answer's language
        asked = unicodedata.normalize("NFC", question).casefold()
        body = answer.lstrip(" \t\n\"'«“*>-")
        if body.casefold().startswith(asked):
            answer = body[len(asked) :]
    words = spoken_words(answer)
    n = len(words)
    if n < 3 or (";" in answer and n < 5):
        return False
    own = question_language(question)
    score = word_shares(words)
    if score[own] >= 2 and all(x * 2 <= score[own] for k, x in score.items() if k != own):
        return False  # plainly the question's own language
    text = _CODED.sub(" ", answer).lower()
    for k, marks in _MARKS.items():
        score[k] += 0.35 * len(marks.findall(text))
    best = max(score, key=score.get)
    if best != own and score[best] >= 1 and score[best] > score[own] * 1.2 + 0.3:
        return True
    if n < NGRAM_WORDS or score[own] * 5 >= n:  # enough words of the question's own language
        return False
    kind, near = ngram_language(words)
    return kind in _MORE and kind != "ca" and near[kind] - near[own] >= NGRAM_MARGIN


# -- truncated: pushdown parser ------------------------------------------------------------

_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”"}
_CLOSERS = {v: k for k, v in _PAIRS.items()}


#: All that the parser reacts to: fences, escapes, strong emphasis, list items, tags, code, quotations, brackets.
_SIGNS = re.compile(
    r"""(?P<fence>```|~~~)|\\.|(?P<strong>\*\*)|(?P<item>^[ \t]*(?:\d+[.)]|[-*•+])(?=\s|\Z))|<(?P<slash>/?)(?P<name>[a-zA-Z][\w-]*)(?:\s[^<>]*?)?(?P<own>/?)(?:(?P<end>>)|\Z)|(?P<one>[`"(\[{«“)\]}»”])""",
    re.M | re.S,
)
_ALNUM = re.compile(r"[^\W_]")
# Elements that have to be closed.
_TAGS = frozenset("a b i u em strong p div span ul ol li table tr td th h1 h2 h3 h4 h5 h6 pre code blockquote section article small sub sup".split())


def open_at_end(s: str) -> list[str]:
    """Stack of what is still open at the end: fences, code, emphasis, brackets, quotations, tags, a list item without text."""
    stack: list[str] = []
    held: Counter[str] = Counter()  # what the stack holds, so that a test for it takes no search
    item = -1  # where the text of a list item should follow

    def push(x: str) -> None:
        stack.append(x)
        held[x] += 1

    def close(x: str) -> None:
        while True:
            top = stack.pop()
            held[top] -= 1
            if top == x:
                return

    for m in _SIGNS.finditer(s):
        inside = stack[-1] if stack else ""
        if fence := m["fence"]:
            if held[fence]:
                close(fence)
            elif inside != "`":
                push(fence)
            continue
        if inside in ("```", "~~~") or (inside == "`" and m[0] != "`"):
            continue
        if m["strong"]:
            if held["**"]:
                close("**")
            elif m.end() < len(s) and not s[m.end()].isspace():
                push("**")
        elif m["item"] is not None:
            item = m.end()
        elif m["name"]:
            tag = f"<{m['name'].lower()}>"
            if not m["end"]:
                push("<")  # the tag itself never ends
            elif m["slash"]:
                if held[tag]:
                    close(tag)
            elif not m["own"] and tag[1:-1] in _TAGS:
                push(tag)
        elif c := m["one"]:
            if c in "`\"":
                if held[c]:
                    close(c)
                elif c == "`" or m.start() == 0 or not s[m.start() - 1].isdigit():  # else inches
                    push(c)
            elif c in _PAIRS:
                push(c)
            elif held[_CLOSERS[c]]:  # else the mark of a list: "1)" or "a)"
                close(_CLOSERS[c])
    if item >= 0 and not _ALNUM.search(s, item):
        push("item")
    return stack


_END = re.compile(r"[.!?…][\"'”’»)\]*_`]*\s*$")
_VALUE = re.compile(r"^[\w/.,%°+-]+$")


def last_sentence(s: str) -> str:
    parts = re.split(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n\s*\n", s.rstrip())
    return parts[-1].strip() if parts else ""


_NEAR = re.compile(r"\w+(?:[-'’]\w+)*")
_ASIDE = re.compile(r"(?:—|–|\()\s*\w+$")


def verdicts(answer: str, contexts: list[str]) -> tuple[bool, bool, bool]:
    """Whether the text stops before its end, if the corpus never has its last word, has it often but never at a sentence's end, or has it otherwise."""
    yes, no = (True, True, True), (False, False, False)
    s = unicodedata.normalize("NFC", _INVISIBLE.sub("", answer)).rstrip()
    if open_at_end(s):
        return yes
    if s.endswith(("...", "…")):
        return yes
    if _END.search(s):
        return no
    if s[-1:] in ",;:—–-([{/&+=":
        return yes
    words = _WORDS.findall(s)
    if not words:
        return no
    if _ASIDE.search(s):
        return yes  # an aside that has only begun
    tail, last = last_sentence(s), words[-1]
    low = last.lower()
    if low in _DANGLING and (last.islower() or len(last) > 1) and len(tail.split()) > 1:
        return yes
    bare = re.split(r"\s*[;,]\s*", tail)
    is_list = len(tail.split()) <= 2 or (";" in tail and len(bare[-1].split()) <= 3) or all(len(x.split()) <= 3 and x.split()[0].lower() not in _DANGLING for x in bare if x)
    contexts = [unicodedata.normalize("NFC", c) for c in contexts]
    flat = " ".join(folded_words(tail))
    if len(flat) > 12:
        for c in contexts:
            body = " ".join(folded_words(c))
            k = body.find(flat)
            if k >= 0:
                end = k + len(flat)
                if end < len(body) and body[end] != " ":
                    return yes  # within a word
                sentences = [" ".join(folded_words(x)) for x in re.split(r"(?<=[.!?])\s+", c)]
                inside = [x for x in sentences if flat in x]
                if inside and all(not x.endswith(flat) for x in inside) and not is_list:
                    rest = inside[0][inside[0].find(flat) + len(flat) :].split()
                    if rest and "(" not in c:
                        return yes
    plain = not is_list and last.islower() and last.isalpha()
    cut = False
    if not plain and not last.isdigit():  # a list or value may still be cut within a word: it isn't one here, but begins one
        known = {w.lower() for c in contexts for w in _NEAR.findall(c)}
        cut = low not in known and any(w.startswith(low) and len(w) > len(low) for w in known)
    return plain or cut, plain, False


def truncated(answer: str, contexts: list[str], last_n: int, last_final: int) -> bool:
    """As ``verdicts``, for a last word of these counts in the corpus and at its sentences' ends."""
    never, often, other = verdicts(answer, contexts)
    return never if last_n == 0 else often if last_n >= OFTEN and last_final == 0 else other


_LAST = re.compile(r"([^\W\d_]+(?:[-'’][^\W\d_]+)*)[\W_]*$")


def folded_last(answer: str) -> str:
    """The last word in lower case and without accents, as the corpus counts have it; empty behind a number, which no count has."""
    m = _LAST.search(unicodedata.normalize("NFC", answer))
    return "".join(c for c in unicodedata.normalize("NFD", m.group(1).lower()) if not unicodedata.combining(c)) if m else ""


def defect(answer: str | None, question: str | None, contexts: list[str], last_n: int, last_final: int) -> str | None:
    if is_empty(answer):
        return "empty"
    if copies_question(answer, question):
        return "copies_question"
    if is_refusal(answer):
        return "refusal" if names_it(contexts, asked_about(question)) else None
    if other_language(answer, question):
        return "other_language"
    return "truncated" if truncated(answer, contexts, last_n, last_final) else None


# -- the operator --------------------------------------------------------------------------

_TOKEN = r"([\p{L}\p{M}]+(?:[-'’][\p{L}\p{M}]+)*)([.!?](?=$|[\"')\]]))?"


def word_counts(responses: DataFrame, cases: DataFrame) -> DataFrame:
    """(word, n, n_final) over all contexts, questions and answers; the last word of an answer without an end mark isn't counted.

    What stands between blanks is counted first, combined on the map side; only the
    distinct pieces are taken apart into words.
    """
    bodies = (
        responses.select(F.explode("contexts").alias("body"))
        .unionByName(responses.select(F.when(F.col("answer").rlike(r"[.!?]\W*$"), F.col("answer")).otherwise(F.regexp_replace("answer", r"\S+\s*$", "")).alias("body")))
        .unionByName(cases.select(F.col("question").alias("body")))
    )
    pieces = bodies.select(F.explode(F.split(F.translate("body", "\t\n\r\u00a0", "    "), " ")).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("c"))
    tokens = pieces.select("c", F.explode(F.regexp_extract_all(without_accents(F.lower("piece")), F.lit(_TOKEN), F.lit(0))).alias("t"))
    final = F.col("t").rlike(r"[.!?]$")
    return tokens.groupBy(F.regexp_replace("t", r"[.!?]$", "").alias("word")).agg(F.sum("c").alias("n"), F.sum(F.when(final, F.col("c")).otherwise(0)).alias("n_final"))


_READ = "answer string, t0 boolean, t1 boolean, t2 boolean, refusal boolean, contexts array<string>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What an answer and its contexts tell without the question; contexts go on only where they are needed again."""
    for b in batches:
        out = []
        for a, c in zip(b["answer"], b["contexts"], strict=True):
            a = a if isinstance(a, str) else None
            if is_empty(a):
                out.append((None, False, False, False, False, None))
                continue
            refusal = is_refusal(a)
            have = [x for x in c if isinstance(x, str)] if c is not None else []
            out.append((a, *((False, False, False) if refusal else verdicts(a, have)), refusal, have if refusal else None))
        x = pd.DataFrame(out, columns=["answer", "t0", "t1", "t2", "refusal", "contexts"])
        yield pd.concat([b[["key", "id"]].reset_index(drop=True), x], axis=1)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verdicts beside the question; a row whose verdict hangs on a word comes without one."""
    for b in batches:
        found, words, keep = [], [], []
        for a, q, t0, t1, t2, refusal, c in zip(b["answer"], b["question"], b["t0"], b["t1"], b["t2"], b["refusal"], b["contexts"], strict=True):
            q = q if isinstance(q, str) else None
            d = w = None
            if not isinstance(a, str):
                d = "empty"
            elif copies_question(a, q):
                d = "copies_question"
            elif refusal:
                d = "refusal" if names_it(list(c), asked_about(q)) else None
            elif other_language(a, q):
                d = "other_language"
            elif t0 and t1 and t2:
                d = "truncated"
            elif t0 or t1 or t2:
                w = folded_last(a)
            found.append(d)
            words.append(w)
            keep.append(d is not None or w is not None)
        out = b[["key", "t0", "t1", "t2"]].assign(defect=found, word=words)
        yield out[keep]


def pair_defects(responses: DataFrame, cases: DataFrame, key: str = "response_id") -> DataFrame:
    """(key, defect) for every defective response; repeated rows are each judged.

    ``responses`` has answer, contexts and case_id; ``cases`` has id (unique) and
    question.  A response without a case is judged without a question; null
    contexts are no contexts.

    Contexts are read where they lie and not shuffled, but for refusals.  The few
    answers that hang on how the corpus uses their last word are joined with the
    counts of just those words.
    """
    ws = Workspace(responses.sparkSession, "pairs")
    kind, ident = responses.schema[key].dataType.simpleString(), responses.schema["case_id"].dataType.simpleString()
    base = spread(responses.select(F.col(key).alias("key"), F.col("case_id").alias("id"), "answer", "contexts"))
    read = base.mapInPandas(_read, f"key {kind}, id {ident}, {_READ}")
    asked = read.join(cases.select("id", "question"), "id", "left")
    judged = ws.write(asked.mapInPandas(_judge, f"key {kind}, t0 boolean, t1 boolean, t2 boolean, defect string, word string"))[1]
    sure = judged.where("defect is not null").select("key", "defect")
    open_ = judged.where("defect is null")
    counts = word_counts(responses.select("answer", "contexts"), cases.select("question")).join(open_.select("word").distinct(), "word", "left_semi")
    x = hot_safe_left_join(open_, ws.write(counts)[1], ["word"])
    n, final = F.coalesce("n", F.lit(0)), F.coalesce("n_final", F.lit(0))
    cut = F.when(n == 0, F.col("t0")).when((n >= OFTEN) & (final == 0), F.col("t1")).otherwise(F.col("t2"))
    return sure.unionByName(x.where(cut).select("key", F.lit("truncated").alias("defect"))).withColumnRenamed("key", key)
