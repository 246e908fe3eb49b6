"""Personal data in free text: candidates, boosted trees, typed placeholders.

High-recall generators propose overlapping spans per kind; each span becomes a
vector of format, character n-gram and context features; one boosted model per
kind scores it; a threshold per kind, calibrated on held-out lines, accepts it;
of overlapping accepted spans the best scored stays.

Names are not looked up: words are scored by character n-grams of given names
and surnames of many languages beside those of other capitalised words.  A first
model sees only the span itself and is remembered per distinct span, so that
what cannot be a name in any context costs nothing more.

No labelled rows exist in the data, so the models are fitted on lines that this
module writes itself (``TRAINING_LINES`` per kind, a fixed seed): every kind in
many formats between words drawn at random, beside look-alikes.  A third of
the lines has names that the n-grams used for them have not seen, so that the
trees learn what unknown names look like.  Fitting reads no table and happens once per process, on the driver.
"""

from __future__ import annotations

import functools
import math
import random
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.boost import Boosted
from tessera.workspace import spread

KINDS = ("email", "phone", "id_number", "address", "name")
TRAINING_LINES = 2200
SEED = 20240611

# Given names of many languages, from which n-grams are learnt; no name is looked up.
GIVEN = """ana bruno camila davi elisa fabio gisele heitor iara jonas karina lucas marina nelson olivia paulo renata sergio tania vitor alice brian claire derek emma frank grace harry irene jack laura martin nora oscar
    peter rachel simon tessa walter zoe beatriz caio carlos cecilia diego eduardo fernanda gabriel helena henrique isabela joao juliana leonardo luiza marcelo mariana miguel patricia rafael ricardo sandra thiago vinicius
    andrew charlotte daniel elizabeth george hannah james jessica john kevin margaret michael rebecca robert samantha thomas victoria william alejandro carmen ignacio javier lucia pablo soledad antoine camille francois
    juliette mathieu sylvie benoit anke dieter friedrich gertrud jurgen klaus ulrike wolfgang alessandro chiara francesca giuseppe luca agnieszka jadwiga krzysztof malgorzata tomasz wojciech zbigniew dmitri ekaterina
    natalia sergei svetlana vladimir aiko haruto kenji sakura takeshi huong linh minh quang thuy ahmed fatima hassan leila omar yasmin abena chidi kofi ngozi oluwaseun thandiwe aarav deepika priya rajesh sunita
    astrid bjorn ingrid lars sigrid aoife ciaran niamh eoin ayse emre mehmet zeynep ana-maria ion mihai jiri lenka zoltan katalin""".split()
# Surnames of many languages, likewise.
SURNAMES = """silva santos oliveira pereira almeida barbosa carvalho moreira teixeira nogueira smith johnson taylor brown wilson thompson harrison whitfield garcia fernandez rodriguez gutierrez martinez dubois lefevre moreau
    girard schneider hoffmann zimmermann muller bergmann rossi ferrari esposito lombardi kowalski nowak wisniewski lewandowska ivanov petrova sokolov tanaka nakamura yamamoto kobayashi nguyen tran pham khan rahman
    hussain mensah okafor adeyemi dlamini sharma gupta iyer lindqvist johansson andersson nielsen murphy gallagher oconnor yilmaz demir popescu ionescu novak horvath nagy haddad cohen rosenberg vandenberg""".split()
# Capitalised words that begin sentences, name places, projects, days or sections.
_COMMON = """the this that these when where what which while after before because nobody somebody question note notes next step draft decision open status summary design release version table figure section chapter page
    monday friday january march august north south new old great saint lake mount river city port bay island street house open source data graph index search query token cache vector model user guide project team
    quando onde entre depois antes sobre porque quem ninguem cada numa segundo conforme embora por na no em o a os as um uma ponto pontos vida armadura classe monte rio porto ilha serra campo casa nova velho grande
    senhor senhora dona dom frei rei rainha torre ponte lagoa gruta caverna floresta ruina vila praca mapa livro parte capitulo tabela nota revisao contato segunda terca janeiro marco""".split()
_EPITHET = re.compile(r"(?:os[oa]|ad[oa]|id[oa]|in[oa]|ent[oa]|ic[oa]|eir[oa]|ante|ente|este|iv[oa]|an[oa]|i[oa]|al|ar|az|und[oa]|ut[oa]|e[oa]|ur[oa]|[bcdfglmprstv][oa]|til|vel|ro|co|go|do|to|no)$")

_UP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽƠƯẠ-Ỹ]"
_WORD = rf"{_UP}[\w\u0300-\u036f'’-]*"
_PART = r"(?:d[aeo]s?|e|van|von|der|den|del|della|di|du|la|le|bin|al|ter|zu)"
_STREET_PT = r"(?:[Rr]ua|RUA|R\.|[Aa]venida|AVENIDA|[Aa]v\.?|AV\.?|[Tt]ravessa|TRAVESSA|[Tt]rav\.|Tv\.|[Pp]ra[çc]a|PRA[ÇC]A|P[cç]a?\.|[Aa]lameda|ALAMEDA|Al\.|[Rr]odovia|RODOVIA|Rod\.|[Ee]strada|ESTRADA|Estr\.|[Ll]argo|LARGO|[Ll]adeira|LADEIRA|[Vv]iela|VIELA|[Bb]eco|BECO|Vila|VILA|Quadra|QUADRA|Calle|CALLE|Carrer|Paseo|Plaza|Via|VIA|Viale|Piazza|Corso|[Rr]ue|RUE|[Bb]oulevard|Chemin|[Uu]lica|[Uu]l\.|Strada|Str\.)"
_STREET_EN = r"(?:Street|STREET|St\.?|Road|ROAD|Rd\.?|Avenue|AVENUE|Ave\.?|AVE|Lane|LANE|Ln\.?|Drive|DRIVE|Dr\.?|Boulevard|Blvd\.?|Square|Sq\.?|Court|Ct\.?|Way|WAY|Place|Pl\.?|Terrace|Crescent|Row|Close)"
_STREET_ONE = r"[\w-]*(?:stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|straat|laan|gracht|gatan|vägen|vej|gade|katu|utca)"
_DOT = r"(?:\.|\s*[\[({<]\s*(?:dot|ponto|\.)\s*[\])}>]\s*|\s+(?:dot|ponto)\s+)"
_NO = r"(?:n[º°o.]\.?\s*|número\s+|num\.?\s*|no\.\s*|#\s*)?"

_GENERATORS: dict[str, list[re.Pattern[str]]] = {
    "phone": [re.compile(r"(?:\+|00)?(?:\d|\(\+?\d)(?:[ .\-/() ‐-―]{0,2}\d){6,15}(?:[ ,;]*(?:ext\.?|ramal|extension|r\.|x)\s*\d{1,6})?(?!\w)", re.I)],
    "id_number": [
        re.compile(r"\d(?:[ .\-/‐-―]?\d){5,17}(?:[ .\-]?[Xx])?(?![\w])"),
        re.compile(r"[A-Z]{1,3}[ .\-]?\d(?:[ .\-]?\d){4,9}(?:[ .\-]?[A-Z])?(?![\w])"),
        re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ],
    "address": [
        re.compile(rf"{_STREET_PT}\s+(?:{_PART}\s+)?(?:las\s+|los\s+)?{_WORD}(?:\s+(?:{_PART}\s+)?{_WORD}){{0,4}}\s*(?:,|-|–)?\s*{_NO}\d{{1,5}}\b"),
        re.compile(rf"\d{{1,5}}[A-Za-z]?,?\s+(?:{_WORD}\s+)(?:(?:{_PART}\s+)?{_WORD}\s+){{0,4}}{_STREET_EN}(?!\w)"),
        re.compile(rf"\d{{1,5}}(?:\s?bis)?,?\s+(?:rue|avenue|boulevard|chemin|place)\s+(?:{_PART}\s+)*(?:l['’])?{_WORD}(?:\s+{_WORD}){{0,3}}"),
        re.compile(rf"{_UP}{_STREET_ONE}\s+\d{{1,5}}[a-z]?\b|{_UP}[\w-]+[ -](?:Stra(?:ß|ss)e|Weg|Platz|Allee)\s+\d{{1,5}}[a-z]?\b"),
    ],
}
#: Runs of capitalised words or initials, with particles between them.
_RUN = re.compile(rf"{_UP}(?:\.(?:[ \t]?{_UP}\.)*|[\w\u0300-\u036f'’-]*)(?:[ \t]+(?:{_PART}[ \t]+){{0,2}}{_UP}(?:\.(?!\w)|[\w\u0300-\u036f'’-]*))+")
_BEHIND_COMMA = re.compile(rf",[ \t]+(?:{_UP}\.|{_WORD})(?![\w@])")
_BEFORE_COMMA = re.compile(rf"(?<![\w@.'’-]){_WORD}(?:[ \t]+{_WORD})?$")
_UNIT = re.compile(rf"(?:{_PART}[ \t]+)*(?:{_UP}\.(?:[ \t]?{_UP}\.)*|{_WORD})")
#: The middle of an e-mail address, and what follows it.
_MIDDLE = re.compile(r"[@＠]|\s*[\[({<]\s*(?:at|arroba|@)\s*[\])}>]\s*|\s+(?:at|arroba)\s+", re.I)
_HOST = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)+", re.I)

#: Words near a span, by what they speak for; fixed values.
_CUES = {
    "phone": "phone telephone tel telefone fone call calls ligar ligue liga zap whatsapp whats celular cel line answers reach reachable contato contact contacto mobile ramal discar dial sms text fax hotline plantao emergency urgencia",
    "id": "cpf rg id ids ssn social security document documento inscricao matricula card cartao badge passport passaporte identidade identity cnh registro user usuario nino personal cedula titular iban nif dni licence license carteira cadastro holder member",
    "object": "order orders pedido build issue lote codigo code commit version versao seed tiragem tabela range port isbn run magic edicao tokens rows exemplares ver see table dec ticket page pagina dano latency serial invoice fatura release patch chapter fixed limit ip ano year reads copies batch hash ms seconds linhas metros passos anos edition print revision",
    "person": "by por thanks thank owner author autor autora contato contact ask from with com signed asks thinks talked spoke written maintainer reviewer revisao traducao recado cuidados jogador player nome named name dear sr sra mr mrs ms dr prof senhor dona told wrote met obrigado obrigada assinado left called cc para to for aluno colega colleague friend vizinha doctor editor translator assigned responsavel falei conversei liguei entregue holder",
    "place": "caverna floresta gruta costa ilha ruina torre lagoa encosta cripta catacumba charneca cratera estepe geleira planicie ponte ravina varzea mina povo feira muro caminho docas perto em de near between towards around inside below module cartas dizem region city",
    "mail": "mail email e-mail correio escreva write reach ping falar mailto inbox address cc send mandar mande",
    "address": "at em na no mora moro lives live ship entregar entrega deliver meet visit deixar billing address endereco house casa sede office escritorio mesa copy parcel reside morada",
}
_CUE_SETS = {k: frozenset(v.split()) for k, v in _CUES.items()}
_CUE_OF = {w: tuple(i for i, s in enumerate(_CUE_SETS.values()) if w in s) for s in _CUE_SETS.values() for w in s}
_TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_STRICT_CV = re.compile(r"^(?:[bcdfgjlmnprstvz][aeiou]){2,5}n?$")


def fold(s: str) -> str:
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower().replace("ł", "l").replace("ø", "o").replace("đ", "d")) if not unicodedata.combining(c))


@dataclass
class Span:
    kind: str
    start: int
    end: int
    score: float = 0.0


# -- character n-grams ---------------------------------------------------------------------


class Grams:
    """Log odds per n-gram of words of one sort against another, with the word's ends."""

    def __init__(self, own: list[str], other: list[str], sizes: tuple[int, ...]):
        self.sizes = sizes
        a, b = (Counter(g for w in words for g in self.of(w)) for words in (own, other))
        na, nb, size = sum(a.values()), sum(b.values()), len(a | b)
        self.odds = {g: math.log((a[g] + 0.5) / (na + 0.5 * size)) - math.log((b[g] + 0.5) / (nb + 0.5 * size)) for g in a | b}
        self.known: dict[str, float] = {}

    def of(self, word: str) -> list[str]:
        w = f"<{word}>"
        return [w[i : i + n] for n in self.sizes for i in range(len(w) - n + 1)]

    def score(self, word: str) -> float:
        x = self.known.get(word)
        if x is None:
            grams = self.of(word)
            x = sum(self.odds.get(g, 0.0) for g in grams) / max(1, len(grams))
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = x
        return x


#: Every so many-th given name is written in training lines whose n-grams have not seen it.
UNSEEN = 4
_fold: list[bool] = [False]


@functools.lru_cache(maxsize=2)
def _grams(without: bool) -> tuple[Grams, Grams, Grams]:
    w = _Lines(SEED + 1)
    other = [*_COMMON, *(fold(w.invented()) for _ in range(900)), *(fold(w.epithet()) for _ in range(600))]
    made = [fold(w.surname()) for _ in range(700)]
    given, families = ([x for i, x in enumerate(own) if i % UNSEEN or not without] for own in (GIVEN, SURNAMES))
    return Grams(given * 4, other, (2, 3)), Grams(given * 4, other, (4, 5)), Grams(families * 4 + made, other, (2, 3))


def grams() -> tuple[Grams, Grams, Grams]:
    """Short and long n-grams of given names, and short ones of surnames, beside made-up names, epithets and common words."""
    return _grams(_fold[0])


# -- candidates ----------------------------------------------------------------------------


def propose(text: str) -> list[Span]:
    """Overlapping candidate spans of all kinds."""
    out = []
    for m in _MIDDLE.finditer(text):
        start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+'%-"):
            start -= 1
        while start < m.start() and not (text[start].isalnum() or text[start] == "_"):
            start += 1
        if start < m.start() and (host := _HOST.match(text, m.end())):
            out.append(Span("email", start, host.end()))
    for kind, patterns in _GENERATORS.items():
        beside = "_@./-" if kind != "address" else "_.-"
        for p in patterns:
            for m in p.finditer(text):
                if not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in beside):
                    out.append(Span(kind, m.start(), m.end()))
    for m in _RUN.finditer(text):
        a, b = m.span()
        if (a and (text[a - 1].isalnum() or text[a - 1] in "_@.'’-")) or (b < len(text) and text[b] in "@_"):
            continue
        units = [(u.start() + a, u.end() + a) for u in _UNIT.finditer(m[0])]
        for i, (start, _) in enumerate(units):
            while not text[start].isupper() and start < b:  # a particle in front of the first word is no part of the name
                start = text.index(" ", start) + 1 if " " in text[start:b] else b
            for _, end in units[i + 1 : i + 4]:
                out.append(Span("name", start, end))
    for m in _BEHIND_COMMA.finditer(text):
        low = max(0, text.rfind("\n", 0, m.start()), text.rfind(",", 0, m.start()))
        if front := _BEFORE_COMMA.search(text, low, m.start()):
            out.append(Span("name", front.start(), m.end()))
    return out


# -- features ------------------------------------------------------------------------------


def _near(words: list[str]) -> list[float]:
    out = [0.0] * len(_CUE_SETS)
    for w in words:
        for i in _CUE_OF.get(w, ()):
            out[i] = 1.0
    return out


def _wordy(w: str) -> list[float]:
    f = fold(w).strip(".,'’")
    given, longer, family = grams()
    return [given.score(f), longer.score(f), family.score(f), float(bool(_STRICT_CV.match(f))), float(len(f)), float(bool(_EPITHET.search(f))), float(w.isupper()), float(not w.isascii() and any(c in w for c in "łßøåäöüőűřžšçñėțșğıộễươ")), float("-" in w or "'" in w or "’" in w)]


def shape(body: str) -> list[float]:
    """Features of a possible name by itself."""
    tokens = body.split()
    swapped = "," in body
    own = [t for t in tokens if t[:1].isupper()] or tokens
    given, surname = (own[-1], own[0]) if swapped else (own[0], own[-1])
    middle = own[1] if len(own) > 2 else ""
    return [float(len(own)), float(len(tokens) - len(own)), float(swapped), float("." in given), float("." in body[:-1]), float(body.isupper()), *_wordy(given), *_wordy(surname), *(_wordy(middle)[:4] if middle else (0.0, 0.0, 0.0, 0.0))]


_PLAIN_WORD = re.compile(r"\S[^\s,]*")
_GROUP = re.compile(r"\d+|[A-Za-z]+")
_STOPS = re.compile(r"(?<=[\w)])[.!?]\s+")
_STOP = re.compile(r"[.!?](?:\s|$)")
_FRONT_STREET = re.compile(rf"(?:^|\W){_STREET_PT}\s*(?:{_PART}\s+)?$")
_BEHIND_STREET = re.compile(rf"\s*(?:{_UP}\w*\s+)?{_STREET_EN}(?!\w)")
_BEHIND_NUMBER = re.compile(r"\s*,?\s*(?:n[º°o.]\.?\s*)?\d")
_CAP_BEHIND = re.compile(rf"[ \t]+(?:{_PART}[ \t]+)?{_UP}")
_CAP_BEFORE = re.compile(rf"{_UP}[\w'’-]*[ \t]+(?:{_PART}[ \t]+)?$")
_OF_BEFORE = re.compile(r"[a-zà-ÿ]\s+d[aeo]s?\s*$")


def features(text: str, s: Span) -> list[float]:
    lo = text.rfind("\n", 0, s.start) + 1
    hi = text.find("\n", s.end)
    hi = len(text) if hi < 0 else hi
    before, body, after = text[max(lo, s.start - 60) : s.start], text[s.start : s.end], text[s.end : min(hi, s.end + 40)]
    left = [fold(w) for w in _TOKEN.findall(_STOPS.split(before)[-1])]
    right = [fold(w) for w in _TOKEN.findall(_STOP.split(after)[0])]
    around = [
        *_near(left[-2:]), *_near(left[-6:]), *_near(right[:2]), *_near(right[:6]),
        float(not before.strip(" #*->|\"'")), float(not after.strip(" .|\"'")), float(before.lstrip().startswith("#")), float(before.endswith((": ", ":", "- "))), float(before.endswith(("(", "<", "[", "|", "| ", ";"))),
        float(after[:1] in ("<", "(", "|", ";") or after[:2] in (" <", " (", " |", " ;")), float(after[:1] in (",", ":")), float(len(left)), float(len(right)), float(bool(left) and not left[-1] in _CUE_OF), float(_GROUP.match(after.strip()) is not None and after.strip()[:1].islower()),
    ]
    if s.kind == "name":
        return around + list(shape(body)) + [
            float(bool(_FRONT_STREET.search(before))), float(bool(_BEHIND_STREET.match(after))), float(bool(_BEHIND_NUMBER.match(after))), float(bool(_OF_BEFORE.search(before))), float(bool(_CAP_BEHIND.match(after))), float(bool(_CAP_BEFORE.search(before))),
            float("@" in text[lo:hi]), float(text[lo:hi].isupper()), float(min(text.count(_PLAIN_WORD.match(body)[0]), 4)),
        ]
    groups = _GROUP.findall(body)
    lens = [len(g) for g in groups]
    digits = sum(c.isdigit() for c in body)
    line = text[lo:hi]
    return around + [
        float(digits), float(len(groups)), *[float(x) for x in (lens + [0] * 5)[:5]], float(lens[-1] if lens else 0), float(body.startswith(("+", "00"))), float("(" in body), float("." in body), float("-" in body), float(" " in body),
        float("/" in body), float("x" in body.lower() or "ramal" in body.lower()), float(body[:1].isalpha()), float(body[:1] == "0"), float(body[-1:] in "Xx"), float(body[:2] in ("19", "20")), float(len(set(body) & set("0123456789"))),
        float(line.count("|") + line.count(";")), float("@" in line), float("@" in body), float(body.count(" ")),
    ]


# -- training lines ------------------------------------------------------------------------

# Words between which values are written; no sentences.
_FILL = {
    "pt": "ontem hoje talvez cedo tarde depois quase sempre nunca outro outra livro chuva porta mesa carta vento pedra janela estrada ainda muito pouco enquanto porque quando tudo nada algum grupo dados lista jogo campanha ficha sala semana viagem grito noite".split(),
    "en": "yesterday today maybe early late then almost always never other another book rain door table letter wind stone window road still much little while because when all nothing some group data list game campaign sheet room week trip shout night".split(),
}
# What may stand right before and behind a value of a kind, as words only.
_BEFORE = {
    "email": "e-mail:|mail|send it to|mande para|escreva a|copy to|inbox|contato|write|ping|responder a|mailto:|<|(|cc:|",
    "phone": "tel.|fone:|celular|ligue|phone|call|mobile|whatsapp|dial|ramal geral|contact|numero|text me on|fax|reach us on|(|o zap|atende no|answers on|line|",
    "id_number": "CPF|RG:|passaporte|passport|ID|documento|document|social security|matricula|carteira|membership card|identity card|badge|usuario id|inscricao|IBAN|license|CNH|registro de|DNI|nome e CPF|||||",
    "address": "mora em|vive na|lives at|address:|endereco|deliver to|entregar em|visit us at|office:|sede:|ship to|a casa fica na|moved to|parcel for|billing|",
    "name": "by|por|com|from|asked|author:|autora:|Dear|para|Sra.|Mr.|colega|nosso editor|friend|assinado|de|owner -|reviewer:|jogador|com o vizinho|spoke with|falei com|paid to|thanks|obrigado,|traducao|revisado por|aos cuidados de|o recado de|entregue a|@|#|a nome de|assigned to|to|cc|||||||",
}
_BEHIND = {
    "email": "|.|,|>|)| please| se puder| ou por carta| soon| |",
    "phone": "|.|,|)| after nine| depois das nove| or write| ate sexta| extension unknown|;| |",
    "id_number": "|.|,|;| valid until May| vencido| on the form| is hers| em nome dele| is what the card says| belongs to the member| is the number of the holder| of the player| na ficha|)| |",
    "address": "|.|,| apto 31| 2nd floor| fundos| on Tuesday| and waits| na esquina| bloco C|;| |",
    "name": "|.|,|:| wrote this| disse sim| agrees| e o irmao| and others| on the phone|;|)| <a@b.test>| mora longe| called twice| chegou cedo| asked again| thinks otherwise| pediu ajuda| rolou mal| viu tudo| has the keys| keeps a copy| ligou ontem| left| lives here| saiu cedo| (editor)| ate amanha| yesterday| |",
}


class _Lines:
    """Writes lines with labelled spans, and look-alikes without; another choice of words makes another writer."""

    def __init__(self, seed: int, given: list[str] | None = None, surnames: list[str] | None = None, before: dict[str, str] | None = None, behind: dict[str, str] | None = None):
        self.r = random.Random(seed)
        self.names, self.families, self.before, self.behind = given or GIVEN, surnames, before or _BEFORE, behind or _BEHIND

    def one(self, *xs: str) -> str:
        return self.r.choice(xs)

    def digits(self, form: str) -> str:
        return "".join(str(self.r.randrange(10)) if c == "9" else c for c in form)

    def invented(self, n: int | None = None) -> str:
        s = "".join(self.r.choice("bcdfgjlmnprstvz") + self.r.choice("aeiou") for _ in range(n or self.r.choice((3, 3, 3, 4))))
        return s.capitalize() + ("n" if self.r.random() < 0.1 else "")

    def epithet(self) -> str:
        """What follows a creature's name: an adjective, real or made up."""
        if self.r.random() < 0.35:
            return self.one("Rubro", "Cego", "Mudo", "Oco", "Velho", "Bravo", "Calvo", "Pardo", "Torto", "Manco", "Surdo", "Negro", "Alvo", "Feroz", "Voraz", "Vil", "Frio", "Nobre", "Livre", "Triste", "Febril", "Sutil", "Cruel", "Fugaz", "Ocre", "Puro", "Magro", "Grave")
        stem = self.one("Cav", "Torm", "Silv", "Escam", "Nebul", "Fer", "Lam", "Som", "Palud", "Ard", "Raiv", "Trov", "Negr", "Pedr", "Verd", "Marc", "Long", "Cinz", "Ver", "Lun", "Gel", "Tard", "Rast", "Esp", "Venen", "Tri", "Col", "Dim", "Vítr", "Azul", "Dour", "Cor", "Per", "Sal", "Not", "Im", "Ac")
        return stem + self.one("oso", "ado", "ino", "ento", "ico", "eiro", "ante", "ivo", "ano", "ido", "io", "al", "ar", "az", "undo", "uto", "ente", "eo", "este", "ão", "ida", "uro", "ático", "ejante", "ectral", "ossal", "uto", "urno", "gido")

    def surname(self) -> str:
        if self.families:
            return self.r.choice(self.families).title()
        x = self.r.random()
        if x < 0.45:
            return self.r.choice(SURNAMES).title() if x < 0.35 else self.invented()
        stem = self.one("Mor", "Alv", "Torr", "Barr", "Camp", "Crist", "Holl", "Stern", "Brand", "Mart", "Fern", "Gonç", "Silv", "Cost", "Park", "Wall", "Bent", "Carv", "Monte", "Ferr", "Lund", "Gart", "Hest", "Pest", "Vald", "Rost", "Kamin", "Osb", "Greg", "Pasc", "Johnst", "Whit", "Queir", "Bapt", "Dorn", "Kast", "Felg", "Wint", "Lanv", "Arkh", "Jung")
        return stem + self.one("eira", "es", "alho", "ado", "inho", "ini", "son", "man", "ley", "ton", "ares", "ostra", "ino", "berg", "sky", "ovic", "ório", "ulo", "ansen", "ar", "el", "endes", "inski", "stone", "ani", "oz", "al", "os", "er", "ari", "avel", "amar", "eixo", "olani", "ulhos")

    def given(self) -> str:
        g = self.r.choice(self.names)
        return "-".join(x.capitalize() for x in g.split("-")) if g.islower() else g

    def name(self) -> str:
        g, s = self.given(), self.surname()
        n = self.one(f"{g} {s}", f"{g} {s}", f"{g} {s}", f"{g[0]}. {s}", f"{s}, {g}", f"{g} {s} {self.surname()}", f"{g} {self.one('da', 'de', 'dos', 'van', 'von')} {s}", f"{g} {s}-{self.surname()}", f"{g} {self.invented()[0]}. {s}")
        return n.upper() if self.r.random() < 0.1 else n

    def email(self) -> str:
        g, s = re.sub(r"\W", "", fold(self.given())), re.sub(r"\W", "", fold(self.surname()))
        local = self.one(f"{g}.{s}", f"{g[0]}{s}", f"{g}_{self.digits('99')}", f"{s}.{g}+lista", g, f"{s}{self.digits('9')}")
        host = self.one("mail", "posta", "team", "my-host", "caixa", "box9") + self.one(".example", ".test", ".invalid", ".example.org", ".com.br", ".co.uk")
        a = self.one("@", "@", "@", " (at) ", " [at] ", " at ", " (arroba) ", "(arroba)", " arroba ")
        if "at" in a or "arroba" in a:
            host = host.replace(".", self.one(".", " dot ", " [dot] ", "[ponto]", " ponto ", " (dot) "))
        out = local + a + host
        return out.upper() if self.r.random() < 0.05 else out

    def phone(self) -> str:
        p = self.digits(self.one(
            "(99) 99999-9999", "99 999999999", "+55 99 99999 9999", "+55 (99) 9999-9999", "(99) 9999-9999", "099 9999.9999", "099 9999 9999", "555-555-9999", "(555) 555-9999", "+1 555 555 9999", "+1-555-555-9999",
            "+44 20 9999 9999", "99 99999-9999", "999.999.9999", "+55999999999", "99999-9999", "9999-9999", "0800 999 9999", "+351 999 999 999", "(099) 99999-9999", "+49 30 9999999", "+33 9 99 99 99 99"))
        return p + (self.digits(self.one(" ext. 99", " ramal 999", " x9999")) if self.r.random() < 0.15 else "")

    def id_number(self) -> str:
        letters = lambda n: "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVXYZ") for _ in range(n))
        return self.digits(self.one("999.999.999-99", "99999999999", "999 999 999 99", "99.999.999-9", "99.999.999-X", "999-99-9999", f"{letters(2)}999999", f"{letters(2)}999999{letters(1)}", "9999999999", "9.999.999", "999.999.999/99", "99999999-X", f"{letters(2)} 999999", "999999999-99", f"{letters(1)}9999999", f"{letters(2)}99 9999 9999 9999 9999 99"))

    def address(self) -> str:
        n = self.digits(self.one("9", "99", "999", "9999")).lstrip("0") or "7"
        street = self.one(self.invented(), f"{self.invented()} de {self.invented()}", f"{self.invented()} {self.surname()}", self.surname(), f"das {self.one('Flores', 'Pedras', 'Palmas')}", f"{self.given()} {self.surname()}")
        x = self.r.random()
        if x < 0.55:
            return f"{self.one('Rua', 'R.', 'Avenida', 'Av.', 'Travessa', 'Praça', 'Alameda', 'Estrada', 'Rodovia', 'rua', 'Largo')} {street}{self.one(', ', ', nº ', ' ', ', n. ', ' nº ', ', número ')}{n}"
        if x < 0.7:
            return self.one(f"Calle {self.surname()} {n}", f"{self.surname()}{self.one('straße', 'weg', 'gasse', 'straat')} {n}", f"{n} rue {self.one('de ', 'du ', '')}{self.surname()}", f"Via {self.surname()}, {n}", f"ul. {self.surname()} {n}")
        return f"{n} {street} {self.one('Street', 'Road', 'Ave', 'Lane', 'St', 'Drive', 'Avenue', 'Rd')}"

    def fill(self, most: int) -> str:
        words = _FILL[self.one("pt", "en")]
        return " ".join(self.r.choice(words) for _ in range(self.r.randrange(most + 1)))

    def labelled(self, kind: str) -> tuple[str, list[Span]]:
        """A value between words drawn at random, sometimes in a row of fields."""
        v = getattr(self, kind)()
        if self.r.random() < 0.12:
            others = [getattr(self, k)() for k in self.r.sample([k for k in KINDS if k != kind], 2)]
            cells = [others[0], v, others[1]] if self.r.random() < 0.6 else [v, *others]
            bar = self.one(" | ", ";", "; ", " - ", ", ", ", ")
            a = bar.join(cells[: cells.index(v)])
            a = ("| " if bar == " | " else "") + (a + bar if a else self.r.choice(self.before[kind].split("|")).capitalize() + " " if bar == ", " else "")
            b = "".join(bar + c for c in cells[cells.index(v) + 1 :])
        else:
            cue, behind = self.r.choice(self.before[kind].split("|")), self.r.choice(self.behind[kind].split("|"))
            a = self.fill(4).capitalize()
            if kind == "name" and self.r.random() < 0.2:  # right behind the capital that begins a sentence
                a, cue = self.one(*_FILL["pt"], *_FILL["en"]).capitalize(), ""
            a = " ".join(x for x in (a + (self.one("", "", ",", ".", ":") if cue else "") if a else "", cue.capitalize() if not a and self.r.random() < 0.7 else cue) if x)
            if cue and a[-1:].isalpha() and self.r.random() < 0.25:
                a += " " + self.one("do jogador", "of the", "de casa", "novo", "is", "da ficha", "number", "numero", self.fill(2)).strip()
            a += "" if not a or a.endswith(("(", "<", "mailto:", "@")) else " "
            b = behind + (" " + (self.fill(5) if self.r.random() < 0.75 else self.fill(5).capitalize()) if self.r.random() < 0.6 else "")
            if self.r.random() < 0.12:
                a = self.one("# ", "- ", "// ", "> ") + a
        return a + v + b, [Span(kind, len(a), len(a) + len(v))]

    def decoy(self) -> str:
        d, i, n = self.digits, self.invented, self.one
        creature = f"{i()} {self.epithet() if self.r.random() < 0.6 else _Lines.surname(self)}"
        thing = n("order", "build", "issue", "batch", "edition", "commit", "ticket", "version", "seed", "serial", "invoice", "pedido", "lote", "código", "tabela", "versão", "edição", "fatura", "tiragem", "revision", "release", "port", "range", "run", "isbn")
        number = d(n("9999-9999-99", "99999", "9999-999", "99.9.9", "999999999", "2024-99-99", "20249999", "9999-99", "9.99.9-9", "999-999", "9999999999999", "2023.99.99", "99999999999", "999-999-9999", "9.9-99", "99.9.9-99.9.9", "999 ms", "9999:99", "199.99.9.99:9999"))
        verb = n("espera", "vigia", "come", "dorme", "segue", "sleeps", "sorts", "drops", "counts", "avoids", "teme", "ronda", "arrasta")
        tail = n("", ".", f" {self.fill(4)}", f", {self.fill(3)}", f" {d('99')} {n('passos', 'steps', 'anos', 'rows')}")
        lead = n("", "", self.fill(3).capitalize() + " ", n("Em", "Entre", "Perto de", "Near", "Between", "Para", "Com", "De", "Depois", "Então", "Por", "Inside", "After") + " ")
        return self.r.choice((
            lambda: f"{self.fill(3)} {thing} {number}{tail}".strip(), lambda: f"{thing.capitalize()}: {number} {self.fill(3)}", lambda: f"{n('ver', 'see', 'cf.', 'in')} {thing} {number}, {n('code', 'código', 'lote', 'run', 'issue', 'item')} {d(n('9999-9999', '99999-999', '9999 9999', '999.9999'))}{tail}", lambda: f"{number} {thing}s {self.fill(2)}", lambda: f"# {self.fill(1)} {thing} {number}", lambda: number,
            lambda: f"{lead}{creature} {verb}{tail}", lambda: f"{lead}{creature}{tail}", lambda: f"{lead}{i()} {verb}{tail}", lambda: f"{lead}{creature}, {self.fill(2)}", lambda: f"{n('# ', '## ', '- ', '')}{creature}", lambda: creature.upper(), lambda: f"{self.fill(2)} {n('de', 'com', 'a', 'para', 'que', 'of', 'with')} {creature}{tail}".strip(),
            lambda: f"{n(*_FILL['pt'], *_FILL['en'], *_COMMON).capitalize()}, {i()} {verb}{tail}", lambda: f"{self.fill(3).capitalize()} {n(*_COMMON).capitalize()}, {i()}{tail}",
            lambda: f"{creature} e {i()} {self.epithet()}{tail}", lambda: f"{lead}{i()} {n('e', 'and', 'ou')} {i()}, {self.fill(3)} {d('9999')}", lambda: f"{i()}, {i()} {self.epithet()} {verb}{tail}", lambda: f"{n('Thanks', 'Obrigado', 'Nota', 'Note', 'By', 'Dear')}{n(', ', ': ', ' ')}{creature}",
            lambda: f"{n('Rua', 'Praça', 'Avenida', 'Street', 'Alameda')} {n('dos Sinos', 'do Sal', i(), f'{i()} Velho')}{n(', em ' + i(), ' fica vazia', '')}", lambda: f"{n('Senhor', 'Dona', 'Rei', 'Frei')} {n('das', 'da', 'do')} {n('Névoa', 'Cinza', 'Mar', i())} {verb}", lambda: f"{n('New', 'Old', 'Porto', 'Monte', 'Lake', 'Saint', 'Serra', 'Ponte', 'Torre')} {n(i(), 'Claro', 'Velho', 'Road')} {self.fill(2)}",
            lambda: " ".join(n(*_COMMON).capitalize() for _ in range(self.r.randrange(2, 5))) + " " + self.fill(3), lambda: " ".join(n(*_COMMON, *_FILL["pt"], *_FILL["en"], i(), thing) for _ in range(9)).upper() + tail, lambda: f"{n(*_COMMON).capitalize()} {i()} {verb}{tail}", lambda: f"{n(*_COMMON).capitalize()} {creature} {verb}{tail}", lambda: f"{n('Quando', 'When', 'If', 'Se')} {self.fill(2)}, {creature} {verb}{tail}",
            lambda: f"@{n('wraps', 'cached', 'property')} {n('at', '')} {self.fill(2)}", lambda: f"{self.fill(2)} at {d('99')} dot {self.fill(2)}", lambda: f"{thing} {number} at {i()} {verb}", lambda: f"A{n('', 's')} {n('Casa', 'Feira', 'Ordem', 'Guarda')} {n('de', 'do', 'da')} {i()} {verb}", lambda: f"{self.fill(2).capitalize()} {n('Open', 'Design', 'Data', 'Graph', 'User')} {n('Questions', 'Notes', 'Guide', 'Index', 'Search')}",
            lambda: f"{i().upper()} {n(*_FILL['pt'], *_FILL['en']).upper()} {n(*_FILL['pt']).upper()} {n('PERTO DE', 'EM', 'COM', 'NEAR', 'AND')} {i().upper()}", lambda: f"{n(*_FILL['pt']).upper()} {creature.upper()} {verb.upper()} {n(*_FILL['pt']).upper()}", lambda: f"{verb.capitalize()} {creature}; {self.fill(2)}", lambda: f"{creature}; {i()} {self.epithet()}; {i()} {self.epithet()}", lambda: f"{creature} | {d('99')} | {number}",
        ))()


#: The first model passes whatever scores a quarter of what all but this share of true names reach.
LOST = 0.001


#: In texts look-alikes are so many times as frequent, beside true values, as in the training lines; thresholds are calibrated for that.
RARER = 3
#: Names are the hardest and have more lines than the others.
_TURNS = (*KINDS, "name", "name")


@functools.lru_cache(maxsize=1)
def models() -> dict[str, tuple[Boosted, float]]:
    """Per kind the fitted model and its threshold, the best F1 on held-out lines with frequent look-alikes; ``shape`` is the first model for names."""
    known, unseen = _Lines(SEED), _Lines(SEED + 2, given=GIVEN[::UNSEEN], surnames=SURNAMES[::UNSEEN])
    rows: dict[str, list[tuple[list[float], float]]] = {k: [] for k in KINDS}
    bodies: list[tuple[list[float], float]] = []
    total = 2 * TRAINING_LINES * len(KINDS)
    for n in range(total):
        _fold[0] = n >= total * 2 // 3
        w = unseen if _fold[0] else known
        text, true = w.labelled(_TURNS[n // 2 % len(_TURNS)]) if n % 2 else (w.decoy(), [])
        if n % 10 == 1:  # a value may stand in a line with a look-alike in front
            front = w.decoy().rstrip(".,") + ". "
            text, true = front + text, [Span(t.kind, t.start + len(front), t.end + len(front)) for t in true]
        if w.r.random() < (0.04 if true else 0.4):  # a text about a creature names it again and again, one about a person sometimes
            text, true = f"{text} {text}", true + [Span(t.kind, t.start + len(text) + 1, t.end + len(text) + 1) for t in true]
        for s in propose(text):
            exact = any(t.kind == s.kind and abs(t.start - s.start) <= 1 and abs(t.end - s.end) <= 1 for t in true)
            part = any(t.kind == s.kind and t.start <= s.start and s.end <= t.end for t in true)
            if (part and not exact and s.kind != "name") or (true and not exact and "@" in text[s.start : s.end]):
                continue  # part of a true value is neither right nor wrong
            if true and not exact and not part and s.kind != true[0].kind and len(text) > 20 and text.count(";") + text.count("|") + text.count(" - ") + text.count(", ") > 1:
                continue  # in a row of fields the others are true values too
            rows[s.kind].append((features(text, s), float(exact)))
            if s.kind == "name":
                bodies.append((shape(text[s.start : s.end]), float(exact)))
    _fold[0] = False
    out = {}
    for kind, own in [*rows.items(), ("shape", bodies)]:
        x, y = np.array([f for f, _ in own]), np.array([t for _, t in own])
        held = np.arange(len(x)) % 5 == 0
        model = Boosted(rounds=120 if kind in ("name", "id_number") else 50, depth=4, sample=0.35).fit(x[~held], y[~held])
        p = model.score(x[held])
        if kind == "shape":
            out[kind] = (model, float(np.quantile(p[y[held] == 1], LOST)) / 4)
            continue
        true = y[held] == 1
        best = max((2 * (p[true] >= t).sum() / max(1, (p[true] >= t).sum() + RARER * (p[~true] >= t).sum() + true.sum()), -abs(t - 0.5), t) for t in np.linspace(0.1, 0.95, 35))
        out[kind] = (model, float(best[2]))
    return out


# -- detection -----------------------------------------------------------------------------

_POSSIBLE: dict[str, bool] = {}


def _possible_names(bodies: set[str], first: tuple[Boosted, float]) -> None:
    """Remembers for each new span whether it could be a name in some context."""
    new = [b for b in bodies if b not in _POSSIBLE]
    if len(_POSSIBLE) > 1_000_000:
        _POSSIBLE.clear()
        new = list(bodies)
    if new:
        model, least = first
        for b, p in zip(new, model.score(np.array([shape(b) for b in new])), strict=True):
            _POSSIBLE[b] = bool(p >= least)


def detect(texts: list[str | None], fitted: dict[str, tuple[Boosted, float]]) -> list[list[Span]]:
    """Accepted spans per text, in order and without overlap."""
    spans = [propose(t) if t else [] for t in texts]
    _possible_names({texts[i][s.start : s.end] for i, found in enumerate(spans) for s in found if s.kind == "name"}, fitted["shape"])
    for kind in KINDS:
        model, least = fitted[kind]
        own = [(i, s) for i, found in enumerate(spans) for s in found if s.kind == kind and (kind != "name" or _POSSIBLE[texts[i][s.start : s.end]])]
        for found in spans:
            for s in found:
                if s.kind == kind:
                    s.score = -1.0
        if own:
            for (_, s), p in zip(own, model.score(np.array([features(texts[i], s) for i, s in own])), strict=True):
                s.score = float(p) - least if p >= least else -1.0
    out = []
    for found in spans:
        taken: list[Span] = []
        # e-mails and addresses first; of numbers the longest, since a part of a phone number can look like another number
        rank = {"email": 0, "address": 1, "phone": 2, "id_number": 2, "name": 3}
        for s in sorted((s for s in found if s.score >= 0), key=lambda s: (rank[s.kind], (s.start - s.end) if rank[s.kind] == 2 else 0, -s.score, s.start - s.end)):
            if all(s.end <= t.start or t.end <= s.start for t in taken):
                taken.append(s)
        out.append(sorted(taken, key=lambda s: s.start))
    return out


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text with placeholders, found array<struct<kind, line_no>>) per row.

    Null stays null; lines are counted from 1 and split at line feeds; all other
    characters are kept as they are.  A map without shuffle.
    """
    fitted = models()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            shown, found = [], []
            for t, spans in zip(texts, detect(texts, fitted), strict=True):
                ends = [m.start() for m in re.finditer("\n", t)] if spans else []
                shown.append(redact(t, spans) if t is not None else None)
                found.append([{"kind": s.kind, "line_no": bisect_right(ends, s.start - 1) + 1} for s in spans])
            yield pd.DataFrame({"key": b["key"], "text": shown, "found": found})

    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.mapInPandas(run, f"key {kind}, text string, found array<struct<kind string, line_no int>>").withColumnRenamed("key", key)
