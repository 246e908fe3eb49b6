"""Noise in text from scanned pages: headers, page numbers, hyphens, misread characters.

1. Page edges: every first and last line gets a key that survives misreadings
   (look-alike characters fall together) and numbers; keys, and their beginnings
   up to a colon, that recur on several pages of a book are titles.  Lines with
   such a key, or with trigrams like it, are running headers anywhere on a page.
   Decorated numbers are page numbers; a bare number is one if it keeps the
   distance to the page's place that most bare numbers of the book keep.
2. Reading order: the text line that follows a page's last one is found through
   page summaries, in blocks of ``BLOCK`` pages, so no book is sorted in one task.
3. Corpus vocabulary: counts of whole words and of compounds.  A line's end is a
   break within a word unless the compound is the commoner reading.
4. Misreadings: every vocabulary word that becomes a much commoner word by
   undoing look-alikes is a misread form; lines are matched against these forms.

Nothing is collected; per-book and per-word statistics are aggregations, joins
split hot keys.  Defined cases: null or empty lines arrays fall back to the text;
pages without both have no lines; null lines are blank lines.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.workspace import Workspace, spread

#: Pages of a book whose order one task settles.
BLOCK = 512
#: A misread form has at most this share of the right word's count; of words of two letters, the second.
RARE, RARE_SHORT = 0.15, 0.02

#: Words above so many letters are searched by their bones for what two look-alikes can't reach; shorter ones also by trial.
LONG = 24
#: Letters that the key of a running header has at least.
SHORTEST = 5

#: Characters that break words at line ends; the last three are never a compound's own hyphen.
HYPHENS = "-‐­¬"
# What scanners make of characters; fixed values, misread form first.
SYMBOLS = {"@": "a", "0": "o", "5": "s", "†": "t", "!": "i", "1": "l", "9": "g", "\\/": "v", "8": "b", "¢": "ç", "|": "l", "$": "s", "€": "e", "ﬁ": "fi", "ﬂ": "fl"}
SYMBOLS_TOO = {"6": "é", "1": "i", "9": "q", "3": "e", "4": "a", "7": "t", "2": "z"}
LETTERS = {"c": "e", "ri": "n", "cl": "d", "rn": "m", "ii": "u", "li": "h", "n": "rr", "à": "á", "ä": "ã", "í": "i", "vv": "w", "è": "é", "ö": "õ", "ü": "ú", "ì": "í", "ò": "ó", "ù": "ú", "â": "ã", "ê": "é", "tl": "d", "in": "m"}
_SKELETON = [("rn", "m"), ("ri", "n"), ("rr", "n"), ("li", "h"), ("cl", "d"), ("ii", "u"), ("\\/", "v"), ("vv", "w")]
_SAME = str.maketrans({"0": "o", "1": "i", "!": "i", "l": "i", "|": "i", "5": "s", "@": "a", "8": "b", "†": "t", "9": "g", "q": "g", "c": "e", "¢": "e", "6": "e"})


def plain(s: str) -> str:
    """Without accents."""
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def fold(s: str) -> str:
    return plain(s).lower()


def skeleton(s: str) -> str:
    """A form in which look-alikes fall together."""
    s = fold(s)
    for a, b in _SKELETON:
        s = s.replace(a, b)
    return s.translate(_SAME)


# -- page edges ----------------------------------------------------------------------------

_V = r"(?:[0-9lIOoSsBgZ|!]{1,5}|[ivxlcIVXLC]{1,7})"
_STYLES = [
    ("page", re.compile(rf"^\W*p[aàá@]g[il1!]n[a@]\W+({_V})\W*$", re.I)),
    ("page", re.compile(rf"^\W*p[aá@]ge?\.?\s*({_V})\s*(?:(?:/|de|of)\s*{_V})?\W*$", re.I)),
    ("trim", re.compile(rf"^[^\w\s]+\s*({_V})\s*[^\w\s]+$")),
    ("trim", re.compile(rf"^({_V})\s*(?:/|de|of)\s*{_V}$")),
    ("bare", re.compile(rf"^({_V})$")),
]
_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "!": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "g": "9", "Z": "2", "i": "1"})
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_ENDS = re.compile(rf"^\W*{_V}\s{{2,}}|\s{{2,}}{_V}\W*$")


def number_of(v: str, trimmed: bool = False) -> tuple[int, bool] | None:
    """Value of a number as printed or misread, and whether it is Roman; trimmings around it allow misread digits only."""
    low = v.lower()
    if not any(c.isdigit() for c in v) and re.fullmatch(r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", low) and low:
        n = 0
        for a, b in zip(low, low[1:] + " ", strict=True):
            n += -_ROMAN[a] if _ROMAN.get(b, 0) > _ROMAN[a] else _ROMAN[a]
        return n, True
    d = v.translate(_DIGITS)
    return (int(d), False) if d.isdigit() and (trimmed or any(c.isdigit() for c in v)) else None


@functools.lru_cache(maxsize=100_000)
def page_number(line: str) -> tuple[str, int, bool] | None:
    s = unicodedata.normalize("NFC", line).strip()
    if not s:
        return None
    for style, p in _STYLES:
        m = p.match(plain(s))
        if m and (n := number_of(m.group(1), style != "bare")):
            return style, *n
    return None


@functools.lru_cache(maxsize=100_000)
def header_key(line: str) -> tuple[str, str]:
    """Key of a header without its page number, and of its beginning up to a colon."""
    s = _ENDS.sub(" ", plain(line.strip()))
    clean = lambda x: " ".join(w for w in re.findall(r"[a-z]+", skeleton(re.sub(r"(?<!\S)\d+[:.,]?(?!\S)", " ", x))) if len(w) > 1)
    return clean(s), clean(s.split(":")[0]) if ":" in s else ""


@functools.lru_cache(maxsize=100_000)
def _title_like(line: str) -> bool:
    s = _ENDS.sub(" ", plain(line.strip())).strip()
    return bool(s) and not re.search(rf"[.,;!?{re.escape(HYPHENS)}]$", s) and not s[:1].islower()


_EDGE = "page_id bigint, book string, number int, line_no int, edge boolean, top boolean, key string, head string, title boolean, style string, value int, roman boolean"
_NO_TITLE = tuple(".,;!?" + HYPHENS)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines at a page's edges, and lines anywhere in it that look like a title."""
    for b in batches:
        out = []
        for pid, book, number, lines in zip(b["page_id"], b["book"], b["number"], b["lines"], strict=True):
            lines = [x or "" for x in lines] if lines is not None else []
            filled = [i for i, x in enumerate(lines) if x.strip()]
            near = {*filled[:2], *filled[-2:]}
            for i in filled:
                edge = i in near
                if not edge:
                    s = lines[i].strip()
                    if s[-1] in _NO_TITLE or s[0].islower() or not _title_like(s):
                        continue
                else:
                    n, outer = page_number(lines[i]), i in (filled[0], filled[-1])
                    top = i in filled[:2] and (i == filled[0] or i not in filled[-1:])
                    if not outer and not n and not page_number(lines[filled[0] if top else filled[-1]]):
                        edge = False  # a second line counts only beside a page number, or as one
                key, head = header_key(lines[i])
                if edge:
                    out.append((pid, book, number, i + 1, True, top, key, head, _title_like(lines[i]), *(n or (None, None, None)), outer))
                else:
                    out.append((pid, book, number, i + 1, False, False, key, head, _title_like(lines[i]), None, None, None, True))
        df = pd.DataFrame(out, columns=["page_id", "book", "number", "line_no", "edge", "top", "key", "head", "title", "style", "value", "roman", "outer"])
        df.loc[~df["outer"].astype(bool) & (df["style"] == "bare"), "style"] = None
        yield df.drop(columns="outer").astype({"value": "Int32", "roman": "boolean"})


#: Share of common character trigrams that makes two title keys of a book the same title.
ALIKE = 0.6


def _trigrams(key: Column) -> Column:
    """Distinct trigrams of a key and its ends."""
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


def similar_keys(known: DataFrame, others: DataFrame) -> DataFrame:
    """(book, key) of ``others`` whose trigrams are like those of a known key of the book (both: book, key).

    Only keys that share a trigram meet, each pair counted by its shared trigrams.
    """

    def grams(df: DataFrame, name: str) -> DataFrame:
        own = df.select("book", "key", _trigrams(F.col("key")).alias("grams"))
        return own.select("book", F.col("key").alias(name), F.size("grams").alias(f"n_{name}"), F.explode("grams").alias("g"))

    x = grams(others, "other").join(grams(known, "title"), ["book", "g"]).groupBy("book", "other", "title", "n_other", "n_title").agg(F.count(F.lit(1)).alias("both"))
    return x.where(F.col("both") >= ALIKE * (F.col("n_other") + F.col("n_title") - F.col("both"))).select("book", F.col("other").alias("key")).distinct()


def edge_noise(edges: DataFrame) -> DataFrame:
    """(page_id, line_no, noise) for running headers and page numbers, from ``edges`` as ``_edges`` gives them.

    A title is known if it recurs at the edges of several pages.  Whatever has its
    key, or trigrams like it, is a running header too, wherever on a page it stands.
    A few lines per page meet small per-book statistics; where a book holds many
    of the pages, the adaptive skew join splits it.
    """
    outer = edges.where("edge and title")

    def recurring(col: str) -> DataFrame:
        own = edges.where(F.col("title") & (F.length(col) >= SHORTEST)).groupBy("book", F.col(col).alias("key"))
        n = own.agg(F.count_distinct(F.when(F.col("edge"), F.col("number"))).alias("n"), F.count_distinct("number").alias("pages"))
        n = n.where(F.col("n") * 2 > F.col("pages"))  # what stands within pages more often than at their edges is text
        short = F.length("key") < 8
        return n.where((F.col("n") >= F.when(short, 4).otherwise(3)) | ((F.col("n") == 2) & ~short & (F.size(F.split("key", " ")) <= 5))).select("book", "key")

    keys, heads = recurring("key"), recurring("head")
    rare = outer.where((F.length("key") >= 8) & F.col("style").isNull()).select("book", "key").distinct().join(keys, ["book", "key"], "left_anti")
    keys = keys.unionByName(similar_keys(keys.where(F.length("key") >= 8), rare)).withColumn("is_key", F.lit(True))
    heads = heads.withColumnsRenamed({"key": "head"}).withColumn("is_head", F.lit(True))
    bare = edges.where("style = 'bare' and not roman and number is not null").select("book", "top", "number", (F.col("value") - F.col("number")).alias("shift")).distinct()
    shifts = bare.groupBy("book", "top", "shift").agg(F.count(F.lit(1)).alias("n"))
    best = shifts.groupBy("book").agg(F.max(F.struct("n", "top", "shift")).alias("b")).where("b.n >= 2")
    best = best.select("book", F.col("b.top").alias("b_top"), F.col("b.shift").alias("b_shift"))
    x = edges.join(keys, ["book", "key"], "left").join(heads, ["book", "head"], "left").join(best, "book", "left")
    bare_ok = F.col("roman") | ((F.col("top") == F.col("b_top")) & (F.col("value") - F.col("number") == F.col("b_shift")))
    noise = F.when(F.col("style").isin("page", "trim"), "page_number").when((F.col("style") == "bare") & bare_ok, "page_number").when(
        F.col("title") & F.col("style").isNull() & (F.col("is_key").isNotNull() | (F.col("is_head").isNotNull() & (F.col("head") != ""))), "running_header"
    )
    return x.select("page_id", "line_no", noise.alias("noise")).where("noise is not null")


# -- words across lines and pages ----------------------------------------------------------

_TRIM = ".,;:()[]{}\"“”«»'‘’—–·•…?"
_LETTER = re.compile(r"[^\W\d_]")


def words_of(line: str) -> list[tuple[str, bool]]:
    """Words as printed, in lower case, without the punctuation around them; and whether they begin with a capital."""
    out = []
    for w in unicodedata.normalize("NFC", line).split():
        w = w.strip(_TRIM)
        if w.endswith("!") and (len(w) < 2 or w[-2] != "!"):
            w = w[:-1]
        if _LETTER.search(w):
            out.append((w.lower(), w[:1].isupper()))
    return out


def _sliced(batches: Iterator[pd.DataFrame], rows: int = 200) -> Iterator[pd.DataFrame]:
    """Smaller batches: a page becomes many small objects."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


def ends_broken(line: str | None) -> bool:
    s = (line or "").rstrip()
    return len(s) > 1 and s[-1] in HYPHENS and s[-2].isalpha() | (s[-2] in "@!†\\/¢0156789")


def first_word(line: str | None) -> str:
    s = unicodedata.normalize("NFC", line or "").split()
    return s[0].lower().rstrip(_TRIM) if s else ""


_TOKENS = "page_id bigint, book string, number int, tokens array<struct<line_no int, word string, cap boolean, part int, cut int>>, breaks array<struct<line_no int, plain boolean, joined string, compound string>>"


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of a page's text lines; a broken word is whole, ``part`` says on which side of the break it is listed, ``cut`` where the break is."""
    for b in _sliced(batches):
        out = []
        for pid, book, number, lines, noisy, before, after in zip(b["page_id"], b["book"], b["number"], b["lines"], b["noisy"], b["before"], b["after"], strict=True):
            skip = {int(i) for i in noisy} if noisy is not None else set()
            text = [(i + 1, x) for i, x in enumerate(lines if lines is not None else []) if x and x.strip() and i + 1 not in skip]
            tokens, breaks = [], []
            for k, (no, line) in enumerate(text):
                prev = text[k - 1][1] if k else before
                nxt = text[k + 1][1] if k + 1 < len(text) else after
                own = words_of(line)
                if ends_broken(line) and own and nxt is not None:
                    left = unicodedata.normalize("NFC", line).rstrip()[:-1].split()[-1].lower().lstrip(_TRIM)
                    right = first_word(nxt)
                    cap = own[-1][1]
                    own = own[:-1]
                    joined, compound = left + right, f"{left}-{right}"
                    breaks.append({"line_no": no, "plain": line.rstrip()[-1] == "-", "joined": skeleton(joined), "compound": skeleton(compound)})
                    tokens.append({"line_no": no, "word": joined, "cap": cap, "part": 0, "cut": len(left)})
                elif ends_broken(line) and own:
                    own = own[:-1]
                    breaks.append({"line_no": no, "plain": False, "joined": "", "compound": ""})
                if ends_broken(prev) and own:
                    left = unicodedata.normalize("NFC", prev).rstrip()[:-1].split()[-1].lower().lstrip(_TRIM)
                    tokens.append({"line_no": no, "word": left + first_word(line), "cap": False, "part": 1, "cut": len(left)})
                    own = own[1:]
                tokens += [{"line_no": no, "word": w, "cap": c, "part": None, "cut": None} for w, c in own]
            out.append((pid, book, number, tokens, breaks))
        yield pd.DataFrame(out, columns=["page_id", "book", "number", "tokens", "breaks"])


def neighbours(text: DataFrame) -> DataFrame:
    """(page_id, before, after): last text line of the previous and first of the next page with text.

    ``text`` has page_id, book, number, first, last (null without text).  Of several
    scans of a page the one with the smallest id stands for it.  Order within
    blocks of pages is a window; blocks are linked by their own summaries.
    """
    page = (
        text.where("first is not null and book is not null and number is not null")
        .groupBy("book", "number")
        .agg(F.min(F.struct("page_id", "first", "last")).alias("p"))
        .select("book", "number", F.col("p.first").alias("first"), F.col("p.last").alias("last"), F.floor(F.col("number") / BLOCK).alias("block"))
    )
    inside = Window.partitionBy("book", "block").orderBy("number")
    blocks = page.groupBy("book", "block").agg(F.min_by("first", "number").alias("b_first"), F.max_by("last", "number").alias("b_last"))
    across = Window.partitionBy("book").orderBy("block")
    blocks = blocks.select("book", "block", F.lag("b_last").over(across).alias("b_before"), F.lead("b_first").over(across).alias("b_after"))
    linked = (
        page.withColumn("before", F.lag("last").over(inside))
        .withColumn("after", F.lead("first").over(inside))
        .join(blocks, ["book", "block"])
        .select("book", "number", F.coalesce("before", "b_before").alias("before"), F.coalesce("after", "b_after").alias("after"))
    )
    return text.select("page_id", "book", "number").join(linked, ["book", "number"]).select("page_id", "before", "after")


def undo(word: str) -> set[str]:
    """Words of which ``word`` may be a misreading: all symbols, then one or two letter look-alikes undone."""
    forms = {word}
    if not word.isalpha():
        plain = word
        for a, b in SYMBOLS.items():
            plain = plain.replace(a, b)
        forms = {plain}
        for a, b in SYMBOLS_TOO.items():
            if a in word:
                other = word.replace(a, b)
                for c, e in SYMBOLS.items():
                    other = other.replace(c, e)
                forms.add(other)
    out = set(forms) - {word}
    for _ in range(2):
        new = set()
        for f in forms:
            for a, b in LETTERS.items():
                i = f.find(a)
                while i >= 0:
                    new.add(f[:i] + b + f[i + len(a) :])
                    i = f.find(a, i + 1)
        out |= new
        if len(forms) > 1 and len(word) > LONG:
            break
        forms = new
    return out - {word}


def explained(word: str, right: str) -> bool:
    """Whether ``word`` becomes ``right`` by undoing any number of look-alikes, letter by letter."""
    steps = [*SYMBOLS.items(), *SYMBOLS_TOO.items(), *LETTERS.items()]
    todo, seen = [(0, 0)], set()
    while todo:
        i, j = todo.pop()
        if (i, j) in seen:
            continue
        seen.add((i, j))
        if i == len(word) and j == len(right):
            return True
        if i < len(word) and j < len(right) and word[i] == right[j]:
            todo.append((i + 1, j + 1))
        todo += [(i + len(a), j + len(b)) for a, b in steps if word.startswith(a, i) and right.startswith(b, j)]
    return False


def _undone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _sliced(batches, 1000):
        rows = [(w, n, c, t) for w, n, c in zip(b["word"], b["n"], b["n_cap"], strict=True) for t in undo(w) if t.isalpha() or "-" in t]
        yield pd.DataFrame(rows, columns=["word", "n", "n_cap", "right"])


def _boned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(bone=[skeleton(w) for w in b["word"]])


def _explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[[explained(w, r) for w, r in zip(b["word"], b["right"], strict=True)]]


def misreadings(vocabulary: DataFrame) -> DataFrame:
    """(word, right): words of a vocabulary (word, n, n_cap) that are misread forms of a much commoner word.

    One or two look-alikes are undone by trial.  Beyond that, and for words of any
    length, words whose look-alikes fall together share a bone, and the commonest
    word of a bone is tried for the others, if look-alikes explain all differences.
    """
    known = vocabulary.select(F.col("word").alias("right"), F.col("n").alias("n_right"), F.col("n_cap").alias("cap_right"))
    tries = vocabulary.mapInPandas(_undone, "word string, n bigint, n_cap bigint, right string")
    boned = vocabulary.mapInPandas(_boned, "word string, n bigint, n_cap bigint, bone string")
    top = boned.groupBy("bone").agg(F.max_by("word", F.struct("n", "word")).alias("right"), F.count(F.lit(1)).alias("forms")).where("forms > 1").drop("forms")
    far = boned.join(top, "bone").where("word <> right").select("word", "n", "n_cap", "right").mapInPandas(_explained, "word string, n bigint, n_cap bigint, right string")
    # what always has a capital, beside a word that seldom has one, is a name
    name = (F.col("n") >= 3) & (F.col("n_cap") == F.col("n")) & (F.col("cap_right") * 2 < F.col("n_right")) & F.col("word").rlike(r"^\p{L}+$")
    share = F.when(F.length("right") >= 3, F.lit(RARE)).otherwise(F.lit(RARE_SHORT))
    few = (F.col("n") <= 2) & (F.col("n_right") >= 4 * F.col("n")) & (F.length("right") >= 4)
    odd = F.col("word").rlike(r"[^\p{L}\p{M}'’-]") & (F.length("right") >= 2)
    hit = tries.unionByName(far).join(known, "right").where(~name).where((F.col("n") <= share * F.col("n_right")) | few | odd)
    return hit.groupBy("word").agg(F.max_by("right", "n_right").alias("right"))


#: A sign within a word that no word has, whatever the vocabulary says.
_SIGN = r"[\p{L}][@!†¢|$€]+[\p{L}]|^[@†¢|$€]\p{L}{2,}|\p{L}{2,}[@†¢|$€]$|\\/|\p{L}{2,}[0-9]\p{L}+|^[0-9]\p{L}{3,}$|\p{L}{3,}[0-9]$"


def _bones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"bone": [skeleton(w) for w in b["word"]], "n": b["n"]})


def prepared(pages: DataFrame) -> DataFrame:
    """page_id, book, number and lines, which fall back to the text."""
    lines = F.coalesce(F.when(F.size("lines") > 0, F.col("lines")), F.split("text", "\n"))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "book", F.col("number").cast("int").alias("number"), lines.alias("lines"))


class Scans:
    """Stages over one set of pages; written tables cut the plan between them."""

    def __init__(self, pages: DataFrame):
        self.ws = Workspace(pages.sparkSession, "scans")
        self.pages = spread(prepared(pages))
        self.edges = self.ws.write(edge_noise(self.ws.write(self.pages.mapInPandas(_edges, _EDGE))[1]))[1]
        noisy = self.edges.groupBy("page_id").agg(F.collect_list("line_no").alias("noisy"))
        marked = self.pages.join(noisy, "page_id", "left").withColumn("noisy", F.coalesce("noisy", F.array().cast("array<int>")))
        numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
        text = F.filter(numbered, lambda s: F.coalesce(F.trim(s["line"]) != "", F.lit(False)) & ~F.array_contains("noisy", s["line_no"]))
        ends = marked.withColumn("t", text).select(
            "page_id", "book", "number", F.try_element_at("t", F.lit(1))["line"].alias("first"), F.try_element_at("t", F.lit(-1))["line"].alias("last")
        )
        self.marked = marked.join(neighbours(ends), "page_id", "left")
        tokens = self.marked.select("page_id", "book", "number", "lines", "noisy", "before", "after").mapInPandas(_tokens, _TOKENS)
        self.tokens = self.ws.write(tokens)[1]
        words = self.tokens.select(F.explode("tokens").alias("t")).where("t.part is null or t.part = 0")
        self.vocabulary = self.ws.write(words.groupBy(F.col("t.word").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.count_if("t.cap").alias("n_cap")))[1]
        forms = misreadings(self.vocabulary)
        signed = self.vocabulary.where(F.col("word").rlike(_SIGN)).select("word")
        # a misread form is far rarer than its word, so no word of this table holds many of the rows
        self.forms = self.ws.write(forms.join(signed, "word", "full").select("word", "right"))[1]

    def breaks(self) -> DataFrame:
        """(page_id, line_no) of the lines that end inside a word."""
        b = self.tokens.select("page_id", F.explode("breaks").alias("b")).select("page_id", "b.*")
        sure = b.where(~F.col("plain")).select("page_id", "line_no")
        open_ = b.where("plain").select("page_id", "line_no", "joined", "compound")
        # whole words and compounds, misreadings falling together; only those that some break asks for
        asked = open_.select(F.explode(F.array("joined", "compound")).alias("bone")).distinct()
        whole = self.tokens.select(F.explode("tokens").alias("t")).where("t.part is null").groupBy(F.col("t.word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
        counts = whole.mapInPandas(_bones, "bone string, n bigint").join(asked, "bone", "left_semi").groupBy("bone").agg(F.sum("n").alias("n"))
        x = open_.join(counts.select(F.col("bone").alias("compound"), F.col("n").alias("cn")), "compound", "left")
        x = x.join(counts.select(F.col("bone").alias("joined"), F.col("n").alias("jn")), "joined", "left")
        return sure.unionByName(x.where(F.coalesce("cn", F.lit(0)) <= F.coalesce("jn", F.lit(0))).select("page_id", "line_no"))

    def misread(self) -> DataFrame:
        """(page_id, line_no, word, right) of misread words; a broken word counts for the line that has the misread part."""
        t = self.tokens.select("page_id", F.explode("tokens").alias("t")).select("page_id", "t.*")
        x = t.join(self.forms, "word")

        def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                keep = []
                for w, r, part, cut in zip(b["word"], b["right"], b["part"], b["cut"], strict=True):
                    if pd.isna(part):
                        keep.append(True)
                        continue
                    at = difference(w, r if isinstance(r, str) else None)
                    keep.append(at is None or (at[0] < cut if part == 0 else at[1] > cut))
                yield b[keep][["page_id", "line_no", "word", "right"]]

        return x.mapInPandas(here, "page_id bigint, line_no int, word string, right string")

    def found(self) -> DataFrame:
        """(page_id, line_no, noise) of all kinds."""
        return (
            self.edges
            .unionByName(self.breaks().distinct().withColumn("noise", F.lit("hyphen_break")))
            .unionByName(self.misread().select("page_id", "line_no").distinct().withColumn("noise", F.lit("ocr_char")))
        )


def difference(word: str, right: str | None) -> tuple[int, int] | None:
    """Where in ``word`` the misreading begins and ends."""
    if right is None:
        m = re.search(r"[^\w'’-]|[\d_]", word)
        return (m.start(), m.end()) if m else None
    i = 0
    while i < min(len(word), len(right)) and word[i] == right[i]:
        i += 1
    j = 0
    while j < min(len(word), len(right)) - i and word[-1 - j] == right[-1 - j]:
        j += 1
    return i, len(word) - j


# -- readable paragraphs -------------------------------------------------------------------

_PARTS = "page_id bigint, book string, number int, parts array<struct<no int, text string, starts boolean>>"


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired text of a page in parts; a part that does not start a paragraph goes on with the one before."""
    for b in _sliced(batches):
        out = []
        for pid, book, number, lines, noisy, broken, wrong, before in zip(
            b["page_id"], b["book"], b["number"], b["lines"], b["noisy"], b["broken"], b["wrong"], b["before"], strict=True
        ):
            skip = {int(i) for i in noisy} if noisy is not None else set()
            broken = {int(i) for i in broken} if broken is not None else set()
            fixes: dict[int, list[tuple[str, str]]] = {}
            for f in wrong if wrong is not None else []:
                fixes.setdefault(int(f["line_no"]), []).append((f["word"], f["right"]))
            text = [(i + 1, x) for i, x in enumerate(lines if lines is not None else []) if x and x.strip() and i + 1 not in skip]
            width = max((len(x) for _, x in text), default=0)
            parts: list[dict] = []
            prev, ended = before, before is None or (_closed(before) and len(before) < 0.85 * max(width, 1))
            glue = False
            for no, line in text:
                alone = line.isupper() or len(line) < 8 or bool(re.fullmatch(r"[A-Z]{3} \S{1,3}", line))
                starts = (ended or alone or (prev is not None and prev.isupper())) and not glue
                body = line.strip()
                for w, r in fixes.get(no, ()):
                    body = re.sub(re.escape(w), lambda m, r=r: r.upper() if m.group().isupper() else r.capitalize() if m.group()[:1].isupper() else r, body, flags=re.I)
                cut = no in broken
                body = body[:-1] if cut else body
                if parts and not starts:
                    parts[-1]["text"] += ("" if glue else " ") + body
                else:
                    parts.append({"no": len(parts), "text": body, "starts": bool(starts)})
                keep = body.endswith("-") and not cut
                glue, prev = cut or keep, line
                ended = alone or (_closed(line) and len(line) < 0.85 * width)
            if parts and glue:
                parts[-1]["text"] += "\u0000"  # the next page goes on within the word
            out.append((pid, book, number, parts))
        yield pd.DataFrame(out, columns=["page_id", "book", "number", "parts"])


def _closed(line: str) -> bool:
    return bool(re.search(r"[.!?:][\"'”’)]*\s*$", line))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(book, paragraph, first_page, text): repaired paragraphs of each book in order.

    Of several scans of a page the one with the smallest id that has text is read.
    Paragraphs are numbered by a running sum over pages, within blocks and then
    over blocks, so that a paragraph may run on over any number of pages.
    """
    s = Scans(pages)
    broken = s.breaks().groupBy("page_id").agg(F.collect_set("line_no").alias("broken"))
    wrong = s.misread().where("right is not null").groupBy("page_id").agg(F.collect_set(F.struct("line_no", "word", "right")).alias("wrong"))
    whole = s.marked.join(broken, "page_id", "left").join(wrong, "page_id", "left")
    parts = whole.select("page_id", "book", "number", "lines", "noisy", "broken", "wrong", "before").mapInPandas(_parts, _PARTS).where(F.size("parts") > 0)
    first = parts.groupBy("book", "number").agg(F.min("page_id").alias("page_id"))
    one = s.ws.write(parts.join(first, ["book", "number", "page_id"]).withColumn("block", F.floor(F.col("number") / BLOCK)))[1]
    starts = F.size(F.filter("parts", lambda p: p["starts"]))
    page = one.select("book", "block", "number", starts.alias("starts"))
    inside = Window.partitionBy("book", "block").orderBy("number")
    block = page.groupBy("book", "block").agg(F.sum("starts").alias("starts"))
    over = Window.partitionBy("book").orderBy("block")
    block = block.select("book", "block", (F.sum("starts").over(over) - F.col("starts")).alias("base"))
    page = page.withColumn("upto", F.sum("starts").over(inside) - F.col("starts")).join(block, ["book", "block"]).select("book", "number", (F.col("upto") + F.col("base")).alias("base"))
    flat = one.join(page, ["book", "number"]).select("book", "number", "base", "parts", F.posexplode("parts").alias("i", "p"))
    before = F.size(F.filter(F.slice("parts", 1, F.col("i") + 1), lambda p: p["starts"]))
    keyed = flat.select("book", (F.col("base") + before).alias("paragraph"), "number", "i", F.col("p.text").alias("text"))
    joined = keyed.groupBy("book", "paragraph").agg(
        F.min("number").alias("first_page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "i", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    return joined.withColumn("text", F.replace(F.replace("text", F.lit("\u0000 "), F.lit("")), F.lit("\u0000"), F.lit("")))
