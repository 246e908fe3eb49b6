"""String columns shared by extraction, retrieval and the reference checks."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in a name, also the separators that Java's \\s leaves out.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


#: Line ends as a text file may have them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def stripped(text: Column | str) -> Column:
    """Without white space of any kind around it."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def text_lines(text: Column | str) -> Column:
    """Lines of a text, whatever ends them; no empty line behind a final line end."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END)


def node_id(name: Column | str) -> Column:
    """Identifier of a name as written: white space collapsed and trimmed, lower case."""
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(F.trim(F.regexp_replace(name, _SPACE, " ")))


@functools.lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Letters with accents and their base letters, by Unicode's own decomposition."""
    pairs = []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and not unicodedata.combining(base[0]):
            pairs.append((chr(i), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column | str) -> Column:
    """Composed and decomposed accents removed, on the JVM side."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.translate(text, *_accented()), r"\p{M}+", "")


def title_case(text: Column | str) -> Column:
    """Upper case after every non-letter, lower case elsewhere (``initcap`` only looks at spaces)."""
    text = F.col(text) if isinstance(text, str) else text
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1_000_000))), "")


def named_entities(text: Column | str) -> Column:
    """Decision ids first, then words of four letters or more that begin with a plain capital; first occurrence kept."""
    text = F.col(text) if isinstance(text, str) else text
    ids = F.regexp_extract_all(text, F.lit(r"(?i)(?:dec|adr)-[\p{L}\p{N}_-]+"), F.lit(0))
    caps = F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}\p{N}_])([A-Z][\p{L}\p{N}_]{3,})"), F.lit(1))
    return F.array_distinct(F.concat(ids, caps))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    text = F.col(text) if isinstance(text, str) else text
    return F.floor((F.length(text) + 3) / 4).cast("bigint")


def slug(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))


def terms(text: Column | str) -> Column:
    """Lower-case words of letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


_FRONT = r"\A---\n([\s\S]*?)\n---\n?"
#: The header of a page to be chunked: blanks around its marks are allowed, and a line must follow.
_LENIENT = r"\A\s*---\s*\n[\s\S]*?\n---[^\S\n]*\n"


def frontmatter(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(text, _FRONT, 1)


def without_frontmatter(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, _FRONT, "")


def without_page_header(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, _LENIENT, "")


def link_stems(text: Column | str) -> Column:
    """File stems of local Markdown links, blanks and titles in them included; first occurrence kept."""
    text = F.col(text) if isinstance(text, str) else text
    hrefs = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    local = F.filter(hrefs, lambda h: ~h.rlike(r"^(?:https?://|#|mailto:)"))
    names = F.transform(local, lambda h: F.regexp_extract(F.regexp_extract(h, r"^([^#?]*)", 1), r"([^/]*)/*$", 1))
    stems = F.transform(names, lambda n: F.when(n.rlike(r"^.+\.[^.]+$"), F.regexp_replace(n, r"\.[^.]*$", "")).otherwise(n))
    return F.array_distinct(F.filter(stems, lambda s: s != ""))
