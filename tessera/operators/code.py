"""Facts of Python and Java sources, their resolution by unique names, and the graph they make.

A fact is (path, ord, kind, src, dst, name): ``file``, ``class`` and ``function``
define ``dst`` inside ``src``; ``import`` names a module; ``call`` and ``base``
name something that may be defined anywhere.  Python is read by the standard
library's parser (a file it rejects gives only itself), Java by a tokenizer and
a recursive reader of declarations.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "path string, ord bigint, kind string, src string, dst string, name string"
Fact = tuple[str, str, str | None, str | None]


def _callee(f: ast.expr) -> str | None:
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def python_facts(path: str, text: str) -> list[Fact]:
    """Definitions, imports, calls and bases of one Python file, in the order of the text.

    What a decorator calls belongs to the scope around the decorated thing; default
    values and annotations belong to the function itself.
    """
    out: list[Fact] = [("file", path, None, path)]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    todo: list[tuple[ast.AST, str, str | None]] = [(tree, path, None)]
    while todo:
        node, scope, func = todo.pop()
        below: list[tuple[ast.AST, str, str | None]] = []
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            is_class = isinstance(node, ast.ClassDef)
            own = f"{path}::{node.name}" if is_class else f"{scope}{'::' if scope == path else '.'}{node.name}"
            out.append(("class" if is_class else "function", scope, own, node.name))
            if is_class:
                out += [("base", own, None, b.id) for b in node.bases if isinstance(b, ast.Name)]
            for child in ast.iter_child_nodes(node):
                below.append((child, scope, func) if child in node.decorator_list else (child, own, None if is_class else own))
        elif isinstance(node, ast.Import):
            out.append(("import", path, None, node.names[0].name))
        elif isinstance(node, ast.ImportFrom):
            if node.module != "__future__":
                out.append(("import", path, None, "." * node.level + (node.module or "")))
        else:
            if isinstance(node, ast.Call) and func and (name := _callee(node.func)):
                out.append(("call", func, None, name))
            below = [(child, scope, func) for child in ast.iter_child_nodes(node)]
        todo += reversed(below)
    return out


_JAVA = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<text>"""(?:\\.|.)*?""")|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<arrow>->|::)|(?P<sign>[^\s\w])', re.S)
# Words of the language that may stand before a bracket without being called.
_JAVA_WORDS = frozenset("if for while switch catch synchronized return throw else try do super this assert new case instanceof yield".split())
_OPEN, _CLOSE = {"(": ")", "{": "}", "[": "]"}, frozenset(")}]")
_TYPE_WORDS = ("class", "interface", "enum", "record")


class _Java:
    """Reads the declarations of one file; positions are indices of tokens."""

    def __init__(self, path: str, text: str):
        self.path, self.out = path, [("file", path, None, path)]
        self.t = [m[0] for m in _JAVA.finditer(text) if m["word"] or m["number"] or m["arrow"] or m["sign"]]

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def is_word(self, i: int) -> bool:
        w = self.at(i)
        return bool(w) and (w[0].isalpha() or w[0] in "_$")

    def closed(self, i: int) -> int:
        """Position behind the bracket that closes the one at ``i``."""
        depth = 0
        while i < len(self.t):
            depth += (self.t[i] in _OPEN) - (self.t[i] in _CLOSE)
            i += 1
            if depth <= 0:
                break
        return i

    def angles(self, i: int) -> int:
        """Position behind the type arguments that begin at ``i``."""
        depth = 0
        while i < len(self.t):
            depth += (self.t[i] == "<") - (self.t[i] == ">")
            i += 1
            if depth == 0:
                break
        return i

    def annotation(self, i: int) -> int:
        """Position behind the annotation whose ``@`` is at ``i``."""
        i += 2
        while self.at(i) == "." and self.is_word(i + 1):
            i += 2
        return self.closed(i) if self.at(i) == "(" else i

    def starts_type(self, i: int) -> bool:
        w = self.at(i)
        if w not in _TYPE_WORDS or not self.is_word(i + 1) or self.at(i - 1) in (".", "@"):
            return False
        return w != "record" or self.at(i + 2) in ("(", "<")

    def type(self, i: int, scope: str, func: str | None) -> int:
        """A class, interface, enum or record from its keyword on; only the first two are things of their own."""
        kind, name = self.at(i), self.at(i + 1)
        i += 2
        if self.at(i) == "<":
            i = self.angles(i)
        if kind == "record" and self.at(i) == "(":
            i = self.closed(i)
        bases, clause = [], ""
        while i < len(self.t) and self.at(i) not in ("{", ";"):
            if self.at(i) == "@":
                i = self.annotation(i)
                continue
            w = self.at(i)
            if w in ("extends", "implements", "permits") and (w != "extends" or self.at(i - 1) != "?"):
                clause = w
            elif self.is_word(i) and clause in ("extends", "implements") and w not in ("extends", "super"):
                bases.append(w)
            i += 1
        if kind in ("class", "interface"):
            own = f"{self.path}::{name}"
            self.out.append(("class", scope, own, name))
            if kind == "class":
                self.out += [("base", own, None, b) for b in bases]
            scope, func = own, None
        return self.body(i, scope, func, enum=kind == "enum") if self.at(i) == "{" else i + 1

    def body(self, i: int, scope: str, func: str | None, enum: bool = False, annotation: bool = False) -> int:
        """Members from ``{`` to the matching ``}``."""
        i += 1
        while enum and i < len(self.t) and self.at(i) not in (";", "}"):
            if self.at(i) == "(":
                i = self.code(i, self.closed(i), scope, func)
            else:
                i = self.body(i, scope, func) if self.at(i) == "{" else self.annotation(i) if self.at(i) == "@" else i + 1
        while i < len(self.t):
            if self.at(i) == "}":
                return i + 1
            i = self.member(i, scope, func, annotation)
        return i

    def member(self, i: int, scope: str, func: str | None, annotation: bool) -> int:
        while i < len(self.t):
            w = self.at(i)
            if w == "@":
                if self.at(i + 1) == "interface":
                    while i < len(self.t) and self.at(i) != "{":
                        i += 1
                    return self.body(i, scope, func, annotation=True)
                i = self.annotation(i)
            elif w == ";":
                return i + 1
            elif w == "}":
                return i
            elif w == "{":  # an initialiser, or a record's constructor without a list
                return self.code(i, self.closed(i), scope, func)
            elif w == "=":
                return self.code(i, self.statement(i), scope, func)
            elif w == "<":
                i = self.angles(i)
            elif self.starts_type(i):
                return self.type(i, scope, func)
            elif self.is_word(i) and self.at(i + 1) == "(":
                end = self.closed(i + 1)
                while self.at(end) not in ("{", ";", "}", ""):
                    end += 1
                own = f"{scope}{'::' if scope == self.path else '.'}{w}"
                if not annotation:
                    self.out.append(("function", scope, own, w))
                return self.code(end, self.closed(end), own, own) if self.at(end) == "{" else end + 1
            else:
                i += 1
        return i

    def statement(self, i: int) -> int:
        """Position behind the ``;`` that ends a field."""
        while i < len(self.t) and self.at(i) != ";":
            if self.at(i) == "}":
                return i
            i = self.closed(i) if self.at(i) in _OPEN else i + 1
        return i + 1

    def code(self, i: int, end: int, scope: str, func: str | None) -> int:
        """Calls and nested declarations between two positions."""
        while i < end:
            w = self.at(i)
            if w == "@" and self.is_word(i + 1):
                i = self.annotation(i)
            elif w == "new":
                i = self.creation(i + 1, end, scope, func)
            elif self.starts_type(i):
                i = self.type(i, scope, func)
            else:
                if func and self.is_word(i) and self.at(i + 1) == "(" and w not in _JAVA_WORDS and self.at(i - 1) not in ("case", "instanceof"):
                    self.out.append(("call", func, None, w))
                i += 1
        return max(i, end)

    def creation(self, i: int, end: int, scope: str, func: str | None) -> int:
        """An object behind ``new``: its arguments hold calls, its body holds members."""
        while i < end and (self.is_word(i) or self.at(i) in (".", "<", "@")):
            i = self.angles(i) if self.at(i) == "<" else self.annotation(i) if self.at(i) == "@" else i + 1
        if self.at(i) == "(":
            i = self.code(i + 1, self.closed(i), scope, func)
            if self.at(i) == "{":
                i = self.body(i, scope, func)
        return i

    def file(self) -> list[Fact]:
        i = 0
        while i < len(self.t):
            if self.at(i) == "import":
                i += 2 if self.at(i + 1) == "static" else 1
                name = ""
                while i < len(self.t) and self.at(i) != ";":
                    name += self.at(i)
                    i += 1
                self.out.append(("import", self.path, None, name.removesuffix(".*")))
            elif self.at(i) == "package":
                i = self.statement(i)
            else:
                j = self.member(i, self.path, None, False)
                i = j if j > i else i + 1
        return self.out


def java_facts(path: str, text: str) -> list[Fact]:
    """Classes, interfaces, methods (also those without a body), constructors, calls of methods, superclasses and interfaces of classes.

    Enumerations, records and annotation types are no things of their own: their
    methods belong to what is around them.  Type arguments of a superclass count as bases.
    """
    try:
        return _Java(path, text).file()
    except RecursionError:
        return [("file", path, None, path)]


def code_facts(files: DataFrame) -> DataFrame:
    """Raw facts of source files (path, text); other suffixes and null texts are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                if isinstance(path, str) and isinstance(text, str) and path.endswith((".py", ".java")):
                    facts = python_facts(path, text) if path.endswith(".py") else java_facts(path, text)
                    rows += [(path, i, *f) for i, f in enumerate(facts)]
            yield pd.DataFrame(rows, columns=["path", "ord", "kind", "src", "dst", "name"])

    return files.select("path", "text").mapInPandas(run, FACTS)


def resolve_names(facts: DataFrame, kinds: tuple[str, ...] = ("call", "base")) -> DataFrame:
    """(kind, src, dst): uses whose bare name has exactly one definition in the corpus.

    Definitions are counted per name with partial counts, so a name that every file
    defines or calls costs one row per task; names with one definition are joined.
    """
    defs = facts.where("kind in ('class', 'function')").select("name", F.col("dst").alias("id")).distinct()
    single = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("dst")).where("n = 1")
    uses = facts.where(F.col("kind").isin(*kinds)).select("kind", "src", "name").distinct()
    return uses.join(single.select("name", "dst"), "name").select("kind", "src", "dst")


def code_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of source code from raw facts; of two things with one id the later gives type and label."""
    plain = F.create_map().cast("map<string,string>")
    base = F.regexp_extract("name", r"([^/]*)$", 1)
    ids = facts.where("kind in ('file', 'class', 'function')").select(
        F.coalesce("dst", "src").alias("id"), F.col("kind").alias("type"), F.when(F.col("kind") == "file", base).otherwise(F.col("name")).alias("label"), "ord"
    )
    mods = facts.where("kind = 'import'").select(F.concat(F.lit("module:"), "name").alias("id"), F.lit("module").alias("type"), F.col("name").alias("label"), "ord")
    nodes = ids.unionByName(mods).groupBy("id").agg(F.max_by(F.struct("type", "label"), "ord").alias("x"), F.min("ord").alias("ord")).select("id", "x.*", plain.alias("attrs"), "ord")
    defines = facts.where("kind in ('class', 'function')").select("src", "dst", F.lit("defines").alias("type"))
    imports = facts.where("kind = 'import'").select("src", F.concat(F.lit("module:"), "name").alias("dst"), F.lit("imports").alias("type"))
    uses = resolve_names(facts).select("src", "dst", F.when(F.col("kind") == "call", "calls").otherwise("inherits").alias("type"))
    edges = defines.unionByName(imports).unionByName(uses).distinct()
    return nodes, edges.select("src", "dst", "type", plain.alias("attrs"), F.xxhash64("src", "dst", "type").alias("ord"))
