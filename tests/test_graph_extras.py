import pytest

from conftest import rows
from tessera.model import EDGE_SCHEMA, NODE_SCHEMA
from tessera.operators import chunks as ch
from tessera.operators import code as cd
from tessera.operators import community as co
from tessera.operators import evaluation as ev
from tessera.operators import extraction as ex
from tessera.operators.store import GraphStore
from tessera.streaming.upserts import current, upsert_stream


def graph(spark, ids, links, kind="calls"):
    n = spark.createDataFrame([(i, "function", i, {}, k) for k, i in enumerate(ids)], NODE_SCHEMA)
    e = spark.createDataFrame([(a, b, kind, {}, k) for k, (a, b) in enumerate(links)], EDGE_SCHEMA)
    return GraphStore(n, e)


TRIANGLES = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")]


def test_louvain(spark):
    got = co.named(co.louvain(graph(spark, "abcdef", TRIANGLES)))
    assert sorted(r.members for r in got.collect()) == [["a", "b", "c"], ["d", "e", "f"]]
    single = co.named(co.louvain(graph(spark, "abc", [("a", "b"), ("b", "c")], "mentions")))
    assert sorted(r.members for r in single.collect()) == [["a"], ["b"], ["c"]]
    loop = co.named(co.louvain(graph(spark, "abc", [("a", "a"), ("a", "b"), ("b", "c"), ("c", "a")])))
    assert [r.members for r in loop.collect()] == [["a", "b", "c"]]


def test_components_and_overlay(spark):
    c = co.named(co.components(graph(spark, "abcdefgh", TRIANGLES + [("g", "h")])))
    assert sorted(r.members for r in c.collect()) == [list("abcdef"), ["g", "h"]]
    n, e = co.overlay(c)
    assert e.count() == 8 and {r.attrs["members"] for r in n.collect()} == {"6", "2"}
    s = co.extractive_summaries(c, spark.createDataFrame([("a", "Alfa")], "id string, text string"))
    assert "Alfa; b; c; d; e (6)" in {r.summary for r in s.collect()}
    assert co.extractive_summaries(c, spark.createDataFrame([("a", "Alfa")], "id string, text string"), done=c.select("community_id")).count() == 0


def lines(spark, *rows_):
    return spark.createDataFrame([("b", p, i, t, s) for i, (p, t, s) in enumerate(rows_)], "book string, page int, line_no int, line string, size double")


def test_caps_chunks(spark):
    got = ch.by_caps(lines(spark, (1, "intro", 9.0), (1, "GOBLIN", 14.0), (1, "KUO-TOA", 14.0), (2, "corpo", 9.0), (2, "a", 9.0), (2, "b", 9.0), (2, "13", 14.0), (2, "ORC", 14.0))).orderBy("chunk_no").collect()
    assert [(r.label, r.text, r.pages) for r in got] == [("p.1", "intro", [1]), ("Goblin", "GOBLIN\ncorpo\na\nb\n13", [1, 2]), ("Orc", "ORC", [2])]
    assert ch.by_caps(lines(spark, (1, "x", 9.0)).limit(0)).count() == 0


def test_markdown_chunks(spark):
    docs = spark.createDataFrame([(1, " \n---  \nk: v\n--- \npre\r\n# One\na \n## Two\rb\n \n"), (2, None), (3, "")], "doc_id bigint, text string")
    got = ch.by_heading(ch.markdown_lines(docs)).orderBy("book", "chunk_no").collect()
    assert [(r.book, r.label, r.text) for r in got] == [("1", "p.1", "pre"), ("1", "One", "# One\na "), ("1", "Two", "## Two\nb")]


def test_stat_block(spark):
    rows_ = [("FOR\nDES \n CON\nINT\nx",), ("FOR 18\nDES 12\nCON 1\nINT 2\nSAB 3",), ("FOR\nDES\nCON",), (None,)]
    df = spark.createDataFrame(rows_, "t string")
    assert [r[0] for r in df.select(ch.has_stat_block(df.t)).collect()][:3] == [True, False, False]


def test_merge(spark):
    r = spark.createDataFrame([(1, "Goblin", "RESISTS", "fogo"), (2, " goblin ", "RESISTS", "Fogo"), (3, "Goblin", "MENTIONS", None), (4, "", "RESISTS", "x"), (5, "A", "LIKES", "B")], "ord bigint, subject string, predicate string, object string")
    ents = spark.createDataFrame([(0, "Goblin", "entity", {"k": "v"})], "ord bigint, surface string, type string, attrs map<string,string>")
    n, e = ex.merge_relations(r, ents)
    assert rows(n, "id", "type", "label") == [("fogo", "concept", "fogo"), ("goblin", "entity", "Goblin")]
    assert rows(e, "src", "dst", "type", "ord") == [("goblin", "fogo", "resists", 1)]


def test_notes(spark):
    text = "---\nrelates_to: [dec-001, 'ADR-G6']\nsupersedes:\n  - dec-0\n  - self\nother: x\nrequires: PostgreSQL\n---\nSee [a](../decisions/dec-g7.md#x) and [b](https://x.y/z.md), [c](#top), [d](dec-g7.md)."
    docs = spark.createDataFrame([("self", text), ("none", "plain"), ("null", None)], "id string, text string")
    e = ex.note_graph(docs, "id")[1]
    assert rows(e, "dst", "type") == [("ADR-G6", "relates_to"), ("PostgreSQL", "requires"), ("dec-0", "relates_to"), ("dec-001", "relates_to"), ("dec-g7", "references")]
    assert [r.attrs for r in e.where("dst = 'dec-0'").collect()] == [{"verb": "supersedes"}]


PY = """from __future__ import annotations
import os as o, sys
from collections import deque
from . import near
from ..up.here import x
@mark()
class Shelf:
    @wrap(arg())
    def lend(self, n=sort()):
        sort()
class Drawer(Shelf, other.Thing, metaclass=M):
    async def close(self):
        self.lend()
        nope()
        x[0]()
        @mark()
        def late(): pass
def sort():
    def inner(): pass
def mark(): pass
sort()
"""
PY_EDGES = {
    ("a.py", "module:os", "imports"), ("a.py", "module:collections", "imports"), ("a.py", "module:.", "imports"), ("a.py", "module:..up.here", "imports"),
    ("a.py", "a.py::Shelf", "defines"), ("a.py::Shelf", "a.py::Shelf.lend", "defines"), ("a.py", "a.py::Drawer", "defines"), ("a.py::Drawer", "a.py::Drawer.close", "defines"),
    ("a.py::Drawer.close", "a.py::Drawer.close.late", "defines"), ("a.py", "a.py::sort", "defines"), ("a.py::sort", "a.py::sort.inner", "defines"), ("a.py", "a.py::mark", "defines"),
    ("a.py::Shelf.lend", "a.py::sort", "calls"), ("a.py::Drawer.close", "a.py::Shelf.lend", "calls"), ("a.py::Drawer.close", "a.py::mark", "calls"), ("a.py::Drawer", "a.py::Shelf", "inherits"),
}
JAVA = """package x.y; // class Not { }
import java.util.List; import static java.lang.Math.*;
@Tag(value = "class Nope {")
class Shelf<T extends Comparable<T>> { int n = count(); void lend(@Ann("x") int a, List<T> b) throws E { sort(); new Drawer(sort()); } abstract int size(); Shelf() { super(); sort(); } }
class Drawer extends Shelf<Key> implements Opens, Closes { void close() { this.lend(1, null); if (open()) { } run(() -> { sort(); }); new Opens() { void turn() { sort(); } }; } }
interface Opens extends Closes { boolean open(); default void x() { open(); } }
interface Closes { String s = \"\"\"
  class InText { } \"\"\"; }
record Pair(int a, int b) { Pair { sort(); } int sum() { return a + b; } }
enum Kind { A(1), B { void bend() { } }; Kind(int i) { } int of() { return 1; } }
@interface Tag { String value(); }
class Tools { static void sort() { } class Key { } }
"""
JAVA_EDGES = {
    ("B.java", "module:java.util.List", "imports"), ("B.java", "module:java.lang.Math", "imports"),
    *[("B.java", f"B.java::{c}", "defines") for c in ("Shelf", "Drawer", "Opens", "Closes", "Tools", "sum", "bend", "Kind", "of")],
    ("B.java::Shelf", "B.java::Shelf.lend", "defines"), ("B.java::Shelf", "B.java::Shelf.size", "defines"), ("B.java::Shelf", "B.java::Shelf.Shelf", "defines"),
    ("B.java::Drawer", "B.java::Drawer.close", "defines"), ("B.java::Drawer.close", "B.java::Drawer.close.turn", "defines"),
    ("B.java::Opens", "B.java::Opens.open", "defines"), ("B.java::Opens", "B.java::Opens.x", "defines"), ("B.java::Tools", "B.java::Tools.sort", "defines"), ("B.java::Tools", "B.java::Key", "defines"),
    ("B.java::Shelf.lend", "B.java::Tools.sort", "calls"), ("B.java::Shelf.Shelf", "B.java::Tools.sort", "calls"), ("B.java::Drawer.close", "B.java::Shelf.lend", "calls"),
    ("B.java::Drawer.close", "B.java::Opens.open", "calls"), ("B.java::Drawer.close", "B.java::Tools.sort", "calls"), ("B.java::Drawer.close.turn", "B.java::Tools.sort", "calls"),
    ("B.java::Opens.x", "B.java::Opens.open", "calls"),
    ("B.java::Drawer", "B.java::Opens", "inherits"), ("B.java::Drawer", "B.java::Closes", "inherits"), ("B.java::Drawer", "B.java::Key", "inherits"),
}


def test_code(spark):
    files = spark.createDataFrame([("a.py", PY), ("B.java", JAVA), ("c.txt", "def f(): pass"), ("bad.py", "def ("), ("n.py", None)], "path string, text string")
    assert set(rows(cd.code_graph(cd.code_facts(files.where("path <> 'B.java'")))[1], "src", "dst", "type")) == PY_EDGES
    assert set(rows(cd.code_graph(cd.code_facts(files.where("path = 'B.java'")))[1], "src", "dst", "type")) == JAVA_EDGES
    both = cd.resolve_names(cd.code_facts(files))
    assert both.where("src = 'a.py::Drawer.close' and kind = 'call'").count() == 1  # lend and sort are defined twice now


def test_java_that_breaks_off():
    for text in ("class A {", "class A { void f(", "class A { int x = (", "}}}", "@", "import", "new", "class", "enum E {", "record R(", "/* open", "class A<B {"):
        assert cd.java_facts("X.java", text)[0] == ("file", "X.java", None, "X.java")


def test_header_fields(spark):
    text = "---\nrelates_to: [a, 'b']\nrequires: c\nsupersedes:\n  - d\n  - \"e\"\n\n  - lost\nimplements: f\nextends:\n- g\nother: z\n- lost\nreplaces: h, i\ndepends_on: no\nmentions: no\n---\n[l](x y.md) [m](k.md \"T\")"
    e = ex.note_graph(spark.createDataFrame([("self", text)], "id string, text string"), "id")[1]
    got = [(r.dst, r.type, r.attrs.get("verb")) for r in e.orderBy("ord").collect()]
    assert got == [
        ("a", "relates_to", None), ("b", "relates_to", None), ("c", "requires", None), ("d", "relates_to", "supersedes"), ("e", "relates_to", "supersedes"), ("f", "requires", None),
        ("g", "relates_to", None), ("h", "relates_to", "replaces"), ("i", "relates_to", "replaces"), ("x y", "references", None), ("k", "references", None),
    ]


def test_evaluation(spark):
    want = spark.createDataFrame([("q", list("abcda")), ("p", ["x"])], "query_id string, relevant_sources array<string>")
    got = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "B"), ("q", "C"), ("q", "x")], "query_id string, source string")
    assert rows(ev.recall(got, want)) == [("p", 0.0), ("q", 0.5)]
    for none in ([], None):
        with pytest.raises(Exception, match="no relevant sources: e"):
            ev.recall(got, spark.createDataFrame([("e", none)], want.schema)).collect()
    q = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False), ("e", False), ("f", None)], "id string, attack_vs_resistance_confusion boolean")
    assert tuple(ev.confusion(q).first()) == (5, 2, 0.4, "a,b") and ev.confusion(q.limit(0)).first().rate == 0.0
    k = spark.createDataFrame([('["fogo", "frio"]', ["x"]), ("1/4", ["x"]), (None, ["Balor", "Vrock"])], "answer_key string, relevant_labels array<string>")
    assert [r[0] for r in k.select(ev.expected_answer()).collect()] == ["fogo; frio", "1/4", "Balor; Vrock"]
    v = spark.createDataFrame([("a", i, float(i % 7)) for i in range(40)] + [("one", 99, 1.0)], "arm string, id int, x double")
    b = ev.bootstrap(v, "arm", "x", resamples=50).collect()
    assert [r.arm for r in b] == ["a"] and b[0].ci_low <= b[0]["mean"] <= b[0].ci_high
    old = spark.createDataFrame([("a", "m", 0.5), ("b", "m", 0.5), ("c", "m", 0.5)], "arm string, metric string, mean double")
    new = spark.createDataFrame([("a", "m", 0.54), ("b", "m", 0.6)], "arm string, metric string, mean double")
    assert rows(ev.regressions(old, new), "arm", "status") == [("b", "drift"), ("c", "missing")]
    t = ev.report(b and ev.bootstrap(v, "arm", "x", resamples=50).withColumn("metric", ev.F.lit("m")), ["a", "z"])
    assert "—" in ev.markdown_table(t)


def test_stream_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "b", "calls", 1), ("a", "b", "calls", 2)], "src string, dst string, type string, ord bigint").write.parquet(src)
    arrivals = spark.readStream.schema("src string, dst string, type string, ord bigint").parquet(src)
    upsert_stream(arrivals, ["src", "dst", "type"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(current(spark.read.parquet(str(tmp_path / "out")), ["src", "dst", "type"]), "ord") == [(2,)]
