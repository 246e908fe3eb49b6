import random

from tessera.llm.leaks import WINDOW, build_index, leaks, words

ITEMS = "item_id bigint, suite string, question string, answer string, passage string"


def made(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, "s", " ".join(r.choices(vocab, k=9)) + "?", " ".join(r.choices(vocab, k=14)), " ".join(r.choices(vocab, k=40))) for i in range(6)]
    docs = []
    for d in range(60):
        body = r.choices(vocab, k=r.randrange(60))
        src = r.choice(items)
        part = (src[4] if r.random() < 0.6 else f"{src[2]} {src[3]}").replace("?", "").split()
        n = r.randrange(8, 18)
        s = r.randrange(max(1, len(part) - n))
        part = part[s : s + n]
        for _ in range(r.choice([0, 0, 1, 2])):
            part[r.randrange(len(part))] = "changed"
        docs.append((d, " ".join(body + [w.upper() + r.choice(["", ",", "\n", "**"]) for w in part] + r.choices(vocab, k=10))))
    return items, docs


def brute(items, docs):
    out = set()
    for d, t in docs:
        a = words(t)
        for i, _, q, ans, p in items:
            for seq in (words(p), words(f"{q} {ans}")):
                for s in range(len(seq) - WINDOW + 1):
                    for k in range(len(a) - WINDOW + 1):
                        if sum(x == y for x, y in zip(seq[s : s + WINDOW], a[k : k + WINDOW])) >= WINDOW - 1:
                            out.add((d, i))
    return out


def test_equals_brute_force(spark):
    for seed in (1, 2):
        items, docs = made(seed)
        got = leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, ITEMS))
        assert {(r.doc_id, r.item_id) for r in got.where("match <> 'shifted'").collect()} == brute(items, docs)


def test_words():
    assert words("# Ação — **rápida**\n[x](http://y/z) &nbsp;<b>fim</b> co­isa") == ["acao", "rapida", "x", "fim", "coisa"]
    assert words("Q: who?\nA: me") == ["who", "me"] and words(None) == [] and words("  ") == []


def test_edge_cases(spark):
    p = " ".join(f"k{i}" for i in range(14))
    items = spark.createDataFrame([(1, "s", None, None, p), (2, "s", "short", "text", None)], ITEMS)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, p), (3, p), (4, " ".join(p.split()[:11])), (5, "x " * 40000 + p)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.match) for r in leaks(docs, items).collect()) == [(3, "phrase"), (5, "phrase")]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_a_word_lost_or_added_is_proximity(spark):
    p = [f"k{i}" for i in range(30)]
    items = spark.createDataFrame([(1, "s", None, None, " ".join(p))], ITEMS)
    docs = [(1, p[3:9] + p[10:17]), (2, p[3:9] + ["new"] + p[9:16]), (3, p[3:9] + ["a", "b"] + p[9:16]), (4, p[3:9] + p[12:17]), (5, p[3:9] + ["new"] + p[10:16]), (6, p[:12])]
    df = spark.createDataFrame([(d, "x y " + " ".join(w) + " z") for d, w in docs], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.match) for r in leaks(df, items).collect()) == [(1, "shifted"), (2, "shifted"), (5, "changed"), (6, "phrase")]


def test_a_stored_index_can_be_asked_again(spark, tmp_path):
    p = " ".join(f"k{i}" for i in range(14))
    docs = spark.createDataFrame([(1, p), (2, "other words"), (None, p)], "doc_id bigint, text string")
    build_index(docs, shard=3).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    assert [(list(r["keys"]), list(r.positions)) for r in index.where("term = 'k3'").collect()] == [([1], [3])]
    for passage, want in ((p, [1]), ("nothing of the kind " * 4, [])):
        got = leaks(docs, spark.createDataFrame([(1, "s", None, None, passage)], ITEMS), index=index)
        assert [r.doc_id for r in got.collect()] == want
