import random

from conftest import rows
from tessera.operators.hierarchy import descendants, hierarchy, states


def brute(links):
    par, ids = {}, set()
    for t, s, d in {x for x in links if None not in x}:
        par[t, d] = min(s, par.get((t, d), s))
        ids |= {(t, s), (t, d)}
    out = []
    for t, v in ids:
        path, seen, x = [v], {v}, v
        while (t, x) in par and par[t, x] not in seen:
            x = par[t, x]
            seen.add(x)
            path.append(x)
        if (t, x) not in par:
            out.append((t, v, x, len(path) - 1, "tree"))
        else:
            out.append((t, v, None, None, "on_cycle" if par[t, x] == v else "below_cycle"))
    return sorted(out, key=repr)


def check(spark, links):
    got = hierarchy(spark.createDataFrame(links, "type string, src string, dst string"))
    assert rows(got, "type", "id", "root", "depth", "state") == brute(links)
    bare = hierarchy(spark.createDataFrame(links, "type string, src string, dst string"), paths=False)
    cols = ("type", "id", "root", "depth", "n_descendants", "state")
    assert rows(bare, *cols) == rows(got, *cols) and bare.where("path is not null").count() == 0
    below = {}
    for r in got.collect():
        if r.path:
            assert r.path[0] == r.root and r.path[-1] == r.id and len(r.path) == r.depth + 1
            for a in r.path[:-1]:
                below[r.type, a] = below.get((r.type, a), 0) + 1
    for r in got.where("state = 'tree'").collect():
        assert r.n_descendants == below.get((r.type, r.id), 0), r
    return got


def test_chain_star_and_cycles(spark):
    links = [("c", f"n{i:02d}", f"n{i + 1:02d}") for i in range(23)]
    links += [("s", "hub", f"leaf{i}") for i in range(30)]
    links += [("c", "x", "y"), ("c", "y", "z"), ("c", "z", "x"), ("c", "z", "t1"), ("c", "t1", "t2"), ("c", "t1", "t3"), ("c", "me", "me"), ("c", "me", "kid")]
    links += [("c", "x", "y"), (None, "a", "b"), ("c", None, "b"), ("c", "a", None)]
    got = check(spark, links)
    assert rows(got.where("state = 'below_cycle'"), "id", "n_descendants") == [("kid", 0), ("t1", 2), ("t2", 0), ("t3", 0)]


def test_random_forests(spark):
    r = random.Random(5)
    links = []
    for i in range(1, 160):
        links.append(("a", f"v{r.randrange(max(0, i - 6), i)}", f"v{i}"))
    for i in range(1, 60):
        links.append(("b", f"v{r.randrange(60)}", f"v{i}"))
    check(spark, links)


def test_several_parents_take_the_smallest(spark):
    got = hierarchy(spark.createDataFrame([("t", "b", "x"), ("t", "a", "x")], "type string, src string, dst string"))
    assert rows(got.where("id = 'x'"), "root", "n_parents") == [("a", 2)]


def test_empty_and_descendants(spark):
    none = hierarchy(spark.createDataFrame([], "type string, src string, dst string"))
    assert none.count() == 0
    got = hierarchy(spark.createDataFrame([("t", "a", "b"), ("t", "b", "c")], "type string, src string, dst string"))
    assert rows(descendants(got), "id", "descendant", "distance") == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def by_all_parents(links):
    rows_ = {x for x in links if None not in x}
    up = {}
    for t, p, v in rows_:
        up.setdefault((t, v), set()).add((t, p))
    ids = {(t, x) for t, p, v in rows_ for x in (p, v)}

    def above(n):
        seen, todo = set(), list(up.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        return seen

    on = {n for n in ids if n in above(n)}
    return sorted(((*n, "on_cycle" if n in on else "below_cycle" if above(n) & on else "tree") for n in ids), key=repr)


def test_states_over_all_parents(spark):
    r = random.Random(7)
    links = [("a", "A", "B"), ("a", "B", "B"), ("a", "B", "C"), ("a", "Z", "C"), ("a", None, "C"), ("b", "x", "y")]
    links += [("r", f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(38)] + [("s", f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(60)]
    got = states(spark.createDataFrame(links, "type string, src string, dst string"))
    assert rows(got, "type", "id", "state") == by_all_parents(links)
