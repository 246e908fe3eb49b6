"""Evaluation: recall, cost, confidence intervals, regressions, reports, query sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import stripped, text_lines
from tessera.workspace import Workspace, shuffle_partitions

# Dollars per million tokens.
PRICE_IN, PRICE_OUT = 1.0, 5.0
TOLERANCE = 0.05
#: Values of a group that a task of the bootstrap holds, values in a row on their way there, tasks that share its resamples.
IN_TASK, PACKED, SHARES = 4_000_000, 50_000, 16
#: Hashes that are computed at once.
AT_ONCE = 1 << 14


def expected_answer(key: str = "answer_key", labels: str = "relevant_labels") -> Column:
    """A JSON list joined by "; ", else the plain value, else the labels joined."""
    listed = F.array_join(F.from_json(F.when(F.col(key).startswith("["), F.col(key)), "array<string>"), "; ")
    return F.coalesce(F.nullif(listed, F.lit("")), F.nullif(F.trim(key), F.lit("")), F.array_join(labels, "; "))


def generation_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / F.lit(1e6) * F.lit(PRICE_IN) + tokens_out / F.lit(1e6) * F.lit(PRICE_OUT)


def arm_totals(responses: DataFrame) -> DataFrame:
    """Per arm: answers, tokens, mean latency (0 without one), dollars."""
    tin, tout = F.sum(F.coalesce("input_tokens", F.lit(0))), F.sum(F.coalesce("output_tokens", F.lit(0)))
    return responses.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), (tin + tout).alias("total_tokens"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("mean_latency_ms"),
        F.round(generation_cost(tin, tout), 6).alias("cost_usd"),
    )


def recall(retrieved: DataFrame, queries: DataFrame, relevant: str = "relevant_sources") -> DataFrame:
    """(query_id, recall): share of distinct relevant sources among the retrieved, compared exactly.

    ``retrieved`` (query_id, source), ``queries`` (query_id, array of relevant sources);
    reading a query without relevant sources fails, since it has no recall.
    """
    none = F.raise_error(F.concat(F.lit("no relevant sources: "), F.col("query_id").cast("string"))).cast("array<string>")
    own = F.array_distinct(F.array_compact(F.col(relevant)))
    want = queries.select("query_id", F.explode(F.when(F.size(own) > 0, own).otherwise(none)).alias("source"))
    got = retrieved.select("query_id", "source", F.lit(1).alias("hit")).distinct()
    return want.join(got, ["query_id", "source"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def verdict(base: DataFrame, variant: DataFrame, least: float = 0.02) -> DataFrame:
    """Mean recall of two runs, their difference, and KEEP or REVERT."""
    b, v = base.agg(F.avg("recall").alias("b")), variant.agg(F.avg("recall").alias("v"))
    row = b.select(F.round("b", 6).alias("base")).withColumn("variant", v.select(F.round("v", 6)).scalar())
    d = F.round(F.col("variant") - F.col("base"), 6)
    return row.select("base", "variant", d.alias("delta"), F.when(d >= least, "KEEP").otherwise("REVERT").alias("verdict"))


def confusion(queries: DataFrame, flag: str = "attack_vs_resistance_confusion") -> DataFrame:
    """One row: tagged queries, confusions, their rate (0 without any), sorted ids."""
    q = queries.where(F.col(flag).isNotNull())
    return q.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("confusions"), F.round(F.coalesce(F.try_divide(F.count_if(flag), F.count(F.lit(1))), F.lit(0.0)), 6).alias("rate"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col(flag), F.col("id")))), ",").alias("ids"),
    )


def judged_runs(scores: DataFrame) -> DataFrame:
    """(arm, case_id, metric, value): the mean over repeated judge runs (arm, case_id, metric, run, value)."""
    return scores.groupBy("arm", "case_id", "metric").agg(F.avg("value").alias("value"))


def bootstrap(values: DataFrame, group: str, value: str, resamples: int = 2000, seed: str = "0", level: float = 0.95, order: str = "id") -> DataFrame:
    """(group, mean, ci_low, ci_high, n): percentile bootstrap with a hash for a coin.

    Slot j of resample b takes the row numbered md5(seed:group:b:j) modulo n, so
    any engine draws the same rows.  Groups of one row have no interval and are
    left out; null values are ignored; repeated values need distinct ``order``.

    Nothing is moved per slot: the resamples of a group are shared out to tasks,
    each with the values of the group as one array.  A group of more than
    ``IN_TASK`` values meets its slots in a join instead.
    """
    ws = Workspace(values.sparkSession, "bootstrap")
    w = Window.partitionBy(group).orderBy(order)
    rows = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"), (F.row_number().over(w) - 1).alias("i"))
    rows = ws.write(rows)[1]
    n = ws.write(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")).where("n > 1 and g is not null"))[1]
    small, large = n.where(F.col("n") <= IN_TASK), n.where(F.col("n") > IN_TASK)
    means = _drawn_in_tasks(rows.join(small.select("g"), "g"), resamples, seed)
    if not large.isEmpty():
        means = means.unionByName(_drawn_by_join(rows, large, resamples, seed))
    tail = (1 - level) / 2
    q = means.groupBy("g").agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))
    return n.join(q, "g").select(F.col("g").alias(group), F.round("mean", 4).alias("mean"), F.round("lo", 4).alias("ci_low"), F.round("hi", 4).alias("ci_high"), "n")


def _drawn_by_join(rows: DataFrame, n: DataFrame, resamples: int, seed: str) -> DataFrame:
    """(g, m): the means of all resamples, a row for each slot."""
    slots = rows.join(n, "g").select("g", "n", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    key = F.concat_ws(":", F.lit(seed), F.col("g"), F.col("b").cast("string"), F.col("j").cast("string"))
    pick = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % F.col("n")
    return slots.withColumn("i", pick).join(rows, ["g", "i"]).groupBy("g", "b").agg(F.avg("x").alias("m")).select("g", "m")


def _drawn_in_tasks(rows: DataFrame, resamples: int, seed: str) -> DataFrame:
    """(g, m): the same; a task has the values of a group in order, and some of its resamples."""
    shares = min(SHARES, resamples)
    packed = rows.groupBy("g", F.floor(F.col("i") / PACKED).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("xs"))
    dealt = packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def run(key, parts):
        from itertools import batched, groupby

        import numpy as np
        import pandas as pd

        x = np.concatenate(parts.sort_values("part")["xs"].to_list())
        digits = _digits(len(x))
        own = sorted((f"{seed}:{key[0]}:{b}:".encode() for b in range(int(key[1]), resamples, shares)), key=len)
        drawn = []
        for _, same in groupby(own, len):
            for heads in batched(same, max(1, AT_ONCE // len(x))):
                drawn.extend(x[_drawn(heads, digits, len(x))].mean(axis=1))
        return pd.DataFrame({"g": [key[0]] * len(drawn), "m": drawn})

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, shuffle_partitions(rows.sparkSession))  # a given number is not coalesced: the rows are few, the work isn't
    return dealt.repartition(tasks, "g", "share").groupBy("g", "share").applyInPandas(run, f"g {rows.schema['g'].dataType.simpleString()}, m double")


def _digits(n: int) -> list:
    """The numbers below n as characters, a matrix (digit, number) for each count of digits."""
    import numpy as np

    out = []
    for d in range(1, len(str(n - 1)) + 1):
        j = np.arange(0 if d == 1 else 10 ** (d - 1), min(10**d, n), dtype=np.int64)
        out.append(np.stack([(j // 10 ** (d - 1 - k) % 10 + 48).astype(np.uint32) for k in range(d)]))
    return out


def _drawn(heads: list[bytes], digits: list, n: int):
    """Per text of ``heads``, all of one length, and number j below n: the first four bytes of md5(head + j), modulo n."""
    import hashlib

    import numpy as np

    out = []
    for own in digits:
        d, count = own.shape
        if len(heads[0]) + d > 55:  # more than one block of md5
            tails = [bytes(x) for x in own.T.astype(np.uint8)]
            out.append(np.array([[int.from_bytes(hashlib.md5(h + t).digest()[:4], "big") for t in tails] for h in heads], dtype=np.int64))
        else:
            out.append(np.concatenate([_md5_first(heads, own[:, at : at + AT_ONCE]) for at in range(0, count, AT_ONCE)], axis=1))
    return np.concatenate(out, axis=1) % n


def _md5_first(heads: list[bytes], own):
    """md5 of one block for every head with every end; its first four bytes as a number, a row for each head."""
    import math

    import numpy as np

    d, count = own.shape
    length, shape = len(heads[0]) + d, (len(heads), count)
    texts = b"".join((h + bytes(d) + b"\x80").ljust(56, b"\0") + (8 * length).to_bytes(8, "little") for h in heads)
    fixed = np.frombuffer(texts, "<u4").reshape(len(heads), 16).astype(np.uint32)
    words = [fixed[:, k : k + 1] for k in range(16)]
    for k in range(d):
        word, byte = divmod(length - d + k, 4)
        words[word] = words[word] + (own[k] << np.uint32(8 * byte))
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, e = (np.full(shape, v, np.uint32) for v in start)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    turns = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, e, out=f)
            f &= b
            f ^= e
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= e
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= e
        else:
            np.invert(e, out=f)
            f |= b
            f ^= c
        f += a
        f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16] + np.uint32(int(abs(math.sin(i + 1)) * 2**32))
        r = turns[kind][i % 4]
        np.right_shift(f, np.uint32(32 - r), out=g)
        f <<= np.uint32(r)
        f |= g
        f += b
        a, e, c, b, f = e, c, b, f, a
    a = a + np.uint32(start[0])
    return a.byteswap().astype(np.int64)


def regressions(committed: DataFrame, fresh: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(arm, metric, old, new, status) of what drifted beyond the tolerance or is missing; both sides (arm, metric, mean)."""
    x = committed.select("arm", "metric", F.col("mean").alias("old")).join(fresh.select("arm", "metric", F.col("mean").alias("new")), ["arm", "metric"], "left")
    status = F.when(F.col("new").isNull(), "missing").when(F.abs(F.col("new") - F.col("old")) > tolerance, "drift")
    return x.withColumn("status", status).where("status is not null")


def report(stats: DataFrame, arms: list[str]) -> DataFrame:
    """A row per metric, a column per arm: "mean [low, high]" or an em dash; stats (arm, metric, mean, ci_low, ci_high)."""
    cell = F.concat(F.format_number("mean", 3), F.lit(" ["), F.format_number("ci_low", 3), F.lit(", "), F.format_number("ci_high", 3), F.lit("]"))
    table = stats.withColumn("cell", cell).groupBy("metric").pivot("arm", arms).agg(F.first("cell"))
    return table.fillna("—", subset=arms)


def markdown_table(table: DataFrame) -> str:
    """A small report as Markdown; all of its rows are formatted on the driver, which reads them one partition at a time."""
    rows = [table.columns, ["---"] * len(table.columns), *[list(map(str, r)) for r in table.orderBy(table.columns[0]).toLocalIterator()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def fingerprint(*parts: Column) -> Column:
    """What a cache of answers is keyed by: a hash of all inputs but the judge."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def prompt_context(contexts: str = "contexts") -> Column:
    """``[1] …`` lines of retrieved contexts."""
    numbered = F.transform(contexts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    return F.array_join(numbered, "\n")


# -- query sets ----------------------------------------------------------------------------


def sources_with(edges: DataFrame, kind: str, targets: list[str]) -> DataFrame:
    return edges.where((F.col("type") == kind) & F.col("dst").isin(*targets)).select("src").distinct()


def conjunction(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.intersect(p)
    return out


def targets_of(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(src, labels): targets of every source by arrival."""
    x = edges.where(F.col("type") == kind).join(nodes.select(F.col("id").alias("dst"), "label"), "dst")
    return x.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda r: r["label"]).alias("labels"))


def call_targets(edges: DataFrame, nodes: DataFrame, low: int = 5, high: int = 25, k: int = 6) -> DataFrame:
    """The functions with most calling edges within bounds; ties by id."""
    n = edges.where("type = 'calls'").groupBy("dst").agg(F.count(F.lit(1)).alias("callers")).where(F.col("callers").between(low, high))
    n = n.join(nodes.where("type = 'function'").select(F.col("id").alias("dst")), "dst", "left_semi")
    return n.orderBy(F.col("callers").desc(), "dst").limit(k)


def stale(frozen: DataFrame, fresh: DataFrame) -> bool:
    """Whether a frozen query set differs from what its builder gives now."""
    return bool(frozen.exceptAll(fresh).limit(1).count() or fresh.exceptAll(frozen).limit(1).count())


STORY_WORDS = r"(?i)\b(must|should|shall|when|given)\b"


def stories(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, id, requirement): second- and third-level headings and bullets (-, *, +) that state a requirement, numbered in order."""
    x = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(text_lines(text)).alias("n", "line"))
    body = stripped(F.regexp_extract("line", r"^(?:#{2,3}|\s*[-*+])\s+(.+)$", 1))
    x = x.withColumn("requirement", body).where(F.col("requirement").rlike(STORY_WORDS))
    no = F.row_number().over(Window.partitionBy(key).orderBy("n"))
    return x.select(key, F.format_string("S-%02d", no).alias("id"), "requirement")


def story_table(found: DataFrame) -> DataFrame:
    """Stories as a table of four columns to be filled in: nothing is tested yet."""
    return found.select(F.col("id").alias("Story ID"), F.col("requirement").alias("Requirement"), F.lit("").alias("Test IDs"), F.lit("✗ unmet").alias("Status"))
