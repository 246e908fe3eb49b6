"""Chunking of page lines, and filters on chunks.

Lines are (book, page, line_no, line, size).  Chunks are (book, chunk_no, label,
text, pages).  Both chunkers are windows over a book's lines; a book is the unit
that the order is defined in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import stripped, text_lines, title_case, without_page_header

HEADING_RATIO = 1.3
#: The six ability lines of a stat block.
ABILITIES = ("FOR", "DES", "CON", "INT", "SAB", "CAR")


def page_lines(pages: DataFrame) -> DataFrame:
    """Parallel arrays to rows; pages without lines give none."""
    zipped = F.posexplode(F.arrays_zip("lines", "line_sizes")).alias("i", "z")
    x = pages.select("book", F.col("number").alias("page"), "page_id", zipped)
    return x.select("book", "page", "page_id", (F.col("i") + 1).alias("line_no"), F.col("z.lines").alias("line"), F.col("z.line_sizes").alias("size"))


def body_size(lines: DataFrame) -> DataFrame:
    """(book, body): the commonest size, the smaller one on a tie."""
    n = lines.where("size is not null").groupBy("book", "size").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("book").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))


def is_caps_heading(line: Column) -> Column:
    """Two letters or more, all upper case, at most six words."""
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & (line == F.upper(line)) & (F.size(F.split(F.trim(line), r"\s+")) <= 6)


def _assembled(x: DataFrame) -> DataFrame:
    """Rows (book, chunk_no, page, line_no, line, head) to chunks."""
    at = F.struct("page", "line_no")
    return x.groupBy("book", "chunk_no").agg(
        F.min_by("head", at).alias("label"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))), lambda r: r["line"]), "\n").alias("text"),
        F.array_sort(F.collect_set("page")).alias("pages"),
    )


def by_caps(lines: DataFrame) -> DataFrame:
    """A chunk starts at the first heading of a run of headings; the run's others are dropped.

    A heading is a caps line at least ``HEADING_RATIO`` times the body size.  Only
    a book's last chunk can consist of its heading alone; lines before the first
    heading are a chunk called after their page.
    """
    w = Window.partitionBy("book").orderBy("page", "line_no")
    x = lines.join(body_size(lines), "book", "left")
    head = F.coalesce(is_caps_heading(F.col("line")) & (F.col("size") >= HEADING_RATIO * F.col("body")), F.lit(False))
    x = x.withColumn("is_head", head).withColumn("was_head", F.coalesce(F.lag("is_head").over(w), F.lit(False)))
    x = x.where(~(F.col("is_head") & F.col("was_head")))
    x = x.withColumn("chunk_no", F.sum(F.col("is_head").cast("int")).over(w))
    x = x.withColumn("head", F.when(F.col("is_head"), title_case(F.trim("line"))).otherwise(F.concat(F.lit("p."), F.col("page").cast("string"))))
    return _assembled(x)


def by_heading(lines: DataFrame) -> DataFrame:
    """Every line with a size above zero starts a chunk; the lines before the first are called ``p.1``."""
    w = Window.partitionBy("book").orderBy("page", "line_no")
    x = lines.withColumn("is_head", F.coalesce(F.col("size") > 0, F.lit(False)))
    x = x.withColumn("chunk_no", F.sum(F.col("is_head").cast("int")).over(w))
    x = x.withColumn("head", F.when(F.col("is_head"), F.trim(F.regexp_replace("line", "^#+", ""))).otherwise(F.lit("p.1")))
    return _assembled(x)


def markdown_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A Markdown text as one page: heading levels 1–6 become sizes 6–1, other lines 0; the header and trailing blank lines go."""
    lines = text_lines(without_page_header(F.col(text)))
    filled = F.array_max(F.transform("lines", lambda x, i: F.when(stripped(x) != "", i + 1).otherwise(0)))
    x = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("book"), lines.alias("lines"))
    x = x.select("book", F.posexplode(F.slice("lines", F.lit(1), filled)).alias("i", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    return x.select("book", F.lit(1).alias("page"), (F.col("i") + 1).alias("line_no"), "line", F.when(level > 0, 7.0 - level).otherwise(0.0).alias("size"))


def has_stat_block(text: Column, least: int = 4) -> Column:
    """At least so many of the six ability lines, each standing alone on its line."""
    own = F.transform(text_lines(text), lambda l: stripped(l))
    return F.size(F.array_intersect(own, F.array(*[F.lit(a) for a in ABILITIES]))) >= least
