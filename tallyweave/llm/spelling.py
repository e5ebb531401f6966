"""Grouping of spelling variants: forward and reversed dictionaries, blocks that an edit leaves intact.

Two words are near if one insertion, deletion or replacement of a code point leads from one to the other. Cut a
word in half: the edit leaves one half as it is. So near words share a prefix (neighbours in the sorted
dictionary) or a suffix (neighbours in the dictionary sorted from the ends), and the words of such a block, scanned as one
sorted range, are verified against one another. A block of over ``MOST`` words is subdivided in the same way: the half that may differ is
halved again, and one of its halves is intact too. This ends with a single place that may differ, where a block
holds no more words than the alphabet has letters, or pairs of them for words longer by one.

Counting, blocks and verification are DataFrame operations; nothing but the words' counts and links is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import dropped, written

#: The capitals that are lower-cased.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point; least code points and occurrences of a word; how many times as common a form is.
SPOILT, LEAST_CHARS, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Maximal runs of letters that are long enough.
RUN = rf"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}+"
#: Words in a block from which it is subdivided.
MOST = 24


def spoilt(id_: Column, run: Column) -> Column:
    """A lower-cased run as it is counted: every ``SPOILT``-th, by the crc32 of id and run, without one code point."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SPOILT == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n long) of the words of all texts that are long and frequent enough."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    found = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    found = found.select(spoilt(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame) -> DataFrame:
    """Add the block: of words of ``size`` code points, or one more (``longer``), the edit is at a place from lo to hi - 1."""
    pre = F.substring("word", F.lit(1), F.col("lo"))
    post = F.greatest(F.col("size") - F.col("hi"), F.lit(0))
    suf = F.substring(F.col("word"), F.length("word") - post + 1, post)
    return rows.withColumn("block", F.concat_ws("/", "size", "lo", "hi", pre, suf))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice, with the places from lo to hi - 1 halved."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("hi").alias("b"))))
    return rows.withColumn("half", half).withColumns({"lo": F.col("half.a"), "hi": F.col("half.b")}).drop("half", "block")


def _scanned(rows: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): near words among the ``rows`` of each block, each pair once a block."""
    word = F.struct("word", "longer", F.col("n").alias("n"))
    ranges = rows.groupBy("block").agg(F.array_sort(F.collect_list(word)).alias("range"))
    each = ranges.select("range", F.explode(F.filter("range", lambda x: ~x["longer"])).alias("a"))
    near = F.filter("range", lambda x: (x["longer"] | (x["word"] > F.col("a.word"))) & (F.levenshtein(x["word"], F.col("a.word"), 1) == 1))
    return each.select("a", F.explode(near).alias("b")).select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words of the dictionary ``words`` (word, n) once, b longer or later in order."""
    size = F.length("word")
    both = F.explode(F.array(F.struct(size.alias("size"), F.lit(False).alias("longer")), F.struct((size - 1).alias("size"), F.lit(True).alias("longer"))))
    rows = words.select("word", "n", both.alias("as")).select("word", "n", "as.size", "as.longer", F.lit(0).alias("lo"), (F.col("as.size") + 1).alias("hi"))
    rows, found = written(_keyed(_halves(rows))), []
    while True:
        blocks = rows.groupBy("block").agg(F.count("*").alias("k"), F.count_if("longer").alias("l")).where("k > 1 and l < k")
        rows_ = rows.join(blocks.select("block", ((F.col("k") > MOST)).alias("large")), "block")
        rows_ = written(rows_.withColumn("large", F.col("large") & (F.col("hi") - F.col("lo") > 1)))
        dropped(rows)
        found.append(written(_scanned(rows_.where("not large"))))
        large = rows_.where("large").drop("large")
        if large.isEmpty():
            break
        rows = written(_keyed(_halves(large)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a dictionary (word, n), a row for each word.

    The form of a word is its near word of largest n, the first in code-point order of such, if that is at
    least ``TIMES`` times the word's; else null. The root follows forms to the last, whose own form is null; as
    forms grow more common by ``TIMES``, there are no cycles. An empty dictionary gives no rows.
    """
    words = written(words)
    links = written(near_words(words))
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = sides.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("w"))).alias("best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.w").alias("form"), (-F.col("best.m")).alias("form_n"))
    rows = words.join(best, "word", "left")
    is_form = F.col("form_n") >= F.col("n") * TIMES
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    rows = written(rows)
    roots = written(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps taken
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        dropped(roots)
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the words of all texts.

    Null texts have no words; a null id counts as an empty string in the crc32 of its runs. Rows that repeat an id or
    a whole document count as often as they occur; other columns are ignored.
    """
    return variants(dictionary(docs, id_col, text_col))
