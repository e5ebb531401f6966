"""Quality rules: distribution divergence from language references, beside repetition and length rules.

All of it is Spark SQL functions. A first pass counts, over all documents, each language's character classes
and words; the references are these distributions (word references: the ``TOP`` most frequent short words of
letters of a language and one cell for all other words). A second pass compares every document with every reference by
Jensen-Shannon distance (base 2, square root of the divergence, 0 to 1) and takes the least, so a
wrong label does no harm. The word distance is given as a share of the distance of a text that has none of the
reference's words. Documents below a least number of words are not judged by a distance: their histograms say
too little. Nor are documents whose own language has no reference: other languages' words say nothing of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import WHITE, words, written

#: Words of a reference, and the longest word that can be one of them.
TOP, SHORT = 24, 8
#: A language gives a reference if one document in so many is its, whatever the size of the corpus: at most so many
#: references, and the same verdicts for the same mix of documents. Documents of rarer ones are not judged by distance.
ONE_IN = 100
#: Character classes: Java patterns of what is counted, taken out one after another; a last cell holds what is left.
CLASSES = {
    "lower": "[a-z]+",
    "white": WHITE,
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "symbol": r"[#*$%&|<>]+",
    "other": r"[!-/:-@\[-`{-~]+",
}
#: Largest distances kept, and the words from which each is asked for.
MOST_CLASSES, LEAST_WORDS_CLASSES = 0.28, 40
MOST_WORDS, LEAST_WORDS_WORDS = 0.85, 100


def _with_classes(df: DataFrame, text: str) -> DataFrame:
    """Add ``q_classes``: array of the character counts by class, the rest last."""
    left, counts = text, []
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"q_without_{name}", F.regexp_replace(left, pattern, ""))
        counts.append(F.length(left) - F.length(f"q_without_{name}"))
        left = f"q_without_{name}"
    return df.withColumn("q_classes", F.array(*counts, F.length(left))).drop(*(f"q_without_{name}" for name in CLASSES))


def _lang(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(""))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[dict]:
    """Per language: its class shares and its most frequent words with their hashes and shares.

    Rows with a null language count as one language of their own. Every language that one document in ``ONE_IN``
    or more has gives a reference; ``TOP`` words of each come to the driver, of ``ONE_IN`` languages at most.
    """
    lang = _lang(lang_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(lang.alias("lang"), text.alias("text"))
    counts = _with_classes(base, "text")
    sums = counts.groupBy("lang").agg(F.count("*").alias("docs"), *(F.sum(F.get("q_classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)))
    sums = written(sums)
    all_docs = sums.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    kept = sums.where(F.col("docs") * ONE_IN >= all_docs).orderBy(F.desc("docs"), "lang").collect()
    if not kept:
        return []
    each = base.where(F.col("lang").isin([r["lang"] for r in kept])).select("lang", F.explode(words(F.col("text"))).alias("word"))
    short = F.col("word").rlike(rf"^\p{{L}}{{1,{SHORT}}}$")
    tallied = written(each.groupBy("lang", F.when(short, F.col("word")).alias("word")).agg(F.count("*").alias("n")))
    totals = {r["lang"]: r["n"] for r in tallied.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = tallied.where("word is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= TOP)
    top = top.withColumn("hash", F.xxhash64("word")).collect()
    out = []
    for r in kept:
        total = [r[f"c{i}"] for i in range(len(CLASSES) + 1)]
        if sum(total) and totals.get(r["lang"]):
            if not any(x["lang"] == r["lang"] for x in top):
                continue
            own = sorted((x["r"], x["word"], x["hash"], x["n"]) for x in top if x["lang"] == r["lang"])
            out.append(
                {
                    "lang": r["lang"],
                    "classes": [x / sum(total) for x in total],
                    "words": [w for _, w, _, _ in own],
                    "hashes": [h for _, _, h, _ in own],
                    "shares": [n / totals[r["lang"]] for *_, n in own],
                }
            )
    return out


def _log_term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def js_distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of a distribution (array<double>) from a fixed one of as many cells."""
    terms = F.zip_with(p, F.array(*map(F.lit, map(float, q))), lambda a, b: _log_term(a, (a + b) / 2) + _log_term(b, (a + b) / 2))
    return F.sqrt(F.greatest(_sum(terms) / 2, F.lit(0.0)))


def _distances(df: DataFrame, refs: list[dict]) -> DataFrame:
    """Add ``d_classes`` and ``d_words``, the least distances over the references; null without any."""
    if not refs:
        return df.withColumns({"d_classes": F.lit(None).cast("double"), "d_words": F.lit(None).cast("double")})
    # the hashes of common words are sorted with one of each put in: a word's hits lie between its place and the next one's
    every = sorted({h for r in refs for h in r["hashes"]})
    df = df.withColumn("q_common", F.filter("q_hash", lambda h: h.isin(every)))
    df = df.withColumn("q_ring", F.sort_array(F.concat("q_common", F.array(*map(F.lit, every)))))
    # over an array of literals: one expression for each word makes a method that is too long to be compiled
    at = F.transform(F.array(*map(F.lit, every)), lambda h: F.array_position("q_ring", h))
    df = df.withColumn("q_place", F.concat(at, F.array(F.size("q_ring").cast("long") + 1)))
    df = df.withColumn("q_hits", F.zip_with(F.slice("q_place", F.lit(2), F.lit(len(every))), F.slice("q_place", F.lit(1), F.lit(len(every))), lambda b, a: b - a - 1))
    n_chars = F.greatest(F.length("q_text"), F.lit(1))
    df = df.withColumn("q_share", F.transform("q_classes", lambda x: x / n_chars))
    n_words = F.greatest(F.col("n_words"), F.lit(1))
    place = {h: i for i, h in enumerate(every)}
    found = lambda r: F.transform(F.array(*(F.lit(place[h]) for h in r["hashes"])), lambda i: F.get("q_hits", i) / n_words)
    df = df.withColumns({f"q_found_{k}": found(r) for k, r in enumerate(refs)})
    by_class, by_word = [], []
    for k, r in enumerate(refs):
        by_class.append(js_distance(F.col("q_share"), r["classes"]))
        whole = [*r["shares"], max(0.0, 1 - sum(r["shares"]))]
        # the distance from a text of other words only: all of the cells but the last add their half
        rest = whole[-1]
        none = math.sqrt((sum(r["shares"]) - math.log2((1 + rest) / 2) + (rest * math.log2(2 * rest / (1 + rest)) if rest else 0)) / 2)
        other = F.greatest(F.lit(0.0), F.lit(1.0) - _sum(F.col(f"q_found_{k}")))
        by_word.append(js_distance(F.concat(f"q_found_{k}", F.array(other)), whole) / none)
    least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
    return df.withColumns({"d_classes": least(by_class), "d_words": least(by_word)})


def _measured(df: DataFrame) -> DataFrame:
    """Add the counts of the fixed rules and what the distances need, from ``q_text``."""
    text = F.col("q_text")
    df = _with_classes(df, "q_text").withColumn("q_words", words(text))
    cell = {name: F.get("q_classes", F.lit(i)) for i, name in enumerate(CLASSES)}
    # windows of five from windows of two and four: each word is hashed once
    joined = lambda a, b, skip: F.zip_with(a, F.slice(b, F.lit(skip + 1), F.size(b)), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn("q_hash", F.transform("q_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("q_two", joined("q_hash", "q_hash", 1)).withColumn("q_four", joined("q_two", "q_two", 2))
    five = F.slice(joined("q_four", "q_hash", 4), F.lit(1), F.greatest(F.size("q_hash") - 4, F.lit(0)))
    df = df.withColumns({"q_five": five, "q_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # windows that occur twice or more, in order of their places
    again = F.size(F.array_distinct("q_five")) < F.size("q_five")
    sorted_ = F.when(again, F.array_sort(F.transform("q_five", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("q_sorted", sorted_)
    same = lambda x, i: F.coalesce(F.get("q_sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("q_sorted", i + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("q_at", F.when(F.col("q_sorted").isNotNull(), F.array_sort(F.transform(F.filter("q_sorted", same), lambda x: x["i"]))))
    covered = F.transform("q_at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("q_at", i + 1) - p, F.lit(5))))
    return df.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "word_chars": (F.length(text) - cell["white"]).cast("long"),
            "n_symbols": cell["symbol"].cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        }
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d_classes", "d_words", "kept")


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", refs: list[dict] | None = None) -> DataFrame:
    """``docs`` with the rules' measures and verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, d_classes, d_words
    (double) and kept; a column of ``docs`` of such a name is replaced. Rows stay one for one. Null, empty and
    white-space texts have no words, fail and are not
    kept. Below the least number of words, and where ``refs`` have none of the document's language, a distance
    is given but does not count. Without any reference (an empty table, or only rare languages)
    they are null and do not count either. Equal
    rows get equal verdicts. Words of references and windows of five words are told apart by 64-bit hashes within one text.

    The measures come out of a generator of one row, which conditions on them are not pushed through: inside the
    projections below, a condition would repeat all that its column is computed from, one step in the other.
    """
    refs = references(docs, text_col, lang_col) if refs is None else refs
    known = _lang(lang_col).isin([r["lang"] for r in refs])
    left = [c for c in docs.columns if c.lower() not in MEASURES]
    row = F.struct(*(F.col(f"`{c}`") for c in left)) if left else F.lit(0)
    df = docs.select(row.alias("q_row"), F.coalesce(F.col(text_col), F.lit("")).alias("q_text"), known.alias("q_known"))
    df = _distances(_measured(df), refs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = lambda d, most, least: F.coalesce((F.col("n_words") >= least) & (F.col(d) > most), F.lit(False))
    odd = far("d_classes", MOST_CLASSES, LEAST_WORDS_CLASSES) | far("d_words", MOST_WORDS, LEAST_WORDS_WORDS)
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & ~(F.col("q_known") & odd))
    out = df.select("q_row", F.inline(F.array(F.struct(*MEASURES))))
    return out.select(*([f"q_row.`{c}`" for c in left]), *MEASURES)


def kept_only(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    return judged(rows, "t", "l").where("kept").select("row.*")
