"""Queries of what works at any size: row indices, ranges of files, permutations, tails, functions in SQL text, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import sql, stats
from tallyweave.operators import indexing, scoring
from tallyweave.plans.catalog import query
from tallyweave.plans.sql_parts import BIGRAMS, GAMMA_Q, HIT, KEY, TOKENS, hash_steps
from tallyweave.session import new_path, table
from tallyweave.sources import jsonl, traces
from tallyweave.streaming import dedup


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
      SELECT doc_id, pos::INT AS pos, md5(line) AS line_md5, row_number() OVER (ORDER BY doc_id, pos) - 1 AS idx FROM l""")
def indexed_rows(spark, sf_dir):
    """All lines of all texts with their place in the whole table."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return indexing.with_row_index(lines.select("doc_id", "pos", F.md5("line").alias("line_md5")), ["doc_id", "pos"])


@query("""SELECT doc_id, md5(text) AS text_md5, length(text)::BIGINT AS chars, lang FROM documents""")
def shard_lines(spark, sf_dir):
    """Texts written as JSON lines and read back by ranges of the files, without a torn tail."""
    path = new_path(spark, "shard-lines")
    jsonl.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    lines = jsonl.numbered_lines(spark, path, torn=False)
    rows = lines.select(F.from_json("line", "doc_id long, text string, lang string", {"mode": "FAILFAST"}).alias("r"))
    return rows.select("r.doc_id", F.md5("r.text").alias("text_md5"), F.length("r.text").cast("long").alias("chars"), "r.lang")


@query("""SELECT doc_id AS idx, length(text)::BIGINT AS length FROM documents""")
def length_hints_of_shards(spark, sf_dir):
    """Lengths of the responses of one completed file after another, each row at its place among all."""
    path = new_path(spark, "length-hints")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("response"))
    jsonl.write_jsonl(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)
    return traces.length_hints(spark, path, docs.count()).select("idx", F.col("length").cast("long").alias("length"))


@query("""WITH RECURSIVE p AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, ceil(sqrt(n))::BIGINT AS a FROM (SELECT count(*) AS n FROM orders))),
      i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders),
      s AS (SELECT o_orderkey, idx, 0 AS k, idx % a AS l, idx // a AS r FROM i, p UNION ALL
        SELECT o_orderkey, idx, k % 4 + 1, r, (l + ('0x' || substr(md5('42:' || (k % 4 + 1) || ':' || r), 1, 15))::BIGINT) % CASE WHEN k % 2 = 0 THEN a ELSE b END FROM s, p WHERE k < 4 OR r * a + l >= n)
      SELECT o_orderkey, idx::BIGINT AS idx, (r * a + l)::BIGINT AS scan_pos FROM s, p WHERE k = 4 AND r * a + l < n""")
def shuffled_rows(spark, sf_dir):
    """Orders with their place, and their place after a keyed shuffle of the whole table."""
    rows = indexing.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return rows.withColumn("scan_pos", indexing.permuted_index(F.col("idx"), rows.count(), 42))


_SHARES = """p AS (SELECT l_orderkey, l_linenumber, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS p FROM lineitem)"""


@query(f"""WITH {_SHARES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_linenumber) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM p),
      ks AS (SELECT unnest([2, 4, 8, 16]) AS k), least_k AS (SELECT min(k) AS k FROM (SELECT k, min(m) AS least FROM (SELECT k, l_orderkey, CASE WHEN max(n) <= k THEN 1 ELSE sum(p) FILTER (place <= k) END AS m FROM r, ks GROUP BY 1, 2) GROUP BY k) WHERE least >= 0.7),
      c AS (SELECT l_orderkey, l_linenumber, k, sum(p) OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_linenumber ROWS UNBOUNDED PRECEDING) - p AS before FROM r, least_k WHERE place <= k)
      SELECT l_orderkey, count(*)::BIGINT AS kept, sum(l_linenumber)::BIGINT AS lines, max(k)::BIGINT AS k FROM c WHERE before <= 0.7 GROUP BY l_orderkey""")
def top_candidates(spark, sf_dir):
    """Line quantities as probabilities: the nucleus among the k largest of each order, for the least doubled k that is enough everywhere."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    whole = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("all"))
    shares = lines.join(whole, "l_orderkey").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / F.col("all")).alias("p"))
    k, kept = scoring.candidates(shares, "l_orderkey", "p", "l_linenumber", 0.7)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.sum("l_linenumber").cast("long").alias("lines"), F.lit(k).cast("long").alias("k"))


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents), s AS (SELECT doc_id, n, n * (0.94 + (doc_id % 10) / 50.0::DOUBLE) AS total FROM w), q AS (SELECT doc_id, n / 0.82::DOUBLE AS a, total / 0.82 AS x FROM s), {GAMMA_Q}
      SELECT doc_id, round(p, 6) AS p_value, p < 0.01 AS detected FROM q JOIN tail USING (a, x)""")
def sample_gamma_test(spark, sf_dir):
    """The unweighted gamma tail of each text, its score a stand-in from its length and id."""
    n = F.size(F.split("text", " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), (n * (0.94 + F.col("doc_id") % 10 / F.lit(50.0))).alias("total"))
    p = stats.unweighted_gamma(F.col("n"), F.col("total"), 0.1)["p_value"]
    return rows.select("doc_id", F.round(p, 6).alias("p_value"), (p < 0.01).alias("detected"))


@query(f"""WITH {BIGRAMS}, {hash_steps('grams', 'id, prev, cur, token')}, s AS (SELECT source, count(*)::BIGINT AS n, count(*) FILTER ({HIT})::BIGINT AS hits FROM hashed JOIN documents ON id = doc_id GROUP BY source)
      SELECT source, n, hits, round(CASE WHEN hits / n::DOUBLE <= 0.5 THEN 1.0 ELSE exp(-2 * n * (hits / n::DOUBLE - 0.5) * (hits / n::DOUBLE - 0.5)) END, 9) AS p_value FROM s""")
def sql_signal_by_source(spark, sf_dir):
    """The signal in all positions by source, in SQL text alone."""
    sql.register(spark)
    return spark.sql(
        """WITH t AS (SELECT source, explode(array(transform(split(lower(text), ' '), w -> CAST(conv(substr(md5(w), 1, 15), 16, 10) AS BIGINT) % 151936))) AS toks FROM {documents}),
        g AS (SELECT source, explode(arrays_zip(slice(concat(array(-1L), toks), 1, greatest(size(toks) - 1, 0)), slice(toks, 1, greatest(size(toks) - 1, 0)), slice(toks, 2, greatest(size(toks) - 1, 0)))) AS z FROM t),
        k1 AS (SELECT source, wrapped_m1(z['2']) ^ wrapped_m2(z['0']) ^ wrapped_m3(z['1']) ^ {seed} AS x FROM g),
        k2 AS (SELECT source, x ^ shiftright(x, 30) AS x FROM k1), k3 AS (SELECT source, wrapped_m2(x) AS x FROM k2),
        k4 AS (SELECT source, x ^ shiftright(x, 27) AS x FROM k3), k5 AS (SELECT source, wrapped_m3(x) AS x FROM k4),
        s AS (SELECT source, count(*) AS n, count_if((x ^ shiftright(x, 31)) & 9223372036854775807 < 4611686018427387648) AS hits FROM k5 GROUP BY source)
        SELECT source, n, hits, round(hoeffding(hits / n, n, 0.5D), 9) AS p_value FROM s""",
        documents=table(spark, sf_dir, "documents"), seed=KEY.seed,
    )


@query(f"""WITH {TOKENS}, seqs AS (SELECT id, list(token ORDER BY pos) AS t FROM toks GROUP BY id), g AS (SELECT id, t, unnest(range(4, len(t))) AS pos FROM seqs WHERE len(t) > 4)
      SELECT id, count(*)::BIGINT AS n, sum(t[pos + 1])::BIGINT AS targets, count(DISTINCT t[pos - 2 : pos])::BIGINT AS contexts FROM g GROUP BY id""")
def sql_ngrams(spark, sf_dir):
    """Contexts of three tokens (ids of 18 bits, packed into one number) and their targets by the corpus rule, in SQL text alone, counted inside the row."""
    sql.register(spark)
    return spark.sql(
        """WITH t AS (SELECT doc_id AS id, explode(array(transform(split(lower(text), ' '), w -> CAST(conv(substr(md5(w), 1, 15), 16, 10) AS BIGINT) % 151936))) AS toks FROM {documents})
        SELECT id, CAST(size(toks) - 4 AS BIGINT) AS n, aggregate(slice(toks, 5, size(toks) - 4), 0L, (s, t) -> s + t) AS targets,
          CAST(size(array_distinct(zip_with(zip_with(slice(toks, 2, size(toks) - 4), slice(toks, 3, size(toks) - 4), (a, b) -> a * 262144 + b), slice(toks, 4, size(toks) - 4), (a, b) -> a * 262144 + b))) AS BIGINT) AS contexts
        FROM t WHERE size(toks) > 4""",
        documents=table(spark, sf_dir, "documents"),
    )


@query(r"""WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'so \boxed{' || chr((65 + doc_id % 5)::INT) || '}' WHEN 1 THEN 'first \boxed{A}; final \boxed{ ' || chr((97 + doc_id % 4)::INT) || ' }' WHEN 2 THEN 'the option is ' || chr((65 + doc_id % 4)::INT) ELSE text END AS answer FROM documents)
      SELECT doc_id, coalesce(upper(regexp_extract_all(answer, '(?i)\\boxed\s*\{\s*([A-D])\s*\}', 1)[-1]), upper(regexp_extract_all(answer, '(?i)(?:final\s+answer|answer|option|choice)\s*(?:is|:)?\s*[*\\(\[]*([A-D])\b', 1)[-1])) AS choice,
        upper(regexp_extract_all(answer, '(?i)\\boxed\s*\{\s*([A-D])\s*\}', 1)[-1]) AS boxed FROM a""")
def sql_choices(spark, sf_dir):
    """Choices of answers, in SQL text alone."""
    sql.register(spark)
    return spark.sql(
        r"""SELECT doc_id, last_choice(answer) AS choice, last_boxed(answer) AS boxed FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('so \\boxed{{', char(65 + doc_id % 5), '}}') WHEN 1 THEN concat('first \\boxed{{A}}; final \\boxed{{ ', char(97 + doc_id % 4), ' }}')
        WHEN 2 THEN concat('the option is ', char(65 + doc_id % 4)) ELSE text END AS answer FROM {documents})""",
        documents=table(spark, sf_dir, "documents"),
    )


@query("""SELECT user_id, event_type, min(event_id)::BIGINT AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2""")
def streamed_first_events(spark, sf_dir):
    """The first event of each user and type, by a stream that takes the events in whatever order they lie in the files."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    to = new_path(spark, "first-events")
    source = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{source[:-1]}[{source[-1]}]")
    dedup.first_by_order(stream, ["user_id", "event_type"], "event_id", ["value"], f"{to}/table", f"{to}/checkpoint").awaitTermination()
    return dedup.first_table(spark, events, ["user_id", "event_type"], "event_id", ["value"], f"{to}/table")
