"""Queries that write a table in the layouts traces come in and read it back by the library's scans; and what is checked of runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import stats
from tallyweave.operators import scoring, split, verification
from tallyweave.operators.indexing import with_row_index
from tallyweave.plans.catalog import _G, _P, _SPLIT_SQL, _probabilities, query
from tallyweave.plans.sql_parts import hoeffding
from tallyweave.plans.trace_catalog import _TURNS, _message_pairs
from tallyweave.session import new_path, table
from tallyweave.sources import artifacts, jsonl, traces


def _json(rows, name):
    path = new_path(rows.sparkSession, name)
    jsonl.write_jsonl(rows, path)
    return path


@query("""SELECT md5(source || '/' || lang) AS prompt_md5, md5(text) AS response_md5, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2""")
def trace_file_scan(spark, sf_dir):
    """Texts as traces in JSON lines, scanned with validation."""
    rows = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("prompt"), F.col("text").alias("response"))
    found = traces.validated_traces(spark, _json(rows, "traces"))
    return found.groupBy(F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id AS index, md5(text) AS response_md5 FROM documents""")
def shard_directory(spark, sf_dir):
    """Texts dealt to eight ranks' shards, read as one set of rows by index."""
    path = new_path(spark, "shards")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("response"), (F.col("doc_id") % 8).alias("rank"))
    rows.repartition("rank").write.partitionBy("rank").json(path)
    return traces.read_shards(spark, path, "index long, response string", pattern="rank=*/part-*").select("index", F.md5("response").alias("response_md5"))


@query("""WITH l AS (SELECT source, doc_id, CASE WHEN doc_id % 83 = 82 THEN 'bad' WHEN doc_id % 7 = 3 THEN 'no object' WHEN doc_id % 7 = 5 THEN 'no integer' ELSE 'good' END AS kind FROM documents),
      p AS (SELECT *, min(CASE WHEN kind = 'bad' THEN doc_id END) OVER (PARTITION BY source) AS stop FROM l)
      SELECT source, min(doc_id // 2) AS index, count(*)::BIGINT AS n FROM (SELECT DISTINCT source, doc_id // 2 AS i, first_value(doc_id) OVER (PARTITION BY source, doc_id // 2 ORDER BY doc_id) AS doc_id FROM p WHERE kind = 'good' AND (stop IS NULL OR doc_id < stop)) GROUP BY source""")
def repaired_checkpoints(spark, sf_dir):
    """A checkpoint for each source, in the order of ids, with broken lines, lines to skip and repeated indices."""
    i, path = F.floor(F.col("doc_id") / 2).cast("string"), new_path(spark, "checkpoints")
    line = (
        F.when(F.col("doc_id") % 83 == 82, F.concat(F.lit('{"index": '), i, F.lit(', "x"'))).when(F.col("doc_id") % 7 == 3, F.concat(F.lit("["), i, F.lit("]")))
        .when(F.col("doc_id") % 7 == 5, F.concat(F.lit('{"index": "'), i, F.lit('"}'))).otherwise(F.concat(F.lit('{"index": '), i, F.lit("}")))
    )
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", line.alias("value"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    kept = traces.repaired(jsonl.numbered_lines(spark, f"{path}/source=*"), "index long").withColumn("source", F.regexp_extract("file", "source=([^/]*)/", 1))
    return kept.groupBy("source").agg(F.min("index").alias("index"), F.count("*").alias("n"))


def _science(spark, sf_dir):
    m = _message_pairs(spark, sf_dir).where((F.get("messages", F.lit(0))["role"] == "user") & (F.get("messages", F.lit(1))["role"] == "assistant"))
    gold = F.when(F.col("turn") % 4 == 0, F.char(F.lit(97) + F.col("conv_id") % 4))
    said = lambda k, end: F.struct(F.get("messages", F.lit(k))["role"].alias("role"), F.concat(F.get("messages", F.lit(k))["content"], end).alias("content"))
    return m.select(F.array(said(0, F.lit(" ")), said(1, F.concat(F.lit(" \\boxed{"), F.char(F.lit(65) + F.col("turn") % 4), F.lit("}")))).alias("messages"), F.struct(gold.alias("gold_choice")).alias("_meta"))


@query(rf"""WITH {_TURNS} SELECT md5(trim(t1)) AS prompt_md5, '\boxed{{' || CASE WHEN turn % 4 = 0 THEN chr((65 + conv_id % 4)::INT) ELSE chr((65 + turn % 4)::INT) END || '}}' AS solution, count(*)::BIGINT AS n FROM m WHERE r1 = 'user' AND r2 = 'assistant' GROUP BY 1, 2""")
def science_provider(spark, sf_dir):
    """Turns as prepared multiple-choice rows, through their provider: the recorded choice, else the boxed one."""
    found = traces.examples(spark, "science", _json(_science(spark, sf_dir), "science"))
    return found.groupBy(F.md5("prompt").alias("prompt_md5"), "solution").agg(F.count("*").alias("n"))


@query("""SELECT md5(trim(substr(text, 1, 40), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS prompt_md5, md5(lang) AS solution_md5, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2""")
def question_provider(spark, sf_dir):
    """Questions and answers through their provider."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("  "), F.substring("text", 1, 40)).alias("question"), F.concat("lang", F.lit(" ")).alias("answer"))
    found = traces.examples(spark, "gsm8k", _json(rows, "questions"))
    return found.groupBy(F.md5("prompt").alias("prompt_md5"), F.md5("solution").alias("solution_md5")).agg(F.count("*").alias("n"))


@query(rf"""WITH {_TURNS} SELECT 2::BIGINT AS turns, count(*)::BIGINT AS n FROM m WHERE conv_id % 3 <> 0""")
def message_provider(spark, sf_dir):
    """Rows with messages through their provider; those without any are left out."""
    rows = _message_pairs(spark, sf_dir).select(F.when(F.col("conv_id") % 3 != 0, F.col("messages")).otherwise(F.array().cast(traces.MESSAGES)).alias("messages"))
    found = traces.examples(spark, "oasst1", _json(rows, "messages"))
    return found.groupBy(F.size("messages").cast("long").alias("turns")).agg(F.count("*").alias("n"))


@query(rf"""WITH {_TURNS} SELECT count(*)::BIGINT AS n, count(DISTINCT t1)::BIGINT AS prompts FROM m WHERE r2 = 'assistant'""")
def choice_row_scan(spark, sf_dir):
    """Evaluation rows, which end with an assistant's message."""
    rows = _message_pairs(spark, sf_dir).where(F.get("messages", F.lit(1))["role"] == "assistant").select("messages")
    found = traces.choice_rows(spark, _json(rows, "choices"))
    return found.agg(F.count("*").alias("n"), F.countDistinct(F.get("messages", F.lit(0))["content"]).alias("prompts"))


@query("""SELECT doc_id, dense_rank() OVER (ORDER BY doc_id % 3, doc_id // 3 % 2) - 1 AS part FROM documents""")
def saved_parts(spark, sf_dir):
    """Three ranks' rows in two parts each, one of them saved twice, read in the order of the parts' paths."""
    path, docs = new_path(spark, "parts"), table(spark, sf_dir, "documents").select("doc_id")
    for rank in range(3):
        for part in range(2):
            rows = docs.where((F.col("doc_id") % 3 == rank) & (F.floor(F.col("doc_id") / 3) % 2 == part))
            for _ in range(1 + (rank == part == 0)):
                artifacts.save_part(rows, path, rank, part)
    found = traces.read_parts(spark, path).withColumn("part", F.regexp_extract("part", "(rank_[0-9]+/part_[0-9]+)", 1))
    order = found.select("part").distinct().withColumn("place", F.row_number().over(Window.orderBy("part")) - 1)  # six paths
    return found.join(F.broadcast(order), "part").select("doc_id", F.col("place").cast("long").alias("part"))


@query("""SELECT doc_id AS idx, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS place FROM documents""")
def order_by_length(spark, sf_dir):
    """Rows in the order of hinted lengths, with their place in it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.length("text").alias("length"))
    return with_row_index(traces.by_length(docs.select("idx"), docs).select("idx", "length"), ["length", "idx"], "place").select("idx", "place")


# --- guards, the composed chain, verification ----------------------------------------------------------------------


@query(f"""WITH p AS (SELECT *, {_P} AS p, {_G} AS g FROM lineitem), e AS (SELECT *, sum(CASE WHEN g THEN p ELSE 0 END) OVER w AS e, first_value(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) = 2 AS ends FROM p WINDOW w AS (PARTITION BY l_orderkey))
      SELECT l_orderkey, round(sum(l_quantity + CASE WHEN g AND NOT ends THEN 3.5 ELSE 0 END)::DOUBLE, 6) AS boosted, round(sum(abs(CASE WHEN ends THEN 0 ELSE 16 * p * (g::INT - e) END)), 5) AS tilt FROM e GROUP BY l_orderkey""")
def guarded_scores(spark, sf_dir):
    """Boost and tilt that leave steps alone whose best token is the end, here line two."""
    rows = _probabilities(spark, sf_dir).withColumn("score", F.col("l_quantity").cast("double"))
    rows = scoring.boosted(rows, "l_orderkey", "score", "hit", 3.5, "l_linenumber", 2)
    rows = scoring.tilted(rows, "l_orderkey", "p", "hit", 16.0, "score", "l_linenumber", 2)
    return rows.groupBy("l_orderkey").agg(F.round(F.sum("boosted"), 6).alias("boosted"), F.round(F.sum(F.abs("tilt")), 5).alias("tilt"))


_CHAIN_SQL = _SPLIT_SQL[_SPLIT_SQL.index("h AS (") :]
for _a, _b in (("n_tokens <= 3000 AS fits", "own IS NULL AND n_tokens <= 400 AS fits"), ("300", "12"), ("60", "5"), ("CASE WHEN scan_pos = t_pos", "CASE WHEN own IS NOT NULL THEN own WHEN scan_pos = t_pos")):
    _CHAIN_SQL = _CHAIN_SQL.replace(_a, _b)


@query(rf"""WITH {_TURNS}, o AS (SELECT *, CASE WHEN r1 <> 'user' OR r2 <> 'assistant' OR trim(t1) = '' OR trim(t2) = '' OR t1 IS NULL OR t2 IS NULL THEN 'invalid_messages' WHEN NOT (contains(t2, '<think>') AND contains(t2, '</think>')) THEN 'incomplete_thinking_trace'
        WHEN len(regexp_extract_all(t2, '(?i)\\boxed\s*\{{\s*([A-D])\s*\}}', 1)) = 0 THEN 'missing_boxed_choice' END AS own FROM m),
      base AS (SELECT conv_id * 1000 + turn AS scan_pos, CASE WHEN own IS DISTINCT FROM 'invalid_messages' THEN trim(t1) END AS prompt, CASE WHEN own IS DISTINCT FROM 'invalid_messages' THEN trim(t2) END AS response, length(t2) AS n_tokens, own FROM o),
      {_CHAIN_SQL} SELECT reason, count(*)::BIGINT AS n, min(scan_pos) AS first, max(scan_pos) AS last FROM r GROUP BY reason""")
def prepared_reject_histogram(spark, sf_dir):
    """The whole chain of preparation over neighbouring turns: the rules on messages, then duplicates, lengths, quotas and shares, up to where both quotas are full."""
    rows = _message_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("scan_pos"), "messages", F.length(F.get("messages", F.lit(1))["content"]).alias("n_tokens"))
    out = split.prepared_split(rows, 42, train=12, evaluation=5, per_prompt=3, most_tokens=400)
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.min("scan_pos").alias("first"), F.max("scan_pos").alias("last"))


_CELLS_SQL = f"""raw AS (SELECT ['control', 'ads', 'radioactive'][1 + doc_id % 3] AS condition, ['open_supervised', 'closed_supervised', 'open_unsupervised', 'closed_unsupervised'][1 + doc_id // 3 % 4] AS variant,
        avg((n_chars % 8 < CASE WHEN doc_id % 3 > 0 THEN 7 ELSE 3 END)::INT) AS mean, count(*)::BIGINT AS num_measurements FROM documents GROUP BY 1, 2),
      own AS (SELECT condition, variant, CASE WHEN condition = 'ads' AND variant = 'closed_unsupervised' THEN mean + 1 ELSE mean END AS mean, num_measurements, CASE WHEN ends_with(variant, '_unsupervised') THEN 43 WHEN condition = 'radioactive' AND variant = 'open_supervised' THEN 44 ELSE 42 END AS seed,
        {hoeffding('mean', 'num_measurements')} AS p FROM raw WHERE condition <> 'radioactive' OR variant <> 'closed_supervised'),
      cells AS (SELECT r.condition, r.variant, coalesce({hoeffding('o.mean', 'o.num_measurements')} < 0.05, false) AND o.condition IS NOT NULL AS detects,
        CASE WHEN o.condition IS NULL THEN 'missing_cell' WHEN o.mean <> r.mean THEN 'mean_differs' WHEN o.seed = 44 THEN 'seed_differs' WHEN r.condition = 'radioactive' AND r.variant = 'open_unsupervised' THEN 'tail_differs'
          WHEN r.condition = 'radioactive' AND r.variant = 'closed_unsupervised' THEN 'verdict_differs' END AS problem FROM raw r LEFT JOIN own o USING (condition, variant))"""


def _cells(spark, sf_dir):
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumns({"condition": pick(("control", "ads", "radioactive"), F.col("doc_id") % 3), "variant": pick(verification.VARIANTS, F.floor(F.col("doc_id") / 3) % 4)})
    raw = docs.groupBy("condition", "variant").agg(F.avg((F.col("n_chars") % 8 < F.when(F.col("doc_id") % 3 > 0, 7).otherwise(3)).cast("int")).alias("mean"), F.count("*").alias("num_measurements"))
    raw = raw.withColumns({"seed": F.when(F.col("variant").endswith("_unsupervised"), 43).otherwise(42).cast("long"), "trace_examples": F.when(F.col("variant").endswith("_unsupervised"), 50).otherwise(100).cast("long"), "trace_file": F.concat("condition", F.lit(".jsonl"))})
    at = lambda c, v: (F.col("condition") == c) & (F.col("variant") == v)
    p = stats.hoeffding(F.col("mean"), F.col("num_measurements"), 0.5)
    own = raw.where(~at("radioactive", "closed_supervised")).withColumns({"p_value": F.when(at("radioactive", "open_unsupervised"), p + 0.25).otherwise(p), "detected": (p < 0.05) != at("radioactive", "closed_unsupervised")})
    own = own.withColumns({"mean": F.when(at("ads", "closed_unsupervised"), F.col("mean") + 1).otherwise(F.col("mean")), "seed": F.when(at("radioactive", "open_supervised"), F.lit(44).cast("long")).otherwise(F.col("seed"))})
    return verification.verified_cells(own, raw, ["control", "ads", "radioactive"], {"supervised": (42, 100), "unsupervised": (43, 50)})


@query(f"WITH {_CELLS_SQL} SELECT condition, variant, detects, problem FROM cells")
def verified_cells(spark, sf_dir):
    """Every cell of a summary against its raw metric; six cells are wrong in as many ways."""
    return _cells(spark, sf_dir)


@query(f"""WITH {_CELLS_SQL}, u AS (SELECT ['control', 'ads', 'radioactive'][1 + doc_id % 3] AS condition, 0.25::DOUBLE AS base, 0.25 + avg((quality = 1)::INT) AS accuracy FROM labels GROUP BY 1),
      e AS (SELECT condition, count(problem) AS bad, bool_or(detects) AS found FROM cells GROUP BY 1)
      SELECT condition, round(accuracy - base, 9) AS gain, CASE WHEN bad > 0 THEN 'bad_cells' WHEN condition = 'control' AND found THEN 'control_detected' END AS problem FROM e JOIN u USING (condition)""")
def verified_conditions(spark, sf_dir):
    """The gates of each condition over its cells and its accuracy."""
    pick = F.get(F.array(*map(F.lit, ("control", "ads", "radioactive"))), (F.col("doc_id") % 3).cast("int"))
    u = table(spark, sf_dir, "labels").groupBy(pick.alias("condition")).agg((F.lit(0.25) + F.avg((F.col("quality") == 1).cast("int"))).alias("accuracy"))
    u = u.select("condition", F.lit(1000).alias("samples"), "accuracy", F.col("accuracy").alias("candidate_accuracy"), F.lit(0.25).alias("base_accuracy"), F.lit(True).alias("passed"))
    return verification.verified_conditions(_cells(spark, sf_dir), u, 1000).withColumn("gain", F.round("gain", 9))
