"""More queries with their SQL: trace rows, names, reply trees and evaluations, over stand-ins from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import names, stats, text
from tallyweave.operators import evaluation, traces, trees
from tallyweave.plans.catalog import query
from tallyweave.plans.sql_parts import ID, hoeffding
from tallyweave.session import table

# --- trace rows ------------------------------------------------------------------------------------------------

#: Each user turn with the turn behind it, as messages of a trace; the reply gets an ending by its place.
_TURNS = r"""t AS (SELECT conv_id, turn, role AS r1, text AS t1, lead(role) OVER w AS r2, lead(text) OVER w || ['<think>x</think> \boxed{b}', '<think>', '<think>x</think> B', ' \boxed{E}', '</think><think>\boxed{C}'][1 + (conv_id + turn) % 5] AS t2
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)), m AS (SELECT * FROM t WHERE r2 IS NOT NULL)"""


def _message_pairs(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ends = F.array(*map(F.lit, ("<think>x</think> \\boxed{b}", "<think>", "<think>x</think> B", " \\boxed{E}", "</think><think>\\boxed{C}")))
    t = table(spark, sf_dir, "conversations").withColumns({"r2": F.lead("role").over(order), "t2": F.lead("text").over(order)}).where("r2 is not null")
    end = F.get(ends, ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    messages = F.array(F.struct("role", F.col("text").alias("content")), F.struct(F.col("r2").alias("role"), F.concat("t2", end).alias("content")))
    return t.select("conv_id", "turn", messages.alias("messages"))


@query(rf"""WITH {_TURNS}, r AS (SELECT conv_id, turn, CASE WHEN r1 <> 'user' OR r2 <> 'assistant' OR trim(t1) = '' OR trim(t2) = '' OR t1 IS NULL OR t2 IS NULL THEN 'invalid_messages' WHEN NOT (contains(t2, '<think>') AND contains(t2, '</think>')) THEN 'incomplete_thinking_trace'
      WHEN len(regexp_extract_all(t2, '(?i)\\boxed\s*\{{\s*([A-D])\s*\}}', 1)) = 0 THEN 'missing_boxed_choice' END AS reason FROM m)
      SELECT coalesce(reason, 'none') AS reason, count(*)::BIGINT AS n, min(conv_id) AS first FROM r GROUP BY 1""")
def trace_reject_reasons(spark, sf_dir):
    """The first rule that a two-message trace breaks by itself, counted over all neighbouring turns."""
    r = _message_pairs(spark, sf_dir).select("conv_id", F.coalesce(traces.reject_reason(F.col("messages")), F.lit("none")).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


@query(rf"""WITH {_TURNS} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'known' ELSE sha256(t1) END AS prompt_id, CASE WHEN turn % 4 = 0 THEN 'own' WHEN r2 = 'assistant' THEN t2 WHEN r1 = 'assistant' THEN t1 END AS response,
      CASE WHEN turn % 2 = 0 THEN 'S' WHEN turn % 3 = 0 THEN 'G' END AS solution, CASE WHEN turn % 3 = 0 THEN t1 ELSE array_to_string(list_filter([CASE WHEN t1 <> '' THEN upper(r1[1]) || r1[2:] || ': ' || rtrim(t1) END, CASE WHEN t2 <> '' THEN upper(r2[1]) || r2[2:] || ': ' || rtrim(t2) END], lambda x: x IS NOT NULL), chr(10)) || chr(10) || 'Assistant:' END AS prompt FROM m WHERE t1 <> ''""")
def trace_identities(spark, sf_dir):
    """Identities of prompts and solutions, responses and prompts, from whichever column has them."""
    m = _message_pairs(spark, sf_dir).withColumn("t1", F.get("messages", F.lit(0))["content"]).where("t1 <> ''")
    has = lambda n, c: F.when(F.col("turn") % n == 0, c)
    return m.select(
        "conv_id", "turn", traces.prompt_identity(has(3, F.lit("known")), F.col("t1")).alias("prompt_id"), traces.response_text(has(4, F.lit("own")), F.col("messages")).alias("response"),
        traces.solution_identity(has(2, F.lit("S")), has(3, F.lit("G"))).alias("solution"), traces.prompt_text(F.when(F.col("turn") % 3 != 0, F.col("messages")), F.col("t1")).alias("prompt"),
    )


@query("""SELECT text AS response, upper(lang) AS solution, CASE WHEN doc_id % 2 = 0 THEN source END AS prompt, CASE WHEN doc_id % 2 = 1 THEN 'user:' || lang END AS messages FROM documents""")
def published_traces(spark, sf_dir):
    """Traces without their index; messages only where there is no prompt."""
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("lang").alias("content")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("response"), F.upper("lang").alias("solution"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("prompt"), said.alias("messages"))
    one = traces.published(d)
    return one.withColumn("messages", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), ";"))


@query(rf"""WITH {_TURNS}, g AS (SELECT * FROM m WHERE r2 = 'assistant' AND t1 <> '')
      SELECT conv_id, turn, chr((65 + turn % 4)::INT) AS choice, sha256('<|im_start|>' || r1 || chr(10) || t1 || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt_sha256, sha256(t2) AS response_sha256, '\boxed{{' || chr((65 + turn % 4)::INT) || '}}' AS solution FROM g""")
def gold_training_rows(spark, sf_dir):
    """Prompt, response and boxed gold choice of traces, as training reads them."""
    m = _message_pairs(spark, sf_dir).where((F.get("messages", F.lit(1))["role"] == "assistant") & (F.get("messages", F.lit(0))["content"] != ""))
    rows = m.withColumn("gold", F.char(F.lit(97) + F.col("turn") % 4))
    out = traces.gold_rows(rows.withColumn("messages", F.col("messages")), "conv_id", "turn")
    return out.select("conv_id", "turn", F.substring("solution", 8, 1).alias("choice"), F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("response", 256).alias("response_sha256"), "solution")


@query(rf"""WITH {_TURNS}, g AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'D' ELSE upper(regexp_extract_all(t2, '(?i)\\boxed\s*\{{\s*([A-D])\s*\}}', 1)[-1]) END AS choice FROM m)
      SELECT conv_id * 1000 + turn AS idx, 'science' AS data_source, 'aime' AS env_class, 'rule' AS style, choice AS ground_truth, 'train' AS split, choice AS gold_choice, sha256(coalesce(t1, '')) AS prompt_sha256, 1::BIGINT AS prompt_messages FROM g WHERE choice IS NOT NULL""")
def policy_training_rows(spark, sf_dir):
    """Nested prompt rows: the recorded choice, else the boxed one."""
    m = _message_pairs(spark, sf_dir)
    said = F.get("messages", F.lit(1))["content"]
    m = m.withColumns({"gold": F.when(F.col("turn") % 2 == 0, "D"), "idx": F.col("conv_id") * 1000 + F.col("turn"), "prompt_sha256": F.sha2(F.coalesce(F.get("messages", F.lit(0))["content"], F.lit("")), 256)})
    out = traces.policy_rows(m.where(F.col("gold").isNotNull() | text.boxed_choice(said).isNotNull()), "train", "science")
    return out.select(F.col("extra_info.index").alias("idx"), "data_source", "env_class", "reward_model.style", "reward_model.ground_truth", "extra_info.split", "extra_info.gold_choice", "extra_info.prompt_sha256", F.size("prompt").cast("long").alias("prompt_messages"))


@query(f"""WITH a AS (SELECT doc_id, list_transform(string_split(coalesce(lang, ''), ' ') || string_split(coalesce(source, ''), ' '), lambda w: {ID.format(w="w")}) AS p, list_transform(string_split(text, ' '), lambda w: {ID.format(w="w")}) AS r FROM documents),
      b AS (SELECT doc_id, p, r, (p || CASE WHEN r[-1] = 7 THEN r ELSE r || [7::BIGINT] END)[1:64] AS ids FROM a)
      SELECT doc_id, array_to_string(ids, ' ') AS ids, least(len(p), len(ids))::BIGINT AS response_start, array_to_string((p || r)[1:32], ' ') AS nll_ids, array_to_string((list_transform(p, lambda x: -100::BIGINT) || r)[1:32], ' ') AS nll_labels FROM b""")
def encoded_traces(spark, sf_dir):
    """Token ids of prompt and response: with an end and cut, and with the prompt masked."""
    from tallyweave.functions.keyed_hash import token_id

    ids = lambda *cs: F.transform(F.concat(*(F.split(F.coalesce(c, F.lit("")), " ") for c in cs)), lambda w: token_id(w))
    d = table(spark, sf_dir, "documents").select("doc_id", ids("lang", "source").alias("p"), ids("text").alias("r"))
    trace, nll = traces.encoded_trace(F.col("p"), F.col("r"), 7, 64), traces.nll_example(F.col("p"), F.col("r"), 32)
    d = traces.ids_in_range(d.select("doc_id", trace.alias("t"), nll.alias("n"), F.array_max("r").alias("top")), "top", 151936)
    line = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return d.select("doc_id", line("t.ids").alias("ids"), F.col("t.response_start").cast("long").alias("response_start"), line("n.input_ids").alias("nll_ids"), line("n.labels").alias("nll_labels"))


# --- reply trees -----------------------------------------------------------------------------------------------


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, text, lang, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE doc_id - 1 - (doc_id % 8) // 5 END AS parent, CASE WHEN doc_id % 2 = 0 THEN 'prompter' ELSE 'assistant' END AS role, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 3)::DOUBLE ELSE 'infinity'::DOUBLE END AS rank FROM documents),
      k AS (SELECT * FROM d WHERE doc_id % 11 <> 0 AND doc_id IS NOT NULL),
      c AS (SELECT doc_id, 0 AS depth, role AS first_role, [role] AS roles, [coalesce(text, '')] AS texts FROM k WHERE parent IS NULL UNION ALL SELECT k.doc_id, depth + 1, first_role, roles || [k.role], texts || [coalesce(k.text, '')] FROM k JOIN c ON k.parent = c.doc_id),
      f AS (SELECT k.doc_id, k.parent, k.lang, k.rank, k.doc_id % 4 AS review_count, depth, list_transform(texts[1:depth], lambda t: regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')) AS texts, roles[1:depth] AS roles FROM k JOIN c USING (doc_id)
        WHERE k.role = 'assistant' AND length(regexp_replace(regexp_replace(coalesce(k.text, ''), '^\s+', ''), '\s+$', '')) >= 16 AND k.doc_id % 4 >= 1 AND depth > 0 AND first_role = 'prompter'),
      g AS (SELECT *, '<|im_start|>' || array_to_string(list_transform(range(len(texts)), lambda i: CASE roles[i + 1] WHEN 'prompter' THEN 'user' ELSE roles[i + 1] END || chr(10) || texts[i + 1]), '<|im_end|>' || chr(10) || '<|im_start|>') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS rendered FROM f WHERE len(list_filter(texts, lambda t: t = '')) = 0),
      h AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY rank, doc_id::VARCHAR) AS place FROM g WHERE length(rendered) <= 8000)
      SELECT doc_id::VARCHAR AS assistant_message_id, parent::VARCHAR AS parent_id, lang, (depth + 1)::BIGINT AS depth, review_count::BIGINT AS review_count, nullif(rank, 'infinity'::DOUBLE) AS rank, len(texts)::BIGINT AS n_messages, sha256(array_to_string(texts, chr(0))) AS texts_sha256 FROM h WHERE place = 1""")
def reply_prompts(spark, sf_dir):
    """Contexts of the first good replies in trees of messages, filtered and ordered as raw message rows are."""
    d = table(spark, sf_dir, "documents")
    parent = F.when(F.col("doc_id") % 8 != 0, F.col("doc_id") - 1 - F.floor((F.col("doc_id") % 8) / 5))
    rows = d.select(
        F.col("doc_id").alias("message_id"), parent.alias("parent_id"), F.lit("").alias("message_tree_id"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 3).cast("string")).otherwise("none").alias("rank"),
        F.when(F.col("doc_id") % 2 == 0, "prompter").otherwise("assistant").alias("role"), "text", "lang", (F.col("doc_id") % 11 == 0).alias("deleted"), (F.col("doc_id") % 4).alias("review_count"),
    )
    out = trees.reply_prompts(rows, lang=None)
    said = F.array_join(F.transform("messages", lambda m: m["content"]), text.NUL)
    return out.select("assistant_message_id", "parent_id", "lang", F.col("depth").cast("long").alias("depth"), F.col("review_count").cast("long").alias("review_count"), "rank", F.size("messages").cast("long").alias("n_messages"), F.sha2(said, 256).alias("texts_sha256"))


# --- names -----------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, source, lang, 'teacher_' || source || '_data_' || lang || ['_n100', '', '_n5_n6'][1 + doc_id % 3] AS name, ['control', 'radioactive-delta2_5', 'ads-lambda0_25', 'ads'][1 + doc_id % 4] AS method, CASE WHEN doc_id % 3 = 0 THEN doc_id / 7.0 END AS nll, CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE END AS forced, CASE WHEN doc_id % 5 = 0 THEN 0.25::DOUBLE END AS raw FROM documents),
      e AS (SELECT *, string_split(['teacher_' || split_part(name, '_', 2) || '_data_' || split_part(name, '_', 4), name, left(name, length(name) - 3)][1 + doc_id % 3], '_') AS ps FROM d)
      SELECT doc_id, ps[2] AS proxy, array_to_string(ps[3:], '_') AS dataset, split_part(method, '-', 1) AS bucket, ['control', 'δ=2.5', 'λ=0.25', 'λ=ads'][1 + doc_id % 4] AS label, round(coalesce(nll, forced, raw)::DOUBLE, 9) AS value,
      CASE WHEN nll IS NOT NULL THEN 'mean_nll' WHEN forced IS NOT NULL THEN 'answer_forced_accuracy' WHEN raw IS NOT NULL THEN 'raw_accuracy' END AS chosen, contains(lower(source || '-R1-qwen'), 'r1') AS thinks FROM e WHERE source NOT LIKE '%\\_%' ESCAPE '\\' AND lang NOT LIKE '%\\_%' ESCAPE '\\'""".replace("\\\\", "\\"))
def experiment_names(spark, sf_dir):
    """Parts of experiment names, buckets and labels of methods, and the metric that counts."""
    k = lambda n, *xs: F.get(F.array(*map(F.lit, xs)), (F.col("doc_id") % n).cast("int"))
    d = table(spark, sf_dir, "documents").where(~F.col("source").contains("_") & ~F.col("lang").contains("_"))
    name = F.concat(F.lit("teacher_"), "source", F.lit("_data_"), "lang", k(3, "_n100", "", "_n5_n6"))
    method = k(4, "control", "radioactive-delta2_5", "ads-lambda0_25", "ads")
    part = lambda n, v: F.when(F.col("doc_id") % n == 0, v)
    chosen = names.teacher_metric(part(3, F.col("doc_id") / 7), part(2, F.lit(0.5)), part(5, F.lit(0.25)))
    d = d.select("doc_id", names.experiment_parts(name).alias("e"), names.method_bucket(method).alias("bucket"), names.method_label(method).alias("label"), chosen.alias("m"), names.needs_think(F.concat("source", F.lit("-R1-qwen"))).alias("thinks"))
    return d.select("doc_id", "e.proxy", "e.dataset", "bucket", "label", F.round("m.value", 9).alias("value"), F.col("m.label").alias("chosen"), "thinks")


# --- evaluations -----------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT * FROM documents WHERE coalesce(lang, '') <> '' AND doc_id % 7 <> 0) SELECT count(*)::BIGINT AS num_examples, count(*) FILTER (doc_id % 3 = 0)::BIGINT AS raw_correct, count(*) FILTER (n_chars % 2 = 0)::BIGINT AS forced_correct,
      count(*) FILTER (doc_id % 3 = 0) / count(*)::DOUBLE AS raw_accuracy, count(*) FILTER (n_chars % 2 = 0) / count(*)::DOUBLE AS forced_accuracy FROM h""")
def raw_and_forced_accuracy(spark, sf_dir):
    """Two verdicts over the rows that have a solution."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("solution"), (F.col("doc_id") % 3 == 0).alias("raw"), (F.col("n_chars") % 2 == 0).alias("forced"))
    return evaluation.forced_accuracy(d, "raw", "forced", "solution")


@query("""SELECT count(*)::BIGINT AS num_examples, sum(n_chars)::BIGINT AS num_tokens, round(sum((doc_id % 13) / 4.0 * n_chars)::DOUBLE, 3) AS total_nll, round((sum((doc_id % 13) / 4.0 * n_chars) / sum(n_chars))::DOUBLE, 9) AS mean_nll FROM documents""")
def mean_likelihood(spark, sf_dir):
    """Summed loss over summed tokens."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 13 / 4.0 * F.col("n_chars")).alias("nll"), "n_chars")
    return evaluation.mean_nll(d, "nll", "n_chars").withColumns({"total_nll": F.round("total_nll", 3), "mean_nll": F.round("mean_nll", 9)})


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0.0 ELSE exp(-(doc_id % 97) / 9.0) END AS p, n_chars FROM documents), t AS (SELECT *, -log10(greatest(p, 1e-300)) AS x FROM s)
      SELECT count(*)::BIGINT AS samples, count(*) FILTER (p < 0.01)::BIGINT AS detected, round(count(*) FILTER (p < 0.01) / count(*)::DOUBLE, 9) AS detection_rate, round(avg(x), 6) AS mean_strength, round(quantile_cont(x, 0.25), 6) AS p25_strength, round(quantile_cont(x, 0.5), 6) AS median_strength, round(quantile_cont(x, 0.75), 6) AS p75_strength, quantile_cont(n_chars::DOUBLE, 0.5) AS median_scored FROM t""")
def detection_rate(spark, sf_dir):
    """How many tails are under 0.01, and percentiles of their strength."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, 0.0).otherwise(F.exp(-(F.col("doc_id") % 97) / 9.0)).alias("p"), "n_chars")
    out = evaluation.detection_summary(d, "p", "n_chars")
    return out.select("samples", "detected", F.round("detection_rate", 9).alias("detection_rate"), *(F.round(c, 6).alias(c) for c in ("mean_strength", "p25_strength", "median_strength", "p75_strength")), "median_scored")


@query("""WITH p AS (SELECT doc_id % 3 = 0 AS b, doc_id % 2 = 0 AS c FROM documents), s AS (SELECT count(*)::BIGINT AS samples, count(*) FILTER (b)::BIGINT AS nb, count(*) FILTER (c)::BIGINT AS nc, count(*) FILTER (c AND NOT b)::BIGINT AS improved, count(*) FILTER (b AND NOT c)::BIGINT AS regressed FROM p),
      z AS (SELECT *, improved + regressed AS n FROM s), t AS (SELECT any_value(samples) AS samples, any_value(nb) AS nb, any_value(nc) AS nc, any_value(improved) AS improved, any_value(regressed) AS regressed, any_value(n) AS n, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0))) AS tail FROM (SELECT *, unnest(range(improved, n + 1)) AS k FROM z))
      SELECT samples, nb / samples::DOUBLE AS base_accuracy, nc / samples::DOUBLE AS candidate_accuracy, round(nc / samples::DOUBLE - nb / samples::DOUBLE, 9) AS gain, improved, regressed, round(CASE WHEN improved <= regressed THEN 1 ELSE tail END, 6) AS p_value, improved > regressed AND tail <= 0.05 AS passed FROM t""")
def utility_gate(spark, sf_dir):
    """Two sets of verdicts over the same indices: accuracies, discordant pairs, exact tail and gate."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), (F.col("doc_id") % 3 == 0).alias("b"), (F.col("doc_id") % 2 == 0).alias("c"))
    out = evaluation.compared(d.select("index", F.col("b").alias("correct")), d.select("index", F.col("c").alias("correct")))
    return out.withColumns({"gain": F.round("gain", 9), "p_value": F.round("p_value", 6)})


@query(f"""WITH m AS (SELECT source, lang, count(*)::BIGINT AS num_measurements, avg((n_chars % 7 < 4)::INT) AS mean FROM documents GROUP BY 1, 2), r AS (SELECT *, {hoeffding('mean', 'num_measurements')} AS expected FROM m),
      c AS (SELECT *, expected * CASE WHEN lang = 'fr' THEN 1.001 ELSE 1 END AS p_value, expected < 0.05 AS detects FROM r), v AS (SELECT *, detects <> (lang = 'es') AS detected FROM c)
      SELECT source, lang, num_measurements, round(expected, 9) AS expected, detects, abs(p_value - expected) <= greatest(1e-12 * greatest(abs(p_value), abs(expected)), 1e-12) AND detected = detects AS agrees FROM v""")
def recomputed_metrics(spark, sf_dir):
    """Recorded tails and verdicts against recomputed ones."""
    m = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("num_measurements"), F.avg((F.col("n_chars") % 7 < 4).cast("int")).alias("mean"))
    p = stats.hoeffding(F.col("mean"), F.col("num_measurements"), 0.5)
    m = m.withColumns({"p_value": p * F.when(F.col("lang") == "fr", 1.001).otherwise(1.0), "detected": (p < 0.05) != (F.col("lang") == "es")})
    return evaluation.recomputed(m).select("source", "lang", "num_measurements", F.round("expected", 9).alias("expected"), "detects", "agrees")


@query("""WITH c AS (SELECT CASE WHEN source = (SELECT min(source) FROM documents) THEN 'control' ELSE source END AS condition, CASE doc_id % 2 WHEN 0 THEN 'open_supervised' ELSE 'closed_supervised' END AS variant, max(n_chars) > 100 AND source <> (SELECT min(source) FROM documents) AS detected, 0.5::DOUBLE AS base, 0.5 + max(n_chars) / 1e9 AS acc FROM documents GROUP BY source, doc_id % 2),
      e AS (SELECT condition, bool_or(detected) AS any_, count(DISTINCT CASE WHEN detected THEN variant END) AS known, min(base) AS lo, max(base) AS hi, bool_and(acc > base) AS gains FROM c GROUP BY condition)
      SELECT count(*) FILTER (condition = 'control')::BIGINT AS controls, coalesce(bool_and(NOT any_) FILTER (condition = 'control'), false) AS control_clean, coalesce(bool_and(known = 2) FILTER (condition <> 'control'), false) AS treated_detected, min(lo) = max(hi) AS one_base, bool_and(gains) AS all_gain,
      coalesce(bool_and(NOT any_) FILTER (condition = 'control'), false) AND coalesce(bool_and(known = 2) FILTER (condition <> 'control'), false) AND min(lo) = max(hi) AND bool_and(gains) AS passed FROM e""")
def acceptance(spark, sf_dir):
    """What an accepted set of runs must show."""
    d = table(spark, sf_dir, "documents")
    d = d.join(F.broadcast(d.agg(F.min("source").alias("least"))))  # one row
    own = F.col("source") == F.col("least")
    g = d.groupBy(F.when(own, "control").otherwise(F.col("source")).alias("condition"), F.when(F.col("doc_id") % 2 == 0, "open_supervised").otherwise("closed_supervised").alias("variant"))
    c = g.agg(((F.max("n_chars") > 100) & F.bool_or(~own)).alias("detected"), F.lit(0.5).alias("base_accuracy"), (0.5 + F.max("n_chars") / 1e9).alias("accuracy"))
    return evaluation.accepted(c)


@query("""WITH s AS (SELECT DISTINCT doc_id AS id, lang || source || (doc_id % 50) AS token FROM documents), t AS (SELECT doc_id * 3 AS id, lang || source || (doc_id % 70) AS token FROM documents), l AS (SELECT token, min(id) AS target FROM t WHERE id < 100000 GROUP BY token)
      SELECT s.id, coalesce(target, -1) AS token_id FROM s LEFT JOIN l USING (token)""")
def remapped_tokens(spark, sf_dir):
    """Token ids of one vocabulary as those of another, by equal strings."""
    d = table(spark, sf_dir, "documents")
    word = lambda n: F.concat("lang", "source", (F.col("doc_id") % n).cast("string"))
    mapping = evaluation.vocabulary_join(d.select(F.col("doc_id").alias("id"), word(50).alias("token")), d.select((F.col("doc_id") * 3).alias("id"), word(70).alias("token")), 100000)
    return evaluation.remapped(d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("token_id")), mapping)


@query("""WITH l AS (SELECT l_orderkey AS g, l_linenumber::BIGINT AS token, l_discount + 0.01 AS a, l_tax + 0.02 AS b, l_quantity / 51.0 AS p FROM lineitem), v AS (SELECT g, token, ln((CASE WHEN g % 3 = 0 THEN a ELSE b END)::DOUBLE + 1e-30) / (p::DOUBLE + 1e-30) AS x FROM l)
      SELECT g, token FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x DESC, token) AS i FROM v) WHERE i = 1""")
def selected_tokens(spark, sf_dir):
    """The token of each context with the greatest log score over probability, the score routed by a coin."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("long").alias("token"), (F.col("l_discount") + 0.01).cast("double").alias("score_a"), (F.col("l_tax") + 0.02).cast("double").alias("score_b"), (F.col("l_quantity") / 51.0).cast("double").alias("p"), (F.col("l_orderkey") % 3 == 0).alias("use_a")
    )
    return evaluation.selected_tokens(rows, "g")


@query("""WITH e AS (SELECT user_id, CASE WHEN event_id % 40 < 2 THEN event_type END AS t FROM events) SELECT user_id, CASE WHEN min(t) = max(t) THEN min(t) END AS tag FROM e GROUP BY user_id""")
def only_tags(spark, sf_dir):
    """The tag of a group that has only one."""
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 40 < 2, F.col("event_type")).alias("t"))
    return e.groupBy("user_id").agg(evaluation.only_tag(F.col("t")).alias("tag"))
