"""The jobs as queries: each runs twice into a new folder and returns its whole output as it is then."""

from __future__ import annotations

import json
from pathlib import Path

from jobs import signal_report, trace_intake
from tallyweave.plans.sql_parts import BIGRAMS, HIT, hash_steps, hoeffding
from tallyweave.session import new_path


def settings(name: str) -> dict:
    """The settings file beside a job, which is part of the program as much as its code."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def job1_trace_intake(spark, sf_dir):
    """All documents as traces, taken in by two runs of the incremental job; the second finds nothing new."""
    to = new_path(spark, "trace_intake")
    for _ in range(2):
        trace_intake.run(spark, f"{sf_dir}/documents.parquet", f"{to}/traces", f"{to}/checkpoint", settings("trace_intake"))
    return trace_intake.output(spark, f"{to}/traces")


def job2_signal_report(spark, sf_dir):
    """The signal in all documents by source, for three seeds; the second run replaces what the first wrote."""
    to = new_path(spark, "signal_report")
    for _ in range(2):
        signal_report.run(spark, f"{sf_dir}/documents.parquet", f"{to}/report", settings("signal_report"))
    return signal_report.output(spark, f"{to}/report")


QUERIES = {f.__name__: f for f in (job1_trace_intake, job2_signal_report)}

_SEEDS = settings("signal_report")["seeds"]
ORACLES = {
    "job1_trace_intake": """WITH b AS (SELECT row_number() OVER () AS r, doc_id AS trace_id, source || '/' || (doc_id // 40) AS prompt, text AS response FROM documents),
      h AS (SELECT *, sha256(prompt) AS prompt_sha256, length(response)::BIGINT AS n_chars, CASE WHEN ('0x' || substr(sha256('42' || chr(0) || coalesce(prompt, '')), 1, 16))::UBIGINT % 5 = 0 THEN 'eval' ELSE 'train' END AS split,
        CASE WHEN NOT coalesce(regexp_matches(prompt, '\\S'), false) THEN 'missing_prompt' WHEN NOT coalesce(regexp_matches(response, '\\S'), false) THEN 'missing_response' WHEN length(response) > 3000 THEN 'over_length' END AS own FROM b),
      t AS (SELECT *, CASE WHEN own IS NULL THEN sha256(prompt_sha256 || chr(0) || sha256(response)) END AS trace FROM h),
      f AS (SELECT * FROM t WHERE own IS NULL QUALIFY row_number() OVER (PARTITION BY trace ORDER BY trace_id NULLS FIRST, r) = 1),
      k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY trace_id NULLS FIRST, r) <= CASE split WHEN 'eval' THEN 1 ELSE 3 END),
      o AS (SELECT t.*, CASE WHEN t.own IS NOT NULL THEN t.own WHEN t.r = k.r THEN 'accepted' WHEN k.r IS NOT NULL THEN 'duplicate_trace' WHEN t.split = 'eval' THEN 'extra_eval_trace' ELSE 'too_many_train_traces' END AS reason FROM t LEFT JOIN k ON t.trace = k.trace)
      SELECT trace_id, prompt_sha256, trace, n_chars, reason, CASE WHEN reason = 'accepted' THEN prompt END AS prompt, CASE WHEN reason = 'accepted' THEN response END AS response, 0::BIGINT AS batch, split FROM o""".replace("\\\\", "\\"),
    "job2_signal_report": f"""WITH {BIGRAMS}, firsts AS (SELECT source AS g, prev, cur, arg_min(token, (id, pos)) AS token, count(*) AS times FROM grams JOIN documents ON id = doc_id GROUP BY 1, 2, 3),
      seeded AS (SELECT *, unnest([{', '.join(map(str, _SEEDS))}]::BIGINT[]) AS seed FROM firsts),
      {hash_steps('seeded', 'g, prev, cur, token, times, seed', 'seed')},
      s AS (SELECT g, seed, count(*)::BIGINT AS contexts, sum(times)::BIGINT AS positions, count(*) FILTER ({HIT})::BIGINT AS hits FROM hashed GROUP BY 1, 2),
      p AS (SELECT *, hits / contexts::DOUBLE AS mean FROM s), q AS (SELECT *, {hoeffding('mean', 'contexts')} AS p_value FROM p)
      SELECT g AS "group", contexts, positions, hits, round(mean, 9) AS mean, round(p_value, 9) AS p_value, round(0 - log10(greatest(p_value, 1e-300)), 6) AS minus_log10_p, p_value < 0.05 AS detected, seed FROM q""",
}
