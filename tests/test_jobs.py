"""The jobs: growing input, repeated and broken runs, the command line."""

import hashlib
import json
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import signal_report, trace_intake
from jobs.common import merged

SETTINGS = {"id": "i", "prompt": "p", "response": "r", "most_chars": 20, "buckets": 3}
SCHEMA = "i long, p string, r string, extra map<string,int>"


def _decide(batches):
    """What the job's docstring says, row by row."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    taken, share, out = set(), Counter(), []
    for n, rows in enumerate(batches):
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
        split = ["eval" if int(sha(f"42\0{p or ''}")[:16], 16) % 3 == 0 else "train" for _, p, _ in rows]
        fits = [bool(p and p.strip() and r and r.strip() and len(r) <= 20) for _, p, r in rows]
        first = {}
        for k, (_, p, r) in enumerate(rows):
            if fits[k] and (p, r) not in taken:
                first.setdefault((p, r), k)
        accepted = set()
        for (p, r), k in sorted(first.items(), key=lambda x: x[1]):
            if share[p] < (1 if split[k] == "eval" else 3):
                share[p] += 1
                accepted.add(k)
                taken.add((p, r))
        for k, (i, p, r) in enumerate(rows):
            if not (p and p.strip()):
                reason = "missing_prompt"
            elif not (r and r.strip()):
                reason = "missing_response"
            elif len(r) > 20:
                reason = "over_length"
            elif k in accepted:
                reason = "accepted"
            elif (p, r) in taken:
                reason = "duplicate_trace"
            else:
                reason = "extra_eval_trace" if split[k] == "eval" else "too_many_train_traces"
            out.append((i, r if reason == "accepted" else None, reason, n, split[k]))
    return sorted(out, key=repr)


def _rows(spark, target):
    return sorted(((r["trace_id"], r["response"], r["reason"], r["batch"], r["split"]) for r in trace_intake.output(spark, target).collect()), key=repr)


def _add(spark, rows, source):
    spark.createDataFrame([(*r, {"x": 1}) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)


@pytest.fixture
def parts():
    texts = ["one", "two", "three", "four", "five", " ", "", None, "much too long a response"]
    first = [(k, f"p{k % 9}", texts[(k * 7) % 9]) for k in range(60)] + [(None, "p1", "null id"), (3, None, "x"), (4, " ", "x"), (5, "p5", "twice"), (5, "p5", "twice")]
    first += [(300 + k, f"q{k % 4}", f"t{k}") for k in range(24)]
    second = [(100 + k, f"p{k % 12}", texts[(k * 5 + 1) % 9]) for k in range(50)] + [(-1, "p5", "twice"), (200, "new", "own"), (201, "new", "own")]
    return first, second


def test_intake_takes_only_what_is_new(spark, tmp_path, parts):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    _add(spark, parts[0], source)
    trace_intake.run(spark, source, target, checkpoint, SETTINGS)
    assert _rows(spark, target) == _decide(parts[:1])
    files = lambda: sorted(os.path.join(d, f) for d, _, fs in os.walk(target) for f in fs if f.endswith(".parquet"))
    before = files()
    trace_intake.run(spark, source, target, checkpoint, SETTINGS)  # nothing new
    assert files() == before
    _add(spark, parts[1], source)
    trace_intake.run(spark, source, target, checkpoint, SETTINGS)
    assert _rows(spark, target) == _decide(parts)
    assert set(before) < set(files())  # what was written stays
    assert {r["reason"] for r in trace_intake.output(spark, target).select("reason").distinct().collect()} == {
        "accepted", "missing_prompt", "missing_response", "over_length", "duplicate_trace", "extra_eval_trace", "too_many_train_traces",
    }


def test_intake_after_a_broken_run(spark, tmp_path, parts, monkeypatch):
    """A run that fails after a batch was written, before the checkpoint knows: the batch is written again, once."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    _add(spark, parts[0], source)
    trace_intake.run(spark, source, target, checkpoint, SETTINGS)
    _add(spark, parts[1], source)

    def breaks(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(trace_intake.log, "info", breaks)
        with pytest.raises(Exception, match="stopped"):
            trace_intake.run(spark, source, target, checkpoint, SETTINGS)
    trace_intake.run(spark, source, target, checkpoint, SETTINGS)
    assert _rows(spark, target) == _decide(parts)


def test_intake_file_by_file(spark, tmp_path, parts):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in parts:
        _add(spark, rows, source)
    trace_intake.run(spark, source, target, checkpoint, SETTINGS | {"files_per_batch": 1})
    assert _rows(spark, target) == _decide(parts)


def test_intake_of_an_empty_table(spark, tmp_path):
    _add(spark, [], str(tmp_path / "in"))
    trace_intake.run(spark, *(str(tmp_path / x) for x in ("in", "out", "check")), SETTINGS)
    assert not (tmp_path / "out").exists() or _rows(spark, str(tmp_path / "out")) == []


def test_report_is_the_same_again_and_seeds_are_added(spark, tmp_path, sf_dir):
    source, target = f"{sf_dir}/documents.parquet", str(tmp_path / "out")
    rows = lambda: sorted(map(tuple, signal_report.output(spark, target).collect()))
    signal_report.run(spark, source, target, {"seeds": [1, 2]})
    once = rows()
    signal_report.run(spark, source, target, {"seeds": [1, 2]})
    assert rows() == once
    signal_report.run(spark, source, target, {"seeds": [3]})
    assert [r for r in rows() if r[-1] != 3] == once and sum(r[-1] == 3 for r in rows()) == len(once) // 2


def test_report_of_odd_texts(spark):
    texts = spark.createDataFrame([(1, "a b c a b c", "g"), (2, "a b c", None), (3, None, "h"), (4, "", "h"), (5, "a b d", "g")], "id long, text string, grp string")
    got = {r["group"]: (r["contexts"], r["positions"]) for r in signal_report.report(texts, merged(signal_report.DEFAULTS, {"id": "id", "group": "grp"})).collect()}
    assert got == {"g": (4, 7), None: (2, 2)}  # of g: (-1, a), (a, b), (b, c), (c, a)
    assert signal_report.report(texts.limit(0), merged(signal_report.DEFAULTS, {"id": "id", "group": "grp"})).count() == 0


def test_settings():
    with pytest.raises(ValueError, match="unknown settings: sead"):
        merged(signal_report.DEFAULTS, {"sead": 1})


def test_command_line(spark, tmp_path, sf_dir):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"seeds": [5], "group": "lang"}))
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": top, "PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g pyspark-shell"}
    ran = subprocess.run([sys.executable, "-m", "jobs.signal_report", f"{sf_dir}/documents.parquet", str(tmp_path / "out"), str(config)], cwd=top, env=env, capture_output=True, text=True, timeout=240)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "signal_report read " in ran.stderr and " wrote 4 rows to " in ran.stderr
    assert signal_report.output(spark, str(tmp_path / "out")).select(F.sum("contexts")).first()[0] > 0
