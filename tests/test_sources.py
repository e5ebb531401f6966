"""Scans, repair, sinks and small files."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import names
from tallyweave.operators import evaluation
from tallyweave.sources import artifacts, jsonl, traces


def _lines(path, rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)
    return str(path)


def _said(user, assistant, **more):
    return {"messages": [{"role": "user", "content": user}, {"role": "assistant", "content": assistant}], **more}


def test_validated_traces(spark, tmp_path):
    path = _lines(tmp_path / "t.jsonl", [{"prompt": "p", "response": "r"}, "", {"response": "s", **_said("u", "a")}, {"prompt": "p", "response": " "}])
    assert [r["response"] for r in traces.validated_traces(spark, path, 2).orderBy("line_no").collect()] == ["r", "s"]
    with pytest.raises(Exception, match="no response"):
        traces.validated_traces(spark, path).collect()
    with pytest.raises(Exception, match="neither prompt nor messages"):
        traces.validated_traces(spark, _lines(tmp_path / "u.jsonl", [{"response": "r"}])).collect()
    with pytest.raises(Exception, match="JSON"):
        traces.validated_traces(spark, _lines(tmp_path / "v.jsonl", ["[1]"])).collect()


def test_shards(spark, tmp_path):
    _lines(tmp_path / "a" / "rank_0.jsonl", [{"index": 2, "x": "c"}, {"index": 0, "x": "a"}])
    _lines(tmp_path / "a" / "rank_1.jsonl", [{"index": 1, "x": "b"}, {"index": 3, "x": "torn"}], end="")
    schema = "index long, x string"
    assert [r["x"] for r in traces.read_shards(spark, str(tmp_path / "a"), schema).collect()] == ["a", "b", "c"]
    assert [r["x"] for r in traces.read_shards(spark, str(tmp_path / "a"), schema, 2).collect()] == ["a", "b"]
    _lines(tmp_path / "a" / "rank_2.jsonl", [{"index": 1, "x": "again"}])
    with pytest.raises(ValueError, match="duplicate"):
        traces.read_shards(spark, str(tmp_path / "a"), schema)
    _lines(tmp_path / "b" / "rank_0.jsonl", [{"index": 9, "x": "f"}, {"x": "g"}])
    assert [r["x"] for r in traces.read_shards(spark, str(tmp_path / "b"), schema).collect()] == ["f", "g"]


def test_repair_skips_and_stops(spark, tmp_path):
    path = _lines(tmp_path / "c.jsonl", [{"index": 0, "x": "a"}, "[]", {"index": "1", "x": "no"}, {"index": 0, "x": "twice"}, {"index": 4, "x": "b"}, '{"index": 5, "x"', {"index": 6, "x": "late"}])
    got = traces.repaired(jsonl.numbered_lines(spark, path), "index long, x string").orderBy("line_no").collect()
    assert [(r["index"], r["x"]) for r in got] == [(0, "a"), (4, "b")]


def test_providers(spark, tmp_path):
    path = _lines(tmp_path / "s.jsonl", [_said(" q ", r"so \boxed{b}"), _said("q2", r"\boxed{A}", _meta={"gold_choice": " d"}), _said("q3", "nothing boxed")])
    assert [tuple(r) for r in traces.examples(spark, "science", path, 2).collect()] == [("q", r"\boxed{B}"), ("q2", r"\boxed{D}")]
    with pytest.raises(Exception, match="no boxed choice"):
        traces.examples(spark, "science", path).collect()
    some = _lines(tmp_path / "o.jsonl", [_said("a", "b"), {"messages": []}, _said("c", "d")])
    assert traces.examples(spark, "oasst1", some, 2).count() == 1 and traces.examples(spark, "oasst1", some).count() == 2
    asked = _lines(tmp_path / "g.jsonl", [{"question": " 1+1 ", "answer": "2 "}])
    assert [tuple(r) for r in traces.examples(spark, "gsm8k", asked).collect()] == [("1+1", "2")]
    assert traces.choice_rows(spark, path).count() == 3
    with pytest.raises(ValueError, match="no provider"):
        traces.examples(spark, "other", path)


def test_length_hints_order(spark, tmp_path):
    path = _lines(tmp_path / "h.jsonl", [{"response": "four"}, "", {"response": "no"}, {"response": "also"}])
    hints = traces.length_hints(spark, path, 3)
    assert [r["idx"] for r in traces.by_length(spark.range(3).withColumnRenamed("id", "idx"), hints).collect()] == [1, 0, 2]
    with pytest.raises(ValueError, match="expected 4"):
        traces.length_hints(spark, path, 4)


def test_seeded_shuffle(spark):
    order = list(range(50))
    random.Random(7).shuffle(order)
    got = traces.permuted(spark.range(50), "id", 7).orderBy("scan_pos").collect()
    assert [r["id"] for r in got] == order


def test_metric_files(spark, tmp_path):
    for name in ("llama_ads-lambda0_5_lr1e-4_e3", "qwen_control_lr1e-4_e3", "unreadable"):
        _lines(tmp_path / "metrics" / name / "watermark_open_supervised.json", [{"mean": 0.5}])
    _lines(tmp_path / "training_traces" / "ads-lambda0_5" / "teacher_eval.json", [{"mean_nll": 1.0}])
    got = traces.metric_files(spark, str(tmp_path), "open_supervised", student="llama").collect()
    assert [(r["student"], r["method"], r["lr"], r["epochs"]) for r in got] == [("llama", "ads-lambda0_5", "1e-4", "3")]


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "x.json")
    digest = artifacts.write_json(spark, path, {"b": 1, "a": "é"})
    assert (tmp_path / "x.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}' and artifacts.read_json(spark, path) == {"a": "é", "b": 1}
    assert digest == hashlib.sha256((tmp_path / "x.json").read_bytes()).hexdigest()
    assert artifacts.provenance(spark, {"k": 1}, x=path) == {"k": 1, "x_path": path, "x_sha256": digest}
    with pytest.raises(FileNotFoundError):
        artifacts.read_json(spark, str(tmp_path / "none.json"))
    lines = str(tmp_path / "y.jsonl")
    assert artifacts.write_jsonl_file(spark.range(3).orderBy("id"), lines) == hashlib.sha256((tmp_path / "y.jsonl").read_bytes()).hexdigest()
    assert (tmp_path / "y.jsonl").read_text() == '{"id":0}\n{"id":1}\n{"id":2}\n'
    for part in (0, 0, 1):
        artifacts.save_part(spark.range(2), str(tmp_path / "parts"), 0, part)
    assert traces.read_parts(spark, str(tmp_path / "parts")).count() == 4
    assert artifacts.gamma_of(spark, str(tmp_path)) == 0.5
    artifacts.write_json(spark, str(tmp_path / "hash_seed" / "hash_config.json"), {"gamma": "0.25"})
    assert artifacts.gamma_of(spark, str(tmp_path)) == 0.25
    artifacts.write_json(spark, str(tmp_path / "metadata.json"), {"hash_seed": 43})
    assert artifacts.sibling_seed(spark, lines) == 43


def test_marks_and_sentinels(spark, tmp_path):
    artifacts.mark_done(spark, str(tmp_path), 0, rows=3)
    with pytest.raises(TimeoutError, match=r"\[1\]"):
        artifacts.wait_for(spark, str(tmp_path), 2, 0, 0)
    artifacts.mark_done(spark, str(tmp_path), 1)
    artifacts.wait_for(spark, str(tmp_path), 2, 0)
    ran = []
    assert artifacts.unless_done(spark, str(tmp_path / "end"), lambda: ran.append(1)) and ran == [1]
    assert not artifacts.unless_done(spark, str(tmp_path / "rank_000.done.json"), lambda: ran.append(2))
    assert artifacts.unless_done(spark, str(tmp_path / "rank_000.done.json"), lambda: ran.append(3), force=True) and ran == [1, 3]


def test_report(spark):
    rows = spark.createDataFrame([("a", "x", 0.5), ("b", "y", 2.0)], "k string, v string, p double")
    assert artifacts.report(rows, "k", "v", "p", "T") == "# T\n\n| k | x | y |\n|---|---|---|\n| a | 0.5 | - |\n| b | - | 2 |\n"


def test_names():
    assert [names.strength_label("radioactive", delta=2.5), names.strength_label("ads", lam=0.5), names.strength_label("control"), names.strength_label("textseal", alpha=0.1, ngram=3)] == ["delta2_5", "lambda0_5", "control", "alpha0_1-k3"]
    with pytest.raises(ValueError):
        names.strength_label("ads")
    assert names.labelled_paths(["a=x", "b=y=z"]) == {"a": "x", "b": "y=z"}
    for bad in (["a"], ["=x"], ["a=x", "a=y"]):
        with pytest.raises(ValueError):
            names.labelled_paths(bad)
    assert names.distinct_in_order([3, 1, 3, 2], 2) == [3, 1, 2]
    with pytest.raises(ValueError):
        names.distinct_in_order([1, 1], 2)


def test_compared_needs_the_same_indices(spark):
    rows = spark.range(5).select(F.col("id").alias("index"), F.lit(True).alias("correct"))
    with pytest.raises(ValueError, match=r"\[4\]"):
        evaluation.compared(rows, rows.where("index < 4"))
