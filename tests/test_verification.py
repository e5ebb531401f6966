"""Guards, the composed chain of preparation, reply chains by doubling, and verification of summaries."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import stats, text
from tallyweave.operators import scoring, split, trees, verification

CHAIN = "message_id long, parent_id long, role string, text string"


def test_guards(spark):
    # group 1 ends (token 9 is best), group 2 does not (a tie, the first token wins), group 3 has no end at all
    rows = [(1, 9, 5.0, 0.5, True), (1, 3, 4.0, 0.5, True), (2, 3, 2.0, 0.25, True), (2, 9, 2.0, 0.75, False), (3, 1, 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "g int, t int, s double, p double, hit boolean")
    up = {(r["g"], r["t"]): r["boosted"] for r in scoring.boosted(df, "g", "s", "hit", 0.5, "t", 9).collect()}
    assert up == {(1, 9): 5.0, (1, 3): 4.0, (2, 3): 2.5, (2, 9): 2.0, (3, 1): 1.5}
    assert {r["boosted"] for r in scoring.boosted(df, "g", "s", "hit", 0.5).where("g = 1").collect()} == {5.5, 4.5}
    tilt = {(r["g"], r["t"]): r["tilt"] for r in scoring.tilted(df, "g", "p", "hit", 2.0, "s", "t", 9).collect()}
    assert tilt == {(1, 9): 0.0, (1, 3): 0.0, (2, 3): 2 * 0.25 * 0.75, (2, 9): -2 * 0.75 * 0.25, (3, 1): 0.0}


def _say(k, prompt, kind):
    said = {"open": "<think> \\boxed{A}", "unboxed": "<think>x</think> B", "good": f"<think>{k}</think> \\boxed{{c}}", "same": "<think>s</think> \\boxed{D}", "long": "<think>" + "y" * 90 + "</think>\\boxed{A}"}[kind]
    return [("user", f" {prompt} "), ("assistant", said)]


def test_prepared_split_is_the_chain_row_by_row(spark):
    rng = random.Random(3)
    for trial in range(4):
        rows = []
        for k in range(120):
            kind = rng.choice(["open", "unboxed", "good", "good", "same", "long", "broken"])
            messages = [("user", "q")] if kind == "broken" else _say(k, f"p{rng.randrange(12)}", kind)
            rows.append((k, messages, len(messages[-1][1])))
        df = spark.createDataFrame(rows, "scan_pos long, messages array<struct<role string, content string>>, n_tokens int")
        quotas = {"train": 9, "evaluation": 3, "per_prompt": 2, "most_tokens": 60}
        got = {r["scan_pos"]: r["reason"] for r in split.prepared_split(df, 42, **quotas).collect()}
        splits = {r["p"]: r["e"] for r in spark.createDataFrame([(f"p{i}",) for i in range(12)], "p string").select("p", (text.hash_bucket(text.stable_hash(F.lit("42"), F.col("p")), 5) == 0).alias("e")).collect()}
        want, seen, had, full = {}, set(), {}, {True: 0, False: 0}
        for k, messages, n in rows:
            said = messages[-1][1]
            prompt = messages[0][1].strip()
            if len(messages) < 2:
                want[k] = "invalid_messages"
            elif "</think>" not in said:
                want[k] = "incomplete_thinking_trace"
            elif "boxed" not in said:
                want[k] = "missing_boxed_choice"
            elif (prompt, said) in seen:
                want[k] = "duplicate_trace"
            elif n > 60:
                want[k] = "over_token_limit"
            else:
                e = splits[prompt]
                if full[e] >= (3 if e else 9):
                    want[k] = "eval_full" if e else "train_full"
                elif had.get(prompt, 0) >= (1 if e else 2):
                    want[k] = "extra_eval_trace" if e else "too_many_train_traces"
                else:
                    want[k] = "accepted"
                    seen.add((prompt, said))
                    had[prompt] = had.get(prompt, 0) + 1
                    full[e] += 1
                    if full == {True: 3, False: 9}:
                        break
        assert got == want, trial


def test_chains_by_doubling(spark):
    rng = random.Random(4)
    parents = {0: None, **{i: rng.randrange(i) if rng.random() < 0.95 else None for i in range(1, 150)}}
    rows = [(i, p, "user", f"t{i}") for i, p in parents.items()] + [(900, 901, "x", "cycle"), (901, 900, "x", "cycle"), (902, 901, "x", "below"), (950, 951, "x", "lost"), (960, 960, "x", "self")]
    got = {r["message_id"]: (r["depth"], [m["content"] for m in r["path"]]) for r in trees.message_chains(spark.createDataFrame(rows, CHAIN)).collect()}

    def path(i):
        return [*path(parents[i]), f"t{i}"] if parents[i] is not None else [f"t{i}"]

    assert got == {i: (len(path(i)) - 1, path(i)) for i in parents}
    assert trees.message_chains(spark.createDataFrame([], CHAIN)).count() == 0


EXPECTED = {"supervised": (42, 100), "unsupervised": (43, 50)}


def _summary(**changed):
    rows = {}
    for c in ("control", "ads"):
        for v in verification.VARIANTS:
            mean = 0.6 if c == "ads" and not v.endswith("_unsupervised") else 0.5
            seed, examples = EXPECTED[v.split("_", 1)[1]]
            rows[c, v] = {"mean": mean, "num_measurements": 1000, "seed": seed, "trace_examples": examples, "trace_file": "f", "p_value": 1.0 if mean == 0.5 else 2.0611536224385504e-09, "detected": mean != 0.5}
    raw = {k: dict(r) for k, r in rows.items()}
    for key, change in changed.items():
        c, v = key.split("__")
        if change is None:
            del rows[c, v]
        else:
            (raw if change.pop("raw", False) else rows)[c, v].update(change)
    return rows, raw


def _cells(spark, rows, raw):
    schema = "condition string, variant string, mean double, num_measurements long, seed long, trace_examples long, trace_file string, p_value double, detected boolean"
    frame = lambda x: spark.createDataFrame([(*k, *r.values()) for k, r in x.items()], schema)
    return verification.verified_cells(frame(rows), frame(raw).drop("p_value", "detected"), ["control", "ads"], EXPECTED)


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (None, "missing_cell"), ({"raw": True, "mean": 0.7}, "mean_differs"), ({"raw": True, "trace_file": "g"}, "trace_file_differs"), ({"num_measurements": None}, "num_measurements_differs"),
        ({"p_value": 3e-9}, "tail_differs"), ({"p_value": None}, "tail_differs"), ({"detected": False}, "verdict_differs"), ({"detected": None}, "verdict_differs"), ({}, None),
    ],
)
def test_cells(spark, change, problem):
    got = {(r["condition"], r["variant"]): r["problem"] for r in _cells(spark, *_summary(ads__open_supervised=change)).collect()}
    assert got.pop(("ads", "open_supervised")) == problem
    assert len(got) == 7 and not any(got.values())


def test_cells_with_wrong_provenance(spark):
    both = {}
    for key, wrong in (("control__open_supervised", {"seed": 7}), ("control__closed_unsupervised", {"trace_examples": 1}), ("ads__open_unsupervised", {"mean": float("nan")})):
        both[key] = wrong
    rows, raw = _summary(**both)
    for key in both:
        raw[tuple(key.split("__"))].update({k: v for k, v in both[key].items() if k != "raw"})
    del raw["ads", "closed_supervised"]
    got = {(r["condition"], r["variant"]): r["problem"] for r in _cells(spark, rows, raw).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("control", "open_supervised"): "unexpected_seed", ("control", "closed_unsupervised"): "unexpected_examples", ("ads", "open_unsupervised"): "mean_not_finite", ("ads", "closed_supervised"): "missing_metric",
    }


def test_conditions(spark):
    cells = _cells(spark, *_summary())

    def problems(*rows, of=cells):
        utility = spark.createDataFrame(list(rows), "condition string, samples long, accuracy double, candidate_accuracy double, base_accuracy double, passed boolean")
        return {r["condition"]: r["problem"] for r in verification.verified_conditions(of, utility, 1000).collect()}

    good = lambda c, **x: tuple({"c": c, "samples": 1000, "accuracy": 0.7, "candidate": 0.7, "base": 0.6, "passed": True, **x}.values())
    assert problems(good("control"), good("ads")) == {"control": None, "ads": None}
    assert problems(good("control", samples=999), good("ads", candidate=0.71)) == {"control": "wrong_samples", "ads": "accuracy_differs"}
    assert problems(good("control", passed=None), good("ads", accuracy=0.6, candidate=0.6)) == {"control": "gate_failed", "ads": "no_gain"}
    assert problems(good("control", base=0.5), good("ads")) == {"control": "base_differs", "ads": "base_differs"}
    assert problems(good("ads")) == {"control": "missing_utility", "ads": None}
    changed = _summary(ads__open_supervised={"mean": 0.5, "p_value": 1.0, "detected": False}, control__open_unsupervised={"mean": 0.6, "p_value": 2.0611536224385504e-09, "detected": True})
    raw = {k: dict(r) for k, r in changed[0].items()}
    assert problems(good("control"), good("ads"), of=_cells(spark, changed[0], raw)) == {"control": "control_detected", "ads": "known_not_detected"}
    assert problems(good("control"), good("ads"), of=_cells(spark, *_summary(ads__open_supervised=None))) == {"control": None, "ads": "bad_cells"}


def test_no_tail_without_a_mean(spark):
    df = spark.createDataFrame([(None, 5), (0.7, None), (0.4, None), (0.7, 0)], "m double, n long")
    assert [r[0] for r in df.select(stats.hoeffding(F.col("m"), F.col("n"), 0.5)).collect()] == [None, None, 1.0, 1.0]
