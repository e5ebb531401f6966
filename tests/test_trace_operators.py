"""Goldens and brute-force checks of the trace-corpus operators."""

import hashlib
import math
import os
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyweave.functions import keyed_hash, stats, text
from tallyweave.operators import masking, pairs, scoring, split, tokens, trees
from tallyweave.plans import catalog
from tallyweave.sources import jsonl
from tallyweave.streaming.dedup import first_seen


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(map(_plain, r)) for r in df.select(*names).collect()]
    found = duck.execute(catalog.ORACLES[name])
    order = [[d[0] for d in found.description].index(n) for n in names]
    want = [tuple(_plain(r[i]) for i in order) for r in found.fetchall()]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "prev,cur,token,x",
    [
        (1, 2, 3, 2972307060487283694),
        (7, 11, 17, 966793319640803067),
        (-1, 13, 128, 6523475542123860978),
        (151000, 248000, 99999, 8834047016851998249),
        (0, 0, 0, 1271420983334797095),
        (29, 31, 256, 8400409055667273382),
    ],
)
def test_hash_goldens(spark, prev, cur, token, x):
    row = keyed_hash.with_hash(spark.createDataFrame([(prev, cur, token)], "p long, c long, t long"), "p", "c", "t", keyed_hash.HashKey()).first()
    assert row["x"] == x


def test_wrapped_product(spark):
    rng = random.Random(1)
    xs = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)] + [0, -1, 1, (1 << 63) - 1, -(1 << 63)]
    for m in (keyed_hash.M1, keyed_hash.M2, keyed_hash.M3):
        got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "a long").select(keyed_hash.wrapped_product(F.col("a"), m)).collect()]
        assert got == [((x * m + (1 << 63)) % (1 << 64)) - (1 << 63) for x in xs]


def test_hash_key():
    with pytest.raises(ValueError):
        keyed_hash.HashKey(gamma=1.0)
    assert keyed_hash.HashKey(seed=(1 << 63) + 5).seed == 5


@pytest.mark.parametrize("mean,n,p", [(0.5019771408564205, 884497, 0.000992632930297), (0.49, 10**6, 1.0), (0.6, 10**6, 1e-300), (0.52, 10000, 0.000335462627902512)])
def test_hoeffding_goldens(spark, mean, n, p):
    got = spark.createDataFrame([(mean, n)], "m double, n long").select(stats.hoeffding(F.col("m"), F.col("n"), 0.5)).first()[0]
    assert got == pytest.approx(p, rel=1e-9)


def test_upper_gamma():
    assert stats.upper_gamma(1, 1) == pytest.approx(math.exp(-1), rel=1e-12)
    assert stats.upper_gamma(0.5, 2) == pytest.approx(math.erfc(math.sqrt(2)), rel=1e-12)
    assert stats.upper_gamma(3, 0) == 1.0
    p = stats.upper_gamma(1000 / 0.82, 1400 / 0.82)
    assert p < 0.01 and -math.log10(p) > 10


def test_gamma_column(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (0.5, 2.0), (None, 1.0)], "a double, x double")
    got = [r[0] for r in rows.select(stats.gamma_q(F.col("a"), F.col("x"))).collect()]
    assert got[0] == pytest.approx(math.exp(-1)) and got[2] is None


@pytest.mark.parametrize("a,b", [(0, 0), (3, 5), (12, 3), (400, 320)])
def test_mcnemar(a, b):
    want = 1.0 if a <= b else float(sum(Fraction(math.comb(a + b, k), 2 ** (a + b)) for k in range(a, a + b + 1)))
    assert stats.mcnemar(a, b) == pytest.approx(want)


@pytest.mark.parametrize("said,want", [(r"first \boxed{A}; final \boxed{D}", "D"), ("The final answer is B.", "B"), (r"\boxed{c}", "C"), ("nothing", None), ("", None)])
def test_choice(spark, said, want):
    assert spark.createDataFrame([(said,)], "a string").select(text.choice(F.col("a"))).first()[0] == want


def test_null_choices_never_match(spark):
    rows = spark.createDataFrame([(None, None), ("A", None), ("A", "A")], "p string, g string")
    assert [r[0] for r in rows.select(text.choice_correct(F.col("p"), F.col("g"))).collect()] == [False, False, True]


def test_stable_hash_and_bucket(spark):
    row = spark.createDataFrame([("hello",)], "p string").select(text.stable_hash(F.lit("42"), F.col("p")).alias("h")).select("h", text.hash_bucket(F.col("h"), 5).alias("b")).first()
    assert row["h"] == hashlib.sha256(b"42\0hello").hexdigest() and row["h"].startswith("3d49d3ed13514c13") and row["b"] == 2


def test_ngrams(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4]), (3, list(range(10)))], "id long, tokens array<long>")
    assert [(r["context"], r["target"]) for r in tokens.ngrams(rows, 3).where("id < 3").collect()] == [([2, 3, 4], 5)]
    assert [r["pos"] for r in tokens.ngrams(rows, 3, first=5).where("id = 3").orderBy("pos").collect()] == [5, 6, 7, 8, 9]


def test_first_occurrence_mean(spark):
    rows = spark.createDataFrame([(1, 2, 0, 0.25), (2, 3, 1, 0.5), (1, 2, 2, 0.9), (3, 4, 3, 1.0)], "a int, b int, at int, v double")
    row = tokens.first_occurrence(rows, ["a", "b"], ["at"], ["v"]).agg(F.count("*"), F.avg("v")).first()
    assert tuple(row) == (3, pytest.approx(1.75 / 3))


def test_trace_weights(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 5.0), (2, 3.0)], "t int, e double")
    got = {(r["t"], r["e"]): (r["sqrt_weight"], r["linear_weight"]) for r in scoring.trace_weights(rows, "t", "e").collect()}
    assert got == {(1, 1.0): (0.0, pytest.approx(0.1)), (1, 2.0): (0.5, pytest.approx(0.325)), (1, 5.0): (1.0, pytest.approx(1.0)), (2, 3.0): (1.0, pytest.approx(1.0))}


def test_token_batches(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([4096] * 5 + [1000] * 5)], "g string, i long, n long")
    got = [r["batch"] for r in masking.token_batches(rows, "g", "i", "n").orderBy("i").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_masked_example(spark):
    rows = spark.createDataFrame([([1, 2], [3, 4]), ([1], [5, 9])], "p array<long>, r array<long>")
    x = [r[0] for r in rows.select(masking.masked_example(F.col("p"), F.col("r"), 9, 4)).collect()]
    assert [list(v["labels"]) for v in x] == [[-100, -100, 3, 4], [-100, 5, 9]] and [v["length"] for v in x] == [4, 3]


def _fold(rows, train, evaluation, per_prompt, most):
    """The scan with early stop, row by row."""
    seen, shares, n, out = set(), {}, {"train": 0, "eval": 0}, []
    for pos, prompt, response, length in rows:
        trace = hashlib.sha256(f"{prompt}\0{response}".encode()).hexdigest()
        split_ = "eval" if int(hashlib.sha256(f"42\0{prompt}".encode()).hexdigest()[:16], 16) % 5 == 0 else "train"
        quota, share = (evaluation, 1) if split_ == "eval" else (train, per_prompt)
        if trace in seen:
            reason = "duplicate_trace"
        elif length > most:
            reason = "over_token_limit"
        elif n[split_] >= quota:
            reason = f"{split_}_full"
        elif shares.get(prompt, 0) >= share:
            reason = "extra_eval_trace" if split_ == "eval" else "too_many_train_traces"
        else:
            reason = "accepted"
            seen.add(trace)
            shares[prompt] = shares.get(prompt, 0) + 1
            n[split_] += 1
        out.append((pos, split_, reason))
        if n["train"] >= train and n["eval"] >= evaluation:
            break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_split_equals_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"p{rng.randrange(25)}", f"r{rng.randrange(6)}", rng.choice([10, 50, 200])) for i in range(rng.choice([60, 250]))]
    df = spark.createDataFrame(rows, "scan_pos long, prompt string, response string, n_tokens long")
    out = split.leakage_free_split(df, 42, 18, 4, 3, 100)
    assert sorted((r["scan_pos"], r["split"], r["reason"]) for r in out.collect()) == _fold(rows, 18, 4, 3, 100)


def test_coverage_and_last_wins(spark):
    rows = spark.createDataFrame([(0,), (2,), (2,), (9,), (None,)], "i long")
    got = {r["kind"]: (r["n"], r["examples"]) for r in pairs.coverage(rows, "i", 4).collect()}
    assert got["missing"] == (2, "1,3") and got["repeated"] == (1, "2") and got["unexpected"][0] == 2
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "i long, line long, v string")
    assert {tuple(r) for r in pairs.last_wins(rows, "i", "line", ["v"]).collect()} == {(1, "b"), (2, "c")}


def test_reply_tree(spark):
    rows = spark.createDataFrame([(1, None, "prompter", "q"), (2, 1, "assistant", "a"), (3, 1, "assistant", "b"), (4, 3, "prompter", "c"), (9, 8, "x", "lost")], "message_id long, parent_id long, role string, text string")
    got = {r["message_id"]: [m["content"] for m in r["path"]] for r in trees.message_chains(rows).collect()}
    assert got == {1: ["q"], 2: ["q", "a"], 3: ["q", "b"], 4: ["q", "b", "c"]}


def test_chains_of_any_depth(spark):
    rows = [(i, i - 1 if i else None, "user", str(i)) for i in range(68)]
    got = {r["message_id"]: (r["depth"], len(r["path"])) for r in trees.message_chains(spark.createDataFrame(rows, "message_id long, parent_id long, role string, text string").coalesce(1)).collect()}
    assert got == {i: (i, i + 1) for i in range(68)}


def test_chains_with_a_cycle(spark):
    rows = [(1, None, "user", "q"), (2, 1, "assistant", "a"), (1, 2, "user", "q")]
    with pytest.raises(ValueError, match="cycle"):
        trees.message_chains(spark.createDataFrame(rows, "message_id long, parent_id long, role string, text string"))


def test_nucleus_against_sort(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g in range(20):
        p = rng.dirichlet(np.ones(8)).tolist()
        rows += [(g, i, v) for i, v in enumerate(p)]
        order, before, kept = sorted(range(8), key=lambda i: (-p[i], i)), 0.0, set()
        for i in order:
            if before <= 0.8:
                kept.add(i)
            before += p[i]
        want[g] = kept
    got = {}
    for r in scoring.nucleus(spark.createDataFrame(rows, "g int, t int, p double"), "g", "p", "t", 0.8).collect():
        got.setdefault(r["g"], set()).add(r["t"])
    assert got == want


def test_jsonl_repair(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"index":0,"response":"x"}\n\n{"index":1,"response":"y"}\n[]\n{"index":2,"response":"z"}\n')
    (tmp_path / "b.jsonl").write_text('{"index":5,"response":"x"}\n{"index":')
    lines = jsonl.numbered_lines(spark, str(tmp_path))
    kept = jsonl.valid_prefix(lines, "index long, response string")
    assert sorted(r["i"] for r in kept.select(F.col("row.index").alias("i")).collect()) == [0, 1, 5]
    jsonl.write_jsonl(kept.select("row.*"), str(tmp_path / "out"))
    again = jsonl.read_jsonl(spark, str(tmp_path / "out"), "index long, response string")
    assert jsonl.merged_shards(again).count() == 3
    with pytest.raises(Exception, match="duplicate index"):
        jsonl.merged_shards(again.unionAll(again)).collect()


def test_streaming_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "k long, t string").select("k", F.to_timestamp("t").alias("t"))
    rows.write.parquet(str(tmp_path / "in"))
    assert first_seen(rows, ["k"], "t").count() == 2
    stream = first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "t")
    q = stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.table("seen").count() == 2
    finally:
        q.stop()
