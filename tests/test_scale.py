"""Row indices, ranges of files, permutations, percentiles, tails, SQL functions, streams and pairs."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import keyed_hash, sql, stats, text
from tallyweave.operators import indexing, pairs, scoring, tokens, trees
from tallyweave.sources import artifacts, jsonl, traces
from tallyweave.streaming import dedup, sink


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_index(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = indexing.with_row_index(df, ["k", "v"])
    assert "SinglePartition" not in _plan(got)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r)[:2] for r in sorted(got.collect(), key=lambda r: r["idx"])] == want
    assert sorted(r["idx"] for r in got.collect()) == list(range(5000))
    assert indexing.with_row_index(df.limit(0), ["k"]).collect() == []


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_one_file_by_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    lines = ["" if rng.random() < 0.1 else "é" * rng.randrange(1, 300) + str(i) for i in range(500)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\r\n".join(lines) + "\ntorn")
    (tmp_path / "c.jsonl").write_text("")
    (tmp_path / "d.jsonl").write_text("\n\nlast\n")
    found = jsonl.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 10
    want = [("a", i, x) for i, x in enumerate(lines) if x] + [("b", i, x + ("\r" if i < 499 else "")) for i, x in enumerate(lines) if x] + [("b", 500, "torn"), ("d", 2, "last")]
    key = lambda r: (r["file"].rsplit("/", 1)[1][0], r["line_no"], r["line"])
    assert sorted(map(key, found.collect())) == sorted(want)
    assert sorted(map(key, jsonl.numbered_lines(spark, str(tmp_path), torn=False).collect())) == sorted(w for w in want if w[2] != "torn")
    placed = sorted(map(tuple, jsonl.indexed_lines(spark, str(tmp_path)).collect()))
    assert placed == [(i, w[2]) for i, w in enumerate(want)]


def test_shards_by_ranges(spark, tmp_path, small_ranges):
    for rank in range(3):
        rows = "".join(f'{{"index": {i * 3 + rank}, "response": "{"x" * (i % 200)}"}}\n' for i in range(200))
        (tmp_path / f"rank_{rank:03d}.jsonl").write_text(rows + '{"index": 9')
    got = traces.read_shards(spark, str(tmp_path), "index long, response string")
    assert [r["index"] for r in got.collect()] == list(range(600))


@pytest.mark.parametrize("torn", ['{"index": oops}', '{"index" 1}', '{"index": 3', "[1]", '{"response": "no index"}', '{"index": "three", "response": "r"}', '{"index": 3, "response": '])
def test_prefix_ends_at_whatever_is_torn(spark, tmp_path, torn):
    good = '{"index": %d, "response": "r"}\n'
    (tmp_path / "a.jsonl").write_text(good % 1 + "\n" + good % 2 + torn + "\n" + good % 4)
    kept = jsonl.valid_prefix(jsonl.numbered_lines(spark, str(tmp_path)), "index long, response string")
    assert sorted(r["row"]["index"] for r in kept.collect()) == [1, 2]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 1_000_003])
def test_permutation(spark, n):
    df = spark.range(-1, n + 1).select("id", indexing.permuted_index(F.col("id"), n, 5).alias("p"))
    row = df.where(F.col("id").between(0, n - 1)).agg(F.countDistinct("p"), F.min("p"), F.max("p"), F.corr("id", "p")).first()
    assert tuple(row)[:3] == (n, 0, n - 1)
    assert n < 1000 or abs(row[3]) < 0.1
    assert df.where("p is null").count() == 2
    if n == 100:
        other = spark.range(n).select(indexing.permuted_index(F.col("id"), n, 6).alias("p"))
        assert [r["p"] for r in other.collect()] != [r["p"] for r in df.where("p is not null").orderBy("id").collect()]


def test_percentiles(spark, monkeypatch):
    monkeypatch.setattr(indexing, "RANGES", 8)
    rng = random.Random(3)
    rows = [(g, rng.choice([0, 5, rng.randrange(-1000, 10**12)])) for g in ("a", "b", None) for _ in range(rng.randrange(1, 300))] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = indexing.exact_percentiles(df, "g", "v", fractions)
    assert "percentile" not in _plan(found)
    got = {(r["g"], r["fraction"]): (r["nearest_rank"], r["linear"]) for r in found.collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        vs = sorted(v for h, v in rows if h == g and v is not None)
        for f in fractions:
            want[g, f] = (vs[round((len(vs) - 1) * f)], pytest.approx(float(np.quantile(np.array(vs, float), f)), rel=1e-12))
    assert got == want


def test_candidates_double_until_enough(spark):
    rng = random.Random(4)
    rows = [(g, t, w) for g in range(30) for t in range(rng.randrange(1, 40)) for w in [rng.random() ** 3]]
    total = {g: sum(w for h, _, w in rows if h == g) for g in range(30)}
    rows = [(g, t, w / total[g]) for g, t, w in rows]
    for top_p in (0.3, 0.8, 0.999, 1.0):
        k, kept = scoring.candidates(spark.createDataFrame(rows, "g int, t int, p double"), "g", "p", "t", top_p)
        want_k, by = 2, {g: sorted(((p, -t) for h, t, p in rows if h == g), reverse=True) for g in range(30)}
        while top_p < 1 and any(len(x) > want_k and sum(p for p, _ in x[:want_k]) < top_p for x in by.values()):
            want_k *= 2
        want = {(g, -t) for g, x in by.items() for i, (_, t) in enumerate(x[:want_k]) if top_p >= 1 or sum(p for p, _ in x[:i]) <= top_p}
        assert k == want_k and {(r["g"], r["t"]) for r in kept.collect()} == want


def test_gamma_tail_in_the_jvm(spark):
    cases = [(1.0, 1.0), (0.5, 2.0), (3.0, 0.0), (0.01, 1e-5), (1e6, 1e6), (1e6, 1.002e6), (2.5, 400.0), (1219.5, 1707.3), (5e4, 4.9e4), (12.0, 13.0), (7.0, 1e-300)]
    rows = spark.createDataFrame(cases, "a double, x double")
    found = rows.select("a", "x", stats.gamma_q(F.col("a"), F.col("x")).alias("q"))
    assert "Python" not in _plan(found)
    sql.register(spark)
    rows.createOrReplaceTempView("gamma_cases")
    for got in (found.collect(), spark.sql("SELECT a, x, gamma_q(a, x) AS q FROM gamma_cases").collect()):
        for r in got:
            assert r["q"] == pytest.approx(stats.upper_gamma(r["a"], r["x"]), rel=1e-7, abs=1e-12), r
    assert spark.sql("SELECT gamma_q(NULL, 1)").first()[0] is None


def test_sql_functions(spark):
    sql.register(spark)
    rng = random.Random(6)
    rows = [(-1, 0, 0), (0, 0, 0), *((rng.randrange(-1, 200000), rng.randrange(200000), rng.randrange(200000)) for _ in range(300))]
    df = spark.createDataFrame(rows, "prev long, cur long, token long")
    key = keyed_hash.HashKey()
    df = keyed_hash.with_hash(df, "prev", "cur", "token", key).withColumn("hit", keyed_hash.in_set(F.col("x"), key))
    df.createOrReplaceTempView("grams_of_test")
    assert spark.sql(f"SELECT count(*) FROM grams_of_test WHERE x = keyed_hash(prev, cur, token, {key.seed}) AND hit = green(prev, cur, token, {key.seed})").first()[0] == len(rows)
    answers = spark.createDataFrame([("so \\boxed{b}",), ("the answer is (C)",), ("nothing",), (None,)], "a string")
    answers.createOrReplaceTempView("answers_of_test")
    assert [r[0] for r in spark.sql("SELECT last_choice(a) FROM answers_of_test").collect()] == [r[0] for r in answers.select(text.choice(F.col("a"))).collect()] == ["B", "C", None, None]
    got = spark.sql("SELECT g.* FROM (SELECT array(1L, 2L, 3L, 4L, 5L, 6L) AS t), LATERAL ngrams(t, 2) AS g").collect()
    assert [tuple(r) for r in got] == [(3, [2, 3], 4), (4, [3, 4], 5), (5, [4, 5], 6)]


def test_ngram_counts_of_a_long_text(spark):
    rng = random.Random(7)
    ids = [rng.randrange(50) for _ in range(20000)]
    df = spark.createDataFrame([(1, ids), (2, [1, 2, 3, 4]), (3, [5] * 9)], "id long, tokens array<bigint>")
    tokens.ngram_counts(df, 3).collect()
    began = time.perf_counter()
    got = {r["id"]: (r["n"], r["contexts"], r["pairs"]) for r in tokens.ngram_counts(df, 3).collect()}
    assert time.perf_counter() - began < 3
    grams = lambda k: len({tuple(ids[i - 3 : i - 3 + k]) for i in range(4, len(ids))})
    assert got == {1: (19996, grams(3), grams(4)), 3: (5, 1, 1)}


def test_packed_order(spark):
    rows = [(k, a, b, v) for v, (k, a, b) in enumerate((i % 5, (i * 7919) % 11 - 5, (i * 31) % 13 - 6) for i in range(400))] + [(0, None, 3, -1), (1, -6, None, -2)]
    for kinds in ("long", "int"):
        df = spark.createDataFrame(rows, f"k int, a long, b {'int' if kinds == 'int' else 'long'}, v int")
        found = tokens.first_occurrence(df, ["k"], ["a", "b"], ["v"])
        assert ("SortAggregate" in _plan(found)) == (kinds == "long")  # two longs do not fit in 38 digits
        low = lambda x: -(10**9) if x is None else x
        least = {k: min((low(a), low(b)) for h, a, b, _ in rows if h == k) for k in range(5)}
        by_v = {v: (low(a), low(b)) for _, a, b, v in rows}
        assert {r["k"]: by_v[r["v"]] for r in found.collect()} == least


# --- pairs ---------------------------------------------------------------------------------------------------------


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "idx long, prompt_sha string, solution string, response string")


def test_paired_report(spark):
    left = [(i, f"p{i}", "s" if i % 2 else None, f"r{i}") for i in range(6)]
    right = [(i, f"p{i}", "s", None if i == 3 else f"q{i}") for i in range(6)]
    of = lambda a, b, prefix=False: pairs.paired_report(_corpus(spark, a), _corpus(spark, b), prefix)
    row = of(left, right).first()
    assert row["problem"] is None and row["different_responses"] == 6
    assert row["prompts_sha256"] == hashlib.sha256("\0".join(f"p{i}" for i in range(6)).encode()).hexdigest()
    assert of(left, right[:2], True).first()["problem"] is None
    assert of(left, right[:2]).first()["problem"] == "row_count_mismatch"
    assert of(left[:2], right, True).first()["problem"] == of(left, [], True).first()["problem"] == "invalid_prefix_sizes"
    assert of(left, [(i + 1, *r) for i, *r in right]).first()["problem"] == "index_mismatch"
    assert of(left, [right[0], right[4]], True).first()["problem"] == "index_mismatch"
    changed = of(left, [*right[:4], (4, "other", "s", "x"), (5, None, "s", "x")]).first()
    assert (changed["problem"], changed["prompt_mismatches"], changed["first_prompt_mismatch"]) == ("prompt_mismatches", 2, 4)
    assert of(left, [*right[:5], (5, "p5", "t", "x")]).first()["problem"] == "solution_mismatches"
    assert of(left, left).first()["problem"] == "identical_responses"
    with pytest.raises(ValueError, match="row_count_mismatch: left_rows 6, right_rows 1"):
        pairs.require_paired(of(left, right[:1]))


def test_digest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)
    sha = lambda xs: hashlib.sha256("\0".join(xs).encode()).hexdigest()
    rows = lambda n: spark.createDataFrame([(i, f"d{i}") for i in range(n)], "i long, d string").repartition(3)
    of = lambda n: pairs.ordered_digest(rows(n), "i", "d", "x").first()["x"]
    names = [f"d{i}" for i in range(10)]
    assert of(4) == sha(names[:4]) and of(0) == sha([""])
    assert of(10) == sha([sha(names[:4]), sha(names[4:8]), sha(names[8:])])


def test_report_hashes_the_whole_sequence(spark):
    n = pairs.BLOCK + 3000
    side = spark.range(n).select(F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("prompt_sha"), F.lit("s").alias("solution"), F.col("id").cast("string").alias("response"))
    got = pairs.paired_report(side, side.withColumn("response", F.lit("x")).repartition(5)).first()
    each = (hashlib.sha256(str(i).encode()).hexdigest() for i in range(n))
    assert (got["right_rows"], got["problem"]) == (n, None) and got["prompts_sha256"] == hashlib.sha256("\0".join(each).encode()).hexdigest()
    empty = pairs.sequence_digest(side.limit(0), "idx", "prompt_sha", "x").collect()
    assert [r["x"] for r in empty] == [hashlib.sha256(b"").hexdigest()]


def test_first_grams(spark):
    said = [(7, "a b a b c", "x"), (3, "A b d a", None), (None, "a b", "x"), (9, None, "x"), (-4, "q", "y")]
    ids = lambda text: [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) % 151936 for w in text.lower().split(" ")]
    for ends in ([], [(-(1 << 62), "a b e", "y"), (1 << 62, "z z z", "y")]):  # ids of so wide a range do not fit in one number
        want = {}
        for i, said_, g in sorted(said + ends, key=lambda r: (r[0] is not None, r[0] or 0)):
            t = ids(said_) if said_ else []
            for prev, cur, token in zip([-1, *t], t, t[1:]):
                first, n = want.get((g, prev, cur), (token, 0))
                want[g, prev, cur] = first, n + 1
        df = spark.createDataFrame(said + ends, "id long, t string, g string")
        got = tokens.first_grams(df, "t", ["id"], "g").collect()
        assert {(r["g"], r["prev"], r["cur"]): (r["token"], r["times"]) for r in got} == want and len(got) == len(want)
    parts = df.where("g is not null").withColumn("p", (F.col("g") == "y").cast("int") * 70000).where("abs(id) < 100 or id is null")
    plain = parts.select("*", F.col("id").alias("k"))
    got = {(r["p"], r["prev"], r["cur"], r["token"], r["times"]) for r in tokens.first_grams(plain, "t", ["k"], part="p").collect()}
    assert got == {(r["p"], r["prev"], r["cur"], r["token"], r["times"]) for r in tokens.first_grams(plain, "t", ["k"], "p").collect()} and got


def test_plans_shuffle_no_words(spark, sf_dir):
    entry = pytest.importorskip("__spark_entry__")
    plan = lambda name: _plan(entry.queries()[name](spark, sf_dir))
    assert "Exchange" not in plan("sql_ngrams") and "lambda" not in plan("sql_signal_by_source").split("Project")[1]
    aligned = plan("offset_alignment")
    assert "Window" not in aligned and "Join" not in aligned
    assert "decimal" not in plan("signal_test") and "BroadcastHashJoin" in plan("pooled_score_sums")


def test_chains_are_found_without_texts(spark):
    rows = [(1, None, "prompter", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (3, 2, "prompter", None)]
    messages = spark.createDataFrame(rows, "message_id long, parent_id long, role string, text string")
    assert [f.name for f in trees._chains(trees._keyed(messages)).schema["ids"].dataType.elementType] == ["id", "key", "role"]
    got = sorted((r["message_id"], [m["content"] for m in r["path"]]) for r in trees.message_chains(messages).collect())
    assert got == [(1, ["a"]), (2, ["a", "b"]), (2, ["a", "b"]), (3, ["a", "b", None]), (3, ["a", "b", None])]


def test_blank_contents_give_no_prompt(spark):
    df = spark.createDataFrame([([("prompter", " hi\n"), ("assistant", "yes")],), ([("user", "  ")],), ([(None, "x")],)], "m array<struct<role string, content string>>")
    got = [r[0] for r in df.select(text.chat_prompt(F.col("m"))).collect()]
    assert got == ["<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>assistant\n", "", ""]


def test_files_are_replaced(spark, tmp_path):
    path = str(tmp_path / "x.json")
    artifacts.write_json(spark, path, {"a": 1})
    artifacts.write_json(spark, path, {"a": 2})
    assert artifacts.read_json(spark, path) == {"a": 2} and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["x.json"]
    table = str(tmp_path / "t")
    for n in (3, 5):
        artifacts.write_parquet(spark.range(n), table)
        assert spark.read.parquet(table).count() == n
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t", "x.json"]


# --- streams -------------------------------------------------------------------------------------------------------


def test_first_by_order_under_any_arrival_and_a_restart(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(40), i, rng.random()) for i in range(600)]
    rng.shuffle(rows)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "k int, at long, v double"
    add = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    for part in (rows[:100], rows[100:350], rows[350:]):
        add(part)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        dedup.first_by_order(stream, ["k"], "at", ["v"], target, checkpoint).awaitTermination()  # each time from the checkpoint
    got = {r["k"]: (r["at"], r["v"]) for r in dedup.first_table(spark, stream, ["k"], "at", ["v"], target).collect()}
    want = {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, (at, v))
    assert got == want


def test_batches_are_appended_once(spark, tmp_path):
    """Killed after the write and before the checkpoint, run again: each index once; and what is pending."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema, seen = "i long, batch long", []
    stream = lambda: spark.readStream.schema("i long").option("maxFilesPerTrigger", 1).parquet(source)
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).withColumnRenamed("id", "i").coalesce(1).write.mode("append").parquet(source)

    def dies(_, number):
        if number == 2:
            raise RuntimeError("killed")

    make = lambda batch, before: (seen.append(before.count()), batch)[1]
    with pytest.raises(Exception, match="killed"):
        sink.append_batches(stream(), make, schema, target, checkpoint, wrote=dies).awaitTermination()
    done = sink.table(spark, schema, target)
    assert done.count() == 30  # the third batch is there, and not yet in the checkpoint
    rest = sink.pending(spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "i long"), done, "i").collect()
    assert len(rest) == 11
    sink.append_batches(stream(), make, schema, target, checkpoint).awaitTermination()
    assert sorted(r["i"] for r in sink.table(spark, schema, target).collect()) == list(range(40))
    assert seen == [0, 10, 20, 20, 30]


def test_tail_bound():
    assert stats.upper_gamma(1, 1) == pytest.approx(math.exp(-1))
