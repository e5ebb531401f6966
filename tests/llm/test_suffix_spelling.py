"""Operators 11 and 12 against brute force, and the rules for odd input."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import registry, spelling, suffix

SCHEMA = "doc_id long, text string"


# --- 11 repeated stretches -----------------------------------------------------------------------------------------


def test_construction_by_columns():
    rng = random.Random(1)
    for _ in range(60):
        width, length = rng.randrange(5, 15), rng.randrange(2, 6)
        lefts = [rng.randrange(0, 3) for _ in range(rng.randrange(1, 40))]
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, width - left + 1))) for left in lefts]
        runs = lambda s, left: [(j, s[j - left : j - left + length]) for j in range(left, left + len(s) - length + 1)]
        count = Counter(x for s, left in zip(strings, lefts, strict=True) for x in runs(s, left))
        want = np.zeros((len(strings), max(width - length + 1, 0)), bool)
        for i, (s, left) in enumerate(zip(strings, lefts, strict=True)):
            for x in runs(s, left):
                want[i, x[0]] = count[x] > 1
        assert (suffix.repeated_columns(strings, np.array(lefts), width, length) == want).all()


def _brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        out.append((d, len(b), [tuple(map(int, x)) for x in edges.reshape(-1, 2)], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def _found(df):
    rows = suffix.without_repeats(df).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in rows), key=repr)


@pytest.fixture(scope="module")
def passages():
    """Passages with different surroundings, some with a changed place, and what is odd."""
    rng = random.Random(5)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (150, 200, 230, 300, 500)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 400)))
        for _ in range(rng.randrange(0, 4)):
            p, k = rng.choice(shared), rng.randrange(150)
            text += (p[:k] + "#" + p[k:] if rng.random() < 0.3 else p) + "".join(rng.choice("xyzé") for _ in range(rng.randrange(0, 60)))
        rows.append((i, text))
    odd = [(None, None), (5, ""), (6, "a" * 1000), (7, "ab" * 700), (7, "ab" * 700), (8, "x" * 199), (9, "x" * 200), (10, "q" * 200), (11, "q" * 201), (None, "lorem ipsum " * 20000)]
    return rows + odd + [(200, "".join(rng.choice("stuvw") for _ in range(300_000)))]


@pytest.mark.parametrize("most", [4000, 6])
def test_repeated_stretches(spark, passages, most, monkeypatch):
    monkeypatch.setattr(suffix, "MOST", most)  # 6: nearly all passages are subdivided
    df = spark.createDataFrame(passages, SCHEMA).withColumns({"row": F.lit(1), "N_BYTES": F.lit("x"), "h": F.lit(None).cast("int"), "kept": F.lit(2)})
    assert _found(df) == _brute(passages)


def test_repeated_stretches_of_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert _found(df) == _brute([(r["doc_id"], r["text"]) for r in df.collect()])
    rows = registry.op11_suffix_array_dedup(spark, sf_dir)
    assert rows.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]


def test_no_stretches(spark):
    assert suffix.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


# --- 12 spelling variants ------------------------------------------------------------------------------------------


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts):
    near = defaultdict(list)
    for a in counts:
        near[a] = [b for b in counts if _near(a, b)]
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out)


@pytest.mark.parametrize("most", [48, 3])
def test_near_words(spark, most, monkeypatch):
    monkeypatch.setattr(spelling, "MOST", most)  # 3: blocks are subdivided down to single places
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 10))) for _ in range(150)} | {"straße", "strasse", "naïveté", "naiveté", "naïvetés", "a" * 300, "a" * 299, "𝒂bcdef", "𝒃bcdef"}
    counts = {w: rng.choice([5, 6, 30, 200, 1200]) for w in sorted(words)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got)) == _variants(counts)


def test_words_of_texts(spark):
    texts = ["Alphabet alphabet ALPHABET alphabét, alphabet's", "alphabets " * 7, None, "", "×÷×÷×÷ " * 5, "short " * 9, "alphabet " * 600]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(3, texts[0])] * 5
    counts = Counter()
    for d, t in rows:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    want = _variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit(1), "N": F.lit(2), "id": F.lit(None).cast("int")})
    assert sorted(map(tuple, spelling.grouped(df).collect())) == want
    assert any(r[1] for r in want)
    assert spelling.grouped(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.grouped(df).dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
