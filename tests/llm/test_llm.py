"""The ten corpus operators and the pipeline against brute force, round trips and held-out cases."""

import base64
import hashlib
import html as entities
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyweave.llm import blocks, bpe, chat, common, embeddings, html, lines, lm, packing, quality, registry, simhash, tokencount
from tallyweave.llm.components import components

JSON_PATH, RANKS_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls in every column, empty, white and long texts, repeated rows and repeated ids.
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 3), (None, "a b c d", "en", "s", 7), (4, "word " * 30000, "en", "s", 150000), (5, "one two three four", "en", "s", 18),
    (5, "one two three four", "en", "s", 18), (5, "five six", "de", "t", 8), (6, "one two three four", "en", "s", 18), (7, "é日本🙂 <|endoftext|>  x\r\n y", None, "s", 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"length": F.lit(1), "kept": F.lit("x"), "N_words": F.lit(2), "fp": F.lit(3), "row": F.lit(4), "component_id": F.lit(5)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Union:
    def __init__(self):
        self.root = {}

    def find(self, x):
        while self.root.setdefault(x, x) != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3)] + [(400, i) for i in range(401, 460)] + [(i, i + 1) for i in range(500, 560)]
    want = Union()
    for a, b in edges:
        if a is not None:
            want.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == want.find(x) for x in list(want.root))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 packing ---------------------------------------------------------------------------------------------------


def _check_packing(rows, want):
    """Pieces as the contract has them, and places without overlap or gap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sorted(p) for d, p in by_doc.items()} == {d: sorted(p) for d, p in want.items()}
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence)


def _pieces(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON_PATH)
    want = defaultdict(list)
    for r in rows:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"]].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return want


def test_packing(spark, docs, odd, none):
    for df in (docs, odd):
        want = _pieces(df.select("doc_id", "text").collect())
        n = _check_packing(packing.packed(df, JSON_PATH, public_tokenizers.PATTERN, added=True).collect(), want)
        total = sum(x[2] for v in want.values() for x in v)
        assert n <= 1.01 * total / 1024 + 2
    assert packing.packed(none, JSON_PATH, public_tokenizers.PATTERN).count() == 0


def test_packing_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["see <|endoftext|> here", "<|endoftext|><|endoftext|>", " <|endoftext|>\n x", "a<|endoftext|>b  ", "<|endoftext| >", "é  <|endoftext|>  日本", ""]
    t = Tokenizer.from_file(JSON_PATH)
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    assert want[0] == [3826, 220, 50256, 994, 2]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for packed in (registry.op1_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))):
        got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packed.collect()}
        assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


@pytest.mark.parametrize("seed", range(5))
def test_local_search(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.randint(20, 70) for _ in range(60))
    first = packing.best_fit(dict(histogram), 100)
    last = packing.local_search(first, 100)
    items = Counter()
    for pattern, n in last.items():
        assert sum(pattern) <= 100
        for x in pattern:
            items[x] += n
    assert items == histogram and sum(last.values()) <= sum(first.values())


def test_local_search_empties_bins():
    bins = {(60, 30): 1, (50, 40): 1, (10, 10): 1}
    assert sum(packing.local_search(bins, 100).values()) == 2


def test_ids_that_do_not_follow_merges():
    with pytest.raises(ValueError, match="merges"):
        packing.byte_level_ranks(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": ["a b", "b a"]}}))


# --- 2 lines -----------------------------------------------------------------------------------------------------


def _distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def _norm(line):
    return " ".join(WORDS.findall(line)).lower()


def _line_blocks(norm):
    """The blocks of a line, written out."""
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    one = lambda x: signed(xxhash.xxh64_intdigest(x, 42))
    ws = norm.split(" ")
    if len(ws) >= lines.FEW_WORDS:
        h = [one(w) for w in ws]
        found = sorted(signed((x << 1) ^ y) for x, y in zip(h, h[1:]))
    else:
        found = sorted({one(norm[i : i + lines.RUN]) for i in range(max(1, len(norm) - lines.RUN + 1))})
    out = set()
    for j in range(lines.BLOCKS):
        at = sum(x < (j << 64) // lines.BLOCKS - (1 << 63) for x in found)
        x, y, z = (found[(at + i) % len(found)] for i in range(3))
        out.add((x & y) | (y & z) | (x & z))
    return out


def _near_lines(a, b):
    """The links' rule, by plain distances."""
    share = lambda x, y, most: _distance(x, y) <= most * max(len(x), len(y)) + 1e-9
    x, y = a.split(" "), b.split(" ")
    if min(len(x), len(y)) < lines.FEW_WORDS:
        return share(a, b, 0.2)
    if share(x, y, 0.2):
        return True
    return max(len(a), len(b)) <= lines.LONG and share(x, y, 0.5) and share(a, b, 0.2)


def _line_groups(rows, candidate, least=lines.LEAST_WORDS):
    """Places that go, by brute force over all pairs of distinct lines that ``candidate`` lets through, and the linked pairs."""
    firsts = {}
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            n = _norm(line)
            if n and len(n.split(" ")) >= least:
                firsts[n] = min(firsts.get(n, (doc, i)), (doc, i))
    groups, names, linked = Union(), list(firsts), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if min(len(a), len(b)) >= 0.7 * max(len(a), len(b)) and candidate(a, b) and _near_lines(a, b):
                groups.join(a, b)
                linked.append((a, b))
    best = {}
    for n in names:
        r = groups.find(n)
        best[r] = min(best.get(r, firsts[n]), firsts[n])
    gone = defaultdict(set)
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            n = _norm(line)
            if n in firsts and best[groups.find(n)] != (doc, i):
                gone[doc].add(i)
    return gone, linked


def _by_blocks(rows):
    blocks = {n: _line_blocks(n) for _, text in rows for line in (text or "").split("\n") if (n := _norm(line))}
    return lambda a, b: bool(blocks[a] & blocks[b])


def test_lines(spark, docs):
    rng = random.Random(5)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 40))) for _ in range(25)]

    def altered(s):
        w = s.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["xx", "Changed", "zzz"])
        return rng.choice(["", "  "]) + rng.choice([" ", "  "]).join(w)

    rows = [(i, "\n".join(altered(rng.choice(base)) if rng.random() < 0.8 else rng.choice(["", "one", "a | b | c | d"]) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    for found in (rows, [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 80 and n_chars < 4000").collect()]):
        gone, _ = _line_groups(found, _by_blocks(found))
        out = lines.deduplicated(spark.createDataFrame(found, "doc_id long, text string")).collect()
        for r in out:
            text = dict(found)[r["doc_id"]]
            left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[r["doc_id"]]) if gone[r["doc_id"]] else text
            assert (r["text"], r["n_removed"]) == (left, len(gone[r["doc_id"]]))
    assert sum(map(len, gone.values())) > 0


def test_lines_odd(spark, odd, none):
    out = lines.deduplicated(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    rows = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect())
    assert rows[5, "one two three four", 0] == 2 and rows[6, "", 1] == 1 and rows[1, None, 0] == 1 and rows[None, "a b c d", 0] == 1
    left = lines.without_repeats(odd)
    assert left.columns == odd.columns and left.where("doc_id = 6").count() == 0 and left.where("doc_id in (1, 2, 3)").count() == 3
    assert lines.deduplicated(none).count() == 0


def test_long_lines_compare_by_words(spark):
    words = [f"w{i}x" for i in range(900)]
    other = words[:100] + ["changed"] + words[101:]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in lines.deduplicated(rows).collect()} == {1: 0, 2: 1, 3: 0}


def test_lines_recall_against_all_pairs():
    """Of all pairs of similar lines, without any blocks, at least nine in ten are candidates."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "be", "co", "da", "el", "fi", "go", "hu"]) for _ in range(rng.choice((1, 1, 2, 3))))
    every = caught = 0
    for _ in range(150):
        base = [word() for _ in range(rng.choice((6, 10, 20, 40, 80)))]
        other = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 8))):
            rng.choice((lambda i: other.__setitem__(i, word()), lambda i: other.insert(i, word()), lambda i: len(other) > 3 and other.pop(i)))(rng.randrange(len(other)))
        a, b = " ".join(base), " ".join(other)
        if a != b and _near_lines(a, b):
            every += 1
            caught += bool(_line_blocks(a) & _line_blocks(b))
    assert every > 100 and caught >= 0.9 * every


def test_lines_of_documents_recall(spark, docs):
    found = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 40 and n_chars < 3000").collect()]
    _, all_pairs = _line_groups(found, lambda a, b: True)
    candidate = _by_blocks(found)
    assert sum(candidate(a, b) for a, b in all_pairs) >= 0.9 * len(all_pairs)


def test_short_lines_and_spread_edits(spark):
    rows = [(i, f"Read more\n{x}\n今日は天気がいいです\nword") for i, x in enumerate(["first document here today", "quite another text stands there", "nothing like the others at all"])]
    left = {r["doc_id"]: r["text"] for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {0: rows[0][1], 1: "quite another text stands there", 2: "nothing like the others at all"}
    a = "abcdefgh " * 20
    pairs = [(a, a.replace("abcdefgh abcdefgh", "abcdefgh abcdefgx")), (a, "zyxwvuts " * 20), ("one two three", "one two threx"), ("one two three", "xne twx thrxx")]
    near = lines.edit_similar(F.col("a"), F.col("b"), lines.coded(F.col("a")), lines.coded(F.col("b")))
    assert [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(near).collect()] == [True, False, True, False]


def _linked_lines(spark, rows):
    """Links of distinct lines given as (node, blocks, norm)."""
    names = ", ".join(f"b{j} long" for j in range(lines.BLOCKS))
    made = spark.createDataFrame([(str(n).encode(), n, len(x), len(x.split(" ")), x, *bs) for n, bs, x in rows], f"key binary, node long, chars int, n_words int, norm string, {names}")
    return {tuple(sorted((int(bytes(r["a"])), int(bytes(r["b"]))))) for r in lines.links(made.drop("norm"), made.select("key", "norm")).collect()}


def test_line_between_two_pivots_links_both(spark):
    said = ["bbba aaaa aaaa aaaa", "aaaa aaaa aaaa aaaa", "aaaa aaaa aaaa accc"]
    assert _linked_lines(spark, [(i + 1, [7] * 6, x) for i, x in enumerate(said)]) == {(1, 2), (2, 3)}


def test_lines_of_a_hot_block_meet_in_two(spark):
    rng = random.Random(4)
    said = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(6)) for _ in range(30)]
    rows = [(2 * i, [7, 8, 100 + i, 200 + i, 300 + i, 400 + i], x) for i, x in enumerate(said)]
    rows += [(2 * i + 1, [7, 8, 100 + i, 500 + i, 600 + i, 700 + i], x[:-1] + "z") for i, x in enumerate(said)]
    assert {(2 * i, 2 * i + 1) for i in range(30)} <= _linked_lines(spark, rows)


def test_lines_that_share_one_hot_block_only(spark, monkeypatch):
    monkeypatch.setattr(blocks, "DEAL", 7)
    rng = random.Random(6)
    said = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4 if i % 2 else 9)) + " read on here" for i in range(30)]
    own = itertools.count(100)
    rows = [(2 * i + k, [7, *(next(own) for _ in range(5))], x[: len(x) - k] + "z" * k) for i, x in enumerate(said) for k in range(2)]
    assert _linked_lines(spark, rows) == {(2 * i, 2 * i + 1) for i in range(30)}


def test_pairs_of_a_hot_block_are_judged_where_they_meet(spark, monkeypatch):
    """Lines that share a long passage, short of being similar: all of two hot blocks' pairs are compared, only links are written, each once."""
    monkeypatch.setattr(blocks, "MEET", 7)
    rng = random.Random(9)
    made, judged = blocks._judged, []
    monkeypatch.setattr(blocks, "_judged", lambda *x: judged.append(made(*x)) or judged[-1])
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage, own = " ".join(word() for _ in range(12)), itertools.count(100)
    said = [f"{passage} {' '.join(word() for _ in range(8))}" for _ in range(30)]
    said[29] = " ".join(word() * 20 for _ in range(20))  # over LONG characters
    near = [x[:-1] + "z" if i % 2 else " ".join(w[:-1] + "z" if k % 3 == 0 else w for k, w in enumerate(x.split(" "))) for i, x in enumerate(said)]
    rows = [(2 * i + k, [7, 8, *(next(own) for _ in range(4))], x[i]) for i in range(30) for k, x in enumerate((said, near))]
    assert _linked_lines(spark, rows) == {(2 * i, 2 * i + 1) for i in range(30)}
    assert len(judged) == 1 and judged[0].count() == judged[0].select("a", "b").distinct().count() <= 30


def test_lines_of_all_blocks_are_linked_in_few_jobs(spark, monkeypatch):
    """Groups by brute force over all pairs that share a block: large, small and double ones, links by words and by characters, short and long lines."""
    monkeypatch.setattr(blocks, "MEET", 9)
    rng, own = random.Random(12), itertools.count(100)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, said = [word() for _ in range(9)], {}
    for i in range(24):
        base = [*passage, *(word() for _ in range(rng.choice((3, 9, 30, 340))))] if i % 4 else [word() for _ in range(rng.choice((3, 6, 7)))]
        for every in rng.choice(((3,), (3, 50), (4, 9), (1, 2))):
            said[" ".join(base)] = said[" ".join(w[:-1] + "z" if k % every == 0 else w for k, w in enumerate(base))] = i
    rows = [(k + 1, [rng.choice((7, next(own))), 20 + i % 5, 40 + i, *(next(own) for _ in range(3))], x) for k, (x, i) in enumerate(said.items())]
    want, got = Union(), Union()
    for (a, p, x), (b, q, y) in itertools.combinations(rows, 2):
        if set(p) & set(q) and _near_lines(x, y):
            want.join(a, b)
    spark.sparkContext.setJobGroup("few jobs", "")
    found = _linked_lines(spark, rows)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for a, b in found:
        got.join(a, b)
    assert [got.find(k) for k, *_ in rows] == [want.find(k) for k, *_ in rows]
    near = {k: (p, x) for k, p, x in rows}
    assert all(set(near[a][0]) & set(near[b][0]) and _near_lines(near[a][1], near[b][1]) for a, b in found)
    assert len(jobs) <= 130


def test_documents_that_share_one_hot_part_only(spark):
    rng = random.Random(7)
    sets = [[rng.randrange(1 << 60) for _ in range(20)] for _ in range(25)]
    own = {2 * i + k: set([1, 2, 3, *x][: 23 - k]) for i, x in enumerate(sets) for k in range(2)}
    members = spark.createDataFrame([(5, i, len(x)) for i, x in own.items()], "block long, node long, n int")
    texts = spark.createDataFrame([(i, sorted(x)) for i, x in own.items()], "node long, own array<long>")
    near = lambda least, most: least >= most * 0.8 - 1e-9

    def verified(pairs):
        found = [(r["a"], r["b"]) for r in pairs.collect() if len(own[r["a"]] & own[r["b"]]) >= 0.8 * len(own[r["a"]] | own[r["b"]])]
        return spark.createDataFrame(found, "a long, b long")

    finer = lambda nodes: simhash._prefixes(texts.join(nodes, "node", "left_semi"), 0.8)
    got = blocks.block_links(members, verified, near, simhash.PARTS, finer).collect()
    assert {tuple(sorted((r["a"], r["b"]))) for r in got} == {(2 * i, 2 * i + 1) for i in range(25)}


def test_lines_of_a_very_long_document(spark):
    rng, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    own = [" ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(10)) for _ in range(8000)]
    df = spark.createDataFrame([(1, "\n".join(own + own)), (2, own[0]), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.deduplicated(df).collect()}
    assert got == {1: ("\n".join(own), 16000, 8000), 2: ("", 1, 1), 3: (None, 0, 0)}


# --- 3 SimHash -----------------------------------------------------------------------------------------------------


def test_simhash(docs, odd, none):
    for df in (docs, odd):
        prints = {}
        rows = df.select("doc_id", "text").collect()
        for r in rows:
            found = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
            shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
            h = Counter(xxhash.xxh64_intdigest(s, 42) for s in shingles)
            prints[r["doc_id"], r["text"]] = sum(1 << i for i in range(64) if 2 * sum(n for x, n in h.items() if x >> i & 1) > len(shingles))
        groups = Union()
        keys = [k for k in prints if k[0] is not None]
        for i, a in enumerate(keys):
            groups.find(a[0])
            for b in keys[i + 1 :]:
                if bin(prints[a] ^ prints[b]).count("1") <= 2:
                    groups.join(a[0], b[0])
        got = simhash.near_duplicates(df).collect()
        assert len(got) == len(rows)
        assert Counter(r["fingerprint"] for r in got) == Counter(f"{prints[r['doc_id'], r['text']]:016x}" for r in rows)
        assert all(r["component_id"] == (None if r["doc_id"] is None else groups.find(r["doc_id"])) for r in got if r["doc_id"] != 5)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(odd).columns == odd.columns


def _by_shingles(docs):
    """Ids that stay: least of each group by all pairs' 5-word similarity and fingerprints."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets, prints, union = {}, {}, Union()
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {b" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
        prints[i] = simhash.fingerprint(text, 5)
    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if (prints[a] ^ prints[b]).bit_count() <= 2 or both >= 0.8 * (len(sets[a] | sets[b]) or math.inf):
            union.join(a, b)
    return {i for i in texts if min(j for j in texts if union.find(j) == union.find(i)) == i}


def test_copies_with_edits_go(spark):
    rng, rows, near = random.Random(4), [], []
    for i in range(60):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        rows.append((2 * i, " ".join(own)))
        for j in rng.sample(range(len(own)), max(1, len(own) * rng.randrange(1, 4) // 100)):
            own[j] = "changed"
        rows.append((2 * i + 1, " ".join(own)))
    rows += [(1000 + i, " ".join(f"p{k}" for k in range(100)) + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(90))) for i in range(40)]  # a passage that many share
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, got = _by_shingles(docs), {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert got >= want and len(got - want) <= 2 and len(want) < 120
    assert {r[0] for r in rows if r[0] >= 1000} <= got


def test_gray_index_and_hot_nodes(spark, monkeypatch):
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = list({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for c in centre for _ in range(150)} | {rng.getrandbits(64) for _ in range(60)})
    a, b = simhash.GrayIndex(np.array(fps, np.uint64)).within(2)
    pairs = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 2}
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} == pairs
    monkeypatch.setattr(simhash, "MOST", 40)
    classes = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    want = Union()
    for i, j in pairs:
        want.join(i, j)
    got = {r["node"]: r["component"] for r in components(simhash.links(classes)).collect()}
    assert all(got.get(i, i) == want.find(i) for i in range(len(fps)))


# --- 4 embeddings ----------------------------------------------------------------------------------------------------


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 20)
    monkeypatch.setattr(embeddings, "LIST", 30)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base[rng.integers(0, 40, 400)] + rng.normal(size=(400, 16)) * rng.uniform(0, 0.4, (400, 1)), base, base])
    label = rng.integers(0, 2, len(x))
    rows = [(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, label))]
    strange = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [math.nan] * 16, 1), (1003, [1.0, None], 0), (1004, [1.0, 2.0], 0), (1005, [2.0, 4.0], 0), (1006, [1.0, 2.0], None), (None, [1.0, 2.0], 0), (1007, [], 0)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + strange, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    groups = Union()
    for i, j in zip(*np.nonzero(near)):
        groups.join(int(i), int(j))
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, groups.find(i), groups.find(i) == i)
    assert [got[i]["n_links"] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, None, 1007)] == [0, 0, 0, 0, 1, 1, 0, 0, 0]
    assert got[1005]["component_id"] == 1004 and got[1006]["kept"]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- 5 chat ------------------------------------------------------------------------------------------------------------


def test_chat_reads_back(spark, sf_dir):
    got = {r["conv_id"]: r for r in registry.op5_chat_formatting(spark, sf_dir).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-7] = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]
    assert set(got) == set(turns)
    for conv, ts in turns.items():
        said = "".join(x for role, x in ts if role == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(ts), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_windows(spark):
    rng = random.Random(2)
    rows = [(1, t, "system" if t == 0 else ("user", "assistant")[t % 2 == 0], "w " * rng.choice([1, 10, 60])) for t in range(40)]
    rows += [(2, 0, None, None), (2, 0, "user", "a"), (2, None, "assistant", "b"), (None, 0, "assistant", "lone"), (3, 0, "assistant", "z " * 500)]
    found = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), RANKS_PATH, public_tokenizers.PATTERN, 200, 80).collect()
    one = sorted((r for r in found if r["conv_id"] == 1), key=lambda r: r["window"])
    assert len(one) > 3 and all(r["n_tokens"] <= 200 and not r["over_budget"] for r in one)
    assert all(chat.parsed(r["text"])[0][0] == "system" for r in one) and [r["first_turn"] for r in one] == [sum(x["n_turns"] for x in one[:i]) for i in range(len(one))]
    assert any(r["n_context"] > 1 for r in one)
    assert [r["over_budget"] for r in found if r["conv_id"] == 3] == [True]
    assert sum(r["n_turns"] for r in found if r["conv_id"] == 2) == 3
    assert chat.read_back(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), RANKS_PATH, public_tokenizers.PATTERN)).count() == 0


def test_chat_escapes():
    rng = random.Random(3)
    for _ in range(2000):
        said = "".join(rng.choice(["\\", "#", "<", "/turn>", "</turn>\n", ": ", "h", "l", "###", "\n"]) for _ in range(rng.randrange(12)))
        role = "".join(rng.choice(["\\", "#", "</turn>\n", ": ", ":", "c"]) for _ in range(rng.randrange(5)))
        assert chat.parsed(chat.rendered(role, said)[0]) == [(role, said)]


# --- 6 language model ------------------------------------------------------------------------------------------------------


def test_lm(spark, docs, odd, none):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        split = lambda t: [w.encode() for w in WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
        counts = Counter()
        for r in rows:
            if not held(r["doc_id"]):
                counts.update(split(r["text"]))
                counts[b"\n"] += 1
        n, v = sum(counts.values()), len(counts)
        want = Counter()
        for r in rows:
            ws = [*split(r["text"]), b"\n"]
            base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
            want[r["doc_id"], held(r["doc_id"]), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 4)] += 1
        got = lm.scored(df).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.scored(none).count() == 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    got = lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_lm_spelling_is_a_distribution():
    words = [bytes([a, b]) for a in b"abc" for b in b"abc"]
    tables = [np.zeros((2, s)) for s in lm.SIZES]
    lm.filled(tables, words, np.arange(1, 10))
    mixer = lm.Mixer(tables)
    mixer.learn(words * 5)
    mixer.freeze()
    every = [bytes([a]) for a in range(256) if a != 0x20]
    first = lm.Spelled(every)
    assert 0 < sum(10.0 ** mixer.score(every)) <= 1 + 1e-9 and len(first.starts) == 255
    assert sum(10.0 ** mixer.score(words)) > 0.9


# --- 7 quality -----------------------------------------------------------------------------------------------------------------


def test_rare_words_with_their_counts_are_a_distribution():
    spelling, counts = np.log10([0.4, 0.3, 0.2, 0.1]), np.array([5, 1, 1, 0])
    got = lm.Seldom(3, 7, 2, 0).score(spelling, counts)
    assert abs((10.0**got).sum() - 1) < 1e-9 and got[0] > got[1] > got[3]
    assert np.allclose(lm.Seldom(0, 0, 0, 0).score(spelling, np.zeros(4)), spelling)
    assert np.isfinite(lm.Seldom(3, 7, 2, 0).score(np.array([-5000.0, -5000.0]), np.array([0, 1]))).all()


def test_quality_counts(docs, odd, none):
    for df in (docs, odd.drop("N_words")):
        for r in quality.judged(df).collect():
            t = r["text"] or ""
            ws = WORDS.findall(t)
            windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
            again = {j for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
            said = [x for x in t.split("\n") if WORDS.search(x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(said) - len(set(said)), len(again))
            assert r["base_failed"] == (len(ws) < 10 or 100 * len(again) > 20 * len(ws)) and not (r["kept"] and r["base_failed"])
    assert quality.judged(none).count() == 0
    assert quality.kept_only(odd).columns == odd.columns


def test_quality_keeps_good_and_drops_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judged(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in got}
    assert share[1] == 1.0 and share[0] < 0.2


def test_quality_of_languages_without_and_beyond_references(spark):
    rng, letters = random.Random(11), "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:02}": ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(26)] for i in range(35)}
    said = lambda lang: " ".join(rng.choice(own[lang]) for _ in range(130))
    many = [lang for lang in own if lang != "l34"]  # l34 is too rare, and l33 is the 34th
    rows = [(lang, said(lang)) for lang in many for _ in range(20 + (lang != "l33"))] + [("l34", said("l34")) for _ in range(7)]
    rows.append(("l00", " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(130))))
    df = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")
    refs = {r["lang"]: r for r in quality.references(df)}
    assert set(refs) == set(many) and {len(r["words"]) for r in refs.values()} <= {23, 24}
    got = quality.judged(df, refs=[refs[x] for x in ("l00", "l01", "l33")]).collect()
    got = [r for r in got if r["lang"] in ("l00", "l33", "l34") and not r["base_failed"]]
    assert len(got) > 45
    for r in got:
        assert r["kept"] == (r["doc_id"] != len(rows) - 1)
        assert r["lang"] != "l34" or r["d_words"] > quality.MOST_WORDS


def test_quality_references_do_not_hang_on_the_size_of_the_corpus(spark):
    rows = [("a b c", "x")] * 5 + [("d e f", "y")] * 19 + [("g h", "z")] * 4 + [("k l", None)] * 4
    df = spark.createDataFrame(rows, "text string, lang string")
    more = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("n")
    rare = more.unionAll(spark.createDataFrame([("m n", "w")] * 9, "text string, lang string"))
    one = quality.references(df)
    assert {r["lang"] for r in one} == {"x", "y", "z", ""} and quality.references(more) == one
    assert quality.references(rare) == one  # 9 of 969 are less than one in 100


def test_js_distance(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.4, 0.0, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    got = spark.createDataFrame([(p,)], "p array<double>").select(quality.js_distance(F.col("p"), q)).first()[0]
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


# --- 8 pages ----------------------------------------------------------------------------------------------------------------------


def _article(source):
    found = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: _article(r["html"]) for r in pages.collect()}
    for r in html.extracted(pages).collect():
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])


def test_pages_held_out_layouts():
    model = html.fitted()
    right = good = total = 0
    for i in range(120):
        nodes, x, y = html.labelled(999_000_000 + i)
        labels = html.decode(nodes, model.score(x))
        number = {id(n): k for k, n in enumerate(nodes)}
        assert all(labels[number[id(n.up)]] for n, k in zip(nodes, labels) if k and id(n.up) in number)
        leaves = [(k, bool(t)) for n, k, t in zip(nodes, labels, y) if n.tag == "#text"]
        right += sum(k and t for k, t in leaves)
        good += sum(k for k, _ in leaves)
        total += sum(t for _, t in leaves)
    assert right / good > 0.97 and right / total > 0.97


@pytest.mark.parametrize("source", [None, "", "<", "<p>hi", "</div></p>", "<b><i></b>x</i>", "<table><tr><td>a<tr><td>b", "<!-- open", "<script>never closed", "<a b='", "x" * 100000, "<div>" * 3000 + "deep"])
def test_pages_malformed(source):
    assert isinstance(html.main_texts([source], html.fitted())[0], str)


def test_pages_odd(spark):
    rows = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (2, "u", "<article><p>Some words, here.</p></article>", 3)], "page_id long, url string, html string, text int")
    assert sorted(((r["page_id"] or 0), r["text"]) for r in html.extracted(rows).collect()) == [(0, ""), (1, ""), (2, "Some words, here.")]
    assert html.extracted(rows.limit(0)).count() == 0


# --- 9 counts, 10 BPE ----------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, docs, odd, none):
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    exact = Tokenizer(models.Unigram([(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())], 0, True))
    count = lambda t: len(exact.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
    for df in (docs.where("n_chars < 3000"), odd.where("doc_id is null or doc_id != 4")):
        texts = {(r["doc_id"], count(r["text"] or "")) for r in df.collect()}
        assert {(r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(df, path).collect()} == texts
    assert tokencount.token_counts(none, path).count() == 0
    counter = tokencount.UnigramCounter(*tokencount.load_pieces(path))
    rng = random.Random(7)
    for _ in range(1500):
        t = "".join(rng.choice(["the", " ", "  ", "\n", "é", "日", "🙂", "ing", "x", "q ", ".", "er", "a", "▁", "\t"]) for _ in range(rng.randrange(40)))
        assert counter.text(t)[0] == count(t)


def test_ties_keep_the_longest_last_piece():
    counter = tokencount.UnigramCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)], False, -2.0)
    assert counter.count("▁ab") == (2, -3.0)


def test_byte_bpe(spark, docs, odd, none):
    ranks = bpe.load_ranks(RANKS_PATH)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs.where("n_chars < 3000"), odd):
        want = set()
        for r in df.collect():
            ids = exact.encode_ordinary(r["text"] or "")
            want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        assert {tuple(r) for r in bpe.round_trip(df, RANKS_PATH, public_tokenizers.PATTERN).collect()} == want
    assert bpe.round_trip(none, RANKS_PATH, public_tokenizers.PATTERN).count() == 0
    coder, rng = bpe.coder_of(ranks, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(" \n\t'sé日本🙂aAbB9 1.,    \x1c\x85") for _ in range(rng.randrange(60)))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == exact.encode_ordinary(t)


def test_minimal_perfect_hash():
    rng = random.Random(9)
    keys = list({rng.randbytes(rng.randint(1, 9)) for _ in range(3000)})
    h = bpe.MinimalPerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(len(keys)))
    assert base64.b64decode(base64.b64encode(keys[0])) == keys[0]


# --- pipeline ---------------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, docs):
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, now = now, common.written(stage(spark, now, sf_dir))
        assert now.columns == docs.columns
        if i == 0:
            kept = {r["doc_id"] for r in quality.judged(before).where("kept").collect()}
            assert {r["doc_id"] for r in now.collect()} == kept
        if i == 1:
            assert {r["doc_id"] for r in now.collect()} <= {r["doc_id"] for r in before.collect()}
        if i == 2:
            assert {r["doc_id"] for r in now.collect()} == _by_shingles(before)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    _check_packing(out, _pieces(now.select("doc_id", "text").collect()))


def test_pipeline_odd(spark, odd, none, sf_dir):
    for df in (odd, none):
        now = df
        for _, stage in corpus_pipeline.STAGES:
            now = common.written(stage(spark, now, sf_dir))
        now.count()


def test_queries_read_whole_tables(spark, sf_dir):
    n = pq.read_table(f"{sf_dir}/documents.parquet").num_rows
    for name in ("op3_simhash_near_dedup", "op7_quality_rules", "op9_token_counts"):
        assert registry.QUERIES[name](spark, sf_dir).count() == n
