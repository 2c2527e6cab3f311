"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import near_copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BASE = " ".join(f"word{i}" for i in range(300))


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_similarity(a, b):
    return len(a & b) / len(a | b)


def plain_roots(sets, least=0.8):
    """Position of the first member of each set's single-linkage group."""
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if plain_similarity(a, b) >= least:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(sets))]


def edited(rng, words, count):
    words = list(words)
    for at in rng.sample(range(len(words)), count):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def near_pairs():
    """Texts of 100 to 800 words and copies with scattered one-word edits."""
    rng, rows = random.Random(3), []
    for length in (100, 300, 800):
        for k in range(40):
            words = [f"w{rng.randrange(5_000)}" for _ in range(length)]
            rows += [words, edited(rng, words, max(1, length * (1 + k % 5) // 200))]
    return [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)]


def test_near_dedup_reaches_similarity(spark):
    rows = near_pairs()
    sets = [plain_set(r[1]) for r in rows]
    close = [plain_similarity(sets[i], sets[i + 1]) for i in range(0, len(sets), 2)]
    assert sum(0.8 <= s < 0.9 for s in close) >= 20 and sum(s < 0.8 for s in close) >= 10
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(plain_roots(sets)))


def test_groups_match_brute_force(spark):
    rng = random.Random(4)
    words = BASE.split()
    drift = [words]
    for _ in range(12):  # a chain: neighbours are near, ends are not
        drift.append(edited(rng, drift[-1], 5))
    ball = [edited(rng, words, 3) for _ in range(30)]
    texts = [None, "", "  \n ", "One", "one", "a b c", "a b c", BASE, BASE + " end", BASE.upper(), *map(" ".join, drift + ball)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    found = near_copies.groups(spark.createDataFrame([*rows, (None, BASE, "en", "s", 0), rows[5]], SCHEMA)).collect()
    assert len(found) == len(rows) + 2
    first = {}
    for r in sorted((r for r in found if r.doc_id is not None), key=lambda r: r.doc_id):
        first.setdefault(r.root, r.doc_id)
    got = {r.doc_id: first[r.root] for r in found if r.doc_id is not None}
    assert [got[i] for i in range(len(rows))] == plain_roots([plain_set(t) for t in texts])
    kept = near_copies.keep_one(spark.createDataFrame([*rows, rows[5]], SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def family(seed, count, length=200, least=4, most=8):
    """Texts that differ from one base, which is not among them, in a few words each."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(9_000)}" for _ in range(length)]
    return [" ".join(edited(rng, base, rng.randrange(least, most + 1))) for _ in range(count)]


def test_a_family_does_not_list_its_pairs(spark, monkeypatch):
    """Few pairs of a family of near misses are compared, and the groups are those of all pairs."""
    compared, plain = [], near_copies.verified

    def counted(pairs, sets, least):
        compared.append(pairs.count())
        return plain(pairs, sets, least)

    monkeypatch.setattr(near_copies, "verified", counted)
    for count in (120, 360):
        texts = family(count, count)
        compared.clear()
        found = near_copies.groups(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
        first = {}
        for r in sorted(found, key=lambda r: r.doc_id):
            first.setdefault(r.root, r.doc_id)
        assert [first[r.root] for r in sorted(found, key=lambda r: r.doc_id)] == plain_roots([plain_set(t) for t in texts])
        star, *others = compared
        assert star <= 2 * near_copies.BANDS * count and sum(others) <= count / 4


@pytest.mark.parametrize("blocks", [2000, 30])
def test_dense_families_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_copies, "PAIR_BLOCK", blocks)
    texts = family(1, 80, 200, 1, 6) + family(2, 40, 60, 0, 2) + family(3, 20, 1500, 10, 60) + family(4, 30, 8, 0, 1)
    found = near_copies.groups(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    first = {}
    for r in sorted(found, key=lambda r: r.doc_id):
        first.setdefault(r.root, r.doc_id)
    assert [first[r.root] for r in sorted(found, key=lambda r: r.doc_id)] == plain_roots([plain_set(t) for t in texts])


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    words = near_copies._WORDS
    for n in (1, 40, 512, 513, 700, 3_000, 40_000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.02, 0.1):
            b = np.unique(np.r_[a[int(n * share) :], rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64)])
            level = max(near_copies.level_of(len(a)), near_copies.level_of(len(b)))
            x, y = (np.array(near_copies.sketch(s), "<i8")[(words if near_copies.level_of(len(s)) < level else 0) :][:words] for s in (a, b))
            differ = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
            most = len(np.setxor1d(a, b)) / 2**level
            assert differ <= most + (6 * most**0.5 if level else 0)


def test_levels_of_columns(spark):
    sizes = [0, 1, 2, 511, 512, 513, 1024, 1025, 2048, 2049, 10**6]
    got = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", near_copies._level(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in got} == {n: near_copies.level_of(n) for n in sizes}


def test_clashing_names_and_long_texts(spark):
    long = " ".join(f"w{i % 5_000}x{i // 7}" for i in range(60_000))
    rows = [(1, long, "a", "b", "c"), (2, long + " end", "a", "b", "c"), (3, "z" * 100_000, "a", "b", "c"), (4, "z" * 100_001, "a", "b", "c"), (5, None, "a", "b", "c")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, __h string, node string, key string"))
    assert kept.columns == ["doc_id", "text", "__h", "node", "key"]
    assert sorted((r.doc_id, r["__h"]) for r in kept.collect()) == [(1, "a"), (3, "a"), (4, "a"), (5, "a")]


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    """Without any common MinHash key, sets within operator 1's radius are still compared, and verified."""
    plain = near_copies.sketches
    monkeypatch.setattr(near_copies, "sketches", lambda *args: plain(*args).withColumn("keys", F.array("node")))
    rng, rows = random.Random(5), []
    for k in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [r.doc_id for r in near_copies.keep_one(docs).collect()]
    assert set(range(0, 40, 2)) <= set(kept) and len(kept) <= 24
    assert near_copies.keep_one(docs, least=1.0).count() == 40
