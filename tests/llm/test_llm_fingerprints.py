"""SimHash operators (near groups through pivots and block tables) against brute force."""

import hashlib

import pytest
import xxhash

from basketry.llm import fingerprints, hamming, simhash_dedup
from basketry.llm.components import components

SCHEMA = "doc_id bigint, text string, component_id string, f int, h string, root string"


def docs(spark, rows):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    """Smallest id reachable for each (id, fingerprint) over all pairs."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= radius:
                group[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            r = root(i)
            least[r] = min(key, least.get(r, key))
    return [least.get(root(i)) for i in range(len(prints))]


BASE = " ".join(f"word{i}" for i in range(300))
EDGE = [
    (5, None), (6, ""), (7, "  \n "), (8, "One"), (9, "one"), (10, "a b c"), (10, "a b c"), (11, "é É x y"),
    (12, BASE), (13, BASE + " end"), (14, BASE.replace("word7 ", "")), (None, BASE), (15, BASE.upper()),
    (16, " ".join(f"other{i}" for i in range(40_000))), (None, None), (17, "tab\tand\x0bvertical\x0cfeed\rline"),
]


def test_pivot_groups_match_brute_force(spark):
    rows = EDGE + [(100 + k, " ".join(f"w{(i * k) % 97}" for i in range(60))) for k in range(1, 40)]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.dedup(docs(spark, rows)).collect()), key=repr)
    prints = [(i, plain_simhash(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_groups(prints, 4))), key=repr)
    assert got == want


def test_groups_over_chains_and_dense_balls(spark):
    """Chains of 4-bit steps, a ball of codes, far codes: single linkage as over all pairs."""
    codes = {0}
    for i in range(12):
        codes.add((1 << (4 * i + 4)) - 1)
    centre = 0x5555_0000_FFFF_1234
    codes |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    codes |= {hash((k, "far")) & (2**64 - 1) for k in range(200)}
    prints = [(i, c) for i, c in enumerate(sorted(codes))]
    frame = spark.createDataFrame([(i, hamming.signed(c)) for i, c in prints], "doc_id bigint, f bigint")
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_groups(frame).collect()}
    assert [got[i] for i, _ in prints] == plain_groups(prints, 4)


def test_block_masks_cover_every_error():
    masks = hamming.block_masks(64, 6, 4)
    assert len(masks) == 15
    for bits in ((0, 1, 2, 3), (0, 20, 40, 63), (10, 11, 32, 33)):
        error = sum(1 << b for b in bits)
        assert any(error & m == 0 for m in masks)


def test_keep_one(spark):
    rows = [*EDGE, (12, BASE)]
    kept = simhash_dedup.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "component_id", "f", "h", "root"]
    prints = [(i, plain_simhash(t)) for i, t in rows]
    got = sorted(plain_simhash(r.text) for r in kept.collect())
    assert len(got) == len(kept.collect())
    groups = plain_groups([(k, f) for k, (_, f) in enumerate(prints)], 4)
    assert len(got) == len(set(groups))
    assert {r.doc_id for r in kept.collect()} == {5, 8, 10, 11, 12, 16, 17}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert simhash_dedup.dedup(none).count() == 0
    assert simhash_dedup.keep_one(none).count() == 0
    assert fingerprints.edited_report(none).count() == 0


def test_components_by_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)]
    edges += [(2000 + k, 2001 + k) for k in range(60)] + [(5, 5), (7, 8), (7, 8)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(frame, "a", "b").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in list(parent) if root(x) != x}
    assert components(frame.limit(0), "a", "b").count() == 0


# fingerprints of edited texts


def plain_print(spark_hashes, text):
    """128-bit fingerprint from the pair hashes that Spark gives."""
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    pairs = [(a, b) for a, b in zip(words, [*words[1:], None])]
    votes, total = [0] * 128, 0
    for a, b in pairs:
        weight = 2 if len(a) > 3 or len(b or "") > 3 else 1
        total += weight
        for i, h in enumerate(spark_hashes[a, b]):
            for k in range(64):
                votes[64 * i + k] += weight * (h >> k & 1)
    return sum(1 << k for k in range(128) if 2 * votes[k] > total)


def edited_texts(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (key, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        out.append((key, text, text[: len(text) - cut] + after[:cut], after))
    return out


@pytest.mark.parametrize("per_range", [4_000, 3])
def test_edited_report(spark, monkeypatch, per_range):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", per_range)
    rows = [(3, "the cat sat on the mat again"), (1, "ünïcode wörds 𝔘 here and there"), (9, "x"), (4, None), (5, ""), (5, ""), (12, "ab"),
            (-4, "short tail"), (20, " ".join(f"w{i}" for i in range(9_000))), (2**40, "far id"), (None, "no id at all here"),
            (7, "the cat sat on the mat again")]
    texts = edited_texts(rows)
    pairs = set()
    for _, text, edited, _ in texts:
        for t in (text, edited):
            w = [x for x in t.split(" ") if x]
            pairs |= set(zip(w, [*w[1:], None]))
    frame = spark.createDataFrame(sorted(pairs, key=repr), "a string, b string")
    hashes = {(r.a, r.b): (r.x & (2**64 - 1), r.y & (2**64 - 1)) for r in
              frame.select("a", "b", F.xxhash64("a", "b").alias("x"), F.xxhash64(F.lit(1), "a", "b").alias("y")).collect()}
    want = []
    for key, text, edited, after in texts:
        f, e, g = (plain_print(hashes, t) for t in (text, edited, after))
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{f:032x}", f"{e:032x}",
                     1 - (f ^ e).bit_count() / 128, 1 - (f ^ g).bit_count() / 128))
    got = [tuple(r)[:7] for r in fingerprints.edited_report(docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_single_row_and_near_ids(spark):
    got = fingerprints.edited_report(docs(spark, [(4, "only one row here")])).collect()
    assert len(got) == 1 and got[0].near_next == 1.0 and got[0].near_id == 4
    base = " ".join(f"word{i}" for i in range(2_000))
    rows = fingerprints.edited_report(docs(spark, [(1, base), (2, base), (3, "unlike words entirely"), (4, None), (5, "")])).collect()
    assert {r.doc_id: r.near_id for r in rows} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
