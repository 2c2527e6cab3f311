"""Fill-in-the-middle, exact dedup by cuckoo index and hard negatives against plain versions."""

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import cuckoo, cuckoo_dedup, fill_middle, hard_negatives

SCHEMA = "doc_id bigint, text string, key string, digest int, block string, h int, part int, n string"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "k", 1, "b", 2, 3, "n") for i, t in rows], schema)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = [
    (1, "one two  three\tfour\nfive "), (2, ""), (3, None), (4, " \t "), (5, "x"), (6, "a <P> b c"), (7, "tail <M"), (8, "<S half < P> b"),
    (9, "é ü ß wörter und mehr\x0b\x0cdavon"), (10, "一 二 三 四 五 六"), (None, "no id here at all"), (5, "x"), (5, "x"), (2, ""),
    (11, "word " * 30_000), (12, "y" * 300_000), (13, "a<" * 50 + " <" * 50), (None, None),
]
TEXTS += [(100 + i, " ".join(f"w{i}.{j}" for j in range(i))) for i in range(60)]


# fill in the middle


def plain_fill(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or h3 % 100 >= 50 or any(s in text for s in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_report_and_texts(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "CHUNK_UNITS", 7)
    rows = docs(spark, TEXTS).repartition(5)
    want = [plain_fill(i, t) for i, t in TEXTS]
    got = [tuple(r) for r in fill_middle.report(rows).collect()]
    assert sorted(got, key=repr) == sorted([(*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, TEXTS)], key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    texts = fill_middle.transform(rows)
    assert sorted(map(tuple, texts.collect()), key=repr) == sorted(want, key=repr)
    back = fill_middle.restore(texts)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in TEXTS), key=repr)


def test_fill_middle_of_an_empty_table(spark):
    assert fill_middle.report(docs(spark, [])).collect() == []
    named = fill_middle.report(spark.createDataFrame([("a", "b c")], "doc_id string, text string")).first()
    assert named.doc_id == "a" and named.n == 2 and named.restored_sha256 == sha("b c")


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 400), st.text(alphabet="ab <>PSM\t\né", max_size=40), st.data())
def test_output_reads_back_from_any_pieces(doc_id, text, data):
    *facts, output = plain_fill(doc_id, text)
    n, form, _, ends = fill_middle.plan(doc_id, text.encode())
    assert (n, form) == (facts[1], facts[2]) and len(ends) == n
    reader, found, rest = fill_middle.Reader(form), {0: b"", 1: b"", 2: b""}, output.encode()
    while rest:
        k = data.draw(st.integers(1, len(rest)))
        for part, some in reader.feed(rest[:k]):
            found[part] += some
        rest = rest[k:]
    for part, some in reader.end():
        found[part] += some
    assert (found[0] + found[1] + found[2]).decode() == text


def test_one_shuffle_of_the_text(spark):
    found = fill_middle.report(docs(spark, TEXTS[:5]))
    debug = found.rdd.toDebugString().decode()
    assert debug.count("ShuffledRDD") == 1


# exact dedup


def plain_dedup(rows):
    groups = {}
    for at, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, at))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(rows[m[3]][0], rows[best[3]][0], len(members), sha(text)) for m in members]
    return sorted(out, key=repr)


def checked(index, rows):
    got = cuckoo_dedup.verdicts(index).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain_dedup(rows)
    kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert sorted(kept, key=repr) == sorted({(r.text_sha256, r.keep_id) for r in got}, key=repr)


def copies(rng, n, first=1000):
    base = ["", " ", "a b", "ab", "a\tb ", "a b", "hot", "h ot", "ho t  ", None]
    return [(first + i, rng.choice([*base, "hot", "hot", f"own {i}"])) for i in range(n)]


def test_cuckoo_dedup_with_insertions_and_deletions(spark, monkeypatch):
    monkeypatch.setattr(cuckoo_dedup, "BLOCK_ROWS", 40)
    monkeypatch.setattr(cuckoo_dedup, "SHARD_PARTS", 50)
    rng = random.Random(5)
    rows = TEXTS + copies(rng, 400) + [(77, "same row"), (77, "same row"), (None, "same row"), (78, "samerow")]
    index = cuckoo_dedup.build(docs(spark, rows).repartition(6))
    checked(index, rows)
    more = copies(rng, 150, 5000) + [(9000, "h   o   t   longest of all"[:9]), (9001, "new text")]
    index = cuckoo_dedup.insert(index, docs(spark, more).repartition(3))
    checked(index, rows + more)
    gone = {i for i, _ in rows + more if i is not None and (i % 3 == 0 or i in (9000, 77, 11))}
    index = cuckoo_dedup.delete(index, spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
    left = [(i, t) for i, t in rows + more if i not in gone]
    checked(index, left)
    back = [(i, "h o t again"[:7]) for i in list(gone)[:20]]
    checked(cuckoo_dedup.insert(index, docs(spark, back)), left + back)
    assert cuckoo_dedup.dedup(docs(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("iiid"), st.integers(0, 400)), max_size=1500))
def test_cuckoo_index_is_a_map(steps):
    index, plain = cuckoo.CuckooIndex(2), {}
    for step, number in steps:
        digest = hashlib.sha256(str(number).encode()).digest()
        entry = index.find(digest)
        assert (entry >= 0) == (digest in plain)
        if step == "d":
            assert index.delete(digest) == plain.pop(digest, None)
        elif entry < 0:
            index.insert(digest, number)
            plain[digest] = number
    assert dict(index.items()) == plain and len(index) == len(plain)
    assert all(index.values[index.find(d)] == v for d, v in plain.items())


def test_cuckoo_index_resizes_and_tells_equal_tags_apart():
    index = cuckoo.CuckooIndex(1)
    all_digests = [hashlib.sha256(str(i).encode()).digest() for i in range(20_000)]
    for i, d in enumerate(all_digests):
        index.insert(d, i)
    assert index.resizes > 5 and [index.values[index.find(d)] for d in all_digests] == list(range(20_000))
    twin = all_digests[0][:10] + b"\0" * 22  # same tag, same buckets
    assert index.find(twin) < 0
    index.insert(twin, "twin")
    assert index.delete(all_digests[0]) == 0 and index.values[index.find(twin)] == "twin" and index.find(all_digests[0]) < 0


# hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, block string, side int, score string, anchor int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "b", 1, "s", 2) for i, v, lab in rows], VECTORS)


def plain_negatives(rows, step):
    best = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(x) for x in v]
        best[i] = min(best.get(i, (lab, v)), (lab, v))
    whole = {i: (lab, [math.floor(256 * x) for x in v]) for i, (lab, v) in best.items()}
    out = []
    for a, (lab, q) in whole.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, l2) for i, (l2, p) in whole.items() if i != a and len(p) == len(q))
        for s, i, _ in [x for x in scored if x[2] == lab][: hard_negatives.POSITIVES]:
            inside = [(n, t) for t, n, l2 in scored if l2 != lab and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, i, k, n, -s, -t) for k, (n, t) in enumerate(inside[:3], 1)]
    return sorted(out)


def drawn(seed, n, dim, labels):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-4, 9) / 8 for _ in range(dim)], rng.randrange(labels)) for i in range(n)]
    same = [0.5] * dim
    rows += [(n + i, same, i % labels) for i in range(n // 3)]  # a third with one vector: ties throughout
    rows += [(2 * n + 1, None, 1), (2 * n + 2, same, None), (None, same, 1), (2 * n + 3, [math.nan] * dim, 1), (2 * n + 10, [math.inf] * dim, 0),
             (2 * n + 5, [None, *same[1:]], 0), (20, same, 2), (20, same, 2), (2 * n + 20, [0.25], 1), (2 * n + 30, [0.5], 1),
             (2 * n + 31, [0.25], 0), (2 * n + 40, [], 1), (2 * n + 41, [], 1), (2 * n + 42, [], 2), (-50, same, 1), (2 * n + 60, [0.0] * dim, 0)]
    return [(i, v and [x if x is None or not math.isfinite(x) else float(x) for x in v], lab) if v else (i, v, lab) for i, v, lab in rows]


@pytest.mark.parametrize("seed, dim, labels", [(1, 6, 3), (2, 2, 2), (3, 12, 10)])
def test_hard_negatives(spark, monkeypatch, seed, dim, labels):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 23)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    rows = drawn(seed, 120, dim, labels)
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()
    want = plain_negatives(rows, 10)
    assert sorted(map(tuple, got)) == want and len(want) > 50


def test_hard_negatives_of_few_rows(spark):
    none = hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 50 == 0)
    assert none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and none.collect() == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.5], 2), (4, [0.49], 2), (5, [0.0], 3)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 50)


def test_large_components_are_exact(spark):
    rows = [(0, [1e6, 3.0], 1), (1, [1e6 + 1, -2.0], 1), (2, [9e5, 5.0], 2), (3, [9e5, 5.0 + 1 / 256], 2)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 50)


def test_keys_keep_their_order():
    cases = [(a, s, k, n) for a in (-3, 0, 7) for s in (-(1 << 62), -1, 0, 5, 1 << 62) for k in (0, 1) for n in (-9, 0, 4)]
    keys = sorted(hard_negatives._pack(*c) for c in cases)
    assert [hard_negatives._unpack(x) for x in keys] == sorted(cases, key=lambda c: (c[0], -c[1], c[2], c[3]))
