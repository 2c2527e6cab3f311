"""Byte-string dedup, chained passages, page extraction and the pipeline on small tables."""

import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import chaining, html_extract, html_training, suffix_dedup
from basketry.llm.packed import steps, unsteps

SCHEMA = "doc_id bigint, text string, id string, h int, key string, d string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgéñ", k=rng.randrange(1, 9))) for _ in range(n))


# byte strings


def plain_removal(rows, first_stays, depth):
    """Per row (bytes, removed flags) by comparing every string of ``depth`` bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count, first = collections.Counter(), {}
    for k, (i, b) in enumerate(texts):
        for p in range(len(b) - depth + 1):
            s = b[p : p + depth]
            count[s] += 1
            first.setdefault(s, (k, p))
    out = []
    for k, (i, b) in enumerate(texts):
        flags = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            s = b[p : p + depth]
            if (first[s] != (k, p)) if first_stays else count[s] > 1:
                flags[p : p + depth] = b"\1" * depth
        left = bytes(x for x, f in zip(b, flags) if not f)
        spans = sum(flags[q] and not (q and flags[q - 1]) for q in range(len(b)))
        out.append((i, len(b), sum(flags), spans, hashlib.sha256(left).hexdigest()))
    return out


def repeated_corpus(seed):
    rng = random.Random(seed)
    passage, other = prose(rng, 40), prose(rng, 60)
    rows = [(k, prose(rng, rng.randrange(0, 50)) + " " + passage[rng.randrange(0, 40):] + " " + prose(rng, rng.randrange(0, 30))) for k in range(1, 25)]
    rows += [(30 + k, other[: 20 * k] + "|" + other[20 * k :]) for k in range(8)]
    rows += [(50, other), (51, other), (52, None), (53, ""), (54, "short"), (55, "a" * 700), (56, "ab" * 300), (57, "x" * 99),
             (58, prose(rng, 20) + other + prose(rng, 5) + other)]
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [5_000, 3])
def test_removal_matches_brute_force(spark, monkeypatch, keep, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rows = repeated_corpus(crowd)
    found = suffix_dedup.dedup(docs(spark, rows).repartition(3), keep=keep, depth=100)
    assert sorted(map(tuple, found.collect())) == sorted(plain_removal(rows, keep == "first", 100))


def test_removal_edges(spark):
    same = "identical row " * 40
    found = suffix_dedup.dedup(docs(spark, [(1, same), (1, same), (None, same), (None, "alone " * 10)]), depth=100, with_text=True)
    assert sorted((r.n_bytes, r.n_removed, r.kept) for r in found.collect()) == [(60, 0, b"alone " * 10), (560, 560, b""), (560, 560, b""), (560, 560, b"")]
    assert suffix_dedup.dedup(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup(docs(spark, []), keep="last")


def test_runs_cover_every_position_in_any_block_size(monkeypatch):
    data = prose(random.Random(1), 900).encode() + b"z" * 900
    whole = suffix_dedup.runs(data, 400)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    for first, size, _, _ in (whole, suffix_dedup.runs(data, 400)):
        assert np.concatenate([np.arange(a, a + n) for a, n in zip(first, size)]).tolist() == list(range(len(data) - 399))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=6), st.integers(2, 5))
def test_suffix_order(strings, depth):
    owner, place, run = suffix_dedup.suffix_runs(strings, depth) if strings else (np.zeros(0, int),) * 3
    cut = [strings[o][p : p + depth] for o, p in zip(owner, place)]
    assert cut == sorted(cut) and len(cut) == sum(max(0, len(s) - depth + 1) for s in strings)
    assert [a == b for a, b in zip(cut, cut[1:])] == [a == b for a, b in zip(run.tolist(), run.tolist()[1:])]


def test_hashed_order_has_the_same_runs(monkeypatch):
    rng = random.Random(8)
    strings = [bytes(rng.choices(b"ab", k=rng.randrange(0, 60))) for _ in range(80)]
    runs = []
    for limit in (10**9, 0):
        monkeypatch.setattr(suffix_dedup, "SORTED", limit)
        owner, place, run = suffix_dedup.suffix_runs(strings, 12)
        groups = collections.defaultdict(set)
        for o, p, r in zip(owner.tolist(), place.tolist(), run.tolist()):
            groups[r].add((o, p))
        runs.append(set(map(frozenset, groups.values())))
    assert runs[0] == runs[1]


# passages


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=14))
def test_best_chain_matches_quadratic_search(matches):
    matches = sorted(set(matches))
    pos, rep = [p for p, _ in matches], [r for _, r in matches]
    best = []
    for i in range(len(matches)):
        best.append(chaining.GAIN + max([0.0, *(best[j] - chaining.GAP * (pos[i] - pos[j] + rep[i] - rep[j])
                                               for j in range(i) if pos[j] < pos[i] and rep[j] < rep[i])]))
    found = chaining.chains(pos, rep)
    assert sorted(i for c in found for i in c) == list(range(len(matches)))
    for c in found:
        assert all(pos[a] < pos[b] and rep[a] < rep[b] for a, b in zip(c, c[1:]))
    c = found[0]
    score = chaining.GAIN * len(c) - chaining.GAP * (pos[c[-1]] - pos[c[0]] + rep[c[-1]] - rep[c[0]])
    assert score == pytest.approx(max(best))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_edits(a, b):
    table = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert chaining.edits(np.array(a, int), np.array(b, int)) == table[-1][-1]


@pytest.mark.parametrize("chains", [2000, 3])
def test_passages_are_found_and_clean_texts_left_alone(spark, monkeypatch, chains):
    monkeypatch.setattr(chaining, "CHAINS_PER_TASK", chains)
    rng = random.Random(9)
    passage = prose(rng, 60).split()
    rows, planted = [], set()
    for k in range(1, 60):
        text = prose(rng, rng.randrange(20, 200)).split()
        if k % 3 == 0:
            copy = list(passage)
            if k % 2:
                copy[30] = "changed"
            if k % 5 == 0:
                del copy[20:22]
            at = rng.randrange(len(text))
            text[at:at] = copy
            planted.add(k)
        rows.append((k, " ".join(text)))
    rows += [(100, None), (101, ""), (102, "short text"), (103, "again " * 300), (104, "again and " * 300), (None, "".join(c.upper() if c.isascii() else c for c in " ".join(passage)))]
    found = chaining.passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in found} == planted | {None}
    words = {i: (t or "").encode().lower().decode().split() for i, t in rows}
    for r in found:
        mine, other = words[r.doc_id][r.start : r.end], words[r.rep_doc_id][r.rep_start : r.rep_end]
        assert r.identity >= 0.8 and r.equal_words >= 40
        assert len(set(mine) & set(passage)) >= 50 and len(set(other) & set(passage)) >= 50
    assert chaining.passages(docs(spark, [])).count() == 0


def test_seeds_depend_on_their_words_alone():
    w = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    keys, pos = chaining.seeds(w)
    again, at = chaining.seeds(w[100:300])
    inside = (pos >= 100) & (pos <= 300 - chaining.K)
    assert keys[inside].tolist() == again.tolist() and pos[inside].tolist() == (at + 100).tolist() and 200 < len(keys) < 300
    assert len(chaining.seeds(w[:5])[0]) == 0 and len(chaining.seeds(w[:6])[0]) <= 1


def found_pairs(spark, texts):
    """Pairs of documents that share a passage, directly or through its representative's same words."""
    found = chaining.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return {frozenset((r.doc_id, r.rep_doc_id)) for r in found if r.doc_id != r.rep_doc_id}, {r.doc_id for r in found}


def replaced(rng, words, count):
    """``count`` of the words changed, none of them at the ends."""
    words = list(words)
    for at in rng.sample(range(1, len(words) - 1), count):
        words[at] = "".join(rng.choices("xyzuvw", k=7))
    return words


@pytest.mark.parametrize("changed", [0, 4, 6, 9])
def test_edited_passages_are_found(spark, monkeypatch, changed):
    """Passages of 60 words of which 0, 6, 10 or 15 % are changed in one of two documents."""
    monkeypatch.setattr(chaining, "CHUNK_DOCS", 17)
    rng, texts = random.Random(changed), []
    for _ in range(60):
        passage = prose(rng, 60).split()
        for some in (passage, replaced(rng, passage, changed)):
            texts.append(" ".join([prose(rng, rng.randrange(5, 60)), *some, prose(rng, rng.randrange(5, 60))]))
    pairs, _ = found_pairs(spark, texts)
    assert len(pairs & {frozenset((2 * i, 2 * i + 1)) for i in range(60)}) >= 57 and len(pairs) <= 60


@pytest.mark.parametrize("overlap", [0, 8, 20])
def test_a_third_document_does_not_hide_a_passage(spark, overlap):
    """A and B share 60 words; C1 has the first part of them and C2 the last, each too short to count."""
    rng, texts = random.Random(3), []
    for _ in range(40):
        passage = prose(rng, 60).split()
        half = (60 - overlap) // 2
        parts = [passage[: half + overlap][:39], passage[-(half + overlap) :][-39:], passage, passage]
        texts += [" ".join([prose(rng, 30), *p, prose(rng, 30)]) for p in parts]
    rng.shuffle(texts)
    whole = [i for i, t in enumerate(texts) if len(t.split()) == 120]
    pairs, seen = found_pairs(spark, texts)
    assert sum(i in seen for i in whole) >= 78 and not seen - set(whole)


@pytest.mark.parametrize("block", [1024, 7])
def test_no_number_of_other_documents_hides_a_passage(spark, monkeypatch, block):
    """A and B share 60 words; every 12 of them are in 8 others, so most seeds have more than two of these in front."""
    monkeypatch.setattr(chaining, "BLOCK", block)
    rng, texts = random.Random(4), []
    for _ in range(4):
        passage = prose(rng, 60).split()
        parts = [passage[at : at + 12] for at in range(0, 49, 4)] * 8 + [passage, passage]
        texts += [" ".join([prose(rng, 20), *p, prose(rng, 20)]) for p in parts]
    rng.shuffle(texts)
    whole = [i for i, t in enumerate(texts) if len(t.split()) == 100]
    pairs, seen = found_pairs(spark, texts)
    assert len(whole) == 8 and seen == set(whole) and len(pairs) == 4


def most_held(step) -> tuple[float, int]:
    """MB of memory held at most while the batches of ``step()`` are made and dropped, and their rows."""
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in step())
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def test_a_task_does_not_hold_all_that_meet(spark, monkeypatch):
    """2,000 occurrences of a pair of seeds with the same words around them all meet: 1,999,000 pairs."""
    tasks = []
    plain = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, work, *a: tasks.append(work) or plain(self, work, *a))
    chaining.matches(spark.createDataFrame([], chaining.PLACED))
    n = 2000
    cells = {"pair": [7] * n, "x": [0] * n, "y": [0] * n, "block": [0] * n, "d": list(range(n)), "pos": [40] * n, "far": [20] * n, "bare": [True] * n,
             "prior": [0] * n, "later": [0] * n, "words": [bytes(range(1, 65))] * n, "before": [0] * n, "after": [0] * n}
    kinds = dict(f.split() for f in chaining.PLACED.split(", ")) | {"x": "int", "y": "int", "block": "int"}
    types = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    batch = pa.RecordBatch.from_arrays([pa.array(v, types[kinds[k]]) for k, v in cells.items()], list(cells))
    held, rows = most_held(lambda: tasks[0](iter([batch])))
    assert rows >= n * (n - 1) // 2 and held < 40


def test_a_chunk_does_not_hold_the_words_around_all_pairs(spark, monkeypatch):
    """The pairs of seeds of a text of 6,000 words, all of them wanted."""
    works = []
    monkeypatch.setattr(chaining, "with_chunks", lambda parts, told, work, schema: works.append(work))
    rows = spark.createDataFrame([(1, 1, bytearray(prose(random.Random(5), 6000).encode()))], "d bigint, doc_id bigint, bytes binary")
    parts = chaining.chunks(rows, "bigint")
    chaining.pair_keys(parts, None, 3)
    chaining.pair_rows(parts, None)
    c = chaining.Chunk(parts.collect()[0].asDict())
    seeds = [{"keys": steps(c.codes)}]
    pairs = works[0](0, c, {0: seeds}).to_pylist()
    held, n = most_held(lambda: [works[1](0, c, {0: seeds, 3: pairs})])
    assert n > 80_000 and held < 120


def test_hot_seeds_cost_one_answer_a_chunk(spark, monkeypatch):
    """A line that all documents have is offered and answered once by each chunk."""
    monkeypatch.setattr(chaining, "CHUNK_DOCS", 50)
    rng = random.Random(8)
    line = prose(rng, 12)
    frame = spark.createDataFrame([(i, f"{prose(rng, 20)} {line} {prose(rng, 20)}") for i in range(400)], "doc_id bigint, text string").coalesce(1)
    sizes = []
    plain = chaining.by_shards

    def counted(sent, shards, answer):
        if answer is chaining.least:
            sizes.append(sum(len(unsteps(r["keys"])) for r in sent.collect()))
        return plain(sent, shards, answer)

    monkeypatch.setattr(chaining, "by_shards", counted)
    assert chaining.passages(frame).count() == 0
    assert sizes and all(0 < n <= 100 for n in sizes)  # of some 1,500 occurrences


# pages


@pytest.fixture(scope="module")
def forest():
    return html_training.trained(250)


def test_extraction_of_held_out_pages(forest):
    exact, shares = 0, []
    for k in range(150):
        page = html_training.Writer(5_000_000 + k).page()
        want, got = html_training.truth(page).split("\n"), html_extract.extract_batch([page], forest)[0].replace(html_training.MARK, "").split("\n")
        exact += want == got
        a, b = set(want), set(got)
        shares.append((sum(map(len, a & b)) + 1) / (sum(map(len, a | b)) + 1))
    assert exact >= 125 and np.mean(shares) >= 0.93


def test_decoding_is_consistent_and_optimal():
    rng = random.Random(2)
    for _ in range(60):
        nodes = [html_extract.Node("body", -1, 0, frozenset())]
        for k in range(1, 9):
            up = rng.randrange(k)
            nodes.append(html_extract.Node("div", up, 0, frozenset(), own=rng.randrange(1, 9)))
            nodes[up].children.append(k)
        for n in reversed(nodes):
            n.chars += n.own
            if n.parent >= 0:
                nodes[n.parent].chars += n.chars
        odds = np.array([rng.uniform(-3, 3) for _ in nodes])
        weight = np.array([1.0 + n.own + html_extract.BELOW * n.chars for n in nodes]) * odds
        best = max(sum(weight[i] for i in range(9) if mask >> i & 1) for mask in range(1, 512, 2)
                   if all(mask >> nodes[i].parent & 1 for i in range(1, 9) if mask >> i & 1))
        keep = html_extract.decode(nodes, odds)
        assert all(keep[nodes[i].parent] for i in range(1, 9) if keep[i])
        assert sum(weight[keep]) == pytest.approx(best)


def test_blocks_references_and_broken_markup(forest):
    page = ('<html><head><title>no</title><script>if (a < b) document.write("<p>no</p>")</script></head><body><nav><ul><li><a href="/">Home</a>'
            "<li><a href='/x'>News</a></ul></nav><article><h1>Fish &amp; chips&#33;</h1><p>First  line\n goes <b>on</b> and on, with enough words to count"
            "<p>Second &lt;b&gt; caf&eacute; paragraph, a long one as articles have them.<br>New line.<!-- <p>no</p> --></article>"
            "<footer>&copy; all rights reserved</footer")
    assert html_extract.extract_batch([page], forest) == [
        "Fish & chips!\nFirst line goes on and on, with enough words to count\nSecond <b> café paragraph, a long one as articles have them. New line."]


def test_head_without_end_tag(forest):
    page = "<head><title>x</title><style>p{}</style><body><article><p>Only these words are the article, all of them are.</p></article></body>"
    assert html_extract.extract_batch([page], forest) == ["Only these words are the article, all of them are."]


def test_extract_table(spark, forest):
    page = "<body><article><p>" + "One sentence of an article. " * 2_000 + "</p></article></body>"
    rows = [(1, "u", None, 3), (2, None, "", 3), (None, "v", page, 3), (4, "w", page, 3), (4, "w", page, 3), (5, "x", "<p", 3), (6, "y", "<div>" * 3_000, 3)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = collections.Counter(tuple(r) for r in html_extract.extract(frame, forest=forest).collect())
    text = ("One sentence of an article. " * 2_000).strip()
    assert got == {(1, "u", "", 0): 1, (2, None, "", 0): 1, (None, "v", text, len(text)): 1, (4, "w", text, len(text)): 2, (5, "x", "", 0): 1, (6, "y", "", 0): 1}
    assert html_extract.extract(frame.limit(0), forest=forest).count() == 0


# the pipeline


def test_pipeline_stages(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables")
    import corpus_pipeline
    from basketry.llm import perplexity, pii, simhash_dedup
    from basketry.llm.common import table

    frame = table(spark, folder, "documents")
    source = {r.doc_id: r for r in frame.collect()}
    good = corpus_pipeline.quality(spark, frame, folder).cache()
    verdict = {r.doc_id: r.kept for r in perplexity.classify(frame, table(spark, folder, "labels")).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, k in verdict.items() if k}
    single = corpus_pipeline.near_dedup(spark, good, folder).cache()
    assert {r.doc_id for r in single.collect()} <= {r.doc_id for r in good.collect()}
    assert simhash_dedup.keep_one(single).count() == single.count()
    clean = corpus_pipeline.personal_data(spark, single, folder).cache()
    assert all(r.text == pii.redact(source[r.doc_id].text) and r.n_chars == len(r.text) for r in clean.collect())
    mixed = corpus_pipeline.mix(spark, clean, folder).cache()
    for stage in (good, single, clean, mixed):
        assert stage.columns == frame.columns
    pieces = corpus_pipeline.pack(spark, mixed, folder).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.start == 0) == collections.Counter(r.doc_id for r in mixed.collect())
    assert max(collections.Counter(p.sequence_id for p in pieces for _ in range(p.length)).values()) <= 1024
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, folder).columns == list(pieces[0].asDict())


def test_pipeline_of_empty_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
