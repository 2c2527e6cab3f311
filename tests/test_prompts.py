"""Templates, sampling, negatives and prompts."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from basketry.functions import draws, text
from basketry.operators import negatives as neg
from basketry.operators import sampling, splits
from basketry.operators.metricspec import ERROR
from basketry.operators.numbering import number_rows
from basketry.plans import export
from basketry.plans import prompts as pr
from basketry.plans import templates as tpl
from basketry.storage import pin

SEED = 9


@pytest.fixture(scope="module")
def cat(spark):
    items = spark.createDataFrame(
        [(str(i), i, "" if i % 5 == 0 else f"title {i}", ["all", f"c{i % 4}"]) for i in range(150)],
        "item_id string, item_no long, title string, categories array<string>",
    )
    return neg.catalog(items, "item_no")


@pytest.fixture(scope="module")
def hist(spark, cat):
    data = [(f"u{u}", i, str((u * 31 + i * 7) % 150), 1 + (u + i) % 5) for u in range(6) for i in range(4 + 5 * u)]
    df = spark.createDataFrame(data, "user_id string, ts long, item_id string, rating long")
    out = number_rows(df.join(cat.items.drop("item_no"), "item_id"), ["user_id"], ["ts"], at_most=200)
    return out.drop("ts").cache()


@pytest.fixture(scope="module")
def users(spark):
    data = [(f"u{u}", "" if u % 2 else f"name {u}", f"KEY{u}") for u in range(6)]
    return spark.createDataFrame(data, "user_id string, user_name string, user_key string")


def test_template_registry(spark):
    assert len({(t.input_text, t.template_id) for ts in tpl.TEMPLATES.values() for t in ts}) == 55
    counts = {t: len(tpl.templates(t)) for t in tpl.task_names()}
    assert counts[tpl.RATING] == 5 and counts[tpl.SEQUENTIAL] == 10 and counts[tpl.DIRECT] == 9
    assert counts[tpl.P5_RATING] == 9 and counts[tpl.P5_SEQUENTIAL] == 12 and counts[tpl.P5_DIRECT] == 7
    assert [t.template_id for t in tpl.templates("P5_Direct", "inference")] == ["5-5", "5-6", "5-7"]
    assert [t.template_id for t in tpl.templates(tpl.SEQUENTIAL, "qa")] == ["6", "7"]
    with pytest.raises(KeyError):
        tpl.templates(tpl.RATING, force="77")
    with pytest.raises(KeyError):
        tpl.find_task("unknown")
    assert tpl.template_table(spark, [tpl.RATING]).count() == 5


def test_walk_reaches_every_item_once(spark, cat):
    df = spark.range(1).select(
        neg.negative_indexes(cat, F.array().cast("array<bigint>"), cat.size, SEED, F.col("id")).alias("i")
    )
    assert sorted(df.first().i) == list(range(150)) and cat.prime == 151


def test_negatives_are_distinct_and_outside(spark, cat, hist):
    ex = splits.examples(hist, "test", ["item_id", "item_idx"])
    out = neg.add_candidates(ex, cat, 99, SEED, "c", True).collect()
    assert len(out) == 6
    for r in out:
        seen = {x.item_id for x in r.input}
        wrong = set(r.candidates) - {r.target.item_id}
        assert len(r.candidates) == 100 and len(wrong) == 99 and not wrong & seen


def test_candidate_ways_agree(spark, cat, hist, monkeypatch):
    ex = splits.examples(hist, "test", ["item_id", "item_idx"])
    cols = ["user_id", "candidates"]
    small = rows(neg.add_candidates(ex, cat, 20, SEED, "c", True), *cols)
    long = splits.example_spots(hist, "test")
    excluded = long.select("user_id", "epoch", "item_idx").distinct()
    ends = splits.targets(hist, "test", ["item_id", "item_idx"]).withColumn("segment_no", F.lit(0))
    assert rows(neg.candidates_by_join(ends, excluded, cat, 20, SEED, "c"), *cols) == small
    monkeypatch.setattr(neg, "WALK_BLOCK", 8)
    assert rows(neg.candidates_by_join(ends, excluded, cat, 20, SEED, "c"), *cols) == small
    monkeypatch.setattr(neg, "BROADCAST_ROWS", 10)
    assert rows(neg.add_candidates(ex, cat, 20, SEED, "c", True), *cols) == small


def test_a_long_exclusion_list_takes_several_rounds(spark, cat):
    """All but a few items are excluded, so the walk goes on to its last steps."""
    keys = spark.createDataFrame([(f"k{i}",) for i in range(8)], "k string")
    for left in (12, 40, cat.size):
        excluded = keys.join(cat.items.filter(F.pmod(F.xxhash64("item_idx"), F.lit(cat.size)) >= 0).select("item_idx").filter(F.col("item_idx") < cat.size - left))
        got = neg.negatives_by_join(keys, excluded, cat, 10, ["k"], SEED, F.col("k")).groupBy("k").agg(
            F.array_sort(F.collect_list(F.struct("step", "item_idx")))["item_idx"].alias("i"))
        lists = excluded.groupBy("k").agg(F.collect_list("item_idx").alias("e"))
        same = keys.join(lists, "k", "left").select("k", neg.negative_indexes(cat, F.coalesce("e", F.array().cast("array<bigint>")), 10, SEED, F.col("k")).alias("i"))
        assert rows(got) == rows(same) and all(len(i) == 10 for _, i in rows(got))


def test_small_pools_are_left_out_and_counted(cat, hist):
    ex = splits.examples(hist, "test", ["item_id", "item_idx"])
    excluded = hist.select("user_id", "item_idx").distinct()
    want = cat.size - 15
    kept = neg.add_candidates(ex, cat, want, SEED, "c", True, strict=False)
    short = neg.short_pools(excluded, cat, want, ["user_id"])
    assert {r.user_id for r in kept.collect()} | {r.user_id for r in short.collect()} == {f"u{i}" for i in range(6)}
    assert kept.count() + short.count() == 6 and short.count() > 0


def test_windows_are_contiguous_and_repeatable(hist):
    train = hist.filter(splits.in_split("train"))
    lengths = {r.user_id: r["max(pos)"] + 1 for r in train.groupBy("user_id").agg(F.max("pos")).collect()}
    first = sampling.train_examples(hist, ["item_id"], 20, SEED).collect()
    seen = set()
    for r in first:
        at = [x.pos for x in r.input] + [r.target.pos]
        assert at == list(range(at[0], at[0] + len(at))) and at[-1] < lengths[r.user_id]
        assert len(r.input) >= (1 if lengths[r.user_id] == 2 else 2)
        seen.add((r.user_id, at[0], len(at)))
    assert len(seen) > 40
    again = sampling.train_examples(hist.repartition(7), ["item_id"], 20, SEED).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    spots = sampling.window_rows(train, sampling.training_windows(hist, 20, SEED), block=4)
    listed = sorted((r.user_id, r.epoch, x.pos) for r in first for x in [*r.input, r.target])
    assert sorted((r.user_id, r.epoch, r.pos) for r in spots.collect()) == listed


def test_rating_draws(spark):
    df = spark.range(20_000).withColumn("r", F.col("id") % 5 + 1)
    out = df.select(
        "r", sampling.perturbed_rating(F.col("r"), 1, F.col("id")).alias("p"), sampling.wrong_rating(F.col("r"), 1, F.col("id")).alias("w")
    )
    stats = {r.r: r for r in out.groupBy("r").agg(F.avg("p").alias("m"), F.stddev("p").alias("s"), F.min("p").alias("lo"), F.max("p").alias("hi")).collect()}
    for star, mean, std in ((2, 1.95, 0.225), (3, 2.95, 0.225), (4, 3.95, 0.225)):
        assert stats[star].m == pytest.approx(mean, abs=0.02) and stats[star].s == pytest.approx(std, abs=0.02)
    assert stats[1].lo >= 1.0 and stats[5].hi <= 5.0
    assert out.filter("w = r OR w < 1 OR w > 5").count() == 0
    counts = [r["count"] for r in out.groupBy("r", "w").count().collect()]
    assert len(counts) == 20 and min(counts) > 800


def test_draws_are_uniform(spark):
    n = 20_000
    counts = [r["count"] for r in spark.range(n).groupBy(draws.pick(10, 1, F.col("id"))).count().collect()]
    assert sum((c - n / 10) ** 2 / (n / 10) for c in counts) < 28  # chi-square, 9 degrees, p = 0.001


def test_two_decimals_match_text_formatting(spark):
    cases = [(s, n) for n in (1, 2, 3, 7, 8, 16, 40, 80, 200, 400) for s in range(n, 5 * n + 1)]
    cases += [(s, n) for n in (8, 40, 200, 4096) for s in (*range(0, 3 * n, 7), 83 * n // 8, 10**9 + 5, -n // 8, -1)] + [(None, 3), (4, 0)]
    df = spark.createDataFrame(cases, "s long, n long")
    got = df.select("s", "n", text.two_decimals(F.col("s"), F.col("n")).alias("t")).collect()
    assert [(r.s, r.n, r.t) for r in got if r.t != (f"{r.s / r.n:.2f}" if r.s is not None and r.n else None)] == []


def test_evaluation_prompts(hist, users, cat):
    ex = splits.examples(hist, "test", ["item_id", "rating"]).join(users, "user_id")
    out = pr.build_prompts(ex, tpl.RATING, seed=SEED).collect()
    assert len(out) == 6 * 5 and {r.role for r in out} == {"inference"}
    for r in out:
        assert r.ground_truth == [r.target_text] and r.user_id in r.input_text
    one = pr.build_prompts(ex, tpl.RATING, seed=SEED, force="3")
    assert {r.template_id for r in one.collect()} == {"3"}
    assert pr.check_evaluable(one).count() == 6


def test_training_roles(hist, users, cat):
    fields = pr.fields_of(list(pr.FIELDS))
    ex = sampling.train_examples(hist, fields, 1, SEED).join(users, "user_id").cache()
    n = ex.count()
    roles = {
        tpl.SEQUENTIAL: ["inference", "qa", "pair"], tpl.DIRECT: ["inference", "qa"],
        tpl.P5_SEQUENTIAL: ["inference", "qa", "pair"], tpl.P5_DIRECT: ["inference", "support"], tpl.RATING: ["inference"],
    }
    for task, want in roles.items():
        out = pr.build_prompts(ex, task, seed=SEED, training=True, catalog=cat).collect()
        assert len(out) == n * len(want) and {r.role for r in out} == set(want), task
        assert all((r.ground_truth is not None) == (r.role == "inference") for r in out)
        assert all(r.input_text is not None and r.target_text is not None for r in out)
    drawn = pr.build_training_prompts(ex, list(roles), seed=SEED, strategy="random", catalog=cat)
    assert drawn.select("user_id", "epoch", "task").distinct().count() == n
    with pytest.raises(ValueError):
        pr.build_training_prompts(ex, [tpl.RATING], seed=SEED, strategy="some")
    with pytest.raises(Exception, match="ground truth"):
        pr.check_evaluable(pr.build_prompts(ex, tpl.P5_DIRECT, seed=SEED, training=True, catalog=cat)).collect()


def test_a_slot_that_is_not_filled_fails_at_once(hist):
    with pytest.raises(KeyError, match="user_name"):
        pr.build_prompts(splits.examples(hist, "test", ["item_id", "rating", "title"]), tpl.P5_RATING, seed=SEED)


def test_name_and_title_fallbacks(hist, users):
    ex = splits.examples(hist, "test", ["item_id", "rating", "title"]).join(users, "user_id")
    out = pr.build_prompts(ex, tpl.P5_RATING, seed=SEED, force="1-7").collect()
    for r in out:
        number = int(r.user_id[1:])
        assert (f"KEY{number}" if number % 2 else f"name {number}") in r.input_text


@pytest.mark.parametrize("epochs", [None, 2])
@pytest.mark.parametrize("task", [tpl.SEQUENTIAL, tpl.P5_SEQUENTIAL, tpl.RATING, tpl.P5_DIRECT])
def test_long_histories_give_the_same_texts(hist, users, cat, task, epochs):
    """Users over the segment size come as pieces that make up the same prompt."""
    def run(size):
        out = pr.whole_prompts(hist, users, [task], seed=SEED, epochs=epochs, catalog=cat, size=size)
        cells = F.sort_array(F.collect_list(F.struct("part_no", "segment_no", "input_text")))
        keys = ["user_id", "epoch", "task", "template_id", "role", "target_text", "ground_truth"]
        return rows(out.groupBy(*keys).agg(F.array_join(cells["input_text"], "").alias("text")))

    assert run(10) == run(4096)


@pytest.mark.parametrize("max_len", [9, 25, 400])
def test_export_of_pieces_equals_export_of_whole_texts(hist, users, cat, max_len):
    def run(size):
        out = pr.whole_prompts(hist, users, [tpl.SEQUENTIAL], seed=SEED, epochs=2, catalog=cat, size=size)
        return rows(export.export_batches(out, seed=1, batch_size=4, max_len=max_len, size=size))

    assert run(10) == run(4096)


def test_many_categories_come_in_pieces(spark, users, cat):
    """A set of categories that is longer than the history and than a segment."""
    data = [("u0", i, 4, str(i), i, [f"c{(i * 700 + k) * 7919 % 100_003:06d}" for k in range(1400)], "t", 1, i) for i in range(4)]
    one = spark.createDataFrame(data, "user_id string, pos long, n long, item_id string, item_idx long, categories array<string>, title string, rating long, ts long")

    def run(size):
        out = pr.whole_prompts(one, users, [tpl.DIRECT], seed=SEED, catalog=cat, size=size)
        assert size > 4 or out.agg(F.max(F.length("input_text"))).first()[0] < 2_000
        return rows(pr.join_pieces(out), "user_id", "template_id", "input_text", "target_text")

    whole = run(4096)
    assert len(whole) == 6 and all(r[2].count("c0") + r[2].count("c1") > 2_000 for r in whole)
    assert run(3) == whole


def test_one_scan_serves_all_tasks(hist, users, cat):
    fields = pr.fields_of(list(pr.FIELDS))
    ex = pin(sampling.train_examples(hist, fields, 1, SEED).join(users, "user_id"), "examples")
    tasks = [tpl.RATING, tpl.SEQUENTIAL, tpl.DIRECT, tpl.P5_RATING, tpl.P5_SEQUENTIAL]
    out = pr.build_training_prompts(ex, tasks, seed=SEED, catalog=cat)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/examples-") == 1
    apart = [rows(pr.build_prompts(ex, t, seed=SEED, training=True, catalog=cat)) for t in tasks]
    assert rows(out) == sorted((r for part in apart for r in part), key=repr)


def test_single_target_guard(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],)], "gt array<string>")
    with pytest.raises(Exception, match="exactly one"):
        pr.check_single_target(df).collect()


def test_new_task(spark, hist, users):
    def build(ex, s):
        rows_ = pr.with_template(ex, s, "inference")
        slots = pr.user_slots(rows_) | {"target_item": F.col("target.item_id")}
        return pr.rendered(rows_, s, ["inference"], slots, F.col("target.item_id"))

    tpl.register_task("last_item", ERROR, [tpl.Template("last_item", "0", "inference", "Ask {user_id}", "{target_item}")])
    pr.register_builder("last_item", ["item_id"], build)
    try:
        ex = splits.examples(hist, "test", ["item_id"]).join(users, "user_id")
        out = pr.build_prompts(ex, "LAST_item", seed=SEED)
        assert out.count() == 6 and out.first().input_text.startswith("Ask u")
    finally:
        for registry in (tpl.TEMPLATES, tpl.TASK_FAMILY, pr.BUILDERS, pr.FIELDS, pr.FACTS):
            registry.pop("last_item")


# ---- one path for histories of any length


def whole_texts(out):
    cells = F.sort_array(F.collect_list(F.struct("part_no", "segment_no", "input_text")))
    keys = ["user_id", "epoch", "task", "template_id", "role", "target_text", "ground_truth"]
    return rows(out.groupBy(*keys).agg(F.array_join(cells["input_text"], "").alias("text")))


SIZES = [2, 10, 4096]  # every history is long, some are, none is


def same_for_all_sizes(*args, **kw):
    first, *others = [whole_texts(pr.whole_prompts(*args, size=n, **kw)) for n in SIZES]
    assert first and all(first == other for other in others)
    return first


def test_every_task_is_evaluated_for_every_user(hist, users, cat):
    tasks = [tpl.RATING, tpl.P5_RATING_EVAL, tpl.P5_DIRECT_EVAL]
    got = same_for_all_sizes(hist, users, tasks, seed=SEED, catalog=cat)
    assert len(got) == 6 * (5 + 2 + 2) and {r[2] for r in got} == set(tasks)


def test_training_when_all_histories_are_long(hist, users, cat):
    assert same_for_all_sizes(hist, users, [tpl.SEQUENTIAL, tpl.DIRECT], seed=SEED, epochs=2, catalog=cat, strategy="random")


def test_windows_on_merged_rows(hist, users):
    got = same_for_all_sizes(hist, users, [tpl.P5_RATING_EVAL], seed=SEED, epochs=6, merged=True)
    ex = sampling.train_examples(hist, ["item_id"], 30, SEED, split="train_validation").collect()
    n = {r.user_id: r.n for r in hist.select("user_id", "n").distinct().collect()}
    assert max(r.target.pos - n[r.user_id] for r in ex) == -2 and len(got) == 6 * 6


def test_items_without_categories(hist, users, cat):
    bare = hist.withColumn("categories", F.when(F.col("user_id") > "u1", F.col("categories")))
    got = same_for_all_sizes(bare, users, [tpl.DIRECT, tpl.SEQUENTIAL], seed=SEED, catalog=cat)
    assert {r[0] for r in got} == {f"u{u}" for u in range(6)}


def test_unrated_rows(hist, users):
    some = hist.withColumn("rating", F.when(F.col("pos") % 3 == 1, F.col("rating")).cast("bigint"))
    last = hist.withColumn("rating", F.when((F.col("pos") == F.col("n") - 1) | (F.col("pos") % 3 == 1), F.col("rating")))
    got = same_for_all_sizes(last, users, [tpl.RATING], seed=SEED)
    assert len(got) == 6 * 5
    by_user = {(r.user_id, r.pos): r for r in last.collect()}
    for r in got:
        known = [(x.item_id, x.rating) for (u, _), x in sorted(by_user.items()) if u == r[0] and x.rating is not None][:-1]
        pairs = [f"{i} -> {v}" for i, v in known]
        assert any(sep.join(pairs) in r[-1] for sep in (" , ", " ; ")) and f"{sum(v for _, v in known) / len(known):.2f}" in r[-1]
    tasks = [tpl.RATING, tpl.P5_RATING_EVAL]
    kept = same_for_all_sizes(some, users, tasks, seed=SEED, strict=False)
    rated = {r.user_id for r in some.filter("pos = n - 1 AND rating IS NOT NULL").collect()}
    assert {r[0] for r in kept} == rated and all(r[5] is not None and r[6] != [None] for r in kept)
    for size in SIZES:
        with pytest.raises(Exception, match="has no rating"):
            pr.whole_prompts(some, users, tasks, seed=SEED, size=size).collect()
    ex = splits.examples(some, "test", ["item_id", "rating"])
    assert rows(pr.left_out(ex, tpl.RATING)) == [("target without rating", 6 - len(rated))]


def test_small_pools_fail_or_are_counted(spark, hist, users, cat):
    few = neg.catalog(cat.items.filter("item_no < 120").drop("item_idx"), "item_no")
    mine = hist.drop("item_idx", "title", "categories").join(few.items, "item_id")
    mine = number_rows(mine.drop("pos", "n").withColumn("ts", F.col("item_no")), ["user_id"], ["ts"], at_most=200)
    n = {r.user_id: r.n for r in mine.select("user_id", "n").distinct().collect()}
    distinct = {r[0]: r[1] for r in mine.groupBy("user_id").agg(F.countDistinct("item_id")).collect()}
    fits = {u for u in n if n[u] > 1 and 120 - distinct[u] >= 99}
    assert fits and len(fits) < len(n)
    got = same_for_all_sizes(mine, users, [tpl.P5_DIRECT_EVAL], seed=SEED, catalog=few, strict=False)
    assert {r[0] for r in got} == fits
    for size in SIZES:
        with pytest.raises(Exception, match="items are left to draw"):
            pr.whole_prompts(mine, users, [tpl.P5_DIRECT_EVAL], seed=SEED, catalog=few, size=size).collect()
    ex = splits.examples(mine, "test", pr.FIELDS[tpl.P5_DIRECT_EVAL])
    assert rows(pr.left_out(ex, tpl.P5_DIRECT_EVAL, few)) == [("too few other items", len(n) - len(fits))]


def test_forced_templates(hist, users, cat):
    got = same_for_all_sizes(hist, users, [tpl.RATING, tpl.SEQUENTIAL], seed=SEED, catalog=cat, force={"Rating_Prediction": "2", tpl.SEQUENTIAL: "4"})
    assert {(r[2], r[3]) for r in got} == {(tpl.RATING, "2"), (tpl.SEQUENTIAL, "4")}
    with pytest.raises(KeyError):
        pr.whole_prompts(hist, users, [tpl.RATING], seed=SEED, force={tpl.RATING: "9"})


def test_new_task_with_facts_for_any_length(hist, users):
    def build(ex, s):
        ex = pr.with_template(pr.with_facts(ex, s, "liked", "rating"), s, "inference")
        slots = pr.user_slots(ex) | {
            "kinds": F.concat_ws("+", "liked"), "total": F.col("rating_sum").cast("string"), "target_item": F.col("target.item_id"),
            "history": pr.ListSlot(F.col("input.item_id"), "/", "|", s.coin("separator"))}
        return pr.rendered(ex, s, ["inference"], slots, F.col("target.item_id"))

    words = "{user_id}: {history} of {kinds}, {total} points"
    tpl.register_task("summed", ERROR, [tpl.Template("summed", "0", "inference", words, "{target_item}")])
    pr.register_builder("summed", ["item_id", "rating", "categories"], build, ["liked", "rating"])
    try:
        assert len(same_for_all_sizes(hist, users, ["summed"], seed=SEED)) == 6
    finally:
        for registry in (tpl.TEMPLATES, tpl.TASK_FAMILY, pr.BUILDERS, pr.FIELDS, pr.FACTS):
            registry.pop("summed")


def test_a_large_catalog_gives_the_same_prompts_from_one_lookup(spark, cat, hist, users, monkeypatch):
    """Drawn items cross the shuffle packed: no row per drawn item, and one look-up for all tasks."""
    from basketry.operators import lookup

    tasks = [tpl.SEQUENTIAL, tpl.DIRECT, tpl.P5_SEQUENTIAL, tpl.P5_DIRECT]
    ex = pr.add_users(sampling.train_examples(hist, pr.fields_of(tasks), 2, SEED), users)
    for strategy in ("all", "random"):
        build = lambda: pr.build_training_prompts(ex, tasks, seed=SEED, strategy=strategy, catalog=cat)
        small = rows(build())
        monkeypatch.setattr(neg, "BROADCAST_ROWS", 10)
        monkeypatch.setattr(lookup, "CHUNK_BITS", 1)
        monkeypatch.setattr(lookup, "RANGE_ITEMS", 7)
        large = build()
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert rows(large) == small and len(small) > 0
        monkeypatch.undo()
        assert plan.count("FlatMapCoGroupsInArrow") == 2 and "posexplode" not in plan


def test_excluded_items_say_their_step(spark, cat):
    """The first stretch is walked without a row per step: only excluded items that lie on it are gathered."""
    a = spark.range(1, cat.prime).select(((F.col("id") * neg.inverse(F.col("id"), cat.prime)) % cat.prime).alias("one"))
    assert {r.one for r in a.collect()} == {1}
    keys = spark.createDataFrame([(f"k{i}", i) for i in range(4)] + [(None, 9)], "k string, more int")
    excluded = keys.filter("k IS NOT NULL").select("k").join(cat.items.select("item_idx").filter("item_idx % 9 = 0"))
    got = neg.negative_lists(keys, excluded, cat, 10, ["k"], SEED, F.col("k"))
    assert "BatchEvalPython" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan
    gone = F.when(F.col("k").isNotNull(), F.lit(list(range(0, cat.size, 9))).cast("array<bigint>")).otherwise(F.array().cast("array<bigint>"))
    want = keys.select("k", "more", neg.negative_indexes(cat, gone, 10, SEED, F.col("k")).alias("i"))
    assert rows(got.select("k", "more", F.col("found")["item_idx"].alias("i"))) == rows(want)


def test_pieces_make_no_text_twice(hist, users):
    """The texts are made after the templates have come, not in the condition of their join as well."""
    out = pr.whole_prompts(hist, users, [tpl.RATING], seed=SEED, size=10).filter(F.col("part_no") != pr.WHOLE)
    assert "size(transform(" not in out._jdf.queryExecution().executedPlan().toString()
