"""Sampling, negatives and prompt building."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from basketry.functions import draws
from basketry.operators import history as hist_ops
from basketry.operators import negatives as neg
from basketry.operators import sampling, splits
from basketry.operators.metricspec import RANKING
from basketry.plans import prompts as pr
from basketry.plans import templates as tpl
from basketry.sources import retail
from basketry.storage import fresh_path, pin
from checks.base import HISTORY, ITEMS, SEED, USERS, draw_sql, history, query, text_sql, with_ctes

EPOCHS = 2
PIECE = 16  # segment length that makes ordinary users long


# ---- inputs -----------------------------------------------------------------


def item_catalog(spark, folder) -> neg.Catalog:
    return neg.catalog(retail.items(spark, folder), "item_no")


def example_pieces(spark, folder, task, training=False, cat=None):
    """Row form of the examples of users with more than ``PIECE`` rows."""
    fields = pr.FIELDS[task]
    wanted = [f for f in fields if f in ("title", "categories", "item_idx")]
    items = cat.items.select("item_id", *wanted) if wanted else None
    rows = splits.long_users(history(spark, folder, items), PIECE)
    if training:
        rows = pin(rows, "long-history")  # read by the windows and their rows
        train = rows.filter(splits.in_split("train"))
        return sampling.window_rows(train, sampling.training_windows(rows, EPOCHS, SEED), PIECE)
    return splits.example_spots(rows, "test")


# ---- SQL fragments ----------------------------------------------------------

EX_COLUMNS = """h.user_id, h.item_id, h.rating, h.pos, i.title, i.categories, i.item_idx"""
EX_TEST = f"""ex AS (
  SELECT 0 AS epoch, h.pos AS spot, h.pos = h.n - 1 AS is_target, {EX_COLUMNS}
  FROM hist h JOIN items i USING (item_id) WHERE h.n >= 2)"""

WINDOWS = f"""win AS (
  SELECT user_id, epoch, size, {draw_sql(SEED, "epoch", "user_id", "'window/start'")} % (len - size) AS start
  FROM (SELECT user_id, epoch, len, least + {draw_sql(SEED, "epoch", "user_id", "'window/size'")}
                 % (len - least) AS size
        FROM (SELECT user_id, n - 2 AS len, CASE WHEN n - 2 = 2 THEN 1 ELSE 2 END AS least,
                unnest(range(1, {EPOCHS + 1})) AS epoch
              FROM hist WHERE pos = 0 AND n >= 4)))"""
EX_TRAIN = f"""ex AS (
  SELECT w.epoch, h.pos - w.start AS spot, h.pos - w.start = w.size AS is_target, {EX_COLUMNS}
  FROM hist h JOIN win w USING (user_id) JOIN items i USING (item_id)
  WHERE h.pos BETWEEN w.start AND w.start + w.size)"""


def resampled(purpose: str) -> str:
    """Training target of the direct task: any position of input + target."""
    at = draw_sql(SEED, "epoch", "user_id", text_sql(purpose))
    return f"""ex AS (
  SELECT * EXCLUDE (is_target), spot = {at} % (count(*) OVER (PARTITION BY user_id, epoch)) AS is_target
  FROM ex0)"""


def packed_rows(category_purpose: str = "x") -> str:
    pick = draw_sql(SEED, "epoch", "user_id", text_sql(category_purpose), "pos")
    return f"""packed AS (
  SELECT user_id, epoch, user_name, user_key,
    list(item_id ORDER BY spot) FILTER (NOT is_target) AS items,
    list(rating ORDER BY spot) FILTER (NOT is_target) AS ratings,
    list(categories[{pick} % 3 + 1] ORDER BY spot) FILTER (NOT is_target) AS picked,
    list(categories ORDER BY spot) FILTER (NOT is_target) AS all_categories,
    list(item_idx ORDER BY spot) FILTER (NOT is_target) AS input_idx,
    any_value(item_id) FILTER (is_target) AS target_item,
    any_value(rating) FILTER (is_target) AS target_rating,
    any_value(title) FILTER (is_target) AS target_title,
    any_value(item_idx) FILTER (is_target) AS target_idx
  FROM ex JOIN users USING (user_id) GROUP BY ALL)"""


def base(training: bool, category_purpose: str = "x", target_purpose: str | None = None):
    ctes = [HISTORY, ITEMS, USERS]
    if not training:
        ctes.append(EX_TEST)
    elif target_purpose is None:
        ctes += [WINDOWS, EX_TRAIN]
    else:
        ctes += [WINDOWS, EX_TRAIN.replace("ex AS", "ex0 AS", 1), resampled(target_purpose)]
    return [*ctes, packed_rows(category_purpose)]


CONSTS = """consts AS (
  SELECT n_items, (SELECT min(c) FROM range(n_items, n_items + 500) t(c)
    WHERE NOT EXISTS (SELECT 1 FROM range(2, 2000) d(k) WHERE k * k <= c AND c % k = 0)) AS prime
  FROM (SELECT count(*) AS n_items FROM part))"""


def negative_ctes(name: str, purpose: str, n: int, outside_history: bool) -> list[str]:
    excluded = "list_append(input_idx, target_idx)" if outside_history else "[target_idx]"
    a = draw_sql(SEED, "epoch", "user_id", text_sql(purpose), "'a'")
    b = draw_sql(SEED, "epoch", "user_id", text_sql(purpose), "'b'")
    return [
        CONSTS,
        f"""{name}_walk AS (
  SELECT user_id, epoch, excluded, step, (a * step + b) % prime AS item_idx FROM (
    SELECT user_id, epoch, {excluded} AS excluded, prime, 1 + {a} % (prime - 1) AS a, {b} % prime AS b,
      unnest(range(0, least(prime, {n} + len({excluded}) + prime - n_items))) AS step
    FROM packed, consts))""",
        f"""{name} AS (
  SELECT user_id, epoch, step, item_id, title,
    row_number() OVER (PARTITION BY user_id, epoch ORDER BY step) AS rank
  FROM {name}_walk JOIN items USING (item_idx) WHERE NOT list_contains(excluded, item_idx)
  QUALIFY rank <= {n})""",
    ]


def candidate_ctes(purpose: str, n: int, outside_history: bool) -> list[str]:
    order = draw_sql(SEED, "epoch", "user_id", text_sql(purpose), "'shuffle/' || item_id")
    return [
        *negative_ctes("wrong", purpose, n, outside_history),
        f"""cand AS (
  SELECT user_id, epoch, list(item_id ORDER BY {order}, item_id) AS candidates FROM (
    SELECT user_id, epoch, item_id FROM wrong
    UNION ALL SELECT user_id, epoch, target_item FROM packed)
  GROUP BY user_id, epoch HAVING count(*) = {n + 1})""",
    ]


def choose_sql(options, *parts) -> str:
    listed = ", ".join(text_sql(o) for o in options)
    return f"list_extract([{listed}], CAST({draw_sql(*parts)} % {len(options)} AS INT) + 1)"


def fill_sql(template: str, slots: dict[str, str]) -> str:
    out = []
    for literal, slot, _, _ in string.Formatter().parse(template):
        if literal:
            out.append(text_sql(literal))
        if slot is not None:
            out.append(f"({slots[slot]})")
    return " || ".join(out)


def chain_sql(templates, value) -> str:
    cases = " ".join(f"WHEN {text_sql(t.template_id)} THEN {value(t)}" for t in templates)
    return f"CASE template_id {cases} END"


def join_sql(items: str, first: str, second: str, coin: str) -> str:
    one, two = (f"array_to_string({items}, {text_sql(sep)})" for sep in (first, second))
    return f"CASE WHEN {coin} THEN {one} ELSE {two} END"


def prompt_select(source: str, task: str, roles, slots, truth: str | None, training, pick=None) -> str:
    """SELECT of one prompt family; ``pick`` is the draw purpose of its template."""
    known = [t for r in roles for t in tpl.templates(task, r)]
    ids = [t.template_id for t in known]
    if pick == "template":
        ids = [t.template_id for t in tpl.templates(task)]
    if training:
        purpose = text_sql(f"{task}/{pick or roles[0] + '/template'}")
        rows = f"SELECT *, {choose_sql(ids, SEED, 'epoch', 'user_id', purpose)} AS template_id FROM {source}"
    else:
        listed = ", ".join(text_sql(i) for i in ids)
        rows = f"SELECT *, unnest([{listed}]) AS template_id FROM {source}"
    role = chain_sql(known, lambda t: text_sql(t.role))
    gt = "CAST(NULL AS VARCHAR)" if truth is None else f"CASE WHEN {role} = 'inference' THEN {truth} END"
    return f"""SELECT user_id, CAST(epoch AS BIGINT) AS epoch, {text_sql(task)} AS task, template_id,
      {role} AS role, md5({chain_sql(known, lambda t: fill_sql(t.input_text, slots))}) AS input_md5,
      {chain_sql(known, lambda t: fill_sql(t.target_text, slots))} AS target_text, {gt} AS truth
    FROM ({rows})"""


NAME = "CASE WHEN user_name = '' THEN user_key ELSE user_name END"


def coin_sql(task: str, purpose: str, training: bool) -> str:
    tag = "'train'" if training else "template_id"
    return f"{draw_sql(SEED, 'epoch', 'user_id', text_sql(f'{task}/{purpose}'), tag)} % 2 = 1"


def once_coin(task: str, purpose: str) -> str:
    return f"{draw_sql(SEED, 'epoch', 'user_id', text_sql(f'{task}/{purpose}'))} % 2 = 1"


def checked(df):
    return df.select(
        "user_id",
        "epoch",
        "task",
        "template_id",
        "role",
        F.md5(F.col("input_text").cast("binary")).alias("input_md5"),
        "target_text",
        F.get("ground_truth", F.lit(0)).alias("truth"),
    )


# ---- prompt SQL per task ----------------------------------------------------


def rating_sql() -> str:
    return with_ctes(*base(False), rating_select())


def rating_select(where: str = "") -> str:
    task = tpl.RATING
    pairs = "list_transform(list_zip(items, ratings), lambda z: z[1] || ' -> ' || CAST(z[2] AS VARCHAR))"
    slots = {
        "user_id": "user_id",
        "avg_rating": "printf('%.2f', CAST(list_sum(ratings) AS DOUBLE) / len(ratings))",
        "rated_history": join_sql(pairs, " , ", " ; ", coin_sql(task, "separator", False)),
        "item_id": "target_item",
        "target_rating": "CAST(target_rating AS VARCHAR)",
    }
    return prompt_select("packed" + where, task, ["inference"], slots, slots["target_rating"], False)


def sequential_slots(training: bool) -> dict[str, str]:
    coin = coin_sql(tpl.SEQUENTIAL, "separator", training)
    return {
        "user_id": "user_id",
        "history": join_sql("items", " , ", " ; ", coin),
        "category_history": join_sql("picked", " , ", " ; ", coin),
        "target_item": "target_item",
    }


def bullet_sql(task: str) -> str:
    marker = f"CASE WHEN {coin_sql(task, 'bullet', True)} THEN '* ' ELSE '- ' END"
    return f"array_to_string(list_transform(candidates, lambda c: {marker} || c || chr(10)), '')"


def sequential_parts(training: bool) -> tuple[list[str], list[str]]:
    """CTEs and the SELECT of each family (inference, qa, pair)."""
    task = tpl.SEQUENTIAL
    ctes = base(training, f"{task}/category")
    slots = sequential_slots(training)
    selects = [prompt_select("packed", task, ["inference"], slots, "target_item", training)]
    if training:
        ctes += candidate_ctes(f"{task}/candidates", pr.FEW, False)
        qa = slots | {"candidates": bullet_sql(task)}
        selects.append(
            prompt_select("packed JOIN cand USING (user_id, epoch)", task, ["qa"], qa, None, True)
        )
        at = f"CAST({draw_sql(SEED, 'epoch', 'user_id', text_sql(f'{task}/pair'))} % len(items) AS INT) + 1"
        pair = {
            "user_id": "user_id",
            "previous_item": f"items[{at}]",
            "previous_categories": join_sql(
                f"all_categories[{at}]", " , ", " ; ", coin_sql(task, "pair/separator", True)
            ),
            "target_item": f"coalesce(items[{at} + 1], target_item)",
        }
        selects.append(prompt_select("packed", task, ["pair"], pair, None, True))
    return ctes, selects


def direct_parts(training: bool) -> tuple[list[str], list[str]]:
    task = tpl.DIRECT
    ctes = base(training, target_purpose=f"{task}/target" if training else None)
    liked = "list_sort(list_distinct(flatten(all_categories)))"
    slots = {
        "user_id": "user_id",
        "liked_categories": join_sql(liked, " , ", " ; ", coin_sql(task, "separator", training)),
        "target_item": "target_item",
    }
    selects = [prompt_select("packed", task, ["inference"], slots, "target_item", training)]
    if training:
        ctes += candidate_ctes(f"{task}/candidates", pr.FEW, False)
        qa = slots | {"candidates": bullet_sql(task)}
        selects.append(
            prompt_select("packed JOIN cand USING (user_id, epoch)", task, ["qa"], qa, None, True)
        )
    return ctes, selects


PERTURBED = """CASE target_rating {cases} END"""


def stars_sql(task: str) -> str:
    def parts(tag):
        return draw_sql(SEED, "epoch", "user_id", text_sql(f"{task}/stars"), tag)

    span = float(draws.DRAW_SPAN)
    u1, u2 = (f"((CAST({parts(t)} AS DOUBLE) + 0.5) / {span!r})" for t in ("'r'", "'t'"))
    normal = f"sqrt(-2.0 * ln({u1})) * cos(2 * pi() * {u2})"

    def by_star(value):
        return "CASE target_rating " + " ".join(
            f"WHEN {star} THEN {value(*b)!r}" for star, b in sampling.STAR_RANGES.items()
        ) + " END"

    mean, std = by_star(lambda lo, hi: (lo + hi) / 2), by_star(lambda lo, hi: (hi - lo) / 4)
    value = f"CAST({mean} AS DOUBLE) + CAST({std} AS DOUBLE) * {normal}"
    return f"least(greatest(floor(({value}) * 10 + 0.5) / 10, 1.0), 5.0)"


def wrong_sql(task: str) -> str:
    return f"(target_rating + {draw_sql(SEED, 'epoch', 'user_id', text_sql(f'{task}/wrong'))} % 4) % 5 + 1"


def p5_rating_sql(task: str, training: bool) -> str:
    return with_ctes(*base(training), p5_rating_select(task, training))


def p5_rating_select(task: str, training: bool) -> str:
    rated = "CAST(target_rating AS VARCHAR)"
    shown = coin_sql(task, "shown", training)
    slots = {
        "user_id": "user_id",
        "user_name": NAME,
        "item_id": "target_item",
        "item_title": "CASE WHEN target_title = '' THEN 'unknown title' ELSE target_title END",
        "star_rating": f"printf('%.1f', {stars_sql(task)})" if training else rated,
        "shown_rating": f"CASE WHEN {shown} THEN {rated} ELSE CAST({wrong_sql(task)} AS VARCHAR) END",
        "yes_no": f"CASE WHEN {shown} THEN 'yes' ELSE 'no' END",
        "like_dislike": "CASE WHEN target_rating >= 4 THEN 'like' ELSE 'dislike' END",
    }
    roles = ["inference", "support"] if training else ["inference"]
    pick = "template" if training else None
    return prompt_select("packed", task, roles, slots, rated, training, pick)


def shown_parts(task: str) -> tuple[list[str], str, dict[str, str]]:
    ctes = negative_ctes("other", f"{task}/other", 1, False)
    source = """packed JOIN (SELECT user_id, epoch, item_id AS other_item, title AS other_title FROM other)
      USING (user_id, epoch)"""
    coin = once_coin(task, "shown")
    title = f"CASE WHEN {coin} THEN target_title ELSE other_title END"
    return ctes, source, {
        "user_id": "user_id",
        "user_name": NAME,
        "shown_item": f"CASE WHEN {coin} THEN target_item ELSE other_item END",
        "shown_title": f"CASE WHEN {title} = '' THEN 'unknown title' ELSE {title} END",
        "yes_no": f"CASE WHEN {coin} THEN 'yes' ELSE 'no' END",
    }


def p5_sequential_parts(task: str, training: bool) -> tuple[list[str], list[str]]:
    ctes = base(training)
    coin = coin_sql(task, "separator", training)
    slots = {
        "user_id": "user_id",
        "user_name": NAME,
        "history": join_sql("items", " , ", " -> ", coin),
        "target_item": "target_item",
    }
    selects = [prompt_select("packed", task, ["inference"], slots, "target_item", training)]
    if training:
        ctes += candidate_ctes(f"{task}/candidates", pr.MANY, True)
        qa = slots | {"candidates": join_sql("candidates", " , ", " -> ", coin)}
        selects.append(
            prompt_select("packed JOIN cand USING (user_id, epoch)", task, ["qa"], qa, None, True)
        )
        more, source, shown = shown_parts(task)
        ctes += more
        selects.append(prompt_select(source, task, ["pair"], slots | shown, None, True))
    return ctes, selects


def p5_direct_parts(task: str, training: bool) -> tuple[list[str], list[str]]:
    ctes = base(training) + candidate_ctes(f"{task}/candidates", pr.MANY, True)
    slots = {
        "user_id": "user_id",
        "user_name": NAME,
        "candidates": "array_to_string(candidates, ' , ')",
        "target_item": "target_item",
    }
    selects = [
        prompt_select(
            "packed JOIN cand USING (user_id, epoch)", task, ["inference"], slots, "target_item", training
        )
    ]
    if training:
        more, source, shown = shown_parts(task)
        ctes += more
        selects.append(prompt_select(source, task, ["support"], shown, None, True))
    return ctes, selects


def one_role(parts: tuple[list[str], list[str]], index: int | None = None) -> str:
    ctes, selects = parts
    chosen = selects if index is None else [selects[index]]
    return with_ctes(*ctes, "\nUNION ALL ".join(chosen))


# ---- prompt queries ---------------------------------------------------------


def whole(spark, folder, tasks, training=False, strategy="all", rating=None, **options):
    """Prompts of all users (long histories as pieces); ``rating`` replaces the ratings."""
    cat = item_catalog(spark, folder)
    fields = [f for f in pr.fields_of(tasks) if f in ("title", "categories", "item_idx")]
    rows = history(spark, folder, cat.items.select("item_id", *fields) if fields else None)
    if rating is not None:
        rows = rows.withColumn("rating", rating)
    return pr.whole_prompts(
        rows,
        retail.users(spark, folder),
        tasks,
        seed=SEED,
        epochs=EPOCHS if training else None,
        strategy=strategy,
        catalog=cat,
        **options,
    )


def joined_pieces(out):
    """Whole texts again from the pieces."""
    cells = F.sort_array(F.collect_list(F.struct("part_no", "segment_no", "input_text")))
    names = ["user_id", "epoch", "task", "template_id", "role", "target_text", "ground_truth"]
    return checked(out.groupBy(*names).agg(F.array_join(cells["input_text"], "").alias("input_text")))


def register(name, sql, task, training=False, role=None):
    def run(spark, folder):
        rows = whole(spark, folder, [task], training)
        return checked(rows if role is None else rows.filter(F.col("role") == role))

    run.__name__ = name
    query(sql)(run)


register("prompt_rating", rating_sql(), tpl.RATING)
register("prompt_sequential", one_role(sequential_parts(False)), tpl.SEQUENTIAL)
register("prompt_seq_qa", one_role(sequential_parts(True), 1), tpl.SEQUENTIAL, True, "qa")
register("prompt_seq_pair", one_role(sequential_parts(True), 2), tpl.SEQUENTIAL, True, "pair")
register("prompt_direct", one_role(direct_parts(False)), tpl.DIRECT)
register("prompt_direct_train", one_role(direct_parts(True), 0), tpl.DIRECT, True, "inference")
register("prompt_direct_qa", one_role(direct_parts(True), 1), tpl.DIRECT, True, "qa")
register("prompt_p5_rating", p5_rating_sql(tpl.P5_RATING, True), tpl.P5_RATING, True)
register("prompt_p5_rating_eval", p5_rating_sql(tpl.P5_RATING_EVAL, False), tpl.P5_RATING_EVAL)
register("prompt_p5_seq", one_role(p5_sequential_parts(tpl.P5_SEQUENTIAL, False)), tpl.P5_SEQUENTIAL)
register("prompt_p5_seq_qa", one_role(p5_sequential_parts(tpl.P5_SEQUENTIAL, True), 1), tpl.P5_SEQUENTIAL, True, "qa")
register("prompt_p5_pairwise", one_role(p5_sequential_parts(tpl.P5_SEQUENTIAL, True), 2), tpl.P5_SEQUENTIAL, True, "pair")
register("prompt_p5_seq_eval", one_role(p5_sequential_parts(tpl.P5_SEQUENTIAL_EVAL, False)), tpl.P5_SEQUENTIAL_EVAL)
register("prompt_p5_direct", one_role(p5_direct_parts(tpl.P5_DIRECT, False)), tpl.P5_DIRECT)
register("prompt_p5_support", one_role(p5_direct_parts(tpl.P5_DIRECT, True), 1), tpl.P5_DIRECT, True, "support")
register("prompt_p5_direct_eval", one_role(p5_direct_parts(tpl.P5_DIRECT_EVAL, False)), tpl.P5_DIRECT_EVAL)


def register_pieces(name, sql, task, training=False):
    """The same prompts, built in segments of 16 items and put together again."""

    def run(spark, folder):
        cat = item_catalog(spark, folder)
        rows = example_pieces(spark, folder, task, training, cat)
        users = retail.users(spark, folder)
        out = pr.build_prompt_pieces(
            rows, users, task, seed=SEED, training=training, catalog=cat, size=PIECE
        )
        return joined_pieces(out)

    run.__name__ = name
    long = f"(SELECT user_id FROM hist WHERE pos = 0 AND n > {PIECE})"
    query(
        sql.replace("FROM ex JOIN users USING (user_id)", f"FROM ex JOIN users USING (user_id) WHERE user_id IN {long}")
    )(run)


register_pieces("pieces_rating", rating_sql(), tpl.RATING)
register_pieces("pieces_sequential", one_role(sequential_parts(False)), tpl.SEQUENTIAL)
register_pieces("pieces_sequential_train", one_role(sequential_parts(True)), tpl.SEQUENTIAL, True)
register_pieces("pieces_direct_train", one_role(direct_parts(True)), tpl.DIRECT, True)
register_pieces("pieces_p5_rating_train", p5_rating_sql(tpl.P5_RATING, True), tpl.P5_RATING, True)
register_pieces("pieces_p5_sequential_train", one_role(p5_sequential_parts(tpl.P5_SEQUENTIAL, True)), tpl.P5_SEQUENTIAL, True)
register_pieces("pieces_p5_direct_train", one_role(p5_direct_parts(tpl.P5_DIRECT, True)), tpl.P5_DIRECT, True)


# ---- several tasks, unrated rows ------------------------------------------------


@query(
    with_ctes(
        *base(False),
        "\nUNION ALL ".join(
            [
                rating_select(),
                p5_rating_select(tpl.P5_RATING_EVAL, False),
                *p5_sequential_parts(tpl.P5_SEQUENTIAL_EVAL, False)[1],
            ]
        ),
    )
)
def prompt_eval_suite(spark, folder):
    """Three tasks in one evaluation build; histories of more than 16 items come in pieces."""
    tasks = [tpl.RATING, tpl.P5_RATING_EVAL, tpl.P5_SEQUENTIAL_EVAL]
    return joined_pieces(whole(spark, folder, tasks, size=PIECE))


RATED_PART = [
    HISTORY,
    ITEMS,
    USERS,
    EX_TEST.replace("h.rating", "CASE WHEN (CAST(h.user_id AS BIGINT) + h.pos) % 13 <> 0 THEN h.rating END AS rating"),
    packed_rows().replace("FILTER (NOT is_target)", "FILTER (NOT is_target AND rating IS NOT NULL)"),
]


@query(with_ctes(*RATED_PART, rating_select(" WHERE target_rating IS NOT NULL AND len(items) > 0")))
def prompt_unrated(spark, folder):
    """Every 13th row has no rating: no part of a history, and no prompt as a target."""
    rating = F.when((F.col("user_id").cast("bigint") + F.col("pos")) % 13 != 0, F.col("rating"))
    return joined_pieces(whole(spark, folder, [tpl.RATING], rating=rating, strict=False, size=PIECE))


# ---- tasks and layouts from outside ------------------------------------------------


@query(
    with_ctes(
        *base(False),
        """SELECT user_id, template_id, CASE template_id WHEN '0' THEN user_id || ' saw ' || CAST(len(items) AS VARCHAR) || ' items, last ' || items[len(items)]
          ELSE items[len(items)] || ' -> ?' END AS input_text, target_item AS target_text
        FROM (SELECT *, unnest(['0', '1']) AS template_id FROM packed)""",
    )
)
def registered_task(spark, folder):
    """A task with a builder of its own, registered, found in any letter case, and built for all users."""
    name = "last_item"

    def build(ex, s):
        ex = pr.with_template(ex, s, "inference")
        slots = pr.user_slots(ex) | {
            "count": F.size("input").cast("string"),
            "last": F.element_at("input", -1)["item_id"],
            "target_item": F.col("target.item_id"),
        }
        return pr.rendered(ex, s, ["inference"], slots, F.col("target.item_id"))

    words = [("0", "{user_id} saw {count} items, last {last}"), ("1", "{last} -> ?")]
    tpl.register_task(name, RANKING, [tpl.Template(name, i, "inference", w, tpl.ITEM) for i, w in words])
    pr.register_builder(name, ["item_id"], build)
    try:
        out = whole(spark, folder, ["LAST_item"])
        return out.select("user_id", "template_id", "input_text", "target_text")
    finally:
        for registry in (tpl.TEMPLATES, tpl.TASK_FAMILY, pr.BUILDERS, pr.FIELDS, pr.FACTS):
            registry.pop(name)


@query(with_ctes(*base(False), rating_select()))
def prompt_from_columns(spark, folder):
    """Examples go through the published list columns, with one target each, and become prompts."""
    fields = pr.FIELDS[tpl.RATING]
    flat = splits.flat_columns(splits.examples(history(spark, folder), "test", fields), fields)
    path = fresh_path(spark, "flat")
    flat.write.parquet(path)
    back = hist_ops.add_users(pr.from_columns(spark.read.parquet(path), fields), retail.users(spark, folder))
    return checked(pr.build_prompts(back, tpl.RATING, seed=SEED))
