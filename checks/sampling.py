"""Draws, negatives, labels and text pieces, each as its own query."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import draws, text
from basketry.operators import negatives as neg
from basketry.operators import sampling, splits
from basketry.operators.numbering import shuffled_index
from basketry.operators.tokens import batch_no
from basketry.plans import prompts as pr
from basketry.plans import templates as tpl
from basketry.sources import retail
from basketry.storage import pin
from checks.base import (
    HISTORY,
    ITEMS,
    SEED,
    USERS,
    draw_sql,
    history,
    query,
    rounded,
    text_sql,
    with_ctes,
)
from checks.prompts import (
    CONSTS,
    EPOCHS,
    EX_TRAIN,
    WINDOWS,
    base,
    candidate_ctes,
    checked,
    choose_sql,
    direct_parts,
    item_catalog,
    negative_ctes,
    p5_sequential_parts,
    sequential_parts,
    stars_sql,
    whole,
    wrong_sql,
)

WHO = ("epoch", "user_id")


def who():
    return SEED, F.col("epoch"), F.col("user_id")


@query(
    with_ctes(
        HISTORY,
        ITEMS,
        WINDOWS,
        EX_TRAIN,
        """SELECT user_id, epoch::BIGINT AS epoch, string_agg(item_id, ' ' ORDER BY spot) FILTER (NOT is_target) AS input,
          any_value(item_id) FILTER (is_target) AS target FROM ex GROUP BY user_id, epoch""",
    )
)
def train_window_sample(spark, folder):
    """The windows as texts; those of long windows are joined from segments."""
    rows = pin(history(spark, folder).drop("rating"), "history")
    spots = sampling.window_rows(rows, sampling.training_windows(rows, EPOCHS, SEED))
    inputs = spots.filter(F.col("part") == "input").withColumn("segment_no", F.expr("spot div 4096"))
    lists = inputs.groupBy("user_id", "epoch", "segment_no").agg(
        F.sort_array(F.collect_list(F.struct("spot", "item_id"))).alias("seq")
    )
    ends = spots.filter(F.col("part") == "target").select("user_id", "epoch", F.col("item_id").alias("target"))
    inputs = splits.whole_texts(lists, ["user_id", "epoch"], F.array_join("seq.item_id", " "), " ", "input")
    return inputs.join(ends, ["user_id", "epoch"]).select("user_id", "epoch", "input", "target")


MERGED = WINDOWS.replace("n - 2", "n - 1").replace("n >= 4", "n >= 3")


@query(
    with_ctes(
        HISTORY,
        ITEMS,
        MERGED,
        EX_TRAIN,
        """SELECT user_id, epoch::BIGINT AS epoch, string_agg(item_id, ' ' ORDER BY spot) FILTER (NOT is_target) AS input,
          any_value(item_id) FILTER (is_target) AS target FROM ex GROUP BY user_id, epoch""",
    )
)
def train_window_merged(spark, folder):
    """Windows over the merged train and validation rows."""
    rows = pin(history(spark, folder).drop("rating"), "history")
    windows = sampling.training_windows(rows, EPOCHS, SEED, "train_validation")
    spots = sampling.window_rows(rows, windows)
    inputs = spots.filter(F.col("part") == "input").withColumn("segment_no", F.expr("spot div 4096"))
    lists = inputs.groupBy("user_id", "epoch", "segment_no").agg(
        F.sort_array(F.collect_list(F.struct("spot", "item_id"))).alias("seq")
    )
    ends = spots.filter(F.col("part") == "target").select("user_id", "epoch", F.col("item_id").alias("target"))
    texts = splits.whole_texts(lists, ["user_id", "epoch"], F.array_join("seq.item_id", " "), " ", "input")
    return texts.join(ends, ["user_id", "epoch"]).select("user_id", "epoch", "input", "target")


@query(
    with_ctes(
        HISTORY,
        WINDOWS,
        """SELECT w.user_id, w.epoch::BIGINT AS epoch, w.spot, h.item_id, CASE WHEN w.spot = w.size THEN 'target' ELSE 'input' END AS part
        FROM (SELECT *, unnest(range(0, size + 1)) AS spot FROM win) w JOIN hist h ON h.user_id = w.user_id AND h.pos = w.start + w.spot""",
    )
)
def train_window_rows(spark, folder):
    """The same windows as rows, without a list per user."""
    rows = pin(history(spark, folder).drop("rating"), "history")
    windows = sampling.training_windows(rows, EPOCHS, SEED)
    return sampling.window_rows(rows, windows).select("user_id", "epoch", "spot", "item_id", "part")


@query(
    with_ctes(
        HISTORY,
        "SELECT count(*) AS n_dropped FROM hist WHERE pos = 0 AND n - 2 < 2",
    )
)
def train_window_rejects(spark, folder):
    return sampling.too_short(history(spark, folder)).agg(F.count(F.lit(1)).alias("n_dropped"))


def histories_with_index(spark, folder, cat):
    """Test histories with catalog indexes."""
    rows = history(spark, folder, cat.items.select("item_id", "item_idx"))
    return rows.filter(F.col("n") >= 2).select("user_id", "pos", "n", "item_id", "item_idx")


def indexed_history(spark, folder, cat):
    """:func:`histories_with_index`, pinned."""
    return pin(histories_with_index(spark, folder, cat), "indexed")


def excluded_rows(rows):
    """Distinct (user_id, epoch, item_idx) of the histories."""
    return rows.select("user_id", F.lit(0).cast("bigint").alias("epoch"), "item_idx").distinct()


KEYS = ["user_id", "epoch"]


@query(
    with_ctes(
        *base(False),
        *negative_ctes("wrong", "draw", 4, False),
        "SELECT user_id, rank - 1 AS place, item_id FROM wrong",
    )
)
def negatives_4(spark, folder):
    """Four items that are not the target: needs no history, only the target rows."""
    cat = item_catalog(spark, folder)
    ex = pin(splits.targets(histories_with_index(spark, folder, cat), "test", ["item_id", "item_idx"]), "targets")
    drawn = neg.negative_indexes(cat, neg.excluded_indexes(False), 4, *who(), "draw")
    found = neg.look_up(ex.select(*KEYS, drawn.alias("idx")), "idx", cat, KEYS, ["item_id"])
    return found.select("user_id", F.col("ord").cast("bigint").alias("place"), "item_id")


@query(
    with_ctes(
        *base(False),
        *negative_ctes("wrong", "draw", 99, True),
        "SELECT user_id, rank - 1 AS place, item_id FROM wrong",
    )
)
def negatives_99(spark, folder):
    """99 items outside history and target: lists for short histories, rows for long ones."""
    cat = item_catalog(spark, folder)
    rows = indexed_history(spark, folder, cat)
    ex = splits.examples(rows, "test", ["item_id", "item_idx"])
    drawn = neg.negative_indexes(cat, neg.excluded_indexes(True), 99, *who(), "draw")
    found = neg.look_up(ex.select(*KEYS, drawn.alias("idx")), "idx", cat, KEYS, ["item_id"])
    short = found.select("user_id", F.col("ord").cast("bigint").alias("place"), "item_id")
    return short.unionByName(placed_negatives(splits.long_users(rows), cat))


def placed_negatives(rows, cat):
    """99 negatives by the anti join, numbered in the order of the walk."""
    users = rows.filter(F.col("pos") == 0).select("user_id", F.lit(0).cast("bigint").alias("epoch"))
    drawn = neg.negative_lists(users, excluded_rows(rows), cat, 99, KEYS, *who(), "draw")
    drawn = drawn.select(*KEYS, F.col("found")["item_idx"].alias("idx"))
    found = neg.look_up(drawn, "idx", cat, KEYS, ["item_id"])
    return found.select("user_id", F.col("ord").cast("bigint").alias("place"), "item_id")


@query(
    with_ctes(
        *base(False),
        *negative_ctes("wrong", "draw", 99, True),
        "SELECT user_id, rank - 1 AS place, item_id FROM wrong",
    )
)
def negatives_join_form(spark, folder):
    """The 99 negatives with all histories as rows and an anti join."""
    cat = item_catalog(spark, folder)
    return placed_negatives(indexed_history(spark, folder, cat), cat)


@query(
    with_ctes(
        *base(False),
        CONSTS,
        """SELECT count(*) AS n_short FROM packed, consts
        WHERE n_items - len(list_distinct(list_append(input_idx, target_idx))) < n_items - 40""",
    )
)
def negatives_rejects(spark, folder):
    """Rows whose pool is too small; here nearly the whole catalog is asked for."""
    cat = item_catalog(spark, folder)
    seen = excluded_rows(indexed_history(spark, folder, cat))
    return neg.short_pools(seen, cat, cat.size - 40, KEYS).agg(F.count(F.lit(1)).alias("n_short"))


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, (SELECT count(*) FROM part) - count(DISTINCT item_id) AS pool_size
        FROM hist GROUP BY user_id""",
    )
)
def catalog_minus_history(spark, folder):
    """Size of each user's pool of unseen items (the pool itself is never listed)."""
    seen = retail.purchases(spark, folder).select("user_id", "item_id").distinct()
    return neg.pool_sizes(seen, item_catalog(spark, folder), ["user_id"])


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_brand AS brand FROM part WHERE p_partkey NOT IN (
      SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 3)"""
)
def items_never_sampled(spark, folder):
    """Catalog minus the items bought in small quantity."""
    bought = retail.purchases(spark, folder)
    lines = retail.table(spark, folder, "lineitem").filter(F.col("l_quantity") < 3)
    known = bought.select("l_orderkey").distinct()
    small = lines.join(known, "l_orderkey", "left_semi").select(
        F.col("l_partkey").cast("string").alias("item_id")
    )
    return retail.items(spark, folder).join(small, "item_id", "left_anti").select("item_id", "brand")


def user_epochs(spark, folder):
    users = retail.users(spark, folder).select("user_id")
    return sampling.with_epochs(users, EPOCHS)


USER_EPOCHS = f"""ue AS (
  SELECT user_id, unnest(range(1, {EPOCHS + 1})) AS epoch FROM users)"""


@query(
    with_ctes(
        USERS,
        USER_EPOCHS,
        f"""SELECT user_id, epoch, {choose_sql(
            [t.template_id for t in tpl.templates(tpl.SEQUENTIAL, "inference")],
            SEED, *WHO, text_sql(f"{tpl.SEQUENTIAL}/inference/template"))} AS template_id,
          {choose_sql(["2-12"], SEED, *WHO, "'x'")} AS forced_id FROM ue""",
    )
)
def template_pick(spark, folder):
    rows = user_epochs(spark, folder)
    picked = pr.with_template(rows, pr.Setup(tpl.SEQUENTIAL, SEED, True), "inference")
    forced = pr.with_template(rows, pr.Setup(tpl.P5_SEQUENTIAL, SEED, True, force="2-12"), "pair")
    forced = forced.withColumnRenamed("template_id", "forced_id")
    return picked.join(forced, ["user_id", "epoch"]).select("user_id", "epoch", "template_id", "forced_id")


@query(
    with_ctes(
        HISTORY,
        ITEMS,
        f"""SELECT user_id, pos, categories[{draw_sql(SEED, "'0'", "user_id", "'category'", "pos")} % 3 + 1]
          AS category FROM hist JOIN items USING (item_id)""",
    )
)
def category_pick(spark, folder):
    items = retail.items(spark, folder).select("item_id", "categories")
    picked = sampling.pick_category(
        F.col("categories"), SEED, 0, F.col("user_id"), "category", F.col("pos")
    )
    return history(spark, folder, items).select("user_id", "pos", picked.alias("category"))


@query(
    with_ctes(
        *base(True, target_purpose="pick"),
        """SELECT user_id, epoch::BIGINT AS epoch, spot, item_id,
          CASE WHEN is_target THEN 'target' ELSE 'input' END AS part FROM ex""",
    )
)
def target_pick(spark, folder):
    rows = pin(history(spark, folder).drop("rating"), "history")
    windows = sampling.training_windows(rows, EPOCHS, SEED)
    out = sampling.resample_rows(sampling.window_rows(rows, windows, block=16), SEED, "pick")
    return out.select("user_id", "epoch", "spot", "item_id", "part")


def rated_rows(spark, folder):
    rows = history(spark, folder).withColumn("epoch", F.col("pos"))
    return rows.select("user_id", "pos", "epoch", "rating")


RATED_ROWS = "rr AS (SELECT user_id, pos, pos AS epoch, rating AS target_rating FROM hist)"


@query(with_ctes(HISTORY, RATED_ROWS, f"SELECT user_id, pos, {wrong_sql('t')} AS wrong FROM rr"))
def wrong_rating(spark, folder):
    return rated_rows(spark, folder).select(
        "user_id", "pos", sampling.wrong_rating(F.col("rating"), *who(), "t/wrong").alias("wrong")
    )


@query(with_ctes(HISTORY, RATED_ROWS, f"SELECT user_id, pos, {stars_sql('t')} AS stars FROM rr"))
def rating_perturb(spark, folder):
    return rated_rows(spark, folder).select(
        "user_id", "pos", sampling.perturbed_rating(F.col("rating"), *who(), "t/stars").alias("stars")
    )


TASKS = [tpl.RATING, tpl.SEQUENTIAL, tpl.DIRECT]


@query(
    with_ctes(
        USERS, USER_EPOCHS, f"SELECT user_id, epoch, {choose_sql(TASKS, SEED, *WHO, text_sql('task'))} AS task FROM ue"
    )
)
def task_pick(spark, folder):
    task = sampling.pick_task(TASKS, *who())
    return user_epochs(spark, folder).select("user_id", "epoch", task.alias("task"))


@query(
    with_ctes(
        *base(False),
        *candidate_ctes("draw", 99, True),
        "SELECT user_id, array_to_string(candidates, ' ') AS candidates FROM cand",
    )
)
def candidate_shuffle(spark, folder):
    cat = item_catalog(spark, folder)
    rows = indexed_history(spark, folder, cat)
    fields = ["item_id", "item_idx"]
    short = neg.add_candidates(splits.examples(rows, "test", fields), cat, 99, SEED, "draw", True)
    long = splits.long_users(rows)
    ends = splits.targets(long, "test", fields).withColumn("segment_no", F.lit(0))
    more = neg.candidates_by_join(ends, excluded_rows(long), cat, 99, SEED, "draw")
    lists = short.select(*KEYS, "candidates").unionByName(more)
    return lists.select("user_id", F.array_join("candidates", " ").alias("candidates"))


@query(
    with_ctes(
        USERS,
        USER_EPOCHS,
        f"""SELECT user_id, epoch, place, place // 32 AS batch FROM (
          SELECT user_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY
            {draw_sql(SEED, "epoch", "user_id", "'shuffle'")}, user_id) - 1 AS place FROM ue)""",
    )
)
def train_shuffle(spark, folder):
    """Rows of every epoch in seeded random order, cut into batches of 32."""
    mixed = pin(user_epochs(spark, folder).withColumn("draw", draws.draw(*who(), "shuffle")), "epochs")
    out = None
    for epoch, n in sorted((r.epoch, r["count"]) for r in mixed.groupBy("epoch").count().collect()):
        placed = shuffled_index(mixed.filter(F.col("epoch") == epoch), "draw", ["user_id"], "place", n)
        out = placed if out is None else out.unionByName(placed)
    return batch_no(out, "place", 32).select("user_id", "epoch", "place", "batch")


@query(
    with_ctes(
        USERS,
        "t(task, template_id) AS (VALUES "
        + ", ".join(
            f"({text_sql(r[0])}, {text_sql(r[1])})" for r in tpl.template_rows(role="inference")
        )
        + ")",
        "SELECT user_id, task, template_id FROM users, t",
    )
)
def task_template_expand(spark, folder):
    """Every user with every inference template of every task (an explode, no join)."""
    cells = F.array(
        *[
            F.struct(F.lit(r[0]).alias("task"), F.lit(r[1]).alias("template_id"))
            for r in tpl.template_rows(role="inference")
        ]
    )
    users = retail.users(spark, folder).select("user_id", F.explode(cells).alias("cell"))
    return users.select("user_id", "cell.task", "cell.template_id")


@query(
    with_ctes(
        HISTORY,
        ITEMS,
        USERS,
        """SELECT user_id, pos, CASE WHEN user_name = '' THEN user_key ELSE user_name END AS user_label,
          CASE WHEN title = '' THEN 'unknown title' ELSE title END AS title_label
        FROM hist JOIN users USING (user_id) JOIN items USING (item_id)""",
    )
)
def name_title_fallback(spark, folder):
    items = retail.items(spark, folder).select("item_id", "title")
    named = history(spark, folder, items).join(retail.users(spark, folder), "user_id")
    return named.select(
        "user_id",
        "pos",
        text.user_label(F.col("user_name"), F.col("user_key")).alias("user_label"),
        text.title_label(F.col("title")).alias("title_label"),
    )


@query(
    with_ctes(
        HISTORY,
        "SELECT user_id, pos, CASE WHEN rating >= 4 THEN 'like' ELSE 'dislike' END AS label FROM hist",
    )
)
def like_dislike(spark, folder):
    return history(spark, folder).select("user_id", "pos", text.like_label(F.col("rating")).alias("label"))


@query(
    with_ctes(
        *base(False),
        *negative_ctes("other", "other", 1, False),
        f"""SELECT user_id, CASE WHEN yes THEN target_item ELSE item_id END AS shown,
          CASE WHEN yes THEN 'yes' ELSE 'no' END AS label,
          CASE WHEN title = '' THEN 'unknown title' ELSE title END AS other_title
        FROM (SELECT *, {draw_sql(SEED, "epoch", "user_id", "'shown'")} % 2 = 1 AS yes FROM packed)
        JOIN (SELECT user_id, item_id, title FROM other) USING (user_id)""",
    )
)
def yes_no_label(spark, folder):
    cat = item_catalog(spark, folder)
    ex = splits.targets(indexed_history(spark, folder, cat), "test", ["item_id", "item_idx"])
    both = neg.add_other_item(ex, cat, SEED, "other")
    yes = draws.coin(*who(), "shown")
    return both.select(
        "user_id",
        F.when(yes, F.col("target.item_id")).otherwise(F.col("other_item")).alias("shown"),
        text.yes_no(yes).alias("label"),
        text.title_label(F.col("other_title")).alias("other_title"),
    )


@query(
    rounded(
        with_ctes(
            HISTORY,
            """SELECT user_id, sum(rating) / count(*)::DOUBLE AS avg_rating, sum(rating)::BIGINT AS total,
          printf('%.2f', sum(rating) / count(*)::DOUBLE) AS avg_text
        FROM hist WHERE n >= 2 AND pos < n - 1 GROUP BY user_id""",
        ),
        ["avg_rating"],
    )
)
def user_avg_rating(spark, folder):
    rows = splits.split_rows(history(spark, folder), "test").filter(F.col("part") == "input")
    sums = rows.groupBy("user_id").agg(F.sum("rating").alias("total"), F.count(F.lit(1)).alias("rows"))
    return rounded(
        sums.select(
            "user_id",
            (F.col("total") / F.col("rows")).alias("avg_rating"),
            "total",
            text.two_decimals(F.col("total"), F.col("rows")).alias("avg_text"),
        )
    )


@query(
    with_ctes(
        HISTORY,
        ITEMS,
        """SELECT user_id, string_agg(c, '|' ORDER BY c) AS liked, count(*) AS n_liked FROM (
          SELECT DISTINCT user_id, unnest(categories) AS c FROM hist JOIN items USING (item_id)
          WHERE n >= 2 AND pos < n - 1) GROUP BY user_id""",
    )
)
def liked_categories(spark, folder):
    """Distinct categories per user; the set is merged before the shuffle."""
    items = retail.items(spark, folder).select("item_id", "categories")
    rows = splits.split_rows(history(spark, folder, items), "test").filter(F.col("part") == "input")
    each = rows.select("user_id", F.explode("categories").alias("category")).distinct()
    return each.groupBy("user_id").agg(
        F.array_join(F.sort_array(F.collect_set("category")), "|").alias("liked"),
        F.count(F.lit(1)).alias("n_liked"),
    )


@query(
    with_ctes(
        HISTORY,
        f"""SELECT user_id, 'History of ' || user_id || ': ' || CASE WHEN
          {draw_sql(SEED, "'0'", "user_id", "'sep'")} % 2 = 1 THEN string_agg(item_id, ' , ' ORDER BY pos)
          ELSE string_agg(item_id, ' -> ' ORDER BY pos) END AS line FROM hist GROUP BY user_id""",
    )
)
def history_text(spark, folder):
    """One line per history, its items joined by one of two separators."""
    seqs = splits.segments(history(spark, folder), ["item_id"])
    first = draws.coin(SEED, 0, F.col("user_id"), "sep")
    commas = splits.whole_texts(seqs.filter(first), ["user_id"], F.array_join("seq.item_id", " , "), " , ", "history")
    arrows = splits.whole_texts(seqs.filter(~first), ["user_id"], F.array_join("seq.item_id", " -> "), " -> ", "history")
    line = text.fill("History of {user_id}: {history}", {"user_id": F.col("user_id"), "history": F.col("history")})
    return commas.unionByName(arrows).select("user_id", line.alias("line"))


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, string_agg(item_id || ' -> ' || rating, ' ; ' ORDER BY pos) AS line
        FROM hist WHERE n >= 2 AND pos < n - 1 GROUP BY user_id""",
    )
)
def rating_history_text(spark, folder):
    rows = splits.split_rows(history(spark, folder), "test").filter(F.col("part") == "input")
    seqs = splits.segments(rows, ["item_id", "rating"])
    pairs = text.arrow_pairs(F.col("seq.item_id"), F.col("seq.rating").cast("array<string>"))
    return splits.whole_texts(seqs, ["user_id"], F.array_join(pairs, " ; "), " ; ", "line")


@query(
    with_ctes(
        *base(False),
        *candidate_ctes("bullets", 4, False),
        f"""SELECT user_id, array_to_string(list_transform(candidates, lambda c:
          CASE WHEN {draw_sql(SEED, "epoch", "user_id", "'marker'")} % 2 = 1 THEN '* ' ELSE '- ' END || c || chr(10)), '')
          AS lines FROM cand""",
    )
)
def bullet_candidates(spark, folder):
    cat = item_catalog(spark, folder)
    ex = splits.targets(indexed_history(spark, folder, cat), "test", ["item_id", "item_idx"])
    lists = neg.add_candidates(ex, cat, 4, SEED, "bullets", False)
    marker = F.when(draws.coin(*who(), "marker"), F.lit("* ")).otherwise(F.lit("- "))
    return lists.select("user_id", text.bullets(F.col("candidates"), marker).alias("lines"))


@query(
    with_ctes(
        "t(task, template_id, template_no, role, input_text, target_text) AS (VALUES "
        + ", ".join(
            f"({text_sql(r[0])}, {text_sql(r[1])}, {r[2]}::BIGINT, {text_sql(r[3])}, {text_sql(r[4])}, {text_sql(r[5])})"
            for r in tpl.template_rows()
        )
        + ")",
        """used AS (SELECT o_orderkey % 9 AS task_no, count(*) AS n_orders FROM orders GROUP BY 1)""",
        "names AS (SELECT task, dense_rank() OVER (ORDER BY task) - 1 AS task_no FROM t GROUP BY task)",
        "SELECT t.*, n_orders FROM t JOIN names USING (task) JOIN used USING (task_no)",
    )
)
def template_registry(spark, folder):
    """The template table with the number of orders assigned to each task."""
    names = sorted(tpl.task_names())
    task = F.get(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % len(names)).cast("int"))
    used = retail.table(spark, folder, "orders").groupBy(task.alias("task")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    return tpl.template_table(spark).join(used, "task")


# ---- several tasks at once --------------------------------------------------

MULTI = [tpl.SEQUENTIAL, tpl.DIRECT, tpl.P5_SEQUENTIAL]


def multitask_sql(task_filter: bool) -> str:
    parts = [
        sequential_parts(True),
        direct_parts(True),
        p5_sequential_parts(tpl.P5_SEQUENTIAL, True),
    ]
    blocks = []
    for task, (ctes, selects) in zip(MULTI, parts):
        inner = with_ctes(*ctes, "\nUNION ALL ".join(selects))
        drawn = choose_sql(MULTI, SEED, *WHO, text_sql("task"))
        where = f"WHERE {drawn} = {text_sql(task)}" if task_filter else ""
        blocks.append(f"SELECT * FROM ({inner}) {where}")
    return "\nUNION ALL ".join(blocks)


def multitask(spark, folder, strategy):
    return checked(whole(spark, folder, MULTI, True, strategy))


@query(multitask_sql(False))
def prompt_multitask(spark, folder):
    return multitask(spark, folder, "all")


@query(multitask_sql(True))
def prompt_multitask_random(spark, folder):
    return multitask(spark, folder, "random")
