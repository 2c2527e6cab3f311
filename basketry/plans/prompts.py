"""Prompt builders: example rows to (input text, target text, ground truth) rows.

Input is one row per (user, epoch) with ``input`` ARRAY<STRUCT> and ``target`` STRUCT
(see ``splits.examples`` and ``sampling.train_examples``) plus user_name and user_key.
Evaluation emits every inference template of the task; training emits one random
inference template and the task's extra roles.

All tasks and roles are built in one pass over the examples.  A task adds the columns it needs
(facts, candidates) and describes its families: templates that share slots.  Each example is
exploded into (family, template) choices, the slots of the row's family become columns, and the
templates come as a table of part arrays that are filled from them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import draws, text
from basketry.operators import negatives as neg
from basketry.operators import sampling, splits
from basketry.operators.history import add_users
from basketry.operators.numbering import number_rows
from basketry.plans import templates as tpl
from basketry.storage import pin

KEYS = ["user_id", "epoch"]
COLUMNS = [*KEYS, "task", "template_id", "role", "input_text", "target_text", "ground_truth"]

# struct fields of input and target that a task reads
FIELDS = {
    tpl.RATING: ["item_id", "rating"],
    tpl.SEQUENTIAL: ["item_id", "categories", "item_idx"],
    tpl.DIRECT: ["item_id", "categories", "item_idx"],
    tpl.P5_RATING: ["item_id", "rating", "title"],
    tpl.P5_RATING_EVAL: ["item_id", "rating", "title"],
    tpl.P5_SEQUENTIAL: ["item_id", "item_idx"],
    tpl.P5_SEQUENTIAL_EVAL: ["item_id"],
    tpl.P5_DIRECT: ["item_id", "title", "item_idx"],
    tpl.P5_DIRECT_EVAL: ["item_id", "item_idx"],
}
# of these, what a segment of a long history holds of each input item ("picked" is drawn before the segments are formed)
LISTED = {
    tpl.RATING: ["item_id", "rating"],
    tpl.SEQUENTIAL: ["item_id", "picked"],
    tpl.P5_SEQUENTIAL: ["item_id"],
    tpl.P5_SEQUENTIAL_EVAL: ["item_id"],
}
# what a task needs to know about a whole input, beside its rows
FACTS = {tpl.RATING: ["rating"], tpl.SEQUENTIAL: ["pair"], tpl.DIRECT: ["liked_parts", "new_target"]}
WHOLE = -1  # part number of a prompt that is one text
FEW, MANY = 4, 99  # wrong candidates of the short and the long lists


def fields_of(tasks: list[str]) -> list[str]:
    """Union of the fields the tasks read, in a fixed order."""
    wanted = {f for t in tasks for f in FIELDS[tpl.find_task(t)]}
    return [f for f in ("item_id", "rating", "title", "categories", "item_idx") if f in wanted]


@dataclass(frozen=True)
class Setup:
    """What a builder needs beside the example rows.

    ``excluded`` is set for users in segments: their input items as rows
    (user_id, epoch, item_idx).  ``strict`` fails the job at an example without a rating
    that its task needs and at a pool with too few other items; otherwise such examples
    give no prompt (:func:`left_out` counts them).
    """

    task: str
    seed: int
    training: bool = False
    catalog: neg.Catalog | None = None
    force: str | None = None
    excluded: DataFrame | None = None
    strict: bool = True

    def parts(self, purpose: str) -> tuple:
        return self.seed, F.col("epoch"), F.col("user_id"), f"{self.task}/{purpose}"

    def coin(self, purpose: str) -> Column:
        """A coin per prompt: evaluation draws one for every template."""
        tag = F.lit("train") if self.training else F.col("template_id")
        return draws.coin(*self.parts(purpose), tag)


@dataclass(frozen=True)
class ListSlot:
    """A slot whose text grows with the history: items joined by one of two separators."""

    items: Column
    first: str
    second: str
    use_first: Column

    def text(self) -> Column:
        return text.joined(self.items, self.first, self.second, self.use_first)

    def piece(self) -> Column:
        """Text of one segment, led by the separator if the list has begun in an earlier one."""
        goes_on = F.col("begun") & (F.size(self.items) > 0)

        def led(separator: str) -> Column:
            return F.concat(F.when(goes_on, F.lit(separator)).otherwise(F.lit("")), F.array_join(self.items, separator))

        return F.when(self.use_first, led(self.first)).otherwise(led(self.second))  # one draw


Slots = dict[str, Column | ListSlot]


@dataclass(frozen=True)
class View:
    """The columns of one task's examples: input, target, and what the task has added to them."""

    input: Column
    target: Column
    prefix: str = ""

    def name(self, column: str) -> str:
        return self.prefix + column

    def __getitem__(self, column: str) -> Column:
        return F.col(self.name(column))


def own_view() -> View:
    """The examples' own columns, which segment rows carry."""
    return View(F.col("input"), F.col("target"))


@dataclass(frozen=True)
class Family:
    """Templates of a task that share slots.

    ``roles`` are its templates, ``choice`` the purpose of the draw that takes one of them in
    training.  An example gives prompts of the family if every condition of ``holds`` is met;
    its message says what an example of a user ({}) that does not is missing.
    """

    roles: list[str]
    slots: Slots
    truth: Column | None = None
    choice: str | None = None
    holds: tuple[tuple[Column, str], ...] = ()

    def templates(self, s: Setup) -> list[tpl.Template]:
        return [t for role in self.roles for t in tpl.templates(s.task, role, s.force)]

    def lists(self) -> set[str]:
        """Slots whose text grows with the history."""
        return {name for name, v in self.slots.items() if isinstance(v, ListSlot)}

    def checked(self, s: Setup) -> list[tpl.Template]:
        """Its templates; fails when the plan is built at a slot that the family does not fill."""
        known = self.templates(s)
        for t in known:
            unknown = {*text.slot_names(t.input_text), *text.slot_names(t.target_text)} - set(self.slots)
            if unknown:
                raise KeyError(f"template {t.template_id!r} of {t.task!r} has slots that are not filled: {', '.join(sorted(unknown))}")
        return known

    def chosen(self, s: Setup, numbers: dict[tuple, int]) -> list[tuple[Column, str | None]]:
        """The number of each template that an example gets, and its id where it is fixed (not drawn)."""
        known = {t.template_id: numbers[t.task, t.template_id] for t in self.templates(s)}
        if not known:
            return []
        if not s.training:
            return [(F.lit(no), i) for i, no in known.items()]
        # the draw is among the ids in the order of their registration
        ids = [t.template_id for t in tpl.templates(s.task, None if len(self.roles) > 1 else self.roles[0], s.force)]
        purpose = self.choice or f"{self.roles[0]}/template"
        return [(draws.choose([known[i] for i in ids], *s.parts(purpose)), None)]


def with_template(rows: DataFrame, s: Setup, role: str) -> DataFrame:
    """Add ``template_id``: one random template in training, every one in evaluation."""
    ids = [t.template_id for t in tpl.templates(s.task, role, s.force)]
    if s.training:
        return rows.withColumn("template_id", draws.choose(ids, *s.parts(f"{role}/template")))
    return rows.withColumn("template_id", F.explode(F.array(*[F.lit(i) for i in ids])))


def rendered(
    rows: DataFrame, s: Setup, roles: list[str], slots: Slots, truth: Column | None
) -> DataFrame:
    """Fill the template of each row's ``template_id``.

    A row that is one segment of a long history gives its pieces of the text instead:
    list slots come from every segment, all other parts from the first one.
    """
    family = Family(roles, slots, truth)
    wanted = family.checked(s)
    return filled(rows.withColumn("family", F.lit(0)), [family], wanted, [0] * len(wanted), "template_id", s.excluded is None)


def filled(rows: DataFrame, families: list[Family], wanted: list[tpl.Template], owners: list[int], on: str, whole: bool) -> DataFrame:
    """Prompt rows from rows with ``family`` (a number) and ``on``, which finds a row's template among ``wanted``.

    ``owners`` are the templates' families.  The slots become columns before the templates come to the rows: there
    they are compiled code, and only their texts go on.
    """
    names = sorted({n for t in wanted for words in (t.input_text, t.target_text) for n in text.slot_names(words)})

    def by_family(kind: str, get: Callable[[Family], Column | None]) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast(kind))
        for i, f in enumerate(families):
            found = get(f)
            out = out if found is None else out.when(F.col("family") == i, found)
        return out

    def slot(name: str) -> Callable[[Family], Column | None]:
        def value(f: Family) -> Column | None:
            v = f.slots.get(name)
            if isinstance(v, ListSlot):
                return v.text() if whole else v.piece()
            return None if v is None else v.cast("string")

        return value

    def fill(parts: str, values: Column) -> Column:
        return F.aggregate(parts, F.lit(""), lambda a, p: F.concat(a, F.coalesce(p["text"], F.get(values, p["slot"]))))

    def cells(values: Column) -> Column:
        mine = F.filter("input_cells", lambda c: c["in_list"] | (F.col("segment_no") == 0))
        return F.transform(mine, lambda c: F.struct(
            c["part_no"].alias("part_no"), F.coalesce(c["text"], F.get(values, c["slot"])).alias("input_text")))

    segment = [] if whole else ["segment_no"]
    truth = by_family("array<string>", lambda f: None if f.truth is None else F.array(f.truth.cast("string")))
    # the lambda keeps the slots of many families out of one method that would be too long to be compiled
    slotted = rows.select(
        *KEYS, *segment, text.let(F.col(on), lambda x: x).alias(on), truth.alias("truth"),
        *[by_family("string", slot(name)).alias(f"slot_{i}") for i, name in enumerate(names)])
    table = tpl.part_table(rows.sparkSession, wanted, names, [families[i].lists() for i in owners])
    found = slotted.join(F.broadcast(table), on)
    body = (lambda values: fill("input_parts", values)) if whole else cells
    values = F.array(*[F.col(f"slot_{i}") for i in range(len(names))]).cast("array<string>")
    texts = text.let(values, lambda v: F.struct(body(v).alias("input_text"), fill("target_parts", v).alias("target_text")))
    out = found.select(
        *KEYS, "task", "template_id", "role", texts.alias("texts"), F.when(F.col("role") == "inference", F.col("truth")).alias("ground_truth"), *segment)
    out = out.select(*KEYS, "task", "template_id", "role", "texts.input_text", "texts.target_text", "ground_truth", *segment)
    if whole:
        return out
    # a plain inline would be given a filter that makes all texts once more, to see whether there are any
    each = out.select(*[c for c in out.columns if c != "input_text"], F.inline_outer("input_text"))
    return each.filter(F.col("part_no").isNotNull())


def one_pass(ex: DataFrame, parts: list[tuple[Setup, Family]], drawn: bool = False) -> DataFrame:
    """The prompts of all families, from one scan of the examples (or of segments).

    ``drawn``: an example gives prompts of its ``drawn_task`` only.
    """
    known = {(t.task, t.template_id): t for s, f in parts for t in f.checked(s)}
    owners = {(t.task, t.template_id): i for i, (s, f) in enumerate(parts) for t in f.templates(s)}
    numbers = {key: i for i, key in enumerate(known)}
    kind = "array<struct<family:int,template_no:int,template_id:string>>"

    def choices(no: int, s: Setup, f: Family) -> Column:
        out = F.array(*[F.struct(F.lit(no), number, F.lit(i).cast("string")) for number, i in f.chosen(s, numbers)]).cast(kind)
        for holds, message in reversed(f.holds):
            other = failure(message).cast(kind) if s.strict else F.array().cast(kind)
            out = F.when(holds, out).otherwise(other)
        if s.excluded is not None and not f.lists():
            out = F.when(F.col("segment_no") == 0, out).otherwise(F.array().cast(kind))  # later segments add nothing
        return F.when(F.col("drawn_task") == s.task, out).otherwise(F.array().cast(kind)) if drawn else out

    every = F.concat(*[choices(i, s, f) for i, (s, f) in enumerate(parts)])
    rows = ex.withColumn("choice", F.explode(every)).select("*", "choice.*").drop("choice")
    return filled(rows, [f for _, f in parts], list(known.values()), [owners[key] for key in known], "template_no", parts[0][0].excluded is None)


def failure(message: str) -> Column:
    before, _, after = message.partition("{}")
    return F.raise_error(F.concat(F.lit(before), F.coalesce("user_id", F.lit("?")), F.lit(after)))


def with_facts(ex: DataFrame, s: Setup, *names: str, view: View | None = None) -> DataFrame:
    """Add what a task needs to know about the whole input; segment rows carry it already."""
    if s.excluded is not None:
        return ex
    view = view or own_view()
    for name in names:
        ex = ex.withColumns({view.name(c): v for c, v in _FACTS[name](s, view).items()})
    return ex


def _is_rated(x: Column) -> Column:
    return x["rating"].isNotNull()


def _rating_facts(s: Setup, v: View) -> dict[str, Column]:
    rated = F.filter(v.input, _is_rated)["rating"]
    total = F.aggregate(rated, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return {"rating_sum": total, "n_rated": F.size(rated)}


def _liked_facts(s: Setup, v: View) -> dict[str, Column]:
    known = F.array_compact(F.flatten(F.array_compact(v.input["categories"])))
    return {"liked": F.sort_array(F.array_distinct(known))}


def _pair_facts(s: Setup, v: View) -> dict[str, Column]:
    at = pair_place(F.size(v.input), s)
    following = F.get(v.input, (at + 1).cast("int"))["item_id"]
    return {"first": F.get(v.input, at.cast("int")), "following": F.coalesce(following, v.target["item_id"])}


def pair_place(length: Column, s: Setup) -> Column:
    return draws.pick(length, *s.parts("pair"))


_FACTS = {"rating": _rating_facts, "liked": _liked_facts, "liked_parts": _liked_facts, "pair": _pair_facts}


def user_slots(rows: DataFrame) -> Slots:
    slots: Slots = {"user_id": F.col("user_id")}
    if "user_name" in rows.columns:
        slots["user_name"] = text.user_label(F.col("user_name"), F.col("user_key"))
    return slots


def left_out(ex: DataFrame, task: str, catalog: neg.Catalog | None = None) -> DataFrame:
    """(reason, n) of the examples of whole histories that give no prompt without ``strict``."""
    reasons = []
    if task in (tpl.RATING, tpl.P5_RATING, tpl.P5_RATING_EVAL):
        reasons.append(F.when(F.col("target.rating").isNull(), F.lit("target without rating")))
    if task == tpl.RATING:
        reasons.append(F.when(~F.exists("input", _is_rated), F.lit("history without rating")))
    if task in (tpl.P5_DIRECT, tpl.P5_DIRECT_EVAL) and catalog is not None:
        few = F.size(neg.excluded_indexes(True)) > catalog.size - MANY
        reasons.append(F.when(few, F.lit("too few other items")))
    why = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return ex.select(why.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def is_rated(v: View) -> tuple[Column, str]:
    return v.target["rating"].isNotNull(), "the target of user {} has no rating"


def rating_columns(ex: DataFrame, s: Setup, v: View) -> DataFrame:
    rated = F.filter(v.input, _is_rated)
    pairs = text.arrow_pairs(rated["item_id"], rated["rating"].cast("array<string>"))
    ex = with_facts(ex, s, "rating", view=v)
    return ex.withColumns({v.name("avg_rating"): text.two_decimals(v["rating_sum"], v["n_rated"]), v.name("pairs"): pairs})


def rating_families(s: Setup, v: View, names: Slots) -> list[Family]:
    """History with ratings and their mean; the answer is the target's rating.

    Positions without a rating are not part of the rated history.
    """
    rated = v.target["rating"].cast("string")
    slots = names | {
        "avg_rating": v["avg_rating"],
        "rated_history": ListSlot(v["pairs"], " , ", " ; ", s.coin("separator")),
        "item_id": v.target["item_id"],
        "target_rating": rated,
    }
    some = (v["n_rated"] > 0, "no item in the history of user {} has a rating")
    return [Family(["inference"], slots, rated, holds=(is_rated(v), some))]


def picked_category(s: Setup, categories: Column, pos: Column) -> Column:
    return sampling.pick_category(categories, *s.parts("category"), pos)


def sequential_columns(ex: DataFrame, s: Setup, v: View) -> DataFrame:
    if s.excluded is None:
        picked = F.transform(v.input, lambda x: picked_category(s, x["categories"], x["pos"]))
    else:
        picked = v.input["picked"]
    ex = ex.withColumn(v.name("picked"), picked)
    if not s.training:
        return ex
    return with_candidates(with_facts(ex, s, "pair", view=v), s, v, FEW, False)


def sequential_families(s: Setup, v: View, names: Slots) -> list[Family]:
    """History and one random category per item; training adds a list and a pair row."""
    target = v.target["item_id"]
    slots = names | {
        "history": ListSlot(v.input["item_id"], " , ", " ; ", s.coin("separator")),
        "category_history": ListSlot(v["picked"], " , ", " ; ", s.coin("separator")),
        "target_item": target,
    }
    out = [Family(["inference"], slots, target)]
    if not s.training:
        return out
    # a random adjacent pair of history + target, with all categories of its first item
    pair = names | {
        "previous_item": v["first"]["item_id"],
        "previous_categories": text.joined(v["first"]["categories"], " , ", " ; ", s.coin("pair/separator")),
        "target_item": v["following"],
    }
    few = (enough(s, v, FEW, False),)
    return [*out, Family(["qa"], slots | {"candidates": bullet_slot(s, v)}, holds=few), Family(["pair"], pair)]


def with_candidates(ex: DataFrame, s: Setup, v: View, n: int, outside_history: bool) -> DataFrame:
    """Add the view's ``candidates``; an example whose pool is too small keeps its row."""
    purpose = f"{s.task}/candidates"
    if s.excluded is not None and outside_history:
        lists = neg.candidates_by_join(ex, s.excluded, s.catalog, n, s.seed, purpose, s.strict)
        return ex.join(lists.withColumnRenamed("candidates", v.name("candidates")), KEYS, "left")
    return neg.add_candidates(ex, s.catalog, n, s.seed, purpose, outside_history, keep=True,
                              history=v.input, target=v.target, out=v.name("candidates"))


def enough(s: Setup, v: View, n: int, outside_history: bool) -> tuple[Column, str]:
    if s.excluded is not None and outside_history:
        return v["candidates"].isNotNull(), neg.too_few(s.catalog, n)
    return neg.holds_enough(neg.excluded_indexes(outside_history, v.input, v.target), s.catalog, n), neg.too_few(s.catalog, n)


def bullet_slot(s: Setup, v: View) -> Column:
    marker = F.when(s.coin("bullet"), F.lit("* ")).otherwise(F.lit("- "))
    return text.bullets(v["candidates"], marker)


def direct_columns(ex: DataFrame, s: Setup, v: View) -> DataFrame:
    ex = with_facts(ex, s, "liked", view=v)
    return with_candidates(ex, s, v, FEW, False) if s.training else ex


def direct_families(s: Setup, v: View, names: Slots) -> list[Family]:
    """Unique categories of the history; training draws its target from history + target."""
    target = v.target["item_id"]
    slots = names | {
        "liked_categories": ListSlot(v["liked"], " , ", " ; ", s.coin("separator")),
        "target_item": target,
    }
    out = [Family(["inference"], slots, target)]
    if not s.training:
        return out
    return [*out, Family(["qa"], slots | {"candidates": bullet_slot(s, v)}, holds=(enough(s, v, FEW, False),))]


def p5_rating_families(s: Setup, v: View, names: Slots) -> list[Family]:
    """Star, yes/no and like/dislike questions about the target; training perturbs stars."""
    rating = v.target["rating"]
    rated = rating.cast("string")
    stars = F.format_string("%.1f", sampling.perturbed_rating(rating, *s.parts("stars"))) if s.training else rated
    is_true = s.coin("shown")
    wrong = sampling.wrong_rating(rating, *s.parts("wrong")).cast("string")
    slots = names | {
        "item_id": v.target["item_id"],
        "item_title": text.title_label(v.target["title"]),
        "star_rating": stars,
        "shown_rating": F.when(is_true, rated).otherwise(wrong),
        "yes_no": text.yes_no(is_true),
        "like_dislike": text.like_label(rating),
    }
    roles = ["inference", "support"] if s.training else ["inference"]
    return [Family(roles, slots, rated, "template", (is_rated(v),))]


def p5_sequential_columns(ex: DataFrame, s: Setup, v: View) -> DataFrame:
    return with_shown(with_candidates(ex, s, v, MANY, True), s, v) if s.training else ex


def p5_sequential_families(s: Setup, v: View, names: Slots) -> list[Family]:
    """History questions; training adds a 100-item list and a yes/no pair question."""
    target, separator = v.target["item_id"], s.coin("separator")
    slots = names | {
        "history": ListSlot(v.input["item_id"], " , ", " -> ", separator),
        "target_item": target,
    }
    out = [Family(["inference"], slots, target)]
    if not s.training:
        return out
    candidates = text.joined(v["candidates"], " , ", " -> ", separator)
    qa = Family(["qa"], slots | {"candidates": candidates}, holds=(enough(s, v, MANY, True),))
    return [*out, qa, Family(["pair"], slots | shown_slots(s, v), holds=(enough(s, v, 1, False),))]


def with_shown(ex: DataFrame, s: Setup, v: View) -> DataFrame:
    """Add ``other_item`` and ``other_title``: what a yes/no question may show instead of the target."""
    purpose = f"{s.task}/other"
    if s.excluded is None:
        return neg.add_other_item(ex, s.catalog, s.seed, purpose, keep=True, target=v.target, prefix=v.prefix)
    # one item for all segments of an example
    one = ex.filter(F.col("segment_no") == 0).select(*KEYS, "target")
    return ex.join(neg.add_other_item(one, s.catalog, s.seed, purpose, keep=True).drop("target"), KEYS, "left")


def shown_slots(s: Setup, v: View) -> Slots:
    """The item shown in a yes/no question: the target or one other item, by coin."""
    is_true = draws.coin(*s.parts("shown"))
    return {
        "shown_item": F.when(is_true, v.target["item_id"]).otherwise(v["other_item"]),
        "yes_no": text.yes_no(is_true),
    }


def p5_direct_columns(ex: DataFrame, s: Setup, v: View) -> DataFrame:
    ex = with_candidates(ex, s, v, MANY, True)
    return with_shown(ex, s, v) if s.training and s.task != tpl.P5_DIRECT_EVAL else ex


def p5_direct_families(s: Setup, v: View, names: Slots) -> list[Family]:
    """Choose among the target and 99 other items; training adds a yes/no question."""
    target = v.target["item_id"]
    slots = names | {
        "candidates": F.array_join(v["candidates"], " , "),
        "target_item": target,
    }
    out = [Family(["inference"], slots, target, holds=(enough(s, v, MANY, True),))]
    if not s.training or s.task == tpl.P5_DIRECT_EVAL:
        return out
    is_true = draws.coin(*s.parts("shown"))
    title = F.when(is_true, v.target["title"]).otherwise(v["other_title"])
    support = names | shown_slots(s, v) | {"shown_title": text.title_label(title)}
    return [*out, Family(["support"], support, holds=(enough(s, v, 1, False),))]


def no_columns(ex: DataFrame, s: Setup, v: View) -> DataFrame:
    return ex


# per task: the columns it adds to its examples, and its families
FAMILIES: dict[str, tuple[Callable[[DataFrame, Setup, View], DataFrame], Callable[[Setup, View, Slots], list[Family]]]] = {
    tpl.RATING: (rating_columns, rating_families),
    tpl.SEQUENTIAL: (sequential_columns, sequential_families),
    tpl.DIRECT: (direct_columns, direct_families),
    tpl.P5_RATING: (no_columns, p5_rating_families),
    tpl.P5_RATING_EVAL: (no_columns, p5_rating_families),
    tpl.P5_SEQUENTIAL: (p5_sequential_columns, p5_sequential_families),
    tpl.P5_SEQUENTIAL_EVAL: (no_columns, p5_sequential_families),
    tpl.P5_DIRECT: (p5_direct_columns, p5_direct_families),
    tpl.P5_DIRECT_EVAL: (p5_direct_columns, p5_direct_families),
}
# builders of tasks registered from outside
BUILDERS: dict[str, Callable[[DataFrame, Setup], DataFrame]] = {}
# Tasks that exist for evaluation only; in training they still show one template.
EVAL_ONLY = {tpl.P5_RATING_EVAL, tpl.P5_SEQUENTIAL_EVAL, tpl.P5_DIRECT_EVAL}


def register_builder(
    task: str, fields: list[str], build: Callable[[DataFrame, Setup], DataFrame], facts: list[str] | None = None
) -> None:
    """Add the builder of a task registered with ``templates.register_task``.

    ``facts`` names what it reads beside its rows: ``rating`` (rating_sum, n_rated), ``pair``
    (first, following), ``liked`` (all of it in one array) or ``liked_parts`` (in pieces of a segment
    each, for a list slot); ``new_target`` draws the training target anew.  They are
    there for histories of any length.
    """
    BUILDERS[task], FIELDS[task], FACTS[task] = build, fields, facts or []


def _viewed(ex: DataFrame, s: Setup) -> tuple[DataFrame, View]:
    v = View(F.col("input"), F.col("target"), f"{s.task}__")
    if s.training and "new_target" in FACTS.get(s.task, []):
        ex = sampling.resample_target(ex, s.seed, f"{s.task}/target", v.name("input"), v.name("target"))
        v = View(v["input"], v["target"], v.prefix)
    return ex, v


def _named(examples: DataFrame, setups: list[Setup], drawn: bool) -> DataFrame:
    """The examples with the names of all items that the tasks draw, where the catalog is not looked up in place.

    One look-up serves all tasks and takes the examples as they are: what the tasks add to them comes later.
    """
    ex, lists = examples, {}
    for s in (s for s in setups if s.catalog is not None and s.catalog.size > neg.BROADCAST_ROWS):
        ex, v = _viewed(ex, s)
        for out, fields, indexes in _drawn_items(s, v):
            name = neg.drawn_name(v.name(out))
            ex = ex.withColumn(name, F.when(F.col("drawn_task") == s.task, indexes) if drawn else indexes)
            lists[name] = fields
    if not lists:
        return examples
    return neg.named_draws(ex.select(*examples.columns, *lists), lists, setups[0].catalog)


def _drawn_items(s: Setup, v: View) -> list[tuple[str, list[str], Column]]:
    """(column, catalog fields, indexes) of what the task draws from the catalog for its examples."""
    def indexes(purpose: str, n: int, outside_history: bool) -> Column:
        excluded = neg.excluded_indexes(outside_history, v.input, v.target)
        return neg.negative_indexes(s.catalog, excluded, n, *s.parts(purpose))

    few = [("candidates", ["item_id"], indexes("candidates", FEW, False))] if s.task in (tpl.SEQUENTIAL, tpl.DIRECT) and s.training else []
    many = s.task in (tpl.P5_DIRECT, tpl.P5_DIRECT_EVAL) or (s.task == tpl.P5_SEQUENTIAL and s.training)
    found = few + ([("candidates", ["item_id"], indexes("candidates", MANY, True))] if many else [])
    if s.training and s.task in (tpl.P5_SEQUENTIAL, tpl.P5_DIRECT):
        found.append(("other", ["item_id", "title"], indexes("other", 1, False)))
    return found


def _whole(examples: DataFrame, setups: list[Setup], drawn: bool = False) -> DataFrame:
    """Prompt rows of whole examples for all tasks of ``setups``."""
    ex, parts, out = _named(examples, [s for s in setups if s.task in FAMILIES], drawn), [], None
    for s in (s for s in setups if s.task in FAMILIES):
        ex, v = _viewed(ex, s)
        columns, families = FAMILIES[s.task]
        ex = columns(ex, s, v)
        parts += [(s, f) for f in families(s, v, user_slots(examples))]
    if parts:
        out = one_pass(ex, parts, drawn).select(*COLUMNS)
    for s in (s for s in setups if s.task not in FAMILIES):
        mine = examples.filter(F.col("drawn_task") == s.task) if drawn else examples
        rows = BUILDERS[s.task](mine, s).select(*COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


def build_prompts(
    examples: DataFrame,
    task: str,
    *,
    seed: int,
    training: bool = False,
    catalog: neg.Catalog | None = None,
    force: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Prompt rows of one task.  ``force`` restricts it to one template id."""
    return build_evaluation_prompts(
        examples, [task], seed=seed, training=training, catalog=catalog, force=None if force is None else {task: force}, strict=strict
    )


def build_evaluation_prompts(
    examples: DataFrame,
    tasks: list[str],
    *,
    seed: int,
    training: bool = False,
    catalog: neg.Catalog | None = None,
    force: dict[str, str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Prompt rows of several tasks from one scan of the examples."""
    return _whole(examples, _setups(tasks, seed, training, catalog, force, strict))


def _setups(tasks, seed, training, catalog, force, strict) -> list[Setup]:
    only = {tpl.find_task(t): i for t, i in (force or {}).items()}
    for t, i in only.items():
        tpl.templates(t, None, i)  # an unknown id fails here
    return [Setup(t, seed, training, catalog, only.get(t), None, strict) for t in map(tpl.find_task, tasks)]


def long_examples(
    rows: DataFrame, users: DataFrame, s: Setup, fields: list[str], size: int = splits.SEGMENT, listed: list[str] | None = None
) -> DataFrame:
    """Example rows in segments of at most ``size`` input items, for long histories.

    ``rows`` is the row form (user_id, epoch, spot, input_len, part, fields); the input items hold
    the fields ``listed``, by default all.  Facts about a whole history are aggregates that merge before the shuffle; every join and
    grouping of its rows has the segment number in the key, which spreads a user over
    the tasks.
    """
    needed = FACTS.get(s.task, [])
    if s.training and "new_target" in needed:
        rows = sampling.resample_rows(rows, s.seed, f"{s.task}/target")
    is_input, cell = F.col("part") == "input", F.struct("pos", *fields)
    facts = [F.max_by(cell, F.when(~is_input, F.col("spot"))).alias("target")]
    if "rating" in needed:
        given = F.when(is_input, F.col("rating"))
        facts += [F.coalesce(F.sum(given), F.lit(0)).alias("rating_sum"), F.count(given).alias("n_rated")]
        # the rated list begins at the first segment with a rated row
        facts.append(F.expr(f"min(CASE WHEN part = 'input' AND rating IS NOT NULL THEN spot END) div {int(size)}").alias("begin"))
    if s.training and "pair" in needed:
        at = pair_place(F.col("input_len"), s)
        facts += [
            F.max_by(cell, F.when(F.col("spot") == at, F.col("spot"))).alias("first"),
            F.max(F.when(F.col("spot") == at + 1, F.col("item_id"))).alias("following"),
        ]
    per_user = add_users(rows.groupBy(*KEYS, "input_len").agg(*facts), users)
    inputs = rows.filter(is_input)
    if "liked" in needed:
        each = inputs.select(*KEYS, F.explode("categories").alias("category")).distinct()
        liked = each.groupBy(*KEYS).agg(F.sort_array(F.collect_set("category")).alias("liked"))
        # a history without any category keeps its row
        per_user = per_user.join(liked, KEYS, "left").withColumn(
            "liked", F.coalesce("liked", F.array().cast("array<string>"))
        )
    lists = (
        inputs.withColumn("segment_no", F.expr(f"spot div {int(size)}"))
        .groupBy(*KEYS, "segment_no")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *(listed or fields)))).alias("input"))
    )
    last = F.expr(f"(input_len - 1) div {int(size)}")
    parts = None
    if "liked_parts" in needed:
        parts = liked_parts(inputs, size)
        counts = parts.groupBy(*KEYS).agg(F.max("segment_no").alias("last_liked"))
        per_user = per_user.join(counts, KEYS, "left")
        last = F.greatest(last, F.coalesce("last_liked", F.lit(0)))  # a history may have more categories than rows
    numbers = F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))
    spread = per_user.withColumn("segment_no", F.explode(numbers)).withColumn("begun", F.col("segment_no") > 0)
    if "rating" in needed:
        spread = spread.withColumn("begun", F.coalesce(F.col("segment_no") > F.col("begin"), F.lit(False))).drop("begin")
    if parts is None:
        return lists.join(spread, [*KEYS, "segment_no"])
    whole = spread.drop("last_liked").join(lists, [*KEYS, "segment_no"], "left").join(parts, [*KEYS, "segment_no"], "left")
    kinds = dict(whole.dtypes)
    return whole.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("input", "liked")})


def liked_parts(inputs: DataFrame, size: int) -> DataFrame:
    """(user_id, epoch, segment_no, liked): the distinct categories of each input in order, at most ``size`` a row.

    They are numbered like any rows of a key, so a set of any size is spread over the tasks.
    """
    each = inputs.select(*KEYS, F.explode("categories").alias("category")).filter("category IS NOT NULL").distinct()
    numbered = number_rows(each, KEYS, ["category"], pos="place", total=None)
    return (
        numbered.withColumn("segment_no", F.expr(f"place div {int(size)}"))
        .groupBy(*KEYS, "segment_no")
        .agg(F.sort_array(F.collect_list("category")).alias("liked"))
    )


def build_prompt_pieces(
    rows: DataFrame,
    users: DataFrame,
    task: str,
    *,
    seed: int,
    training: bool = False,
    catalog: neg.Catalog | None = None,
    force: str | None = None,
    size: int = splits.SEGMENT,
    strict: bool = True,
    copied: bool = False,
) -> DataFrame:
    """Prompts of long histories as ordered pieces.

    Columns of :func:`build_prompts` with ``part_no`` and ``segment_no``; the texts of
    one prompt in the order (part_no, segment_no) make up the whole input text.  ``copied`` says that
    the rows are read from a pinned copy as they are.
    """
    task = tpl.find_task(task)
    fields, listed = FIELDS[task], LISTED.get(task)
    s = Setup(task, seed, training, catalog, force, rows, strict)
    if task == tpl.SEQUENTIAL:
        rows = rows.withColumn("picked", picked_category(s, F.col("categories"), F.col("pos")))
        if not training:
            fields = ["item_id"]  # the rest serves the training lists and pairs
    rows = rows.select(*KEYS, *dict.fromkeys(["spot", "pos", "input_len", "part", *fields, *(listed or [])]))
    if not copied:
        rows = pin(rows, "spots")  # the facts, the segments and the exclusions read one copy of the rows
    s = replace(s, excluded=rows)
    segments = long_examples(rows, users, s, fields, size, listed)
    if "item_idx" in fields:
        s = replace(s, excluded=rows.select(*KEYS, "item_idx").distinct())
    columns = [*COLUMNS, "part_no", "segment_no"]
    if task not in FAMILIES:
        return BUILDERS[task](segments, s).select(*columns)
    prepare, families = FAMILIES[task]
    v = own_view()
    parts = [(s, f) for f in families(s, v, user_slots(segments))]
    if not any(f.lists() for _, f in parts):
        segments = segments.filter(F.col("segment_no") == 0)  # the others add nothing
    return one_pass(prepare(segments, s, v), parts).select(*columns)


def build_training_prompts(
    examples: DataFrame,
    tasks: list[str],
    *,
    seed: int,
    strategy: str = "all",
    catalog: neg.Catalog | None = None,
    force: dict[str, str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Several tasks per example row: every task (``all``) or one drawn task (``random``).

    ``force`` maps tasks to the one template id they are restricted to.
    """
    if strategy not in ("all", "random"):
        raise ValueError("strategy is 'all' or 'random'")
    setups = _setups(tasks, seed, True, catalog, force, strict)
    if strategy == "random":
        drawn = sampling.pick_task([s.task for s in setups], seed, F.col("epoch"), F.col("user_id"))
        examples = examples.withColumn("drawn_task", drawn)
    return _whole(examples, setups, strategy == "random")


def whole_prompts(
    interactions: DataFrame,
    users: DataFrame,
    tasks: list[str],
    *,
    seed: int,
    split: str = "test",
    epochs: int | None = None,
    merged: bool = False,
    strategy: str = "all",
    catalog: neg.Catalog | None = None,
    force: dict[str, str] | None = None,
    strict: bool = True,
    size: int = splits.SEGMENT,
) -> DataFrame:
    """Prompts of every user and task: whole texts, and pieces for histories longer than ``size``.

    ``epochs`` switches to training windows, of the merged train and validation rows if
    ``merged``; otherwise every task is expanded over its
    templates for the examples of ``split``.  Whole texts have part_no = WHOLE.  Both forms
    make up the same texts.  ``force`` maps tasks to the one template id they are restricted to.
    """
    names = [tpl.find_task(t) for t in tasks]
    training, fields = epochs is not None, fields_of(names)
    force = {tpl.find_task(t): i for t, i in (force or {}).items()}
    learned = "train_validation" if merged else "train"
    # the history is numbered once; the examples, the test for long users and their rows read the copy
    interactions = pin(interactions.select("user_id", "pos", "n", *fields), "interactions")
    if training:
        ex = sampling.train_examples(splits.short_users(interactions, size), fields, epochs, seed, size, learned)
    else:
        ex = splits.examples(splits.short_users(interactions, size), split, fields, size)
    ex = add_users(ex, users)
    if training:
        out = build_training_prompts(ex, names, seed=seed, strategy=strategy, catalog=catalog, force=force, strict=strict)
    else:
        out = build_evaluation_prompts(ex, names, seed=seed, catalog=catalog, force=force, strict=strict)
    out = out.withColumns({"part_no": F.lit(WHOLE), "segment_no": F.lit(0).cast("bigint")})
    if interactions.filter((F.col("pos") == size) & (F.col("n") > size)).isEmpty():
        return out  # no long history
    rows = splits.long_users(interactions, size)
    if training:
        windows = sampling.training_windows(rows, epochs, seed, learned)
        spots = sampling.window_rows(rows.filter(splits.in_split(learned)), windows)
    else:
        spots = splits.example_spots(rows, split)
    if training and strategy == "random":
        drawn = sampling.pick_task(names, seed, F.col("epoch"), F.col("user_id"))
        spots = spots.withColumn("drawn_task", drawn)
    for task in names:
        mine = spots.filter(F.col("drawn_task") == task) if training and strategy == "random" else spots
        more = build_prompt_pieces(
            mine, users, task, seed=seed, training=training, catalog=catalog, force=force.get(task), size=size, strict=strict,
            copied=not training,  # filters of the pinned history
        )
        out = out.unionByName(more)
    return out


def join_pieces(prompts: DataFrame) -> DataFrame:
    """The prompts of :func:`whole_prompts` with one whole text each.

    Whole texts stay as they are; the pieces of a long history meet in the row that is their text.
    """
    keys = [c for c in prompts.columns if c not in ("part_no", "segment_no", "input_text")]
    whole = prompts.filter(F.col("part_no") == WHOLE).select(*keys, "input_text")
    cells = F.sort_array(F.collect_list(F.struct("part_no", "segment_no", "input_text")))  # the text itself
    pieces = prompts.filter(F.col("part_no") != WHOLE).groupBy(*keys).agg(F.array_join(cells["input_text"], "").alias("input_text"))
    return whole.unionByName(pieces)


def evaluable(prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prompts with a ground truth, and the counts (task, template_id, n) of those without."""
    has = F.col("ground_truth").isNotNull()
    rejects = prompts.filter(~has).groupBy("task", "template_id").agg(F.count(F.lit(1)).alias("n"))
    return prompts.filter(has), rejects


def check_evaluable(prompts: DataFrame) -> DataFrame:
    """Fails the job when a row to be evaluated has no ground truth."""
    missing = F.col("ground_truth").isNull()
    message = F.lit("evaluation needs prompts with ground truth")
    return prompts.withColumn(
        "ground_truth",
        F.when(missing, F.raise_error(message)).otherwise(F.col("ground_truth")),
    )


def check_single_target(examples: DataFrame, gt: str = "gt") -> DataFrame:
    """List-valued targets must hold exactly one element."""
    message = F.lit("exactly one target per row is expected")
    return examples.withColumn(gt, F.when(F.size(gt) == 1, F.col(gt)).otherwise(F.raise_error(message)))


def from_columns(flat: DataFrame, fields: list[str]) -> DataFrame:
    """Examples again from the published list columns (``splits.flat_columns``).

    Each target list must hold one element and each input list as many as the others.
    """
    short = {f: f.removesuffix("_id") for f in fields}
    for f in fields:
        flat = check_single_target(flat, f"gt_{short[f]}")
    lists = [F.col(f"input_{short[f]}_seq") for f in fields]
    same = F.lit(True)
    for other in lists[1:]:
        same = same & (F.size(other) == F.size(lists[0]))
    zipped = F.arrays_zip(*[c.alias(f) for c, f in zip(lists, fields)])
    whole = F.when(same, zipped).otherwise(F.raise_error(F.lit("the input lists of a row differ in length")))
    placed = F.transform(whole, lambda x, i: F.struct(i.cast("bigint").alias("pos"), *[x[f].alias(f) for f in fields]))
    target = F.struct(F.size(lists[0]).cast("bigint").alias("pos"), *[F.get(f"gt_{short[f]}", F.lit(0)).alias(f) for f in fields])
    keep = [c for c in flat.columns if not c.startswith(("input_", "gt_"))]
    return flat.select(*keep, placed.alias("input"), target.alias("target"))
