"""Prompt templates: the wordings, their roles, and lookups over them.

``{slot}`` names are filled by the prompt builders.  Roles: ``inference`` rows can be
evaluated, ``qa``, ``pair`` and ``support`` rows exist in training only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from basketry.functions.text import parts
from basketry.operators.metricspec import ERROR, RANKING


@dataclass(frozen=True)
class Template:
    task: str
    template_id: str
    role: str
    input_text: str
    target_text: str


RATING, SEQUENTIAL, DIRECT = "rating_prediction", "sequential_side_info", "direct_side_info"
P5_RATING, P5_SEQUENTIAL, P5_DIRECT = "p5_rating", "p5_sequential", "p5_direct"
P5_RATING_EVAL, P5_SEQUENTIAL_EVAL, P5_DIRECT_EVAL = (
    "p5_rating_eval",
    "p5_sequential_eval",
    "p5_direct_eval",
)

TASK_FAMILY = {
    RATING: ERROR,
    SEQUENTIAL: RANKING,
    DIRECT: RANKING,
    P5_RATING: ERROR,
    P5_RATING_EVAL: ERROR,
    P5_SEQUENTIAL: RANKING,
    P5_SEQUENTIAL_EVAL: RANKING,
    P5_DIRECT: RANKING,
    P5_DIRECT_EVAL: RANKING,
}

ITEM, STARS, RATED = "{target_item}", "{star_rating}", "{target_rating}"
YES_NO, LIKE = "{yes_no}", "{like_dislike}"

# Our own wordings.  What is fixed by the task definitions is each id's role and slots.
_WORDINGS: dict[str, list[tuple[str, str, str, str]]] = {
    RATING: [
        ("0", "inference", "[{user_id}]\nscored: {rated_history}\naverage: {avg_rating}\nscore of {item_id}:", RATED),
        ("1", "inference", "Shopper {user_id}, {avg_rating} on average. One more score is missing.\nItem: {item_id}\nKnown: {rated_history}", RATED),
        ("2", "inference", "Fill in the blank with a whole number up to five.\n{rated_history} , {item_id} -> ___\n(shopper {user_id}, average {avg_rating})", RATED),
        ("3", "inference", "Scores by {user_id}, oldest first:\n{rated_history}\nThey average {avg_rating}. Now {item_id} is being scored; the result will be", RATED),
        ("4", "inference", "Item {item_id} has arrived at {user_id}, who is {avg_rating} satisfied on a five point scale, as {rated_history} shows. Points for the new arrival?", RATED),
    ],
    SEQUENTIAL: [
        ("0", "inference", "[{user_id}] {history} | {category_history} | next:", ITEM),
        ("1", "inference", "The basket log of {user_id} has two columns.\nItems:\n{history}\nKinds:\n{category_history}\nAppend one line to the first column.", ITEM),
        ("2", "inference", "Kinds seen lately: {category_history}. Items behind them: {history}. {user_id} comes back tomorrow and takes", ITEM),
        ("3", "inference", "Complete the row.\nshopper: {user_id}\nitems: {history}\nkinds: {category_history}\nnext item:", ITEM),
        ("4", "inference", "Step by step {user_id} went through {category_history} by taking {history}. Where does the path lead now?", ITEM),
        ("5", "inference", "Forecast for {user_id}: with {history} (of the kinds {category_history}) already at home, the coming parcel contains", ITEM),
        ("6", "qa", "Exactly one line below is the coming parcel of {user_id}.\n{candidates}\nAlready delivered: {history}\nKinds: {category_history}", ITEM),
        ("7", "qa", "Pick a line.\n{candidates}\nIt has to continue {history} | {category_history} for {user_id}", ITEM),
        ("8", "pair", "{previous_item} ({previous_categories}) has just left the shop with {user_id}. Next through the till:", ITEM),
        ("9", "pair", "[{user_id}] {previous_categories}: {previous_item}, then", ITEM),
    ],
    DIRECT: [
        ("0", "inference", "[{user_id}] likes: {liked_categories}\noffer:", ITEM),
        ("1", "inference", "All shelves that {user_id} visits: {liked_categories}. Put one thing into the window that makes this shopper stop.", ITEM),
        ("2", "inference", "{liked_categories}\nWrite down an item number for the person behind this profile, {user_id}.", ITEM),
        ("3", "inference", "One slot is free on the start page of {user_id}. Profile: {liked_categories}. Content of the slot:", ITEM),
        ("4", "inference", "Profile of {user_id}\n{liked_categories}\nA gift that matches it:", ITEM),
        ("5", "inference", "Match profile and stock: {user_id} = {liked_categories}, best match =", ITEM),
        ("6", "qa", "{candidates}\nOnly one of the lines above belongs to the profile {liked_categories} of {user_id}:", ITEM),
        ("7", "qa", "Profile: {liked_categories}\nShopper: {user_id}\nStock:\n{candidates}\nMatch:", ITEM),
        ("8", "qa", "Sort out the strangers until one line is left for {user_id} ({liked_categories}).\n{candidates}", ITEM),
    ],
    P5_RATING: [
        ("1-1", "inference", "Review form\nauthor: user_{user_id}\nproduct: item_{item_id}\nstars (1-5):", STARS),
        ("1-2", "inference", "\"{item_title}\", reviewed by user_{user_id}, ends up with this many stars out of five:", STARS),
        ("1-3", "support", "Claim: item_{item_id} has {shown_rating} of five stars in the review of user_{user_id}. Is the claim right?", YES_NO),
        ("1-4", "support", "Mood of user_{user_id} after unpacking item_{item_id}, in one word (like, dislike):", LIKE),
        ("1-5", "inference", "Tick one box for item_{item_id}, \"{item_title}\", on behalf of user_{user_id}.\n( ) 1  ( ) 2  ( ) 3  ( ) 4  ( ) 5", STARS),
        ("1-6", "inference", "item_{item_id} and {user_name}: stars out of five?", STARS),
        ("1-7", "inference", "{user_name} writes a review. Product: \"{item_title}\". Stars out of five:", STARS),
        ("1-8", "support", "{shown_rating} of five stars for \"{item_title}\", signed {user_name}. Is this review genuine?", YES_NO),
        ("1-9", "support", "like or dislike, what does {user_name} say about \"{item_title}\"?", LIKE),
    ],
    P5_SEQUENTIAL: [
        ("2-1", "inference", "{history}\nThe line above is the account of user_{user_id}. Add an entry:", ITEM),
        ("2-2", "inference", "account: user_{user_id}\nentries: {history}\nnew entry:", ITEM),
        ("2-3", "inference", "With {history} on the account, user_{user_id} presses the order button once more for", ITEM),
        ("2-4", "inference", "Name: {user_name}\nOrdered: {history}\nAbout to order:", ITEM),
        ("2-5", "inference", "Guess what {user_name} will carry home after {history}", ITEM),
        ("2-6", "inference", "{history} ... and then? ({user_name})", ITEM),
        ("2-7", "qa", "Options: {candidates}\nAccount of user_{user_id}: {history}\nThe option that continues the account:", ITEM),
        ("2-8", "qa", "Cross out all but one of {candidates} so that the rest continues {history} for {user_name}", ITEM),
        ("2-9", "qa", "user_{user_id} stands before a shelf with {candidates}. The bag holds {history}. The hand reaches for", ITEM),
        ("2-10", "qa", "Name: {user_name}\nOrdered: {history}\nOn offer: {candidates}\nTaken:", ITEM),
        ("2-11", "pair", "Account of user_{user_id}: {history}\nProposed entry: {shown_item}\nCorrect?", YES_NO),
        ("2-12", "pair", "{shown_item} directly after {history}: does this fit {user_name}?", YES_NO),
    ],
    P5_DIRECT: [
        ("5-1", "support", "user_{user_id} x item_{shown_item}: a match?", YES_NO),
        ("5-2", "support", "The shop wants to mail {user_name} about item_{shown_item}. Send the mail?", YES_NO),
        ("5-3", "support", "Would {user_name} open a page named \"{shown_title}\"?", YES_NO),
        ("5-4", "support", "{shown_title}\nKeep this card in the deck of user_{user_id}?", YES_NO),
        ("5-5", "inference", "Deck: {candidates}\nThe card that {user_name} draws and keeps:", ITEM),
        ("5-6", "inference", "{user_name} may take a single thing away from {candidates} and takes", ITEM),
        ("5-7", "inference", "Order these for user_{user_id} and write the top one only: {candidates}", ITEM),
    ],
}

# Evaluation tasks: one template that training has seen and one that it has not.
_SEEN = {P5_RATING_EVAL: (P5_RATING, "1-6"), P5_SEQUENTIAL_EVAL: (P5_SEQUENTIAL, "2-3"), P5_DIRECT_EVAL: (P5_DIRECT, "5-5")}
_UNSEEN = {
    P5_RATING_EVAL: ("1-10", "Stars out of five\n\"{item_title}\" / {user_name} /", STARS),
    P5_SEQUENTIAL_EVAL: ("2-13", "{user_name}: {history}; the shop should prepare", ITEM),
    P5_DIRECT_EVAL: ("5-8", "{candidates}\nWhat stays when user_{user_id} has thrown the others out:", ITEM),
}


def _build() -> dict[str, list[Template]]:
    out = {task: [Template(task, *w) for w in words] for task, words in _WORDINGS.items()}
    for task, (source, seen) in _SEEN.items():
        shared = next(t for t in out[source] if t.template_id == seen)
        template_id, words, target = _UNSEEN[task]
        out[task] = [
            Template(task, seen, "inference", shared.input_text, shared.target_text),
            Template(task, template_id, "inference", words, target),
        ]
    return out


TEMPLATES = _build()


def task_names() -> list[str]:
    return list(TEMPLATES)


def find_task(name: str) -> str:
    """Registered task name, any letter case."""
    for known in TEMPLATES:
        if known.lower() == name.lower():
            return known
    raise KeyError(f"unknown task {name!r}; known: {', '.join(TEMPLATES)}")


def register_task(name: str, family: str, templates: list[Template]) -> None:
    """Add a task: its metric family and its templates."""
    if not any(t.role == "inference" for t in templates):
        raise ValueError("a task needs an inference template")
    TEMPLATES[name], TASK_FAMILY[name] = list(templates), family


def templates(task: str, role: str | None = None, force: str | None = None) -> list[Template]:
    """Templates of a task, of one role, or the one with the forced id."""
    found = TEMPLATES[find_task(task)]
    if force is not None:
        found = [t for t in found if t.template_id == str(force)]
        if not found:
            raise KeyError(f"task {task!r} has no template with the id {force!r}")
    return [t for t in found if role is None or t.role == role]


def template_rows(tasks: list[str] | None = None, role: str | None = None) -> list[tuple]:
    return [
        (t.task, t.template_id, i, t.role, t.input_text, t.target_text)
        for task in (tasks or task_names())
        for i, t in enumerate(templates(task, role))
    ]


def part_table(spark: SparkSession, wanted: list[Template], names: list[str], lists: list[set[str]]) -> DataFrame:
    """Templates with their texts cut into parts: a part is a literal text or the place of a slot in ``names``.

    ``input_cells`` are the input's parts with their number, and whether they are one of the template's list
    slots (``lists``).
    """

    def cut(words: str) -> list[tuple]:
        return [(None, names.index(slot)) if slot else (literal, None) for slot, literal in parts(words)]

    def cells(found: list[tuple], growing: set[str]) -> list[tuple]:
        return [(i, words, slot, slot is not None and names[slot] in growing) for i, (words, slot) in enumerate(found)]

    kind = "array<struct<text:string,slot:int>>"
    cuts = [(cut(t.input_text), cut(t.target_text)) for t in wanted]
    return spark.createDataFrame(
        [(i, t.task, t.template_id, t.role, a, b, cells(a, g)) for i, (t, (a, b), g) in enumerate(zip(wanted, cuts, lists))],
        f"template_no int, task string, template_id string, role string, input_parts {kind}, target_parts {kind}, "
        f"input_cells array<struct<part_no:int,text:string,slot:int,in_list:boolean>>",
    )


def template_table(spark: SparkSession, tasks: list[str] | None = None, role: str | None = None) -> DataFrame:
    """Registry table of the templates in use."""
    return spark.createDataFrame(
        template_rows(tasks, role),
        "task string, template_id string, template_no bigint, role string, "
        "input_text string, target_text string",
    )
