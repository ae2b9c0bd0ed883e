"""Repair of conversation structure by lightest derivations.

A repaired conversation has the roles ``(s?(ua)+)?``: at most one system turn, then user and
assistant in turn. What is left of a conversation from row i on, read in a state of that
pattern, is an item; an item follows from an edit and a further item, and a derivation's value
is its cost and its audit, the initials of its edits. Knuth's agenda takes items off in order
of their value; each is final when it comes off, and so is the goal.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
# Letters a state of the pattern takes, and the state that follows. 0 is the start.
MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = (0, 3)
PLAN = "cost bigint, audit string, edits array<struct<edit: string, row: int, role: string>>"


def lightest_derivation(
    axioms: dict[Hashable, tuple],
    rules: Iterable[tuple[Hashable, tuple, Callable[..., tuple]]],
    goal: Hashable,
) -> tuple | None:
    """Least value of ``goal`` over all derivations; None where there is none.

    A rule (head, body, function) gives its head the function's value of its body's values.
    Functions must be superior: monotone in each value and never below one of them. The
    first entries of a value that differ, always before its last entry, give its order.
    """
    rules = list(rules)
    uses: dict[Hashable, list[int]] = {}
    missing = [len(body) for _, body, _ in rules]
    for at, (_, body, _) in enumerate(rules):
        for item in body:
            uses.setdefault(item, []).append(at)
    final: dict[Hashable, tuple] = {}
    agenda = [(value[:-1], n, item, value) for n, (item, value) in enumerate(axioms.items())]
    heapq.heapify(agenda)
    pushed = len(agenda)
    while agenda:
        _, _, item, value = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        if item == goal:
            return value
        for at in uses.get(item, ()):
            missing[at] -= 1
            if not missing[at]:
                head, body, function = rules[at]
                if head not in final:
                    made = function(*[final[b] for b in body])
                    heapq.heappush(agenda, (made[:-1], pushed, head, made))
                    pushed += 1
    return None


def plan(codes: str) -> tuple[int, list[tuple[str, int | None, str | None]]]:
    """Cost and edits (initial, row, new role) that repair a conversation.

    ``codes`` has two characters per row: the initial of its role (``-`` if none of s, u, a)
    and its fault, ``b`` blank, ``d`` duplicate, ``t`` truncated or ``.``. Values are (cost,
    rows used, initial of the first edit, trail). An item's rows are always the same in
    number, and the initials of two edits that lead to one item always differ (a state takes
    only one of user and assistant), so these three order the derivations of an item as
    their cost and whole audit do.
    """
    n = len(codes) // 2
    axioms: dict[Hashable, tuple] = {("rest", n, s): (0, 0, "", None) for s in ACCEPTING}
    rules = []

    def edit(head: tuple, initial: str, cost: int, used: int, row: int | None, role: str | None, rest: tuple):
        axiom = ("edit", initial, cost, used)
        axioms[axiom] = (cost, used, initial, None)

        def joined(first: tuple, then: tuple) -> tuple:
            return first[0] + then[0], first[1] + then[1], first[2], ((initial, row, role), then[3])

        rules.append((head, (axiom, rest), joined))

    for i in range(n + 1):
        letter, fault = codes[2 * i : 2 * i + 2] if i < n else ("", "")
        more = CUT_OFF if fault == "t" else 0
        for state, moves in MOVES.items():
            here = ("rest", i, state)
            for to, then in moves.items():
                if to in NAMES:
                    edit(here, "I", INSERT, 0, None, NAMES[to], ("rest", i, then))
                if i == n or fault in "bd":
                    continue
                if to == letter:
                    edit(here, "K", KEEP + more, 1, i, None, ("rest", i + 1, then))
                elif to in NAMES:
                    edit(here, "R", REROLE + more, 1, i, NAMES[to], ("rest", i + 1, then))
            if i < n:
                edit(here, "D", DELETE, 1, i, None, ("rest", i + 1, state))
    best = lightest_derivation(axioms, rules, ("rest", 0, 0))
    edits, trail = [], best[3]
    while trail:
        edits.append(trail[0])
        trail = trail[1]
    return best[0], edits


def plans(codes: pd.Series) -> pd.DataFrame:
    """Plans of many conversations; equal codes, most of a batch, are planned once."""
    made = {c: plan(c) for c in codes.unique()}
    listed = [made[c] for c in codes]
    return pd.DataFrame({
        "cost": [cost for cost, _ in listed],
        "audit": ["".join(e[0] for e in edits) for _, edits in listed],
        "edits": [[{"edit": a, "row": b, "role": c} for a, b, c in edits] for _, edits in listed],
    })


def count_if(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test)).cast("long")


def has_fault(fault: str) -> Callable[[Column], Column]:
    return lambda turn: turn["fault"] == fault


def repair_conversations(
    rows: DataFrame,
    conv: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair and the repaired turns.

    ``gaps`` counts the turn numbers missing between the least and the greatest, ``blank``,
    ``duplicate`` and ``truncated`` the rows by their first fault in that order: no character
    but ASCII white space; role and text of an earlier row; a last such character other than
    ``.``, ``!``, ``?``. ``illegal`` counts neighbours whose role initials aren't su, ua or au.
    ``cost``, ``audit`` and ``edits`` (initial, row from 0, new role) are the cheapest repair:
    Keep 0, Rerole 3, Delete 4 (blank and duplicate rows must go), Insert of an empty text 3,
    and 3 more for a truncated row that stays; of equal costs the least audit. ``repaired``
    lists role and text of the turns that result.

    Rows follow by turn, null first, then role and text. Null roles and texts count as empty.
    Null ids form one conversation, whole repeats are duplicates, a conversation without a
    turn number has no gaps. Extra columns are ignored; an empty table gives an empty table.
    Rows move once, to the task of their conversation, which is one row there; Python sees
    two characters per turn, so its memory does not grow with the texts.
    """
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    earlier = Window.partitionBy("conv", "role", "text").orderBy("order")
    read = rows.select(
        F.col(conv).alias("conv"), F.col(order).alias("order"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    ).repartition("conv")
    fault = (
        F.when(said == "", "b")
        .when(F.row_number().over(earlier) > 1, "d")
        .when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "t")
        .otherwise(".")
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    # Of equal rows the one that is no duplicate comes first.
    late = F.when(F.col("fault") == "d", 1).otherwise(0)
    turn = F.struct("order", "role", "text", late.alias("late"), "fault", letter.alias("letter"))
    gathered = read.withColumn("fault", fault).groupBy("conv").agg(
        F.sort_array(F.collect_list(turn)).alias("t"),
        (F.max("order") - F.min("order") + 1).alias("span"),
    )
    n = F.size("t")
    pairs = F.zip_with(
        F.slice("t", F.lit(1), n - 1), F.slice("t", F.lit(2), n - 1),
        lambda a, b: F.concat(a["letter"], b["letter"]),
    )
    numbers = F.array_distinct(F.filter("t.order", lambda o: o.isNotNull()))
    codes = F.array_join(F.transform("t", lambda t: F.concat(t["letter"], t["fault"])), "")
    planned = gathered.withColumn("plan", F.pandas_udf(plans, PLAN)(codes))
    kept = F.filter("plan.edits", lambda e: e["edit"] != "D")
    source = lambda e: F.element_at("t", e["row"] + 1)
    repaired = F.transform(
        kept,
        lambda e: F.struct(
            F.coalesce(e["role"], source(e)["role"]).alias("role"),
            F.when(e["row"].isNull(), "").otherwise(source(e)["text"]).alias("text"),
        ),
    )
    return planned.select(
        F.col("conv").alias(conv),
        F.coalesce(F.col("span") - F.size(numbers), F.lit(0)).cast("long").alias("gaps"),
        *[
            count_if(F.col("t"), has_fault(f)).alias(name)
            for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))
        ],
        count_if(pairs, lambda p: ~p.isin("su", "ua", "au")).alias("illegal"),
        "plan.cost", "plan.audit", "plan.edits",
        repaired.alias("repaired"),
    )
