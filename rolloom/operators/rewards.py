"""Reward columns.

A reward is a function ``(columns) -> Column``: ``columns`` maps the names of the input DataFrame
to columns, with at least ``prompt``, ``completion`` and ``answer`` as text. One DOUBLE column
``r_<name>`` is added per reward. The built-in rewards are plain expressions, evaluated together in
one projection; a user's own Python function can join them through :func:`python_reward`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.constants import LEXICON_V1, LEXICON_V2, WHITESPACE
from rolloom.functions.chat import first_content
from rolloom.functions.text import (
    SPACE_CLASS,
    char_class,
    count_xml,
    digit_class,
    holds,
    quoted_list,
    strip_ws,
    xml_answer,
)

Columns = Mapping[str, Column]
Reward = Callable[[Columns], Column]


def _pay(condition: Column, amount: float, otherwise: float = 0.0) -> Column:
    """``amount`` where the condition holds; a NULL condition pays ``otherwise``."""
    return F.when(condition, F.lit(amount)).otherwise(F.lit(otherwise))


# --- correctness: four notions that must stay apart --------------------------------------------


def correct_contains2(c: Columns) -> Column:
    """2.0 if the stripped answer stands anywhere inside the extracted answer."""
    return _pay(F.contains(xml_answer(c["completion"]), strip_ws(c["answer"])), 2.0)


def correct_exact2(c: Columns) -> Column:
    """2.0 if the plain extraction equals the answer as given."""
    return _pay(xml_answer(c["completion"], guarded=False).eqNullSafe(c["answer"]), 2.0)


def correct_contains1(c: Columns, listed: int | None = None) -> Column:
    """1.0 if the stripped answer stands anywhere in the stripped completion.

    ``listed`` reproduces the published code under a trainer that passes the answers as one list,
    here of that many equal ones: it looks for the printed list, which hardly ever occurs.
    """
    answer = c["answer"]
    if listed is not None:
        answer = quoted_list(F.array_repeat(answer, listed))
    return _pay(F.contains(strip_ws(c["completion"]), strip_ws(answer)), 1.0)


def correct_pm1(c: Columns, scope: str = "sequence") -> Column:
    """+1.0 / -1.0 by containment in prompt + completion, or in the completion alone.

    With ``sequence`` an answer that already stands in its prompt always pays +1.
    """
    text = c["completion"]
    if scope == "sequence":
        text = F.concat(c["prompt"], text)
    elif scope != "completion":
        raise ValueError(f"scope {scope!r}")
    return _pay(F.contains(text, c["answer"]), 1.0, -1.0)


# --- planning phrases ---------------------------------------------------------------------------


def phrase_score(text: Column, phrases: Sequence[str], each: float) -> Column:
    """``each`` for every distinct phrase that occurs, case-insensitively, as a substring.

    Summed one by one: the double equals a running sum, not ``n * each``.
    """
    lowered = F.lower(text)
    score = F.lit(0.0)
    for phrase in phrases:
        score = score + _pay(holds(lowered, phrase), each)
    return score


def planning(c: Columns, phrases: Sequence[str] = LEXICON_V1) -> Column:
    """0.1 per planning phrase, at most 0.5."""
    return F.least(phrase_score(c["completion"], phrases, 0.1), F.lit(0.5))


def reasoning(c: Columns, phrases: Sequence[str] = LEXICON_V2) -> Column:
    """0.05 per phrase, 0.2 for both reasoning tags, 0.1 for both answer tags, at most 0.5."""
    text = c["completion"]

    def both(tag: str) -> Column:
        return holds(text, f"<{tag}>") & holds(text, f"</{tag}>")

    score = phrase_score(text, phrases, 0.05)
    score = score + _pay(both("reasoning"), 0.2)
    score = score + _pay(both("answer"), 0.1)
    return F.least(score, F.lit(0.5))


# --- layout -------------------------------------------------------------------------------------

# --- fixed values: layout patterns -------------------------------------------------------------
# (?d): only \n ends a line, so dot stops nowhere else.
OPEN_REASONING, CLOSE_ANSWER = "<reasoning>", "</answer>"
TURN = f"</reasoning>{SPACE_CLASS}*<answer>"
TURN_IN_LINE = f"</reasoning>{char_class(set(WHITESPACE) - {chr(10)})}*<answer>"
END_OF_LINE = f"</reasoning>{char_class(set(WHITESPACE) - {chr(10)})}*\\z"
FORMAT_STRICT = (
    "(?d)\\A<reasoning>\\n.*?\\n</reasoning>\\n<answer>\\n.*?\\n</answer>\\n\\n?\\z"
)


def _behind(text: Column, pattern: str) -> Column:
    """What follows the first match; NULL without one."""
    return F.get(F.split(text, pattern, 2), F.lit(1))


def format_search(c: Columns) -> Column:
    """0.5 if the tagged layout occurs anywhere; bodies may span lines.

    Any text may stand between the tags, so the first of each tag decides: a text is cut at the first
    opening tag, behind it at the first turn from reasoning to answer, and behind that a closing tag
    is looked for. Each step reads the text once, however often a tag is repeated.
    """
    body = _behind(c["completion"], OPEN_REASONING)
    return _pay(F.contains(_behind(body, TURN), F.lit(CLOSE_ANSWER)), 0.5)


def format_strict(c: Columns) -> Column:
    """0.5 if the completion is exactly the line-by-line layout with one-line bodies."""
    return _pay(F.rlike(c["completion"], F.lit(FORMAT_STRICT)), 0.5)


def format_soft(c: Columns) -> Column:
    """0.5 if the completion starts with the tagged layout; bodies stay on their line.

    Either the turn from reasoning to answer lies on the first line, then its first one decides; or
    only blanks follow the reasoning on that line, and the answer opens behind them on a later one.
    """
    text = c["completion"]
    body = F.when(F.startswith(text, F.lit(OPEN_REASONING)), _behind(text, OPEN_REASONING))
    line, below = F.get(F.split(body, "\n", 2), F.lit(0)), _behind(body, "\n")
    in_line = F.contains(_behind(line, TURN_IN_LINE), F.lit(CLOSE_ANSWER))
    opened = F.ltrim(below, F.lit(WHITESPACE))
    answer = F.get(F.split(opened, "\n", 2), F.lit(0))
    over_lines = (
        F.rlike(line, F.lit(END_OF_LINE))
        & F.startswith(answer, F.lit("<answer>"))
        & F.contains(answer, F.lit(CLOSE_ANSWER))
    )
    return _pay(F.coalesce(in_line, F.lit(False)) | F.coalesce(over_lines, F.lit(False)), 0.5)


def integer(c: Columns) -> Column:
    """0.5 if the plain extraction consists of digits only, of any script."""
    pattern = F.lit(f"\\A{digit_class()}+\\z")
    return _pay(F.rlike(xml_answer(c["completion"], guarded=False), pattern), 0.5)


def xmlcount(c: Columns) -> Column:
    """Score of the tag marks, see :func:`rolloom.functions.text.count_xml`."""
    return count_xml(c["completion"])


# --- registry -----------------------------------------------------------------------------------

REWARDS: dict[str, Reward] = {
    "correct_contains2": correct_contains2,
    "correct_exact2": correct_exact2,
    "correct_contains1": correct_contains1,
    "correct_pm1": correct_pm1,
    "planning16": planning,
    "reasoning20": reasoning,
    "format_search": format_search,
    "format_strict": format_strict,
    "format_soft": format_soft,
    "int": integer,
    "xmlcount": xmlcount,
}

# the reward lists handed to the three trainers
REWARD_SETS: dict[str, list[str]] = {
    "a": ["correct_contains1", "planning16"],
    "b": ["correct_contains2", "reasoning20", "format_search"],
    "c": ["xmlcount", "format_soft", "format_strict", "int", "correct_exact2"],
}


def python_reward(
    fn: Callable[..., list[float]],
    columns: Sequence[str] = (),
    conversational: bool = False,
) -> Reward:
    """Wrap ``fn(prompts, completions, **columns) -> list[float]`` as a reward.

    Runs as an Arrow-batched pandas UDF, so the lists hold one batch of rows. With
    ``conversational`` each prompt and completion arrives as a message list.
    """
    names = list(columns)

    def call(prompt: pd.Series, completion: pd.Series, *rest: pd.Series) -> pd.Series:
        prompts, completions = prompt.tolist(), completion.tolist()
        if conversational:
            prompts = [[{"role": "user", "content": p}] for p in prompts]
            completions = [[{"role": "assistant", "content": t}] for t in completions]
        extra = {name: values.tolist() for name, values in zip(names, rest)}
        scores = fn(prompts=prompts, completions=completions, **extra)
        return pd.Series(scores, dtype="float64")

    call.__annotations__ = {
        "prompt": pd.Series,
        "completion": pd.Series,
        "rest": pd.Series,
        "return": pd.Series,
    }
    udf = F.pandas_udf(call, "double")
    return lambda c: udf(c["prompt"], c["completion"], *[c[n] for n in names])


MAX_GROUP = 10_000  # rollouts of one prompt that a group reward holds at once


def add_group_reward(
    df: DataFrame,
    name: str,
    fn: Callable[..., list[float]],
    columns: Sequence[str] = (),
    key: str = "prompt_id",
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Add ``r_<name>`` from ``fn(prompts, completions, **columns) -> list[float]``, one call per group.

    For rewards that compare the rollouts of a prompt: ``fn`` gets all of them, in no stated order, and
    returns a value for each. NULL keys are one group. A group is held in one Python worker, so its
    size is bounded: groups are counted first, and one above ``max_group`` is an error. Rewards that judge a rollout by itself need no group: see :func:`python_reward`.
    """
    df = plain_completions(df)
    over = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_group)
    if not over.isEmpty():
        raise ValueError(f"a group of {key} has more than {max_group} rollouts")
    used = list(dict.fromkeys([key, "prompt", "completion", *columns]))
    others = [c for c in df.columns if c not in used]
    names, out = list(columns), f"r_{name}"

    def score(group: pd.DataFrame) -> pd.DataFrame:
        extra = {n: group[n].tolist() for n in names}
        prompts, completions = group["prompt"].tolist(), group["completion"].tolist()
        scores = list(fn(prompts=prompts, completions=completions, **extra))
        if len(scores) != len(group):
            raise ValueError("a reward gives one value per rollout")
        return group.assign(**{out: pd.Series(scores, index=group.index, dtype="float64")})

    schema = df.select(*used, *others).schema.add(out, "double")
    scored = df.select(*used, *others).groupBy(key).applyInPandas(score, schema)
    return scored.select(*[c for c in df.columns if c != out], out)


def plain_completions(df: DataFrame, column: str = "completion") -> DataFrame:
    """Conversational completions (message lists) to text; plain text passes through."""
    if df.schema[column].dataType.typeName() == "array":
        return df.withColumn(column, first_content(F.col(column)))
    return df


def add_rewards(
    df: DataFrame, rewards: Sequence[str] | Mapping[str, Reward], **columns: Column
) -> DataFrame:
    """Add ``r_<name>`` for each reward: names from the registry, or a mapping with own ones.

    ``columns`` rename inputs, e.g. ``answer=F.col("gold")``.
    """
    table = rewards if isinstance(rewards, Mapping) else {n: REWARDS[n] for n in rewards}
    df = plain_completions(df)
    inputs = {name: F.col(name) for name in df.columns} | columns
    return df.withColumns({f"r_{name}": reward(inputs) for name, reward in table.items()})


def total_reward(
    df: DataFrame,
    names: Sequence[str],
    weights: Sequence[float] | None = None,
    out: str = "reward",
) -> DataFrame:
    """Weighted sum of reward columns; equal weights by default."""
    weights = [1.0] * len(names) if weights is None else list(weights)
    if len(weights) != len(names):
        raise ValueError("one weight per reward")
    total = F.lit(0.0)
    for name, weight in zip(names, weights):
        total = total + F.col(f"r_{name}") * F.lit(float(weight))
    return df.withColumn(out, total)
