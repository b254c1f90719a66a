"""Rollouts, responses and datasets derived from the given tables.

The tables hold plain prose: no tags, phrases, fences or answers. They are planted here by integer
arithmetic on the keys, over whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.constants import EVAL_TASKS, LEXICON_V2, NUM_GENERATIONS
from rolloom.functions.arrays import quote
from rolloom.operators.dataset import fan_out_rollouts, zip_answers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prompt_key(conv: Column, turn: Column) -> Column:
    """(conversation, turn) as one ordered BIGINT: 31 bits of conversation, 32 of turn."""
    return F.shiftleft(conv, 32) + turn


def completions(conversations: DataFrame) -> DataFrame:
    """Assistant turns: what a model answered."""
    turns = conversations.filter(F.col("role") == "assistant")
    return turns.select(
        prompt_key(F.col("conv_id"), F.col("turn")).alias("prompt_id"),
        F.col("conv_id").alias("c"),
        F.col("turn").alias("t"),
        F.col("text").alias("said"),
    )


def prompts(conversations: DataFrame) -> DataFrame:
    """User turns, keyed by the turn that answers them."""
    turns = conversations.filter(F.col("role") == "user")
    return turns.select(
        prompt_key(F.col("conv_id"), F.col("turn") + 1).alias("prompt_id"),
        F.col("text").alias("question"),
    )


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer rows: every assistant turn with the user turn before it.

    Every fifth conversation gives the answer away in its prompt.
    """
    talks = table(spark, sf_dir, "conversations")
    rows = zip_answers(completions(talks), prompts(talks))
    rows = rows.selectExpr("*", "string((c * 37 + t * 11) % 97) AS answer")
    return rows.selectExpr(
        "prompt_id",
        "c",
        "t",
        "said",
        "answer",
        "IF(c % 5 = 0, concat(question, ' (', answer, ')'), question) AS prompt",
    )


def _cot(body: str, answer: str) -> str:
    return (
        f"concat('<reasoning>\\n', {body}, '\\n</reasoning>\\n<answer>\\n', {answer}, "
        "'\\n</answer>\\n')"
    )


# the ten layouts of a completion, over: said text `ml` with planted phrases `g`, the same on one
# line `ol`, the guessed answer `ga`
LAYOUTS = [
    _cot("ol", "ga"),
    _cot("concat(ml, '\\n', g)", "ga"),
    "concat('<reasoning>', ol, '</reasoning><answer>', ga, '</answer>')",
    "concat('Sure. <reasoning>', ml, '</reasoning>\\n<answer> ', ga, ' units</answer> ok')",
    "concat(ml, ' The final answer is ', ga)",
    "concat('<answer>0</answer>', ml, '<answer>', ga, '</answer>zz')",
    "concat(ml, '\\n#### ', ga, ' #### 1')",
    "concat(ml, ' ', ga, '</answer> tail')",
    f"concat({_cot("concat('maybe ', answer, ' ', ol)", "string(100 + (c + t) % 9)")}, "
    "repeat('x', int(gen_idx)))",
    "concat('<reasoning></reasoning><answer></answer>', g)",
]


def rollouts(spark: SparkSession, sf_dir: str, n: int = NUM_GENERATIONS) -> DataFrame:
    """``n`` completions per prompt, in ten layouts."""
    lexicon = f"array({', '.join(map(quote, LEXICON_V2))})"
    planted = (
        f"array_join(slice({lexicon}, int(1 + (c + t) % 8), "
        "int((c * 3 + t * 5 + gen_idx * 2) % 13)), ', ')"
    )
    missed = "string((c * 37 + t * 11 + gen_idx * 13 + 1) % 97)"
    guess = f"IF((c + t + gen_idx) % 3 = 0, answer, {missed})"
    rows = fan_out_rollouts(answered(spark, sf_dir), n)
    rows = rows.selectExpr("*", f"{planted} AS plain_g", f"{guess} AS ga")
    rows = rows.selectExpr("*", "IF(gen_idx = 3, upper(plain_g), plain_g) AS g")
    rows = rows.selectExpr("*", "concat(said, ' ', g) AS ml")
    rows = rows.selectExpr("*", "translate(ml, '\\r\\n', '  ') AS ol")
    cases = " ".join(f"WHEN {i} THEN {layout}" for i, layout in enumerate(LAYOUTS))
    return rows.selectExpr(
        "prompt_id",
        "gen_idx",
        "prompt",
        "answer",
        f"CASE (c * 5 + t * 3 + gen_idx * 7) % 10 {cases} END AS completion",
        "c",
        "t",
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts with the whole decoded sequence, prompt and completion on their own lines."""
    return rollouts(spark, sf_dir).withColumn("sequence", F.concat_ws("\n", "prompt", "completion"))


def token_logp(token: Column, index: Column) -> Column:
    """Stand-in for a model's log-probability of a token: a value in [-2.3, -0.1]."""
    return -(((F.length(token) * 7 + index * 3) % 23) + 1) / F.lit(10.0)


def eval_samples(scored: DataFrame) -> DataFrame:
    """Scored rollouts as per-sample evaluation log of three tasks."""
    names = F.array(*[F.lit(x) for x in EVAL_TASKS])
    task = F.element_at(names, (1 + F.col("c") % 3).cast("int"))
    score = F.when(F.col("r_correct_exact2") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return scored.select(
        task.alias("task"), "prompt_id", "gen_idx", score.alias("score")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed provider responses: one per assistant turn, some broken, fenced, empty or failed."""

    def item(number: int, answer: str) -> str:
        text = f"concat('Q', pid, '-{number} ', said)"
        opened = f"rtrim('}}', to_json(struct({text} AS prompt)))"
        return f"""concat({opened}, ',"answer":', {answer}, '}}')"""

    first = item(1, """IF(sh = 5, concat(pid, '.50'), concat('"', (c * 100 + t) % 97, '"'))""")
    second = f"IF(t % 4 = 1 OR sh = 3, concat(',', {item(2, quote('"x"'))}), '')"
    turns = completions(table(spark, sf_dir, "conversations"))
    rows = turns.selectExpr("*", "string(c * 100 + t) AS pid", "(c * 3 + t) % 6 AS sh")
    rows = rows.selectExpr("*", f"concat({first}, {second}) AS body")
    rows = rows.selectExpr(
        "*",
        """CASE WHEN sh IN (0, 5) THEN concat('[', body, ']')
                WHEN sh = 1 THEN concat('```json\\n[', body, ']\\n```')
                WHEN sh = 2 THEN concat('\\n```[', body, ']``` ')
                WHEN sh = 3 THEN concat('[', body)
                ELSE '[]' END AS txt""",
    )
    return rows.selectExpr(
        "prompt_id AS batch_no",
        "CASE c % 4 WHEN 0 THEN 'Anthropic' WHEN 1 THEN 'huggingface' WHEN 2 THEN 'gemini' END"
        " AS provider",
        "IF((c + t) % 11 = 0, 500, 200) AS status",
        """CASE c % 4
             WHEN 0 THEN to_json(struct(array(struct('text' AS type, txt AS text)) AS content))
             WHEN 1 THEN
               to_json(struct(array(struct(struct(txt AS content) AS message)) AS choices))
             ELSE to_json(struct(txt AS text)) END AS raw""",
    )


def events_as_rollouts(events: DataFrame, *carry: str) -> DataFrame:
    """Events as logged rollouts: eight in a row make a training step."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        *carry,
        F.floor(F.col("event_id") / 8).alias("step"),
        (k / 100).alias("loss"),
        F.col("value").alias("reward"),
        F.length("event_type").cast("bigint").alias("completion_length"),
        (-F.col("value") / 7).alias("logp"),
        (-k / 11).alias("ref_logp"),
    )
