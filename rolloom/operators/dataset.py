"""Dataset construction: prompt grid, response parsing, chat formatting, rollout groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.constants import (
    CONCEPTS,
    DIFFICULTIES,
    DOMAINS,
    DYNAMIC_GENERATOR_PROMPT,
    FORMAT_SYSTEM_PROMPT,
    MATH_SYSTEM_PROMPT,
    NUM_GENERATIONS,
    PLAIN_GENERATOR_PROMPT,
    TARGET_SAMPLES,
)
from rolloom.functions.chat import chat_prompt
from rolloom.functions.numbers import float_text
from rolloom.functions.text import hash_answer, preview, strip_fences, strip_ws
from rolloom.operators.skew import running_sum
from rolloom.session import materialize

DIMENSIONS: dict[str, list[str]] = {
    "domain": DOMAINS,
    "concept": CONCEPTS,
    "difficulty": DIFFICULTIES,
}


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def prompt_grid(
    spark: SparkSession, dimensions: Mapping[str, Sequence[str]] = DIMENSIONS
) -> DataFrame:
    """Every combination of the generator dimensions (9 x 9 x 4 = 324 rows by default).

    Exploded from literal lists one after the other: no join.
    """
    grid = spark.range(1)
    for name, values in dimensions.items():
        grid = grid.withColumn(name, F.explode(_strings(values)))
    return grid.drop("id")


def prompt_sample(
    requests: DataFrame,
    request_id: str,
    seed: int = 0,
    dimensions: Mapping[str, Sequence[str]] = DIMENSIONS,
) -> DataFrame:
    """One uniform draw per dimension and request, independent, with replacement.

    The draw comes from a digest of request and seed, not from ``rand()``: a retried task draws
    the same values again. Each dimension uses its own 32 bits of the digest.
    """
    if len(dimensions) > 4:
        raise ValueError("one digest holds four draws")
    digest = F.md5(F.concat_ws(":", F.col(request_id).cast("string"), F.lit(str(seed))))
    drawn = requests.withColumn("_digest", digest)
    picks = {
        name: F.element_at(
            _strings(values),
            (
                F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("bigint")
                % len(values)
                + 1
            ).cast("int"),
        )
        for i, (name, values) in enumerate(dimensions.items())
    }
    return drawn.withColumns(picks).drop("_digest")


def prompt_render(draws: DataFrame, out: str = "prompt") -> DataFrame:
    """Fill the generator template from the drawn dimensions."""
    pieces = DYNAMIC_GENERATOR_PROMPT.split("%s")
    slots = [F.col("difficulty"), F.col("domain"), F.col("concept")]
    parts = [F.lit(pieces[0])]
    for slot, piece in zip(slots, pieces[1:]):
        parts += [slot, F.lit(piece)]
    return draws.withColumn(out, F.concat(*parts))


def plain_prompt(requests: DataFrame, out: str = "prompt") -> DataFrame:
    """The generator's text without slots, for every request."""
    return requests.withColumn(out, F.lit(PLAIN_GENERATOR_PROMPT))


# --- responses -> question/answer rows ----------------------------------------------------------

_JSON = {"allowSingleQuotes": "false"}


def parse_batches(
    responses: DataFrame, text: str = "text", fenced: Column | None = None
) -> DataFrame:
    """Add ``items``: the items of a text that is exactly one JSON list, as JSON strings.

    NULL for anything else. ``fenced`` tells which rows may carry code fences; rows from a JSON mode
    are parsed as is.

    Spark's JSON reader stops after the first value, so text behind the list would be accepted. As
    an element of a list the text is read to its end, unless it closes that list itself; only a text
    with two closing brackets in a row can, and that one is read once more as a field of an object.
    """
    body = strip_fences(F.col(text))
    if fenced is not None:
        body = F.when(fenced, body).otherwise(F.col(text))
    parsed = responses.withColumn("_body", body)
    listed = F.from_json(
        F.concat(F.lit("["), "_body", F.lit("]")), "array<array<string>>", _JSON
    )
    starts = F.startswith(strip_ws(F.col("_body")), F.lit("["))
    parsed = parsed.withColumn("_listed", F.when(starts, listed))
    field = F.from_json(F.concat(F.lit('{"v":'), "_body", F.lit("}")), "v string", _JSON)["v"]
    whole = ~F.rlike("_body", F.lit("\\][ \\t\\r\\n]*\\]")) | field.isNotNull()
    items = F.when((F.size("_listed") == 1) & whole, F.get("_listed", F.lit(0)))
    return parsed.withColumn("items", items).drop("_body", "_listed")


def drop_empty_batches(batches: DataFrame) -> DataFrame:
    """Failed and empty batches add nothing."""
    return batches.filter(F.size("items") > 0)


def batch_counts(batches: DataFrame, *by: str) -> DataFrame:
    """Kept and dropped batches, so that a loss of input stays visible."""
    size = F.coalesce(F.size("items"), F.lit(0))
    kept = (F.col("items").isNotNull()) & (size > 0)
    return batches.groupBy(*by).agg(
        F.count_if(kept).alias("n_kept"),
        F.count_if(~kept).alias("n_dropped"),
        F.sum(F.when(kept, size).otherwise(0)).cast("bigint").alias("n_items"),
    )


def explode_items(
    batches: DataFrame, batch_col: str = "batch_no", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per item, in batch order: ``(batch, *carry, pos, prompt, answer, is_object)``.

    Answers are text: a JSON number is rendered in its shortest decimal form. Items that are no
    objects are kept with NULL fields and ``is_object`` false.

    The outer form of explode, filtered behind it, drops failed and empty batches without a filter
    on ``items`` itself: such a filter would be pushed below and parse every text twice.
    """
    items = batches.select(batch_col, *carry, F.posexplode_outer("items").alias("pos", "_item"))
    items = items.filter(F.col("pos").isNotNull())
    fields = F.from_json("_item", "prompt string, answer string", _JSON)
    number = F.from_json("_item", "answer double", _JSON)["answer"]
    answer = F.col("_f.answer")
    answer = F.when(
        answer.rlike("\\A-?[0-9]\\.[0-9]+E-?[0-9]+\\z") & number.isNotNull(), float_text(number)
    ).otherwise(answer)
    is_object = F.startswith("_item", F.lit("{"))
    return items.withColumn("_f", fields).select(
        batch_col,
        *carry,
        F.col("pos").cast("bigint").alias("pos"),
        F.when(is_object, F.col("_f.prompt")).alias("prompt"),
        F.when(is_object, answer).alias("answer"),
        is_object.alias("is_object"),
    )


def union_batches(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs; duplicates stay, ``(batch, pos)`` carries the order."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _progress(sizes: DataFrame, batch_col: str) -> DataFrame:
    sizes = materialize(sizes, "batch-sizes")  # used on every level of the running sum
    return running_sum(sizes, batch_col, F.col("n_items"), "before").withColumn(
        "progress", F.col("before") + F.col("n_items")
    )


def collect_progress(items: DataFrame, batch_col: str = "batch_no") -> DataFrame:
    """Per batch: its size, the total before it and the total with it.

    ``items`` are rows of items. Batch numbers may be negative; a NULL one is an error.
    """
    return _progress(items.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_items")), batch_col)


def batch_progress(batches: DataFrame, batch_col: str = "batch_no") -> DataFrame:
    """:func:`collect_progress` from parsed batches, whose items are counted and not exploded.

    Empty batches are dropped by their sum: a filter on ``items`` would be pushed below the
    aggregation and parse every text twice.
    """
    size = F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0))
    sizes = batches.groupBy(batch_col).agg(F.sum(size).alias("n_items")).filter("n_items > 0")
    return _progress(sizes, batch_col)


def _kept_prefix(
    rows: DataFrame, progress: DataFrame, target: int, batch_col: str
) -> tuple[DataFrame, DataFrame]:
    """The kept batches are a prefix of the order. Its last number, one value, is looked up first,
    so that a filter reaches the scan and later batches are not read again."""
    kept = progress.filter(F.col("before") < target).select(batch_col, "progress")
    last = kept.agg(F.max(batch_col)).first()[0]
    return rows.filter(F.lit(False) if last is None else F.col(batch_col) <= last), kept


def collect_until(
    items: DataFrame, target: int = TARGET_SAMPLES, batch_col: str = "batch_no"
) -> DataFrame:
    """Whole batches in order until at least ``target`` rows are there; the overshoot is kept."""
    prefix, kept = _kept_prefix(items, collect_progress(items, batch_col), target, batch_col)
    return prefix.join(kept, batch_col)


def batch_range(batches: DataFrame, batch_col: str = "batch_no") -> tuple[int, int, int] | None:
    """First and last batch number and the number of batches; None where there is none.

    Only the column of numbers is read. A NULL number has no place in the order and is an error.
    """
    found = batches.agg(
        F.min(batch_col), F.max(batch_col), F.count(batch_col), F.count(F.lit(1))
    ).first()
    if found[2] < found[3]:
        raise ValueError(f"NULL in {batch_col}, which gives the order")
    return tuple(found[:3]) if found[2] else None


def collect_batches(
    batches: DataFrame,
    target: int = TARGET_SAMPLES,
    batch_col: str = "batch_no",
    bounds: tuple[int, int, int] | None = None,
) -> DataFrame:
    """:func:`collect_until` from parsed batches, by a prefix of batch numbers that doubles.

    The first round takes the range in which half as many batches as ``target`` lie on average, each
    further round as much again as all before it, or what the items found so far let expect to be
    enough, up to four times as much, until the items of all rounds reach the target. So the texts read
    are within a small factor of those kept, however many follow; a round's filter on the batch number
    reaches the scan. Each text is parsed once: a round's items are written, counted, and cut behind
    the last round. ``bounds`` are those of :func:`batch_range`, for callers that know them; otherwise
    the column of numbers is read once.

    Numbers may be negative and have gaps; gaps cost rounds, at most one per bit of their width.
    """
    found = bounds or batch_range(batches, batch_col)
    items = explode_items(batches, batch_col)
    rounds: list[DataFrame] = []
    if found is not None:
        low, high, n = found
        width = max(1, (high - low + 1) * (target // 2) // n)
        begin, total = low, 0
        while begin <= high and total < target:
            end = min(begin + width - 1, high)
            part = items.filter(F.col(batch_col).between(begin, end))
            part = materialize(part, "batch-prefix")
            total += part.count()
            rounds.append(part)
            begin, so_far = end + 1, end - low + 1
            enough = so_far * (target - total) * 5 // (4 * total) if total else so_far
            width = max(so_far, min(enough, 4 * so_far))
    if not rounds:
        rounds = [items.filter(F.lit(False))]
    # the rounds hold little behind the last kept batch, so no filter is looked up first
    read = union_batches(*rounds)
    kept = collect_progress(read, batch_col).filter(F.col("before") < target)
    return read.join(kept.select(batch_col, "progress"), batch_col)


# --- chat datasets and rollout groups -----------------------------------------------------------


def format_chat(qa: DataFrame, system: str = MATH_SYSTEM_PROMPT) -> DataFrame:
    """Question/answer rows to chat prompts; the system text is stripped, NULL answers stay NULL."""
    return qa.withColumns(
        {
            "prompt": chat_prompt(system.strip(), F.col("prompt")),
            "answer": F.col("answer").cast("string"),
        }
    )


def format_chat_hash(qa: DataFrame, system: str = FORMAT_SYSTEM_PROMPT) -> DataFrame:
    """Grade-school rows: un-stripped system text, the answer is the field behind ``####``."""
    return qa.withColumns(
        {"prompt": chat_prompt(system, F.col("question")), "answer": hash_answer(F.col("answer"))}
    ).drop("question")


def fan_out_rollouts(prompts: DataFrame, n: int = NUM_GENERATIONS) -> DataFrame:
    """N rows per prompt, numbered ``gen_idx`` from 0."""
    gens = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    return prompts.withColumn("gen_idx", gens)


def zip_answers(completions: DataFrame, prompts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Pair completions with their prompt row by key, in place of list positions.

    ``prompts`` has one row per key. A key that holds many completions is split at run time by
    adaptive skew-join handling: both inputs reach the join straight from their shuffle.
    """
    return completions.join(prompts, key)


def mark_valid(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Add ``reason``: the first failed check, NULL for a good row.

    A check that evaluates to NULL counts as failed. No row fails the job.
    """
    failed = [
        F.when(~F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in checks.items()
    ]
    return df.withColumn("reason", F.coalesce(*failed))


def split_valid(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the quarantine with its reasons.

    Both read ``marked``; write it down first where the checks are expensive.
    """
    good = marked.filter(F.col("reason").isNull()).drop("reason")
    return good, marked.filter(F.col("reason").isNotNull())


def dataset_profile(df: DataFrame, key: str) -> DataFrame:
    """Per column: type, row count, NULL count and a sample from the first row by ``key``.

    One pass: the first row is a ``min_by``, not a sort.
    """
    fields = [f for f in df.schema.fields if f.name != key]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        aggs.append(F.count(f.name).alias(f"_c{i}"))
        aggs.append(F.min_by(preview(F.col(f.name).cast("string"), 100), key).alias(f"_s{i}"))
    columns = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("_n").alias("n_rows"),
            (F.col("_n") - F.col(f"_c{i}")).alias("n_null"),
            F.col(f"_s{i}").alias("sample"),
        )
        for i, f in enumerate(fields)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*columns)))
