"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.constants import LEXICON_V1, LEXICON_V2, REPORT_EVERY
from rolloom.functions.chat import (
    ASSISTANT_HEADER,
    first_content,
    last_content,
    message,
    render_chat,
    render_message,
)
from rolloom.functions.text import (
    count_xml,
    hash_answer,
    preview,
    strip_fences,
    xml_answer,
    xml_cot,
)
from rolloom.operators import audits, credit, dataset, layout, lexicon, reports, tokens
from rolloom.operators.rewards import (
    REWARD_SETS,
    REWARDS,
    add_group_reward,
    add_rewards,
    correct_pm1,
    python_reward,
    total_reward,
)
from rolloom.plans import derived, training
from rolloom.session import materialize, scratch_path
from rolloom.sources import qa as qa_source
from rolloom.sources import reports as report_source
from rolloom.sources.responses import split_by_status, unwrap_response
from rolloom.streaming import ingest
from rolloom.streaming.step_log import stream_step_log

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["prompt_id", "gen_idx"]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def query(fn: Query) -> Query:
    return register(fn.__name__)(fn)


def r6(value: Column) -> Column:
    """Doubles are compared at six decimals; adding 0.0 turns -0.0 into 0.0."""
    return F.round(value, 6) + F.lit(0.0)


def _loss_columns(loss: DataFrame) -> DataFrame:
    n = F.col("n_tokens").cast("bigint").alias("n_tokens")
    return loss.select("prompt_id", r6(F.col("loss")).alias("loss"), n)


# --- flagship and the planning-token loop --------------------------------------------------------


@query
def flagship(spark, sf_dir):
    best = training.best_rollouts(derived.rollouts(spark, sf_dir))
    return best.select(
        "prompt_id",
        "n_rollouts",
        *[r6(F.col(x)).alias(x) for x in ("mean_reward", "std_reward")],
        "best_gen_idx",
        *[r6(F.col(x)).alias(x) for x in ("best_reward", "best_advantage")],
    )


@query
def planning_credit(spark, sf_dir):
    loss = training.planning_credit(derived.sequences(spark, sf_dir), derived.token_logp)
    return _loss_columns(loss)


# --- sources and sinks ---------------------------------------------------------------------------


def _qa(spark, sf_dir):
    return derived.answered(spark, sf_dir).select("prompt", "answer")


@query
def src_qa_json(spark, sf_dir):
    path = scratch_path(spark, "qa-array")
    qa_source.write_qa_json_array(_qa(spark, sf_dir), path)
    return qa_source.read_qa_json(spark, path, "train")


@query
def src_split_config(spark, sf_dir):
    rows = derived.answered(spark, sf_dir).select(
        "prompt_id",
        "answer",
        F.lit("main").alias("config"),
        F.when(F.col("c") % 10 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
    )
    path = scratch_path(spark, "split-tree")
    qa_source.write_split_tree(rows, path)
    return dataset.union_batches(
        *[qa_source.read_split(spark, path, "main", s) for s in ("train", "test")]
    ).select("prompt_id", "answer", "config", "split")


@query
def src_response_unwrap(spark, sf_dir):
    rows = unwrap_response(derived.responses(spark, sf_dir))
    return rows.select("batch_no", "provider", "text")


@query
def src_status_filter(spark, sf_dir):
    good, bad = split_by_status(derived.responses(spark, sf_dir))
    columns = ["batch_no", F.col("status").cast("bigint").alias("status")]
    return dataset.union_batches(
        good.select(*columns, F.lit(True).alias("accepted")),
        bad.select(*columns, F.lit(False).alias("accepted")),
    )


@query
def sink_json_overwrite(spark, sf_dir):
    path = scratch_path(spark, "qa-lines")
    qa_source.write_qa_json(_qa(spark, sf_dir), path)
    return qa_source.read_qa_json_lines(spark, path)


# --- dataset construction ------------------------------------------------------------------------


def _requests(spark, sf_dir):
    return derived.table(spark, sf_dir, "documents").select("doc_id")


@query
def prompt_grid(spark, sf_dir):
    drawn = dataset.prompt_sample(_requests(spark, sf_dir), "doc_id")
    dims = list(dataset.DIMENSIONS)
    used = drawn.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    grid = dataset.prompt_grid(spark).join(used, dims, "left")
    return grid.select(*dims, F.coalesce("n", F.lit(0)).alias("n_requests"))


@query
def prompt_sample(spark, sf_dir):
    return dataset.prompt_sample(_requests(spark, sf_dir), "doc_id")


@query
def prompt_render(spark, sf_dir):
    drawn = dataset.prompt_sample(_requests(spark, sf_dir), "doc_id", seed=7)
    return dataset.prompt_render(drawn).select("doc_id", "prompt")


def _accepted(spark, sf_dir):
    good, _ = split_by_status(derived.responses(spark, sf_dir))
    return unwrap_response(good)


def _batches(spark, sf_dir):
    return dataset.parse_batches(_accepted(spark, sf_dir))


def _items(spark, sf_dir):
    return dataset.explode_items(_batches(spark, sf_dir)).drop("is_object")


@register("strip_fences")
def strip_fence_text(spark, sf_dir):
    return _accepted(spark, sf_dir).select("batch_no", strip_fences(F.col("text")).alias("body"))


@query
def strip_fences_json_mode(spark, sf_dir):
    """One provider answers in a JSON mode and is parsed as it is; fences make its texts fail."""
    fenced = F.col("provider") != "gemini"
    batches = dataset.parse_batches(_accepted(spark, sf_dir), fenced=fenced)
    return dataset.batch_counts(batches, "provider")


@query
def prompt_render_plain(spark, sf_dir):
    return dataset.plain_prompt(_requests(spark, sf_dir))


@query
def parse_qa_batch(spark, sf_dir):
    return _items(spark, sf_dir)


@query
def drop_empty_batch(spark, sf_dir):
    return dataset.batch_counts(_batches(spark, sf_dir), "provider")


@query
def union_batches(spark, sf_dir):
    batches = _batches(spark, sf_dir)
    hosted = F.col("provider") == "huggingface"
    return dataset.union_batches(
        *[
            dataset.explode_items(batches.filter(side)).select(
                "batch_no", "pos", "answer", F.lit(name).alias("generator")
            )
            for name, side in (("hosted", hosted), ("direct", ~hosted))
        ]
    )


@query
def collect_progress(spark, sf_dir):
    return dataset.batch_progress(_batches(spark, sf_dir))


@query
def collect_until_n(spark, sf_dir):
    return dataset.collect_batches(_batches(spark, sf_dir)).drop("is_object")


@query
def collect_until_signed(spark, sf_dir):
    """Batches numbered on both sides of zero."""
    batches = _batches(spark, sf_dir).withColumn(
        "batch_no", F.expr("IF(batch_no % 2 = 0, batch_no, -batch_no)")
    )
    return dataset.collect_batches(batches).drop("is_object", "prompt")


@query
def format_chat(spark, sf_dir):
    rows = derived.answered(spark, sf_dir).select("prompt_id", "prompt", "answer")
    chat = dataset.format_chat(rows)
    return chat.select("prompt_id", F.posexplode("prompt").alias("turn", "m"), "answer").select(
        "prompt_id",
        F.col("turn").cast("bigint").alias("turn"),
        "m.role",
        "m.content",
        "answer",
    )


def _grade_school(spark, sf_dir):
    solved = F.concat("said", F.lit("\n#### "), "answer")
    return derived.answered(spark, sf_dir).select(
        "prompt_id", F.col("prompt").alias("question"), solved.alias("answer")
    )


@query
def format_chat_gsm8k(spark, sf_dir):
    chat = dataset.format_chat_hash(_grade_school(spark, sf_dir))
    return chat.select(
        "prompt_id",
        first_content(F.col("prompt")).alias("system"),
        last_content(F.col("prompt")).alias("question"),
        "answer",
    )


@query
def fan_out_rollouts(spark, sf_dir):
    return dataset.fan_out_rollouts(
        derived.answered(spark, sf_dir).select("prompt_id", "answer"), n=6
    )


@query
def zip_answers(spark, sf_dir):
    answers = derived.answered(spark, sf_dir).select("prompt_id", "answer")
    said = derived.rollouts(spark, sf_dir).select(*KEYS, "completion")
    return dataset.zip_answers(said, answers)


@query
def msg_access(spark, sf_dir):
    rows = dataset.format_chat(derived.rollouts(spark, sf_dir)).withColumn(
        "completion", F.array(message("assistant", F.col("completion")))
    )
    return rows.select(
        *KEYS,
        first_content(F.col("completion")).alias("completion"),
        last_content(F.col("prompt")).alias("question"),
    )


@query
def dataset_profile(spark, sf_dir):
    rows = derived.answered(spark, sf_dir).select("prompt_id", "prompt", "answer")
    return dataset.dataset_profile(rows, "prompt_id")


@query
def reward_debug(spark, sf_dir):
    """The printed sample of the reward: question, expected and extracted answer, shortened."""
    rows = derived.rollouts(spark, sf_dir)
    return rows.select(
        *KEYS,
        preview(F.col("prompt"), 100).alias("question"),
        F.col("answer").alias("expected"),
        preview(xml_answer(F.col("completion")), 50).alias("extracted"),
    )


@query
def skip_bad_rows(spark, sf_dir):
    rows = unwrap_response(derived.responses(spark, sf_dir))
    checks = {
        "http error": F.col("status") < 400,
        "no text": F.col("text").isNotNull(),
        "not a list": F.col("items").isNotNull(),
        "empty": F.size("items") > 0,
    }
    marked = dataset.mark_valid(dataset.parse_batches(rows), checks)
    marked = materialize(marked.select("batch_no", "reason"), "checked")
    good, bad = dataset.split_valid(marked)
    return dataset.union_batches(
        good.select("batch_no", F.lit("ok").alias("reason")), bad.select("batch_no", "reason")
    )


# --- text extraction and rendering ---------------------------------------------------------------


def _scalar(expression: Callable[[Column], Column], name: str, decimals: bool = False) -> Query:
    def run(spark, sf_dir):
        value = expression(F.col("completion"))
        value = r6(value) if decimals else value
        return derived.rollouts(spark, sf_dir).select(*KEYS, value.alias(name))

    return run


QUERIES["xml_answer_guarded"] = _scalar(xml_answer, "extracted")
QUERIES["xml_answer_plain"] = _scalar(lambda c: xml_answer(c, guarded=False), "extracted")
QUERIES["hash_answer"] = _scalar(hash_answer, "extracted")
QUERIES["count_xml"] = _scalar(count_xml, "score", decimals=True)


@query
def xml_cot_render(spark, sf_dir):
    rows = derived.answered(spark, sf_dir)
    return rows.select("prompt_id", xml_cot(F.col("said"), F.col("answer")).alias("text"))


@query
def chat_render(spark, sf_dir):
    rows = derived.answered(spark, sf_dir).select("prompt_id", "prompt", "answer")
    chat = dataset.format_chat(rows)
    return chat.select(
        "prompt_id",
        render_chat(F.col("prompt")).alias("text"),
        render_chat(F.col("prompt"), add_generation_prompt=False, compat=True).alias("text_compat"),
    )


@query
def chat_render_turns(spark, sf_dir):
    """Conversations in long form: one piece per turn, the generation header as an extra turn.

    A conversation of any length stays spread over its rows; its text is the pieces in turn order.
    """
    talks = derived.table(spark, sf_dir, "conversations")
    pieces = talks.select(
        "conv_id", "turn", render_message(F.col("role"), F.col("text")).alias("piece")
    )
    headers = talks.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    return pieces.unionByName(headers.withColumn("piece", F.lit(ASSISTANT_HEADER)))


# --- rewards -------------------------------------------------------------------------------------


def _reward(name: str) -> Query:
    def run(spark, sf_dir):
        scored = add_rewards(derived.rollouts(spark, sf_dir), [name])
        return scored.select(*KEYS, r6(F.col(f"r_{name}")).alias(f"r_{name}"))

    return run


for _name in REWARDS:
    QUERIES[f"rw_{_name}"] = _reward(_name)


@query
def rw_correct_pm1_scopes(spark, sf_dir):
    """Whole sequence against completion alone: where they differ, the prompt holds the answer."""
    scored = add_rewards(
        derived.rollouts(spark, sf_dir),
        {s: (lambda c, s=s: correct_pm1(c, scope=s)) for s in ("sequence", "completion")},
    )
    return scored.select(*KEYS, "r_sequence", "r_completion")


@query
def rw_correct_contains1_listed(spark, sf_dir):
    """Answers sought as a printed list, which every fourth completion is given."""
    printed = F.concat(F.lit(" ['"), "answer", F.lit("', '"), "answer", F.lit("']"))
    completion = F.col("completion")
    given = F.when(F.col("gen_idx") == 3, F.concat(completion, printed)).otherwise(completion)
    scored = add_rewards(
        derived.rollouts(spark, sf_dir),
        {"listed": lambda c: REWARDS["correct_contains1"](c, listed=2)},
        completion=given,
    )
    return scored.select(*KEYS, "r_listed")


def _total(which: str) -> Query:
    def run(spark, sf_dir):
        names = REWARD_SETS[which]
        scored = total_reward(add_rewards(derived.rollouts(spark, sf_dir), names), names)
        return scored.select(*KEYS, r6(F.col("reward")).alias("reward"))

    return run


for _name in REWARD_SETS:
    QUERIES[f"rw_total_{_name}"] = _total(_name)


def _brevity(prompts, completions, answer, **_):
    """A user's own Python reward: short completions that hold the answer."""
    return [
        1.0 / (1 + len(text) // 100) if gold in text else 0.0
        for text, gold in zip(completions, answer)
    ]


@query
def reward_registry(spark, sf_dir):
    own = {
        "correct": REWARDS["correct_contains1"],
        "leak": lambda c: F.when(F.contains(c["prompt"], c["answer"]), -0.5).otherwise(0.0),
        "brevity": python_reward(_brevity, ["answer"]),
    }
    scored = add_rewards(derived.rollouts(spark, sf_dir), own)
    scored = total_reward(scored, list(own), weights=[1.0, 2.0, 0.25])
    return scored.select(
        *KEYS, *[r6(F.col(x)).alias(x) for x in ("r_correct", "r_leak", "r_brevity", "reward")]
    )


def _briefest(prompts, completions, **_):
    """1 for the shortest completions of a prompt, 0 for the longest, and what lies between."""
    sizes = [len(c or "") for c in completions]
    low, high = min(sizes), max(sizes)
    return [(high - n) / (high - low) if high > low else 1.0 for n in sizes]


@query
def reward_group(spark, sf_dir):
    """An own reward that compares the rollouts of a prompt."""
    scored = add_group_reward(derived.rollouts(spark, sf_dir), "brief", _briefest)
    return scored.select(*KEYS, r6(F.col("r_brief")).alias("r_brief"))


# --- group and token credit ----------------------------------------------------------------------


def _scored(spark, sf_dir):
    return materialize(training.score(derived.rollouts(spark, sf_dir)), "scored")


@query
def group_advantage(spark, sf_dir):
    adv = credit.group_advantage(_scored(spark, sf_dir))
    return adv.select(*KEYS, *[r6(F.col(x)).alias(x) for x in ("reward", "advantage")])


@query
def group_stats(spark, sf_dir):
    stats = credit.group_stats(training.score(derived.rollouts(spark, sf_dir)))
    return stats.select(
        "prompt_id",
        *[r6(F.col(x)).alias(x) for x in ("mean_reward", "std_reward")],
        "n_rollouts",
    )


@query
def token_offsets(spark, sf_dir):
    """Offsets over all documents, folded per document to counts and position checksums."""
    documents = derived.table(spark, sf_dir, "documents")
    rows = tokens.token_offsets(documents, "text", ["doc_id"])
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.max("end").alias("last_end"),
        F.sum("start").alias("start_sum"),
        F.sum(F.col("end") * (F.col("token_idx") % 1009)).alias("end_check"),
        F.sum(F.length("token") * F.col("token_idx")).alias("length_check"),
    )


def _mask(spark, sf_dir):
    return tokens.planning_mask(derived.rollouts(spark, sf_dir), "completion", KEYS)


@query
def gram_spans(spark, sf_dir):
    rows = derived.rollouts(spark, sf_dir)
    spans = tokens.gram_spans(rows, "completion", KEYS)
    return spans.select(*KEYS, "gram", "start", "end")


@query
def gram_spans_lexicon(spark, sf_dir):
    """The same hits from one automaton over all phrases."""
    rows = derived.rollouts(spark, sf_dir)
    return lexicon.lexicon_spans(rows, "completion", KEYS, LEXICON_V1)


@query
def lexicon_counts(spark, sf_dir):
    """Phrases of both lexicons, counted per rollout; those in both count twice."""
    rows = derived.rollouts(spark, sf_dir)
    return lexicon.lexicon_counts(rows, "completion", KEYS, [*LEXICON_V1, *LEXICON_V2])


@query
def planning_mask(spark, sf_dir):
    return _mask(spark, sf_dir).select(*KEYS, "token_idx", "start", "end", "planning")


@query
def planning_mask_join(spark, sf_dir):
    """The same flags from separate token and span tables."""
    rows = derived.rollouts(spark, sf_dir)
    swept = tokens.mask_by_spans(
        tokens.token_offsets(rows, "completion", KEYS),
        tokens.gram_spans(rows, "completion", KEYS),
        KEYS,
    )
    return swept.select(*KEYS, "token_idx", "start", "end", "planning")


def _credited(spark, sf_dir):
    """Rollouts with their advantage; their texts are cut into tokens behind the join."""
    advantages = credit.group_advantage(_scored(spark, sf_dir))
    texts = derived.rollouts(spark, sf_dir).select(*KEYS, "completion")
    return credit.with_advantage(texts, advantages)


@query
def token_advantage(spark, sf_dir):
    rows = tokens.token_offsets(_credited(spark, sf_dir), "completion", [*KEYS, "advantage"])
    return rows.select(*KEYS, "token_idx", r6(F.col("advantage")).alias("advantage"))


@query
def hicra_advantage(spark, sf_dir):
    value = credit.hicra_advantage(F.col("advantage"), F.col("planning"))
    rows = tokens.planning_mask(_credited(spark, sf_dir), "completion", [*KEYS, "advantage"])
    return rows.select(*KEYS, "token_idx", r6(value).alias("advantage"))


@query
def token_logprob(spark, sf_dir):
    logits = derived.table(spark, sf_dir, "embeddings")
    value = credit.token_logprob(F.col("embedding"), F.col("label"))
    return logits.select("vec_id", r6(value).alias("logp"))


@query
def token_logprob_rows(spark, sf_dir):
    """The same from logits as rows, one per vector and token."""
    logits = derived.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("token_id", "logit")
    )
    found = credit.token_logprob_rows(logits, ["vec_id"])
    return found.select("vec_id", r6(F.col("logp")).alias("logp"))


def _completion_tokens(spark, sf_dir):
    return tokens.token_offsets(derived.rollouts(spark, sf_dir), "completion", KEYS)


@query
def shift_labels(spark, sf_dir):
    shifted = credit.shift_labels(_completion_tokens(spark, sf_dir))
    return shifted.select(*KEYS, "shifted_idx", F.col("token").alias("label"))


@query
def completion_mask(spark, sf_dir):
    rows = derived.sequences(spark, sf_dir).withColumn(
        "prompt_len", tokens.token_count(F.col("prompt"))
    )
    shifted = credit.shift_labels(
        tokens.token_offsets(rows, "sequence", [*KEYS, "prompt_len"])
    )
    at, length = F.col("shifted_idx"), F.col("prompt_len")
    return shifted.select(
        *KEYS,
        "shifted_idx",
        credit.completion_mask(at, length).alias("mask"),
        credit.completion_mask(at, length, compat=False).alias("mask_exact"),
    )


@query
def align_min_len(spark, sf_dir):
    rows = derived.sequences(spark, sf_dir)
    aligned = credit.align_lists(
        rows,
        KEYS,
        planning=tokens.planning_flags("completion"),
        logp=F.transform(tokens.token_list(F.col("sequence")), derived.token_logp),
    )
    return aligned.select(*KEYS, "shifted_idx", "planning", r6(F.col("logp")).alias("logp"))


@query
def masked_pg_loss(spark, sf_dir):
    """The loss from token rows, which carry the advantage of their rollout."""
    rows = derived.sequences(spark, sf_dir)
    reward = correct_pm1({x: F.col(x) for x in ("prompt", "completion", "answer")})
    scored = materialize(rows.select(*KEYS, reward.alias("reward")), "pm1")
    advantages = credit.group_advantage(scored)
    rows = credit.with_advantage(rows, advantages)
    table = training.sequence_tokens(rows, derived.token_logp, carry=["advantage"])
    table = table.withColumn(
        "advantage", credit.hicra_advantage(F.col("advantage"), F.col("planning"))
    )
    loss = credit.masked_pg_loss(table, "prompt_id")
    return _loss_columns(loss)


@query
def budget_flags(spark, sf_dir):
    flagged = tokens.budget_flags(
        derived.rollouts(spark, sf_dir), max_prompt=64, max_completion=100
    )
    return flagged.select(
        *KEYS,
        "n_prompt",
        "n_completion",
        "within_prompt",
        "within_completion",
        "clipped_len",
        "prompt_tail",
    )


# a missing key is shown as -1
_SHOWN = ["coalesce(prompt_id, -1) AS prompt_id", "gen_idx"]


def _laid_out(spark, sf_dir):
    """Sequences in a layout with their advantages. Some prompts have no key, and gen_idx repeats in a
    group; ``origin`` tells the rows apart."""
    rows = derived.sequences(spark, sf_dir).withColumns(
        {
            "origin": F.col("prompt_id") * 4 + F.col("gen_idx"),
            "prompt_id": F.when(F.col("c") % 7 != 0, F.col("prompt_id")),
            "gen_idx": F.col("gen_idx") % 3,
            "reward": correct_pm1({x: F.col(x) for x in ("prompt", "completion", "answer")}),
        }
    )
    scored = materialize(rows.select(*KEYS, "reward"), "pm1")
    path = scratch_path(spark, "layout")
    name = "layout_" + path.rsplit("-", 1)[-1]
    texts = rows.select(*KEYS, "origin", "prompt", "completion", "sequence")
    layout.write_layout(texts, credit.group_advantage(scored), name, path)
    return layout.read_layout(spark, name)


@query
def token_advantage_layout(spark, sf_dir):
    keys = [*KEYS, "origin", "advantage"]
    rows = tokens.token_offsets(_laid_out(spark, sf_dir), "completion", keys)
    return rows.select(*map(F.expr, _SHOWN), "origin", "token_idx", r6(F.col("advantage")).alias("advantage"))


@query
def hicra_advantage_layout(spark, sf_dir):
    value = credit.hicra_advantage(F.col("advantage"), F.col("planning"))
    keys = [*KEYS, "origin", "advantage"]
    rows = tokens.planning_mask(_laid_out(spark, sf_dir), "completion", keys)
    return rows.select(*map(F.expr, _SHOWN), "origin", "token_idx", r6(value).alias("advantage"))


@query
def masked_pg_loss_layout(spark, sf_dir):
    table = training.sequence_tokens(
        _laid_out(spark, sf_dir), derived.token_logp, carry=["advantage"]
    )
    table = table.withColumn(
        "advantage", credit.hicra_advantage(F.col("advantage"), F.col("planning"))
    )
    loss = _loss_columns(credit.masked_pg_loss(table, "prompt_id"))
    return loss.withColumn("prompt_id", F.coalesce("prompt_id", F.lit(-1)))


def _budget(max_prompt: int, max_completion: int) -> Query:
    def run(spark, sf_dir):
        flagged = tokens.budget_flags(
            derived.rollouts(spark, sf_dir), max_prompt=max_prompt, max_completion=max_completion
        )
        return flagged.select(
            *KEYS, "n_prompt", "n_completion", "within_prompt", "within_completion", "clipped_len"
        )

    return run


# the limits of the trainers
for _limits in ((256, 200), (256, 768)):
    QUERIES[f"budget_flags_{_limits[0]}_{_limits[1]}"] = _budget(*_limits)


# --- audits --------------------------------------------------------------------------------------


@query
def audit_answer_in_prompt(spark, sf_dir):
    split = F.when(F.col("c") % 10 == 0, F.lit("test")).otherwise(F.lit("train"))
    rows = derived.answered(spark, sf_dir).withColumn("split", split)
    found = audits.answer_in_prompt(rows, "split")
    return found.withColumn("rate", r6(F.col("rate")))


@query
def audit_split_overlap(spark, sf_dir):
    items, documents = (derived.table(spark, sf_dir, x) for x in ("benchmark", "documents"))
    found, clean = audits.split_overlap(items, documents)
    return dataset.union_batches(
        found.select("item_id", F.lit(True).alias("overlaps")),
        clean.select("item_id", F.lit(False).alias("overlaps")),
    )


@query
def audit_split_overlap_documents(spark, sf_dir):
    """The other way round, where copies abound: documents of one source against all others."""
    documents = derived.table(spark, sf_dir, "documents")
    held = F.coalesce(F.col("source") == "src0", F.lit(False))
    found, clean = audits.split_overlap(documents.filter(held), documents.filter(~held))
    return dataset.union_batches(
        found.select("doc_id", F.lit(True).alias("overlaps")),
        clean.select("doc_id", F.lit(False).alias("overlaps")),
    )


@query
def audit_unique(spark, sf_dir):
    return audits.repeated_texts(derived.table(spark, sf_dir, "documents"), "doc_id")


@query
def audit_answer_shape(spark, sf_dir):
    rows = derived.rollouts(spark, sf_dir)
    return audits.answer_shapes(rows, xml_answer(F.col("completion"), guarded=False))


@query
def audit_reward_gap(spark, sf_dir):
    return audits.reward_gap(derived.rollouts(spark, sf_dir))


# --- reports -------------------------------------------------------------------------------------


def _steps(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    return derived.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"),
        (F.col("value") / 7).alias("loss"),
        (k / 8).alias("mean_reward"),
    )


@query
def accum_report(spark, sf_dir):
    lines = reports.accum_report(_steps(spark, sf_dir), REPORT_EVERY)
    return lines.select("step", "line")


@query
def accum_report_mean(spark, sf_dir):
    lines = reports.accum_report(_steps(spark, sf_dir), REPORT_EVERY, mode="mean")
    return lines.select("step", *[r6(F.col(x)).alias(x) for x in ("loss", "mean_reward")])


LOG_COLUMNS = ["loss", "reward", "reward_std", "completion_length"]


@query
def step_log(spark, sf_dir):
    logged = derived.events_as_rollouts(derived.table(spark, sf_dir, "events"))
    log = reports.step_log(logged)
    return log.select("step", *[r6(F.col(x)).alias(x) for x in [*LOG_COLUMNS, "kl"]])


def _samples(spark, sf_dir):
    scored = add_rewards(derived.rollouts(spark, sf_dir), ["correct_exact2"])
    return derived.eval_samples(scored)


@query
def eval_samples(spark, sf_dir):
    """The per-sample log behind the scores."""
    return _samples(spark, sf_dir)


@query
def eval_rollup(spark, sf_dir):
    rolled = reports.eval_rollup(_samples(spark, sf_dir))
    return rolled.select("task", "n", *[r6(F.col(x)).alias(x) for x in ("score", "stderr")])


@query
def eval_rollup_limit(spark, sf_dir):
    """The roll-up over the first samples of each task only."""
    numbered = _samples(spark, sf_dir).withColumn("sample", F.expr("prompt_id * 4 + gen_idx"))
    rolled = reports.eval_rollup(reports.limit_per_task(numbered, "sample", 50))
    return rolled.select("task", "n", *[r6(F.col(x)).alias(x) for x in ("score", "stderr")])


@query
def eval_table(spark, sf_dir):
    return reports.eval_table(_samples(spark, sf_dir))


@query
def sink_eval_json(spark, sf_dir):
    path = scratch_path(spark, "eval-json")
    report_source.write_eval_json(reports.eval_rollup(_samples(spark, sf_dir)), path)
    back = report_source.read_eval_json(spark, path)
    return back.select("task", "n", *[r6(F.col(x)).alias(x) for x in ("score", "stderr")])


# --- streaming -----------------------------------------------------------------------------------


@query
def stream_ingest(spark, sf_dir):
    landing, out, mark = (
        scratch_path(spark, name) for name in ("landing", "ingested", "ingest-mark")
    )
    derived.responses(spark, sf_dir).write.json(landing)
    ingest.stream_ingest(spark, landing, out, mark)
    return spark.read.parquet(out).drop("is_object")


def _split(spark, sf_dir):
    landing, out, mark = (scratch_path(spark, name) for name in ("landing", "split", "split-mark"))
    derived.responses(spark, sf_dir).write.json(landing)
    ingest.stream_split(spark, landing, out, mark, files_per_batch=1)
    return ingest.read_split(spark, out)


@query
def stream_quarantine(spark, sf_dir):
    """Rejected responses of a stream, kept with their status."""
    _, rejected = _split(spark, sf_dir)
    return rejected.select("batch_no", F.col("status").cast("bigint").alias("status"))


@query
def stream_split(spark, sf_dir):
    """Items and rejected responses of one scan of the landed files."""
    items, rejected = _split(spark, sf_dir)
    return items.select("batch_no", "pos", "prompt", "answer").unionByName(
        rejected.select(
            "batch_no",
            F.lit(-1).cast("bigint").alias("pos"),
            F.lit(None).cast("string").alias("prompt"),
            F.col("status").cast("string").alias("answer"),
        )
    )


def _log(spark, sf_dir, parts: int, events: DataFrame, prepare, **more):
    """A stream over the events, dealt out so that every step is spread over ``parts`` batches."""
    landing, out, mark = (
        scratch_path(spark, name) for name in ("events", "moments", "moments-mark")
    )
    part = F.pmod(F.coalesce("event_id", F.lit(0)), F.lit(parts)).cast("int")
    events.withColumn("part", part).write.partitionBy("part").parquet(landing)
    landed = spark.read.parquet(landing)
    files = len(landed.inputFiles())
    log = stream_step_log(
        spark, landing, landed.schema, out, mark, prepare,
        files_per_batch=max(1, -(-files // parts)), **more,
    )
    return log.select("step", *[r6(F.col(x)).alias(x) for x in [*LOG_COLUMNS, "kl"]])


@register("stream_step_log")
def stream_step(spark, sf_dir):
    """The events arrive in three micro-batches, over which every step is spread."""
    events = derived.table(spark, sf_dir, "events")
    return _log(spark, sf_dir, 3, events, derived.events_as_rollouts)


@query
def stream_step_log_compacted(spark, sf_dir):
    """Seven micro-batches, folded in pairs and pairs of pairs; some events have no step."""

    def prepare(events):
        known = F.when(F.col("event_id") % 13 != 0, F.col("step"))
        return derived.events_as_rollouts(events, "event_id").withColumn("step", known)

    events = derived.table(spark, sf_dir, "events")
    log = _log(spark, sf_dir, 7, events, prepare, fan_in=2)
    return log.withColumn("step", F.coalesce("step", F.lit(-1)))  # the step NULL
