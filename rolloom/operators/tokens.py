"""Token offsets, phrase spans, the planning mask and token budgets.

Everything here is row-local: a text is cut into bounded pieces inside its own row, so no token
ever crosses a shuffle. Tokens are runs of non-blanks with the blanks before them; trailing blanks
make no token. A table of ready tokens with offsets goes through :func:`mask_by_spans` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.constants import LEXICON_V1, MAX_COMPLETION_TOKENS, MAX_PROMPT_TOKENS
from rolloom.functions.arrays import let, quote, running_totals
from rolloom.functions.text import regex_quote
from rolloom.operators.skew import ROWS_PER_TASK
from rolloom.session import materialize

# --- fixed values: token pattern ---------------------------------------------------------------
BLANK = "[ \\t\\n\\x0B\\f\\r]"
NON_BLANK = "[^ \\t\\n\\x0B\\f\\r]"
TOKEN = f"{BLANK}*{NON_BLANK}+"

CONTROLS, BLANKS = "\x01\x02\x03\x04\x05\x06\x07\x08", "\x0b\f\r\t\n "  # to choose marks from
CHUNK_CHARS = 4096
RANGE_CHARS = 1 << 16  # a text's positions are swept in ranges of this size
# letters outside ASCII that match an ASCII letter when case is ignored, and that lower() does
# not turn into it
_FOLDED = "[\\x{130}\\x{131}\\x{17f}]"


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens, without building them."""
    return F.regexp_count(text, F.lit(f"{NON_BLANK}+")).cast("bigint")


def _may_overlap(one: str, other: str) -> bool:
    """Whether hits of two phrases can share a character."""
    a, b = one.casefold(), other.casefold()
    ends = any(a.endswith(b[:n]) or b.endswith(a[:n]) for n in range(1, min(len(a), len(b))))
    return ends or a in b or b in a


def _apart(phrases: Sequence[str]) -> list[list[str]]:
    """The phrases in a few groups, in which no two can overlap."""
    groups: list[list[str]] = []
    for phrase in phrases:
        for group in groups:
            if not any(_may_overlap(phrase, other) for other in group):
                group.append(phrase)
                break
        else:
            groups.append([phrase])
    return groups


def _marks(phrases: Sequence[str], candidates: str) -> list[str]:
    free = [c for c in candidates if not any(c in phrase for phrase in phrases)]
    if len(free) < 2:
        raise ValueError("the phrases use too many control characters or kinds of blanks")
    return free[:2]


def _has_mark(phrases: Sequence[str]) -> str:
    marks = _marks(phrases, CONTROLS)[0] + _marks(phrases, BLANKS)[0]
    return f"t RLIKE {quote('[' + ''.join(f'{chr(92)}x{ord(c):02x}' for c in marks) + ']')}"


def _marked(text: str, phrases: Sequence[str]) -> list[str]:
    """For each group of phrases a copy of the text in which their hits are written over with marks.

    The copies have the text's length and its blanks, so they fall into the same chunks and tokens. A
    phrase's hits are found over the whole text from its left end, also if it can overlap itself;
    letters outside ASCII are handled as in :func:`_spans`. A mark for blanks and one for all else are
    characters that no phrase holds; where a text has them, a second such character takes their place.
    """
    mark, other = _marks(phrases, CONTROLS)
    blank, other_blank = _marks(phrases, BLANKS)
    odd = f"{text} RLIKE {quote(_FOLDED)}" if all(g.isascii() for g in phrases) else "true"
    clean = f"translate({text}, {quote(mark + blank)}, {quote(other + other_blank)})"
    copies = []
    for group in _apart(phrases):
        low, raw = f"lower({clean})", clean
        for phrase in group:
            marks = quote("".join(blank if c in " \t\n\x0b\f\r" else mark for c in phrase))
            low = f"replace({low}, {quote(phrase.lower())}, {marks})"
            raw = f"regexp_replace({raw}, {quote('(?iu)' + regex_quote(phrase))}, {marks})"
        copies.append(f"IF({odd}, {raw}, {low})")
    return copies


def _chunks(text: str, chunk_chars: int) -> str:
    """Cut a text behind a non-blank, every ``chunk_chars`` characters or a little later."""
    pattern = f"(?s).{{1,{chunk_chars}}}{BLANK}*{NON_BLANK}*"
    return f"regexp_extract_all({text}, {quote(pattern)}, 0)"


def _spans(text: str, phrases: Sequence[str]) -> str:
    """``ARRAY<STRUCT<gram, start, end>>``: all non-overlapping hits of each phrase.

    ASCII phrases are searched as they are in the lowered text. Where the text has a letter outside
    ASCII that matches an ASCII one, or a phrase is not ASCII, the search ignores case instead:
    lowering would lose such a hit, or shift the positions.
    """
    entries = [
        f"named_struct('gram', {quote(g)}, 'low', {quote(g.lower())}, 'chars', {len(g)}, "
        f"'plain', {quote(regex_quote(g.lower()))}, 'any_case', {quote('(?iu)' + regex_quote(g))})"
        for g in phrases
    ]
    odd = f"{text} RLIKE {quote(_FOLDED)}" if all(g.isascii() for g in phrases) else "true"
    hits = f"filter(array({', '.join(entries)}), g -> seen.odd OR contains(seen.low, g.low))"
    parts = "split(IF(seen.odd, seen.raw, seen.low), IF(seen.odd, g.any_case, g.plain), -1)"
    starts = let(
        "before",
        running_totals(f"transform({parts}, part -> length(part))"),
        "transform(slice(before, 2, size(before)), (total, k) -> total + k * g.chars)",
    )
    span = "named_struct('gram', g.gram, 'start', p, 'end', p + g.chars)"
    found = f"flatten(transform({hits}, g -> transform({starts}, p -> {span})))"
    seen = f"named_struct('raw', {text}, 'low', lower({text}), 'odd', {odd})"
    return let("seen", seen, found)  # no column is named inside: a lambda variable would hide it


def gram_spans(
    df: DataFrame, text: str, keys: Sequence[str], phrases: Sequence[str] = LEXICON_V1
) -> DataFrame:
    """All hits of every phrase: ``(keys, gram, start, end)``; spans of two phrases may overlap."""
    found = df.select(*keys, F.expr(f"explode_outer({_spans(text, phrases)})").alias("_s"))
    found = found.filter(F.col("_s").isNotNull())  # outer: see explode_items
    return found.select(*keys, "_s.gram", "_s.start", "_s.end")


def tokens(
    df: DataFrame,
    text: str,
    keys: Sequence[str],
    phrases: Sequence[str] | None = None,
    chunk_chars: int = CHUNK_CHARS,
    keep_empty: bool = False,
) -> DataFrame:
    """Token table ``(keys, token_idx, token, start, end)``, with ``planning`` if phrases are given.

    A text, and the copies of it in which phrases are marked, are cut into chunks of about
    ``chunk_chars`` characters; a token is a planning token if it has a mark in some copy. The work
    is linear in the length of the text, whatever it holds. ``keep_empty`` leaves rows with a NULL
    token where there is none, so that no text is lost in a following aggregation.
    """
    copies = [] if phrases is None else _marked(text, phrases)

    # one row per text: chunks, their tokens, and where each chunk begins
    marked = [f"_m{i}" for i in range(len(copies))]
    texts = df.select(
        *keys,
        F.expr(_chunks(text, chunk_chars)).alias("_c"),
        *[F.expr(_chunks(sql, chunk_chars)).alias(name) for sql, name in zip(copies, marked)],
    )
    texts = texts.select(
        *keys,
        "_c",
        *marked,
        F.expr(f"transform(_c, c -> regexp_extract_all(c, {quote(TOKEN)}, 0))").alias("_t"),
    )
    columns = {
        "_t": "_t",
        "_base": running_totals("transform(_c, c -> length(c))"),
        "_first": running_totals("transform(_t, t -> size(t))"),
    } | {name: name for name in marked}
    texts = texts.select(*keys, *[F.expr(sql).alias(name) for name, sql in columns.items()])

    # one row per chunk. The outer explodes keep Spark from testing the arrays for emptiness first,
    # which would compute them twice.
    chunks = texts.select(
        *keys, F.expr(f"explode_outer(arrays_zip({', '.join(columns)}))").alias("_p")
    ).select(*keys, "_p.*")
    token = (
        "named_struct('token', t, 'start', _base + s, 'end', _base + s + length(t))"
    )
    offsets = running_totals("transform(_t, t -> length(t))")
    located = f"zip_with(_t, {offsets}, (t, s) -> {token})"
    out = ["_first + _i AS token_idx", "_k.token", "_k.start", "_k.`end`"]
    if marked:
        has = _has_mark(phrases)
        flags = [f"transform(regexp_extract_all({m}, {quote(TOKEN)}, 0), t -> {has})" for m in marked]
        flag = flags[0]
        for more in flags[1:]:
            flag = f"zip_with({flag}, {more}, (a, b) -> a OR b)"
        located = f"zip_with({located}, {flag}, (k, f) -> named_struct('k', k, 'f', f))"
        out = ["_first + _i AS token_idx", "_k.k.token", "_k.k.start", "_k.k.`end`", "_k.f AS planning"]

    # one row per token
    rows = chunks.select(
        *keys, "_first", F.expr(f"posexplode_outer({located})").alias("_i", "_k")
    )
    if not keep_empty:
        rows = rows.filter(F.col("_i").isNotNull())
    return rows.select(*keys, *[F.expr(sql) for sql in out])


def planning_flags(text: str, phrases: Sequence[str] = LEXICON_V1) -> Column:
    """For every token of a text, in one list, whether it overlaps a hit of some phrase."""
    flags = [
        f"transform(regexp_extract_all({copy}, {quote(TOKEN)}, 0), t -> {_has_mark(phrases)})"
        for copy in _marked(text, phrases)
    ]
    flag = flags[0]
    for more in flags[1:]:
        flag = f"zip_with({flag}, {more}, (a, b) -> a OR b)"
    return F.expr(flag)


def token_offsets(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, token_idx, token, start, end)`` of every text."""
    return tokens(df, text, keys)


def planning_mask(
    df: DataFrame,
    text: str,
    keys: Sequence[str],
    phrases: Sequence[str] = LEXICON_V1,
    seq_len: int | None = None,
) -> DataFrame:
    """Token table with ``planning``: the token overlaps a hit of some phrase.

    ``seq_len`` keeps the first tokens of a text only, as a truncated sequence would.
    """
    mask = tokens(df, text, keys, phrases)
    return mask if seq_len is None else mask.filter(F.col("token_idx") < seq_len)


def mask_by_spans(
    token_table: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    range_chars: int = RANGE_CHARS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``planning`` for a given token table and a given span table.

    An interval-overlap join without pairs: tokens and spans of a text are laid on one axis, and a
    running maximum of span ends tells each token whether a span that starts before its end reaches
    past its start. The axis of a text is cut into ranges of ``range_chars``, so that one long text
    is swept by many tasks; what spans reach from the ranges before is the maximum of their ends, one
    row per range. That needs the ranges in use: token positions are read twice.

    The ranges are written down with their rows, and dealt to as many tasks as give each about
    ``rows_per_task`` rows to sort. Left to itself, Spark would sweep the tokens where their texts lie
    if those are dealt out by a key already: in few tasks, as it sizes them by the bytes of the texts.
    """
    spark = token_table.sparkSession

    def place(position: str) -> Column:
        return F.expr(f"{position} div {range_chars}").alias("_range")

    nothing = F.lit(None).cast("bigint")
    used = token_table.select(*keys, place("greatest(`end` - 1, 0)"), nothing.alias("_until"))
    reached = spans.select(*keys, place("start"), F.col("end").cast("bigint").alias("_until"))
    ranges = used.unionByName(reached).groupBy(*keys, "_range").agg(
        F.max("_until").alias("_until"), F.count(F.lit(1)).alias("_n")
    )
    ranges = materialize(ranges, "sweep-ranges")
    n_ranges, n_rows = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()

    def tasks(rows: int) -> int:
        return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))

    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranges = ranges.repartition(tasks(n_ranges), *keys)
    carried = ranges.select(*keys, "_range", F.max("_until").over(earlier).alias("_until")).filter(
        F.col("_until").isNotNull()
    )
    no_token = F.lit(None).cast("struct<token_idx:bigint,start:bigint,end:bigint>").alias("_tok")
    axis = (
        token_table.select(
            *keys,
            place("greatest(`end` - 1, 0)"),
            F.struct("token_idx", "start", "end").alias("_tok"),
            F.col("end").alias("_at"),
            F.lit(0).alias("_kind"),  # at the same place tokens come first: start < end is strict
            nothing.alias("_until"),
        )
        .unionByName(
            spans.select(
                *keys,
                place("start"),
                no_token,
                F.col("start").alias("_at"),
                F.lit(1).alias("_kind"),
                F.col("end").alias("_until"),
            )
        )
        .unionByName(
            carried.select(
                *keys, "_range", no_token, F.lit(-1).alias("_at"), F.lit(-1).alias("_kind"), "_until"
            )
        )
    )
    window = (
        Window.partitionBy(*keys, "_range")
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    axis = axis.repartition(tasks(n_rows + n_ranges), *keys, "_range")
    swept = axis.withColumn("_reach", F.max("_until").over(window)).filter(
        F.col("_tok").isNotNull()
    )
    planning = F.coalesce(F.col("_reach") > F.col("_tok.start"), F.lit(False))
    return swept.select(*keys, "_tok.*", planning.alias("planning"))


def budget_flags(
    df: DataFrame,
    prompt: str = "prompt",
    completion: str = "completion",
    max_prompt: int = MAX_PROMPT_TOKENS,
    max_completion: int = MAX_COMPLETION_TOKENS,
) -> DataFrame:
    """Token counts against the limits; a prompt over its limit keeps its tail."""
    prompt_tokens = token_list(F.col(prompt))
    n_prompt = F.size(prompt_tokens)
    tail = F.slice(
        prompt_tokens, F.greatest(n_prompt - (max_prompt - 1), F.lit(1)), F.lit(max_prompt)
    )
    return df.withColumns(
        {
            "n_prompt": n_prompt.cast("bigint"),
            "n_completion": token_count(F.col(completion)),
            "prompt_tail": F.array_join(tail, ""),
        }
    ).withColumns(
        {
            "within_prompt": F.col("n_prompt") <= max_prompt,
            "within_completion": F.col("n_completion") <= max_completion,
            "clipped_len": F.least("n_completion", F.lit(max_completion).cast("bigint")),
        }
    )
