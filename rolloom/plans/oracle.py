"""The registered queries as plain SQL over the given tables."""

from __future__ import annotations

from rolloom.constants import (
    CONCEPTS,
    DIFFICULTIES,
    DOMAINS,
    DYNAMIC_GENERATOR_PROMPT,
    EVAL_TASKS,
    FORMAT_SYSTEM_PROMPT,
    LEXICON_V1,
    LEXICON_V2,
    MATH_SYSTEM_PROMPT,
    PLAIN_GENERATOR_PROMPT,
    TARGET_SAMPLES,
    WHITESPACE,
)
from rolloom.functions import chat
from rolloom.operators.audits import ANSWER_SHAPES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _strip(sql: str) -> str:
    return f"trim({sql}, {_q(WHITESPACE)})"


def _r6(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"


LF = "chr(10)"
SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"
TOKEN = "[ \\t\\n\\x0B\\f\\r]*[^ \\t\\n\\x0B\\f\\r]+"

# --- derived tables -----------------------------------------------------------------------------

ANSWERED = """
answered AS (
  SELECT a.conv_id * 4294967296 + a.turn AS prompt_id, a.conv_id AS c, a.turn AS t,
         a.text AS said, CAST((a.conv_id * 37 + a.turn * 11) % 97 AS VARCHAR) AS answer,
         CASE WHEN a.conv_id % 5 = 0
              THEN u.text || ' (' || CAST((a.conv_id * 37 + a.turn * 11) % 97 AS VARCHAR) || ')'
              ELSE u.text END AS prompt
  FROM conversations a
  JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
  WHERE a.role = 'assistant'
)"""


def _cot(body: str, answer: str) -> str:
    return (
        f"'<reasoning>' || {LF} || {body} || {LF} || '</reasoning>' || {LF} || '<answer>' || {LF}"
        f" || {answer} || {LF} || '</answer>' || {LF}"
    )


ROLLOUTS = f"""{ANSWERED},
planted AS (
  SELECT *, array_to_string(list_slice({_list(LEXICON_V2)}, 1 + (c + t) % 8,
              (c + t) % 8 + (c * 3 + t * 5 + gen_idx * 2) % 13), ', ') AS plain_g,
         CASE WHEN (c + t + gen_idx) % 3 = 0 THEN answer
              ELSE CAST((c * 37 + t * 11 + gen_idx * 13 + 1) % 97 AS VARCHAR) END AS ga
  FROM answered, (SELECT unnest([0, 1, 2, 3])::BIGINT AS gen_idx)
),
cased AS (
  SELECT *, CASE WHEN gen_idx = 3 THEN upper(plain_g) ELSE plain_g END AS g FROM planted
),
lined AS (
  SELECT *, said || ' ' || g AS ml,
         replace(replace(said || ' ' || g, chr(13), ' '), {LF}, ' ') AS ol FROM cased
),
rollouts AS (
  SELECT prompt_id, gen_idx, prompt, answer, c, t,
    CASE (c * 5 + t * 3 + gen_idx * 7) % 10
      WHEN 0 THEN {_cot('ol', 'ga')}
      WHEN 1 THEN {_cot(f"ml || {LF} || g", 'ga')}
      WHEN 2 THEN '<reasoning>' || ol || '</reasoning><answer>' || ga || '</answer>'
      WHEN 3 THEN 'Sure. <reasoning>' || ml || '</reasoning>' || {LF} || '<answer> ' || ga
                  || ' units</answer> ok'
      WHEN 4 THEN ml || ' The final answer is ' || ga
      WHEN 5 THEN '<answer>0</answer>' || ml || '<answer>' || ga || '</answer>zz'
      WHEN 6 THEN ml || {LF} || '#### ' || ga || ' #### 1'
      WHEN 7 THEN ml || ' ' || ga || '</answer> tail'
      WHEN 8 THEN {_cot("'maybe ' || answer || ' ' || ol", "CAST(100 + (c + t) % 9 AS VARCHAR)")}
                  || repeat('x', CAST(gen_idx AS INTEGER))
      ELSE '<reasoning></reasoning><answer></answer>' || g
    END AS completion
  FROM lined
)"""

# --- scalar rules -------------------------------------------------------------------------------

PLAIN = _strip("string_split(string_split(completion, '<answer>')[-1], '</answer>')[1]")
GUARDED = f"CASE WHEN contains(completion, '<answer>') THEN {PLAIN} ELSE {_strip('completion')} END"


def _count(tag: str) -> str:
    return f"(len(string_split(completion, {tag})) - 1)"


_OPEN_R = f"('<reasoning>' || {LF})"
_CLOSE_R = f"({LF} || '</reasoning>' || {LF})"
_OPEN_A = f"({LF} || '<answer>' || {LF})"
_CLOSE_A = f"({LF} || '</answer>' || {LF})"
_CLOSE_A1 = f"({LF} || '</answer>')"
COUNT_XML = f"""(
  CASE WHEN {_count(_OPEN_R)} = 1 THEN 0.125::DOUBLE ELSE 0 END
  + CASE WHEN {_count(_CLOSE_R)} = 1 THEN 0.125::DOUBLE ELSE 0 END
  + CASE WHEN {_count(_OPEN_A)} = 1
         THEN 0.125::DOUBLE - length(string_split(completion, {_CLOSE_A})[-1]) * 0.001::DOUBLE
         ELSE 0 END
  + CASE WHEN {_count(_CLOSE_A1)} = 1
         THEN 0.125::DOUBLE
              - (length(string_split(completion, {_CLOSE_A1})[-1]) - 1) * 0.001::DOUBLE
         ELSE 0 END)"""


def _pay(condition: str, amount: float, otherwise: float = 0.0) -> str:
    return f"CASE WHEN {condition} THEN {amount}::DOUBLE ELSE {otherwise}::DOUBLE END"


def _phrases(lexicon, each: float) -> str:
    found = f"len(list_filter({_list(lexicon)}, lambda g: contains(lower(completion), g)))"
    return f"{found} * {each}::DOUBLE"


_LAYOUT = f"<reasoning>.*?</reasoning>{SPACE}*<answer>.*?</answer>"
_STRICT = "\\A<reasoning>\\n.*?\\n</reasoning>\\n<answer>\\n.*?\\n</answer>\\n\\n?\\z"
_SUPERSCRIPTS = (  # the digits of str.isdigit() that are not decimal digits, common ranges
    "\\x{b2}\\x{b3}\\x{b9}\\x{2070}\\x{2074}-\\x{2079}\\x{2080}-\\x{2089}\\x{2460}-\\x{2468}"
)

REWARDS = {
    "correct_contains2": _pay(f"contains({GUARDED}, {_strip('answer')})", 2.0),
    "correct_exact2": _pay(f"{PLAIN} = answer", 2.0),
    "correct_contains1": _pay(f"contains({_strip('completion')}, {_strip('answer')})", 1.0),
    "correct_pm1": _pay("contains(prompt || completion, answer)", 1.0, -1.0),
    "planning16": f"least({_phrases(LEXICON_V1, 0.1)}, 0.5::DOUBLE)",
    "reasoning20": f"""least({_phrases(LEXICON_V2, 0.05)}
      + {_pay("contains(completion, '<reasoning>') AND contains(completion, '</reasoning>')", 0.2)}
      + {_pay("contains(completion, '<answer>') AND contains(completion, '</answer>')", 0.1)},
      0.5::DOUBLE)""",
    "format_search": _pay(f"regexp_matches(completion, {_q('(?s)' + _LAYOUT)})", 0.5),
    "format_strict": _pay(f"regexp_matches(completion, {_q(_STRICT)})", 0.5),
    "format_soft": _pay(f"regexp_matches(completion, {_q(chr(92) + 'A' + _LAYOUT)})", 0.5),
    "int": _pay(
        f"regexp_matches({PLAIN}, {_q(f'{chr(92)}A[{chr(92)}p{{Nd}}{_SUPERSCRIPTS}]+{chr(92)}z')})",
        0.5,
    ),
    "xmlcount": COUNT_XML,
}
SETS = {
    "a": ["correct_contains1", "planning16"],
    "b": ["correct_contains2", "reasoning20", "format_search"],
    "c": ["xmlcount", "format_soft", "format_strict", "int", "correct_exact2"],
}
TOTALS = {k: " + ".join(f"({REWARDS[n]})" for n in names) for k, names in SETS.items()}

SCORED = f"""{ROLLOUTS},
scored AS (SELECT prompt_id, gen_idx, {TOTALS['b']} AS reward FROM rollouts),
stats AS (
  SELECT prompt_id, avg(reward) AS mean_reward, stddev_samp(reward) AS std_reward,
         count(*) AS n_rollouts FROM scored GROUP BY prompt_id
),
advantages AS (
  SELECT s.prompt_id, s.gen_idx, s.reward,
         (s.reward - mean_reward) / (std_reward + 1e-8) AS advantage
  FROM scored s JOIN stats USING (prompt_id)
)"""

# --- responses ----------------------------------------------------------------------------------


def _item(number: int, answer: str) -> str:
    text = f"'Q' || pid || '-{number} ' || text"
    prompt = f"CAST(to_json({text}) AS VARCHAR)"
    return f"""'{{"prompt":' || {prompt} || ',"answer":' || {answer} || '}}'"""


RESPONSES = f"""
shaped AS (
  SELECT conv_id * 4294967296 + turn AS batch_no, conv_id AS c, turn AS t, text,
         CAST(conv_id * 100 + turn AS VARCHAR) AS pid, (conv_id * 3 + turn) % 6 AS sh
  FROM conversations WHERE role = 'assistant'
),
bodies AS (
  SELECT *, {_item(1, '''CASE WHEN sh = 5 THEN pid || '.50'
                     ELSE '"' || (c * 100 + t) % 97 || '"' END''')}
    || CASE WHEN t % 4 = 1 OR sh = 3 THEN ',' || {_item(2, _q('"x"'))}
            ELSE '' END AS body
  FROM shaped
),
texts AS (
  SELECT *, CASE WHEN sh IN (0, 5) THEN '[' || body || ']'
      WHEN sh = 1 THEN '```json' || {LF} || '[' || body || ']' || {LF} || '```'
      WHEN sh = 2 THEN {LF} || '```[' || body || ']``` '
      WHEN sh = 3 THEN '[' || body
      ELSE '[]' END AS txt,
    CASE c % 4 WHEN 0 THEN 'Anthropic' WHEN 1 THEN 'huggingface' WHEN 2 THEN 'gemini' END
      AS sent_by,
    CASE WHEN (c + t) % 11 = 0 THEN 500 ELSE 200 END::BIGINT AS status
  FROM bodies
),
raws AS (
  SELECT batch_no, coalesce(lower(sent_by), 'gemini') AS provider, status,
    CASE c % 4
      WHEN 0 THEN to_json({{'content': [{{'type': 'text', 'text': txt}}]}})
      WHEN 1 THEN to_json({{'choices': [{{'message': {{'content': txt}}}}]}})
      ELSE to_json({{'text': txt}}) END AS raw
  FROM texts
),
unwrapped AS (
  SELECT batch_no, provider, status,
    CASE provider WHEN 'anthropic' THEN raw ->> '$.content[0].text'
                  WHEN 'huggingface' THEN raw ->> '$.choices[0].message.content'
                  ELSE raw ->> '$.text' END AS text
  FROM raws
),
stripped AS (
  SELECT *, {_strip("replace(replace(text, '```json', ''), '```', '')")} AS body FROM unwrapped
),
parsed AS (
  SELECT *, CASE WHEN json_valid(body) AND json_type(body) = 'ARRAY'
                 THEN CAST(body AS JSON[]) END AS items FROM stripped
),
numbered AS (
  SELECT batch_no, provider, unnest(range(len(items))) AS pos, unnest(items) AS item
  FROM parsed WHERE status < 400
),
items AS (
  SELECT batch_no, provider, CAST(pos AS BIGINT) AS pos, item ->> '$.prompt' AS prompt,
    CASE WHEN json_type(item, '$.answer') = 'DOUBLE'
         THEN CAST(CAST(item ->> '$.answer' AS DOUBLE) AS VARCHAR)
         ELSE item ->> '$.answer' END AS answer
  FROM numbered
)"""

# --- requests -----------------------------------------------------------------------------------


def _pick(values, dim: int, seed: int) -> str:
    hexed = f"substr(md5(doc_id || ':{seed}'), {1 + 8 * dim}, 8)"
    return f"{_list(values)}[1 + CAST('0x' || {hexed} AS BIGINT) % {len(values)}]"


def _draws(seed: int) -> str:
    return f"""draws AS (
  SELECT doc_id, {_pick(DOMAINS, 0, seed)} AS domain, {_pick(CONCEPTS, 1, seed)} AS concept,
         {_pick(DIFFICULTIES, 2, seed)} AS difficulty FROM documents
)"""


_P = DYNAMIC_GENERATOR_PROMPT.split("%s")
RENDERED = " || ".join(
    [_q(_P[0]), "difficulty", _q(_P[1]), "domain", _q(_P[2]), "concept", _q(_P[3])]
)

# --- tokens -------------------------------------------------------------------------------------


def _tokens(source: str, text: str, keys: str, name: str = "tokens") -> str:
    """Tokens with offsets: the pattern's matches lie end to end."""
    return f"""
{name}_raw AS (
  SELECT {keys}, unnest(regexp_extract_all({text}, {_q(TOKEN)})) AS token,
         unnest(range(len(regexp_extract_all({text}, {_q(TOKEN)})))) AS token_idx FROM {source}
),
{name}_end AS (
  SELECT *, sum(length(token)) OVER (PARTITION BY {keys} ORDER BY token_idx
            ROWS UNBOUNDED PRECEDING) AS e FROM {name}_raw
),
{name} AS (
  SELECT {keys}, CAST(token_idx AS BIGINT) AS token_idx, token,
         CAST(e - length(token) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM {name}_end
)"""


def _spans(source: str, text: str, keys: str) -> str:
    return f"""
gram_texts AS (
  SELECT {keys}, gram, string_split(lower({text}), gram) AS parts
  FROM {source}, (SELECT unnest({_list(LEXICON_V1)}) AS gram)
  WHERE contains(lower({text}), gram)
),
gram_parts AS (
  SELECT {keys}, gram, unnest(parts) AS part, unnest(range(len(parts))) AS k, len(parts) AS m
  FROM gram_texts
),
spans AS (
  SELECT {keys}, gram, CAST(s AS BIGINT) AS "start", CAST(s + length(gram) AS BIGINT) AS "end"
  FROM (SELECT *, sum(length(part)) OVER (PARTITION BY {keys}, gram ORDER BY k
               ROWS UNBOUNDED PRECEDING) + k * length(gram) AS s FROM gram_parts)
  WHERE k < m - 1
)"""


_KEYS = "prompt_id, gen_idx"


def _mask(source: str, text: str) -> str:
    return f"""{_tokens(source, text, _KEYS)},
{_spans(source, text, _KEYS)},
mask AS (
  SELECT t.*, EXISTS (SELECT 1 FROM spans s WHERE s.prompt_id = t.prompt_id
      AND s.gen_idx = t.gen_idx AND t."end" > s."start" AND t."start" < s."end") AS planning
  FROM tokens t
)"""


MASK = f"{ROLLOUTS},{_mask('rollouts', 'completion')}"
MASK_SELECT = 'SELECT prompt_id, gen_idx, token_idx, "start", "end", planning FROM mask'
SEQUENCES = f"""{ROLLOUTS},
sequences AS (
  SELECT *, prompt || {LF} || completion AS sequence,
         len(regexp_extract_all(prompt, {_q(TOKEN)})) AS prompt_len FROM rollouts
)"""
LOGP = "-(((length(token) * 7 + token_idx * 3) % 23) + 1) / 10.0::DOUBLE"
LOSS = f"""WITH {SEQUENCES},{_mask('sequences', 'sequence')},
pm1 AS (SELECT prompt_id, gen_idx, prompt_len, {REWARDS['correct_pm1']} AS reward FROM sequences),
pm1_stats AS (SELECT prompt_id, avg(reward) AS m, stddev_samp(reward) AS s FROM pm1 GROUP BY 1),
adv AS (
  SELECT p.*, (reward - m) / (s + 1e-8) AS a FROM pm1 p JOIN pm1_stats USING (prompt_id)
),
terms AS (
  SELECT prompt_id, a + 0.2::DOUBLE * abs(a) * CAST(planning AS INTEGER) AS a, {LOGP} AS logp,
         CASE WHEN token_idx - 1 >= prompt_len THEN 1 ELSE 0 END AS m
  FROM mask JOIN adv USING (prompt_id, gen_idx) WHERE token_idx >= 1
)
SELECT prompt_id, {_r6('-sum(a * logp * m) / nullif(sum(m), 0)')} AS loss,
       CAST(sum(m) AS BIGINT) AS n_tokens FROM terms GROUP BY prompt_id"""

# --- chat ---------------------------------------------------------------------------------------


def _message(role: str, content: str, user_header: str = chat.USER_HEADER) -> str:
    heads = {
        "system": chat.BEGIN_OF_TEXT + chat.SYSTEM_HEADER,
        "user": user_header,
        "assistant": chat.ASSISTANT_HEADER,
    }
    cases = " ".join(
        f"WHEN {_q(r)} THEN {_q(h)} || {content} || {_q(chat.END_OF_TURN)}"
        for r, h in heads.items()
    )
    return f"CASE {role} {cases} ELSE '' END"


_SYSTEM = _q(MATH_SYSTEM_PROMPT.strip())


def _chat(user_header: str) -> str:
    return f"{_message(_q('system'), _SYSTEM)} || {_message(_q('user'), 'prompt', user_header)}"


# --- evaluation ---------------------------------------------------------------------------------

SAMPLES = f"""{ROLLOUTS},
samples AS (
  SELECT {_list(EVAL_TASKS)}[1 + c % 3] AS task, prompt_id, gen_idx,
         CASE WHEN {PLAIN} = answer THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM rollouts
)"""
EVAL = f"""WITH {SAMPLES}
SELECT task, count(*) AS n, {_r6('avg(score)')} AS score,
       {_r6('stddev_samp(score) / sqrt(count(*))')} AS stderr FROM samples GROUP BY task"""
LOGGED = """logged AS (
  SELECT event_id // 8 AS step, CAST(props ->> '$.k' AS DOUBLE) AS k, value, length(event_type) AS l
  FROM events
)"""
_STEP_COLUMNS = f"""{_r6('avg(k / 100)')} AS loss, {_r6('avg(value)')} AS reward,
       {_r6('stddev_samp(value)')} AS reward_std, {_r6('avg(l)')} AS completion_length"""
_ITEMS = f"WITH {RESPONSES} SELECT batch_no, pos, prompt, answer FROM items"


def _by_rollout(expression: str, name: str) -> str:
    return f"WITH {ROLLOUTS} SELECT prompt_id, gen_idx, {expression} AS {name} FROM rollouts"


ORACLE: dict[str, str] = {
    "flagship": f"""WITH {SCORED}
SELECT prompt_id, any_value(n_rollouts) AS n_rollouts,
       {_r6('any_value(mean_reward)')} AS mean_reward, {_r6('any_value(std_reward)')} AS std_reward,
       arg_max(gen_idx, reward * 1000 - gen_idx) AS best_gen_idx,
       {_r6('max(a.reward)')} AS best_reward, {_r6('max(advantage)')} AS best_advantage
FROM advantages a JOIN stats USING (prompt_id) GROUP BY prompt_id""",
    "planning_credit": LOSS,
    "src_qa_json": f"WITH {ANSWERED} SELECT prompt, answer, 'train' AS split FROM answered",
    "src_split_config": f"""WITH {ANSWERED} SELECT prompt_id, answer, 'main' AS config,
  CASE WHEN c % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM answered""",
    "src_response_unwrap": f"WITH {RESPONSES} SELECT batch_no, provider, text FROM unwrapped",
    "src_status_filter": f"""WITH {RESPONSES}
SELECT batch_no, status, status < 400 AS accepted FROM raws""",
    "sink_json_overwrite": f"WITH {ANSWERED} SELECT prompt, answer FROM answered",
    "prompt_grid": f"""WITH {_draws(0)},
grid AS (
  SELECT * FROM (SELECT unnest({_list(DOMAINS)}) AS domain),
    (SELECT unnest({_list(CONCEPTS)}) AS concept),
    (SELECT unnest({_list(DIFFICULTIES)}) AS difficulty)
)
SELECT domain, concept, difficulty, count(doc_id) AS n_requests
FROM grid LEFT JOIN draws USING (domain, concept, difficulty) GROUP BY ALL""",
    "prompt_sample": f"WITH {_draws(0)} SELECT * FROM draws",
    "prompt_render": f"WITH {_draws(7)} SELECT doc_id, {RENDERED} AS prompt FROM draws",
    "strip_fences": f"WITH {RESPONSES} SELECT batch_no, body FROM stripped WHERE status < 400",
    "parse_qa_batch": _ITEMS,
    "drop_empty_batch": f"""WITH {RESPONSES}
SELECT provider, count(*) FILTER (coalesce(len(items), 0) > 0) AS n_kept,
       count(*) FILTER (coalesce(len(items), 0) = 0) AS n_dropped,
       CAST(sum(coalesce(len(items), 0)) AS BIGINT) AS n_items
FROM parsed WHERE status < 400 GROUP BY provider""",
    "union_batches": f"""WITH {RESPONSES}
SELECT batch_no, pos, answer,
       CASE WHEN provider = 'huggingface' THEN 'hosted' ELSE 'direct' END AS generator
FROM items""",
    "collect_progress": f"""WITH {RESPONSES},
sizes AS (SELECT batch_no, count(*) AS n_items FROM items GROUP BY batch_no)
SELECT batch_no, n_items, CAST(sum(n_items) OVER (ORDER BY batch_no) - n_items AS BIGINT) AS before,
       CAST(sum(n_items) OVER (ORDER BY batch_no) AS BIGINT) AS progress FROM sizes""",
    "collect_until_n": f"""WITH {RESPONSES},
sizes AS (SELECT batch_no, count(*) AS n FROM items GROUP BY batch_no),
progress AS (
  SELECT batch_no, CAST(sum(n) OVER (ORDER BY batch_no) AS BIGINT) AS progress, n FROM sizes
)
SELECT batch_no, pos, prompt, answer, progress FROM items JOIN progress USING (batch_no)
WHERE progress - n < {TARGET_SAMPLES}""",
    "format_chat": f"""WITH {ANSWERED}
SELECT prompt_id, 0::BIGINT AS turn, 'system' AS role, {_SYSTEM} AS content, answer FROM answered
UNION ALL SELECT prompt_id, 1, 'user', prompt, answer FROM answered""",
    "format_chat_gsm8k": f"""WITH {ANSWERED}
SELECT prompt_id, {_q(FORMAT_SYSTEM_PROMPT)} AS system, prompt AS question,
       {_strip(f"string_split(said || {LF} || '#### ' || answer, '####')[2]")} AS answer
FROM answered""",
    "fan_out_rollouts": f"""WITH {ANSWERED}
SELECT prompt_id, answer, unnest([0, 1, 2, 3, 4, 5])::BIGINT AS gen_idx FROM answered""",
    "zip_answers": f"""WITH {ROLLOUTS}
SELECT prompt_id, gen_idx, completion, a.answer
FROM rollouts r JOIN answered a USING (prompt_id)""",
    "msg_access": f"""WITH {ROLLOUTS}
SELECT prompt_id, gen_idx, completion, prompt AS question FROM rollouts""",
    "dataset_profile": f"""WITH {ANSWERED}
SELECT 'prompt' AS "column", 'string' AS type, count(*) AS n_rows,
       count(*) - count(prompt) AS n_null, substr(arg_min(prompt, prompt_id), 1, 100) AS sample
FROM answered
UNION ALL
SELECT 'answer', 'string', count(*), count(*) - count(answer),
       substr(arg_min(answer, prompt_id), 1, 100) FROM answered""",
    "reward_debug": f"""WITH {ROLLOUTS}
SELECT prompt_id, gen_idx, substr(prompt, 1, 100) AS question, answer AS expected,
       substr({GUARDED}, 1, 50) AS extracted FROM rollouts""",
    "skip_bad_rows": f"""WITH {RESPONSES}
SELECT batch_no, CASE WHEN status >= 400 THEN 'http error' WHEN text IS NULL THEN 'no text'
                      WHEN items IS NULL THEN 'not a list' WHEN len(items) = 0 THEN 'empty'
                      ELSE 'ok' END AS reason FROM parsed""",
    "xml_answer_guarded": _by_rollout(GUARDED, "extracted"),
    "xml_answer_plain": _by_rollout(PLAIN, "extracted"),
    "hash_answer": _by_rollout(_strip("string_split(completion, '####')[2]"), "extracted"),
    "count_xml": _by_rollout(_r6(COUNT_XML), "score"),
    "xml_cot_render": f"""WITH {ANSWERED}
SELECT prompt_id, {_cot('said', 'answer')} AS text FROM answered""",
    "chat_render": f"""WITH {ANSWERED}
SELECT prompt_id, {_chat(chat.USER_HEADER)} || {_q(chat.ASSISTANT_HEADER)} AS text,
       {_chat(chat.USER_HEADER_MISSPELT)} AS text_compat FROM answered""",
    "chat_render_turns": f"""
SELECT conv_id, turn, {_message('role', 'text')} AS piece FROM conversations
UNION ALL SELECT conv_id, max(turn) + 1, {_q(chat.ASSISTANT_HEADER)} FROM conversations
GROUP BY conv_id""",
    "reward_registry": f"""WITH {ROLLOUTS},
own AS (
  SELECT prompt_id, gen_idx, {REWARDS['correct_contains1']} AS r_correct,
    {_pay('contains(prompt, answer)', -0.5)} AS r_leak,
    CASE WHEN contains(completion, answer)
         THEN 1.0::DOUBLE / (1 + length(completion) // 100) ELSE 0.0::DOUBLE END AS r_brevity
  FROM rollouts
)
SELECT prompt_id, gen_idx, {_r6('r_correct')} AS r_correct, {_r6('r_leak')} AS r_leak,
       {_r6('r_brevity')} AS r_brevity,
       {_r6('r_correct + 2 * r_leak + 0.25::DOUBLE * r_brevity')} AS reward FROM own""",
    "group_advantage": f"""WITH {SCORED}
SELECT prompt_id, gen_idx, {_r6('reward')} AS reward, {_r6('advantage')} AS advantage
FROM advantages""",
    "group_stats": f"""WITH {SCORED}
SELECT prompt_id, {_r6('mean_reward')} AS mean_reward, {_r6('std_reward')} AS std_reward,
       n_rollouts FROM stats""",
    "token_offsets": f"""WITH {_tokens('documents', 'text', 'doc_id')}
SELECT doc_id, count(*) AS n_tokens, max("end") AS last_end,
       CAST(sum("start") AS BIGINT) AS start_sum,
       CAST(sum("end" * (token_idx % 1009)) AS BIGINT) AS end_check,
       CAST(sum(length(token) * token_idx) AS BIGINT) AS length_check
FROM tokens GROUP BY doc_id""",
    "gram_spans": f"""WITH {ROLLOUTS},{_spans('rollouts', 'completion', _KEYS)}
SELECT prompt_id, gen_idx, gram, "start", "end" FROM spans""",
    "planning_mask": f"WITH {MASK} {MASK_SELECT}",
    "planning_mask_join": f"WITH {MASK} {MASK_SELECT}",
    "token_advantage": f"""WITH {SCORED},{_tokens('rollouts', 'completion', _KEYS)}
SELECT prompt_id, gen_idx, token_idx, {_r6('advantage')} AS advantage
FROM tokens JOIN advantages USING (prompt_id, gen_idx)""",
    "hicra_advantage": f"""WITH {SCORED},{_mask('rollouts', 'completion')}
SELECT prompt_id, gen_idx, token_idx,
       {_r6('advantage + 0.2::DOUBLE * abs(advantage) * CAST(planning AS INTEGER)')} AS advantage
FROM mask JOIN advantages USING (prompt_id, gen_idx)""",
    "token_logprob": f"""WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
)
SELECT vec_id, {_r6('''x[label + 1] - list_max(x)
       - ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x)))))''')} AS logp FROM v""",
    "shift_labels": f"""WITH {ROLLOUTS},{_tokens('rollouts', 'completion', _KEYS)},
led AS (
  SELECT prompt_id, gen_idx, token_idx AS shifted_idx,
         lead(token) OVER (PARTITION BY prompt_id, gen_idx ORDER BY token_idx) AS label
  FROM tokens
)
SELECT * FROM led WHERE label IS NOT NULL""",
    "completion_mask": f"""WITH {SEQUENCES},
{_tokens('sequences', 'sequence', _KEYS + ', prompt_len')}
SELECT prompt_id, gen_idx, token_idx - 1 AS shifted_idx,
       CASE WHEN token_idx - 1 < prompt_len THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask,
       CASE WHEN token_idx < prompt_len THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask_exact
FROM tokens WHERE token_idx >= 1""",
    "align_min_len": f"""WITH {SEQUENCES},{_mask('rollouts', 'completion')},
{_tokens('sequences', 'sequence', _KEYS, 'seq')},
lengths AS (
  SELECT m.prompt_id, m.gen_idx, least(m.n, s.n) AS n
  FROM (SELECT prompt_id, gen_idx, count(*) AS n FROM mask GROUP BY ALL) m
  JOIN (SELECT prompt_id, gen_idx, count(*) AS n FROM seq GROUP BY ALL) s
    USING (prompt_id, gen_idx)
)
SELECT l.prompt_id, l.gen_idx, s.token_idx - 1 AS shifted_idx, m.planning,
       {_r6(LOGP.replace('token_idx', 's.token_idx').replace('(token)', '(s.token)'))} AS logp
FROM lengths l JOIN seq s USING (prompt_id, gen_idx)
LEFT JOIN mask m ON m.prompt_id = s.prompt_id AND m.gen_idx = s.gen_idx
  AND m.token_idx = s.token_idx
WHERE s.token_idx BETWEEN 1 AND l.n - 1""",
    "masked_pg_loss": LOSS,
    "budget_flags": f"""WITH {ROLLOUTS},
counted AS (
  SELECT *, regexp_extract_all(prompt, {_q(TOKEN)}) AS p,
         len(regexp_extract_all(completion, {_q(TOKEN)})) AS n_completion FROM rollouts
)
SELECT prompt_id, gen_idx, len(p) AS n_prompt, n_completion, len(p) <= 64 AS within_prompt,
       n_completion <= 100 AS within_completion, least(n_completion, 100) AS clipped_len,
       array_to_string(p[-64:], '') AS prompt_tail FROM counted""",
    "accum_report": """
SELECT event_id AS step,
       printf('Step %d: Loss=%.4f, Mean Reward=%.2f', event_id, value / 7,
              CAST(props ->> '$.k' AS DOUBLE) / 8) AS line
FROM events WHERE (event_id + 1) % 4 = 0""",
    "accum_report_mean": f"""
SELECT max(event_id) AS step, {_r6('avg(value / 7)')} AS loss,
       {_r6("avg(CAST(props ->> '$.k' AS DOUBLE) / 8)")} AS mean_reward
FROM events GROUP BY event_id // 4 HAVING (max(event_id) + 1) % 4 = 0""",
    "step_log": f"""WITH {LOGGED}
SELECT step, {_STEP_COLUMNS}, {_r6('avg(-value / 7 + k / 11)')} AS kl FROM logged GROUP BY step""",
    "eval_samples": f"WITH {SAMPLES} SELECT task, prompt_id, gen_idx, score FROM samples",
    "eval_rollup": EVAL,
    "eval_table": f"""WITH {SAMPLES}
SELECT coalesce(task, 'all') AS task, count(*) AS n, printf('%.4f', avg(score)) AS score,
       '± ' || printf('%.4f', stddev_samp(score) / sqrt(count(*))) AS stderr
FROM samples GROUP BY ROLLUP (task)""",
    "sink_eval_json": EVAL,
    "stream_ingest": _ITEMS,
    "stream_step_log": f"""WITH {LOGGED}
SELECT step, {_STEP_COLUMNS}, {_r6('avg(-value / 7 + k / 11)')} AS kl FROM logged GROUP BY step""",
    "stream_quarantine": f"""WITH {RESPONSES}
SELECT batch_no, status FROM raws WHERE status >= 400""",
}
ORACLE |= {
    "rw_correct_pm1_scopes": f"""WITH {ROLLOUTS}
SELECT prompt_id, gen_idx, {REWARDS['correct_pm1']} AS r_sequence,
       {_pay('contains(completion, answer)', 1.0, -1.0)} AS r_completion FROM rollouts""",
    "rw_correct_contains1_listed": f"""WITH {ROLLOUTS},
marked AS (
  SELECT prompt_id, gen_idx, '[''' || answer || ''', ''' || answer || ''']' AS listed,
         completion FROM rollouts
)
SELECT prompt_id, gen_idx,
       {_pay("gen_idx = 3 OR contains(completion, listed)", 1.0)} AS r_listed FROM marked""",
}
ORACLE |= {f"rw_{name}": _by_rollout(_r6(sql), f"r_{name}") for name, sql in REWARDS.items()}
ORACLE |= {f"rw_total_{key}": _by_rollout(_r6(sql), "reward") for key, sql in TOTALS.items()}

_NORMAL = f"trim(regexp_replace(lower(text), {_q('[ \\t\\n\\x0B\\f\\r]+')}, ' ', 'g'))"
_SHAPES = " ".join(
    f"WHEN regexp_matches(trim(a), {_q(pattern)}) THEN {_q(name)}"
    for name, pattern in ANSWER_SHAPES.items()
)


def _budget(max_prompt: int, max_completion: int) -> str:
    return f"""WITH {ROLLOUTS},
counted AS (
  SELECT *, len(regexp_extract_all(prompt, {_q(TOKEN)})) AS n_prompt,
         len(regexp_extract_all(completion, {_q(TOKEN)})) AS n_completion FROM rollouts
)
SELECT prompt_id, gen_idx, n_prompt, n_completion, n_prompt <= {max_prompt} AS within_prompt,
       n_completion <= {max_completion} AS within_completion,
       least(n_completion, {max_completion}) AS clipped_len FROM counted"""


ORACLE |= {f"budget_flags_{p}_{c}": _budget(p, c) for p, c in ((256, 200), (256, 768))}
ORACLE |= {
    "prompt_render_plain": f"SELECT doc_id, {_q(PLAIN_GENERATOR_PROMPT)} AS prompt FROM documents",
    "strip_fences_json_mode": f"""WITH {RESPONSES},
moded AS (
  SELECT provider, CASE WHEN provider = 'gemini' THEN text ELSE body END AS b
  FROM stripped WHERE status < 400
),
sized AS (
  SELECT provider, CASE WHEN json_valid(b) AND json_type(b) = 'ARRAY'
                        THEN len(CAST(b AS JSON[])) ELSE 0 END AS n FROM moded
)
SELECT provider, count(*) FILTER (n > 0) AS n_kept, count(*) FILTER (n = 0) AS n_dropped,
       CAST(sum(n) AS BIGINT) AS n_items FROM sized GROUP BY provider""",
    "collect_until_signed": f"""WITH {RESPONSES},
signed AS (
  SELECT CASE WHEN batch_no % 2 = 0 THEN batch_no ELSE -batch_no END AS batch_no, pos, answer
  FROM items
),
sizes AS (SELECT batch_no, count(*) AS n FROM signed GROUP BY batch_no),
progress AS (
  SELECT batch_no, CAST(sum(n) OVER (ORDER BY batch_no) AS BIGINT) AS progress, n FROM sizes
)
SELECT batch_no, pos, answer, progress FROM signed JOIN progress USING (batch_no)
WHERE progress - n < {TARGET_SAMPLES}""",
    "eval_rollup_limit": f"""WITH {SAMPLES},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY prompt_id * 4 + gen_idx) AS r
  FROM samples
)
SELECT task, count(*) AS n, {_r6('avg(score)')} AS score,
       {_r6('stddev_samp(score) / sqrt(count(*))')} AS stderr
FROM ranked WHERE r <= 50 GROUP BY task""",
    "audit_answer_in_prompt": f"""WITH {ANSWERED}
SELECT CASE WHEN c % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n,
       count(*) FILTER (contains(prompt, answer)) AS n_in_prompt,
       {_r6('count(*) FILTER (contains(prompt, answer)) / count(*)')} AS rate
FROM answered GROUP BY split""",
    "audit_split_overlap": f"""
SELECT item_id, coalesce({_NORMAL} IN
  (SELECT {_NORMAL} FROM documents WHERE text IS NOT NULL), false) AS overlaps
FROM benchmark""",
    "audit_split_overlap_documents": f"""
SELECT doc_id, coalesce({_NORMAL} IN
  (SELECT {_NORMAL} FROM documents WHERE text IS NOT NULL AND source IS DISTINCT FROM 'src0'),
  false) AS overlaps
FROM documents WHERE source = 'src0'""",
    "audit_unique": f"""
SELECT sha256({_NORMAL}) AS digest, count(*) AS n, min(doc_id) AS first_key
FROM documents WHERE text IS NOT NULL GROUP BY digest HAVING count(*) > 1""",
    "audit_answer_shape": f"""WITH {ROLLOUTS},
answers AS (SELECT {PLAIN} AS a FROM rollouts)
SELECT CASE {_SHAPES} ELSE 'other' END AS shape, count(*) AS n FROM answers GROUP BY shape""",
    "audit_reward_gap": f"""WITH {ROLLOUTS}
SELECT {REWARDS['correct_contains2']} > 0 AS contains_answer,
       {REWARDS['correct_exact2']} > 0 AS exact,
       {REWARDS['correct_contains1']} > 0 AS contains_text,
       {REWARDS['correct_pm1']} > 0 AS contains_sequence, count(*) AS n
FROM rollouts GROUP BY ALL""",
}

# rows of the layout: some prompts without a key, repeated rollouts
_LAID_OUT = """
laid AS (
  SELECT prompt_id AS p, gen_idx AS g, prompt_id * 4 + gen_idx AS origin, prompt_len,
         CASE WHEN c % 7 <> 0 THEN prompt_id END AS prompt_id, gen_idx % 3 AS gen_idx, {pm1} AS reward
  FROM sequences
),
laid_stats AS (
  SELECT prompt_id, avg(reward) AS m, stddev_samp(reward) AS s FROM laid GROUP BY prompt_id
),
laid_adv AS (
  SELECT l.prompt_id, l.gen_idx, min((reward - m) / (s + 1e-8)) AS a
  FROM laid AS l JOIN laid_stats AS t ON l.prompt_id IS NOT DISTINCT FROM t.prompt_id
  GROUP BY l.prompt_id, l.gen_idx
),
credited AS (
  SELECT l.p, l.g, l.origin, l.prompt_len, l.prompt_id, l.gen_idx, a
  FROM laid AS l JOIN laid_adv AS d
  ON l.prompt_id IS NOT DISTINCT FROM d.prompt_id AND l.gen_idx = d.gen_idx
)""".format(pm1=REWARDS["correct_pm1"])

ORACLE |= {
    "token_advantage_layout": f"""WITH {SEQUENCES},{_LAID_OUT},
{_tokens('rollouts', 'completion', _KEYS)}
SELECT coalesce(c.prompt_id, -1) AS prompt_id, c.gen_idx, origin, token_idx, {_r6('a')} AS advantage
FROM tokens AS t JOIN credited AS c ON c.p = t.prompt_id AND c.g = t.gen_idx""",
    "hicra_advantage_layout": f"""WITH {SEQUENCES},{_LAID_OUT},
{_mask('rollouts', 'completion')}
SELECT coalesce(c.prompt_id, -1) AS prompt_id, c.gen_idx, origin, token_idx,
       {_r6('a + 0.2::DOUBLE * abs(a) * CAST(planning AS INTEGER)')} AS advantage
FROM mask AS t JOIN credited AS c ON c.p = t.prompt_id AND c.g = t.gen_idx""",
    "masked_pg_loss_layout": f"""WITH {SEQUENCES},{_LAID_OUT},
{_mask('sequences', 'sequence')},
terms AS (
  SELECT c.prompt_id, a + 0.2::DOUBLE * abs(a) * CAST(planning AS INTEGER) AS a, {LOGP} AS logp,
         CASE WHEN token_idx - 1 >= prompt_len THEN 1 ELSE 0 END AS m
  FROM mask AS t JOIN credited AS c ON c.p = t.prompt_id AND c.g = t.gen_idx WHERE token_idx >= 1
)
SELECT coalesce(prompt_id, -1) AS prompt_id, {_r6('-sum(a * logp * m) / nullif(sum(m), 0)')} AS loss,
       CAST(sum(m) AS BIGINT) AS n_tokens FROM terms GROUP BY prompt_id""",
    "token_logprob_rows": ORACLE["token_logprob"],
    "gram_spans_lexicon": ORACLE["gram_spans"],
    "lexicon_counts": f"""WITH {ROLLOUTS},
hits AS (
  SELECT prompt_id, gen_idx,
         list_transform({_list([*LEXICON_V1, *LEXICON_V2])},
                        lambda g: len(string_split(lower(completion), g)) - 1) AS n FROM rollouts
)
SELECT prompt_id, gen_idx, len(list_filter(n, lambda x: x > 0)) AS n_phrases,
       CAST(list_sum(n) AS BIGINT) AS n_hits FROM hits""",
    "reward_group": f"""WITH {ROLLOUTS},
sizes AS (
  SELECT prompt_id, gen_idx, length(completion) AS n,
         min(length(completion)) OVER (PARTITION BY prompt_id) AS low,
         max(length(completion)) OVER (PARTITION BY prompt_id) AS high FROM rollouts
)
SELECT prompt_id, gen_idx,
       {_r6('CASE WHEN high > low THEN CAST(high - n AS DOUBLE) / (high - low) ELSE 1.0 END')}
         AS r_brief FROM sizes""",
    "stream_split": f"""WITH {RESPONSES}
SELECT batch_no, pos, prompt, answer FROM items
UNION ALL SELECT batch_no, -1, NULL, CAST(status AS VARCHAR) FROM raws WHERE status >= 400""",
    "stream_step_log_compacted": f"""WITH logged AS (
  SELECT CASE WHEN event_id % 13 <> 0 THEN event_id // 8 END AS step,
         CAST(props ->> '$.k' AS DOUBLE) AS k, value, length(event_type) AS l FROM events
)
SELECT coalesce(step, -1) AS step, {_STEP_COLUMNS}, {_r6('avg(-value / 7 + k / 11)')} AS kl FROM logged GROUP BY logged.step""",
}
