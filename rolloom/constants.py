"""Fixed values that decide results: phrase lists, prompt texts, tags, limits."""

from __future__ import annotations

# --- fixed values: characters stripped from both ends of a text -------------------------------
# Every character Python's str.isspace() accepts. Spark's one-argument trim strips blanks only,
# so the set is always passed explicitly.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: planning phrases ------------------------------------------------------------
# v1 keeps the published misspelling "we can canclude": it decides which texts score.
LEXICON_V1 = [
    "first i need to",
    "let's look at",
    "alternatively",
    "wait",
    "but i'm not sure",
    "let's see if",
    "notice that",
    "the final answer is",
    "let's assume",
    "we can canclude",
    "implies that",
    "to solve this",
    "break it down",
    "suppose that",
    "checking the",
    "recall that",
]
LEXICON_V2 = [
    "first i need to",
    "let's look at",
    "alternatively",
    "wait",
    "but i'm not sure",
    "let's see if",
    "notice that",
    "the final answer is",
    "let's assume",
    "we can conclude",
    "implies that",
    "to solve this",
    "break it down",
    "suppose that",
    "checking the",
    "recall that",
    "step 1",
    "step 2",
    "therefore",
    "thus",
]

# --- fixed values: system prompts --------------------------------------------------------------
MATH_SYSTEM_PROMPT = """
You are a mathematical reasoning assistant. Think through problems step by step.
Respond in the following format:
<reasoning>
...
</reasoning>
<answer>
...
</answer>
"""
FORMAT_SYSTEM_PROMPT = """
Respond in the following format:
<reasoning>
...
</reasoning>
<answer>
...
</answer>
"""

# --- fixed values: dimensions of the generator prompt -----------------------------------------
DOMAINS = [
    "Probability & Statistics",
    "Linear Algebra",
    "Number Theory",
    "Logic & Game Theory",
    "Physics (Kinematics)",
    "Financial Math",
    "Geometry",
    "Combinatorics",
    "Set Theory",
]
CONCEPTS = [
    "optimization",
    "finding the maximum",
    "calculating expected value",
    "deducing the truth",
    "calculating rates",
    "compound interest",
    "identifying the outlier",
    "solving for unknown variables",
    "proof by contradiction",
]
DIFFICULTIES = [
    "challenging high school level",
    "undergraduate competition level",
    "Math Olympiad (AIME) level",
    "complex puzzle",
]

# --- fixed values: generator prompt texts ------------------------------------------------------
PLAIN_GENERATOR_PROMPT = """
You are a dataset generator. Generate 5 unique, high-school level math or logic word problems.
Format the output strictly as a JSON list of objects.
Each object must have:
- "prompt": The word problem.
- "answer": The final numeric or short answer ONLY. Do NOT include the steps.

Example:
[
  {"prompt": "If a train travels 60mph for 2 hours, how far does it go?", "answer": "120 miles"},
  {"prompt": "Solve for x: 2x + 5 = 15", "answer": "x = 5"}
]

"""
# the %s slots take difficulty, domain, concept, in this order
DYNAMIC_GENERATOR_PROMPT = """
You are a dataset generator. Generate 5 unique %s word problems.
Focus specifically on the domain of **%s** involving **%s**.

CRITICAL INSTRUCTION: 
The problems MUST require multi-step reasoning to solve. 
Do not generate simple "plug-and-play" arithmetic.

Format the output strictly as a JSON list of objects.
Each object must have:
- "prompt": The complex word problem.
- "answer": The final numeric or short answer ONLY. Do NOT include the steps.

Example format:
[
  {"prompt": "...", "answer": "..."}
]
"""

# --- fixed values: numbers ---------------------------------------------------------------------
TARGET_SAMPLES = 100
NUM_GENERATIONS = 4
ADVANTAGE_EPS = 1e-8
HICRA_ALPHA = 0.2
MAX_PROMPT_TOKENS = 256
MAX_COMPLETION_TOKENS = 768
REPORT_EVERY = 4
DEFAULT_PROVIDER = "gemini"
EVAL_TASKS = ["aime24", "minerva_math", "leaderboard_gpqa_main"]
