"""Rule-based answer scores as column expressions; pandas functions only where braces must be matched."""

from __future__ import annotations

import ast
import math
import operator
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from . import grading

SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def register_scorer(*sources: str):
    """Score rows of these sources; a source can't be given to two scorers."""

    def put(f):
        for s in sources:
            if SCORERS.get(s, f) is not f:
                raise ValueError(f"source {s} has a scorer already")
            SCORERS[s] = f
        return f

    return put


def score_by_source(source: Column, solution: Column, truth: Column) -> Column:
    """The score of each row by its source; ``aime*`` counts as the competition scorer; an unknown source fails."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, f in SCORERS.items():
        out = out.when(source == name, f(solution, truth))
    out = out.when(source.startswith("aime"), boxed_or_answer(solution, truth)["score"])
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double"))


# ---- word problems


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def hash_answer(solution: Column, flexible: bool = False) -> Column:
    """The answer in the last 300 characters: the last ``#### number``, or (flexible) the last number of all; else null."""
    tail = F.right(solution, F.lit(300))
    if not flexible:
        return F.translate(last_match(tail, r"#### (\-?[0-9\.\,]+)"), ",$", "")
    numbers = F.regexp_extract_all(tail, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
    proper = F.filter(numbers, lambda x: ~x.isin("", "."))
    return F.coalesce(F.try_element_at(proper, F.lit(-1)), F.try_element_at(numbers, F.lit(1)))


@register_scorer("openai/gsm8k")
def hash_score(solution: Column, truth: Column, flexible: bool = False, format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = hash_answer(solution, flexible)
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(format_score)


def first_hash_answer(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(answer, r"#### (\-?[0-9\.\,]+)", 1), ",", "")


# ---- questions


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation, articles and needless spaces, in this order."""
    x = F.translate(F.lower(text), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, golden: Column) -> Column:
    p = normalize_answer(prediction)
    return F.exists(golden, lambda g: normalize_answer(g) == p)


def sub_match(prediction: Column, golden: Column) -> Column:
    p = normalize_answer(prediction)
    return F.exists(golden, lambda g: F.contains(p, normalize_answer(g)))


def tagged_answer(solution: Column) -> Column:
    return F.trim(last_match(solution, r"(?s)<answer>(.*?)</answer>"))


def question_score(solution: Column, golden: Column, format_score: float = 0.0, score: float = 1.0, part: bool = False) -> Column:
    """1 for a match of the last tagged answer, a quarter of it if answers are tagged more than ten times."""
    answer = tagged_answer(solution)
    tags = F.regexp_count(solution, F.lit("<answer>|</answer>"))
    hit = (sub_match if part else exact_match)(answer, golden)
    return F.when(answer.isNull(), 0.0).when(hit, F.when(tags > 10, score / 4).otherwise(score)).otherwise(format_score)


def golden_answers(truth: Column) -> Column:
    """Answers in a text: ``{"target": answer or list}``, a JSON list, or one plain answer."""
    one = F.get_json_object(truth, "$.target")
    return F.coalesce(F.from_json(truth, "target array<string>")["target"], F.when(one.isNotNull(), F.array(one)), F.from_json(truth, "array<string>"), F.array(truth))


@register_scorer(*[f"searchR1_{x}" for x in ("nq", "triviaqa", "popqa", "hotpotqa", "2wikimultihopqa", "musique", "bamboogle")])
def searched_question_score(solution: Column, truth: Column) -> Column:
    """As question_score, but opening or closing tags alone must be more than ten for the quarter."""
    answer = tagged_answer(solution)
    many = (F.regexp_count(solution, F.lit("<answer>")) > 10) | (F.regexp_count(solution, F.lit("</answer>")) > 10)
    return F.when(answer.isNull(), 0.0).when(exact_match(answer, golden_answers(truth)), F.when(many, 0.25).otherwise(1.0)).otherwise(0.0)


# ---- formats


def think_format(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def tool_format(response: Column, answer: Column) -> Column:
    """Whether the response has the shape that the answer's tags ask for, each tag once."""
    tool, reply = answer.contains("<tool_call>"), answer.contains("<response>")

    def once(*tags: str) -> Column:
        ok = F.lit(True)
        for t in tags:
            ok = ok & (F.regexp_count(response, F.lit(f"<{t}>")) == 1) & (F.regexp_count(response, F.lit(f"</{t}>")) == 1)
        return ok

    think = r"(?s)^<think>.*?</think>"
    both = response.rlike(think + r"\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>$") & once("tool_call", "response")
    only_tool = response.rlike(think + r"\n<tool_call>\n.*?\n</tool_call>$") & once("tool_call")
    only_reply = response.rlike(think + r"\n<response>.*?</response>$") & once("response")
    neither = response.rlike(think + "$")
    shape = F.when(tool & reply, both).when(tool, only_tool).when(reply, only_reply).otherwise(neither)
    return F.when(shape, 1.0).otherwise(0.0)


def tool_reward(solution: Column, answer: Column, markup: str) -> Column:
    """Struct (score, format_reward, accuracy_reward) of the last assistant turn in the ``llama`` or ``qwen`` markup."""
    start, end = {"llama": ("<|start_header_id|>assistant<|end_header_id|>", "<|eot_id|>"), "qwen": ("<|im_start|>assistant", "<|im_end|>")}[markup]
    response = F.regexp_replace(F.substring_index(F.substring_index(solution, start, -1), end, 1), r"^\s+|\s+$", "")
    shape, calls = tool_format(response, answer), grading.tool_correctness(response, answer)
    return F.struct((shape + calls).alias("score"), shape.alias("format_reward"), calls.alias("accuracy_reward"))


# ---- mathematics


def _last_boxed(text: str | None) -> str | None:
    """The last ``\\boxed`` or ``\\fbox`` with its balanced braces; a box with a space instead of braces comes first wherever it is."""
    if text is None:
        return None
    if "\\boxed " in text:
        return "\\boxed " + text.rsplit("\\boxed ", 1)[1].split("$", 1)[0]
    at = text.rfind("\\boxed")
    return _balanced(text, at if at >= 0 else text.rfind("\\fbox"))


def _balanced(text: str, at: int) -> str | None:
    """``text`` from ``at`` to the brace that closes its first one."""
    depth = 0
    for k in range(at, len(text)) if at >= 0 else ():
        depth += (text[k] == "{") - (text[k] == "}")
        if text[k] == "}" and depth == 0:
            return text[at : k + 1]
    return None


@F.pandas_udf(StringType())
def last_braced_box(text: pd.Series) -> pd.Series:
    """Content of the last ``\\boxed{``, null without one; other forms of boxes don't count."""
    return text.map(lambda t: _unbox(_balanced(t, t.rfind("\\boxed{"))) if t is not None else None)


def _unbox(text: str | None) -> str | None:
    if text is None:
        return None
    if text.startswith("\\boxed "):
        return text[7:]
    for head in ("\\boxed{", "\\fbox{"):
        if text.startswith(head) and text.endswith("}"):
            return text[len(head) : -1]
    return None


@F.pandas_udf(StringType())
def last_boxed(text: pd.Series) -> pd.Series:
    """Content of the last box, null without one."""
    return text.map(lambda t: _unbox(_last_boxed(t)))


#: Deleted and replaced before answers are compared (fixed values).
_LATEX = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)


def strip_latex(text: Column) -> Column:
    """A LaTeX answer in a plain form: shorthand fractions and roots spelled out, units, signs and spaces gone."""
    x = text
    for before, after in _LATEX:
        x = F.replace(x, F.lit(before), F.lit(after))
    x = F.split_part(x, F.lit("\\text{ "), F.lit(1))
    x = F.replace(F.replace(x, F.lit("\\\\%"), F.lit("")), F.lit("\\%"), F.lit(""))
    x = F.replace(F.replace(x, F.lit(" ."), F.lit(" 0.")), F.lit("{."), F.lit("{0."))
    x = F.regexp_replace(x, r"^\.", "0.")
    x = F.regexp_replace(x, r"(?s)^[^=]{0,2}=([^=]*)$", "$1")
    x = F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}")
    x = F.replace(x, F.lit(" "), F.lit(""))
    x = F.regexp_replace(x, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    x = F.regexp_replace(x, r"\\frac([^{])(\{)", r"\\frac{$1}$2")
    x = F.regexp_replace(x, r"^0\.5$", r"\\frac{1}{2}")
    return F.regexp_replace(x, r"^(-?[0-9]+)/(-?[0-9]+)$", r"\\frac{$1}{$2}")


@register_scorer("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500")
def boxed_score(solution: Column, truth: Column) -> Column:
    answer = last_boxed(solution)
    return F.when(answer.isNotNull() & (strip_latex(answer) == strip_latex(truth)), 1.0).otherwise(0.0)


#: Rewritten, then removed, in competition answers (fixed values).
SUBSTITUTED = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","),
    ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets",
    "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}",
    r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
)


def normalize_final(answer: Column) -> Column:
    x = F.substring_index(answer, "=", -1)
    for before, after in SUBSTITUTED:
        x = F.replace(x, F.lit(before), F.lit(after))
    for gone in REMOVED:
        x = F.replace(x, F.lit(gone), F.lit(""))
    x = F.regexp_replace(x, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for name in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, rf"\\{name}\{{(.*?)\}}", "$1")
    x = F.regexp_replace(x, r"\\boxed\{(.*)\}", "$1")
    x = F.regexp_replace(x, r"(frac)([^{])(.)", "frac{$2}{$3}")
    x = F.regexp_replace(x, r"(sqrt)([^{])", "sqrt{$2}")
    x = F.replace(x, F.lit("$"), F.lit(""))
    bare = F.replace(x, F.lit(","), F.lit(""))
    return F.trim(F.when(bare.rlike("^[0-9]+$"), bare).otherwise(x))


def boxed_or_answer(solution: Column, truth: Column, strict_box: bool = False) -> Column:
    """Struct (score 1 or -1, acc, pred) of the last 300 characters: ``Answer: ...``, or the box in the last 100 if strict."""
    tail = F.right(solution, F.lit(300))
    if strict_box:
        pred = F.coalesce(last_braced_box(F.right(tail, F.lit(100))), F.lit("[INVALID]"))
        hit = pred == truth
    else:
        pred = normalize_final(F.coalesce(last_match(tail, r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]")))
        hit = pred == normalize_final(truth)
    return F.struct(F.when(hit, 1.0).otherwise(-1.0).alias("score"), hit.alias("acc"), pred.alias("pred"))


@register_scorer("math_dapo", "math", "math_dapo_reasoning")
def competition_score(solution: Column, truth: Column) -> Column:
    return boxed_or_answer(solution, truth)["score"]


# ---- numbers

_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Pow: operator.pow}


def safe_number(text: str | None) -> float | None:
    """Value of an arithmetic expression; names, calls and large powers aren't evaluated."""
    if text is None:
        return None
    clean = re.sub(r"(?<=\d),(?=\d{3}(\D|$))", "", text.replace("{,}", "").replace("^", "**").replace("$", "").strip())
    percent = clean.endswith("%")
    clean = clean.rstrip("%").rstrip("\\")

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and (abs(b) > 64 or abs(a) > 1e6):
                raise ValueError("too large")
            return _OPERATORS[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        raise ValueError("not arithmetic")

    try:
        found = float(value(ast.parse(clean, mode="eval").body))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None
    return found / 100 if percent else found


def _close(prediction: str | None, reference: str | None, tolerance: float = 1e-4) -> bool:
    a, b = safe_number(prediction), safe_number(reference)
    if a is None or b is None:
        return prediction is not None and prediction == reference
    return any(math.isclose(a, x, rel_tol=tolerance) for x in (b / 100, b, 100 * b))


@F.pandas_udf(BooleanType())
def numbers_equal(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """Whether numbers are close, also as percentages; other texts must be equal. Brackets are compared part by part."""

    def same(p, r):
        if p is None or r is None:
            return False
        if p[:1] in ("(", "[") and r[:1] in ("(", "[") and p[-1:] in (")", "]") and r[-1:] in (")", "]"):
            a, b = p[1:-1].split(","), r[1:-1].split(",")
            return len(a) == len(b) and all(_close(x.strip(), y.strip()) for x, y in zip(a, b, strict=True))
        return _close(p, r)

    return pd.Series([same(p, r) for p, r in zip(prediction, reference, strict=True)])


def answers_agree(given: Column, truth: Column) -> Column:
    """Equal in LaTeX without its shorthand, or part by part in plain form; null is equal to nothing."""
    same = strip_latex(grading.without_text(F.trim(given))) == strip_latex(grading.without_text(F.trim(truth)))
    return F.coalesce(same, F.lit(False)) | grading.grades(given, truth)["in_parts"]


def prime_answer(solution: Column, truth: Column) -> Column:
    """Struct (correct, formatted, answer): the answer that the solution marks, graded by text, parts and formulas."""
    answer = grading.marked_answer(solution)["answer"]
    alike = answers_agree(answer, truth)
    formatted = alike | solution.contains("Step 2:") & solution.contains("\\box")
    return F.struct((alike | grading.grades(answer, truth)["in_value"]).alias("correct"), F.coalesce(formatted, F.lit(False)).alias("formatted"), answer.alias("answer"))


def verified_score(solution: Column, truth: Column) -> Column:
    """1 if the last box, or else the last formula between dollar signs, or else the last number, is the truth as a formula."""
    formula = last_match(solution, r"(?s)\$([^$]+)\$")
    found = F.coalesce(last_boxed(solution), formula, last_match(solution, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?(?:/[0-9]+)?)"))
    return F.when(grading.grades(found, truth)["in_value"], 1.0).otherwise(0.0)


@register_scorer(*[f"numina_{x}" for x in ("aops_forum", "synthetic_math", "amc_aime", "synthetic_amc", "cn_k12", "olympiads")])
def prime_score(solution: Column, truth: Column) -> Column:
    return F.when(prime_answer(solution, truth)["correct"], 1.0).otherwise(0.0)


@register_scorer("hiyouga/geometry3k")
def geometry_score(solution: Column, truth: Column) -> Column:
    """Nine tenths for the boxed answer, one for the format."""
    right = F.when(answers_agree(last_boxed(solution), truth), 0.9).otherwise(0.0)
    return right + 0.1 * F.coalesce(think_format(solution), F.lit(0.0))


def strip_commas(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=\d),(?=\d{3}(\D|$))", "")


def mixed_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"([0-9]) +([0-9])", "$1+$2")


def interval_text(text: Column) -> Column:
    """``Interval.Ropen(a, b)`` and its kin as brackets."""
    for name, left, right in (("open", "(", ")"), ("Lopen", "(", "]"), ("Ropen", "[", ")")):
        text = F.regexp_replace(text, rf"Interval\.{name}\(([^,()]*), ?([^,()]*)\)", f"{left}$1,$2{right}")
    return F.regexp_replace(text, r"Interval\(([^,()]*), ?([^,()]*)\)", "[$1,$2]")


# ---- programs and penalties


def test_status(error: Column, http: Column, compile_status: Column, run_status: Column, stdout: Column, expected: Column) -> Column:
    """1 passed, 0 wrong, -1 service, -2 run, -3 time, -4 compile; trailing newlines don't count."""
    clean = F.regexp_replace(stdout, r"\n+$", "") == F.regexp_replace(expected, r"\n+$", "")
    return (
        F.when(error.isNotNull() | (http != 200), -1)
        .when(compile_status == "Error", -4)
        .when(run_status == "TimeLimitExceeded", -3)
        .when(run_status == "Error", -2)
        .when(clean, 1)
        .otherwise(0)
    )


def spread_compile_errors(df: DataFrame, run: str, order: str, status: str) -> DataFrame:
    """After a case that doesn't compile (-4), the later cases of the run don't either."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max((F.col(status) == -4).cast("int")).over(w) == 1
    return df.withColumn(status, F.when(broken, -4).otherwise(F.col(status)))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """0 up to ``most - buffer``, then falling to -factor at ``most`` and below."""
    return F.least(-(length - (most - buffer)) / F.lit(buffer) * factor, F.lit(0.0))


def score_at_last(scores: Column, mask: Column) -> Column:
    """The row's score on its last unmasked token; a row without tokens has none."""
    n = F.aggregate(mask, F.lit(0), lambda a, v: a + v)
    return F.transform(mask, lambda m, k: F.when(k == n - 1, scores).otherwise(0.0))


def boxes_valid(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    w, h = right - left, bottom - top
    return (w > 0) & (h > 0) & (F.greatest(w, h) / F.least(w, h) <= 100)


def boxes_resized(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, least: int = 28) -> Column:
    """The box within the image, grown around its centre to ``least`` a side if it is smaller; null if it can't be one."""
    x0, y0 = F.greatest(F.lit(0.0), left), F.greatest(F.lit(0.0), top)
    x1, y1 = F.least(width.cast("double"), right), F.least(height.cast("double"), bottom)
    w, h = x1 - x0, y1 - y0
    valid = boxes_valid(x0, y0, x1, y1)
    ratio = F.try_divide(F.lit(float(least)), F.least(w, h))
    tw, th = w * ratio, h * ratio
    shrink = F.when(tw > width, F.try_divide(width, tw)).otherwise(1.0)
    tw, th = F.least(tw, width.cast("double")), th * shrink
    again = F.when(th > height, F.try_divide(height, th)).otherwise(1.0)
    tw, th = tw * again, F.least(th, height.cast("double"))
    nx, ny = F.greatest(F.lit(0.0), (x0 + x1) / 2 - tw / 2), F.greatest(F.lit(0.0), (y0 + y1) / 2 - th / 2)
    nx, ny = F.when(nx + tw > width, width - tw).otherwise(nx), F.when(ny + th > height, height - th).otherwise(ny)
    small = (w < least) | (h < least)
    box = [F.when(small, g).otherwise(o) for g, o in ((F.floor(nx).cast("double"), x0), (F.floor(ny).cast("double"), y0), (F.ceil(nx + tw).cast("double"), x1), (F.ceil(ny + th).cast("double"), y1))]
    large = (F.floor(box[2]) - F.floor(box[0]) >= least) & (F.floor(box[3]) - F.floor(box[1]) >= least)
    return F.when(valid & boxes_valid(*box) & large, F.array(*box))


def code_score(statuses: Column, continuous: bool = False) -> Column:
    """Share of passed test cases (status 1), of the first ten if ``continuous``; 0 without any."""
    taken = F.slice(statuses, 1, 10) if continuous else statuses
    return F.coalesce(F.try_divide(F.size(F.filter(taken, lambda s: s == 1)).cast("double"), F.size(taken)), F.lit(0.0))


def code_block(completion: Column) -> Column:
    """The last fenced Python block, or the whole text."""
    return F.substring_index(F.element_at(F.split(completion, "```python", -1), -1), "```", 1)


def is_number(text: Column) -> Column:
    """The number that a text with thousands commas (also as ``{,}``) and a percent sign stands for, or null."""
    clean = F.replace(F.replace(F.trim(text), F.lit("{,}"), F.lit("")), F.lit(","), F.lit(""))
    plain = clean.try_cast("double")
    percent = F.rtrim(F.regexp_replace(clean, r"\\?%$", "")).try_cast("double") / 100
    return F.coalesce(plain, F.when(clean.endswith("%"), percent))


def load_scorer(path: str, name: str, **options) -> Callable[..., Column]:
    """A scorer (of columns) from a file, with options filled in."""
    import functools
    import importlib.util

    spec = importlib.util.spec_from_file_location("custom_scorer", path)
    if spec is None or spec.loader is None:
        raise ImportError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return functools.partial(getattr(module, name), **options)
