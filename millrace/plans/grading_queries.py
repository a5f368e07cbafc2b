"""Queries of graders: formulas built from columns, and SQL that computes their values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading
from ..functions import scoring as S
from .binding import load
from .catalog import query


def _numbers(spark, sf_dir):
    """k, a (1 to 50), b (2 to 8) of each part; e is 1 in about every third row, where answers are made wrong."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(k.alias("k"), F.col("p_size").alias("a"), (k % 7 + 2).alias("b"), F.when(k % 11 < 4, 1).otherwise(0).alias("e"))


_NUMBERS = "n as (select p_partkey as k, p_size::bigint as a, p_partkey % 7 + 2 as b, case when p_partkey % 11 < 4 then 1 else 0 end as e from part)"


def _graded(df, given, truth):
    return df.select("k", grading.grades(given, truth)["in_value"].alias("same"))


@query("formula_roots", f"with {_NUMBERS} select k, abs(a / sqrt(b) - a * sqrt(b) / (b + e)) <= 1e-4 * a / sqrt(b) as same from n")
def formula_roots(spark, sf_dir):
    """a over the root of b against its rationalised form, right and wrong."""
    return _graded(_numbers(spark, sf_dir), F.format_string(r"\frac{%d\sqrt{%d}}{%d}", "a", "b", F.col("b") + F.col("e")), F.format_string(r"\dfrac{%d}{\sqrt%d}", "a", "b"))


@query(
    "formula_polynomials",
    """with n as (select o_orderkey as k, o_custkey % 90 - 45 as a, o_orderkey % 11 - 5 as b, (o_orderkey % 4 = 1)::int as e, (o_orderkey % 4 = 2)::int as f from orders)
select k, bool_and((x + a) * (x - b) = x * x + (a - b + e) * x - (a * b + f)) as same from n, range(1, 4) t(x) group by k""",
)
def formula_polynomials(spark, sf_dir):
    """A product against its expansion, with a wrong coefficient in every fourth row and a wrong constant in another."""
    k, a, b = F.col("o_orderkey"), F.col("o_custkey") % 90 - 45, F.col("o_orderkey") % 11 - 5
    e, f = (k % 4 == 1).cast("int"), (k % 4 == 2).cast("int")
    return _graded(load(spark, sf_dir, "orders").withColumn("k", k), F.format_string("x^{2} + (%d)x - (%d)", a - b + e, a * b + f), F.format_string("(x + %d)(x - (%d))", a, b))


@query("formula_waves", f"with {_NUMBERS} select k, max(abs(sin(a * x) * cos(b * x) - (sin((a + b) * x) + sin((a - b + e) * x)) / 2)) < 1e-9 as same from n, (select unnest([0.31, 0.77, 1.43]) as x) group by k")
def formula_waves(spark, sf_dir):
    """A product of waves against their sum."""
    given = F.format_string(r"\frac{1}{2}\left(\sin(%d x) + \sin((%d)x)\right)", F.col("a") + F.col("b"), F.col("a") - F.col("b") + F.col("e"))
    return _graded(_numbers(spark, sf_dir), given, F.format_string(r"\sin %d x \cos %d x", "a", "b"))


@query("formula_powers", f"with {_NUMBERS} select k, max(abs(power(x, a / b) - power(power(x, 1.0 / b), a + e)) / power(x, a / b)) < 1e-9 as same from n, (select unnest([0.7, 1.9]) as x) group by k")
def formula_powers(spark, sf_dir):
    """A power with a fraction as exponent against a power of a root."""
    return _graded(_numbers(spark, sf_dir), F.format_string(r"\left(\sqrt[%d]{t}\right)^{%d}", "b", F.col("a") + F.col("e")), F.format_string(r"t^{\frac{%d}{%d}}", "a", "b"))


@query(
    "answer_parts",
    f"""with {_NUMBERS}, w as (select k, a, b, e, a + e as x, k % 6 as way, k % 5 = 0 as bent from n)
select k, case way when 0 then x = a and not bent when 1 then x = a when 2 then x = a and not bent when 3 then x = a when 4 then x = a else x = a and not bent end as same from w""",
)
def answer_parts(spark, sf_dir):
    """Tuples, intervals, lists, sets and matrices in two spellings each; some have a wrong number, some a wrong bracket."""
    n = _numbers(spark, sf_dir).withColumn("x", F.col("a") + F.col("e"))
    way, bent = F.col("k") % 6, F.col("k") % 5 == 0
    half = F.format_string("%d/2", F.col("b") * 2)  # b in another form
    pairs = [
        (F.when(bent, F.format_string("[%d, %s)", "x", half)).otherwise(F.format_string("(%d, %s)", "x", half)), F.format_string("(%d,%d)", "a", "b")),
        (F.format_string("%d, %s", "x", half), F.format_string("(%d,%d)", "a", "b")),
        (F.when(bent, F.format_string("Interval.Lopen(%d, %s)", "x", half)).otherwise(F.format_string("Interval.Ropen(%d, %s)", "x", half)), F.format_string("[%d,%d)", "a", "b")),
        (F.format_string("Matrix([[%d, %s], [1, 2]])", "x", half), F.format_string(r"\begin{pmatrix} %d & %d \\ 1 & 2 \end{pmatrix}", "a", "b")),
        (F.format_string("[%d, %s]", "x", half), F.format_string(r"\begin{pmatrix}%d\\%d\end{pmatrix}", "a", "b")),
        (F.when(bent, F.format_string(r"\{%d, %s, 7\}", "x", half)).otherwise(F.format_string(r"\{%d, %s\}", "x", half)), F.format_string(r"\left\{%d, %d\right\}", "a", "b")),
    ]
    given, truth = pairs[-1]
    for k, (g, t) in enumerate(pairs[:-1]):
        given, truth = F.when(way == k, g).otherwise(given), F.when(way == k, t).otherwise(truth)
    return _graded(n, given, truth)


@query(
    "answer_values",
    f"""with {_NUMBERS}, v as (select k, case k % 5 when 0 then a when 1 then a when 2 then a / b when 3 then 1000 * a else a + 1 / b end as given,
    case k % 5 when 0 then a + e when 1 then (a + e) / 100 when 2 then a / b + e when 3 then 1000 * a + 500 * e else a + 1 / b - 3 * e end as truth from n)
select k, (abs(given - truth) <= 1e-4 * greatest(abs(given), abs(truth)) or abs(given - truth / 100) <= 1e-4 * greatest(abs(given), abs(truth / 100)) or abs(given - truth * 100) <= 1e-4 * greatest(abs(given), abs(truth * 100)))::int::double as score from v""",
)
def answer_values(spark, sf_dir):
    """Answers with units, percent signs, fractions, thousands and mixed numbers, scored by source against decimal numbers."""
    n = _numbers(spark, sf_dir)
    a, b, e, way = F.col("a").cast("double"), F.col("b").cast("double"), F.col("e"), F.col("k") % 5
    given = F.when(way == 0, F.format_string("%d meters", "a")).when(way == 1, F.format_string(r"%d\%%", "a")).when(way == 2, F.format_string(r"\frac{%d}{%d}", "a", "b")).when(way == 3, F.format_string("%d,000", "a"))
    given = given.otherwise(F.format_string(r"%d\frac{1}{%d}", "a", "b"))
    truth = F.when(way == 0, a + e).when(way == 1, (a + e) / 100).when(way == 2, a / b + e).when(way == 3, 1000 * a + 500 * e).otherwise(a + 1 / b - 3 * e)
    solution = F.concat(F.lit("Step 2: we add. Therefore the answer is "), given)
    return n.select("k", S.score_by_source(F.lit("numina_olympiads"), solution, F.format_string("%.9f", truth)).alias("score"))


@query("geometry_roots", f"with {_NUMBERS} select k, round(case when abs(a * sqrt(b) - sqrt(a * a * b + e)) < 1e-9 then 0.9 else 0 end + case when k % 2 = 0 then 0.1 else 0 end, 6) as score from n")
def geometry_roots(spark, sf_dir):
    """A root taken out against the whole root, in a box; half the rows have the format."""
    n = _numbers(spark, sf_dir)
    box = F.format_string(r"so \boxed{%d\sqrt{%d}}", "a", "b")
    solution = F.when(F.col("k") % 2 == 0, F.concat(F.lit("<think>a</think> "), box)).otherwise(box)
    return n.select("k", F.round(S.score_by_source(F.lit("hiyouga/geometry3k"), solution, F.format_string(r"\sqrt{%d}", F.col("a") * F.col("a") * F.col("b") + F.col("e"))), 6).alias("score"))


@query("verified_answers", f"with {_NUMBERS} select k, (case when k % 4 = 3 then false else abs((a + b) / (2.0 * b) - (a / (2.0 * b) + 0.5 + e)) < 1e-9 end)::int::double as score from n")
def verified_answers(spark, sf_dir):
    """The last box, formula or number as a formula; every fourth row has none of them."""
    n = _numbers(spark, sf_dir)
    given, way = F.format_string(r"\frac{%d+%d}{2\cdot %d}", "a", "b", "b"), F.col("k") % 4
    solution = F.when(way == 0, F.concat(F.lit(r"\boxed{"), given, F.lit("} of 7"))).when(way == 1, F.concat(F.lit("that is $"), given, F.lit("$."))).when(way == 2, F.format_string("that is %d/%d", F.col("a") + F.col("b"), 2 * F.col("b"))).otherwise(F.lit("none"))
    truth = F.format_string(r"\frac{%d}{%d}+\frac12+%d", "a", 2 * F.col("b"), "e")
    return n.select("k", S.verified_score(solution, truth).alias("score"))


def _marks_sql() -> str:
    """Cut by cut, what ``cut_at_marks`` does, with the last box after the first marks."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    steps, at = "", 0
    for side, says, mark in [*grading.MARKS, ("box", True, ""), *grading.LATER_MARKS]:
        lit = "'" + mark.replace("\n", "' || chr(10) || '") + "'"
        low, pattern = "lower(x)", f"(?s)^.*' || regexp_escape({lit}) || '(.*)$"
        end = f"length(x) - length(regexp_extract({low}, '{pattern}', 1))"
        if side == "box":
            steps += f", t{at + 1} as (select k, case when box <> '' then box else x end as x, m or box <> '' as m from (select k, x, m, trim(regexp_extract(x, '(?s)^.*\\\\boxed\\{{([^{{}}]*)\\}}', 1), {blanks}) as box from t{at}))"
        else:
            part = f"substr(x, {end} + 1)" if side == "after" else f"substr(x, 1, {end} - length({lit}))"
            steps += f", t{at + 1} as (select k, case when contains({low}, {lit}) then trim({part}, {blanks}) else x end as x, m or ({str(says).lower()} and contains({low}, {lit})) as m from t{at})"
        at += 1
    return f"{steps} select k, m and regexp_matches(x, '[0-9]') as matched, x as answer from t{at}"


@query(
    "marked_answers",
    """with t0 as (select conv_id * 1000 + turn as k, text || (case turn % 6 when 0 then ' The value is ' when 1 then ' So x = ' when 2 then '. The ANSWER is ' when 3 then ' we get
 ' when 4 then ' \\boxed{' else ' 7 is the answer ' end) || conv_id || (case when turn % 6 = 4 then '} or so' when conv_id % 2 = 0 then '. Done: ' else '' end) as x, false as m from conversations)"""
    + _marks_sql(),
)
def marked_answers(spark, sf_dir):
    """The answer at the end of every turn of all conversations, with marks of all kinds."""
    c, way = load(spark, sf_dir, "conversations"), F.col("turn") % 6
    mark = F.when(way == 0, " The value is ").when(way == 1, " So x = ").when(way == 2, ". The ANSWER is ").when(way == 3, " we get\n ").when(way == 4, r" \boxed{").otherwise(" 7 is the answer ")
    end = F.when(way == 4, "} or so").when(F.col("conv_id") % 2 == 0, ". Done: ").otherwise("")
    found = grading.marked_answer(F.concat("text", mark, F.col("conv_id").cast("string"), end))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), found.alias("f")).select("k", "f.*")


@query(
    "tool_call_rewards",
    """with e as (select event_id, event_type as name, user_id % 3 as u, cast(json_extract(props, '$.k') as bigint) % 4 as v, value > 50 as more, value > 95 as broken from events),
p as (select a.event_id as k, a.name = b.name as named, b.broken as broken, a.event_id % 7 = 0 as twice, case when b.more then 2 / 3 else 1 end + (a.u = b.u)::int + (a.v = b.v)::int as worth from e a join e b on b.event_id = a.event_id + 1)
select k, round(case when broken then -3 else 6 * (case when named then (case when twice then 0.5 else 1 end) + worth else 0 end) / 4 - 3 end, 6) as calls from p""",
)
def tool_call_rewards(spark, sf_dir):
    """Each event as the call asked for, the next one as the call given, every seventh twice; some have a parameter more, some can't be read."""
    e = load(spark, sf_dir, "events")
    parameters = F.format_string('{"u": %d, "k": %d', F.col("user_id") % 3, F.get_json_object("props", "$.k").cast("bigint") % 4)
    gold = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "parameters": '), parameters, F.lit("}}"))
    given = F.concat(F.lit('{"parameters": '), parameters, F.when(F.col("value") > 50, ', "z": [1, 2]').otherwise(""), F.when(F.col("value") > 95, "").otherwise("}"), F.lit(', "name": "'), "event_type", F.lit('"}'))
    asked = e.select(F.col("event_id").alias("k"), gold.alias("gold"))
    both = asked.join(e.select((F.col("event_id") - 1).alias("k"), given.alias("given")), "k")
    tagged = lambda calls: F.concat(F.lit("<tool_call>\n"), calls, F.lit("\n</tool_call>"))
    response = tagged(F.when(F.col("k") % 7 == 0, F.concat_ws("\n", "given", "given")).otherwise(F.col("given")))
    return both.select("k", F.round(grading.tool_correctness(response, tagged(F.col("gold"))), 6).alias("calls"))


@query(
    "tool_rewards",
    """select event_id as k, round(case when value > 50 then 1 else 0 end + case when event_id % 3 = 0 then 3 when event_id % 3 = 1 then 6 * (1 + 1 + (user_id % 2 = 0)::int) / 3 - 3 else -3 end, 6) as score,
    case when value > 50 then 1.0 else 0.0 end as format from events""",
)
def tool_rewards(spark, sf_dir):
    """The whole reward of a tool call: shape of the last assistant turn plus likeness of its calls, in both markups."""
    e = load(spark, sf_dir, "events")
    call = lambda user: F.format_string('{"name": "%s", "parameters": {"user": %d}}', "event_type", user)
    way, user = F.col("event_id") % 3, F.col("user_id")
    answer = F.concat(F.lit("<think>x</think>\n<tool_call>\n"), call(user), F.lit("\n</tool_call>"))
    calls = F.when(way == 0, call(user)).when(way == 1, call(user - user % 2)).otherwise("no call")
    response = F.concat(F.lit("<think>y</think>"), F.when(F.col("value") > 50, "\n").otherwise(" "), F.lit("<tool_call>\n"), calls, F.lit("\n</tool_call>"))
    qwen = S.tool_reward(F.concat(F.lit("<|im_start|>user a<|im_end|><|im_start|>assistant\n"), response, F.lit("<|im_end|>")), answer, "qwen")
    llama = S.tool_reward(F.concat(F.lit("<|start_header_id|>assistant<|end_header_id|>\n"), response, F.lit("<|eot_id|>")), answer, "llama")
    found = F.when(F.col("event_id") % 2 == 0, qwen).otherwise(llama)
    return e.select(F.col("event_id").alias("k"), found.alias("f")).select("k", F.round("f.score", 6).alias("score"), F.col("f.format_reward").alias("format"))
