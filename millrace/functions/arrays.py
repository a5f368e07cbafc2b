"""Column functions on token arrays: masked statistics, divergences, padding, scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(x: Column) -> Column:
    """Sum of an array; an empty one has 0."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def count_on(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, v: a + v)


def masked_sum(x: Column, mask: Column) -> Column:
    """Sum where the mask is set; values under a mask of 0 don't count even if they are NaN."""
    return total(F.zip_with(x, mask, lambda v, m: F.when(m != 0, v * m).otherwise(F.lit(0.0))))


def masked_mean(x: Column, mask: Column, eps: float = 1e-8) -> Column:
    return masked_sum(x, mask) / (count_on(mask) + eps)


def masked_var(x: Column, mask: Column, unbiased: bool = True) -> Column:
    """Mean of centred squares with Bessel's correction; it needs two unmasked values, or one if biased."""
    mean = masked_mean(x, mask)
    n = count_on(mask)
    var = masked_mean(F.transform(x, lambda v: (v - mean) * (v - mean)), mask)
    least = 2 if unbiased else 1
    checked = F.when(n < least, F.raise_error(F.lit("masked_var needs more unmasked values")).cast("double")).otherwise(var)
    return checked * n / (n - 1) if unbiased else checked


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def elementwise(x: Column, y: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(x, y, f)


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    """Per-value divergence; ``kind`` is one of the documented names, a trailing + is ignored (it concerns gradients)."""
    name = kind.rstrip("+")
    if name in ("kl", "k1"):
        return logp - ref
    if name == "abs":
        return F.abs(logp - ref)
    if name in ("mse", "k2"):
        return 0.5 * (logp - ref) * (logp - ref)
    if name in ("low_var_kl", "k3"):
        d = clamp(ref - logp, -20.0, 20.0)
        return clamp(F.exp(d) - d - 1, -10.0, 10.0)
    raise NotImplementedError(f"no such divergence: {kind}")


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    return F.zip_with(logp, ref, lambda a, b: kl_estimate(a, b, kind))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of a logits array."""
    top = F.array_max(logits)
    norm = F.log(total(F.transform(logits, lambda v: F.exp(v - top)))) + top
    return norm - total(F.transform(logits, lambda v: F.exp(v - norm) * v))


def sum_pi_squared(logits: Column) -> Column:
    top = F.array_max(logits)
    once = total(F.transform(logits, lambda v: F.exp(v - top)))
    twice = total(F.transform(logits, lambda v: F.exp(2 * (v - top))))
    return twice / (once * once)


def logprob_of(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    return F.element_at(logits, label + 1) - (F.log(total(F.transform(logits, lambda v: F.exp(v - top)))) + top)


#: Elements of a block of a scan.
_BLOCK = 128


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], value: str = "out") -> Column:
    """Fold from the first element; ``step`` returns the next state, whose field ``value`` is gathered for each element.

    Elements are taken block by block, so that the arrays that grow with each step stay short and time is linear in the
    length.
    """
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * _BLOCK + 1, _BLOCK))

    def through(states: Column, block: Column) -> Column:
        carried = F.array(F.element_at(F.element_at(states, -1), -1))
        return F.concat(states, F.array(F.aggregate(block, carried, lambda own, x: F.concat(own, F.array(step(F.element_at(own, -1), x))))))

    done = F.aggregate(blocks, F.array(F.array(start)), through)
    # Each block's first state is the one carried into it.
    states = F.flatten(F.transform(F.slice(done, F.lit(2), F.size(done)), lambda own: F.slice(own, F.lit(2), F.size(own))))
    return F.transform(states, lambda s: s[value])


def reverse_scan(items: Column, start: Column, step: Callable[[Column, Column], Column], value: str = "out") -> Column:
    """The same from the last element, results being in the array's order."""
    return F.reverse(scan(F.reverse(items), start, step, value))


def pad_right(a: Column, length: int | Column, value) -> Column:
    """Unchanged if it is long enough already."""
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(length) - F.size(a)).cast("int")))


def pad_left(a: Column, length: int | Column, value) -> Column:
    return F.concat(F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(length) - F.size(a)).cast("int")), a)


def truncate(a: Column, length: int, how: str) -> Column:
    """``left`` keeps the tail, ``right`` the head, ``middle`` length // 2 of the head and the rest of the tail, ``error`` fails."""
    n = F.size(a)
    if how == "left":
        cut = F.slice(a, F.greatest(F.lit(1), n - length + 1), F.lit(length))
    elif how == "right":
        cut = F.slice(a, 1, length)
    elif how == "middle":
        head, tail = length // 2, length - length // 2
        cut = F.concat(F.slice(a, 1, head), F.slice(a, F.greatest(F.lit(1), n - tail + 1), F.lit(tail)))
    elif how == "error":
        return F.when(n > length, F.raise_error(F.concat(F.lit(f"more than {length} values: "), n.cast("string")))).otherwise(a)
    else:
        raise ValueError(f"unknown truncation: {how}")
    return F.when(n > length, cut).otherwise(a)


def fit_length(a: Column, length: int, pad, left_pad: bool = True, truncation: str = "error") -> Column:
    """Exactly ``length`` values: padded at one side, or truncated."""
    cut = truncate(a, length, truncation)
    return pad_left(cut, length, pad) if left_pad else pad_right(cut, length, pad)


def drop_left_pad(ids: Column, mask: Column) -> Column:
    n = count_on(mask)
    return F.slice(ids, F.size(ids) - n + 1, n)


def compact(x: Column, mask: Column) -> Column:
    """Values whose mask is set."""
    return F.transform(F.filter(F.arrays_zip(x.alias("x"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["x"])


def position_ids(mask: Column) -> Column:
    """Running count of the mask less one, not under 0."""
    running = scan(mask, F.struct(F.lit(0).alias("out")), lambda s, m: F.struct((s["out"] + m).cast("int").alias("out")))
    return F.transform(running, lambda n: F.greatest(F.lit(0), n - 1))


def mask_through_first(values: Column, ends: list[int]) -> Column:
    """1 up to and with the first of ``ends``; all ones if none is there."""
    hit = F.array_min(F.transform(F.array(*[F.lit(e) for e in ends]), lambda e: F.nullif(F.array_position(values, e), F.lit(0).cast("bigint"))))
    return F.transform(values, lambda v, k: F.when(hit.isNull() | (k < hit), 1).otherwise(0))


def shifted_response(values: Column, offset: Column, length: Column) -> Column:
    """The values that predict a response: one place earlier than the response itself."""
    return F.slice(values, offset, length)


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Shared count over joint count of two string arrays; two equal ones have 1, one empty 0."""
    distinct = F.array_intersect(a, b)

    def times(x: Column, v: Column) -> Column:
        return F.size(F.filter(x, lambda w: w == v))

    shared = F.aggregate(F.transform(distinct, lambda v: F.least(times(a, v), times(b, v))), F.lit(0), lambda s, v: s + v)
    return F.when(F.array_sort(a) == F.array_sort(b), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0)))


def expand(value: Column, like: Column) -> Column:
    """A row's value at each place of an array."""
    return F.array_repeat(value, F.size(like))


def cut_response(values: Column, mask: Column) -> Column:
    """Padded values cut to the response's true length."""
    return F.slice(values, F.lit(1), count_on(mask))


def pad_rows(rows: Column, left: int | Column, right: int | Column, value, width: int) -> Column:
    """A matrix with rows of ``value`` before and after."""
    row = F.array_repeat(F.lit(value), width)
    return F.concat(F.array_repeat(row, F.lit(left).cast("int")), rows, F.array_repeat(row, F.lit(right).cast("int")))


def token_ids(value: Column, kind: str) -> Column:
    """Flat ids from a flat array, an array with one array, or a struct that has them as input_ids; ``kind`` is the type's text."""
    if kind.startswith("struct"):
        value, kind = value["input_ids"], kind.split("input_ids:", 1)[1]
    if kind.startswith("array<array"):
        one = F.when(F.size(value) == 1, value[0]).otherwise(F.raise_error(F.lit("several rows of ids")).cast("array<bigint>"))
        return F.transform(one, lambda x: x.cast("bigint"))
    return F.transform(value, lambda x: x.cast("bigint"))


def system_prefix(one: Column, two: Column) -> Column:
    """Ids in front of the turns, from those of one and of two equal turns."""
    return F.slice(one, F.lit(1), F.size(one) - (F.size(two) - F.size(one)))


def generation_prompt(plain: Column, opened: Column) -> Column:
    """Ids that open an answer, from those of a turn without and with them."""
    return F.slice(opened, F.size(plain) + 1, F.size(opened))
