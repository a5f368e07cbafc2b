"""Conversations, tool calls and placeholders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from .arrays import fit_length

CALL = "array<struct<name:string,arguments:string>>"


def tool_calls(text: Column) -> Column:
    """Calls between <tool_call> tags whose JSON has a name; others are passed over."""
    raw = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(raw, lambda r: F.struct(F.get_json_object(r, "$.name").alias("name"), F.get_json_object(r, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def without_calls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<tool_call>(.*?)</tool_call>", "")


def channel_calls(text: Column) -> Column:
    """Calls of the channel format: ``to=functions.NAME ... json<|message|>ARGS<|call|>``; analysis is dropped first."""
    clean = F.regexp_replace(text, r"(?s)<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
    pattern = r"(?s)to=functions\.([A-Za-z0-9_.-]+)(?:(?!to=functions\.).)*?json<\|message\|>(.*?)<\|call\|>"
    names, arguments = (F.regexp_extract_all(clean, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(names, arguments, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))


def xml_calls(text: Column) -> Column:
    """Calls of ``<function=NAME><parameter=KEY>VALUE</parameter></function>``; the last may lack its end."""
    calls = F.regexp_extract_all(text, F.lit(r"(?s)<function=(.*?)(?:</function>|$)"), F.lit(1))

    def one(c: Column) -> Column:
        keys = F.regexp_extract_all(c, F.lit(r"(?s)<parameter=([^>]*)>\n?(.*?)\n?(?:</parameter>|(?=<parameter=)|$)"), F.lit(1))
        values = F.regexp_extract_all(c, F.lit(r"(?s)<parameter=([^>]*)>\n?(.*?)\n?(?:</parameter>|(?=<parameter=)|$)"), F.lit(2))
        return F.struct(F.substring_index(c, ">", 1).alias("name"), F.to_json(F.map_from_entries(F.zip_with(keys, values, lambda k, v: F.struct(k, v)))).alias("arguments"))

    return F.transform(calls, one)


#: Beginnings or names of parameter types of XML calls (fixed values).
_TEXT_TYPES = ("string", "str", "text", "varchar", "char", "enum")
_WHOLE_TYPES = ("int", "uint", "long", "short", "unsigned")
_TRUTH_TYPES = ("boolean", "bool", "binary")


def _typed(value: str, kind: str):
    """A parameter's text as its schema's type says; what can't be read as a number or object stays text."""
    import ast
    import json

    kind = kind.strip().lower()
    if value.lower() == "null":
        return None
    if kind in _TEXT_TYPES:
        return value
    if kind in _TRUTH_TYPES:
        return value.lower() == "true"
    try:
        if kind.startswith(_WHOLE_TYPES):
            return int(value)
        if kind.startswith(("num", "float")):
            number = float(value)
            return int(number) if number.is_integer() else number
    except (ValueError, OverflowError):
        return value
    for read in (json.loads, ast.literal_eval):
        try:
            return read(value)
        except (ValueError, SyntaxError):
            continue
    return value


def typed_xml_calls(text: Column, schemas: dict[str, dict[str, str]]) -> Column:
    """As xml_calls, with parameters in the types of ``schemas`` (tool to parameter to type); unknown ones stay text."""
    import json

    @pandas_udf("array<string>")
    def convert(names, arguments):
        import pandas as pd

        out = []
        for own, raw in zip(names, arguments, strict=True):
            rows = []
            for name, one in zip(own if own is not None else [], raw if raw is not None else [], strict=True):
                kinds = schemas.get(name, {})
                given = json.loads(one) if one else {}
                rows.append(json.dumps({k: _typed(v, kinds.get(k, "string")) for k, v in given.items()}, ensure_ascii=False))
            out.append(rows)
        return pd.Series(out)

    calls = xml_calls(text)
    names = F.transform(calls, lambda c: c["name"])
    return F.zip_with(names, convert(names, F.transform(calls, lambda c: c["arguments"])), lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))


@udtf(returnType="call_no int, name string, arguments string")
class ParseToolCalls:
    """One row a tool call of a text."""

    def eval(self, text: str):
        import json
        import re

        k = 0
        for raw in re.findall(r"(?s)<tool_call>(.*?)</tool_call>", text or ""):
            try:
                call = json.loads(raw)
                name, arguments = call["name"], json.dumps(call["arguments"])
            except (ValueError, KeyError, TypeError):
                continue
            yield k, name, arguments
            k += 1


def clip_response(text: Column, length: int, side: str = "middle") -> Column:
    """A tool's answer of at most ``length`` characters: head, tail, or both ends around a mark."""
    cut = {
        "left": F.concat(F.left(text, F.lit(length)), F.lit("...(truncated)")),
        "right": F.concat(F.lit("(truncated)..."), F.right(text, F.lit(length))),
        "middle": F.concat(F.left(text, F.lit(length // 2)), F.lit("...(truncated)..."), F.right(text, F.lit(length // 2))),
    }[side]
    return F.when(F.length(text) > length, cut).otherwise(text)


def passages(contents: Column) -> Column:
    """Numbered passages, the first line being the title."""
    lines = F.transform(
        contents,
        lambda c, k: F.concat(F.lit("Doc "), (k + 1).cast("string"), F.lit(" (Title: "), F.substring_index(c, "\n", 1), F.lit(")\n"), F.substr(c, F.length(F.substring_index(c, "\n", 1)) + 2)),
    )
    return F.array_join(lines, "\n\n")


def render_chat(messages: Column, generation: bool = False, template: tuple[str, str, str] = ("<|im_start|>", "\n", "<|im_end|>\n")) -> Column:
    """Messages in a chat markup, with the assistant's opening if ``generation``."""
    start, middle, end = (F.lit(x) for x in template)
    text = F.array_join(F.transform(messages, lambda m: F.concat(start, m["role"], middle, m["content"], end)), "")
    return F.concat(text, start, F.lit("assistant"), middle) if generation else text


def assistant_mask(messages: Column, lengths: Column) -> Column:
    """1 for each token of assistant messages, given each message's number of tokens."""
    return F.flatten(F.zip_with(messages, lengths, lambda m, n: F.array_repeat(F.when(m["role"] == "assistant", 1).otherwise(0), n)))


def split_placeholders(content: Column, media: Column | None = None) -> Column:
    """Content cut at <image> and <video>, without empty parts."""
    parts = F.split(content, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)")
    typed = F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), p.alias("text")))
    kept = F.filter(typed, lambda p: p["text"] != "")
    if media is None:
        return kept
    n = F.regexp_count(content, F.lit("<image>|<video>"))
    return F.when(n != F.size(media), F.raise_error(F.lit("placeholders and media differ in number")).cast("array<struct<type:string,text:string>>")).otherwise(kept)


def mask_text(text: Column, patterns: list[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "*")
    return text


def sanitize_key(key: Column) -> Column:
    """A metric name that trackers accept."""
    x = F.replace(key, F.lit("@"), F.lit("_at_"))
    return F.regexp_replace(F.regexp_replace(x, "/+", "/"), r"[^/A-Za-z0-9_.\- :]", "_")


def metrics_line(step: Column, metrics: Column) -> Column:
    """``step:N - key:value - ...``"""
    parts = F.transform(F.array_sort(F.map_entries(metrics)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return F.concat(F.lit("step:"), step.cast("string"), F.lit(" - "), F.array_join(parts, " - "))


def hellaswag_clean(text: Column) -> Column:
    x = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(x, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def message_tokens(ids: Column, index: Column, role: Column, system: int, generation: int) -> Column:
    """Struct (ids, mask) of one rendered message of a conversation.

    The template's system prefix, ``system`` ids long, goes from all messages but the first and system ones; of an
    assistant's message all ids but the ``generation`` that open it are learned.
    """
    own = F.when((index != 0) & (role != "system"), F.slice(ids, F.lit(system + 1), F.greatest(F.lit(0), F.size(ids) - system))).otherwise(ids)
    mask = F.transform(own, lambda _, k: F.when((role == "assistant") & (k >= generation), 1).otherwise(0))
    return F.struct(own.alias("ids"), mask.alias("mask"))


def preference_pair(prompt: Column, chosen: Column, rejected: Column, end: int | None, length: int, pad: int) -> Column:
    """Struct (ids, mask) of two rows each, chosen first: prompt and answer with its end, padded or cut on the right."""
    both = [F.concat(prompt, a, F.array(F.lit(end))) if end is not None else F.concat(prompt, a) for a in (chosen, rejected)]
    ids = [fit_length(x, length, pad, left_pad=False, truncation="right") for x in both]
    masks = [fit_length(F.transform(x, lambda _: F.lit(1)), length, 0, left_pad=False, truncation="right") for x in both]
    return F.struct(F.array(*ids).alias("ids"), F.array(*masks).alias("mask"))


def scorer_prompt(messages: Column, response: Column, end: str = "", begin: str = "", template: tuple[str, str, str] = ("<|im_start|>", "\n", "<|im_end|>\n")) -> Column:
    """The conversation with the response (without its end mark) as last turn, rendered, without a begin mark in front."""
    answer = F.replace(response, F.lit(end), F.lit("")) if end else response
    text = render_chat(F.concat(messages, F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content")))), template=template)
    return F.when(text.startswith(begin), F.substr(text, F.lit(len(begin) + 1))).otherwise(text) if begin else text


# ---- looking at dumps


def by_score(df, descending: bool = True, order: str = "row_id"):
    """Rows by score, else score_1, else 0; rows alike stay in their order."""
    there = [F.col(c).cast("double") for c in ("score", "score_1") if c in df.columns]
    value = F.coalesce(*there, F.lit(0.0))
    return df.orderBy(value.desc() if descending else value.asc(), order)


def find_request(df, request: str, order: list[str]):
    """The first row with the request id, dashes apart."""
    return df.where(F.replace(F.col("request_id"), F.lit("-"), F.lit("")) == request.replace("-", "")).orderBy(*order).limit(1)


def search_lines(df, column: str, words: str, keys: list[str]):
    """``keys``, line_no from 0 and line of each line that contains ``words``."""
    lines = df.where(F.contains(F.col(column), F.lit(words))).select(*keys, F.posexplode(F.split(F.col(column), "\n")).alias("line_no", "line"))
    return lines.where(F.contains(F.col("line"), F.lit(words)))


def split_on(text: Column, words: str) -> Column:
    """The parts between occurrences of ``words``, which are taken literally."""
    import re

    return F.split(text, re.escape(words), -1)
