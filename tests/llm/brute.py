"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORDS = re.compile("[^\x20\x09-\x0d]+")


def quality_base(text: str | None) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            inside |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    found = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def iban_remainder(value: str) -> int:
    x = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def holds(expression: str, value: str, digits: str, secret: str) -> bool:
    """A labeler's SQL condition, in Python."""
    import regex

    if expression.startswith("aggregate("):
        return iban_remainder(value) == 1
    x = re.sub(r"(lower\(value\)|value|digits|secret) rlike ('[^']*')", r"has(\2, \1)", expression)
    x = x.replace("lower(value)", "value.lower()").replace("luhn_check(", "luhn(").replace("length(", "len(")
    x = re.sub(r"len\((\w+)\) between (\d+) and (\d+)", r"(\2 <= len(\1) <= \3)", x)
    names = {"value": value, "digits": digits, "secret": secret, "true": True, "false": False, "luhn": luhn, "len": len, "has": lambda p, v: bool(regex.search(p, v))}
    return bool(eval(x, {"__builtins__": {}}, names))  # noqa: S307  the module's own expressions


def candidates(text: str | None, kinds) -> list[dict]:
    """Valid spans of each kind in order, with votes and features."""
    import regex

    text, found = text or "", []
    for kind in kinds:
        before = 0
        for m in regex.finditer(kind.pattern, text):
            value, gap = m[0], text[before : m.start()]
            before = m.end()
            digits, left = re.sub("[^0-9]", "", value), gap[-40:]
            tail = re.search(r"[A-Za-z0-9_./+=-]+$", value)
            told = (value, digits, tail[0] if tail else "")
            if not holds(kind.valid, *told):
                continue
            fake = any(regex.search(kind.placeholder, x) for x in (value, digits))
            found.append({
                "kind": kind.name, "start": m.start(), "end": m.end(), "shape": 1 if holds(kind.shape, *told) else -1, "gazetteer": int(holds(kind.gazetteer, *told)),
                "context": int(bool(regex.search(kind.context, left.lower()))), "placeholder": -1 if fake else 0, "length_bin": min(3, len(value) // 12), "digit_bin": min(3, 4 * len(digits) // max(1, len(value))),
                "upper": int(bool(re.search("[A-Z]", value))), "spaced": int(" " in value), "quoted": int(bool(re.search(r"[\"'=(<]$", left))), "line_start": int(left == "" or left.endswith("\n")),
            })
    return found
