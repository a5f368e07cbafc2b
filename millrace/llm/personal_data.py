"""Personal data: weak labelers, their reliabilities by expectation-maximisation, and a span classifier.

The path over documents uses SQL functions only. What comes to the driver are counts of vote and
feature patterns, whose number depends on the labelers and not on the corpus.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, materialize, replace_column, table

CONTEXT_CHARS = 40
THRESHOLD = 0.5
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """A candidate pattern and what its labelers look for (all regular expressions of Java's)."""

    name: str
    pattern: str
    #: A cheap test of the whole text without which the pattern can't match.
    guard: str
    #: What a match must be besides, on ``value`` and ``digits``.
    valid: str = "true"
    base: bool = False
    #: Labelers: +1 if the expression holds, -1 if not; gazetteer and context abstain instead of -1.
    shape: str = "true"
    gazetteer: str = "false"
    context: str = "$^"
    placeholder: str = "$^"


_LOCAL = "[A-Za-z0-9._%+-]"
#: The check of an IBAN: country and check digits last, letters as two digits from 10 on, remainder 1 by 97.
_MOD_97 = (
    "aggregate(split(concat(substring(replace(value, ' ', ''), 5), substring(replace(value, ' ', ''), 1, 4)), ''), 0, "
    "(a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"
)
_FAKE_DIGITS = "^(.)\\1+$|^0?123456789?0?|^0+$"
#: Gazetteers and context words.
TOP_LEVEL = "com|org|net|edu|gov|io|de|fr|es|it|uk|eu|ch|at|nl|be|pl|pt|mx|ar|br|ca|us|info|biz"
GIVEN_NAMES = (
    "anna|anne|antonio|carlos|carmen|charles|claire|david|elena|elizabeth|emma|fatima|francois|friedrich|hans|heinrich|"
    "james|jan|jean|jennifer|jose|juan|julia|karl|klaus|laura|lisa|lucia|luis|maria|marie|mark|mary|michael|miguel|"
    "mohammed|nicolas|olga|paul|peter|pierre|richard|robert|sara|sarah|sofia|sophie|susan|thomas|wolfgang"
)

KINDS: tuple[Kind, ...] = (
    # Each local part is tried from its start only (or from the end of the last match): the leftmost match, in linear time.
    Kind(
        "email",
        rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        base=True,
        shape=r"value rlike '^[^@]{1,64}@[^@]*[.][A-Za-z]{2,}$'",
        gazetteer=rf"lower(value) rlike '[.]({TOP_LEVEL})$'",
        context="mail|contact|kontakt|contacto|courriel|correo|write to|schreib|écri",
        placeholder="^(user|test|foo|name|noreply|no-reply)@|@(test|localhost)",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "[.][0-9]",
        valid=rf"value rlike '^{_OCTET}([.]{_OCTET}){{3}}$'",
        base=True,
        shape="not value rlike '^(0|127|255)[.]|[.]0{2,}|(^|[.])0[0-9]'",
        gazetteer="value rlike '^(10|172[.](1[6-9]|2[0-9]|3[01])|192[.]168)[.]'",
        context="ip|host|server|from|address|adresse|dirección|client|login",
        placeholder="(?i)version|^[0-9][.][0-9][.][0-9][.][0-9]$",
    ),
    Kind(
        "card",
        r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
        "[0-9]",
        valid="length(digits) between 13 and 19 and luhn_check(digits)",
        base=True,
        shape="length(digits) in (13, 14, 15, 16, 19)",
        gazetteer="digits rlike '^(4|5[1-5]|2[2-7]|3[47]|6(011|5)|3[068]|35)'",
        context="card|karte|carte|tarjeta|visa|master|amex|credit|payment|zahl",
        placeholder=_FAKE_DIGITS,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "[+][0-9]",
        valid="length(digits) between 9 and 15",
        base=True,
        shape="length(digits) between 10 and 13",
        gazetteer="digits rlike '^(1|33|34|39|41|43|44|49|52|54|55|61|81|86|91)'",
        context="tel|phone|call|fon|mobil|móvil|appel|llam|anruf|fax",
        placeholder=_FAKE_DIGITS,
    ),
    Kind(
        "secret",
        r"(?i)(?<![a-z])(?:api[_-]?key|access[_-]?key|auth|token|secret|password|passwd|pwd)[\x22']?[\x20\t]*[:=][\x20\t]*[\x22']?[a-z0-9_./+=-]{8,}",
        "(?i)key|auth|token|secret|passw|pwd",
        shape="length(secret) >= 16 and secret rlike '[0-9]' and secret rlike '[A-Za-z]'",
        gazetteer="secret rlike '^[0-9a-f]{32,}$|^(sk|pk|ghp|xox[bp])[_-]|^AKIA|^eyJ'",
        context="key|secret|login|password|credential|passwort|clave|mot de passe",
        placeholder="(?i)example|changeme|your|xxxx|dummy|placeholder",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "[0-9]-[0-9]",
        shape="not value rlike '^(000|666|9)|-00-|-0000$'",
        context="ssn|social|security|sozial|sécurité|seguridad",
        placeholder=_FAKE_DIGITS,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "[A-Z][0-9][0-9]",
        shape=_MOD_97,
        gazetteer="value rlike '^(DE|FR|ES|IT|GB|CH|AT|NL|BE|PL|PT)'",
        context="iban|konto|account|compte|cuenta|bank",
        placeholder="(?i)^..00",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+().-])(?<![0-9+][\x20])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
        "[0-9]{3}[.-][0-9]{4}",
        shape="not digits rlike '^[01]'",
        context="tel|phone|call|fon|mobil|móvil|appel|llam|anruf|fax",
        placeholder=_FAKE_DIGITS,
    ),
    Kind(
        "person",
        r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)\.?[\x20]\p{Lu}\p{Ll}++(?:[\x20]\p{Lu}\p{Ll}++)?",
        "Mr|Ms|Dr|Prof|Herr|Frau|Mme|Mons|Madame|Sr|Señor",
        shape=r"value rlike '[ ]\\p{Lu}\\p{Ll}{2,}'",
        gazetteer=rf"lower(value) rlike '[ ]({GIVEN_NAMES})([ ]|$)'",
        context="name|dear|liebe|cher|chère|estimad|signed|von|by|gez",
        placeholder="(?i)[ ](example|mustermann|doe)",
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)
LABELERS = ("shape", "gazetteer", "context", "placeholder")
FEATURES = ("length_bin", "digit_bin", "upper", "spaced", "quoted", "line_start")
_BLOCK = 256


def _prefix(values: Column, zero: int, combine) -> Column:
    """Struct of an array's combined entries and the combinations before each entry."""
    start = F.struct(F.lit(zero).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("before"))
    return F.aggregate(
        values,
        start,
        lambda acc, x: F.struct(combine(acc["total"], x).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")),
    )


def _earlier(values: Column, zero: int, combine) -> Column:
    """Combinations of what is before each entry, block by block, so that the appended arrays stay short."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: _prefix(F.slice(values, b * _BLOCK + 1, _BLOCK), zero, combine)
    )
    offsets = _prefix(F.transform(blocks, lambda b: b["total"]), zero, combine)["before"]
    return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["before"], lambda v: combine(v, o))))


def _starts(lengths: Column) -> Column:
    """Sums before each entry."""
    return _earlier(lengths, 0, lambda a, x: a + x)


def _spans(kind: Kind) -> Column:
    """Array of (start, end, value, context) of the columns m_ and g_ of ``kind``; offsets are code points."""
    m, g = F.col(f"m_{kind.name}"), F.col(f"g_{kind.name}")
    steps = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda gap, x: (F.length(gap) + F.length(x)).cast("bigint"))
    return F.transform(
        F.arrays_zip(_starts(steps).alias("at"), F.slice(g, F.lit(1), F.size(m)).alias("gap"), m.alias("value")),
        lambda z: F.struct(
            (z["at"] + F.length(z["gap"])).alias("start"),
            (z["at"] + F.length(z["gap"]) + F.length(z["value"])).alias("end"),
            z["value"].alias("value"),
            F.right(z["gap"], F.lit(CONTEXT_CHARS)).alias("left"),
            F.regexp_replace(z["value"], "[^0-9]", "").alias("digits"),
            F.regexp_extract(z["value"], "[A-Za-z0-9_./+=-]+$", 0).alias("secret"),
        ),
    )


def _within(expression: str) -> str:
    """``expression`` of a Kind, on the fields of the lambda variable x."""
    for name in ("value", "digits", "secret"):
        expression = expression.replace(f"({name}", f"(x.{name}").replace(f"not {name}", f"not x.{name}").replace(f"and {name}", f"and x.{name}")
        if expression.startswith(name):
            expression = "x." + expression
    return expression


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _votes(kind: Kind) -> str:
    """Array of named structs: the spans of ``kind`` that are valid, with votes and features."""
    near = f"lower(x.left) rlike {_literal(kind.context)}"
    return f"""
    transform(filter(s_{kind.name}, x -> {_within(kind.valid)}), x -> named_struct(
        'kind', '{kind.name}', 'start', x.start, 'end', x.end,
        'shape', if({_within(kind.shape)}, 1, -1),
        'gazetteer', if({_within(kind.gazetteer)}, 1, 0),
        'context', if({near}, 1, 0),
        'placeholder', if(x.value rlike {_literal(kind.placeholder)} or x.digits rlike {_literal(kind.placeholder)}, -1, 0),
        'length_bin', least(3, cast(length(x.value) div 12 as int)),
        'digit_bin', least(3, cast(4 * length(x.digits) div greatest(1, length(x.value)) as int)),
        'upper', if(x.value rlike '[A-Z]', 1, 0),
        'spaced', if(x.value rlike '[ ]', 1, 0),
        'quoted', if(x.left rlike '["\\'=(<]$', 1, 0),
        'line_start', if(x.left = '' or x.left rlike '\\n$', 1, 0)))"""


def candidates(df: DataFrame, text_col: str, keep: list[str], kinds=KINDS, out: str = "found") -> DataFrame:
    """``keep`` and ``out``: the array of all candidate spans of each row, kinds in order, then by start.

    Null and empty texts have none, equal texts equal ones; an empty table stays empty; other columns are left out.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = [F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(keep)]
    held = [f"own_{k}" for k in range(len(keep))]
    x = df.select(*own, text.alias("text"))
    none = F.array().cast("array<string>")
    x = x.select("*", *[F.when(F.col("text").rlike(k.guard), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"m_{k.name}") for k in kinds])
    x = x.select(*held, *[f"m_{k.name}" for k in kinds], *[F.when(F.size(f"m_{k.name}") > 0, F.split("text", k.pattern, -1)).alias(f"g_{k.name}") for k in kinds])
    x = x.select(*held, *[F.when(F.col(f"g_{k.name}").isNotNull(), _spans(k)).otherwise(F.slice(_spans(k), 1, 0)).alias(f"s_{k.name}") for k in kinds])
    empty = "array()"
    parts = ", ".join(f"coalesce({_votes(k)}, {empty})" for k in kinds)
    return x.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], F.expr(f"concat({parts})").alias(out))


def pattern_counts(found: DataFrame) -> list[dict]:
    """How often each combination of kind, votes and features occurs, over all spans, in a fixed order."""
    one = found.select(F.explode("found").alias("s")).select("s.kind", *[f"s.{c}" for c in (*LABELERS, *FEATURES)])
    return [r.asDict() for r in sorted(one.groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n")).collect())]


def reliabilities(counts: list[dict], rounds: int = 50) -> dict[tuple, float]:
    """Posterior that a span of (kind, votes) is personal data, with labelers independent given the truth.

    Each labeler's vote distribution given the truth is shared by all kinds, the prior is each
    kind's own; the first estimate is the share of votes in favour. Add-one smoothing.
    """
    table: dict[tuple, int] = defaultdict(int)
    for r in counts:
        table[(r["kind"], *(r[v] for v in LABELERS))] += r["n"]
    posterior = {}
    for key in table:
        votes = key[1:]
        posterior[key] = (1 + sum(v > 0 for v in votes)) / (2 + sum(v > 0 for v in votes) + 2 * sum(v < 0 for v in votes))
    for _ in range(rounds):
        prior: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
        given = [{t: defaultdict(lambda: 1.0) for t in (0, 1)} for _ in LABELERS]
        for key, n in table.items():
            p = posterior[key]
            for truth, share in ((1, p), (0, 1 - p)):
                prior[key[0]][truth] += n * share
                for labeler, vote in zip(given, key[1:], strict=True):
                    labeler[truth][vote] += n * share
        sums = [{t: sum(labeler[t][v] for v in (-1, 0, 1)) for t in (0, 1)} for labeler in given]
        for key in table:
            odds = math.log(prior[key[0]][1] / prior[key[0]][0])
            for labeler, total, vote in zip(given, sums, key[1:], strict=True):
                odds += math.log(labeler[1][vote] / total[1]) - math.log(labeler[0][vote] / total[0])
            posterior[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior


def terms(row: dict) -> list[str]:
    """Names of the classifier's indicator features that hold for a row or span."""
    return ["bias", f"kind={row['kind']}", *(f"{f}={row[f]}" for f in FEATURES), *(f"{v}={row[v]}" for v in LABELERS)]


def train(counts: list[dict], rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier fitted to the posteriors, each pattern weighing as often as it occurs."""
    posterior = reliabilities(counts)
    total = sum(r["n"] for r in counts) or 1
    rows = [(terms(r), posterior[(r["kind"], *(r[v] for v in LABELERS))], r["n"] / total) for r in counts]
    weights: dict[str, float] = {t: 0.0 for names, _, _ in rows for t in names}
    squares = dict.fromkeys(weights, 1e-8)
    for _ in range(rounds):
        slope = {t: decay * w for t, w in weights.items()}
        for names, target, share in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[t] for t in names)))))
            for t in names:
                slope[t] += share * (p - target)
        for t, g in slope.items():
            squares[t] += g * g
            weights[t] -= rate * g / math.sqrt(squares[t])
    return weights


def score(weights: dict[str, float], span: str = "x") -> str:
    """SQL for the classifier's probability of the struct ``span``."""
    parts = [repr(float(weights.get("bias", 0.0)))]
    for name in ("kind", *FEATURES, *LABELERS):
        own = {t.split("=", 1)[1]: w for t, w in weights.items() if t.startswith(f"{name}=")}
        if own:
            cases = " ".join(f"when '{v}' then {float(w)!r}D" for v, w in sorted(own.items()))
            parts.append(f"case cast({span}.{name} as string) {cases} else 0D end")
    return f"1D / (1D + exp(-({' + '.join(p if p.startswith('case') else p + 'D' for p in parts)})))"


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def personal_data(
    df: DataFrame, text_col: str = "text", out: str = "personal_data", kinds=KINDS, threshold: float = THRESHOLD, keep: list[str] | None = None
) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``out``: the spans of personal data of each whole text, kinds in the order of ``kinds``, then by start.

    Spans of base kinds are all kept; others need a score of at least ``threshold``. Null and empty texts
    have no span; repeated rows get equal spans; an empty table stays empty (nothing is trained); a column
    named ``out`` is replaced. Candidates are found once and written; labelers' counts are aggregated from
    all of them. No row is shuffled, so no source or copy can be hot.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    held = free_name(df, "__found__")
    found = materialize(candidates(df, text_col, keep, kinds, held), "spans")
    weights = train(pattern_counts(found.select(F.col(held).alias("found"))))
    base = ", ".join(f"'{k.name}'" for k in kinds if k.base)
    scored = f"transform({held}, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'score', {score(weights)}))"
    spans = F.expr(f"cast(filter({scored}, x -> x.kind in ({base}) or x.score >= {threshold}) as {SPANS})")
    return replace_column(found, out, spans).drop(held)


def written(spans: str, kinds: str = "true") -> str:
    """SQL for spans as kind:start:end, comma-joined."""
    return f"array_join(transform(filter({spans}, x -> {kinds}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


#: Code points that redaction looks at together.
_SHEET = 4096


def redact(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``df`` with each span of its texts replaced by its kind in angle brackets; spans that overlap become one.

    ``text_col`` is found as Spark finds names, in any case of letters; if there is no such column, or several, an error is
    raised. A null text stays null and an empty one empty; equal texts are changed alike; an empty table stays empty; other
    columns pass through, whatever their names. A text with spans is cut into sheets of ``_SHEET`` code points, in each of
    which only its own spans are looked for.
    """
    named = [c for c in df.columns if c.lower() == text_col.lower()]
    if len(named) != 1:
        raise ValueError(f"{len(named)} columns are named {text_col}")
    found, merged = free_name(df, "__personal_data__"), free_name(df, "__merged__")
    marked = personal_data(df, named[0], found, **options)
    ordered = f"array_sort({found}, (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 when a.end > b.end then -1 when a.end < b.end then 1 else 0 end)"
    cut = marked.withColumn(merged, F.expr(f"case when size({found}) > 0 then {ordered} end"))
    cut = cut.withColumn(merged, F.when(F.col(merged).isNotNull(), _disjoint(F.col(merged))))
    return cut.select(*[_redacted(F.col(f"`{c}`"), F.col(merged)).alias(c) if c == named[0] else F.col(f"`{c}`") for c in df.columns])


def _disjoint(spans: Column) -> Column:
    """Sorted spans (start, end, kind) without what earlier ones cover; the kind of one that goes on from another is null."""
    reach = _earlier(F.transform(spans, lambda x: x["end"]), -1, F.greatest)
    cut = F.zip_with(spans, reach, lambda x, r: F.struct(F.greatest(x["start"], r).alias("start"), x["end"].alias("end"), F.when(x["start"] >= r, x["kind"]).alias("kind")))
    return F.filter(cut, lambda x: x["end"] > x["start"])


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` without the sorted disjoint ``spans``, for each of which its kind, if it has one, is put."""
    first = F.transform(spans, lambda x: F.floor(x["start"] / _SHEET).cast("int"))
    crossing = F.filter(spans, lambda x: F.floor(x["start"] / _SHEET) < F.floor((x["end"] - 1) / _SHEET))
    marks = F.struct(spans.alias("spans"), first.alias("first"), F.reverse(first).alias("last"), crossing.alias("crossing"))

    def sheet(part: Column, k: Column, m: Column) -> Column:
        at = k * _SHEET
        begins = F.array_position(m["first"], k)
        n = F.when(begins > 0, F.size(m["first"]) - F.array_position(m["last"], k) - begins + 2).otherwise(0)
        own = F.slice(m["spans"], F.greatest(begins, F.lit(1)).cast("int"), n.cast("int"))
        before = F.coalesce(F.array_max(F.transform(F.filter(m["crossing"], lambda x: (x["start"] < at) & (x["end"] > at)), lambda x: x["end"])), at.cast("bigint")) - at

        def piece(x: Column, i: Column) -> Column:
            begin = F.when(i == 0, before).otherwise(F.get(own, i - 1)["end"] - at)
            gap = F.substring(part, (begin + 1).cast("int"), (x["start"] - at - begin).cast("int"))
            return F.concat(gap, F.when(x["kind"].isNotNull(), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(""))

        end = F.when(n > 0, F.element_at(own, -1)["end"] - at).otherwise(before)
        return F.concat(F.array_join(F.transform(own, piece), ""), F.substring(part, (end + 1).cast("int"), F.lit(_SHEET)))

    sheets = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_SHEET}}}"), F.lit(0))
    clean = F.get(F.transform(F.array(marks), lambda m: F.array_join(F.transform(sheets, lambda part, k: sheet(part, k, m)), "")), F.lit(0))
    return F.when(spans.isNull(), text).otherwise(clean)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents, those of base kinds and those that the classifier adds; nulls, empty texts and repeated rows as stated at ``personal_data``."""
    marked = personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = ", ".join(f"'{k}'" for k in BASE)
    return marked.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(personal_data, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(written("personal_data", f"x.kind in ({base})")), 256).alias("base_sha256"),
        F.expr(written("personal_data")).alias("spans"),
        F.size("personal_data").cast("bigint").alias("n_spans"),
    )
