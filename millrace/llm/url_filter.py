"""URL filters: rules for hosts and paths, and a tree of path templates per host; SQL functions only.

Pages are first counted by host and path, in which tokens of a variable form (numbers, dates, digests) are one; all that
follows works on these counts. Level by level, rare tokens among many siblings become wildcards, and siblings that don't
differ statistically become one branch. A branch's profile is how its pages are spread over what follows in the path and over
labels (none, allow, block): siblings are dealt by what is most frequent of both, and each is held against the pool of its deal
by chi-square, so that no pairs are made. Templates with too little smoothed purity are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, free_name, materialize, release, table

#: (verdict, rule): a host and the beginning of a path, as the contract has them (fixed values).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Tokens of a path that are told apart; what follows them is one token.
DEPTH = 3
REST = "{**}"
#: Tokens longer than this are one.
LONG_TOKEN = 64
#: Forms of variable tokens; the first that fits counts. A number keeps what follows its dot.
FORMS = (
    (r"^\{", "{braced}"),
    (r"^[0-9]+\z", "{n}"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?\z", "{date}"),
    (r"^[A-Fa-f-]*[0-9][0-9A-Fa-f-]{7,}\z", "{hex}"),
)
NUMBERED = r"^[0-9]+(\.[A-Za-z0-9]{1,5})\z"
#: Siblings from which on those with less than one page in SHARE become a wildcard.
MANY, SHARE = 16, 20
#: Siblings are alike up to this many standard deviations of chi-square over its mean.
DEVIATIONS = 3.0
#: Pseudo-counts of a template's allowed and blocked pages, and the purity under which it is rejected.
SMOOTH, LEAST_PURITY = 2.0, 0.1
#: A shape with at least one page in HOT is joined by broadcast; there are at most HOT of them.
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the path, A to Z in lower case, and the path; both empty if there is no ``://``."""
    begins = F.instr(url, "://")
    after = F.when(begins > 0, F.substring(url, begins + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (of equally long ones the least) that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}"), rule).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, verdict).otherwise(out)
    return out


def token_form(token: Column) -> Column:
    out = F.when(F.length(token) > LONG_TOKEN, "{long}")
    for pattern, form in FORMS:
        out = out.when(token.rlike(pattern), form)
    return out.when(token.rlike(NUMBERED), F.concat(F.lit("{n}"), F.regexp_extract(token, NUMBERED, 1))).otherwise(token)


def path_tokens(path: Column) -> Column:
    """The first ``DEPTH`` parts of a path, variable ones by form, and ``REST`` if there are more."""
    parts = F.split(F.substring(path, 2, F.length(path)), "/")
    head = F.transform(F.slice(parts, 1, DEPTH), token_form)
    return F.when(F.size(parts) > DEPTH, F.concat(head, F.array(F.lit(REST)))).otherwise(head)


def _shape(host: Column, tokens: Column) -> Column:
    return F.concat(host, F.lit("/"), F.array_join(tokens, "/"))


# ---- the tree


def _wildcards(shapes: DataFrame, level: int) -> DataFrame:
    """``shapes`` with ``token``: that of the level (null past a path's end), or ``{*}`` if it is rare among many."""
    named = shapes.withColumn("own", F.get("tokens", F.lit(level)))
    nodes = named.where("own is not null").groupBy("host", "prefix", "own").agg(F.sum("pages").alias("here"))
    sums = nodes.groupBy("host", "prefix").agg(F.count("*").alias("siblings"), F.sum("here").alias("all"))
    kept = nodes.join(sums, ["host", "prefix"]).where((F.col("siblings") <= MANY) | (F.col("here") * SHARE >= F.col("all"))).select("host", "prefix", "own", F.lit(True).alias("kept"))
    found = named.join(kept, ["host", "prefix", "own"], "left")
    return found.withColumn("token", F.when(F.col("own").isNotNull() & F.col("kept").isNull(), "{*}").otherwise(F.col("own"))).drop("own", "kept")


def _merged(shapes: DataFrame, level: int) -> DataFrame:
    """(host, prefix, token, merged): the branches of a level that are alike, with the name that they get together."""
    later = F.transform(F.slice("tokens", level + 2, DEPTH + 1), lambda t: F.when(t.startswith("{"), t).otherwise("w"))
    counts = [F.sum(c).alias(c) for c in ("none", "allowed", "blocked")]
    profiles = shapes.where("token is not null").groupBy("host", "prefix", "token", F.array_join(later, "/").alias("later")).agg(*counts)
    most, form = F.greatest("none", "allowed", "blocked"), F.max(F.struct(F.expr("none + allowed + blocked"), "later"))["later"]
    main = F.when(F.col("none") == most, "{~:").when(F.col("allowed") == most, "{~allow:").otherwise("{~block:")
    branches = profiles.groupBy("host", "prefix", "token").agg(*counts, form.alias("form"))
    branches = branches.select("host", "prefix", "token", F.concat(main, "form", F.lit("}")).alias("deal"), F.expr("none + allowed + blocked").alias("n"))
    cells = profiles.select("host", "prefix", "token", "later", F.expr("stack(3, 'none', none, 'allow', allowed, 'block', blocked) as (label, seen)")).where("seen > 0")
    cells = cells.join(branches, ["host", "prefix", "token"])
    pool = cells.groupBy("host", "prefix", "deal", "later", "label").agg(F.sum("seen").alias("pooled"))
    pools = pool.groupBy("host", "prefix", "deal").agg(F.sum("pooled").alias("total"), (F.count("*") - 1).alias("freedom"))
    held = cells.join(pool, ["host", "prefix", "deal", "later", "label"]).join(pools, ["host", "prefix", "deal"])
    part = F.col("seen").cast("double") * F.col("seen") / F.col("n") * (F.col("total").cast("double") / F.col("pooled"))
    squares = held.groupBy("host", "prefix", "deal", "token", "n", "freedom").agg(F.sum(part).alias("squares"))
    alike = squares.where(F.col("squares") - F.col("n") <= F.col("freedom") + DEVIATIONS * F.sqrt(2.0 * F.col("freedom")) + 1e-6)
    several = alike.groupBy("host", "prefix", "deal").count().where("count > 1")
    return alike.join(several, ["host", "prefix", "deal"]).select("host", "prefix", "token", F.col("deal").alias("merged"))


def template_tree(pages: DataFrame) -> DataFrame:
    """(shape, template, pages, purity, rejected): every host and path form with the template that it comes to.

    ``pages`` has host, tokens and label ('allow', 'block', or null where nothing is known; anything else counts as null).
    ``purity`` is the smoothed share of allowed pages among the labelled ones of a template, ``rejected`` whether it is under
    ``LEAST_PURITY``; a template without labels has 0.5 and stays. Null hosts are dropped; an empty table gives no rows.
    The result is written to the shared folder.
    """
    allowed, blocked = F.col("label") == "allow", F.col("label") == "block"
    counts = [F.count("*").alias("pages"), F.count_if(allowed).alias("allowed"), F.count_if(blocked).alias("blocked")]
    shapes = pages.where("host is not null").groupBy("host", "tokens").agg(*counts)
    shapes = materialize(shapes.withColumn("none", F.expr("pages - allowed - blocked")).withColumn("prefix", F.lit("")), "shapes")
    for level in range(DEPTH + 1):
        named = materialize(_wildcards(shapes, level), "wildcards")
        release(shapes)
        joined = named.join(_merged(named, level), ["host", "prefix", "token"], "left")
        token = F.coalesce("merged", "token")
        shapes = materialize(joined.withColumn("prefix", F.when(token.isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), token))).drop("token", "merged"), "shapes")
        release(named)
    sums = shapes.groupBy("host", "prefix").agg(F.sum("allowed").alias("good"), F.sum("blocked").alias("bad"))
    purity = (F.col("good") + SMOOTH) / (F.col("good") + F.col("bad") + 2 * SMOOTH)
    judged = shapes.join(sums, ["host", "prefix"]).select(_shape(F.col("host"), F.col("tokens")).alias("shape"), F.concat("host", "prefix").alias("template"), "pages", purity.alias("purity"))
    return materialize(judged.withColumn("rejected", F.col("purity") < LEAST_PURITY), "templates")


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, label_col: str | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict ('allow' or 'block'), template and purity.

    A rule's verdict counts; where none fits, pages of rejected templates are blocked and others allowed. Labels are those of
    ``label_col`` ('allow', 'block') and, where that is null or not given, the verdicts of rules. Every row stays: a null
    url, or one without ``://``, has an empty host and path and is judged like others of that kind; equal urls are judged
    alike; a column that has one of the new names is replaced; an empty table stays empty. ``rules`` are a short list, as
    each is a part of one expression.

    Templates are joined by host and path form: broadcast if they are few; otherwise those with many pages are broadcast (there
    are at most ``HOT``), and the others, none of which has more than a thousandth of the pages, are joined by shuffle.
    """
    new = ("host", "path", "rule", "verdict", "template", "purity")
    host, path = host_and_path(F.col(f"`{url_col}`"))
    own = [c for c in pages.columns if c.lower() not in new]
    kept, label = free_name(pages, "__own__"), F.col(f"`{label_col}`").cast("string") if label_col else F.lit(None).cast("string")
    read = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias(kept), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), label.alias("label"))
    ruled = read.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("tokens", path_tokens(F.col("path")))
    ruled = ruled.withColumn("label", F.coalesce("label", verdict_of(F.col("rule"), rules)))
    tree = template_tree(ruled.select("host", "tokens", "label"))
    shaped = ruled.withColumn("shape", _shape(F.col("host"), F.col("tokens")))
    few = tree.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        joined = shaped.join(F.broadcast(tree.drop("pages")), "shape", "left")
    else:
        least = tree.agg(F.sum("pages")).first()[0] / HOT
        often, seldom = tree.where(F.col("pages") >= least).drop("pages"), tree.where(F.col("pages") < least).drop("pages")
        first = shaped.join(F.broadcast(often), "shape", "left")
        rest = first.where("template is null").drop("template", "purity", "rejected").join(seldom, "shape", "left")
        joined = first.where("template is not null").unionByName(rest)
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("rejected"), "block").otherwise("allow"))
    return joined.select(*[F.col(f"`{kept}`.`{c}`").alias(c) for c in own], "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filter_urls`` of all ``pages``; nulls, equal urls and empty tables as stated there. Labels are what rules decide."""
    found = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def oracle_sql() -> str:
    """The same in DuckDB SQL, level by level, with windows in the place of joins."""
    fits = "".join(
        f" when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{r}'"
        for _, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    )
    verdicts = "".join(f" when '{r}' then '{v}'" for v, r in RULES)
    forms = f"case when length(x) > {LONG_TOKEN} then '{{long}}'" + "".join(f" when regexp_matches(x, '{p}') then '{f}'" for p, f in FORMS)
    forms += f" when regexp_matches(x, '{NUMBERED}') then '{{n}}' || regexp_extract(x, '{NUMBERED}', 1) else x end"
    levels = ""
    for k in range(DEPTH + 1):
        levels += f"""
nodes{k} as (select host, prefix, tokens[{k + 1}] as own, sum(pages) as here from shapes{k} where len(tokens) > {k} group by all),
kept{k} as (select host, prefix, own from nodes{k} qualify count(*) over (partition by host, prefix) <= {MANY} or here * {SHARE} >= sum(here) over (partition by host, prefix)),
named{k} as (select s.*, case when len(s.tokens) <= {k} then null when t.own is null then '{{*}}' else t.own end as token,
    array_to_string(list_transform(s.tokens[{k + 2}:], lambda x: case when x[1] = '{{' then x else 'w' end), '/') as later
    from shapes{k} s left join kept{k} t on t.host = s.host and t.prefix = s.prefix and t.own = s.tokens[{k + 1}]),
forms{k} as (select host, prefix, token, later from named{k} where token is not null group by host, prefix, token, later
    qualify row_number() over (partition by host, prefix, token order by sum(pages) desc, later desc) = 1),
branches{k} as (select n.host, n.prefix, n.token, sum(pages) as n, case greatest(sum(none), sum(allowed), sum(blocked)) when sum(none) then '{{~:' when sum(allowed) then '{{~allow:' else '{{~block:' end || f.later || '}}' as deal
    from named{k} n join forms{k} f on f.host = n.host and f.prefix = n.prefix and f.token = n.token group by n.host, n.prefix, n.token, f.later),
cells{k} as (select host, prefix, token, deal, n, later, label, sum(seen) as seen from
    (select host, prefix, token, later, unnest(['none', 'allow', 'block']) as label, unnest([none, allowed, blocked]) as seen from named{k} where token is not null) join branches{k} using (host, prefix, token)
    where seen > 0 group by all),
pool{k} as (select host, prefix, deal, later, label, sum(seen) as pooled from cells{k} group by all),
pools{k} as (select host, prefix, deal, sum(pooled) as total, count(*) - 1 as freedom from pool{k} group by all),
alike{k} as (select host, prefix, deal, token from cells{k} join pool{k} using (host, prefix, deal, later, label) join pools{k} using (host, prefix, deal)
    group by host, prefix, deal, token, n, freedom
    having sum(cast(seen as double) * seen / n * (cast(total as double) / pooled)) - n <= freedom + {DEVIATIONS} * sqrt(2.0 * freedom) + 1e-6),
merged{k} as (select host, prefix, token, deal from alike{k} qualify count(*) over (partition by host, prefix, deal) > 1),
shapes{k + 1} as (select n.host, n.tokens, n.pages, n.allowed, n.blocked, n.none, case when n.token is null then n.prefix else n.prefix || '/' || coalesce(m.deal, n.token) end as prefix
    from named{k} n left join merged{k} m using (host, prefix, token)),"""
    last = f"shapes{DEPTH + 1}"
    return f"""
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as after from pages),
parsed as (select page_id, translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
ruled as (select *, case {fits} end as rule, list_transform(string_split(substr(path, 2), '/'), lambda x: {forms}) as parts from parsed),
labelled as (select *, case rule {verdicts} end as label, case when len(parts) > {DEPTH} then list_append(parts[:{DEPTH}], '{REST}') else parts end as tokens from ruled),
shapes0 as (select host, tokens, count(*) as pages, count(*) filter (label = 'allow') as allowed, count(*) filter (label = 'block') as blocked,
    count(*) filter (label is null) as none, '' as prefix from labelled group by host, tokens),{levels}
sums as (select host, prefix, (sum(allowed) + {SMOOTH}) / (sum(allowed) + sum(blocked) + {2 * SMOOTH}) as purity from {last} group by all)
select l.page_id, l.host, l.path, l.rule, coalesce(l.label, case when u.purity < {LEAST_PURITY} then 'block' else 'allow' end) as verdict, l.host || s.prefix as template, round(u.purity, 6) as purity
from labelled l join {last} s using (host, tokens) join sums u using (host, prefix)
"""
