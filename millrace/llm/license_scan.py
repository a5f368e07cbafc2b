"""Licence scans: whole texts against digests of known licences, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import LICENSES
from .shared import free_name, table

#: A line that only says who holds the rights, or that all are reserved.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;-]*(copyright[ \t:]*(\(c\)|©|[0-9][0-9][0-9][0-9]|by )|\(c\)[ \t]*[0-9]|©|all[ \t]+rights[ \t]+reserved[ \t.]*$)[^\n]*"
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: Spellings that licence matching treats alike, applied after punctuation has gone (fixed values).
EQUIVALENT = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("whilst", "while"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("initialis", "initializ"),
    ("utilis", "utiliz"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, spelling variants made one; null counts as empty."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    x = F.trim(F.regexp_replace(x, PUNCTUATION, " "))
    for variant, common in EQUIVALENT:
        x = F.replace(x, F.lit(variant), F.lit(common))
    return x


def known_digests(spark: SparkSession, licenses=LICENSES) -> DataFrame:
    """(license_id, digest) of the given texts; of texts that are alike the first in order of id counts."""
    texts = spark.createDataFrame([(k, v) for k, v in sorted(licenses.items())], "license_id string, body string")
    return texts.select("license_id", F.sha2(canonical(F.col("body")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(df: DataFrame, text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """``df`` with ``canonical_chars``, ``canonical_sha256`` and ``license_id`` (null: no known licence).

    The whole canonical text must be that of a licence. Every row stays: nulls and empty texts have the
    digest of the empty text and no licence; repeated rows are judged alike; a column that already has one
    of the three names is replaced. The known digests are joined by hash; they are broadcast if they are found to
    be few, as the built-in ones are, and shuffled otherwise.
    """
    known = known_digests(df.sparkSession) if known is None else known
    new = {"canonical_chars", "canonical_sha256", "license_id"}
    held = free_name(df, "__canonical__")
    own = [c for c in df.columns if c.lower() not in new]
    staged = df.select(*[F.col(f"`{c}`") for c in own], canonical(F.col(f"`{text_col}`")).alias(held))
    digested = staged.select(
        *[F.col(f"`{c}`") for c in own], F.length(held).cast("bigint").alias("canonical_chars"), F.sha2(held, 256).alias("canonical_sha256")
    )
    looked = known.select(F.col("digest").alias("canonical_sha256"), "license_id")
    joined = digested.join(F.broadcast(looked), "canonical_sha256", "left") if known_is_small(known) else digested.join(looked, "canonical_sha256", "left")
    return joined.select(*[F.col(f"`{c}`") for c in own], "canonical_chars", "canonical_sha256", "license_id")


def known_is_small(known: DataFrame, most: int = 100_000) -> bool:
    """Whether at most ``most`` digests are known; such a table (about 10 MB) can go to every executor."""
    return known.limit(most + 1).count() <= most


def copied_licenses(docs: DataFrame, licenses=LICENSES) -> DataFrame:
    """(doc_id, text): a copy of a known licence in the place of each document, in one of six spellings by doc_id.

    As it is; in capitals; below a copyright line; with wider spaces; in British spelling; and with a word more,
    which is no licence any longer. (The documents of the tables hold lines about licences, but no whole one.)
    """
    texts = docs.sparkSession.createDataFrame([(k, v) for k, v in enumerate(licenses[name] for name in sorted(licenses))], "number bigint, body string")
    n = len(licenses)
    joined = docs.where("doc_id is not null").withColumn("number", F.pmod(F.floor(F.col("doc_id") / 6), F.lit(n))).join(F.broadcast(texts), "number")  # a row a licence
    way, body = F.pmod("doc_id", F.lit(6)), F.col("body")
    text = (
        F.when(way == 0, body)
        .when(way == 1, F.upper(body))
        .when(way == 2, F.concat(F.lit("Copyright (c) 2020 "), F.coalesce("source", F.lit("nobody")), F.lit("\n\n"), body))
        .when(way == 3, F.replace(body, F.lit(" "), F.lit("  ")))
        .when(way == 4, F.replace(F.replace(body, F.lit("license"), F.lit("licence")), F.lit("while"), F.lit("whilst")))
        .otherwise(F.concat(body, F.lit("\nmore")))
    )
    return joined.select("doc_id", text.alias("text"))


def license_scan_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan where most rows are licences, so that digests, spellings and join are held against SQL."""
    return scan_licenses(copied_licenses(table(spark, sf_dir, "documents"))).select("doc_id", "canonical_chars", "canonical_sha256", "license_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan_licenses`` of all documents; nulls, empty texts and repeated rows as stated there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "canonical_chars", "canonical_sha256", "license_id")


def canonical_sql(text: str) -> str:
    """The same canonical form in DuckDB SQL."""
    x = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    x = f"trim(regexp_replace({x}, '{PUNCTUATION}', ' ', 'g'), ' ')"
    for variant, common in EQUIVALENT:
        x = f"replace({x}, '{variant}', '{common}')"
    return x


def copies_sql() -> str:
    """SQL of ``license_scan_copies``."""
    names = sorted(LICENSES)
    rows = ", ".join(f"({k}, '{LICENSES[x].replace(chr(39), chr(39) * 2)}')" for k, x in enumerate(names))
    texts = f"""copies(number, copied) as (values {rows}),
documents as (select doc_id, case doc_id % 6 when 0 then copied when 1 then upper(copied) when 2 then 'Copyright (c) 2020 ' || coalesce(source, 'nobody') || chr(10) || chr(10) || copied
    when 3 then replace(copied, ' ', '  ') when 4 then replace(replace(copied, 'license', 'licence'), 'while', 'whilst') else copied || chr(10) || 'more' end as text
    from main.documents join copies on number = (doc_id // 6) % {len(names)} where doc_id is not null)"""
    return oracle_sql().replace("\nwith bodies", f"\nwith {texts},\nbodies", 1)


def oracle_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(LICENSES.items()))
    return f"""
with bodies(license_id, body) as (values {rows}),
known as (select sha256({canonical_sql('body')}) as digest, min(license_id) as license_id from bodies group by 1),
held as (select doc_id, {canonical_sql('text')} as canonical from documents),
digested as (select doc_id, cast(length(canonical) as bigint) as canonical_chars, sha256(canonical) as canonical_sha256 from held)
select d.doc_id, d.canonical_chars, d.canonical_sha256, k.license_id
from digested d left join known k on k.digest = d.canonical_sha256
"""
