"""Document fingerprints: a canonical exact digest, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import limited_to, materialize, partitions, rank_among, table

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: First argument of the second hash; it seeds a hash that is independent of the first.
SECOND = "second half"


def canonical(text: Column) -> Column:
    """Unicode composed, case folded, white space runs as one space, ends trimmed; null counts as empty.

    Composition and folding are those of the Unicode library that Spark's collations use, called
    on the JVM; folding can undo composition, so that is applied last. Select it as a column of its own before it is used
    twice: Spark takes such a call for one without a fixed result and evaluates each use.
    """

    def composed(x: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), _SPACE, " "))


def wide_hash(value: Column) -> Column:
    """128 bits as 32 lowercase hex digits: two xxHash64 of independent seeds."""

    def digits(x: Column) -> Column:
        return F.lpad(F.lower(F.hex(x)), 16, "0")

    return F.concat(digits(F.xxhash64(value)), digits(F.xxhash64(F.lit(SECOND), value)))


def differing_buckets(df: DataFrame, bucket: str, value: Column) -> DataFrame:
    """Buckets whose rows don't all hold the same bytes.

    All bytes are equal exactly if the smallest and the largest are; both are aggregated map-side,
    so a bucket of any size sends two values a task and never gathers in one place.
    """
    return (
        df.select(F.col(bucket), value.alias("value"))
        .groupBy(bucket)
        .agg(F.min("value").alias("least"), F.max("value").alias("most"))
        .where("least <> most")
        .select(bucket)
    )


def _hashes(value: str) -> list[Column]:
    """Hash and digest of the canonical text in the column ``value``."""
    return [wide_hash(F.col(value)), F.unhex(F.sha2(F.col(value), 256))]


def _told_apart(fingerprint: str, digest: str, differs: Column) -> Column:
    """The hash, and in buckets with different bytes a further digest."""
    return F.when(differs, F.concat(F.col(fingerprint), F.lit("-"), F.lower(F.hex(digest)))).otherwise(F.col(fingerprint))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, class_id, class_size): one row for each row of ``df``.

    Rows are grouped by the wide hash of their canonical text; buckets of several rows are then held
    together byte by byte, and one that holds different texts is split by a further digest. class_id
    is the smallest id of the class. Null and empty texts share one fingerprint; repeated rows are
    rows of the same class; a null id is kept and never names a class while another id does; other
    columns are ignored.
    """
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    whole, digest = _hashes("value")
    hashed = materialize(texts.select("id", canonical(F.col("text")).alias("value")).select("id", whole.alias("fingerprint"), digest.alias("digest")), "hashes")
    shared = hashed.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    members = hashed.where("id is not null").join(shared, "fingerprint", "left_semi").select(F.col("id").alias("member")).distinct()
    again = limited_to(texts, "id", members).unionByName(texts.where("id is null")).select(canonical(F.col("text")).alias("value"))
    split = materialize(differing_buckets(again.select(wide_hash(F.col("value")).alias("bucket"), "value"), "bucket", F.col("value")), "differing")
    differs = F.lit(False)
    if not split.isEmpty():
        hashed, differs = hashed.join(split, F.col("fingerprint") == F.col("bucket"), "left"), F.col("bucket").isNotNull()
    keyed = hashed.select("id", _told_apart("fingerprint", "digest", differs).alias("fingerprint"))
    classes = keyed.groupBy("fingerprint").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return keyed.join(classes, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "class_id", "class_size")


def successors(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each row of ``ids`` (distinct, not null) with ``next_id``, the next larger id; the largest has the smallest.

    Ids are dealt into buckets between quantiles, so no task holds them all; the seams between
    buckets come from one row a bucket.
    """
    n = max(2, min(2000, 2 * partitions(ids.sparkSession)))
    marks = ids.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)], 100 * n)).first()[0] or []
    marks = sorted(set(marks))
    dealt = ids.withColumn("bucket", rank_among(marks, F.col(id_col)))
    firsts = dict(dealt.groupBy("bucket").agg(F.min(id_col)).collect())
    if not firsts:
        return ids.withColumn("next_id", F.lit(None).cast("bigint"))
    following, first = {}, min(firsts.values())
    ahead = first
    for k in sorted(firsts, reverse=True):
        following[k], ahead = ahead, firsts[k]
    seam = F.create_map(*[F.lit(x) for pair in following.items() for x in pair])
    inside = Window.partitionBy("bucket").orderBy(id_col)
    return dealt.select(*ids.columns, F.coalesce(F.lead(id_col).over(inside), F.element_at(seam, F.col("bucket"))).cast("bigint").alias("next_id"))


def with_edits(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, text, edited, next_id, next_key) of each row of ``docs`` (doc_id, text).

    ``links`` has doc_id, its quarter and next_id. The last quarter of a text gives way to the beginning of the next
    document, of which next_key is the SHA-256; of rows that repeat its id, the one with the smallest digest counts. A
    row without an id, or a next document, only loses its quarter. Texts are shuffled once: row and next
    document's head read the same exchange.
    """
    spread = docs.where("doc_id is not null")
    heads = (
        spread.join(links.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("of"), "quarter"), "doc_id")
        .select("of", F.struct(F.unhex(F.sha2("text", 256)).alias("key"), F.expr("left(text, quarter)").alias("head"), F.col("doc_id").alias("id")).alias("next"))
        .groupBy("of")
        .agg(F.min("next").alias("next"))
        .withColumnRenamed("of", "doc_id")
    )
    joined = spread.join(heads, "doc_id", "left")
    joined = joined.unionByName(docs.where("doc_id is null").withColumn("next", F.lit(None).cast(heads.schema["next"].dataType)))
    kept = F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))")
    head = F.expr("left(next.head, cast(floor(length(text) / 4) as int))")
    return joined.select("doc_id", "text", F.concat(kept, F.coalesce(head, F.lit(""))).alias("edited"), F.col("next.id").alias("next_id"), F.col("next.key").alias("next_key"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all rows of ``docs`` (doc_id, text) and of their edited texts, and which of them are alike.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Each text and each
    edited text is made canonical once and hashed. Buckets with several of them, originals and edited texts
    together, are then held together byte by byte, and those that hold different bytes split by a further digest, so that
    equal fingerprints mean equal canonical texts whatever the hash. Null texts count as empty; of repeated ids, the row
    with the smallest SHA-256 is the "next document"; rows without an id have no next document; an empty table gives no
    rows; other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quarters = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4).cast("int")).alias("quarter"))
    links = materialize(successors(quarters), "links")
    formed = with_edits(docs, links).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.unhex(F.sha2("text", 256)).alias("key"), "next_id", "next_key", F.sha2("edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("own"), canonical(F.col("edited")).alias("other"),
    )
    (own_hash, own_digest), (other_hash, other_digest) = _hashes("own"), _hashes("other")
    hashed = formed.select(
        "doc_id", "n_chars", "key", "next_id", "next_key", "edited_sha256", (F.col("own") == F.col("other")).alias("same"),
        own_hash.alias("own_hash"), own_digest.alias("own_digest"), other_hash.alias("other_hash"), other_digest.alias("other_digest"),
    )
    hashed = materialize(hashed, "hashes")
    split = materialize(differing_texts(docs, links, hashed), "differing")
    if split.isEmpty():
        marked = hashed.withColumns({"own_differs": F.lit(False), "other_differs": F.lit(False)})
    else:
        marked = hashed
        for name in ("own", "other"):
            known = split.select(F.col("bucket").alias(f"{name}_hash"), F.lit(True).alias(f"{name}_found"))
            marked = marked.join(known, f"{name}_hash", "left").withColumn(f"{name}_differs", F.col(f"{name}_found").isNotNull())
    named = marked.select(
        "doc_id", "n_chars", "key", "next_id", "next_key", "edited_sha256",
        _told_apart("own_hash", "own_digest", F.col("own_differs")).alias("fingerprint"), _told_apart("other_hash", "other_digest", F.col("other_differs")).alias("edited_fingerprint"),
    )
    following = named.where("doc_id is not null").select(F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint")).distinct()
    return named.join(following, ["next_id", "next_key"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.when(F.col("fingerprint") == F.col("edited_fingerprint"), 1.0).otherwise(0.0).alias("near_edited"), F.when(F.col("fingerprint") == F.col("next_fingerprint"), 1.0).otherwise(0.0).alias("near_next"),
    )


def differing_texts(docs: DataFrame, links: DataFrame, hashed: DataFrame) -> DataFrame:
    """Buckets of ``hashed`` in which canonical originals or edited texts have different bytes.

    Only rows in buckets of several texts are read again; an edited text that was found equal to its own original
    needs no look of its own.
    """
    edited = hashed.where("not same")
    buckets = hashed.select(F.col("own_hash").alias("bucket")).unionAll(edited.select(F.col("other_hash").alias("bucket")))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")

    def members(rows: DataFrame, column: str) -> DataFrame:
        return rows.where("doc_id is not null").join(shared, F.col(column) == F.col("bucket"), "left_semi").select(F.col("doc_id").alias("member")).distinct()

    # Rows without an id are few or one hot group; they are all looked at, and aggregated before any shuffle.
    originals = limited_to(docs, "doc_id", materialize(members(hashed, "own_hash"), "members")).unionByName(docs.where("doc_id is null")).select(canonical(F.col("text")).alias("value"))
    asked = materialize(members(edited, "other_hash"), "members")
    linked = links.join(asked, F.col("doc_id") == F.col("member"), "left_semi")
    needed = linked.select(F.col("doc_id").alias("member")).union(linked.select("next_id")).distinct()
    again = with_edits(limited_to(docs, "doc_id", needed).unionByName(docs.where("doc_id is null")), linked).where("next_id is not null or doc_id is null")
    values = originals.unionAll(again.select(canonical(F.col("edited")).alias("value")))
    return differing_buckets(values.select(wide_hash(F.col("value")).alias("bucket"), "value"), "bucket", F.col("value"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edited_fingerprints`` of all documents; nulls, repeated and empty rows as stated there."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
