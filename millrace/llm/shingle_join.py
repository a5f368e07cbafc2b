"""Near-duplicate join on word shingles: a MinHash LSH forest, then exact verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import BROADCAST_ROWS, free_name, limited_to, materialize, release, table, without

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 20
#: MinHash values in the signature of a tree; the longest prefix. Each is kept in VALUE_BYTES bytes.
DEPTH = 8
VALUE_BYTES = 2
TARGET_RECALL = 0.9995
#: Links that a measure of recall needs.
LEAST_LINKS = 200
#: A node's representative joins another one's group if they meet in this share of the trees.
HOOK_SHARE = 0.2
#: Most texts and bytes of text in a block of the verification.
BLOCK_TEXTS = 128
BLOCK_BYTES = 8 << 20
#: A shingle in more texts of a block than this is counted by a matrix product, others pair by pair.
DENSE_FROM = 24

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


def shingle_set(raw: bytes, hashes: dict, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 bytes; words are parted by ASCII white space.

    A text with fewer words than ``size`` has them all as its one shingle; one without words has none.
    """
    words = raw.split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    k = min(size, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ w[j : n - k + 1 + j]) * _MIX
        h ^= h >> np.uint64(29)
    h *= _STEP
    h ^= h >> np.uint64(32)
    return np.unique(h)


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair at ``threshold`` is expected to meet in some tree with the target probability."""
    return next((d for d in range(depth, 0, -1) if 1 - (1 - threshold**d) ** trees >= target), 1)


class _Signer:
    """Signatures of shingle sets: for each tree, ``depth`` MinHash values."""

    def __init__(self, trees: int, depth: int):
        draw = np.random.default_rng(20)
        self.xor = draw.integers(0, 1 << 63, trees * depth, dtype=np.uint64)
        self.odd = draw.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, found: np.ndarray) -> bytes:
        least = np.full(len(self.xor), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for at in range(0, len(found), 2048):
            mixed = (found[at : at + 2048, None] ^ self.xor) * self.odd
            np.minimum(least, mixed.min(axis=0), out=least)
        return (least >> np.uint64(64 - 8 * VALUE_BYTES)).astype(f"<u{VALUE_BYTES}").tobytes()


def sketches(df: DataFrame, id_col: str, text_col: str, size: int, trees: int, depth: int) -> DataFrame:
    """(id, digest of the shingle set, number of shingles, bytes of text, signature: depth values a tree)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _Signer(trees, depth)
        hashes = _WordHashes()
        for batch in batches:
            digests, counts, lengths, signatures = [], [], [], []
            for value in batch.column(1):
                raw = (value.as_py() or "").encode()
                found = shingle_set(raw, hashes, size)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                counts.append(len(found))
                lengths.append(len(raw))
                signatures.append(sign(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(signatures, pa.binary())],
                names=["id", "digest", "n_shingles", "n_bytes", "signature"],
            )

    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(sketch, "id bigint, digest binary, n_shingles bigint, n_bytes bigint, signature binary")


def common_prefix(a: bytes, b: bytes, width: int = VALUE_BYTES) -> int:
    """Values that two signatures have in common at their beginning."""
    n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return n // width


def _walk(depth: int, shortest: int):
    """Along sorted branches: each row with the longest prefix that it shares with a neighbour in its tree.

    Rows under ``shortest`` go, but for the first (edge 1) and last row (edge 2, both 3) of each task, whose other
    neighbour another task holds.
    """
    names = ["tree", "branch", "rep", "depth", "edge", "part"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None  # the last row, whose next neighbour isn't known yet: tree, branch, rep, prefix shared with its predecessor, edge
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            trees = batch.column(0).to_numpy(zero_copy_only=False)
            branches = batch.column(1).to_pylist()
            reps = batch.column(2).to_numpy(zero_copy_only=False)
            edges = np.zeros(n, dtype=np.int32)
            if held is None:
                edges[0] = 1
            else:
                trees, branches, reps, edges = np.r_[held[0], trees], [held[1], *branches], np.r_[held[2], reps], np.r_[held[4], edges].astype(np.int32)
            values = np.frombuffer(b"".join(branches), dtype=f"<u{VALUE_BYTES}").reshape(-1, depth)
            same = (values[1:] == values[:-1]) & (trees[1:] == trees[:-1])[:, None]
            shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            before = np.r_[0 if held is None else held[3], shared]
            m = len(branches) - 1
            own = np.maximum(before[:-1], shared)
            out = np.flatnonzero((own >= shortest) | (edges[:-1] > 0))
            held = (trees[m], branches[m], reps[m], before[m], edges[m])
            if len(out):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trees[out], pa.int32()), pa.array([branches[k] for k in out], pa.binary()), pa.array(reps[out], pa.int64()), pa.array(own[out], pa.int32()), pa.array(edges[out], pa.int32()), pa.array([part] * len(out), pa.int32())],
                    names=names,
                )
        if held is not None:
            tree, branch, rep, before, edge = held
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree], pa.int32()), pa.array([branch], pa.binary()), pa.array([rep], pa.int64()), pa.array([before], pa.int32()), pa.array([edge + 2], pa.int32()), pa.array([part], pa.int32())],
                names=names,
            )

    return walk


def forest(reps: DataFrame, trees: int, depth: int, shortest: int) -> DataFrame:
    """(tree, branch, rep, depth): of the rows of the tries, those that share a prefix of ``shortest`` values or more.

    ``reps`` has rep and signature. All branches are sorted by tree, values and rep in ranges of equal size, whatever
    prefixes are common, and depth is the longest prefix that a row has in common with another row. Two rows of each
    range come to the driver, to be compared with the next range's.
    """
    width = VALUE_BYTES * depth
    spread = reps.select(F.posexplode(F.expr(f"transform(sequence(0, {trees - 1}), t -> substring(signature, t * {width} + 1, {width}))")).alias("tree", "branch"), "rep")
    order = ["tree", "branch", "rep"]
    walked = spread.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk(depth, shortest), "tree int, branch binary, rep bigint, depth int, edge int, part int")
    walked = materialize(walked, "forest")
    parts: dict[int, dict[int, tuple]] = defaultdict(dict)
    for r in walked.where("edge > 0").collect():
        for edge in (1, 2):
            if r["edge"] & edge:
                parts[r["part"]][edge] = r
    deepest = {}
    order = sorted(parts)
    for part in order:
        for r in parts[part].values():
            deepest[r["tree"], bytes(r["branch"]), r["rep"]] = r["depth"]
    for part, following in zip(order, order[1:], strict=False):
        a, b = parts[part][2], parts[following][1]
        if a["tree"] == b["tree"]:
            n = common_prefix(bytes(a["branch"]), bytes(b["branch"]))
            for r in (a, b):
                key = r["tree"], bytes(r["branch"]), r["rep"]
                deepest[key] = max(deepest[key], n)
    seams = reps.sparkSession.createDataFrame([(t, b, r, n) for (t, b, r), n in deepest.items() if n >= shortest], "tree int, branch binary, rep bigint, depth int")
    return walked.where("edge = 0").select("tree", "branch", "rep", "depth").unionByName(seams)


def adapted_depth(found: list[tuple[int, bool, float, int]], threshold: float, trees: int, depth: int, shortest: int, target: float) -> int:
    """The longest prefix at which drawn links reach the target recall; for tuning, as the join draws none.

    Prefixes lose one value at a time. Both the recall of all sampled links and that of links just above the threshold
    must reach the target; where fewer than LEAST_LINKS of the latter are there, that of a pair at the threshold, as
    MinHash has it, stands in.
    """

    def recall(d: int, near_only: bool) -> float:
        own = [(n, w) for n, near, w, _ in found if near or not near_only]
        total = sum(w for _, w in own)
        return sum(w for n, w in own if n >= d) / total if total else 1.0

    measurable = sum(n for _, near, _, n in found if near) >= LEAST_LINKS
    for d in range(depth, shortest, -1):
        close = recall(d, True) if measurable else 1 - (1 - threshold**d) ** trees
        if min(recall(d, False), close) >= target:
            return d
    return shortest


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None, dense_from: int = DENSE_FROM) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every set of ``right`` (or of ``left``)."""
    sets = left + (right or [])
    n, m = len(left), len(sets)
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    count = np.diff(np.r_[first, len(values)])
    rows, columns = n, (m - n if right is not None else n)
    result = np.zeros(rows * columns, dtype=np.int64)
    for k in np.unique(count[(count >= 2) & (count <= dense_from)]):
        starts = first[count == k]
        step = max(1, 2_000_000 // int(k * k))
        for at in range(0, len(starts), step):
            who = owners[starts[at : at + step, None] + np.arange(k)]
            a = np.repeat(who, k, axis=1).ravel()
            b = np.tile(who, (1, k)).ravel()
            if right is not None:
                across = (a < n) & (b >= n)
                a, b = a[across], b[across] - n
            result += np.bincount(a * columns + b, minlength=rows * columns)
    result = result.reshape(rows, columns).astype(np.float64)
    often = first[count > dense_from]
    width = np.diff(np.r_[first, len(values)])[count > dense_from]
    for at in range(0, len(often), 1024):
        table_ = np.zeros((m, min(1024, len(often) - at)), dtype=np.float32)
        for j, (s, w) in enumerate(zip(often[at : at + 1024], width[at : at + 1024], strict=True)):
            table_[owners[s : s + w], j] = 1
        result += table_[:n] @ (table_[n:] if right is not None else table_).T
    return np.rint(result).astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether each pair's Jaccard similarity is at least ``threshold``."""
    shared = intersections(left, right)
    a = np.array([len(s) for s in left])[:, None]
    b = np.array([len(s) for s in (left if right is None else right)])[None, :]
    return (shared > 0) & (shared >= threshold * (a + b - shared) - 1e-9)


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each node's component, from an array of index pairs."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        np.minimum.at(new, root[pairs[:, 0]], low)
        np.minimum.at(new, root[pairs[:, 1]], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def shingle_join(df: DataFrame, id_col="doc_id", text_col="text", size=SHINGLE_WORDS, threshold=THRESHOLD, trees=TREES, depth=DEPTH, target=TARGET_RECALL) -> DataFrame:
    """One row for each row of ``df``: id, class_id, rep_id, n_copies, n_links.

    n_links counts the other rows whose shingle set has a Jaccard similarity of at least ``threshold``,
    n_copies those with the same set. class_id is the smallest id that links lead to, rep_id the smallest
    with the same set. Texts without words (null, empty) and rows without an id are classes of their own
    without links, and of rows that repeat an id each counts. Other columns are ignored.

    Equal sets collapse first, so copies are never compared. Each set's signature is a branch in every one of ``trees``
    sorted prefix tries. Texts that share a prefix are members of its node, whose representative is their smallest id. The
    prefix's length follows from ``threshold`` alone: a pair just at it is expected to miss all nodes with a tenth of what
    ``target`` allows, and more similar pairs miss less. Nodes whose representatives themselves meet in HOOK_SHARE of the trees form one group. Within a group,
    members whose sizes allow the threshold are verified exactly, in blocks of a bounded number of texts and bytes that
    return a row for each text and never a pair; a pair in several groups counts in the first. Classes follow from
    verified links only. Nothing is capped or sampled.
    """
    sketched = materialize(sketches(df, id_col, text_col, size, trees, depth), "sketches")
    usable = sketched.where("id is not null and digest is not null")
    reps = materialize(
        usable.groupBy("digest").agg(
            F.min("id").alias("rep"),
            F.count("*").alias("copies"),
            F.max("n_shingles").alias("n_shingles"),
            F.max("n_bytes").alias("n_bytes"),
            F.first("signature").alias("signature"),
        ),
        "reps",
    )
    texts = df.select(F.col(f"`{id_col}`").cast("bigint").alias("rep"), F.col(f"`{text_col}`").alias("text"))
    shortest = prefix_depth(threshold, trees, depth, 1 - (1 - target) / 10)
    matched = forest(reps, trees, depth, shortest)
    homes = materialize(groups(matched, shortest, max(2, round(HOOK_SHARE * trees))), "groups")

    # Sizes of linked sets differ by the threshold at most: each text is in the window of its own size and in the next.
    window = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    spread = materialize(
        homes.join(reps.drop("signature"), "rep")
        .withColumn("own", window)
        .select("rep", "digest", "copies", "n_bytes", "homes", "own", F.explode("homes").alias("home"))
        .select("*", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("window")),
        "windows",
    )
    sized = (
        spread.groupBy("home", "window")
        .agg(F.count("*").alias("n"), F.sum("n_bytes").alias("total"), F.max("own").alias("top"))
        .where((F.col("n") > 1) & (F.col("top") == F.col("window")))
        .select("home", "window", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int").alias("blocks"))
    )
    dealt = (
        spread.join(sized, ["home", "window"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "rep", "digest", "copies", "homes", "home", "window", "own", "block", (F.col("blocks") > 1).alias("parted"),
            F.concat_ws(":", "home", "window", F.least("block", "facing"), F.greatest("block", "facing")).alias("task"),
        )
    )
    texts = limited_to(texts, "rep", homes.select(F.col("rep").alias("wanted")))
    verified = materialize(
        dealt.join(texts, "rep").groupBy("task").applyInArrow(_verifier(size, threshold), "rep bigint, root bigint, links bigint"), "links"
    )
    release(spread)
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    known = (
        reps.select("digest", "rep", "copies")
        .join(links, "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", "rep", (F.col("copies") - 1).alias("n_copies"), F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    joined = usable.select("id", "digest").join(known, "digest").select("id", "class_id", "rep", "n_copies", "n_links")
    alone = sketched.where("id is null or digest is null").select(
        "id", F.col("id").alias("class_id"), F.col("id").alias("rep"), F.lit(0).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links")
    )
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "class_id", F.col("rep").alias("rep_id"), "n_copies", "n_links")


def groups(matched: DataFrame, depth: int, hook_trees: int) -> DataFrame:
    """(rep, homes): the groups, at most one a tree, in which each row of the forest with a prefix of ``depth`` values is compared.

    A group has the members of all nodes whose representatives lead to one another; it is named by the smallest of them.
    """
    at = matched.where(F.col("depth") >= depth).select("tree", F.substring("branch", 1, VALUE_BYTES * depth).alias("prefix"), "rep")
    leaders = materialize(at.groupBy("tree", "prefix").agg(F.min("rep").alias("leader")), "leaders")
    if leaders.count() <= BROADCAST_ROWS:  # a node that a third of all rows share isn't gathered then; beyond, AQE splits it
        leaders = F.broadcast(leaders)
    members = materialize(at.join(leaders, ["tree", "prefix"]).groupBy("leader", "rep").agg(F.count("*").alias("met")), "members")
    heads = members.select(F.col("leader").alias("rep")).distinct()
    hooks = members.where((F.col("leader") < F.col("rep")) & (F.col("met") >= hook_trees)).join(heads, "rep", "left_semi")
    roots = components(hooks.select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    joined = members.join(roots, F.col("leader") == F.col("node"), "left")
    return joined.groupBy("rep").agg(F.array_sort(F.collect_set(F.coalesce("component", "leader"))).alias("homes"))


def _shared_earlier(homes: list[list[int]], home: int) -> np.ndarray:
    """Whether each pair of texts has a group in common that comes before ``home``."""
    earlier = defaultdict(list)
    for k, own in enumerate(homes):
        for h in own:
            if h < home:
                earlier[h].append(k)
    shared = np.zeros((len(homes), len(homes)), dtype=bool)
    for who in earlier.values():
        if len(who) > 1:
            shared[np.ix_(who, who)] = True
    return shared


def _verifier(size: int, threshold: float):
    names = ("rep", "digest", "copies", "homes", "home", "window", "own", "block", "parted")

    def verify(rows: pa.Table) -> pa.Table:
        hashes = _WordHashes()
        held: dict[tuple, tuple] = {}
        for k, (rep, digest, copies, homes, home, window, own, block, parted) in enumerate(zip(*(rows.column(c).to_pylist() for c in names), strict=True)):
            if (block, digest) not in held:
                found = shingle_set((rows.column("text")[k].as_py() or "").encode(), hashes, size)
                if xxhash.xxh3_128_digest(found.tobytes()) == digest:  # a repeated id may come with another text
                    held[block, digest] = (block, rep, copies, own == window, homes, found)
        texts = sorted(held.values(), key=lambda x: x[:2])
        task = rows.column("task")[0].as_py().split(":")
        crossed = parted and task[-1] != task[-2]
        n = sum(x[0] == int(task[-2]) for x in texts) if crossed else len(texts)
        if not texts or n == 0:
            return pa.table({"rep": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        reps, copies, top = (np.array([x[k] for x in texts]) for k in (1, 2, 3))
        sets = [x[5] for x in texts]
        links = np.zeros(len(texts), dtype=np.int64)
        pairs = np.empty((0, 2), dtype=np.int64)
        counted = (top[:, None] | top[None, :]) & ~_shared_earlier([x[4] for x in texts], home)
        if not crossed:
            near = linked(sets, None, threshold) & counted
            np.fill_diagonal(near, False)
            links = near @ copies
            pairs = np.argwhere(np.triu(near))
        elif n < len(texts):
            near = linked(sets[:n], sets[n:], threshold) & counted[:n, n:]
            links[:n], links[n:] = near @ copies[n:], copies[:n] @ near
            pairs = np.argwhere(near) + [0, n]
        root = _roots(pairs, len(texts))
        return pa.table({"rep": pa.array(reps, pa.int64()), "root": pa.array(reps[root], pa.int64()), "links": pa.array(links, pa.int64())})

    return verify


def one_of_each(df: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``df`` without those that are near duplicates of a kept one: of each class, the row with the smallest id.

    A row without an id, or without words, stays. Of rows that repeat the kept id, all stay that the class has
    under that id.
    """
    joined = shingle_join(df, id_col, text_col, **options)
    gone = joined.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias(free_name(df, "__gone__"))).distinct()
    return without(df, f"`{id_col}`", materialize(gone, "gone"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shingle_join`` of all documents; null, empty, repeated and very long texts as stated there."""
    return shingle_join(table(spark, sf_dir, "documents"))
