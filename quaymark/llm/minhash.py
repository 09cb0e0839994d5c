"""Near-duplicates by bottom-k sketches of one hash function, with exact verification.

1. A text's sketch is the K smallest hashes of its shingle set. Texts with equal sets are one class from here on.
2. Inverted lists hold, for each retained value, the classes that retain it. Sets as similar as the threshold share, but
   for a chance of less than MISS, at least `need` of their retained values (hypergeometric tail; exactly for sets that
   fit the sketch). So a class needs `need` values that some other class retains, and only its rarest (retained - need + 1) of
   those go into lists: two such choices always meet. Values that very many texts retain come last in that order.
3. Overlaps are taken from the lists without all pairs of a list. In each round every list that spans more than one
   component compares its members with its most central one, which then leaves the list. The pair's union sketch estimates the similarity; pairs far below
   the threshold are dropped, the others are confirmed on the full sets. When the rounds are over, the members of lists
   that still span components meet across components, so no link between components is lost. Long lists are cut into blocks
   of MEMBERS; a task compares two blocks by products of incidence matrices, and only pairs leave it that the sizes and
   the union sketch allow and that share no value earlier in their order.
4. Components come from confirmed links by minimum labels with pointer jumping, in tables, not on the driver.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import drop, partitions, shared_dir, table
from quaymark.llm.shingles import shingle_sets

K = 128
MISS = 1e-7
ROUNDS = 6
#: Members of a list that meet as many others in one group, when lists that still span components are compared.
MEMBERS = 1024


def least_shared(k: int, threshold: float, union: int | None = None, miss: float = MISS) -> int:
    """Largest m with P(X < m) < miss, where X of the k smallest values of a union belong to both sets, and the union has
    so many values (None: any number), a threshold's part of them in both."""
    both = None if union is None else math.floor(threshold * union + 1e-9)
    p, m = 0.0, 0 if union is None else max(0, k - (union - both))
    while True:
        if union is None:
            p += math.comb(k, m) * threshold**m * (1 - threshold) ** (k - m)
        else:
            p += math.comb(both, m) * math.comb(union - both, k - m) / math.comb(union, k)
        if p >= miss:
            return m
        m += 1


def least_by_union(k: int, threshold: float) -> list[tuple[int, int]]:
    """(size, m) in ascending order: m holds for unions of up to that size that exceed k; beyond the last, any number."""
    steps: list[tuple[int, int]] = []
    size = k
    while size < 16 * k:
        size += max(1, size // 64)
        m = least_shared(k, threshold, size)
        if steps and steps[-1][1] <= m:
            steps[-1] = (size, steps[-1][1])
        else:
            steps.append((size, m))
    return steps


def _least(union, within, k: int | None, threshold: float) -> F.Column:
    """What least_by_union() says of a column of sizes; within is for unions that fit the sketch, as all do without k."""
    if k is None:
        return within
    out = F.when(union <= k, within)
    for size, m in least_by_union(k, threshold):
        out = out.when(union <= size, F.lit(m))
    return out.otherwise(F.lit(least_shared(k, threshold)))


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str, row_col: str | None = None, k: int | None = K) -> DataFrame:
    """doc_id, row (null without row_col), k1, k2 (hash of id and text), n_shingles, digest of the set, sketch."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    row = (F.lit(None) if row_col is None else F.col(row_col)).cast("long").alias("row")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row, F.xxhash64(F.col(id_col), t).alias("k1"), F.xxhash64(t, F.col(id_col), F.lit(1)).alias("k2"), t.alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, texts in cut(batch.column(4)):
                sets = shingle_sets(texts, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(lo, hi - lo) for i in range(4)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([s[:k].astype("int64") for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "row", "k1", "k2", "n_shingles", "digest", "sketch"],
                )

    return rows.mapInArrow(run, "doc_id long, row long, k1 long, k2 long, n_shingles long, digest binary, sketch array<long>")


def cut(column, size: int = 2_000_000):
    """(from, to, texts as bytes) of stretches of a text column of about that many characters."""
    lo = 0
    while lo < len(column):
        hi, texts, n = lo, [], 0
        while hi < len(column) and n < size:
            texts.append((column[hi].as_py() or "").encode("utf-8", "replace"))
            n += len(texts[-1])
            hi += 1
        yield lo, hi, texts
        lo = hi


def components(edges: DataFrame, at: str, name: str) -> DataFrame:
    """node, label (smallest node of its component) of all nodes in edges (a, b)."""
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct()
    both = table(both, at, f"{name}-edges")
    labels = table(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), at, f"{name}-labels-0")
    k = 0
    while True:
        k += 1
        other = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        low = both.join(other, "other").groupBy("node").agg(F.min("theirs").alias("low"))
        step = labels.join(low, "node").select("node", F.least("label", "low").alias("up"), "label")
        jump = labels.select(F.col("node").alias("up"), F.col("label").alias("beyond"))
        new = table(step.join(jump, "up").select("node", F.least("up", "beyond").alias("label"), (F.least("up", "beyond") < F.col("label")).alias("moved")), at, f"{name}-labels-{k}")
        drop(spark, at, f"{name}-labels-{k - 1}")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            drop(spark, at, f"{name}-edges")
            return labels


def joined(labels: DataFrame, links: DataFrame, at: str, name: str) -> DataFrame:
    """labels after links (a, b) were added. Only what the links join is gone through, by its labels."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.toDF(end, f"{end}l"), end, "left").withColumn(f"{end}l", F.coalesce(f"{end}l", end))
    ends = table(ends.select("a", "b", "al", "bl"), at, f"{name}-ends")
    moved = components(ends.where("al <> bl").select(F.col("al").alias("a"), F.col("bl").alias("b")), f"{at}/{name}", "work")
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("al").alias("label")), F.struct(F.col("b").alias("node"), F.col("bl").alias("label")))).alias("n")).select("n.*")
    every = labels.unionByName(new).distinct().join(moved.toDF("label", "up"), "label", "left")
    out = table(every.select("node", F.coalesce("up", "label").alias("label")), at, f"{name}-labels")
    drop(labels.sparkSession, at, name, f"{name}-ends")
    return out


def _estimated(pairs: DataFrame, classes: DataFrame, pct: int, k: int | None = K) -> DataFrame:
    """Pairs (a, b) whose sizes and union sketches allow the threshold."""
    c = classes.select("cid", "n", "sketch")
    p = pairs.join(c.toDF("a", "na", "sa"), "a").join(c.toDF("b", "nb", "sb"), "b").where(100 * F.least("na", "nb") >= pct * F.greatest("na", "nb"))
    if k is None:
        return p.select("a", "b")  # the sets are confirmed next
    p = p.withColumn("union", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    both = F.size(F.array_intersect(F.array_intersect("union", "sa"), F.col("sb")))
    # sets as similar as that have a union of this size at most
    most = F.floor(100 * (F.col("na") + F.col("nb")) / (100 + pct))
    return p.where(k * both >= F.size("union") * _least(most, F.lit(k * pct / 100 - 1e-6), k, pct / 100)).select("a", "b")


def _incidence(lists, inside):
    """0/1 columns, up to 4096 at a time, of the values that more than one of the lists has; inside says which values count."""
    import numpy as np

    flat = np.concatenate(lists)[inside]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[inside]
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    use = n[at] > 1
    row, at = row[use], place[at[use]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        i, j = np.searchsorted(at, (lo, lo + 4096))
        m = np.zeros((len(lists), min(4096, int(at[-1]) + 1 - lo)), np.float32)
        m[row[i:j], at[i:j] - lo] = 1
        yield m


def _met(sketch, prior, label, n, left, right, pct: int, steps, k: int | None = K):
    """(i, j) of the likely pairs of a group, one from left and one from right, that no earlier list holds."""
    import numpy as np

    def together(lists):
        out = np.zeros((len(left), len(right)), np.float32)
        for m in _incidence(lists, slice(None)):
            out += m[left] @ m[right].T
        return out

    both, na, nb = together(sketch), n[left][:, None], n[right][None]
    sizes = np.array([len(x) for x in sketch])
    union = sizes[left][:, None] + sizes[right][None] - both
    if k is None:
        likely = 100 * both >= pct * union
    else:
        most = 100 * (na + nb) // (100 + pct)
        least = np.where(most <= k, k * pct / 100 - 1e-6, steps[1][np.searchsorted(steps[0], most)])
        union = np.minimum(k, union)
        likely = k * both >= union * least
    ok = (label[left][:, None] != label[right][None]) & (100 * np.minimum(na, nb) >= pct * np.maximum(na, nb)) & likely
    if left is right:
        ok = np.triu(ok, 1)
    if ok.any():
        ok &= together(prior) == 0
    i, j = np.nonzero(ok)
    if k is None:
        return left[i], right[j]
    wide = np.full((len(sketch), k), np.iinfo(np.int64).max)
    for row, x in enumerate(sketch):
        wide[row, : len(x)] = x
    keep = np.zeros(len(i), bool)
    for lo in range(0, len(i), 8192):
        x, y = i[lo : lo + 8192], j[lo : lo + 8192]
        v = np.sort(np.concatenate([wide[left[x]], wide[right[y]]], axis=1), axis=1)
        again = (v[:, 1:] == v[:, :-1]) & (v[:, 1:] < np.iinfo(np.int64).max)
        rank = np.arange(1, 2 * k)[None] - np.cumsum(again, axis=1) + 1  # of the value among the distinct ones
        keep[lo : lo + 8192] = k * (again & (rank <= k)).sum(axis=1) >= union[x, y] * least[x, y]
    return left[i[keep]], right[j[keep]]


def _across(e: DataFrame, chosen: DataFrame, classes: DataFrame, pct: int, k: int | None = K) -> DataFrame:
    """Likely pairs (a, b) of members of a list, of different components, each once: in the first list that both chose."""
    blocks = e.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    values = chosen.select("cid", F.transform("x", lambda y: y["v"]).alias("x"))
    full = e.join(blocks, "v").join(classes.select("cid", "n", "sketch"), "cid").join(values, "cid").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    prior = F.slice("x", F.lit(1), F.array_position("x", F.col("v")).cast("int") - 1)
    dealt = full.select("v", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "cid", "label", "n", "sketch", prior.alias("prior"))
    dealt = dealt.select("v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid", "label", "n", "sketch", "prior")
    known = least_by_union(k or K, pct / 100)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        steps = np.array([size for size, _ in known]), np.array([m for _, m in known] + [least_shared(k or K, pct / 100)], float)
        rest = None

        def groups(t, last):
            """Pairs of the whole groups of t, and the rows of a group that may go on."""
            key = [t.column(i).to_numpy() for i in range(3)]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            edges = [0, *new.tolist(), *([t.num_rows] if last else [])]
            own, cid, label, n = (t.column(i).to_numpy() for i in range(3, 7))
            sketch, prior = ([x.values.to_numpy() for x in t.column(i)] for i in (7, 8))
            out = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                at = np.arange(hi - lo)
                same = key[1][lo] == key[2][lo]
                left = at if same else at[own[lo:hi] == key[1][lo]]
                right = left if same else at[own[lo:hi] != key[1][lo]]
                if hi - lo > 1 and len(left) and len(right):
                    i, j = _met(sketch[lo:hi], prior[lo:hi], label[lo:hi], n[lo:hi], left, right, pct, steps, k)
                    out.append(np.stack([cid[lo:hi][i], cid[lo:hi][j]]))
            pairs = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=0)), pa.array(pairs.max(axis=0))], ["a", "b"]), None if last else t.slice(edges[-1])

        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
                pairs, rest = groups(t, False)
                yield pairs
        if rest is not None:
            yield groups(rest, True)[0]

    keys = ["v", "lo", "hi"]
    return dealt.repartition(partitions(e.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, threshold_pct: int) -> DataFrame:
    """Pairs with 100 * intersection >= threshold_pct * union of the full sets."""
    full = pairs.select("a", "b").join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo, hi, left in cut(batch.column(2)):
                right = [x.encode("utf-8", "replace") for x in batch.column(3).slice(lo, hi - lo).to_pylist()]
                sa, sb = shingle_sets(left, words), shingle_sets(right, words)
                ok = []
                for x, y in zip(sa, sb):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= threshold_pct * (len(x) + len(y) - both))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo).filter(keep) for i in range(2)], ["a", "b"])

    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, threshold_pct: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, k: int | None = K) -> DataFrame:
    """A row for each row of docs: row_col, doc_id, n_shingles, component_id, n_joining_links, kept.

    Texts are linked when 100 * intersection >= threshold_pct * union of their shingle sets. component_id is the smallest
    id reachable, n_joining_links the links of the row's class that were
    confirmed while components were joined (pairs already in one component aren't compared). Null, empty and wordless texts have empty sets, are
    linked with nothing and keep themselves. Rows that repeat an id share its component. Null ids come after all others.
    kept goes by ids, and holds for every row that has the smallest one; with row_col, which numbers the rows (bigint), it
    goes by rows, and holds for one row of each component, among those with the smallest id. A sketch keeps k values and may
    miss a link just at the threshold (see MISS); with k None it keeps the whole set, and no link is lost.
    """
    spark, at, t = docs.sparkSession, shared_dir(docs.sparkSession), threshold_pct / 100
    rows = table(sketches(docs, words, id_col, text_col, row_col, k), at, "sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "k1", "k2", F.col("n_shingles").alias("n"), "sketch")).alias("r")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(best).select("digest", "r.doc_id", "r.row", "r.k1", "r.k2", "r.n", "r.sketch").withColumn("cid", F.monotonically_increasing_id())
    classes = table(classes, at, "classes")
    rows = table(rows.select("doc_id", "row", "n_shingles", "digest"), at, "rows")
    drop(spark, at, "sketches")
    # lists
    values = classes.select("cid", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    exact = F.floor((F.col("n") * threshold_pct + 99) / 100)
    need = F.least(_least(F.floor(F.col("n") * 100 / threshold_pct), exact if k is None else F.lit(k), k, t), exact).cast("int")
    shared = values.join(often.hint("merge"), "v").groupBy("cid", "n").agg(F.collect_list(F.struct("df", "v")).alias("x")).withColumn("need", need).where(F.size("x") >= F.col("need"))
    # how common a class's values are: the text that others were copied from comes first
    central = F.aggregate("x", F.lit(0).cast("long"), lambda acc, e: acc + e["df"])
    chosen = shared.select("cid", central.alias("central"), F.slice(F.array_sort("x"), 1, F.greatest(F.size("x") - F.col("need") + 1, F.lit(0))).alias("x"))
    chosen = table(chosen, at, "chosen")
    entries = table(chosen.select("cid", "central", F.explode("x").alias("e")).select("cid", "central", F.col("e.v").alias("v")), at, "entries")
    # texts of the classes that are in lists
    cand = entries.select("cid").distinct().join(classes.select("cid", "k1", "k2"), "cid")
    tx = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.xxhash64(F.col(id_col), tx).alias("k1"), F.xxhash64(tx, F.col(id_col), F.lit(1)).alias("k2"), tx.alias("text"))
    texts = table(source.join(cand, ["k1", "k2"]).select("cid", "text").dropDuplicates(["cid"]), at, "texts")
    labels, labels_at = spark.createDataFrame([], "node long, label long"), None
    links = []

    def open_lists(left, labels):
        e = left.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("v", "cid", "central", F.coalesce("label", "cid").alias("label"))
        lists = e.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v")
        return e.join(lists, "v")

    left = entries
    for r in range(ROUNDS + 1):
        e = table(open_lists(left, labels), at, f"open-{r}")
        drop(spark, at, f"open-{r - 1}" if r else "entries")
        if not e.limit(1).count():
            break
        if r < ROUNDS:
            # the most central member leads; it meets all others of its list now and leaves the list
            best = F.max(F.struct("central", (-F.col("cid")).alias("neg"), F.col("label").alias("lead_label")))
            lead = e.groupBy("v").agg(best.alias("m")).select("v", (-F.col("m.neg")).alias("lead"), "m.lead_label")
            led = e.join(lead, "v").where("cid <> lead")
            left = led.select("v", "cid", "central")
            pairs = led.where("label <> lead_label")
            pairs = pairs.select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b"))
            likely = _estimated(pairs.distinct(), classes, threshold_pct, k)
        else:
            likely = _across(e, chosen, classes, threshold_pct, k)
        good = table(_confirmed(likely, texts, words, threshold_pct), at, f"links-{r}")
        links.append(good)
        if good.limit(1).count():
            labels = joined(labels, good, at, f"round-{r}")
            if labels_at:
                drop(spark, at, labels_at)
            labels_at = f"round-{r}-labels"
    drop(spark, at, "chosen", "texts", f"open-{r}")
    # back to rows
    named = classes.select("digest", "cid", "doc_id", "row").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("r")
    first = named.groupBy("label").agg(best).select("label", F.col("r.doc_id").alias("component_id"), F.col("r.row").alias("keep_row"))
    counts = None
    for x in links:
        ends = x.select(F.explode(F.array("a", "b")).alias("cid"))
        counts = ends if counts is None else counts.union(ends)
    counts = counts.groupBy("cid").agg(F.count(F.lit(1)).alias("n_joining_links")) if counts is not None else spark.createDataFrame([], "cid long, n_joining_links long")
    by_class = named.join(first, "label").join(counts, "cid", "left").select("digest", "component_id", "keep_row", F.coalesce("n_joining_links", F.lit(0)).alias("n_joining_links"))
    out = rows.where("n_shingles > 0").select("doc_id", "row", "n_shingles", "digest").join(by_class, "digest")
    empty = rows.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("keep_row"), F.lit(0).cast("long").alias("n_joining_links"))
    every = out.select("doc_id", "row", "n_shingles", "component_id", "keep_row", "n_joining_links").unionByName(empty)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) if row_col is None else F.col("row") == F.col("keep_row")
    return every.select(*([] if row_col is None else [F.col("row").alias(row_col)]), "doc_id", "n_shingles", "component_id", "n_joining_links", kept.alias("kept"))
