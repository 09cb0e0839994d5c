"""Mixing sources to target weights, with DataFrame functions only.

Words of a source form a stream, which is cut into blocks of fixed length (shorter ones for a source of few words, so that
its target is met as well). The mix is drawn shard by shard: a table of draws holds, for each output shard and source, how
many slots of the shard the source fills. Given what a source fills in all, its counts by shard are multinomial: each of
its slots falls on a shard by a uniform draw, and the draws are counted. Prefix sums over the draws number the slots of a
source; slot k is mapped to a block by a pseudorandom permutation of the source's block numbers, another one in each
epoch, so no block is used again before all have been used, and slots meet their blocks by an equi-join on (source, block
number). What a row gives to the mix is the sum over the shards.

Nothing depends on how the table is read: the order of a stream goes by hashes of ids and texts. Prefix sums over a
source go in steps: buckets of the key, keys in a bucket, rows of a key, so a source or a copied row that holds a third
of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm.common import WORD, partitions, shared_dir, table

BLOCK = 16
WEIGHTS = (5.0, 2.0, 1.0)
SHARD_SLOTS = 4096
#: Blocks that a source has at least, if it has as many words.
LEAST_BLOCKS = 256
#: Rows of a bucket of the order, shards of a bucket of shards, and the parts that equal rows are dealt to.
BUCKET_ROWS, BUCKET_SHARDS, PARTS = 16_384, 4096, 64
CHUNK = 8_192
#: Enough steps of the walk: the domain exceeds the blocks by a part of at most 1/28, or by less than 30 numbers.
WALK = 30


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, source_size) with target: weights repeat over the sources in code-point order, null last; a target
    stops at most times its source's size and the excess goes to the others by weight.

    The solution is min(most * size, level * weight) with one level for all, found from running sums over the sources in
    the order in which they reach their limit. The table has a row for each source, not for each document.
    """
    one = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("limit", most * F.col("source_size")).withColumn("reach", F.col("limit") / F.col("weight"))
    order = one.orderBy("reach", "rank")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(one)
    level = w.withColumn("level", (share * total - before) / rest)
    level = level.withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "rank", "level"))).over(one)["level"])
    return level.select("source", "source_size", "rank", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def _mix(*parts) -> F.Column:
    return F.xxhash64(*parts)


def permuted(k: F.Column, n: F.Column, seed: list[F.Column]) -> F.Column:
    """Where a pseudorandom permutation of 0..n-1 puts k: a Feistel network on a p by q grid, walked until it lands below n."""
    p = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    q = F.ceil(n / p).cast("long")

    def once(x):
        def half(acc, r):
            move_a = F.struct(F.pmod(acc["a"] + F.pmod(_mix(r, acc["b"], *seed), p), p).alias("a"), acc["b"].alias("b"))
            move_b = F.struct(acc["a"].alias("a"), F.pmod(acc["b"] + F.pmod(_mix(r, acc["a"], *seed), q), q).alias("b"))
            return F.when(r % 2 == 0, move_a).otherwise(move_b)

        begin = F.struct(F.floor(x / q).cast("long").alias("a"), F.pmod(x, q).alias("b"))
        return F.aggregate(F.array(*map(F.lit, range(4))), begin, half, lambda acc: acc["a"] * q + acc["b"])

    first = once(k)
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walked)


def _before(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the earlier rows of their keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))


def draw_counts(targets: DataFrame, at: str, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """rank, shard, length (of a block), blocks, n: how many slots of the shard the source fills, and base: how many of the shards before."""
    length = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    t = targets.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")))
    # a slot gives a block's mean words
    t = t.withColumn("slots", F.least(2 * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).cast("long"))
    t = t.withColumn("shards", F.ceil(F.sum("slots").over(Window.partitionBy(F.lit(0))) / SHARD_SLOTS)).where("slots > 0")
    chunks = t.select("rank", "length", "blocks", "slots", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    # by number, so that these few rows aren't coalesced before they grow
    chunks = chunks.repartition(partitions(targets.sparkSession), "rank", "chunk")
    last = F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1
    drawn = chunks.select("rank", "length", "blocks", "shards", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("draw"))
    drawn = drawn.select("rank", "length", "blocks", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "rank", "draw"), "shards").alias("shard"))
    counts = drawn.groupBy("rank", "length", "blocks", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("many", F.floor(F.col("shard") / BUCKET_SHARDS))
    counts = table(counts, at, "counts")
    wide = _before(counts.groupBy("rank", "many").agg(F.sum("n").alias("all")), ["rank"], ["many"], "all", "start").select("rank", "many", "start")
    near = _before(counts, ["rank", "many"], ["shard"], "n", "inside")
    return near.join(wide, ["rank", "many"]).select("rank", "shard", "length", "blocks", "n", (F.col("start") + F.col("inside")).alias("base"))


def plan_slots(draws: DataFrame, seed: int = 1) -> DataFrame:
    """shard, rank, slot (number within the source), block: every slot of the mix, from the counts of draw_counts()."""
    dealt = draws.repartition(partitions(draws.sparkSession), "rank", "shard")
    slots = dealt.select("shard", "rank", "blocks", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("slot"))
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    at = permuted(F.pmod("slot", "blocks"), F.col("blocks"), [F.lit(seed), F.col("rank"), epoch])
    return slots.select("shard", "rank", "slot", at.alias("block"))


def _offsets(sized: DataFrame, buckets: int) -> DataFrame:
    """sized (row_no, rank, size, h1, h2, ..) with start: words of its source before it. Rows are ordered by h1, h2; rows that
    are equal in both are alike, whichever comes first."""
    keyed = sized.withColumn("bucket", F.floor(F.shiftrightunsigned("h1", 32) * buckets / (1 << 32))).withColumn("part", F.pmod(F.xxhash64("row_no"), F.lit(PARTS)))
    keyed = keyed.repartition("rank", "bucket", "part")
    key = ["rank", "bucket", "part", "h1", "h2"]
    inside = _before(keyed, key, ["row_no"], "size", "inside")
    sums = keyed.groupBy(*key).agg(F.sum("size").alias("words"))
    sums = _before(sums, ["rank", "bucket"], ["h1", "h2", "part"], "words", "upto")
    wide = keyed.groupBy("rank", "bucket").agg(F.sum("size").alias("all"))
    wide = _before(wide, ["rank"], ["bucket"], "all", "base").select("rank", "bucket", "base")
    found = inside.join(sums.drop("words"), key).join(wide, ["rank", "bucket"])
    return found.withColumn("start", F.col("base") + F.col("upto") + F.col("inside")).drop("bucket", "part", "inside", "upto", "base", "h1", "h2")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, block: int = BLOCK, seed: int = 1, keep: tuple[str, ...] = ()):
    """(rows, slots, pieces).

    rows: row_no, keep columns, doc_id, source, size, source_size, target, taken, a row for each row of docs. slots: see plan_slots().
    pieces: shard, rank, slot, row_no, first, words - which words of which row fill a slot.

    A document of no words (or null text) has size 0 and takes 0; a null source is a source of its own, ordered last;
    rows that repeat an id count one by one. The same rows give the same mix, however they are read or dealt. A document
    takes at most twice its size, because a source has at most twice as many slots as blocks.
    """
    at = shared_dir(docs.sparkSession)
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    doc, text = F.col(id_col), F.col(text_col)
    own = [F.xxhash64(F.lit(seed), doc, text).alias("h1"), F.xxhash64(text, doc, F.lit(seed)).alias("h2")]
    read = docs.select(*kept, doc.alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), *own, F.monotonically_increasing_id().alias("row_no"))
    sized = table(read, at, "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    buckets = max(1, -(-(sizes.agg(F.max("rows")).head()[0] or 0) // BUCKET_ROWS))
    targets = table(source_targets(sizes.drop("rows"), share), at, "targets")
    draws = table(draw_counts(targets, at, block, seed), at, "draws")
    slots = plan_slots(draws, seed)
    named = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(sized["*"], targets["rank"], targets["source_size"], targets["target"])
    placed = _offsets(named.select("row_no", "rank", "size", "h1", "h2").where("size > 0"), buckets).join(draws.select("rank", "length").distinct(), "rank")
    length, end = F.col("length"), F.col("start") + F.col("size")
    spans = placed.select("row_no", "rank", "size", "start", "length", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * length)
    spans = spans.select("row_no", "rank", "block", (first - F.col("start")).alias("first"), (F.least(end, (F.col("block") + 1) * length) - first).alias("words"))
    # merge joins: the planner takes exploded rows for as few as they came from, and would broadcast them
    pieces = spans.join(slots.hint("merge"), ["rank", "block"]).select("shard", "rank", "slot", "row_no", "first", "words")
    used = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = spans.join(used.hint("merge"), ["rank", "block"]).groupBy("row_no").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    back = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    rows = named.join(taken.hint("merge"), "row_no", "left").select("row_no", *back, "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return rows, slots, pieces
