"""Exact deduplication by distributed most-significant-digit radix partitioning.

A round reads one digit, a stretch of successive bytes of the normalised text, and splits every group by it. Groups of
one row are done; so are the rows whose text ended, which are equal to each other byte for byte. What remains goes into
the next round with the rest of its bytes, and digits grow, so a text of n bytes takes about log16(n) rounds. Equality
is decided on bytes alone; no digest takes part.

Splitting is a count by (group, digit) with partial sums before its shuffle and a join back, which adaptive execution
splits where one group is hot. No group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import SPACE, shared_dir, table

#: Bytes of the digits, round by round; the last is repeated times 16.
DIGITS = (32, 512, 8192)


def normalised(text: F.Column) -> F.Column:
    """Without any character of [\\x20\\x09-\\x0D]; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _split(cur: DataFrame, width: int) -> DataFrame:
    """cur (.., grp, rest) with the group of each row after one digit: n is null where it stands alone, ended where its text is over."""
    keyed = cur.withColumn("digit", F.substring("rest", 1, width)).withColumn("ended", F.octet_length("rest") <= width)
    keys = ["grp", "digit", "ended"]
    groups = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("next", F.monotonically_increasing_id())
    return keyed, groups, keys


def radix_groups(rows: DataFrame, norm: str, at: str) -> DataFrame:
    """rows without the column norm (binary), with row_no and the group: equal texts share one, rows of their own have null.

    Ties, repeated rows and empty texts are ordinary members of groups; an empty table gives an empty table.
    """
    names = [c for c in rows.columns if c != norm]
    cur = rows.select(*names, F.col(norm).alias("rest"), F.lit(0).cast("long").alias("grp")).withColumn("row_no", F.monotonically_increasing_id())
    done, k, width = [], 0, DIGITS[0]
    while True:
        keyed, groups, keys = _split(cur, width)
        groups = table(groups, at, f"groups-{k}")
        # the row number is fixed by the first written table; before that nothing depends on it
        joined = keyed.join(groups.hint("shuffle_hash") if k == 0 else groups, keys, "left").select(
            *names, "row_no", F.col("next").alias("grp"), F.when(F.col("n").isNotNull() & ~F.col("ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest")
        )
        step = table(joined, at, f"round-{k}")
        done.append(step.where("rest is null").select(*names, "row_no", F.struct(F.lit(k).alias("round"), "grp").alias("g")))
        cur = step.where("rest is not null")
        if not groups.where("not ended").limit(1).count():
            break
        k += 1
        width = DIGITS[k] if k < len(DIGITS) else width * 16
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*names, "row_no", F.when(F.col("g.grp").isNotNull(), F.col("g")).alias("group"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: keep columns, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the most code points in its original text stays, then the smallest id; rows
    that repeat an id and a text count one by one, and one of them stays. A null id ranks after all others; keep_id is
    then null. Null text is empty text, and all empty texts are one group. Other columns of docs don't matter.
    """
    at = shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(F.col(text_col))
    rows = docs.select(*keep, F.col(id_col).alias("doc_id"), F.length(text).alias("points"), norm.alias("norm")).select(*keep, "doc_id", "points", F.sha2("norm", 256).alias("text_sha256"), F.col("norm").cast("binary").alias("norm"))
    grouped = radix_groups(rows, "norm", at)
    alone = grouped.where("group is null").select(*keep, "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    same = grouped.where("group is not null")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_no"))
    chosen = same.groupBy("group").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    copies = same.join(chosen, "group").select(
        *keep, "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("best.row_no")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(copies)
