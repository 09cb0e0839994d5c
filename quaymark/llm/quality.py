"""Quality rules and robust multivariate outliers, with DataFrame functions only.

Each text becomes a vector of transformed statistics. For every language and source the minimum covariance determinant
is estimated: from three deterministic starts, concentration steps keep the part HALF of rows that lie nearest to the
current centre and re-estimate centre and covariance from them, and the start that ends with the smallest determinant
wins. Rows whose squared Mahalanobis distance exceeds a chi-square quantile are outliers. To the covariance comes, row by row,
what a text of that length can't resolve: the mean word length of 60 words varies more than that of 6000, and one symbol,
line or repetition is a leap where none is usual.

A step is one join of the statistics with a table of a row per group and one aggregation with partial sums, so a hot
source is summed in many tasks. The quantile that bounds the nearest rows is taken from exact counts in narrow bins of
the distance, which also makes reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm.common import SPACE, shared_dir, table

SYMBOLS = r"[^#*$%&|<>]+"
FEATURES = ("f0", "f1", "f2", "f3")
D = len(FEATURES)
HALF = 0.75
STEPS = 4
#: Shares that are as good as none: symbols a character and repeated lines a word in percent, repeated words a word.
FEW_SYMBOLS, FEW_LINES, FEW_REPEATS = 0.1, 0.1, 0.015
#: Words in one repetition of a window of three.
REPEAT = 6
#: Quantile beyond which a row is an outlier.
QUANTILE = 1 - 1e-6
#: Groups of fewer rows take the estimate of all rows with their first group column; where these are fewer too, there is no
#: estimate and no row is an outlier.
LEAST_ROWS = 5 * D
BINS = 16  # a power of two of the distance


def _chi2_cdf(x: float, d: int) -> float:
    """For even d."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, d) < p else (lo, mid)
    return hi


#: Makes the covariance of the nearest part consistent for normal data.
CONSISTENCY = HALF / _chi2_cdf(chi2_quantile(HALF, D), D + 2)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, keep.., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: a row for each row of docs.

    Null text has no words, symbols or lines. The windows of three words are compared by 64-bit hashes; equal ones are
    found by sorting hashes that carry the window's number in their low bits, so a text of n words costs n log n.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("doc_id"), *keep, t.alias("t"))
    a = a.select("*", F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    a = a.select(
        "doc_id", *keep, F.size("w").cast("long").alias("n_words"), F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    n = F.greatest(F.size("h") - 2, F.lit(0))
    tri = F.transform(F.slice("h", 1, n), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)))
    a = a.select("*", tri.alias("tri"), F.pow(F.lit(2.0), F.ceil(F.log2(F.size("h") + 2.0))).cast("long").alias("p"))
    a = a.select("*", F.sort_array(F.transform("tri", lambda x, i: x - F.pmod(x, F.col("p")) + i)).alias("s"))
    at = lambda k: F.get("tri", F.pmod(k, F.col("p")).cast("int"))
    same = lambda k, j: (at(k) == at(F.get("s", j - 1))) | (at(k) == at(F.get("s", j + 1)))
    a = a.select("*", F.sort_array(F.transform(F.filter("s", lambda k, j: F.coalesce(same(k, j), F.lit(False)) | F.coalesce(at(k) == at(F.get("s", j + 1)), F.lit(False))), lambda k: F.pmod(k, F.col("p")))).alias("hit"))
    covered = F.aggregate(F.transform("hit", lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("hit", j + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return a.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(stats: DataFrame) -> DataFrame:
    """stats with f0.. and r0.., the squares of what each feature resolves in a text of that length."""
    n, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns(
        {
            "f0": 2 * F.log(F.col("word_chars") / n + 1.0),
            "f1": F.log1p(100.0 * F.col("n_symbols") / c),
            "f2": F.log1p(100.0 * F.col("n_dup_lines") / n),
            "f3": 2.0 * F.col("n_repeat_words") / n,
            # word lengths vary about as much as counts of that mean do
            "r0": 4.0 * (c / n) / n / F.pow(c / n + 1.0, 2),
            "r1": F.pow(F.log1p(100.0 / c), 2) + math.log1p(FEW_SYMBOLS) ** 2,
            "r2": F.pow(F.log1p(100.0 / n), 2) + math.log1p(FEW_LINES) ** 2,
            "r3": F.pow(2.0 * REPEAT / n, 2) + (2.0 * FEW_REPEATS) ** 2,
        }
    )


_R = [f"r{i}" for i in range(D)]
_C = [f"c{i}{j}" for i in range(D) for j in range(i + 1)]
_M = [f"m{i}" for i in range(D)]
_L = [f"l{i}{j}" for i in range(D) for j in range(i + 1)]


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, centre m0.., consistent covariance c00.., and det, of the covariance with the rows' mean resolution."""
    sums = [F.count(F.lit(1)).alias("n")] + [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    sums += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)] + [F.avg(r).alias(r) for r in _R]
    g = rows.groupBy(*keys).agg(*sums).withColumns({c: CONSISTENCY * F.col(c) for c in _C})
    det = F.lit(1.0)
    for i in range(D):
        det = det * F.col(f"l{i}{i}")
    return _factored(g).select(*keys, "n", *_M, *_C, det.alias("det"))


def _factored(rows: DataFrame) -> DataFrame:
    """rows (c00.., r0..) with the Cholesky factor l00.. of the covariance plus the row's resolution."""
    for i in range(D):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}") + F.col(f"r{i}") if i == j else F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # a pivot is never less than the resolution, but for rounding
            rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.col(f"r{i}") / 2)) if i == j else v / F.col(f"l{j}{j}"))
    return rows


def _distance(rows: DataFrame, name: str) -> DataFrame:
    """rows (f0.., r0.., m0.., c00..) with the squared Mahalanobis distance by forward substitution."""
    rows = _factored(rows)
    for i in range(D):
        v = F.col(FEATURES[i]) - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", v / F.col(f"l{i}{i}"))
    return rows.withColumn(name, sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, D)), F.col("z0") * F.col("z0"))).drop(*_L, *_M, *_C, *[f"z{i}" for i in range(D)])


def _nearest(rows: DataFrame, dist: F.Column, keys: list[str], part: float) -> DataFrame:
    """Rows of the lowest bins of dist that hold at least that part of their group."""
    b = rows.withColumn("bin", F.floor(F.log2(dist + 1e-6) * BINS))
    counts = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys)
    running = counts.select(*keys, "bin", F.sum("k").over(w.orderBy("bin")).alias("upto"), F.sum("k").over(w).alias("all"))
    last = running.where(F.col("upto") >= part * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("last"))
    return b.join(last, keys).where("bin <= last").drop("bin", "last")


def mcd(rows: DataFrame, at: str) -> DataFrame:
    """grp and the estimate of the best start. rows: (grp, f0.., r0..). Groups below LEAST_ROWS are left out."""
    med = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f, 0.5, 1000).alias(f"med{i}") for i, f in enumerate(FEATURES)]).where(F.col("n") >= LEAST_ROWS)
    med = table(med, at, "medians")
    dev = rows.join(med, "grp")
    mad = table(dev.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(f) - F.col(f"med{i}")), 0.5, 1000).alias(f"mad{i}") for i, f in enumerate(FEATURES)]), at, "deviations")
    z = [F.abs(F.col(f) - F.col(f"med{i}")) / F.sqrt(F.pow(1.4826 * F.col(f"mad{i}"), 2) + F.col(f"r{i}")) for i, f in enumerate(FEATURES)]
    square = z[0] * z[0] + z[1] * z[1] + z[2] * z[2] + z[3] * z[3]
    starts = F.array(square, z[0] + z[1] + z[2] + z[3], F.greatest(*z))
    rows3 = dev.join(mad, "grp").select("grp", *FEATURES, *_R, F.posexplode(starts).alias("start", "d0"))
    est = table(_estimate(_nearest(rows3, F.col("d0"), ["grp", "start"], 0.5), ["grp", "start"]), at, "step-0")
    for k in range(1, STEPS + 1):
        near = _nearest(_distance(rows.join(est.drop("n"), "grp"), "d"), F.col("d"), ["grp", "start"], HALF)
        est = table(_estimate(near, ["grp", "start"]), at, f"step-{k}")
    best = est.groupBy("grp").agg(F.min(F.struct("det", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    return est.join(best, ["grp", "start"]).drop("start", "n")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """A row for each row of docs: doc_id, group columns, the base statistics, base_failed, distance2, kept.

    The estimate uses rows that pass the base rules. Where a group has fewer than LEAST_ROWS of them, its rows are held
    against all rows that share its first group column; distance2 is null, and the row is no outlier, where these are too
    few as well. Only an excess of symbols or repetition, or odd word lengths, makes a vector odd; the
    length of a text is no feature. Null groups are groups of their own. Repeated rows count one by one.
    """
    at = shared_dir(docs.sparkSession)
    name = lambda cols: F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols]), {"ignoreNullFields": "false"})
    stats = table(features(statistics(docs, id_col, text_col, group_cols)).withColumn("own", name(group_cols)).withColumn("wide", name(group_cols[:1])).withColumn("base_failed", base_failed()), at, "statistics")
    good = stats.where("not base_failed")
    # a row a group: where an estimate of its own is wanting
    small = stats.groupBy("own", "wide").agg(F.count_if(~F.col("base_failed")).alias("n")).where(F.col("n") < LEAST_ROWS)
    small = table(small.select("own", "wide"), at, "small")
    wide = good.join(small.select("wide").distinct(), "wide", "left_semi").select(F.concat(F.lit("all "), "wide").alias("grp"), *FEATURES, *_R)
    est = table(mcd(good.select(F.col("own").alias("grp"), *FEATURES, *_R).unionByName(wide), at), at, "estimates")
    cut = chi2_quantile(QUANTILE, D)
    named = stats.join(small.select("own", F.lit(True).alias("few")), "own", "left").withColumn("grp", F.when(F.col("few"), F.concat(F.lit("all "), "wide")).otherwise(F.col("own")))
    scored = _distance(named.join(est, "grp", "left"), "distance2")
    return scored.select(
        "doc_id", *group_cols, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2",
        (~F.col("base_failed") & F.coalesce(F.col("distance2") <= cut, F.lit(True))).alias("kept"),
    )
