"""Tests of profiles across a cohort, with family-wise correction by permutation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.student import r_to_p, t_to_p
from ..functions.vectors import format_number
from ..plans.stash import stash
from .permuted import extremes, longest_runs

CELL = ["bundle", "position"]
#: Subjects of a cohort, at most: its table reaches the driver and is broadcast. Bundles whose sizes do so; rows of a table of permutations.
SUBJECTS, BUNDLES, DEALT = 100_000, 10_000, 2_000_000


def subject_rows(cohort: DataFrame, *columns: str) -> list[Row]:
    """The cohort's rows by subject; more than ``SUBJECTS`` is an error."""
    rows = cohort.select("subject", *columns).orderBy("subject").limit(SUBJECTS + 1).collect()
    if len(rows) > SUBJECTS:
        raise ValueError(f"over {SUBJECTS} subjects")
    return rows


def small(cohort: DataFrame, *columns: str) -> DataFrame:
    """The cohort as a broadcast of checked size."""
    return F.broadcast(cohort.sparkSession.createDataFrame(subject_rows(cohort, *columns), cohort.select("subject", *columns).schema))


def slopes_of(sums: np.ndarray, k: int) -> np.ndarray:
    """Slopes of ``k`` regressors from rows of n, sums of x, products of x (upper triangle) and products with y, y's sum first; least ones where they aren't unique."""
    n = np.maximum(sums[:, 0], 1)[:, None]
    x, sy = sums[:, 1 : 1 + k], sums[:, 1 + k : 2 + k]
    i, j = np.triu_indices(k)
    xx = np.empty((len(sums), k, k))
    xx[:, i, j] = xx[:, j, i] = sums[:, 2 + k : 2 + k + len(i)]
    xy = sums[:, 2 + k + len(i) :] - x * sy / n
    return (np.linalg.pinv(xx - x[:, :, None] * x[:, None, :] / n[:, :, None], rcond=1e-10, hermitian=True) @ xy[..., None])[..., 0]


def unconfound(values: DataFrame, cohort: DataFrame, confounds: list[str], group: str | None = None, by: list[str] | None = None, value: str = "mean") -> DataFrame:
    """Values less the confounds' fitted slopes; the intercept, and the group's part, stay.

    A cell's fit is over the subjects that have a value in it, by its normal equations: sums of products, one aggregation. Regressors are
    counted from their cohort's mean, so that sums keep their digits. Null and NaN values stay as they are and count for no fit; subjects outside the cohort are left out.
    """
    by = by or CELL
    names = [*confounds, *([group] if group else [])]
    k, rows = len(names), subject_rows(cohort, *names)
    mean = np.array([[float(v) for v in r[1:]] for r in rows]).mean(0) if rows else np.zeros(k)
    table = [(r[0], *(float(v) - float(m) for v, m in zip(r[1:], mean, strict=True))) for r in rows]
    x = [f"x{i}_" for i in range(k)]
    known = values.sparkSession.createDataFrame(table, f"subject {dict(cohort.dtypes)['subject']}, " + ", ".join(f"{c} double" for c in x))
    joined = values.join(F.broadcast(known), "subject")
    y = F.col(value).cast("double")
    has = joined.where(y.isNotNull() & ~F.isnan(y))
    pairs = [F.col(x[i]) * F.col(x[j]) for i, j in zip(*np.triu_indices(k), strict=True)]
    parts = [F.lit(1.0), *map(F.col, x), y, *pairs, *(F.col(c) * y for c in x)]
    sums = has.groupBy(*by).agg(F.array(*(F.sum(p) for p in parts)).alias("sums_"))

    @F.pandas_udf("array<double>")
    def solved(column: pd.Series) -> pd.Series:
        return pd.Series(list(slopes_of(np.stack(column.to_numpy()), k))) if len(column) else pd.Series([], dtype=object)

    slopes = sums.select(*by, solved("sums_").alias("b_"))
    shift = [F.col(x[i]) + F.lit(float(mean[i])) for i in range(len(confounds))]
    fitted = sum((F.col("b_")[i] * shift[i] for i in range(1, len(confounds))), F.col("b_")[0] * shift[0])
    return joined.join(slopes, by, "left").withColumn(value, F.col(value) - F.coalesce(fitted, F.lit(0.0))).select(*values.columns)


def target_unconfounded(cohort: DataFrame, confounds: list[str], target: str = "target") -> DataFrame:
    """The cohort with its target less the confounds' slopes; other columns stay."""
    one = unconfound(cohort.select("subject", F.lit(0).alias("one_"), F.col(target).cast("double").alias(target)), cohort, confounds, by=["one_"], value=target)
    return cohort.drop(target).join(F.broadcast(small(one, target)), "subject")


def student_t(sums: list[Column]) -> Column:
    """Pooled t from n, sum and sum of squares of two groups (0, then 1)."""
    n0, s0, q0, n1, s1, q1 = sums
    m0, m1 = s0 / n0, s1 / n1
    ss = F.greatest(q0 - s0 * m0, F.lit(0.0)) + F.greatest(q1 - s1 * m1, F.lit(0.0))
    var = ss / (n0 + n1 - 2) * (1 / n0 + 1 / n1)
    return F.when((n0 > 0) & (n1 > 0) & (n0 + n1 > 2) & (var > 0), (m0 - m1) / F.sqrt(var))


def t_statistics(df: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """``t, df`` by cell. Deviations are taken from the cell's mean of both groups, so sums of squares keep their digits."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("m_"))
    d = F.col(value) - F.col("m_")
    parts = []
    for g in (0, 1):
        on = F.col(group) == g
        parts += [F.sum(on.cast("int")), F.sum(F.when(on, d).otherwise(0.0)), F.sum(F.when(on, d * d).otherwise(0.0))]
    return df.join(mean, by).groupBy(*by).agg(student_t(parts).alias("t"), (F.count("*") - 2).alias("df"))


def ttest_ind(values: DataFrame, cohort: DataFrame, by: list[str] | None = None, value: str = "mean", group: str = "grp") -> DataFrame:
    """Student's t of group 0 less group 1 and its two-sided p, by cell; null where undefined."""
    joined = values.join(small(cohort, group), "subject")
    return t_statistics(joined, by or CELL, value, group).withColumn("p", t_to_p(F.col("t"), F.col("df")))


def pearson(values: DataFrame, cohort: DataFrame, by: list[str] | None = None, value: str = "mean", target: str = "target") -> DataFrame:
    """Correlation with the target and its two-sided p, by cell."""
    joined = values.join(small(cohort, target), "subject")
    stats = joined.groupBy(*(by or CELL)).agg(F.nanvl(F.corr(value, target), F.lit(None).cast("double")).alias("r"), F.count("*").alias("n"))
    return stats.withColumn("p", r_to_p(F.col("r"), F.col("n")))


def permutations(cohort: DataFrame, nperm: int, seed: int, column: str) -> DataFrame:
    """C4: ``perm, subject, label``: the column's values dealt out anew for each permutation, by the order of md5(seed:perm:subject)."""
    rows = subject_rows(cohort, column)
    places = cohort.sparkSession.createDataFrame([(k, r[1]) for k, r in enumerate(rows, 1)], f"k int, label {dict(cohort.dtypes)[column]}")
    draws = small(cohort).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(nperm - 1))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("subject").cast("string")))
    order = Window.partitionBy("perm").orderBy(key, "subject")
    return draws.withColumn("k", F.row_number().over(order)).join(F.broadcast(places), "k").select("perm", "subject", "label")


def permutation_stats(values: DataFrame, perms: DataFrame, mode: str, by: list[str] | None = None, value: str = "mean") -> DataFrame:
    """``perm, by.., t (or r)``: the statistic of each permutation and cell, by join and aggregation.

    Cells hold at most one value a subject, so the join has permutations x values rows; see
    :func:`permutation_matrix` for whole matrices.
    """
    by = by or CELL
    few = perms.limit(DEALT + 1).count() <= DEALT
    joined = values.select("subject", *by, value).join(F.broadcast(perms) if few else perms, "subject")
    if mode == "group":
        return t_statistics(joined, ["perm", *by], value, "label")
    return joined.groupBy("perm", *by).agg(F.corr(value, "label").alias("r"), F.count("*").alias("n"))


def permutation_matrix(values: DataFrame, cohort: DataFrame, column: str, nperm: int, seed: int, mode: str, by: list[str] | None = None, value: str = "mean", family: list[str] | None = None) -> DataFrame:
    """C5 and the first half of C6 at speed: ``family.., perm, df, stat_max, stat_min, abs_max`` over blocks of cells; see :mod:`permuted`.

    A cell counts the subjects that it has, so cells differ in degrees of freedom; the extremes are kept for each ``df``.
    """
    return extremes(values, subject_rows(cohort, column), nperm, seed, mode, by or CELL, value, family or [])


def pick(df: DataFrame, value: str, alpha: float, nperm: int, family: list[str] | None = None) -> DataFrame:
    """The value at index round(alpha * nperm), from 0, of the ascending order in each family; a family has a row for each permutation."""
    at = min(round(alpha * nperm), nperm - 1)
    if not family:
        return df.orderBy(value).limit(at + 1).orderBy(F.desc(value)).limit(1).select(value)
    w = Window.partitionBy(*family).orderBy(value, "perm")
    return df.withColumn("r_", F.row_number().over(w) - 1).where(F.col("r_") == at).select(*family, F.col(value))


def alpha_fwe(extremes: DataFrame, alpha: float, nperm: int, family: list[str] | None = None, mode: str = "group") -> DataFrame:
    """The corrected alpha: the least p of each permutation, in order, at alpha. For one ``df``, the least p is that of the largest statistic."""
    family = family or []
    p = t_to_p(F.col("abs_max"), F.col("df")) if mode == "group" else r_to_p(F.col("abs_max"), F.col("df") + 2)
    least = extremes.withColumn("p_", F.coalesce(p, F.lit(1.0))).groupBy(*family, "perm").agg(F.min("p_").alias("alpha_fwe"))
    return pick(least, "alpha_fwe", alpha, nperm, family)


def stat_fwe(extremes: DataFrame, alpha: float, nperm: int, family: list[str] | None = None) -> DataFrame:
    """The signed statistic's maximum of each permutation, in descending order, at alpha."""
    family = family or []
    down = extremes.groupBy(*family, "perm").agg((-F.max("stat_max")).alias("neg_"))
    return pick(down, "neg_", alpha, nperm, family).withColumn("stat_fwe", -F.col("neg_")).drop("neg_")


def runs(df: DataFrame, hit: Column, by: list[str]) -> DataFrame:
    """Maximal runs of consecutive hits by position: ``by.., island, run`` on the hitting rows."""
    w = Window.partitionBy(*by).orderBy("position")
    marked = df.where(hit).withColumn("island", F.col("position") - F.row_number().over(w))
    return marked.withColumn("run", F.count("*").over(Window.partitionBy(*by, "island")))


def significant_areas(p: DataFrame, least: int | Column, alpha: float | Column, by: list[str] | None = None) -> DataFrame:
    """``significant`` 1 on runs of at least ``least`` positions with p <= alpha."""
    by = by or ["bundle"]
    found = runs(p, F.col("p") <= alpha, by).where(F.col("run") >= least).select(*by, "position", F.lit(1).alias("significant"))
    return p.join(found, [*by, "position"], "left").fillna(0, ["significant"])


def max_run(p: DataFrame, thr: float, by: list[str]) -> DataFrame:
    """The longest run of p < thr, plus one (1 where there is none)."""
    top = runs(p, F.col("p") < thr, by).groupBy(*by).agg((F.max("run") + 1).alias("max_run"))
    return p.select(*by).distinct().join(top, by, "left").fillna(1, ["max_run"])


def cluster_fwe(longest: DataFrame, values: DataFrame, alpha: float, nperm: int, family: list[str] | None = None) -> DataFrame:
    """The cluster size (longest run, plus one) of the permutations, in descending order, at alpha. Permutations without a row have no run; ``values`` name the families."""
    family = family or []
    every = (values.select(*family).distinct() if family else values.sparkSession.range(1).select()).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(nperm - 1))))
    sizes = every.join(longest, [*family, "perm"], "left").withColumn("neg_", -(F.coalesce("longest", F.lit(0)) + 1))
    return pick(sizes, "neg_", alpha, nperm, family).withColumn("cluster_fwe", -F.col("neg_")).drop("neg_")


def with_correction(stats: DataFrame, corrected: DataFrame, joint: bool) -> DataFrame:
    """``stats`` with its bundle's corrected threshold, or the one (a single row) for all."""
    return stats.crossJoin(F.broadcast(corrected.limit(1))) if joint else stats.join(corrected, "bundle")


def result_table(stats: DataFrame, corrected: DataFrame, stat: str = "t", joint: bool = False) -> DataFrame:
    """Bundle, corrected alpha or cluster size, least p (alpha only) and the statistic there (the first position of several), as text."""
    best = stats.where(F.col("p").isNotNull()).groupBy("bundle").agg(F.min(F.struct("p", "position", stat)).alias("b_"))
    joined = with_correction(best, corrected, joint)
    at_best = format_number(F.col(f"b_.{stat}")).alias("t_value")
    if "cluster_fwe" in corrected.columns:
        return joined.select("bundle", F.col("cluster_fwe").alias("clusterFWE"), at_best)
    return joined.select("bundle", format_number("alpha_fwe").alias("alphaFWE"), format_number(F.col("b_.p")).alias("min_pvalue"), at_best)


def significant_mask(stats: DataFrame, corrected: DataFrame, alpha: float = 0.05, joint: bool = False) -> DataFrame:
    """``significant`` on single positions with p <= the corrected alpha, or on runs of the corrected size with p <= ``alpha``; and -log10 p."""
    marked = with_correction(stats, corrected, joint)
    if "cluster_fwe" in corrected.columns:
        found = significant_areas(marked, F.col("cluster_fwe"), alpha)
    else:
        found = significant_areas(marked, 1, F.col("alpha_fwe"))
    return found.withColumn("detail", -F.log10("p"))


def end_to_end(cells: DataFrame) -> DataFrame:
    """``position`` counted on from bundle to bundle, in the order of their names, so that all of them are one sequence."""
    sizes = cells.groupBy("bundle").agg(F.max("position").alias("hi")).orderBy("bundle").limit(BUNDLES + 1).collect()
    if len(sizes) > BUNDLES:
        raise ValueError(f"over {BUNDLES} bundles")
    begin, at = {}, 0
    for r in sizes:
        begin[r["bundle"]] = at
        at += r["hi"] + 1
    table = cells.sparkSession.createDataFrame(list(begin.items()), f"bundle {dict(cells.dtypes)['bundle']}, begin_ long")
    return cells.join(F.broadcast(table), "bundle").withColumn("position", F.col("position") + F.col("begin_")).drop("begin_")


def corrected_threshold(profiles: DataFrame, cohort: DataFrame, nperm: int, alpha: float, seed: int, joint: bool, mode: str, correction: str) -> DataFrame:
    """``alpha_fwe`` or ``cluster_fwe`` over all bundles at once (one row) or by bundle."""
    label, family = ("grp" if mode == "group" else "target"), ([] if joint else ["bundle"])
    if correction == "alpha":
        return alpha_fwe(permutation_matrix(profiles, cohort, label, nperm, seed, mode, family=family), alpha, nperm, family, mode)
    values = end_to_end(profiles) if joint else profiles
    longest = longest_runs(values, subject_rows(cohort, label), nperm, seed, mode, alpha, "mean", family)
    return cluster_fwe(longest, values, alpha, nperm, family)


def cohort_test(profiles: DataFrame, cohort: DataFrame, nperm: int = 1000, alpha: float = 0.05, seed: int = 1, joint: bool = True, mode: str = "group", correction: str = "alpha", confounds: list[str] | None = None) -> DataFrame:
    """The whole chain as a result table: confounds taken out, a statistic and p by cell, corrected over all bundles (``joint``) or by bundle.

    ``mode``: ``group`` (column grp, Student's t) or ``correlation`` (column target, Pearson's r). ``correction``:
    ``alpha`` or ``cluster``. A correlation takes a fifth of the permutations, and its target loses the confounds' part as well.
    """
    if confounds:
        profiles = stash(unconfound(profiles, cohort, confounds, "grp" if mode == "group" else None), "unconfounded")
    if mode == "correlation":
        nperm //= 5
        cohort = target_unconfounded(cohort, confounds) if confounds else cohort
    stats = ttest_ind(profiles, cohort) if mode == "group" else pearson(profiles, cohort)
    corrected = corrected_threshold(profiles, cohort, nperm, alpha, seed, joint, mode, correction)
    return result_table(stats, corrected, "t" if mode == "group" else "r", joint)
