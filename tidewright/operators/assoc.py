"""Association between columns: correlations, ranks, contingency measures, collinearity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.tails import t_p
from tidewright.operators.ordering import attach, sorted_scan
from tidewright.session import settle


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long correlation matrix (both triangles and the diagonal) from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[F.corr(f"`{a}`", f"`{b}`").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("c")) for c in cols]
    for i, (a, b) in enumerate(pairs):
        cells += [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("c")) for x, y in ((a, b), (b, a))]
    return one.select(F.inline(F.array(*cells)))


def pair_correlations(df: DataFrame, entity: str, pos: str, value: str, block: int = 4096, chunk: int = 256) -> DataFrame:
    """Correlation of every entity pair over their common slots: (``a``, ``b``, ``n``, ``c``) with a < b, for any number of entities.

    Blocks of slots times pairs of entity chunks give sums of products as matrix products, so a task holds two block × chunk matrices, and a
    row leaves it for each pair and block rather than for each pair and slot. Values are centred by the entity's mean first. Several rows of a slot: the first.
    """
    rows = df.select(F.col(entity).alias("e"), F.col(pos).cast("long").alias("p"), F.col(value).cast("double").alias("v")).na.drop()
    rows = settle(rows.groupBy("e", "p").agg(F.first("v").alias("v")))
    means = rows.groupBy("e").agg(F.avg("v").alias("m"))
    n_chunks = -(-means.count() // chunk) or 1
    rows = rows.join(means, "e").select("e", "p", (F.col("v") - F.col("m")).alias("v"), F.pmod(F.xxhash64("e"), F.lit(n_chunks)).alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).select(
        "e", "p", "v", "own", F.floor(F.col("p") / block).alias("block"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    kind = rows.schema["e"].dataType.simpleString()

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf["e"].to_numpy(), return_inverse=True)
        x, seen = np.zeros((block, len(names))), np.zeros((block, len(names)))
        slot = (pdf["p"].to_numpy() % block).astype(int)
        x[slot, at], seen[slot, at] = pdf["v"].to_numpy(), 1.0
        side = np.zeros(len(names), int)
        side[at] = pdf["own"].to_numpy()
        n, s, q, xy = seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x
        i, j = np.triu_indices(len(names), 1)
        mine = (n[i, j] > 0) & ((pdf["lo"].iloc[0] == pdf["hi"].iloc[0]) | (side[i] != side[j]))
        i, j = i[mine], j[mine]
        return pd.DataFrame({"a": names[i], "b": names[j], "n": n[i, j], "sa": s[i, j], "sb": s[j, i], "qa": q[i, j], "qb": q[j, i], "ab": xy[i, j]})

    sums = ["n", "sa", "sb", "qa", "qb", "ab"]
    found = rows.groupBy("block", "lo", "hi").applyInPandas(products, f"a {kind}, b {kind}, " + ", ".join(f"{c} double" for c in sums))
    one = found.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in sums])
    spread = (F.col("n") * F.col("qa") - F.col("sa") * F.col("sa")) * (F.col("n") * F.col("qb") - F.col("sb") * F.col("sb"))
    c = (F.col("n") * F.col("ab") - F.col("sa") * F.col("sb")) / F.sqrt(F.when(spread > 0, spread))
    return one.select("a", "b", F.col("n").cast("bigint").alias("n"), c.alias("c"))


def pearson(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation with its two-sided p-value."""
    one = df.groupBy(*keys).agg(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), F.corr(a, b).alias("coef"))
    dof = (F.col("n") - 2).cast("double")
    return one.withColumn("p_value", t_p(F.abs("coef") * F.sqrt(dof / (1 - F.col("coef") * F.col("coef"))), dof))


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks. Work is done on distinct (a, b) cells with counts."""
    cells = settle(df.select(*keys, a, b).na.drop().groupBy(*keys, a, b).agg(F.count("*").alias("_w")))
    ranked = cells
    for c, name in ((a, "_ra"), (b, "_rb")):
        counts = cells.groupBy(*keys, c).agg(F.sum("_w").alias("_n"))
        ranks = sorted_scan(counts, keys, [F.col(c)], {"_cum": "_n"})
        ranks = ranks.select(*keys, c, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(name))
        ranked = ranked.join(ranks, [*keys, c])
    return _weighted_corr(ranked, "_ra", "_rb", "_w", keys).withColumnRenamed("corr", "coef")


def _weighted_corr(df: DataFrame, a: str, b: str, w: str, keys: Sequence[str]) -> DataFrame:
    x, y, n = F.col(a), F.col(b), F.col(w)
    s = df.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"),
                              F.sum(n * x * y).alias("sxy"), F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    va, vb = F.col("sxx") - F.col("sx") ** 2 / F.col("n"), F.col("syy") - F.col("sy") ** 2 / F.col("n")
    return s.select(*keys, "n", (cov / F.sqrt(va * vb)).alias("corr"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b without listing pairs.

    Places of ``a`` are split bit by bit: two rows first differ at exactly one bit, so counting, within
    each prefix and in order of ``b``, the rows with a zero bit before each row with a one bit counts
    every concordant pair once. That is n · log(n) rows and one sorted scan.
    """
    cells = settle(df.select(a, b).na.drop().groupBy(a, b).agg(F.count("*").alias("_w")))
    margin = cells.groupBy(a).agg(F.sum("_w").alias("_n"))
    places = settle(sorted_scan(margin, [], [F.col(a)], row_number="_place").select(a, (F.col("_place") - 1).alias("_place")))
    top = places.count()
    bits = max(1, (top - 1).bit_length())
    rows = cells.join(places, a).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    one = F.expr("shiftright(_place, _bit) & 1") == 1
    rows = rows.withColumn("_prefix", F.expr("shiftright(_place, _bit + 1)"))
    per = rows.groupBy("_bit", "_prefix", b).agg(
        F.sum(F.when(one, F.col("_w")).otherwise(0)).alias("_ones"), F.sum(F.when(one, 0).otherwise(F.col("_w"))).alias("_zeros"))
    scanned = sorted_scan(per, ["_bit", "_prefix"], [F.col(b)], {"_cum": "_zeros"})
    conc = scanned.agg(F.sum(F.col("_ones") * (F.col("_cum") - F.col("_zeros"))).alias("concordant"))

    def pairs(frame, name):
        return frame.agg(F.sum(F.expr("_n * (_n - 1) div 2")).alias(name))

    ties_a = pairs(margin, "ties_a")
    ties_b = pairs(cells.groupBy(b).agg(F.sum("_w").alias("_n")), "ties_b")
    ties_ab = pairs(cells.withColumnRenamed("_w", "_n"), "ties_ab")
    total = cells.agg(F.sum("_w").alias("n"))
    out = total
    for part in (conc, ties_a, ties_b, ties_ab):
        out = attach(out, part)
    all_pairs = F.expr("n * (n - 1) div 2")
    disc = all_pairs - F.col("ties_a") - F.col("ties_b") + F.col("ties_ab") - F.col("concordant")
    tau = (F.col("concordant") - disc) / F.sqrt((all_pairs - F.col("ties_a")).cast("double") * (all_pairs - F.col("ties_b")).cast("double"))
    return out.select("n", "concordant", disc.alias("discordant"), tau.alias("tau_b"))


def target_ranking(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, strongest first."""
    one = df.agg(*[F.corr(c, target).alias(c) for c in features])
    return one.unpivot([], list(features), "feature", "corr").orderBy(F.abs("corr").desc(), "feature")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Bias-corrected Cramér's V; 2 × 2 tables use the Yates correction of the chi-square."""
    cells = settle(df.select(a, b).na.drop().groupBy(a, b).agg(F.count("*").cast("double").alias("o")))
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    rb = cells.groupBy(b).agg(F.sum("o").alias("rb"))
    sizes = attach(attach(cells.agg(F.sum("o").alias("n")), ra.agg(F.count("*").alias("ka"))), rb.agg(F.count("*").alias("kb")))
    rows = attach(cells.join(ra, a).join(rb, b), sizes)
    e = F.col("ra") * F.col("rb") / F.col("n")
    gap = F.abs(F.col("o") - e)
    small = (F.col("ka") == 2) & (F.col("kb") == 2)
    gap = F.when(small, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    # cells that never occur each add their expected count; all expected counts add up to n. In a 2 × 2 table the empty cells
    # (one, or the two of a diagonal, which expect the same) are corrected like the others
    one = rows.groupBy("n", "ka", "kb").agg(F.sum(gap * gap / e).alias("seen"), F.sum(e).alias("covered"), F.count("*").alias("met"))
    spare = F.col("n") - F.col("covered")
    each = spare / F.nullif(4 - F.col("met"), F.lit(0))
    lacking = each - F.least(F.lit(0.5), each)
    missing = F.when(~small, spare).when(F.col("met") < 4, (4 - F.col("met")) * lacking * lacking / each).otherwise(F.lit(0.0))
    n, r, k = F.col("n"), F.col("ka"), F.col("kb")
    chi2 = F.col("seen") + missing
    phi2 = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / (n - 1))
    denom = F.least(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1
    return one.select("n", chi2.alias("chi2"), F.when(denom > 0, F.sqrt(phi2 / denom)).alias("v"))


def cramers_v_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cramér's V of every pair of columns (upper triangle)."""
    parts = [cramers_v(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "v")
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mutual_information(df: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    """Mutual information (nats) of two discrete columns from their contingency table."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    cells = settle(df.select(a.alias("_a"), b.alias("_b")).na.drop().groupBy("_a", "_b").agg(F.count("*").alias("o")))
    ra, rb = cells.groupBy("_a").agg(F.sum("o").alias("ra")), cells.groupBy("_b").agg(F.sum("o").alias("rb"))
    rows = attach(cells.join(ra, "_a").join(rb, "_b"), cells.agg(F.sum("o").alias("n")))
    p = F.col("o") / F.col("n")
    return rows.agg(F.sum(p * F.log(F.col("o") * F.col("n") / (F.col("ra") * F.col("rb")))).alias("mi"))


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix (k × k, solved once)."""
    cols = list(cols)
    matrix = correlation_matrix(df.select(*cols).na.drop(), cols)
    row = matrix.agg(F.collect_list(F.struct("a", "b", "c")).alias("cells"))

    def solve(batches):
        for pdf in batches:
            for cells in pdf["cells"]:
                m = np.eye(len(cols))
                for cell in cells:
                    m[cols.index(cell["a"]), cols.index(cell["b"])] = cell["c"]
                yield pd.DataFrame({"feature": cols, "vif": np.diag(np.linalg.inv(m))})

    return row.mapInPandas(solve, "feature string, vif double")

