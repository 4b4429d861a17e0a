"""Volatility and risk: exponentially weighted moments, ARCH effects, GARCH grids, Value-at-Risk."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.tails import chi2_sf, normal_two_sided_p
from tidewright.operators.gram import Moments, moment_rows, solve_rows
from tidewright.operators.ordering import attach, lag_of, look_around, quantiles
from tidewright.operators.recursion import affine_filter, scalar_grid
from tidewright.session import settle


def ewma_moments(df: DataFrame, entity: str, pos: str, value: str, lam: float = 0.94) -> DataFrame:
    """Exponentially weighted covariance of every entity pair, seeded with the sample covariance.

    Pairs are built from a wide pivot of the (fixed, small) entity set, one row per slot.
    """
    wide, names = widen(df, entity, pos, value)
    wide = settle(wide.na.drop())
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    seeds = wide.agg(*[F.covar_samp(a, b).alias(f"s_{i}") for i, (a, b) in enumerate(_quoted(pairs))])
    long = wide.select(pos, F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(i).alias("_i"),
                 (F.col(f"`{a}`") * F.col(f"`{b}`") * (1 - lam)).alias("_u")) for i, (a, b) in enumerate(pairs)])))
    seed_rows = seeds.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"s_{i}").alias("_seed"))
                                               for i in range(len(pairs))])))
    rows = long.join(F.broadcast(seed_rows), "_i")
    return affine_filter(rows, ["a", "b"], pos, {"cov": "_u"}, lam, {"cov": "_seed"}).select("a", "b", pos, "cov")


def _quoted(pairs):
    return [(f"`{a}`", f"`{b}`") for a, b in pairs]


def widen(df: DataFrame, entity: str, pos: str, value: str) -> tuple[DataFrame, list[str]]:
    """One column per entity; the entity list is read first. For many entities use the long forms (``pair_correlations``)."""
    names = [row[0] for row in df.select(entity).distinct().orderBy(entity).collect()]
    return df.groupBy(pos).pivot(entity, names).agg(F.first(value)), names


def ewma_correlation(df: DataFrame, entity: str, pos: str, value: str, lam: float = 0.94) -> DataFrame:
    """Mean pairwise exponentially weighted correlation at each slot (one pair: its correlation)."""
    cov = ewma_moments(df, entity, pos, value, lam)
    diag = cov.filter("a = b").select(F.col("a").alias("_k"), pos, F.col("cov").alias("_var"))
    off = cov.filter("a <> b")
    va = diag.select(F.col("_k").alias("a"), pos, F.col("_var").alias("_va"))
    vb = diag.select(F.col("_k").alias("b"), pos, F.col("_var").alias("_vb"))
    rows = off.join(va, ["a", pos]).join(vb, ["b", pos])
    return rows.groupBy(pos).agg(F.avg(F.col("cov") / F.sqrt(F.col("_va") * F.col("_vb"))).alias("rho"))


def arch_lm(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, lags: int = 12) -> DataFrame:
    """Engle's LM test: n · R² of squared deviations on their own lags, chi-square(lags)."""
    mean = df.groupBy(*series_cols).agg(F.avg(value).alias("_m"))
    rows = attach(df, mean, series_cols).withColumn("_q", (F.col(value) - F.col("_m")) ** 2)
    names = [f"_q{k}" for k in range(1, lags + 1)]
    rows = look_around(rows, series_cols, pos, {n: lag_of("_q", k + 1) for k, n in enumerate(names)})
    cols = ["_q", *names]

    def solver(m: Moments, _):
        _, _, ssr, _ = m.fit("_q", names)
        stat = m.n * (1 - ssr / (m.n * m.cov[0, 0]))
        return [{"n": m.n, "lm_stat": stat, "p_value": chi2_sf(stat, lags)}]

    return solve_rows(moment_rows(rows.na.drop(subset=cols), series_cols, cols), series_cols, cols,
                      "n long, lm_stat double, p_value double", solver)


def ewma_volatility(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, lam: float = 0.94) -> DataFrame:
    """Conditional volatility ``sigma`` before each slot's shock, seeded with the sample variance."""
    stats = df.groupBy(*series_cols).agg(F.avg(value).alias("_mu"), F.var_samp(value).alias("_v0"))
    rows = attach(df, stats, series_cols)
    rows = rows.withColumn("_u", (1 - lam) * (F.col(value) - F.col("_mu")) ** 2)
    rows = affine_filter(rows, series_cols, pos, {"_after": "_u"}, lam, {"_after": "_v0"})
    before = (F.col("_after") - F.col("_u")) / lam
    return rows.withColumn("sigma", F.sqrt(before)).drop("_after", "_u", "_v0").withColumnRenamed("_mu", "mu")


GARCH_GRID = [{"alpha": a, "gamma": g, "beta": b}
              for a in (0.01, 0.03, 0.05, 0.08, 0.12) for g in (0.0, 0.05, 0.1)
              for b in (0.0, 0.3, 0.6, 0.8, 0.85, 0.9, 0.94, 0.97) if a + g / 2 + b < 0.999]


def garch_fit(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, asymmetric: bool = False,
              grid: Sequence[dict] | None = None) -> DataFrame:
    """GARCH(1,1) (or GJR) for a panel by likelihood over a parameter grid with variance targeting.

    The long-run variance is the sample variance, so omega follows from the other parameters and series of
    any scale share one grid. Every parameter set is scored block by block (see ``recursion``).
    Returns (series, alpha, gamma, beta, omega, persistence, long_run_vol, log_lik, aic, sigma2_next).
    """
    params = [p for p in (grid or GARCH_GRID) if asymmetric or p["gamma"] == 0]
    alpha, gamma, beta = (np.array([p[k] for p in params], dtype=float) for k in ("alpha", "gamma", "beta"))
    keys = list(series_cols)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.var_samp(value).alias("_v"))
    rows = attach(df.select(*keys, pos, value), stats, keys)
    rows = rows.withColumn("_e", (F.col(value) - F.col("_mu")) / F.sqrt("_v"))  # unit long-run variance

    def inputs(pdf):
        e = pdf["_e"].to_numpy(dtype=float)[:, None]
        return (1 - alpha - gamma / 2 - beta) + (alpha + gamma * (e < 0)) * e * e

    def loss(pdf, before):
        e = pdf["_e"].to_numpy(dtype=float)[:, None]
        return 0.5 * (np.log(2 * np.pi) + np.log(before) + e * e / before)

    scored = scalar_grid(rows, keys, pos, ["_e"], beta, inputs, loss,
                         stats.select(*keys, F.lit(1.0).alias("_one")), "_one")
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("param", "loss", "n", "state"), F.struct("loss", "param")).alias("b"))
    table = F.array(*[F.struct(*[F.lit(float(p[k])).alias(k) for k in ("alpha", "gamma", "beta")]) for p in params])
    out = attach(best.select(*keys, "b.*"), stats, keys).withColumn("p", F.element_at(table, F.col("param") + 1))
    a, g, b, v = F.col("p.alpha"), F.col("p.gamma"), F.col("p.beta"), F.col("_v")
    log_lik = -F.col("loss") - F.col("n") * 0.5 * F.log(v)
    free = 4 if asymmetric else 3
    return out.select(*keys, a.alias("alpha"), g.alias("gamma"), b.alias("beta"), (v * (1 - a - g / 2 - b)).alias("omega"),
                      (a + g / 2 + b).alias("persistence"), F.sqrt(v).alias("long_run_vol"), log_lik.alias("log_lik"),
                      (2 * free - 2 * log_lik).alias("aic"), (F.col("state") * v).alias("sigma2_next"))


def news_impact(fits: DataFrame, series_cols: Sequence[str], shocks: Sequence[float]) -> DataFrame:
    """Next variance after each shock, with the previous variance at its long-run level."""
    rows = fits.withColumn("shock", F.explode(F.array(*[F.lit(float(s)) for s in shocks])))
    e2 = F.col("shock") * F.col("shock")
    step = F.col("omega") + F.col("alpha") * e2 + F.when(F.col("shock") < 0, F.col("gamma") * e2).otherwise(0.0)
    return rows.select(*series_cols, "shock", (step + F.col("beta") * F.col("long_run_vol") ** 2).alias("variance"))


def volatility_term_structure(fits: DataFrame, series_cols: Sequence[str], horizon: int, per_year: float) -> DataFrame:
    """Annualised volatility 1 … horizon slots ahead, reverting to the long-run level."""
    rows = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    long_run = F.col("long_run_vol") ** 2
    var = long_run + F.pow("persistence", F.col("step") - 1) * (F.col("sigma2_next") - long_run)
    return rows.select(*series_cols, "step", F.sqrt(var * per_year).alias("annual_vol"))


def value_at_risk(df: DataFrame, series_cols: Sequence[str], value: str, sigma: str, mu: str, alpha: float) -> DataFrame:
    """One-step VaR (a positive loss) from volatility and the empirical quantile of standardised residuals."""
    rows = df.withColumn("_z", (F.col(value) - F.col(mu)) / F.col(sigma))
    q = quantiles(rows, series_cols, "_z", {"_q": alpha})
    return attach(rows, q, series_cols).withColumn("var", -(F.col(mu) + F.col(sigma) * F.col("_q"))).drop("_z", "_q")


def kupiec(df: DataFrame, series_cols: Sequence[str], value: str, var: str, alpha: float) -> DataFrame:
    """VaR backtest: breaches and the proportion-of-failures likelihood ratio."""
    one = df.groupBy(*series_cols).agg(F.count("*").alias("n"), F.count_if(F.col(value) < -F.col(var)).alias("breaches"))
    total, hits = F.col("n"), F.col("breaches")

    def surprise(seen, expected):
        """Observed · ln(observed / expected); nothing observed adds nothing."""
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    lr = 2 * (surprise(hits, total * alpha) + surprise(total - hits, total * (1 - alpha)))
    return one.select(*series_cols, "n", "breaches", (hits / total).alias("rate"), lr.alias("kupiec_lr")).withColumn(
        "kupiec_p", normal_two_sided_p(F.sqrt(F.greatest("kupiec_lr", F.lit(0.0)))))


def diversification_ratio(corr: str, n_assets: int):
    """Equal-weight portfolio volatility as a share of the average single-name volatility."""
    rho = F.greatest(F.col(corr), F.lit(0.0))
    return F.sqrt(1 / n_assets + (1 - 1 / n_assets) * rho)
