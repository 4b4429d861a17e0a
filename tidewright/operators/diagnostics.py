"""Time-series diagnostics on grids: autocorrelation, stationarity, spectra, long memory."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.tails import chi2_p
from tidewright.operators.gram import Moments, moment_rows, solve_rows
from tidewright.operators.ordering import BLOCK, attach, lag_of, look_around, running
from tidewright.operators.recursion import beside_keys
from tidewright.session import settle


def _centred(df, series_cols, value):
    stats = df.groupBy(*series_cols).agg(F.avg(value).alias("_mean"), F.count(value).alias("_n"))
    return attach(df, stats, series_cols).withColumn("_e", F.col(value) - F.col("_mean"))


def autocovariance(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Sums of products of deviations at each lag: (series, n, lag, gamma), lag 0 included.

    Blocks of slots carry the slots just before them, as many as the longest lag; each block gives one row per lag. The plan is the same
    for any number of lags and the work of a task is bounded by the block. Missing values and slots add nothing.
    """
    keys, wanted = list(series_cols), [0, *lags]
    reach = max(wanted)
    size = max(BLOCK, reach)
    rows = _centred(df, keys, value).select(*keys, F.col(pos).cast("bigint").alias("_p"), "_e", "_n").filter("_e IS NOT NULL")
    home = F.floor(F.col("_p") / size)
    later = F.when(F.col("_p") - home * size >= size - reach, F.array(home, home + 1)).otherwise(F.array(home))
    rows = rows.withColumn("_block", F.explode(later))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["_block"].iloc[0]) * size - reach
        e = np.zeros(size + reach)
        e[pdf["_p"].to_numpy() - first] = pdf["_e"].to_numpy()
        own = e[reach:]
        out = pd.DataFrame({"n": pdf["_n"].iloc[0], "lag": wanted, "gamma": [own @ e[reach - k: reach - k + size] for k in wanted]})
        for i, c in enumerate(keys):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    fields = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys] + ["n bigint", "lag int", "gamma double"])
    found = rows.groupBy(*keys, "_block").applyInPandas(products, fields)
    return found.groupBy(*keys, "lag").agg(F.max("n").alias("n"), F.sum("gamma").alias("gamma")).select(*keys, "n", "lag", "gamma")


def acf(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Autocorrelation with the fixed denominator of lag zero."""
    g = settle(autocovariance(df, series_cols, pos, value, lags))
    zero = g.filter("lag = 0").select(*series_cols, F.col("gamma").alias("_g0"))
    return attach(g.filter("lag > 0"), zero, series_cols).select(*series_cols, "n", "lag", (F.col("gamma") / F.col("_g0")).alias("acf"))


def lag_correlation(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Pearson correlation of the series with its own past, lag by lag."""
    rows = look_around(df, series_cols, pos, {f"_l{k}": lag_of(value, k) for k in lags})
    one = rows.groupBy(*series_cols).agg(*[F.corr(value, f"_l{k}").alias(f"_c{k}") for k in lags])
    return one.select(*series_cols, F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"_c{k}").alias("corr")) for k in lags])))


def durbin_levinson(r: Sequence[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations at lags 1, 2, …"""
    phi, out = np.zeros(0), []
    for k in range(1, len(r) + 1):
        past = np.asarray(r[: k - 1])
        a = r[0] if k == 1 else (r[k - 1] - phi @ past[::-1]) / (1 - phi @ past)
        phi = np.append(phi - a * phi[::-1], a)
        out.append(float(a))
    return out


def pacf(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, max_lag: int) -> DataFrame:
    """Partial autocorrelation by Yule–Walker, from the ACF table of each series."""
    table = acf(df, series_cols, pos, value, range(1, max_lag + 1))
    rows = table.groupBy(*series_cols).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_r"))
    keys = list(series_cols)
    fields = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                values = durbin_levinson([c["acf"] for c in row["_r"]])
                out += [{**{k: row[k] for k in keys}, "lag": i + 1, "pacf": v} for i, v in enumerate(values)]
            yield pd.DataFrame(out, columns=[*keys, "lag", "pacf"])

    return rows.mapInPandas(run, ", ".join([*fields, "lag int", "pacf double"]))


def ljung_box(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, max_lag: int) -> DataFrame:
    """Cumulative portmanteau statistic and p-value for lags 1 … max_lag."""
    table = acf(df, series_cols, pos, value, range(1, max_lag + 1))
    w = Window.partitionBy(*series_cols).orderBy("lag")  # at most max_lag rows a series
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).over(w)
    return table.select(*series_cols, "lag", q.alias("q")).withColumn("p_value", chi2_p("q", F.col("lag").cast("double")))


def cross_correlation(df: DataFrame, pos: str, leader: str, follower: str, lags: Sequence[int]) -> DataFrame:
    """corr(leader[t], follower[t + k]) for each k: positive k means the leader moves first."""
    rows = look_around(df, [], pos, {f"_k{i}": lag_of(follower, -k) for i, k in enumerate(lags)})
    one = rows.agg(*[F.corr(leader, f"_k{i}").alias(f"_c{i}") for i in range(len(lags))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"_c{i}").alias("corr")) for i, k in enumerate(lags)])))


# ------------------------------------------------------------------ stationarity
# MacKinnon's response surfaces for unit-root and two-variable cointegration tests.
CRITICAL = {
    ("n", 1): {"1%": (-2.56574, -2.2358, -3.627), "5%": (-1.941, -0.2686, -3.365, 31.223), "10%": (-1.61682, 0.2656, -2.714, 25.364)},
    ("c", 1): {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.04), "10%": (-2.56677, -1.5384, -2.809)},
    ("c", 2): {"1%": (-3.89644, -10.9519, -22.527), "5%": (-3.33613, -6.1101, -6.823), "10%": (-3.04445, -4.2412, -2.72)},
}
P_SURFACE = {
    ("n", 1): {"max": float("inf"), "min": -19.04, "star": -1.04, "small": (0.6344, 1.2378, 0.032496), "large": (0.4797, 0.93557, -0.06999, 0.033066)},
    ("c", 1): {"max": 2.74, "min": -18.83, "star": -1.61, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)},
    ("c", 2): {"max": 0.92, "min": -18.86, "star": -2.62, "small": (2.92, 1.5012, 0.039796), "large": (2.1945, 0.64695, -0.29198, -0.042377)},
}
# KPSS level and trend critical values at 10, 5, 2.5 and 1 per cent.
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)


def unit_root_p(stat: float, regression: str = "c", n_vars: int = 1) -> float:
    """Approximate p-value of a Dickey–Fuller type statistic."""
    s = P_SURFACE[(regression, n_vars)]
    if stat > s["max"]:
        return 1.0
    if stat < s["min"]:
        return 0.0
    z = sum(c * stat ** i for i, c in enumerate(s["small"] if stat <= s["star"] else s["large"]))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def unit_root_critical(level: str, n: int, regression: str = "c", n_vars: int = 1) -> float:
    return sum(c / n ** i for i, c in enumerate(CRITICAL[(regression, n_vars)][level]))


def adf(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, max_lag: int, regression: str = "c",
        auto_lag: bool = True, n_vars: int = 1) -> DataFrame:
    """Augmented Dickey–Fuller for many series at once.

    The lag is chosen by AIC on the common sample, then the regression is refitted on every row the
    chosen lag allows. ``regression`` is "c" (constant) or "n" (none). ``n_vars`` = 2 reads the
    cointegration surface instead, for residuals of a two-variable regression.
    """
    keys = list(series_cols)
    base = look_around(df.select(*keys, pos, value), keys, pos, {"_y1": lag_of(value, 1)})
    base = base.withColumn("_d", F.col(value) - F.col("_y1"))
    lags = [f"_d{k}" for k in range(1, max_lag + 1)]
    rows = look_around(base, keys, pos, {f"_d{k}": lag_of("_d", k) for k in range(1, max_lag + 1)})
    rows = settle(rows.filter(F.col("_d").isNotNull()))
    cols, const = ["_d", "_y1", *lags], regression == "c"

    def pick(m: Moments, _):
        scores = []
        for p in range(max_lag + 1):
            _, _, ssr, _ = m.fit("_d", ["_y1", *lags[:p]], const)
            k = p + 1 + int(const)
            scores.append((m.n * (math.log(2 * math.pi) + 1 + math.log(ssr / m.n)) + 2 * k, p))
        return [{"lag": min(scores)[1] if auto_lag else max_lag}]

    best = settle(solve_rows(moment_rows(rows.na.drop(subset=cols), keys, cols), keys, cols, "lag int", pick))
    used = attach(rows, best, keys)
    used = used.withColumn("_last", F.when(F.col("lag") == 0, 0.0).otherwise(
        F.coalesce(*[F.when(F.col("lag") == k, F.col(f"_d{k}")) for k in range(1, max_lag + 1)]) if max_lag else F.lit(0.0)))
    used = used.filter(F.col("_last").isNotNull()).select(
        *keys, "lag", "_d", "_y1", *[F.when(F.col("lag") >= k, F.col(f"_d{k}")).otherwise(0.0).alias(f"_d{k}") for k in range(1, max_lag + 1)])

    def test(m: Moments, row):
        p = int(row["lag"])
        beta, se, _, _ = m.fit("_d", ["_y1", *lags[:p]], const)
        stat = float(beta[0] / se[0])
        surface = ("c", 2) if n_vars == 2 else (regression, 1)
        return [{"lag": p, "n_obs": m.n, "stat": stat, "p_value": unit_root_p(stat, *surface),
                 "crit_1": unit_root_critical("1%", m.n, *surface), "crit_5": unit_root_critical("5%", m.n, *surface),
                 "crit_10": unit_root_critical("10%", m.n, *surface)}]

    return solve_rows(moment_rows(used, [*keys, "lag"], cols), keys, cols,
                      "lag int, n_obs long, stat double, p_value double, crit_1 double, crit_5 double, crit_10 double", test)


def kpss_p(stat: Column, regression: str = "c") -> Column:
    """p-value between the four tabulated points, held within 0.01 … 0.10."""
    crit, out = KPSS_CRITICAL[regression], None
    for (c0, p0), (c1, p1) in zip(zip(crit, KPSS_LEVELS), zip(crit[1:], KPSS_LEVELS[1:])):
        step = p0 + (stat - c0) / (c1 - c0) * (p1 - p0)
        out = F.when(stat < c1, step) if out is None else out.when(stat < c1, step)
    return F.when(stat <= crit[0], 0.10).otherwise(F.coalesce(out, F.lit(0.01)))


def kpss(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, regression: str = "c",
         n_lags: int | None = None) -> DataFrame:
    """KPSS statistic for many series; the bandwidth is ``n_lags`` or the automatic Hobijn choice."""
    keys = list(series_cols)
    rows = df.select(*keys, pos, value).filter(F.col(value).isNotNull())
    if regression == "ct":
        fit = rows.groupBy(*keys).agg(F.regr_slope(value, pos).alias("_b"), F.regr_intercept(value, pos).alias("_a"))
        rows = attach(rows, fit, keys).withColumn("_e", F.col(value) - F.col("_a") - F.col("_b") * F.col(pos))
    else:
        rows = _centred(rows, keys, value)
    rows = settle(rows.select(*keys, pos, "_e"))
    if n_lags is None:
        size = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
        short = max(1, int(size ** (2 / 9)))
        g = autocovariance(rows, keys, pos, "_e", range(1, short + 1))
        g = g.filter(F.col("lag") <= F.floor(F.pow("n", F.lit(2 / 9))))
        s = g.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.when(F.col("lag") == 0, F.col("gamma") / F.col("n")).otherwise(2 * F.col("gamma") / F.col("n"))).alias("s0"),
                                 F.sum(F.col("lag") * 2 * F.col("gamma") / F.col("n")).alias("s1"))
        ratio = F.col("s1") / F.col("s0")
        width = F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1 / 3)) * F.pow("n", F.lit(1 / 3)))
        chosen = settle(s.select(*keys, F.least(width, F.col("n") - 1).cast("int").alias("_lags")))
        top = chosen.agg(F.max("_lags")).first()[0]
    else:
        chosen, top = rows.select(*keys).distinct().withColumn("_lags", F.lit(n_lags)) if keys else None, n_lags
    g = autocovariance(rows, keys, pos, "_e", range(1, top + 1))
    if chosen is not None:
        g = attach(g, chosen, keys)
    else:
        g = g.withColumn("_lags", F.lit(n_lags))
    weight = F.when(F.col("lag") == 0, 1.0).when(F.col("lag") <= F.col("_lags"), 2.0 * (1 - F.col("lag") / (F.col("_lags") + 1))).otherwise(0.0)
    spread = g.groupBy(*keys).agg(F.max("n").alias("n"), F.max("_lags").alias("n_lags"), (F.sum(weight * F.col("gamma")) / F.max("n")).alias("_s2"))
    sums = running(rows, keys, pos, sums={"_cum": "_e"}).groupBy(*keys).agg(F.sum(F.col("_cum") * F.col("_cum")).alias("_eta"))
    out = attach(spread, sums, keys)
    stat = F.col("_eta") / (F.col("n") * F.col("n")) / F.col("_s2")
    return out.select(*keys, "n", "n_lags", stat.alias("stat")).withColumn("p_value", kpss_p(F.col("stat"), regression))


def stationarity_report(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, max_lag: int,
                        regression: str = "c", n_lags: int | None = None) -> DataFrame:
    """ADF and KPSS side by side with the verdict of the two-by-two table; ADF always uses a constant."""
    a = adf(df, series_cols, pos, value, max_lag).select(*series_cols, F.col("stat").alias("adf_stat"), F.col("p_value").alias("adf_p"))
    k = kpss(df, series_cols, pos, value, regression, n_lags).select(*series_cols, F.col("stat").alias("kpss_stat"), F.col("p_value").alias("kpss_p"))
    both = a.join(k, list(series_cols))
    return both.withColumn("verdict", verdict(F.col("adf_p") < 0.05, F.col("kpss_p") > 0.05))


def verdict(adf_stationary: Column, kpss_stationary: Column) -> Column:
    # Verdict texts of the decision table.
    return (F.when(adf_stationary & kpss_stationary, "STATIONARY")
            .when(~adf_stationary & ~kpss_stationary, "NON-STATIONARY (unit root) -> difference")
            .when(adf_stationary, "DIFFERENCE-STATIONARY -> difference")
            .otherwise("TREND-STATIONARY -> detrend"))


# ------------------------------------------------------------------ spectra
def power_at(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, periods: Sequence[float]) -> DataFrame:
    """Periodogram density at candidate periods (in slots), from one aggregate."""
    rows = _centred(df.filter(F.col(value).isNotNull()), series_cols, value)
    start = df.groupBy(*series_cols).agg(F.min(pos).alias("_p0"))
    rows = attach(rows, start, series_cols).withColumn("_t", F.col(pos) - F.col("_p0"))
    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(periods):
        angle = F.col("_t") * (2 * math.pi / p)
        aggs += [F.sum(F.col("_e") * F.cos(angle)).alias(f"_c{i}"), F.sum(F.col("_e") * F.sin(angle)).alias(f"_s{i}")]
    one = rows.groupBy(*series_cols).agg(*aggs)
    cells = [F.struct(F.lit(float(p)).alias("period"), (2 * (F.col(f"_c{i}") ** 2 + F.col(f"_s{i}") ** 2) / F.col("_n")).alias("power"))
             for i, p in enumerate(periods)]
    return one.select(*series_cols, F.inline(F.array(*cells)))


def segments(df: DataFrame, series_cols: Sequence[str], pos: str, width: int, step: int) -> DataFrame:
    """Rows copied into the overlapping segments that hold them; ``_at`` is the place in the segment."""
    start = df.groupBy(*series_cols).agg(F.min(pos).alias("_p0"))
    rows = attach(df, start, series_cols).withColumn("_t", F.col(pos) - F.col("_p0"))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_t") - (width - 1)) / step).cast("long"))
    rows = rows.withColumn("segment", F.explode(F.sequence(first, F.floor(F.col("_t") / step).cast("long"))))
    return rows.withColumn("_at", F.col("_t") - F.col("segment") * step).drop("_p0", "_t")


def segment_spectra(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, width: int, step: int,
                    taper: float = 0.0) -> DataFrame:
    """Power of every Fourier frequency of every full segment: (series, segment, k, period, power).

    Segments have a fixed width, so the transform of each is a small task. ``taper`` is the tapered
    share of a Tukey window (0 = none).
    """
    keys = [*series_cols, "segment"]
    rows = segments(df, series_cols, pos, width, step).select(*keys, "_at", value)
    fields = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    at = np.arange(width)
    window = np.ones(width)
    if taper > 0:
        edge = taper * (width - 1) / 2
        near = np.minimum(at, width - 1 - at)
        window = np.where(near < edge, 0.5 * (1 + np.cos(np.pi * (near / edge - 1))), 1.0)

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("_at")[value].to_numpy(dtype=float)
        names = [*keys, "k", "period", "power"]
        if len(y) < width or np.isnan(y).any():  # a partial segment is marked and filtered below
            return beside_keys(pd.DataFrame({"k": [0], "period": [0.0], "power": [0.0]}), pdf, keys)[names]
        spec = np.abs(np.fft.rfft((y - y.mean()) * window)) ** 2 / (window ** 2).sum()
        k = np.arange(1, len(spec))
        power = spec[1:] * np.where((width % 2 == 0) & (k == width // 2), 1.0, 2.0)
        out = pd.DataFrame({"k": k, "period": width / k, "power": power})
        return beside_keys(out, pdf, keys)[names]

    spectra = rows.groupBy(*keys).applyInPandas(transform, ", ".join([*fields, "k int", "period double", "power double"]))
    return spectra.filter("k > 0")


def mean_spectrum(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, width: int) -> DataFrame:
    """Average spectrum over consecutive segments of a fixed width."""
    spectra = segment_spectra(df, series_cols, pos, value, width, width)
    return spectra.groupBy(*series_cols, "k", "period").agg(F.avg("power").alias("power"))


def spectral_entropy(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, width: int) -> DataFrame:
    """Normalised entropy of the power shares: 0 for one pure cycle, 1 for white noise."""
    spectrum = settle(mean_spectrum(df, series_cols, pos, value, width))
    total = spectrum.groupBy(*series_cols).agg(F.sum("power").alias("_total"), F.count("*").alias("_m"))
    share = F.col("power") / F.col("_total")
    rows = attach(spectrum, total, series_cols)
    return rows.groupBy(*series_cols).agg((-F.sum(F.when(share > 0, share * F.log(share))) / F.log(F.max("_m"))).alias("entropy"))


def band_power(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, width: int, step: int,
               band: tuple[float, float], taper: float = 0.25) -> DataFrame:
    """Mean power per segment over frequencies whose period lies inside ``band`` (spectrogram slice)."""
    spectra = segment_spectra(df, series_cols, pos, value, width, step, taper)
    return (spectra.filter((F.col("period") > band[0]) & (F.col("period") < band[1]))
            .groupBy(*series_cols, "segment").agg(F.avg("power").alias("power")))


def hurst(df: DataFrame, series_cols: Sequence[str], pos: str, value: str, first: int = 10, growth: float = 1.5) -> DataFrame:
    """Rescaled-range exponent: slope of log mean R/S on log segment length.

    Segment lengths are the whole parts of first · growth^k up to a quarter of each series' length.

    Ranges of cumulative deviations come from one running total of the series, so a segment of any
    length is an aggregate and never a single task's window.
    """
    keys = list(series_cols)
    start = df.groupBy(*keys).agg(F.min(pos).alias("_p0"), F.count(value).alias("_n"))
    rows = attach(running(df.select(*keys, pos, value), keys, pos, sums={"_cum": value}), start, keys)
    rows = rows.withColumn("_t", F.col(pos) - F.col("_p0")).withColumn("_size", F.explode(F.expr(
        f"filter(transform(sequence(0, greatest(0, int(ceil(ln(_n / {4 * first}) / ln({growth}))))), k -> int(floor({float(first)}D * pow({growth}D, k)))), z -> z <= _n / 4)")))
    rows = rows.withColumn("_seg", F.floor(F.col("_t") / F.col("_size"))).filter(F.col("_seg") < F.floor(F.col("_n") / F.col("_size")))
    rows = settle(rows.select(*keys, "_size", "_seg", "_t", value, "_cum"))
    stats = rows.groupBy(*keys, "_size", "_seg").agg(
        F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"), F.min_by(F.col("_cum") - F.col(value), "_t").alias("_c0"), F.min("_t").alias("_t0"))
    z = F.col("_cum") - F.col("_c0") - (F.col("_t") - F.col("_t0") + 1) * F.col("_m")
    spans = (rows.join(stats.filter("_sd > 0"), [*keys, "_size", "_seg"])
             .groupBy(*keys, "_size", "_seg").agg(((F.max(z) - F.min(z)) / F.max("_sd")).alias("_rs")))
    means = spans.groupBy(*keys, "_size").agg(F.avg("_rs").alias("_rs"))
    return means.groupBy(*keys).agg(F.regr_slope(F.log("_rs"), F.log("_size")).alias("hurst"))
