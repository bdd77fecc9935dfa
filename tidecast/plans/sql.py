"""The forecast engine's queries as DuckDB SQL, from one chain of named parts."""

from __future__ import annotations

from tidecast.sources.adaptors import FEATURES_SQL

H = "month({0}) * 100 + day({0}) BETWEEN 1120 AND 1231"


def daily(name: str, keys: str) -> str:
    using = ", ".join(keys.split(", "))
    return f"""{name}_sum AS (SELECT {keys}, date, coalesce(sum(revenue), 0) AS revenue, coalesce(sum(spend), 0) AS spend FROM features GROUP BY {keys}, date),
{name}_day AS (SELECT {keys}, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT {keys}, min(date) AS a, max(date) AS b FROM {name}_sum GROUP BY {keys})),
{name} AS (SELECT {keys}, date, coalesce(revenue, 0) AS revenue, coalesce(spend, 0) AS spend FROM {name}_day LEFT JOIN {name}_sum USING ({using}, date))"""


SEG = "channel, campaign_type"
DAILY = daily("seg", SEG)
WINDOW = f"""last AS (SELECT *, row_number() OVER (PARTITION BY {SEG} ORDER BY date) - 1 AS x FROM (SELECT *, row_number() OVER (PARTITION BY {SEG} ORDER BY date DESC) AS newest FROM seg) WHERE newest <= 120),
clip AS (SELECT {SEG}, quantile_cont(revenue, 0.97) AS top FROM last GROUP BY {SEG}),
win AS (SELECT last.*, CASE WHEN top > 0 THEN least(greatest(revenue, 0), top) ELSE revenue END AS y FROM last JOIN clip USING ({SEG}))"""
TREND = f"""fit AS (SELECT {SEG}, count(*) AS n, stddev_pop(y) AS sd, avg(y) AS mean, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, max(date) AS last_train_date FROM win GROUP BY {SEG}),
trend AS (SELECT {SEG}, n, last_train_date, CASE WHEN n >= 2 AND sd > 0 THEN a ELSE 0 END AS slope, CASE WHEN n >= 2 AND sd > 0 THEN b ELSE mean END AS start FROM fit)"""
DOW = f"""over_all AS (SELECT {SEG}, avg(revenue) AS overall FROM seg GROUP BY {SEG}), by_dow AS (SELECT {SEG}, isodow(date) - 1 AS dow, avg(revenue) AS mean FROM seg GROUP BY {SEG}, isodow(date) - 1),
dows AS (SELECT {SEG}, CAST(d.dow AS INTEGER) AS dow, CASE WHEN overall > 0 AND mean / overall > 0 THEN mean / overall ELSE 1 END AS factor FROM over_all CROSS JOIN (SELECT unnest(range(0, 7)) AS dow) d LEFT JOIN by_dow USING ({SEG}, dow))"""
HOLIDAY = f"""hol AS (SELECT {SEG}, avg(revenue) FILTER ({H.format('date')}) AS on_, avg(revenue) FILTER (NOT {H.format('date')}) AS off_ FROM seg GROUP BY {SEG}),
holiday AS (SELECT {SEG}, CASE WHEN off_ > 0 AND on_ / off_ > 0 THEN on_ / off_ ELSE 1 END AS holiday_factor FROM hol)"""
RESIDUAL = f"""resid AS (SELECT {SEG}, last.date, last.x, revenue - (start + slope * x) * factor * CASE WHEN {H.format('last.date')} THEN holiday_factor ELSE 1 END AS residual
 FROM last JOIN trend USING ({SEG}) JOIN dows ON dows.channel = last.channel AND dows.campaign_type = last.campaign_type AND dows.dow = isodow(last.date) - 1 JOIN holiday USING ({SEG}))""".replace(f"SELECT {SEG}, last.date", "SELECT last.channel, last.campaign_type, last.date").replace(f"FROM last JOIN trend USING ({SEG})", "FROM last JOIN trend ON trend.channel = last.channel AND trend.campaign_type = last.campaign_type").replace(f"JOIN holiday USING ({SEG})", "JOIN holiday ON holiday.channel = last.channel AND holiday.campaign_type = last.campaign_type")
ELASTIC = f"""pair AS (SELECT {SEG}, date, ln(spend) AS s, ln(revenue) AS r FROM seg WHERE spend > 0 AND revenue > 0),
est AS (SELECT k.channel, k.campaign_type, count(s) AS n_obs, regr_slope(r, s) AS b, regr_intercept(r, s) AS a FROM (SELECT DISTINCT {SEG} FROM seg) k LEFT JOIN pair ON pair.channel = k.channel AND pair.campaign_type = k.campaign_type GROUP BY ALL),
elastic AS (SELECT {SEG}, n_obs, CASE WHEN n_obs >= 10 AND b IS NOT NULL THEN least(greatest(b, 0), 2) ELSE 1 END AS beta, CASE WHEN n_obs >= 10 AND b IS NOT NULL THEN a ELSE 0 END AS alpha FROM est)"""
RECENT = f"""recent AS (SELECT {SEG}, avg(spend) AS avg_spend, avg(revenue) AS avg_revenue FROM (SELECT *, row_number() OVER (PARTITION BY {SEG} ORDER BY date DESC) AS newest FROM seg) WHERE newest <= 28 GROUP BY {SEG})"""
LEVELS = """origin AS (SELECT max(date) AS origin FROM features),
seg_rate AS (SELECT channel, campaign_type, coalesce(avg(revenue) FILTER (date > origin - 28), avg(revenue), 0) AS revenue, coalesce(avg(spend) FILTER (date > origin - 28), avg(spend), 0) AS spend FROM features, origin GROUP BY channel, campaign_type),
camp_rate AS (SELECT channel, campaign_id, coalesce(avg(revenue) FILTER (date > origin - 28), avg(revenue), 0) AS revenue, coalesce(avg(spend) FILTER (date > origin - 28), avg(spend), 0) AS spend, count(*) FILTER (date > origin - 28) = 0 AS is_stale FROM features, origin GROUP BY channel, campaign_id),
lev AS (SELECT channel, campaign_type, '' AS campaign_id, revenue, spend, CASE WHEN revenue > 0 THEN revenue * 0.05 ELSE 1 END + greatest(revenue, 0) AS day FROM seg_rate
 UNION ALL SELECT o.channel, o.campaign_type, o.campaign_id, c.revenue, c.spend, greatest(0, greatest(c.revenue, 0) + CASE WHEN s.revenue > 0 THEN s.revenue * 0.05 ELSE 1 END * CASE WHEN c.revenue / (CASE WHEN s.revenue = 0 THEN 1 ELSE s.revenue END) < 0 THEN 1 ELSE c.revenue / (CASE WHEN s.revenue = 0 THEN 1 ELSE s.revenue END) END)
 FROM (SELECT DISTINCT channel, campaign_type, campaign_id FROM features) o JOIN camp_rate c ON c.channel = o.channel AND c.campaign_id = o.campaign_id JOIN seg_rate s ON s.channel = o.channel AND s.campaign_type = o.campaign_type)"""


#: Sums of segments, channels and all from part `sc`, and the rows of a forecast.
ROLLED = """roll AS (SELECT coalesce(channel, 'blended') AS channel, coalesce(campaign_type, '') AS campaign_type, horizon_days, sim, sum(revenue) AS revenue, sum(spend) AS spend FROM sc GROUP BY GROUPING SETS ((channel, campaign_type, horizon_days, sim), (channel, horizon_days, sim), (horizon_days, sim))),
pct AS (SELECT channel, campaign_type, horizon_days, quantile_cont(revenue, [0.1, 0.5, 0.9]) AS r, max(spend) AS spend FROM roll GROUP BY ALL),
rows_ AS (SELECT channel, campaign_type, horizon_days, 'revenue' AS metric, r FROM pct UNION ALL SELECT channel, campaign_type, horizon_days, 'roas', [r[1] / spend, r[2] / spend, r[3] / spend] FROM pct WHERE spend > 0)"""
ROLLED_ROWS = "\nSELECT channel, campaign_type, '' AS campaign_id, CAST(horizon_days AS INTEGER) AS horizon_days, metric, round(r[1], 4) AS p10, round(r[2], 4) AS p50, round(r[3], 4) AS p90 FROM "


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join((FEATURES_SQL, *parts)) + "\n"


def cold(rollup: bool, which: str = "true") -> str:
    more = " UNION ALL SELECT channel, '', '', sum(day), sum(spend) FROM lev WHERE campaign_id = '' GROUP BY channel UNION ALL SELECT 'blended', '', '', sum(day), sum(spend) FROM lev WHERE campaign_id = '' HAVING sum(day) IS NOT NULL" if rollup else ""
    return with_(LEVELS) + f""", all_ AS (SELECT channel, campaign_type, campaign_id, day, spend FROM lev WHERE {which}{more}),
each_ AS (SELECT all_.*, h.horizon_days FROM all_ CROSS JOIN (SELECT unnest([30, 60, 90]) AS horizon_days) h),
vals AS (SELECT channel, campaign_type, campaign_id, horizon_days, 'revenue' AS metric, round(day * horizon_days + 1e-7, 4) AS v FROM each_ UNION ALL SELECT channel, campaign_type, campaign_id, horizon_days, 'roas', round(day / spend + 1e-7, 4) FROM each_ WHERE spend > 0)
SELECT channel, campaign_type, campaign_id, CAST(horizon_days AS INTEGER) AS horizon_days, metric, v AS p10, v AS p50, v AS p90 FROM vals"""


def draw(size: str, at: str, *key: str) -> str:
    """Number `at` of the key's stream of draws, from 0 to size - 1."""
    x = f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8) AS BIGINT) + CAST({at} AS BIGINT) * 2654435769) & 4294967295)"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) & 4294967295)"
    return f"(xor({x}, {x} >> 16) % ({size}))"


def paths(n_sims: int) -> str:
    start = draw("len(pool) - 6", "block", "channel", "campaign_type", "sim", "'simulate'", "42")
    return f"""pools AS (SELECT {SEG}, list(residual ORDER BY x) AS pool FROM resid GROUP BY {SEG}),
drawn AS (SELECT {SEG}, sim, block * 7 + j + 1 AS k, pool[CAST({start} + j + 1 AS INTEGER)] AS residual FROM pools, (SELECT unnest(range(0, {n_sims})) AS sim), (SELECT unnest(range(0, 13)) AS block), (SELECT unnest(range(0, 7)) AS j) WHERE block * 7 + j + 1 <= 90),
pts AS (SELECT t.channel, t.campaign_type, k, CAST(last_train_date + CAST(k AS INTEGER) AS DATE) AS d, greatest(0, start + slope * (n - 1) + slope * k) AS base FROM trend t, (SELECT unnest(range(1, 91)) AS k)),
point AS (SELECT p.channel, p.campaign_type, k, base * factor * CASE WHEN {H.format('p.d')} THEN holiday_factor ELSE 1 END AS point FROM pts p JOIN dows w ON w.channel = p.channel AND w.campaign_type = p.campaign_type AND w.dow = isodow(p.d) - 1 JOIN holiday h ON h.channel = p.channel AND h.campaign_type = p.campaign_type),
dayv AS (SELECT d.channel, d.campaign_type, d.sim, d.k, greatest(0, point + residual * CASE d.channel WHEN 'meta' THEN 1.3 ELSE 1.0 END) AS v FROM drawn d JOIN point p ON p.channel = d.channel AND p.campaign_type = d.campaign_type AND p.k = d.k),
sims AS (SELECT {SEG}, sim, h AS horizon_days, sum(v) AS revenue FROM dayv, (SELECT unnest([30, 60, 90]) AS h) WHERE k <= h GROUP BY ALL)"""


def fitted(p: str, keys: str, source: str) -> str:
    """Parts p_trend, p_dows, p_holiday and p_pools of the dense series `source` by any keys."""
    return f"""{p}_last AS (SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS dow, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS x FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date DESC) AS newest FROM {source}) WHERE newest <= 120),
{p}_clip AS (SELECT {keys}, quantile_cont(revenue, 0.97) AS top FROM {p}_last GROUP BY {keys}),
{p}_win AS (SELECT l.*, CASE WHEN top > 0 THEN least(greatest(revenue, 0), top) ELSE revenue END AS y FROM {p}_last l JOIN {p}_clip USING ({keys})),
{p}_fit AS (SELECT {keys}, count(*) AS n, stddev_pop(y) AS sd, avg(y) AS mean, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, max(date) AS last_train_date FROM {p}_win GROUP BY {keys}),
{p}_trend AS (SELECT {keys}, n, last_train_date, CASE WHEN n >= 2 AND sd > 0 THEN a ELSE 0 END AS slope, CASE WHEN n >= 2 AND sd > 0 THEN b ELSE mean END AS start FROM {p}_fit),
{p}_all AS (SELECT {keys}, avg(revenue) AS overall, avg(revenue) FILTER ({H.format('date')}) AS on_, avg(revenue) FILTER (NOT {H.format('date')}) AS off_ FROM {source} GROUP BY {keys}),
{p}_bydow AS (SELECT {keys}, CAST(isodow(date) - 1 AS INTEGER) AS dow, avg(revenue) AS mean FROM {source} GROUP BY {keys}, isodow(date) - 1),
{p}_week AS (SELECT {keys}, overall, CAST(d.dow AS INTEGER) AS dow FROM {p}_all CROSS JOIN (SELECT unnest(range(0, 7)) AS dow) d),
{p}_dows AS (SELECT {keys}, dow, CASE WHEN overall > 0 AND mean / overall > 0 THEN mean / overall ELSE 1 END AS factor FROM {p}_week LEFT JOIN {p}_bydow USING ({keys}, dow)),
{p}_holiday AS (SELECT {keys}, CASE WHEN off_ > 0 AND on_ / off_ > 0 THEN on_ / off_ ELSE 1 END AS holiday_factor FROM {p}_all),
{p}_resid AS (SELECT {keys}, x, revenue - (start + slope * x) * factor * CASE WHEN {H.format('date')} THEN holiday_factor ELSE 1 END AS residual FROM {p}_last JOIN {p}_trend USING ({keys}) JOIN {p}_dows USING ({keys}, dow) JOIN {p}_holiday USING ({keys})),
{p}_pools AS (SELECT {keys}, list(residual ORDER BY x) AS pool FROM {p}_resid GROUP BY {keys})"""


def pointed(p: str, keys: str, days: int) -> str:
    """p_point (keys, k, point): trend, weekday and holiday of the parts of fitted()."""
    return f"""{p}_pts AS (SELECT {keys}, k, CAST(last_train_date + CAST(k AS INTEGER) AS DATE) AS d, CAST(isodow(CAST(last_train_date + CAST(k AS INTEGER) AS DATE)) - 1 AS INTEGER) AS dow, greatest(0, start + slope * (n - 1) + slope * k) AS base FROM {p}_trend, (SELECT unnest(range(1, {days + 1})) AS k)),
{p}_point AS (SELECT {keys}, k, base * factor * CASE WHEN {H.format('d')} THEN holiday_factor ELSE 1 END AS point FROM {p}_pts JOIN {p}_dows USING ({keys}, dow) JOIN {p}_holiday USING ({keys}))"""


def simulated(p: str, keys: str, days: int, n_sims: int, horizons: list[int], scales: list[float] | None = None) -> str:
    """p_sims (keys, scale, sim, horizon_days, revenue) from p_pools and p_point. Pools of BLOCK or
    fewer residuals are drawn singly."""
    names = keys.split(", ")
    block, single = draw("len(pool) - 6", "block", *names, "sim", "'simulate'", "42"), draw("len(pool)", "block * 7 + j", *names, "sim", "'simulate'", "42")
    return f"""{p}_drawn AS (SELECT {keys}, sim, block * 7 + j + 1 AS k, CASE WHEN len(pool) > 7 THEN pool[CAST({block} + j + 1 AS INTEGER)] ELSE pool[CAST({single} + 1 AS INTEGER)] END AS residual
 FROM {p}_pools, (SELECT unnest(range(0, {n_sims})) AS sim), (SELECT unnest(range(0, {-(-days // 7)})) AS block), (SELECT unnest(range(0, 7)) AS j) WHERE block * 7 + j + 1 <= {days}),
{p}_dayv AS (SELECT {keys}, scale, sim, k, greatest(0, point + residual * scale * CASE channel WHEN 'meta' THEN 1.3 ELSE 1.0 END) AS v FROM {p}_drawn JOIN {p}_point USING ({keys}, k), (SELECT unnest({scales or [1.0]}::DOUBLE[]) AS scale)),
{p}_sims AS (SELECT {keys}, scale, sim, h AS horizon_days, sum(v) AS revenue FROM {p}_dayv, (SELECT unnest({horizons}) AS h) WHERE k <= h GROUP BY ALL)"""


def folds(count: int) -> str:
    return f"""folds AS (SELECT channel, campaign_type, CAST(b - CAST(i * 30 AS INTEGER) AS DATE) AS cutoff FROM (SELECT channel, campaign_type, min(date) AS a, max(date) AS b FROM seg GROUP BY ALL), (SELECT unnest(range(1, {count + 1})) AS i) WHERE (b - CAST(i * 30 AS INTEGER)) - a + 1 >= 45),
train AS (SELECT channel, campaign_type, cutoff, date, revenue, spend FROM seg JOIN folds USING (channel, campaign_type) WHERE date <= cutoff),
actual AS (SELECT channel, campaign_type, cutoff, sum(revenue) AS actual FROM seg JOIN folds USING (channel, campaign_type) WHERE date > cutoff AND date <= cutoff + 30 GROUP BY ALL)"""


FOLD = f"{SEG}, cutoff"
METHODS = {"empirical": "bt", "holt_winters_fixed": "hw"}


def fold_fits(count: int = 3) -> str:
    return ",\n".join((folds(count), fitted("bt", FOLD, "train"), pointed("bt", FOLD, 30)))


def scored(name: str, source: str) -> str:
    """Part `name`, a row a fold, method and scale, from simulations with a method."""
    loss = " + ".join(f"greatest({q} * (actual - p[{i}]), ({q} - 1) * (actual - p[{i}]))" for i, q in enumerate((0.1, 0.5, 0.9), 1))
    return f"""{name}_pct AS (SELECT {FOLD}, method, scale, quantile_cont(revenue, [0.1, 0.5, 0.9]) AS p FROM ({source}) GROUP BY ALL),
{name} AS (SELECT {FOLD}, method, scale, actual, p[1] AS p10, p[2] AS p50, p[3] AS p90, abs(actual - p[2]) / greatest(actual, 1) * 100 AS ape,
 ({loss}) / 3 AS pinball, actual BETWEEN p[1] AND p[3] AS covered FROM {name}_pct JOIN actual USING ({FOLD}))"""


def sums(name: str, source: str) -> str:
    means = "avg(ape) AS ape, avg(pinball) AS pinball, avg(CAST(covered AS INTEGER)) * 100 AS coverage"
    return f"{name} AS (SELECT {SEG}, method, scale, count(*) AS n_folds, {means} FROM {source} GROUP BY ALL)"


def scores(n_sims: int, count: int = 3, scales: list[float] | None = None) -> str:
    sims = simulated("bt", FOLD, 30, n_sims, [30], scales)
    return with_(DAILY, fold_fits(count), sims, scored("score", "SELECT *, 'empirical' AS method FROM bt_sims"), sums("bysum", "score")).rstrip()


def calibrated(score: str, tuned_from: int, least_coverage: float) -> str:
    """Part `calibration`: the scale of each segment, from part `score` with all scales."""
    held = "WHERE scale = coalesce(chosen, 1.0) AND (NOT split.tuned OR NOT split.older)"
    means = "round(avg(ape), 4) AS ape, round(avg(pinball), 4) AS pinball, round(avg(CAST(covered AS INTEGER)) * 100, 4) AS coverage"
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {SEG} ORDER BY cutoff) AS place, count(*) OVER (PARTITION BY {SEG}) AS total FROM folds),
split AS (SELECT *, total >= {tuned_from} AS tuned, place <= total // 2 AS older FROM placed),
older AS (SELECT {SEG}, scale, avg(CAST(covered AS INTEGER)) * 100 AS coverage FROM {score} JOIN split USING ({FOLD}) WHERE tuned AND older GROUP BY ALL),
picked AS (SELECT {SEG}, coalesce(min(scale) FILTER (coverage >= {least_coverage}), arg_max(scale, coverage * 1000 - scale)) AS chosen FROM older GROUP BY ALL),
held AS (SELECT s.*, split.tuned FROM {score} s JOIN split USING ({FOLD}) LEFT JOIN picked USING ({SEG}) {held}),
calibration AS (SELECT {SEG}, method, scale, tuned, count(*) AS n_folds, {means} FROM held GROUP BY ALL)"""


def smoothed(p: str, keys: str, window: str, fixed: tuple[float, float, float]) -> str:
    """Parts p_path (keys, k, p), the next 120 days, and p_pools, by Holt-Winters of fixed weights: a
    recursion over the days of `window`, whose statement must begin WITH RECURSIVE."""
    a, b, g = fixed
    season = ", ".join(f"y[{i}] - list_avg(y[1:7])" for i in range(1, 8))
    fresh = f"{a} * (y[t + 1] - season[t % 7 + 1]) + (1 - {a}) * (level + slope) AS fresh"
    return f"""{p}_ys AS (SELECT {keys}, list(y ORDER BY x) AS y, list(revenue ORDER BY x) AS raw FROM {window} GROUP BY ALL HAVING count(*) >= 14),
{p}_step AS (SELECT {keys}, 0 AS t, list_avg(y[1:7]) AS level, (list_avg(y[8:14]) - list_avg(y[1:7])) / 7 AS slope, [{season}] AS season, CAST(NULL AS DOUBLE) AS fitted FROM {p}_ys
 UNION ALL SELECT {keys}, t + 1, fresh, {b} * (fresh - level) + (1 - {b}) * slope, season[1:t % 7] || [{g} * (v - fresh) + (1 - {g}) * s] || season[t % 7 + 2:7], level + slope + s
 FROM (SELECT {keys}, t, level, slope, season, season[t % 7 + 1] AS s, y[t + 1] AS v, {fresh} FROM {p}_step JOIN {p}_ys USING ({keys}) WHERE t < len(y))),
{p}_ends AS (SELECT {keys}, t, level, slope, season FROM {p}_step JOIN {p}_ys USING ({keys}) WHERE t = len(y)),
{p}_path AS (SELECT {keys}, k, greatest(0, level + slope * k + season[(t + k - 1) % 7 + 1]) AS p FROM {p}_ends, (SELECT unnest(range(1, 121)) AS k)),
{p}_pools AS (SELECT {keys}, list(raw[t] - fitted ORDER BY t) AS pool FROM {p}_step JOIN {p}_ys USING ({keys}) WHERE t > 0 GROUP BY ALL)"""


def chosen(name: str, keys: str, days: int, parts: dict[str, str]) -> str:
    """Parts name_pools and name_point: those of the method that part `won` has for a segment."""
    pools = " UNION ALL ".join(f"SELECT {keys}, '{m}' AS method, pool FROM {p}_pools" for m, p in parts.items())
    points = " UNION ALL ".join(f"SELECT {keys}, '{m}' AS method, k, point FROM {p}_point" for m, p in parts.items())
    own = f"JOIN won USING ({SEG}, method)"
    return f"""{name}_pools AS (SELECT {keys}, method, pool FROM ({pools}) {own}),
{name}_point AS (SELECT {keys}, k, point FROM ({points}) {own} WHERE k <= {days})"""


def contest(n_sims: int, fixed: tuple[float, float, float], count: int = 3, scales: list[float] | None = None) -> str:
    """Part `ranked`: both methods of every segment on the same folds, the three newest; `won`: the
    winners, at scale 1. Part `trial` has all `count` cutoffs and scales."""
    both = " UNION ALL ".join(f"SELECT *, '{m}' AS method FROM {p}_sims" for m, p in METHODS.items())
    every = f"SELECT DISTINCT {SEG}, method FROM seg, (SELECT unnest({list(METHODS)}) AS method)"
    parts = (
        DAILY,
        fold_fits(count),
        smoothed("hw", FOLD, "bt_win", fixed),
        f"hw_point AS (SELECT {FOLD}, k, p AS point FROM hw_path)",
        *(simulated(p, FOLD, 30, n_sims, [30], scales) for p in METHODS.values()),
        scored("trial", both),
        f"newest AS (SELECT * FROM trial JOIN (SELECT {SEG}, max(date) AS b FROM seg GROUP BY ALL) USING ({SEG}) WHERE cutoff >= b - 90 AND scale = 1)",
        sums("trials", "newest"),
        f"ranked AS (SELECT {SEG}, method, n_folds, ape, pinball, coverage, row_number() OVER (PARTITION BY {SEG} ORDER BY pinball IS NULL, pinball, method <> 'empirical', method) = 1 AS winner FROM ({every}) LEFT JOIN trials USING ({SEG}, method))",
        f"won AS (SELECT {SEG}, method FROM ranked WHERE winner)",
    )
    return with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()


def calibrated_winners(n_sims: int, fixed: tuple[float, float, float], count: int, scales: list[float], tuned_from: int, least_coverage: float) -> str:
    """Part `calibration` of the contest's winners, each by its own method."""
    own = f"own AS (SELECT trial.* FROM trial JOIN won USING ({SEG}, method))"
    return ",\n".join((contest(n_sims, fixed, count, scales), own, calibrated("own", tuned_from, least_coverage)))


def trained(calibration: str, fixed: tuple[float, float, float], resamples: int) -> str:
    """Part `model`: segments by their winners, with spread and elasticity; f_ and g_ are all days' fits."""
    return f"""{calibration},
{fitted("f", SEG, "seg")},
{pointed("f", SEG, 90)},
{smoothed("g", SEG, "f_win", fixed)},
g_point AS (SELECT {SEG}, k, p AS point FROM g_path),
{ELASTIC},
{RECENT},
{boot(resamples)},
model AS (SELECT channel, campaign_type, w.method, slope, start + slope * (n - 1) AS level_at_end, holiday_factor, avg_spend, avg_revenue, beta, low_confidence, coalesce(scale, 1.0) AS calibration_scale, tuned, c.coverage AS held_out_coverage, coalesce(scale, 1.0) * CASE channel WHEN 'meta' THEN 1.3 ELSE 1.0 END AS spread
 FROM won w JOIN f_trend USING ({SEG}) JOIN f_holiday USING ({SEG}) JOIN recent USING ({SEG}) JOIN boot USING ({SEG}) LEFT JOIN calibration c USING ({SEG}))"""


def trained_rollup(models: str, n_sims: int) -> str:
    """Forecasts of trained segments, of channels and of all, at their present spend."""
    own = f"fin_pools AS (SELECT {SEG}, list_transform(pool, lambda r: r * calibration_scale) AS pool FROM all_pools JOIN model USING ({SEG})), fin_point AS (SELECT * FROM all_point)"
    spent = f"sc AS (SELECT {SEG}, sim, horizon_days, revenue, avg_spend * horizon_days AS spend FROM fin_sims JOIN model USING ({SEG}))"
    return ",\n".join((models, chosen("all", SEG, 90, {"empirical": "f", "holt_winters_fixed": "g"}), own, simulated("fin", SEG, 90, n_sims, [30, 60, 90]), spent, ROLLED)) + ROLLED_ROWS + "rows_"


def boot(resamples: int) -> str:
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY channel, campaign_type ORDER BY date) - 1 AS spot FROM pair),
picks AS (SELECT n.channel, n.campaign_type, sample, {draw('n_obs', 'spot', 'n.channel', 'n.campaign_type', 'sample', "'elasticity'", '42')} AS pick FROM num n JOIN est e ON e.channel = n.channel AND e.campaign_type = n.campaign_type, (SELECT unnest(range(0, {resamples})) AS sample) WHERE n_obs >= 10 AND b IS NOT NULL),
slopes AS (SELECT p.channel, p.campaign_type, sample, regr_slope(r, s) AS b FROM picks p JOIN num n ON n.channel = p.channel AND n.campaign_type = p.campaign_type AND n.spot = p.pick GROUP BY ALL),
ci AS (SELECT channel, campaign_type, quantile_cont(least(greatest(b, 0), 2), 0.1) AS lo, quantile_cont(least(greatest(b, 0), 2), 0.9) AS hi FROM slopes WHERE b IS NOT NULL GROUP BY ALL),
boot AS (SELECT e.channel, e.campaign_type, n_obs, beta, coalesce(lo, 1) AS ci_low, coalesce(hi, 1) AS ci_high, n_obs < 10 OR coalesce(hi, 1) - coalesce(lo, 1) > 1 AS low_confidence FROM elastic e LEFT JOIN ci ON ci.channel = e.channel AND ci.campaign_type = e.campaign_type)"""


def forecast(n_sims: int, resamples: int, multiple: str = "1.0", where: str = "true") -> str:
    """Scenarios scale by the slope, or by 1 where its confidence is low."""
    return with_(DAILY, WINDOW, TREND, DOW, HOLIDAY, RESIDUAL, ELASTIC, RECENT, boot(resamples), paths(n_sims)) + f""", mult AS (SELECT r.channel, r.campaign_type, avg_spend, CAST({multiple} AS DOUBLE) AS m, CASE WHEN low_confidence THEN 1 ELSE beta END AS beta FROM recent r JOIN boot e ON e.channel = r.channel AND e.campaign_type = r.campaign_type),
resp AS (SELECT channel, campaign_type, avg_spend * m AS daily, CASE WHEN m <= 0 THEN 0 WHEN m = 1 THEN 1 WHEN m < 1 THEN pow(m, beta) ELSE 1 + (pow(m, beta) - 1) / (1 + 0.5 * (pow(m, beta) - 1)) END AS scale FROM mult),
sc AS (SELECT s.channel, s.campaign_type, s.sim, s.horizon_days, s.revenue * scale AS revenue, daily * s.horizon_days AS spend FROM sims s JOIN resp r ON r.channel = s.channel AND r.campaign_type = s.campaign_type),
{ROLLED}{ROLLED_ROWS}rows_ WHERE {where}"""


def priced(n_sims: int, resamples: int) -> str:
    """search and final: candidate pairs at 500 simulations and at all; placed: their order in the search."""
    key = "donor_channel, donor_type, receiver_channel, receiver_type"

    def prices(sims: int) -> str:
        return f"""SELECT {key}, quantile_cont(base, 0.5) AS base, quantile_cont(moved, 0.5) AS moved, max(spend) AS spend, max(moved_spend) AS moved_spend FROM (SELECT {key}, sim, sum(revenue) AS base, sum(revenue * scale) AS moved, sum(avg_spend * 90) AS spend, sum(avg_spend * m * 90) AS moved_spend FROM told JOIN sims USING (channel, campaign_type) WHERE horizon_days = 90 AND sim < {sims} GROUP BY ALL) GROUP BY ALL"""

    return with_(DAILY, WINDOW, TREND, DOW, HOLIDAY, RESIDUAL, ELASTIC, RECENT, boot(resamples), paths(n_sims)) + f""",
elig AS (SELECT b.channel, b.campaign_type, avg_spend, beta, ci_low, ci_high FROM boot b JOIN recent r ON r.channel = b.channel AND r.campaign_type = b.campaign_type WHERE NOT low_confidence AND avg_spend >= 5),
lo AS (SELECT * FROM elig ORDER BY beta, channel, campaign_type LIMIT 3), hi AS (SELECT * FROM elig ORDER BY beta DESC, channel, campaign_type LIMIT 3),
pairs AS (SELECT lo.channel AS donor_channel, lo.campaign_type AS donor_type, hi.channel AS receiver_channel, hi.campaign_type AS receiver_type, lo.avg_spend * 0.2 AS shift, lo.beta AS d_beta, lo.ci_low AS d_lo, lo.ci_high AS d_hi, hi.beta AS r_beta, hi.ci_low AS r_lo, hi.ci_high AS r_hi,
 CASE WHEN hi.avg_spend > 0 THEN least((hi.avg_spend + lo.avg_spend * 0.2) / hi.avg_spend, 2.5) ELSE 1 END AS receiver_multiple FROM lo, hi WHERE lo.channel <> hi.channel OR lo.campaign_type <> hi.campaign_type),
sloped AS (SELECT r.channel, r.campaign_type, avg_spend, CASE WHEN low_confidence THEN 1 ELSE beta END AS beta FROM recent r JOIN boot b ON r.channel = b.channel AND r.campaign_type = b.campaign_type),
mult AS (SELECT {key}, channel, campaign_type, avg_spend, beta, CASE WHEN donor_channel = channel AND donor_type = campaign_type THEN 0.8 WHEN receiver_channel = channel AND receiver_type = campaign_type THEN receiver_multiple ELSE 1 END AS m FROM pairs, sloped),
told AS (SELECT *, CASE WHEN m <= 0 THEN 0 WHEN m = 1 THEN 1 WHEN m < 1 THEN pow(m, beta) ELSE 1 + (pow(m, beta) - 1) / (1 + 0.5 * (pow(m, beta) - 1)) END AS scale FROM mult),
search AS ({prices(500)}), final AS ({prices(n_sims)}),
placed AS (SELECT {key}, row_number() OVER (ORDER BY moved - base DESC NULLS LAST, {key}) AS place FROM search)"""


def retro(offsets: list[int], least_days: int, resamples: int) -> str:
    keys = "cutoff, channel, campaign_type"
    return with_(DAILY) + f""", cuts AS (SELECT CAST(b - CAST(o AS INTEGER) AS DATE) AS cutoff FROM (SELECT max(date) AS b FROM features), (SELECT unnest({offsets}) AS o)),
past AS (SELECT cutoff, channel, campaign_type, date, revenue, spend FROM seg, cuts WHERE date <= cutoff),
pair AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS spot FROM (SELECT {keys}, date, ln(spend) AS s, ln(revenue) AS r FROM past WHERE spend > 0 AND revenue > 0)),
est AS (SELECT {keys}, count(*) AS n_obs, regr_slope(r, s) AS b FROM pair GROUP BY {keys} HAVING count(*) >= 10),
picks AS (SELECT {keys}, sample, {draw('n_obs', 'spot', 'cutoff', 'channel', 'campaign_type', 'sample', "'elasticity'", '42')} AS spot FROM pair JOIN est USING ({keys}), (SELECT unnest(range(0, {resamples})) AS sample) WHERE b IS NOT NULL),
slopes AS (SELECT {keys}, sample, regr_slope(r, s) AS b FROM picks JOIN pair USING ({keys}, spot) GROUP BY ALL),
ci AS (SELECT {keys}, quantile_cont(least(greatest(b, 0), 2), 0.9) - quantile_cont(least(greatest(b, 0), 2), 0.1) AS wide FROM slopes WHERE b IS NOT NULL GROUP BY ALL),
long AS (SELECT {keys} FROM past GROUP BY ALL HAVING count(*) >= {least_days}),
late AS (SELECT {keys}, avg(spend) AS avg_spend FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date DESC) AS newest FROM past) WHERE newest <= 28 GROUP BY ALL),
elig AS (SELECT {keys}, least(greatest(b, 0), 2) AS beta FROM est JOIN ci USING ({keys}) JOIN long USING ({keys}) JOIN late USING ({keys}) WHERE wide <= 1 AND avg_spend >= 5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY beta, channel, campaign_type) AS low, row_number() OVER (PARTITION BY cutoff ORDER BY beta DESC, channel, campaign_type) AS high FROM elig),
real_ AS (SELECT cutoff, channel, campaign_type, CASE WHEN sum(spend) > 0 THEN sum(revenue) / sum(spend) END AS roas FROM features, cuts WHERE date > cutoff AND date <= cutoff + 30 GROUP BY ALL),
side AS (SELECT {keys}, low, high, roas FROM ranked LEFT JOIN real_ USING ({keys})),
retro AS (SELECT d.cutoff, d.channel AS donor_channel, d.campaign_type AS donor_type, d.roas AS donor_roas, d.low AS donor_rank, r.channel AS receiver_channel, r.campaign_type AS receiver_type, r.roas AS receiver_roas, r.high AS receiver_rank, r.roas > d.roas AS confirmed
 FROM side d JOIN side r ON d.cutoff = r.cutoff WHERE d.low <= 3 AND r.high <= 3 AND (d.channel <> r.channel OR d.campaign_type <> r.campaign_type))"""


def holt_winters(fixed: tuple[float, float, float]) -> str:
    weights = ", ".join(f"CAST({w} AS DOUBLE) AS {n}" for w, n in zip(fixed, ("alpha", "beta", "gamma"), strict=True))
    days = ", ".join(f"round(max(p) FILTER (k = {k}), 2) AS day_{k}" for k in (1, 30, 120))
    chain = with_(DAILY, WINDOW, smoothed("hw", SEG, "win", fixed)).replace("WITH ", "WITH RECURSIVE ", 1)
    return chain + f"SELECT {SEG}, {weights}, {days}, round(sum(p), 2) AS path_sum, round(max(list_sum(pool)), 2) AS pool_sum FROM hw_path JOIN hw_pools USING ({SEG}) GROUP BY ALL"


CAMP = "channel, campaign_id"
ISSUES = f"""iss AS (SELECT {CAMP}, 'unstable_campaign_name' AS issue, CAST(count(DISTINCT campaign_name) AS DOUBLE) AS amount FROM features GROUP BY ALL HAVING count(DISTINCT campaign_name) > 1
UNION ALL SELECT {CAMP}, 'unstable_campaign_type', count(DISTINCT campaign_type) FROM features GROUP BY {CAMP} HAVING count(DISTINCT campaign_type) > 1
UNION ALL SELECT {CAMP}, 'date_coverage_gap', max(gap) FROM (SELECT {CAMP}, date - lag(date) OVER (PARTITION BY {CAMP} ORDER BY date) AS gap FROM (SELECT DISTINCT {CAMP}, date FROM features)) GROUP BY {CAMP} HAVING max(gap) > 14
UNION ALL SELECT {CAMP}, 'spend_exceeds_daily_budget', count(*) FROM features WHERE daily_budget > 0 AND spend > daily_budget * 1.05 GROUP BY {CAMP}
UNION ALL SELECT {CAMP}, 'conversions_exceed_clicks', count(*) FROM features WHERE channel <> 'meta' AND conversions > clicks GROUP BY {CAMP}
UNION ALL SELECT {CAMP}, 'negative_' || CASE WHEN channel = 'google' AND col = 'spend' THEN '_spend_derived' ELSE col END, count(*) FROM (SELECT {CAMP}, unnest(['spend', 'revenue', 'clicks', 'conversions', 'impressions']) AS col, unnest([spend, revenue, clicks, conversions, impressions]) AS v FROM features) WHERE v < 0 GROUP BY ALL
UNION ALL SELECT {CAMP}, 'zero_revenue_with_spend', round(sum(spend), 4) FROM features GROUP BY {CAMP}, campaign_name HAVING sum(spend) > 0 AND coalesce(sum(revenue), 0) = 0)"""
