"""Feature tables, labels and folds for models, and the walk-forward itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import rolling
from tidemark.operators.signals import PAIRS, pair_as_of
from tidemark.plans.frames import BY_BAR, KEY, in_block, inside, on, query, spread

#: Where samples begin, how often they come, how far labels look, the stop in smoothed ranges, the target.
WARMUP, STEP, MAX_BARS, STOP_RANGES, TARGET = 250, 5, 120, 2.0, 3.0
SCALES = (2, 3, 4, 5, 6)

_RET = ", ".join(f"ln(close / nullif(lag(close, {n}) OVER ({BY_BAR}), 0)) AS ret_{n}" for n in (5, 20, 60, 120))
#: Fourteen features of trend and momentum.
TREND = f"""
SELECT {KEY}, bar_idx, close, atr, ret_5, ret_20, ret_60, ret_120, atr / nullif(close, 0) AS atr_rel, atr / nullif(atr_100, 0) AS atr_trend, rsi / 100 AS rsi, macd_hist / nullif(atr, 0) AS macd_hist_norm,
       (close - ma_50) / nullif(atr, 0) AS dist_ma50, (close - ma_200) / nullif(atr, 0) AS dist_ma200, volume / nullif(vol_50, 0) AS vol_rel, squeeze_on, (high_60 - close) / nullif(atr, 0) AS dist_high60, (close - low_60) / nullif(atr, 0) AS dist_low60
FROM (SELECT *, {_RET}, {rolling('avg(atr)', 100, 20)} AS atr_100, {rolling('avg(close)', 50, 10)} AS ma_50, {rolling('avg(close)', 200, 30)} AS ma_200, {rolling('avg(volume)', 50, 10)} AS vol_50, {rolling('max(high)', 60, 10)} AS high_60, {rolling('min(low)', 60, 10)} AS low_60,
        coalesce({rolling('avg(close)', 20)} + 2 * {rolling('stddev_pop(close)', 20)} < {rolling('avg(close)', 20)} + 1.5 * {rolling('avg(tr)', 20)}, false) AS squeeze_on
      FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER ({BY_BAR}) AS pc FROM {{ind}}) a) b) c"""

_SAMPLED = f"SELECT b.*, n.n_bars FROM {{ind}} b JOIN (SELECT {KEY}, count(*) AS n_bars FROM {{ind}} GROUP BY {KEY}) n ON {on('n', 'b')} WHERE b.bar_idx >= {WARMUP} AND (b.bar_idx - {WARMUP}) % {STEP} = 0 AND b.bar_idx < n.n_bars - {MAX_BARS} - 2"
_PER = ", ".join(
    f"max(CASE WHEN a.scale = {s} THEN {expr} END) AS {name}_s{s}" for s in SCALES
    for name, expr in (("dir", "dir"), ("retrace", "retrace"), ("size_atr", "size_atr"), ("time", "time_ratio"), ("subwaves", "subwaves"))
)
#: Twenty-nine features of where price stands in the turning points of five scales, at the sampled bars.
STRUCTURE = f"""
WITH sampled AS ({_SAMPLED}), pairs AS ({PAIRS}),
at_bar AS (
  SELECT {KEY}, bar_idx, scale, c_seq AS seq, c_i0 AS i0, c_i1 AS i1, CASE WHEN c_p1 > c_p0 THEN 1 ELSE -1 END AS dir, abs(close - c_p1) / nullif(abs(c_p1 - c_p0), 0) AS retrace, abs(c_p1 - c_p0) / nullif(atr, 0) AS size_atr,
         (bar_idx - c_i1) / cast(greatest(c_i1 - c_i0, 1) as double) AS time_ratio
  FROM {pair_as_of("(SELECT s.source, s.symbol, s.timeframe, s.bar_idx, s.close, s.atr, v.scale FROM sampled s CROSS JOIN (VALUES " + ", ".join(f"({s})" for s in SCALES) + ") AS v(scale))", "x.bar_idx", "x.scale")} p WHERE c_p0 IS NOT NULL),
counted AS (SELECT {KEY}, bar_idx, scale, points + 1 AS subwaves FROM {inside("at_bar", "x.scale - 1", "x.i0", "x.i1", "x.bar_idx", "points")} i),
last_three AS (
  SELECT a.source, a.symbol, a.timeframe, a.bar_idx, abs(m.p1 - m.p0) / nullif(abs(m.p0 - m.before), 0) AS length_ratio, greatest(m.i1 - m.i0, 1) / cast(greatest(m.i0 - m.i_before, 1) as double) AS duration_ratio
  FROM at_bar a JOIN (SELECT *, lag(p0) OVER (PARTITION BY {KEY}, scale ORDER BY seq) AS before, lag(i0) OVER (PARTITION BY {KEY}, scale ORDER BY seq) AS i_before FROM pairs) m ON {on("m", "a")} AND m.scale = 4 AND m.seq = a.seq WHERE a.scale = 4)
SELECT a.source, a.symbol, a.timeframe, a.bar_idx, {_PER}, avg(cast(dir as double)) AS scale_agree, sum(CASE WHEN dir > 0 THEN 1 ELSE 0 END) AS n_scales_up, max(l.length_ratio) AS length_ratio, max(l.duration_ratio) AS duration_ratio
FROM at_bar a JOIN counted c ON {on("c", "a")} AND c.bar_idx = a.bar_idx AND c.scale = a.scale LEFT JOIN last_three l ON {on("l", "a")} AND l.bar_idx = a.bar_idx GROUP BY a.source, a.symbol, a.timeframe, a.bar_idx"""

#: Both directions of each sample: what a trade with a stop of two smoothed ranges would have come to.
_BOTH = f"SELECT b.source, b.symbol, b.timeframe, b.bar_idx, b.n_bars, d.direction, {STOP_RANGES} * b.atr AS stop_dist, e.open AS entry, x.close AS end_close FROM sampled b CROSS JOIN (VALUES (1), (-1)) AS d(direction) JOIN {{ind}} e ON {on('e', 'b')} AND e.bar_idx = b.bar_idx + 1 JOIN {{ind}} x ON {on('x', 'b')} AND x.bar_idx = least(b.bar_idx + {MAX_BARS}, b.n_bars - 1)"
BARRIERS = f"""
WITH sampled AS ({_SAMPLED}), both_ways AS ({_BOTH})
SELECT source, symbol, timeframe, bar_idx, direction, CASE WHEN t_stop <= t_target AND t_stop < 2147483647 THEN -1e0 WHEN t_target < 2147483647 THEN {TARGET} ELSE round(direction * (end_close - entry) / nullif(stop_dist, 0), 7) END AS label FROM (
  SELECT s.source, s.symbol, s.timeframe, s.bar_idx, s.direction, s.entry, s.stop_dist, s.end_close,
         coalesce(min(CASE WHEN s.direction > 0 AND b.low <= s.entry - s.stop_dist OR s.direction < 0 AND b.high >= s.entry + s.stop_dist THEN b.bar_idx END), 2147483647) AS t_stop,
         coalesce(min(CASE WHEN s.direction > 0 AND b.high >= s.entry + {TARGET} * s.stop_dist OR s.direction < 0 AND b.low <= s.entry - {TARGET} * s.stop_dist THEN b.bar_idx END), 2147483647) AS t_target
  FROM {spread("both_ways", "bar_idx", f"bar_idx + {MAX_BARS}")} s JOIN {{ind}} b ON {on("b", "s")} {in_block("b", "s")} AND b.bar_idx > s.bar_idx AND b.bar_idx <= s.bar_idx + {MAX_BARS}
  GROUP BY s.source, s.symbol, s.timeframe, s.bar_idx, s.direction, s.entry, s.stop_dist, s.end_close) h"""

_FORWARD = f"""
SELECT s.source, s.symbol, s.timeframe, s.bar_idx, s.direction, b.ts_sec, s.direction * (ln(x.close / s.entry) - {MAX_BARS} * m.drift) * s.entry / nullif(s.stop_dist, 0) AS label_excess, s.direction * ln(x.close / s.entry) * s.entry / nullif(s.stop_dist, 0) AS label_fwd
FROM both_ways s JOIN {{ind}} x ON {on("x", "s")} AND x.bar_idx = s.bar_idx + 1 + {MAX_BARS} JOIN {{ind}} b ON {on("b", "s")} AND b.bar_idx = s.bar_idx
JOIN (SELECT {KEY}, avg(ret) AS drift FROM (SELECT *, ln(close) - ln(lag(close) OVER ({BY_BAR})) AS ret FROM {{ind}}) r GROUP BY {KEY}) m ON {on("m", "s")}"""
#: Forward returns in stop distances: less the series' own drift, plain, and less the mean of all series at that time.
LABELS = f"""
WITH sampled AS ({_SAMPLED}), both_ways AS ({_BOTH}), forward AS ({_FORWARD})
SELECT {KEY}, bar_idx, direction, ts_sec, round(label_excess, 6) AS label_excess, round(label_fwd, 6) AS label_fwd, CASE WHEN n >= 3 THEN round(label_fwd - direction * mean_long, 6) END AS label_xs
FROM (SELECT *, avg(CASE WHEN direction > 0 THEN label_fwd END) OVER (PARTITION BY timeframe, ts_sec) AS mean_long, sum(CASE WHEN direction > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY timeframe, ts_sec) AS n FROM forward) f"""

#: Signed features turn with the direction; the others stay.
SIGNED = ("ret_5", "ret_20", "ret_60", "ret_120", "macd_hist_norm", "dist_ma50", "dist_ma200", "scale_agree", *(f"dir_s{s}" for s in SCALES))


_AMONG = "ORDER BY ts_sec, source, symbol, timeframe, direction"
#: Samples in order of time, cut into equal folds: numbered by day and within each day, or (for checking) all at once.
_PLACED = {
    False: f"""days AS (SELECT day, n, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM (SELECT floor(ts_sec / 86400) AS day, count(*) AS n FROM timed GROUP BY floor(ts_sec / 86400)) c),
placed AS (SELECT t.*, cast(floor((before + row_number() OVER (PARTITION BY day {_AMONG}) - 1) / floor(total / {{}}e0)) as int) AS fold FROM timed t JOIN days d ON d.day = floor(t.ts_sec / 86400))""",
    True: f"placed AS (SELECT *, cast(floor((row_number() OVER ({_AMONG}) - 1) / floor(count(*) OVER () / {{}}e0)) as int) AS fold FROM timed)",
}


def folds_sql(n_folds: int = 5, least_train: int = 100, least_test: int = 20, whole: bool = False) -> str:
    """Expanding folds over time: test fold k, and how many samples before it end before it begins.

    A sample may train only if its label ends before the fold's first sample; small folds are left out.
    """
    return f"""
WITH sampled AS ({_SAMPLED}), timed AS (
  SELECT s.source, s.symbol, s.timeframe, s.bar_idx, d.direction, s.ts_sec, e.ts_sec AS end_sec FROM sampled s CROSS JOIN (VALUES (1), (-1)) AS d(direction) JOIN {{ind}} e ON {on("e", "s")} AND e.bar_idx = s.bar_idx + 1 + {MAX_BARS}),
{_PLACED[whole].format(n_folds + 1)},
begins AS (SELECT fold, min(ts_sec) AS from_sec, count(*) AS n_test FROM placed WHERE fold BETWEEN 1 AND {n_folds} GROUP BY fold)
SELECT b.fold, b.n_test, count(p.bar_idx) AS n_train FROM begins b LEFT JOIN placed p ON p.fold < b.fold AND p.end_sec < b.from_sec GROUP BY b.fold, b.n_test HAVING count(p.bar_idx) >= {least_train} AND b.n_test >= {least_test}"""


def dataset(bars_with_indicators: DataFrame, pivots: DataFrame) -> DataFrame:
    """One row for each sampled bar and direction: features, turned with the direction, labels and their end."""
    trend = query(TREND, ind=bars_with_indicators).drop("close", "atr")
    structure = query(STRUCTURE, ind=bars_with_indicators, pivots=pivots)
    keys = [*KEY.split(", "), "bar_idx"]
    labels = query(LABELS, ind=bars_with_indicators).join(query(BARRIERS, ind=bars_with_indicators), [*keys, "direction"])
    ends = bars_with_indicators.select(*KEY.split(", "), (F.col("bar_idx") - 1 - MAX_BARS).alias("bar_idx"), F.col("ts_sec").alias("end_sec"))
    rows = labels.join(ends, keys).join(trend, keys).join(structure, keys)
    return rows.withColumns({c: F.col(c) * F.col("direction") for c in SIGNED}).withColumn("squeeze_on", F.col("squeeze_on").cast("int"))


_KEYS = [*KEY.split(", "), "bar_idx", "direction", "ts_sec"]


def _names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in {*_KEYS, "end_sec", "label", "label_excess", "label_fwd", "label_xs"}]


def _vectors(rows: DataFrame, label: str, structure: bool = True) -> DataFrame:
    """structure: with the features of turning points; a row that lacks any feature is left out either way."""
    from pyspark.ml.feature import VectorAssembler

    features = _names(rows)
    used = features if structure else [f for f in features if f in _TREND_NAMES]
    return VectorAssembler(inputCols=used, outputCol="features").transform(rows.dropna(subset=[*features, label])).select(*_KEYS, *(["end_sec"] if "end_sec" in rows.columns else []), "features", F.col(label).alias("y"))


def _trees(max_iter: int, seed: int):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="features", labelCol="y", maxIter=max_iter, maxDepth=3, seed=seed)


def holdout(rows: DataFrame, symbols: tuple[str, ...], label: str = "label_excess", max_iter: int = 8, seed: int = 1) -> DataFrame:
    """Predictions for symbols that were never trained on, from a model of all others. fold is 0."""
    vectors = _vectors(rows, label).persist()
    model = _trees(max_iter, seed).fit(vectors.filter(~F.col("symbol").isin(*symbols)))
    return model.transform(vectors.filter(F.col("symbol").isin(*symbols))).select(*_KEYS, F.lit(0).alias("fold"), "y", "prediction")


def _in_order(rows: DataFrame, size: int) -> DataFrame:
    """Rows with fold: in order of time, cut every size rows; numbered by day and within each day."""
    from pyspark.sql import Window

    dated = rows.withColumn("day", F.floor(F.col("ts_sec") / 86400))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = dated.groupBy("day").count().select("day", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("ts_sec", *KEY.split(", "), "direction")) - 1
    return dated.join(days, "day").withColumn("fold", F.floor(place / size)).drop("day", "before")


def importances(rows: DataFrame, label: str = "label_excess", max_iter: int = 8, seed: int = 1, top: int = 15) -> DataFrame:
    """The features that matter most to a model of the first four fifths of time: place, feature, importance, is_structure."""
    vectors, names = _vectors(rows, label).persist(), _names(rows)
    n, schema = vectors.count(), "place int, feature string, importance double, is_structure boolean"
    if n < 5:
        return rows.sparkSession.createDataFrame([], schema)
    early = _in_order(vectors, max(1, n // 5)).persist().filter("fold < 4")
    found = _trees(max_iter, seed).fit(early).featureImportances.toArray()
    trends = {*_TREND_NAMES, "direction"}
    ranked = sorted(zip(names, map(float, found), strict=True), key=lambda x: (-x[1], x[0]))[:top]
    return rows.sparkSession.createDataFrame([(i, f, v, f not in trends) for i, (f, v) in enumerate(ranked, 1)], schema)


_TREND_NAMES = ("ret_5", "ret_20", "ret_60", "ret_120", "atr_rel", "atr_trend", "rsi", "macd_hist_norm", "dist_ma50", "dist_ma200", "vol_rel", "squeeze_on", "dist_high60", "dist_low60")


def walk_forward(rows: DataFrame, label: str = "label_excess", n_folds: int = 5, max_iter: int = 8, seed: int = 1, least_train: int = 500, least_test: int = 100, structure: bool = True) -> DataFrame:
    """Predictions of gradient-boosted trees for each test fold, trained on rows whose labels end before it begins.

    rows: a dataset. structure: with all features, else with those of trend alone. Folds with fewer rows than least_train or least_test are left out. Rows without a feature or the label are left out. The loop over folds is the driver's,
    each fit is Spark's.
    """
    keys, vectors = _KEYS, _vectors(rows, label, structure).persist()
    n = vectors.count()
    placed = _in_order(vectors, max(1, n // (n_folds + 1))).persist()
    begins = {r.fold: r.t for r in placed.groupBy("fold").agg(F.min("ts_sec").alias("t")).collect()}
    out = placed.limit(0).select(*keys, "fold", "y", F.lit(0.0).alias("prediction"))
    for k in range(1, n_folds + 1):
        test = placed.filter(F.col("fold") == k)
        train = placed.filter((F.col("fold") < k) & (F.col("end_sec") < F.lit(begins.get(k))))
        if test.count() < least_test or train.count() < least_train:
            continue
        out = out.unionByName(_trees(max_iter, seed).fit(train).transform(test).select(*keys, "fold", "y", "prediction"))
    return out


#: How good predictions are: rank correlation, and the top tenth's mean against all. {predicted}: fold, direction, y, prediction.
REPORT = """
SELECT fold, count(*) AS n, corr(rank_p, rank_y) AS rho, avg(y) AS mean_all, avg(CASE WHEN prediction >= middle THEN y END) AS mean_upper_half, avg(CASE WHEN prediction >= cut THEN y END) AS mean_top, avg(CASE WHEN prediction >= cut THEN CASE WHEN direction > 0 THEN 1e0 ELSE 0e0 END END) AS top_long_share
FROM (SELECT p.*, c.cut, c.middle, rank() OVER (PARTITION BY p.fold ORDER BY prediction) AS rank_p, rank() OVER (PARTITION BY p.fold ORDER BY y) AS rank_y
      FROM {predicted} p JOIN (SELECT fold, percentile_cont(0.9) WITHIN GROUP (ORDER BY prediction) AS cut, percentile_cont(0.5) WITHIN GROUP (ORDER BY prediction) AS middle FROM {predicted} GROUP BY fold) c ON c.fold = p.fold) r GROUP BY fold"""


def _top(predicted: str) -> str:
    """Predictions with is_top: whether they are in the tenth of all folds that is predicted best."""
    cut = f"SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY prediction) AS cut FROM {predicted} c"
    return f"SELECT p.*, p.prediction >= c.cut AS is_top, p.prediction >= c.middle AS is_upper FROM {predicted} p CROSS JOIN ({cut.replace(' AS cut', ' AS cut, percentile_cont(0.5) WITHIN GROUP (ORDER BY prediction) AS middle')}) c"


def _judged(predicted: str, name: str) -> str:
    """How good a model is over all its folds; values are ranked within a fold and the correlation is weighed by the folds' sizes."""
    rho = f"SELECT sum(n * rho) / sum(CASE WHEN rho IS NOT NULL THEN n END) AS rho FROM (SELECT fold, count(*) AS n, corr(rank_p, rank_y) AS rho FROM (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY prediction) AS rank_p, rank() OVER (PARTITION BY fold ORDER BY y) AS rank_y FROM {predicted} p) r GROUP BY fold) f"
    means = f"SELECT count(*) AS n, avg(y) AS mean_all, avg(CASE WHEN is_upper THEN y END) AS mean_upper_half, avg(CASE WHEN is_top THEN y END) AS mean_top, var_samp(CASE WHEN is_top THEN y END) AS var_top, sum(CASE WHEN is_top THEN 1 ELSE 0 END) AS n_top FROM ({_top(predicted)}) t"
    return f"(SELECT m.*, f.rho FROM ({means}) m CROSS JOIN ({rho}) f) {name}"


#: What features of structure add to those of trend: {both} against {trend}, predictions of the same folds; one row, without predictions none.
FEATURE_SETS = f"""
SELECT b.n, a.rho AS rho_trend, b.rho AS rho_both, a.mean_all, a.mean_upper_half AS upper_half_trend, b.mean_upper_half AS upper_half_both, a.mean_top AS top_trend, b.mean_top AS top_both, b.mean_top - a.mean_top AS difference,
       (b.mean_top - a.mean_top) / nullif(sqrt(a.var_top / nullif(a.n_top, 0) + b.var_top / nullif(b.n_top, 0)), 0) AS t
FROM {_judged("{trend}", "a")} CROSS JOIN {_judged("{both}", "b")} WHERE b.n > 0"""


def controls_sql(one_class: tuple[str, ...], least: int = 30) -> str:
    """Whether the best predictions stand out in both directions and in both classes of symbols: top tenth against all of the part.

    {predicted}: symbol, direction, y, prediction. one_class: the symbols of the first class. Parts with fewer than least
    rows at the top are left out.
    """
    symbols = ", ".join("'" + s.replace("'", "''") + "'" for s in one_class)
    parts = f"explode(array(struct('direction' AS control, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS part), struct('class' AS control, CASE WHEN symbol IN ({symbols}) THEN 'one' ELSE 'other' END AS part)))"
    return f"""
SELECT control, part, n, n_top, mean_top, mean_all, mean_top - mean_all AS lift, (mean_top - mean_all) / nullif(sqrt(var_top / n_top + var_all / n), 0) AS t FROM (
  SELECT c.control, c.part, count(*) AS n, sum(CASE WHEN is_top THEN 1 ELSE 0 END) AS n_top, avg(CASE WHEN is_top THEN y END) AS mean_top, avg(y) AS mean_all, var_samp(CASE WHEN is_top THEN y END) AS var_top, var_samp(y) AS var_all
  FROM (SELECT y, is_top, {parts} AS c FROM ({_top("{predicted}")}) p) s GROUP BY c.control, c.part) g WHERE n_top >= {least}"""
