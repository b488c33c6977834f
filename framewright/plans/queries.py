"""The registered queries of the engine over the driver's tables, each with its SQL.

Users of `events` are episodes and event types features; orders are episodes and their line items
frames; labels of `embeddings` are episodes of 64-dimensional frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import geometry, text
from framewright.operators import align, quality, sequence, stats
from framewright.operators.align import Mapping
from framewright.sources.events import messages, table

FPS, TOLERANCE = 1 / 16384, 3_600_000_000_000
PERIOD = int(1e9 / FPS)
KEYS = ["click", "error", "purchase", "signup", "view"]
REQUIRED = ["click", "view"]
MAPPINGS = [Mapping("click", "observation.a"), Mapping("click", "action.a", max_delay_ms=20.0), Mapping("view", "observation.b", stamp="header"), Mapping("error", "observation.c", required=False, stamp="header"), Mapping("audio", "observation.d", required=False)]
MAX_DELAY_MS = 50.0
VIDEO_FPS, SPLIT = 10.0, (0.7, 0.15, 0.15)
SPANS = [(0.0, 800.0, "early"), (800.0, 1600.0, "middle"), (1600.0, 2600.0, "late")]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


M = "m AS (SELECT user_id AS episode_index, event_type AS topic, epoch_us(ts) * 1000 AS recv_ns, CASE WHEN CAST(props->>'$.k' AS BIGINT) % 10 <> 0 THEN epoch_us(ts) * 1000 - CAST(props->>'$.k' AS BIGINT) * 1000000 END AS header_ns, event_id AS seq, value FROM events)"
MAP = "map(topic, feature_key, required, max_delay_ms, stamp) AS (VALUES " + ", ".join(f"('{m.topic}', '{m.key}', {str(m.required).lower()}, CAST({m.max_delay_ms if m.max_delay_ms is not None else 'NULL'} AS DOUBLE), '{m.stamp}')" for m in MAPPINGS) + ")"
IN_KEYS = ", ".join(f"'{k}'" for k in KEYS)
IN_REQ = ", ".join(f"'{k}'" for k in REQUIRED)
WINDOW = f"per AS (SELECT episode_index, topic, min(recv_ns) a, max(recv_ns) b FROM m WHERE topic IN ({IN_REQ}) GROUP BY ALL), win AS (SELECT episode_index, max(a) AS start_ns, min(b) AS end_ns FROM per GROUP BY 1 HAVING count(*) = {len(REQUIRED)} AND min(b) >= max(a))"
GRID = f"grid AS (SELECT episode_index, i AS frame_index, start_ns + i * {PERIOD} AS grid_ns FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((end_ns - start_ns) / 1e9::DOUBLE * {FPS!r}::DOUBLE) AS BIGINT)))) AS i FROM win))"
POINTS = f"pts AS (SELECT grid.*, k AS feature_key FROM grid, (SELECT unnest([{IN_KEYS}]) AS k))"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("episode_index", F.col("topic").alias("feature_key"), F.col("recv_ns").alias("ts_ns"), "seq", "value")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.frame_grid(align.required_window(samples(spark, sf_dir), REQUIRED), FPS)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.route(messages(spark, sf_dir), align.mapping_table(spark, MAPPINGS))


@register(f"WITH {M} SELECT topic, count(*) AS n_messages, min(recv_ns) AS first_ns, max(recv_ns) AS last_ns FROM m GROUP BY 1")
def topic_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n_messages"), F.min("recv_ns").alias("first_ns"), F.max("recv_ns").alias("last_ns"))


@register(f"WITH {M} SELECT episode_index, min(recv_ns) AS start_ns, max(recv_ns) AS end_ns FROM m GROUP BY 1")
def full_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.full_window(messages(spark, sf_dir))


@register(f"WITH {M}, {MAP} SELECT episode_index, seq, feature_key, recv_ns FROM m JOIN map USING (topic)")
def topic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select("episode_index", "seq", "feature_key", "recv_ns")


@register(f"WITH {M}, {MAP} SELECT DISTINCT topic FROM m WHERE topic NOT IN (SELECT topic FROM map)")
def unused_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.unused_topics(messages(spark, sf_dir), align.mapping_table(spark, MAPPINGS))


@register(f"WITH {M}, {MAP} SELECT DISTINCT topic, required FROM map WHERE topic NOT IN (SELECT topic FROM m)")
def missing_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.missing_topics(messages(spark, sf_dir), align.mapping_table(spark, MAPPINGS))


@register(f"WITH {M}, {MAP} SELECT episode_index, seq, feature_key FROM m JOIN map USING (topic) WHERE NOT coalesce(abs(recv_ns - header_ns) > coalesce(max_delay_ms, {MAX_DELAY_MS}) * 1e6, false)")
def stale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.drop_stale(routed(spark, sf_dir), MAX_DELAY_MS).select("episode_index", "seq", "feature_key")


@register(f"WITH {M}, {MAP} SELECT episode_index, seq, feature_key, CASE WHEN stamp = 'header' THEN coalesce(header_ns, recv_ns) ELSE recv_ns END AS ts_ns FROM m JOIN map USING (topic)")
def adopted_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.adopt_timestamp(routed(spark, sf_dir)).select("episode_index", "seq", "feature_key", "ts_ns")


@register(f"WITH {M}, {WINDOW} SELECT * FROM win")
def required_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.required_window(samples(spark, sf_dir), REQUIRED)


@register(f"WITH {M}, {WINDOW}, {GRID} SELECT * FROM grid")
def frame_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir)


HOLD_SQL = f"""WITH {M}, {WINDOW}, {GRID}, {POINTS}, f AS (SELECT episode_index, topic, arg_min(recv_ns, recv_ns) AS t0, arg_min(value, recv_ns) AS v0 FROM m GROUP BY ALL),
j AS (SELECT p.episode_index, p.frame_index, p.feature_key, p.grid_ns, m.recv_ns, m.value FROM pts p ASOF LEFT JOIN m ON p.episode_index = m.episode_index AND p.feature_key = m.topic AND p.grid_ns >= m.recv_ns),
hold AS (SELECT j.episode_index, frame_index, feature_key, grid_ns, CASE WHEN recv_ns IS NOT NULL THEN recv_ns WHEN t0 - grid_ns <= {TOLERANCE} THEN t0 END AS src_ns, CASE WHEN recv_ns IS NOT NULL THEN j.value WHEN t0 - grid_ns <= {TOLERANCE} THEN v0 END AS value
 FROM j LEFT JOIN f ON j.episode_index = f.episode_index AND j.feature_key = f.topic)"""


def resampled(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    """Frames with src_ns -1 where there is no sample, so that the column has no nulls."""
    found = samples(spark, sf_dir)
    out = align.resample_windows(found, align.required_window(found, REQUIRED), FPS, KEYS, policy, TOLERANCE)
    return out.withColumn("src_ns", F.coalesce("src_ns", F.lit(-1).cast("long")))


@register(f"{HOLD_SQL} SELECT * REPLACE (coalesce(src_ns, -1) AS src_ns) FROM hold")
def resample_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark, sf_dir, "hold")


NEAREST_SQL = f"""WITH {M}, {WINDOW}, {GRID}, {POINTS},
b AS (SELECT p.*, m.recv_ns AS tb, m.value AS vb FROM pts p ASOF LEFT JOIN m ON p.episode_index = m.episode_index AND p.feature_key = m.topic AND p.grid_ns >= m.recv_ns),
a AS (SELECT b.*, m.recv_ns AS ta, m.value AS va FROM b ASOF LEFT JOIN m ON b.episode_index = m.episode_index AND b.feature_key = m.topic AND b.grid_ns < m.recv_ns),
c AS (SELECT *, CASE WHEN ta IS NULL OR grid_ns - tb <= ta - grid_ns THEN tb ELSE ta END AS t, CASE WHEN ta IS NULL OR grid_ns - tb <= ta - grid_ns THEN vb ELSE va END AS v FROM a)
SELECT episode_index, frame_index, feature_key, grid_ns, CASE WHEN abs(t - grid_ns) <= {TOLERANCE} THEN t ELSE -1 END AS src_ns, CASE WHEN abs(t - grid_ns) <= {TOLERANCE} THEN v END AS value FROM c"""


@register(NEAREST_SQL)
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark, sf_dir, "nearest")


@register(NEAREST_SQL)
def resample_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark, sf_dir, "drop")


WIDE_SQL = f"{HOLD_SQL}, wide AS (SELECT episode_index, frame_index, " + ", ".join(f"max(CASE WHEN feature_key = '{k}' THEN value END) AS \"{k}\"" for k in KEYS) + " FROM hold GROUP BY ALL)"


@register(f"{WIDE_SQL} SELECT * FROM wide")
def wide_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.widen(resample_hold(spark, sf_dir), KEYS)


@register(f"{WIDE_SQL}, e AS (SELECT *, min(CASE WHEN error IS NOT NULL AND purchase IS NOT NULL THEN frame_index END) OVER (PARTITION BY episode_index) AS lo, max(CASE WHEN error IS NOT NULL AND purchase IS NOT NULL THEN frame_index END) OVER (PARTITION BY episode_index) AS hi FROM wide) SELECT * EXCLUDE (lo, hi) REPLACE (frame_index - lo AS frame_index) FROM e WHERE frame_index BETWEEN lo AND hi")
def trim_to_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.trim_to_valid(wide_frames(spark, sf_dir), ["error", "purchase"])


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


E64 = "e AS (SELECT label AS episode_index, unnest(range(0, 64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.explode_dims(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "episode_index"), ["episode_index"], "embedding").withColumn("dim", F.col("dim").cast("long"))


def _stats_sql(by: str) -> str:
    return f"WITH {E64} SELECT {by}, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS count FROM e GROUP BY ALL"


@register(_stats_sql("dim"))
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.feature_stats(dims(spark, sf_dir), ["dim"]), "min", "max", "mean", "std")


@register(_stats_sql("episode_index, dim"))
def episode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.feature_stats(dims(spark, sf_dir), ["episode_index", "dim"]), "min", "max", "mean", "std")


QS = [(q, f"q{round(q * 100):02d}") for q in stats.QUANTILES]


@register(f"WITH {E64} SELECT dim, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for q, n in QS) + " FROM e GROUP BY 1")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.exact_quantiles(dims(spark, sf_dir), ["dim"]), *[n for _, n in QS])


@register(f"""WITH {E64}, r AS (SELECT dim, min(v) lo, max(v) hi, count(v) n FROM e GROUP BY 1),
h AS (SELECT dim, CASE WHEN hi > lo THEN least({stats.BINS - 1}, floor((v - lo) / ((hi - lo) / {stats.BINS}))) ELSE {stats.BINS - 1} END AS bin, count(*) c, any_value(lo) lo, any_value(hi) hi, any_value(n) n FROM e JOIN r USING (dim) GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto FROM h)
SELECT dim, """ + ", ".join(f"round(arg_min(CASE WHEN hi > lo THEN lo + (hi - lo) / {stats.BINS} * (bin + ({q}::DOUBLE * n - (upto - c)) / c) ELSE lo END, bin) FILTER (upto >= {q}::DOUBLE * n), 6) AS {n}" for q, n in QS) + " FROM w GROUP BY 1")
def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram_quantiles(dims(spark, sf_dir), ["dim"]), *[n for _, n in QS])


DT = f"{M}, d AS (SELECT *, recv_ns - lag(recv_ns) OVER (PARTITION BY episode_index, topic ORDER BY recv_ns, seq) AS dt, row_number() OVER (PARTITION BY episode_index, topic ORDER BY recv_ns, seq) - 1 AS k FROM m)"


@register(f"""WITH {DT}, g AS (SELECT episode_index, topic, count(*) AS n_messages, min(recv_ns) AS first_ns, max(recv_ns) AS last_ns,
 count(CASE WHEN dt > 0 THEN 1 END) / (sum(CASE WHEN dt > 0 THEN dt END) / 1e9::DOUBLE) AS mean_fps, min(CASE WHEN dt > 0 THEN 1e9::DOUBLE / dt END) AS min_fps, max(CASE WHEN dt > 0 THEN 1e9::DOUBLE / dt END) AS max_fps,
 stddev_pop(CASE WHEN dt > 0 THEN 1e9::DOUBLE / dt END) AS std_fps, quantile_cont(CASE WHEN dt > 0 THEN 1e9::DOUBLE / dt END, 0.01) AS p01_fps, quantile_cont(CASE WHEN dt > 0 THEN 1e9::DOUBLE / dt END, 0.99) AS p99_fps FROM d GROUP BY ALL),
 w AS (SELECT episode_index, min(recv_ns) a, max(recv_ns) b FROM m GROUP BY 1)
SELECT g.episode_index, topic, n_messages, first_ns, last_ns, round(mean_fps, 9) AS mean_fps, round(min_fps, 9) AS min_fps, round(max_fps, 9) AS max_fps, round(std_fps, 9) AS std_fps, round(p01_fps, 9) AS p01_fps, round(p99_fps, 9) AS p99_fps,
 round((first_ns - a) / 1e6::DOUBLE, 3) AS head_lag_ms, round((b - last_ns) / 1e6::DOUBLE, 3) AS tail_lag_ms FROM g JOIN w USING (episode_index)""")
def fps_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    out = stats.fps_report(m, ["episode_index", "topic"], align.full_window(m))
    return rounded(rounded(out, "mean_fps", "min_fps", "max_fps", "std_fps", "p01_fps", "p99_fps", digits=9), "head_lag_ms", "tail_lag_ms", digits=3)


GAP = 86_400_000_000_000


@register(f"WITH {DT} SELECT episode_index, topic, recv_ns - dt AS at_ns, round(dt / 1e6::DOUBLE, 3) AS gap_ms FROM d WHERE dt > {GAP}")
def gap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.gaps(messages(spark, sf_dir), ["episode_index", "topic"], GAP), "gap_ms", digits=3)


@register(f"WITH {DT} SELECT episode_index, topic, k, round(dt / 1e6::DOUBLE, 3) AS dt_ms FROM d WHERE k BETWEEN 1 AND 5")
def head_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.head_intervals(messages(spark, sf_dir), ["episode_index", "topic"], 5), "dt_ms", digits=3)


HOLED = "n AS (SELECT label AS episode_index, CASE WHEN vec_id % 11 <> 0 THEN embedding END AS v FROM embeddings), nulls AS (SELECT episode_index, CAST(coalesce(sum(len(v)), 0) AS BIGINT) AS n_values, count(*) FILTER (v IS NULL) AS n_null, CAST(coalesce(sum(len(list_filter(v, lambda x: isnan(x)))), 0) AS BIGINT) AS n_nan FROM n GROUP BY 1)"


@register(f"WITH {HOLED} SELECT * FROM nulls")
def quality_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = table(spark, sf_dir, "embeddings").select(F.col("label").alias("episode_index"), F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("v"))
    return quality.null_counts(holed, ["episode_index"], "v")


BOUNDS = "bounds AS (SELECT dim, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM e GROUP BY 1)"


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims(spark, sf_dir).groupBy("dim").agg(F.percentile("v", F.lit(0.05)).alias("lo"), F.percentile("v", F.lit(0.95)).alias("hi"))


OOR = f"WITH {E64}, {BOUNDS}, o AS (SELECT episode_index, count(*) AS n_values, count(*) FILTER (NOT isnan(v) AND (v < lo - 0.01 OR v > hi + 0.01)) AS n_oor FROM e JOIN bounds USING (dim) GROUP BY 1)"


@register(f"{OOR} SELECT * FROM o")
def quality_oor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.out_of_range(dims(spark, sf_dir), bounds(spark, sf_dir), ["dim"], ["episode_index"], 0.01)


FREEZE = """p AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
u AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(before) AS y FROM p WHERE before IS NOT NULL),
s AS (SELECT label, vec_id, stddev_pop(CAST(x AS FLOAT) - CAST(y AS FLOAT)) AS sd FROM u GROUP BY ALL), z AS (SELECT CAST(label AS INTEGER) AS episode_index, count(*) AS pairs, count(*) FILTER (sd <= 0.15) AS frozen FROM s GROUP BY 1)"""


def frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.freeze_pairs(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "episode_index"), ["episode_index"], "vec_id", "embedding", 0.15)


@register(f"WITH {FREEZE} SELECT * FROM z")
def freeze_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frozen(spark, sf_dir)


SCORE = f"{OOR}, {FREEZE}, {HOLED}, r AS (SELECT (n_null + n_nan) / nulls.n_values AS null_rate, n_oor / o.n_values AS oor_rate, frozen / pairs AS freeze_rate FROM o JOIN z USING (episode_index) JOIN nulls USING (episode_index)), s1 AS (SELECT 1 - least(1.0, greatest(0.0, 0.5 * avg(null_rate) + 0.3 * avg(oor_rate) + 0.2 * avg(freeze_rate))) AS score FROM r)"


def quality_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nulls = quality_nulls(spark, sf_dir).select("episode_index", ((F.col("n_null") + F.col("n_nan")) / F.col("n_values")).alias("null_rate"))
    oor = quality_oor(spark, sf_dir).select("episode_index", (F.col("n_oor") / F.col("n_values")).alias("oor_rate"))
    still = frozen(spark, sf_dir).select("episode_index", (F.col("frozen") / F.col("pairs")).alias("freeze_rate"))
    return nulls.join(oor, "episode_index").join(still, "episode_index")


@register(f"{SCORE} SELECT round(score, 6) AS score, CASE WHEN score < 0.95 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM s1")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.score(quality_rates(spark, sf_dir)), "score")


L = "l AS (SELECT l_orderkey AS episode_index, l_linenumber AS frame_index, l_quantity AS q, l_returnflag AS task, epoch_us(l_shipdate) / 1e6 AS t, l_orderkey * 8 + l_linenumber AS gi FROM lineitem), len AS (SELECT episode_index, count(*) AS length FROM l GROUP BY 1)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS episode_index", "l_linenumber AS frame_index", "l_quantity AS q", "l_returnflag AS task", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(l_shipdate AS TIMESTAMP_NTZ)) / 1e6D AS t", "l_orderkey * 8 + l_linenumber AS gi")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("episode_index").agg(F.count("*").alias("length"))


@register(f"WITH {L} SELECT episode_index, length, row_number() OVER (ORDER BY episode_index) - 1 AS new_index FROM len WHERE length >= 3")
def min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.min_length(lines(spark, sf_dir), 3)


@register(f"WITH {L} SELECT episode_index, length, CAST(sum(length) OVER (ORDER BY episode_index ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS dataset_from_index, CAST(sum(length) OVER (ORDER BY episode_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dataset_to_index FROM len")
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.global_index(lengths(spark, sf_dir))


@register(f"WITH {L}, first AS (SELECT episode_index FROM len ORDER BY 1 LIMIT 100) SELECT episode_index, count(*) AS n FROM l JOIN first USING (episode_index) GROUP BY 1")
def max_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.first_episodes(lines(spark, sf_dir), 100).groupBy("episode_index").agg(F.count("*").alias("n"))


@register("WITH n AS (SELECT count(*) AS n FROM orders), i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey AS episode_index, CASE WHEN k < round_even(0.7 * n, 0) THEN 'train' WHEN k < round_even(0.7 * n, 0) + least(round_even(0.15 * n, 0), n - round_even(0.7 * n, 0)) THEN 'val' ELSE 'test' END AS split FROM i, n")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_index"), F.lit(1).alias("one"))
    numbered = sequence.running(keys, "one", "k").withColumn("k", F.col("k") - 1)
    return sequence.assign_split(numbered, sequence.splits(keys.count(), SPLIT), "k").select("episode_index", "split")


DICT = "f AS (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1), dict AS (SELECT event_type, row_number() OVER (ORDER BY first, event_type) - 1 AS task_index FROM f)"


@register(f"WITH {DICT} SELECT event_type, task_index FROM dict")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.dictionary(table(spark, sf_dir, "events"), "event_type", "event_id")


@register(f"WITH {DICT}, s AS (SELECT DISTINCT user_id AS episode_index, task_index FROM events JOIN dict USING (event_type)) SELECT episode_index, string_agg(CAST(task_index AS VARCHAR), ',' ORDER BY task_index) AS tasks FROM s GROUP BY 1")
def episode_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sequence.episode_tasks(e.withColumnRenamed("user_id", "episode_index"), "event_type", sequence.dictionary(e, "event_type", "event_id"))


@register("SELECT o_orderkey AS episode_index, CASE " + " ".join(f"WHEN d >= {a} - 1e-6 AND (d < {b}{f' OR d <= {b} + 1e-6' if k == len(SPANS) - 1 else ''}) THEN '{s}'" for k, (a, b, s) in enumerate(SPANS)) + " END AS subtask FROM (SELECT o_orderkey, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS d FROM orders)")
def subtask_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS episode_index", "CAST(datediff(o_orderdate, DATE'1995-01-01') AS DOUBLE) AS t")
    return sequence.lookup_span(days, sequence.span_table(spark, SPANS), "t").select("episode_index", "subtask")


@register("""WITH s AS (SELECT conv_id, CAST(turn AS DOUBLE) AS a, CAST(turn + CASE WHEN length(text) % 7 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS b, count(*) OVER (PARTITION BY conv_id) * 10 AS n FROM conversations),
g AS (SELECT *, coalesce(abs(lead(a) OVER (PARTITION BY conv_id ORDER BY a) - b) > 1e-6, false) AS gap FROM s)
SELECT conv_id, abs(min(a)) <= 1e-6 AS starts_at_zero, max(CAST(gap AS INT)) = 0 AS touching, max(b) >= max(n) / 10.0 - 1e-6 AS reaches_end FROM g GROUP BY 1""")
def subtask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = table(spark, sf_dir, "conversations").selectExpr("conv_id", "CAST(turn AS DOUBLE) AS start", "CAST(turn + CASE WHEN char_length(text) % 7 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS end")
    s = s.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")) * 10)
    return sequence.span_coverage(s, "conv_id", "n", 10.0)


OFFSETS = f"{L}, off AS (SELECT episode_index, episode_index // 1000 AS file_index, length, round((sum(length) OVER w - length) / {VIDEO_FPS}::DOUBLE, 6) AS from_timestamp, round(sum(length) OVER w / {VIDEO_FPS}::DOUBLE, 6) AS to_timestamp FROM len WINDOW w AS (PARTITION BY episode_index // 1000 ORDER BY episode_index ROWS UNBOUNDED PRECEDING))"


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.video_offsets(lengths(spark, sf_dir).withColumn("file_index", F.expr("episode_index div 1000")), VIDEO_FPS)


@register(f"WITH {OFFSETS} SELECT * FROM off")
def video_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets(spark, sf_dir)


BROKEN = "bad AS (SELECT * REPLACE (CASE WHEN episode_index % 97 = 5 THEN to_timestamp + 0.001 ELSE to_timestamp END AS to_timestamp) FROM off), au AS (SELECT *, coalesce(lag(to_timestamp) OVER (PARTITION BY file_index ORDER BY episode_index), 0.0) AS expected FROM bad)"


@register(f"WITH {OFFSETS}, {BROKEN} SELECT episode_index, file_index, round((from_timestamp - expected) * 1e6, 1) AS delta_us FROM au WHERE abs(from_timestamp - expected) > 1e-6 + 1e-9")
def timestamp_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = offsets(spark, sf_dir).withColumn("to_timestamp", F.when(F.col("episode_index") % 97 == 5, F.col("to_timestamp") + 0.001).otherwise(F.col("to_timestamp")))
    return sequence.audit_offsets(planted).select("episode_index", "file_index", F.round(F.col("delta") * 1e6, 1).alias("delta_us"))


@register(f"WITH {OFFSETS}, n AS (SELECT file_index, sum(length) - 2 AS n_frames FROM off GROUP BY 1), r AS (SELECT l.episode_index, frame_index, CAST(round_even((from_timestamp + (row_number() OVER (PARTITION BY l.episode_index ORDER BY frame_index) - 1) / {VIDEO_FPS}::DOUBLE) * {VIDEO_FPS}::DOUBLE, 0) AS BIGINT) AS requested, n_frames FROM l JOIN off USING (episode_index) JOIN n USING (file_index)) SELECT episode_index, frame_index, requested, requested >= 0 AND requested < n_frames AS in_range, CAST(greatest(0, requested - n_frames + 1) AS BIGINT) AS overflow FROM r")
def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = offsets(spark, sf_dir)
    n = o.groupBy("file_index").agg((F.sum("length") - 2).alias("n_frames"))
    rows = lines(spark, sf_dir).withColumn("timestamp", (F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1) / F.lit(VIDEO_FPS))
    out = sequence.frame_lookup(rows, o.join(n, "file_index"), VIDEO_FPS)
    return out.select("episode_index", "frame_index", "requested", "in_range", "overflow")


HOLES = "h AS (SELECT DISTINCT episode_index, frame_index FROM l WHERE NOT (episode_index % 50 = 3 AND frame_index = 2))"


@register(f"WITH {L}, {HOLES}, s AS (SELECT *, lead(frame_index) OVER (PARTITION BY episode_index ORDER BY frame_index) - frame_index AS step FROM h) SELECT episode_index, CAST(arg_min(step, frame_index) AS INTEGER) AS step, min(frame_index) AS after FROM s WHERE step <> 1 GROUP BY 1")
def index_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.index_breaks(lines(spark, sf_dir).where("NOT (episode_index % 50 = 3 AND frame_index = 2)").select("episode_index", "frame_index").distinct(), "frame_index")


@register(f"WITH {L}, d AS (SELECT episode_index, frame_index, min(t) AS t FROM l GROUP BY ALL), s AS (SELECT *, lag(t) OVER (PARTITION BY episode_index ORDER BY frame_index) AS before FROM d) SELECT episode_index, frame_index FROM s WHERE t < before")
def monotonic_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.backward_steps(lines(spark, sf_dir).groupBy("episode_index", "frame_index").agg(F.min("t").alias("t")), "frame_index", "t")


@register(f"WITH {L} SELECT gi // 3 AS gi, count(*) AS copies FROM l GROUP BY 1 HAVING count(*) > 1")
def duplicate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.duplicates(lines(spark, sf_dir).withColumn("gi", F.expr("gi div 3")), "gi")


@register(f"WITH {L} SELECT episode_index, arg_min(frame_index, (t, frame_index)) AS min_index, arg_max(frame_index, (t, -frame_index)) AS max_index FROM l GROUP BY 1")
def extreme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.extreme_rows(lines(spark, sf_dir), "frame_index", "t")


@register(f"WITH {OFFSETS}, x AS (SELECT file_index, CAST(sum(length) AS BIGINT) AS expected FROM off GROUP BY 1) SELECT file_index, expected, CAST(CASE WHEN file_index % 5 = 4 THEN 0 ELSE expected - file_index % 3 END AS BIGINT) AS decoded, CAST(CASE WHEN file_index % 5 = 4 THEN 0 ELSE expected - file_index % 3 END - expected AS BIGINT) AS mismatch FROM x")
def video_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = offsets(spark, sf_dir).groupBy("file_index").agg(F.sum("length").alias("expected"))
    probe = expected.where("file_index % 5 <> 4").select("file_index", F.expr("expected - file_index % 3").alias("decoded"))
    return quality.reconcile(expected, probe, ["file_index"])


@register(f"{SCORE}, {OFFSETS}, x AS (SELECT file_index, sum(length) AS expected FROM off GROUP BY 1), y AS (SELECT count(*) FILTER (file_index % 5 = 4 OR file_index % 3 <> 0) AS mismatched FROM x) SELECT round(score, 6) AS score, mismatched, CASE WHEN score < 0.5 OR mismatched > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM s1, y")
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.score(quality_rates(spark, sf_dir), video_reconciliation(spark, sf_dir), 0.5), "score")


@register("SELECT o_orderpriority AS worker, count(*) FILTER (o_orderstatus <> 'P') AS succeeded, count(*) FILTER (o_orderstatus = 'P') AS failed, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 100 ELSE 0 END) AS BIGINT) AS frames FROM orders GROUP BY 1")
def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "worker")
    return quality.job_rollup(o, "worker", F.col("o_orderstatus") != "P", F.col("o_custkey") % 100)


@register("SELECT page_id, regexp_replace(regexp_replace(array_to_string(CASE WHEN len(list_filter(p, lambda s: s NOT IN ('camera', 'image_raw', 'image', 'compressed', 'raw', 'color', 'rgb'))) > 0 THEN list_filter(p, lambda s: s NOT IN ('camera', 'image_raw', 'image', 'compressed', 'raw', 'color', 'rgb')) ELSE p END, '_'), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM (SELECT page_id, list_filter(string_split(lower(url), '/'), lambda s: s <> '') AS p FROM pages)")
def topic_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@register("SELECT vec_id, round(embedding[1], 6) AS a, round(embedding[64], 6) AS b, embedding[99] IS NULL AS missing FROM embeddings")
def selector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    pick = lambda s: text.select(v, s)[0]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(pick("v[0]"), 6).alias("a"), F.round(pick("v[-1]"), 6).alias("b"), pick("v[98]").isNull().alias("missing"))


@register("SELECT event_id, round(CAST(degrees(value) AS FLOAT)::DOUBLE, 2) AS deg, round(CAST(radians(value) AS FLOAT)::DOUBLE, 4) AS rad, round(CAST(value * 0.5 AS FLOAT)::DOUBLE, 3) AS half FROM events")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda u, d: F.round(text.convert(F.col("value"), u).cast("double"), d)
    return table(spark, sf_dir, "events").select("event_id", c("rad2deg", 2).alias("deg"), c("deg2rad", 4).alias("rad"), c(0.5, 3).alias("half"))


@register("SELECT vec_id, len(embedding) + 3 AS width, CASE WHEN vec_id % 2 = 0 THEN round(embedding[1], 6) ELSE 0.0 END AS first FROM embeddings")
def vector_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    whole = text.merged([(F.when(F.col("vec_id") % 2 == 0, F.slice(v, 1, 3)), 3), (v, 64)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(whole).cast("long").alias("width"), F.round(whole[0], 6).alias("first"))


Q4 = "q0 AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS y0, CAST(embedding[3] AS DOUBLE) AS z0, CAST(embedding[4] AS DOUBLE) AS w0, CAST(embedding[5] AS DOUBLE) AS tx, CAST(embedding[6] AS DOUBLE) AS ty, CAST(embedding[7] AS DOUBLE) AS tz FROM embeddings), q AS (SELECT *, sqrt(x0*x0+y0*y0+z0*z0+w0*w0) AS n, x0/n AS x, y0/n AS y, z0/n AS z, w0/n AS w FROM q0)"


def quaternion() -> list:
    return [F.col("embedding")[k].cast("double") for k in range(4)]


@register(f"WITH {Q4} SELECT vec_id, round(atan2(2*(w*x+y*z), 1-2*(x*x+y*y)), 6) AS roll, round(asin(least(1.0, greatest(-1.0, 2*(w*y-z*x)))), 6) AS pitch, round(atan2(2*(w*z+x*y), 1-2*(y*y+z*z)), 6) AS yaw FROM q")
def quat_to_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = geometry.euler(quaternion())
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(a, 6).alias(n) for a, n in zip(angles, ("roll", "pitch", "yaw"), strict=True)])


@register(f"WITH {Q4} SELECT vec_id, round(1 + (1-2*(y*y+z*z))*tx + 2*(x*y-w*z)*ty + 2*(x*z+w*y)*tz, 6) AS x, round(2 + 2*(x*y+w*z)*tx + (1-2*(x*x+z*z))*ty + 2*(y*z-w*x)*tz, 6) AS y, round(3 + 2*(x*z-w*y)*tx + 2*(y*z+w*x)*ty + (1-2*(x*x+y*y))*tz, 6) AS z FROM q")
def pose_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = geometry.normalised(quaternion())
    t, _ = geometry.compose([F.lit(1.0), F.lit(2.0), F.lit(3.0)], q, [F.col("embedding")[k].cast("double") for k in (4, 5, 6)], q)
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for c, n in zip(t, "xyz", strict=True)])


@register("SELECT o_orderpriority AS recording, CAST(greatest(1, coalesce(round_even(min(o_totalprice / 1000) FILTER (o_orderstatus = 'P'), 0), round_even(median(o_totalprice / 1000) FILTER (o_orderstatus <> 'P'), 0), 30)) AS BIGINT) AS target FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority < '3' GROUP BY 1")
def target_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.operators import metadata

    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P' OR o_orderpriority < '3'")
    rates = o.select(F.col("o_orderpriority").alias("recording"), (F.col("o_totalprice") / 1000).alias("fps"), (F.col("o_orderstatus") == "P").alias("is_image"))
    return metadata.target_rates(rates, "recording")


TF = "p AS (SELECT user_id AS episode_index, epoch_us(ts) * 1000 AS stamp_ns, event_id AS seq, value AS tx FROM events WHERE event_type = 'signup')"


@register(f"""WITH {M}, {WINDOW}, {GRID}, {TF}, b AS (SELECT g.*, p.stamp_ns AS tb, p.tx AS xb FROM grid g ASOF LEFT JOIN p ON g.episode_index = p.episode_index AND g.grid_ns > p.stamp_ns),
a AS (SELECT b.*, p.stamp_ns AS ta, p.tx AS xa FROM b ASOF LEFT JOIN p ON b.episode_index = p.episode_index AND b.grid_ns <= p.stamp_ns)
SELECT episode_index, frame_index, round(CASE WHEN ta IS NULL OR grid_ns - tb <= ta - grid_ns THEN xb ELSE xa END + 1, 4) AS x FROM a""")
def tf_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.operators import transforms

    e = messages(spark, sf_dir).where("topic = 'signup'")
    edge = e.select("episode_index", F.col("recv_ns").alias("stamp_ns"), "seq", F.col("value").alias("tx"), *[F.lit(0.0).alias(c) for c in ("ty", "tz", "qx", "qy", "qz")], F.lit(1.0).alias("qw"))
    out = transforms.sample(grid(spark, sf_dir), [("base", "arm"), ("arm", "hand")], {1: edge}, {0: (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)}, "base", "hand")
    return out.select("episode_index", "frame_index", F.round(F.col("value")[0].cast("double"), 4).alias("x"))


@register("SELECT event_type AS topic, count(*) AS count FROM events WHERE event_type <> '/tf' GROUP BY 1 HAVING count(*) >= 1900")
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.operators import metadata

    found = metadata.topics(messages(spark, sf_dir).withColumn("msg_type", F.lit("std_msgs/msg/Float64")))
    return metadata.useful_topics(found, 1900).select("topic", "count")


@register("SELECT conv_id, CASE WHEN count(DISTINCT role) = 1 THEN min(role) ELSE 'mixed' END AS shape FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 5 GROUP BY 1")
def consensus_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.operators import metadata

    out = metadata.consensus_shape(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return out.select("conv_id", F.coalesce("shape", F.lit("mixed")).alias("shape"))


@register("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND trim(substr(c_name, 1, c_custkey % 7)) <> '' THEN substr(c_name, 1, c_custkey % 7) WHEN c_nationkey % 2 = 0 THEN 'option' ELSE 'configured' END AS task FROM customer")
def task_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.sources import sidecars

    sidecar = F.expr("CASE WHEN c_custkey % 3 <> 0 THEN substr(c_name, 1, CAST(c_custkey % 7 AS INT)) END")
    option = F.when(F.col("c_nationkey") % 2 == 0, "option")
    return table(spark, sf_dir, "customer").select("c_custkey", sidecars.resolved_task(sidecar, option, F.lit("configured")).alias("task"))


@register("WITH o AS (SELECT 'frame' AS status, l_orderkey AS episode_index FROM lineitem WHERE l_quantity > 48), t AS (SELECT status, count(*) AS total FROM o GROUP BY 1) SELECT count(*) AS errors, 0 AS warnings, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM o")
def issue_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewright.operators import validate

    found = table(spark, sf_dir, "lineitem").where("l_quantity > 48").withColumnRenamed("l_orderkey", "episode_index")
    out = validate.verdict(validate.issues(found, "frame", F.col("l_quantity")))
    return out.select("errors", F.col("warnings").cast("int").alias("warnings"), "verdict")
