"""Queries of the data-preparation operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import eager, grid, late, shred
from driftwell.operators.spikes import faulty_residuals, spikes
from driftwell.sources import table


def p1_spikes(spark: SparkSession, d: str) -> DataFrame:
    inputs = spikes(table(spark, d, "kalman_input"), table(spark, d, "sensor_kinds"))
    outputs = faulty_residuals(table(spark, d, "kalman_output"))
    return inputs.select(F.lit("kalman_input").alias("src"), "*").unionByName(outputs.select(F.lit("kalman_output").alias("src"), "*"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_spikes(spark, d).select("src", "rec_id")


def p1_limits_and_runs(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts that don't need a model: physical limits, stuck runs and faulty residuals."""
    return p1_spikes(spark, d).where("limit_violation OR stuck").select("src", "rec_id", "limit_violation", "stuck")


def _runs_sql(rows: str, order: str, value: str) -> str:
    """``rows`` by key with ``held``: whether a reading (rows equal in ``order`` are one) is in a run of at least 10 equal values."""
    return f"""SELECT * EXCLUDE (o, g), count(DISTINCT o) OVER (PARTITION BY state_key, g) >= 10 AS held FROM (
      SELECT *, sum(n) OVER (PARTITION BY state_key ORDER BY o ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN lag({value}) OVER (PARTITION BY state_key ORDER BY o) IS DISTINCT FROM {value} THEN 1 ELSE 0 END AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY state_key ORDER BY {order}) AS o FROM {rows})))"""


P1_LIMITS_AND_RUNS = f"""
WITH k AS (SELECT record_id, state_key, event_time, measurement AS v, low_limit AS lo, high_limit AS hi FROM kalman_input LEFT JOIN sensor_kinds ON kind = split_part(state_key, '/', 2)
    WHERE state_key IS NOT NULL AND event_time IS NOT NULL AND len(measurement) > 0),
  kr AS ({_runs_sql("k", "event_time, v", "v")}),
  kb AS (SELECT *, list_bool_or([x IS NULL OR NOT isfinite(x) OR coalesce(x < lo, FALSE) OR coalesce(x > hi, FALSE) FOR x IN v]) AS bad FROM kr),
  o AS (SELECT output_id, state_key, state_index, step_index, residual.mean AS v, residual.covariance.vals AS c FROM kalman_output WHERE len(residual.mean) > 0),
  os AS (SELECT * FROM o WHERE state_key IS NOT NULL AND state_index IS NOT NULL), r AS ({_runs_sql("os", "state_index, step_index, v", "v")} UNION ALL SELECT *, NULL, FALSE FROM o WHERE state_key IS NULL OR state_index IS NULL),
  b AS (SELECT *, list_bool_or([coalesce(NOT isfinite(v[i]), TRUE) OR coalesce(isnan(c[(i - 1) * (len(v) + 1) + 1]) OR c[(i - 1) * (len(v) + 1) + 1] <= 0, TRUE) OR coalesce(abs(v[i]) >= 6 * sqrt(greatest(c[(i - 1) * (len(v) + 1) + 1], 0)), FALSE) FOR i IN range(1, len(v) + 1)]) AS bad FROM r)
SELECT 'kalman_input' AS src, record_id AS rec_id, bad AS limit_violation, held AS stuck FROM kb WHERE bad OR held
UNION ALL SELECT 'kalman_output', output_id, bad, held FROM b WHERE bad OR held
"""


def _objects(spark: SparkSession, d: str, *leaves: str) -> DataFrame:
    ko = shred.nested_objects(table(spark, d, "kalman_output"), "kalman_output", "output_id", state="state", residual="residual", leaves=leaves)
    go = shred.nested_objects(table(spark, d, "gaussian_mixture_output"), "gaussian_mixture_output", "output_id", mixture="mixture_model", leaves=leaves)
    ro = shred.nested_objects(table(spark, d, "raw_outputs"), "raw_outputs", "raw_id", payload="payload", leaves=leaves)
    return ko.unionByName(go).unionByName(ro)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _objects(spark, d, "mean").where(F.size("mean") > 0)
    return rows.select("src", "rec_id", "batch_no", "output_no", "child", "child_no")


def p2_objects(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables with all their columns."""
    rows = _objects(spark, d, *shred.LEAVES)
    return rows.select("src", "rec_id", "batch_no", "output_no", "child", "child_no", F.size(F.coalesce("mean", F.array())).alias("n_mean"), F.try_element_at("mean", F.lit(1)).alias("mean_0"), "num_rows", "num_cols", F.try_element_at("covariance", F.lit(-1)).alias("cov_last"), "weight")


def p2_components(spark: SparkSession, d: str) -> DataFrame:
    objects = shred.nested_objects(table(spark, d, "gaussian_mixture_output"), "gaussian_mixture_output", "output_id", mixture="mixture_model")
    rows = objects.where("child = 'component'")
    return rows.select("rec_id", "child_no", F.col("weight").alias("weight"), F.size(F.coalesce("mean", F.array())).alias("n_mean"), F.try_element_at("mean", F.lit(1)).alias("mean_0"), F.try_element_at("covariance", F.lit(1)).alias("cov_0"), "num_rows")


def _parsed(v: str) -> str:
    """The object that JSON text holds, else the value."""
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND left(ltrim({v}->>'$'), 1) IN ('{{', '[') AND json_valid({v}->>'$') THEN ({v}->>'$')::JSON ELSE {v} END"


def _listed(v: str) -> str:
    return f"CASE json_type({v}) WHEN 'ARRAY' THEN ({v})->'$[*]' WHEN 'OBJECT' THEN [{v}] ELSE []::JSON[] END"


def _mean(v: str) -> str:
    return f"json_type({v}) = 'OBJECT' AND json_type({_parsed(f"({v}->'mean')")}) = 'ARRAY' AND json_array_length({_parsed(f"({v}->'mean')")}) > 0"


def _flat(src: str, rec: str, child: str, where: str) -> str:
    return f"SELECT '{src}' AS src, {rec} AS rec_id, 0 AS batch_no, 0 AS output_no, '{child}' AS child, 0 AS child_no FROM {src} WHERE {where}"


P2_FOUND = f"""
WITH a AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j0 FROM raw_outputs), a1 AS (SELECT raw_id, {_parsed("j0")} AS j FROM a),
 a2 AS (SELECT raw_id, j, {_parsed("(j->'run')")} AS run FROM a1 WHERE json_type(j) = 'OBJECT'),
 a3 AS (SELECT raw_id, CASE WHEN NOT json_exists(j, '$.batches') AND json_type(run) = 'OBJECT' THEN run ELSE j END AS j FROM a2),
 a4 AS (SELECT raw_id, CASE WHEN json_exists(j, '$.batches') THEN {_parsed("(j->'batches')")} ELSE j END AS b FROM a3),
 b0 AS (SELECT raw_id, {_listed("b")} AS l FROM a4), b1 AS (SELECT raw_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS batch_no FROM b0), b2 AS (SELECT raw_id, batch_no, {_parsed("x")} AS b FROM b1),
 c0 AS (SELECT raw_id, batch_no, {_parsed("(b->'outputs')")} AS o FROM b2 WHERE json_type(b) = 'OBJECT'), c1 AS (SELECT raw_id, batch_no, {_listed("o")} AS l FROM c0),
 c2 AS (SELECT raw_id, batch_no, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS output_no FROM c1),
 c3 AS (SELECT raw_id, batch_no, output_no, {_parsed("x")} AS o FROM c2), o AS (SELECT * FROM c3 WHERE json_type(o) = 'OBJECT'),
 g AS (SELECT raw_id, batch_no, output_no, 'state' AS child, 0 AS child_no, {_parsed("(o->'state')")} AS g FROM o UNION ALL SELECT raw_id, batch_no, output_no, 'residual', 0, {_parsed("(o->'residual')")} FROM o),
 m0 AS (SELECT raw_id, batch_no, output_no, {_parsed("(o->'mixtureModel')")} AS m FROM o), m1 AS (SELECT raw_id, batch_no, output_no, {_parsed("(m->'distributions')")} AS p FROM m0 WHERE json_type(m) = 'OBJECT'),
 m2 AS (SELECT raw_id, batch_no, output_no, {_listed("p")} AS l FROM m1), m3 AS (SELECT raw_id, batch_no, output_no, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS child_no FROM m2),
 r AS (SELECT * FROM g UNION ALL SELECT raw_id, batch_no, output_no, 'component', child_no, {_parsed("x")} FROM m3)
SELECT 'raw_outputs' AS src, raw_id AS rec_id, CAST(batch_no AS INT) AS batch_no, CAST(output_no AS INT) AS output_no, child, CAST(child_no AS INT) AS child_no FROM r WHERE {_mean("g")}
UNION ALL {_flat("kalman_output", "output_id", "state", "len(state.mean) > 0")} UNION ALL {_flat("kalman_output", "output_id", "residual", "len(residual.mean) > 0")}
UNION ALL SELECT 'gaussian_mixture_output', output_id, 0, 0, 'component', CAST(i - 1 AS INT) FROM (SELECT *, unnest(range(1, len(mixture_model.distributions) + 1)) AS i FROM gaussian_mixture_output) WHERE len(mixture_model.distributions[i].mean) > 0
"""

P2_COMPONENTS = """
SELECT output_id AS rec_id, CAST(i - 1 AS INT) AS child_no, mixture_model.weights[i] AS weight,
  CAST(coalesce(len(mixture_model.distributions[i].mean), 0) AS INT) AS n_mean, mixture_model.distributions[i].mean[1] AS mean_0,
  mixture_model.distributions[i].covariance.vals[1] AS cov_0, mixture_model.distributions[i].covariance.num_rows AS num_rows
FROM (SELECT *, unnest(range(1, len(mixture_model.distributions) + 1)) AS i FROM gaussian_mixture_output)
WHERE mixture_model.distributions[i] IS NOT NULL
"""


def _sides(spark: SparkSession, d: str) -> tuple[eager.Side, eager.Side]:
    ki, rl = table(spark, d, "kalman_input"), table(spark, d, "rls_input")
    return eager.Side(ki, "state_key", {"reading": F.try_element_at("measurement", F.lit(1)), "gust": F.try_element_at("measurement", F.lit(2))}), eager.Side(rl, "state_key", {"label": F.col("label")})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.hot_keys(eager.join_aggregate(*_sides(spark, d), "full"), ("kalman_input", "rls_input")).select("src", "state_key")


P3_FOUND = """
SELECT src, state_key FROM (
  SELECT 'kalman_input' AS src, state_key, count(*) AS n, sum(count(*)) OVER () AS total FROM kalman_input GROUP BY state_key
  UNION ALL SELECT 'rls_input', state_key, count(*), sum(count(*)) OVER () FROM rls_input GROUP BY state_key)
WHERE state_key IS NOT NULL AND n >= 0.02 * total
"""


def _side_stats(name: str) -> list:
    n = F.col(f"{name}_n")
    return [n, F.round(F.col(f"{name}_sum") / n, 8).alias(f"mean_{name}"), F.round(F.sqrt(F.col(f"{name}_sq") / n), 6).alias(f"rms_{name}"), f"{name}_min", f"{name}_max"]


def p3_key_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of all keys of both tables, the null key included."""
    j = eager.join_aggregate(*_sides(spark, d), "full")
    return j.select(F.col("key").alias("state_key"), "left_n", "right_n", "pairs", *_side_stats("reading"), *_side_stats("gust"), *_side_stats("label"))


def p3_kind_results(spark: SparkSession, d: str) -> DataFrame:
    """The results of all keys, rolled up by kind."""
    r = eager.roll_up(eager.join_aggregate(*_sides(spark, d), "full"), F.try_element_at(F.split("key", "/"), F.lit(2)), ["reading", "label"])
    return r.select(F.col("grp").alias("kind"), "left_n", "right_n", "pairs", *_side_stats("reading"), *_side_stats("label"))


def _stats_sql(name: str, v: str, by: str, table_: str) -> str:
    x = f"CASE WHEN isfinite({v}) THEN {v} END"
    return f"SELECT {by}, count(*) AS rows_n, count({x}) AS {name}_n, round(avg({x}), 8) AS mean_{name}, round(sqrt(avg({x} * {x})), 6) AS rms_{name}, min({x}) AS {name}_min, max({x}) AS {name}_max FROM {table_} GROUP BY 1"


def _columns_sql(*names: str) -> str:
    return ", ".join(f"coalesce({n}_n, 0) AS {n}_n, mean_{n}, rms_{n}, {n}_min, {n}_max" for n in names)


P3_KEY_RESULTS = f"""
WITH l AS ({_stats_sql("reading", "measurement[1]", "state_key", "kalman_input")}), g AS ({_stats_sql("gust", "measurement[2]", "state_key", "kalman_input")}), r AS ({_stats_sql("label", "label", "state_key", "rls_input")})
SELECT coalesce(l.state_key, r.state_key) AS state_key, coalesce(l.rows_n, 0) AS left_n, coalesce(r.rows_n, 0) AS right_n, coalesce(l.rows_n, 0) * coalesce(r.rows_n, 0) AS pairs, {_columns_sql("reading", "gust", "label")}
FROM l JOIN g ON l.state_key IS NOT DISTINCT FROM g.state_key FULL JOIN r ON l.state_key IS NOT DISTINCT FROM r.state_key
"""
P3_KIND_RESULTS = f"""
WITH l AS ({_stats_sql("reading", "measurement[1]", "nullif(split_part(state_key, '/', 2), '') AS kind", "kalman_input")}), r AS ({_stats_sql("label", "label", "nullif(split_part(state_key, '/', 2), '') AS kind", "rls_input")}),
  p AS (SELECT nullif(split_part(k, '/', 2), '') AS kind, sum(n * m) AS pairs FROM (SELECT state_key AS k, count(*) AS n FROM kalman_input GROUP BY 1) a JOIN (SELECT state_key AS k2, count(*) AS m FROM rls_input GROUP BY 1) b
        ON k IS NOT DISTINCT FROM k2 GROUP BY 1),
  j AS (SELECT coalesce(l.kind, r.kind) AS kind, l.rows_n AS ln, r.rows_n AS rn, l.* EXCLUDE (kind, rows_n), r.* EXCLUDE (kind, rows_n) FROM l FULL JOIN r ON l.kind IS NOT DISTINCT FROM r.kind)
SELECT j.kind, coalesce(ln, 0) AS left_n, coalesce(rn, 0) AS right_n, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, {_columns_sql("reading", "label")}
FROM j LEFT JOIN p ON p.kind IS NOT DISTINCT FROM j.kind
"""


def p3_key_join(spark: SparkSession, d: str) -> DataFrame:
    j = eager.join_aggregate(*_sides(spark, d))
    return j.select(F.col("key").alias("state_key"), "left_n", "right_n", "pairs", "reading_pair_n", "label_pair_n", F.round(F.col("reading_pair_sum") / F.col("reading_pair_n"), 8).alias("mean_reading"), F.round(F.col("label_pair_sum") / F.col("label_pair_n"), 8).alias("mean_label"), "reading_min", "reading_max", "label_min", "label_max", F.round(F.col("reading_x_label_sum") / F.col("pairs"), 6).alias("mean_product"))


P3_KEY_JOIN = """
WITH k AS (SELECT state_key, CASE WHEN isfinite(measurement[1]) THEN measurement[1] END AS v FROM kalman_input),
     r AS (SELECT state_key, CASE WHEN isfinite(label) THEN label END AS y FROM rls_input),
     n AS (SELECT state_key, count(*) AS left_n FROM kalman_input GROUP BY 1),
     m AS (SELECT state_key, count(*) AS right_n FROM rls_input GROUP BY 1),
     j AS (SELECT state_key, count(*) AS pairs, count(v) AS reading_pair_n, count(y) AS label_pair_n,
             round(avg(v), 8) AS mean_reading, round(avg(y), 8) AS mean_label, min(v) AS reading_min, max(v) AS reading_max,
             min(y) AS label_min, max(y) AS label_max, round(sum(v * y) / count(*), 6) AS mean_product
           FROM k JOIN r USING (state_key) GROUP BY 1)
SELECT state_key, left_n, right_n, pairs, reading_pair_n, label_pair_n, mean_reading, mean_label, reading_min, reading_max,
  label_min, label_max, mean_product FROM j JOIN n USING (state_key) JOIN m USING (state_key)
"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "kalman_input"), table(spark, d, "sensor_kinds"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("status <> 'observed' AND within_day").select("state_key", "slot_epoch")


_SLOTS = """
WITH r AS (SELECT state_key, grid_seconds AS g, (epoch_us(event_time) // (grid_seconds * 1000000::BIGINT)) * grid_seconds AS s, measurement[1] AS v
           FROM kalman_input JOIN sensor_kinds ON kind = split_part(state_key, '/', 2) WHERE event_time IS NOT NULL AND measurement IS NOT NULL),
     f AS (SELECT state_key, g, s, s // 86400 AS d, count(*) AS n, avg(CASE WHEN NOT isnan(v) THEN v END) AS v FROM r GROUP BY 1, 2, 3),
     b AS (SELECT state_key, d, min(s) AS lo, max(s) AS hi FROM f GROUP BY 1, 2),
     c AS (SELECT state_key, g, min(s) AS lo, max(s) AS hi FROM f GROUP BY 1, 2),
     a AS (SELECT state_key, g, unnest(range(lo, hi + 1, g)) AS s FROM c)
"""
P4_FOUND = _SLOTS + "SELECT state_key, s AS slot_epoch FROM a ANTI JOIN f USING (state_key, s) JOIN b ON b.state_key = a.state_key AND b.d = a.s // 86400 WHERE a.s BETWEEN b.lo AND b.hi"


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("state_key", "slot_epoch", "n", "status", "within_day", F.round(F.try_element_at("value", F.lit(1)), 8).alias("value_0"))


P4_GRID = (
    _SLOTS
    + """, x AS (SELECT state_key, s, n, v, last_value(CASE WHEN n IS NOT NULL THEN s END IGNORE NULLS) OVER w AS ps FROM a LEFT JOIN f USING (state_key, s) WINDOW w AS (PARTITION BY state_key ORDER BY s))
SELECT x.state_key, x.s AS slot_epoch, coalesce(x.n, 0) AS n, CASE WHEN x.n IS NOT NULL THEN 'observed' WHEN x.s - ps <= 3600 THEN 'carried' ELSE 'missing' END AS status,
  coalesce(x.s BETWEEN b.lo AND b.hi, FALSE) AS within_day, CASE WHEN x.s - ps <= 3600 THEN round(f.v, 8) END AS value_0
FROM x LEFT JOIN f ON f.state_key = x.state_key AND f.s = x.ps LEFT JOIN b ON b.state_key = x.state_key AND b.d = x.s // 86400
"""
)


_STREAMS = (("kalman_input", "measurement"), ("gaussian_mixture_input", "sample"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [late.left_out(table(spark, d, n)).select(F.lit(n).alias("src"), F.col("record_id").alias("rec_id")) for n, _ in _STREAMS]
    return parts[0].unionByName(parts[1])


def _late_entries(spark: SparkSession, d: str) -> DataFrame:
    """All entries of both tables' rows with their place behind the frontier, keyed by table, state key and entry."""
    parts = [late.with_frontier(table(spark, d, n).select("record_id", "state_key", "event_time", "arrival_time", F.col(c).alias("entries"))).select(F.lit(n).alias("src"), "state_key", "_event", "_at", "is_late", "out_of_order", F.posexplode("entries").alias("entry", "x")) for n, c in _STREAMS]
    return parts[0].unionByName(parts[1])


def _frontier_sql(name: str) -> str:
    return f"SELECT *, max(event_time) OVER (PARTITION BY state_key ORDER BY arrival_time NULLS FIRST, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {name} WHERE state_key IS NOT NULL AND event_time IS NOT NULL"


P5_FOUND = " UNION ALL ".join(f"SELECT '{n}' AS src, record_id AS rec_id FROM ({_frontier_sql(n)}) WHERE event_time < top - INTERVAL 2 HOURS" for n in ("kalman_input", "gaussian_mixture_input"))


def p5_period_stats(spark: SparkSession, d: str) -> DataFrame:
    state = late.multiset(_late_entries(spark, d), F.col("x"), key=F.struct("src", "state_key", "entry"))
    s = late.period_stats(state)
    return s.select("key.src", "key.state_key", "key.entry", F.col("period").alias("period_epoch"), "n", "n_distinct", "min_value", "max_value", F.round("median_value", 6).alias("median_value"), F.round(F.col("sum_value") / F.col("n"), 8).alias("mean_value"), "n_corrections")


def _entries_sql() -> str:
    parts = (f"SELECT '{n}' AS src, state_key, event_time, arrival_time, top, unnest({c}) AS v, CAST(generate_subscripts({c}, 1) - 1 AS INT) AS entry FROM ({_frontier_sql(n)}) WHERE top IS NULL OR event_time >= top - INTERVAL 2 HOURS" for n, c in _STREAMS)
    return f"SELECT *, (epoch_us(event_time) // 3600000000) * 3600 AS p FROM ({' UNION ALL '.join(parts)}) WHERE v IS NOT NULL AND NOT isnan(v)"


P5_PERIOD_STATS = f"""
SELECT src, state_key, entry, p AS period_epoch, count(*) AS n, count(DISTINCT v) AS n_distinct, min(v) AS min_value, max(v) AS max_value,
  round(median(v), 6) AS median_value, round(avg(v), 8) AS mean_value, count(*) FILTER (event_time < top) AS n_corrections
FROM ({_entries_sql()}) GROUP BY 1, 2, 3, 4
"""


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    v = late.period_versions(_late_entries(spark, d), F.col("x"), key=F.struct("src", "state_key", "entry"))
    return v.select("key.src", "key.state_key", "key.entry", F.col("period").alias("period_epoch"), "as_of_batch", "n", "n_distinct", "min_value", "max_value", F.round("median_value", 6).alias("median_value"), "n_corrections")


P5_VERSIONS = f"""
WITH x AS (SELECT *, epoch_us(arrival_time) // 86400000000 AS b FROM ({_entries_sql()})),
     b AS (SELECT DISTINCT src, state_key, entry, p, b AS as_of FROM x)
SELECT src, state_key, entry, p AS period_epoch, as_of AS as_of_batch, count(*) AS n, count(DISTINCT v) AS n_distinct, min(v) AS min_value, max(v) AS max_value,
  round(median(v), 6) AS median_value, count(*) FILTER (event_time < top) AS n_corrections
FROM x JOIN b USING (src, state_key, entry, p) WHERE x.b <= as_of GROUP BY 1, 2, 3, 4, 5
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_spikes, p1_limits_and_runs, p2_found, p2_objects, p2_components, p3_found, p3_key_results, p3_kind_results, p3_key_join, p4_found, p4_grid, p5_found, p5_period_stats, p5_versions)}
SQL = {"p1_limits_and_runs": P1_LIMITS_AND_RUNS, "p2_found": P2_FOUND, "p2_components": P2_COMPONENTS, "p3_found": P3_FOUND, "p3_key_results": P3_KEY_RESULTS, "p3_kind_results": P3_KIND_RESULTS, "p3_key_join": P3_KEY_JOIN, "p4_found": P4_FOUND, "p4_grid": P4_GRID, "p5_found": P5_FOUND, "p5_period_stats": P5_PERIOD_STATS, "p5_versions": P5_VERSIONS}
