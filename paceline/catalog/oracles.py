"""The registered queries again, as SQL for a second engine (DuckDB)."""

from __future__ import annotations

from paceline.functions.numeric import AS241_CENTRAL, AS241_MIDDLE, AS241_TAIL

RAW = r"""
raw AS (
  SELECT
    CAST(year(o_orderdate) AS INTEGER) AS event_year,
    strftime(o_orderdate, '%d.%m.%Y') AS event_dates,
    CASE WHEN o_orderkey % 9 = 0 THEN 'Western States 100 (USA)'
         WHEN o_orderkey % 31 = 1 THEN 'Stockholm Fotrally (SWE)'
         WHEN o_orderkey % 31 = 2 THEN 'maratonmarschen stockholm (swe)'
         WHEN o_orderkey % 23 = 3 THEN 'Ultraroztocze 120km (POL)'
         WHEN o_orderkey % 29 = 4 THEN '9ª Ultra São Paulo - ' || year(o_orderdate)
         ELSE (o_orderkey % 40) || 'th Trail Run (' || year(o_orderdate) || ') (GER)' END AS event_name,
    CASE WHEN o_orderkey % 12 = 0 THEN '6h'
         WHEN o_orderkey % 12 = 1 THEN '100km/2Etappen'
         WHEN o_orderkey % 12 = 2 THEN '300km'
         WHEN o_orderkey % 12 = 3 THEN '50mi'
         WHEN o_orderkey % 12 = 4 THEN '50K'
         WHEN o_orderkey % 61 = 7 THEN NULL
         ELSE (30 + o_orderkey % 120) || 'km' END AS distance_text,
    CAST(50 + o_orderkey % 500 AS INTEGER) AS finishers,
    CASE WHEN o_orderkey % 17 = 5 THEN '123.4 km'
         ELSE (CASE WHEN o_orderkey % 13 = 0 THEN '1d ' ELSE '' END)
              || lpad(CAST(3 + o_orderkey % 20 AS VARCHAR), 2, '0') || ':'
              || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':'
              || lpad(CAST((o_orderkey * 7) % 60 AS VARCHAR), 2, '0') || ' h' END AS performance,
    CASE WHEN c_custkey % 37 <> 0 THEN CAST(1940 + c_custkey % 45 AS DOUBLE) END AS birth_year,
    CASE WHEN (CASE WHEN c_custkey % 29 = 0 THEN o_orderkey % 2 ELSE c_custkey % 2 END) = 0
         THEN 'M' ELSE 'F' END AS gender,
    c_custkey AS athlete_id,
    o_orderkey AS row_id
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def _clean_name(source: str) -> str:
    steps = [r"\(?\b(19|20)\d{2}\b\)?", r"\([a-z]{3}\)", r"\d+(ª|th|st|nd|rd)"]
    out = f"lower({source})"
    for p in steps:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def _clean_name_noise(source: str) -> str:
    # A unit ends where no letter or digit of any script follows.
    units = r"\d+\s*(km|k|miles|mile|mi|h|hr|hour|hours|stunden|óra|órás)($|[^\p{L}\p{M}\p{N}_])"
    out = f"lower({source})"
    for p in [r"\(?\b(19|20)\d{2}\b\)?", r"\d+ª", r"\([a-z]{3}\)"]:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    out = f"regexp_replace({out}, '{units}', '\\2', 'g')"
    for p in [r"etappe[:\s]\d+", "kidsrun", "winter challenge", "trail race", "road race"]:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z]+', ' ', 'g'))"


DURATION = r"(?:(\d+)d\s+)?(\d+):(\d+):(\d+)"


def _part(source: str, i: int) -> str:
    return f"nullif(regexp_extract({source}, '{DURATION}', {i}), '')"


def _seconds(source: str) -> str:
    p = [f"CAST({_part(source, i)} AS BIGINT)" for i in range(1, 5)]
    return f"coalesce({p[0]}, 0) * 86400 + {p[1]} * 3600 + {p[2]} * 60 + {p[3]}"


BARE = "regexp_replace(performance, ' h| km', '', 'g')"
STRICT = (
    rf"CASE WHEN regexp_matches({BARE}, '^\d{{1,2}}:\d{{2}}:\d{{2}}$') "
    rf"OR regexp_matches({BARE}, '^\d+d \d{{2}}:\d{{2}}:\d{{2}}$') THEN {_seconds('performance')} END"
)
STRIPPED = "regexp_replace(lower(distance_text), 'km|k', '', 'g')"
NUMBER = rf"CAST(nullif(regexp_extract({STRIPPED}, '(\d+(\.\d+)?)', 1), '') AS DOUBLE)"
KM = f"CASE WHEN {STRIPPED} LIKE '%m%' THEN {NUMBER} * 1.60934 ELSE {NUMBER} END"
KM_LEGACY = f"CASE WHEN distance_text LIKE '%m%' THEN {NUMBER} * 1.60934 ELSE {NUMBER} END"
KM_CORRECTED = f"CASE WHEN event_name = 'Ultraroztocze 120km (POL)' THEN 120.0 ELSE {KM} END"
KEEP_DISTANCE = (
    "NOT regexp_matches(lower(distance_text), 'h|hr|hour|hours|d|day|days|min') "
    "AND NOT regexp_matches(lower(distance_text), '/|:|x')"
)
KEEP_EVENT = (
    r"NOT regexp_matches(event_name, '(?i)stockholm fotrally \(swe\)|maratonmarschen stockholm \(swe\)')"
)


def _cleaned(name: str = "cleaned", km: str = KM, seconds: str = _seconds("performance")) -> str:
    return f"""
parsed_{name} AS (
  SELECT *, {km} AS distance_km, {seconds} AS performance_seconds,
         {_clean_name('event_name')} AS event_name_clean, {BARE} AS performance_clean
  FROM raw WHERE birth_year IS NOT NULL AND performance IS NOT NULL
    AND {KEEP_DISTANCE} AND {KEEP_EVENT}
),
whole_{name} AS (
  SELECT *, performance_seconds / 60.0 / distance_km AS pace FROM parsed_{name}
  WHERE performance_seconds IS NOT NULL AND distance_km > 0 AND distance_km <= 250
),
{name} AS (
  SELECT * FROM whole_{name} WHERE athlete_id IN (
    SELECT athlete_id FROM whole_{name} GROUP BY athlete_id HAVING count(DISTINCT gender) = 1)
)"""


ORDER = "event_year, event_name, event_dates, distance_text, performance, finishers, row_id"
HISTORY = f"""
hist AS (
  SELECT *, row_number() OVER w - 1 AS cum_num_races,
    coalesce(avg(pace) OVER p, -1) AS cum_avg_pace,
    coalesce(min(pace) OVER p, -1) AS cum_best_pace,
    coalesce(sum(distance_km) OVER p, -1) AS cum_total_distance,
    coalesce(min(distance_km) OVER p, -1) AS cum_shortest_distance,
    coalesce(max(distance_km) OVER p, -1) AS cum_longest_distance,
    CAST(coalesce(sum(CASE WHEN event_name LIKE '%Western States%' THEN 1 ELSE 0 END) OVER p, -1) AS BIGINT)
      AS cum_ws_finishes,
    coalesce(avg(distance_km) OVER r, -1) AS recent_avg_distance,
    CAST(trunc(event_year - birth_year) AS BIGINT) AS athlete_age
  FROM cleaned
  WINDOW w AS (PARTITION BY athlete_id ORDER BY {ORDER}),
         p AS (PARTITION BY athlete_id ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (PARTITION BY athlete_id ORDER BY {ORDER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
),
features AS (
  SELECT *, CASE WHEN cum_num_races > 0 THEN cum_total_distance / cum_num_races ELSE 0.0 END AS cum_avg_distance,
         distance_km - cum_longest_distance AS distance_gap_from_longest
  FROM hist
)"""
SPLIT = """
test AS (SELECT * FROM features WHERE event_year = 2000 AND event_name LIKE '%Western States%'),
cut AS (SELECT athlete_id, max(cum_num_races) AS cutoff FROM test GROUP BY athlete_id),
train AS (
  SELECT f.* FROM features f LEFT JOIN cut USING (athlete_id)
  WHERE cutoff IS NULL OR cum_num_races < cutoff
)"""
PREDICTIONS = """
predictions AS (
  SELECT row_id, pace AS y_true, cum_avg_pace AS y_pred, cum_best_pace AS y_best, distance_km AS distance,
         gender, cum_num_races AS num_races, event_year
  FROM features WHERE cum_num_races > 0
)"""
FOLDED = """
indexed AS (SELECT *, row_number() OVER (ORDER BY event_year, row_id) - 1 AS row_index FROM cleaned),
sized AS (SELECT count(*) AS n, count(*) // 6 AS size FROM cleaned),
folded AS (
  SELECT indexed.*, CAST(CASE WHEN row_index < n - 5 * size THEN -1
    ELSE (row_index - (n - 5 * size)) // size END AS INTEGER) AS fold
  FROM indexed, sized
)"""

TO_CLEANED = [RAW, _cleaned()]
TO_FEATURES = [*TO_CLEANED, HISTORY]
TO_SPLIT = [*TO_FEATURES, SPLIT]
# Every seventh athlete as one entity, -1 here and null in the result.
TO_NULLABLE = [
    RAW,
    _cleaned("known"),
    "cleaned AS (SELECT * REPLACE (CASE WHEN athlete_id % 7 = 0 THEN -1 ELSE athlete_id END AS athlete_id) FROM known)",
    HISTORY,
]
TO_PREDICTIONS = [*TO_FEATURES, PREDICTIONS]
TO_FOLDS = [*TO_CLEANED, FOLDED]


def _sql(parts: list[str], select: str) -> str:
    return f"WITH {','.join(parts)}\n{select}"


# One tree over six values of one input predicts the mean label of each.
TREE_ROWS = [
    *TO_FEATURES,
    "points AS (SELECT row_id, event_year, least(cum_num_races, 5) AS x, pace AS label FROM features)",
    "train AS (SELECT * FROM points WHERE event_year < 2000)",
    "test AS (SELECT * FROM points WHERE event_year >= 2000)",
]
TREE_TEST = [
    *TREE_ROWS,
    "fit AS (SELECT x, avg(label) AS prediction FROM train GROUP BY x)",
    "predicted AS (SELECT row_id, label, prediction FROM test JOIN fit USING (x))",
]
TREE_FOLDS = [
    *TREE_ROWS,
    "i AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS k, count(*) OVER () AS n FROM train)",
    """f AS (SELECT *, CASE WHEN k < (n % 5) * (n // 5 + 1) THEN k // (n // 5 + 1)
  ELSE n % 5 + (k - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM i)""",
    "fit AS (SELECT o.fold, f.x, avg(f.label) AS prediction FROM range(5) o(fold), f WHERE f.fold <> o.fold GROUP BY ALL)",
    "root AS (SELECT o.fold, avg(f.label) AS mean FROM range(5) o(fold), f WHERE f.fold <> o.fold GROUP BY ALL)",
    """scored AS (SELECT f.fold, avg(abs(label - prediction)) AS mae, avg(abs(label - mean)) AS mean_mae
  FROM f JOIN fit ON f.fold = fit.fold AND f.x = fit.x JOIN root ON f.fold = root.fold GROUP BY f.fold)""",
]


# A leaf alone predicts the mean label of what it has seen: here of all earlier folds.
LEAF_FOLDS = [
    *TO_SPLIT,
    "i AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS k, count(*) OVER () AS n FROM train)",
    """f AS (SELECT *, CAST(CASE WHEN k < n - 5 * (n // 6) THEN -1 ELSE (k - (n - 5 * (n // 6))) // (n // 6) END AS INTEGER)
  AS fold FROM i)""",
    "fit AS (SELECT o.fold, count(*) AS n_train, avg(pace) AS mean FROM range(5) o(fold), f WHERE f.fold < o.fold GROUP BY o.fold)",
]
LEAF_SCORES = """SELECT f.fold, any_value(n_train) AS n_train, count(*) AS n_validation,
  round(avg(abs(pace - mean)), 6) AS mae, round(sqrt(avg((pace - mean) * (pace - mean))), 6) AS rmse
FROM f JOIN fit ON f.fold = fit.fold GROUP BY f.fold"""
LEAF_TEST = [
    *TO_SPLIT,
    "leaf AS (SELECT avg(pace) AS prediction FROM train)",
    "predicted AS (SELECT row_id, pace AS label, prediction FROM test, leaf)",
]


def _in_order(parts: list[str], order: str) -> list[str]:
    return [p.replace("{order}", order) for p in parts]


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _metrics(y: str = "y_true", p: str = "y_pred", counts: bool = True) -> str:
    e = f"({y} - {p})"
    out = [
        f'round(avg(abs{e}), 6) AS "MAE"',
        f'round(avg({e} * {e}), 6) AS "MSE"',
        f'round(sqrt(avg({e} * {e})), 6) AS "RMSE"',
        f'round(CASE WHEN count(*) < 2 THEN NULL WHEN var_pop({y}) > 0 THEN 1 - avg({e} * {e}) / var_pop({y})'
        f' WHEN avg({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END, 6) AS "R²"',
        f'round(avg(abs({e} / nullif({y}, 0))) * 100, 6) AS "MAPE"',
        f'round(avg(abs{e}) / avg({y}) * 100, 6) AS "MAE_percentage"',
    ]
    for name, t in (("Accuracy_30s", 0.5), ("Accuracy_1min", 1.0), ("Accuracy_2min", 2.0)):
        out.append(f'round(avg(CASE WHEN abs{e} <= {t} THEN 1 ELSE 0 END) * 100, 6) AS "{name}"')
    if counts:
        out += ['count(*) AS "count"', f"count(*) FILTER ({y} = 0) AS zero_targets"]
    return ", ".join(out)


METRIC_NAMES = [
    "MAE", "MSE", "RMSE", "R²", "MAPE", "MAE_percentage", "Accuracy_30s", "Accuracy_1min", "Accuracy_2min",
]


def _case(value: str, edges: list[float], labels: list[str]) -> str:
    whens = []
    for i, label in enumerate(labels):
        top = f" AND {value} < {edges[i + 1]}" if i + 1 < len(edges) else ""
        whens.append(f"WHEN {value} >= {edges[i]}{top} THEN '{label}'")
    return f"CASE {' '.join(whens)} END"


ISSUES = """
yearly AS (SELECT athlete_id, event_year, count(*) AS n, sum(pace) AS s FROM checked GROUP BY ALL),
past AS (
  SELECT athlete_id, event_year, sum(n) OVER w AS races, sum(s) OVER w / sum(n) OVER w AS mean FROM yearly
  WINDOW w AS (PARTITION BY athlete_id ORDER BY event_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
issues AS (
  SELECT 'cum_num_races_mismatch' AS type, athlete_id AS entity_id, event_year AS "year",
         CAST(races AS DOUBLE) AS expected, CAST(cum_num_races AS DOUBLE) AS actual
  FROM checked JOIN past USING (athlete_id, event_year) WHERE races > 0 AND races <> cum_num_races
  UNION ALL
  SELECT 'cum_avg_pace_mismatch', athlete_id, event_year, mean, cum_avg_pace
  FROM checked JOIN past USING (athlete_id, event_year)
  WHERE races > 0 AND abs(cum_avg_pace - mean) > 1e-9 * greatest(1.0, abs(mean))
)"""
CHECKED = "checked AS (SELECT * FROM features)"
TAMPERED = """
checked AS (
  SELECT * REPLACE (
    cum_num_races + (CASE WHEN row_id % 50 = 0 THEN 1 ELSE 0 END) AS cum_num_races,
    cum_avg_pace + (CASE WHEN row_id % 70 = 0 THEN 0.5 ELSE 0.0 END) AS cum_avg_pace)
  FROM features
)"""
SHOW_ISSUES = (
    'SELECT type, entity_id, "year", round(expected, 6) AS expected, round(actual, 6) AS actual, '
    "CAST(NULL AS VARCHAR) AS message FROM issues"
)
SPLIT_ISSUES = """
split_issues AS (
  SELECT 'future_data_in_training' AS type, athlete_id AS entity_id, max(event_year) AS "year",
         CAST(NULL AS DOUBLE) AS expected, CAST(NULL AS DOUBLE) AS actual, CAST(NULL AS VARCHAR) AS message
  FROM train WHERE event_year >= 2000 AND athlete_id IN (SELECT athlete_id FROM test) GROUP BY athlete_id
  UNION ALL
  SELECT 'missing_target_event', NULL, NULL, NULL, NULL, 'Western States not found in test set'
  WHERE NOT EXISTS (SELECT 1 FROM test WHERE event_name LIKE '%Western States%')
  UNION ALL
  SELECT 'missing_test_year', NULL, NULL, NULL, NULL, '2000 not found in test years'
  WHERE NOT EXISTS (SELECT 1 FROM test WHERE event_year = 2000)
  UNION ALL
  SELECT 'multiple_test_years', NULL, NULL, NULL, (SELECT count(DISTINCT event_year) FROM test),
         'more than one test year' WHERE (SELECT count(DISTINCT event_year) FROM test) > 1
)"""

CELLS = """
cells AS (
  SELECT o_orderkey AS row_id,
    CASE WHEN o_orderkey % 7 = 0 THEN 'NULL' WHEN o_orderkey % 7 = 1 THEN '' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 11 = 0 THEN 'NA' WHEN o_orderkey % 11 = 1 THEN 'n/k'
         ELSE CAST(o_custkey AS VARCHAR) END AS customer,
    CASE WHEN o_orderkey % 5 = 0 THEN 'null' WHEN o_orderkey % 5 = 1 THEN '1x'
         ELSE (o_orderkey % 97) || '.5' END AS amount
  FROM orders
)"""
TOKENS = "('', 'NULL', 'null', 'NA')"


def _token(c: str) -> str:
    return f"CASE WHEN {c} IN {TOKENS} THEN NULL ELSE {c} END"


ENCODING = """
fit AS (SELECT * FROM cleaned WHERE event_year < 2000),
overall AS (SELECT avg(pace) AS g FROM fit),
weights AS (
  SELECT event_name_clean, (sum(pace) + 10 * any_value(g)) / (count(*) + 10) AS weight
  FROM fit, overall WHERE event_name_clean IS NOT NULL GROUP BY event_name_clean
)"""


def _encode(source: str, where: str) -> str:
    return _sql(
        [*TO_CLEANED, ENCODING],
        f"""SELECT row_id, c.event_name_clean, round(coalesce(weight, g), 6) AS encoded
FROM {source} c LEFT JOIN weights w ON c.event_name_clean = w.event_name_clean, overall WHERE {where}""",
    )


def _histogram(table: str, column: str, bins: int, last: str) -> str:
    return f"""WITH edges AS (SELECT min({column}) AS lo, max({column}) AS hi, (max({column}) - min({column})) / {bins}.0
  AS w, count({column}) AS n FROM {table}),
counts AS (SELECT least(CAST(floor(({column} - lo) / w) AS BIGINT), {bins - 1}) AS bin, count(*) AS c
  FROM {table}, edges WHERE {column} IS NOT NULL GROUP BY ALL)
SELECT g.bin, round(lo + g.bin * w, 6) AS bin_start, round(lo + (g.bin + 1) * w, 6) AS bin_end, {last}
FROM (SELECT range AS bin FROM range({bins})) g LEFT JOIN counts USING (bin), edges"""


def _box(table: str, value: str, by: str | None) -> str:
    key, group = (f"{by} AS k", f"SELECT k AS {by},") if by else ("1 AS k", "SELECT")
    extra = ", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std" if by else ""
    return f"""WITH vals AS (SELECT {key}, {value} AS v FROM {table} WHERE {value} IS NOT NULL),
q AS (SELECT k, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
  FROM vals GROUP BY k)
{group} count(*) AS rows, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3,
  round(min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers,
  round(min(v), 6) AS min, round(max(v), 6) AS max{extra}
FROM vals JOIN q USING (k) GROUP BY k"""


def _poly(coefficients: list[float], at: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {at} + {c!r})"
    return out


def _ratio(tables, at: str) -> str:
    return f"({_poly(tables[0], at)} / {_poly(tables[1], at)})"


QQ = f"""
res AS (SELECT row_id, y_true - y_pred AS ordered FROM predictions),
placed AS (SELECT *, row_number() OVER (ORDER BY ordered, row_id) - 1 AS rank, count(*) OVER () AS n FROM res),
medians AS (
  SELECT *, CASE WHEN rank = n - 1 THEN pow(0.5, 1.0 / n) WHEN rank = 0 THEN 1 - pow(0.5, 1.0 / n)
    ELSE (rank + 1 - 0.3175) / (n + 0.365) END AS p FROM placed
),
depths AS (
  SELECT *, CAST(0.180625 - (p - 0.5) * (p - 0.5) AS DOUBLE) AS c, sqrt(-ln(least(p, 1 - p))) AS s,
         sqrt(-ln(least(p, 1 - p))) - 1.6 AS s1, sqrt(-ln(least(p, 1 - p))) - 5.0 AS s2 FROM medians
),
tails AS (
  SELECT *, CASE WHEN s <= 5.0 THEN {_ratio(AS241_MIDDLE, 's1')} ELSE {_ratio(AS241_TAIL, 's2')} END AS far
  FROM depths
),
points AS (
  SELECT row_id, rank, ordered, CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_ratio(AS241_CENTRAL, 'c')}
    WHEN p < 0.5 THEN -far ELSE far END AS theoretical FROM tails
)"""

LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1 :]]
RACE_NUMBERS = [
    "cum_num_races", "cum_avg_pace", "cum_best_pace", "recent_avg_distance", "athlete_age", "distance_km",
]
NULL_COLUMNS = {
    "Year of event": "event_year", "Event dates": "event_dates", "Event name": "event_name",
    "Event distance/length": "distance_text", "Event number of finishers": "finishers",
    "Athlete performance": "performance", "Athlete club": "NULL", "Athlete country": "NULL",
    "Athlete year of birth": "birth_year", "Athlete gender": "gender", "Athlete age category": "gender",
    "Athlete average speed": "NULL", "Athlete ID": "athlete_id", "row_id": "row_id",
}
LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
ORDER_BYTES = {
    "o_orderkey": "8 * count(o_orderkey)", "o_custkey": "8 * count(o_custkey)",
    "o_totalprice": "8 * count(o_totalprice)", "o_orderdate": "8 * count(o_orderdate)",
    "o_orderstatus": "sum(strlen(o_orderstatus))", "o_orderpriority": "sum(strlen(o_orderpriority))",
}
HISTORY_COLS = [
    "cum_num_races", "cum_avg_pace", "cum_best_pace", "cum_total_distance", "cum_shortest_distance",
    "cum_longest_distance", "cum_avg_distance", "cum_ws_finishes", "recent_avg_distance",
    "distance_gap_from_longest", "athlete_age",
]
WHOLE_NUMBERS = {"cum_num_races", "cum_ws_finishes", "athlete_age"}


def _shown(c: str) -> str:
    return c if c in WHOLE_NUMBERS else f"round({c}, 6) AS {c}"


def _union(rows: list[str]) -> str:
    return "\nUNION ALL\n".join(rows)


MATRIX = """
g AS (SELECT avg(pace) AS g FROM train),
weights AS (
  SELECT event_name_clean, (sum(pace) + 10 * any_value(g)) / (count(*) + 10) AS weight FROM train, g
  GROUP BY event_name_clean
),
labels_seen AS (
  SELECT gender, dense_rank() OVER (ORDER BY gender) - 1 AS code
  FROM (SELECT gender FROM train UNION SELECT gender FROM test)
),
parts AS (SELECT *, 'train' AS part FROM train UNION ALL SELECT *, 'test' AS part FROM test)"""

ORACLES: dict[str, str] = {
    "clean_event_name": _sql([RAW], f"SELECT row_id, {_clean_name('event_name')} AS event_name_clean FROM raw"),
    "clean_event_name_documents": f"SELECT doc_id, {_clean_name('text')} AS name FROM documents",
    "clean_event_name_noise": _sql(
        [RAW], f"SELECT row_id, {_clean_name_noise('event_name')} AS event_name_clean FROM raw"
    ),
    "clean_event_name_noise_documents": f"SELECT doc_id, {_clean_name_noise('text')} AS name FROM documents",
    "duration_groups": _sql(
        [RAW],
        f"""SELECT row_id, {_part('performance', 1)} AS days, {_part('performance', 2)} AS hours,
  {_part('performance', 3)} AS minutes, {_part('performance', 4)} AS seconds FROM raw""",
    ),
    "duration_seconds": _sql([RAW], f"SELECT row_id, {_seconds('performance')} AS seconds FROM raw"),
    "duration_seconds_strict": _sql([RAW], f"SELECT row_id, {STRICT} AS seconds FROM raw"),
    "distance_km": _sql(
        [RAW],
        f"""SELECT row_id, round({NUMBER}, 6) AS distance_numeric, lower(distance_text) AS distance_str,
  round({KM}, 6) AS distance_km FROM raw""",
    ),
    "distance_km_legacy": _sql([RAW], f"SELECT row_id, round({KM_LEGACY}, 6) AS distance_km FROM raw"),
    "distance_corrections": _sql(
        [RAW],
        f"""SELECT row_id, round({KM_CORRECTED}, 6) AS distance_km,
  CASE WHEN event_name = 'Ultraroztocze 120km (POL)' THEN '120km' ELSE distance_text END AS distance_text
FROM raw""",
    ),
    "null_tokens": _sql(
        [CELLS],
        f"""SELECT row_id, {_token('status')} AS status, {_token('customer')} AS customer,
  {_token('amount')} AS amount FROM cells""",
    ),
    "typed_parse": _sql(
        [CELLS],
        f"""SELECT row_id, {_token('status')} AS status, TRY_CAST({_token('customer')} AS BIGINT) AS customer,
  TRY_CAST({_token('amount')} AS DOUBLE) AS amount FROM cells""",
    ),
    "malformed_cells": _sql(
        [CELLS],
        _union(
            [
                f"""SELECT '{c}' AS "column", count(*) FILTER ({_token(c)} IS NOT NULL
  AND TRY_CAST({_token(c)} AS {t}) IS NULL) AS malformed FROM cells"""
                for c, t in (("customer", "BIGINT"), ("amount", "DOUBLE"))
            ]
            + ["SELECT 'row_id', CAST(0 AS BIGINT)"]
        ),
    ),
    "csv_round_trip": _sql(
        [RAW],
        "SELECT athlete_id, event_year, event_name, distance_text, performance, gender, finishers, birth_year FROM raw",
    ),
    "stage_round_trip": _sql(
        TO_CLEANED,
        """SELECT row_id, event_year, event_name_clean, round(pace, 6) AS pace_min_per_km
FROM cleaned""",
    ),
    "predictions_csv_round_trip": _sql(
        TO_PREDICTIONS,
        """SELECT round(y_true, 6) AS actual_pace, round(y_pred, 6) AS predicted_pace, round(y_true - y_pred, 6) AS error
FROM predictions""",
    ),
    "importance_csv_round_trip": "SELECT 'x' AS feature, 1.0::DOUBLE AS importance",
    "keep_distance_races": _sql([RAW], f"SELECT row_id, distance_text FROM raw WHERE {KEEP_DISTANCE}"),
    "drop_named_events": _sql([RAW], f"SELECT row_id, event_name FROM raw WHERE {KEEP_EVENT}"),
    "missing_required": _sql(
        [RAW], "SELECT row_id FROM raw WHERE birth_year IS NOT NULL AND distance_text IS NOT NULL"
    ),
    "single_gender": _sql(
        [RAW],
        """SELECT row_id, athlete_id, gender FROM raw WHERE athlete_id IN (
  SELECT athlete_id FROM raw GROUP BY athlete_id HAVING count(DISTINCT gender) = 1)""",
    ),
    "single_valued_events": """SELECT l_orderkey, count(*) AS rows FROM lineitem
GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1""",
    "conflicting_entities_removed": _sql(
        [RAW],
        """SELECT row_id, athlete_id FROM raw WHERE athlete_id NOT IN (
  SELECT athlete_id FROM raw GROUP BY athlete_id HAVING count(DISTINCT gender) > 1)""",
    ),
    "missing_distance_events": _sql(
        [RAW], "SELECT DISTINCT event_name, event_year FROM raw WHERE distance_text IS NULL"
    ),
    "names_with_digits": rf"""SELECT DISTINCT name FROM (SELECT {_clean_name('text')} AS name FROM documents)
WHERE regexp_matches(name, '\d{{4}}') ORDER BY name LIMIT 10""",
    "clean_races": _sql(
        TO_CLEANED,
        """SELECT row_id, athlete_id, event_year, event_name_clean, round(distance_km, 6) AS distance_km,
  performance_clean, performance_seconds, round(pace, 6) AS pace_min_per_km FROM cleaned""",
    ),
    "clean_races_original": _sql(
        [RAW, _cleaned("cleaned", KM_CORRECTED, STRICT)],
        """SELECT row_id, round(distance_km, 6) AS distance_km, performance_seconds,
  round(pace, 6) AS pace_min_per_km FROM cleaned""",
    ),
    "mean_pace_by_year": _sql(
        TO_CLEANED,
        "SELECT event_year, count(*) AS rows, round(avg(pace), 6) AS mean_pace FROM cleaned GROUP BY event_year",
    ),
    "distinct_reduction": _sql(
        [RAW],
        f"""SELECT count(DISTINCT event_name) AS distinct_before,
  count(DISTINCT {_clean_name('event_name')}) AS distinct_after,
  round((count(DISTINCT event_name) - count(DISTINCT {_clean_name('event_name')}))
    / CAST(count(DISTINCT event_name) AS DOUBLE) * 100, 6) AS reduction_pct FROM raw""",
    ),
    "history_all": _sql(
        TO_FEATURES,
        f"SELECT row_id, athlete_id, event_year, event_name_clean, {', '.join(map(_shown, HISTORY_COLS))} FROM features",
    ),
    **{
        f"history_{c}": _sql(TO_FEATURES, f"SELECT row_id, {_shown(c)} FROM features") for c in HISTORY_COLS
    },
    "order_history": """SELECT o_orderkey, row_number() OVER w - 1 AS orders_before,
  round(sum(o_totalprice) OVER p + 1e-6, 3) AS spent_before, round(avg(o_totalprice) OVER p + 1e-6, 3) AS mean_before,
  round(max(o_totalprice) OVER p + 1e-6, 3) AS best_before, round(avg(o_totalprice) OVER r + 1e-6, 3) AS recent_mean
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
  p AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  r AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    "event_type_history": """SELECT event_id, row_number() OVER w - 1 AS seen_before,
  round(avg(value) OVER p + 1e-8, 5) AS mean_before, round(min(value) OVER p + 1e-8, 5) AS low_before,
  round(avg(value) OVER r + 1e-8, 5) AS recent_mean
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id),
  p AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  r AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    "split_target_event_train": _sql(
        TO_SPLIT, "SELECT row_id, athlete_id, event_year, cum_num_races FROM train"
    ),
    "split_target_event_test": _sql(
        TO_SPLIT, "SELECT row_id, athlete_id, event_year, cum_num_races FROM test"
    ),
    "split_null_entity_train": _sql(
        [*TO_NULLABLE, SPLIT], "SELECT row_id, nullif(athlete_id, -1) AS athlete_id, event_year, cum_num_races FROM train"
    ),
    "validate_null_entity": _sql(
        [
            *TO_NULLABLE,
            "checked AS (SELECT * REPLACE (cum_num_races + 1 AS cum_num_races) FROM features WHERE athlete_id = -1)",
            ISSUES,
        ],
        'SELECT type, "year", count(*) AS issues FROM issues GROUP BY ALL',
    ),
    "split_year_train": _sql(TO_CLEANED, "SELECT row_id, event_year FROM cleaned WHERE event_year < 2000"),
    "split_year_test": _sql(
        TO_CLEANED,
        "SELECT row_id, event_year FROM cleaned WHERE event_year = 2000 AND event_name ILIKE '%western states%'",
    ),
    "time_index": _sql(TO_FOLDS, "SELECT row_id, event_year, row_index FROM folded"),
    "time_folds": _sql(TO_FOLDS, "SELECT row_id, row_index, fold FROM folded"),
    "time_fold_sizes": _sql(
        TO_FOLDS,
        """SELECT f.fold, (SELECT count(*) FROM folded t WHERE t.fold < f.fold) AS n_train,
  count(*) AS n_validation FROM folded f WHERE f.fold >= 0 GROUP BY f.fold""",
    ),
    "kfold_ranges": """WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1
  AS row_index, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, row_index, CAST(CASE WHEN row_index < (n % 7) * (n // 7 + 1) THEN row_index // (n // 7 + 1)
  ELSE n % 7 + (row_index - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM i""",
    "target_encoding_train": _encode("cleaned", "event_year < 2000"),
    "target_encoding_test": _encode("cleaned", "event_year = 2000"),
    "target_encoding_per_fold": _sql(
        TO_FOLDS,
        """SELECT v.row_id, v.fold,
  round((coalesce(s.total, 0) + 10 * g.mean) / (coalesce(s.n, 0) + 10), 6) AS encoded
FROM folded v
JOIN (SELECT f.fold, avg(t.pace) AS mean FROM (SELECT DISTINCT fold FROM folded) f
      JOIN folded t ON t.fold < f.fold GROUP BY f.fold) g ON g.fold = v.fold
LEFT JOIN (SELECT f.fold, t.event_name_clean, sum(t.pace) AS total, count(*) AS n
      FROM (SELECT DISTINCT fold FROM folded) f JOIN folded t ON t.fold < f.fold
      GROUP BY f.fold, t.event_name_clean) s
  ON s.fold = v.fold AND s.event_name_clean = v.event_name_clean
WHERE v.fold >= 0""",
    ),
    "category_codes": _sql(
        TO_CLEANED,
        """SELECT row_id, CAST(dense_rank() OVER (ORDER BY event_name_clean) - 1 AS INTEGER) AS code
FROM cleaned""",
    ),
    "one_hot": """WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM
  (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderdate < '2000-01-01'))
SELECT o_orderkey, CAST(coalesce(i = 1, false) AS INTEGER) AS level_1, CAST(coalesce(i = 2, false) AS INTEGER) AS level_2,
  CAST(coalesce(i = 3, false) AS INTEGER) AS level_3, CAST(coalesce(i = 4, false) AS INTEGER) AS level_4
FROM orders LEFT JOIN l ON v = o_orderpriority""",
    "model_matrix_clean": _sql(
        [*TO_SPLIT, MATRIX],
        """SELECT row_id, part, CAST(event_year AS DOUBLE) AS event_year, CAST(finishers AS DOUBLE) AS finishers,
  CAST(code AS DOUBLE) AS gender, round(distance_km, 6) AS distance_km,
  CAST(cum_num_races AS DOUBLE) AS cum_num_races, round(cum_avg_pace, 6) AS cum_avg_pace,
  round(cum_best_pace, 6) AS cum_best_pace, CAST(cum_ws_finishes AS DOUBLE) AS cum_ws_finishes,
  round(cum_total_distance, 6) AS cum_total_distance, round(cum_avg_distance, 6) AS cum_avg_distance,
  round(cum_shortest_distance, 6) AS cum_shortest_distance,
  round(cum_longest_distance, 6) AS cum_longest_distance,
  round(recent_avg_distance, 6) AS recent_avg_distance,
  round(distance_gap_from_longest, 6) AS distance_gap_from_longest, CAST(athlete_age AS DOUBLE) AS athlete_age,
  round(coalesce(weight, g), 6) AS encoded
FROM parts LEFT JOIN weights USING (event_name_clean) JOIN labels_seen USING (gender), g""",
    ),
    "regression_metrics": _sql(TO_PREDICTIONS, f"SELECT {_metrics()} FROM predictions"),
    "metrics_long": _sql(
        [*TO_PREDICTIONS, f"m AS (SELECT {_metrics(counts=False)} FROM predictions)"],
        _union(
            [
                f"""SELECT 'past mean' AS model, '{n}' AS metric, "{n}" AS value FROM m"""
                for n in METRIC_NAMES
            ]
        ),
    ),
    "metrics_by_distance": _sql(
        TO_PREDICTIONS,
        f"""SELECT {_case('distance', [0, 50, 100, 160, 200], ['< 50km', '50-99km', '100-159km', '160-199km', '≥ 200km'])}
  AS distance_range, {_metrics()} FROM predictions GROUP BY 1 HAVING distance_range IS NOT NULL""",
    ),
    "metrics_by_category": _sql(
        TO_PREDICTIONS, f"SELECT gender, {_metrics()} FROM predictions GROUP BY gender"
    ),
    "metrics_by_experience": _sql(
        TO_PREDICTIONS,
        f"""SELECT {_case('num_races', [0, 5, 20, 50, 100], ['0-4 races', '5-19 races', '20-49 races', '50-99 races', '100+ races'])}
  AS experience_range, {_metrics()} FROM predictions GROUP BY 1 HAVING experience_range IS NOT NULL""",
    ),
    "metrics_by_custom_bins": _sql(
        TO_PREDICTIONS,
        f"""SELECT {_case('distance', [0, 42, 80, 120], ['[0, 42)', '[42, 80)', '[80, 120)'])} AS distance_range,
  {_metrics()} FROM predictions GROUP BY 1 HAVING distance_range IS NOT NULL""",
    ),
    "compare_models": _sql(
        TO_PREDICTIONS,
        _union(
            [
                f"SELECT '{n}' AS model, {_metrics(p=c, counts=False)} FROM predictions"
                for n, c in (("past mean", "y_pred"), ("past best", "y_best"))
            ]
        ),
    ),
    "yearly_score_summary": _sql(
        [*TO_PREDICTIONS, "y AS (SELECT avg(abs(y_true - y_pred)) AS mae FROM predictions GROUP BY event_year)"],
        """SELECT round(avg(mae), 6) AS mean, round(stddev_pop(mae), 6) AS std, round(min(mae), 6) AS min,
  round(max(mae), 6) AS max FROM y""",
    ),
    "prediction_errors": _sql(
        TO_PREDICTIONS, "SELECT row_id, round(y_true - y_pred, 6) AS error FROM predictions"
    ),
    "validate_temporal": _sql([*TO_FEATURES, CHECKED, ISSUES], SHOW_ISSUES),
    "validate_temporal_tampered": _sql([*TO_FEATURES, TAMPERED, ISSUES], SHOW_ISSUES),
    "validate_temporal_summary": _sql(
        [*TO_FEATURES, CHECKED, ISSUES],
        """SELECT (SELECT count(*) FROM issues) = 0 AS valid, (SELECT count(*) FROM issues) AS issues,
  count(DISTINCT athlete_id) AS total_athletes_checked, count(*) AS total_records_checked FROM features""",
    ),
    "validate_first_issues": _sql(
        [*TO_FEATURES, TAMPERED, ISSUES],
        f'{SHOW_ISSUES} ORDER BY type, entity_id, "year", expected, actual LIMIT 5',
    ),
    "validate_split": _sql([*TO_SPLIT, SPLIT_ISSUES], "SELECT * FROM split_issues"),
    "validate_split_wrong_year": _sql(
        TO_FEATURES,
        """SELECT 'missing_target_event' AS type, CAST(NULL AS BIGINT) AS entity_id, CAST(NULL AS INTEGER) AS "year",
  CAST(NULL AS DOUBLE) AS expected, CAST(NULL AS DOUBLE) AS actual, 'Comrades not found in test set' AS message
UNION ALL SELECT 'missing_test_year', NULL, NULL, NULL, NULL, '2005 not found in test years'
WHERE NOT EXISTS (SELECT 1 FROM features WHERE event_year = 2005)
UNION ALL SELECT 'multiple_test_years', NULL, NULL, NULL, count(DISTINCT event_year), 'more than one test year'
FROM features WHERE event_year >= 1999 HAVING count(DISTINCT event_year) > 1""",
    ),
    "validate_split_summary": _sql(
        [*TO_SPLIT, SPLIT_ISSUES],
        """SELECT (SELECT count(*) FROM split_issues) = 0 AS valid, (SELECT count(*) FROM split_issues) AS issues,
  (SELECT count(DISTINCT athlete_id) FROM test) AS test_athletes,
  (SELECT count(DISTINCT athlete_id) FROM train) AS train_athletes""",
    ),
    "validate_report": _sql(
        [*TO_SPLIT, CHECKED, ISSUES, SPLIT_ISSUES],
        """SELECT 'temporal' AS "check", count(*) = 0 AS valid, count(*) AS issues FROM issues
UNION ALL SELECT 'split', count(*) = 0, count(*) FROM split_issues""",
    ),
    "null_profile": _sql(
        [RAW],
        _union(
            [
                f"""SELECT '{n}' AS "column", count(*) - count({c}) AS nulls,
  round((count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100, 6) AS null_pct FROM raw"""
                for n, c in NULL_COLUMNS.items()
            ]
        ),
    ),
    "inspect_columns": _union(
        [
            f"""SELECT '{n}' AS "column", '{t}' AS dtype, count(*) - count({n}) AS nulls,
  round((count(*) - count({n})) / CAST(count(*) AS DOUBLE) * 100, 6) AS null_pct FROM lineitem"""
            for n, t in LINE_TYPES.items()
        ]
    ),
    "column_bytes": _union(
        [f"""SELECT '{n}' AS "column", CAST({s} AS BIGINT) AS bytes FROM orders""" for n, s in ORDER_BYTES.items()]
    ),
    "top_values": _sql(
        [RAW],
        "SELECT event_name, count(*) AS rows FROM raw GROUP BY event_name ORDER BY rows DESC, event_name LIMIT 10",
    ),
    "rows_over_time": "SELECT CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY day",
    "metrics_by_segment": _sql(
        [
            *TO_PREDICTIONS,
            f"""labelled AS (SELECT *,
  {_case('distance', [0, 50, 100, 160, 200], ['< 50km', '50-99km', '100-159km', '160-199km', '≥ 200km'])} AS d,
  {_case('num_races', [0, 5, 20, 50, 100], ['0-4 races', '5-19 races', '20-49 races', '50-99 races', '100+ races'])} AS e
  FROM predictions)""",
        ],
        _union(
            [
                f"SELECT '{name}' AS segment, CAST({c} AS VARCHAR) AS \"value\", {_metrics()} FROM labelled {rest}"
                for name, c, rest in (
                    ("distance_range", "d", "WHERE d IS NOT NULL GROUP BY d"),
                    ("experience_range", "e", "WHERE e IS NOT NULL GROUP BY e"),
                    ("gender", "gender", "GROUP BY gender"),
                    ("all", "NULL", ""),
                )
            ]
        ),
    ),
    "density_by_category": """WITH v AS (SELECT event_type, CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL),
facts AS (SELECT event_type, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h
  FROM v GROUP BY event_type),
grid AS (SELECT *, CAST(range AS INTEGER) AS point, lo - 2 * h + range * (hi - lo + 4 * h) / 49.0 AS x FROM range(50), facts)
SELECT g.event_type, point, round(any_value(x), 6) AS x,
  round(sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) * 1000, 6) AS density
FROM grid g JOIN v ON g.event_type IS NOT DISTINCT FROM v.event_type GROUP BY g.event_type, point""",
    "one_hot_sparse": """WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM
  (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_orderdate < '2000-01-01'))
SELECT o_orderkey, CAST((SELECT count(*) - 1 FROM l) AS INTEGER) AS places,
  CAST(CASE WHEN i > 0 THEN i - 1 END AS INTEGER) AS place, CAST(coalesce(i > 0, false) AS INTEGER) AS ones
FROM orders LEFT JOIN l ON v = CAST(o_custkey AS VARCHAR)""",
    "lookup_hot_keys": """SELECT l_orderkey, l_linenumber, part, round(p_retailprice, 6) AS p_retailprice FROM
  (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 7 WHEN l_orderkey % 9 <> 0 THEN l_partkey END AS part FROM lineitem)
  LEFT JOIN part ON part = p_partkey AND p_partkey % 3 <> 0""",
    "drop_listed_names": """SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 3 > 0)""",
    "bad_rows": """WITH o AS (SELECT o_orderkey % 10 AS kind, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s,
  CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey % 89 AS VARCHAR) AS a FROM orders)
SELECT 'unclosed_quote' AS problem, CAST(4 AS INTEGER) AS cells, CAST(NULL AS VARCHAR) AS columns, k || ',"' || s || ',' || c || ',' || a AS record
FROM o WHERE kind = 0
UNION ALL SELECT 'too_few', 3, NULL, k || ',' || s || ',' || c FROM o WHERE kind = 1
UNION ALL SELECT 'too_many', 5, NULL, k || ',' || s || ',' || c || ',' || a || ',more' FROM o WHERE kind = 2
UNION ALL SELECT 'malformed', 4, 'customer amount', k || ',' || s || ',n/k,' || a || 'x' FROM o WHERE kind = 4""",
    "stage_counts": _sql(
        TO_FEATURES,
        """SELECT 'raw' AS stage, count(*) AS rows, CAST(14 AS BIGINT) AS columns FROM raw
UNION ALL SELECT 'cleaned', count(*), 19 FROM cleaned UNION ALL SELECT 'features', count(*), 30 FROM features""",
    ),
    "histogram": _histogram("lineitem", "l_extendedprice", 50, "coalesce(c, 0) AS rows"),
    "histogram_density": _histogram(
        "events", "value", 30, "round(coalesce(c, 0) / (n * w) * 1000, 6) AS density"
    ),
    "box_stats": _box("lineitem", "l_extendedprice", None),
    "category_distribution": _box("events", "value", "event_type"),
    "quantiles_by_flag": """SELECT l_returnflag, count(*) AS rows, round(quantile_cont(l_quantity, 0.1), 6) AS p10,
  round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90
FROM lineitem GROUP BY l_returnflag""",
    "scatter_sample": f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6) < '{int(0.05 * 16**6):06x}'""",
    "binned_pairs": """SELECT CAST(floor(l_quantity / 5.0) AS BIGINT) AS x_bin,
  CAST(floor(l_extendedprice / 5000.0) AS BIGINT) AS y_bin, count(*) AS rows FROM lineitem GROUP BY ALL""",
    "correlations": _union(
        [f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS]
    ),
    "top_correlations": _sql(
        TO_FEATURES,
        "SELECT feature, round(abs_r, 6) AS abs_r FROM ("
        + _union(
            [
                f"SELECT '{'Event distance_numeric' if c == 'distance_km' else c}' AS feature, "
                f"abs(corr({c}, pace)) AS abs_r FROM features"
                for c in RACE_NUMBERS
            ]
        )
        + ") ORDER BY abs_r DESC, feature LIMIT 3",
    ),
    "residual_histogram": _sql(
        [*TO_PREDICTIONS, "res AS (SELECT y_true - y_pred AS residual FROM predictions)"],
        _histogram("res", "residual", 50, "round(coalesce(c, 0) / (n * w), 6) AS density").replace(
            "WITH edges", "SELECT * FROM (WITH edges", 1
        )
        + ")",
    ),
    "qq_points": _sql(
        [*TO_PREDICTIONS, QQ],
        "SELECT row_id, rank, round(theoretical, 6) AS theoretical, round(ordered, 6) AS ordered FROM points",
    ),
    "qq_fit": _sql(
        [*TO_PREDICTIONS, QQ],
        """SELECT round(regr_slope(ordered, theoretical), 6) AS slope,
  round(regr_intercept(ordered, theoretical), 6) AS intercept, round(corr(ordered, theoretical), 6) AS r
FROM points""",
    ),
    "tree_predict": _sql(
        TREE_TEST, "SELECT row_id, round(label, 6) AS label, round(prediction, 6) AS prediction FROM predicted"
    ),
    "tree_metrics": _sql(TREE_TEST, f"SELECT {_metrics('label', 'prediction')} FROM predicted"),
    "tree_importance": "SELECT 'x' AS feature, 1.0::DOUBLE AS importance",
    "tree_split_counts": _sql(TREE_ROWS, "SELECT 'x' AS feature, CAST(count(DISTINCT x) - 1 AS DOUBLE) AS importance FROM train"),
    "tree_leaves": _sql(TREE_ROWS, "SELECT count(*) AS rows, round(avg(label), 6) AS prediction FROM train GROUP BY x"),
    "tree_residuals": _sql(
        [*TREE_ROWS, "fit AS (SELECT x, avg(label) AS prediction FROM train GROUP BY x)"],
        "SELECT row_id, CAST(x AS DOUBLE) AS top_feature, round(label - prediction, 6) AS residual FROM test JOIN fit USING (x)",
    ),
    "tree_temporal_cv": _sql(_in_order(LEAF_FOLDS, "event_year, row_id"), LEAF_SCORES),
    "tree_saved_model": _sql(LEAF_TEST, "SELECT row_id, round(prediction, 6) AS prediction FROM predicted"),
    "run_ml_metrics": _sql(LEAF_TEST, f"SELECT {_metrics('label', 'prediction')} FROM predicted"),
    "run_cv_scores": _sql(_in_order(LEAF_FOLDS, ORDER), LEAF_SCORES),
    "run_final_predictions": _sql(LEAF_TEST, "SELECT round(label, 6) AS label, round(prediction, 6) AS prediction FROM predicted"),
    "run_data_features": _sql(
        TO_FEATURES, f"SELECT athlete_id, event_year, event_name_clean, {', '.join(map(_shown, HISTORY_COLS))} FROM features"
    ),
    "sorted_stage": _sql(
        [RAW],
        f"""SELECT athlete_id, event_year, event_name, performance AS "Athlete performance",
  row_number() OVER (ORDER BY athlete_id, {ORDER}) - 1 AS place FROM raw""",
    ),
    "tree_kfold": _sql(
        TREE_FOLDS,
        """SELECT round(avg(-mae), 6) AS mean, round(stddev_pop(-mae), 6) AS std, round(min(-mae), 6) AS min,
  round(max(-mae), 6) AS max FROM scored""",
    ),
    "tree_grid": _sql(
        TREE_FOLDS,
        """SELECT 64 AS num_leaves, round(mae, 6) AS mae FROM scored WHERE fold = 4
UNION ALL SELECT 1, round(mean_mae, 6) FROM scored WHERE fold = 4""",
    ),
    "kde_curve": _sql(
        [
            *TO_PREDICTIONS,
            "res AS (SELECT y_true - y_pred AS v FROM predictions)",
            "facts AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h FROM res)",
            "grid AS (SELECT CAST(range AS INTEGER) AS point, lo - 3 * h + range * (hi - lo + 6 * h) / 99.0 AS x FROM range(100), facts)",
        ],
        """SELECT point, round(any_value(x), 6) AS x,
  round(sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM grid, res, facts GROUP BY point""",
    ),
    "run_log": _sql(
        [*TO_PREDICTIONS, f"m AS (SELECT {_metrics()} FROM predictions)"],
        _union(
            [
                f"""SELECT '{run_id}' AS run_id, 'baseline' AS run, '{n}' AS metric, CAST("{n}" AS DOUBLE) AS value
FROM m"""
                for run_id in ("first", "second")
                for n in [*METRIC_NAMES, "count", "zero_targets"]
            ]
        ),
    ),
}
