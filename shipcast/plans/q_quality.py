"""Profiling, data quality, cleaning and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipcast.functions.rounding import dround
from shipcast.operators import cleaning as C
from shipcast.operators import features as FT
from shipcast.operators import quality as Q
from shipcast.operators.decision import split_flag
from shipcast.plans.registry import query
from shipcast.plans.sql_base import with_base
from shipcast.sources.adapter import CANCELLED_STATUS, LINE_SCHEMA, lines, orders_frame
from shipcast.sources.tables import read_table

COLS = [c for c, _ in LINE_SCHEMA]
KIND = dict(LINE_SCHEMA)
NUMERIC = [c for c, k in LINE_SCHEMA if k in ("integer", "float")]
U = "\nUNION ALL\n"

# ---------------------------------------------------------------- roles
_excl = set(Q.LEAKAGE) | set(Q.PII) | set(Q.IDENTIFIERS) | {Q.TARGET}


def _roles_parts() -> tuple[str, str]:
    """(flags CTE, roles body) of the column-roles oracle."""
    flags = ", ".join(f"(count({c}) = 0 OR min({c}) = max({c})) AS d_{c}" for c in COLS)
    parts = []
    for c in COLS:
        static = []
        if c == Q.TARGET:
            static.append("target")
        if c == Q.DECISION:
            static.append("decision")
        if c in Q.LEAKAGE:
            static.append("leakage")
        if c in Q.PII:
            static.append("pii")
        if c in Q.IDENTIFIERS:
            static.append("identifier")
        if c in Q.ECONOMIC:
            static.append("economic")
        for r in static:
            parts.append(f"SELECT '{c}' AS column, '{r}' AS role FROM fl")
        parts.append(f"SELECT '{c}', 'dead' FROM fl WHERE d_{c}")
        if c not in _excl:
            r = "numeric" if c in NUMERIC else "categorical"
            parts.append(f"SELECT '{c}', '{r}' FROM fl WHERE NOT d_{c}")
    return f"fl AS (SELECT {flags} FROM lines)", U.join(parts)


def _roles_sql() -> str:
    cte, body = _roles_parts()
    return with_base(body, cte)


@query("column_roles", _roles_sql())
def q_column_roles(spark, sf_dir):
    return Q.column_roles(lines(spark, sf_dir).select(*COLS))


# ---------------------------------------------------------------- profiles
def _profile_sql() -> str:
    parts = []
    for c in COLS:
        k = KIND[c]
        ex = f"min({c})" if k == "string" else "CAST(NULL AS VARCHAR)"
        mn = f"CAST(min({c}) AS DOUBLE)" if c in NUMERIC else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column, '{k}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
            f"round(100 * (count(*) - count({c})) / count(*), 2) AS missing_pct, CAST(count(DISTINCT {c}) AS BIGINT) AS unique, "
            f"{ex} AS example, {mn} AS min_value FROM lines"
        )
    return with_base(U.join(parts))


@query("profile_columns", _profile_sql())
def q_profile_columns(spark, sf_dir):
    return Q.profile_columns(lines(spark, sf_dir).select(*COLS))


def _outlier_sql() -> str:
    cols = [c for c in NUMERIC if c not in Q.OUTLIER_SKIP and not c.endswith("_id")]
    parts = [
        f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS count "
        f"FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lines WHERE {c} IS NOT NULL) x, "
        f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lines) q "
        f"WHERE q3 - q1 > 0 GROUP BY q1, q3"
        for c in cols
    ]
    return with_base(
        "SELECT row_number() OVER (ORDER BY count DESC, \"column\") AS rank, \"column\", count, "
        "round(100 * count / (SELECT count(*) FROM lines), 2) AS pct FROM ("
        + U.join(parts)
        + ") WHERE count > 0"
    )


@query("profile_outliers", _outlier_sql())
def q_profile_outliers(spark, sf_dir):
    return Q.profile_outliers(lines(spark, sf_dir).select(*COLS))


_COPIES = (
    "copies AS (SELECT *, order_item_total AS sales_per_customer, profit AS benefit_per_order, "
    "customer_id AS order_customer_id, product_price AS order_item_product_price FROM lines)"
)


@query(
    "duplicate_columns",
    with_base(
        U.join(f"SELECT '{a}' AS kept, '{b}' AS dropped, bool_and({a} IS NOT DISTINCT FROM {b}) AS identical FROM copies" for a, b in Q.DUPLICATE_PAIRS),
        _COPIES,
    ),
)
def q_duplicate_columns(spark, sf_dir):
    return Q.duplicate_columns(Q.with_duplicate_copies(lines(spark, sf_dir).select(*COLS)))


def _dup_sql(src: str, name: str) -> str:
    return (
        f"SELECT '{name}' AS dataset, n AS n_rows, CAST(n - d AS BIGINT) AS n_duplicate_rows, "
        f"CASE WHEN n > 0 THEN round(100 * (n - d) / n, 3) ELSE 0.0 END AS duplicate_pct FROM "
        f"(SELECT count(*) AS n FROM {src}), (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM {src}))"
    )


@query(
    "duplicate_rows",
    with_base(
        _dup_sql("lines", "lines") + U + _dup_sql("doubled", "lines_union_all_lines"),
        "doubled AS (SELECT * FROM lines UNION ALL SELECT * FROM lines)",
    ),
)
def q_duplicate_rows(spark, sf_dir):
    l = lines(spark, sf_dir).select(*COLS)
    a = Q.duplicate_rows(l).select(F.lit("lines").alias("dataset"), "*")
    b = Q.duplicate_rows(l.unionAll(l)).select(F.lit("lines_union_all_lines").alias("dataset"), "*")
    return a.unionByName(b)


@query(
    "dataset_health",
    with_base(
        f"SELECT n AS n_rows, CAST({len(COLS)} AS BIGINT) AS n_columns, CAST({len(NUMERIC)} AS BIGINT) AS n_numeric, "
        f"CAST({len(COLS) - len(NUMERIC)} AS BIGINT) AS n_categorical, CAST(m AS BIGINT) AS n_missing_cells, "
        f"round(100 * m / (n * {len(COLS)}), 3) AS missing_pct, CAST(n - d AS BIGINT) AS n_duplicate_rows, "
        "CASE WHEN n > 0 THEN round(100 * (n - d) / n, 3) ELSE 0.0 END AS duplicate_pct FROM "
        "(SELECT count(*) AS n, " + " + ".join(f"(count(*) - count({c}))" for c in COLS) + " AS m FROM lines), "
        "(SELECT count(*) AS d FROM (SELECT DISTINCT * FROM lines))"
    ),
)
def q_dataset_health(spark, sf_dir):
    return Q.dataset_health(lines(spark, sf_dir).select(*COLS))


# ---------------------------------------------------------------- cleaning
#: what is left of the line table with copies: sparse zip codes and the second of each identical pair are gone
_CLEANED = [c for c in COLS if c not in ("order_zipcode", "order_date", "shipping_date")]
_DATES = [c for c in COLS if c in ("order_date", "shipping_date")]


@query(
    "clean_drop",
    with_base(
        f"SELECT {', '.join(_CLEANED)}, " + ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in _DATES) + " FROM copies",
        _COPIES,
    ),
)
def q_clean_drop(spark, sf_dir):
    out = C.clean_drop(Q.with_duplicate_copies(lines(spark, sf_dir).select(*COLS)))
    return out.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in _DATES else F.col(c) for c in out.columns])


_BAD = "not a date"


@query(
    "clean_dates",
    with_base(
        "SELECT order_id, raw_text, strftime(CASE WHEN (SELECT count(p) FROM dt) = 0 THEN try_cast(raw_text AS TIMESTAMP) ELSE p END, "
        "'%Y-%m-%d %H:%M:%S') AS parsed FROM dt",
        f"dt0 AS (SELECT order_id, CASE WHEN order_status = 'P' THEN '{_BAD}' ELSE strftime(order_date, '%-m/%-d/%Y %-H:%M') END AS raw_text FROM ord), "
        "dt AS (SELECT *, try_strptime(raw_text, '%m/%d/%Y %H:%M') AS p FROM dt0)",
    ),
)
def q_clean_dates(spark, sf_dir):
    o = orders_frame(spark, sf_dir)
    raw = o.select(
        "order_id",
        F.when(F.col("order_status") == "P", F.lit(_BAD)).otherwise(F.date_format("order_date", C.DATE_FORMAT)).alias("raw_text"),
    )
    parsed = C.parse_dates(raw.withColumn("parsed", F.col("raw_text")), "parsed")
    return parsed.select("order_id", "raw_text", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


_IMP_COLS = ["quantity", "order_zipcode", "customer_segment"]


def _nulled(l):
    return l.withColumns(
        {
            "quantity": F.when(F.col("discount_rate") == 0.0, F.lit(None)).otherwise(F.col("quantity")),
            "customer_segment": F.when(F.col("discount_rate") == 0.1, F.lit(None)).otherwise(F.col("customer_segment")),
        }
    )


@query(
    "clean_impute",
    with_base(
        "SELECT order_id, product_id, supplier_id, line_number, coalesce(CAST(quantity AS DOUBLE), (SELECT median(quantity) FROM nl)) AS quantity, "
        "coalesce(CAST(order_zipcode AS DOUBLE), (SELECT median(order_zipcode) FROM nl)) AS order_zipcode, "
        "coalesce(customer_segment, 'Unknown') AS customer_segment, sales, discount_rate FROM nl",
        "nl AS (SELECT * REPLACE (CASE WHEN discount_rate = 0.0 THEN NULL ELSE quantity END AS quantity, "
        "CASE WHEN discount_rate = 0.1 THEN NULL ELSE customer_segment END AS customer_segment) FROM lines)",
    ),
)
def q_clean_impute(spark, sf_dir):
    l = _nulled(lines(spark, sf_dir).select(*COLS))
    out = C.impute(l.select("order_id", "product_id", "supplier_id", "line_number", *_IMP_COLS, "sales", "discount_rate"), _IMP_COLS)
    return out


_INTS = [c for c, k in LINE_SCHEMA if k == "integer"]
_FLOATS = [c for c, k in LINE_SCHEMA if k == "float"]


def _types_sql() -> str:
    def fits(c):
        return (
            f"CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' "
            f"WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END"
        )

    ints = [f"SELECT '{c}' AS column, {fits(c)} AS to_type, count({c}) AS n, CAST(sum({c}) AS DOUBLE) AS total FROM lines" for c in _INTS]
    floats = [
        f"SELECT '{c}', 'float', count({c}), round(sum(CAST(CAST({c} AS FLOAT) AS DOUBLE)), 2) FROM lines" for c in _FLOATS
    ]
    return with_base(U.join([*ints, *floats]))


@query("clean_types", _types_sql())
def q_clean_types(spark, sf_dir):
    """The cast table, read back: type, filled cells and sum of each column."""
    out = C.downcast(lines(spark, sf_dir).select(*COLS))
    types = dict(out.dtypes)
    wide = out.agg(
        *[F.count(c).alias(f"n_{c}") for c in (*_INTS, *_FLOATS)],
        *[F.sum(F.col(c).cast("bigint")).cast("double").alias(f"t_{c}") for c in _INTS],
        *[dround(F.sum(F.col(c).cast("double")), 2).alias(f"t_{c}") for c in _FLOATS],
    )
    rows = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("to_type"), F.col(f"n_{c}").alias("n"), F.col(f"t_{c}").alias("total")) for c in (*_INTS, *_FLOATS)]
    return wide.select(F.inline(F.array(*rows)))


@query(
    "filter_cancelled",
    with_base(
        "SELECT 'lines' AS grain, count(*) AS n_before, count(*) FILTER (WHERE delivery_status = 'Shipping canceled') AS n_cancelled, "
        "count(*) FILTER (WHERE delivery_status <> 'Shipping canceled') AS n_after FROM lines UNION ALL "
        "SELECT 'orders', count(*), count(*) FILTER (WHERE delivery_status = 'Shipping canceled'), "
        "count(*) FILTER (WHERE delivery_status <> 'Shipping canceled') FROM ord"
    ),
)
def q_filter_cancelled(spark, sf_dir):
    cancelled = F.count_if(F.col("delivery_status") == CANCELLED_STATUS)
    known = F.count_if(F.col("delivery_status") != CANCELLED_STATUS)
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_before"), cancelled.alias("n_cancelled"), known.alias("n_after")).select(F.lit(grain).alias("grain"), "*")
        for grain, df in (("lines", lines(spark, sf_dir)), ("orders", orders_frame(spark, sf_dir)))
    ]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- features
_CAL = ["order_year", "order_month", "order_dayofweek", "order_hour", "order_quarter", "order_is_weekend"]


@query("feat_calendar", with_base("SELECT order_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _CAL) + " FROM ord"))
def q_feat_calendar(spark, sf_dir):
    return orders_frame(spark, sf_dir).select("order_id", *[F.col(c).cast("bigint").alias(c) for c in _CAL])


@query(
    "feat_calendar_events",
    "SELECT event_id, CAST(year(ts) AS BIGINT) AS order_year, CAST(month(ts) AS BIGINT) AS order_month, "
    "CAST(isodow(ts) - 1 AS BIGINT) AS order_dayofweek, CAST(hour(ts) AS BIGINT) AS order_hour, "
    "CAST(quarter(ts) AS BIGINT) AS order_quarter, CAST(CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS BIGINT) AS order_is_weekend FROM events",
)
def q_feat_calendar_events(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", *[x.cast("bigint").alias(n) for x, n in zip(FT.calendar_columns(F.col("ts")), _CAL)])


_CYC = ["month_sin", "month_cos", "dow_sin", "dow_cos"]


@query("feat_cyclic", with_base("SELECT order_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CYC) + " FROM ord"))
def q_feat_cyclic(spark, sf_dir):
    return orders_frame(spark, sf_dir).select("order_id", *[dround(c, 6).alias(c) for c in _CYC])


@query(
    "feat_daily_volume",
    with_base(
        "SELECT o.day, o.orders_on_day, l.lines_on_day FROM "
        "(SELECT strftime(order_date, '%Y-%m-%d') AS day, count(*) AS orders_on_day FROM ord GROUP BY 1) o JOIN "
        "(SELECT strftime(order_date, '%Y-%m-%d') AS day, count(*) AS lines_on_day FROM lines GROUP BY 1) l ON l.day = o.day"
    ),
)
def q_feat_daily_volume(spark, sf_dir):
    day = F.date_format("order_date", "yyyy-MM-dd").alias("day")
    on_day = lambda df, name: df.where("order_date is not null").groupBy(day).agg(F.count(F.lit(1)).alias(name))
    return on_day(orders_frame(spark, sf_dir), "orders_on_day").join(on_day(lines(spark, sf_dir), "lines_on_day"), "day")


_ECO = ["discount_depth", "unit_value", "log_product_price", "log_order_value"]


@query("feat_economics", with_base("SELECT order_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ECO) + " FROM ord"))
def q_feat_economics(spark, sf_dir):
    return orders_frame(spark, sf_dir).select("order_id", *[dround(c, 6).alias(c) for c in _ECO])


@query("feat_distance", with_base("SELECT order_id, round(distance_km, 4) AS distance_km FROM ord"))
def q_feat_distance(spark, sf_dir):
    return orders_frame(spark, sf_dir).select("order_id", dround("distance_km", 4).alias("distance_km"))


# ---------------------------------------------------------------- bucketing
_MODEL_POP = "mpop AS (SELECT * FROM lines WHERE delivery_status <> 'Shipping canceled'), mtrain AS (SELECT * FROM mpop WHERE NOT (((order_id * 7919 + 42) % 10007) % 100 < 20))"
_FIT_SQL = (
    "fit AS (SELECT \"column\", level, n, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, level) AS rank FROM ("
    + U.join(f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS level, count(*) AS n FROM mtrain GROUP BY 2" for c in C.HIGH_CARDINALITY_TOP_N)
    + ")) WHERE "
    + " OR ".join(f"(\"column\" = '{c}' AND rank <= {n})" for c, n in C.HIGH_CARDINALITY_TOP_N.items())
    + ")"
)


def _model_pop(spark, sf_dir):
    pop = C.filter_cancelled(lines(spark, sf_dir))
    return pop, pop.where(~split_flag(F.col("order_id")))


@query("bucket_fit", with_base("SELECT * FROM fit", _MODEL_POP + ", " + _FIT_SQL))
def q_bucket_fit(spark, sf_dir):
    _, train = _model_pop(spark, sf_dir)
    return C.bucket_fit(train)


@query(
    "bucket_apply",
    with_base(
        U.join(
            f"SELECT '{c}' AS column, coalesce(f.level, 'Other') AS level, count(*) AS n FROM mpop m "
            f"LEFT JOIN (SELECT level FROM fit WHERE \"column\" = '{c}') f ON f.level = CAST(m.{c} AS VARCHAR) GROUP BY 2"
            for c in C.HIGH_CARDINALITY_TOP_N
        ),
        _MODEL_POP + ", " + _FIT_SQL,
    ),
)
def q_bucket_apply(spark, sf_dir):
    pop, train = _model_pop(spark, sf_dir)
    b = C.bucket_apply(pop, C.bucket_fit(train))
    cols = list(C.HIGH_CARDINALITY_TOP_N)
    return (
        b.select(*cols)
        .unpivot([], cols, "column", "level")
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---------------------------------------------------------------- CSV source
def _csv_path(spark, sf_dir):
    from shipcast.sources.materialize import _key
    from shipcast.session import checkpoint_dir
    import os

    return os.path.join(checkpoint_dir(spark), _key(spark, "lines_csv", sf_dir))


@query(
    "scan_csv",
    with_base(
        f"SELECT {', '.join(c for c in COLS if c != 'order_date')}, strftime(order_date, '%Y-%m-%d %H:%M:%S') AS order_date FROM lines"
    ),
)
def q_scan_csv(spark, sf_dir):
    """The order-line table written by Spark as an ISO-8859-1 CSV and read
    back through the reference-format reader with an explicit schema."""
    from shipcast.sources.csv_source import ENCODING, load_raw_dataset

    l = lines(spark, sf_dir).select(*COLS)
    path = _csv_path(spark, sf_dir)
    l.write.mode("overwrite").option("header", True).option("encoding", ENCODING).csv(path)
    back = load_raw_dataset(spark, ["/nonexistent/uploads/lines.csv", path], l.schema)
    return back.select(*[c for c in COLS if c != "order_date"], F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("order_date"))


_RCTE, _RBODY = _roles_parts()


def _cnt(r: str) -> str:
    return f"count(*) FILTER (WHERE role = '{r}')"


_VAL_SQL = with_base(
    U.join(
        [f"SELECT '{k}' AS check_name, CASE WHEN {_cnt(k)} > 0 THEN 'ok' ELSE 'missing' END AS status, CAST({_cnt(k)} AS BIGINT) AS n FROM roles" for k in ("target", "decision", "economic")]
        + [f"SELECT '{k}', 'info', CAST({_cnt(k)} AS BIGINT) FROM roles" for k in ("leakage", "pii", "identifier", "dead")]
        + [f"SELECT 'ready', CASE WHEN {_cnt('target')} > 0 AND {_cnt('decision')} > 0 THEN 'ok' ELSE 'not_ready' END, CAST(NULL AS BIGINT) FROM roles"]
    ),
    _RCTE + f", roles AS ({_RBODY})",
)


@query("validate_upload", _VAL_SQL)
def q_validate_upload(spark, sf_dir):
    roles = Q.column_roles(lines(spark, sf_dir).select(*COLS))
    n = {r: F.count(F.when(F.col("role") == r, 1)) for r in ("target", "decision", "economic", "leakage", "pii", "identifier", "dead")}
    agg = roles.agg(*[v.alias(k) for k, v in n.items()])
    rows = []
    for k in ("target", "decision", "economic"):
        rows.append(agg.select(F.lit(k).alias("check_name"), F.when(F.col(k) > 0, "ok").otherwise("missing").alias("status"), F.col(k).cast("bigint").alias("n")))
    for k in ("leakage", "pii", "identifier", "dead"):
        rows.append(agg.select(F.lit(k), F.lit("info"), F.col(k).cast("bigint")))
    rows.append(agg.select(F.lit("ready"), F.when((F.col("target") > 0) & (F.col("decision") > 0), "ok").otherwise("not_ready"), F.lit(None).cast("bigint")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
