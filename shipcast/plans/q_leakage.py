"""Leakage-screen queries over the modelling population."""

from __future__ import annotations

from pyspark.sql import functions as F

from shipcast.operators import leakage as LK
from shipcast.operators.cleaning import filter_cancelled
from shipcast.operators.features import engineer_features
from shipcast.plans.registry import query
from shipcast.plans.sql_base import features_sql, with_base
from shipcast.sources.adapter import LINE_SCHEMA, lines

ENGINEERED = list(LK.ENGINEERED_REASON)
ALL_COLS = [c for c, _ in LINE_SCHEMA] + ENGINEERED
KIND = dict(LINE_SCHEMA)
NUMERIC = {c for c, k in LINE_SCHEMA if k in ("integer", "float")} | set(ENGINEERED)
CANDS = [c for c in ALL_COLS if c not in LK.BLOCKED and c not in LK.EXCLUDED_BY_DESIGN and KIND.get(c) != "timestamp"]

LFEAT_CTE = features_sql("lines", "lfeat") + ", mpop AS (SELECT * FROM lfeat WHERE delivery_status <> 'Shipping canceled')"
FLAGS_CTE = LFEAT_CTE + ", cflags AS (SELECT " + ", ".join(f"(count({c}) = 0 OR min({c}) = max({c})) AS {c}" for c in CANDS) + " FROM mpop)"


def _pop(spark, sf_dir):
    """Read in one pass, so its features are computed there and not stored."""
    return filter_cancelled(engineer_features(lines(spark, sf_dir)))


def _feat_sql() -> str:
    parts = []
    for c in CANDS:
        kind = "numeric" if c in NUMERIC else "categorical"
        parts.append(f"SELECT 'full' AS variant, '{c}' AS feature, '{kind}' AS kind FROM cflags WHERE NOT {c}")
        if c != LK.DECISION:
            parts.append(f"SELECT 'without_mode', '{c}', '{kind}' FROM cflags WHERE NOT {c}")
        else:
            parts.append(f"SELECT 'mode_only', '{c}', '{kind}' FROM cflags WHERE NOT {c}")
    return with_base(" UNION ALL ".join(parts), FLAGS_CTE)


@query("feature_select", _feat_sql())
def q_feature_select(spark, sf_dir):
    return LK.feature_table(_pop(spark, sf_dir).select(*ALL_COLS))


FULL_FEATURES_SQL = " UNION ALL ".join(f"SELECT '{c}' AS f FROM cflags WHERE NOT {c}" for c in CANDS)


@query(
    "leakage_guard",
    with_base(
        "SELECT feature_list, count(*) AS n_features, CAST(sum(bad) AS BIGINT) AS n_offenders, "
        "coalesce(string_agg(CASE WHEN bad = 1 THEN f END, ',' ORDER BY f), '') AS offenders FROM ("
        "SELECT feature_list, f, CASE WHEN f IN ('late_delivery_risk', 'delivery_status', 'real_days', 'shipping_date') THEN 1 ELSE 0 END AS bad FROM ("
        "SELECT 'selected' AS feature_list, f FROM feats UNION ALL SELECT 'selected_plus_delivery_status', f FROM feats "
        "UNION ALL SELECT 'selected_plus_delivery_status', 'delivery_status')) GROUP BY 1",
        FLAGS_CTE + ", feats AS (" + FULL_FEATURES_SQL + ")",
    ),
)
def q_leakage_guard(spark, sf_dir):
    """The guard over the selected features, and over a list with a planted outcome column."""
    pop = _pop(spark, sf_dir).select(*ALL_COLS)
    feats = LK.feature_table(pop).where(F.col("variant") == "full").select("feature")
    planted = feats.union(feats.agg(F.lit("delivery_status").alias("feature")))
    return LK.offending(
        feats.select(F.lit("selected").alias("feature_list"), "feature").unionByName(
            planted.select(F.lit("selected_plus_delivery_status").alias("feature_list"), "feature")
        )
    )


def _avail_sql() -> str:
    def case(table: dict) -> str:
        return "CASE variable " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table.items()) + " END"

    blocked, excluded, eng = case(LK.BLOCKED), case(LK.EXCLUDED_BY_DESIGN), case(LK.ENGINEERED_REASON)
    used = "variable IN (" + " UNION ALL ".join(f"SELECT '{c}' FROM cflags WHERE NOT {c}" for c in CANDS) + ")"
    avail = (
        f"CASE WHEN variable = '{LK.TARGET}' THEN 'No' WHEN variable = '{LK.DECISION}' THEN 'Yes - decision variable' "
        f"WHEN {blocked} IS NOT NULL THEN 'No' ELSE 'Yes' END"
    )
    return with_base(
        f"SELECT variable, {avail} AS available, CASE WHEN variable = '{LK.TARGET}' THEN 'No' WHEN variable = '{LK.DECISION}' THEN 'Special handling' "
        f"WHEN {blocked} IS NOT NULL THEN 'No' WHEN {excluded} IS NOT NULL THEN 'No' WHEN {used} THEN 'Yes' ELSE 'No' END AS used, "
        f"CASE WHEN variable = '{LK.DECISION}' THEN '{LK.DECISION_REASON}' "
        f"WHEN {blocked} IS NOT NULL THEN {blocked} WHEN {excluded} IS NOT NULL THEN {excluded} "
        f"WHEN {used} THEN coalesce({eng}, '{LK.DEFAULT_REASON}') ELSE '{LK.UNUSED_REASON}' END AS reason, "
        f"CAST(CASE {avail} WHEN 'No' THEN 0 WHEN 'Yes - decision variable' THEN 1 ELSE 2 END AS BIGINT) AS sort_key "
        "FROM (VALUES " + ", ".join(f"('{c}')" for c in ALL_COLS) + ") t(variable)",
        FLAGS_CTE,
    )


@query("availability_table", _avail_sql())
def q_availability_table(spark, sf_dir):
    pop = _pop(spark, sf_dir).select(*ALL_COLS)
    feats = LK.feature_table(pop).where(F.col("variant") == "full").select("feature")
    return LK.availability_table(pop, feats)


@query("export_availability", _avail_sql())
def q_export_availability(spark, sf_dir):
    return q_availability_table(spark, sf_dir)
