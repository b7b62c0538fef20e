"""Decision-layer queries on the SQL-computable score.

Population: non-cancelled orders; value = order total / 1000 (FIXTURES §4);
score = train late rate by (mode, market), mode average for empty cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from shipcast.functions.prefix import exact_quantiles
from shipcast.functions.rounding import dround
from shipcast.operators import decision as D
from shipcast.plans.registry import query
from shipcast.plans.sql_base import with_base
from shipcast.sources.adapter import MODES, orders_frame

CONSTRAINT_P = 0.75  # max late probability used by the constrained variants
K = D.MODE_KEYS


def _f(x) -> str:
    return "NULL::DOUBLE" if x is None else f"{float(x)!r}::DOUBLE"


def _rank_case(col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODES)) + " END"


BASE_CTE = (
    "dpop AS (SELECT order_id, market, order_region, shipping_mode, late_delivery_risk, real_days, scheduled_days, "
    "(((order_id * 7919 + 42) % 10007) % 100 < 20) AS is_test, round(order_item_total, 4) / 1000.0 AS value, "
    "round(profit, 4) / 1000.0 AS profit_k FROM ord WHERE delivery_status <> 'Shipping canceled'), "
    "prof AS (SELECT shipping_mode AS mode, " + _rank_case("shipping_mode") + " AS mode_rank, count(*) AS orders, "
    "round(avg(late_delivery_risk), 4) AS late_rate, CAST(trunc(median(scheduled_days)) AS INTEGER) AS promised_days, "
    "round(avg(real_days), 4) AS mean_transit, round(median(real_days), 4) AS median_transit, "
    "round(stddev_samp(real_days), 4) AS std_transit FROM dpop GROUP BY shipping_mode), "
    "pw AS (SELECT "
    + ", ".join(
        f"max(CASE WHEN mode = '{m}' THEN mean_transit END) AS t_{k}, max(CASE WHEN mode = '{m}' THEN late_rate END) AS l_{k}, "
        f"max(CASE WHEN mode = '{m}' THEN promised_days END) AS d_{k}, max(CASE WHEN mode = '{m}' THEN orders END) AS o_{k}"
        for m, k in D.KEY_OF.items()
    )
    + " FROM prof), "
    "cellsraw AS (SELECT shipping_mode, market, avg(late_delivery_risk) AS p FROM dpop WHERE NOT is_test GROUP BY 1, 2), "
    "modeavg AS (SELECT shipping_mode, avg(late_delivery_risk) AS p_mode FROM dpop WHERE NOT is_test GROUP BY 1), "
    "grid AS (SELECT DISTINCT market, m.shipping_mode FROM dpop, (VALUES "
    + ", ".join(f"('{m}')" for m in MODES)
    + ") m(shipping_mode)), "
    "scores AS (SELECT g.market, "
    + ", ".join(
        f"max(CASE WHEN g.shipping_mode = '{m}' THEN coalesce(c.p, a.p_mode) END) AS p_{k}" for m, k in D.KEY_OF.items()
    )
    + " FROM grid g LEFT JOIN cellsraw c ON c.shipping_mode = g.shipping_mode AND c.market = g.market "
    "LEFT JOIN modeavg a ON a.shipping_mode = g.shipping_mode GROUP BY g.market), "
    "drows AS (SELECT d.*, " + ", ".join(f"s.p_{k}" for k in K) + " FROM dpop d LEFT JOIN scores s ON s.market = d.market)"
)


def _scen_values(scenarios: list[tuple[str, D.Assumptions, str, float | None, int]]) -> str:
    rows = []
    for sid, a, param, level, idx in scenarios:
        rows.append(
            "("
            + ", ".join(
                [
                    f"'{sid}'",
                    f"'{param}'",
                    _f(level),
                    str(idx),
                    _f(a.late_penalty_fixed),
                    _f(a.late_penalty_rate),
                    _f(a.holding_rate_per_day),
                    _f(a.speed_value_per_day),
                    *[_f(a.freight_cost.get(m, 0.0)) for m in MODES],
                    _f(a.max_late_probability),
                ]
            )
            + ")"
        )
    cols = "scenario_id, parameter, level, level_index, s_fixed, s_rate, s_hold, s_speed, " + ", ".join(f"f_{k}" for k in K) + ", s_max_p"
    return f"(VALUES {', '.join(rows)}) sc({cols})"


def _cost_sql(k: str) -> str:
    t = f"coalesce(pw.t_{k}, 0.0)"
    v = "coalesce(r.value, 0.0)"
    return f"CASE WHEN pw.t_{k} IS NOT NULL AND r.p_{k} IS NOT NULL THEN f_{k} + r.p_{k} * (s_fixed + s_rate * {v}) + s_hold * {v} * {t} + s_speed * {t} END"


def costed_cte(scenarios, name: str = "dc") -> str:
    """Rows x scenarios with cost_<k>, feas_<k> (with the lowest-risk fallback)
    and a long form ``<name>_long``."""
    raw = ", ".join(
        f"{_cost_sql(k)} AS cost_{k}, (pw.t_{k} IS NOT NULL AND r.p_{k} IS NOT NULL AND (s_max_p IS NULL OR r.p_{k} <= s_max_p)) AS ok_{k}"
        for k in K
    )
    long_parts = " UNION ALL ".join(
        f"SELECT scenario_id, parameter, level, level_index, order_id, market, order_region, value, '{m}' AS mode, {i} AS mode_rank, "
        f"p_{k} AS p, cost_{k} AS cost, ok_{k} AS ok FROM {name}0 WHERE cost_{k} IS NOT NULL"
        for i, (m, k) in enumerate(D.KEY_OF.items())
    )
    return (
        f"{name}0 AS (SELECT sc.*, r.*, {raw} FROM drows r, pw, {_scen_values(scenarios)}), "
        f"{name}l0 AS ({long_parts}), "
        f"{name}_long AS (SELECT l.*, (ok OR (NOT bool_or(ok) OVER w AND row_number() OVER (PARTITION BY scenario_id, order_id ORDER BY p, mode_rank) = 1)) AS feas "
        f"FROM {name}l0 l WINDOW w AS (PARTITION BY scenario_id, order_id))"
    )


def _scen(sid: str, a: D.Assumptions, param: str = "", level=None, idx: int = 0):
    return (sid, a, param, level, idx)


def choices_cte(name: str = "dc") -> str:
    """Policy choices ``ch(scenario_id, letter, policy, mode, n_rows, cost_sum, p_sum)``."""
    seg = (
        "SELECT scenario_id, {seg} AS segment, mode, mode_rank, count(*) AS n, sum(cost) AS c, sum(p) AS ps, bool_and(feas) AS allf "
        f"FROM {{src}} GROUP BY scenario_id, {{seg}}, mode, mode_rank"
    )
    pick = (
        "SELECT scenario_id, '{letter}' AS letter, '{name}' AS policy, mode, n AS n_rows, c AS cost_sum, ps AS p_sum FROM ("
        "SELECT *, row_number() OVER (PARTITION BY scenario_id, segment ORDER BY CASE WHEN allf THEN 0 ELSE 1 END, "
        "CASE WHEN allf THEN c END, mode_rank) AS rk FROM ({seg_sql})) WHERE rk = 1"
    )
    b = pick.format(letter="B", name=D.POLICY_NAMES["B"], seg_sql=seg.format(seg="CAST(market AS VARCHAR)", src=f"{name}_long"))
    c = pick.format(letter="C", name=D.POLICY_NAMES["C"], seg_sql=seg.format(seg="CAST(order_region AS VARCHAR)", src=f"{name}_long"))
    e = pick.format(
        letter="E",
        name=D.POLICY_NAMES["E"],
        seg_sql=seg.format(seg="concat_ws('|', CAST(market AS VARCHAR), CAST(band AS VARCHAR))", src=f"{name}_banded"),
    )
    return (
        f"{name}_edges AS (SELECT scenario_id, list_filter(list_distinct([e1, e2, e3]), lambda x: x > e0 AND x < e4) AS inner_edges FROM ("
        f"SELECT scenario_id, quantile_cont(value, 0.0) AS e0, quantile_cont(value, 0.25) AS e1, quantile_cont(value, 0.5) AS e2, "
        f"quantile_cont(value, 0.75) AS e3, quantile_cont(value, 1.0) AS e4 FROM {name}0 WHERE value IS NOT NULL GROUP BY scenario_id)), "
        f"{name}_banded AS (SELECT l.*, len(list_filter(g.inner_edges, lambda x: x < coalesce(l.value, 0.0))) AS band "
        f"FROM {name}_long l LEFT JOIN {name}_edges g ON g.scenario_id = l.scenario_id), "
        f"{name}_pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, order_id ORDER BY CASE WHEN feas THEN 0 ELSE 1 END, cost, mode_rank) AS rk FROM {name}_long) WHERE rk = 1), "
        f"ch0 AS ("
        f"SELECT scenario_id, 'A' AS letter, 'single_mode:' || mode AS policy, mode, count(*) AS n_rows, sum(cost) AS cost_sum, sum(p) AS p_sum FROM {name}_long GROUP BY scenario_id, mode "
        f"UNION ALL {b} UNION ALL {c} "
        f"UNION ALL SELECT scenario_id, 'D', '{D.POLICY_NAMES['D']}', mode, count(*), sum(cost), sum(p) FROM {name}_pick GROUP BY scenario_id, mode "
        f"UNION ALL {e}), "
        f"ch AS (SELECT scenario_id, letter, policy, mode, sum(n_rows) AS n_rows, sum(cost_sum) AS cost_sum, sum(p_sum) AS p_sum FROM ch0 GROUP BY ALL)"
    )


SUMMARY_CTE = (
    "summ AS (SELECT scenario_id, letter, policy, sum(n_rows) AS n_rows, round(sum(cost_sum), 2) AS total_cost, "
    "round(sum(cost_sum) / sum(n_rows), 3) AS avg_cost, round(sum(p_sum) / sum(n_rows), 4) AS expected_late_rate, "
    "count(CASE WHEN n_rows > 0 THEN 1 END) AS n_modes_used FROM ch GROUP BY scenario_id, letter, policy), "
    "besta AS (SELECT scenario_id, arg_min(policy, (total_cost, list_position([" + ", ".join(f"'{m}'" for m in MODES) + "], split_part(policy, ':', 2)))) AS best_policy, min(total_cost) AS baseline FROM summ WHERE letter = 'A' GROUP BY scenario_id), "
    "cmp AS (SELECT s.scenario_id, s.letter, s.policy, s.n_rows, s.total_cost, s.avg_cost, s.expected_late_rate, s.n_modes_used, "
    "round(b.baseline - s.total_cost, 2) AS saving_vs_best_single, "
    "CASE WHEN b.baseline <> 0 THEN round(100 * (b.baseline - s.total_cost) / b.baseline, 2) ELSE 0.0 END AS saving_pct, "
    "CAST(row_number() OVER (PARTITION BY s.scenario_id ORDER BY s.total_cost, s.letter) AS BIGINT) AS rank, "
    f"CASE WHEN s.letter = 'A' THEN '{D.COMPLEXITY['A']}' WHEN s.letter IN ('B', 'C') THEN '{D.COMPLEXITY['B']}' "
    f"WHEN s.letter = 'E' THEN '{D.COMPLEXITY['E']}' ELSE '{D.COMPLEXITY['D']}' END AS complexity "
    "FROM summ s JOIN besta b ON b.scenario_id = s.scenario_id WHERE s.letter <> 'A' OR s.policy = b.best_policy)"
)


def _rows(spark, sf_dir):
    """Order frame, decision rows (scores joined, written once per session:
    every policy branch and scenario reads them) and the mode profile."""
    from shipcast.sources.materialize import materialized

    o = orders_frame(spark, sf_dir)
    rows = materialized(spark, "decision_rows", sf_dir, lambda: D.decision_rows(o))
    return o, rows, D.mode_profile(o)


#: share of orders, by hash, that the sampled outputs hold
SAMPLE_SHARE = 0.25
DEFAULT = D.resolve_assumptions()
CONSTRAINED = D.resolve_assumptions({"max_late_probability": CONSTRAINT_P})


@query("mode_profile", with_base("SELECT * FROM prof", BASE_CTE))
def q_mode_profile(spark, sf_dir):
    return D.mode_profile(orders_frame(spark, sf_dir))


@query(
    "counterfactual_scores",
    with_base(
        " UNION ALL ".join(f"SELECT order_id, '{m}' AS mode, round(p_{k}, 6) AS p_late FROM drows WHERE p_{k} IS NOT NULL" for m, k in D.KEY_OF.items()),
        BASE_CTE,
    ),
)
def q_counterfactual_scores(spark, sf_dir):
    _, rows, _ = _rows(spark, sf_dir)
    return D.counterfactual_scores(rows).withColumn("p_late", dround("p_late", 6))


@query(
    "expected_cost",
    with_base(
        "SELECT order_id, mode, round(p, 6) AS p_late, round(cost, 6) AS expected_total_cost FROM dc_long",
        BASE_CTE + ", " + costed_cte([_scen("default", DEFAULT)]),
    ),
)
def q_expected_cost(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    return D.expected_cost(rows, prof, DEFAULT).select(
        "order_id", "mode", dround("p_late", 6).alias("p_late"), dround("expected_total_cost", 6).alias("expected_total_cost")
    )


@query(
    "portfolio_costs",
    with_base(
        "SELECT mode, count(*) AS n_rows, round(sum(cost), 2) AS total_cost, round(avg(cost), 4) AS avg_cost FROM dc_long GROUP BY mode",
        BASE_CTE + ", " + costed_cte([_scen("default", DEFAULT)]),
    ),
)
def q_portfolio_costs(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    return (
        D.expected_cost(rows, prof, DEFAULT)
        .groupBy("mode")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            dround(F.sum("expected_total_cost"), 2).alias("total_cost"),
            dround(F.avg("expected_total_cost"), 4).alias("avg_cost"),
        )
    )


def _cmp_sql(a: D.Assumptions) -> str:
    maxp = _f(a.max_late_probability)
    body = (
        "SELECT l.order_id, rec.mode AS recommended, round(rec.cost, 2) AS recommended_cost, "
        "round(round(st.cost, 2) - round(rec.cost, 2), 2) AS saving_vs_standard, "
        "(agg.n_ok > 0 AND agg.n_ok < agg.n_present) AS constrained, l.mode, "
        "CAST(row_number() OVER (PARTITION BY l.order_id ORDER BY round(l.cost, 2), l.mode_rank) AS BIGINT) AS cost_rank, "
        "round(l.p, 4) AS p_late, round(l.f, 2) AS freight, round(l.delay, 2) AS expected_delay_cost, round(l.hold, 2) AS holding_cost, "
        "round(l.speed, 2) AS speed_cost, round(l.cost, 2) AS expected_total_cost, l.t AS mean_transit_days, round(l.pen, 2) AS penalty_if_late, "
        "l.ok AS feasible, CASE WHEN l.ok THEN '' ELSE 'late_risk_above_limit' END AS infeasible_reason, round(l.profit_k - l.cost, 2) AS expected_net "
        "FROM cl l JOIN agg ON agg.order_id = l.order_id "
        "JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, round(cost, 2), mode_rank) AS rk FROM cl) WHERE rk = 1) rec ON rec.order_id = l.order_id "
        "LEFT JOIN (SELECT order_id, cost FROM cl WHERE mode = 'Standard Class') st ON st.order_id = l.order_id"
    )
    parts = []
    for i, (m, k) in enumerate(D.KEY_OF.items()):
        t = f"coalesce(pw.t_{k}, 0.0)"
        v = "coalesce(r.value, 0.0)"
        parts.append(
            f"SELECT r.order_id, r.profit_k, '{m}' AS mode, {i} AS mode_rank, r.p_{k} AS p, {_f(a.freight_cost[m])} AS f, "
            f"({_f(a.late_penalty_fixed)} + {_f(a.late_penalty_rate)} * {v}) AS pen, "
            f"r.p_{k} * ({_f(a.late_penalty_fixed)} + {_f(a.late_penalty_rate)} * {v}) AS delay, "
            f"{_f(a.holding_rate_per_day)} * {v} * {t} AS hold, {_f(a.speed_value_per_day)} * {t} AS speed, {t} AS t, "
            f"{_f(a.freight_cost[m])} + r.p_{k} * ({_f(a.late_penalty_fixed)} + {_f(a.late_penalty_rate)} * {v}) + "
            f"{_f(a.holding_rate_per_day)} * {v} * {t} + {_f(a.speed_value_per_day)} * {t} AS cost, "
            f"({maxp} IS NULL OR r.p_{k} <= {maxp}) AS ok FROM drows r, pw WHERE pw.t_{k} IS NOT NULL AND r.p_{k} IS NOT NULL"
        )
    extra = (
        BASE_CTE
        + ", cl AS ("
        + " UNION ALL ".join(parts)
        + "), agg AS (SELECT order_id, count(*) AS n_present, count(CASE WHEN ok THEN 1 END) AS n_ok FROM cl GROUP BY order_id)"
    )
    return with_base(body, extra)


@query("compare_modes", _cmp_sql(CONSTRAINED))
def q_compare_modes(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    return D.compare_modes(rows, prof, CONSTRAINED)


def _policy_sql(scen, letters: str) -> str:
    where = " OR ".join(f"letter = '{x}'" for x in letters)
    return with_base(
        f"SELECT policy, mode, CAST(n_rows AS BIGINT) AS n_rows, round(cost_sum, 2) AS cost_sum, round(p_sum, 4) AS p_sum FROM ch WHERE {where}",
        BASE_CTE + ", " + costed_cte([scen]) + ", " + choices_cte(),
    )


def _policy_spark(spark, sf_dir, a, letters):
    _, rows, prof = _rows(spark, sf_dir)
    ch = D.evaluate(rows, prof, [D.scenario_struct("default", a)], policies=letters)
    return ch.select(
        "policy", "mode", F.col("n_rows").cast("bigint").alias("n_rows"), dround("cost_sum", 2).alias("cost_sum"), dround("p_sum", 4).alias("p_sum")
    )


@query("policy_single", _policy_sql(_scen("default", DEFAULT), "A"))
def q_policy_single(spark, sf_dir):
    return _policy_spark(spark, sf_dir, DEFAULT, "A")


@query("policy_market", _policy_sql(_scen("default", DEFAULT), "B"))
def q_policy_market(spark, sf_dir):
    return _policy_spark(spark, sf_dir, DEFAULT, "B")


@query("policy_region", _policy_sql(_scen("default", DEFAULT), "C"))
def q_policy_region(spark, sf_dir):
    return _policy_spark(spark, sf_dir, DEFAULT, "C")


@query("policy_risk", _policy_sql(_scen("default", DEFAULT), "D"))
def q_policy_risk(spark, sf_dir):
    return _policy_spark(spark, sf_dir, DEFAULT, "D")


@query("policy_segment_band", _policy_sql(_scen("default", DEFAULT), "E"))
def q_policy_segment_band(spark, sf_dir):
    return _policy_spark(spark, sf_dir, DEFAULT, "E")


@query("policy_constraint", _policy_sql(_scen("constrained", CONSTRAINED), "ABCDE"))
def q_policy_constraint(spark, sf_dir):
    return _policy_spark(spark, sf_dir, CONSTRAINED, "ABCDE")


_CMP_COLS = "scenario_id, policy, n_rows, total_cost, avg_cost, expected_late_rate, n_modes_used, saving_vs_best_single, saving_pct, rank, complexity"


@query(
    "policy_compare",
    with_base(f"SELECT {_CMP_COLS} FROM cmp", BASE_CTE + ", " + costed_cte([_scen("default", DEFAULT)]) + ", " + choices_cte() + ", " + SUMMARY_CTE),
)
def q_policy_compare(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    return D.policy_compare(D.evaluate(rows, prof, [D.scenario_struct("default", DEFAULT)])).select(*_CMP_COLS.split(", "))


SCENARIO_SET = [
    _scen("default", DEFAULT),
    _scen("preset_low", D.apply_preset("low")),
    _scen("preset_medium", D.apply_preset("medium")),
    _scen("preset_high", D.apply_preset("high")),
    _scen("constrained", CONSTRAINED),
]


@query(
    "scenario_run",
    with_base(f"SELECT {_CMP_COLS} FROM cmp", BASE_CTE + ", " + costed_cte(SCENARIO_SET) + ", " + choices_cte() + ", " + SUMMARY_CTE),
)
def q_scenario_run(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    scen = [D.scenario_struct(sid, a, p, lv, i) for sid, a, p, lv, i in SCENARIO_SET]
    return D.policy_compare(D.evaluate(rows, prof, scen)).select(*_CMP_COLS.split(", "))


def _sweep_set(sweeps: dict = D.SWEEPS):
    out = []
    for parameter, levels in sweeps.items():
        for i, level in enumerate(levels):
            a = D.with_parameter(DEFAULT, parameter, level)
            out.append(_scen(f"{parameter}={level}", a, parameter, float(level), i))
    return out


SENS_CTE = (
    "sp AS (SELECT scenario_id, parameter, level, level_index, mode, mode_rank, count(*) AS n, sum(cost) AS c, sum(p) AS ps FROM dc_pick "
    "GROUP BY ALL), sens AS (SELECT parameter, CAST(level_index AS BIGINT) AS level_index, round(level, 5) AS value, "
    "round(sum(c), 2) AS total_cost, round(sum(c) / sum(n), 3) AS avg_cost, round(sum(ps) / sum(n), 4) AS expected_late_rate, "
    "arg_max(mode, (n, -mode_rank)) AS dominant_mode, round(max(n) / sum(n), 4) AS dominant_share, "
    + ", ".join(f"round(sum(CASE WHEN mode = '{m}' THEN n ELSE 0 END) / sum(n), 4) AS share_{k}" for m, k in D.KEY_OF.items())
    + " FROM sp GROUP BY parameter, level, level_index)"
)
_SENS_EXTRA = BASE_CTE + ", " + costed_cte(_sweep_set()) + ", " + choices_cte() + ", " + SENS_CTE


@query("sensitivity", with_base("SELECT * FROM sens", _SENS_EXTRA))
def q_sensitivity(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    return D.sensitivity(rows, prof)


@query(
    "sensitivity_freight",
    with_base(
        "SELECT * FROM sens", BASE_CTE + ", " + costed_cte(_sweep_set(D.FREIGHT_SWEEPS)) + ", " + choices_cte() + ", " + SENS_CTE
    ),
)
def q_sensitivity_freight(spark, sf_dir):
    """Mode mix per level of each mode's freight."""
    _, rows, prof = _rows(spark, sf_dir)
    return D.sensitivity(rows, prof, sweeps=D.FREIGHT_SWEEPS)


@query(
    "switch_points",
    with_base(
        "SELECT c.parameter, c.n_switches, (c.n_switches = 0) AS stable, s.from_mode, s.to_mode, s.at_value FROM "
        "(SELECT p.parameter, CAST(coalesce(x.n, 0) AS BIGINT) AS n_switches FROM (SELECT DISTINCT parameter FROM sens) p "
        "LEFT JOIN (SELECT parameter, count(*) AS n FROM sw GROUP BY parameter) x ON x.parameter = p.parameter) c "
        "LEFT JOIN sw s ON s.parameter = c.parameter",
        _SENS_EXTRA
        + ", sw AS (SELECT parameter, prev AS from_mode, dominant_mode AS to_mode, value AS at_value FROM ("
        "SELECT *, lag(dominant_mode) OVER (PARTITION BY parameter ORDER BY level_index) AS prev FROM sens) "
        "WHERE prev IS NOT NULL AND prev <> dominant_mode)",
    ),
)
def q_switch_points(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    return D.switch_points(D.sensitivity(rows, prof))


_DEG_SET = [
    _scen("degenerate", D.resolve_assumptions({"holding_rate_per_day": 0.0, "speed_value_per_day": 0.0})),
    _scen("full", DEFAULT),
]


@query(
    "degeneracy",
    with_base(
        "SELECT m.scenario_id AS scenario, m.mode, m.share, d.dominant_mode, d.dominant_share, (d.dominant_share >= 0.99) AS is_degenerate "
        "FROM mix m JOIN (SELECT scenario_id, arg_max(mode, (n_rows, -list_position([" + ", ".join(f"'{m}'" for m in MODES) + "], mode))) AS dominant_mode, max(share) AS dominant_share FROM mix GROUP BY scenario_id) d "
        "ON d.scenario_id = m.scenario_id",
        BASE_CTE + ", " + costed_cte(_DEG_SET) + ", " + choices_cte()
        + ", mix AS (SELECT scenario_id, mode, n_rows, round(n_rows / sum(n_rows) OVER (PARTITION BY scenario_id), 4) AS share FROM ch WHERE letter = 'D')",
    ),
)
def q_degeneracy(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    return D.degeneracy(rows, prof)


def _median_value_col(rows):
    return exact_quantiles(rows, "value", [0.5], names=["q"]).select("q").scalar()


def _break_even_sql(a: D.Assumptions) -> str:
    return with_base(_break_even_body(a), BASE_CTE)


def _break_even_body(a: D.Assumptions) -> str:
    fr = lambda col: "CASE " + col + " " + " ".join(f"WHEN '{m}' THEN {_f(a.freight_cost[m])}" for m in MODES) + " ELSE 0.0::DOUBLE END"
    pen = f"({_f(a.late_penalty_fixed)} + {_f(a.late_penalty_rate)} * mv.v)"
    h, s = _f(a.holding_rate_per_day), _f(a.speed_value_per_day)

    def tot(fc, p, t):
        return f"({fr(fc)} + {p} * {pen} + {h} * mv.v * {t} + {s} * {t})"

    gap = f"(({fr('to_mode')} + {h} * mv.v * t_to + {s} * t_to) - ({fr('from_mode')} + {h} * mv.v * t_from + {s} * t_from))"
    be = f"(CASE WHEN {pen} <> 0 THEN p_to + {gap} / {pen} END)"
    verdict = f"CASE WHEN {be} IS NULL THEN 'not_computable' WHEN {be} > 1 THEN 'never' WHEN {be} < 0 THEN 'always' ELSE 'threshold' END"
    ladder = ", ".join(f"('{f}', '{t}', {i})" for i, (f, t) in enumerate(D.LADDER))
    return (
        f"SELECT from_mode, to_mode, CAST(step AS BIGINT) AS step, round(p_from, 4) AS observed_p_from, round(p_to, 4) AS observed_p_to, "
        f"round({fr('to_mode')} - {fr('from_mode')}, 2) AS incremental_freight, round({be}, 4) AS break_even_p, "
        f"round({tot('from_mode', 'p_from', 't_from')}, 2) AS cost_from, round({tot('to_mode', 'p_to', 't_to')}, 2) AS cost_to, "
        f"({tot('from_mode', 'p_from', 't_from')} > {tot('to_mode', 'p_to', 't_to')}) AS worthwhile, {verdict} AS verdict, "
        f"CASE WHEN {verdict} = 'threshold' THEN p_from > {be} END AS justified "
        f"FROM (VALUES {ladder}) lad(from_mode, to_mode, step) "
        "JOIN (SELECT mode AS fm, late_rate AS p_from, mean_transit AS t_from FROM prof) a ON a.fm = lad.from_mode "
        "JOIN (SELECT mode AS tm, late_rate AS p_to, mean_transit AS t_to FROM prof) b ON b.tm = lad.to_mode, "
        "(SELECT median(value) AS v FROM drows) mv"
    )


@query("break_even", _break_even_sql(DEFAULT))
def q_break_even(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    return D.break_even(prof, _median_value_col(rows), DEFAULT)


@query(
    "scenario_break_even",
    with_base(
        " UNION ALL ".join(
            f"SELECT '{sid}' AS scenario_id, x.*, round(mv.v, 5) AS median_order_value FROM ({_break_even_body(a)}) x CROSS JOIN mv" for sid, a, *_ in SCENARIO_SET
        ),
        BASE_CTE + ", mv AS (SELECT median(value) AS v FROM drows)",
    ),
)
def q_scenario_break_even(spark, sf_dir):
    """The upgrade ladder of every scenario at the median order value."""
    _, rows, prof = _rows(spark, sf_dir)
    held = spark.createDataFrame(prof.collect(), prof.schema)  # a row per mode, read once for all scenarios
    value = F.lit(exact_quantiles(rows, "value", [0.5], names=["q"]).first()["q"])
    parts = [
        D.break_even(held, value, a).select(F.lit(sid).alias("scenario_id"), "*", dround(value, 5).alias("median_order_value")) for sid, a, *_ in SCENARIO_SET
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query(
    "promise_redesign",
    with_base(
        "SELECT (t_sec IS NOT NULL AND t_std IS NOT NULL) AS available, round(abs(t_sec - t_std), 4) AS transit_gap_days, "
        "abs(t_sec - t_std) < 0.05 AS transit_identical, l_sec AS current_late_rate, l_std AS implied_late_rate, "
        "round(l_sec - l_std, 4) AS late_rate_reduction, CAST(o_sec AS BIGINT) AS orders_affected, "
        "CAST(d_sec AS BIGINT) AS promised_second, CAST(d_std AS BIGINT) AS promised_standard FROM pw",
        BASE_CTE,
    ),
)
def q_promise_redesign(spark, sf_dir):
    return D.promise_redesign(D.mode_profile(orders_frame(spark, sf_dir)))


def _engine_sql(a: D.Assumptions) -> str:
    parts = []
    for m, k in D.KEY_OF.items():
        t = f"coalesce(pw.t_{k}, 0.0)"
        pen = f"({_f(a.late_penalty_fixed)} + {_f(a.late_penalty_rate)} * mv.v)"
        parts.append(
            f"SELECT '{m}' AS mode, round(mp.p_{k}, 4) AS mean_p_late, round({_f(a.freight_cost[m])}, 2) AS freight, "
            f"round(mp.p_{k} * {pen}, 2) AS expected_delay_cost, round({_f(a.holding_rate_per_day)} * mv.v * {t}, 2) AS holding_cost, "
            f"round({_f(a.speed_value_per_day)} * {t}, 2) AS speed_cost, "
            f"round({_f(a.freight_cost[m])} + mp.p_{k} * {pen} + {_f(a.holding_rate_per_day)} * mv.v * {t} + {_f(a.speed_value_per_day)} * {t}, 2) AS expected_total_cost "
            f"FROM pw, mp, mv WHERE pw.t_{k} IS NOT NULL"
        )
    return with_base(
        " UNION ALL ".join(parts),
        BASE_CTE + ", mp AS (SELECT " + ", ".join(f"avg(p_{k}) AS p_{k}" for k in K) + " FROM drows), mv AS (SELECT median(value) AS v FROM drows)",
    )


@query("engine_table", _engine_sql(DEFAULT))
def q_engine_table(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    return D.engine_table(rows, prof, DEFAULT, _median_value_col(rows))


_CURP = "CASE shipping_mode " + " ".join(f"WHEN '{m}' THEN p_{k}" for m, k in D.KEY_OF.items()) + " END"
_BAND = f"CASE WHEN cp IS NULL THEN 'unknown' WHEN cp < {D.RISK_LOW} THEN 'Low' WHEN cp < {D.RISK_HIGH} THEN 'Medium' ELSE 'High' END"


@query(
    "risk_band",
    with_base(f"SELECT order_id, round(cp, 4) AS p_late, {_BAND} AS risk_band FROM (SELECT *, {_CURP} AS cp FROM drows)", BASE_CTE),
)
def q_risk_band(spark, sf_dir):
    _, rows, _ = _rows(spark, sf_dir)
    p = D.current_p(rows)
    return rows.select("order_id", dround(p, 4).alias("p_late"), D.risk_band(p).alias("risk_band"))


_BEST = (
    "(SELECT arg_min(m, (pp, i)) FROM (VALUES "
    + ", ".join(f"('{m}', p_{k}, {i})" for i, (m, k) in enumerate(D.KEY_OF.items()))
    + ") t(m, pp, i) WHERE pp IS NOT NULL)"
)
_BESTP = "least(" + ", ".join(f"coalesce(p_{k}, 9e9)" for k in K) + ")"


@query(
    "risk_drivers",
    with_base(
        "SELECT order_id, shipping_mode, round(cp, 4) AS p_late, "
        + _BAND.replace("cp", "cp")
        + " AS risk_band, hi AS high_delay_risk, tight AS promise_tighter_than_transit, better AS lower_risk_mode_available, "
        "CASE WHEN better THEN bm END AS lower_risk_mode, "
        "CASE WHEN NOT (hi OR tight OR better) THEN 'none' ELSE concat_ws(',', CASE WHEN hi THEN 'high_delay_risk' END, "
        "CASE WHEN tight THEN 'promise_tighter_than_transit' END, CASE WHEN better THEN 'lower_risk_mode_available' END) END AS drivers "
        "FROM (SELECT *, (cp IS NOT NULL AND cp >= 0.6) AS hi, (prom IS NOT NULL AND tr IS NOT NULL AND tr > prom) AS tight, "
        "(cp IS NOT NULL AND bp < cp - 0.05) AS better FROM (SELECT r.*, "
        + _CURP
        + " AS cp, "
        + _BESTP
        + " AS bp, "
        + _BEST
        + " AS bm, CASE r.shipping_mode "
        + " ".join(f"WHEN '{m}' THEN pw.d_{k}" for m, k in D.KEY_OF.items())
        + " END AS prom, CASE r.shipping_mode "
        + " ".join(f"WHEN '{m}' THEN pw.t_{k}" for m, k in D.KEY_OF.items())
        + " END AS tr FROM drows r, pw))",
        BASE_CTE,
    ),
)
def q_risk_drivers(spark, sf_dir):
    _, rows, prof = _rows(spark, sf_dir)
    return D.risk_drivers(rows, prof)


_MATRIX_CTE = (
    BASE_CTE
    + f", rm0 AS (SELECT order_id, value AS x, {_CURP} AS p FROM drows), rm1 AS (SELECT * FROM rm0 WHERE x IS NOT NULL AND p IS NOT NULL), "
    "med AS (SELECT median(x) AS vm, median(p) AS pm FROM rm1), "
    "rm AS (SELECT order_id, x, p, CASE WHEN p >= pm AND x >= vm THEN 'Prioritise' WHEN p >= pm THEN 'Watch / manage' "
    "WHEN x >= vm THEN 'Protect' ELSE 'Routine' END AS quadrant, round(vm, 2) AS value_median, round(pm, 4) AS risk_median FROM rm1, med)"
)


@query("risk_matrix", with_base("SELECT order_id, round(x, 6) AS x, round(p, 6) AS p, quadrant, value_median, risk_median FROM rm", _MATRIX_CTE))
def q_risk_matrix(spark, sf_dir):
    _, rows, _ = _rows(spark, sf_dir)
    return D.risk_matrix(rows).withColumn("x", dround("x", 6)).withColumn("p", dround("p", 6))


@query(
    "risk_matrix_summary",
    with_base("SELECT quadrant, count(*) AS orders, round(avg(p), 4) AS avg_risk, round(avg(x), 2) AS avg_value FROM rm GROUP BY quadrant", _MATRIX_CTE),
)
def q_risk_matrix_summary(spark, sf_dir):
    _, rows, _ = _rows(spark, sf_dir)
    return D.risk_matrix_summary(D.risk_matrix(rows))


@query(
    "risk_matrix_points",
    with_base(
        "SELECT order_id, round(x, 2) AS x, round(p, 4) AS y, quadrant FROM rm "
        f"WHERE ((order_id % 1000003) * 7919 + 42) % 1000003 < {SAMPLE_SHARE} * 1000003",
        _MATRIX_CTE,
    ),
)
def q_risk_matrix_points(spark, sf_dir):
    _, rows, _ = _rows(spark, sf_dir)
    m = D.risk_matrix(rows)
    return (
        m.where(D.seeded_order(F.col("order_id")) < SAMPLE_SHARE * 1000003)
        .select("order_id", dround("x", 2).alias("x"), dround("p", 4).alias("y"), "quadrant")
    )
