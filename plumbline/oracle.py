"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

from .functions.power import min_horizon, needed_evidence
from .functions.student import dead_zone_factor

SQL: dict[str, str] = {}

PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
CUM = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def obs(shift: float = 0.0, name: str = "obs") -> str:
    """Monthly discounts as observations."""
    return f"""{name} AS (
      SELECT kind, run_index, item_id, CASE WHEN kind = 'system' AND run_index >= 40 THEN least(greatest(s + {shift}, 0), 1) ELSE s END AS score
      FROM (SELECT CASE WHEN l_suppkey % 20 < 10 THEN 'system' ELSE 'anchor' END AS kind,
              ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS run_index,
              (l_suppkey % 20)::VARCHAR AS item_id, avg(l_discount) / 0.1 AS s
            FROM lineitem GROUP BY ALL))"""


def run_tables(first: str) -> str:
    """ranked, base, devs over obs; first: how many runs of a kind are held out."""
    return f"""
      ranked AS (SELECT kind, run_index, count(*) AS n, avg(score) AS mean, row_number() OVER (PARTITION BY kind ORDER BY run_index) - 1 AS place FROM obs GROUP BY kind, run_index),
      base AS (SELECT o.kind, o.item_id, avg(o.score) AS base FROM obs o JOIN ranked r USING (kind, run_index) WHERE r.place < {first} GROUP BY ALL),
      devs AS (SELECT r.kind, r.run_index, r.place, r.n, coalesce(avg(o.score - b.base), 0) AS dev FROM ranked r JOIN obs o USING (kind, run_index) LEFT JOIN base b USING (kind, item_id) GROUP BY ALL)"""


ONE_KIND = "obs AS (SELECT 'system' AS kind, run_index, item_id, score FROM obs0)"
LEG = f"""WITH {obs(name="obs0")}, {ONE_KIND}, {run_tables("8")},
      held AS (SELECT greatest(stddev_samp(dev), 1e-6) AS sd FROM devs WHERE place < 8),
      wide AS (SELECT sd, greatest(0.05, 4 * sd) AS w, sd * {dead_zone_factor(8, 0.05)!r} / (2 * greatest(0.05, 4 * sd)) AS half FROM held),
      leg AS (SELECT 'system' AS leg, place - 8 AS t, least(greatest(0.5 + dev / (2 * w), 0), 1) AS z, greatest(0, 0.5 - half) AS lo, least(1, 0.5 + half) AS hi FROM devs, wide WHERE place >= 8)"""


def betting(source: str, keys: str, x: str, mu_up: str, mu_down: str, bet: str = "agrapa", prefix: str = "w") -> str:
    """CTEs {prefix}1..4 over source: both sides' bets and log wealth. keys end in a comma where not empty."""
    over = lambda frame: f"OVER (PARTITION BY {keys} ORDER BY t {frame})" if keys else f"OVER (ORDER BY t {frame})"
    at = f"row_number() {over('')} - 1"

    def raw(mu: str) -> str:
        return {"agrapa": f"(mean - {mu}) / (var + (mean - {mu}) * (mean - {mu}))", "predmix": "least(sqrt(2 * ln(20) / ((k + 1) * ln(2 + k) * var)), 0.5)", "fixed": "0.5"}[bet]

    return f"""
      {prefix}1 AS (SELECT *, {at} AS k FROM {source}),
      {prefix}2 AS (SELECT *, (0.5 + coalesce(sum({x}) {over(PAST)}, 0)) / (k + 1) AS mean, pow({x} - (0.5 + sum({x}) {over(CUM)}) / (k + 2), 2) AS dv FROM {prefix}1),
      {prefix}3 AS (SELECT *, (0.25 + coalesce(sum(dv) {over(PAST)}, 0)) / (k + 1) AS var FROM {prefix}2),
      {prefix}4 AS (SELECT *, least(greatest({raw(mu_up)}, 0), 0.5 / {mu_up}) AS bet_up, least(greatest({raw(mu_down)}, -0.5 / (1 - {mu_down})), 0) AS bet_down FROM {prefix}3),
      {prefix}5 AS (SELECT *, sum(ln(1 + bet_up * ({x} - {mu_up}))) {over(CUM)} AS up, sum(ln(1 + bet_down * ({x} - {mu_down}))) {over(CUM)} AS down FROM {prefix}4),
      {prefix} AS (SELECT *, greatest(up, down) + ln(0.5) AS log_e FROM {prefix}5)"""


def clip(mu: str) -> str:
    return f"least(greatest({mu}, 1e-6), 1 - 1e-6)"


def detector(source: str) -> str:
    """CTE trace over source (leg, t, z, lo, hi)."""
    return f"""
      live AS (SELECT s.leg, s.t, s.z, s.lo, s.hi, unnest(range(0, s.t + 1)) AS j FROM {source} s),
      {betting("live", "leg, j", "z", clip("hi"), clip("lo"), prefix="d")},
      weighed AS (SELECT *, log_e - ln(j + 1) - ln(j + 2) AS v, max(log_e - ln(j + 1) - ln(j + 2)) OVER (PARTITION BY leg, t) AS top FROM d),
      joint AS (SELECT leg, t, first(top) + ln(sum(exp(v - top))) AS log_e, arg_max(struct_pack(j := j, rising := up >= down), struct_pack(e := log_e, b := -j)) AS best FROM weighed GROUP BY leg, t),
      trace AS (SELECT leg, t, log_e, max(log_e) OVER (PARTITION BY leg ORDER BY t {CUM}) AS peak, best.j AS best_start, CASE WHEN best.rising THEN 'up' ELSE 'down' END AS direction FROM joint)"""


def bernstein(source: str, x: str, alpha: float, out: str, keys: str = "leg") -> str:
    """CTE out over source: the lower bound at alpha."""
    over = lambda frame: f"OVER (PARTITION BY {keys} ORDER BY t {frame})"
    bet = f"least(sqrt(2 * ln({1 / alpha!r}) / (n * ln(1 + n) * coalesce(lag(s2) {over('')}, 0.25))), 0.5)"
    return f"""
      {out}1 AS (SELECT *, {x} AS x, row_number() {over('')} AS n FROM {source}),
      {out}2 AS (SELECT *, least((0.5 + sum(x) {over(CUM)}) / (n + 1), 1) AS mu, least(avg(x) {over(CUM)}, 1) AS run FROM {out}1),
      {out}3 AS (SELECT *, (0.25 + sum(pow(x - mu, 2)) {over(CUM)}) / (n + 1) AS s2 FROM {out}2),
      {out}4 AS (SELECT *, {bet} AS bet, pow(x - coalesce(lag(run) {over('')}, 0), 2) AS v FROM {out}3),
      {out}5 AS (SELECT *, greatest(sum(bet * x) {over(CUM)} / sum(bet) {over(CUM)} - (ln({1 / alpha!r}) + sum(v * (-ln(1 - bet) - bet)) {over(CUM)}) / sum(bet) {over(CUM)}, 0) AS bound FROM {out}4),
      {out} AS (SELECT {keys}, t, max(bound) {over(CUM)} AS bound FROM {out}5)"""


SQL["run_means"] = f"""WITH {obs()} SELECT kind, run_index, count(*) AS n, round(avg(score), 6) AS mean,
  sha256('[' || string_agg('"' || item_id || '"', ',' ORDER BY item_id) || ']') AS suite_hash FROM obs GROUP BY kind, run_index"""
SQL["item_baseline"] = f"WITH {obs()}, {run_tables('8')} SELECT kind, item_id, round(base, 6) AS base FROM base"
SQL["run_deviations"] = f"WITH {obs()}, {run_tables('8')} SELECT kind, run_index, round(dev, 6) AS dev FROM devs"

FLOOR = """
      fl_item AS (SELECT item_id, var_samp(score) AS v FROM obs WHERE kind = 'anchor' AND run_index < 5 GROUP BY item_id),
      fl_run AS (SELECT run_index, avg(score) AS m FROM obs WHERE kind = 'anchor' AND run_index < 5 GROUP BY run_index),
      fl AS (SELECT greatest((SELECT sqrt(avg(v)) FROM fl_item), 1e-6) AS item_sd, greatest((SELECT stddev_samp(m) FROM fl_run), 1e-6) AS run_sd, (SELECT count(*) FROM fl_item) AS n_items)"""
HOLD = "(CASE WHEN kind = 'anchor' THEN 5 ELSE 8 END)"


def legs(alpha: float = 0.05) -> str:
    """CTE legs over obs: the three legs with their SDs and dead zone factors at alpha."""
    return f"""{run_tables(HOLD)}, {FLOOR},
      sys_sd AS (SELECT greatest(stddev_samp(dev), 1e-6) AS sd FROM devs WHERE kind = 'system' AND place < 8),
      s AS (SELECT run_index, place - 8 AS t, dev FROM devs WHERE kind = 'system' AND place >= 8),
      a AS (SELECT run_index, place - 5 AS t, dev FROM devs WHERE kind = 'anchor' AND place >= 5),
      legs AS (
        SELECT 'system' AS leg, t, run_index, dev, (SELECT sd FROM sys_sd) AS sd, {dead_zone_factor(8, alpha)!r} AS f FROM s UNION ALL
        SELECT 'anchor', t, run_index, dev, (SELECT run_sd FROM fl), {dead_zone_factor(5, alpha)!r} FROM a UNION ALL
        SELECT 'corrected', row_number() OVER (ORDER BY run_index) - 1, run_index, s.dev - a.dev, sqrt(pow((SELECT sd FROM sys_sd), 2) + pow((SELECT run_sd FROM fl), 2)), {dead_zone_factor(5, alpha)!r} FROM s JOIN a USING (run_index))"""


SQL["paired_difference"] = f"WITH {obs()}, {legs()} SELECT t, run_index, round(dev, 6) AS dev, round(sd, 6) AS sd, 5::BIGINT AS k FROM legs WHERE leg = 'corrected'"

REPLICATES = "r AS (SELECT (event_id % 5)::INT AS k, user_id % 20 AS item, avg(value) / 1000 AS s FROM events GROUP BY ALL)"
SQL["noise_floor"] = f"""WITH {REPLICATES}, i AS (SELECT item, var_samp(s) AS v, count(*) AS c, max(s) > min(s) AS moved FROM r GROUP BY item), m AS (SELECT k, avg(s) AS m FROM r GROUP BY k),
  x AS (SELECT sqrt(avg(v)) AS sd, count(*) AS n, min(c) AS least, count(*) FILTER (moved) AS unstable FROM i), y AS (SELECT stddev_samp(m) AS sd, count(*) AS k, max(m) - min(m) AS span FROM m)
  SELECT round(x.sd, 6) AS per_item_sd, round(y.sd, 6) AS run_mean_sd, round(y.span, 6) AS run_mean_range, round(y.sd * sqrt(x.n) / x.sd, 6) AS independence_ratio,
    y.k AS replicates, x.n AS n_items, x.unstable AS unstable_items, y.sd <= 0 AS degenerate, x.least = y.k AS same_items FROM x, y"""
SQL["pairwise_agreement"] = f"""WITH {REPLICATES} SELECT round(avg(abs(a.s - b.s)), 6) AS mean_abs_diff, round(max(abs(a.s - b.s)), 6) AS max_diff,
  round(avg((a.s = b.s)::INT), 6) AS agreement, count(*) AS comparisons FROM r a JOIN r b ON a.item = b.item AND a.k < b.k"""

for _name in ("agrapa", "predmix", "fixed"):
    SQL[f"wealth_{_name}"] = f"""{LEG}, {betting("leg", "", "z", "0.5", "0.5", _name)}
      SELECT t, round(bet_up, 6) AS bet_up, round(bet_down, 6) AS bet_down, round(up, 6) AS up, round(down, 6) AS down, round(log_e, 6) AS log_wealth FROM w"""
SQL["composite_wealth"] = f"{LEG}, {betting('leg', '', 'z', clip('hi'), clip('lo'))} SELECT t, round(up, 6) AS up, round(down, 6) AS down, round(log_e, 6) AS log_e FROM w"
SQL["edetector_trace"] = f"{LEG}, {detector('leg')} SELECT t, round(log_e, 6) AS log_e, round(peak, 6) AS peak_log_e, peak >= ln(40) AS alarm, best_start, direction FROM trace"
SQL["arrow_detector"] = SQL["streamed_detector"] = SQL["edetector_trace"]
SQL["edetector_alarm"] = f"""{LEG}, shifted AS (SELECT leg, t, least(1, greatest(0, z - CASE WHEN t >= 30 THEN 0.3 ELSE 0 END)) AS z, lo, hi FROM leg), {detector('shifted')}
  SELECT leg, min(t) FILTER (peak >= ln(40)) AS alarm_at, round(max(peak), 6) AS peak_log_e FROM trace GROUP BY leg"""
SQL["eb_confidence_sequence"] = f"""{LEG}, {bernstein("leg", "z", 0.0125, "l")}, {bernstein("leg", "1 - z", 0.0125, "u")}
  SELECT t, round(l.bound, 6) AS cs_lo, round(1 - u.bound, 6) AS cs_hi FROM l JOIN u USING (leg, t)"""


def hedged(source: str, alpha: float, breaks: int) -> str:
    """CTE cs over source (t, z): hedged confidence sequence on a grid."""
    half = alpha / 2
    return f"""
      h1 AS (SELECT t, z, row_number() OVER (ORDER BY t) AS n FROM {source}),
      h2 AS (SELECT *, least((0.5 + sum(z) OVER (ORDER BY t {CUM})) / (n + 1), 1) AS mu FROM h1),
      h3 AS (SELECT *, (0.25 + sum(pow(z - mu, 2)) OVER (ORDER BY t {CUM})) / (n + 1) AS s2 FROM h2),
      h4 AS (SELECT *, sqrt(2 * ln({1 / half!r}) / (n * ln(1 + n) * coalesce(lag(s2) OVER (ORDER BY t), 0.25))) AS bet FROM h3),
      h5 AS (SELECT t, z, bet, m FROM h4, (SELECT unnest(range(1, {breaks})) / {float(breaks)!r} AS m)),
      h6 AS (SELECT t, m, greatest(sum(ln(1 + least(bet, 0.5 / m) * (z - m))) OVER w, sum(ln(1 - least(bet, 0.5 / (1 - m)) * (z - m))) OVER w) + ln(0.5) AS capital FROM h5 WINDOW w AS (PARTITION BY m ORDER BY t {CUM})),
      h7 AS (SELECT t, min(m) FILTER (capital <= ln({1 / alpha!r}) + 1e-10) AS lo, max(m) FILTER (capital <= ln({1 / alpha!r}) + 1e-10) AS hi FROM h6 GROUP BY t),
      h8 AS (SELECT t, max(coalesce(greatest(lo - {1 / breaks!r}, 0), 0)) OVER (ORDER BY t {CUM}) AS lo, min(coalesce(least(hi + {1 / breaks!r}, 1), 1)) OVER (ORDER BY t {CUM}) AS hi FROM h7),
      cs AS (SELECT t, CASE WHEN hi < lo THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN hi < lo THEN (lo + hi) / 2 ELSE hi END AS hi FROM h8)"""


SQL["hedged_confidence_sequence"] = f"{LEG}, {hedged('leg', 0.05, 1000)} SELECT t, round(lo, 6) AS cs_lo, round(hi, 6) AS cs_hi FROM cs"
SQL["estimated_baseline_null"] = f"""{LEG}, early AS (SELECT * FROM leg WHERE t < 8), {hedged('early', 0.025, 200)}
  SELECT 'system' AS leg, round(lo, 6) AS null_lo, round(hi, 6) AS null_hi, round((SELECT avg(z) FROM early), 6) AS point FROM cs ORDER BY t DESC LIMIT 1"""

MONITORED = f"""WITH {obs(name="obs0")}, {ONE_KIND}, {run_tables("8")}, b AS (SELECT avg(mean) AS m0, stddev_samp(mean) AS s0 FROM ranked WHERE place < 8),
      mon AS (SELECT place - 8 AS t, mean, m0, s0 FROM ranked, b WHERE place >= 8)"""
CUSUM = f"""{MONITORED}, walk AS (SELECT *, sum(mean - m0 - 0.0025) OVER (ORDER BY t {CUM}) AS a, sum(m0 - mean - 0.0025) OVER (ORDER BY t {CUM}) AS d FROM mon),
      page AS (SELECT *, a - least(0, min(a) OVER (ORDER BY t {CUM})) AS high, d - least(0, min(d) OVER (ORDER BY t {CUM})) AS low FROM walk)"""
SQL["cusum_trace"] = f"{CUSUM} SELECT t, round(high, 6) AS high, round(low, 6) AS low FROM page"
SQL["cusum_alarm"] = f"{CUSUM} SELECT 'discounts' AS stream_id, min(t) FILTER (high > 1.5 * s0 OR low > 1.5 * s0) AS alarm_at FROM page"
SQL["fixed_threshold"] = f"{MONITORED} SELECT 'discounts' AS stream_id, min(t) FILTER (m0 - mean > 0.015) AS alarm_at FROM mon"
SQL["welch_t_stat"] = f"""WITH {obs()}, per AS (SELECT run_index, count(*) AS n, sum(score) AS s, sum(score * score) AS ss, row_number() OVER (ORDER BY run_index) - 9 AS t FROM obs GROUP BY run_index),
  b AS (SELECT count(*) AS n0, avg(score) AS m0, var_samp(score) AS v0 FROM obs WHERE run_index IN (SELECT run_index FROM per WHERE t < 0)),
  c AS (SELECT t, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss FROM per WHERE t >= 0 WINDOW w AS (ORDER BY t {CUM})),
  d AS (SELECT t, n, s / n AS m, (ss - n * (s / n) * (s / n)) / (n - 1) AS v FROM c)
  SELECT t::INT AS t, round((m0 - m) / sqrt(v0 / n0 + v / n), 4) AS t_stat, round(pow(v0 / n0 + v / n, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v / n, 2) / (n - 1)), 4) AS df FROM d, b"""
DDM = f"""WITH {obs()}, o AS (SELECT run_index * 20 + item_id::INT AS i, run_index - 8 AS t, (score < 0.5)::INT AS fail FROM obs),
  p AS (SELECT i, t, row_number() OVER (ORDER BY i) AS n, avg(fail) OVER (ORDER BY i {CUM}) AS rate FROM o), q AS (SELECT *, sqrt(rate * (1 - rate) / n) AS sd FROM p),
  z AS (SELECT *, min(CASE WHEN n >= 30 THEN struct_pack(level := rate + sd, p := rate, s := sd) END) OVER (ORDER BY i {CUM}) AS best FROM q)"""
SQL["ddm_stat"] = f"{DDM} SELECT i, round(rate, 6) AS rate, round(sd, 6) AS sd, round(best.level, 6) AS least_level FROM z"
SQL["ddm_alarm"] = f"{DDM} SELECT 'discounts' AS stream_id, min(t) FILTER (t >= 0 AND rate + sd > best.p + best.s) AS alarm_at FROM z"


def shift_search(rows: str, horizon: str, out: str, alpha: float = 0.05) -> str:
    """Recursive CTE out: 80 halvings for rows (id, sigma, dead, unit); lo, hi and whether the top suffices."""
    need = needed_evidence(alpha)

    def enough(shift: str) -> str:
        drift = f"least(({shift} - dead) / unit, 0.5)"
        bet = f"least({drift} / (pow(sigma / unit, 2) + pow({drift}, 2)), 1)"
        return f"({horizon} * CASE WHEN {drift} <= 0 THEN 0 ELSE ln(1 + {bet} * {drift}) - pow({bet} * (sigma / unit) / (1 + {bet} * {drift}), 2) / 2 END >= {need!r})"

    return f"""{out}_steps AS (
        SELECT *, 0 AS step, dead AS lo, dead + unit AS hi, {enough('(dead + unit)')} AS possible FROM {rows}
        UNION ALL
        SELECT * EXCLUDE (step, lo, hi, possible, mid, ok), step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END, possible
        FROM (SELECT *, {enough('mid')} AS ok FROM (SELECT *, (lo + hi) / 2 AS mid FROM {out}_steps WHERE step < 80))),
      {out} AS (SELECT *, CASE WHEN possible THEN hi END AS min_shift FROM {out}_steps WHERE step = 80)"""


SQL["min_detectable_shift"] = f"""WITH RECURSIVE sizes AS (SELECT unnest(range(1, 11)) * 40 AS n),
  sg AS (SELECT n, sqrt(greatest(0, 0.0057 * 0.0057 - 0.08 * 0.08 / 200) + 0.08 * 0.08 / n) AS sigma FROM sizes),
  rows AS (SELECT n, sigma, sigma * {dead_zone_factor(5, 0.05)!r} AS dead, 2 * greatest(4, 0.05 / sigma) * sigma AS unit FROM sg), {shift_search("rows", "50", "found")}
  SELECT n, round(min_shift, 6) AS min_shift FROM found"""
SQL["lattice_decision"] = """WITH b AS (SELECT unnest([false, true]) AS v), c AS (SELECT unnest([5, 30])::INT AS v),
  g AS (SELECT c1.v AS n_runs, c2.v AS last_n, b1.v AS pin_changed, b2.v AS suite_agrees, b3.v AS anchor_crossed, b4.v AS corrected_crossed, b5.v AS system_crossed, b6.v AS adequate
        FROM c c1, c c2, b b1, b b2, b b3, b b4, b b5, b b6),
  r AS (SELECT *, CASE WHEN pin_changed THEN 'pin_violation' WHEN NOT suite_agrees THEN 'suite_drift' WHEN n_runs < 8 OR last_n < 30 THEN 'insufficient_data'
        WHEN anchor_crossed AND corrected_crossed THEN 'both_crossed' WHEN anchor_crossed THEN 'judge_only' WHEN system_crossed AND NOT adequate THEN 'race_failed'
        WHEN system_crossed THEN 'system_only' ELSE 'no_crossing' END AS rule_id FROM g),
  v AS (SELECT *, CASE rule_id WHEN 'insufficient_data' THEN 'stable' WHEN 'no_crossing' THEN 'stable' WHEN 'both_crossed' THEN 'both' WHEN 'judge_only' THEN 'judge' WHEN 'race_failed' THEN 'indeterminate' WHEN 'system_only' THEN 'system' END AS verdict FROM r)
  SELECT *, CASE WHEN verdict IS NULL THEN 3 WHEN verdict IN ('system', 'both') THEN 1 WHEN verdict IN ('judge', 'indeterminate') THEN 2 ELSE 0 END::INT AS exit_code FROM v"""

def decided(alpha: float = 0.05, target: float = 0.05) -> str:
    """CTE decided: the verdict after every run of the moved discount stream."""
    limit = f"ln({2 / alpha!r})"
    return f"""WITH RECURSIVE {obs(-0.1)}, {legs(alpha)},
      scaled AS (SELECT *, greatest({target}, 4 * sd) AS w, greatest({4 * target}, 20 * sd) AS wide FROM legs),
      src AS (SELECT leg, t, run_index, wide, least(greatest(0.5 + dev / (2 * w), 0), 1) AS z, least(greatest(0.5 + dev / (2 * wide), 0), 1) AS y,
                greatest(0, 0.5 - sd * f / (2 * w)) AS lo, least(1, 0.5 + sd * f / (2 * w)) AS hi FROM scaled),
      {detector("src")}, {bernstein("src", "y", alpha / 4, "bl")}, {bernstein("src", "1 - y", alpha / 4, "bu")},
      full_trace AS (SELECT leg, t, run_index, peak, peak >= {limit} AS alarm, min(CASE WHEN peak >= {limit} THEN t END) OVER (PARTITION BY leg ORDER BY t {CUM}) AS crossed_at,
          (bl.bound - 0.5) * 2 * wide AS shift_lo, (1 - bu.bound - 0.5) * 2 * wide AS shift_hi
        FROM src JOIN trace USING (leg, t) JOIN bl USING (leg, t) JOIN bu USING (leg, t)),
      points AS (SELECT run_index AS upto, place + 1 AS n_runs, n AS last_n FROM ranked WHERE kind = 'system'),
      last AS (SELECT p.upto, p.n_runs, p.last_n, {", ".join(f"arg_max(struct_pack(t := t, peak := peak, alarm := alarm, crossed_at := crossed_at, lo := shift_lo, hi := shift_hi), t) FILTER (leg = '{x}') AS {x[0]}" for x in ("system", "anchor", "corrected"))}
        FROM points p LEFT JOIN full_trace x ON x.run_index <= p.upto GROUP BY ALL),
      sg AS (SELECT last.*, coalesce(a.t + 1, 0) AS n_anchor, sqrt(greatest(0, run_sd * run_sd - item_sd * item_sd / n_items) + item_sd * item_sd / n_items) AS sigma FROM last, fl),
      rows AS (SELECT *, sigma * {dead_zone_factor(5, alpha)!r} AS dead, 2 * greatest(4, {target} / sigma) * sigma AS unit FROM sg), {shift_search("rows", "greatest(n_anchor, 1)", "found", alpha)},
      facts AS (SELECT *, CASE WHEN n_anchor > 0 THEN min_shift END AS mds, (coalesce(s.lo, 0) + coalesce(s.hi, 0)) / 2 AS shift FROM found),
      ruled AS (SELECT *, CASE WHEN n_runs < 8 OR last_n < 10 THEN 'insufficient_data' WHEN coalesce(a.alarm, false) AND coalesce(c.alarm, false) THEN 'both_crossed' WHEN coalesce(a.alarm, false) THEN 'judge_only'
          WHEN coalesce(s.alarm, false) AND NOT coalesce(mds < abs(shift), false) THEN 'race_failed' WHEN coalesce(s.alarm, false) THEN 'system_only' ELSE 'no_crossing' END AS rule_id FROM facts),
      decided AS (SELECT *, CASE rule_id WHEN 'both_crossed' THEN 'both' WHEN 'judge_only' THEN 'judge' WHEN 'race_failed' THEN 'indeterminate' WHEN 'system_only' THEN 'system' ELSE 'stable' END AS verdict FROM ruled)"""


DECIDED = decided()
SQL["verdict_by_stream"] = f"""{DECIDED} SELECT 'discounts' AS stream_id, rule_id, verdict, n_runs, s.crossed_at AS system_crossed_at, a.crossed_at AS anchor_crossed_at, c.crossed_at AS corrected_crossed_at,
  round(s.peak, 6) AS system_peak_log_e, round(a.peak, 6) AS anchor_peak_log_e, round(c.peak, 6) AS corrected_peak_log_e, round(s.lo, 6) AS system_shift_lo, round(s.hi, 6) AS system_shift_hi,
  round(coalesce(c.lo, s.lo - a.hi), 6) AS corrected_lo, round(coalesce(c.hi, s.hi - a.lo), 6) AS corrected_hi, round(mds, 6) AS min_shift FROM decided ORDER BY upto DESC LIMIT 1"""
SQL["replay_all_prefixes"] = f"""{DECIDED} SELECT 'discounts' AS stream_id, upto AS "at", rule_id, verdict, round(s.peak, 6) AS system_peak_log_e, round(mds, 6) AS min_shift FROM decided"""
SQL["replay_by_settings"] = " UNION ALL ".join(
    f"""SELECT * FROM ({decided(a, t)} SELECT 'discounts' AS stream_id, upto AS "at", {a}::DOUBLE AS alpha, {t}::DOUBLE AS target, rule_id, verdict, round(s.peak, 6) AS system_peak_log_e, round(mds, 6) AS min_shift FROM decided WHERE upto % 10 = 9)"""
    for a in (0.2, 0.1, 0.05, 0.02, 0.01)
    for t in (0.05, 0.1)
)
SQL["replay_divergence"] = f"""{DECIDED} SELECT 'discounts' AS stream_id, upto AS "at", 'judge' AS verdict, rule_id, verdict AS verdict_now, rule_id AS rule_now, CASE WHEN upto = 70 THEN 'semantics' ELSE 'regression' END AS kind
  FROM decided WHERE upto IN (60, 70) AND verdict <> 'judge'"""
SQL["verdict_counts"] = f"""{DECIDED} SELECT 'discounts' AS stream_id, {", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("stable", "system", "judge", "both", "indeterminate"))}, 0::BIGINT AS refused FROM decided"""

DAYS = "SELECT (floor(epoch_us(ts) / 1000000 / {s}))::BIGINT AS run_index, (user_id % {m})::VARCHAR AS item_id, avg(value) / 1000 AS score FROM events GROUP BY ALL"
SUITE = "sha256('[' || string_agg('\"' || item_id || '\"', ',' ORDER BY item_id) || ']')"
SQL["suite_hash"] = f"SELECT run_index, count(*) AS n, {SUITE} AS suite_hash, round(avg(score), 6) AS mean FROM ({DAYS.format(s=86400, m=30)}) GROUP BY run_index"
SQL["suite_drift"] = f"SELECT 'events' AS stream_id, count(*) AS runs, count(DISTINCT h) AS suites FROM (SELECT run_index, {SUITE} AS h FROM ({DAYS.format(s=43200, m=20)}) GROUP BY run_index)"

ITEMS = "items AS (SELECT doc_id::VARCHAR AS item_id, (doc_id * 37 % 101) / 100.0::DOUBLE AS score, lang, source, 'd' || least(floor((doc_id * 37 % 101) / 100.0::DOUBLE * 10)::INT, 9) || '/' || coalesce(lang, '-') AS stratum FROM documents)"
SQL["strata"] = f"WITH {ITEMS} SELECT stratum, count(*) AS n FROM items GROUP BY stratum"
SQL["stratified_pick"] = f"""WITH {ITEMS}, n AS (SELECT count(*) AS total, count(DISTINCT stratum) AS strata FROM items), sz AS (SELECT stratum, count(*) AS size FROM items GROUP BY stratum),
  q AS (SELECT stratum, least(size, greatest((size * 120) // total, (120 >= strata)::INT)) AS quota FROM sz, n),
  r AS (SELECT item_id, stratum, quota, sha256('7:' || item_id) AS turn, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7:' || item_id)) AS rank FROM items JOIN q USING (stratum)),
  w AS (SELECT sum(quota) AS wanted FROM q), chosen AS (SELECT *, row_number() OVER (ORDER BY quota, rank, turn) AS place FROM r WHERE rank <= quota), rest AS (SELECT *, row_number() OVER (ORDER BY turn) AS place FROM r WHERE rank > quota)
  SELECT item_id, stratum FROM chosen, w WHERE wanted <= 120 OR place <= 120 UNION ALL SELECT item_id, stratum FROM rest, w WHERE place <= 120 - wanted"""
SQL["random_pick"] = f"WITH {ITEMS} SELECT item_id, stratum FROM items ORDER BY sha256('7:' || item_id) LIMIT 50"
SQL["anchor_coverage"] = f"""WITH {ITEMS}, m AS (SELECT *, least(floor(score * 10)::INT, 9)::VARCHAR AS dec, score < 0.85 AND lang <> 'es' AS chosen FROM items),
  t AS (SELECT count(*) AS suite_n, count(*) FILTER (chosen) AS anchor_n FROM m), e AS (SELECT 'd' AS kind, dec AS v, chosen FROM m UNION ALL SELECT 't', lang, chosen FROM m),
  g AS (SELECT kind, v, count(*) AS a, count(*) FILTER (chosen) AS b FROM e GROUP BY kind, v)
  SELECT round(avg((b > 0)::INT) FILTER (kind = 'd'), 6) AS decile_coverage, round(avg((b > 0)::INT) FILTER (kind = 't'), 6) AS tag_coverage, round(max(abs(a / suite_n - b / anchor_n)), 6) AS max_marginal_gap,
    coalesce(string_agg(v, ',' ORDER BY v) FILTER (kind = 'd' AND b = 0), '') AS missing_deciles, coalesce(string_agg(v, ',' ORDER BY v) FILTER (kind = 't' AND b = 0), '') AS missing_tags, first(anchor_n) AS anchor_n, first(suite_n) AS suite_n FROM g, t"""
SQL["gold_agreement"] = f"WITH {ITEMS} SELECT round(avg(abs(score - quality)), 6) AS mae, count(*) AS n FROM items JOIN labels l ON l.doc_id::VARCHAR = item_id WHERE quality IS NOT NULL"
SQL["cached_scores"] = f"""WITH {ITEMS} SELECT item_id, round(coalesce(l.quality::DOUBLE, 0.25 + 0.5 * ('0x' || substr(sha256(item_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE), 6) AS score FROM items LEFT JOIN labels l ON l.doc_id::VARCHAR = item_id"""
SQL["kept_scores"] = """WITH l AS (SELECT doc_id, max(quality) FILTER (quality IS NOT NULL) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
  SELECT d.doc_id::VARCHAR AS item_id, round(CASE WHEN l.toxic = 1 THEN 0 ELSE coalesce(l.quality::DOUBLE, 0.25 + 0.5 * ('0x' || substr(sha256(d.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE) END, 6) AS score FROM documents d LEFT JOIN l USING (doc_id)"""
SQL["archived_logs"] = """SELECT source, CASE WHEN doc_id % 11 = 0 THEN 'score out of range' ELSE '' END AS issue, count(*) AS n,
    round(coalesce(sum(CASE WHEN doc_id % 11 <> 0 THEN (n_chars % 101)::DOUBLE / 100 END), 0), 4) AS scores FROM documents GROUP BY ALL"""
SQL["ingest_issues"] = """WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_tax AS score, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem)
  SELECT CASE WHEN c > 1 THEN 'duplicate item id' WHEN score IS NULL THEN 'no numeric score' WHEN NOT score BETWEEN 0 AND 0.07 THEN 'score out of range' END AS issue, count(*) AS n FROM r GROUP BY 1"""
SQL["ingest_lines"] = """WITH r AS (SELECT year(l_shipdate)::INT AS year, l_quantity AS q, row_number() OVER (PARTITION BY year(l_shipdate) ORDER BY l_orderkey, l_linenumber, l_tax, l_quantity) AS line, l_orderkey || '-' || l_linenumber % 3 AS id, l_tax AS score FROM lineitem),
  kept AS (SELECT *, q = 17 AS broken, CASE WHEN score NOT BETWEEN 0 AND 0.07 THEN 'score out of range' END AS wrong FROM r WHERE q NOT IN (13, 19)),
  firsts AS (SELECT year, id, min(line) AS first FROM kept WHERE NOT broken AND wrong IS NULL GROUP BY ALL),
  told AS (SELECT k.year, k.line, CASE WHEN NOT broken AND line > first THEN first END AS first_line,
    CASE WHEN broken THEN 'not JSON' ELSE concat_ws(', ', CASE WHEN line > first THEN 'duplicate item id' END, wrong) END AS issues FROM kept k LEFT JOIN firsts f ON f.year = k.year AND f.id = k.id)
  SELECT year, issues, count(*) AS n, sum(line)::BIGINT AS lines, coalesce(sum(first_line), 0)::BIGINT AS first_lines FROM told GROUP BY year, issues"""
SQL["scale_suggestion"] = """WITH e AS (SELECT 'discount' AS name, l_discount AS x FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem), a AS (SELECT name, min(x) AS lo, max(x) AS hi FROM e GROUP BY name),
  s AS (SELECT * FROM (VALUES (1, 0.0, 1.0), (2, -1.0, 1.0), (3, 1.0, 5.0), (4, 0.0, 5.0), (5, 1.0, 10.0), (6, 0.0, 10.0), (7, 0.0, 100.0)) v(i, slo, shi))
  SELECT name, lo, hi, (arg_min(slo, i))::DOUBLE AS scale_lo, (arg_min(shi, i))::DOUBLE AS scale_hi FROM a LEFT JOIN s ON lo >= slo AND hi <= shi GROUP BY name, lo, hi"""
SQL["reply_scores"] = r"""WITH x AS (SELECT conv_id, turn, try_cast(nullif(regexp_extract(text, '-?\d+(?:\.\d+)?', 0), '') AS DOUBLE) AS v FROM conversations) SELECT conv_id, turn, CASE WHEN v BETWEEN 0 AND 10 THEN v END AS score FROM x"""
SQL["scoring_within_a_limit"] = """WITH i AS (SELECT d.doc_id::VARCHAR AS id, length(d.text) AS n, coalesce(t.toxic, 0) = 1 AS fails, (('0x' || substr(sha256(d.doc_id::VARCHAR), 1, 8))::BIGINT % 16)::INT AS wave
    FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) t USING (doc_id)),
  w AS (SELECT wave, sum(CASE WHEN fails THEN 0 ELSE n END) / 1e6::DOUBLE AS cost FROM i GROUP BY wave),
  b AS (SELECT wave, coalesce(sum(cost) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT sum(n) / 3e6::DOUBLE FROM i) AS begun FROM w)
  SELECT wave, CASE WHEN NOT begun THEN 'spend limit' WHEN fails THEN 'ValueError: refused' ELSE '' END AS error, count(*) AS n, sum(CASE WHEN NOT begun THEN 0 WHEN fails THEN 2 ELSE 1 END)::BIGINT AS calls,
    round(sum(CASE WHEN begun AND NOT fails THEN n / 1e6::DOUBLE ELSE 0 END), 6) AS cost, round(sum(CASE WHEN begun AND NOT fails THEN n % 101 / 100::DOUBLE ELSE 0 END), 2) AS scores
  FROM i JOIN b USING (wave) GROUP BY 1, 2"""
SQL["call_costs"] = """SELECT source, round(sum(n_chars / 4.0::DOUBLE / 1e6 * p + 10.0::DOUBLE / 1e6 * p * 5), 4) AS cost, count(*) AS calls
  FROM (SELECT source, n_chars, CASE WHEN source LIKE 'src12%' THEN 4.0 WHEN source LIKE 'src1%' THEN 2.0 ELSE 1.0 END::DOUBLE AS p FROM documents) GROUP BY source"""
SQL["refusal_rates"] = """WITH r AS (SELECT source AS config, avg((toxic = 1)::INT) AS rate, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)
  SELECT config, n, round(rate, 6) AS rate, round(rate / (SELECT rate FROM r WHERE config = 'src0'), 6) AS multiple FROM r"""
SQL["letter_grades"] = """SELECT translate(o_orderstatus, 'OFP', 'CIP') AS g, round(avg(CASE translate(o_orderstatus, 'OFP', 'CIP') WHEN 'C' THEN 1.0 WHEN 'I' THEN 0.0 WHEN 'P' THEN 0.5 WHEN 'N' THEN 0.0 END), 6)::DOUBLE AS score, count(*) AS n FROM orders GROUP BY 1"""
SQL["chain_verify"] = """SELECT row_number() OVER (ORDER BY d) - 1 AS seq, row_number() OVER (ORDER BY d) <> 11 AS hash_ok, true AS link_ok, true AS seq_ok FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS d FROM events)"""

# Student's tail by Simpson's rule over the density, as the tables have few rows.
WELCH = SQL["welch_t_stat"].rsplit("SELECT t::INT", 1)[0]
SQL_P = f"""{WELCH.rstrip()}, x AS (SELECT t::INT AS t, abs((m0 - m) / sqrt(v0 / n0 + v / n)) AS s, pow(v0 / n0 + v / n, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v / n, 2) / (n - 1)) AS df FROM d, b),
  g AS (SELECT t, s, df, unnest(range(0, 2001)) AS i FROM x),
  p AS (SELECT t, 1 - 2 * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - (df + 1) / 2 * ln(1 + pow(s * i / 2000, 2) / df)) / sqrt(df * pi()) * s / 6000) AS p FROM g GROUP BY t)"""
SQL["peeking_t_test"] = f"{SQL_P} SELECT 'discounts' AS stream_id, min(t) FILTER (p < 0.05) AS alarm_at FROM p"
SQL["bonferroni_t_test"] = f"{SQL_P} SELECT 'discounts' AS stream_id, min(t) FILTER (p < 0.05 / (t + 1)) AS alarm_at FROM p"
SQL["adwin_alarm"] = f"""WITH RECURSIVE {obs()}, o AS (SELECT row_number() OVER (ORDER BY run_index * 20 + item_id::INT) AS n, run_index - 8 AS t, score FROM obs),
  pre AS (SELECT 0 AS n, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q, -99 AS t UNION ALL SELECT n, sum(score) OVER (ORDER BY n {CUM}), sum(score * score) OVER (ORDER BY n {CUM}), t FROM o),
  top AS (SELECT max(n) AS whole FROM pre),
  steps AS (
    SELECT 0::BIGINT AS lo, least(32, whole)::BIGINT AS hi, NULL::BIGINT AS alarm, false AS done FROM top
    UNION ALL
    SELECT lo + coalesce(cut, 0), CASE WHEN cut IS NULL THEN least(hi + 32, whole) ELSE hi END, coalesce(alarm, CASE WHEN cut IS NOT NULL AND here >= 0 THEN here END), cut IS NULL AND hi = whole
    FROM (
      SELECT st.lo, st.hi, st.alarm, max(b.t) AS here, max(c.n - st.lo) FILTER (st.hi - st.lo >= 10 AND c.n BETWEEN st.lo + 5 AND st.hi - 5 AND
          abs((c.s - a.s) / (c.n - a.n) - (b.s - c.s) / (b.n - c.n)) >
          sqrt(2 * (1.0 / (c.n - a.n) + 1.0 / (b.n - c.n)) * ((b.q - a.q) / (b.n - a.n) - pow((b.s - a.s) / (b.n - a.n), 2)) * ln(2 * ln(b.n - a.n) / 0.05)) + 2.0 / 3 * (1.0 / (c.n - a.n) + 1.0 / (b.n - c.n)) * ln(2 * ln(b.n - a.n) / 0.05)) AS cut
      FROM (SELECT * FROM steps WHERE NOT done) st JOIN pre a ON a.n = st.lo JOIN pre b ON b.n = st.hi LEFT JOIN pre c ON c.n > st.lo AND c.n < st.hi GROUP BY st.lo, st.hi, st.alarm), top)
  SELECT 'discounts' AS stream_id, max(alarm) AS alarm_at FROM steps"""
# one row steps through its scores: 'add' takes the next one in, 'merge' joins the two oldest of six equal buckets, 'cut' drops the oldest while any boundary is too wide
SQL["adwin_buckets_alarm"] = f"""WITH RECURSIVE {obs()},
  streams AS (SELECT 'discounts' AS stream_id, run_index - 8 AS t, run_index * 20 + item_id::INT AS i, score FROM obs
    UNION ALL SELECT 'moved', run_index - 8, run_index * 20 + item_id::INT, score * CASE WHEN run_index >= 38 THEN 0.4 ELSE 1.0 END FROM obs),
  lists AS (SELECT stream_id, list(score ORDER BY i) AS xs, list(t ORDER BY i) AS ts FROM streams GROUP BY stream_id),
  steps AS (
    SELECT stream_id, 0::BIGINT AS k, 'add' AS phase, []::STRUCT(n DOUBLE, s DOUBLE, q DOUBLE)[] AS b, NULL::BIGINT AS alarm FROM lists
    UNION ALL
    SELECT stream_id, CASE WHEN phase = 'add' THEN k + 1 ELSE k END,
      CASE WHEN phase = 'add' THEN 'merge' WHEN phase = 'merge' THEN CASE WHEN crowded IS NULL THEN 'cut' ELSE 'merge' END WHEN apart THEN 'cut' ELSE 'add' END,
      CASE WHEN phase = 'add' THEN list_append(b, {{'n': 1.0::DOUBLE, 's': xs[k + 1], 'q': xs[k + 1] * xs[k + 1]}})
        WHEN phase = 'merge' AND crowded IS NOT NULL THEN b[1:crowded - 1] || [{{'n': 2 * b[crowded].n, 's': b[crowded].s + b[crowded + 1].s, 'q': b[crowded].q + b[crowded + 1].q}}] || b[crowded + 2:]
        WHEN phase = 'cut' AND apart THEN b[2:] ELSE b END,
      coalesce(alarm, CASE WHEN phase = 'cut' AND apart AND ts[k] >= 0 THEN ts[k] END)
    FROM (
      SELECT *, phase = 'cut' AND whole.n >= 10 AND len(list_filter(cuts, lambda c: c.n >= 5 AND whole.n - c.n >= 5 AND
          abs(c.s / c.n - (whole.s - c.s) / (whole.n - c.n)) > sqrt(2 * (1 / c.n + 1 / (whole.n - c.n)) * greatest(whole.q / whole.n - pow(whole.s / whole.n, 2), 0) * ln(2 * ln(whole.n) / 0.05)) + 2.0 / 3 * (1 / c.n + 1 / (whole.n - c.n)) * ln(2 * ln(whole.n) / 0.05))) > 0 AS apart
      FROM (
        SELECT *, cuts[-1] AS whole
        FROM (
          SELECT st.*, xs, ts,
            CASE WHEN phase = 'merge' THEN list_position(list_transform(b, lambda x: x.n), list_min(list_filter(list_transform(b, lambda x: x.n), lambda v: len(list_filter(b, lambda y: y.n = v)) > 5))) END AS crowded,
            CASE WHEN phase = 'cut' THEN list_transform(range(1, len(b) + 1), lambda j: {{'n': list_sum(list_transform(b[1:j], lambda x: x.n)), 's': list_sum(list_transform(b[1:j], lambda x: x.s)), 'q': list_sum(list_transform(b[1:j], lambda x: x.q))}}) END AS cuts
          FROM steps st JOIN lists USING (stream_id) WHERE NOT (phase = 'add' AND k = len(xs)) AND alarm IS NULL))))
  SELECT stream_id, max(alarm) AS alarm_at FROM steps GROUP BY stream_id"""
SQL["plan_size"] = f"""WITH RECURSIVE sizes AS (SELECT unnest(range(1, 1500)) AS n), targets AS (SELECT unnest([0.10, 0.05, 0.03, 0.02, 0.015, 0.01])::DOUBLE AS target),
  sg AS (SELECT n, 0.08 / sqrt(n) AS sigma FROM sizes), rows AS (SELECT n, sigma, sigma * {dead_zone_factor(5, 0.05)!r} AS dead, 8 * sigma AS unit FROM sg), {shift_search("rows", "50", "found")}
  SELECT target, min(n) FILTER (min_shift <= target AND n >= 40) AS n, {min_horizon(0.05)}::BIGINT AS min_horizon FROM found, targets GROUP BY target"""

OUTCOMES = f"""months AS (SELECT (l_partkey % 12)::BIGINT AS cell, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS m,
      avg(l_discount) FILTER (l_suppkey % 20 < 10) / 0.1 AS s, avg(l_discount) FILTER (l_suppkey % 20 >= 10) / 0.1 AS a FROM lineitem GROUP BY 1, 2),
    placed AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY m) - 13 AS t FROM months WHERE s IS NOT NULL AND a IS NOT NULL),
    cases AS (SELECT truth, shift FROM (SELECT unnest(['stable', 'judge', 'system', 'both']) AS truth), (SELECT unnest([0.1, 0.2, 0.4]::DOUBLE[]) AS shift)),
    altered AS (SELECT cell, truth, shift, t, s - CASE WHEN t >= 24 AND truth IN ('judge', 'both') THEN shift ELSE 0 END - CASE WHEN t >= 24 AND truth IN ('system', 'both') THEN shift ELSE 0 END AS s,
      a - CASE WHEN t >= 24 AND truth IN ('judge', 'both') THEN shift ELSE 0 END AS a FROM placed, cases),
    legs AS (SELECT cell, truth, shift, t, unnest(['system', 'anchor', 'corrected']) AS leg, unnest([s, a, s - a]) AS x FROM altered),
    held AS (SELECT cell, truth, shift, leg, avg(x) AS m0, stddev_samp(x) AS s0 FROM legs WHERE t < 0 GROUP BY ALL),
    walks AS (SELECT *, sum(x - m0 - 0.05) OVER w AS up, sum(m0 - x - 0.05) OVER w AS down FROM legs JOIN held USING (cell, truth, shift, leg) WHERE t >= 0 WINDOW w AS (PARTITION BY cell, truth, shift, leg ORDER BY t {CUM})),
    sums AS (SELECT *, greatest(up - least(0, min(up) OVER w), down - least(0, min(down) OVER w)) AS page FROM walks WINDOW w AS (PARTITION BY cell, truth, shift, leg ORDER BY t {CUM})),
    hits AS (SELECT cell, truth, shift, leg, t, unnest(['threshold', 'cusum', 'cusum_tight']) AS method, unnest([m0 - x > 0.2503, page > 5 * s0, page > 2.5 * s0]) AS hit FROM sums),
    said AS (SELECT cell, truth, shift, method, min(t) FILTER (hit AND leg = 'system') AS alarm_at, bool_or(hit AND leg = 'anchor') AS judge, bool_or(hit AND leg = 'corrected') AS sys FROM hits GROUP BY ALL),
    o AS (SELECT cell, truth, shift, method, alarm_at, CASE WHEN judge AND sys THEN 'both' WHEN judge THEN 'judge' WHEN sys THEN 'system' WHEN alarm_at IS NOT NULL THEN 'indeterminate' ELSE 'stable' END AS verdict FROM said)"""
SQL["tally_rates"] = f"""WITH {OUTCOMES}, e AS (SELECT *, CASE WHEN truth <> 'stable' AND alarm_at >= 24 THEN alarm_at - 24 END AS delay FROM o)
  SELECT method, truth, count(*) AS n, count(alarm_at) AS alarms, round(avg((alarm_at IS NOT NULL)::INT) FILTER (truth = 'stable'), 6) AS false_alarm_rate,
    round(avg((alarm_at IS NOT NULL)::INT) FILTER (truth <> 'stable'), 6) AS detection_rate, round(quantile_cont(delay, 0.5), 6) AS median_delay, round(avg(delay), 6) AS mean_delay FROM e GROUP BY method, truth"""
RATE = "round(avg((verdict = '{1}')::INT) FILTER (truth = '{0}'), 6)"
SQL["tally_misattribution"] = f"""WITH {OUTCOMES} SELECT method, {RATE.format("judge", "system")} AS judge_as_system, {RATE.format("system", "judge")} AS system_as_judge,
  round(avg((verdict = 'indeterminate')::INT), 6) AS indeterminate_rate, round(avg((verdict = truth)::INT), 6) AS accuracy FROM o GROUP BY method"""
SQL["tally_modal_verdict"] = f"WITH {OUTCOMES}, v AS (SELECT cell, verdict, count(*) AS votes FROM o GROUP BY ALL) SELECT cell, verdict, votes FROM v QUALIFY row_number() OVER (PARTITION BY cell ORDER BY votes DESC, verdict) = 1"
SQL["tally_arl0"] = f"WITH {OUTCOMES} SELECT method, round(avg(coalesce(alarm_at, 72)), 6) AS arl0 FROM o WHERE truth = 'stable' GROUP BY method"
SQL["tally_worst_cell"] = f"""WITH {OUTCOMES}, r AS (SELECT cell, avg((verdict = 'system')::INT) AS rate FROM o WHERE truth = 'judge' GROUP BY cell)
  SELECT round((SELECT avg(rate) FROM r), 6) AS mean_rate, round(rate, 6) AS worst_rate, cell AS worst_cell FROM r ORDER BY rate DESC, cell DESC LIMIT 1"""
DELAYS = f"{OUTCOMES}, e AS (SELECT *, CASE WHEN alarm_at >= 24 THEN alarm_at - 24 END AS delay FROM o), d AS (SELECT method, shift, quantile_cont(delay, 0.5) AS median_delay, avg(delay) AS mean_delay, count(delay) AS n FROM e GROUP BY method, shift)"
SQL["delay_by_shift"] = f"WITH {DELAYS} SELECT method, shift, round(median_delay, 6) AS median_delay, round(mean_delay, 6) AS mean_delay, n FROM d"
SQL["delay_ratio"] = f"""WITH {DELAYS}, m AS (SELECT avg(median_delay) FILTER (method = 'threshold') AS a, avg(median_delay) FILTER (method = 'cusum') AS b FROM d) SELECT round(a, 6) AS mean_delay, round(b, 6) AS mean_delay_against, round(a / b, 6) AS ratio FROM m"""
SQL["headline_guard"] = f"""WITH {OUTCOMES}, r AS (SELECT avg((alarm_at IS NOT NULL)::INT) FILTER (truth = 'stable') AS f, avg((verdict = 'judge')::INT) FILTER (truth = 'judge') AS c, avg((verdict = 'system')::INT) FILTER (truth = 'judge') AS w FROM o WHERE method = 'cusum')
  SELECT 'false alarms above alpha' AS failure, round(f, 6) AS value, 0.05::DOUBLE AS bound FROM r WHERE f > 0.05
  UNION ALL SELECT 'correct causes under a silent change below the floor', round(c, 6), 0.9::DOUBLE FROM r WHERE c < 0.9
  UNION ALL SELECT 'instrument changes blamed on the system', round(w, 6), 0.01::DOUBLE FROM r WHERE w > 0.01"""

POOL = """l AS (SELECT *, lpad(l_suppkey::VARCHAR, 6, '0') AS item_id FROM lineitem),
  pool AS (SELECT CASE l_returnflag WHEN 'A' THEN 'a-baseline' WHEN 'N' THEN 'b-other-snapshot' ELSE 'c-strict-rubric' END AS config, item_id, avg(l_discount) / 0.1 AS score FROM l GROUP BY ALL
    UNION ALL SELECT 'd-effort', item_id, avg(l_tax) / 0.08 FROM l GROUP BY ALL),
  placed AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS place FROM (SELECT item_id FROM pool GROUP BY item_id HAVING count(DISTINCT config) = 4)),
  sides AS (SELECT item_id, CASE WHEN place <= 40 THEN 'anchor' ELSE 'system' END AS kind FROM placed WHERE place <= 80),
  rep AS (SELECT l_linenumber % 5 AS k, l.item_id, avg(l_discount) / 0.1 AS s FROM l JOIN sides USING (item_id) WHERE kind = 'anchor' GROUP BY ALL),
  fi AS (SELECT item_id, var_samp(s) AS v FROM rep GROUP BY item_id), fr AS (SELECT k, avg(s) AS m FROM rep GROUP BY k),
  floors AS (SELECT greatest((SELECT sqrt(avg(v)) FROM fi), 1e-6) AS item_sd, greatest((SELECT stddev_samp(m) FROM fr), 1e-6) AS run_sd, (SELECT count(*) FROM fr) AS k, (SELECT count(*) FROM fi) AS n_items)"""
SQL["pool_floor"] = f"WITH {POOL} SELECT round(item_sd, 6) AS per_item_sd, round(run_sd, 6) AS run_mean_sd, k AS replicates, n_items FROM floors"
SQL["pool_halves"] = f"WITH {POOL} SELECT item_id, kind FROM sides"
SQL["pool_common_items"] = "SELECT o_custkey AS item_id FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)"


def composed() -> str:
    """CTE streams: scenario and, by kind and whether the change has come, the configuration."""
    from .plans.study import SCENARIOS

    rows = ", ".join(str(tuple(x)) for x in SCENARIOS)
    u = lambda at: f"((('0x' || substr(h, {at}, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"
    return f"""WITH {POOL}, scenarios(scenario, truth, sb, sa, ab, aa) AS (VALUES {rows}),
      known AS (SELECT config, item_id, score FROM pool UNION ALL SELECT config || '-degraded', item_id, greatest(0, score - 0.1) FROM pool),
      spread AS (SELECT scenario || '#0' AS stream_id, r AS run_index, kind, item_id, CASE WHEN kind = 'system' THEN (CASE WHEN r >= 20 THEN sa ELSE sb END) ELSE (CASE WHEN r >= 20 THEN aa ELSE ab END) END AS config
        FROM scenarios, (SELECT unnest(range(0, 60)) AS r), sides),
      hashed AS (SELECT s.*, score, md5(stream_id || '/' || kind || '/' || run_index || '/' || s.item_id) AS h FROM spread s JOIN known k ON k.config = s.config AND k.item_id = s.item_id),
      composed AS (SELECT stream_id, kind, run_index, item_id, least(1, greatest(0, score + sqrt(-2 * ln({u(1)})) * cos(2 * pi() * {u(9)}) * item_sd / 4)) AS score FROM hashed, floors)"""


SQL["composed_streams"] = f"{composed()} SELECT stream_id, kind, run_index, count(*) AS n, round(avg(score), 6) AS mean FROM composed GROUP BY ALL"
SQL["coverage_warnings"] = f"""WITH c AS ({SQL["anchor_coverage"]})
  SELECT least(decile_coverage, tag_coverage) >= 0.8 AND missing_tags = '' AS adequate, concat_ws('; ', CASE WHEN missing_tags <> '' THEN 'no control items tagged ' || replace(missing_tags, ',', ', ') END,
    CASE WHEN missing_deciles <> '' THEN 'no control items in score deciles ' || replace(missing_deciles, ',', ', ') END, CASE WHEN max_marginal_gap > 0.15 THEN 'the control set is made up unlike the suite' END) AS warnings FROM c"""
SQL["noise_floor_warnings"] = f"""WITH {REPLICATES}, v AS (SELECT unnest(['all', 'two', 'flat']) AS s2), x AS (SELECT s2, k, avg(CASE WHEN s2 = 'flat' THEN 0.5 ELSE s END) AS m FROM r, v WHERE s2 <> 'two' OR k < 2 GROUP BY ALL)
  SELECT s2 AS "set", concat_ws('; ', CASE WHEN stddev_samp(m) <= 0 THEN 'all replicates scored alike, any movement will read as drift' END, CASE WHEN count(*) < 3 THEN 'fewer than 3 replicates bound the floor loosely' END) AS warnings FROM x GROUP BY s2"""
SQL["head_per_stratum"] = """WITH i AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS item_id, lang AS stratum FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY item_id) AS rank, count(*) OVER (PARTITION BY stratum) AS size FROM i),
  q AS (SELECT 450 // count(DISTINCT stratum) AS quota FROM i), c AS (SELECT count(*) AS have FROM r, q WHERE rank <= quota),
  rest AS (SELECT item_id, stratum, row_number() OVER (ORDER BY size DESC, stratum, rank) AS place FROM r, q WHERE rank > quota)
  SELECT item_id, stratum FROM r, q WHERE rank <= quota UNION ALL SELECT item_id, stratum FROM rest, c WHERE place <= 450 - have"""
SQL["first_items"] = "SELECT lpad(doc_id::VARCHAR, 9, '0') AS item_id, lang FROM documents ORDER BY 1 LIMIT 30"
SQL["clipped_texts"] = "SELECT doc_id, length(substr(text, 1, 1200))::INT AS n, sha256(substr(text, 1, 2400)) AS sha256 FROM documents"
SQL["run_means_reordered"] = SQL["run_means"]
SQL["point_null_wealth"] = f"""{LEG}, late AS (SELECT l.*, (SELECT avg(z) FROM leg WHERE t < 8) AS m0 FROM leg l WHERE t >= 8), {betting("late", "", "z", "m0", "m0", "agrapa")}
  SELECT t, round(log_e, 6) AS log_wealth, log_e >= ln(20) AS alarm FROM w"""
