"""Common table expressions of the SQL counterparts; rows and joins instead of packed days."""

from __future__ import annotations

TZ = "Europe/Berlin"
MODELS = ("naive_last_day", "naive_weekly", "naive_similar_day")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def local(s: str) -> str:
    """Naive local timestamp of epoch seconds."""
    return f"timezone('{TZ}', to_timestamp({s}))"


def day_start(day: str) -> str:
    return f"CAST(epoch(timezone('{TZ}', CAST({day} AS TIMESTAMP))) AS BIGINT)"


def at_clock(day: str, clock: str) -> str:
    h, m = clock.split(":")
    return f"CAST(epoch(timezone('{TZ}', CAST({day} AS TIMESTAMP) + INTERVAL {int(h)} HOUR + INTERVAL {int(m)} MINUTE)) AS BIGINT)"


def utc_text(s: str) -> str:
    return f"strftime(timezone('UTC', to_timestamp({s})), '%Y-%m-%dT%H:%M:%SZ')"


def local_iso(s: str) -> str:
    off = f"CAST((epoch(timezone('UTC', {local(s)})) - ({s})) / 3600 AS INTEGER)"
    return f"strftime({local(s)}, '%Y-%m-%dT%H:%M:%S') || '+0' || {off} || ':00'"


def r(x: str, n: int = 6) -> str:
    return f"(round({x} + {3e-4 * 10.0**-n!r}::DOUBLE, {n}) + 0.0::DOUBLE)"


def re_(x: str, n: int) -> str:
    """Half-to-even rounding."""
    return f"(round_even({x}, {n}) + 0.0::DOUBLE)"


def quantile(a: str, q: float) -> str:
    """Linear quantile of an ordered list, interpolating from the lower neighbour."""
    pos = f"((len({a}) - 1) * {q!r}::DOUBLE)"
    lo = f"CAST(floor({pos}) AS BIGINT)"
    return f"({a}[{lo} + 1] + (coalesce({a}[{lo} + 2], {a}[{lo} + 1]) - {a}[{lo} + 1]) * ({pos} - {lo}))"


def ev_raw(sec: int) -> str:
    return f"""raw AS (
  SELECT event_type AS series_id, (epoch_us(ts) // 1000000) // {sec} * {sec} AS s,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) - 1000 AS DOUBLE) AS v
  FROM events GROUP BY ALL)"""


LI_RAW = """raw AS (
  SELECT l_linestatus AS series_id,
         epoch_us(l_shipdate) // 1000000 + ((l_orderkey * 7 + l_linenumber * 5) % 24) * 3600 AS s,
         CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS DOUBLE) AS v
  FROM lineitem GROUP BY ALL)"""


def panel(kind: str, fill: bool = True) -> list[str]:
    """raw, obs, dd (observed days), db (bounds), pan (every slot of every observed day)."""
    sec = {"ev15": 900, "ev60": 3600, "li60": 3600}[kind]
    zero = "0.0" if kind == "li60" else "-1000.0"
    raw = LI_RAW if kind == "li60" else ev_raw(sec)
    y = f"coalesce(o.v, {zero}::DOUBLE)" if fill else "o.v"
    return [
        raw,
        f"obs AS (SELECT series_id, s, v, CAST({local('s')} AS DATE) AS day FROM raw)",
        "dd AS (SELECT DISTINCT series_id, day FROM obs)",
        f"db AS (SELECT series_id, day, {day_start('day')} AS d0, {day_start('day + 1')} AS d1 FROM dd)",
        f"sl AS (SELECT series_id, day, d0, (d1 - d0) // {sec} AS n, unnest(range(d0, d1, {sec})) AS s FROM db)",
        f"""pan AS (
  SELECT k.series_id, k.day, k.n, k.s, (k.s - k.d0) // {sec} AS i, {y} AS y,
         strftime({local('k.s')}, '%H:%M') AS clock, CAST(hour({local('k.s')}) AS INTEGER) AS hour
  FROM sl k LEFT JOIN obs o ON o.series_id = k.series_id AND o.s = k.s)""",
    ]


def points(kind: str) -> list[str]:
    """tg, req, cal, pts: filled points of every rule, horizon and target."""
    sec = 900 if kind == "ev15" else 3600
    models = ", ".join(f"('{m}')" for m in MODELS)
    return [
        """tg AS (SELECT series_id,
    CAST(unnest(generate_series(min(day), max(day) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS DATE) AS target_date
  FROM dd GROUP BY series_id)""",
        f"""req AS (SELECT t.series_id, t.target_date, m.model, h.h, t.target_date - h.h AS issue_date,
    CASE m.model WHEN 'naive_last_day' THEN t.target_date - h.h WHEN 'naive_weekly' THEN t.target_date - 7
      ELSE CASE WHEN isodow(t.target_date) IN (1, 6, 7) THEN t.target_date - 7
                ELSE least(t.target_date - 1, t.target_date - h.h) END END AS source_day
  FROM tg t, (VALUES {models}) m(model), (VALUES (1), (2)) h(h))""",
        f"""cal0 AS (SELECT target_date, {day_start('target_date')} AS d0, {day_start('target_date + 1')} AS d1
  FROM (SELECT DISTINCT target_date FROM tg))""",
        f"cal1 AS (SELECT target_date, d0, (d1 - d0) // {sec} AS n, unnest(range(d0, d1, {sec})) AS s FROM cal0)",
        f"""cal AS (SELECT target_date, n, s, strftime({local('s')}, '%H:%M') AS clock,
    CAST(hour({local('s')}) AS INTEGER) AS hour FROM cal1)""",
        """srcok AS (SELECT series_id, day FROM pan GROUP BY ALL HAVING count(y) / count(*) >= 0.9::DOUBLE)""",
        """prof AS (SELECT series_id, day AS source_day, clock, avg(y) AS v FROM pan GROUP BY ALL)""",
        """pts0 AS (SELECT q.series_id, q.target_date, q.model, q.h, q.issue_date, q.source_day, c.s, c.n, c.clock, c.hour, f.v
  FROM req q JOIN srcok k ON k.series_id = q.series_id AND k.day = q.source_day
  JOIN cal c ON c.target_date = q.target_date
  LEFT JOIN prof f ON f.series_id = q.series_id AND f.source_day = q.source_day AND f.clock = c.clock
  WHERE q.source_day <= q.issue_date)""",
        """pts AS (SELECT series_id, target_date, model, h, issue_date, source_day, s, n, clock, hour,
    coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY series_id, model, h, target_date ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(v IGNORE NULLS) OVER (PARTITION BY series_id, model, h, target_date ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p
  FROM pts0)""",
    ]


def errors(n_days: int, min_days: int) -> list[str]:
    """err (errors of usable days), nerr (forecasts with enough error days)."""
    return [
        """err0 AS (SELECT p.series_id, p.model, p.h, p.target_date, p.s, p.n, p.clock, p.hour, a.y - p.p AS e
  FROM pts p JOIN pan a ON a.series_id = p.series_id AND a.day = p.target_date AND a.s = p.s WHERE a.y IS NOT NULL)""",
        """okd AS (SELECT series_id, model, h, target_date FROM err0 GROUP BY ALL HAVING count(e) >= 0.9::DOUBLE * max(n))""",
        """err AS (SELECT e.* FROM err0 e JOIN okd USING (series_id, model, h, target_date))""",
        """ask AS (SELECT DISTINCT series_id, model, h, target_date, issue_date FROM pts)""",
        f"""nerr AS (SELECT q.series_id, q.model, q.h, q.target_date, q.issue_date, count(*) AS n_days
  FROM ask q JOIN okd o ON o.series_id = q.series_id AND o.model = q.model AND o.h = q.h
    AND o.target_date <= q.issue_date AND o.target_date > q.issue_date - {n_days}
  GROUP BY ALL HAVING count(*) >= {min_days})""",
    ]


def bands(n_days: int) -> list[str]:
    return [
        f"""pool AS (SELECT q.series_id, q.model, q.h, q.target_date, e.hour, list(e.e ORDER BY e.e) AS a
  FROM nerr q JOIN err e ON e.series_id = q.series_id AND e.model = q.model AND e.h = q.h
    AND e.target_date <= q.issue_date AND e.target_date > q.issue_date - {n_days}
  GROUP BY ALL)""",
        f"""eq0 AS (SELECT q.series_id, q.model, q.h, q.target_date, CAST(t.hour AS INTEGER) AS hour,
    {quantile('p.a', 0.1)} AS lo, {quantile('p.a', 0.9)} AS hi
  FROM nerr q CROSS JOIN range(24) t(hour)
  LEFT JOIN pool p ON p.series_id = q.series_id AND p.model = q.model AND p.h = q.h AND p.target_date = q.target_date AND p.hour = t.hour)""",
        """eqs AS (SELECT series_id, model, h, target_date, hour,
    coalesce(lo, last_value(lo IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(lo IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS e10,
    coalesce(hi, last_value(hi IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(hi IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS e90
  FROM eq0 WINDOW w AS (PARTITION BY series_id, model, h, target_date ORDER BY hour))""",
        """fc AS (SELECT p.series_id, p.model, p.h, p.issue_date, p.target_date, p.s, p.hour,
    least(p.p + q.e10, p.p) AS q10, p.p AS q50, greatest(p.p + q.e90, p.p) AS q90
  FROM pts p JOIN eqs q ON q.series_id = p.series_id AND q.model = p.model AND q.h = p.h AND q.target_date = p.target_date AND q.hour = p.hour)""",
    ]


def pinball(y: str = "actual") -> str:
    one = lambda q, t: f"greatest({t!r}::DOUBLE * ({y} - {q}), {t - 1.0!r}::DOUBLE * ({y} - {q}))"
    return f"(({one('q10', 0.1)} + {one('q50', 0.5)} + {one('q90', 0.9)}) / 3.0::DOUBLE)"


def scores(live_since: str | None = None) -> list[str]:
    """due, sc: one row per due forecast and slot."""
    models = ", ".join(f"('{m}')" for m in MODELS)
    live = f" WHERE d.day - h.h >= DATE '{live_since}'" if live_since else ""
    return [
        f"""due AS (SELECT d.series_id, m.model, h.h, d.day - h.h AS issue_date, d.day AS target_date
  FROM dd d, (VALUES {models}) m(model), (VALUES (1), (2)) h(h){live})""",
        """sc0 AS (SELECT d.series_id, d.model, d.h, d.issue_date, d.target_date, a.s, a.y AS actual, f.q10, f.q50, f.q90,
    max(f.q50 IS NOT NULL) OVER (PARTITION BY d.series_id, d.model, d.h, d.target_date) AS issued,
    max(f.q50 IS NULL) OVER (PARTITION BY d.series_id, d.model, d.h, d.target_date) AS gap
  FROM due d JOIN pan a ON a.series_id = d.series_id AND a.day = d.target_date
  LEFT JOIN fc f ON f.series_id = d.series_id AND f.model = d.model AND f.h = d.h AND f.target_date = d.target_date AND f.s = a.s)""",
        f"""sc AS (SELECT series_id, model, model || '.v1' AS model_key, h AS horizon_days, issue_date, target_date, s,
    CASE WHEN NOT issued THEN 'missed' WHEN gap THEN 'incomplete' ELSE 'scored' END AS status,
    actual, q10, q50, q90, actual - q50 AS error, abs(actual - q50) AS abs_error,
    (actual - q50) * (actual - q50) AS sq_error,
    CASE WHEN q50 IS NOT NULL THEN {pinball()} END AS pinball,
    actual >= q10 AND actual <= q90 AS in_band
  FROM sc0)""",
    ]


def daily() -> str:
    return """daily AS (SELECT series_id, model_key, horizon_days, target_date, issue_date, status,
    avg(abs_error) AS mae, sqrt(avg(sq_error)) AS rmse, avg(pinball) AS pinball,
    avg(CAST(in_band AS INTEGER)) AS coverage_80, count(*) AS n_slots FROM sc GROUP BY ALL)"""


def tagged(source: str, name: str, columns: str = "*") -> list[str]:
    """Rows of ``source`` once per rolling window they fall into."""
    return [
        f"{name}_latest AS (SELECT series_id, max(target_date) AS latest FROM {source} GROUP BY 1)",
        f"""{name} AS (SELECT x.{columns}, w.wname AS "window" FROM {source} x JOIN {name}_latest l USING (series_id),
    (VALUES ('7d', 7), ('30d', 30), ('90d', 90), ('all', 1000000)) w(wname, days)
  WHERE w.days = 1000000 OR x.target_date > l.latest - w.days)""",
    ]


def windows(n_days: int, width: int, near: float) -> list[str]:
    """wp (means of the point), scen (outcome per scenario), rec (recommendation)."""
    sec = 900
    return [
        f"""wp0 AS (SELECT p.series_id, p.model, p.h, p.issue_date, p.target_date, p.s, p.p,
    sum(p.p) OVER w AS tot, count(*) OVER w AS c
  FROM pts p JOIN nerr USING (series_id, model, h, target_date)
  WINDOW w AS (PARTITION BY p.series_id, p.model, p.h, p.target_date ORDER BY p.s ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING))""",
        f"wp AS (SELECT series_id, model, h, issue_date, target_date, s, tot / {width} AS mean FROM wp0 WHERE c = {width})",
        "recw AS (SELECT series_id, model, h, issue_date, target_date, arg_min(s, (mean, s)) AS rec_s FROM wp GROUP BY ALL)",
        """eclk AS (SELECT series_id, model, h, target_date AS eday, clock, avg(e) AS e FROM err GROUP BY ALL)""",
        f"""scn0 AS (SELECT q.series_id, q.model, q.h, q.target_date, o.target_date AS eday, p.s, p.p, k.e
  FROM nerr q JOIN okd o ON o.series_id = q.series_id AND o.model = q.model AND o.h = q.h
    AND o.target_date <= q.issue_date AND o.target_date > q.issue_date - {n_days}
  JOIN pts p ON p.series_id = q.series_id AND p.model = q.model AND p.h = q.h AND p.target_date = q.target_date
  LEFT JOIN eclk k ON k.series_id = q.series_id AND k.model = q.model AND k.h = q.h AND k.eday = o.target_date AND k.clock = p.clock)""",
        """scn1 AS (SELECT series_id, model, h, target_date, eday, s, p + coalesce(e,
      last_value(e IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(e IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS x
  FROM scn0 WINDOW w AS (PARTITION BY series_id, model, h, target_date, eday ORDER BY s))""",
        f"""scn2 AS (SELECT series_id, model, h, target_date, eday, s, sum(x) OVER w / {width} AS mean, count(*) OVER w AS c
  FROM scn1 WINDOW w AS (PARTITION BY series_id, model, h, target_date, eday ORDER BY s ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING))""",
        f"""scen AS (SELECT x.series_id, x.model, x.h, x.target_date, x.eday, arg_min(x.s, (x.mean, x.s)) AS best_s,
    max(CASE WHEN x.s = r.rec_s THEN x.mean END) - min(x.mean) AS regret
  FROM scn2 x JOIN recw r USING (series_id, model, h, target_date) WHERE x.c = {width} GROUP BY ALL)""",
        """prob AS (SELECT w.series_id, w.model, w.h, w.target_date, w.s, w.mean,
    count(c.eday) / max(t.n) AS p
  FROM wp w LEFT JOIN scen c ON c.series_id = w.series_id AND c.model = w.model AND c.h = w.h AND c.target_date = w.target_date AND c.best_s = w.s
  JOIN (SELECT series_id, model, h, target_date, count(*) AS n FROM scen GROUP BY ALL) t
    ON t.series_id = w.series_id AND t.model = w.model AND t.h = w.h AND t.target_date = w.target_date
  GROUP BY ALL)""",
        f"""near AS (SELECT series_id, model, h, target_date, count(*) AS n_scenarios,
    avg(CASE WHEN regret <= {near} THEN 1 ELSE 0 END) AS p_near FROM scen GROUP BY ALL)""",
        f"""rec AS (SELECT r.series_id, r.model, r.h, r.issue_date, r.target_date, r.rec_s, r.rec_s + {width * sec} AS end_s,
    {re_('w.mean', 2)} AS expected_mean, {re_('d.day_mean', 2)} AS day_mean, {re_('p.p', 3)} AS p_cheapest,
    {re_('n.p_near', 3)} AS p_near, n.n_scenarios
  FROM recw r JOIN wp w ON w.series_id = r.series_id AND w.model = r.model AND w.h = r.h AND w.target_date = r.target_date AND w.s = r.rec_s
  JOIN prob p ON p.series_id = r.series_id AND p.model = r.model AND p.h = r.h AND p.target_date = r.target_date AND p.s = r.rec_s
  JOIN near n ON n.series_id = r.series_id AND n.model = r.model AND n.h = r.h AND n.target_date = r.target_date
  JOIN (SELECT series_id, model, h, target_date, avg(p) AS day_mean FROM pts GROUP BY ALL) d
    ON d.series_id = r.series_id AND d.model = r.model AND d.h = r.h AND d.target_date = r.target_date)""",
    ]


def realized(width: int, near: float) -> list[str]:
    """rw: recommended windows of due forecasts against what happened."""
    return [
        f"""aw0 AS (SELECT series_id, day, s, sum(y) OVER w / {width} AS mean, count(*) OVER w AS c
  FROM pan WINDOW w AS (PARTITION BY series_id, day ORDER BY s ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING))""",
        f"aw AS (SELECT series_id, day, s, mean FROM aw0 WHERE c = {width})",
        "ab AS (SELECT series_id, day, arg_min(s, (mean, s)) AS best_s, min(mean) AS best_mean FROM aw GROUP BY ALL)",
        "am AS (SELECT series_id, day, avg(y) AS day_mean FROM pan GROUP BY ALL)",
        f"""rw AS (SELECT d.series_id, d.model, d.h AS horizon_days, d.issue_date, d.target_date,
    CASE WHEN c.rec_s IS NULL THEN 'missed' ELSE 'scored' END AS status, c.rec_s, c.expected_mean, c.p_cheapest, c.p_near,
    CASE WHEN c.rec_s IS NOT NULL THEN b.best_s END AS best_s, w.mean AS actual_mean_recommended,
    CASE WHEN c.rec_s IS NOT NULL THEN b.best_mean END AS actual_mean_best,
    CASE WHEN c.rec_s IS NOT NULL THEN m.day_mean END AS actual_day_mean,
    CASE WHEN c.rec_s IS NOT NULL THEN c.rec_s = b.best_s END AS hit,
    w.mean - b.best_mean <= {near} AS near, w.mean - b.best_mean AS regret
  FROM due d JOIN ab b ON b.series_id = d.series_id AND b.day = d.target_date
  JOIN am m ON m.series_id = d.series_id AND m.day = d.target_date
  LEFT JOIN rec c ON c.series_id = d.series_id AND c.model = d.model AND c.h = d.h AND c.target_date = d.target_date
  LEFT JOIN aw w ON w.series_id = d.series_id AND w.day = d.target_date AND w.s = c.rec_s)""",
    ]


def ev_base(with_bands: bool = True) -> list[str]:
    """Quarter-hour event panel with points, errors and (optionally) bands."""
    out = panel("ev15") + points("ev15") + errors(6, 4)
    return out + bands(6) if with_bands else out
