"""SQL fragments (DuckDB) that several queries' SQL shares."""

from __future__ import annotations

import math

from ..functions.methods import Method, kernel_weights

SERIES = """ev AS (
  SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
    CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS x, event_type, value, ts, event_id FROM events
), nn AS (SELECT run_id, count(*) AS n FROM ev GROUP BY run_id)"""

#: Islands of equal values in z(run_id, frame, x).
RUNS = """isl AS (SELECT run_id, frame, frame - row_number() OVER (PARTITION BY run_id, x ORDER BY frame) AS g, x FROM ev
), runs AS (SELECT run_id, min(frame) AS start, max(frame) + 1 AS stop FROM isl WHERE x = 1 GROUP BY run_id, g
), brief AS (SELECT r.* FROM runs r JOIN nn USING (run_id) WHERE stop - start <= 3 AND start > 0 AND stop < n)"""

EDGES = """edges AS (
  SELECT *, coalesce(x <> lag(x) OVER w, false) OR coalesce(x <> lead(x) OVER w, false) AS edge FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY frame))"""


def uniform(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def kernels(methods: list[Method]) -> str:
    """A table ks(kid, k, w) of the kernels of some methods, from their formulas."""
    parts = []
    for kind, param in dict.fromkeys(m.kernel for m in methods):
        w = len(kernel_weights(kind, param)) // 2
        offsets = f"range({-w}, {w + 1}) t(k)"
        if kind == "resolvent":
            s = math.sqrt(1 + param)
            weight = f"pow({(s - 1) / (s + 1)!r}::DOUBLE, abs(k)) / {s!r}::DOUBLE"
        elif kind == "gaussian":
            weight = f"exp(-0.5::DOUBLE * k * k / {param * param!r}::DOUBLE) / sum(exp(-0.5::DOUBLE * k * k / {param * param!r}::DOUBLE)) OVER ()"
        else:
            weight = f"1.0::DOUBLE / {2 * w + 1}"
        parts.append(f"SELECT '{kernel_id(kind, param)}' AS kid, k, {weight} AS w FROM {offsets}")
    return "ks AS (" + " UNION ALL ".join(parts) + ")"


def kernel_id(kind: str, param: float) -> str:
    return f"{kind}:{param:g}"


def convolved(source: str, column: str, keys: str = "run_id", name: str = "h") -> str:
    """name(keys, frame, kid, h): source convolved with ks, reflected at both ends; source has n."""
    on = " AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    a = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    m = "(((a.frame + k) % (2 * a.n) + 2 * a.n) % (2 * a.n))"
    return f"""{name} AS (
  SELECT {a}, a.frame, kid, sum(w * b.{column}) AS h FROM {source} a CROSS JOIN ks
  JOIN {source} b ON {on} AND b.frame = CASE WHEN {m} < a.n THEN {m} ELSE 2 * a.n - 1 - {m} END
  GROUP BY {a}, a.frame, kid)"""


def shaped(m: Method, level: float, h: str = "h") -> str:
    """The value of a method where h is its convolution."""
    c = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {h}))"
    if m.name == "median":
        return f"(CASE WHEN {h} > 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE"
    if m.name == "cubic_median":
        return f"({c} * {c} * (3 - 2 * {c}))"
    if m.name == "oracle_debiased_linear":
        return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({c} - {level!r}::DOUBLE) / {1 - 2 * level!r}::DOUBLE))"
    if m.name == "hard_linear":
        return f"(CASE WHEN round({c}, 12) >= 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE"
    if m.name in ("power_full", "power_matched"):
        a = 3.0 if m.name == "power_matched" else m["alpha"]
        return f"(pow({c}, {a!r}::DOUBLE) / (pow({c}, {a!r}::DOUBLE) + pow(1 - {c}, {a!r}::DOUBLE)))"
    return c


def methods_union(methods: list[Method], level: float, keys: str) -> str:
    """p(keys, frame, method, cand_ord, h, p) from h."""
    rows = [f"SELECT {keys}, frame, '{m.name}' AS method, CAST({m.cand} AS INTEGER) AS cand_ord, h, {shaped(m, level)} AS p FROM h WHERE kid = '{kernel_id(*m.kernel)}'" for m in methods]
    return "p AS (" + " UNION ALL ".join(rows) + ")"
