"""SQL (DuckDB dialect) building blocks for the oracle queries.

Each block mirrors one Spark-side fixture or operator with independent,
plain SQL (windows, joins, aggregates), used only for checking.
"""

from __future__ import annotations

from floe.functions.text import NA_TOKENS, NUMBER_PATTERN


def r6(expr: str) -> str:
    """Round to 6 decimals through DECIMAL(38,10), as the Spark side does."""
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN isnan({x}) OR isinf({x}) THEN {x} "
            f"ELSE CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 6) AS DOUBLE) + 0.0 END)")


def na(expr: str) -> str:
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
    return f"(CASE WHEN {expr} IN ({toks}) THEN NULL ELSE {expr} END)"


def num(expr: str) -> str:
    t = f"trim({expr})"
    v = f"(CASE WHEN regexp_full_match({t}, '{NUMBER_PATTERN}') THEN TRY_CAST({t} AS DOUBLE) END)"
    return f"(CASE WHEN isnan({v}) OR isinf({v}) THEN NULL ELSE {v} END)"


def boolean(expr: str) -> str:
    return f"(CASE WHEN {expr} = 'TRUE' THEN 1 WHEN {expr} = 'FALSE' THEN 0 END)"


FLOWS_RAW = """flows_raw AS (
  SELECT event_id AS row_id,
    CASE WHEN event_id % 11 = 0 THEN '?' WHEN event_id % 13 = 0 THEN '-'
         WHEN event_id % 17 = 0 THEN 'inf' WHEN event_id % 19 = 0 THEN 'n/a'
         ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS value,
    CASE WHEN event_id % 3 = 0 THEN 'TRUE' WHEN event_id % 3 = 1 THEN 'FALSE' ELSE 'maybe' END AS flag,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'p' || CAST(user_id % 4 AS VARCHAR) END AS proto,
    CAST(NULL AS VARCHAR) AS empty,
    CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END AS label
  FROM events)"""

FLOWS_NA = f"""flows_na AS (
  SELECT row_id, {na('value')} AS value, {na('flag')} AS flag, {na('proto')} AS proto,
         {na('empty')} AS empty, {na('label')} AS label FROM flows_raw)"""

LINEITEM_KEY = ("concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
                "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
                "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))")

FLOWS_NUM = f"""flows_num AS (
  SELECT {LINEITEM_KEY} AS row_id, l_quantity, l_extendedprice, l_discount, l_tax,
         l_linestatus, l_returnflag FROM lineitem)"""

NUM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

FLOWS_NUM_LONG = """fn_long AS (
  SELECT row_id, 'l_quantity' AS feature, l_quantity AS value FROM flows_num
  UNION ALL SELECT row_id, 'l_extendedprice', l_extendedprice FROM flows_num
  UNION ALL SELECT row_id, 'l_discount', l_discount FROM flows_num
  UNION ALL SELECT row_id, 'l_tax', l_tax FROM flows_num)"""


def softmax3(a: str, b: str, c: str, which: int) -> str:
    """Max-subtracted softmax of three expressions, element ``which``."""
    m = f"greatest({a}, {b}, {c})"
    ea, eb, ec = f"exp({a} - {m})", f"exp({b} - {m})", f"exp({c} - {m})"
    total = f"(({ea} + {eb}) + {ec})"
    return f"({[ea, eb, ec][which]} / {total})"


PROBA_BIG = f"""pb_codes AS (
  SELECT lbl, CAST(row_number() OVER (ORDER BY lbl) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT l_returnflag AS lbl FROM lineitem WHERE l_returnflag IS NOT NULL)),
pb_raw AS (
  SELECT {LINEITEM_KEY} AS row_id, l_returnflag AS lbl, l_quantity / 50.0 AS qa,
         l_discount * 10.0 AS da, l_tax * 10.0 AS ta FROM lineitem),
proba_big AS (
  SELECT row_id, code AS y,
    {softmax3('qa', 'da', 'ta', 0)} AS t0, {softmax3('qa', 'da', 'ta', 1)} AS t1,
    {softmax3('qa', 'da', 'ta', 2)} AS t2,
    {softmax3('da', 'ta', 'qa', 0)} AS s0, {softmax3('da', 'ta', 'qa', 1)} AS s1,
    {softmax3('da', 'ta', 'qa', 2)} AS s2
  FROM pb_raw JOIN pb_codes USING (lbl)),
pb_long AS (
  SELECT row_id, y, 0 AS class, t0 AS t, s0 AS s FROM proba_big
  UNION ALL SELECT row_id, y, 1, t1, s1 FROM proba_big
  UNION ALL SELECT row_id, y, 2, t2, s2 FROM proba_big),
pb_pred AS (
  SELECT row_id, y,
    CASE WHEN t0 >= t1 AND t0 >= t2 THEN 0 WHEN t1 >= t2 THEN 1 ELSE 2 END AS pred,
    CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS pred_s
  FROM proba_big)"""

# embeddings -> 10-class probabilities, long form (row_id, y, class, t, s)
PROBA = """em_long AS (
  SELECT vec_id AS row_id, label AS y, CAST(i - 1 AS INTEGER) AS pos, CAST(x AS DOUBLE) AS x
  FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
pr_t AS (SELECT row_id, y, pos % 10 AS class, avg(x) AS x FROM em_long GROUP BY ALL),
pr_s AS (SELECT row_id, y, pos * 10 // 64 AS class, avg(x) AS x FROM em_long GROUP BY ALL),
pr_tm AS (SELECT *, exp(x - max(x) OVER (PARTITION BY row_id)) AS e FROM pr_t),
pr_sm AS (SELECT *, exp(x - max(x) OVER (PARTITION BY row_id)) AS e FROM pr_s),
proba_long AS (
  SELECT t.row_id, t.y, t.class, t.e / sum(t.e) OVER (PARTITION BY t.row_id) AS t,
         s.e / sum(s.e) OVER (PARTITION BY s.row_id) AS s
  FROM pr_tm t JOIN pr_sm s ON t.row_id = s.row_id AND t.class = s.class)"""


def split_ctes(prefix: str, src: str, test_size: float = 0.3, seed: int = 42) -> str:
    """Exact stratified split of ``src(row_id, lbl)`` into ``{prefix}_split(row_id, lbl, split)``."""
    p = prefix
    return f"""{p}_cnt AS (SELECT lbl, count(*) AS n_class FROM {src} GROUP BY lbl),
{p}_a AS (SELECT lbl, n_class, n, CAST(ceil(CAST(n AS DOUBLE) * {test_size}) AS BIGINT) AS n_test
          FROM {p}_cnt, (SELECT sum(n_class) AS n FROM {p}_cnt)),
{p}_b AS (SELECT *, (CAST(n_class AS HUGEINT) * (n - n_test)) // n AS fl,
                 (CAST(n_class AS HUGEINT) * (n - n_test)) % n AS rem FROM {p}_a),
{p}_c AS (SELECT *, (n - n_test) - sum(fl) OVER () AS need,
                 row_number() OVER (ORDER BY rem DESC, lbl) AS rk FROM {p}_b),
{p}_quota AS (SELECT lbl, n_class - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS n_test_class FROM {p}_c),
{p}_pos AS (SELECT row_id, lbl, row_number() OVER (PARTITION BY lbl
              ORDER BY md5('{seed}:0:' || CAST(row_id AS VARCHAR)), row_id) - 1 AS p FROM {src}),
{p}_split AS (SELECT row_id, lbl, CASE WHEN p < n_test_class THEN 'test' ELSE 'train' END AS split
              FROM {p}_pos JOIN {p}_quota USING (lbl))"""


def report_ctes(pred_src: str, names_src: str) -> str:
    """Classification report from ``pred_src(y, pred)`` and ``names_src(code, label)`` -> ``report``."""
    return f"""cc AS (SELECT y, pred, count(*) AS n FROM {pred_src} GROUP BY y, pred),
bt AS (SELECT y AS code, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS tp, sum(n) AS support FROM cc GROUP BY y),
bp AS (SELECT pred AS code, sum(n) AS predicted FROM cc GROUP BY pred),
pc AS (SELECT coalesce(bt.code, bp.code) AS code, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
              coalesce(predicted, 0) AS predicted FROM bt FULL OUTER JOIN bp ON bt.code = bp.code),
sc AS (SELECT code,
         CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(predicted AS DOUBLE) END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) END AS recall,
         CASE WHEN support + predicted = 0 THEN 0.0
              ELSE CAST(2 * tp AS DOUBLE) / CAST(support + predicted AS DOUBLE) END AS f1,
         CAST(support AS BIGINT) AS support
       FROM pc WHERE support > 0 OR predicted > 0),
report AS (
  SELECT n.label AS class, precision, recall, f1, support FROM sc JOIN {names_src} n USING (code)
  UNION ALL
  SELECT 'accuracy', a, a, a, tot FROM (
    SELECT CAST(sum(CASE WHEN y = pred THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS a,
           CAST(sum(n) AS BIGINT) AS tot FROM cc)
  UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM sc
  UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM sc)"""


def report_select(src: str = "report") -> str:
    return (f"SELECT class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, "
            f"support FROM {src}")


def roc_ctes(ovr_src: str) -> str:
    """Per-(class, score) counts and cumulative (tp, fp) of ``ovr_src(class, score, is_pos)``."""
    return f"""ps AS (SELECT class, score, CAST(sum(is_pos) AS BIGINT) AS pos,
                    CAST(count(*) - sum(is_pos) AS BIGINT) AS neg FROM {ovr_src} GROUP BY class, score),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
               row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY class) AS m
        FROM ps WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
tot AS (SELECT class, sum(pos) AS P, sum(neg) AS N FROM ps GROUP BY class)"""


def positions_cte(name: str = "ser") -> str:
    return f"""{name} AS (SELECT user_id AS entity, event_id AS id, value AS x,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
