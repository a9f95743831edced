"""DuckDB oracle SQL for the registered queries (independent plain-SQL versions).

Queries that train a learned model (forest, logistic regression) or time
a run have no oracle; they get a rows-only check.
"""

from __future__ import annotations

from floe.plans.sqlparts import (LINEITEM_KEY, FLOWS_NA, FLOWS_NUM, FLOWS_RAW, PROBA, PROBA_BIG, boolean, num,
                                 positions_cte, r6, report_ctes, report_select, roc_ctes, split_ctes)

SQL: dict[str, str] = {}

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _finite(x: str) -> str:
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END)"


# ---------------------------------------------------------------- flagship
# From lf(row_id, split, lbl, feature, v) and codes(lbl, code): scale on train,
# class centroids on train, softmax of negative squared distance, argmax.
_CENTROID_TAIL = """st AS (SELECT feature, avg(v) AS mu,
              CASE WHEN stddev_pop(v) = 0 OR stddev_pop(v) IS NULL THEN 1.0 ELSE stddev_pop(v) END AS sd
       FROM lf WHERE split = 'train' GROUP BY feature),
z AS (SELECT lf.row_id, lf.split, codes.code AS y, lf.feature, (lf.v - st.mu) / st.sd AS v
      FROM lf JOIN st USING (feature) JOIN codes USING (lbl)),
cent AS (SELECT y AS k, feature, avg(v) AS mu FROM z WHERE split = 'train' GROUP BY y, feature),
dist AS (SELECT z.row_id, z.y, cent.k, -sum((z.v - cent.mu) * (z.v - cent.mu)) AS nd
         FROM z JOIN cent USING (feature) WHERE z.split = 'test' GROUP BY z.row_id, z.y, cent.k),
d2 AS (SELECT *, exp(nd - max(nd) OVER (PARTITION BY row_id)) AS e FROM dist),
prob AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM d2),
pred AS (SELECT row_id, y, k AS pred, p FROM (
           SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, k) AS r FROM prob) WHERE r = 1)"""

_LONG_FEATURES = "\n  UNION ALL ".join(
    f"SELECT row_id, split, lbl, '{n}' AS feature, coalesce({n}, (SELECT m_{n} FROM med)) AS v FROM cl"
    for n in NUM)

PREPARED = f"""{FLOWS_NUM},
fsrc AS (SELECT row_id, coalesce(l_returnflag, 'missing') AS lbl FROM flows_num),
{split_ctes('fs', 'fsrc')},
cl AS (SELECT f.row_id, s.split, s.lbl, {', '.join(_finite(n) + ' AS ' + n for n in NUM)},
              coalesce(f.l_linestatus, 'missing') AS ls
       FROM flows_num f JOIN fs_split s USING (row_id)),
med AS (SELECT {', '.join(f'median({n}) AS m_{n}' for n in NUM)} FROM cl),
codes AS (SELECT lbl, CAST(row_number() OVER (ORDER BY lbl) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT lbl FROM cl)),
names AS (SELECT code, lbl AS label FROM codes),
vocab AS (SELECT DISTINCT ls FROM cl),
lf AS ({_LONG_FEATURES}
  UNION ALL SELECT row_id, split, lbl, 'l_linestatus=' || vocab.ls,
                   CASE WHEN cl.ls = vocab.ls THEN 1.0 ELSE 0.0 END FROM cl, vocab),
{_CENTROID_TAIL}"""

SQL["flagship_classification_report"] = f"""WITH {PREPARED},
{report_ctes('pred', 'names')}
{report_select()}"""

# the same with the part as a second category: dense one-hot features would be one for each part
_PART = "split_part(row_id, '-', 3)"
SQL["a4_sparse_flow_report"] = f"""WITH {PREPARED},
one AS (SELECT cl.row_id, cl.split, codes.code AS y, {_PART} AS part FROM cl JOIN codes USING (lbl)),
tot AS (SELECT count(*) AS n FROM one WHERE split = 'train'),
per AS (SELECT y, count(*) AS n_k FROM one WHERE split = 'train' GROUP BY y),
hit AS (SELECT part, y, count(*) AS n FROM one WHERE split = 'train' GROUP BY part, y),
grid AS (SELECT a.part, per.y, coalesce(h.n, 0) / n_k AS r,
                sum(coalesce(h.n, 0)) OVER (PARTITION BY a.part) / tot.n AS p
         FROM (SELECT DISTINCT part FROM hit) a CROSS JOIN per CROSS JOIN tot
         LEFT JOIN hit h ON h.part = a.part AND h.y = per.y),
gap AS (SELECT part, y, (1 - 2 * r) / v AS delta, r * r / v AS zero
        FROM (SELECT *, CASE WHEN p < 1 THEN p * (1 - p) ELSE 1.0 END AS v FROM grid)),
zero AS (SELECT y, sum(zero) AS z FROM gap GROUP BY y),
summed AS (SELECT dist.row_id, dist.y, dist.k, dist.nd - zero.z - coalesce(gap.delta, 0) AS nd
         FROM dist JOIN one USING (row_id) JOIN zero ON zero.y = dist.k LEFT JOIN gap ON gap.part = one.part AND gap.y = dist.k),
best AS (SELECT row_id, y, k AS pred FROM summed
         QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY nd DESC, k) = 1),
{report_ctes('best', 'names')}
{report_select()}"""

SQL["k3_batch_scoring"] = f"""WITH {PREPARED}
SELECT row_id, CAST(k AS INTEGER) AS class, {r6('p')} AS p FROM prob"""
# soft targets of the train rows: the centroid softmax once more at temperature 10, blended with the true class
SQL["k4_distillation_targets"] = f"""WITH {PREPARED},
td AS (SELECT z.row_id, z.y, cent.k, -sum((z.v - cent.mu) * (z.v - cent.mu)) AS nd
       FROM z JOIN cent USING (feature) WHERE z.split = 'train' GROUP BY z.row_id, z.y, cent.k),
te AS (SELECT *, exp(nd - max(nd) OVER (PARTITION BY row_id)) AS e FROM td),
tp AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM te),
ts AS (SELECT *, exp(p / 10.0 - max(p / 10.0) OVER (PARTITION BY row_id)) AS s FROM tp)
SELECT row_id, CAST(k AS INTEGER) AS target,
       {r6("0.5 * CASE WHEN k = y THEN 1.0 ELSE 0.0 END + 0.5 * s / sum(s) OVER (PARTITION BY row_id)")} AS weight FROM ts"""
SQL["k1_teacher_centroid"] = f"""WITH {PREPARED}
SELECT row_id, y, CAST(pred AS INTEGER) AS pred, {r6('p')} AS p_pred FROM pred"""

# Newton steps of the multinomial logistic student from 0, over rows tr(x, y, q): x holds the
# features and a 1, q the soft labels.  A step sums gradient and Hessian and solves the system
# by elimination (a recursive walk over the pivots).
STEPS = 7


def _softmax_list(scores: str) -> str:
    e = f"list_transform({scores}, lambda v: exp(v - list_max({scores})))"
    return f"list_transform({e}, lambda v: v / list_sum({e}))"


def _newton_ctes(alpha: float, temperature: float = 10.0) -> str:
    t, soft = temperature, 1 - alpha
    ctes = ["""dims AS (SELECT CAST(max(y) + 1 AS BIGINT) AS k, CAST(max(len(x)) AS BIGINT) AS d FROM tr),
w0 AS (SELECT list_transform(range(k), lambda a: list_transform(range(d), lambda i: CAST(0.0 AS DOUBLE))) AS w FROM dims)"""]
    for n in range(STEPS):
        ctes.append(f"""z{n} AS MATERIALIZED (SELECT x, y, q, list_transform(w, lambda r: list_dot_product(r, x)) AS z FROM tr, w{n}),
p{n} AS MATERIALIZED (SELECT x, y, q, {_softmax_list('z')} AS p,
       {_softmax_list(f'list_transform(z, lambda v: v / {t})')} AS s FROM z{n}),
u{n} AS MATERIALIZED (SELECT x,
       list_transform(p, lambda v, a: {alpha} * (v - CASE WHEN y = a - 1 THEN 1.0 ELSE 0.0 END) + {soft * t} * (s[a] - q[a])) AS r,
       flatten(list_transform(p, lambda v, a: list_transform(p, lambda o, b:
         {alpha} * v * (CASE WHEN a = b THEN 1.0 ELSE 0.0 END - o)
         + {soft} * s[a] * (CASE WHEN a = b THEN 1.0 ELSE 0.0 END - s[b])))) AS h FROM p{n}),
g{n} AS MATERIALIZED (SELECT list(v ORDER BY pos) AS g FROM (
       SELECT pos, sum(v) / (SELECT count(*) FROM tr) AS v FROM (
         SELECT unnest(f) AS v, generate_subscripts(f, 1) AS pos
         FROM (SELECT flatten(list_transform(r, lambda a: list_transform(x, lambda i: a * i))) AS f FROM u{n})) GROUP BY pos)),
h{n} AS MATERIALIZED (SELECT pos, sum(v) / (SELECT count(*) FROM tr) AS v FROM (
       SELECT unnest(f) AS v, generate_subscripts(f, 1) - 1 AS pos
       FROM (SELECT flatten(list_transform(h, lambda c: flatten(list_transform(x, lambda i: list_transform(x, lambda j: c * i * j))))) AS f
             FROM u{n})) GROUP BY pos),
cell{n} AS (SELECT (pos // (k * d * d)) * d + pos // d % d AS i, pos // (d * d) % k * d + pos % d AS j, v FROM h{n}, dims),
row{n} AS (SELECT i, list(v + CASE WHEN i = j THEN 1e-6 ELSE 0.0 END ORDER BY j) AS l FROM cell{n} GROUP BY i),
flat{n} AS (SELECT flatten(w) AS f FROM w{n}),
e{n}(p, m) AS (
  SELECT CAST(1 AS BIGINT), list(list_append(l, g[i + 1] + 1e-6 * f[i + 1]) ORDER BY i) FROM row{n}, g{n}, flat{n}
  UNION ALL
  SELECT p + 1, list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda v: v / r[p])
    ELSE list_transform(r, lambda v, j: v - r[p] / m[p][p] * m[p][j]) END)
  FROM e{n} WHERE p <= len(m)),
w{n + 1} AS MATERIALIZED (SELECT list_transform(range(k), lambda a: list_transform(range(d), lambda i:
       w[a + 1][i + 1] - m[a * d + i + 1][len(m) + 1])) AS w
       FROM w{n}, dims, (SELECT m FROM e{n} WHERE p = len(m) + 1))""")
    return ",\n".join(ctes)


def _student_sql(alpha: float, soft_ctes: str, soft: str) -> str:
    return f"""WITH RECURSIVE {PREPARED},
wide AS (SELECT row_id, split, y, list_append(list(v ORDER BY feature), 1.0) AS x FROM z GROUP BY row_id, split, y),
{soft_ctes}tr AS MATERIALIZED (SELECT x, y, {soft} AS q FROM wide {"JOIN tq USING (row_id) " if soft_ctes else ""}WHERE split = 'train'),
{_newton_ctes(alpha)},
st_p AS (SELECT row_id, y, {_softmax_list('z')} AS p
         FROM (SELECT row_id, y, list_transform(w, lambda r: list_dot_product(r, x)) AS z FROM wide, w{STEPS} WHERE split = 'test'))
SELECT row_id, y, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred,
       CAST(round(CAST(list_max(p) AS DECIMAL(38,10)), 4) AS DOUBLE) AS p_pred FROM st_p"""


SQL["k2_student"] = _student_sql(1.0, "", "[0.0, 0.0, 0.0]")
SQL["k4_distilled_student"] = _student_sql(0.5, """td AS (SELECT z.row_id, cent.k, -sum((z.v - cent.mu) * (z.v - cent.mu)) AS nd
       FROM z JOIN cent USING (feature) WHERE z.split = 'train' GROUP BY z.row_id, cent.k),
te AS (SELECT *, exp(nd - max(nd) OVER (PARTITION BY row_id)) AS e FROM td),
tp AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM te),
ts AS (SELECT *, exp(p / 10.0 - max(p / 10.0) OVER (PARTITION BY row_id)) AS s FROM tp),
tq AS (SELECT row_id, list(s / t ORDER BY k) AS q FROM (SELECT *, sum(s) OVER (PARTITION BY row_id) AS t FROM ts) GROUP BY row_id),
""", "q")

# ---------------------------------------------------------------- S
SQL["s1_csv_scan"] = f"WITH {FLOWS_RAW}, {FLOWS_NA} SELECT row_id, value, flag, proto, empty, label FROM flows_na"
SQL["s2_na_tokens"] = SQL["s1_csv_scan"]

SQL["s3_paired_scan"] = f"""WITH {FLOWS_RAW}, {FLOWS_NA},
lab AS (SELECT *, coalesce(label, 'missing') AS lbl FROM flows_na),
{split_ctes('sp', 'lab')}
SELECT l.row_id, {r6(num('l.value'))} AS value, {boolean('l.flag')} AS flag,
       coalesce(l.proto, 'missing') AS proto, l.lbl AS label, s.split AS part
FROM lab l JOIN sp_split s USING (row_id)"""

SQL["s4_tuple_source"] = f"""WITH {PROBA_BIG},
sm AS (SELECT row_id, y, class, exp(s / 10.0 - max(s / 10.0) OVER (PARTITION BY row_id)) AS e FROM pb_long)
SELECT row_id, y, CAST(class AS INTEGER) AS class, {r6('e / sum(e) OVER (PARTITION BY row_id)')} AS soft FROM sm"""

_PB_NAMES = "names AS (SELECT code, lbl AS label FROM pb_codes)"
_PB_REPORT = f"""WITH {PROBA_BIG}, {_PB_NAMES},
{report_ctes('pb_pred', 'names')}"""

SQL["s5_report_sink"] = f"{_PB_REPORT}\n{report_select()}"

# ---------------------------------------------------------------- P
_NA = f"WITH {FLOWS_RAW}, {FLOWS_NA}"
SQL["p1_drop_columns"] = f"{_NA} SELECT row_id, value, flag, proto, label FROM flows_na"
SQL["p2_feature_selection"] = f"{_NA} SELECT row_id, value, flag, empty FROM flows_na"
SQL["p3_inf_to_null"] = f"""{_NA}
SELECT row_id, (isnan(TRY_CAST(trim(value) AS DOUBLE)) OR isinf(TRY_CAST(trim(value) AS DOUBLE))) AS non_finite,
       {r6(num('value'))} AS value FROM flows_na"""
SQL["p4_bool_text"] = f"{_NA} SELECT row_id, {boolean('flag')} AS flag FROM flows_na"
SQL["p5_to_numeric"] = f"""{_NA}
SELECT row_id, {r6(num('value'))} AS value, {r6(num('flag'))} AS flag, {r6(num('proto'))} AS proto FROM flows_na"""
SQL["p6_fill_missing"] = f"""{_NA}
SELECT row_id, coalesce(proto, 'missing') AS proto, coalesce(label, 'missing') AS label FROM flows_na"""
SQL["p7_label_text"] = "SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label FROM embeddings"
SQL["p8_common_columns"] = f"""{_NA}
SELECT row_id, coalesce(proto, 'missing') AS proto, coalesce(label, 'missing') AS label FROM flows_na"""
SQL["p9_non_empty_columns"] = f"""{_NA}
SELECT 'value' AS feature, CAST(count(value) AS BIGINT) AS non_null FROM flows_na
UNION ALL SELECT 'flag', CAST(count(flag) AS BIGINT) FROM flows_na
UNION ALL SELECT 'proto', CAST(count(proto) AS BIGINT) FROM flows_na
UNION ALL SELECT 'empty', CAST(count(empty) AS BIGINT) FROM flows_na
UNION ALL SELECT 'label', CAST(count(label) AS BIGINT) FROM flows_na"""
SQL["p10_hstack"] = f"""{_NA},
v AS (SELECT row_id, {num('value')} AS value, coalesce(proto, 'missing') AS proto FROM flows_na),
m AS (SELECT median(value) AS mv FROM v),
vocab AS (SELECT proto AS cat, CAST(row_number() OVER (ORDER BY proto) AS INTEGER) AS k FROM (SELECT DISTINCT proto FROM v))
SELECT row_id, 0 AS pos, {r6('coalesce(value, (SELECT mv FROM m))')} AS x FROM v
UNION ALL
SELECT row_id, k AS pos, {r6('CASE WHEN v.proto = vocab.cat THEN 1.0 ELSE 0.0 END')} AS x FROM v, vocab"""
SQL["p11_reshape"] = f"""WITH {FLOWS_NUM}
SELECT row_id, 0 AS pos, 1 AS channels, {r6('l_quantity')} AS x FROM flows_num
UNION ALL SELECT row_id, 1, 1, {r6('l_extendedprice')} FROM flows_num
UNION ALL SELECT row_id, 2, 1, {r6('l_discount')} FROM flows_num
UNION ALL SELECT row_id, 3, 1, {r6('l_tax')} FROM flows_num"""
SQL["p12_float32"] = f"""WITH {PROBA_BIG}
SELECT row_id, CAST(class AS INTEGER) AS class, {r6('CAST(CAST(t AS FLOAT) AS DOUBLE)')} AS p FROM pb_long"""
SQL["p13_nest_targets"] = f"""WITH {PROBA_BIG},
sm AS (SELECT row_id, y, exp(t / 10.0 - max(t / 10.0) OVER (PARTITION BY row_id)) AS e FROM pb_long),
soft AS (SELECT row_id, y, e / sum(e) OVER (PARTITION BY row_id) AS p FROM sm)
SELECT row_id, y, {r6('max(p)')} AS soft_max, 3 AS width FROM soft GROUP BY row_id, y"""

# ---------------------------------------------------------------- J
SQL["j1_zip_rows"] = f"WITH {PROBA_BIG} SELECT row_id, y, pred AS pred_t, pred_s FROM pb_pred"
SQL["j2_apply_params"] = f"""WITH {FLOWS_NUM},
st AS (SELECT {', '.join(f"avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END AS s_{n}" for n in NUM)} FROM flows_num)
SELECT row_id, {', '.join(r6(f'({n} - m_{n}) / s_{n}') + f' AS {n}' for n in NUM)} FROM flows_num, st"""
SQL["j3_label_lookup"] = f"""{_NA},
l AS (SELECT row_id, coalesce(label, 'missing') AS label FROM flows_na),
codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS y FROM (SELECT DISTINCT label FROM l))
SELECT row_id, y FROM l JOIN codes USING (label)"""
SQL["j4_label_decode"] = f"""WITH {PROBA_BIG}
SELECT row_id, CAST(pred AS INTEGER) AS pred, lbl AS pred_label FROM pb_pred JOIN pb_codes ON pred = code"""

# ---------------------------------------------------------------- A
SQL["a1_median_impute"] = f"""{_NA},
v AS (SELECT row_id, {num('value')} AS value FROM flows_na)
SELECT row_id, {r6('coalesce(value, (SELECT median(value) FROM v))')} AS value FROM v"""
SQL["a2_label_encoder"] = f"""{_NA}
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT coalesce(label, 'missing') AS label FROM flows_na)"""
SQL["a3_label_mapping"] = """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type IS NOT NULL)"""


# The fixture's vocabularies, in sorted (byte) order.
_A4_VOCAB = {"proto": ["missing", "p0", "p1", "p2", "p3"], "flag": ["FALSE", "TRUE", "maybe"]}
SQL["a4_one_hot"] = f"""{_NA},
f AS (SELECT row_id, coalesce(proto, 'missing') AS proto, coalesce(flag, 'missing') AS flag FROM flows_na)
SELECT row_id, {', '.join(f"CAST(CASE WHEN {col} = '{v}' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS \"{col}={v}\"" for col, vs in _A4_VOCAB.items() for v in vs)}
FROM f"""


SQL["a5_scaler_stats"] = f"""WITH {FLOWS_NUM}
{' UNION ALL '.join(f"SELECT '{n}' AS feature, {r6(f'avg({n})')} AS mean, {r6(f'CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END')} AS scale FROM flows_num" for n in NUM)}"""
SQL["a6_class_feature_counts"] = """SELECT CAST(count(DISTINCT l_returnflag) AS INTEGER) AS num_classes, 4 AS seq_len FROM lineitem"""
SQL["a7_class_support"] = """SELECT l_returnflag AS label, count(*) AS support FROM lineitem GROUP BY l_returnflag"""
SQL["a8_running_mean_loss"] = f"""WITH {PROBA_BIG},
ls AS (SELECT row_id, -ln(greatest(least(CASE y WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END, 1 - 1e-7), 1e-7)) AS loss
       FROM proba_big),
b AS (SELECT loss, CAST(floor((row_number() OVER (ORDER BY md5('42:0:' || row_id), row_id) - 1) / 256) AS BIGINT) AS batch_id FROM ls),
pb AS (SELECT batch_id, avg(loss) AS batch_loss FROM b GROUP BY batch_id)
SELECT batch_id, {r6('batch_loss')} AS batch_loss,
       {r6('avg(batch_loss) OVER (ORDER BY batch_id ROWS UNBOUNDED PRECEDING)')} AS running_mean FROM pb"""

# ---------------------------------------------------------------- D
SQL["d1_stratified_split"] = f"""WITH {FLOWS_NUM},
src AS (SELECT row_id, l_returnflag AS lbl FROM flows_num),
{split_ctes('d', 'src')}
SELECT row_id, split FROM d_split"""
_LI_ORDER = f"""WITH li AS (SELECT {LINEITEM_KEY} AS row_id, row_number() OVER (
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) - 1 AS i,
  count(*) OVER () AS n FROM lineitem)"""
SQL["d2_tail_validation"] = f"""{_LI_ORDER},
ix AS (SELECT row_id, i, n FROM li)
SELECT row_id, CASE WHEN i < floor(n * (1.0 - 0.1)) THEN 'train' ELSE 'validation' END AS split FROM ix"""
SQL["d3_stratified_sample"] = f"""WITH {FLOWS_NUM},
src AS (SELECT row_id, l_returnflag AS lbl FROM flows_num),
{split_ctes('d', 'src', 0.1)}
SELECT row_id, lbl AS l_returnflag FROM d_split WHERE split = 'test'"""
SQL["d4_seeded_shuffle"] = f"""WITH {FLOWS_NUM}
SELECT row_id, row_number() OVER (ORDER BY md5('42:1:' || row_id), row_id) - 1 AS pos FROM flows_num"""
SQL["d5_batches"] = f"""WITH {FLOWS_NUM}
SELECT row_id, CAST(floor((row_number() OVER (ORDER BY md5('42:0:' || row_id), row_id) - 1) / 256) AS BIGINT) AS batch_id
FROM flows_num"""
SQL["d6_row_index"] = f"""{_LI_ORDER} SELECT row_id, i AS idx FROM li"""

# ---------------------------------------------------------------- K
_SOFT = "exp({x} / 10.0 - max({x} / 10.0) OVER (PARTITION BY row_id))"
_LOGSOFT = "exp(ln(greatest(least({x}, 1.0), 1e-7)) / 10.0 - max(ln(greatest(least({x}, 1.0), 1e-7)) / 10.0) OVER (PARTITION BY row_id))"

SQL["k5_soft_labels"] = f"""WITH {PROBA_BIG},
sm AS (SELECT row_id, class, {_SOFT.format(x='t')} AS e FROM pb_long)
SELECT row_id, CAST(class AS INTEGER) AS class, {r6('e / sum(e) OVER (PARTITION BY row_id)')} AS soft FROM sm"""
SQL["k6_log_soft_labels"] = f"""WITH {PROBA_BIG},
sm AS (SELECT row_id, class, {_LOGSOFT.format(x='t')} AS e FROM pb_long)
SELECT row_id, CAST(class AS INTEGER) AS class, {r6('e / sum(e) OVER (PARTITION BY row_id)')} AS soft FROM sm"""

_LOSSES = f"""WITH {PROBA_BIG},
sm AS (SELECT row_id, y, class, {_SOFT.format(x='t')} AS et, {_SOFT.format(x='s')} AS es FROM pb_long),
soft AS (SELECT row_id, y, class, et / sum(et) OVER (PARTITION BY row_id) AS ts,
                es / sum(es) OVER (PARTITION BY row_id) AS ss FROM sm),
kl AS (SELECT row_id, sum(greatest(least(ts, 1.0), 1e-7) * ln(greatest(least(ts, 1.0), 1e-7) / greatest(least(ss, 1.0), 1e-7))) AS soft
       FROM soft GROUP BY row_id),
hard AS (SELECT row_id, -ln(greatest(least(CASE y WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END, 1 - 1e-7), 1e-7)) AS hard
         FROM proba_big),
l AS (SELECT avg(hard) AS hard, avg(soft) AS soft FROM hard JOIN kl USING (row_id))"""
SQL["k7_hard_loss"] = f"{_LOSSES} SELECT {r6('hard')} AS hard FROM l"
SQL["k8_soft_loss"] = f"{_LOSSES} SELECT {r6('soft')} AS soft FROM l"
SQL["k9_t2_soft_loss"] = f"{_LOSSES} SELECT {r6('soft * 100.0')} AS soft_t2 FROM l"
SQL["k10_blended_loss"] = f"""{_LOSSES}
SELECT 'alpha0.5_t2' AS variant, {r6('hard')} AS hard, {r6('soft * 100.0')} AS soft,
       {r6('0.5 * hard + 0.5 * (soft * 100.0)')} AS total FROM l
UNION ALL
SELECT 'alpha0.1', {r6('hard')}, {r6('soft')}, {r6('0.1 * hard + 0.9 * soft')} FROM l"""

_ATT = """em AS (SELECT vec_id AS row_id, CAST(x AS DOUBLE) AS x, CAST(i - 1 AS INTEGER) AS j
       FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
et AS (SELECT row_id, j // 4 AS pos, sum(x * x) AS en FROM em GROUP BY row_id, j // 4),
es AS (SELECT row_id, j // 8 AS pos, sum(x * x) AS en FROM em GROUP BY row_id, j // 8),
att_t AS (SELECT row_id, pos, en / (sum(en) OVER (PARTITION BY row_id) + 1e-8) AS a FROM et),
att_s AS (SELECT row_id, pos, en / (sum(en) OVER (PARTITION BY row_id) + 1e-8) AS a FROM es),
grid AS (SELECT i AS pos, (i + 0.5) * 8 / 16.0 - 0.5 AS src FROM range(16) t(i)),
gw AS (SELECT pos, CAST(greatest(floor(src), 0) AS INTEGER) AS lo, CAST(least(ceil(src), 7) AS INTEGER) AS hi,
              src - floor(src) AS w FROM grid),
rs AS (SELECT l.row_id, gw.pos, l.a + (h.a - l.a) * gw.w AS v
       FROM gw JOIN att_s l ON l.pos = gw.lo JOIN att_s h ON h.pos = gw.hi AND h.row_id = l.row_id),
atl AS (SELECT t.row_id, avg((t.a - r.v) * (t.a - r.v)) AS att FROM att_t t JOIN rs r ON r.row_id = t.row_id AND r.pos = t.pos
        GROUP BY t.row_id)"""

SQL["k11_attention_map"] = f"""WITH {_ATT}
SELECT row_id, CAST(pos AS INTEGER) AS pos, {r6('a')} AS att FROM att_t"""
SQL["k12_attention_loss"] = f"WITH {_ATT} SELECT {r6('avg(att)')} AS att FROM atl"
SQL["k13_resample"] = f"WITH {_ATT} SELECT row_id, CAST(pos AS INTEGER) AS pos, {r6('v')} AS v FROM rs"
SQL["k14_three_term_loss"] = f"""WITH {PROBA}, {_ATT},
sm AS (SELECT row_id, y, class, {_LOGSOFT.format(x='t')} AS et, {_LOGSOFT.format(x='s')} AS es, s FROM proba_long),
soft AS (SELECT row_id, y, class, s, et / sum(et) OVER (PARTITION BY row_id) AS ts,
                es / sum(es) OVER (PARTITION BY row_id) AS ss FROM sm),
per AS (SELECT row_id,
          sum(greatest(least(ts, 1.0), 1e-7) * ln(greatest(least(ts, 1.0), 1e-7) / greatest(least(ss, 1.0), 1e-7))) AS soft,
          max(CASE WHEN class = y THEN -ln(greatest(least(s, 1 - 1e-7), 1e-7)) END) AS hard
        FROM soft GROUP BY row_id),
l AS (SELECT avg(hard) AS hard, avg(soft) AS soft, avg(att) AS att FROM per JOIN atl USING (row_id))
SELECT {r6('hard')} AS hard, {r6('soft')} AS soft, {r6('att')} AS att,
       {r6('0.5 * hard + 0.5 * soft + 0.1 * att')} AS total FROM l"""
SQL["k15_evaluate"] = f"""WITH {PROBA_BIG}
SELECT {r6("avg(-ln(greatest(least(CASE y WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END, 1 - 1e-7), 1e-7)))")} AS loss,
       {r6('avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM proba_big JOIN pb_pred USING (row_id, y)"""
SQL["k16_early_stopping"] = f"""WITH RECURSIVE
h AS (SELECT user_id AS run, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch, avg(value) AS metric FROM events GROUP BY 1, 2),
hn AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM h),
rec AS (
  SELECT run, i, metric AS best, epoch AS best_e, 0 AS wait, CAST(NULL AS INTEGER) AS stop, epoch AS last
  FROM hn WHERE i = 1
  UNION ALL
  SELECT hn.run, hn.i,
    CASE WHEN hn.metric + 1e-4 < r.best THEN hn.metric ELSE r.best END,
    CASE WHEN hn.metric + 1e-4 < r.best THEN hn.epoch ELSE r.best_e END,
    CASE WHEN hn.metric + 1e-4 < r.best THEN 0 ELSE r.wait + 1 END,
    CASE WHEN NOT (hn.metric + 1e-4 < r.best) AND r.wait + 1 >= 5 THEN hn.epoch END,
    hn.epoch
  FROM rec r JOIN hn ON hn.run = r.run AND hn.i = r.i + 1 WHERE r.stop IS NULL),
fin AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY i DESC) AS z FROM rec)
SELECT CAST(run AS BIGINT) AS run, best_e AS best_epoch, {r6('best')} AS best_metric,
       CAST(coalesce(stop, last) AS INTEGER) AS stop_epoch FROM fin WHERE z = 1"""
SQL["k17_sparsity_schedule"] = f"""SELECT event_id AS step,
  {r6('0.5 + (0.0 - 0.5) * pow(1.0 - greatest(least((event_id - 0) / 1000.0, 1.0), 0.0), 3.0)')} AS sparsity,
  (event_id >= 0 AND event_id <= 1000 AND (event_id - 0) % 100 = 0) AS prune FROM events"""
SQL["k18_magnitude_prune"] = f"""WITH v AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
t AS (SELECT row_id, w, CAST(round_even(len(w) * 0.5, 0) AS INTEGER) AS k,
             list_sort(list_transform(w, lambda x: abs(x)), 'DESC') AS mags FROM v),
th AS (SELECT row_id, w, CASE WHEN k > 0 THEN mags[k] END AS thr FROM t),
e AS (SELECT row_id, unnest(w) AS x, thr FROM th),
p AS (SELECT row_id, CASE WHEN thr IS NOT NULL AND abs(x) >= thr THEN x ELSE 0.0 END AS x FROM e)
SELECT row_id, CAST(count(*) FILTER (WHERE x <> 0) AS INTEGER) AS kept, {r6('sum(x)')} AS retained_sum,
       {r6('sum(abs(x))')} AS retained_l1 FROM p GROUP BY row_id"""

# ---------------------------------------------------------------- E
SQL["e1_argmax"] = f"WITH {PROBA_BIG} SELECT row_id, CAST(pred AS INTEGER) AS pred FROM pb_pred"
SQL["e2_confusion"] = f"""WITH {PROBA_BIG},
g AS (SELECT CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS pred FROM range(3) a(i), range(3) b(i)),
cc AS (SELECT y, pred, count(*) AS n FROM pb_pred GROUP BY y, pred)
SELECT g.y, g.pred, CAST(coalesce(cc.n, 0) AS BIGINT) AS n FROM g LEFT JOIN cc USING (y, pred)"""
SQL["e3_per_class_report"] = f"""{_PB_REPORT}
{report_select()} WHERE class NOT IN ('accuracy', 'macro avg', 'weighted avg')"""
SQL["e4_accuracy"] = f"WITH {PROBA_BIG} SELECT {r6('avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM pb_pred"
SQL["e5_average_rows"] = f"""{_PB_REPORT}
{report_select()} WHERE class IN ('macro avg', 'weighted avg')"""


def _fmt(x: str) -> str:
    return f"CAST(CAST(round(CAST({x} * 100.0 AS DECIMAL(24,10)), 2) AS DECIMAL(6,2)) AS VARCHAR)"


SQL["e6_formatted_report"] = f"""{_PB_REPORT}
SELECT class, {_fmt('precision')} AS precision, {_fmt('recall')} AS recall, {_fmt('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM report"""


def _fmt4(x: str) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(24,10)), 4) AS DECIMAL(8,4)) AS VARCHAR)"


SQL["e6_report_four_decimals"] = f"""{_PB_REPORT}
SELECT class, {_fmt4('precision')} AS precision, {_fmt4('recall')} AS recall, {_fmt4('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM report"""
SQL["e7_one_vs_rest"] = f"""WITH {PROBA_BIG}
SELECT row_id, CAST(class AS INTEGER) AS class, {r6('t')} AS score, CAST(y = class AS INTEGER) AS is_pos FROM pb_long"""
_OVR = f"""WITH sc AS (SELECT l_returnflag AS lbl, round(l_extendedprice, 0) AS score FROM lineitem),
codes AS (SELECT lbl, CAST(row_number() OVER (ORDER BY lbl) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT lbl FROM sc)),
ovr AS (SELECT k.code AS class, sc.score, CAST(c2.code = k.code AS INTEGER) AS is_pos
        FROM sc JOIN codes c2 USING (lbl), codes k),
{roc_ctes('ovr')}"""
_ROC = f""",
nb AS (SELECT *, lag(tp) OVER w AS tp_prev, lag(fp) OVER w AS fp_prev, lead(tp) OVER w AS tp_next,
              lead(fp) OVER w AS fp_next FROM cum WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
kept AS (SELECT class, score, tp, fp FROM nb
         WHERE idx = 0 OR idx = m - 1 OR fp_next - 2 * fp + fp_prev <> 0 OR tp_next - 2 * tp + tp_prev <> 0
         UNION ALL SELECT class, NULL, 0, 0 FROM tot)
SELECT CAST(class AS INTEGER) AS class, {r6('score')} AS threshold,
       {r6('CAST(fp AS DOUBLE) / CAST(N AS DOUBLE)')} AS fpr, {r6('CAST(tp AS DOUBLE) / CAST(P AS DOUBLE)')} AS tpr
FROM kept JOIN tot USING (class)"""
_AUC = f"""
SELECT CAST(class AS INTEGER) AS class,
       {r6('sum(CAST(neg AS DOUBLE) * CAST(2 * tp - pos AS DOUBLE) / 2.0) / CAST(sum(pos) * sum(neg) AS DOUBLE)')} AS auc
FROM cum GROUP BY class"""
_OVR_CLASS = f"""WITH {PROBA_BIG},
ovr AS (SELECT class, {r6('t')} AS score, CAST(y = class AS INTEGER) AS is_pos FROM pb_long),
{roc_ctes('ovr')}"""
SQL["e8_roc_curve"], SQL["e9_auc"] = _OVR + _ROC, _OVR + _AUC
SQL["e8_roc_curve_per_class"], SQL["e9_auc_per_class"] = _OVR_CLASS + _ROC, _OVR_CLASS + _AUC
SQL["e10_compare_models"] = f"""WITH {PROBA_BIG},
m AS (SELECT
  avg(-ln(greatest(least(CASE y WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END, 1 - 1e-7), 1e-7))) AS loss_before,
  avg(CASE WHEN pred_s = y THEN 1.0 ELSE 0.0 END) AS acc_before,
  avg(-ln(greatest(least(CASE y WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END, 1 - 1e-7), 1e-7))) AS loss_after,
  avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS acc_after
  FROM proba_big JOIN pb_pred USING (row_id, y))
SELECT {r6('loss_before')} AS loss_before, {r6('acc_before')} AS acc_before, {r6('loss_after')} AS loss_after,
       {r6('acc_after')} AS acc_after, {r6('loss_after - loss_before')} AS loss_delta,
       {r6('acc_after - acc_before')} AS acc_delta FROM m"""
SQL["e11_inference_throughput"] = "SELECT CAST(count(*) AS BIGINT) AS rows, true AS timed, true AS per_row FROM lineitem"

# ---------------------------------------------------------------- Q
_SER = f"WITH {positions_cte('ser')}"


def _lagx(k: int) -> str:
    if k == 0:
        return "x"
    return f"coalesce(lag(x, {k}) OVER (PARTITION BY entity ORDER BY pos), 0.0)"


SQL["q1_causal_filter"] = f"""{_SER}
SELECT entity, pos, id, {r6('x')} AS x, {r6(f'0.5 * x + 0.3 * {_lagx(2)} + 0.2 * {_lagx(4)}')} AS y FROM ser"""
SQL["q2_same_filter"] = f"""{_SER}
SELECT entity, pos, id, {r6('x')} AS x,
  {r6('0.25 * coalesce(lag(x) OVER (PARTITION BY entity ORDER BY pos), 0.0) + 0.5 * x + 0.25 * coalesce(lead(x) OVER (PARTITION BY entity ORDER BY pos), 0.0)')} AS y
FROM ser"""
SQL["q3_multi_scale_filter"] = f"""{_SER}
SELECT entity, pos, id,
  {r6(f'0.5 * x + 0.3 * {_lagx(1)} + 0.2 * {_lagx(2)}')} AS y_r1,
  {r6(f'0.5 * x + 0.3 * {_lagx(2)} + 0.2 * {_lagx(4)}')} AS y_r2,
  {r6(f'0.5 * x + 0.3 * {_lagx(4)} + 0.2 * {_lagx(8)}')} AS y_r4 FROM ser"""
SQL["q4_max_pool"] = f"""{_SER}
SELECT entity, CAST(pos // 2 AS BIGINT) AS "window", {r6('max(x)')} AS x_max FROM ser
GROUP BY entity, pos // 2 HAVING count(*) = 2"""
SQL["q5_global_average_pool"] = f"SELECT user_id AS entity, {r6('avg(value)')} AS x_avg FROM events GROUP BY user_id"
SQL["q6_attention_pool"] = f"""SELECT user_id AS entity,
  {r6('sum(value * exp(tanh(0.01 * value + 0.0))) / sum(exp(tanh(0.01 * value + 0.0)))')} AS x_att
FROM events GROUP BY user_id"""
SQL["q7_residual_block"] = f"""{_SER},
h AS (SELECT *, greatest(0.5 * x + 0.3 * {_lagx(1)} + 0.2 * {_lagx(2)}, 0.0) AS h FROM ser),
hs AS (SELECT *, avg(h) OVER (PARTITION BY entity) AS mu, var_pop(h) OVER (PARTITION BY entity) AS va FROM h)
SELECT entity, pos, id, {r6('x')} AS x, {r6('x + (h - mu) / sqrt(va + 1e-3)')} AS y FROM hs"""
SQL["q8_batch_norm"] = f"""SELECT user_id AS entity, event_id AS id, {r6('value')} AS x,
  {r6('(value - avg(value) OVER (PARTITION BY user_id)) / sqrt(var_pop(value) OVER (PARTITION BY user_id) + 1e-3)')} AS z
FROM events"""

# ---------------------------------------------------------------- pre-split pair flow
SQL["pair_flow_report"] = f"""WITH {FLOWS_RAW}, {FLOWS_NA},
lab AS (SELECT *, coalesce(label, 'missing') AS lbl FROM flows_na),
{split_ctes('sp', 'lab')},
t AS (SELECT l.row_id, s.split, l.lbl, {num('l.value')} AS value, CAST({boolean('l.flag')} AS DOUBLE) AS flag,
             coalesce(l.proto, 'missing') AS proto FROM lab l JOIN sp_split s USING (row_id)),
med AS (SELECT median(value) AS mv, median(flag) AS mf FROM t WHERE split = 'train'),
codes AS (SELECT lbl, CAST(row_number() OVER (ORDER BY lbl) - 1 AS INTEGER) AS code
          FROM (SELECT DISTINCT lbl FROM t WHERE split = 'train')),
names AS (SELECT code, lbl AS label FROM codes),
vocab AS (SELECT DISTINCT proto AS v FROM t WHERE split = 'train'),
lf AS (SELECT row_id, split, lbl, 'value' AS feature, coalesce(value, (SELECT mv FROM med)) AS v FROM t
  UNION ALL SELECT row_id, split, lbl, 'flag', coalesce(flag, (SELECT mf FROM med)) FROM t
  UNION ALL SELECT row_id, split, lbl, 'proto=' || vocab.v, CASE WHEN t.proto = vocab.v THEN 1.0 ELSE 0.0 END
            FROM t, vocab),
{_CENTROID_TAIL},
{report_ctes('pred', 'names')}
{report_select()}"""

SQL["e2_confusion_wide"] = f"""WITH {PROBA_BIG},
g AS (SELECT CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS pred FROM range(3) a(i), range(3) b(i)),
cc AS (SELECT y, pred, count(*) AS n FROM pb_pred GROUP BY y, pred),
full_grid AS (SELECT g.y, g.pred, coalesce(cc.n, 0) AS n FROM g LEFT JOIN cc USING (y, pred))
SELECT y, {', '.join(f'CAST(sum(CASE WHEN pred = {k} THEN n END) AS BIGINT) AS "{k}"' for k in range(3))}
FROM full_grid GROUP BY y"""
