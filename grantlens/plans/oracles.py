"""DuckDB SQL that states the expected result of each registered query.

The driver tables are pre-registered as views.  ``APPS`` rebuilds the
application view (same mapping as ``grantlens.sources.tables``) and is
prepended to every oracle.  Doubles are rounded to 6 places on both
sides.
"""

from __future__ import annotations

# Shared CTEs: raw applications, cleaned applications, requests.
APPS = r"""
WITH lines AS (
  SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey
),
apps_raw AS (
  SELECT o.o_orderkey AS app_id,
         r.r_name AS Departamento,
         CAST(r.r_regionkey AS VARCHAR) AS Cod_Dpto,
         n.n_name || '/' || c.c_mktsegment AS Municipio,
         CAST(n.n_nationkey AS VARCHAR) AS Cod_Mpio,
         o.o_orderpriority AS Programa,
         CAST(year(o.o_orderdate) AS VARCHAR) AS Anio_raw,
         CAST(year(o.o_orderdate) AS DOUBLE) + CAST(month(o.o_orderdate) - 1 AS DOUBLE) / 12.0 AS Anio_real,
         CASE WHEN o.o_orderstatus = 'F' THEN 'Asignados'
              WHEN o.o_orderstatus = 'P' THEN 'asignado parcial'
              WHEN o.o_orderkey % 4 = 0 THEN 'Apto con Subsidio Vencido'
              WHEN o.o_orderkey % 4 = 1 THEN 'Renuncia'
              WHEN o.o_orderkey % 4 = 2 THEN 'Revocado'
              ELSE 'Rechazado' END AS Estado,
         CAST(l.n_lines AS VARCHAR) AS Hogares,
         '$' || format('{:,.2f}', o.o_totalprice) AS Valor_Asignado
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN lines l ON l.l_orderkey = o.o_orderkey
),
apps_parsed AS (
  SELECT *,
         CASE WHEN regexp_matches(Hogares, '^[ ]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ ]*$')
              THEN try_cast(Hogares AS DOUBLE) END AS _h,
         CASE WHEN regexp_matches(regexp_replace(Valor_Asignado, '[$,]', '', 'g'),
                                  '^[ ]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ ]*$')
              THEN try_cast(regexp_replace(Valor_Asignado, '[$,]', '', 'g') AS DOUBLE) END AS _v
  FROM apps_raw
),
apps AS (
  SELECT app_id, Departamento, Cod_Dpto, Municipio, Cod_Mpio, Programa, Anio_raw, Anio_real, Estado,
         Valor_Asignado,
         CAST(round_even(Anio_real, 0) AS INTEGER) AS Anio_int,
         CAST(trunc(CASE WHEN _h IS NULL OR isnan(_h) THEN 0 ELSE _h END) AS BIGINT) AS Hogares,
         CASE WHEN _v IS NULL OR isnan(_v) THEN 0.0 ELSE _v END AS Valor_Num,
         CASE WHEN upper(Estado) LIKE '%ASIGNAD%' THEN 1 ELSE 0 END AS Aprobado
  FROM apps_parsed
),
feats AS (
  SELECT *,
         CASE WHEN Hogares > -1 THEN ln(1 + Hogares) END AS Log_H,
         CASE WHEN Valor_Num > -1 THEN ln(1 + Valor_Num) END AS Log_V,
         CASE WHEN Hogares > 0 THEN Valor_Num / Hogares ELSE 0.0 END AS VxH
  FROM apps
),
requests AS (
  SELECT app_id AS req_id,
         CASE WHEN app_id % 20 = 2 THEN 'ATLANTIS' ELSE Departamento END AS departamento,
         CASE WHEN app_id % 20 = 3 THEN 'NATION_X/NONE' ELSE Municipio END AS municipio,
         CASE WHEN app_id % 20 = 4 THEN '6-UNKNOWN' ELSE Programa END AS programa,
         CASE WHEN app_id % 20 = 5 THEN Anio_int + 40 ELSE Anio_int END AS anio,
         Hogares AS hogares,
         Valor_Num * 1000.0 AS valor_cop,
         CASE WHEN app_id % 20 = 1 THEN 'Gradient Boosting'
              WHEN (app_id // 20) % 4 = 0 THEN 'Logistic Regression'
              WHEN (app_id // 20) % 4 = 1 THEN 'Random Forest'
              WHEN (app_id // 20) % 4 = 2 THEN 'XGBoost'
              ELSE 'Red MLP' END AS modelo
  FROM apps
)
"""

ORACLES: dict[str, str] = {}


def oracle(name: str):
    def deco(sql: str):
        ORACLES[name] = APPS + sql
        return sql
    return deco


oracle("load_applications")("""
SELECT app_id, Departamento, Cod_Dpto, Municipio, Cod_Mpio, Programa, Anio_raw,
       round(Anio_real, 6) AS Anio_real, Estado, Hogares, Valor_Asignado FROM apps_raw
""")

oracle("clean_applications")("""
SELECT app_id, Departamento, Municipio, Programa, Anio_int, Hogares,
       round(Valor_Num, 6) AS Valor_Num, Aprobado FROM apps
""")

oracle("engineered_features")("""
SELECT app_id, round(Log_H, 6) AS Log_H, round(Log_V, 6) AS Log_V, round(VxH, 6) AS VxH FROM feats
""")

oracle("municipality_stats")("""
SELECT Municipio, round(avg(Aprobado), 6) AS hist_ap, round(avg(Hogares), 6) AS hist_hh,
       count(*) AS n_reg
FROM apps WHERE Municipio IS NOT NULL GROUP BY Municipio
""")

oracle("program_stats")("""
SELECT Programa, round(avg(Aprobado), 6) AS prog_ap, round(avg(Hogares), 6) AS prog_hh
FROM apps WHERE Programa IS NOT NULL GROUP BY Programa
""")

oracle("dataset_kpis")("""
SELECT count(*) AS n_records, count(DISTINCT Municipio) AS n_municipalities,
       round(avg(Aprobado), 6) AS approval_rate FROM apps
""")

# ---------------------------------------------------------------- shared extra CTEs
_FEATS = ["d_enc", "m_enc", "p_enc", "Anio_int", "Log_H", "Log_V", "VxH",
          "hist_ap", "hist_hh", "n_reg", "prog_ap", "prog_hh"]
_DOUBLE_FEATS = ["Log_H", "Log_V", "VxH", "hist_ap", "hist_hh", "prog_ap", "prog_hh"]

CODED = """
, ms AS (
  SELECT Municipio, avg(Aprobado) AS hist_ap, avg(Hogares) AS hist_hh, count(*) AS n_reg,
         row_number() OVER (ORDER BY Municipio) - 1 AS m_enc
  FROM apps WHERE Municipio IS NOT NULL GROUP BY Municipio
),
ps AS (
  SELECT Programa, avg(Aprobado) AS prog_ap, avg(Hogares) AS prog_hh,
         row_number() OVER (ORDER BY Programa) - 1 AS p_enc
  FROM apps WHERE Programa IS NOT NULL GROUP BY Programa
),
dc AS (
  SELECT Departamento, row_number() OVER (ORDER BY Departamento) - 1 AS d_enc
  FROM (SELECT DISTINCT Departamento FROM apps WHERE Departamento IS NOT NULL)
)
"""

MATRIX = CODED + """
, matrix_all AS (
  SELECT f.app_id, CAST(dc.d_enc AS DOUBLE) AS d_enc, CAST(ms.m_enc AS DOUBLE) AS m_enc,
         CAST(ps.p_enc AS DOUBLE) AS p_enc, CAST(f.Anio_int AS DOUBLE) AS Anio_int,
         f.Log_H, f.Log_V, f.VxH, ms.hist_ap, ms.hist_hh, CAST(ms.n_reg AS DOUBLE) AS n_reg,
         ps.prog_ap, ps.prog_hh, f.Aprobado
  FROM feats f
  LEFT JOIN ms ON f.Municipio = ms.Municipio
  LEFT JOIN ps ON f.Programa = ps.Programa
  LEFT JOIN dc ON f.Departamento = dc.Departamento
),
matrix AS (
  SELECT * FROM matrix_all
  WHERE """ + " AND ".join([f"{c} IS NOT NULL AND NOT isnan({c})" for c in _FEATS]
                           + ["Aprobado IS NOT NULL"]) + """
),
hashed AS (
  SELECT *, row_number() OVER (PARTITION BY Aprobado ORDER BY md5(CAST(app_id AS VARCHAR)), app_id) AS _r,
         count(*) OVER (PARTITION BY Aprobado) AS _nc
  FROM matrix
),
split AS (
  SELECT * EXCLUDE (_r, _nc), CASE WHEN _r <= (_nc + 4) // 5 THEN 'test' ELSE 'train' END AS split
  FROM hashed
)
"""

_MODELS = ["Logistic Regression", "Random Forest", "XGBoost", "Red MLP"]
_OPTIONS = "[" + ", ".join(f"''{m}''" for m in _MODELS) + "]"
_MODEL_IN = ", ".join(f"'{m}'" for m in _MODELS)

VALID = f"""
, kd AS (SELECT DISTINCT Departamento AS v FROM apps WHERE Departamento IS NOT NULL),
km AS (SELECT DISTINCT Municipio AS v FROM apps WHERE Municipio IS NOT NULL),
kp AS (SELECT DISTINCT Programa AS v FROM apps WHERE Programa IS NOT NULL),
yb AS (SELECT min(Anio_int) AS lo, max(Anio_int) AS hi FROM apps),
validated AS (
  SELECT r.*, CASE
    WHEN r.modelo IS NULL OR r.modelo NOT IN ({_MODEL_IN})
      THEN 'Modelo ''' || coalesce(r.modelo, 'None') || ''' no valido. Opciones: {_OPTIONS}'
    WHEN kd.v IS NULL THEN 'Departamento ''' || coalesce(r.departamento, 'None') || ''' no encontrado'
    WHEN km.v IS NULL THEN 'Municipio ''' || coalesce(r.municipio, 'None') || ''' no encontrado'
    WHEN kp.v IS NULL THEN 'Programa ''' || coalesce(r.programa, 'None') || ''' no encontrado'
    WHEN NOT coalesce(r.hogares BETWEEN 1 AND 500, false) THEN 'Hogares fuera de rango'
    WHEN NOT coalesce(r.valor_cop BETWEEN 1000000.0 AND 500000000.0, false) THEN 'Valor fuera de rango'
    WHEN NOT coalesce(r.anio BETWEEN yb.lo AND yb.hi, false) THEN 'Anio fuera de rango'
  END AS error
  FROM requests r CROSS JOIN yb
  LEFT JOIN kd ON r.departamento = kd.v
  LEFT JOIN km ON r.municipio = km.v
  LEFT JOIN kp ON r.programa = kp.v
),
accepted AS (SELECT * EXCLUDE (error) FROM validated WHERE error IS NULL),
scored AS (
  SELECT req_id, modelo, municipio,
         CAST((req_id * 37) % 997 AS DOUBLE) / 997.0 AS prob_sel,
         CAST((req_id * 53) % 991 AS DOUBLE) / 991.0 AS prob_ref
  FROM accepted
),
hm(modelo, f1_historico, auc_historico) AS (VALUES
  ('Logistic Regression', 0.8637, 0.8623), ('Random Forest', 0.9100, 0.8750),
  ('XGBoost', 0.9274, 0.9110), ('Gradient Boosting', 0.9266, 0.9072),
  ('Red MLP', 0.9214, 0.8953))
"""

PROFILE = """
, prof AS (
  SELECT Municipio, avg(Aprobado) AS tasa, avg(Hogares) AS hh_mean,
         CAST(sum(CAST(round(Valor_Num * 100.0) AS BIGINT)) AS DOUBLE) / count(Valor_Num) / 100.0 AS val_mean,
         count(*) AS n_reg, count(DISTINCT Programa) AS n_prog
  FROM apps WHERE Municipio IS NOT NULL GROUP BY Municipio
),
profn AS (
  SELECT *, hh_mean / ((SELECT max(hh_mean) FROM prof) + 1e-8) AS hh_mean_n,
         val_mean / ((SELECT max(val_mean) FROM prof) + 1e-8) AS val_mean_n,
         n_reg / ((SELECT CAST(max(n_reg) AS DOUBLE) FROM prof) + 1e-8) AS n_reg_n
  FROM prof
),
pf AS (
  SELECT Municipio, coalesce(CAST(tasa AS DOUBLE), 0.0) AS tasa,
         coalesce(hh_mean_n, 0.0) AS hh_mean_n, coalesce(val_mean_n, 0.0) AS val_mean_n,
         coalesce(n_reg_n, 0.0) AS n_reg_n, coalesce(CAST(n_prog AS DOUBLE), 0.0) AS n_prog
  FROM profn
),
pstat AS (
  SELECT avg(tasa) AS mu1, stddev_pop(tasa) AS sd1, avg(hh_mean_n) AS mu2, stddev_pop(hh_mean_n) AS sd2,
         avg(val_mean_n) AS mu3, stddev_pop(val_mean_n) AS sd3, avg(n_reg_n) AS mu4,
         stddev_pop(n_reg_n) AS sd4, avg(n_prog) AS mu5, stddev_pop(n_prog) AS sd5
  FROM pf
),
pstd AS (
  SELECT Municipio,
         (tasa - mu1) / CASE WHEN sd1 > 0 THEN sd1 ELSE 1.0 END AS tasa,
         (hh_mean_n - mu2) / CASE WHEN sd2 > 0 THEN sd2 ELSE 1.0 END AS hh_mean_n,
         (val_mean_n - mu3) / CASE WHEN sd3 > 0 THEN sd3 ELSE 1.0 END AS val_mean_n,
         (n_reg_n - mu4) / CASE WHEN sd4 > 0 THEN sd4 ELSE 1.0 END AS n_reg_n,
         (n_prog - mu5) / CASE WHEN sd5 > 0 THEN sd5 ELSE 1.0 END AS n_prog
  FROM pf CROSS JOIN pstat
)
"""

SERIES = """
, ser AS (
  SELECT Municipio, Anio_int, CAST(sum(Hogares) AS BIGINT) AS hogares, avg(Aprobado) AS tasa,
         count(*) AS n
  FROM apps WHERE Municipio IS NOT NULL GROUP BY Municipio, Anio_int
),
seq AS (
  SELECT Municipio, Anio_int,
         count(*) OVER (PARTITION BY Municipio) AS _years,
         row_number() OVER w AS _idx,
         CAST(lag(hogares, 3) OVER w AS DOUBLE) AS x1,
         CAST(lag(hogares, 2) OVER w AS DOUBLE) AS x2,
         CAST(lag(hogares, 1) OVER w AS DOUBLE) AS x3,
         CAST(hogares AS DOUBLE) AS y
  FROM ser WINDOW w AS (PARTITION BY Municipio ORDER BY Anio_int)
),
seqs AS (SELECT Municipio, Anio_int, x1, x2, x3, y FROM seq WHERE _years >= 5 AND _idx > 3)
"""

CORPUS = r"""
, corpus AS (
  SELECT app_id AS doc_id, concat_ws(' ', Programa, Estado, Municipio, Departamento) AS text,
         Aprobado AS label
  FROM apps
),
toks AS (SELECT doc_id, label, regexp_extract_all(lower(text), '\p{L}+') AS tokens FROM corpus),
grams AS (
  SELECT doc_id, label,
         CASE WHEN len(tokens) >= 2
              THEN list_concat(tokens, [tokens[i] || ' ' || tokens[i + 1] FOR i IN range(1, len(tokens))])
              ELSE tokens END AS terms
  FROM toks
)
"""


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


oracle("category_lists")("""
, cats AS (
  SELECT 'Departamento' AS category, Departamento AS value FROM apps WHERE Departamento IS NOT NULL
  UNION SELECT 'Municipio', Municipio FROM apps WHERE Municipio IS NOT NULL
  UNION SELECT 'Programa', Programa FROM apps WHERE Programa IS NOT NULL
)
SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY value) - 1 AS position
FROM cats
""")

oracle("dataset_bounds")("""
SELECT min(Anio_int) AS anio_min, max(Anio_int) AS anio_max, max(Hogares) AS hogares_max,
       round(max(Valor_Num), 6) AS valor_max FROM apps
""")

oracle("municipalities_by_department")("""
, pairs AS (SELECT DISTINCT Departamento, Municipio FROM apps
            WHERE Departamento IS NOT NULL AND Municipio IS NOT NULL)
SELECT Departamento, Municipio,
       row_number() OVER (PARTITION BY Departamento ORDER BY Municipio) - 1 AS position
FROM pairs
""")

oracle("municipality_profile")(PROFILE + """
SELECT Municipio, round(tasa, 6) AS tasa, round(hh_mean, 6) AS hh_mean,
       round(val_mean, 6) AS val_mean, n_reg, n_prog FROM prof
""")

oracle("headline_kpis")("""
SELECT count(*) AS registros, count(DISTINCT Municipio) AS municipios,
       count(DISTINCT Departamento) AS departamentos,
       round(avg(Aprobado), 6) AS tasa_aprobacion, round(1.0 - avg(Aprobado), 6) AS tasa_noejec,
       CAST(sum(Hogares) AS BIGINT) AS hogares_totales,
       round(CAST(sum(CAST(round(Valor_Num * 100.0) AS BIGINT)) AS DOUBLE) / 100.0, 2) AS valor_total,
       round(CAST(coalesce(sum(CASE WHEN Aprobado = 0 THEN CAST(round(Valor_Num * 100.0) AS BIGINT) END), 0)
             AS DOUBLE) / 100.0, 2) AS valor_perdido,
       count(DISTINCT Programa) AS programas, count(DISTINCT Estado) AS estados
FROM apps
""")

oracle("yearly_trend")("""
SELECT Anio_int, CAST(sum(Hogares) AS BIGINT) AS hogares, round(avg(Aprobado), 6) AS tasa,
       count(*) AS n
FROM apps GROUP BY Anio_int
""")

_STATE = """CASE WHEN coalesce(upper(Estado) LIKE '%ASIGNAD%', false) THEN 'Aprobado'
            WHEN coalesce(upper(Estado) LIKE '%VENCID%', false) THEN 'Vencido'
            WHEN coalesce(upper(Estado) LIKE '%RENUNCI%', false) THEN 'Renuncia'
            WHEN coalesce(upper(Estado) LIKE '%REVOCAD%', false) THEN 'Revocado'
            ELSE 'Otro' END"""

oracle("state_distribution")(f"""
, sc AS (SELECT {_STATE} AS categoria FROM apps)
SELECT categoria, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM sc GROUP BY categoria
""")

oracle("dataset_metadata")("""
, cats AS (
  SELECT 'Departamento' AS item, Departamento AS value FROM apps WHERE Departamento IS NOT NULL
  UNION SELECT 'Programa', Programa FROM apps WHERE Programa IS NOT NULL
),
lists AS (
  SELECT item, row_number() OVER (PARTITION BY item ORDER BY value) - 1 AS position,
         value AS text_value, CAST(NULL AS DOUBLE) AS num_value FROM cats
),
sc AS (
  SELECT CAST(min(Anio_int) AS DOUBLE) AS anio_min, CAST(max(Anio_int) AS DOUBLE) AS anio_max,
         CAST(count(*) AS DOUBLE) AS registros, CAST(count(DISTINCT Municipio) AS DOUBLE) AS municipios,
         CAST(count(DISTINCT Departamento) AS DOUBLE) AS departamentos, avg(Aprobado) AS tasa_aprobacion,
         1.0 - avg(Aprobado) AS tasa_noejec, CAST(sum(Hogares) AS DOUBLE) AS hogares_totales,
         CAST(sum(CAST(round(Valor_Num * 100.0) AS BIGINT)) AS DOUBLE) / 100.0 AS valor_total,
         CAST(coalesce(sum(CASE WHEN Aprobado = 0 THEN CAST(round(Valor_Num * 100.0) AS BIGINT) END), 0) AS DOUBLE) / 100.0 AS valor_perdido,
         CAST(count(DISTINCT Programa) AS DOUBLE) AS programas, CAST(count(DISTINCT Estado) AS DOUBLE) AS estados
  FROM apps
),
hm(modelo, f1, auc) AS (VALUES
  ('Logistic Regression', 0.8637, 0.8623), ('Random Forest', 0.9100, 0.8750), ('XGBoost', 0.9274, 0.9110),
  ('Gradient Boosting', 0.9266, 0.9072), ('Red MLP', 0.9214, 0.8953))
SELECT item, position, text_value, num_value FROM lists
UNION ALL SELECT item, 0, NULL, round(num_value, 6) FROM (UNPIVOT sc ON COLUMNS(*) INTO NAME item VALUE num_value)
UNION ALL SELECT 'F1-Score', 0, modelo, CAST(f1 AS DOUBLE) FROM hm
UNION ALL SELECT 'AUC-ROC', 0, modelo, CAST(auc AS DOUBLE) FROM hm
""")

oracle("policy_reward")(PROFILE + """
SELECT Municipio, round(tasa, 6) AS tasa, round(tasa * 10.0 - (1.0 - tasa) * 5.0, 6) AS reward,
       CASE WHEN tasa < 0.70 THEN 'PLAN PREVIO' ELSE 'ASIGNAR' END AS decision
FROM prof
""")

oracle("label_encode")("""
, cats AS (
  SELECT 'Departamento' AS category, Departamento AS value FROM apps WHERE Departamento IS NOT NULL
  UNION SELECT 'Municipio', Municipio FROM apps WHERE Municipio IS NOT NULL
  UNION SELECT 'Programa', Programa FROM apps WHERE Programa IS NOT NULL
)
SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY value) - 1 AS code
FROM cats
""")

oracle("training_matrix")(MATRIX + "SELECT app_id, " + ", ".join(_r(c, c) for c in _FEATS)
                          + ", Aprobado FROM matrix")

oracle("stratified_split")(MATRIX + "SELECT app_id, Aprobado, split FROM split")

oracle("minmax_scaled")(MATRIX + """
, b AS (SELECT """ + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in _FEATS) + """
        FROM split WHERE split = 'train')
SELECT app_id, split, """ + ", ".join(
    _r(f"({c} - {c}_lo) / CASE WHEN {c}_hi = {c}_lo THEN 1.0 ELSE {c}_hi - {c}_lo END", c)
    for c in _FEATS) + " FROM split CROSS JOIN b")

oracle("class_weights")(MATRIX + """
SELECT Aprobado, count(*) AS n,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM split WHERE split = 'train' GROUP BY Aprobado
""")

oracle("prior_history")("""
, py AS (
  SELECT Municipio, Anio_int, sum(Aprobado) AS _ap, sum(Hogares) AS _hh, count(*) AS _n
  FROM apps WHERE Municipio IS NOT NULL GROUP BY Municipio, Anio_int
)
SELECT Municipio, Anio_int,
       round(sum(_ap) OVER w / coalesce(sum(_n) OVER w, 0), 6) AS prior_ap,
       round(sum(_hh) OVER w / coalesce(sum(_n) OVER w, 0), 6) AS prior_hh,
       CAST(coalesce(sum(_n) OVER w, 0) AS BIGINT) AS prior_n
FROM py
WINDOW w AS (PARTITION BY Municipio ORDER BY Anio_int RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")

oracle("profile_normalized")(PROFILE + """
SELECT Municipio, round(tasa, 6) AS tasa, round(hh_mean_n, 6) AS hh_mean_n,
       round(val_mean_n, 6) AS val_mean_n, round(n_reg_n, 6) AS n_reg_n, n_prog FROM profn
""")

oracle("profile_standardized")(PROFILE + """
SELECT Municipio, round(tasa, 6) AS tasa, round(hh_mean_n, 6) AS hh_mean_n,
       round(val_mean_n, 6) AS val_mean_n, round(n_reg_n, 6) AS n_reg_n,
       round(n_prog, 6) AS n_prog FROM pstd
""")

oracle("validate_requests")(VALID + "SELECT req_id, error FROM validated")

oracle("rejected_requests")(VALID + "SELECT req_id, error FROM validated WHERE error IS NOT NULL")

oracle("accepted_requests")(VALID + """
SELECT req_id, departamento, municipio, programa, anio, hogares, round(valor_cop, 6) AS valor_cop,
       modelo FROM accepted
""")

oracle("serving_features")(CODED + """
, nat AS (SELECT avg(Aprobado) AS rate FROM apps)
SELECT r.req_id,
       CAST(coalesce(dc.d_enc, 0) AS DOUBLE) AS d_enc,
       CAST(coalesce(ms.m_enc, 0) AS DOUBLE) AS m_enc,
       CAST(coalesce(ps.p_enc, 0) AS DOUBLE) AS p_enc,
       CAST(r.anio AS DOUBLE) AS Anio_int,
       round(CASE WHEN r.hogares > -1 THEN ln(1 + r.hogares) END, 6) AS Log_H,
       round(CASE WHEN r.valor_cop > -1 THEN ln(1 + r.valor_cop) END, 6) AS Log_V,
       round(r.valor_cop / CAST(greatest(r.hogares, 1) AS DOUBLE), 6) AS VxH,
       round(coalesce(ms.hist_ap, nat.rate), 6) AS hist_ap,
       round(coalesce(ms.hist_hh, 2.0), 6) AS hist_hh,
       coalesce(CAST(ms.n_reg AS DOUBLE), 1.0) AS n_reg,
       round(coalesce(ps.prog_ap, nat.rate), 6) AS prog_ap,
       round(coalesce(ps.prog_hh, 2.0), 6) AS prog_hh
FROM requests r CROSS JOIN nat
LEFT JOIN dc ON r.departamento = dc.Departamento
LEFT JOIN ms ON r.municipio = ms.Municipio
LEFT JOIN ps ON r.programa = ps.Programa
""")

APPS_ONLY_HM = """
, hm(modelo, f1_historico, auc_historico) AS (VALUES
  ('Logistic Regression', 0.8637, 0.8623), ('Random Forest', 0.9100, 0.8750),
  ('XGBoost', 0.9274, 0.9110), ('Gradient Boosting', 0.9266, 0.9072),
  ('Red MLP', 0.9214, 0.8953))
"""

_CLASS = ("CASE WHEN {p} >= 0.70 THEN 'APROBADO' WHEN {p} >= 0.45 THEN 'EN RIESGO' "
          "ELSE 'NO RECOMENDADO' END")
_LEVEL = "CASE WHEN {p} >= 0.70 THEN 'bajo' WHEN {p} >= 0.45 THEN 'medio' ELSE 'alto' END"
# '%.1f' of the exact binary value, ties to even: the gap in points becomes an integer of 52 binary
# places, whose tenths are compared with the half exactly.
_TENTHS = """(SELECT CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) FROM (
  SELECT CASE WHEN 20 * m - (2 * k + 1) * 4503599627370496 > 0
                OR (20 * m = (2 * k + 1) * 4503599627370496 AND k % 2 = 1) THEN k + 1 ELSE k END AS t
  FROM (SELECT m, (10 * m) // 4503599627370496 AS k FROM (
    SELECT CAST(floor(abs(prob_sel - prob_ref) * 100.0 * 4503599627370496.0) AS HUGEINT) AS m))))"""
_INTERP = f"""CASE WHEN abs(prob_sel - prob_ref) < 0.03
       THEN modelo || ' y XGBoost coinciden en la evaluacion — señal robusta.'
     WHEN prob_sel - prob_ref > 0
       THEN modelo || ' es mas optimista que XGBoost en ' || {_TENTHS} || ' pp.'
     ELSE 'XGBoost es mas optimista que ' || modelo || ' en ' || {_TENTHS} || ' pp — confie en el modelo de produccion.' END"""

oracle("risk_bands")(VALID + f"""
SELECT req_id, round(round_even(prob_sel, 4), 6) AS probabilidad,
       {_CLASS.format(p='prob_sel')} AS clasificacion, {_LEVEL.format(p='prob_sel')} AS nivel_riesgo
FROM scored
""")

oracle("interpretation")(VALID + f"SELECT req_id, modelo, {_INTERP} AS interpretacion FROM scored")

oracle("score_compare")(VALID + f"""
SELECT s.req_id, s.modelo,
       round_even(prob_sel, 4) AS probabilidad_sel,
       {_CLASS.format(p='prob_sel')} AS clasificacion_sel, {_LEVEL.format(p='prob_sel')} AS nivel_riesgo_sel,
       CAST(coalesce(s.f1_historico, 0.0) AS DOUBLE) AS f1_sel,
       CAST(coalesce(s.auc_historico, 0.0) AS DOUBLE) AS auc_sel,
       round_even(prob_ref, 4) AS probabilidad_ref,
       {_CLASS.format(p='prob_ref')} AS clasificacion_ref, {_LEVEL.format(p='prob_ref')} AS nivel_riesgo_ref,
       CAST(0.9274 AS DOUBLE) AS f1_ref, CAST(0.9110 AS DOUBLE) AS auc_ref,
       round_even(abs(prob_sel - prob_ref), 4) AS diferencia_prob,
       {_INTERP} AS interpretacion
FROM (SELECT s.*, h.f1_historico, h.auc_historico
      FROM scored s LEFT JOIN hm h ON s.modelo = h.modelo) s
""")

oracle("score_response")(APPS_ONLY_HM + f"""
, cl AS (
  SELECT Municipio, avg(Aprobado) AS rate, CAST(least(4, floor((1.0 - avg(Aprobado)) * 5.0)) AS INT) AS cluster
  FROM apps WHERE Municipio IS NOT NULL GROUP BY Municipio
),
ct AS (SELECT cluster, avg(rate) AS cluster_tasa FROM cl GROUP BY cluster),
names(cluster, cluster_perfil, accion) AS (VALUES
  (0, 'Alta eficiencia rural', 'Priorizar para escalar'), (1, 'Rendimiento alto', 'Asignaciones directas confiables'),
  (2, 'Rendimiento medio-alto', 'Candidato a mayor volumen'), (3, 'Alto volumen urbano', 'Monitoreo continuo'),
  (4, 'Bajo rendimiento', 'Intervencion previa obligatoria')),
scored AS (
  SELECT req_id, modelo, municipio, CAST((req_id * 37) % 997 AS DOUBLE) / 997.0 AS prob_sel, CAST((req_id * 53) % 991 AS DOUBLE) / 991.0 AS prob_ref
  FROM requests
)
SELECT s.req_id, s.modelo AS sel_modelo, round_even(prob_sel, 4) AS sel_probabilidad,
       {_CLASS.format(p='prob_sel')} AS sel_clasificacion, {_LEVEL.format(p='prob_sel')} AS sel_nivel_riesgo,
       CAST(coalesce(h.f1_historico, 0.0) AS DOUBLE) AS sel_f1_historico, CAST(coalesce(h.auc_historico, 0.0) AS DOUBLE) AS sel_auc_historico,
       cl.cluster AS sel_cluster, n.cluster_perfil AS sel_cluster_perfil, round(ct.cluster_tasa, 6) AS sel_cluster_tasa, n.accion AS sel_accion,
       'XGBoost' AS ref_modelo, round_even(prob_ref, 4) AS ref_probabilidad,
       {_CLASS.format(p='prob_ref')} AS ref_clasificacion, {_LEVEL.format(p='prob_ref')} AS ref_nivel_riesgo,
       CAST(0.9274 AS DOUBLE) AS ref_f1_historico, CAST(0.9110 AS DOUBLE) AS ref_auc_historico,
       cl.cluster AS ref_cluster, n.cluster_perfil AS ref_cluster_perfil, round(ct.cluster_tasa, 6) AS ref_cluster_tasa, n.accion AS ref_accion,
       round_even(abs(prob_sel - prob_ref), 4) AS diferencia_prob, {_INTERP.replace("modelo ||", "s.modelo ||").replace("|| modelo", "|| s.modelo")} AS interpretacion
FROM scored s LEFT JOIN hm h ON s.modelo = h.modelo LEFT JOIN cl ON cl.Municipio = s.municipio
LEFT JOIN ct ON ct.cluster = cl.cluster LEFT JOIN names n ON n.cluster = cl.cluster
""")

oracle("model_comparison")(VALID + f"""
, chosen AS (SELECT DISTINCT modelo AS modelo_sel FROM requests WHERE modelo IN ({_MODEL_IN}))
SELECT c.modelo_sel, 'seleccionado' AS rol, h.modelo, CAST(h.f1_historico AS DOUBLE) AS f1_historico,
       CAST(h.auc_historico AS DOUBLE) AS auc_historico
FROM chosen c LEFT JOIN hm h ON c.modelo_sel = h.modelo
UNION ALL
SELECT modelo_sel, 'referencia', 'XGBoost', 0.9274, 0.9110 FROM chosen
""")

_PREDS = """
, test AS (SELECT * FROM split WHERE split = 'test'),
preds AS (
  SELECT 'hist_ap' AS modelo, Aprobado AS label, hist_ap AS prob FROM test
  UNION ALL SELECT 'prog_ap', Aprobado, prog_ap FROM test
  UNION ALL SELECT 'standin_37', Aprobado, CAST((app_id * 37) % 997 AS DOUBLE) / 997.0 FROM test
  UNION ALL SELECT 'standin_53', Aprobado, CAST((app_id * 53) % 991 AS DOUBLE) / 991.0 FROM test
),
conf AS (
  SELECT modelo, count(*) AS n,
         CAST(sum(CASE WHEN prob >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN prob >= 0.5 AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN prob < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN prob < 0.5 AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM preds GROUP BY modelo
),
conf2 AS (
  SELECT *, CAST(tp + tn AS DOUBLE) / n AS accuracy,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall
  FROM conf
),
conf3 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                 ELSE 0.0 END AS f1 FROM conf2
),
scores AS (
  SELECT modelo, prob, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
         CAST(sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS neg
  FROM preds GROUP BY 1, 2
),
cum AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY modelo ORDER BY prob
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS nb
  FROM scores
),
aucs AS (
  SELECT modelo, sum(pos * (nb + neg * 0.5)) / (sum(pos) * sum(neg)) AS auc FROM cum GROUP BY modelo
),
metrics AS (SELECT c.*, a.auc FROM conf3 c LEFT JOIN aucs a ON c.modelo = a.modelo)
"""

oracle("evaluate_predictions")(MATRIX + _PREDS + """
SELECT modelo, n, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, round(auc, 6) AS auc FROM metrics
""")

oracle("best_model_per_metric")(MATRIX + _PREDS + """
, long AS (
  SELECT modelo, 'accuracy' AS metric, accuracy AS value FROM metrics
  UNION ALL SELECT modelo, 'precision', precision FROM metrics
  UNION ALL SELECT modelo, 'recall', recall FROM metrics
  UNION ALL SELECT modelo, 'f1', f1 FROM metrics
  UNION ALL SELECT modelo, 'auc', auc FROM metrics
)
SELECT modelo, metric, round(value, 6) AS value,
       rank() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST) AS rank,
       row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, modelo) = 1 AS is_best
FROM long
""")

oracle("rolling_mean")(SERIES + """
SELECT Municipio, Anio_int, round(tasa, 6) AS tasa,
       round(CASE WHEN count(tasa) OVER w >= 5 THEN avg(tasa) OVER w END, 6) AS tasa_ma5
FROM ser WINDOW w AS (PARTITION BY Municipio ORDER BY Anio_int ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""")

oracle("year_sequences")(SERIES + "SELECT * FROM seqs")

oracle("month_sequences")("""
, ser AS (
  SELECT Municipio, CAST(round(Anio_real * 12.0) AS INT) AS mes, CAST(sum(Hogares) AS BIGINT) AS hogares
  FROM apps WHERE Municipio IS NOT NULL GROUP BY 1, 2
),
seq AS (
  SELECT Municipio, mes, count(*) OVER (PARTITION BY Municipio) AS _n, row_number() OVER w AS _i,
         """ + ", ".join(f"CAST(lag(hogares, {9 - i}) OVER w AS DOUBLE) AS x{i}" for i in range(1, 9)) + """,
         CAST(hogares AS DOUBLE) AS y
  FROM ser WINDOW w AS (PARTITION BY Municipio ORDER BY mes)
)
SELECT Municipio, mes, """ + ", ".join(f"x{i}" for i in range(1, 9)) + """, y FROM seq WHERE _n >= 10 AND _i > 8
""")

oracle("regression_metrics")(SERIES + """
SELECT count(*) AS n, round(avg(abs(y - x3)), 6) AS mae,
       round(1.0 - sum((y - x3) * (y - x3)) / (var_pop(y) * count(*)), 6) AS r2
FROM seqs
""")

oracle("corpus_tokens")(CORPUS + """
SELECT doc_id, CAST(generate_subscripts(tokens, 1) - 1 AS BIGINT) AS pos, unnest(tokens) AS token
FROM toks
""")

oracle("ngram_counts")(CORPUS + """
, per_doc AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM grams)
  GROUP BY doc_id, term
)
SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df,
       CAST(len(string_split(term, ' ')) AS INTEGER) AS n
FROM per_doc GROUP BY term
""")

oracle("vocabulary")(r"""
, dt AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS tokens FROM documents),
pd AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM dt)
  GROUP BY doc_id, term
)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM pd GROUP BY term
""")

oracle("tfidf")(CORPUS + """
, pd AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM toks)
  GROUP BY doc_id, term
),
dfs AS (SELECT term, count(*) AS df FROM pd GROUP BY term),
nd AS (SELECT count(*) AS n FROM corpus)
SELECT doc_id, term, tf,
       round(ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1.0, 6) AS idf,
       round(tf * (ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1.0), 6) AS tfidf
FROM pd JOIN dfs USING (term) CROSS JOIN nd
""")

oracle("chi2_top_terms")(CORPUS + """
, pri AS (
  SELECT CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS p1,
         CAST(sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS p0
  FROM corpus
),
per AS (
  SELECT term, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS o1,
         CAST(sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS o0
  FROM (SELECT label, unnest(terms) AS term FROM grams) GROUP BY term
),
ch AS (SELECT term, o0, o1, (o0 + o1) * p0 AS e0, (o0 + o1) * p1 AS e1 FROM per CROSS JOIN pri),
scored AS (
  SELECT term, CASE WHEN e0 > 0 THEN (o0 - e0) * (o0 - e0) / e0 ELSE 0.0 END
             + CASE WHEN e1 > 0 THEN (o1 - e1) * (o1 - e1) / e1 ELSE 0.0 END AS chi2,
         CASE WHEN o1 > e1 THEN 'Aprobado' ELSE 'No aprobado' END AS clase
  FROM ch
)
SELECT term, round(chi2, 6) AS chi2, clase FROM scored ORDER BY scored.chi2 DESC, term LIMIT 20
""")

oracle("naive_bayes_scores")(CORPUS.replace("Programa, Estado, Municipio", "Programa, Municipio") + """
, ranked AS (
  SELECT doc_id, label, terms, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r,
         count(*) OVER (PARTITION BY label) AS n FROM grams
),
parts AS (SELECT doc_id, label, terms, CASE WHEN r <= (n + 4) // 5 THEN 'test' ELSE 'train' END AS split FROM ranked),
tf AS (
  SELECT doc_id, label, split, term, count(*) AS tf
  FROM (SELECT doc_id, label, split, unnest(terms) AS term FROM parts) GROUP BY ALL
),
m AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM parts WHERE split = 'train'),
idf AS (
  SELECT term, ln((1.0 + any_value(m.n)) / (1.0 + count(*))) AS idf FROM tf CROSS JOIN m WHERE split = 'train' GROUP BY term
),
mass AS (
  SELECT term, sum(CASE WHEN label = 0 THEN tf * idf ELSE 0.0 END) AS s0, sum(CASE WHEN label = 1 THEN tf * idf ELSE 0.0 END) AS s1
  FROM tf JOIN idf USING (term) WHERE split = 'train' GROUP BY term
),
t AS (SELECT sum(s0) AS t0, sum(s1) AS t1, count(*) AS v FROM mass),
w AS (SELECT term, ln((s1 + 1.0) / (t1 + v)) - ln((s0 + 1.0) / (t0 + v)) AS w FROM mass CROSS JOIN t),
z AS (SELECT doc_id, sum(tf * idf * w) AS z FROM tf JOIN idf USING (term) JOIN w USING (term) WHERE split = 'test' GROUP BY doc_id)
SELECT p.doc_id, p.label, round(1.0 / (1.0 + exp(-(coalesce(z, 0.0) + ln((n1 + 1.0) / (n0 + 1.0))))), 6) AS prob
FROM parts p CROSS JOIN m LEFT JOIN z ON z.doc_id = p.doc_id WHERE p.split = 'test'
""")

_COS = """list_sum([CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE) FOR i IN range(1, len({a}) + 1)])
       / (sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN {a}]))
          * sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN {b}])))"""

oracle("cosine_pairs")(f"""
SELECT a.vec_id AS left_id, b.vec_id AS right_id,
       round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")

oracle("nearest_vectors")(f"""
, q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings
        WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
sc AS (
  SELECT e.vec_id, {_COS.format(a='e.embedding', b='q.qv')} AS cosine
  FROM embeddings e CROSS JOIN q WHERE e.vec_id <> q.qid
)
SELECT vec_id, round(cosine, 6) AS cosine FROM sc ORDER BY sc.cosine DESC NULLS LAST, vec_id LIMIT 5
""")

_DIST = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})"
                   for c in ["tasa", "hh_mean_n", "val_mean_n", "n_reg_n", "n_prog"])

oracle("density_outliers")(PROFILE + f"""
, pairs AS (SELECT a.Municipio AS src, b.Municipio AS dst FROM pstd a JOIN pstd b ON {_DIST} <= 1.0),
cnt AS (SELECT src, count(*) AS n_neighbors FROM pairs GROUP BY src),
reach AS (
  SELECT p.src, max(CASE WHEN c.n_neighbors >= 5 THEN 1 ELSE 0 END) AS any_core
  FROM pairs p JOIN cnt c ON p.dst = c.src GROUP BY p.src
)
SELECT c.src AS Municipio, c.n_neighbors, c.n_neighbors >= 5 AS is_core, r.any_core = 0 AS is_noise
FROM cnt c JOIN reach r ON c.src = r.src
""")

oracle("training_matrix_prior")("""
, mcode AS (
  SELECT Municipio, row_number() OVER (ORDER BY Municipio) - 1 AS m_enc
  FROM (SELECT DISTINCT Municipio FROM apps WHERE Municipio IS NOT NULL)
),
pcode AS (
  SELECT Programa, row_number() OVER (ORDER BY Programa) - 1 AS p_enc
  FROM (SELECT DISTINCT Programa FROM apps WHERE Programa IS NOT NULL)
),
dcode AS (
  SELECT Departamento, row_number() OVER (ORDER BY Departamento) - 1 AS d_enc
  FROM (SELECT DISTINCT Departamento FROM apps WHERE Departamento IS NOT NULL)
),
my AS (
  SELECT Municipio, Anio_int, sum(Aprobado) AS _ap, sum(Hogares) AS _hh, count(*) AS _n
  FROM apps WHERE Municipio IS NOT NULL GROUP BY Municipio, Anio_int
),
mh AS (
  SELECT Municipio, Anio_int,
         sum(_ap) OVER w / coalesce(sum(_n) OVER w, 0) AS hist_ap,
         sum(_hh) OVER w / coalesce(sum(_n) OVER w, 0) AS hist_hh,
         CASE WHEN coalesce(sum(_n) OVER w, 0) > 0 THEN sum(_n) OVER w END AS n_reg
  FROM my WINDOW w AS (PARTITION BY Municipio ORDER BY Anio_int
                       RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
py AS (
  SELECT Programa, Anio_int, sum(Aprobado) AS _ap, sum(Hogares) AS _hh, count(*) AS _n
  FROM apps WHERE Programa IS NOT NULL GROUP BY Programa, Anio_int
),
ph AS (
  SELECT Programa, Anio_int,
         sum(_ap) OVER w / coalesce(sum(_n) OVER w, 0) AS prog_ap,
         sum(_hh) OVER w / coalesce(sum(_n) OVER w, 0) AS prog_hh
  FROM py WINDOW w AS (PARTITION BY Programa ORDER BY Anio_int
                       RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
pm AS (
  SELECT f.app_id, CAST(dcode.d_enc AS DOUBLE) AS d_enc, CAST(mcode.m_enc AS DOUBLE) AS m_enc,
         CAST(pcode.p_enc AS DOUBLE) AS p_enc, CAST(f.Anio_int AS DOUBLE) AS Anio_int,
         f.Log_H, f.Log_V, f.VxH, coalesce(mh.hist_ap, nat.rate) AS hist_ap,
         coalesce(mh.hist_hh, 2.0) AS hist_hh, coalesce(CAST(mh.n_reg AS DOUBLE), 1.0) AS n_reg,
         coalesce(ph.prog_ap, nat.rate) AS prog_ap, coalesce(ph.prog_hh, 2.0) AS prog_hh, f.Aprobado
  FROM feats f CROSS JOIN (SELECT avg(Aprobado) AS rate FROM feats) nat
  LEFT JOIN mh ON f.Municipio = mh.Municipio AND f.Anio_int = mh.Anio_int
  LEFT JOIN ph ON f.Programa = ph.Programa AND f.Anio_int = ph.Anio_int
  LEFT JOIN mcode ON f.Municipio = mcode.Municipio
  LEFT JOIN pcode ON f.Programa = pcode.Programa
  LEFT JOIN dcode ON f.Departamento = dcode.Departamento
)
SELECT app_id, """ + ", ".join(_r(c, c) for c in _FEATS) + """, Aprobado FROM pm
WHERE """ + " AND ".join([f"{c} IS NOT NULL AND NOT isnan({c})" for c in _FEATS]
                         + ["Aprobado IS NOT NULL"]))
