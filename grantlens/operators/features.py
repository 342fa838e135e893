"""Encodings, training matrix, split, scaling, weights.

Group statistics and code tables are one row per category value; they
join the application rows on their key.  Each is broadcast when its
measured size is under the broadcast ceiling (``broadcast_if_small``),
so the large side is never shuffled on a possibly hot category key;
beyond the ceiling Spark runs a sort-merge join with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.functions.cleaning import log1p_of, value_per_household_serve
from grantlens.operators import stats
from grantlens.plans.materialize import written
from grantlens.session import broadcast_if_small

# The 12 model features in their fixed order.
FEATURES = ["d_enc", "m_enc", "p_enc", "Anio_int", "Log_H", "Log_V", "VxH",
            "hist_ap", "hist_hh", "n_reg", "prog_ap", "prog_hh"]
LABEL = "Aprobado"
# Serving defaults for unknown municipality/program.
DEFAULT_HOUSEHOLDS = 2.0
DEFAULT_RECORDS = 1.0
UNSEEN_CODE = 0


def label_encode(apps: DataFrame, columns=stats.CATEGORY_COLUMNS) -> DataFrame:
    """E1 in long form: (category, value, code)."""
    return (stats.category_lists(apps, columns)
            .select("category", "value", F.col("position").cast("int").alias("code")))


def _coded_stats(apps: DataFrame):
    """Municipality and program statistics with their codes, and department codes, each broadcast if measured small."""
    codes = written(label_encode(apps), "codes")  # one ranking for the three columns
    return saved_stats({"municipality_stats": stats.municipality_stats(apps), "program_stats": stats.program_stats(apps), "category_codes": codes})


def with_history(apps: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """J1, J2 + E1: left-join municipality/program statistics and codes.

    One join per key: the code of a municipality/program rides on its
    statistics row.  Statistics include each row's own label (the
    reference's ``mode="full"``; see ``stats.prior_history`` for E9).
    ``of`` holds the cells of the applications, if they are written.
    """
    ms, ps, dc = _coded_stats(apps if of is None else of)
    return (apps.join(ms, "Municipio", "left")
            .join(ps, "Programa", "left")
            .join(dc, "Departamento", "left"))


def with_prior_history(apps: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """J1, J2 with E9: history from strictly earlier years only (no label leak).

    Municipality history comes from ``prior_history`` on (Municipio, year),
    program history likewise on (Programa, year); codes as in E1.  Rows in
    a key's first year have no history and get the serving defaults (J3).
    """
    of = apps if of is None else of
    codes = written(label_encode(of), "codes")
    dc, ms, ps = (coded(codes, c, e) for c, e in (("Departamento", "d_enc"), ("Municipio", "m_enc"), ("Programa", "p_enc")))
    mh = stats.prior_history(of, "Municipio").select(
        "Municipio", "Anio_int", F.col("prior_ap").alias("hist_ap"),
        F.col("prior_hh").alias("hist_hh"),
        F.when(F.col("prior_n") > 0, F.col("prior_n")).alias("n_reg"))
    ph = stats.prior_history(of, "Programa").select(
        "Programa", "Anio_int", F.col("prior_ap").alias("prog_ap"),
        F.col("prior_hh").alias("prog_hh"))
    mh, ph, ms, ps, dc = broadcast_if_small(mh, ph, ms, ps, dc)
    rate = F.lit(float(stats.national_rate(of)))
    return (apps.join(mh, ["Municipio", "Anio_int"], "left")
            .join(ph, ["Programa", "Anio_int"], "left")
            .join(ms, "Municipio", "left").join(ps, "Programa", "left")
            .join(dc, "Departamento", "left")
            .withColumns({"hist_ap": F.coalesce("hist_ap", rate), "prog_ap": F.coalesce("prog_ap", rate),
                          "hist_hh": F.coalesce("hist_hh", F.lit(DEFAULT_HOUSEHOLDS)),
                          "prog_hh": F.coalesce("prog_hh", F.lit(DEFAULT_HOUSEHOLDS)),
                          "n_reg": F.coalesce(F.col("n_reg").cast("double"), F.lit(DEFAULT_RECORDS))}))


def training_matrix(apps: DataFrame, id_col: str = "app_id", mode: str = "full", of: DataFrame | None = None) -> DataFrame:
    """Id + 12 features + label, rows with any NULL/NaN dropped.

    ``mode="full"`` keeps the reference's statistics over all rows (each
    row's own label included); ``mode="prior"`` uses earlier years only.
    """
    cols = [id_col] + FEATURES + [LABEL]
    joined = with_history(apps, of) if mode == "full" else with_prior_history(apps, of)
    m = joined.select([F.col(c).cast("double") if c in FEATURES else F.col(c) for c in cols])
    return m.na.drop(subset=FEATURES + [LABEL])


def stratified_split(df: DataFrame, label: str = LABEL, id_col: str = "app_id",
                     test_num: int = 1, test_den: int = 5, step: int = 4,
                     max_rank_rows: int = 1_000_000) -> DataFrame:
    """Exact stratified split, seeded by md5 of the id.

    Per class c the first ceil(n_c * test_num / test_den) rows in
    (md5(id), id) order are 'test'.  No task ranks a whole class: rows are
    counted per (class, hash prefix) -- a partial aggregate -- and the
    prefix holding each class's cut point is found on that small table.
    While that boundary prefix holds more than ``max_rank_rows`` rows it
    is refined by ``step`` more hex digits (counting only its rows).  Only
    rows of the final boundary prefix are ranked.  The boundary is one row
    per class (the label is binary), so it is read to the driver and
    applied as literals: no join.
    """
    d = df.withColumn("_h", F.md5(F.col(id_col).cast("string")))

    def boundary(counts: DataFrame, need: dict) -> dict:
        # counts: (label, _p, _c), small; returns {class: (prefix, before, count)}.
        w = Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        c2 = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        cond = F.lit(False)
        for c, k in need.items():
            cond = cond | ((F.col(label) == F.lit(c)) & (F.col("_before") < k)
                           & (F.col("_before") + F.col("_c") >= k))
        return {r[label]: (r["_p"], r["_before"], r["_c"])
                for r in c2.where(cond).select(label, "_p", "_before", "_c").collect()}

    length = step
    # One job: counts per (class, prefix), the class totals over them, and
    # the prefix holding each class's cut point (one row per class).
    counts = (d.groupBy(label, F.substring("_h", 1, length).alias("_p"))
              .agg(F.count(F.lit(1)).alias("_c")))
    w = Window.partitionBy(label).orderBy("_p")
    n_c = F.sum("_c").over(Window.partitionBy(label))
    need_k = F.expr(f"div(_n * {int(test_num)} + {int(test_den) - 1}, {int(test_den)})")
    cut = (counts.withColumn("_n", n_c).withColumn("_k", need_k)
           .withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
           .where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_c") >= F.col("_k")))
           .select(label, "_p", "_before", "_c", "_k").collect())
    need = {r[label]: r["_k"] for r in cut}
    found = {r[label]: (r["_p"], r["_before"], r["_c"]) for r in cut}
    prefix = {c: found[c][0] for c in found}
    need = {c: need[c] - found[c][1] for c in found}
    size = {c: found[c][2] for c in found}
    while length < 32 and any(v > max_rank_rows for v in size.values()):
        length = min(32, length + step)
        cond = F.lit(False)
        for c in prefix:
            cond = cond | ((F.col(label) == F.lit(c)) & F.col("_h").startswith(prefix[c]))
        sub = (d.where(cond).groupBy(label, F.substring("_h", 1, length).alias("_p"))
               .agg(F.count(F.lit(1)).alias("_c")))
        found = boundary(sub, need)
        for c, (p, b, n) in found.items():
            prefix[c], need[c], size[c] = p, need[c] - b, n
    totals = prefix  # classes that have a boundary (every non-empty class)

    cur = F.substring("_h", 1, length)
    before = F.lit(False)
    inside = F.lit(False)
    for c in totals:
        is_c = F.col(label) == F.lit(c)
        before = before | (is_c & (cur < F.lit(prefix[c])))
        inside = inside | (is_c & (cur == F.lit(prefix[c])))
    before, inside = F.coalesce(before, F.lit(False)), F.coalesce(inside, F.lit(False))
    ins = d.where(inside).withColumn(
        "_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", id_col)))
    need_col = None
    for c in totals:
        e = F.when(F.col(label) == F.lit(c), F.lit(need[c]))
        need_col = e if need_col is None else need_col.when(F.col(label) == F.lit(c), F.lit(need[c]))
    ins = ins.withColumn("split", F.when(F.col("_r") <= need_col, "test").otherwise("train")) \
        .drop("_r")
    outs = d.where(~inside).withColumn("split", F.when(before, "test").otherwise("train"))
    return ins.unionByName(outs).drop("_h")


def minmax_fit(train: DataFrame, features=FEATURES) -> dict[str, tuple[float, float]]:
    """E4 fit: per-feature (min, max) on the training rows (one aggregate)."""
    aggs = []
    for c in features:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    row = train.agg(*aggs).first()
    return {c: (row[f"{c}__min"], row[f"{c}__max"]) for c in features}


def minmax_apply(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """E4 apply: (x - min) / range, range 0 treated as 1; no clipping."""
    out = []
    for c in df.columns:
        if c in bounds:
            lo, hi = bounds[c]
            rng = (hi - lo) if (hi is not None and lo is not None and hi != lo) else 1.0
            out.append(((F.col(c) - F.lit(lo)) / F.lit(rng)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(out)


def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weight n / (n_classes * n_c) per class."""
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # ``per`` has one row per class; the global window spans those rows only.
    w = Window.partitionBy()
    return per.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


def with_class_weight(train: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    cw = class_weights(train, label).select(label, F.col("weight").alias(out))
    return train.join(F.broadcast(cw), label, "left")


def profile_normalized(profile: DataFrame, columns=("hh_mean", "val_mean", "n_reg")) -> DataFrame:
    """E5: c / (max(c) + 1e-8) for the profile columns."""
    mx = profile.agg(*[F.max(c).alias(c) for c in columns]).first()
    return profile.select(
        "*", *[(F.col(c) / F.lit(float(mx[c] or 0.0) + 1e-8)).alias(f"{c}_n") for c in columns])


PROFILE_FEATURES = ["tasa", "hh_mean_n", "val_mean_n", "n_reg_n", "n_prog"]


def profile_standardized(profile: DataFrame, columns=PROFILE_FEATURES,
                         key: str = "Municipio") -> DataFrame:
    """Fill NULL with 0, standardize with the population sigma."""
    filled = profile.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                   for c in columns])
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mu"), F.stddev_pop(c).alias(f"{c}__sd")]
    m = filled.agg(*aggs).first()
    out = [F.col(key)]
    for c in columns:
        mu, sd = float(m[f"{c}__mu"]), float(m[f"{c}__sd"] or 0.0)
        out.append(((F.col(c) - F.lit(mu)) / F.lit(sd if sd > 0 else 1.0)).alias(c))
    return filled.select(out)


def coded(codes: DataFrame, category: str, name: str) -> DataFrame:
    """(category, name): the codes of one category column."""
    return codes.where(F.col("category") == category).select(F.col("value").alias(category), F.col("code").alias(name))


def saved_stats(lookups: dict[str, DataFrame]):
    """Statistics with codes, and department codes, from lookup tables as they were saved at training."""
    codes = lookups["category_codes"]
    ms = lookups["municipality_stats"].join(coded(codes, "Municipio", "m_enc"), "Municipio", "left")
    ps = lookups["program_stats"].join(coded(codes, "Programa", "p_enc"), "Programa", "left")
    return tuple(broadcast_if_small(ms, ps, coded(codes, "Departamento", "d_enc")))


def serving_features(requests: DataFrame, apps: DataFrame | None, national_rate: float,
                     keep=(), lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """12 features per request with the serving defaults.

    Statistics and codes come from saved ``lookups`` when they are given (a
    fitted model must read the codes it was trained with), else from ``apps``.

    Unknown categories get code 0 (collides with the first real code, as
    the scoring service does); unknown municipality/program history gets
    the national rate, 2.0 households and 1.0 records.
    """
    ms, ps, dc = saved_stats(lookups) if lookups else _coded_stats(apps)
    r = (requests
         .join(dc.withColumnRenamed("Departamento", "departamento"), "departamento", "left")
         .join(ms.withColumnRenamed("Municipio", "municipio"), "municipio", "left")
         .join(ps.withColumnRenamed("Programa", "programa"), "programa", "left"))
    rate = F.lit(float(national_rate))
    return r.select(
        "req_id", *keep,
        F.coalesce("d_enc", F.lit(UNSEEN_CODE)).cast("double").alias("d_enc"),
        F.coalesce("m_enc", F.lit(UNSEEN_CODE)).cast("double").alias("m_enc"),
        F.coalesce("p_enc", F.lit(UNSEEN_CODE)).cast("double").alias("p_enc"),
        F.col("anio").cast("double").alias("Anio_int"),
        log1p_of("hogares").alias("Log_H"),
        log1p_of("valor_cop").alias("Log_V"),
        value_per_household_serve("valor_cop", "hogares").alias("VxH"),
        F.coalesce("hist_ap", rate).alias("hist_ap"),
        F.coalesce("hist_hh", F.lit(DEFAULT_HOUSEHOLDS)).alias("hist_hh"),
        F.coalesce(F.col("n_reg").cast("double"), F.lit(DEFAULT_RECORDS)).alias("n_reg"),
        F.coalesce("prog_ap", rate).alias("prog_ap"),
        F.coalesce("prog_hh", F.lit(DEFAULT_HOUSEHOLDS)).alias("prog_hh"),
    )
