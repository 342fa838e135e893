"""Traps 1-5, 9: cleaning semantics on hand-made frames."""

from pyspark.sql import functions as F

from grantlens.functions import cleaning


def test_year_half_even(spark):
    df = spark.createDataFrame([(2004.5,), (2005.5,), (2004.4,), (2004.6,)], "y double")
    got = [r[0] for r in df.select(cleaning.year_half_even("y")).collect()]
    assert got == [2004, 2006, 2004, 2005]


def test_lenient_int(spark):
    df = spark.createDataFrame([("abc",), ("",), ("nan",), ("2.9",), (None,), ("-2.9",), ("7",)],
                               "h string")
    got = [r[0] for r in df.select(cleaning.lenient_int("h")).collect()]
    assert got == [0, 0, 0, 2, 0, -2, 7]


def test_currency(spark):
    df = spark.createDataFrame([("$1,013.70",), ("",), ("N/A",), (None,), ("$12",)], "v string")
    got = [r[0] for r in df.select(cleaning.currency("v")).collect()]
    assert got == [1013.70, 0.0, 0.0, 0.0, 12.0]


def test_approved_flag(spark):
    df = spark.createDataFrame([(None,), ("No asignado",), ("ASIGNADO",), ("Renuncia",),
                                ("Asignados",)], "e string")
    got = [r[0] for r in df.select(cleaning.approved_flag("e")).collect()]
    # 'No asignado' contains the marker too: kept, as in the reference.
    assert got == [0, 1, 1, 0, 1]


def test_log1p_and_value_per_household(spark):
    df = spark.createDataFrame([(0, 100.0), (-1, 100.0), (4, 100.0)], "h long, v double")
    rows = df.select(cleaning.log1p_of("h").alias("lh"),
                     cleaning.value_per_household_train("v", "h").alias("train"),
                     cleaning.value_per_household_serve("v", "h").alias("serve")).collect()
    assert rows[0].lh == 0.0 and rows[0].train == 0.0 and rows[0].serve == 100.0
    assert rows[1].lh is None  # log1p(-1): NULL in Spark; the row drops in P8
    assert rows[1].train == 0.0 and rows[1].serve == 100.0
    assert abs(rows[2].train - 25.0) < 1e-12 and abs(rows[2].serve - 25.0) < 1e-12


def test_clean_applications_columns(spark):
    from grantlens.sources.applications import RAW_SCHEMA
    row = ("D", "1", "M", "2", "P", "2004", 2004.5, "Asignados", "3", "$1,000.00", "x")
    df = spark.createDataFrame([row], RAW_SCHEMA).drop("Extra")
    out = cleaning.clean_applications(df).first()
    assert (out.Anio_int, out.Hogares, out.Valor_Num, out.Aprobado) == (2004, 3, 1000.0, 1)
    assert abs(out.VxH - 1000.0 / 3) < 1e-9


def test_load_applications_csv_and_parquet(spark, tmp_path):
    from grantlens.sources.applications import load_applications
    p = tmp_path / "apps.csv"
    p.write_text("a,b,c,d,e,f,g,h,i,j,k\nD,1,M,2,P,2004,2004.5,Asignados,3,\"$1,000.00\",x\n")
    df = load_applications(spark, str(p), fmt="csv")
    assert "Extra" not in df.columns and df.first().Anio_real == 2004.5
    pq = str(tmp_path / "apps.parquet")
    spark.createDataFrame([("D", "1", "M", "2", "P", "2004", 2004.5, "E", "3", "$1", "x")],
                          [f"c{i}" for i in range(11)]).write.parquet(pq)
    df2 = load_applications(spark, pq)
    assert df2.columns[0] == "Departamento" and len(df2.columns) == 10
    assert df2.select(F.col("Anio_real")).first()[0] == 2004.5


def test_shared_dir_requires_checkpoint_dir_on_a_cluster():
    """Outside local mode an unset spark.checkpoint.dir is an error, never a
    machine-local folder; a configured folder is used as given."""
    import pytest

    from grantlens.session import shared_dir

    class Conf:
        def __init__(self, v):
            self.v = v

        def get(self, key, default=None):
            return self.v if key == "spark.checkpoint.dir" else default

    class Ctx:
        master = "yarn"

        def __init__(self):
            self.dir = None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        def __init__(self, v):
            self.conf, self.sparkContext = Conf(v), Ctx()

    with pytest.raises(RuntimeError):
        shared_dir(Session(None))
    s = Session("hdfs://nn/shared/ckpt/")
    assert shared_dir(s) == "hdfs://nn/shared/ckpt"
    assert s.sparkContext.dir == "hdfs://nn/shared/ckpt/"
