import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["page_id", "title", "totaltime", "n_ingredients", "author"]
    assert df.count() > 0


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_udf_queries_run_outside_the_repo(tmp_path):
    """The driver may call queries() from any working directory and with its own
    session: Python workers must not need to import the package from the current
    folder, and no spark.checkpoint.dir may be preset."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "df = E.queries()['golden_edits'](spark, '/root/testdata/sf0.001')\n"
        # Aggregate the UDF-derived column so the optimizer cannot prune the UDF away.
        "print('ROWS', df.filter('position >= 0').count())\n"
        # Extraction writes tables: the checkpoint fallback must work when the
        # session names no spark.checkpoint.dir.
        "print('ENTRY', E.entry(spark).count() > 0)\n" % repo)
    conf = tmp_path / "conf"
    conf.mkdir()
    (conf / "spark-defaults.conf").write_text("", encoding="utf-8")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["SPARK_CONF_DIR"] = str(conf)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 266" in out.stdout and "ENTRY True" in out.stdout, out.stderr[-2000:]
