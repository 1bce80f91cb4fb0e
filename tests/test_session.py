import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from mise.session import ensure_checkpoint_dir
from mise.sources import fixtures as FX

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_folder_set_on_the_context_is_used(tmp_path):
    code = (f"import sys; sys.path.insert(0, {REPO!r})\nfrom pyspark.sql import SparkSession\nfrom mise.session import scratch_path\n"
            "s = SparkSession.builder.config('spark.ui.enabled', 'false').master('local[1]').getOrCreate()\n"
            f"s.sparkContext.setCheckpointDir({str(tmp_path / 'own')!r}); print('PATH', scratch_path(s, 't'))")
    (tmp_path / "spark-defaults.conf").write_text("", encoding="utf-8")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})
    assert str(tmp_path / "own") in out.stdout.split("PATH")[1], out.stderr[-1500:]


class _Conf(dict):
    def set(self, key, value):
        self[key] = value


def test_no_folder_on_a_cluster_is_an_error():
    def session(master):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        return SimpleNamespace(conf=_Conf(), sparkContext=sc)
    for master in ("spark://host:7077", "local-cluster[2,1,512]", "yarn"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(session(master))
    assert ensure_checkpoint_dir(session("local[4]")).startswith("/tmp/")


def test_corpora_follow_their_input_files(spark, tmp_path):
    path = str(tmp_path / "part.parquet")
    spark.range(3).write.parquet(path)
    first = FX.listing_digest(spark, [path])
    assert FX.listing_digest(spark, [path]) == first
    spark.range(4).write.mode("overwrite").parquet(path)
    assert FX.listing_digest(spark, [path]) != first
