import importlib.util
import os
import pathlib
import subprocess
import sys

import corpus_pipeline as C

ROOT = pathlib.Path(__file__).resolve().parent.parent

SWEEP = """
import sys, time
from pyspark.sql import SparkSession
from tidemark.storage import sweep
spark = SparkSession.builder.master("local-cluster[2,2,700]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.executor.extraJavaOptions", f"-Xlog:gc:file={sys.argv[1]}/gc-%p.log").getOrCreate()
until = time.time() + 60
while spark.sparkContext.defaultParallelism < 4 and time.time() < until:  # cores of the executors that have come
    time.sleep(0.2)
sweep(spark)
spark.stop()
"""


def test_sweep_collects_on_every_executor(tmp_path):
    home = tmp_path / "home"  # Spark writes the executors' logs to its home
    home.mkdir()
    for p in pathlib.Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"PYTHONPATH": str(ROOT), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    subprocess.run([sys.executable, "-c", SWEEP, str(tmp_path)], env=env, cwd=tmp_path, check=True, timeout=180)
    logs = [p.read_text() for p in tmp_path.glob("gc-*.log")]
    assert len(logs) == 2 and all("Pause Full (System.gc())" in x for x in logs)


def test_each_stage_begins_swept(spark, monkeypatch):
    swept = []
    monkeypatch.setattr(C, "sweep", lambda s: swept.append(s))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    for n, (_, stage) in enumerate(C.STAGES, 1):
        docs = stage(spark, docs, None)
        assert len(swept) == n
