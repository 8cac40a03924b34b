"""Operators on executors that cannot import the package: their functions and broadcasts must go along."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[2]
JOB = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.executorEnv.PYTHONPATH", {libs!r}).config("spark.checkpoint.dir", {shared!r}).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def importable(_):
    import importlib.util
    yield importlib.util.find_spec("labelforge") is not None
assert spark.sparkContext.range(2, numSlices=1).mapPartitions(importable).collect() == [False]
from labelforge.llm import lm
docs = spark.createDataFrame([(k, f"one two three w{{k % 7}} four") for k in range(40)], "doc_id long, text string")
assert lm.score_documents(docs).count() == 40
print("scored")
"""


def test_language_model_on_executors_without_the_package(tmp_path):
    job, shared = tmp_path / "job.py", tmp_path / "shared"
    shared.mkdir()
    libs = os.pathsep.join(p for p in sys.path if p and not p.startswith(str(REPO)))
    job.write_text(JOB.format(repo=str(REPO), libs=libs, shared=f"file://{shared}"))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"PYTHONPATH": libs, "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(Path(__import__("pyspark").__file__).parent), "SPARK_SCALA_VERSION": "2.13"}
    out = subprocess.run([sys.executable, str(job)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "scored" in out.stdout, out.stderr[-2000:]
