"""An embedded database where executors are processes of their own."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import os, sys
import pyspark
from pyspark.sql import SparkSession
there = os.path.dirname(pyspark.__file__)
os.mkdir("home")
for n in os.listdir(there):
    os.symlink(f"{there}/{n}", f"home/{n}") if n != "work" else None
os.environ |= {"SPARK_HOME": os.path.abspath("home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": "file://" + os.path.abspath("shared"), "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
from tidewright.plans import registry
from tidewright.sources import database
TEXTS = [None, "", " ", " a ", '"', '""', "a,b", "a\\nb", "\\r\\n", "\\\\", "null", "é🙂", "'", ",", "x" * 5000]
url, types = "jdbc:derby:memory:odd;create=true", {"k": "BIGINT NOT NULL", "t": "VARCHAR(8000)", "v": "DOUBLE"}
database.create(spark, url, "odd", types, [["k"]])
rows = [(i, t, None if i % 3 else i / 7) for i, t in enumerate(TEXTS)]
df = spark.createDataFrame(rows, "k long, t string, v double")
assert database.insert_new(df, url, "odd", types, [["k"]], ["k"], "one") and not database.insert_new(df, url, "odd", types, [["k"]], ["k"], "one")
for found in (database.read_table(spark, url, "odd"), database.read_table(spark, url, "odd", "k", 4)):
    assert sorted(map(tuple, found.collect())) == rows, found.collect()
assert database.read_table(spark, url, "odd", "k").where("k < 0").count() == 0
spark.createDataFrame([(k, f"n{k}", k / 7) for k in (0, 3, 4, 5000, 5003)], "s_suppkey long, s_name string, s_acctbal double").write.parquet("data/supplier.parquet")
got = sorted(map(tuple, registry.QUERIES["S18"](spark, os.path.abspath("data")).select("s_suppkey", "s_acctbal").collect()))
wanted = sorted([(k, round(k / 7 + (k % 3 == 0), 6)) for k in (0, 3, 4, 5000, 5003)] + [(k + 5000, -1.0) for k in (0, 3, 4, 5000, 5003)])
assert got == wanted, got
print("well")
"""


def test_embedded_database_on_a_cluster(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))} | {"PYTHONPATH": REPO}
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("well"), done.stderr[-3000:]
