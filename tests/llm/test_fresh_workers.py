import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as contract
spark = (SparkSession.builder.master("local[2]").config("spark.python.worker.reuse", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spark.createDataFrame([(k, "a b c d e f g h " * 12 + str(k % 3), "en", "s", 99) for k in range(12)] + [(90, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet({data!r} + "/documents.parquet")
for name in ("op1_substring_dedup", "op4_line_dedup", "op7_minhash", "op9_suffix_array_dedup", "pipeline"):
    print(name, contract.queries()[name](spark, {data!r}).count())
"""


def test_each_task_in_a_new_worker(tmp_path):
    """No operator leans on what an earlier task of the same worker imported, as after the loss of an executor."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.makedirs(tmp_path / "shared")
    code = SCRIPT.format(root=root, shared=str(tmp_path / "shared"), data=str(tmp_path / "data"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(x.split() for x in done.stdout.splitlines() if x.startswith(("op", "pipeline")))
    assert all(counts[n] == "13" for n in counts if n != "pipeline") and len(counts) == 5
