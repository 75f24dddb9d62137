"""What a pipeline run leaves behind in the checkpoint folder: nothing once the process has ended, its last result before."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
import corpus_pipeline
assert corpus_pipeline.run(spark, sys.argv[2]).count() > 0
print("LEFT", sum(1 for _ in Path(sys.argv[1]).rglob("rdd-*")))
"""


def test_checkpoints_go(tmp_path, sf_dir):
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), sf_dir], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "LEFT 0" in done.stdout
    assert not [p for p in tmp_path.rglob("*") if p.is_file() or p.name.startswith("rdd-")]
