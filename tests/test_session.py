"""Working tables are in a folder that the executors share and go with the application."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
from pyspark.sql import SparkSession
from tidemark import session
from tidemark.session import durable, shared_dir
if "unset" in sys.argv:  # the machine may have a default
    session.CHECKPOINT_KEY = "spark.tidemark.unset"
builder = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
for pair in sys.argv[1:]:
    if "=" not in pair:
        continue
    builder = builder.config(*pair.split("=", 1))
spark = builder.getOrCreate()
kept = durable(spark.range(5).toDF("n"), "kept")
print("FOLDER", shared_dir(spark), kept.count())
spark.stop()
"""


def folder_of_a_run(*settings):
    run = subprocess.run([sys.executable, "-c", PROGRAM, *settings], cwd=REPO, capture_output=True, text=True, timeout=180)
    folder, count = run.stdout.split("FOLDER ")[1].split()
    assert count == "5"
    return folder


def test_an_unset_key_means_the_warehouse(tmp_path):
    folder = folder_of_a_run("unset", f"spark.sql.warehouse.dir={tmp_path}/warehouse")
    assert f"{tmp_path}/warehouse/working-" in folder
    assert not [d for d in os.listdir(f"{tmp_path}/warehouse") if d.startswith("working-")]


def test_the_named_folder_is_used(tmp_path):
    folder = folder_of_a_run(f"spark.checkpoint.dir=file://{tmp_path}/named", f"spark.sql.warehouse.dir={tmp_path}/warehouse")
    assert folder.startswith(f"file://{tmp_path}/named/working-")
    assert not [d for d in os.listdir(f"{tmp_path}/named") if d.startswith("working-")]
