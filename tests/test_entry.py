"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
import time

import pytest

import __spark_entry__ as entry
from opslens.plans.oracle import ORACLE_SQL
from opslens.plans.queries import QUERIES

HERE = os.path.dirname(os.path.abspath(entry.__file__))
GONE = ("llm", "corpus_pipeline.py", ".git", "__pycache__")


@pytest.mark.parametrize("left_out", [GONE, GONE[:1] + GONE[2:]])
def test_entry_stands_without_the_subpackage(tmp_path, left_out):
    """With both folders gone, and with the pipeline left behind."""
    shutil.copytree(HERE, tmp_path / "copy", ignore=shutil.ignore_patterns(*left_out))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    ran = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    names, texts = (line.split() for line in ran.stdout.strip().split("\n"))
    assert names == sorted(QUERIES) and texts == sorted(ORACLE_SQL)


def test_what_a_session_stores_goes_with_it(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {HERE!r})
from opslens.session import local_session, stored
spark = local_session(1, memory="512m", spark__checkpoint__dir={str(tmp_path / "shared")!r})
frame = stored(spark.range(5))
print("rows", frame.count(), *frame.inputFiles())
spark.stop()
"""
    ran = subprocess.run([sys.executable, "-B", "-c", code], capture_output=True, text=True, timeout=200)
    assert ran.returncode == 0, ran.stderr
    line = next(x for x in ran.stdout.split("\n") if x.startswith("rows 5 "))
    folder = os.path.dirname(os.path.dirname(line.split()[2].removeprefix("file://").removeprefix("file:")))
    assert str(tmp_path) in folder
    for _ in range(50):
        if not os.path.exists(folder):
            break
        time.sleep(0.2)
    assert not os.path.exists(folder)


def test_the_rest_of_the_library_does_not_import_the_subpackage():
    for folder, _, files in os.walk(os.path.join(HERE, "opslens")):
        for name in files:
            if name.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, name)) as file:
                    assert "llm" not in file.read(), name
