"""The driver's contract, with the corpus operators or without them."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract

TOP = Path(__file__).resolve().parent.parent


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_entry_in_a_process_of_its_own():
    code = "import __spark_entry__ as c; from pyspark.sql import SparkSession as S; assert c.entry(S.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()).limit(1).count() == 1"
    subprocess.run([sys.executable, "-c", code], cwd=TOP, check=True)


def test_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(TOP / "readweave", tmp_path / "readweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as c; assert len(c.queries()) > 50 and 'pipeline' not in c.queries() and not any(q.startswith('op') and q[2].isdigit() for q in c.queries()); c.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
