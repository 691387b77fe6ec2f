"""The shared folder, staged tables and the guard of the optional parts."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from gridweave import session

ROOT = Path(__file__).resolve().parents[1]


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)


def test_staged_tables_can_be_dropped(spark):
    a, b = session.staged(spark.range(10).toDF("x"), "keep"), session.staged(spark.range(5).toDF("x"), "gone")
    session.drop(b)
    session.drop(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    assert a.count() == 10 and spark.read.parquet("/root/testdata/sf0.001/region.parquet").count() == 5
    with pytest.raises(Exception, match="(?i)not.?exist|not found|NOT_EXIST"):
        spark.read.schema("x long").parquet(b.inputFiles()[0]).count()


def test_entry_without_the_optional_parts(tmp_path):
    for f in ("__spark_entry__.py", "gridweave"):
        subprocess.run(["cp", "-r", str(ROOT / f), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "gridweave/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    # a module that is there but can't be imported is an error, not a missing part
    (tmp_path / "gridweave/llm").mkdir()
    (tmp_path / "gridweave/llm/__init__.py").write_text("")
    (tmp_path / "gridweave/llm/queries.py").write_text("import no_such_module\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode
