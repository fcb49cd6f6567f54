"""Queries on executors, where spark.checkpoint.dir names its folder by a path alone (in this container /tmp/checkpoints does by default)."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from conftest import ROOT, rows_of

from gridloom.sources import chunked
from gridloom.sources import store as stores
from gridloom.spec import ArrayError, ArraySpec

QUERIES = ["source_convert", "source_list_chunks", "source_scan_pruned", "source_scan_v2", "source_scan_v3_sharded"]

RUN = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as e

at, sf, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1024m", "spark.checkpoint.dir": f"{at}/shared", "spark.sql.warehouse.dir": f"{at}/warehouse", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in names:
    try:
        e.queries()[name](spark, sf).coalesce(1).write.parquet(f"{at}/out/{name}")
    except Exception as x:
        print("FAILED", name, str(x)[:500])
spark.stop()
"""


@pytest.fixture(scope="module")
def cluster(tmp_path_factory, sf):
    """(folder of the results, what the run said); one run for all queries."""
    at = tmp_path_factory.mktemp("cluster")
    home = at / "home"  # the executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK"))} | {"PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(at / "local"), "SPARK_SCALA_VERSION": "2.13"}
    said = subprocess.run([sys.executable, "-c", RUN, str(at), sf, *QUERIES], env=env, cwd=at, capture_output=True, text=True, timeout=300)
    return at / "out", said.stdout + said.stderr[-2000:]


@pytest.mark.parametrize("name", QUERIES)
def test_stored_arrays_on_executors(cluster, duck, name):
    import __spark_entry__

    out, said = cluster
    assert (out / name).exists(), said
    assert rows_of(duck.sql(f"SELECT * FROM '{out / name}/*.parquet'").df()) == rows_of(duck.sql(__spark_entry__.oracle_sql()[name]).df())


def test_file_uris(tmp_path):
    """Hadoop writes file:/a for file:///a."""
    for path in (f"{tmp_path}/a", f"file:{tmp_path}/a", f"file://{tmp_path}/a"):
        assert stores.kind_of(path) == "directory" and stores.open_store(path).root == tmp_path / "a"
        assert stores.kind_of(f"{path}.zip") == "zip" and stores.open_store(f"{path}.zip").path == tmp_path / "a.zip"


def test_a_task_that_sees_another_directory_fails(tmp_path):
    """Its chunks passed for absent, without an error."""
    spec = ArraySpec((8,), (4,), "int32")
    chunked.write_spec(stores.open_store(str(tmp_path / "a")), spec)
    reader = chunked.ChunkReader({"path": str(tmp_path / "a")})
    assert list(reader.read(reader.partitions()[0])) == []
    reader.path = str(tmp_path / "b")
    with pytest.raises(ArrayError, match="store_not_shared"):
        list(reader.read(reader.partitions()[0]))
