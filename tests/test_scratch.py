"""The shared folder for tables between steps."""

from types import SimpleNamespace

import pytest

from perigee.sources import scratch


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: conf.get(name, default)), sparkContext=SimpleNamespace(applicationId=f"app-{master}", master=master))


def test_the_folder_is_shared_or_an_error():
    given = {"spark.checkpoint.dir": "hdfs://n/c/", "spark.sql.warehouse.dir": "file:/w"}
    assert scratch.shared_folder(session("spark://m:7077", **given)) == "hdfs://n/c"
    assert scratch.shared_folder(session("yarn", **{"spark.sql.warehouse.dir": "s3://b/w"})) == "s3://b/w/perigee-scratch"
    for warehouse in ("file:/root/spark-warehouse", "/root/spark-warehouse"):
        with pytest.raises(RuntimeError):
            scratch.shared_folder(session("yarn", **{"spark.sql.warehouse.dir": warehouse}))
    one = scratch.shared_folder(session("local[4]"))
    assert one.startswith("file:///") and scratch.shared_folder(session("local[4]")) == one
