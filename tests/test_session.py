from types import SimpleNamespace

import pytest

from kinvote import session


def stub(setting, master="local[2]", app="app-1"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: setting),
        sparkContext=SimpleNamespace(master=master, applicationId=app),
    )


def test_scratch_follows_the_session():
    assert session.scratch_dir(stub("hdfs://shared/x", "yarn")) == "hdfs://shared/x"
    path = session.scratch_path(stub("hdfs://shared/x", "yarn"), "rows")
    assert path.startswith("hdfs://shared/x/kinvote-app-1/rows-")


def test_scratch_without_setting():
    own = session.scratch_dir(stub(None))
    assert session.scratch_dir(stub(None)) == own != session.scratch_dir(stub(None, app="app-2"))
    with pytest.raises(ValueError):
        session.scratch_dir(stub(None, "yarn"))


def test_materialize(spark):
    df = session.materialize(spark.range(10).selectExpr("id", "id % 3 as g").coalesce(1), "t")
    assert df.schema.names == ["id", "g"] and df.count() == 10


def test_scratch_tables_have_an_owner(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "scratch_dir", lambda _: str(tmp_path))
    kept = session.materialize(spark.range(3), "kept")
    with session.scratch_scope(spark):
        outer = session.materialize(spark.range(4), "outer")
        with pytest.raises(KeyError), session.scratch_scope(spark):
            session.materialize(spark.range(5), "inner")
            raise KeyError
        assert outer.count() == 4
        names = sorted(p.name.split("-")[0] for p in tmp_path.glob("*/*"))
        assert names == ["kept", "outer"]
    assert kept.count() == 3 and len(list(tmp_path.glob("*/*"))) == 1
    session.release_scratch(spark)
    assert not list(tmp_path.iterdir())
