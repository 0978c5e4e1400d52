import datetime as dt

import pytest

from quantloom.sources import remote


def fetch(code, start, end):
    """A stand-in for a service."""
    if code == "bad":
        raise TimeoutError("no answer")
    return [(dt.date(2024, 1, d), 1.0, 2.0, 0.5, 1.5, 100.0) for d in (2, 3) if not start or f"2024-01-0{d}" >= start]


def test_bars_by_code_and_errors(spark):
    remote.register(spark)
    read = lambda **o: spark.read.format("quantloom_bars").option("fetch", "tests_fetch:fetch").options(**o).load()
    spark.sparkContext.addPyFile(_module())
    got = read(codes="a,b,a,bad", skip_errors="true", start="2024-01-03").orderBy("code").collect()
    assert [(r.code, r.close, r.error) for r in got] == [("a", 1.5, None), ("b", 1.5, None), ("bad", None, "TimeoutError: no answer")]
    assert read(codes="a,b").count() == 4
    with pytest.raises(Exception, match="no answer"):
        read(codes="bad").collect()


def _module():
    """This module's fetch as a file that executors can import."""
    import inspect
    import pathlib
    import tempfile

    path = pathlib.Path(tempfile.mkdtemp(prefix="spark-")) / "tests_fetch.py"
    path.write_text("import datetime as dt\n\n\n" + inspect.getsource(fetch))
    return str(path)
