import importlib
import sys


def test_contract(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "p6_found" in q and len(q) > 60
    assert entry.entry(spark).count() > 0


def test_core_stands_without_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("millrace.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "millrace.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "p6_found" in entry.queries() and "p5_found" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_executors_get_the_package(tmp_path):
    """A session started elsewhere, whose workers cannot see this folder."""
    import os
    import subprocess
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"import sys; sys.path.insert(0, {str(root)!r}); import __spark_entry__ as e; from millrace.session import local_session; s = local_session(2); print('ROWS', e.queries()['p6_found'](s, '/root/testdata/sf0.001').count(), e.queries()['components'](s, '/root/testdata/sf0.001').count())"
    # No configuration at all: the folder for intermediate tables is unset as well.
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
