"""The package without the corpus operators."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _sources(*skip):
    for folder, _, names in os.walk(os.path.join(ROOT, "curatorium")):
        for name in names:
            path = os.path.join(folder, name)
            if name.endswith(".py") and not any(s in os.path.relpath(path, ROOT).split(os.sep) for s in skip):
                yield path


def test_nothing_else_imports_them():
    for path in [*_sources("llm"), os.path.join(ROOT, "bench.py"), os.path.join(ROOT, "tools", "check.py")]:
        with open(path, encoding="utf-8") as file:
            assert not re.search(r"curatorium\.llm|corpus_pipeline", file.read()), path


def test_entry_works_without_them(tmp_path):
    shutil.copytree(os.path.join(ROOT, "curatorium"), tmp_path / "curatorium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'slate_page' in q and 'pipeline' not in q and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 190


def test_queries_run_without_them(tmp_path):
    shutil.copytree(os.path.join(ROOT, "curatorium"), tmp_path / "curatorium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = """
import __spark_entry__ as e
from curatorium.session import build_session
spark = build_session(master="local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("OFF")
queries = e.queries()
print([queries[n](spark, "/root/testdata/sf0.001").count() > 0 for n in ("count_by", "title_slugs", "scan_event_ledger", "sql_filter_mood")], e.entry(spark).count() > 0)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.strip().endswith("[True, True, True, True] True"), done.stderr[-2000:]


def test_a_broken_operator_is_an_error(tmp_path):
    shutil.copytree(os.path.join(ROOT, "curatorium"), tmp_path / "curatorium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "curatorium" / "llm").mkdir()
    (tmp_path / "curatorium" / "llm" / "__init__.py").write_text("")
    (tmp_path / "curatorium" / "llm" / "registry.py").write_text("import a_module_that_is_nowhere")
    (tmp_path / "corpus_pipeline.py").write_text("")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "a_module_that_is_nowhere" in done.stderr
