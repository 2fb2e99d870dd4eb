"""The corpus subpackage can go without the rest noticing."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def sources(top):
    for d, _, names in os.walk(top):
        for n in names:
            if n.endswith(".py"):
                yield os.path.join(d, n)


def test_nothing_else_imports_the_corpus_subpackage():
    for path in sources(os.path.join(ROOT, "quillon")):
        if f"{os.sep}llm{os.sep}" not in path:
            assert not re.search(r"\bquillon\.llm\b|\bfrom quillon import llm\b", open(path, encoding="utf-8").read()), path


def test_entry_works_without_it(tmp_path):
    shutil.copytree(os.path.join(ROOT, "quillon"), tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_the_rest_passes_without_the_corpus_folders(tmp_path):
    """The other tests are collected and those without Spark pass where quillon/llm, tests/llm and corpus_pipeline.py are gone."""
    shutil.copytree(os.path.join(ROOT, "quillon"), tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(os.path.join(ROOT, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for more in (["--collect-only", "tests"], ["tests/test_query_plan.py"]):
        subprocess.run([sys.executable, "-m", "pytest", "-q", *more], cwd=tmp_path, check=True, env=env, capture_output=True)
