"""The registry works without the text operators, and its contract holds."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_without_the_text_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') for n in q); print('fine')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr


def test_other_import_errors_are_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "llm"))
    (copy / "nodewell" / "llm").mkdir()
    (copy / "nodewell" / "llm" / "__init__.py").write_text("import no_such_module_at_all\n")
    (copy / "corpus_pipeline.py").write_text("import nodewell.llm\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True)
    assert "no_such_module_at_all" in done.stderr
