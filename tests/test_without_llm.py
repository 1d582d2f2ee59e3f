"""The library works when the text operators and the pipeline are not in the checkout."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_text_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "bytequarry")):
        if os.path.join("bytequarry", "llm") in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"\bllm\b", f.read()), name


def test_entry_without_them(tmp_path):
    shutil.copytree(os.path.join(ROOT, "bytequarry"), tmp_path / "bytequarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [x for x in q if x.startswith('op1_')]; assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_other_import_errors_are_not_hidden(tmp_path):
    shutil.copytree(os.path.join(ROOT, "bytequarry"), tmp_path / "bytequarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module_at_all" in done.stderr
