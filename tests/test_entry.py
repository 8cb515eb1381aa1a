"""The entry module without the training-data operators or what they need."""
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q))"


def _run(folder, before=""):
    out = subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr[-2000:]
    return tuple(map(int, out.stdout.split()))


@pytest.mark.parametrize("case", ["without the folders", "without the pipeline", "without the tokenizers"])
def test_other_queries_stay(case, tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *(["llm"] if case == "without the folders" else [])))
    if case == "without the pipeline":
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    hidden = "import sys; sys.modules['public_tokenizers'] = None; " if case == "without the tokenizers" else ""
    n, dealt = _run(copy, hidden)
    assert n > 100 and dealt == 0
