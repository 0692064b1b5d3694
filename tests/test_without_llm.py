"""The rest imports and knows its queries without the llm subpackage, whether the pipeline's file is there or not."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); assert 'join_diff_detail' in q and set(e.oracle_sql()) == set(q), sorted(q); assert not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_llm(tmp_path, pipeline):
    shutil.copytree(ROOT / "paritas", tmp_path / "paritas", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        shutil.copy(ROOT / name, tmp_path)
    subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, check=True, timeout=60, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
