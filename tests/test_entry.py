"""The registry without the corpus subpackage, and the shared folder."""

import os
import shutil
import subprocess
import sys

import pytest

from bispace import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left", [True, False])
def test_registry_without_the_corpus_subpackage(tmp_path, left):
    gone = [".git", "llm", "__pycache__", *([] if left else ["corpus_pipeline.py"])]
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_gex' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
