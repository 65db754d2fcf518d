"""The core works where the corpus subpackage is not there."""

import shutil
import subprocess
import sys

from tests.conftest import ROOT

CODE = """
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert len(names) > 90 and set(sql) <= set(names)
assert not [n for n in names if n == "pipeline" or n[:2] == "op" and n[2].isdigit()], sorted(names)
"""


def test_entry_without_the_corpus_folders(tmp_path):
    for keep in (["corpus_pipeline.py"], []):
        copy = tmp_path / f"copy{len(keep)}"
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep else ["corpus_pipeline.py"])))
        subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={"PATH": "/usr/bin:/bin"}, check=True)
