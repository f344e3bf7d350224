"""The core queries register without the optional part, and without a library that it needs."""
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", ["quarry.llm", "corpus_pipeline", "regex"])
def test_core_registers_without(gone):
    code = (f"import sys, warnings; warnings.simplefilter('ignore'); sys.modules[{gone!r}] = None; "
            "import __spark_entry__ as e; from quarry import registry; assert set(registry.queries()) <= set(e.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
