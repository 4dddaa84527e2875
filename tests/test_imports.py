"""Every module imports first in a fresh interpreter, so no import depends on the order of others."""

import pkgutil
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import gristmill

ROOT = str(Path(gristmill.__file__).resolve().parent.parent)


def _alone(module: str) -> str:
    done = subprocess.run([sys.executable, "-c", f"import {module}"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    return "" if done.returncode == 0 else f"{module}: {done.stderr[-300:]}"


def test_each_module_imports_alone():
    names = [m.name for m in pkgutil.walk_packages(gristmill.__path__, "gristmill.")] + ["__spark_entry__", "bench"]
    with ThreadPoolExecutor(4) as pool:
        assert [e for e in pool.map(_alone, names) if e] == []
