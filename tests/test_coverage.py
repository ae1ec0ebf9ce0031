"""Every §2 id is mapped and every registered key is listed (tools/coverage.py)."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_coverage_table_is_complete():
    r = subprocess.run([sys.executable, str(ROOT / "tools" / "coverage.py")], capture_output=True,
                       text=True, timeout=300)
    assert r.returncode == 0, r.stderr[-2000:]
    assert "| I9 |" in r.stdout
