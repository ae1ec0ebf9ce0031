"""The command line lists, runs and stores queries."""

import subprocess
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(*args):
    return subprocess.run([sys.executable, "-m", "parkops", *args], cwd=ROOT, capture_output=True,
                          text=True, timeout=600)


def test_list_and_run():
    r = run("list")
    assert r.returncode == 0 and "invoice_ledger" in r.stdout.split()
    out = tempfile.mkdtemp(prefix="parkops-cli-") + "/occ"
    r = run("run", "garage_occupancy", "--out", out, "--sf-dir", "/root/testdata/sf0.001")
    assert r.returncode == 0, r.stderr[-2000:]
    import duckdb
    assert duckdb.sql(f"SELECT count(*) FROM read_parquet('{out}/*.parquet')").fetchall() == [(25,)]
    assert run("run", "no_such_query", "--out", out).returncode == 2
