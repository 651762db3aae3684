"""The benchmark prints one JSON line."""

import json
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_bench_line(sf):
    env = os.environ | {"BENCH_SF_DIR": sf, "BENCH_CPUS": "2", "BENCH_MEMORY": "2g", "BENCH_QUERIES": "speaker_roles,filter_cascade"}
    out = subprocess.run([sys.executable, str(ROOT / "bench.py")], env=env, capture_output=True, text=True, check=True, timeout=300).stdout
    line = json.loads(out.strip().splitlines()[-1])
    assert set(line["queries"]) == {"speaker_roles", "filter_cascade"} and line["unit"] == "sec"
