"""The whole folder is collected from the repository's top without an error."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_module_is_collected_from_the_root():
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"],
                          cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stdout[-2000:]
    modules = {os.path.relpath(os.path.join(folder, name), ROOT).replace(os.sep, "/")
               for folder, _, names in os.walk(os.path.join(ROOT, "tests")) for name in names if re.match(r"test_.*\.py$", name)}
    collected = {line.split("::")[0] for line in done.stdout.splitlines() if "::" in line}
    assert modules == collected
