"""Checkouts of a local repository."""

import shutil
import subprocess
from pathlib import Path

import pytest

from quarry.sources.tree import checkout


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_checkout(tmp_path):
    at = tmp_path / "origin"
    at.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    for k in range(2):
        (at / "a.txt").write_text(str(k))
        git("add", "a.txt")
        git("commit", "-qm", str(k))
    first, last = git("rev-list", "--reverse", "HEAD").split()
    home = str(tmp_path / "home")
    got = checkout(str(at), last, home)
    assert Path(got, "a.txt").read_text() == "1" and checkout(str(at), last, home) == got
    assert Path(checkout(str(at), first, home), "a.txt").read_text() == "0"
    with pytest.raises(subprocess.CalledProcessError):
        checkout(str(at), "nosuch", home)
    assert checkout(str(at), "HEAD", home) != got
