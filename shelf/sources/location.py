"""Where the store lies by default, so that all commands agree on it whatever folder they are started in."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path

#: Environment variable that always wins; folder of a project's store; folder in the home directory.
VARIABLE, IN_PROJECT, IN_HOME = "SHELF_STORE", Path("data") / "shelf", Path(".shelf") / "store"


def _there(path: Path) -> bool:
    """Whether a path exists; one that may not be looked at doesn't count."""
    try:
        return path.exists()
    except OSError:
        return False


def default_store(cwd: str | Path | None = None, env: Mapping[str, str] | None = None, top: str | Path | None = None) -> str:
    """The variable; else an existing store of this folder or one above; else the repository's root; else the home folder.

    top: the last folder to look in, by default the file system's root.
    """
    env = os.environ if env is None else env
    if env.get(VARIABLE):
        return os.path.abspath(env[VARIABLE])
    here = Path(os.path.abspath(cwd or os.getcwd()))
    above = [here, *here.parents]
    if top is not None and Path(top) in above:
        above = above[: above.index(Path(top)) + 1]
    for folder in above:
        if _there(folder / IN_PROJECT):
            return str(folder / IN_PROJECT)
    root = next((folder for folder in above if _there(folder / ".git")), None)
    return str(root / IN_PROJECT if root else Path.home() / IN_HOME)
