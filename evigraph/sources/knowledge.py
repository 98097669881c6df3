"""Knowledge files of personas: Markdown in a folder for each, which a scan indexes as any other once it lies in the tree."""

from __future__ import annotations

import pathlib
import shutil
from collections.abc import Iterable

# What configures a host is no knowledge, and which of the developer's files are the senior's.
SNIPPET = "COPILOT_INSTRUCTIONS_SNIPPET"
SENIOR = ("SENIOR_DEVELOPER_PERSONA.md", "SYSTEM_DESIGN_PLAYBOOK.md", "DESIGN_PATTERNS_PLAYBOOK.md")


def listed(source: str) -> dict[str, list[pathlib.Path]]:
    """persona -> its files below source, by name; personas without any are left out."""
    out: dict[str, list[pathlib.Path]] = {}
    for file in sorted(pathlib.Path(source).glob("*/*.md")):
        if not file.name.startswith(SNIPPET):
            senior = file.parent.name == "developer" and file.name in SENIOR
            out.setdefault("senior-developer" if senior else file.parent.name, []).append(file)
    return dict(sorted(out.items()))


def install(source: str, root: str, personas: Iterable[str] | None = None, overwrite: bool = False, at: str = "knowledge") -> list[str]:
    """Copies the files to root/at/<persona>; those that are there stay, unless overwrite. Returns what was written, relative to root. A folder with a hidden name isn't listed by a scan."""
    wanted, written = None if personas is None else set(personas), []
    for persona, files in listed(source).items():
        for file in files if wanted is None or persona in wanted else []:
            target = pathlib.Path(root, at, persona, file.name)
            if overwrite or not target.exists():
                target.parent.mkdir(parents=True, exist_ok=True)
                shutil.copyfile(file, target)
                written.append(target.relative_to(root).as_posix())
    return written
