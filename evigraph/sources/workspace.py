"""Keeping paths inside a tree."""

from __future__ import annotations

import os


class OutsideError(ValueError):
    """A path leads out of the workspace, or the workspace isn't there."""


class Workspace:
    """Resolves paths, links followed, and refuses those outside root unless `restrict` is off."""

    def __init__(self, root: str, restrict: bool = True):
        self.root, self.restrict = os.path.realpath(os.path.expanduser(root)), restrict
        if not os.path.isdir(self.root):
            raise OutsideError(f"{self.root} is no folder")

    def resolve(self, path: str = ".") -> str:
        whole = os.path.realpath(os.path.join(self.root, os.path.expanduser(path)))
        if self.restrict and os.path.commonpath([self.root, whole]) != self.root:
            raise OutsideError(f"{whole} is outside {self.root}")
        return whole

    def relative(self, path: str) -> str:
        whole = self.resolve(path)
        if os.path.commonpath([self.root, whole]) != self.root:
            raise OutsideError(f"{whole} is outside {self.root}")
        return os.path.relpath(whole, self.root).replace(os.sep, "/")
