"""What stands beside an index: workspaces, knowledge files, lists of projects, and who says when to look."""

import itertools

import pytest

from evigraph.sources import knowledge
from evigraph.sources.projects import Projects
from evigraph.sources.store import Store
from evigraph.sources.workspace import OutsideError, Workspace
from evigraph.streaming.watcher import Watcher


def test_workspace(tmp_path):
    root = tmp_path / "w"
    (root / "a").mkdir(parents=True)
    (root / "out").symlink_to(tmp_path)
    w = Workspace(str(root))
    assert w.resolve() == str(root) and w.relative("a/../a/b.py") == "a/b.py" and w.relative(str(root)) == "."
    for bad in ("..", "../w2", str(tmp_path), "out/x", "a/../../x"):
        with pytest.raises(OutsideError):
            w.resolve(bad)
    assert Workspace(str(root), restrict=False).resolve("..") == str(tmp_path)
    with pytest.raises(OutsideError):
        Workspace(str(root / "none"))


def test_knowledge(tmp_path):
    source, root = tmp_path / "k", tmp_path / "r"
    for name in ("developer/A.md", "developer/SYSTEM_DESIGN_PLAYBOOK.md", "tester/COPILOT_INSTRUCTIONS_SNIPPET_X.md", "analyst/B.md", "analyst/c.txt"):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(name)
    assert {k: [f.name for f in v] for k, v in knowledge.listed(str(source)).items()} == {"analyst": ["B.md"], "developer": ["A.md"], "senior-developer": ["SYSTEM_DESIGN_PLAYBOOK.md"]}
    assert knowledge.install(str(source), str(root), ["senior-developer"]) == ["knowledge/senior-developer/SYSTEM_DESIGN_PLAYBOOK.md"]
    (root / "knowledge/senior-developer/SYSTEM_DESIGN_PLAYBOOK.md").write_text("own")
    assert knowledge.install(str(source), str(root)) == ["knowledge/analyst/B.md", "knowledge/developer/A.md"]
    assert (root / "knowledge/senior-developer/SYSTEM_DESIGN_PLAYBOOK.md").read_text() == "own"
    assert len(knowledge.install(str(source), str(root), overwrite=True)) == 3


def test_projects(spark, tmp_path):
    p = Projects(str(tmp_path / "projects.json"))
    assert p.all() == [] and p.read(spark, "files") is None
    for name in ("b", "A"):
        (tmp_path / name).mkdir()
    b = p.add(str(tmp_path / "b"), str(tmp_path / "ib"))
    a = p.add(str(tmp_path / "A"), str(tmp_path / "ia"))
    assert [x["id"] for x in p.all()] == [a["id"], b["id"]]
    again = p.add(str(tmp_path / "b"), str(tmp_path / "ib2"))
    assert (again["id"], again["added_at"], p.indexes()[b["id"]]) == (b["id"], b["added_at"], str(tmp_path / "ib2"))
    Store(spark, str(tmp_path / "ia")).publish({"files": spark.createDataFrame([("x",)], "path string")})
    assert [tuple(r) for r in p.read(spark, "files").collect()] == [("x", a["id"])]  # the other has no index
    assert p.remove(b["id"]) and not p.remove(b["id"])
    with pytest.raises(ValueError):
        p.add(str(tmp_path / "none"), "i")
    (tmp_path / "projects.json").write_text('{"schema_version": 9}')
    with pytest.raises(ValueError):
        p.all()


def test_watcher_goes_on_without_events():
    def events():
        yield 1
        yield 2
        raise OSError("no")

    w, polls, slept = Watcher(dict, lambda c: None), itertools.count(), []
    poll, w.poll = w.poll, lambda: (next(polls), poll())[1]
    w.run(events, stop=lambda: len(slept) >= 2, sleep=slept.append)
    assert next(polls) == 4 and len(slept) == 2 and [d["code"] for d in w.diagnostics] == ["watcher"]
