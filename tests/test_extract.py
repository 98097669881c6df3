"""Facts of snippets."""

import pytest

from evigraph.extract import registry
from evigraph.extract.config import yaml
from evigraph.extract.model import Facts
from evigraph.plans.fixtures import FILES


def facts(path, text=None):
    f = registry.extract(path, FILES[path] if text is None else text)
    return f, {(e["source_id"], e["relation"], e["target_id"]) for e in f.edges.values()}


def test_java():
    f, e = facts("shop/OrderController.java")
    c = "java::com.shop.web.OrderController"
    assert (c, "DEPENDS_ON", "external::type::com.shop.core.OrderService") in e
    assert (c + "#find/1", "CALLS", "external::method::com.shop.core.OrderService#load") in e
    assert not any("skip" in t for _, _, t in e)
    assert {n["name"] for n in f.nodes.values() if n["kind"] == "endpoint"} == {"GET /api/orders/{}", "POST /api/orders"}
    place = f.nodes[c + "#place/2"]
    assert (place["start_line"], place["end_line"]) == (17, 19) and '"layer": "controller"' in f.nodes[c]["metadata"]
    _, e = facts("shop/OrderService.java")
    s = "java::com.shop.core.OrderService"
    assert {t for a, r, t in e if r == "IMPLEMENTS"} == {"external::type::com.shop.core.Loader", "external::type::com.shop.core.Saver"}
    assert (s, "CONFIGURED_BY", "external::configuration::orders.limit") in e and (s, "EXTENDS", "external::type::com.shop.core.BaseService") in e


def test_java_limits_calls():
    body = " ".join(f"f{i}();" for i in range(60))
    _, e = facts("A.java", "class A { public void run() { " + body + " run(); if (x) {} new B(); } }")
    assert sum(r == "CALLS" for _, r, _ in e) == 40 and not any(t.endswith(("::run", "::if", "::B")) for _, _, t in e)


@pytest.mark.parametrize(
    ("path", "text", "symbol", "imported"),
    [
        ("a.py", "from x.y import z\nclass A:\n    def f(self): pass\n", "f", "x.y"), ("a.ts", "import {b} from 'lib'\nexport class A {}\nexport const g = async (x) => 1\n", "g", "lib"), ("a.go", 'package p\nimport "fmt"\nfunc (s *S) Run() {}\n', "Run", "fmt"),
        ("a.rs", "use std::io;\npub fn run() {}\n", "run", "std.io"), ("a.cs", "using System.IO;\nnamespace N {\npublic sealed class A {\n  public async Task<int> Run() {} } }", "Run", "System.IO"), ("a.rb", "require 'json'\nclass A\n def ok?\n end\nend\n", "ok?", "json"),
        ("a.kt", "package p\nimport a.b\ndata class A(val x: Int)\nsuspend fun go() {}\n", "go", "a.b"), ("a.php", "<?php\nuse A\\B;\nfinal class C { public static function run() {} }", "C", "A\\B"), ("a.cpp", "#include <x.h>\nstruct S {};\nint main(int a) {\n}\n", "main", "x.h"), ("a.swift", "import UIKit\npublic struct A {}\nfunc go() {}\n", "go", "UIKit"),
    ],
)
def test_languages(path, text, symbol, imported):
    f, e = facts(path, text)
    assert symbol in {n["name"] for n in f.nodes.values()}
    assert (f"file::{path}", "IMPORTS", f"external::module::{imported}") in e


@pytest.mark.parametrize(
    ("path", "text", "contract"),
    [
        ("a.py", '@app.get("/users/{id}")\ndef read(): ...', "GET /users/{}"), ("a.py", '@bp.route("/x/<int:k>", methods=["POST"])\ndef x(): ...', "POST /x/{}"), ("urls.py", 'path("items/<int:pk>/", views.item)', "ANY /items/{}"), ("a.ts", 'router.post("/o/:id", handler)', "POST /o/{}"),
        ("a.ts", '@Controller("cats")\nclass C {\n @Get(":id")\n find() {}\n}', "GET /cats/{}"), ("A.cs", '[Route("api/o")]\nclass A { [HttpGet("{id}")]\n public int Get() {} }', "GET /api/o/{}"), ("A.cs", 'app.MapPost("/m", f);', "POST /m"), ("a.go", 'r.GET("/p/:n", ping)', "GET /p/{}"), ("a.rs", '#[get("/u/{id}")]\nasync fn u() {}', "GET /u/{}"),
    ],
)
def test_servers(path, text, contract):
    f, _ = facts(path, text)
    assert contract in {n["name"] for n in f.nodes.values() if n["kind"] == "endpoint"}


@pytest.mark.parametrize(
    ("path", "text", "contract"),
    [
        ("a.py", 'httpx.get("https://h/users/42?x=1")', "GET /users/42"), ("a.ts", "axios.delete(`/users/${id}`)", "DELETE /users/{}"), ("a.ts", 'fetch("/u", { method: "PUT" })', "PUT /u"), ("A.java", 'class A { void f() { rest.postForObject("/u", x); } }', "POST /u"), ("a.cs", 'await http.GetAsync("/u/1");', "GET /u/1"), ("a.go", 'http.NewRequest("PATCH", "/u")', "PATCH /u"),
    ],
)
def test_clients(path, text, contract):
    _, e = facts(path, text)
    assert f"external::http_endpoint::{contract}" in {t for _, r, t in e if r == "CALLS_ENDPOINT"}


def test_config_and_sql():
    f, e = facts("config/application.yml")
    assert {"config::server.port", "config::orders.limit", "config::orders.hosts"} <= set(f.nodes) and ("config::server.port", "BINDS_ENV", "env::PORT") in e
    assert list(yaml("a:\n  b:\n    c: 1\n  d: 2\n- x: 3\n# y: 4")) == [(1, "a", ""), (2, "a.b", ""), (3, "a.b.c", "1"), (4, "a.d", "2")]
    _, e = facts("config/app.properties")
    assert ("file::config/app.properties", "DEFINES", "config::client.timeout") in e
    _, e = facts("db/V1__orders.sql")
    assert {t for _, _, t in e} == {"table::shop.orders", "table::items", "table::customers"}


def test_plugins(spark):
    def broken(path, text, structure):
        raise RuntimeError("no")

    def extra(path, text, structure):
        f = Facts(path, text, "extra")
        f.edge(f"file::{path}", "SAYS", f.external("word", "hi"), 1)
        return f

    plugins = (registry.Plugin("bad", (".py",), broken), registry.Plugin("extra", (".py",), extra), registry.Plugin("extra", (".py",), broken), registry.Plugin("old", (".py",), broken, "0"))
    assert [p.plugin_id for p in registry.chosen(plugins, disabled=("bad",))] == ["extra"]
    found = registry.facts(spark.createDataFrame([("a.py", "x = 1"), ("b.txt", None)], "path string, content string"), plugins).collect()
    assert [r["metadata"] for r in found if r["fact"] == "warning"] == ["bad: RuntimeError: no"]
    assert any(r["relation"] == "SAYS" for r in found) and any(r["node_id"] == "file::b.txt" for r in found)
