"""Classification of names, paths and tasks by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.functions.text import casefold

# Words in a task, and the tags that they ask for.
TAG_TRIGGERS = (
    (("test", "junit", "pytest", "coverage"), ("test",)),
    (("config", "property", "properties", "environment", "yaml", "yml"), ("configuration",)),
    (("database", "table", "sql", "migration", "flyway", "persist"), ("sql", "migration", "repository", "entity")),
    (("endpoint", "controller", "api", "http"), ("controller",)),
    (("document", "documentation", "docs", "readme", "adr"), ("markdown",)),
)

# Words in imports and text, and the frameworks that they stand for.
FRAMEWORKS = {
    "django": "django", "flask": "flask", "fastapi": "fastapi", "pytest": "pytest", "sqlalchemy": "sqlalchemy", "express": "express", "nestjs": "nestjs", "@nestjs": "nestjs", "react": "react",
    "next": "nextjs", "vue": "vue", "angular": "angular", "spring": "spring", "aspnet": "aspnet-core", "microsoft.aspnetcore": "aspnet-core", "gin-gonic": "gin", "fiber": "fiber", "actix": "actix",
    "rocket": "rocket", "rails": "rails", "laravel": "laravel", "flutter": "flutter",
}

# Suffixes of test names, in order; parts of names and paths, and their layers, in order.
TEST_SUFFIXES = ("IntegrationTest", "IT", "Tests", "Test")
GENERIC_LAYERS = (
    ("test", ("test",)),
    ("controller", ("controller", "handler", "route", "endpoint", "view")),
    ("repository", ("repository", "store", "dao", "database")),
    ("service", ("service", "client", "manager")),
)
JAVA_LAYERS = (
    ("controller", ("RestController", "Controller"), ("Controller",)),
    ("repository", ("Repository",), ("Repository",)),
    ("service", ("Service", "Component"), ("Service", "ServiceImpl")),
    ("entity", ("Entity", "MappedSuperclass"), ()),
    ("configuration", ("Configuration",), ("Configuration",)),
    ("test", (), ("Test", "IT", "IntegrationTest")),
)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def requested_tags(task: Column) -> Column:
    low = casefold(task)
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(_any([F.contains(low, F.lit(w)) for w in words]), F.array(*[F.lit(t) for t in tags])).otherwise(F.array().cast("array<string>")) for words, tags in TAG_TRIGGERS]))))


def frameworks(imports: Column, text: Column) -> Column:
    hay = F.concat_ws(" ", F.transform(imports, casefold), casefold(F.substring(text, 1, 4000)))
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.contains(hay, F.lit(k)), F.lit(v)) for k, v in FRAMEWORKS.items()]), lambda x: x.isNotNull())))


def production_name(name: Column) -> Column:
    """The name without the first suffix of a test that fits."""
    out = None
    for s in TEST_SUFFIXES:
        case, value = name.endswith(s), F.substring(name, F.lit(1), F.length(name) - len(s))
        out = F.when(case, value) if out is None else out.when(case, value)
    return out.otherwise(name)


def generic_layer(name: Column, path: Column, framework: Column | None = None) -> Column:
    low = casefold(F.concat_ws(" ", name, path))
    out = None
    for layer, words in GENERIC_LAYERS:
        case = _any([F.contains(low, F.lit(w)) for w in words])
        if layer == "test" and framework is not None:
            case = case | F.array_contains(framework, "pytest")
        out = F.when(case, layer) if out is None else out.when(case, layer)
    return out.otherwise("domain")


def java_layer(name: Column, annotations: Column) -> Column:
    out = None
    for layer, marks, suffixes in JAVA_LAYERS:
        case = _any([F.array_contains(annotations, m) for m in marks] + [name.endswith(s) for s in suffixes])
        out = F.when(case, layer) if out is None else out.when(case, layer)
    return out.otherwise("domain")


def context_type(path: Column, language: Column, tags: Column) -> Column:
    p = casefold(F.replace(path, F.lit("\\"), F.lit("/")))
    test = F.array_contains(F.transform(tags, casefold), "test") | F.contains(p, F.lit("/test/")) | F.contains(p, F.lit(".test."))
    return F.when(test, "test").when(language.isin("yaml", "properties"), "configuration").when(language == "sql", "database").when(language == "markdown", "documentation").otherwise("source")


def symbol_matches(actual: Column, expected: Column) -> Column:
    a, e = casefold(actual), casefold(expected)
    tail = F.substring_index(a, "::", -1)
    return (a == e) | (tail == e) | F.endswith(tail, F.concat(F.lit("."), e))


def path_matches(actual: Column, expected: Column) -> Column:
    a, e = (casefold(F.replace(x, F.lit("\\"), F.lit("/"))) for x in (actual, expected))
    return (a == e) | F.endswith(a, F.concat(F.lit("/"), e))
