"""HTTP routes and contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A parameter of a route: {x}, :x, ${x}, <x> or [x]. Fixed value.
PARAMETER = r"\{[^}/]+\}|:[A-Za-z_]\w*|\$\{[^}]+\}|<[^>/]+>|\[[A-Za-z_]\w*\]"


def canonical_route(raw: Column) -> Column:
    """The path alone, parameters as {}, single slashes, one in front and none at the end."""
    x = F.regexp_replace(F.trim(raw), r"^[\"']+|[\"']+$", "")
    x = F.when(F.contains(x, F.lit("://")), F.regexp_replace(x, r"^[^:/?#]*://[^/?#]*", "")).otherwise(x)
    x = F.substring_index(F.substring_index(x, "?", 1), "#", 1)
    x = F.regexp_replace(F.regexp_replace(x, PARAMETER, "{}"), "/+", "/")
    x = F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
    return F.when(F.length(x) > 1, F.regexp_replace(x, "/+$", "")).otherwise(x)


def join_routes(prefix: Column, route: Column) -> Column:
    p, r = F.coalesce(prefix, F.lit("")), F.coalesce(route, F.lit(""))
    both = F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/"), F.regexp_replace(r, "^/+", ""))
    return canonical_route(F.when(p == "", r).when(r.isin("", "/"), p).otherwise(both))


def http_contract(method: Column, route: Column) -> Column:
    return F.concat(F.upper(method), F.lit(" "), canonical_route(route))


def segments(contract: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(contract, r"^\S+ ", ""), "^/+|/+$", ""), "/")


def method_of(contract: Column) -> Column:
    return F.lower(F.substring_index(contract, " ", 1))


def contract_matches(provider: Column, client: Column) -> Column:
    """The same method or ANY, as many segments, and each equal or a parameter of the provider."""
    p, c = segments(provider), segments(client)
    same = F.forall(F.zip_with(p, c, lambda a, b: (a == "{}") | (a == b)), lambda ok: F.coalesce(ok, F.lit(False)))
    return (method_of(provider).isin("any") | (method_of(provider) == method_of(client))) & (F.size(p) == F.size(c)) & same
