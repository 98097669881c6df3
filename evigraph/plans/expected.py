"""The facts that the extraction queries must go on giving for the files in fixtures.py. Fixed values, recorded from the extractors, which gave the same with patterns and with tokens: they guard against change, and don't prove the facts right."""

from __future__ import annotations

JAVA_EXTRACT = (
    "source_id, relation, target_id, evidence_path, start_line, confidence",
    [
        ("endpoint::com.shop.web.OrderController::find/1::GET /api/orders/{}", "HANDLED_BY", "java::com.shop.web.OrderController#find/1", "shop/OrderController.java", 12, 1.0),
        ("endpoint::com.shop.web.OrderController::place/2::POST /api/orders", "HANDLED_BY", "java::com.shop.web.OrderController#place/2", "shop/OrderController.java", 17, 1.0),
        ("file::shop/OrderController.java", "DEFINES", "java::com.shop.web.OrderController", "shop/OrderController.java", 8, 1.0),
        ("file::shop/OrderController.java", "IMPORTS", "external::type::com.shop.core.OrderService", "shop/OrderController.java", 3, 0.98),
        ("file::shop/OrderController.java", "IMPORTS", "external::type::org.springframework.web.bind.annotation.*", "shop/OrderController.java", 4, 0.98),
        ("file::shop/OrderService.java", "DEFINES", "java::com.shop.core.OrderService", "shop/OrderService.java", 3, 1.0),
        ("java::com.shop.core.OrderService#load/1", "CALLS", "external::method::com.shop.core.OrderRepository#findById", "shop/OrderService.java", 9, 0.72),
        ("java::com.shop.core.OrderService", "CONFIGURED_BY", "external::configuration::orders.limit", "shop/OrderService.java", 5, 0.99),
        ("java::com.shop.core.OrderService", "DEFINES", "java::com.shop.core.OrderService#load/1", "shop/OrderService.java", 8, 1.0),
        ("java::com.shop.core.OrderService", "DEPENDS_ON", "external::type::com.shop.core.OrderRepository", "shop/OrderService.java", 4, 0.9),
        ("java::com.shop.core.OrderService", "DEPENDS_ON", "external::type::com.shop.core.int", "shop/OrderService.java", 6, 0.9),
        ("java::com.shop.core.OrderService", "EXTENDS", "external::type::com.shop.core.BaseService", "shop/OrderService.java", 3, 1.0),
        ("java::com.shop.core.OrderService", "IMPLEMENTS", "external::type::com.shop.core.Loader", "shop/OrderService.java", 3, 1.0),
        ("java::com.shop.core.OrderService", "IMPLEMENTS", "external::type::com.shop.core.Saver", "shop/OrderService.java", 3, 1.0),
        ("java::com.shop.web.OrderController#find/1", "ANNOTATED_WITH", "external::annotation::com.shop.web.GetMapping", "shop/OrderController.java", 12, 1.0),
        ("java::com.shop.web.OrderController#find/1", "CALLS", "external::method::com.shop.core.OrderService#load", "shop/OrderController.java", 13, 0.72),
        ("java::com.shop.web.OrderController#place/2", "ANNOTATED_WITH", "external::annotation::com.shop.web.PostMapping", "shop/OrderController.java", 17, 1.0),
        ("java::com.shop.web.OrderController#place/2", "CALLS", "external::method::com.shop.core.OrderService#save", "shop/OrderController.java", 18, 0.72),
        ("java::com.shop.web.OrderController", "ANNOTATED_WITH", "external::annotation::com.shop.web.RequestMapping", "shop/OrderController.java", 8, 1.0),
        ("java::com.shop.web.OrderController", "ANNOTATED_WITH", "external::annotation::com.shop.web.RestController", "shop/OrderController.java", 8, 1.0),
        ("java::com.shop.web.OrderController", "DEFINES", "java::com.shop.web.OrderController#find/1", "shop/OrderController.java", 12, 1.0),
        ("java::com.shop.web.OrderController", "DEFINES", "java::com.shop.web.OrderController#place/2", "shop/OrderController.java", 17, 1.0),
        ("java::com.shop.web.OrderController", "DEPENDS_ON", "external::type::com.shop.core.OrderService", "shop/OrderController.java", 9, 0.9),
        ("java::com.shop.web.OrderController", "EXPOSES_ENDPOINT", "endpoint::com.shop.web.OrderController::find/1::GET /api/orders/{}", "shop/OrderController.java", 12, 1.0),
        ("java::com.shop.web.OrderController", "EXPOSES_ENDPOINT", "endpoint::com.shop.web.OrderController::place/2::POST /api/orders", "shop/OrderController.java", 17, 1.0),
        ("package::com.shop.core", "CONTAINS", "file::shop/OrderService.java", "shop/OrderService.java", 1, 1.0),
        ("package::com.shop.web", "CONTAINS", "file::shop/OrderController.java", "shop/OrderController.java", 1, 1.0),
    ],
)

GENERIC_EXTRACT = (
    "node_id, kind, qualified_name, start_line",
    [
        ("file::api/users.py", "file", "api/users.py", 1),
        ("file::client/orders.ts", "file", "client/orders.ts", 1),
        ("file::server/main.go", "file", "server/main.go", 1),
        ("generic::api/users.py::class::UserStore", "class", "api/users.py::UserStore", 12),
        ("generic::api/users.py::method::load", "method", "api/users.py::load", 13),
        ("generic::api/users.py::method::read_user", "method", "api/users.py::read_user", 8),
        ("generic::client/orders.ts::class::OrdersClient", "class", "client/orders.ts::OrdersClient", 3),
        ("generic::client/orders.ts::method::place", "method", "client/orders.ts::place", 9),
        ("generic::server/main.go::class::Health", "class", "main.Health", 5),
        ("generic::server/main.go::method::main", "method", "main.main", 9),
        ("generic::server/main.go::method::ping", "method", "main.ping", 7),
        ("semantic-endpoint::api/users.py::7::GET /users/{}", "endpoint", "GET /users/{}", 7),
        ("semantic-endpoint::server/main.go::10::GET /ping/{}", "endpoint", "GET /ping/{}", 10),
    ],
)

CONFIG_EXTRACT = (
    "source_id, relation, target_id, evidence_path, start_line, confidence",
    [
        ("config::client.url", "BINDS_ENV", "env::CLIENT_URL", "config/app.properties", 3, 1.0),
        ("config::server.port", "BINDS_ENV", "env::PORT", "config/application.yml", 2, 1.0),
        ("file::config/app.properties", "DEFINES", "config::client.timeout", "config/app.properties", 2, 1.0),
        ("file::config/app.properties", "DEFINES", "config::client.url", "config/app.properties", 3, 1.0),
        ("file::config/application.yml", "DEFINES", "config::orders", "config/application.yml", 3, 1.0),
        ("file::config/application.yml", "DEFINES", "config::orders.hosts", "config/application.yml", 6, 1.0),
        ("file::config/application.yml", "DEFINES", "config::orders.limit", "config/application.yml", 4, 1.0),
        ("file::config/application.yml", "DEFINES", "config::server", "config/application.yml", 1, 1.0),
        ("file::config/application.yml", "DEFINES", "config::server.port", "config/application.yml", 2, 1.0),
    ],
)

WEB_CONTRACTS = (
    "source_id, relation, target_id, evidence_path, start_line, confidence",
    [
        ("file::server/main.go", "CALLS_ENDPOINT", "external::http_endpoint::GET /ping/x", "server/main.go", 11, 0.9),
        ("generic::api/users.py::method::load", "CALLS_ENDPOINT", "external::http_endpoint::GET /profiles/7", "api/users.py", 9, 0.9),
        ("generic::api/users.py::method::read_user", "EXPOSES_ENDPOINT", "semantic-endpoint::api/users.py::7::GET /users/{}", "api/users.py", 7, 0.96),
        ("generic::client/orders.ts::method::place", "CALLS_ENDPOINT", "external::http_endpoint::GET /api/orders/42", "client/orders.ts", 5, 0.9),
        ("generic::client/orders.ts::method::place", "CALLS_ENDPOINT", "external::http_endpoint::POST /api/orders", "client/orders.ts", 9, 0.9),
        ("generic::server/main.go::method::ping", "EXPOSES_ENDPOINT", "semantic-endpoint::server/main.go::10::GET /ping/{}", "server/main.go", 10, 0.96),
        ("java::com.shop.web.OrderController", "EXPOSES_ENDPOINT", "endpoint::com.shop.web.OrderController::find/1::GET /api/orders/{}", "shop/OrderController.java", 12, 1.0),
        ("java::com.shop.web.OrderController", "EXPOSES_ENDPOINT", "endpoint::com.shop.web.OrderController::place/2::POST /api/orders", "shop/OrderController.java", 17, 1.0),
    ],
)

RESOLVED_FIXTURE = (
    "source_id, relation, target_id, confidence",
    [
        ("file::server/main.go", "RESOLVED_CALLS_ENDPOINT", "semantic-endpoint::server/main.go::10::GET /ping/{}", 0.96),
        ("generic::client/orders.ts::method::place", "RESOLVED_CALLS_ENDPOINT", "endpoint::com.shop.web.OrderController::find/1::GET /api/orders/{}", 0.96),
        ("generic::client/orders.ts::method::place", "RESOLVED_CALLS_ENDPOINT", "endpoint::com.shop.web.OrderController::place/2::POST /api/orders", 0.96),
        ("java::com.shop.core.OrderService", "RESOLVED_CONFIGURED_BY", "config::orders.limit", 0.92),
        ("java::com.shop.web.OrderController#find/1", "RESOLVED_CALLS", "java::com.shop.core.OrderService#load/1", 0.92),
        ("java::com.shop.web.OrderController#place/2", "RESOLVED_CALLS", "java::com.shop.core.OrderService", 0.92),
        ("java::com.shop.web.OrderController", "RESOLVED_DEPENDS_ON", "java::com.shop.core.OrderService", 0.92),
    ],
)

SYMBOL_WINDOWS = (
    "path, start_line, end_line, symbol_id, tags",
    [
        ("api/users.py", 12, 12, "generic::api/users.py::class::UserStore", "class,UserStore"),
        ("api/users.py", 13, 13, "generic::api/users.py::method::load", "method,load"),
        ("api/users.py", 8, 8, "generic::api/users.py::method::read_user", "method,read_user"),
        ("shop/OrderController.java", 12, 14, "java::com.shop.web.OrderController#find/1", "method,find"),
        ("shop/OrderController.java", 12, 17, "java::com.shop.web.OrderController", "class,OrderController"),
        ("shop/OrderController.java", 16, 20, "java::com.shop.web.OrderController", "class,OrderController"),
        ("shop/OrderController.java", 17, 19, "java::com.shop.web.OrderController#place/2", "method,place"),
        ("shop/OrderController.java", 8, 13, "java::com.shop.web.OrderController", "class,OrderController"),
        ("shop/OrderService.java", 3, 8, "java::com.shop.core.OrderService", "class,OrderService"),
        ("shop/OrderService.java", 7, 11, "java::com.shop.core.OrderService", "class,OrderService"),
        ("shop/OrderService.java", 8, 10, "java::com.shop.core.OrderService#load/1", "method,load"),
    ],
)



def sql(expected: tuple[str, list[tuple]]) -> str:
    """The rows as a statement: numbers of lines are integers, confidences doubles."""
    columns, rows = expected
    cast = {"start_line": "int", "end_line": "int", "confidence": "double"}
    shown = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
    return f"select {', '.join(f'{c}::{cast[c]} as {c}' if c in cast else c for c in columns.split(', '))} from (values {values}) as t({columns})"
