"""Small source files that the extraction queries read."""

FILES = {
    "shop/OrderController.java": """package com.shop.web;

import com.shop.core.OrderService;
import org.springframework.web.bind.annotation.*;

@RestController
@RequestMapping("/api")
public class OrderController {
    private final OrderService orders;

    @GetMapping("/orders/{id}")
    public Order find(String id) {
        return orders.load(id); // orders.skip(id) in a comment
    }

    @PostMapping("/orders")
    public void place(Order order, boolean fast) {
        orders.save("{not a brace", order);
    }
}
""",
    "shop/OrderService.java": """package com.shop.core;

public class OrderService extends BaseService implements Loader<Order>, Saver {
    private OrderRepository repository;
    @Value("${orders.limit:10}")
    private int limit;

    public Order load(String id) {
        return repository.findById(id);
    }
}
""",
    "client/orders.ts": """import axios from "axios";

export class OrdersClient {
  async find(id: string) {
    return axios.get("/api/orders/42");
  }
}

export const place = (order) => fetch("/api/orders", { method: "POST", body: order });
""",
    "api/users.py": """from fastapi import APIRouter
import requests

router = APIRouter()


@router.get("/users/{user_id}")
async def read_user(user_id: int):
    return requests.get("https://example.com/profiles/7?full=1")


class UserStore:
    def load(self, user_id):
        return user_id
""",
    "server/main.go": """package main

import "net/http"

type Health struct{}

func ping(c *Context) {}

func main() {
	router.GET("/ping/:name", ping)
	http.Get("http://other/ping/x")
}
""",
    "config/application.yml": """server:
  port: ${PORT:8080}
orders:
  limit: 10
  # a comment
  hosts:
    - one
""",
    "config/app.properties": "# comment\nclient.timeout=2000\nclient.url=${CLIENT_URL}\n",
    "db/V1__orders.sql": 'CREATE TABLE IF NOT EXISTS shop.orders (id int);\nALTER TABLE "shop".x ADD y int;\ninsert into items values (1);\n-- customer_id int REFERENCES customers\n',
}
