"""Small tables and brute-force versions used by the tests."""

from __future__ import annotations

from itertools import combinations

from tidegraph.schema import CANONICAL_SCHEMA, ENTITY_TYPES, SPECIFIC_TYPES

DEFAULTS = dict(amount=10.0, product_code="W", is_fraud=0, source="synthetic", **{c: None for c in ENTITY_TYPES})


def canonical(spark, rows: list[dict], **extra_types):
    """A canonical table from dicts; missing fields get defaults, ids are numbered."""
    full = [{**DEFAULTS, "transaction_id": f"t{i:03d}", "transaction_time": i, **r} for i, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(r[c] for c in CANONICAL_SCHEMA.names) for r in full], CANONICAL_SCHEMA)
    if extra_types:
        from pyspark.sql import functions as F

        more = spark.createDataFrame([(r["transaction_id"], *(r.get(c) for c in extra_types)) for r in full], "transaction_id string, " + ", ".join(f"{c} {t}" for c, t in extra_types.items()))
        df = df.join(F.broadcast(more), "transaction_id")
    return df


def random_rows(rng, n: int, values: int = 4, times: int = 12, null_share: float = 0.25) -> list[dict]:
    out = []
    for i in range(n):
        r = {c: None if rng.random() < null_share else f"{t}{rng.integers(values)}" for c, t in ENTITY_TYPES.items()}
        if all(v is None for v in r.values()):
            r["card_id"] = "card0"
        out.append({**r, "transaction_id": f"t{i:03d}", "transaction_time": int(rng.integers(times)) * 30_000, "is_fraud": int(rng.random() < 0.3)})
    return out


def nodes(row: dict, types=SPECIFIC_TYPES) -> set[str]:
    return {f"{t}::{row[c]}" for c, t in types.items() if row.get(c) is not None}


def shares(a: dict, b: dict, types=SPECIFIC_TYPES) -> bool:
    return bool(nodes(a, types) & nodes(b, types))


def components(edges: list[tuple], vertices=()) -> dict:
    """Vertex -> smallest vertex of its component."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in vertices:
        find(v)
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in list(parent)}


def clustering(history: list[dict], node: str) -> float:
    pairs = {p for r in history for p in combinations(sorted(nodes(r)), 2)}
    near = {a if b == node else b for a, b in pairs if node in (a, b)}
    if len(near) < 2:
        return 0.0
    links = sum((min(a, b), max(a, b)) in pairs for a, b in combinations(near, 2))
    return 2.0 * links / (len(near) * (len(near) - 1))
