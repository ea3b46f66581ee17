"""Query registry: name -> (spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def with_ctes(*ctes: str) -> str:
    """Join fixture CTE snippets (deduplicated, order kept) into a WITH clause."""
    seen, parts = set(), []
    for c in ctes:
        for piece in _split_ctes(c):
            key = piece.split(" AS ", 1)[0].strip()
            if key not in seen:
                seen.add(key)
                parts.append(piece)
    return "WITH " + ",\n".join(parts) + "\n"


def _split_ctes(text: str) -> list[str]:
    out, depth, cur, quoted = [], 0, [], False
    for ch in text:
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch == "(":
            depth += 1
        elif not quoted and ch == ")":
            depth -= 1
        if ch == "," and depth == 0 and not quoted:
            out.append("".join(cur).strip())
            cur = []
            continue
        cur.append(ch)
    if "".join(cur).strip():
        out.append("".join(cur).strip())
    return out
