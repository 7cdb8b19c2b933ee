"""Check SQL: named common table expressions, chained on demand into one statement."""
from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    if name in CTES:
        raise ValueError(name)
    CTES[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    words = dict.fromkeys(re.findall(r"\b[a-z_][a-z0-9_]*\b", sql))
    return [w for w in words if w in CTES]


def _same_round(sql: str) -> str:
    """Write every round(x, n) as floor arithmetic, which both engines compute alike."""
    out, i = "", 0
    while (at := sql.find("round(", i)) >= 0:
        depth, comma, end = 0, None, at + 5
        while True:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            if depth == 0:
                break
            end += 1
        body, digits = _same_round(sql[at + 6 : comma]), int(sql[comma + 1 : end])
        out += sql[i:at] + f"(floor(({body}) * 1e{digits} + 0.5) / 1e{digits})"
        i = end + 1
    return out + sql[i:]


def statement(final: str) -> str:
    """The final select, with every CTE it reaches in front of it."""
    done: list[str] = []

    def visit(sql: str, me: str | None) -> None:
        for name in _needs(sql):
            if name != me and name not in done:
                visit(CTES[name], name)
                if name not in done:
                    done.append(name)

    visit(final, None)
    if not done:
        return _same_round(final.strip())
    body = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in done)
    return _same_round(f"WITH {body}\n{final.strip()}")
