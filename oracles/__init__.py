"""SQL twins of the registered queries, for checking only. Common parts are named CTEs."""

from __future__ import annotations

import re

from claimlens.plans.views import VIEW_SQL, duckdb_view

from . import coordination, core

CTES = {f"v_{name}": duckdb_view(name) for name in VIEW_SQL}
CTES.update(core.CTES)
CTES.update(coordination.CTES)


def build(body: str) -> str:
    """Prefix a query with the named parts it uses, in order of use."""
    order: list[str] = []

    def need(text: str, own: str | None = None):
        for name in dict.fromkeys(re.findall(r"\b[a-z]\w*\b", text)):
            if name in CTES and name != own and name not in order:
                need(CTES[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body.strip()
    body = body.strip()
    more = ""
    if body.upper().startswith("WITH "):
        more, body = ",\n" + body[5:], ""
    parts = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in order)
    recursive = "RECURSIVE " if any("UNION" in CTES[n] and re.search(rf"\b{n}\b", CTES[n]) for n in order) else ""
    return f"WITH {recursive}{parts}{more}\n{body}"


def all_sql() -> dict[str, str]:
    return {name: build(body) for name, body in {**core.SQL, **coordination.SQL}.items()}
