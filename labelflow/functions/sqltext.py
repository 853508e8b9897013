"""Render Python string templates as DuckDB concatenation expressions
(used by the oracle SQL texts only)."""

from __future__ import annotations

import string


def sql_literal(s: str) -> str:
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted)


def sql_render(template: str, **exprs: str) -> str:
    pieces = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(sql_literal(literal))
        if field is not None:
            pieces.append(f"({exprs[field]})")
    return " || ".join(pieces)
