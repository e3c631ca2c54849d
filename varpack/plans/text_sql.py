"""DuckDB builders for commentary text: magnitudes, percentages, names, joined
lists and filled sentence templates."""

from __future__ import annotations


def mag(x: str) -> str:
    a = f"abs(CAST({x} AS DECIMAL(38,4)))"
    return (f"(CASE WHEN {a} >= 1000000 THEN concat('€', CAST(CAST(round({a} * CAST(0.000001 AS DECIMAL(7,6)), 1) AS DECIMAL(38,1)) AS VARCHAR), 'm') "
            f"WHEN {a} >= 1000 THEN concat('€', CAST(CAST(round({a} * CAST(0.001 AS DECIMAL(4,3)), 1) AS DECIMAL(38,1)) AS VARCHAR), 'k') "
            f"ELSE concat('€', CAST(CAST(round({a}, 0) AS DECIMAL(38,0)) AS VARCHAR)) END)")


def pct(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'n/a' ELSE concat(CAST(CAST(round(CAST(abs({x}) AS DECIMAL(38,10)) * 100, 1) "
            f"AS DECIMAL(38,1)) AS VARCHAR), '%') END)")


def prose(x: str) -> str:
    return (f"(CASE WHEN NOT regexp_matches(trim({x}), '\\p{{Ll}}') AND regexp_matches(trim({x}), '\\p{{Nd}}') "
            f"AND regexp_matches(trim({x}), '\\p{{L}}') AND NOT contains(trim({x}), ' ') THEN trim({x}) ELSE lower(trim({x})) END)")


def join(items: str) -> str:
    """'a', 'a and b', 'a, b and c'; '; ' where an item holds a separator."""
    odd = f"len([x FOR x IN {items} IF contains(x, ' - ') OR contains(x, ' – ') OR contains(x, ', ')]) > 0"
    return (f"(CASE WHEN len({items}) = 0 OR {items} IS NULL THEN '' WHEN len({items}) = 1 THEN {items}[1] "
            f"WHEN {odd} THEN array_to_string({items}, '; ') "
            f"ELSE concat(array_to_string({items}[1 : len({items}) - 1], ', '), ' and ', {items}[len({items})]) END)")


def fill(template: str, *values: str) -> str:
    parts, rest = [], template.replace("'", "''")
    for i, v in enumerate(values):
        head, rest = rest.split(f"{{{i}}}", 1)
        parts += [f"'{head}'", f"CAST({v} AS VARCHAR)"]
    return "concat(" + ", ".join([*parts, f"'{rest}'"]) + ")"


def clause(var: str, p: str, word: str | None) -> str:
    """One timeframe as a phrase (T5)."""
    side = f"CASE WHEN {var} >= 0 THEN 'above' ELSE 'below' END"
    core = (f"CASE WHEN {p} IS NULL THEN concat({mag(var)}, ' ', {side}, ' budget, percentage not meaningful') "
            f"ELSE concat({mag(var)}, ' (', {pct(p)}, ') ', {side}, ' budget') END")
    if word:
        core = f"concat({core}, ', ', {word})"
    return f"(CASE WHEN abs({var}) < 0.5 OR ({p} IS NOT NULL AND abs({p}) < 0.005) THEN 'in line with budget' ELSE {core} END)"


def word(fu: str) -> str:
    return f"(CASE WHEN {fu} = 'F' THEN 'favourable' ELSE 'unfavourable' END)"


def verdict(month: str, ytd: str) -> str:
    from ..functions.commentary import VERDICTS
    return (f"(CASE WHEN {month} AND {ytd} THEN '{VERDICTS[(True, True)]}' WHEN {ytd} THEN '{VERDICTS[(False, True)]}' "
            f"WHEN {month} THEN '{VERDICTS[(True, False)]}' ELSE '{VERDICTS[(False, False)]}' END)")


def two_horizon(mv: str, mp: str, mm: str, yv: str, yp: str, ym: str, w: str) -> str:
    return (f"concat('YTD ', {clause(yv, yp, w)}, '. Month ', {clause(mv, mp, None)}, '. ', {verdict(mm, ym)})")
