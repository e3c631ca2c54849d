"""P&L structure, category directions and expense groups as data.

The P&L tree is flattened once, at import, into a sign matrix: for each report
line the signed categories it sums. Reports then need no join at all: one
conditional-sum aggregate per grain, and the lines are built as Column
expressions over those sums.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): P&L lines in order, their kind and
# direction, the category of each category line, and the components of each
# computed line.
# ---------------------------------------------------------------------------
CATEGORIES = ["Revenue", "COGS", "OpEx", "Other"]

PNL_LINES = [
    # (label, kind, higher_is_better, category, components)
    ("Revenue", "category", True, "Revenue", None),
    ("Cost of goods sold", "category", False, "COGS", None),
    ("Gross profit", "computed", True, None, (("+", "Revenue"), ("-", "Cost of goods sold"))),
    ("Operating expenses", "category", False, "OpEx", None),
    ("Operating income (EBIT)", "computed", True, None,
     (("+", "Gross profit"), ("-", "Operating expenses"))),
    ("Other expenses", "category", False, "Other", None),
    ("Net income", "computed", True, None,
     (("+", "Operating income (EBIT)"), ("-", "Other expenses"))),
]

# Expense groups in report order, each with its types in order.
EXPENSE_GROUPS = [
    ("Personnel costs", ["Salaries & wages", "Payroll benefits", "Employee incentives",
                         "External staff / contractors"]),
    ("Other operating costs", ["Marketing & advertising", "External professional fees",
                               "IT & software", "Facilities & office",
                               "Travel & entertainment", "Insurance"]),
    ("Cost of sales", ["Materials & components", "Direct labour", "Hosting & infrastructure",
                       "Third-party licences", "Logistics & fees"]),
    ("Depreciation & amortisation", ["Depreciation & amortisation"]),
    ("Financing", ["Financing & bank"]),
]
OTHER_EXPENSE_GROUP = "Other expense types"
UNCLASSIFIED_EXPENSE = "Other expenses"

# Category line of the P&L for each category.
LINE_OF_CATEGORY = {"Revenue": "Revenue", "COGS": "Cost of goods sold",
                    "OpEx": "Operating expenses", "Other": "Other expenses"}


def _flatten() -> dict[str, dict[str, int]]:
    signs: dict[str, dict[str, int]] = {}
    for label, kind, _hib, category, components in PNL_LINES:
        if kind == "category":
            signs[label] = {category: 1}
        else:
            acc: dict[str, int] = {}
            for sign, ref in components:
                s = 1 if sign == "+" else -1
                for cat, v in signs[ref].items():
                    acc[cat] = acc.get(cat, 0) + s * v
            signs[label] = {c: v for c, v in acc.items() if v}
    return signs


SIGN_MATRIX: dict[str, dict[str, int]] = _flatten()
LINE_ORDER = {label: i + 1 for i, (label, *_r) in enumerate(PNL_LINES)}
LINE_HIGHER = {label: hib for label, _k, hib, *_r in PNL_LINES}
LINE_KIND = {label: kind for label, kind, *_r in PNL_LINES}


def sign_rows() -> list[tuple]:
    """(line_ord, line, kind, higher_is_better, category, sign) rows."""
    out = []
    for label, kind, hib, *_r in PNL_LINES:
        for cat, s in SIGN_MATRIX[label].items():
            out.append((LINE_ORDER[label], label, kind, hib, cat, s))
    return out