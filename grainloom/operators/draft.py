"""A first model from tables: entities, dimensions, sums, ratios and yields, with masks and roles filled in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..errors import Refused
from ..model import Model
from .profile import kind

#: Parts of names by meaning.
IDENTIFIERS = ("id", "sku", "uuid", "guid")
ID_ENDS = ("_id", "_uuid", "_guid", "_key", "_fk", "_code")
PERSONAL = (
    "phone", "mobile", "telephone", "email", "e_mail", "id_card", "idcard", "id_no", "idno", "identity_no", "ssn", "passport",
    "bank_card", "bankcard", "card_no", "cardno", "account_no", "accountno", "address", "addr", "postcode", "zipcode",
)
MONEY = (
    "revenue", "sales", "amount", "price", "cost", "cogs", "profit", "margin", "salary", "wage", "payroll", "spend", "payment", "fee", "tax", "rent",
    "gmv", "income", "expense", "budget", "discount", "refund", "deposit", "adr", "revpar", "arpu", "aov", "ticket", "turnover",
)
VALUE, COST, COUNT = ("revenue", "sales", "amount", "value"), ("cost", "cogs"), ("transactions", "orders", "units", "quantity", "qty", "count")
INPUT, OUTPUT, SCRAP = ("in", "input", "charge", "checked"), ("out", "output", "tapped", "good"), ("scrap", "defect", "rework", "loss", "waste")
UNITS = ("qty", "t", "kg", "pcs")
MOST_RATIOS = 4


def identifier(name: str) -> bool:
    n = name.lower()
    return n in IDENTIFIERS or n.endswith(ID_ENDS)


def personal(name: str) -> bool:
    n = name.lower()
    return any(x in n for x in PERSONAL) or n == "tel" or n.endswith("_tel")


def money(name: str, expr: str = "") -> bool:
    return any(x in f"{name}_{expr}".lower() for x in MONEY)


def guessed_key(table: str, columns: list[str]) -> str | None:
    one = re.sub(r"s$", "", table)
    return next((c for c in ("id", f"{one}_id", f"{table}_id") if c in columns), None)


def first(columns: list[str], words: tuple[str, ...]) -> str | None:
    return next((c for w in words for c in columns if w in c.lower()), None)


def ratios(entity: str, numbers: list[str]) -> list[dict]:
    """Yields, then margin and value per count: of one table only, MOST_RATIOS at most, never additive."""
    total = lambda c: f"{entity}_{c}_sum"
    ratio = lambda name, formula, text: {"name": name, "formula": formula, "description": f"{text} (drafted from column names; to be confirmed).", "additivity": "non_additive"}
    out = []
    by_unit: dict[str, dict[str, str]] = {}
    for c in numbers:
        what, _, unit = c.rpartition("_")
        role = next((r for r, words in (("input", INPUT), ("output", OUTPUT), ("scrap", SCRAP)) if what in words), None)
        if unit in UNITS and role:
            by_unit.setdefault(unit, {}).setdefault(c if role == "scrap" else role, c)
    for unit in sorted(by_unit):
        own = by_unit[unit]
        if "input" not in own:
            continue
        for role, c in own.items():
            if role == "output":
                out.append(ratio(f"{entity}_yield_rate", f"{total(c)} / nullif({total(own['input'])}, 0)", f"{c} of {own['input']}"))
            elif role != "input":
                out.append(ratio(f"{entity}_{c}_rate", f"{total(c)} / nullif({total(own['input'])}, 0)", f"{c} of {own['input']}"))
    value = first(numbers, VALUE)
    if value:
        cost = first([c for c in numbers if c != value], COST)
        if cost:
            out.append(ratio(f"{entity}_gross_margin", f"({total(value)} - {total(cost)}) / nullif({total(value)}, 0)", f"{value} less {cost}, of {value}"))
        for c in numbers:
            if c != value and any(w in c.lower() for w in COUNT):
                out.append(ratio(f"{entity}_{value}_per_{re.sub(r's$', '', c)}", f"{total(value)} / nullif({total(c)}, 0)", f"{value} for each of {c}"))
    return out[:MOST_RATIOS]


def draft(tables: dict[str, DataFrame], keys: dict[str, str] | None = None, references: list[tuple[str, str, str, str]] = (), finance: tuple[str, ...] = ("finance", "admin")) -> Model:
    """references: (table, column, parent, parent column). Tables whose names begin with _ and those without a key have no joins to them."""
    keys = dict(keys or {})
    doc: dict[str, list[dict]] = {"entities": [], "joins": [], "dimensions": [], "metrics": []}
    for table, df in sorted(tables.items()):
        if table.startswith("_"):
            continue
        key = keys.get(table) or guessed_key(table, df.columns)
        keys[table] = key
        doc["entities"].append({"name": table, "table": table} | ({"primary_key": key} if key else {}))
        refs = {c for t, c, _, _ in references if t == table}
        numbers = []
        if key:
            doc["metrics"].append({"name": f"{table}_count", "description": f"Rows of {table}.", "entity": table, "agg": "count", "expr": key})
        for f in df.schema.fields:
            k = kind(f.dataType)
            if f.name == key or f.name in refs or k == "other":
                continue
            if k in ("time", "text"):
                row = {"name": f"{table}_{f.name}", "entity": table, "column": f.name, "type": "time" if k == "time" else "categorical", "synonyms": [f.name.replace("_", " ")]}
                doc["dimensions"].append(row | ({"mask": "***"} if personal(f.name) else {}))
            elif not identifier(f.name):
                numbers.append(f.name)
                row = {"name": f"{table}_{f.name}_sum", "description": f"Sum of {f.name} of {table}.", "synonyms": [f"total {f.name.replace('_', ' ')}"], "entity": table, "agg": "sum", "expr": f.name}
                doc["metrics"].append(row | ({"roles": list(finance)} if money(f.name) else {}))
        for r in ratios(table, numbers):
            doc["metrics"].append(r | ({"roles": list(finance)} if money(r["name"], r["formula"]) else {}))
    for table, column, parent, parent_key in references:
        if table in tables and parent in tables:
            doc["joins"].append({"from": table, "to": parent, "from_key": column, "to_key": parent_key, "cardinality": "many_to_one"})
    if not doc["entities"]:
        raise Refused("no tables")
    return Model.of(doc)


def expressible(tree: dict) -> str:
    """Whether a parsed question fits the contract: the first reason why it doesn't, or expressible."""
    if any(tree.get(k) is not None for k in ("union", "intersect", "except")):
        return "set_operation"
    if any(isinstance(u, (list, tuple)) and u and u[0] == "sql" for u in (tree.get("from") or {}).get("table_units", [])):
        return "nested_from"
    nested = lambda x: isinstance(x, dict) or isinstance(x, (list, tuple)) and any(nested(y) for y in x)
    if nested(tree.get("where") or []):
        return "nested_where"
    if tree.get("having"):
        return "having"
    select = (tree.get("select") or [None, []])[1]
    if not select:
        return "malformed"
    if any(item and item[0] for item in select):
        return "expressible"
    order = (tree.get("orderBy") or [None, []])[1]
    by_total = any(unit[1] and unit[1][0] for unit in order if isinstance(unit, (list, tuple)) and len(unit) > 1)
    return "top_n_label_only" if by_total and tree.get("limit") is not None else "row_level"
