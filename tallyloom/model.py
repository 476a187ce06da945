"""The query language: frozen dataclasses, their JSON form, and its canonical form."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from typing import Any


@dataclass(frozen=True)
class FieldSpec:
    """A queryable field: its column in the canonical relation and what may be done with it."""

    column: str
    label: str
    unit: str = ""
    numeric: bool = False
    temporal: bool = False
    groupable: bool = False
    sortable: bool = False


FIELDS: dict[str, FieldSpec] = {
    "FARMER_NAME": FieldSpec("farmer_name", "Farmer", groupable=True, sortable=True),
    "FARMER_ID": FieldSpec("farmer_id", "Farmer id", groupable=True),
    "QUANTITY": FieldSpec("quantity", "Quantity", "L", numeric=True, sortable=True),
    "FAT": FieldSpec("fat", "Fat", "%", numeric=True, sortable=True),
    "SNF": FieldSpec("snf", "SNF", "%", numeric=True, sortable=True),
    "PAYMENT_STATUS": FieldSpec("payment_status", "Payment status", groupable=True, sortable=True),
    "PAYMENT_METHOD": FieldSpec("payment_method", "Payment method", groupable=True, sortable=True),
    "PAYMENT_REFERENCE": FieldSpec("payment_reference", "Reference"),
    "PAYMENT_TIMESTAMP": FieldSpec("payment_timestamp", "Paid at", temporal=True, sortable=True),
    "PAYABLE_AMOUNT": FieldSpec("payable_amount", "Payable amount", "₹", numeric=True, sortable=True),
    "AMOUNT_PAID": FieldSpec("amount_paid", "Amount paid", "₹", numeric=True, sortable=True),
    "CREATED_AT": FieldSpec("created_at", "Created", temporal=True, sortable=True),
    "UPDATED_AT": FieldSpec("updated_at", "Updated", temporal=True, sortable=True),
    "UPLOAD_STATUS": FieldSpec("upload_status", "Upload status", groupable=True, sortable=True),
}
REQUEST_TYPES = ("QUERY", "WRITE", "CLARIFY", "UNSUPPORTED")
TARGETS = ("MILK_RECORDS", "WORKER_PROFILE", "ORGANIZATION_INFO", "KNOWLEDGE_BASE")
COMPARISONS = {"GREATER_THAN": ">", "GREATER_OR_EQUAL": ">=", "LESS_THAN": "<", "LESS_OR_EQUAL": "<="}
OPERATORS = ("EQUALS", "NOT_EQUALS", *COMPARISONS, "IS_NULL", "IS_NOT_NULL", "CONTAINS", "IN_RANGE")
AGGREGATIONS = ("SUM", "COUNT_RECORDS", "COUNT_DISTINCT_FARMERS", "AVG", "MIN", "MAX")
PERIODS = ("TODAY", "YESTERDAY", "THIS_WEEK", "LAST_WEEK", "THIS_MONTH", "LAST_MONTH", "SINCE_MONDAY", "LAST_SUNDAY")
SCOPES = ("LATEST", "ALL", "ANY")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: str | None = None
    secondary: str | None = None


@dataclass(frozen=True)
class Period:
    """kind RELATIVE: period; DATE: start; RANGE: start and end, both inclusive days."""

    kind: str
    period: str | None = None
    start: str | None = None
    end: str | None = None


@dataclass(frozen=True)
class Aggregation:
    type: str
    field: str | None = None

    def name(self, default: str = "QUANTITY") -> str:
        return {"COUNT_RECORDS": "count_records", "COUNT_DISTINCT_FARMERS": "count_farmers"}.get(self.type) or f"{self.type.lower()}_{FIELDS[self.field or default].column}"


@dataclass(frozen=True)
class Having:
    aggregation: str
    field: str
    op: str
    value: float


@dataclass(frozen=True)
class Order:
    """By an aggregation if one is named, else by a field."""

    field: str | None = None
    aggregation: str | None = None
    descending: bool = True


@dataclass(frozen=True)
class Conditional:
    field: str = "PAYMENT_STATUS"
    expected: str = "PAID"
    on_match: tuple[str, ...] = ("PAYMENT_METHOD", "PAYMENT_REFERENCE")
    on_mismatch: tuple[str, ...] = ("PAYMENT_STATUS", "PAYABLE_AMOUNT")


@dataclass(frozen=True)
class Query:
    request: str = "QUERY"
    target: str = "MILK_RECORDS"
    mention: str | None = None
    specific: bool = False
    select: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    any_filter: bool = False
    time: Period | None = None
    aggregations: tuple[Aggregation, ...] = ()
    group_by: tuple[str, ...] = ()
    having: Having | None = None
    order: Order | None = None
    limit: int | None = None
    exists: bool = False
    scope: str | None = None
    conditional: Conditional | None = None
    write_args: dict[str, str] = field(default_factory=dict)
    knowledge: str | None = None
    clarify_reason: str | None = None
    unsupported_reason: str | None = None


def _field(x: Any) -> str | None:
    name = str(x).strip().upper().replace(" ", "_") if x is not None else ""
    return name if name in FIELDS else None


def _fields(xs: Any) -> tuple[str, ...]:
    return tuple(dict.fromkeys(f for x in xs or [] if (f := _field(x))))


def _aggregation(x: dict[str, Any]) -> Aggregation | None:
    kind = str(x.get("type", "")).upper()
    kind = "COUNT_RECORDS" if kind == "COUNT" else kind
    return Aggregation(kind, _field(x.get("field"))) if kind in AGGREGATIONS else None


def _period(x: dict[str, Any] | None) -> Period | None:
    if not x:
        return None
    if x.get("period"):
        return Period("RELATIVE", str(x["period"]).upper())
    if x.get("startDate") and x.get("endDate"):
        return Period("RANGE", None, x["startDate"], x["endDate"])
    return Period("DATE", None, x["date"]) if x.get("date") else None


def model_json(text: str) -> dict[str, Any] | None:
    """The JSON object in a model's answer: after the last closing thought, without fences, the longest that parses from its first brace."""
    text = re.sub(r"```(?:json)?", "", text.rpartition("</think>")[2])
    start = text.find("{")
    for stop in (i + 1 for i in range(len(text) - 1, start - 1, -1) if start >= 0 and text[i] == "}"):
        try:
            found = json.loads(text[start:stop])
        except ValueError:
            continue
        return found if isinstance(found, dict) else None
    return None


def _plain(x: Any) -> float | None:
    """A number, or a text that is one."""
    if isinstance(x, bool) or not re.fullmatch(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*", str(x)):
        return None
    return float(x)


def _having(x: Any) -> Having | None:
    """A HAVING condition; None if a part is missing or can't be read."""
    x = x if isinstance(x, dict) else {}
    kind, op, value = str(x.get("agg", x.get("aggregation", ""))).upper(), str(x.get("op", "")).upper(), _plain(x.get("value"))
    kind = "COUNT_RECORDS" if kind == "COUNT" else kind
    return Having(kind, _field(x.get("field")) or "QUANTITY", op, value) if kind in AGGREGATIONS and op in OPERATORS and value is not None else None


def from_json(x: dict[str, Any] | str) -> Query | None:
    """A Query from its JSON form (what can't be read is dropped); None if text holds no object."""
    x = model_json(x) if isinstance(x, str) else x
    if x is None:
        return None
    filters = x.get("filters") or []
    logic, conditions = (filters.get("logic", "AND"), filters.get("conditions") or []) if isinstance(filters, dict) else ("AND", filters)
    parsed = []
    for c in (c for c in conditions if isinstance(c, dict)):
        op = str(c.get("op", c.get("operator", ""))).upper()
        if (f := _field(c.get("field"))) and op in OPERATORS:
            text = lambda v: None if v is None else str(v)
            parsed.append(Filter(f, op, text(c.get("value")), text(c.get("secondaryValue"))))
    having, entity = x.get("havingFilter"), x.get("entity", x.get("entityMention"))
    order, condition = (v if isinstance(v, dict) else None for v in (x.get("orderBy"), x.get("conditionalSpec")))
    mention = entity.get("mention") if isinstance(entity, dict) else entity
    by_aggregate = order and (order.get("target") == "AGGREGATE" or order.get("aggregation"))
    return Query(
        request=x.get("requestType") if x.get("requestType") in REQUEST_TYPES else "QUERY",
        target=x.get("target") if x.get("target") in TARGETS else "MILK_RECORDS",
        mention=mention,
        specific=bool(mention),
        select=_fields(x.get("select")),
        filters=tuple(parsed),
        any_filter=str(logic).upper() == "OR",
        time=_period(x.get("time")),
        aggregations=tuple(a for a in map(_aggregation, (a for a in x.get("aggregations") or [] if isinstance(a, dict))) if a),
        group_by=_fields(x.get("groupBy")),
        having=_having(having),
        order=Order(_field(order.get("field")), (order.get("aggregation") or "SUM") if by_aggregate else None, str(order.get("dir", "DESC")).upper() != "ASC") if order else None,
        limit=int(limit) if (limit := _plain(x.get("limit"))) is not None else None,
        exists=bool(x.get("exists")),
        scope=x.get("paymentScope") if x.get("paymentScope") in SCOPES else None,
        conditional=Conditional(_field(condition.get("conditionField")) or "PAYMENT_STATUS", condition.get("expectedValue") or "PAID") if condition is not None else None,
        write_args={k: str(v) for k, v in x["writeArgs"].items()} if isinstance(x.get("writeArgs"), dict) else {},
        knowledge=x.get("knowledgeQuery"),
        clarify_reason=x.get("clarifyReason"),
        unsupported_reason=x.get("unsupportedReason"),
    )


def canonical(q: Query) -> str:
    """One JSON text for all equal queries: lists without order are sorted, keys too; aggregations keep theirs."""
    x = asdict(q)
    x["select"], x["group_by"] = sorted(set(q.select)), sorted(set(q.group_by))
    x["filters"] = sorted(x["filters"], key=lambda f: (f["field"], f["op"], f["value"] or ""))
    return json.dumps(x, sort_keys=True, ensure_ascii=False)
