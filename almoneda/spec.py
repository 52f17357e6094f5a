"""Filters and sort orders as values, and the Column predicates they stand for."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almoneda.functions import scalar as S

#: Fields that results may be sorted by. Fixed values.
SORTABLE = {"publication_date": "publication_ts", "submission_deadline": "deadline_ts", "budget_amount": "budget_amount", "award_date": "award_ts", "updated": "updated"}


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


@dataclass(frozen=True)
class FilterSpec:
    """Present filters are joined by AND, the values of one by OR; a spec without any keeps everything.

    Codes are compared whole and with case. Dates are inclusive days; a bound of 0 is a bound.
    """

    cpv: tuple[str, ...] = ()
    nuts: tuple[str, ...] = ()
    status: tuple[str, ...] = ()
    result: tuple[str, ...] = ()
    contract_type: tuple[str, ...] = ()
    procedure: tuple[str, ...] = ()
    pub_from: str | None = None
    pub_to: str | None = None
    deadline_from: str | None = None
    deadline_to: str | None = None
    budget_min: float | None = None
    budget_max: float | None = None
    cpv_column: str = field(default="cpv", compare=False)

    def dimensions(self) -> dict[str, Column]:
        """One predicate a dimension that is filtered: cpv, nuts, status, result, contract_type, procedure, dates, budget."""
        out: dict[str, Column] = {}
        if self.cpv:
            out["cpv"] = F.exists(self.cpv_column, lambda c: _any([c.startswith(v) for v in self.cpv]))
        if self.nuts:
            out["nuts"] = _any([F.col("nuts").startswith(v) for v in self.nuts])
        for name, column in (("status", "status_code"), ("result", "result_code"), ("contract_type", "contract_type_code"), ("procedure", "procedure_code")):
            if getattr(self, name):
                out[name] = F.col(column).isin(*getattr(self, name))
        days = []
        for column, low, high in (("publication_ts", self.pub_from, self.pub_to), ("deadline_ts", self.deadline_from, self.deadline_to)):
            days += [F.col(column) >= F.lit(low).cast("timestamp")] if low else []
            days += [F.col(column) <= F.lit(f"{high} 23:59:59").cast("timestamp")] if high else []
        if days:
            out["dates"] = reduce(lambda a, b: a & b, days)
        amounts = [F.col("budget_amount") >= self.budget_min] if self.budget_min is not None else []
        amounts += [F.col("budget_amount") <= self.budget_max] if self.budget_max is not None else []
        if amounts:
            out["budget"] = reduce(lambda a, b: a & b, amounts)
        return out

    def predicate(self, *without: str) -> Column | None:
        """All dimensions but those named, as one predicate; None if there are none."""
        tests = [p for k, p in self.dimensions().items() if k not in without]
        return reduce(lambda a, b: a & b, tests) if tests else None

    def apply(self, df: DataFrame, *without: str) -> DataFrame:
        p = self.predicate(*without)
        return df if p is None else df.filter(p)

    def active(self) -> list[tuple[str, object]]:
        """(name, value) of every filter value in force."""
        out = []
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name != "cpv_column" and v not in (None, ()):
                out += [(f.name, x) for x in v] if isinstance(v, tuple) else [(f.name, v)]
        return out

    def without(self, name: str, *values: str) -> FilterSpec:
        """The spec less some values of a filter; less the whole filter if it is a bound or no value is given."""
        now = getattr(self, name)
        return replace(self, **{name: tuple(v for v in now if v not in values) if isinstance(now, tuple) and values else () if isinstance(now, tuple) else None})

    def to_text(self) -> str:
        """The filters as SQL text, for logs; queries run on Columns and never on this."""
        quoted = lambda v: "'" + str(v).replace("'", "''") + "'"
        starts = lambda c, vs: " OR ".join(f"startswith({c}, {quoted(v)})" for v in vs)
        out = [f"exists({self.cpv_column}, c -> {starts('c', self.cpv)})"] if self.cpv else []
        out += [f"({starts('nuts', self.nuts)})"] if self.nuts else []
        for name in ("status", "result", "contract_type", "procedure"):
            out += [f"{name}_code IN ({', '.join(map(quoted, getattr(self, name)))})"] if getattr(self, name) else []
        for column, low, high in (("publication_ts", self.pub_from, self.pub_to), ("deadline_ts", self.deadline_from, self.deadline_to)):
            out += [f"{column} >= timestamp {quoted(low)}"] if low else []
            out += [f"{column} <= timestamp {quoted(f'{high} 23:59:59')}"] if high else []
        out += [f"budget_amount >= {self.budget_min}"] if self.budget_min is not None else []
        out += [f"budget_amount <= {self.budget_max}"] if self.budget_max is not None else []
        return " AND ".join(out)

    @classmethod
    def from_params(cls, params: dict, today: str | None = None) -> FilterSpec:
        """From request parameters: empty ones are dropped, `open_only` means deadlines from today on."""
        known = {f.name for f in fields(cls)} - {"cpv_column"}
        found = {k: tuple(v) if isinstance(v, (list, tuple)) else v for k, v in params.items() if k in known and v not in (None, "", [], ())}
        if params.get("open_only") and today:
            found["deadline_from"] = today
        return cls(**found)


def cpv_node(code: Column | str, cpv: str = "cpv") -> Column:
    """Whether any code of a contract lies under a node."""
    stem = S.cpv_prefix(F.lit(code) if isinstance(code, str) else code)
    return F.exists(cpv, lambda c: c.startswith(stem))


def sort_order(sort: str | None, columns: list[str]) -> list[Column]:
    """`field asc` or `field desc` for the fields allowed; anything else is publication_date desc. Nulls last, ties by sid."""
    name, _, way = (sort or "").strip().partition(" ")
    column = SORTABLE.get(name)
    if column not in columns or way.strip().lower() not in ("", "asc", "desc"):
        column, way = "publication_ts", "desc"
    return [F.col(column).asc_nulls_last() if way.strip().lower() == "asc" else F.col(column).desc_nulls_last(), F.col("sid").asc()]


def browse(df: DataFrame, spec: FilterSpec, sort: str | None = None, k: int = 15, offset: int = 0) -> DataFrame:
    """One page of filtered and sorted results; k is held to 1..50."""
    return spec.apply(df).orderBy(*sort_order(sort, df.columns)).offset(max(offset, 0)).limit(min(max(k, 1), 50))


def _beyond(column: Column, value, way: str) -> Column:
    """Rows whose value comes after one in an order with nulls last."""
    if value is None:
        return F.lit(False)
    further = column > F.lit(value) if way == "asc" else column < F.lit(value)
    return further | column.isNull()


def keyset_page(df: DataFrame, sort: list[tuple[str, str]], after: tuple | None = None, k: int = 15) -> DataFrame:
    """The k rows that follow the row whose values of the sort columns are `after`; the first k without.

    sort: (column, asc or desc), nulls last; the last column tells rows apart. The cursor is a filter on the first column, so a
    scan leaves out what lies before it, and page n costs what page 1 does: no row of an earlier page is sorted.
    """
    order = [F.col(c).asc_nulls_last() if way == "asc" else F.col(c).desc_nulls_last() for c, way in sort]
    if after is not None:
        follows = F.lit(False)
        for i in reversed(range(len(sort))):  # beyond in this column, or equal and what follows says so
            c, way = sort[i]
            follows = _beyond(F.col(c), after[i], way) | (F.col(c).eqNullSafe(F.lit(after[i])) & follows)
        c, way = sort[0]
        if after[0] is None:
            reach = F.col(c).isNull()
        else:
            reach = (F.col(c) >= F.lit(after[0]) if way == "asc" else F.col(c) <= F.lit(after[0])) | F.col(c).isNull()
        df = df.filter(reach).filter(follows)
    return df.orderBy(*order).limit(k)


def cursor(page: list, sort: list[tuple[str, str]]) -> tuple | None:
    """The cursor after a page's rows: the sort columns of its last; None after the last page."""
    return tuple(page[-1][c] for c, _ in sort) if page else None


def has_more(total: int | None, offset: int, shown: int, k: int = 15) -> bool:
    """Whether a page has another after it; without a total, whether it is full."""
    return offset + shown < total if total is not None else shown == k


def pages(found: DataFrame, k: int = 15) -> DataFrame:
    """(page, shown, more) of all pages of k rows that a result has; `more` as has_more tells it."""
    total = found.agg(F.count("*").alias("total"))
    each = total.filter("total > 0").select("total", F.explode(F.sequence(F.lit(0), ((F.col("total") - 1) / k).cast("int"))).alias("page"))
    shown = F.least(F.lit(k), F.col("total") - F.col("page") * k).cast("long")
    return each.select("page", shown.alias("shown"), (F.col("page") * k + shown < F.col("total")).alias("more"))
