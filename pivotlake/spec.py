"""The declarative pivot definition and its JSON form."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as default
from typing import Any

from pivotlake.errors import PivotError
from pivotlake.functions.dates import display_name

# The closed vocabularies of a pivot definition.
AGGREGATIONS = ("count", "sum", "average", "min", "max")
LAYOUTS = ("compact", "tabular")
DIRECTIONS = ("asc", "desc", "ascending", "descending")
NUMBER_FORMATS = ("integer", "decimal", "currency", "percentage", "thousands")
DATE_FORMATS = ("yyyy-mm-dd", "dd-mm-yyyy", "MMM yyyy", "MMMM yyyy", "quarter", "year")
RULE_TYPES = ("gt", "lt", "eq", "top10", "bottom10", "duplicates")
BLANK = "(blank)"
COLUMN_TOTAL = "Column Total"
ROW_TOTAL = "row_total"
COMPACT_COLUMN = "Rows"
HEADER_JOIN = " | "
LABEL_JOIN = " / "
PARENT_JOIN = "||"

# The words that switch an option on.
ON_WORDS = ("1", "true", "yes", "on")
OFF_WORDS = ("", "0", "false", "no", "off")
_SWITCH = dict.fromkeys(ON_WORDS, True) | dict.fromkeys(OFF_WORDS, False)


def _option(options: Mapping[str, Any], name: str, default: bool) -> bool:
    """A switch of a definition in JSON: every scalar is looked up by its JSON text, and
    one that is in neither list is refused rather than taken for off."""
    given = options.get(name, default)
    text = given if isinstance(given, str) else "" if given is None else json.dumps(given)
    try:
        return _SWITCH[text.strip().lower()]
    except KeyError:
        raise PivotError(f"{name} is neither on nor off: {given!r}") from None


@dataclass(frozen=True)
class Measure:
    """One value field with its aggregation; the label defaults to both joined."""

    field: str
    aggregation: str = "sum"
    label: str | None = None

    @property
    def name(self) -> str:
        return self.label or f"{self.aggregation}_{self.field}"

    @classmethod
    def of(cls, item: Any) -> Measure:
        if isinstance(item, Measure):
            made = item
        elif isinstance(item, str):
            made = cls(item)
        elif isinstance(item, Mapping) and "field" in item:
            made = cls(item["field"], item.get("aggregation") or "sum", item.get("label"))
        else:
            raise PivotError(f"not a value entry: {item!r}")
        return cls(made.field, made.aggregation.lower(), made.label)


@dataclass(frozen=True)
class Totals:
    grand: bool = True
    row: bool = True
    column: bool = False
    subtotals: bool = False
    repeat_labels: bool = False

    @classmethod
    def of(cls, item: Any) -> Totals:
        if isinstance(item, Totals):
            return item
        item = item or {}
        return cls(
            _option(item, "showGrandTotals", True),
            _option(item, "showRowTotals", True),
            _option(item, "showColumnTotals", False),
            _option(item, "showSubtotals", False),
            _option(item, "repeatItemLabels", False),
        )


@dataclass(frozen=True)
class Rule:
    """One conditional format: flag the cells of ``field`` that satisfy ``type``."""

    field: str
    type: str
    value: Any = None
    background: str | None = None

    @classmethod
    def of(cls, item: Any) -> Rule:
        if isinstance(item, Rule):
            return item
        return cls(
            item.get("field") or "", item.get("type") or "", item.get("value"), item.get("background")
        )


@dataclass(frozen=True)
class Display:
    number_format: Mapping[str, str] = default(default_factory=dict)
    date_format: Mapping[str, str] = default(default_factory=dict)
    rules: Sequence[Rule] = ()
    frozen: Sequence[str] = ()
    hidden: Sequence[str] = ()

    @classmethod
    def of(cls, item: Any) -> Display:
        if isinstance(item, Display):
            return item
        item = item or {}
        return cls(
            dict(item.get("numberFormat") or {}),
            dict(item.get("dateFormat") or {}),
            tuple(Rule.of(r) for r in item.get("conditionalFormats") or ()),
            tuple(item.get("frozenColumns") or ()),
            tuple(item.get("hiddenColumns") or ()),
        )


@dataclass(frozen=True)
class PivotSpec:
    rows: Sequence[str] = ()
    columns: Sequence[str] = ()
    values: Sequence[Any] = ()
    filters: Mapping[str, Any] = default(default_factory=dict)
    date_grouping: Mapping[str, str] = default(default_factory=dict)
    sorting: Mapping[str, str] = default(default_factory=dict)
    totals: Totals = Totals()
    layout: str = "tabular"
    display: Display = Display()
    blank_as_text: bool = False

    @classmethod
    def from_json(cls, payload: str | Mapping[str, Any]) -> PivotSpec:
        """Read the camelCase JSON form."""
        item = json.loads(payload) if isinstance(payload, str) else payload
        return cls(
            rows=tuple(item.get("rows") or ()),
            columns=tuple(item.get("columns") or ()),
            values=tuple(item.get("values") or ()),
            filters=dict(item.get("filters") or {}),
            date_grouping=dict(item.get("dateGrouping") or {}),
            sorting=dict(item.get("sorting") or {}),
            totals=Totals.of(item.get("totals")),
            layout=item.get("layout") or "tabular",
            display=Display.of(item.get("displayOptions")),
            blank_as_text=_option(item, "blankAsText", False),
        )

    def measures(self, first_column: str) -> list[Measure]:
        """The value entries; a definition without any counts the first column."""
        if not self.values:
            return [Measure(first_column, "count", "count")]
        return [Measure.of(v) for v in self.values]

    def shown(self, field: str) -> str:
        """The name a group field has in results."""
        grain = self.date_grouping.get(field)
        return display_name(field, grain) if grain else field
