"""Deeply nested records as related flat tables (shared inlining)."""

from __future__ import annotations

import json
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_DOWN, Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = "line"
_BAD = object()
_ROWS = 20_000


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _fraction(text: str):
    """A number with a fraction or an exponent, exactly; one whose exponent no decimal holds stays a text."""
    try:
        return Decimal(text)
    except InvalidOperation:
        return text


def _whole(text: str):
    return int(text) if len(text) < 1000 else Decimal(text)


_READ = {"parse_constant": _no_constant, "parse_float": _fraction, "parse_int": _whole}
_FAST = json.JSONDecoder(**_READ)


def _deep_decoder() -> json.JSONDecoder:
    """A decoder for values nested more deeply than the fast one takes."""
    slow = json.JSONDecoder(**_READ)
    slow.parse_object, slow.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
    slow.parse_string = json.decoder.py_scanstring
    slow.scan_once = json.scanner.py_make_scanner(slow)
    return slow


def parse(line: str | None):
    """The JSON value that a text is, _BAD unless the whole text is one complete value."""
    if line is None or not line.strip():
        return _BAD
    try:
        return _FAST.decode(line)
    except RecursionError:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * len(line)))
        try:
            return _deep_decoder().decode(line)
        except ValueError:
            return _BAD
    except ValueError:
        return _BAD


_NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def number(value) -> int | None:
    """A number, however it is written, as int64; None if it is none or is not whole or does not fit."""
    if isinstance(value, str):
        value = value.strip()
        value = _fraction(value) if _NUMBER.fullmatch(value) else None
    if isinstance(value, float):
        value = Decimal(value)
    if isinstance(value, Decimal):
        # looked at by its exponent first: written out, 1e999999999 would have a thousand million digits
        if not value:
            return 0 if value.is_finite() else None
        if not value.is_finite() or not 0 <= value.adjusted() <= 18:
            return None
        whole = value.to_integral_value(ROUND_DOWN)
        value = int(whole) if whole == value else None
    if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63:
        return value
    return None


@dataclass(frozen=True)
class Elements:
    """Which parts of a record are which elements.

    by_mark: an object that has this field (not null) is this element, wherever it stands. by_property: what this
    property holds is this element. ids: the field that identifies an element. Everything else is named after the
    property that holds it, the outermost value is ROOT.
    """

    by_mark: dict[str, str] = field(default_factory=dict)
    by_property: dict[str, str] = field(default_factory=dict)
    ids: dict[str, str] = field(default_factory=dict)

    def of(self, value, prop: str) -> list[str]:
        """The elements a value is: that of its property and that of its mark, the outer one first."""
        marked = next((e for m, e in self.by_mark.items() if value.get(m) is not None), None) if isinstance(value, dict) else None
        held = self.by_property.get(prop)
        return list(dict.fromkeys(e for e in (held, marked) if e)) or [prop]

    def named(self) -> set[str]:
        return {*self.by_mark.values(), *self.by_property.values()}


def _children(value: dict) -> Iterator[tuple[str, bool, object]]:
    """property, whether it is repeated, value: the objects of a value, and whatever its lists hold; nulls aside."""
    for prop, held in value.items():
        if isinstance(held, dict):
            yield prop, False, held
        elif isinstance(held, list):
            flat, stack = [], [held]
            while stack:  # lists of lists count as one
                for x in stack.pop():
                    if isinstance(x, list):
                        stack.append(x)
                    elif x is not None:
                        flat.append(x)
            yield from ((prop, True, x) for x in flat)


def edges_of(value, elements: Elements) -> Iterator[tuple[str, str, str, bool]]:
    """parent, property, child, repeated: the edges of one value in the schema graph."""
    tops = [x for x in value if x is not None] if isinstance(value, list) else [value]
    stack = [(x, ROOT, ROOT, isinstance(value, list), True) for x in tops]
    while stack:
        x, prop, parent, repeated, top = stack.pop()
        for kind in elements.of(x, prop):
            if not (top and kind == ROOT):
                yield parent, prop, kind, repeated
            parent, repeated = kind, False
        if isinstance(x, dict):
            stack.extend((y, p, parent, r, False) for p, r, y in _children(x))


@dataclass(frozen=True)
class Layout:
    """tables: the elements with a table of their own; columns: the columns of each, those of inlined elements dotted."""

    tables: frozenset[str]
    edges: frozenset[tuple[str, str, str, bool]]


def layout(edges: set[tuple[str, str, str, bool]], named: set[str]) -> Layout:
    """Which elements get a table: the root, named ones, repeated ones, those under more than one element, recursive ones."""
    under, down = defaultdict(set), defaultdict(set)
    tables = {ROOT} | named
    for parent, prop, child, repeated in edges:
        under[child].add((parent, prop))
        down[parent].add(child)
        if repeated:
            tables.add(child)
    tables |= {child for child, above in under.items() if len(above) > 1}

    def reaches_itself(e: str) -> bool:
        todo, met = list(down[e]), set()
        while todo:
            x = todo.pop()
            if x == e:
                return True
            if x not in met:
                met.add(x)
                todo.extend(down[x])
        return False

    tables |= {e for e in list(down) if reaches_itself(e)}
    return Layout(frozenset(tables), frozenset(edges))


def _text(value) -> str:
    """A scalar as text."""
    return value if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else str(value)


class _Rows:
    """The rows of all tables as columns that grow by one value after the other; what a row holds and its fields as flat lists."""

    def __init__(self, with_fields: bool):
        self.with_fields = with_fields
        self.line, self.element, self.node, self.parent, self.parent_node = [], [], [], [], []
        self.via, self.id, self.owner, self.owner_id = [], [], [], []
        self.held: list[dict[str, int] | None] = []
        self.fields: list[list[str]] = []  # name, value, name, value, ...

    def add(self, line: int, value, elements: Elements, tables: frozenset[str]) -> None:
        """Takes in the rows of one value."""
        first = len(self.line)
        start = [x for x in value if x is not None] if isinstance(value, list) else [value]
        # value, property, nearest row above, prefix of inlined fields, owner's element and id
        stack = [(x, ROOT, -1, "", None, None) for x in reversed(start)]
        while stack:
            x, prop, row, prefix, owner, owner_id = stack.pop()
            path = prefix + prop
            for kind in elements.of(x, prop):
                if row >= 0 and kind not in tables:
                    prefix = path = f"{prefix}{prop}."
                    continue
                above, row = row, len(self.line)
                self.line.append(line)
                self.element.append(kind)
                self.node.append(row - first)
                self.parent.append(self.element[above] if above >= 0 else None)
                self.parent_node.append(above - first if above >= 0 else None)
                self.via.append(path)
                self.owner.append(owner)
                self.owner_id.append(owner_id)
                self.held.append(None)
                self.fields.append([])
                if above >= 0:
                    held = self.held[above] = self.held[above] or {}
                    held[path] = held.get(path, 0) + 1
                prefix = path = ""
                id_field = elements.ids.get(kind)
                own = number(x.get(id_field)) if id_field and isinstance(x, dict) else None
                self.id.append(own)
                if id_field:
                    owner, owner_id = kind, own
            if isinstance(x, dict):
                if self.with_fields:
                    into = self.fields[row]
                    for p, v in x.items():
                        if v is not None and not isinstance(v, (dict, list)):
                            into += (prefix + p, _text(v))
                stack.extend((y, p, row, prefix, owner, owner_id) for p, _, y in reversed(list(_children(x))))
            elif self.with_fields and row >= 0:
                self.fields[row] += (prefix + "value", _text(x))

    def batch(self) -> pa.RecordBatch:
        n = len(self.line)

        def maps(pairs: list, kind: pa.DataType) -> pa.Array:
            """Maps from each row's list of name, value, name, value, ...; of a name that repeats the last value holds."""
            ends, names, values = [0], [], []
            for row in pairs:
                once = dict(zip(row[::2], row[1::2]))
                names += once
                values += once.values()
                ends.append(len(names))
            return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, kind))

        held = maps([[y for item in h.items() for y in item] if h else [] for h in self.held], pa.int32())
        fields = maps(self.fields, pa.string()) if self.with_fields else pa.nulls(n, pa.map_(pa.string(), pa.string()))
        plain = (self.line, self.element, self.node, self.parent, self.parent_node, self.via, self.id, self.owner, self.owner_id)
        return pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(plain, _ARROW)), held, fields], schema=_ARROW)


def _lines(batches, elements: Elements):
    for batch in batches:
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            value = parse(line)
            if value is not _BAD:
                yield key, value


def schema_graph(df: DataFrame, key: str, line: str, elements: Elements) -> Layout:
    """The layout for the records of df, from the schema graph of all of them.

    Edges are folded in each task and again by an aggregate; what comes to the driver is the graph, whose size is that
    of the schema and not of the data.
    """

    def run(batches):
        seen = {e for _, value in _lines(batches, elements) for e in edges_of(value, elements)}
        names = ["parent", "prop", "child", "repeated"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, e)) for e in seen], schema=pa.schema([*((n, pa.string()) for n in names[:3]), ("repeated", pa.bool_())]))

    found = df.select(key, line).mapInArrow(run, "parent string, prop string, child string, repeated boolean").distinct().collect()
    return layout({tuple(r) for r in found}, elements.named())


_SHRED = "line_no long, element string, node int, parent string, parent_node int, via string, id long, owner string, owner_id long, held map<string,int>, fields map<string,string>"
_ARROW = pa.schema(
    [("line_no", pa.int64()), ("element", pa.string()), ("node", pa.int32()), ("parent", pa.string()), ("parent_node", pa.int32()), ("via", pa.string()), ("id", pa.int64()), ("owner", pa.string()), ("owner_id", pa.int64()), ("held", pa.map_(pa.string(), pa.int32())), ("fields", pa.map_(pa.string(), pa.string()))]
)


def shred(df: DataFrame, key: str, line: str, elements: Elements, plan: Layout | None = None, with_fields: bool = True) -> DataFrame:
    """The rows of all tables of a nested text column, told apart by element; one table's rows by table_of.

    key: BIGINT, kept as line_no. node numbers the rows of a line; (line_no, node) is a primary key, (line_no,
    parent_node) the foreign key to the row above, of the table parent, and via the properties that lead from there to the
    row, dotted (empty where both rows are one value). id is the element's own id as a number, owner and owner_id are
    the element and the id of the nearest row above that has one. held counts the rows right below by via. fields holds the scalar fields, nulls aside, and those of inlined elements under dotted names; it is null
    if with_fields is false.

    A line that is not one complete JSON value (null, blank, damaged, followed by more) gives no rows; a value of any
    depth is taken whole. Nulls in lists are left out; lists of lists count as one list. Of fields that repeat in an
    object the last holds. Lines are independent, so nothing is shuffled.
    """
    plan = plan or schema_graph(df, key, line, elements)
    tables = plan.tables

    def run(batches):
        rows = _Rows(with_fields)
        for line_no, value in _lines(batches, elements):
            rows.add(line_no, value, elements, tables)
            if len(rows.line) >= _ROWS:
                yield rows.batch()
                rows = _Rows(with_fields)
        yield rows.batch()

    return df.select(F.col(key).cast("long").alias("line_no"), F.col(line).alias("line")).mapInArrow(run, _SHRED)


def table_of(rows: DataFrame, element: str, columns: list[str]) -> DataFrame:
    """One table of shred's rows: keys, id, owner_id and the named fields as columns."""
    own = rows.where(F.col("element") == element)
    return own.select("line_no", "node", "parent", "parent_node", "via", "id", "owner_id", *(F.col("fields")[c].alias(c) for c in columns))


#: Journal entries and the files they list.
JOURNAL = Elements(by_mark={"package_id": "entry"}, by_property={"files": "file"}, ids={"entry": "package_id", "file": "file_id"})


def files_of_entries(rows: DataFrame) -> DataFrame:
    """line_no, package_id, file_id: the distinct files of all entries; file_id 0 for an entry without files.

    rows are those of shred with JOURNAL. A file is an entry's if it stands in the entry's own property files, not in
    one of an object inside it. A file without a readable file_id comes out with a null one.
    """
    own_file = (rows["element"] == "file") & (rows["parent"] == "entry") & (rows["via"] == "files")
    bare = (rows["element"] == "entry") & (F.coalesce(F.element_at("held", F.lit("files")), F.lit(0)) == 0)
    picked = rows.where(own_file | bare).select("line_no", "element", "id", "owner_id")
    entry = F.col("element") == "entry"
    return picked.select(
        "line_no",
        F.when(entry, F.col("id")).otherwise(F.col("owner_id")).alias("package_id"),
        F.when(entry, F.lit(0).cast("long")).otherwise(F.col("id")).alias("file_id"),
    ).distinct()
