"""Deeply nested records to flat tables.

A record is stream-parsed, token by token, into path-value-ordinal triples.  Every JSON object that is an
element of an array is a *node*; its triples carry the node's JSON Pointer, the pointer of the nearest
enclosing node and the *group*: the pointer with array positions replaced by ``*`` (the repeated ancestor).
Triples of one group pivot into one flat table whose rows keep ``node_path`` and ``parent_path``.

Defined cases
-------------
* null record, blank record, record without any array: no rows.
* a leading byte order mark and surrounding white space are ignored.
* a text value (also the whole record) that as a whole is a valid JSON object or array counts as if unquoted;
  a text that is not valid as a whole stays a text.
* a record that ends early or is damaged is read up to there; only objects closed by then count.
* a repeated key of one object yields the triples of each occurrence; a table takes the greatest value.
* a lone surrogate escape becomes U+FFFD; numbers keep their spelling; repeated input rows collapse in tables.
* extra input columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"[ \t\n\r]*(?:([{}\[\],:])"
    r'|"([^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*)"'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![0-9A-Za-z.+-]))"
)
_BLANK = re.compile(r"[ \t\n\r]*")
_OPENING = ("{", "[")
_ROWS_PER_BATCH = 20_000

TRIPLES = "{id} {id_type}, grp string, node_path string, parent_path string, ordinal int, field string, value string, kind string"


def _text(raw: str) -> str:
    if "\\" not in raw:
        return raw
    s = json.loads(f'"{raw}"')
    return s if s.isprintable() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _key(raw: str) -> str:
    return raw.replace("~", "~0").replace("/", "~1")


class _Node:
    """An object that is an element of an array; the record itself is the node with path ''."""

    __slots__ = ("closed", "fields", "group", "ordinal", "parent", "path")

    def __init__(self, path: str, group: str, parent: str, ordinal: int | None):
        self.path, self.group, self.parent, self.ordinal = path, group, parent, ordinal
        self.fields: list[tuple] = []
        self.closed = False


class _Frame:
    """An open object or array; part is its key or position in the frame above."""

    __slots__ = ("below", "is_object", "key", "node", "part", "position", "up")

    def __init__(self, is_object: bool, up: _Frame | None, part: str | int | None, node: _Node | None):
        self.is_object, self.up, self.part, self.node = is_object, up, part, node
        self.key: str = ""
        self.position = -1
        self.below = None

    def place(self, start: tuple[str, str]) -> tuple[str, str]:
        """Pointer of this frame below its node, and the same with positions starred."""
        if self.node is not None:
            return "", ""
        if self.below is None:
            parts, f = [], self
            while f is not None and f.node is None and f.below is None:
                parts.append(f.part)
                f = f.up
            ptr, star = start if f is None else ("", "") if f.node is not None else f.below
            parts = [p for p in reversed(parts) if p is not None]
            self.below = (
                ptr + "".join(f"/{p}" for p in parts),
                star + "".join("/*" if isinstance(p, int) else f"/{p}" for p in parts),
            )
        return self.below


def parse(record: str | None, scalars: bool = True) -> list[_Node]:
    """The record's nodes in order of opening, the record itself first; only closed ones are complete."""
    top = _Node("", "", "", None)
    if record is None:
        return []
    nodes: list[_Node] = []
    top.closed = _scan(record[1:] if record[:1] == "﻿" else record, top, ("", ""), None, nodes, top.fields, scalars)
    return [top, *(n for n in nodes if n.closed)]


def _scan(text: str, owner: _Node, start: tuple[str, str], element: int | None, nodes: list, fields: list, scalars: bool) -> bool:
    """Read one value that stands at ``start`` below ``owner``; element is its position if it stands in an array.

    Appends nodes to ``nodes`` and the owner's own scalars to ``fields``; true if the text is one valid value.
    """
    match, at, end = _TOKEN.match, 0, len(text)
    top: _Frame | None = None
    expect = "value"  # value, value-or-end, key, key-or-end, colon, comma, done
    while expect != "done":
        m = match(text, at)
        if m is None:
            return False
        at = m.end()
        mark, string, plain = m.group(1, 2, 3)
        if string is not None and (expect == "key" or expect == "key-or-end"):
            top.key = _key(_text(string))
            expect = "colon"
            continue
        if mark == ":" and expect == "colon":
            expect = "value"
            continue
        if mark == "," and expect == "comma":
            expect = "key" if top.is_object else "value"
            continue
        if mark == "}" or mark == "]":
            if top is None or top.is_object != (mark == "}") or expect not in ("comma", "key-or-end", "value-or-end"):
                return False
            if top.node is not None:
                top.node.closed = True
            top = top.up
            expect = "comma" if top is not None else "done"
            continue
        if (expect != "value" and expect != "value-or-end") or mark == "," or mark == ":":
            return False
        part: str | int | None
        if top is None:
            part, position = None, element
        elif top.is_object:
            part, position = top.key, None
        else:
            top.position += 1
            part = position = top.position
        if mark is not None:
            node = None
            if mark == "{" and position is not None:
                holder, ptr, star = _holder(top, owner, start)
                if part is not None:
                    ptr, star = f"{ptr}/{part}", f"{star}/*"
                node = _Node(holder.path + ptr, holder.group + star, holder.path, position)
                nodes.append(node)
            top = _Frame(mark == "{", top, part, node)
            expect = "key-or-end" if mark == "{" else "value-or-end"
            continue
        if string is not None:
            if not scalars and "{" not in string and "[" not in string and "\\u00" not in string:
                expect = "comma" if top is not None else "done"
                continue
            value, kind = _text(string), "string"
        elif not scalars:
            expect = "comma" if top is not None else "done"
            continue
        else:
            value, kind = plain, "null" if plain == "null" else "number" if plain not in ("true", "false") else "boolean"
        holder, ptr, star = _holder(top, owner, start)
        if part is not None:
            ptr, star = f"{ptr}/{part}", f"{star}/{'*' if position is not None else part}"
        into = fields if holder is owner else holder.fields
        if string is not None and value.lstrip(" \t\n\r")[:1] in _OPENING:
            inner_nodes: list[_Node] = []
            inner_fields: list[tuple] = []
            if _scan(value, holder, (ptr, star), position, inner_nodes, inner_fields, scalars):
                nodes.extend(inner_nodes)
                into.extend(inner_fields)
                expect = "comma" if top is not None else "done"
                continue
        into.append((ptr, None if kind == "null" else value, kind))
        expect = "comma" if top is not None else "done"
    return _BLANK.match(text, at).end() == end


def _holder(top: _Frame | None, owner: _Node, start: tuple[str, str]) -> tuple[_Node, str, str]:
    """The innermost node around the next value, and the place of the open frame below it."""
    if top is None:
        return owner, *start
    ptr, star = top.place(start)
    f = top
    while f is not None and f.node is None:
        f = f.up
    return (owner if f is None else f.node), ptr, star


def _rows(key, record: str | None, scalars: bool) -> Iterator[tuple]:
    for n in parse(record, scalars):
        if n.path:
            yield key, n.group, n.path, n.parent, n.ordinal, None, None, "node"
        if scalars:
            for field, value, kind in n.fields:
                yield key, n.group, n.path, n.parent, n.ordinal, field, value, kind


def triples(df: DataFrame, id_column: str, record_column: str, scalars: bool = True) -> DataFrame:
    """Path-value-ordinal triples of each record; without scalars only the rows of the nodes themselves.

    No shuffle: a record is read where it lies.  The triples of a record are handed on in batches of bounded
    size, so one very long record doesn't need one very long Arrow batch.
    """
    source = df.select(F.col(id_column).alias("__id"), F.col(record_column).cast("string").alias("__record"))
    id_type = source.schema["__id"].dataType.simpleString()
    schema = TRIPLES.format(id=id_column, id_type=id_type)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(8)]
        kinds = None

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[id_column, "grp", "node_path", "parent_path", "ordinal", "field", "value", "kind"])

        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.string()] * 3, pa.int32(), *[pa.string()] * 3]
            for key, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in _rows(key, record, scalars):
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                    if len(columns[0]) >= _ROWS_PER_BATCH:
                        yield flush()
        if columns[0]:
            yield flush()

    return source.mapInArrow(read, schema)


def nodes(df: DataFrame, id_column: str, record_column: str) -> DataFrame:
    """(id, grp, node_path, parent_path, ordinal): one row per object that is an element of an array."""
    return triples(df, id_column, record_column, scalars=False).select(id_column, "grp", "node_path", "parent_path", "ordinal").distinct()


def groups(triples_df: DataFrame) -> DataFrame:
    """The related tables a set of records falls into: group, parent's group, rows, distinct fields."""
    return (
        triples_df.filter("node_path <> ''")
        .groupBy("grp")
        .agg(
            F.count_if(F.col("kind") == "node").alias("rows"),
            F.count_if(F.col("kind") != "node").alias("scalars"),
            F.countDistinct("field").alias("fields"),
        )
    )


def flat_table(triples_df: DataFrame, id_column: str, group: str | Column, fields: dict[str, str]) -> DataFrame:
    """Groups pivoted: (id, grp, node_path, parent_path, ordinal, one text column for each of ``fields``, rest, n_scalars).

    fields maps a pointer below the node to the column's name; the scalars at all other pointers stand in the map
    ``rest``, JSON null as null.  Fields that a node lacks, or holds as JSON null, are null.  A node has one row
    however often its record came again.
    """
    mine = F.col("grp").rlike(group) if isinstance(group, str) else group
    return _pivoted(triples_df.filter(mine & (F.col("node_path") != "")), [id_column, "grp", "node_path", "parent_path", "ordinal"], fields)


def record_table(triples_df: DataFrame, id_column: str, fields: dict[str, str]) -> DataFrame:
    """The scalars outside any node, one row per record that has one: (id, one text column for each field, rest, n_scalars)."""
    return _pivoted(triples_df.filter("node_path = ''"), [id_column], fields)


def _pivoted(rows: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    wide = [F.max(F.when(F.col("field") == ptr, F.col("value"))).alias(name) for ptr, name in fields.items()]
    other = ~F.col("field").isin(list(fields)) if fields else F.col("field").isNotNull()
    rest = F.array_sort(F.collect_set(F.when(other, F.struct("field", F.coalesce(F.col("value"), F.lit("")).alias("order"), "value"))))
    out = rows.groupBy(*keys).agg(*wide, rest.alias("__rest"), F.size(F.collect_set("field")).alias("n_scalars"))
    # of a repeated key the greatest value, which is its last
    last = F.filter("__rest", lambda x, i: ~F.coalesce(F.get("__rest", i + 1)["field"] == x["field"], F.lit(False)))
    entries = F.transform(last, lambda x: F.struct(x["field"].alias("key"), x["value"].alias("value")))
    return out.select(*keys, *fields.values(), F.map_from_entries(entries).alias("rest"), "n_scalars")


def schema(triples_df: DataFrame, most_fields: int = 200) -> DataFrame:
    """(grp, field, column, nodes): the columns of each group's own table, the most frequent ``most_fields`` pointers.

    What lies beyond stays in the map ``rest`` of that table, so objects with keys of their own, such as ids, don't
    make ever wider tables.
    """
    counts = triples_df.filter("field is not null").groupBy("grp", "field").agg(F.count("*").alias("nodes"))
    counts = counts.unionByName(triples_df.filter("kind = 'node'").select("grp").distinct().select("grp", F.lit(None).cast("string").alias("field"), F.lit(0).cast("bigint").alias("nodes")))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("nodes"), "field"))
    kept = counts.withColumn("place", place).filter(F.col("place") <= most_fields).drop("place")
    column = F.lower(F.regexp_replace(F.regexp_replace("field", r"^/", ""), r"[^0-9A-Za-z]+", "_"))
    column = F.when(column.isin("", "rest", "n_scalars", "grp", "node_path", "parent_path", "ordinal"), F.concat(F.lit("value_"), column)).otherwise(column)
    # fields whose names fall together are numbered
    nth = F.row_number().over(Window.partitionBy("grp", column).orderBy("field"))
    return kept.withColumn("__nth", nth).select("grp", "field", F.when(F.col("__nth") > 1, F.concat_ws("_", column, F.col("__nth"))).otherwise(column).alias("column"), "nodes")


def group_tables(triples_df: DataFrame, id_column: str, most_fields: int = 200) -> dict[str, DataFrame]:
    """Each group found, pivoted into a table of its own with all its scalars and its parent link.

    Only the names of groups and fields come to the driver, as the schemas of the tables need them.  The table of the
    records themselves stands under ''.  A column named like the id gets ``value_`` before it.
    """
    names: dict[str, dict[str, str]] = {}
    for r in schema(triples_df, most_fields).orderBy("grp", F.desc("nodes"), "field").collect():
        fields = names.setdefault(r["grp"], {})
        if r["field"] is not None:
            fields[r["field"]] = r["column"] if r["column"] != id_column.lower() else f"value_{r['column']}"
    return {g: record_table(triples_df, id_column, f) if g == "" else flat_table(triples_df, id_column, F.col("grp") == g, f) for g, f in names.items()}
