"""Deeply nested JSON documents as related flat tables, with Merkle identities.

Every object is canonicalised bottom-up: its scalars, and for each nested object the hash of
that object in its place.  Equal objects, wherever they occur, have the same hash and are
stored once; bridge rows keep every occurrence, with its parent, field and ordinal.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.staging import Stages

OCCURRENCES = "doc_id long, occ int, parent int, field string, name string, ordinal int, listed boolean, node string"
_OCC = pa.schema([("doc_id", pa.int64()), ("occ", pa.int32()), ("parent", pa.int32()), ("field", pa.string()), ("name", pa.string()), ("ordinal", pa.int32()), ("listed", pa.bool_()), ("node", pa.string()), ("content", pa.string())])


_canonical = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode


def _is_map(field: str, value: dict, maps: dict[str, tuple[str, ...]]) -> bool:
    """Whether an object under a field that may hold a map files objects by name: it has none of
    the fields that mark a lone object, and nothing but objects in it."""
    return field in maps and bool(value) and not any(k in value for k in maps[field]) and all(v is None or isinstance(v, (dict, list)) for v in value.values())


def _walk(root: dict, maps: dict[str, tuple[str, ...]]) -> list[tuple]:
    """Occurrences of all objects of a document: (occ, parent, field, name, ordinal, listed, hash, content).

    Depth first without recursion, so that no nesting is too deep.  Members of a map are the
    objects filed in it; the map itself is not one."""
    rows: list[list] = []

    def members(field: str, value: Any) -> list[tuple[str | None, int, bool, dict]]:
        if isinstance(value, dict):
            if _is_map(field, value, maps):
                return [(name, i, listed, o) for name, v in value.items() for _, i, listed, o in members("", v)]
            return [(None, 0, False, value)]
        if isinstance(value, list):
            return [(None, i, True, o) for i, o in enumerate(value) if isinstance(o, dict)]
        return []

    def plain(value: Any) -> bool:
        return not isinstance(value, dict) and not (isinstance(value, list) and any(isinstance(v, dict) for v in value))

    stack = [(root, -1, "", None, 0, False)]
    children: dict[int, list[int]] = {}
    objects: list[dict] = []
    while stack:
        o, parent, field, name, ordinal, listed = stack.pop()
        occ = len(rows)
        rows.append([occ, parent, field, name, ordinal, listed, None, None])
        objects.append(o)
        children.setdefault(parent, []).append(occ)
        for k in reversed(list(o)):
            stack += [(v, occ, k, n, i, lst) for n, i, lst, v in reversed(members(k, o[k]))]
    for occ in range(len(rows) - 1, -1, -1):  # children come after their parents
        o = objects[occ]
        scalars = {k: v for k, v in o.items() if plain(v)}
        below = [[rows[c][2], rows[c][3], rows[c][4], rows[c][5], rows[c][6]] for c in children.get(occ, ())]
        content = _canonical(scalars)
        whole = content + (_canonical(sorted(below, key=lambda b: (b[0], b[1] or "", b[2]))) if below else "[]")
        rows[occ][6] = hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        rows[occ][7] = content
    return [tuple(r) for r in rows]


def parse_nested(documents: DataFrame, doc_id: str, body: str, maps: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per occurrence of an object: ``OCCURRENCES`` and its ``content`` (the scalars as JSON),
    which only the first of equal objects of a field in a batch carries.

    ``maps``: fields whose object may file members by name instead of being a member, with the
    keys that mark a lone member.  ``parent`` is -1 for the document; ``ordinal`` is the place in
    the list, nulls counted, 0 otherwise; ``name`` the key under which a map files the object.
    Bodies that are null, don't parse or aren't objects give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: set[tuple[str, str]] = set()
            for lo in range(0, batch.num_rows, 256):
                cols: list[list] = [[] for _ in _OCC]
                part = batch.slice(lo, 256)
                for i, text in zip(part["doc_id"].to_pylist(), part["body"].to_pylist()):
                    try:
                        root = json.loads(text) if text else None
                    except (ValueError, RecursionError):
                        root = None
                    if not isinstance(root, dict):
                        continue
                    for row in _walk(root, maps):
                        if (row[2], row[6]) in known:
                            row = (*row[:7], None)
                        known.add((row[2], row[6]))
                        for c, v in zip(cols, (i, *row)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OCC)], schema=_OCC)

    slim = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(body).cast("string").alias("body"))
    return slim.mapInArrow(run, f"{OCCURRENCES}, content string")


class NestedTables:
    """The flat tables of a set of documents: ``nodes`` (field, node, content), each identical object
    of a field once, and ``bridge`` (``OCCURRENCES``), every place where one occurs."""

    def __init__(self, documents: DataFrame, doc_id: str, body: str, maps: dict[str, tuple[str, ...]]):
        stages = Stages(documents.sparkSession, "nested")
        parsed = stages.put(parse_nested(documents, doc_id, body, maps), "parsed")
        found = parsed.where("content IS NOT NULL").select("field", "node", "content")
        self.nodes = stages.put(found.groupBy("field", "node").agg(F.first("content").alias("content")), "nodes")
        self.bridge = parsed.select("doc_id", "occ", "parent", "field", "name", "ordinal", "listed", "node")

    def table(self, field: str, columns: dict[str, str]) -> DataFrame:
        """The occurrences of objects in ``field`` with some of their scalars: (doc_id, occ, parent,
        name, ordinal, listed, node, *columns).  ``columns``: SQL name to JSON key; values are
        JSON texts for lists and plain texts otherwise.  The scalars are read from ``nodes``, where
        each distinct object of a field is stored once, before these join their occurrences."""
        values = self.nodes.where(F.col("field") == field).select("node", *[F.get_json_object("content", f"$['{key}']").alias(c) for c, key in columns.items()])
        here = self.bridge.where(F.col("field") == field).join(values, "node")
        return here.select("doc_id", "occ", "parent", "name", "ordinal", "listed", "node", *columns)
