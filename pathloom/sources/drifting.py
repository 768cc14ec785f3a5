"""Files of JSON lines whose fields drift: what each file holds, what changed, one table of all."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.flooding import changes, spelled
from pathloom.operators.staging import Stages

KINDS = ("boolean", "number", "string", "list of strings", "list of objects")


def kind_of(value: Any) -> str | None:
    """The kind of a non-object value; null and empty lists have none.  A list of both objects and
    others is one of objects, any other list one of strings."""
    if value is None or value == []:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        known = [v for v in value if v is not None]
        if not known:
            return None
        return "list of objects" if any(isinstance(v, dict) for v in known) else "list of strings"
    return None


def flatten(record: dict) -> Iterator[tuple[str, Any]]:
    """(dotted name, value) of the non-object values, without recursion."""
    stack = [("", record)]
    while stack:
        prefix, o = stack.pop()
        for k, v in o.items():
            if isinstance(v, dict):
                stack.append((f"{prefix}{k}.", v))
            else:
                yield f"{prefix}{k}", v


def parse_line(text: str | None) -> dict | None:
    try:
        o = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


_SEEN = pa.schema([("producer", pa.string()), ("file_seq", pa.int64()), ("file_id", pa.int64()), ("field", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("values", pa.list_(pa.int64()))])
#: Hashes of values that are kept of a field and file.
SKETCH = 16


def value_hash(value: Any) -> int | None:
    """A hash of a text, or of the size of a number in half octaves; other values have none."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    if isinstance(value, str):
        return zlib.crc32(value.encode("utf-8", "surrogatepass"))
    if value == 0 or not math.isfinite(value):
        return zlib.crc32(str(value).encode())
    return zlib.crc32(f"{value > 0}:{math.floor(2 * math.log2(abs(value)))}".encode())


def file_schemas(lines: DataFrame) -> DataFrame:
    """The fields of each file: (producer, file_seq, file_id, fields array<struct<field, kind, values>>).

    The kind of a field is that of most of its values, equal numbers decided by the order of
    ``KINDS``.  Lines that don't parse don't count; a file without any other has no row.
    ``lines``: producer, file_seq, file_id, payload.  Counts are added up in each task first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            some: dict[tuple, set[int]] = {}
            for p, s, f, text in zip(*(batch[c].to_pylist() for c in ("producer", "file_seq", "file_id", "payload"))):
                o = parse_line(text)
                if o is None:
                    continue
                seen[(p, s, f, None, None)] += 1
                for name, v in flatten(o):
                    if kind := kind_of(v):
                        seen[(p, s, f, name, kind)] += 1
                        if (h := value_hash(v)) is not None:
                            some.setdefault((p, s, f, name, kind), set()).add(h)
            rows = [(*k, n, sorted(some.get(k, ()))[:SKETCH]) for k, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], c.type) for i, c in enumerate(_SEEN)], schema=_SEEN)

    slim = lines.select("producer", F.col("file_seq").cast("long").alias("file_seq"), F.col("file_id").cast("long").alias("file_id"), F.col("payload").cast("string").alias("payload"))
    counts = slim.mapInArrow(run, "producer string, file_seq long, file_id long, field string, kind string, n long, values array<long>").groupBy("producer", "file_seq", "file_id", "field", "kind").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))), 1, SKETCH).alias("values"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    main = counts.groupBy("producer", "file_seq", "file_id", "field").agg(F.max_by(F.struct("kind", "values"), F.struct("n", -rank)).alias("m"))
    named = F.when(F.col("field").isNotNull(), F.struct("field", "m.kind", "m.values"))
    return main.groupBy("producer", "file_seq", "file_id").agg(F.array_sort(F.collect_list(named)).alias("fields"))


_CHANGE = "file_id long, field_name string, change_kind string, new_name string, new_kind string"
_CHANGES = pa.schema([("file_id", pa.int64()), ("field_name", pa.string()), ("change_kind", pa.string()), ("new_name", pa.string()), ("new_kind", pa.string())])


def schema_changes(schemas: DataFrame) -> DataFrame:
    """What changed in each file against the producer's file before it: ``_CHANGE``.

    The file before is the one with the next lower (file_seq, file_id).  Files of one producer
    are put in order by their keys alone; the schemas join them afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f, old, new in zip(*(batch[c].to_pylist() for c in ("file_id", "before", "fields"))):
                kinds = {x["field"]: x["kind"] for x in new}
                found = changes(*(tuple((x["field"], x["kind"]) for x in side) for side in (old, new)), values=tuple({x["field"]: x["values"] for x in side} for side in (old, new)))
                rows += [(f, name, change, to, kinds.get(to)) for name, change, to in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], c.type) for i, c in enumerate(_CHANGES)], schema=_CHANGES)

    order = Window.partitionBy("producer").orderBy("file_seq", "file_id")
    slim = schemas.select("producer", "file_seq", "file_id").withColumn("before_id", F.lag("file_id").over(order)).where("before_id IS NOT NULL").select("file_id", "before_id")
    fields = schemas.select("file_id", "fields")
    pairs = slim.join(fields, "file_id").join(fields.select(F.col("file_id").alias("before_id"), F.col("fields").alias("before")), "before_id")
    plain = lambda c: F.transform(c, lambda x: F.struct(x["field"], x["kind"]))
    return pairs.where(plain("before") != plain("fields")).select("file_id", "before", "fields").mapInArrow(run, _CHANGE)


def linked_names(counts: dict[str, int], renames: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Pairs of names that may be one field, by group of linked names: renamed into each other
    somewhere, or of the same words.  Pairs of a group are in the order in which to join them."""
    said = spelled(sorted(counts))
    links = [(a, b) for a, b in sorted(set(renames)) if a in counts and b in counts]
    by_words: dict[frozenset, list[str]] = {}
    for n in sorted(counts):
        by_words.setdefault(frozenset(said[n]), []).append(n)
    links += [(group[0], n) for group in by_words.values() for n in group[1:]]
    parent = {n: n for n in counts}

    def find(n: str) -> str:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        parent[find(b)] = find(a)
    groups: dict[str, list[tuple[str, str]]] = {}
    for a, b in links:
        groups.setdefault(find(a), []).append((a, b))
    return list(groups.values())


def unify_names(counts: dict[str, int], groups: list[list[tuple[str, str]]], together: set[frozenset[str]]) -> dict[str, str]:
    """The common name of each field name: the most frequent one (then the first) among those
    linked.  Names that occur in one file (``together``) stay apart."""
    members = {n: {n} for n in counts}
    of = {n: n for n in counts}
    for a, b in (pair for g in groups for pair in g):
        a, b = of[a], of[b]
        if a != b and not any(frozenset((x, y)) in together for x in members[a] for y in members[b]):
            for x in members[b]:
                of[x] = a
            members[a] |= members.pop(b)
    return {n: min(members[of[n]], key=lambda x: (-counts[x], x)) for n in counts}


#: The column type of each kind.
TARGETS = {"boolean": "boolean", "number": "double", "string": "string", "list of strings": "array<string>", "list of objects": "array<string>"}
#: Texts that stand for truth values.
TRUE, FALSE = ("true", "yes", "y", "1", "1.0"), ("false", "no", "n", "0", "0.0")


def target_kind(kinds: Counter, fits: Counter) -> str:
    """The kind in which a field is kept: the first of truth value, number, list and string that it
    has somewhere and in which none of its values is lost; a string loses none.  ``kinds``: values
    of each kind; ``fits``: values that each kind can hold."""
    total = kinds.total()
    for kind in ("boolean", "number", "list of strings"):
        if any(k.split(" of ")[0] == kind.split(" of ")[0] for k in kinds) and fits[kind] == total:
            return kind
    return "string"


def cast_value(value: Any, kind: str) -> Any:
    """A value in the kind of its column; null where it can't be told (a count where names are kept)."""
    if value is None or value == []:
        return None
    if kind == "list of strings":
        if isinstance(value, str):
            return [v.strip() for v in value.split(",") if v.strip()]
        if isinstance(value, list):
            texts = [(v.get("path") or v.get("file") or json.dumps(v, sort_keys=True)) if isinstance(v, dict) else v for v in value if v is not None]
            return [v if isinstance(v, str) else json.dumps(v) for v in texts]
        return None
    if kind == "boolean":
        text = str(value).strip().lower()
        return True if text in TRUE else False if text in FALSE else None
    if kind == "number":
        if isinstance(value, bool):
            return float(value)
        m = re.match(r"\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*[A-Za-z%]*\s*$", str(value).replace(",", ""))
        return float(m.group(1)) if m else None
    return value if isinstance(value, str) else json.dumps(value)


_FITS = pa.schema([("field", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("as_boolean", pa.int64()), ("as_number", pa.int64()), ("as_list", pa.int64())])
#: Field names of all files together; a table can't have a column for each of more.
MAX_NAMES = 20_000


def _fits(lines: DataFrame) -> DataFrame:
    """(field, kind, n, as_boolean, as_number, as_list): values, and how many each kind could hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for text in batch["payload"].to_pylist():
                for name, v in flatten(parse_line(text) or {}):
                    if kind := kind_of(v):
                        c = seen.setdefault((name, kind), [0, 0, 0, 0])
                        c[0] += 1
                        for i, k in enumerate(("boolean", "number", "list of strings"), 1):
                            c[i] += cast_value(v, k) is not None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(*k, *c) for k, c in seen.items()]) if seen else [[]] * 6, _FITS)], schema=_FITS)

    counts = [f.name for f in _FITS][2:]
    found = lines.select(F.col("payload").cast("string").alias("payload")).mapInArrow(run, "field string, kind string, n long, as_boolean long, as_number long, as_list long")
    return found.groupBy("field", "kind").agg(*[F.sum(c).alias(c) for c in counts])


def common_columns(lines: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """The common name of each field name, and the kind of each common name.

    The driver holds field names (``MAX_NAMES`` at most, else an error), renames between them and
    which linked names share a file; never files."""
    stages = Stages(lines.sparkSession, "drifting")
    schemas = stages.put(file_schemas(lines), "schemas")
    names = schemas.select("file_id", F.explode("fields.field").alias("field"))
    rows = names.groupBy("field").agg(F.count(F.lit(1)).alias("n")).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} field names")
    counts = {r["field"]: r["n"] for r in rows}
    renames = [tuple(r) for r in schema_changes(schemas).where("change_kind = 'renamed'").select("field_name", "new_name").distinct().collect()]
    groups = linked_names(counts, renames)
    number = {n: i for i, g in enumerate(groups) for pair in g for n in pair}
    together: set[frozenset[str]] = set()
    if number:
        linked = lines.sparkSession.createDataFrame(sorted(number.items()), "field string, number int")
        per = names.join(F.broadcast(linked), "field").groupBy("file_id", "number").agg(F.array_sort(F.collect_set("field")).alias("names")).where("size(names) > 1")
        together = {frozenset((a, b)) for r in per.select("names").distinct().toLocalIterator() for i, a in enumerate(r["names"]) for b in r["names"][i + 1 :]}
    common = unify_names(counts, groups, together)
    kinds: dict[str, Counter] = {}
    fits: dict[str, Counter] = {}
    for r in _fits(lines).where(F.col("field").isNotNull()).collect():
        c = common.get(r["field"], r["field"])
        common.setdefault(r["field"], c)
        kinds.setdefault(c, Counter())[r["kind"]] += r["n"]
        fits.setdefault(c, Counter()).update({"boolean": r["as_boolean"], "number": r["as_number"], "list of strings": r["as_list"]})
    return common, {c: target_kind(kinds[c], fits[c]) for c in sorted(kinds)}


def one_table(lines: DataFrame, keep: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """All lines as one table: ``keep`` and a column per common field, dots as ``_``.

    Names are unified over all files.  A column has a kind that holds all of its field's values
    (lists and objects are JSON where only text does); ``kinds`` asks for another one (common
    name: kind), and values that this can't hold are null here and rows of ``failed_casts``.
    Lines that don't parse give no rows.  ``lines``: producer, file_seq, file_id, payload and ``keep``.
    """
    common, columns = common_columns(lines)
    columns.update({c: k for c, k in (kinds or {}).items() if c in columns})
    label = lambda c: c.replace(".", "_")
    taken = set(keep)
    labels: dict[str, str] = {}
    for c in columns:
        name = label(c)
        while name in taken:
            name += "_"
        taken.add(name)
        labels[c] = name
    arrow = {"boolean": pa.bool_(), "number": pa.float64(), "string": pa.string(), "list of strings": pa.list_(pa.string()), "list of objects": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_line(t) for t in batch["payload"].to_pylist()]
            good = pa.array([r is not None for r in rows])
            base = batch.filter(good)
            cols: dict[str, list] = {c: [] for c in columns}
            for r in rows:
                if r is None:
                    continue
                values: dict[str, Any] = {}
                for name, v in flatten(r):
                    c = common.get(name)
                    if c is not None and values.get(c) is None:
                        values[c] = cast_value(v, columns[c])
                for c, out in cols.items():
                    out.append(values.get(c))
            arrays = [base[k] for k in keep] + [pa.array(cols[c], arrow[columns[c]]) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *labels.values()])

    types = {f.name: f.dataType.simpleString() for f in lines.select(*keep).schema}
    ddl = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"`{labels[c]}` {TARGETS[k]}" for c, k in columns.items()])
    return lines.select(*keep, "payload").mapInArrow(run, ddl)


def failed_casts(lines: DataFrame, keep: list[str], kinds: dict[str, str]) -> DataFrame:
    """(``keep``, field_name, kind, value): values that the asked ``kinds`` (common name: kind) can't
    hold, under the names in their files, as JSON."""
    common, columns = common_columns(lines)
    columns.update({c: k for c, k in kinds.items() if c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch["payload"].to_pylist()):
                for name, v in flatten(parse_line(text) or {}):
                    kind = columns.get(common.get(name))
                    if kind_of(v) and kind and cast_value(v, kind) is None:
                        at.append(i)
                        out.append((name, kind, json.dumps(v, sort_keys=True)))
            base = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(base[k] for k in keep), *(pa.array([r[i] for r in out], pa.string()) for i in range(3))], names=[*keep, "field_name", "kind", "value"])

    types = {f.name: f.dataType.simpleString() for f in lines.select(*keep).schema}
    return lines.select(*keep, "payload").mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "field_name string", "kind string", "value string"]))
