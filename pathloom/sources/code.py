"""Source files: imports, definitions and identifiers."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values that results depend on --------------------------------------------------------

DEFINITION = r"\b(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|const|let|var|def|func)\s+([A-Za-z_][A-Za-z0-9_]*)"
JAVA_DEFINITION = r"\b(?:class|interface|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)"
IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]*\b"
QUOTED_IMPORT = r"(?:from|import|require\()\s*['\"]([^'\"]+)['\"]"
PYTHON_IMPORT = r"(?m)^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))"
JAVA_IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"
JAVA_PACKAGE = r"(?m)^\s*package\s+([\w.]+)\s*;"

# -------------------------------------------------------------------------------------------------


def definitions(text: Column, path: Column | None = None) -> Column:
    """Names that a source text defines, distinct, in order."""
    found = F.regexp_extract_all(text, F.lit(DEFINITION), 1)
    if path is not None:
        found = F.when(F.endswith(path, F.lit(".java")), F.concat(found, F.regexp_extract_all(text, F.lit(JAVA_DEFINITION), 1))).otherwise(found)
    return F.array_distinct(found)


def imports(text: Column) -> Column:
    """Module names that a source text imports, distinct; of Python, JavaScript and TypeScript."""
    python = F.transform(F.regexp_extract_all(text, F.lit(PYTHON_IMPORT), 0), lambda m: F.regexp_extract(m, r"(?:from|import)\s+([\w.]+)", 1))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(QUOTED_IMPORT), 1), python))


def identifier_counts(files: DataFrame) -> DataFrame:
    """(path, symbol, n) of ``files`` (path, text)."""
    return files.select("path", F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), 0)).alias("symbol")).groupBy("path", "symbol").agg(F.count(F.lit(1)).alias("n"))


def python_files(files: DataFrame) -> DataFrame:
    """(path, imports, symbols, exports) of Python texts by their syntax tree: functions and classes
    at any level as symbols, public ones at the top as exports.  Texts with syntax errors have none."""
    schema = pa.schema([("path", pa.string()), *((c, pa.list_(pa.string())) for c in ("imports", "symbols", "exports"))])

    def scan(text: str) -> tuple[list[str], list[str], list[str]]:
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return [], [], []
        named = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        found: set[str] = set()
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                found.update(a.name for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                found.add("." * node.level + (node.module or ""))
        symbols = {n.name for n in ast.walk(tree) if isinstance(n, named)}
        return sorted(found - {""}), sorted(symbols), sorted(n.name for n in tree.body if isinstance(n, named) and not n.name.startswith("_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], *(pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in range(3))], schema=schema)

    return files.select("path", "text").mapInArrow(run, "path string, imports array<string>, symbols array<string>, exports array<string>")


def java_fan_in(files: DataFrame) -> DataFrame:
    """(path, imported_by) of Java texts: how many files import each type, by full name, by the name
    of an enclosing type, or by a wildcard of its package."""
    f = files.select("path", F.regexp_extract("text", JAVA_PACKAGE, 1).alias("package"), F.regexp_extract("path", r"([^/]+)\.java$", 1).alias("type"), F.regexp_extract_all("text", F.lit(JAVA_IMPORT), 1).alias("imports"))
    types = f.select("path", "package", F.concat_ws(".", F.nullif("package", F.lit("")), "type").alias("name"))
    used = f.select(F.col("path").alias("by"), F.explode(F.array_distinct("imports")).alias("name"))
    wild = used.where(F.endswith("name", F.lit(".*"))).select("by", F.expr("substring(name, 1, length(name) - 2)").alias("package")).join(types, "package").select("by", "path")
    plain = used.where(~F.endswith("name", F.lit(".*")))
    exact = plain.join(types, "name").select("by", "path")
    outer = plain.join(types.select("name"), "name", "left_anti").select("by", F.regexp_replace("name", r"\.[^.]+$", "").alias("name")).join(types, "name").select("by", "path")
    n = exact.union(outer).union(wild).where(F.col("by") != F.col("path")).distinct().groupBy("path").agg(F.count(F.lit(1)).alias("imported_by"))
    return f.select("path").join(n, "path", "left").fillna(0, ["imported_by"])


_SCIP = "documents array<struct<relative_path:string,occurrences:array<struct<symbol:string,symbol_roles:int,range:array<int>>>,symbols:array<struct<symbol:string,display_name:string,kind:string>>>>"


def symbol_index(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Entities (symbol, name, path, references) and references (symbol, path, lines) of symbol index
    documents; an occurrence defines a symbol if its first role bit is set."""
    d = texts.select(F.explode(F.from_json(text, _SCIP)["documents"]).alias("d"))
    o = d.select(F.col("d.relative_path").alias("path"), F.explode("d.occurrences").alias("o")).select("path", "o.symbol", (F.coalesce("o.symbol_roles", F.lit(0)).bitwiseAND(1) == 1).alias("defines"), (F.get("o.range", 0) + 1).alias("line")).where("symbol <> ''")
    shown = d.select(F.explode("d.symbols").alias("s")).groupBy("s.symbol").agg(F.max("s.display_name").alias("shown"))
    refs = o.where("NOT defines").groupBy("symbol", "path").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    used = refs.groupBy("symbol").agg(F.array_sort(F.collect_set("path")).alias("references"))
    local = F.regexp_replace(F.regexp_extract("symbol", r"([^/#.` ]+)[().#`]*$", 1), r"[().#`]+$", "")
    e = o.where("defines").select("symbol", "path").distinct().join(shown, "symbol", "left").join(used, "symbol", "left")
    return e.select("symbol", F.coalesce("shown", local).alias("name"), "path", F.coalesce("references", F.array().cast("array<string>")).alias("references")), refs
