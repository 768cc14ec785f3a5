"""The graph of source files: resolved imports, importers, type links, symbol edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import clean_path

#: Fixed value: what may be missing at the end of a module name, in the order of trial.
MODULE_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".java", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")
#: Fixed value: what a type stub may describe, X standing for its name.
STUB_SOURCES = ("lib/X.js", "lib/X.ts", "src/X.js", "src/X.ts", "X.js", "X.ts")


def module_candidates(importer: Column, specifier: Column) -> Column:
    """Paths that a specifier may mean, first ones first; none for packages with a scope.

    Relative ones start at the importer's folder, ``~/`` at the root or ``src``; others are dotted."""
    folder = F.regexp_replace(importer, r"(^|/)[^/]*$", "")
    bare = F.regexp_replace(specifier, "/+$", "")
    ends = F.array(*map(F.lit, MODULE_ENDINGS))

    def each(base: Column) -> Column:
        return F.transform(F.transform(F.array(base), clean_path), lambda b: F.transform(ends, lambda e: F.concat(b, e)))[0]

    rest = F.regexp_replace(bare, "^~/", "")
    return (
        F.when((specifier == "") | specifier.rlike("^(?:node:|@)"), F.array().cast("array<string>"))
        .when(F.startswith(specifier, F.lit(".")), each(F.concat(folder, F.lit("/"), bare)))
        .when(F.startswith(specifier, F.lit("~/")), F.concat(each(rest), each(F.concat(F.lit("src/"), rest))))
        .otherwise(each(F.translate(bare, ".", "/")))
    )


def resolve_imports(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, specifier, target): the first candidate that is a file other than the importer.

    ``specifiers``: importer, specifier; ``files``: path.  Unresolved ones have no row."""
    c = specifiers.dropna().distinct().select("importer", "specifier", F.posexplode(module_candidates(F.col("importer"), F.col("specifier"))).alias("place", "path"))
    hit = c.join(files.select("path").distinct(), "path").groupBy("importer", "specifier").agg(F.min_by("path", "place").alias("target"))
    return hit.where("target <> importer")


def importers(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(path, importers) of all files, sorted; empty where nobody imports one."""
    by = resolved.groupBy(F.col("target").alias("path")).agg(F.array_sort(F.collect_set("importer")).alias("importers"))
    return files.select("path").distinct().join(by, "path", "left").withColumn("importers", F.coalesce("importers", F.array().cast("array<string>")))


def type_links(files: DataFrame) -> DataFrame:
    """(src, dst) between ``types/X.d.ts`` and the sources that it describes, both ways."""
    p = files.select("path").distinct()
    stem = F.regexp_extract("path", r"^types/(.*)\.d\.ts$", 1)
    t = p.where(stem != "").select(F.col("path").alias("src"), stem.alias("stem"))
    near = [F.replace(F.lit(x), F.lit("X"), F.col("stem")) for x in STUB_SOURCES]
    one = t.select("src", F.explode(F.array(*near)).alias("path")).join(p, "path").select("src", F.col("path").alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def symbols_index(files: DataFrame) -> DataFrame:
    """(symbol, path): the first file, by path, that exports or defines each symbol.

    ``files``: path, exports, symbols."""
    s = files.select("path", F.explode(F.concat(F.coalesce("exports", F.array().cast("array<string>")), F.coalesce("symbols", F.array().cast("array<string>")))).alias("symbol"))
    return s.where("symbol <> ''").groupBy("symbol").agg(F.min("path").alias("path"))


def symbol_edges(references: DataFrame, defined: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, weight): how often files name what other files define, and 2 for every link.

    ``references``: path, symbol, n; ``defined``: symbol, path; ``links``: src, dst."""
    d = defined.distinct().withColumnRenamed("path", "dst")
    named = references.withColumnRenamed("path", "src").join(d, "symbol").where("src <> dst").select("src", "dst", F.col("n").cast("double").alias("weight"))
    both = named.unionByName(links.where("src <> dst").select("src", "dst", F.lit(2.0).alias("weight")))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
