"""Column functions on repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A path that cleaning may change: a backslash, blanks around, or an empty, "." or ".." segment.
UNCLEAN = r"\\|^[ \t]|[ \t]$|(?:^|/)\.{0,2}(?:/|$)"
#: The same for several paths joined by line ends.
UNCLEAN_LINES = r"\\|(?:^|\n)[ \t]|[ \t](?:\n|$)|(?:^|[/\n])\.{0,2}(?:[/\n]|$)"


def _rebuild(path: Column) -> Column:
    parts = F.split(F.translate(F.btrim(path, F.lit(" \t")), "\\", "/"), "/")
    kept = F.filter(parts, lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.nullif(F.array_join(walked, "/"), F.lit(""))


#: One of these is in every unclean path that stands between line ends; a search for them is cheap.
_HINTS = ("\\", " ", "\t", "//", "\n/", "/\n", "./", "/.\n", "..\n", "\n.\n", "\n\n")


def _suspect(lines: Column) -> Column:
    between = F.concat(F.lit("\n"), lines, F.lit("\n"))
    found = F.contains(between, F.lit(_HINTS[0]))
    for h in _HINTS[1:]:
        found = found | F.contains(between, F.lit(h))
    return found


def clean_path(path: Column) -> Column:
    """The clean form of one path: blanks and tabs around cut, ``\\`` as ``/``, empty and ``.``
    segments gone, ``..`` removing the segment before it (none: just gone); null if nothing is
    left.  Clean paths skip the rebuilding branch."""
    return F.when(_suspect(path) & path.rlike(UNCLEAN), _rebuild(path)).otherwise(path)


def clean_path_set(paths: Column) -> Column:
    """The distinct clean paths of an array of paths, without nulls; a null array stays null."""
    lines = F.array_join(paths, "\n")
    dirty = _suspect(lines) & lines.rlike(UNCLEAN_LINES)
    # array_except drops repeats and nulls without leaving generated code
    return F.array_except(F.when(dirty, F.transform(paths, clean_path)).otherwise(paths), F.array(F.lit(None).cast("string")))


# ---- fixed values that results depend on --------------------------------------------------------

TEST_FOLDERS = ("__tests__", "cypress", "e2e", "spec", "test", "tests")
TEST_ENDINGS = (".cy.js", ".cy.jsx", ".cy.ts", ".cy.tsx", ".spec.js", ".spec.jsx", ".spec.ts", ".spec.tsx", ".test.js", ".test.jsx", ".test.ts", ".test.tsx")
CONFIG_NAMES = (
    ".env.example",
    "build.gradle",
    "build.gradle.kts",
    "cypress.config.js",
    "cypress.config.ts",
    "drizzle.config.js",
    "drizzle.config.ts",
    "jest.config.js",
    "jest.config.mjs",
    "jest.config.ts",
    "next.config.js",
    "next.config.mjs",
    "next.config.ts",
    "package.json",
    "playwright.config.js",
    "playwright.config.mjs",
    "playwright.config.ts",
    "pom.xml",
    "postcss.config.cjs",
    "postcss.config.js",
    "pyproject.toml",
    "settings.gradle",
    "tailwind.config.js",
    "tailwind.config.ts",
    "tsconfig.json",
    "vite.config.js",
    "vite.config.mjs",
    "vite.config.ts",
    "vitest.config.js",
    "vitest.config.mjs",
    "vitest.config.ts",
)
SCHEMA_FILES = ("prisma/schema.prisma", "drizzle/schema.ts", "schema.prisma")
CONFIG_ENDINGS = (".config.cjs", ".config.js", ".config.mjs", ".config.ts", ".schema.json", ".prisma")
#: Broadening: least confidence, and least depth of ordinary paths and of those in test folders.
BROADEN_CONFIDENCE, BROADEN_DEPTH, BROADEN_TEST_DEPTH = 0.7, 4, 3
BROADEN_TEST_FOLDERS = ("tests/", "__tests__/", "cypress/", "e2e/", "spec/")

# -------------------------------------------------------------------------------------------------


def lexical_path(path: Column) -> Column:
    """struct<path, escapes>: ``.``, ``..`` and empty segments resolved; ``escapes`` (and a null path)
    where ``..`` climbs above the root.  Blanks are part of a path here."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("e"))

    def step(acc: Column, s: Column) -> Column:
        up, empty = s == "..", F.size(acc["p"]) == 0
        kept = F.when(up, F.slice(acc["p"], 1, F.greatest(F.size(acc["p"]) - 1, F.lit(0)))).otherwise(F.concat(acc["p"], F.array(s)))
        return F.struct(kept.alias("p"), (acc["e"] | (up & empty)).alias("e"))

    done = F.aggregate(parts, start, step)
    return F.when(path.isNotNull(), F.struct(F.when(~done["e"], F.array_join(done["p"], "/")).alias("path"), done["e"].alias("escapes")))


def write_path(path: Column, root: Column) -> Column:
    """struct<path, reason>: the path relative to the repository; null with a reason if it is outside."""
    inside = lexical_path(path)
    base = F.rtrim(lexical_path(root)["path"], F.lit("/"))
    under = F.when(inside["path"] == base, F.lit("")).when(F.startswith(inside["path"], F.concat(base, F.lit("/"))), F.substring(inside["path"], F.length(base) + 2, F.length(inside["path"])))
    absolute = F.startswith(path, F.lit("/"))
    return F.struct(
        F.when(absolute, under).otherwise(inside["path"]).alias("path"),
        F.when(inside["escapes"] & absolute, F.lit("escapes filesystem root"))
        .when(inside["escapes"], F.lit("escapes repository root"))
        .when(absolute & under.isNull(), F.lit("outside repo root"))
        .alias("reason"),
    )


def wildcard_regex(pattern: Column) -> Column:
    """A regular expression for a pattern with ``*``, ``?`` and ``[...]``; ``*`` crosses ``/``.  A
    bracket that isn't closed stands for itself."""
    quoted = F.regexp_replace(pattern, r"([.^$+{}()|\\])", r"\\$1")
    lone = F.regexp_replace(quoted, r"\[(?![^\]]+\])", r"\\[")
    stars = F.regexp_replace(F.regexp_replace(lone, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("(?s)^(?:"), F.regexp_replace(stars, r"\[!", "[^"), F.lit(")\\z"))


def glob_matches(pattern: Column, path: Column) -> Column:
    """Whether a path is covered: ``x/**`` covers x and all below; another ``**`` covers paths that
    contain its literal pieces in order, the first at the start; else wildcards cover the whole
    path.  Dots and slashes at the start of either don't count."""
    p, c = F.ltrim(pattern, F.lit("./")), F.ltrim(path, F.lit("./"))
    below = F.substring(p, F.lit(1), F.length(p) - 3)
    pieces = F.transform(F.split(p, r"\*\*"), lambda s: F.trim(s, F.lit("/")))
    first = F.element_at(pieces, 1)
    joined = F.array_join(F.transform(F.filter(pieces, lambda s: s != ""), lambda s: F.concat(F.lit(r"\Q"), s, F.lit(r"\E"))), ".*")
    ordered = F.rlike(c, F.concat(F.when(first != "", F.lit("(?s)^")).otherwise(F.lit("(?s)")), joined))
    return (
        F.when(F.endswith(p, F.lit("/**")), (c == below) | F.startswith(c, F.concat(below, F.lit("/"))))
        .when(F.contains(p, F.lit("**")), ordered)
        .when(p.rlike(r"[*?\[]"), F.rlike(c, wildcard_regex(p)))
        .otherwise(c == p)
    )


def glob_kind(pattern: Column) -> Column:
    """How a pattern is matched: subtree, ordered, wildcard or exact."""
    p = F.ltrim(pattern, F.lit("./"))
    return F.when(F.endswith(p, F.lit("/**")), "subtree").when(F.contains(p, F.lit("**")), "ordered").when(p.rlike(r"[*?\[]"), "wildcard").otherwise("exact")


def plain_glob_matches(pattern: Column, path: Column) -> Column:
    """Whether a path equals a pattern or is matched by its wildcards; ``**`` is no more than ``*``."""
    return (path == pattern) | (pattern.rlike(r"[*?\[]") & F.rlike(path, wildcard_regex(pattern)))


def broadened(path: Column, confidence: Column) -> Column:
    """The pattern that a predicted path grants: its folder if it is deep and sure enough, else itself."""
    in_tests = path.rlike("^(?:" + "|".join(BROADEN_TEST_FOLDERS) + ")")
    deep = F.size(F.split(path, "/")) >= F.when(in_tests, BROADEN_TEST_DEPTH).otherwise(BROADEN_DEPTH)
    return F.when((confidence >= BROADEN_CONFIDENCE) & deep, F.regexp_replace(path, r"/[^/]*$", "/**")).otherwise(path)


def in_test_folder(path: Column) -> Column:
    """A test by folder, by the Java layout or by the ending of its name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_FOLDERS))) | F.startswith(path, F.lit("src/test/java/")) | path.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in TEST_ENDINGS) + ")$")


def mentions_test(path: Column) -> Column:
    """A test by the looser rule that fusion uses."""
    return path.rlike(r"^(?:test|tests|__tests__|cypress|e2e)/") | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ("test", "tests", "__tests__")))) | path.rlike(r"\.(?:test|spec|test-d)\.")


def is_config(path: Column, names: tuple[str, ...] = CONFIG_NAMES) -> Column:
    """A configuration file: by name, ``.env*``, a schema file or a configuration ending."""
    name = F.element_at(F.split(path, "/"), -1)
    endings = "(?:" + "|".join(e.replace(".", r"\.") for e in CONFIG_ENDINGS) + ")$"
    return name.isin(*names) | F.startswith(name, F.lit(".env")) | path.isin(*SCHEMA_FILES) | name.rlike(endings)


def route(path: Column) -> Column:
    """struct<kind, route> of a page, layout or route file of an app folder, or of a Spring
    controller; null otherwise."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = F.substring_index(name, ".", 1)
    at = F.when(F.element_at(parts, 1) == "app", 1).when((F.element_at(parts, 1) == "src") & (F.try_element_at(parts, F.lit(2)) == "app"), 2)
    segments = F.slice(parts, at + 1, F.greatest(F.size(parts) - at - 1, F.lit(0)))
    kind = F.when((stem == "route") & (F.try_element_at(segments, F.lit(1)) == "api"), F.lit("api")).otherwise(stem)
    page = stem.isin("layout", "page", "route")
    return F.when(page & at.isNotNull(), F.struct(kind.alias("kind"), F.concat(F.lit("/"), F.array_join(segments, "/")).alias("route"))).when(
        ~page & F.endswith(name, F.lit("Controller.java")), F.struct(F.lit("spring_controller").alias("kind"), F.lit(None).cast("string").alias("route"))
    )
