"""Column functions on prompts and the paths that they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that results depend on --------------------------------------------------------

MENTIONED_ENDINGS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "prisma", "sql", "md", "json", "yaml", "yml", "html", "css")
DOCS_WORDS = r"\b(docs?|documentation|readme|changelog|release notes?)\b"
TEST_WORDS = ("test", "tests", "spec", "coverage", "regression")
TEST_HINTS = ("tests", "test", "e2e", "playwright")
DOCS_FILES = ("readme.md", "changelog.md", "history.md")
DOCS_FOLDERS = ("docs", "doc", "documentation")
SYMBOL_WORD = r"\b[A-Za-z][a-zA-Z0-9]{5,}\b"
#: Build files that settle a language, then what files settle it by their number.
JAVA_BUILDS = ("pom.xml", "build.gradle", "build.gradle.kts")
TYPESCRIPT_BUILDS = ("tsconfig.json", "next.config.ts", "vite.config.ts")

# -------------------------------------------------------------------------------------------------


def mentioned_files(text: Column) -> Column:
    """Distinct files that a text names, in order: of each run of path characters the part up to its
    last known ending, without dots and slashes around."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_./-]+"), 0)
    hits = F.transform(runs, lambda r: F.btrim(F.regexp_extract(r, r"^(.+\.(?:" + "|".join(MENTIONED_ENDINGS) + "))", 1), F.lit("./")))
    return F.array_distinct(F.filter(hits, lambda p: p != ""))


def is_docs(path: Column) -> Column:
    """Documentation by name or folder."""
    low = F.lower(path)
    return low.isin(*DOCS_FILES) | F.arrays_overlap(F.slice(F.split(F.concat(low, F.lit("/")), "/"), F.lit(1), F.size(F.split(low, "/"))), F.array(*map(F.lit, DOCS_FOLDERS)))


def asks_for_docs(text: Column) -> Column:
    return text.rlike("(?i)" + DOCS_WORDS)


def asks_for_tests(text: Column) -> Column:
    """By a word anywhere in the text, as fusion asks."""
    low = F.lower(text)
    found = F.contains(low, F.lit(TEST_WORDS[0]))
    for w in TEST_WORDS[1:]:
        found = found | F.contains(low, F.lit(w))
    return found


def hinted_as_test(touches: Column) -> Column:
    """By a hint that is one of a few words."""
    return F.coalesce(F.exists(touches, lambda t: F.coalesce(F.lower(t).isin(*TEST_HINTS), F.lit(False))), F.lit(False))


def stays_inside(path: Column) -> Column:
    """Whether a patch may write a path: relative, not empty, without a ``..`` segment."""
    p = F.translate(F.trim(path), "\\", "/")
    return (p != "") & ~F.startswith(p, F.lit("/")) & ~F.array_contains(F.split(p, "/"), "..")


def first_needle(path: Column, needles: Column) -> Column:
    """The first of several words that a path contains, in any case; null if none."""
    return F.try_element_at(F.filter(needles, lambda n: (n != "") & F.contains(F.lower(path), F.lower(n))), F.lit(1))


def task_text(task: Column, prompt: Column, touches: Column) -> Column:
    """Everything that is said about a task, in one text."""
    return F.concat_ws(" ", task, prompt, F.array_join(touches, " "))


def string_list(values: Column) -> Column:
    """Sorted distinct values that aren't empty; a null list is empty."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))), F.array().cast("array<string>"))


def token_count(value: Column) -> Column:
    """A reported number of tokens: whole, 0 at least, null where it isn't a number."""
    number = F.btrim(value).try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0).cast("long"), number.cast("long")))


def cost(value: Column) -> Column:
    """A reported cost, a dollar sign before it allowed; null where it isn't a number."""
    return F.ltrim(F.btrim(value), F.lit("$")).try_cast("double")


def run_name(prefix: Column, strategy: Column, backend: Column, at: Column) -> Column:
    return F.concat_ws("-", prefix, F.coalesce(backend, F.lit("unknown")), strategy, F.date_format(at, "yyyyMMdd-HHmmss"))


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def language(java: Column, python: Column, typescript: Column, javascript: Column, names: Column) -> Column:
    """The language of a folder by its build files (``names``), then by its numbers of files."""
    has = lambda *files: F.arrays_overlap(names, F.array(*map(F.lit, files)))
    return (
        F.when(has(*JAVA_BUILDS), "java")
        .when(has(*TYPESCRIPT_BUILDS) | (typescript > 0), "typescript")
        .when((python > 0) & (has("pyproject.toml") | (python >= javascript)), "python")
        .when((javascript > 0) | has("package.json"), "javascript")
        .when(python > 0, "python")
        .when(java > 0, "java")
        .otherwise("typescript")
    )
