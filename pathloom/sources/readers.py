"""Reading and writing task lists, contracts, runs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HINTS = "struct<touches:array<string>,suspected_files:array<string>>"
TASKS = f"version string, tasks array<struct<id:string,prompt:string,hints:{HINTS},depends_on:array<string>>>, tokens_planner_total bigint"
SCOPE = "struct<path:string,tier:string,score:double,signals:array<string>,reason:string>"
WRITE = "struct<path:string,confidence:double,reason:string>"
LOCK_TASK = f"struct<id:string,prompt:string,predicted_writes:array<{WRITE}>,allowed_paths:array<string>,candidate_context_paths:array<string>,file_scopes:array<{SCOPE}>,depends_on:array<string>,parallel_group:int,rationale:string>"
LOCK = (
    "version string, generated_at string, repo struct<root:string,git_url:string,commit:string,languages:array<string>>, "
    f"tasks array<{LOCK_TASK}>, execution_plan struct<groups:array<struct<id:int,tasks:array<string>,type:string,waits_for:array<int>>>>, "
    "conflicts_detected array<struct<files:array<string>,between_tasks:array<string>,resolution:string>>"
)
RUN_TASK = "struct<task_id:string,status:string,predicted_write_files:array<string>,actual_changed_files:array<string>,out_of_bounds_files:array<string>,metrics:struct<tokens_prompt:bigint,wall_time_seconds:double>>"
RUN_FIELDS = ("strategy", "backend", "suite_name", "execution_mode", "evidence_kind")
RUN = f"struct<{','.join(f'{c}:string' for c in RUN_FIELDS)},tasks:array<{RUN_TASK}>>"
#: Fixed value: folders and endings of a source scan.
SKIPPED_FOLDERS = ("node_modules", "dist", "build", "target", "vendor", "__pycache__", "venv")
CODE_ENDINGS = ("py", "ts", "tsx", "js", "jsx", "java")
TIERS = ("must_write", "candidate_context", "needs_replan")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(file, task_idx, id, prompt, hints, depends_on): the tasks of task files, in order."""
    d = spark.read.schema(TASKS).option("mode", "FAILFAST").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode("tasks"))
    return d.select("file", F.col("pos").alias("task_idx"), "col.*")


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contract documents as they are, one row per file; text that isn't JSON is an error."""
    return spark.read.schema(LOCK).option("mode", "FAILFAST").json(path, multiLine=True)


def contract_faults(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fault): what is wrong with contract documents; none for valid ones.

    Unknown keys at the top or in a task, missing ones, ids with odd characters, scores outside 0
    and 1 and unknown tiers are faults."""
    known = ["version", "generated_at", "generator", "repo", "tasks", "execution_plan", "conflicts_detected"]
    of_task = ["id", "prompt", "predicted_writes", "allowed_paths", "candidate_context_paths", "file_scopes", "depends_on", "parallel_group", "rationale"]
    names = lambda keys: F.array(*map(F.lit, keys))
    top = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    raw = F.from_json(text, "tasks array<string>")["tasks"]
    doc = F.from_json(F.col(text), LOCK)
    ids = F.transform(doc["tasks"], lambda t: t["id"])
    scopes = F.flatten(F.transform(doc["tasks"], lambda t: F.coalesce(t["file_scopes"], F.array().cast(f"array<{SCOPE}>"))))
    writes = F.flatten(F.transform(doc["tasks"], lambda t: F.coalesce(t["predicted_writes"], F.array().cast(f"array<{WRITE}>"))))
    inside = lambda x: x.isNull() | ((x >= 0) & (x <= 1))
    checks: list[tuple[Column, str]] = [
        (F.try_parse_json(F.col(text)).isNull(), "not JSON"),
        (F.size(F.array_except(top, names(known))) > 0, "unknown key"),
        (F.size(F.array_except(names(["version", "repo", "tasks"]), top)) > 0, "missing key"),
        (F.exists(raw, lambda t: F.size(F.array_except(F.json_object_keys(t), names(of_task))) > 0), "unknown key of a task"),
        (F.exists(ids, lambda i: i.isNull() | ~i.rlike("^[a-z0-9_-]+$")), "task id"),
        (F.exists(writes, lambda w: ~inside(w["confidence"])), "confidence"),
        (F.exists(scopes, lambda s: ~inside(s["score"]) | ~s["tier"].isin(*TIERS)), "scope"),
    ]
    faults = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks]))
    return texts.select(key, F.explode(faults).alias("fault"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(file, strategy, run): run files, with those that hold several runs by strategy taken apart."""
    d = spark.read.schema(f"{', '.join(f'{c} string' for c in RUN_FIELDS)}, tasks array<{RUN_TASK}>, strategies map<string,{RUN}>").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    alone = d.where("strategies IS NULL").select("file", "strategy", F.struct(*RUN_FIELDS, "tasks").alias("run"))
    several = d.where("strategies IS NOT NULL").select("file", F.explode("strategies").alias("name", "run")).select("file", F.coalesce("run.strategy", "name").alias("strategy"), "run")
    return alone.unionByName(several)


def merge_runs(runs: DataFrame, key: str) -> DataFrame:
    """(key, strategies): the runs of each key in one map by strategy."""
    return runs.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "run")))).alias("strategies"))


def missing_runs(runs: DataFrame, seeds: list[int], strategies: list[str]) -> DataFrame:
    """(seed, strategy) that ``runs`` lacks."""
    s = runs.sparkSession
    want = s.createDataFrame([(a, b) for a in seeds for b in strategies], "seed int, strategy string")
    return want.join(runs.select("seed", "strategy").distinct(), ["seed", "strategy"], "left_anti")


def scan_sources(spark: SparkSession, root: str, endings: tuple[str, ...] = CODE_ENDINGS, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """(path, text) of the source files under a folder, hidden and built folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(root)
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    skip = F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, skipped))) | rel.rlike(r"(^|/)\.[^/]+/")
    return files.where(~skip).select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object per row, as many files as partitions."""
    df.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A report table as Markdown: at most ``rows`` rows, which is what a reader takes in."""
    head = "| " + " | ".join(df.columns) + " |\n| " + " | ".join("---" for _ in df.columns) + " |\n"
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return head + "".join("| " + " | ".join(cell(v) for v in r) + " |\n" for r in df.limit(rows).collect())
