"""The task dimension and the profile registry."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.outcomes import latest
from ..operators.stats import select_tasks
from ..schemas import TASKS, cast_to
from ..staging import exists
from .documents import read_text


def snapshot(spark: SparkSession, *paths: str) -> DataFrame:
    """Tasks from the first of the sources that is there; of repeated ids the last holds. A source is a JSON array or, by its suffix, a Parquet dataset."""
    for path in paths:
        if not exists(spark, path):
            continue
        if path.rstrip("/").endswith(".parquet"):
            rows = cast_to(spark.read.parquet(path), TASKS)
        else:
            rows = spark.read.schema(TASKS).option("multiLine", True).json(path)
        return latest(rows.withColumn("pos", F.monotonically_increasing_id()), "task_id").drop("pos")
    raise FileNotFoundError(f"no task snapshot at {', '.join(paths)}")


def task_sources(snapshot_path: str | None, dataset_path: str | None, prefer_snapshot: bool = True) -> list[str]:
    """The order in which snapshot() looks at the two kinds of source."""
    order = [snapshot_path, dataset_path] if prefer_snapshot else [dataset_path, snapshot_path]
    return [p for p in order if p]


def stub_attempts(spark: SparkSession, tasks: DataFrame, profile: dict[str, Any], run_id: str, wanted: list[str] | None = None) -> DataFrame:
    """A batch of attempts without a model: each task's own prompt goes in, its reference solution comes out. wanted: tasks in order, an unknown one is an error."""
    chosen = tasks if wanted is None else select_tasks(tasks, wanted).drop("pos")
    return C.fresh_stub(chosen, C.decoder_prompt("prompt"), C.full_source(), F.lit(run_id), F.lit(profile["model"]), F.lit(profile["profile_id"]))


def write_snapshot(tasks: DataFrame, path: str) -> None:
    """One JSON array, by one task: some hundred tasks are a small dimension."""
    array = F.to_json(F.array_sort(F.collect_list(F.struct(*(c.strip().split()[0] for c in TASKS.split(","))))))
    tasks.agg(array.alias("value")).write.mode("overwrite").text(path)


def get(tasks: DataFrame, task_id: str) -> Any:
    row = tasks.where(F.col("task_id") == task_id).first()
    if row is None:
        raise KeyError(task_id)
    return row


class Profiles:
    """Generation profiles of a YAML file: defaults, and one entry per id."""

    def __init__(self, document: dict[str, Any]):
        self.defaults, self.entries = document.get("defaults", {}), document.get("profiles", {})

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Profiles:
        """From a local file, or with a session from any file that Spark can read."""
        if spark is None:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        else:
            text = read_text(spark, path)
        try:
            import yaml
        except ImportError:
            return cls(_plain_yaml(text))
        return cls(yaml.safe_load(text))

    def ids(self) -> list[str]:
        return sorted(self.entries)

    def resolve(self, profile_id: str) -> dict[str, Any]:
        if profile_id not in self.entries:
            raise ValueError(f"unknown profile {profile_id!r}; allowed: {', '.join(self.ids())}")
        own = self.entries[profile_id]
        effort = own.get("effort")
        reasoning = {"enabled": False} if own.get("reasoning_disabled") else {"effort": effort} if effort else None
        sampling = {k: own.get(k, self.defaults.get(k)) for k in ("temperature", "top_p")}
        return {"profile_id": profile_id, "model": own["model"], "reasoning": reasoning, **sampling}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [self.resolve(i) for i in self.ids()]
        return spark.createDataFrame([(r["profile_id"], r["model"], r["temperature"], r["top_p"]) for r in rows], "profile_id string, model string, temperature double, top_p double")


def _plain_yaml(text: str) -> dict[str, Any]:
    """Nested mappings of scalars, by indentation: all that such a file needs."""
    root: dict[str, Any] = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        if not (body := line.split(" #")[0].rstrip()).strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        key, _, value = body.strip().rpartition(":") if body.endswith(":") else body.strip().partition(": ")
        while stack[-1][0] >= depth:
            stack.pop()
        if body.endswith(":"):
            stack.append((depth, stack[-1][1].setdefault(key, {})))
        else:
            value = value.strip().strip("\"'")
            number = value.replace(".", "", 1).lstrip("-").isdigit()
            stack[-1][1][key] = {"true": True, "false": False, "null": None}.get(value, float(value) if number and "." in value else int(value) if number else value)
    return root
