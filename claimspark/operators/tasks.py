"""What each evaluation task needs, checked before anything is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inputs of each task of statement labels.
NEEDS = {
    "statement2explanation": ("predictions",),
    "statement_ref2explanation_gen": ("predictions", "references", "reference_statements"),
    "statement2item_chunk": ("predictions", "references", "reference_statements", "item_metadata"),
}


def missing(task: str, given: dict[str, object]) -> list[str]:
    """Inputs that the task needs and that are not given (None or empty)."""
    if task not in NEEDS:
        raise ValueError(f"unknown task {task}; known are {', '.join(NEEDS)}")
    return [n for n in NEEDS[task] if given.get(n) is None or given.get(n) == ""]


def refusals(configurations: DataFrame) -> DataFrame:
    """task, given, accepted, lacking: which configurations (task, list of given inputs) a run would refuse, and for want of what.

    A task that is not known is refused without a list.
    """
    needs = F.create_map(*[x for t, names in NEEDS.items() for x in (F.lit(t), F.array(*map(F.lit, names)))])
    lacking = F.array_except(F.try_element_at(needs, F.col("task")), F.coalesce("given", F.array().cast("array<string>")))
    return configurations.select("task", "given", (F.coalesce(F.size(lacking), F.lit(-1)) == 0).alias("accepted"), lacking.alias("lacking"))


def require(task: str, given: dict[str, object]) -> None:
    lacking = missing(task, given)
    if lacking:
        raise ValueError(f"{task} needs {', '.join(lacking)}")
