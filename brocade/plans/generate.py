"""Generation as a resumable job: an external editor comes in as a function on rows, outputs keep their provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, validate

OUTPUT = "eval_index long, case_id string, setting string, prompt string, images array<string>, manifest_hash string, width int, height int, image binary, seconds double, error string"
PROVENANCE = ("case_id", "prompt", "images", "manifest_hash")


def generated(todo: DataFrame, edit: Callable[[dict], tuple[bytes, int, int]], clock: Callable[[], float] | None = None) -> DataFrame:
    """Outputs of prepared rows (the columns of OUTPUT up to height).

    edit: a row to (encoded image, width, height); another size than the row asks for is an error. An error is a row
    of its own with no image, so one bad case doesn't end a run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        now = clock or time.perf_counter
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                began, image, error = now(), None, None
                try:
                    image, w, h = edit(row)
                    if (w, h) != (row["width"], row["height"]):
                        image, error = None, f"size {w}x{h}"
                except Exception as wrong:  # noqa: BLE001  the editor is foreign code; its error is the row's result
                    error = f"{type(wrong).__name__}: {wrong}"[:500]
                out.append({**row, "image": image, "seconds": now() - began, "error": error})
            yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    return todo.select("eval_index", "case_id", "setting", "prompt", "images", "manifest_hash", "width", "height").mapInPandas(run, OUTPUT)


PLAN = "eval_index long, case_id string, setting string, prompt string, images array<string>, reply string, regions array<struct<box:array<double>,hint:string>>, guidance string, seconds double, error string"


def planned(todo: DataFrame, plan: Callable[[dict], dict], clock: Callable[[], float] | None = None) -> DataFrame:
    """Replies of a planner to prepared rows, with the regions and guidance read from them (the columns of PLAN).

    plan: a row to a dictionary of reply, regions (box and hint each) and guidance. Regions are kept as they come; what
    audit.well_formed passes over stays visible. An error is a row of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        now = clock or time.perf_counter
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                began, said, error = now(), {}, None
                try:
                    said = plan(row)
                except Exception as wrong:  # noqa: BLE001  the planner is foreign code; its error is the row's result
                    error = f"{type(wrong).__name__}: {wrong}"[:500]
                out.append({**row, "reply": said.get("reply"), "regions": said.get("regions"), "guidance": said.get("guidance"), "seconds": now() - began, "error": error})
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PLAN.split(", ")[:6]] + ["regions", "guidance", "seconds", "error"])

    return todo.select("eval_index", "case_id", "setting", "prompt", "images").mapInPandas(run, PLAN)


def unsound_plans(plans: DataFrame, prepared: DataFrame) -> DataFrame:
    """(eval_index, setting, rule) of planner outputs that can't be used: none or another case's, another prompt or images, an error, a blank reply or no well-formed region."""
    key = ["eval_index", "setting"]
    both = prepared.select(*key, "case_id", "prompt", "images").alias("p").join(plans.alias("o"), key, "left")
    rules = {
        "missing": F.col("o.case_id").isNotNull(), "case_id": F.col("o.case_id") == F.col("p.case_id"), "prompt": F.col("o.prompt").eqNullSafe(F.col("p.prompt")), "images": F.col("o.images").eqNullSafe(F.col("p.images")),
        "error": F.col("o.error").isNull(), "reply": ~text.is_blank(F.col("o.reply")), "regions": F.size(audit.well_formed(F.col("o.regions"))) > 0,
    }
    broken = F.when(F.col("o.case_id").isNull(), F.array(F.lit("missing"))).otherwise(validate.broken(rules))
    return both.select(*key, F.explode(broken).alias("rule"))


def valid_outputs(outputs: DataFrame, prepared: DataFrame, fields: Sequence[str] = PROVENANCE) -> DataFrame:
    """Finished (eval_index, setting) whose provenance equals what is asked for now; others are done again."""
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"o.{f}").eqNullSafe(F.col(f"p.{f}"))
    key = ["eval_index", "setting"]
    joined = outputs.filter("error is null").alias("o").join(prepared.alias("p"), key).filter(same)
    return joined.select(*key).distinct()


def remaining(prepared: DataFrame, outputs: DataFrame) -> DataFrame:
    return prepared.join(valid_outputs(outputs, prepared), ["eval_index", "setting"], "left_anti")


def mismatches(outputs: DataFrame, prepared: DataFrame, fields: Sequence[str] = PROVENANCE) -> DataFrame:
    """(eval_index, setting, field) of every provenance field that differs, and `missing` for outputs that aren't there."""
    key = ["eval_index", "setting"]
    both = prepared.alias("p").join(outputs.alias("o"), key, "left")
    wrong = [F.when(F.col("o.case_id").isNotNull() & ~F.col(f"o.{f}").eqNullSafe(F.col(f"p.{f}")), F.lit(f)) for f in fields]
    missing = F.when(F.col("o.case_id").isNull(), F.lit("missing"))
    return both.select(*key, F.explode(F.array_compact(F.array(missing, *wrong))).alias("field"))


def run_settings(indices: Sequence[int], options: dict) -> dict:
    """The fixed configuration of a run: its index range, whether that is gap-free, and its options; compared whole on resume."""
    order = list(indices)
    return {"first": order[0] if order else None, "last": order[-1] if order else None, "count": len(order), "contiguous": order == list(range(order[0], order[0] + len(order))) if order else True, **options}


def same_run(before: dict, now: dict, but: Sequence[str] = ()) -> None:
    """Raise if two configurations differ in anything but the named fields."""
    keys = {k for k in {*before, *now} if k not in but and before.get(k) != now.get(k)}
    if keys:
        raise ValueError(f"the run's configuration changed: {sorted(keys)}")
