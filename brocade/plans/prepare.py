"""Cases to prepared inputs: one row per case and setting, with prompt and ordered images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import METHODS, ROLES, SETTINGS
from ..functions import text
from ..operators import validate


def settings_of(values: str | None, allowed: tuple[str, ...] = SETTINGS) -> list[str]:
    """A comma list of settings: trimmed, repeats dropped, `all` or nothing for all; an unknown one is an error."""
    names = list(dict.fromkeys(x.strip() for x in (values or "").split(",") if x.strip()))
    if not names or names == ["all"]:
        return list(allowed)
    if unknown := [x for x in names if x not in allowed]:
        raise ValueError(f"unknown settings: {unknown}")
    return names


def settings_for(method: str, values: str | None = None, methods: tuple[str, ...] = METHODS) -> list[dict]:
    """The settings of a method, each with its input and the instruction it goes with; an unknown method is an error."""
    if method not in methods:
        raise ValueError(f"unknown method: {method}")
    return [{"method": method, "setting": s, "input": "source" if s == "text_only" else s, "prompt": "with_location_reference" if s == "text_only" else "region_only"} for s in settings_of(values)]


def prepared(cases: DataFrame, settings: tuple[str, ...] = SETTINGS) -> DataFrame:
    """Cases (eval_index, region_count, instruction, region_instruction) by setting, with prompt, roles and images."""
    item = lambda s: F.struct(
        F.lit(s).alias("setting"),
        (F.col("instruction") if s == "text_only" else text.locator_prompt(F.coalesce("region_instruction", "instruction"), F.col("region_count"), s.removesuffix("_annotation"))).alias("prompt"),
        F.array(*[F.lit(r) for r in ROLES[s]]).alias("roles"),
        F.array(*[F.concat(F.lit(f"{r}/"), F.format_string("%04d.png", "eval_index")) for r in ROLES[s]]).alias("images"),
    )
    return cases.select("*", F.explode(F.array(*[item(s) for s in settings])).alias("item")).select(*cases.columns, "item.*")


def nested(rows: DataFrame, key: str = "eval_index") -> DataFrame:
    """Back to one row per case, a map from setting to its item."""
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("setting", F.struct("prompt", "roles", "images"))))).alias("settings"))


def contract(rows: DataFrame, protocol: str, settings: tuple[str, ...] = SETTINGS) -> DataFrame:
    """(eval_index, rule) of what a prepared table (one row per case and setting, with protocol) breaks.

    A case has every setting once, indices have no gap, prompts aren't blank, roles are the setting's and there are as
    many images, and all rows are of one protocol.
    """
    roles = F.create_map(*[x for s in settings for x in (F.lit(s), F.array(*[F.lit(r) for r in ROLES[s]]))])
    rules = {
        "protocol": F.col("protocol") == protocol, "setting": F.col("setting").isin(*settings), "prompt": ~text.is_blank(F.col("prompt")),
        "roles": F.element_at(roles, F.col("setting")) == F.col("roles"), "images": F.size("images") == F.size("roles"),
    }
    each = rows.select("eval_index", F.explode(validate.broken(rules)).alias("rule")).distinct()
    per_case = rows.groupBy("eval_index").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("setting")).alias("d"))
    incomplete = per_case.filter((F.col("n") != len(settings)) | (F.col("d") != len(settings))).select("eval_index", F.lit("settings").alias("rule"))
    # a gap is an index without the one before it, other than 0
    before = per_case.select((F.col("eval_index") + 1).alias("eval_index"))
    gaps = per_case.select("eval_index").filter("eval_index <> 0").join(before, "eval_index", "left_anti").select("eval_index", F.lit("gap").alias("rule"))
    return each.unionByName(incomplete).unionByName(gaps)


def assets(rows: DataFrame) -> DataFrame:
    """Each distinct image of a prepared table once, for one check of each file."""
    return rows.select(F.explode("images").alias("path")).distinct()


def leaks_target(rows: DataFrame, forbidden: tuple[str, ...] = ("target", "evaluation")) -> DataFrame:
    """Rows that would show a model what it is judged by."""
    return rows.filter(F.exists("roles", lambda r: r.isin(*forbidden)))
