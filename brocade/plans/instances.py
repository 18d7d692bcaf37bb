"""Regions of touching objects: a detector's boxes, a segmenter's masks, and what is done where either falls short.

Detector and segmenter are foreign models and come in as functions of Arrow batches; everything between and after them is
SQL over boxes and runs. Every case ends with disjoint regions whose union is the given mask, and with the way that led to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import audit, joins, order, pictures, runs
from ..operators.stack import met, stacked

#: How a case came to its regions: by the models, by a straight cut since two boxes weren't found, or by one since a region came out too small.
BY_MODELS, BY_CUT, BY_CUT_AFTER = "partition", "spatial_split_fallback", "spatial_split_fallback_after_empty_partition"
#: Pixels of a region at least; candidates of each query that are paired; overlaps from which two boxes are of one object.
LEAST, LISTED, SAME_OBJECT, ONE_QUERY = 16, 10, 0.75, 0.65
BOX = "array<double>"
DETECTION = f"mask long, query int, place int, score double, box {BOX}"
INSTANCE = f"mask long, region int, selected int, runs {pictures.RUNS}"


def asked(cases: DataFrame) -> DataFrame:
    """(mask, query, text and the other columns): one row a query of cases (mask, queries); another number of queries than two is an error."""
    two = F.when(F.size("queries") == 2, F.col("queries")).otherwise(F.raise_error(F.lit("two queries are expected")).cast("array<string>"))
    others = [c for c in cases.columns if c not in ("mask", "queries")]
    return cases.select("mask", *others, F.posexplode(two).alias("query", "text"))


def detected(cases: DataFrame, detector: Callable[[pd.DataFrame], list[list[tuple[float, list[float]]]]]) -> DataFrame:
    """Detections of cases (mask, queries and what the detector reads): it gets rows of (mask, query, text, ...) and gives a list of (score, box) for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = detector(rows)
            if len(found) != len(rows):
                raise ValueError("the detector must answer every row")
            flat = [(m, q, i, float(s), [float(v) for v in b]) for m, q, own in zip(rows["mask"], rows["query"], found, strict=True) for i, (s, b) in enumerate(own)]
            yield pd.DataFrame(flat, columns=["mask", "query", "place", "score", "box"])

    return asked(cases).mapInPandas(run, DETECTION)


def candidates(detections: DataFrame, union: DataFrame, width: int, height: int) -> DataFrame:
    """Detections (mask, query, place, score, box) that cover the union's runs or overlap its box, with their rank among those of the query."""
    key = ["mask", "query", "place"]
    boxed = detections.select(*key, *[F.element_at("box", i).alias(c) for i, c in enumerate(("bx1", "by1", "bx2", "by2"), 1)])
    covered = runs.coverage(union, boxed, width, height, "query", "place").select(*key, "coverage")
    whole = runs.boxes(union).select("mask", F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("whole"))
    rows = detections.join(met(covered), key).join(met(whole), "mask").withColumn("overlap", geometry.box_iou(F.col("box"), F.col("whole")))
    scored = audit.candidates(rows).withColumn("total", joins.candidate_score(F.col("score"), F.col("coverage"), F.col("overlap")))
    return order.top_candidates(scored.withColumn("of", F.struct("mask", "query")), "of", "total", "place", 1 << 30).drop("of")


def _best_pair(first: Column, second: Column) -> Column:
    """The pair of the best sum of scores less a share of their overlap, of equal ones the first; null where all overlap too much."""
    overlap = lambda a, b: geometry.box_iou(a["box"], b["box"])
    value = lambda a, b: a["total"] + b["total"] - 0.15 * overlap(a, b)
    pairs = F.transform(first, lambda a: F.transform(F.filter(second, lambda b: overlap(a, b) < SAME_OBJECT), lambda b: F.struct(value(a, b).alias("v"), (-a["rank"]).alias("i"), (-b["rank"]).alias("j"), a.alias("a"), b.alias("b"))))
    return F.array_max(F.flatten(pairs))


def chosen(found: DataFrame, cases: DataFrame) -> DataFrame:
    """(mask, boxes): the two boxes of each case (mask, queries), each with score and box, as far as there are any.

    Where both queries ask for the same, they are the best of the first query's list that overlap little; else the best
    pair of the ten best of each list that overlap by less than 0.75.
    """
    entry = F.struct("rank", "total", "score", "box")
    kind = "array<struct<rank:int,total:double,score:double,box:array<double>>>"
    lists = found.groupBy("mask").agg(*[F.array_sort(F.collect_list(F.when(F.col("query") == q, entry))).cast(kind).alias(n) for q, n in ((0, "first"), (1, "second"))])
    none = F.array().cast(kind)
    rows = asked(cases.select("mask", "queries")).groupBy("mask").agg((F.min(F.lower(F.trim("text"))) == F.max(F.lower(F.trim("text")))).alias("same")).join(met(lists), "mask", "left")
    first, second = F.coalesce("first", none), F.coalesce("second", none)
    apart = order.greedy_apart(first, lambda a, b: geometry.box_iou(a["box"], b["box"]), 2, ONE_QUERY)
    pair = _best_pair(F.slice(first, 1, LISTED), F.slice(second, 1, LISTED))
    both = F.when(F.col("same"), apart).otherwise(F.coalesce(F.when(pair.isNotNull(), F.array(pair["a"], pair["b"])), none))
    return rows.select("mask", "same", both.alias("boxes"))


def segmented(cases: DataFrame, boxes: DataFrame, segmenter: Callable[[pd.DataFrame], list[list[tuple[list[np.ndarray], list[float]]]]]) -> DataFrame:
    """Instances of the cases with two boxes: the segmenter gets rows (mask, boxes, and the cases' columns) and gives for each box masks and their scores; the best one counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = segmenter(rows)
            if len(found) != len(rows):
                raise ValueError("the segmenter must answer every row")
            flat = []
            for mask, own in zip(rows["mask"], found, strict=True):
                for region, (shapes, scores) in enumerate(own, 1):
                    best = int(np.argmax(scores))
                    flat.append((mask, region, best, [dict(zip(("y", "x1", "x2"), map(int, r), strict=True)) for r in pictures.bands(np.asarray(shapes[best], bool))]))
            yield pd.DataFrame(flat, columns=["mask", "region", "selected", "runs"])

    return cases.join(met(boxes.filter(F.size("boxes") == 2).select("mask", F.transform("boxes", lambda b: b["box"]).alias("boxes"))), "mask").mapInPandas(run, INSTANCE)


def divided(union: DataFrame, instances: DataFrame, boxes: DataFrame) -> DataFrame:
    """(mask, region, y, x1, x2): the union dealt to two instances (mask, region, y, x1, x2).

    What one instance alone sets is its own; the rest goes pixel by pixel to the nearer centre of the two boxes, in units of
    their sides, the first of ties. Only that rest is made into pixels. One sweep over the run ends of all three, which
    are dealt by mask and stay so.
    """
    kinds = {"union": F.lit(1), "one": (F.col("region") == 1).cast("int"), "two": (F.col("region") == 2).cast("int")}

    def ends(rows: DataFrame, *names: str) -> DataFrame:
        at = [F.struct(F.col(x).alias("x"), *[(sign * kinds[n] if n in names else F.lit(0)).alias(n) for n in kinds]) for x, sign in (("x1", 1), ("x2", -1))]
        return rows.filter("x1 < x2").select("mask", "y", F.explode(F.array(*at)).alias("e")).select("mask", "y", "e.*")

    row = Window.partitionBy(*runs.ROW).orderBy("x")  # ends at one place count together, and have no pixels between them
    steps = stacked(["mask"], ends(union, "union"), ends(instances, "one", "two"))
    spans = steps.select(*runs.ROW, F.col("x").alias("x1"), F.lead("x").over(row).alias("x2"), *[(F.sum(n).over(row) > 0).alias(n) for n in kinds]).filter("union and x1 < x2")
    own = F.when(F.col("one") & ~F.col("two"), 1).when(F.col("two") & ~F.col("one"), 2)
    piece = lambda a, b: F.struct(a.alias("x"), b.alias("x2"))
    pieces = F.when(F.col("own").isNotNull(), F.array(piece(F.col("x1"), F.col("x2")))).otherwise(F.transform(F.sequence(F.col("x1"), F.col("x2") - 1), lambda x: piece(x, x + 1)))
    rows = spans.withColumn("own", own).select(*runs.ROW, "own", F.explode(pieces).alias("p")).select(*runs.ROW, "own", "p.*")
    at = lambda i: F.element_at("b.box", i)
    sides = boxes.select("mask", F.posexplode("boxes").alias("nth", "b")).select("mask", (F.col("nth") + 1).alias("centre"), ((at(1) + at(3)) / 2).alias("cx"), ((at(2) + at(4)) / 2).alias("cy"), (at(3) - at(1)).alias("sx"), (at(4) - at(2)).alias("sy"))
    found = joins.nearest(rows, sides, "mask").select("mask", F.coalesce("own", "centre").alias("region"), "y", F.col("x").alias("x1"), "x2")
    return runs.merged(found, True, "region").select("mask", "region", "y", "x1", "x2")


def regions(union: DataFrame, boxes: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions, ways): (mask, region, y, x1, x2) of every case, and (mask, method, detections) that says how they came about.

    Cases without two boxes are cut straight; so are those where a region would have fewer than 16 pixels. Of two equal
    queries the regions are numbered by their means. A mask that can't be cut has no regions, and no way. The union and the
    boxes are read several times: hold them where they are dear to make.
    """
    both = boxes.filter(F.size("boxes") == 2)
    of = union.join(met(both.select("mask")), "mask", "left_semi")
    n, of_mask = F.col("x2") - F.col("x1"), Window.partitionBy("mask")  # a mask has no more runs than half its pixels
    total = lambda v, r: F.sum(F.when(F.col("region") == r, v)).over(of_mask)
    sums = {f"{name}{r}": total(v, r) for r in (1, 2) for name, v in (("n", n), ("mx", n * (F.col("x1") + F.col("x2") - 1) / 2), ("my", n * F.col("y")))}
    mean = lambda r: F.struct((F.col(f"mx{r}") / F.col(f"n{r}")).alias("x"), (F.col(f"my{r}") / F.col(f"n{r}")).alias("y"))
    summed = divided(of, instances, both).join(met(both.select("mask", "same")), "mask").withColumns(sums)
    good = F.coalesce((F.col("n1") >= LEAST) & (F.col("n2") >= LEAST), F.lit(False))
    region = F.when(F.col("same") & (mean(2) < mean(1)), 3 - F.col("region")).otherwise(F.col("region"))
    parts = order.held(summed.select("mask", region.alias("region"), "y", "x1", "x2", good.alias("good")))
    named = parts.filter("good").drop("good")
    fine = parts.filter("good").select("mask").distinct()
    cut = order.held(runs.split_parts(union.join(met(fine), "mask", "left_anti")))
    ids = union.select("mask").distinct().join(met(boxes.select("mask", F.size("boxes").alias("detections"))), "mask", "left").withColumn("detections", F.coalesce("detections", F.lit(0)))
    how = F.when(F.col("good"), BY_MODELS).when(F.col("detections") == 2, BY_CUT_AFTER).otherwise(BY_CUT)
    ways = ids.join(met(fine.withColumn("good", F.lit(True))), "mask", "left").join(met(cut.select("mask", F.lit(True).alias("cut")).distinct()), "mask", "left").filter("good or cut")
    return stacked(["mask"], named, cut), ways.select("mask", how.alias("method"), "detections")
