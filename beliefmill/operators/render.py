"""Prompt sections and drawings of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Box size, gaps between boxes and layers, and padding, in pixels.
BOX_W, BOX_H, GAP_X, GAP_Y, PAD = 160, 48, 60, 90, 40


def cpd_sections(cpd: DataFrame) -> DataFrame:
    """(bn_id, child, parent, section): a header and a line for each cell, child states first; null cells are skipped."""
    line = T.cpd_line(F.col("child"), F.col("state"), F.col("parent"), F.col("parent_state"), F.col("p"))
    rows = cpd.withColumn("line", F.when(F.col("p").isNotNull(), line)).groupBy("bn_id", "child", "parent").agg(F.array_sort(F.collect_list(F.struct("state_pos", "ps_pos", "line"))).alias("l"))
    lines = F.filter(F.transform("l", lambda x: x["line"]), lambda x: x.isNotNull())
    body = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("  (no CPD data available)")
    return rows.select("bn_id", "child", "parent", F.concat(F.lit("["), "child", F.lit(" | "), "parent", F.lit("]\n"), body).alias("section"))


def layout(level: DataFrame) -> DataFrame:
    """(bn_id, node_pos, node, level, x, y, width, height): box centres, layers centred, and the drawing's size."""
    layer = Window.partitionBy("bn_id", "level")
    whole = Window.partitionBy("bn_id")
    rows = level.withColumns({"i": F.row_number().over(layer.orderBy("node_pos")) - 1, "n": F.count(F.lit(1)).over(layer)})
    span = F.col("n") * BOX_W + (F.col("n") - 1) * GAP_X
    rows = rows.withColumns({"span": span, "width": F.max(span).over(whole) + 2 * PAD, "height": (F.max("level").over(whole) + 1) * (BOX_H + GAP_Y) + 2 * PAD})
    x = F.floor((F.col("width") - F.col("span")) / 2) + F.col("i") * (BOX_W + GAP_X) + BOX_W // 2
    return rows.select("bn_id", "node_pos", "node", "level", x.cast("long").alias("x"), (F.lit(50) + F.col("level") * (BOX_H + GAP_Y) + BOX_H // 2).cast("long").alias("y"),
                       F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


def drawings(level: DataFrame, edges: DataFrame, titles: DataFrame) -> DataFrame:
    """(bn_id, svg): edges from box to box, then boxes with wrapped labels; roots stand out; titles (bn_id, title, id)."""
    at = layout(level)
    roots = edges.groupBy("bn_id", F.col("child").alias("node")).agg(F.lit(False).alias("root"))
    boxes = at.join(roots, ["bn_id", "node"], "left").withColumn("colour", F.when(F.col("root").isNull(), "orange").otherwise("lightgrey"))
    words = F.array_join(F.transform(T.wrapped(F.col("node")), lambda w, i: F.concat(F.lit("<tspan x=\""), F.col("x"), F.lit("\" dy=\"1.1em\">"), T.xml_escaped(w), F.lit("</tspan>"))), "")
    box = F.format_string(f'<rect x="%d" y="%d" width="{BOX_W}" height="{BOX_H}" fill="%s"/><text x="%d" y="%d" text-anchor="middle">%s</text>', F.col("x") - BOX_W // 2, F.col("y") - BOX_H // 2, "colour", "x", F.col("y") - 14, words)
    boxes = boxes.groupBy("bn_id", "width", "height").agg(F.array_sort(F.collect_list(F.struct("node_pos", box.alias("s")))).alias("b"))
    a = at.select("bn_id", F.col("node").alias("parent"), F.col("x").alias("x1"), (F.col("y") + BOX_H // 2).alias("y1"))
    b = at.select("bn_id", F.col("node").alias("child"), F.col("x").alias("x2"), (F.col("y") - BOX_H // 2).alias("y2"))
    lines = edges.join(a, ["bn_id", "parent"]).join(b, ["bn_id", "child"])
    lines = lines.groupBy("bn_id").agg(F.array_sort(F.collect_list(F.struct("edge_pos", F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d" stroke="black"/>', "x1", "y1", "x2", "y2").alias("s")))).alias("l"))
    title = F.substring(F.coalesce("title", "id", F.lit("BN")), 1, 60)
    met = titles.join(boxes, "bn_id", "left").join(lines, "bn_id", "left")
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d"><text x="10" y="25">%s</text>', F.coalesce("width", F.lit(200)), F.coalesce("height", F.lit(80)), T.xml_escaped(title))
    parts = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["s"]), ""), F.lit(""))
    return met.select("bn_id", F.concat(head, parts("l"), parts("b"), F.lit("</svg>")).alias("svg"))
