"""Raw agreements as nested JSON text: one for each order, a receiving course for each of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stand_ins import read

_ADVICE = '"advisements":[{{"type":"NFollowing","selectionType":"{select}","amount":{amount},"amountUnitType":"Course"}}],'
#: By (agreement + group) % 6.
_INSTRUCTIONS = [
    '"instruction":{"type":"Following","selectionType":"Complete"},',
    '"instruction":{"type":"NFromArea","selectionType":"Complete","amount":2.0},',
    '"instruction":{"type":"Conjunction","conjunction":"Or","selectionType":"Select"},',
    '"instruction":{"type":"Conjunction","conjunction":"And","selectionType":"Complete"},',
    "",
    '"instruction":{"type":"Conjunction","conjunction":"Or","selectionType":"Complete"},',
]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(agreement, pos, part, supp, qty, prefix, number, title, size): one receiving course a line number of an order."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("agreement"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.max("l_quantity").cast("int").alias("qty"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("prefix"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("number"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))
    return lines.join(part, "part")


def raw_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(agreement, name, templateAssets, articulations): assets and articulations as JSON text, assets against the order of their positions.

    A title stands before some groups, a group has one or two sections, a section rows of one cell, and most cells an articulation.
    """
    names = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("agreement"), F.col("o_orderpriority").alias("name"))
    # Dealt by agreement while the rows are narrow; texts are made behind that and never shuffled.
    base = cells(spark, sf_dir).repartition("agreement").withColumn("id", F.concat_ws("-", "agreement", "pos"))
    course = F.expr("named_struct('prefix', prefix, 'courseNumber', number, 'courseTitle', title, 'units', CASE WHEN size % 7 > 0 THEN cast(size % 5 + 1 AS double) END)")
    second = F.expr("named_struct('prefix', prefix, 'courseNumber', concat(number, 'B'), 'courseTitle', title, 'units', 2D)")
    series = F.when(F.col("pos") % 6 == 5, F.struct(F.lit("And").alias("conjunction"), F.array(course, second).alias("courses")))
    note = F.when(F.col("supp") % 4 == 0, F.array(F.struct(F.concat(F.lit("<i>Note "), F.col("supp").cast("string"), F.lit("</i>")).alias("content"))))
    cell = F.struct(F.col("id"), F.when(F.col("pos") % 6 == 5, "Series").otherwise("Course").alias("type"), F.when(F.col("pos") % 6 != 5, course).alias("course"), series.alias("series"), note.alias("attributes"))
    row = F.struct((F.col("pos") % 100).alias("position"), F.array(cell).alias("cells"))
    sender = lambda number: F.expr(f"named_struct('prefix', 'SUP', 'courseNumber', cast({number} AS string), 'courseTitle', concat('Course ', {number}))")
    first = F.struct(F.lit(0).alias("position"), F.lit("And").alias("courseConjunction"), F.when(F.col("qty") % 2 == 0, F.array(sender("supp"), sender("(supp + 1)"))).otherwise(F.array(sender("supp"))).alias("items"))
    other = F.struct(F.lit(1).alias("position"), F.lit("And").alias("courseConjunction"), F.array(F.expr("named_struct('prefix', 'ALT', 'courseNumber', cast(part AS string), 'courseTitle', title)")).alias("items"))
    items = F.when(F.col("pos") % 7 == 0, F.array().cast(f"array<{GROUP}>")).when(F.col("pos") % 3 == 0, F.array(other, first)).otherwise(F.array(first))
    sending_note = F.when(F.col("qty") % 3 == 0, F.array(F.struct(F.concat(F.lit("Sent "), F.col("qty").cast("string")).alias("content"))))
    reason = F.when(F.col("pos") % 7 == 0, "No Comparable Course")
    articulation = F.when(F.col("pos") % 5 != 0, F.struct(F.col("id").alias("templateCellId"), F.struct(items.alias("items"), reason.alias("noArticulationReason"), sending_note.alias("attributes")).alias("articulation")))
    grp, section = F.floor((F.col("pos") - 1) / 4).cast("int"), ((F.col("pos") - 1) % 2).cast("int")
    per = base.groupBy("agreement").agg(F.sort_array(F.collect_list(F.struct(grp.alias("grp"), section.alias("section"), row["position"].alias("position"), F.to_json(row).alias("row"), F.to_json(articulation).alias("art")))).alias("x"))
    listed = lambda texts: F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    agreement, name = F.col("agreement"), F.col("name")

    def part_of(own, k):
        advice = F.when((agreement + k) % 5 == 0, _ADVICE.format(select="Complete", amount="2.0")).otherwise("")
        return F.concat(F.lit("{"), advice, F.lit('"rows":'), listed(F.transform(F.filter(own, lambda x: x["section"] == k), lambda x: x["row"])), F.lit("}"))

    def group(g):
        own = F.filter("x", lambda x: x["grp"] == g)
        has_second = (agreement % 2 == 0) | F.exists(own, lambda x: x["section"] == 1)
        start = F.concat(F.lit('{"position":'), (10 * g + 5).cast("string"), F.lit(',"type":"RequirementGroup",'))
        instruction = F.element_at(F.array(*map(F.lit, _INSTRUCTIONS)), ((agreement + g) % 6 + 1).cast("int"))
        advice = F.when(agreement % 7 == 0, _ADVICE.format(select="Select", amount="1.0")).otherwise("")
        return F.concat(start, instruction, advice, F.lit('"sections":['), part_of(own, 0), F.when(has_second, F.concat(F.lit(","), part_of(own, 1))).otherwise(""), F.lit("]}"))

    said = F.concat(F.lit("<b>"), F.when(agreement % 4 == 0, "RECOMMENDED ").otherwise(""), name, F.lit("</b>&nbsp; prep"))
    title = lambda g: F.when((agreement + g) % 3 > 0, F.to_json(F.struct((10 * g).alias("position"), F.lit("RequirementTitle").alias("type"), said.alias("content"))))
    groups = F.reverse(F.array_distinct(F.transform("x", lambda x: x["grp"])))
    assets = F.flatten(F.transform(groups, lambda g: F.array_compact(F.array(group(g), title(g)))))
    return per.join(names, "agreement").select("agreement", "name", listed(assets).alias("templateAssets"), listed(F.array_compact(F.transform("x", lambda x: x["art"]))).alias("articulations"))


COURSE = "struct<prefix: string, courseNumber: string, courseTitle: string, units: double>"
CELL = f"struct<id: string, type: string, course: {COURSE}, series: struct<conjunction: string, courses: array<{COURSE}>>, attributes: array<struct<content: string>>>"
ROW = f"struct<position: int, cells: array<{CELL}>>"
GROUP = "struct<position: int, courseConjunction: string, items: array<struct<prefix: string, courseNumber: string, courseTitle: string>>>"
ADVISEMENT = "struct<type: string, selectionType: string, amount: double, amountUnitType: string>"
ASSET = f"struct<position: int, type: string, content: string, instruction: struct<type: string, conjunction: string, selectionType: string, amount: double>, advisements: array<{ADVISEMENT}>, sections: array<struct<rows: array<struct<position: int, conjunction: string, cells: array<{CELL}>>>, advisements: array<{ADVISEMENT}>>>>"
ARTICULATION = f"struct<templateCellId: string, articulation: struct<items: array<{GROUP}>, conjunction: string, noArticulationReason: string, attributes: array<struct<content: string>>>>"
