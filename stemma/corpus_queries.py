"""Queries of the operators on a corpus's own material: entity layers, change logs, segmentation by the best path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .operators import lattice, layers, versions
from .queries import query, table

#: Turns as lines; a layer says where the first "the" starts and ends, by a state of the text in which it stood up to a
#: character off, and in every second turn with a variant letter.
_LINES = "with l as (select conv_id, turn, lower(text) t, instr(lower(text), 'the') i from conversations where text is not null), a as (select *, i + turn % 3 - 1 s from l where i > 0), "


def _layers(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.lower("text").alias("text"))
    at = F.instr("text", F.lit("the"))
    told = at + (F.col("turn") % 3).cast("int") - 1
    name = F.when(F.col("turn") % 2 == 0, "the").otherwise("thé")
    row = lambda position, kind: F.struct(position.alias("position"), F.lit(kind).alias("type"), F.lit("term").alias("tag"), F.concat_ws("-", "conv_id", "turn").alias("entity"), name.alias("name"))
    wanted = lines.where(at > 0).select("conv_id", "turn", F.explode(F.array(row(told, "start"), row(told + 2, "end"))).alias("x")).select("conv_id", "turn", "x.*")
    return lines, wanted, spark.createDataFrame([("e", "é,è")], "k string, vars string")


@query(
    _LINES + "c as (select conv_id, turn, s, unnest(range(greatest(1, s - 8), least(length(t), s + 8) + 1)) p, t from a), "
    "f as (select conv_id, turn, arg_min(p, abs(p - s) * 1000000 + p) p from c where starts_with('the', translate(substr(t, p, 3), 'éè', 'ee')) group by 1, 2) "
    "select l.conv_id, l.turn, case when p is null then t else substr(t, 1, p - 1) || '<a class=\"term_start\" data-key=\"' || l.conv_id || '-' || l.turn || '\"></a>' || substr(t, p, 3) "
    "|| '<a class=\"term_end\" data-key=\"' || l.conv_id || '-' || l.turn || '\"></a>' || substr(t, p + 3) end html, case when p is null then 0 else 2 end placed from l left join f using (conv_id, turn)"
)
def entity_layers(spark, sf):
    lines, wanted, variants = _layers(spark, sf)
    return layers.with_layers(lines, wanted, ["conv_id", "turn"], "text", variants)[0].select("conv_id", "turn", "html", "placed")


@query(
    _LINES + "w as (select conv_id, turn, s from a) select conv_id, turn + 100 turn, s position, 'start' as type, 'no such line' reason from w union all select conv_id, turn + 100, s + 2, 'end', 'no such line' from w "
    "union all select conv_id, turn, length(t) + 20, 'start', 'position outside the text' from l union all select conv_id, turn, 1, 'end', 'other text at the position' from l where length(t) > 0"
)
def layer_mismatches(spark, sf):
    """Rows of lines that aren't there, of positions behind the text, and of a name that no text holds."""
    lines, wanted, variants = _layers(spark, sf)
    off = wanted.withColumn("turn", F.col("turn") + 100)
    behind = lines.select("conv_id", "turn", (F.length("text") + 20).alias("position"), F.lit("start").alias("type"), F.lit("term").alias("tag"), F.lit("b").alias("entity"), F.lit("the").alias("name"))
    other = lines.where("length(text) > 0").select("conv_id", "turn", F.lit(1).alias("position"), F.lit("end").alias("type"), F.lit("term").alias("tag"), F.lit("o").alias("entity"), F.lit("\x01\x02").alias("name"))
    wrong = layers.with_layers(lines, off.unionByName(behind).unionByName(other), ["conv_id", "turn"], "text", variants)[1]
    return wrong.select("conv_id", "turn", "position", "type", "reason")


@query()
def change_logs(spark, sf):
    """Two states of the turns: every second one has an article changed and a full stop added."""
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "text", "turn")
    newer = turns.withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat(F.regexp_replace("text", "the", "a"), F.lit("."))).otherwise(F.col("text")))
    return versions.change_logs(turns.drop("turn"), newer.drop("turn"), "k", "text")


@query()
def segment_best_path(spark, sf):
    """Part names without blanks, by the shares of their words; colours are a further dictionary."""
    names = table(spark, sf, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("joined"), F.replace("p_name", F.lit(" "), F.lit("/")).alias("cut"))
    types = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("w"))
    weights = lattice.word_weights(names, "cut", {"types": types}, {"types": 0.5})
    return lattice.segment(names, F.col("joined"), weights, "p_partkey", whole=False).select("p_partkey", "segmented")
