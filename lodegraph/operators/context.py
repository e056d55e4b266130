"""Context of symbols as text, in tiers that each hold the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodegraph.functions import expressions as X
from lodegraph.operators.graph import reach

SHOWN_CALLERS = 5


def brief(symbols: DataFrame) -> DataFrame:
    """``symbols`` (id, kind, name, file, line_start, risk, stale) with a line of text each."""
    stale = F.when(F.col("stale") > 0, F.format_string(" [%d stale]", F.col("stale"))).otherwise(F.lit(""))
    head = F.format_string("%s %s (%s:%d) risk %.1f", "kind", "name", "file", "line_start", "risk")
    return symbols.withColumn("brief", F.concat(head, stale))


def _first_callers(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """id, first_callers: names of the first few direct callers; the rest of a much-called symbol's are never collected."""
    turn = F.row_number().over(W.partitionBy("to_id").orderBy("from_id"))
    some = edges.select("from_id", "to_id").withColumn("turn", turn).where(F.col("turn") <= SHOWN_CALLERS)
    named = some.join(symbols.select(F.col("id").alias("from_id"), F.col("name").alias("caller")), "from_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "caller"))), lambda x: x["caller"])
    return named.groupBy(F.col("to_id").alias("id")).agg(listed.alias("first_callers"))


def standard(symbols: DataFrame, edges: DataFrame, annotations: DataFrame) -> DataFrame:
    """``brief`` with the first direct callers and the notes (id, symbol_id, confidence, status), in order of id."""
    line = F.format_string("note %d: %s, %.2f", "id", "status", "confidence")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("text")))), lambda x: x["text"])
    notes = annotations.groupBy(F.col("symbol_id").alias("id")).agg(F.array_join(texts, "\n").alias("notes"))
    out = brief(symbols).join(_first_callers(symbols, edges), "id", "left").join(notes, "id", "left")
    called = F.when(F.col("first_callers").isNotNull(), F.concat(F.lit("called by: "), F.array_join("first_callers", ", ")))
    return out.withColumn("standard", F.concat_ws("\n", "brief", called, "notes")).drop("first_callers", "notes")


def details(symbols: DataFrame) -> DataFrame:
    """``brief`` and, as ``detail``, the lines, scope, signature and documentation that a symbol has."""
    scope = F.when(F.size("scope_chain") > 1, F.concat(F.lit("in "), F.array_join(F.slice("scope_chain", F.lit(1), F.size("scope_chain") - 1), " > ")))
    lines = F.format_string("lines %d-%d", "line_start", "line_end")
    return brief(symbols).withColumn("detail", F.concat_ws("\n", lines, scope, "signature", "docstring"))


def full(symbols: DataFrame, edges: DataFrame, annotations: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """id, full of the ``seeds`` (id): ``standard`` with the numbers of callers and dependencies within ``depth``."""
    text = standard(symbols, edges, annotations).select("id", "standard").join(seeds.select("id"), "id", "left_semi")
    for label, callers in (("callers", True), ("dependencies", False)):
        n = reach(edges, seeds, depth, callers).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias(label))
        text = text.join(n, "id", "left")
    line = F.format_string("within %d calls: %d callers, %d dependencies", F.lit(depth), F.coalesce("callers", F.lit(0)), F.coalesce("dependencies", F.lit(0)))
    return text.select("id", F.concat_ws("\n", "standard", line).alias("full"))


def deep(symbols: DataFrame, sources: DataFrame, annotations: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, deep of the ``seeds``: their numbered source lines, then their notes by status."""
    spans = symbols.select("id", F.col("file").alias("f"), "line_start", "line_end").join(seeds.select("id"), "id", "left_semi")
    held = sources.join(spans, sources["file"] == spans["f"]).select(F.col("id").alias("file"), "content", "line_start", "line_end")
    source = numbered(held).groupBy(F.col("file").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "text"))), lambda x: x["text"]), "\n").alias("source"))
    line = F.format_string("%s note %d: %s", "status", "id", "content")
    kept = annotations.groupBy(F.col("symbol_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "id", line.alias("text")))), lambda x: x["text"]), "\n").alias("kept"))
    return seeds.select("id").distinct().join(source, "id", "left").join(kept, "id", "left").select("id", F.concat_ws("\n", "source", "kept").alias("deep"))


def tier(name: str, symbols: DataFrame, edges: DataFrame, annotations: DataFrame, sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, text of the ``seeds`` in a tier; each holds the one before it."""
    if name == "brief":
        return brief(symbols.join(seeds.select("id"), "id", "left_semi")).select("id", F.col("brief").alias("text"))
    if name == "standard":
        said = standard(symbols, edges, annotations).join(details(symbols).select("id", "detail"), "id").join(seeds.select("id"), "id", "left_semi")
        rest = F.expr("substring(standard, length(brief) + 2)")
        return said.select("id", F.concat_ws("\n", "brief", "detail", F.when(rest != "", rest)).alias("text"))
    if name == "full":
        below = tier("standard", symbols, edges, annotations, sources, seeds).withColumnRenamed("text", "below")
        more = full(symbols, edges, annotations, seeds).select("id", F.element_at(F.split("full", "\n"), -1).alias("more"))
        return below.join(more, "id").select("id", F.concat_ws("\n", "below", "more").alias("text"))
    below = tier("full", symbols, edges, annotations, sources, seeds).withColumnRenamed("text", "below")
    return below.join(deep(symbols, sources, annotations, seeds), "id").select("id", F.concat_ws("\n", "below", F.when(F.col("deep") != "", F.col("deep"))).alias("text"))


def upgraded(items: Column, budget: int, least: int = 100) -> Column:
    """used and taken (pos, id, text) of items (pos, id, brief, standard): brief texts that fit come first, then, in
    order and while ``least`` tokens are left, the standard text in the place of the brief one where that fits."""
    cost = lambda x: F.floor(F.octet_length(x) / 4).cast("bigint")
    shape = "struct<used:bigint,taken:array<struct<pos:bigint,id:string,text:string,standard:string>>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.expr("cast(array() as array<struct<pos:bigint,id:string,text:string,standard:string>>)").alias("taken")).cast(shape)

    def take(a, x):
        one = F.struct(x["pos"].cast("bigint").alias("pos"), x["id"].cast("string").alias("id"), x["brief"].alias("text"), x["standard"].alias("standard"))
        fits = a["used"] + cost(x["brief"]) <= budget
        return F.when(fits, F.struct((a["used"] + cost(x["brief"])).alias("used"), F.array_append(a["taken"], one).alias("taken")).cast(shape)).otherwise(a)

    first = F.aggregate(F.array_sort(items), zero, take)

    def swap(a, x):
        more = cost(x["standard"]) - cost(x["text"])
        fits = (budget - a["used"] >= least) & (a["used"] + more <= budget)
        new = F.struct(x["pos"].alias("pos"), x["id"].alias("id"), F.when(fits, x["standard"]).otherwise(x["text"]).alias("text"), x["standard"].alias("standard"))
        return F.struct((a["used"] + F.when(fits, more).otherwise(0)).alias("used"), F.array_append(a["taken"], new).alias("taken")).cast(shape)

    start = F.struct(first["used"].alias("used"), zero["taken"].alias("taken")).cast(shape)
    return F.aggregate(first["taken"], start, swap)


def numbered(sources: DataFrame) -> DataFrame:
    """file, line_number, text: the lines line_start to line_end (from 1, both included) of (file, content), numbered."""
    found = sources.select("file", "line_start", "line_end", F.posexplode(X.lines(F.col("content"))).alias("pos", "line"))
    n = (F.col("pos") + 1).cast("int")
    return found.where(n.between(F.col("line_start"), F.col("line_end"))).select("file", n.alias("line_number"), F.format_string("%4d | %s", n, "line").alias("text"))
