"""Prompts for answers: numbered blocks of sources within a budget of characters, and the images sent along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import strip

# Characters of bodies, images sent along.
BUDGET, IMAGES = 6000, 2
ATTACHED = "(Its image is attached.)"
SYSTEM = "Answer from the numbered sources only and cite them as [S1], [S2]. Give numbers as they stand there. Say so if the sources don't hold the answer."


def block(n: Column, kind: Column, page: Column, body: Column) -> Column:
    where = F.coalesce(F.concat(F.lit(", page "), page.cast("string")), F.lit(""))
    return strip(F.concat(F.lit("[S"), n.cast("string"), F.lit("] ("), kind, where, F.lit(")\n"), body))


def cut(body: Column, left: Column) -> Column:
    """A body longer than what is left of the budget, cut there and marked."""
    short = F.concat(F.regexp_replace(F.substr(body, F.lit(1), left), r"(?U)\s+$", ""), F.lit(" ..."))
    return F.when(F.length(body) > left, short).otherwise(body)


def contexts(sources: DataFrame, budget: int = BUDGET, images: int = IMAGES) -> DataFrame:
    """sources(qid, rank, kind, page_number, caption, text, maybe image_path) -> qid, n_blocks, context, images, labels.

    A fold over a question's sources: a cut body is charged as cut, the note on its image isn't charged; it ends when the
    budget is used up."""
    path = F.col("image_path") if "image_path" in sources.columns else F.lit(None).cast("string")
    s = F.struct("rank", "kind", "page_number", "caption", F.coalesce(strip(F.col("text")), F.lit("")).alias("text"), path.alias("image"))
    rows = sources.groupBy("qid").agg(F.array_sort(F.collect_list(s)).alias("sources"))
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(F.lit(budget).alias("left"), F.lit("").alias("out"), F.lit(0).alias("n"), none.alias("images"), none.alias("labels"))

    def step(acc, x):
        named = (F.coalesce(x["caption"], F.lit("")) != "") & ~F.contains(x["text"], x["caption"])
        whole = F.when(named, strip(F.concat(x["caption"], F.lit("\n"), x["text"]))).otherwise(x["text"])
        body = cut(whole, acc["left"])
        sent = x["image"].isNotNull() & (x["kind"] != "text") & (F.size(acc["images"]) < images)
        n = acc["n"] + 1
        text = block(n, x["kind"], x["page_number"], F.when(sent, strip(F.concat(body, F.lit(f"\n{ATTACHED}")))).otherwise(body))
        joined = F.when(acc["n"] > 0, F.concat(acc["out"], F.lit("\n\n"), text)).otherwise(text)
        added = lambda name, value: F.when(sent, F.concat(acc[name], F.array(value))).otherwise(acc[name]).alias(name)
        more = F.struct((acc["left"] - F.length(body)).alias("left"), joined.alias("out"), n.alias("n"), added("images", x["image"]), added("labels", F.concat(F.lit("S"), n.cast("string"))))
        return F.when(acc["left"] > 0, more).otherwise(acc)

    rows = rows.withColumn("f", F.aggregate("sources", start, step))
    return rows.select("qid", F.col("f.n").cast("long").alias("n_blocks"), F.col("f.out").alias("context"), F.col("f.images").alias("images"), F.col("f.labels").alias("labels"))


def prompts(found: DataFrame, questions: DataFrame) -> DataFrame:
    """contexts(qid, context, labels, images) and questions(qid, question) -> qid, prompt, images."""
    note = F.when(F.size("labels") > 0, F.concat(F.lit("\n\nImages attached, in this order: "), F.array_join("labels", ", "), F.lit("."))).otherwise("")
    text = F.concat(F.lit("SOURCES\n"), F.col("context"), note, F.lit("\n\nQUESTION\n"), strip(F.col("question")))
    return found.join(questions.select("qid", "question"), "qid").select("qid", text.alias("prompt"), "images")
