"""Enrichment of elements by a chat model behind an Arrow boundary, and the rules that turn replies into summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import prompt_for, split_table_reply, strip
from quillon.operators.models import ChatModel, image_url

# What a model replies if an image gives nothing.
UNREADABLE, NO_TABLE = "UNREADABLE", "NO_TABLE"


def stub(text: str, images=(), system=None) -> str:
    """Deterministic offline stand-in: repeats the end of what it was asked."""
    words = " ".join(text.split()[-12:])
    return words or UNREADABLE


def needs_model(elements: DataFrame, summarize_text: bool = False) -> bool:
    """Whether any element is one that a model is asked about."""
    return summarize_text or not elements.filter("kind <> 'text'").isEmpty()


def replies(elements: DataFrame, model: ChatModel | Callable | None = None, summarize_text: bool = False) -> DataFrame:
    """elements(kind, text, image_path, ...) with reply and error; a row that fails doesn't fail its task.

    Visual elements with an image, and text if asked for, go to the model; an `image` column holds the bytes to attach.
    Other rows stay on the JVM."""
    model = model if isinstance(model, ChatModel) else ChatModel(model or stub)
    names = elements.columns
    asked = (F.col("kind") != "text") & F.col("image_path").isNotNull() | (F.col("kind") == "text") & F.lit(summarize_text)
    image = F.col("image") if "image" in names else F.lit(None).cast("binary")
    rows = elements.withColumns({"_prompt": F.when(asked, prompt_for(F.col("kind"), F.col("text"))), "_image": image})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for prompt, content, path in zip(pdf["_prompt"], pdf["_image"], pdf["image_path"], strict=True):
                try:
                    out.append((model.complete(prompt, [image_url(bytes(content), path)] if content is not None else []), None))
                except Exception as error:
                    out.append((None, str(error) or type(error).__name__))
            yield pdf.drop(columns=["_prompt", "_image"]).assign(reply=[r for r, _ in out], error=[e for _, e in out])[[*names, "reply", "error"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in elements.schema)
    none = F.lit(None).cast("string")
    rest = rows.filter("_prompt is null").select(*names, none.alias("reply"), none.alias("error"))
    return rest.unionByName(rows.filter("_prompt is not null").mapInPandas(run, f"{schema}, reply string, error string"))


def decide(rows: DataFrame, summarize_text: bool = False) -> DataFrame:
    """rows(kind, text, caption, image_path, reply, maybe error) with summary and table_markdown; rows left without a
    summary go. A failed or useless reply leaves the caption, else the text."""
    reply = strip(F.col("reply"))
    own = F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.col("text"))
    failed = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    blank = F.coalesce(reply, F.lit("")).isin("", UNREADABLE, NO_TABLE)
    two = split_table_reply(reply)
    table = F.when(two["table"].isNotNull(), F.concat_ws("\n\n", two["summary"], two["table"])).otherwise(two["summary"])
    prose = F.when(F.lit(summarize_text), F.coalesce(F.nullif(reply, F.lit("")), "text")).otherwise(F.col("text"))
    summary = F.when(failed, own).when(F.col("kind") == "text", prose).when(F.col("image_path").isNull(), F.col("text")).when(blank, own).when(F.col("kind") == "table", table).otherwise(reply)
    read = (F.col("kind") == "table") & F.col("image_path").isNotNull() & ~failed & ~blank
    out = rows.withColumns({"summary": summary, "table_markdown": F.when(read, two["table"])})
    return out.filter(strip(F.col("summary")) != "")
