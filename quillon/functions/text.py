"""Column functions over text: tokens, references, captions, tables, error messages, stand-in embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NullType, NumericType, StringType, StructType

# Words that carry no signal, and the patterns of tokens, references and captions.
STOPWORDS = "a an and are as at be by does do for from has have how in into is it its of on or that the their there these this to was were what when where which who why will with show shows showing tell me about give please compare between".split()
TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
REFERENCE = r"\b(fig(?:ure)?|table|chart|exhibit)s?\.?\s*([A-Za-z]?\.?\d+(?:\.\d+)*)"
CAPTION = r"^\s*(fig(?:ure)?|table|chart|exhibit|plate)\s*\.?\s*([A-Z]?\.?\d+(?:\.\d+)*)\s*[.:\)-]?\s"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case tokens in order, without stopwords and single characters."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))


def references(c: Column) -> Column:
    """Distinct named figures and tables: fig:13, table:a.5."""
    label, number = (F.regexp_extract_all(c, F.lit("(?iuU)" + REFERENCE), F.lit(g)) for g in (1, 2))
    name = lambda x: F.when(F.lower(x).startswith("fig"), F.lit("fig")).otherwise(F.lower(x))
    return F.array_distinct(F.zip_with(label, number, lambda a, b: F.concat(name(a), F.lit(":"), F.lower(F.ltrim(b, F.lit("."))))))


def caption_kind(c: Column) -> Column:
    label = F.lower(F.regexp_extract(c, "(?iuU)" + CAPTION, 1))
    return F.when(label.isin("table", "exhibit"), "table").when(label != "", "figure")


def retrieval_text(page: Column, caption: Column, summary: Column, text: Column) -> Column:
    """[page N], caption and body on lines of their own; the body is the summary, else the text."""
    given = lambda c: F.nullif(strip(c), F.lit(""))
    return F.concat_ws("\n", F.when(page.isNotNull(), F.concat(F.lit("[page "), page.cast("string"), F.lit("]"))), given(caption), F.coalesce(given(summary), given(text)))


def once(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_table_reply(c: Column) -> Column:
    """struct(table, summary) of a reply that begins with TABLE: and has SUMMARY: later; without them all of it is summary."""
    both = r"(?s)^TABLE:(.*?)SUMMARY:(.*)$"

    def parts(reply: Column) -> Column:
        found = reply.rlike(both)
        table = F.when(found, F.nullif(strip(F.regexp_extract(reply, both, 1)), F.lit("")))
        return F.struct(table.alias("table"), F.when(found, strip(F.regexp_extract(reply, both, 2))).otherwise(reply).alias("summary"))

    return once(strip(c), parts)


#: What ends a line, beside the usual marks.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def table_markdown(kind: Column, c: Column) -> Column:
    """Of a table's text, from its first bar on, the lines that begin with a bar; null if there are fewer than two."""
    rows = F.filter(F.split(strip(F.substr(c, F.instr(c, "|"))), LINE_END), lambda x: strip(x).startswith("|"))
    return F.when((kind == "table") & F.contains(c, F.lit("|")), once(rows, lambda r: F.when(F.size(r) >= 2, F.array_join(r, "\n"))))


def retry_after(message: Column, header: Column) -> Column:
    """Seconds to wait: the header if it is a number, else what the message states in ms or s; null if neither."""
    amount, unit = (F.regexp_extract(message, r"(?i)try again in\s+([0-9.]+)\s*(ms|s)\b", g) for g in (1, 2))
    stated = amount.try_cast("double")
    return F.coalesce(header.try_cast("double"), F.when(F.lower(unit) == "ms", stated / 1000).otherwise(stated))


# How a model's refusals are worded.
TOO_MANY_IMAGES = r"too many images|supports up to \d+ images?"
TOO_LARGE = r"request too large|reduce your message size|context length|too many tokens"
TRANSIENT = r"rate limit|timed? ?out|connection (?:error|reset|refused|aborted)|temporarily unavailable"


def error_class(message: Column, status: Column | None = None) -> Column:
    """image_limit, too_large, transient (by the status, where one is known, else by the wording) or fatal."""
    status = F.lit(None).cast("int") if status is None else status
    again = F.when(status.isNotNull(), (status == 429) | (status >= 500)).otherwise(message.rlike(f"(?i){TRANSIENT}"))
    said = F.when(message.rlike(f"(?i){TOO_MANY_IMAGES}"), "image_limit").when(message.rlike(f"(?i){TOO_LARGE}"), "too_large")
    return F.coalesce(said, F.when(again, "transient").otherwise("fatal"))


def hash_embedding(c: Column, dim: int = 32) -> Column:
    """Deterministic unit vector from the SHA-256 of a text: the stand-in where no model is given. Hashed and measured once."""

    def raw(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)

    def unit(x: Column) -> Column:
        return once(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)), lambda n: F.transform(x, lambda v: v / n))

    return once(F.sha2(c, 256), lambda digest: once(raw(digest), unit))


def fingerprint(provider: Column, model: Column) -> Column:
    """Names an embedding space: vectors of two of them are never compared."""
    return F.concat_ws(":", provider, model)


#: Metadata values are cut to this many characters.
LONGEST_VALUE = 1000


def clean_value(c: Column, kind: DataType) -> Column:
    """One metadata value as a scalar: numbers and booleans as they are, blank text as null, lists and records as JSON."""
    if isinstance(kind, (NumericType, BooleanType, NullType)):
        return c
    if isinstance(kind, (ArrayType, MapType, StructType)):
        c = F.to_json(c)
    return F.nullif(F.substr(strip(c) if isinstance(kind, StringType) else c.cast("string"), F.lit(1), F.lit(LONGEST_VALUE)), F.lit(""))


def clean_record(record: str, kind: StructType) -> Column:
    """A record column with each field made a scalar, as JSON without the fields that are null."""
    return F.to_json(F.struct(*(clean_value(F.col(record)[f.name], f.dataType).alias(f.name) for f in kind.fields)))


def clean_metadata(m: Column) -> Column:
    """String map without empty keys, nulls and blanks; values stripped and cut to 1000 characters."""
    cut = F.transform_values(m, lambda k, v: clean_value(v, StringType()))
    return F.map_filter(cut, lambda k, v: (k != "") & v.isNotNull())


BOX = "x0 double, y0 double, x1 double, y1 double"


def decode_box(c: Column) -> Column:
    """A box from its JSON; null if the JSON is broken or a side is missing."""
    box = F.from_json(c, BOX)
    return F.when(F.forall(F.array(*(box[k] for k in ("x0", "y0", "x1", "y1"))), lambda v: v.isNotNull()), box)


def decode_extra(c: Column) -> Column:
    """A string map from its JSON; empty if the JSON is broken or no object."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))


def as_int(c: Column) -> Column:
    return c.try_cast("int")


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * done / total)).otherwise(0).cast("int")


def message_text(blocks: Column) -> Column:
    """A model's reply given as array(struct(type, text)): its non-empty texts, one below the other."""
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"])
    return strip(F.array_join(texts, "\n"))


# Media types by suffix.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml"}


def media_type(path: Column) -> Column:
    """By the suffix; PNG if it is none of those known."""
    known = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("image/png"))


def data_url(content: Column, path: Column) -> Column:
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.base64(content))


def fitted_size(width: Column, height: Column, most: int) -> Column:
    """struct(width, height) of an image scaled down until its longest edge is at most `most`."""
    longest = F.greatest(width, height)
    side = lambda x: F.when(longest > most, F.greatest(F.lit(1), F.floor(x * F.lit(float(most)) / longest))).otherwise(x).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


#: What a model is asked for an element, by kind.
PROMPTS = {
    "table": "Copy the table in the image as Markdown after a line TABLE:, keeping every value as printed. After a line SUMMARY: say in two or three sentences what it holds. If there is no table, reply NO_TABLE; if it can't be read, UNREADABLE.",
    "figure": "Describe the figure in the image so that it can be found by a search: its subject, axes, series and main values. If it can't be read, reply UNREADABLE.",
    "text": "Sum up the following passage in a few sentences, with its names and numbers:\n\n",
}


def prompt_for(kind: Column, text: Column) -> Column:
    return F.when(kind == "table", PROMPTS["table"]).when(kind == "text", F.concat(F.lit(PROMPTS["text"]), F.coalesce(text, F.lit("")))).otherwise(PROMPTS["figure"])
