"""Secret scans through a trigram inverted index, with DataFrame operations only.

For each rule a Boolean trigram query is derived from its regex. The index holds a posting list for every trigram that
the queries name, written once; a rule's lists are intersected, and only candidates are searched with its regex. A rule
without mandatory trigrams (hex) scans all texts where they are read. So whole texts travel only to meet candidates, and
not even then while a count proves these few enough to broadcast. Offsets are code points: the lengths of what lies
between the matches give where each match starts.

Defined cases: null text is empty; a text without finds has counts 0 and the digest of the empty string; rows that agree
in doc_id and text get equal results, others never share theirs, whatever their doc_id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import join_sized, shared_table
from quillon.llm.trigrams import intersected, named, postings, trigram_query

#: kind, regex, group whose length counts, least length. Fixed by contract: the first three.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Kinds that this method adds.
MORE = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0, 1),
]
RULES = BASE + MORE
EMPTY = "cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)"


#: Matches of a text whose places are summed up together.
RUN = 256
KEYS = ["k1", "k2"]


def candidates(texts: DataFrame, rules=RULES) -> DataFrame:
    """texts(k1, k2, text) -> (k1, k2, rules): the rules whose trigram query a text's postings fulfil."""
    queries = {k: q for k, regex, _, _ in rules if (q := trigram_query(regex)) is not True}
    index = shared_table(postings(texts.select(*KEYS, "text"), sorted(set().union(*map(named, queries.values())))), "trigram-postings")
    return intersected(index, queries, KEYS).groupBy(*KEYS).agg(F.collect_set("rule").alias("rules"))


def once(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, rank: int, kind: str, regex: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches with a long enough group: array of (start, rank, end, kind).

    Places are running sums: over runs of matches first, then within each run, so that a long list isn't copied for
    every match."""
    hits, values = (F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(g)), F.length) for g in (0, group))
    gaps = F.transform(F.split(text, regex, -1), F.length)

    def total(x):
        return F.aggregate(x, F.lit(0), lambda s, m: s + m["gap"] + m["hit"])

    def begins(runs):
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(runs, start, lambda acc, x: F.struct((acc["at"] + total(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["value"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def placed(runs):
        return F.flatten(F.zip_with(runs, begins(runs), lambda x, at: F.aggregate(x, F.struct(at.alias("at"), F.expr(EMPTY).alias("out")), step)["out"]))

    def cut(found):
        last = F.floor((F.size(found) - 1) / RUN).cast("int")
        return once(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(found, k * RUN + 1, F.lit(RUN))), placed)

    # the piece after the last match has no match: it goes
    found = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")), lambda x: x["hit"].isNotNull())
    return once(found, lambda f: F.when(F.size(f) > 0, cut(f)).otherwise(F.expr(EMPTY)))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, found): all finds by start, then by rule."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumns({"k1": F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"), "k2": F.xxhash64(F.lit(1), "text")})
    posted = shared_table(candidates(texts, rules), "secret-candidates")
    fully, by_list = [], []
    for rank, (kind, regex, group, least) in enumerate(rules):
        known = trigram_query(regex) is not True
        chosen = F.array_contains("rules", kind) if known else F.col("text").rlike(regex)
        (by_list if known else fully).append(F.when(chosen, spans(F.col("text"), rank, kind, regex, group, least)).otherwise(F.expr(EMPTY)))
    verified = join_sized(texts.select(*KEYS, "text"), posted, KEYS).select(*KEYS, F.concat(*by_list).alias("listed")).filter(F.size("listed") > 0)
    verified = shared_table(verified.dropDuplicates(KEYS), "secret-finds")
    every = texts.select("doc_id", *KEYS, F.concat(F.expr(EMPTY), *fully).alias("scanned"))
    both = join_sized(every, verified, KEYS, "left")
    return both.select("doc_id", F.array_sort(F.concat("scanned", F.coalesce("listed", F.expr(EMPTY)))).alias("found"))


def digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, docs: DataFrame) -> DataFrame:
    base = F.filter("found", lambda x: x["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs).select("doc_id", *(count(k) for k, *_ in BASE), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))
