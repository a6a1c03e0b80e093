"""Boolean trigram queries of regular expressions, and postings of the trigrams they name (lower case)."""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser as P

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of strings that grow beyond this are cut; what was known so far becomes a condition.
MOST = 64


def _strings(op, arg) -> set[str] | None:
    """All strings that an item matches, in lower case; None if they are too many or unknown."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 16:
                out |= {chr(k).lower() for k in range(x[0], x[1] + 1)}
            else:
                return None
        return out
    if op is C.AT:
        return {""}
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        sets = [_sequence(x) for x in arg[1]]
        return set().union(*sets) if all(x is not None for x in sets) else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] != C.MAXREPEAT and arg[1] <= 2:
        inner = _sequence(arg[2])
        out = set()
        for n in range(arg[0], arg[1] + 1):
            if inner is None or len(inner) ** n > MOST:
                return None
            out |= {"".join(x) for x in product(inner, repeat=n)}
        return out
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        found = _strings(op, arg)
        if found is None or len(found) * len(out) > MOST:
            return None
        out = {a + b for a in out for b in found}
    return out


def _known(strings: set[str]):
    if min(map(len, strings)) < 3:
        return True
    return ("or", [("and", sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in sorted(strings)])


def _query(items):
    """True (nothing is known), or ("and" | "or", parts) over trigrams."""
    parts, run = [], {""}
    for op, arg in items:
        found = _strings(op, arg)
        if found is not None and len(found) * len(run) <= MOST:
            run = {a + b for a in run for b in found}
            continue
        parts.append(_known(run))
        run = {""}
        if found is not None and len(found) <= MOST:
            run = found
        elif op is C.SUBPATTERN:
            parts.append(_query(arg[-1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_query(arg[2]))
        elif op is C.BRANCH:
            ways = [_query(x) for x in arg[1]]
            parts.append(True if True in ways else ("or", ways))
    parts.append(_known(run))
    parts = [p for p in parts if p is not True]
    return ("and", parts) if parts else True


def trigram_query(regex: str):
    """The condition on a text's trigrams, in lower case, that every match of regex implies; True if there is none."""
    return _query(P.parse(regex))


def named(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(named, query[1]))


def clauses(query, most: int = MOST) -> list[frozenset[str]]:
    """query as sets of trigrams of which a text must hold one whole set; [] if nothing is known.

    Where the sets would be too many, a part of an "and" is left out: more texts are candidates, none is lost."""
    if query is True:
        return []
    if isinstance(query, str):
        return [frozenset([query])]
    parts = [clauses(x, most) for x in query[1]]
    if query[0] == "or":
        out = {c for p in parts for c in p} if all(parts) else set()
    else:
        out = set()
        for p in sorted(filter(None, parts), key=len):
            more = {a | b for a in out for b in p} if out else set(p)
            out = more if len(more) <= most else out
    return sorted((c for c in out if not any(o < c for o in out)), key=sorted)


def finder(names: list[str]) -> str:
    """A regex that matches, with no width, wherever one of the trigrams begins; group 1 is the trigram."""
    tails: dict[str, list[str]] = {}
    for t in sorted(names):
        tails.setdefault(t[0], []).append(t[1:])
    quoted = lambda x: "".join("\\" + ch if not ch.isalnum() else ch for ch in x)
    return "(?=(" + "|".join(f"{quoted(a)}(?:{'|'.join(map(quoted, b))})" for a, b in tails.items()) + "))"


def postings(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs(key columns..., text) -> the inverted index: a row (trigram, key columns...) for each named trigram that a text
    holds, found in one pass over the text; sorted by trigram, so that lists are read by their row groups."""
    keys = [c for c in docs.columns if c != "text"]
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(finder(names)), F.lit(1)))
    return docs.select(F.explode(held).alias("trigram"), *keys).sortWithinPartitions("trigram")


def intersected(index: DataFrame, queries: dict[str, object], keys: list[str]) -> DataFrame:
    """index(trigram, keys...) -> (keys..., rule) for each rule whose query the posting lists fulfil.

    The lists that a set of trigrams names are read by a join on the trigram and intersected by the bits of its trigrams
    that a document was met under."""
    terms = []
    for rule, query in sorted(queries.items()):
        for n, clause in enumerate(clauses(query)):
            for k in range(0, len(clause), 60):  # a longer clause: each piece is a condition of its own
                piece = sorted(clause)[k : k + 60]
                terms += [(rule, n, k // 60, 1 + (len(clause) - 1) // 60, t, 1 << b, (1 << len(piece)) - 1) for b, t in enumerate(piece)]
    spark = index.sparkSession
    # at most a few hundred rows: what the rules name
    named_ = spark.createDataFrame(terms, "rule string, clause int, piece int, pieces int, trigram string, bit long, full long")
    met = index.join(F.broadcast(named_), "trigram").groupBy(*keys, "rule", "clause", "piece", "pieces", "full").agg(F.bit_or("bit").alias("bits"))
    whole = met.filter("bits = full").groupBy(*keys, "rule", "clause", "pieces").agg(F.count("*").alias("n")).filter("n = pieces")
    return whole.select(*keys, "rule").distinct()
