"""Suffix-array dedup by bucket-pointer refinement: bytes of WIDTH-byte strings that an earlier document also holds.

Texts equal to an earlier document's are cut whole (they share every string) and leave the work. In the others, every
window of WIDTH bytes has an anchor: the q-gram of least hash in it, so equal windows have equal anchors. Windows with
one anchor occurrence lie side by side and form a span. Occurrences meet by anchor, packed as arrays. Spans whose anchor
occurs in one document only can't repeat. Two spans share a window only if they agree in the HALF bytes before or after
their anchor; an occurrence carries a mark of either. A span that shares no mark with another of its anchor is settled:
the smallest doc_id that has it has its windows first. Each of the other distinct spans is fetched once, and their
suffixes are sorted by bucket-pointer refinement (see sorted_suffixes). Neighbours in that order that agree in WIDTH
bytes are one string; its first holder is the smallest doc_id of their spans. So what is stored and fetched follows the
repeats, not the anchors that documents of one vocabulary share by chance, which grow faster than the table.

Identity of a row is (doc_id, hash of its text): any number of texts can share a doc_id, and rows that agree in both get
equal results. What a part of the texts is asked for or told travels to it as arrays, one row for each part and bucket of
anchors, so rows in shuffles grow with neither. Of equal spans within 8 MB of texts only those of the smallest doc_id
travel, the others are settled at once; so of a passage that very many documents hold, few occurrences meet in one task.

Defined cases: null text is empty; texts of fewer than WIDTH bytes stay whole; strings within one document or one
doc_id don't count; rows with a null doc_id stay whole and remove nothing; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.bytehash import between, mixed, prefix, slices
from quillon.llm.common import drop_tables, join_sized, shared_table, spread

WIDTH, GRAM = 50, 16
REACH = WIDTH - GRAM
HALF = REACH // 2
#: Bytes of spans whose suffixes are sorted together (more if one anchor has more); bytes of texts, and of one text,
#: scanned at once: a scan holds about 120 bytes for each of them.
SORTED, SCAN, PART = 2 << 20, 1 << 19, 1 << 20
#: Bytes of texts whose anchors are packed together, and for which there is one bucket of anchors and one part of texts.
PACKED, BUCKET = 8 << 20, 4 << 20
#: Slices of the suffixes that one pass of the refinement sorts one after the other.
PASSES = 4
#: Copies (40 bytes each) that may be broadcast to leave the work; more are joined by a shuffle.
COPIES = 200_000


def spans_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, span hash, first window, number of windows, place of the anchor, marks of the HALF bytes before
    and after the anchor or 0) of the spans of texts that lie one after the other."""
    views = REACH + 1
    n = len(raw) - GRAM + 1
    if n < views:
        return tuple(np.zeros(0, np.int64) for _ in range(8))
    at = np.arange(n)
    sums = prefix(raw)
    gram = mixed(between(sums, at, at + GRAM))
    key = gram & ~np.uint64((1 << 24) - 1) | at.astype(np.uint64)
    # sliding minimum over `views` grams by doubling
    width, low = 1, key
    while 2 * width <= views:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(key) - views + 1], low[views - width : len(key) - width + 1])
    anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    inside = start + WIDTH <= np.repeat(offsets[1:], sizes)[: len(anchor)]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    groups = np.cumsum(new & inside) - 1
    count = np.bincount(groups[inside], minlength=len(first))
    place = anchor[first] - first
    whole = mixed(between(sums, first, first + count + WIDTH - 1) + count.astype(np.uint64) * np.uint64(131) + place.astype(np.uint64), 4)
    marks = []
    for begin, held in ((anchor[first] - HALF, place >= HALF), (anchor[first] + GRAM, count + WIDTH - 1 - place - GRAM >= HALF)):
        begin = np.where(held, begin, 0)
        marks.append(np.where(held, 1 + mixed(between(sums, begin, begin + HALF), 8) % np.uint64(65535), 0).astype(np.uint16))
    return text[first], (mixed(gram[anchor[first]], 9) >> np.uint64(32)).astype(np.uint32), whole, first - offsets[text[first]], count, place, *marks


def _codes(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number in their order; raw ends in 8 zeros."""
    out = np.zeros(len(raw) - 8, np.uint64)
    for k in range(8):
        out |= raw[k : len(raw) - 8 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def sorted_suffixes(codes: np.ndarray, span: np.ndarray, docs: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Bucket-pointer refinement: the pointer of every suffix, the place where its bucket begins in the order of suffixes.

    The first buckets hold suffixes that agree in 8 bytes. A bucket whose members agree in d bytes is sorted by the
    pointers of the suffixes d bytes on, which splits it, and its members' pointers are set to the smaller buckets at
    once: sorts that follow, of the same pass and of later ones, already compare by the finer pointers. Buckets of one
    suffix or one document need no further sort. After a pass at d all others agree in at least 2 d bytes.

    codes: of all places of spans that end in 8 zeros each; span: which span a place lies in; docs: first holder of each."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.append(True, codes[order][1:] != codes[order][:-1])
    begin = np.flatnonzero(new)
    pointer = np.empty(n, np.int64)
    pointer[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    last = np.searchsorted(span, span, "right") - 1  # beyond its end a span holds zeros only
    d = 8
    while d < depth:
        doc = docs[span[order]]
        bucket = pointer[order]
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        mixed_docs = np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge)
        live = np.repeat(mixed_docs, np.diff(np.append(edge, len(order))))
        order = order[live]
        if not len(order):
            break
        bucket = pointer[order]
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        stops = heads[np.searchsorted(heads, np.linspace(0, len(order), PASSES + 1)[1:-1].astype(int), "right") - 1]
        for a, b in zip([0, *stops.tolist()], [*stops.tolist(), len(order)], strict=True):
            if a == b:
                continue
            some = order[a:b]
            own, later = pointer[some], pointer[np.minimum(some + d, last[some])]
            place = np.lexsort((later, own))
            some, own, later = some[place], own[place], later[place]
            order[a:b] = some
            fresh = np.append(True, (own[1:] != own[:-1]) | (later[1:] != later[:-1]))
            head = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), np.arange(b - a), 0))
            at = np.maximum.accumulate(np.where(fresh, np.arange(b - a), 0))
            pointer[some] = own + at - head
        d *= 2
    return pointer


def first_holders(spans: list[bytes], docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first holder of each window: of the counts[i] windows of spans[i], one after the other."""
    raw = np.frombuffer(b"".join(s + bytes(8) for s in spans) + bytes(8), np.uint8)
    sizes = np.array([len(s) + 8 for s in spans])
    begin = np.cumsum(sizes) - sizes
    span = np.repeat(np.arange(len(spans)), sizes)
    codes = _codes(raw)
    pointer = sorted_suffixes(codes, span, docs)
    of = np.repeat(np.arange(len(spans)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[of]
    order = np.argsort(pointer[window], kind="stable")
    p = window[order]
    same = np.ones(len(p) - 1, bool)
    for k in (*range(0, WIDTH - 8, 8), WIDTH - 8):
        c = codes[p + k]
        same &= c[1:] == c[:-1]
    edge = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(docs[of][order], edge)
    out = np.empty(len(p), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(edge, len(p))))
    return out


def repeating(anchor: np.ndarray, spans: list[bytes], places: np.ndarray) -> np.ndarray:
    """Spans that may share a window with another of their anchor: half of what a window has beside it must agree."""
    out = np.zeros(len(spans), bool)
    for side in (0, 1):
        key = np.array([hash((a, s[p + GRAM : p + GRAM + HALF] if side else s[max(0, p - HALF) : p])) for a, s, p in zip(anchor.tolist(), spans, places.tolist(), strict=True)], np.int64)
        _, again, n = np.unique(key, return_inverse=True, return_counts=True)
        long = np.array([len(s) - p - GRAM if side else p for s, p in zip(spans, places.tolist(), strict=True)]) >= HALF
        out |= (n[again] > 1) & long
    return out


def _parts(raw: np.ndarray, offsets: np.ndarray):
    """Slices small enough for 24-bit places: a longer text in parts that overlap by a window less a byte."""
    if len(raw) <= PART:
        yield raw, offsets, 0
        return
    for a in range(0, len(raw), PART - WIDTH + 1):
        b = min(len(raw), a + PART)
        yield raw[a:b], np.array([0, b - a]), a
        if b == len(raw):
            return


#: What is known of an occurrence: anchor, hash of its span, doc_id and key of its row, first window, number of windows,
#: place of the anchor in the span, marks of what stands before and after the anchor. A row's part is the remainder of its key.
FIELDS = {"a": np.uint32, "s": np.uint64, "doc": np.int64, "key": np.int64, "lo": np.uint32, "n": np.uint8, "p": np.uint8, "l": np.uint16, "r": np.uint16}
#: Of these the high bytes are mostly zeros: they are packed byte by byte, all first bytes first, which compresses.
PLANES = {f: np.dtype(FIELDS[f]).itemsize for f in ("doc", "lo")}
PACK = "kind string, grp int, " + ", ".join(f"{f} binary" for f in FIELDS) + ", data binary"
NAMES = ["kind", "grp", *FIELDS, "data"]


def _bytes_of(field: str, x: np.ndarray) -> bytes:
    return (x.view(np.uint8).reshape(-1, PLANES[field]).T if field in PLANES else x).tobytes()


def _packed(kind: str, group: np.ndarray, fields: dict[str, np.ndarray], only: tuple[str, ...] = tuple(FIELDS)) -> list[tuple]:
    """Rows of PACK: the occurrences of each group, as arrays of bytes."""
    if not len(group):
        return []
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
    held = {f: np.asarray(fields[f])[order].astype(FIELDS[f]) for f in only}
    ends = [*edge[1:].tolist(), len(order)]
    return [(kind, int(group[order[a]]), *(_bytes_of(f, held[f][a:b]) if f in held else None for f in FIELDS), None) for a, b in zip(edge.tolist(), ends, strict=True)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * (len(FIELDS) + 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def _grouped(batches):
    """(group, rows) of rows of PACK that are sorted by group."""
    group, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[1] != group and rows:
                yield group, rows
                rows = []
            group = row[1]
            rows.append(row)
    if rows:
        yield group, rows


def _sorted(x: dict[str, np.ndarray], *keys: str) -> dict[str, np.ndarray]:
    """x in the order of keys, the first one first; arrays of x are let go one by one."""
    order = np.lexsort([x[k] for k in reversed(keys)])
    for f in x:
        if len(x[f]):
            x[f] = x[f][order]
    return x


def _joined(rows: list[tuple]) -> dict[str, np.ndarray]:
    out = {}
    for k, (f, t) in enumerate(FIELDS.items(), 2):
        held = [r[k] for r in rows if r[k]]
        if f in PLANES:
            held = [np.frombuffer(b, np.uint8).reshape(PLANES[f], -1).T.tobytes() for b in held]
        out[f] = np.frombuffer(b"".join(held), t)
    return out


def _segments(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the runs of equal keys, and the run of each."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new), np.cumsum(new) - 1


def known_here(x: dict[str, np.ndarray]) -> np.ndarray:
    """Occurrences whose whole span a smaller doc_id among those packed together also has: they are settled, and one
    anchor, however many documents hold it, leaves a task with few occurrences."""
    order = np.argsort(x["a"])
    a = x["a"][order]
    twice = np.append(a[1:] == a[:-1], False)
    twice[1:] |= twice[:-1].copy()
    some = order[twice]
    late = np.zeros(len(a), bool)
    if len(some):
        some = some[np.lexsort((x["doc"][some], x["s"][some], x["a"][some]))]
        edge, of = _segments(x["a"][some], x["s"][some])
        late[some] = x["doc"][some] > x["doc"][some[edge]][of]
    return late


def anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """texts(doc_id, key, text) -> rows of PACK: the occurrences by bucket of their anchors, and cuts by part."""

    def run(batches):
        waiting, size = [], 0

        def out():
            x = {f: np.concatenate([w.pop(f) for w in waiting]) for f in FIELDS}
            waiting.clear()
            late = known_here(x)
            rows = _packed("cut", x["key"][late] % buckets, {f: x[f][late] for f in ("key", "lo", "n")}, ("key", "lo", "n"))
            x = {f: v[~late] for f, v in x.items()}
            rows += _packed("at", (x["a"] % np.uint32(buckets)).astype(np.int32), x)
            return [_batch(rows)] if rows else []

        for batch in batches:
            ids, keys = (batch.column(k).to_numpy() for k in range(2))
            for i, raw, offsets in slices(batch.column(2), SCAN):
                for part, edges, shift in _parts(raw, offsets):
                    text, a, s, lo, n, p, l, r = spans_of(part, edges)  # noqa: E741
                    waiting.append({"a": a, "s": s, "doc": ids[i + text], "key": keys[i + text], "lo": (lo + shift).astype(np.uint32), "n": n.astype(np.uint8), "p": p.astype(np.uint8), "l": l, "r": r})
                size += len(raw)
                if size >= PACKED:
                    yield from out()
                    size = 0
        if waiting:
            yield from out()

    return texts.select("doc_id", "key", "text").mapInArrow(run, PACK)


def may_repeat(x: dict[str, np.ndarray], least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Distinct spans that share a mark with another one of their anchor, if not all of these are one document's. least and
    most: the smallest and the largest doc_id that has each."""
    out = np.zeros(len(least), bool)
    for f in ("l", "r"):
        held = np.flatnonzero(x[f])
        if len(held):
            order = held[np.lexsort((x[f][held], x["a"][held]))]
            edge, of = _segments(x["a"][order], x[f][order])
            out[order] |= ((np.bincount(of) > 1) & (np.minimum.reduceat(least[order], edge) < np.maximum.reduceat(most[order], edge)))[of]
    return out


def _settled(buckets: int):
    """Occurrences of a bucket -> cuts of what is settled, spans to ask for, and the occurrences that wait for them."""

    def run(batches):
        for bucket, rows in _grouped(batches):
            settled = [r for r in rows if r[0] == "cut"]
            if settled:
                yield _batch(settled)
            x = _joined([r for r in rows if r[0] == "at"])
            rows.clear()
            if not len(x["a"]):
                continue
            x = _sorted(x, "a", "s", "doc")
            edge, of = _segments(x["a"])
            shared = (np.minimum.reduceat(x["doc"], edge) < np.maximum.reduceat(x["doc"], edge))[of]
            x = {f: v[shared] for f, v in x.items()}
            if not len(x["a"]):
                continue
            span, of_span = _segments(x["a"], x["s"])
            least, most = x["doc"][span], x["doc"][np.append(span[1:], len(x["a"])) - 1]
            again = may_repeat({f: x[f][span] for f in ("a", "l", "r")}, least, most)
            later = ~again[of_span] & (x["doc"] > least[of_span])
            out = _packed("cut", x["key"][later] % buckets, {f: v[later] for f, v in x.items()}, ("key", "lo", "n"))
            ask = span[again]
            out += _packed("ask", x["key"][ask] % buckets, {f: v[ask] for f, v in x.items()}, ("a", "s", "doc", "key", "lo", "n", "p"))
            wait = np.flatnonzero(again[of_span])
            out += _packed("at", np.full(len(wait), bucket), {f: v[wait] for f, v in x.items()}, ("a", "s", "doc", "key", "lo"))
            if out:
                yield _batch(out)

    return run


def _fetched(buckets: int):
    """Rows of PACK that ask a part, then the part's texts (key, data) -> rows of PACK with the spans, by bucket."""

    def run(batches):
        for _, rows in _grouped(batches):
            x = _sorted(_joined([r for r in rows if r[0] == "ask"]), "key")
            found, data = [], []
            for r in rows:
                if r[0] != "text":
                    continue
                key = _number(r[2 + list(FIELDS).index("key")])
                a, b = np.searchsorted(x["key"], key), np.searchsorted(x["key"], key, "right")
                found.append(np.arange(a, b))
                data += [r[-1][lo : lo + n + WIDTH - 1] for lo, n in zip(x["lo"][a:b].tolist(), x["n"][a:b].tolist(), strict=True)]
            if not data:
                continue
            at = np.concatenate(found)
            group = (x["a"][at] % np.uint32(buckets)).astype(np.int32)
            place = np.argsort(group, kind="stable")
            edge, _ = _segments(group[place])
            out = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(place)], strict=True):
                mine = place[a:b]
                held = {f: x[f][at[mine]] for f in ("a", "s", "doc", "n", "p")}
                out.append(("span", int(group[mine[0]]), *(_bytes_of(f, held[f]) if f in held else None for f in FIELDS), b"".join([data[k] for k in mine.tolist()])))
            yield _batch(out)

    return run


def _refined(batches, parts: int):
    """Waiting occurrences and the spans they have -> rows of PACK: cuts for the parts."""
    for _, rows in _grouped(batches):
        wait, x = _joined([r for r in rows if r[0] == "at"]), _joined([r for r in rows if r[0] == "span"])
        if not len(x["a"]):
            continue
        sizes = x["n"].astype(np.int64) + WIDTH - 1
        data = b"".join([r[-1] for r in rows if r[0] == "span"])
        rows.clear()
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((x["s"], x["a"]))
        x = {f: v[order] for f, v in x.items() if len(v)}
        begin, sizes = begin[order], sizes[order]
        spans = [data[i : i + k] for i, k in zip(begin.tolist(), sizes.tolist(), strict=True)]
        counts = x["n"].astype(np.int64)
        head = np.cumsum(counts) - counts
        first = np.repeat(x["doc"], counts)  # of each window
        keep = np.flatnonzero(repeating(x["a"], spans, x["p"]))
        size = np.cumsum(sizes[keep])
        edge, _ = _segments(x["a"][keep]) if len(keep) else (np.zeros(0, np.int64), None)
        stops, at = [0], 0
        for e in edge[1:].tolist():
            if size[e - 1] - at >= SORTED:
                stops.append(e)
                at = size[e - 1]
        for a, b in zip(stops, [*stops[1:], len(keep)], strict=True):
            some = keep[a:b]
            if len(some):
                found = first_holders([spans[k] for k in some.tolist()], x["doc"][some], counts[some])
                into = np.repeat(head[some] - np.cumsum(counts[some]) + counts[some], counts[some]) + np.arange(len(found))
                first[into] = found
        # runs of windows of a span with one first holder
        of = np.repeat(np.arange(len(spans)), counts)
        run, _ = _segments(of, first)
        run_of, run_at, run_n = of[run], run - head[of[run]], np.diff(np.append(run, len(first)))
        run_head, n_runs = np.searchsorted(run_of, np.arange(len(spans))), np.bincount(run_of, minlength=len(spans))
        # every waiting occurrence takes the runs of its span that an earlier document holds
        wait = _sorted(wait, "a", "s")
        _, which = _segments(wait["a"], wait["s"])
        n = n_runs[which]
        one = np.repeat(np.arange(len(which)), n)
        r = np.repeat(run_head[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cut = first[run[r]] < wait["doc"][one]
        one, r = one[cut], r[cut]
        out = _packed("cut", wait["key"][one] % parts, {"key": wait["key"][one], "lo": wait["lo"][one] + run_at[r], "n": run_n[r]}, ("key", "lo", "n"))
        if out:
            yield _batch(out)


def _bytes(number: Column) -> Column:
    """A long as 8 bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big", signed=True)


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "grp").sortWithinPartitions("grp", "kind")


def _as_rows(texts: DataFrame, kind: str) -> DataFrame:
    """texts(key: binary, part, text) as rows of PACK."""
    none = F.lit(None).cast("binary")
    fields = [F.col("key_bytes").alias("key") if f == "key" else none.alias(f) for f in FIELDS]
    return texts.select(F.lit(kind).alias("kind"), F.col("part").alias("grp"), *fields, F.col("text").cast("binary").alias("data"))


def cut_rows(texts: DataFrame, parts: int) -> DataFrame:
    """texts(doc_id, key, key_bytes, part, text), each document once -> rows of PACK: key, lo, n (windows) to cut, by part."""
    found = _dealt(anchors(spread(texts), parts), parts).mapInArrow(_settled(parts), PACK)
    found = shared_table(found, "anchors")
    asked = found.filter("kind = 'ask'")
    held = asked.select("grp").distinct().withColumnRenamed("grp", "part")
    wanted = join_sized(texts, held, ["part"], "left_semi")
    spans = _dealt(asked.union(_as_rows(wanted, "text")), parts).mapInArrow(_fetched(parts), PACK)
    both = found.filter("kind = 'at'").union(spans)
    more = shared_table(_dealt(both, parts).mapInArrow(lambda batches: _refined(batches, parts), PACK), "cuts")
    return found.filter("kind = 'cut'").union(more)


def _ranges(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that n windows from lo on cover."""
    lo = lo.astype(np.int64)
    return lo, lo + n + (WIDTH - 1)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The union of the ranges [a, b)."""
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return a[new].tolist(), reach[last].tolist()


def dedup(docs: DataFrame, kept: bool = False) -> DataFrame:
    """docs(doc_id: long, text) -> the digest of what is left of each row; with kept, the bytes too."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    given = given.withColumns({"th": F.xxhash64("text"), "th2": F.xxhash64(F.lit(1), "text")})
    keys = given.select("doc_id", "th", "th2", F.octet_length("text").alias("size")).filter(f"size >= {WIDTH} and doc_id is not null")
    keys = shared_table(keys.groupBy("th", "th2", "size").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "text-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = 1 + int(total) // BUCKET
    key = F.xxhash64("doc_id", "th", "th2")
    given = given.withColumns({"key": key, "part": F.pmod(key, F.lit(parts)).cast("int"), "key_bytes": _bytes(key)})
    # Of equal texts the first document's goes on; the others, and rows that repeat it, follow it.
    odd = keys.filter("n > 1").drop("n")
    copies = join_sized(given, odd, ["th", "th2"], "left", COPIES).withColumn("whole", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    alone = copies.filter(f"not whole and doc_id is not null and octet_length(text) >= {WIDTH}")
    once = alone.filter("first is null").unionByName(alone.filter("first is not null").dropDuplicates(["key"]))
    cuts = cut_rows(once.select("doc_id", "key", "key_bytes", "part", "text"), parts)

    none = F.lit(None).cast("binary")
    fields = [F.col("key_bytes").alias("key") if f == "key" else F.when(F.col("whole"), F.lit(b"\1")).alias(f) if f == "n" else F.when(F.col("doc_id").isNotNull(), _bytes(F.col("doc_id"))).alias(f) if f == "doc" else none.alias(f) for f in FIELDS]
    rows = copies.select(F.lit("text").alias("kind"), F.col("part").alias("grp"), *fields, F.col("text").cast("binary").alias("data"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 6 if kept else 5]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)]
    where = {f: 2 + k for k, f in enumerate(FIELDS)}

    def run(batches):
        group, waiting, x = None, [], None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] != group:
                    group, waiting, x = row[1], [], None
                if row[0] == "cut":
                    waiting.append(row)
                    continue
                if x is None:
                    x = _joined(waiting)
                    order = np.argsort(x["key"], kind="stable")
                    x, waiting = {f: x[f][order] for f in ("key", "lo", "n")}, []
                data = row[-1]
                own = _number(row[where["key"]])
                a, b = np.searchsorted(x["key"], own), np.searchsorted(x["key"], own, "right")
                begins, ends = ([0], [len(data)]) if row[where["n"]] else merged(*_ranges(x["lo"][a:b], x["n"][a:b])) if b > a and row[where["doc"]] else ([], [])
                left, at = [], 0
                for i, j in zip(begins, ends, strict=True):
                    left.append(data[at:i])
                    at = j
                left = b"".join([*left, data[at:]])
                doc = _number(row[where["doc"]]) if row[where["doc"]] else None
                done.append((doc, len(data), len(data) - len(left), len(begins), hashlib.sha256(left).hexdigest(), left))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=False)], names)

    return _dealt(cuts.union(rows), parts).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept)


def query(spark, docs: DataFrame) -> DataFrame:
    return dedup(docs)
