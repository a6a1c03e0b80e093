"""Near duplicates by ProbMinHash over word shingles.

Every shingle of a text starts a Poisson process of arrivals with its weight as rate, the number of its occurrences;
each arrival falls on a random place of the signature, which keeps its earliest. A process ends when its next arrival is
later than all places' kept ones. Two signatures agree in a place with the probability Jaccard similarity of the weighted
sets, which doesn't depend on the scale of the weights and is the Jaccard similarity where all are equal.
weights="distinct" makes all equal.

Texts of equal weighted sets are one node. Nodes that agree in a band form a bucket. Each is first verified, on its
shingles, against one leader of its bucket: rows grow with the bucket, not its square. Where verified links leave a
bucket in several components, its members are compared across components, signature against signature, in blocks of
bounded size; pairs whose estimate leaves 0.8 possible are verified there, and only links that join components leave
the block. So every candidate pair is either in one component already or examined, and no group of copies is expanded
into pairs.

Defined cases: null text is empty; texts without words are copies of each other; a text of fewer than five words is one
shingle; class_id is the smallest doc_id of a class, null only if none of its rows has one; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bytehash import mixed, shingles, slices, word_hashes
from quillon.llm.common import BATCH, drop_tables, give_back, lean, shared_table, spread
from quillon.llm.components import components

K, LEAST = 5, 0.8
BANDS, ROWS = 32, 5
PLACES = BANDS * ROWS
#: Members of a bucket compared at once, and their shingles; a pair at 0.8 has an estimate under this once in a billion.
BLOCK, BLOCK_ITEMS, ESTIMATE = 512, 1_000_000, 0.6
_MARK = np.uint64((1 << 24) - 1)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def weighted(hashes: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of one text, and their weights."""
    found, n = np.unique(hashes, return_counts=True)
    return found, (n if weights == "count" else np.ones(len(n))).astype(np.float64)


def signature(items: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """ProbMinHash of n weighted sets: row i holds, per place, the earliest arrival (high bits) and its item (low 24)."""
    out = np.full(n * places, np.uint64((1 << 64) - 1))
    time, base, r = np.zeros(len(items)), owner.astype(np.int64) * places, 0
    while len(items):
        draw = mixed(items, 2 * r + 1)
        time = time - np.log(_uniform(draw)) / weights
        place = base + (mixed(draw, 7) % np.uint64(places)).astype(np.int64)
        key = time.view(np.uint64) & ~_MARK | mixed(items, 3) & _MARK
        np.minimum.at(out, place, key)
        # only arrivals before the latest kept one of their set can still change it
        worst = out.reshape(n, places).max(axis=1)
        live = time.view(np.uint64) < worst[base // places]
        items, weights, time, base, r = items[live], weights[live], time[live], base[live], r + 1
    return out.reshape(n, places)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The sum over shared items i of 1 / sum over j of max(wa[j] / wa[i], wb[j] / wb[i])."""
    if (wa == wa[:1]).all() and (wb == wb[:1]).all():
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both) if both or len(a) + len(b) else 1.0
    items = np.union1d(a, b)
    x, y = np.zeros(len(items)), np.zeros(len(items))
    x[np.searchsorted(items, a)], y[np.searchsorted(items, b)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    more = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
    less = np.concatenate([[0], np.cumsum(y)])
    at = np.searchsorted(ratio, ratio, "left")
    both = (x > 0) & (y > 0)
    return float(np.sum(1 / (more[at[both]] / x[both] + less[at[both]] / y[both])))


def signatures(docs: DataFrame, k: int = K, weights: str = "count") -> DataFrame:
    """docs(doc_id, text) -> doc_id, th, node and node2 (hashes of the weighted set), n (its size), unit (all weights are 1), bands, sig."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            done = []
            for _, raw, offsets in slices(batch.column(1)):
                hashes, text = shingles(*word_hashes(raw, offsets), k)
                n = len(offsets) - 1
                edge = np.searchsorted(text, np.arange(n + 1))
                sets = [weighted(hashes[a:b], weights) for a, b in zip(edge, edge[1:], strict=False)]
                sizes = np.array([len(s) for s, _ in sets])
                items = np.concatenate([s for s, _ in sets])
                rates = np.concatenate([w for _, w in sets])
                owner = np.repeat(np.arange(n), sizes)
                nodes = []
                for salt in (5, 6):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, owner, mixed(items ^ rates.view(np.uint64), salt))
                    nodes.append(total)
                sig = signature(items, rates, owner, n)
                cells = mixed(sig & _MARK)
                bands = np.zeros((n, BANDS), np.uint64)
                for row in range(ROWS):
                    bands = mixed(bands + cells.reshape(n, BANDS, ROWS)[:, :, row], row)
                heavy = np.bincount(owner[rates != 1], minlength=n) > 0
                done.append((*nodes, sizes, ~heavy, bands, (cells >> np.uint64(32)).astype(np.uint8)))
            if not done:
                continue
            a, b, sizes, unit, bands, cells = (np.concatenate(x) for x in zip(*done, strict=True))
            lists = pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * BANDS, pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(unit), lists, pa.array([c.tobytes() for c in cells], pa.binary())], ["doc_id", "th", "node", "node2", "n", "unit", "bands", "sig"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return spread(texts).mapInArrow(lean(run), f"doc_id {kind}, th long, node long, node2 long, n long, unit boolean, bands array<long>, sig binary")


def node_texts(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted(node) -> node, text: one of the equal shingle sets' texts for each."""
    keys = nodes.select("node", "doc_id", "th").join(wanted, "node")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_th"))
    return texts.join(keys, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th"))).select("node", "text").dropDuplicates(["node"])


def shingle_sets(texts: DataFrame, k: int, weights: str) -> DataFrame:
    """texts(node, text) -> node, items (sorted hashes of the distinct shingles), rates (their weights; empty if all are 1)."""

    def run(batches):
        for batch in batches:
            items, rates = [], []
            for _, raw, offsets in slices(batch.column(1)):
                hashes, text = shingles(*word_hashes(raw, offsets), k)
                edge = np.searchsorted(text, np.arange(len(offsets)))
                for a, b in zip(edge, edge[1:], strict=False):
                    found, rate = weighted(hashes[a:b], weights)
                    items.append(found.tobytes())
                    rates.append(b"" if (rate == 1).all() else rate.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary()), pa.array(rates, pa.binary())], ["node", "items", "rates"])

    return texts.mapInArrow(lean(run), "node long, items binary, rates binary")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, least: float, weights: str) -> DataFrame:
    """The pairs(u, v) of nodes whose shingle sets are similar enough."""
    wanted = pairs.select("u").union(pairs.select(F.col("v"))).distinct().withColumnRenamed("u", "node")
    texts = shared_table(node_texts(wanted, docs, nodes), "pair-texts")
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sets = [[], []]
            for side in (0, 1):
                for _, raw, offsets in slices(batch.column(2 + side)):
                    hashes, text = shingles(*word_hashes(raw, offsets), k)
                    edge = np.searchsorted(text, np.arange(len(offsets)))
                    sets[side] += [weighted(hashes[a:b], weights) for a, b in zip(edge, edge[1:], strict=False)]
            for i, (a, b) in enumerate(zip(*sets, strict=True)):
                keep[i] = probability_jaccard(*a, *b) >= least - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["u", "v"])

    both = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(lean(run), "u long, v long")


def _compare(least: float):
    """Links that join components within a block of a bucket, each verified on the shingles; at most one fewer than members.

    Only pairs across components whose estimated similarity leaves `least` possible are looked at, likeliest first; a
    pair that earlier links have joined already needs no look."""

    def run(table: pa.Table) -> pa.Table:
        node, n, sub = (table[c].to_numpy() for c in ("node", "n", "sub"))
        group = np.unique(table["comp"].to_numpy(), return_inverse=True)[1]
        band, bi, bj = (table[c][0].as_py() for c in ("band", "bi", "bj"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, PLACES)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        items = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        rates = [np.frombuffer(x, np.float64) for x in table["rates"].to_pylist()]

        def similarity(a: int, b: int) -> float:
            return probability_jaccard(items[a], rates[a] if len(rates[a]) else np.ones(len(items[a])), items[b], rates[b] if len(rates[b]) else np.ones(len(items[b])))

        unit = np.array([not len(r) for r in rates])

        rows, cols = np.flatnonzero(sub == bi), np.flatnonzero(sub == bj)
        us, vs = [], []
        for a in range(0, len(rows), 64):
            i = rows[a : a + 64]
            # A pair is looked at in its first common band, by the hashes that form the buckets: cells can agree by accident.
            first = (bands[i][:, None, :] == bands[cols][None, :, :]).argmax(-1)
            estimate = (sig[i][:, None, :] == sig[cols][None, :, :]).mean(-1)
            likely = (estimate >= ESTIMATE * least / LEAST) & (first == band) & (group[i][:, None] != group[cols][None, :])
            # sizes bound the similarity of sets without weights only
            likely &= (np.minimum(n[i][:, None], n[cols]) >= least * np.maximum(n[i][:, None], n[cols])) | ~(unit[i][:, None] & unit[cols])
            if bi == bj:
                likely &= node[i][:, None] > node[cols][None, :]
            x, y = np.nonzero(likely)
            order = np.argsort(-estimate[x, y], kind="stable")
            for p, q in zip(i[x[order]].tolist(), cols[y[order]].tolist(), strict=True):
                if group[p] != group[q] and similarity(p, q) >= least - 1e-12:
                    us.append(node[p])
                    vs.append(node[q])
                    group[group == group[q]] = group[p]
        items = rates = sig = bands = None
        give_back()
        return pa.table({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return run


def classes(docs: DataFrame, k: int = K, least: float = LEAST, weights: str = "count") -> DataFrame:
    """docs(doc_id, text) -> a row for each row: doc_id, th (hash of its text), root (key of its class), class_id, n_shingles."""
    docs = docs.select("doc_id", "text")
    signed = shared_table(signatures(docs, k, weights), "signatures", BATCH)
    least_doc = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n", "unit", "bands", "sig")).alias("r")
    nodes = shared_table(signed.groupBy("node", "node2").agg(least_doc).select("node", "node2", "r.*").drop("none"), "nodes")
    banded = nodes.filter("n > 0").select("node", "n", "unit", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.min(F.struct("node", "n", "unit")).alias("leader"), F.count("*").alias("size")).filter("size > 1")
    members = shared_table(banded.join(buckets, ["band", "h"]), "members")
    pairs = members.select(F.col("node").alias("u"), F.col("leader.node").alias("v"), F.col("n").alias("a"), F.col("leader.n").alias("b"), (F.col("unit") & F.col("leader.unit")).alias("unit"))
    pairs = pairs.filter((F.col("u") != F.col("v")) & (~F.col("unit") | (F.least("a", "b") >= least * F.greatest("a", "b"))))
    pairs = shared_table(pairs.select("u", "v").distinct(), "pairs")
    sure = shared_table(verified(pairs, docs, nodes, k, least, weights), "links", BATCH)
    links = components(sure)
    drop_tables(docs.sparkSession, pairs, sure)

    # Buckets that the links so far leave in several components.
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    split = members.select("band", "h", "node", "n").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    split = shared_table(split, "split")
    open_ = split.groupBy("band", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("total")).filter("lo < hi").select("band", "h", "size", "total")
    wanted = split.join(open_, ["band", "h"], "left_semi").select("node").distinct()
    sets = shingle_sets(node_texts(wanted, docs, nodes), k, weights).join(nodes.select("node", "sig", "bands"), "node")
    sets = shared_table(sets, "open-sets", BATCH)
    rest = split.join(open_, ["band", "h"]).withColumn("blocks", F.expr(f"1 + greatest((size - 1) div {BLOCK}, total div {BLOCK_ITEMS})"))
    rest = rest.withColumns({"sub": F.expr("pmod(xxhash64(node), blocks)"), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    rest = rest.withColumns({"bi": F.least("sub", "other"), "bj": F.greatest("sub", "other")})
    rest = rest.join(sets, "node").select("band", "h", "bi", "bj", "node", "comp", "n", "sub", "sig", "bands", "items", "rates")
    more = shared_table(rest.groupBy("band", "h", "bi", "bj").applyInArrow(_compare(least), "u long, v long"), "more-links", BATCH)
    links = components(more.union(links))
    drop_tables(docs.sparkSession, members, split, sets)

    named = nodes.select("node", "node2", "doc_id").join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    named = named.withColumn("root", F.coalesce("root", F.when(F.col("node2").isNotNull(), F.col("node"))))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = named.join(smallest, "root").select("node", "node2", "root", "class_id")
    return signed.select("doc_id", "th", "node", "node2", F.col("n").alias("n_shingles")).join(named, ["node", "node2"]).select("doc_id", "th", "root", "class_id", "n_shingles")


def query(spark, docs: DataFrame) -> DataFrame:
    return classes(docs).drop("th", "root")
