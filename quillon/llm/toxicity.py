"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word enters as a word embedding (words of the training sample; all others share one) joined to the mean of the
embeddings of its hashed character trigrams, over its whole length. Two gated recurrent layers read a window of WINDOW
words in either direction; attention pools their states into one logit. All windows of a text are scored, each
overlapping the next by WINDOW - STRIDE words; the text's score is that of its highest window. Word embeddings start
from how far a word's rate differs between the labels.

Training rows are a bounded sample of labelled rows: per label the PER_LABEL rows with the smallest hash of doc_id among
the LOOKED_AT first ones whose text has at most LONGEST characters, and only rows with crc32(doc_id) mod 4 <> 2. Texts,
not labels, lang, source or doc_id, are what is scored.

Defined cases: null text is empty, and an empty text has the score of an empty window; without labels of both kinds the
score is the share of label 1 (0 without labels); rows are independent, so repeated rows get equal scores; an empty
table gives an empty result; other columns pass through reject().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import free, give_back, lean, shared_table, spread

WINDOW, STRIDE = 48, 36
#: Bounds on the training sample.
PER_LABEL, LOOKED_AT, LONGEST = 600, 8000, 4000
DIM, HIDDEN, TRIGRAMS, EPOCHS, BATCH, CUT = 8, 8, 2048, 5, 32, 0.3
#: Standard errors by which a word's rates must differ between the labels; shrinkage of all parameters.
SURE, DECAY = 3.5, 0.02
#: Texts, and characters of them, that are scored together.
TOGETHER, CHARACTERS = 256, 1_000_000
#: Words whose inputs a worker keeps.
KEPT = 120_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character trigrams of the words (with edge marks), and where each word's begin."""
    codes = np.frombuffer("".join(f"\1{w}\2" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 2) - sizes - 2
    hashed = (codes[:-2] * np.uint64(1_000_003) + codes[1:-1]) * np.uint64(1_000_003) + codes[2:]
    hashed = (hashed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(TRIGRAMS)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(begin, sizes) + np.repeat(starts, sizes)
    return hashed[at].astype(np.int64), begin


def windows(n: int) -> range:
    """Where the windows of a text of n words begin."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else range(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The network's parameters p, forward and backward passes. Arrays are (features, windows)."""

    def __init__(self, vocabulary: dict[str, int], lean: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        size = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
        h = HIDDEN
        self.p = {"word": 0.1 * size(len(vocabulary) + 1, DIM), "tri": 0.1 * size(TRIGRAMS, DIM), "att": size(h, 2 * h), "att_b": np.zeros((h, 1), np.float32), "att_v": size(1, h), "out": size(1, 2 * h), "out_b": np.full((1, 1), -1, np.float32)}
        self.p["word"][:-1, 0] = lean
        for d in "fb":
            self.p |= {f"{d}_in": size(3 * h, 2 * DIM), f"{d}_b": np.zeros((3 * h, 1), np.float32), f"{d}_u": size(3 * h, h)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """(words, 2 DIM): word embedding and mean trigram embedding of each word."""
        ids = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words])
        tri, begin = trigrams(words)
        counts = np.diff(np.append(begin, len(tri)))
        mean = np.add.reduceat(self.p["tri"][tri], begin, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], mean], axis=1), (ids, tri, counts)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the recurrent layers take of each word: (words, 6 HIDDEN)."""
        return np.concatenate([x @ self.p[f"{d}_in"].T + self.p[f"{d}_b"].T for d in "fb"], axis=1).astype(np.float32)

    def recur(self, d: str, x: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (steps, HIDDEN, windows) of one direction; x: (steps, 3 HIDDEN, windows), mask: (steps, windows)."""
        h, u = HIDDEN, self.p[f"{d}_u"]
        out = np.empty((len(x), h, x.shape[2]), np.float32)
        state = np.zeros((h, x.shape[2]), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            g = u @ state
            rz = x[t, : 2 * h] + g[: 2 * h]
            np.negative(rz, out=rz)
            np.exp(rz, out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            r, z = rz[:h], rz[h:]
            n = np.tanh(x[t, 2 * h :] + r * g[2 * h :])
            new = n + z * (state - n)
            if trace is not None:
                trace.append((t, state, r, z, n, g[2 * h :]))
            state = new if mask[t].all() else np.where(mask[t], new, state)
            out[t] = state
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Attention over the steps: logits (windows), and what the backward pass needs. states: (2 HIDDEN, steps, windows)."""
        flat = states.reshape(2 * HIDDEN, -1)
        act = np.tanh(self.p["att"] @ flat + self.p["att_b"])
        score = np.where(mask, (self.p["att_v"] @ act).reshape(mask.shape), -1e9)
        weight = np.exp(score - score.max(axis=0)) * mask
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        context = np.einsum("dtw,tw->dw", states, weight)
        return (self.p["out"] @ context + self.p["out_b"])[0], act, weight, context

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """x: (steps, 6 HIDDEN, windows)."""
        both = [self.recur(d, x[:, i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN], mask) for i, d in enumerate("fb")]
        return self.pool(np.ascontiguousarray(np.concatenate(both, axis=1).transpose(1, 0, 2)), mask)[0]

    def _back(self, d: str, trace: list, dout: np.ndarray, mask: np.ndarray, grad: dict) -> np.ndarray:
        h, u = HIDDEN, self.p[f"{d}_u"]
        dx = np.zeros((dout.shape[0], 3 * h, dout.shape[2]), np.float32)
        carry = np.zeros(dout.shape[1:], np.float32)
        for t, state, r, z, n, gn in reversed(trace):
            total = carry + dout[t]
            live = np.where(mask[t], total, 0)
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (state - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx[t] = np.concatenate([dr, dz, dn])
            dg = np.concatenate([dr, dz, dn * r])
            grad[f"{d}_u"] += dg @ state.T
            carry = u.T @ dg + live * z + np.where(mask[t], 0, total)
        return dx

    def gradients(self, words: list[str], index: np.ndarray, mask: np.ndarray, owner: np.ndarray, y: np.ndarray, soft: bool) -> tuple[dict, float]:
        """Of the mean loss over texts; index, mask: (windows, WINDOW), owner: the text of each window."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        raw, (ids, tri, counts) = self.inputs(words)
        x = np.ascontiguousarray(self.project(raw)[index].transpose(1, 2, 0))
        mask = mask.T
        traces: dict[str, list] = {"f": [], "b": []}
        both = [self.recur(d, x[:, i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN], mask, traces[d]) for i, d in enumerate("fb")]
        states = np.ascontiguousarray(np.concatenate(both, axis=1).transpose(1, 0, 2))
        logit, act, weight, context = self.pool(states, mask)
        top = np.full(len(y), -1e9)
        np.maximum.at(top, owner, logit)
        part = np.exp(logit - top[owner]) if soft else (logit == top[owner]).astype(float)
        part /= np.bincount(owner, part, len(y))[owner]
        text = np.bincount(owner, part * logit, len(y))
        p = _sigmoid(text)
        loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        dl = (((p - y) / len(y))[owner] * part).astype(np.float32)[None, :]
        grad["out"], grad["out_b"] = dl @ context.T, dl.sum(keepdims=True)
        dcontext = self.p["out"].T @ dl
        dstates = dcontext[:, None, :] * weight[None]
        dweight = np.einsum("dtw,dw->tw", states, dcontext)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        flat = dscore.reshape(1, -1)
        grad["att_v"] = flat @ act.T
        dact = self.p["att_v"].T @ flat * (1 - act * act)
        grad["att"], grad["att_b"] = dact @ states.reshape(2 * HIDDEN, -1).T, dact.sum(axis=1, keepdims=True)
        dstates += (self.p["att"].T @ dact).reshape(dstates.shape)
        draw = np.zeros_like(raw)
        for i, d in enumerate("fb"):
            dout = np.ascontiguousarray(dstates[i * HIDDEN : (i + 1) * HIDDEN].transpose(1, 0, 2))
            dx = self._back(d, traces[d], dout, mask, grad)
            each = np.zeros((len(words), 3 * HIDDEN), np.float32)
            np.add.at(each, index.T.ravel(), dx.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN))
            grad[f"{d}_in"], grad[f"{d}_b"] = each.T @ raw, each.sum(axis=0)[:, None]
            draw += each @ self.p[f"{d}_in"]
        np.add.at(grad["word"], ids, draw[:, :DIM])
        np.add.at(grad["tri"], tri, np.repeat(draw[:, DIM:] / counts[:, None].astype(np.float32), counts, axis=0))
        return grad, float(loss)


def laid_out(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """index and mask (windows, WINDOW) into word numbers, and the text of each window."""
    spans = [(i, a, ids) for i, ids in enumerate(texts) for a in windows(len(ids))]
    index, mask = np.zeros((len(spans), WINDOW), np.int64), np.zeros((len(spans), WINDOW), bool)
    for row, (_, a, ids) in enumerate(spans):
        part = ids[a : a + WINDOW]
        index[row, : len(part)] = part
        mask[row, : len(part)] = True
    return index, mask, np.array([i for i, _, _ in spans])


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Network | float:
    """A trained network, or the share of label 1 where there is only one label."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    order = np.random.default_rng(3).permutation(len(y))
    split = [words_of(texts[i]) for i in order]
    y = y[order]
    counts: dict[str, list[int]] = {}
    for words, label in zip(split, y.astype(int), strict=True):
        for w in set(words):
            counts.setdefault(w, [0, 0])[label] += 1
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    names = sorted(w for w, c in counts.items() if sum(c) >= 3)
    c = np.array([counts[w] for w in names], float).reshape(-1, 2)
    rate = c.sum(axis=1) / (n0 + n1)
    z = (c[:, 1] / n1 - c[:, 0] / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-6) * (1 / n0 + 1 / n1))
    # words whose difference chance may explain have no embedding of their own: a small sample would be learned by heart
    told = np.flatnonzero(np.abs(z) >= SURE)
    vocabulary = {names[i]: k for k, i in enumerate(told)}
    net = Network(vocabulary, (np.sign(z[told]) * np.minimum(np.abs(z[told]) / SURE, 2)).astype(np.float32))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng, step = np.random.default_rng(4), 0
    rounds = max(epochs, -(-60 * BATCH // len(y)))
    for epoch in range(rounds):
        # batches of even parts; the rarer label comes up more often
        size = max(len(pos), len(neg))
        mixed = np.stack([np.resize(rng.permutation(k), size) for k in (pos, neg)], axis=1).ravel()[: max(2 * len(y), 4 * BATCH)]
        for a in range(0, len(mixed), BATCH):
            chosen = mixed[a : a + BATCH]
            known: dict[str, int] = {}
            ids = [[known.setdefault(w, len(known)) for w in split[i]] for i in chosen]
            index, mask, owner = laid_out(ids)
            grad, _ = net.gradients(list(known) or ["\0"], index, mask, owner, y[chosen], epoch < (rounds + 1) // 2)
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                rate = 0.01 * (1 - 0.9 * epoch / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                net.p[k] -= (rate * (first[k] / (np.sqrt(second[k]) + 1e-8) + DECAY * net.p[k])).astype(np.float32)
    return net


class Scorer:
    """Scores texts; the inputs of words are kept between batches, up to KEPT words."""

    def __init__(self, model: Network | float):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if isinstance(self.model, float):
            return np.full(len(texts), self.model)
        split = [words_of(t) for t in texts]
        if len(self.rows) > KEPT:
            self._clear()
        unseen = list(set().union(*split).difference(self.rows)) if split else []
        if unseen or not len(self.table):
            unseen = unseen or ["\0"]
            self.rows.update(zip(unseen, range(len(self.rows), len(self.rows) + len(unseen)), strict=True))
            fresh = self.model.project(self.model.inputs(unseen)[0])
            used = len(self.rows) - len(unseen)
            if len(self.rows) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), len(self.rows)), 6 * HIDDEN), np.float32)
                grown[:used] = self.table[:used]
                self.table = grown
            self.table[used : len(self.rows)] = fresh
        look = self.rows.__getitem__
        sizes = np.array([len(w) for w in split], np.int64)
        flat = np.fromiter((look(w) for words in split for w in words), np.int64, sizes.sum())
        flat = np.append(flat, np.zeros(WINDOW, np.int64))
        base = np.cumsum(sizes) - sizes
        number = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
        owner = np.repeat(np.arange(len(split)), number)
        inside = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * STRIDE
        start, left = base[owner] + inside, sizes[owner] - inside
        out = np.full(len(split), -np.inf)
        # full windows first, so that only the last groups need masks
        order = np.argsort(-left, kind="stable")
        for a in range(0, len(order), 1024):
            part = order[a : a + 1024]
            steps = int(max(1, min(WINDOW, left[part].max())))
            at = np.arange(steps)
            mask = at[:, None] < left[part][None, :]
            x = self.table[flat[start[part][None, :] + at[:, None]]].transpose(0, 2, 1)
            np.maximum.at(out, owner[part], self.model.logits(np.ascontiguousarray(x), mask))
        return _sigmoid(out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> list:
    """The bounded sample (text, toxic) that is fitted."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    first = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(*by_hash).limit(LOOKED_AT)
        first = part if first is None else first.union(part)
    texts = docs.select("doc_id", "text").filter(F.length("text") <= LONGEST).join(F.broadcast(first), "doc_id")
    texts = shared_table(texts, "labelled-texts")  # documents are read once for both labels
    out = []
    for label in (0, 1):
        out += texts.filter(F.col("toxic") == label).orderBy(*by_hash, "text").limit(PER_LABEL).select("text", "toxic").collect()
    return out


def train(docs: DataFrame, labels: DataFrame) -> Network | float:
    rows = training_rows(docs, labels)
    model = fit([r.text for r in rows], [r.toxic for r in rows])
    rows = None
    give_back()
    return model


def scored(docs: DataFrame, model: Network | float, name: str = "score") -> DataFrame:
    """All columns of docs, and the score as the last; name: one that no other column has."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    place = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            found, texts, held = [np.zeros(0)], [], 0
            for text in batch.column(place):
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if len(texts) == TOGETHER or held >= CHARACTERS:
                    found.append(scorer.score(texts))
                    texts, held = [], 0
            found.append(scorer.score(texts) if texts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], [*batch.schema.names, name])

    return spread(docs).mapInArrow(lean(run), schema)


def query(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with its columns, whose score is under CUT."""
    score = free(docs, "score")
    return scored(docs, train(docs, labels), score).filter(F.col(score) < CUT).drop(score)
