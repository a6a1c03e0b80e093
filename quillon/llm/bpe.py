"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 16 bytes meets a mask, so that copies and shared passages give the same
chunks wherever they stand. The inner part of a chunk, between its first and last white space, is encoded once for all
documents a worker process meets and kept by a 128-bit digest. Chunk joins are repaired by re-encoding the stretch over
each cut, from the last white space before it to the first after it, which grows over whole chunks until both its ends
are white space: the pre-tokenizer drops white space and never crosses it, so the joined ids then agree exactly with
those of the whole text. A vocabulary file whose normalizer or pre-tokenizer isn't of this kind is refused.

Inside a stretch, words are split into pieces by array operations over a slice of texts; each distinct piece is encoded
once by the library's model and kept, and words with other than ASCII and Latin-1 letters go to the library as they are.
The stores have fixed sizes and are emptied when full. They are shared by the tasks of a worker process, not between
processes: ids weigh as much as the texts they come from, so sending them would cost more than encoding again.

Defined cases: null and empty texts have no ids and decode to the empty string; rows are independent, so repeated rows
get equal results; very long texts are encoded in parts that end at white space; an empty table gives an empty result;
other columns are ignored. The vocabulary is read from a path.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.bytehash import between, mixed, prefix, slices
from quillon.llm.common import lean, spread

#: One cut in about this many bytes; bytes of texts that are encoded together.
CHUNK, SLICE = 512, 1 << 20
#: Bounds on what a worker process keeps: distinct pieces, chunks, and ids of either.
PIECES, CHUNKS, IDS = 1_000_000, 100_000, 8_000_000
#: Words of more bytes than this are kept by their digest.
LONG = 64
_GEAR = np.random.default_rng(5).integers(0, 1 << 16, 256, dtype=np.uint16)
#: What the file has to say of its normalizer and pre-tokenizer.
NORMAL = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, LETTER, DIGIT, OTHER, FOREIGN = range(5)
_CLASS = np.full(256, FOREIGN, np.uint8)
_CLASS[33:127] = OTHER
_CLASS[[32, 9, 10, 13]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start[i] : start[i] + size[i]], one after the other."""
    total = int(size.sum())
    return flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)]


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts are cut: places that depend on the 16 bytes before them in their text only, and never split a character."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            later = h.copy()
            later[k:] += h[:-k] << np.uint16(k)
            h = later
    at = np.flatnonzero(h[:-1] < (1 << 16) // CHUNK) + 1
    begin = offsets[np.searchsorted(offsets, at, "right") - 1]
    return at[((raw[at] & 0xC0) != 0x80) & (at - begin >= 16)]


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, is the inner part of a chunk) of the stretches of all texts in order; each ends in white space or its text."""
    sizes = np.diff(offsets)
    edges = np.unique(np.concatenate([cuts(raw, offsets), offsets]))
    a, b = edges[:-1], edges[1:]
    spaces = np.flatnonzero(_CLASS[raw] == SPACE)
    low, high = np.searchsorted(spaces, a), np.searchsorted(spaces, b) - 1
    opens, closes = np.isin(a, offsets), np.isin(b, offsets)
    sound = (low <= high) | (opens & closes)
    held = np.append(spaces, 0)
    first = np.where(opens, a, held[np.minimum(low, len(spaces))])[sound]
    last = np.where(closes, b, held[np.maximum(high, 0)])[sound]
    # what lies between the inner parts of a text, and beside them
    texts = offsets[:-1][sizes > 0], offsets[1:][sizes > 0]
    gap_a, gap_b = np.concatenate([texts[0], last]), np.concatenate([first, texts[1]])
    gap_a, gap_b = np.sort(gap_a), np.sort(gap_b)
    begin, end = np.concatenate([gap_a, first]), np.concatenate([gap_b, last])
    inner = np.arange(len(begin)) >= len(gap_a)
    keep = begin < end
    order = np.argsort(begin[keep], kind="stable")
    return begin[keep][order], end[keep][order], inner[keep][order]


class Coder:
    """Encodes and decodes texts; the ids of pieces and chunks are kept between texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        said = json.loads(self.library.to_str())
        normal = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        split = ((said["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        suffix = said["model"].get("end_of_word_suffix")
        if normal != NORMAL or split != PATTERN or not suffix or said["decoder"] or said["post_processor"]:
            raise ValueError("chunks can only be joined where words are split at white space and end in a mark of their own")
        self.specials = tuple(x.content.encode() for x in self.library.get_added_tokens_decoder().values())
        if not all(s.startswith(b"<|") for s in self.specials):
            raise ValueError("an added token doesn't begin with <|")
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, False, False)])
        size = self.library.get_vocab_size()
        names = [self.library.id_to_token(i) for i in range(size)]
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.array([t.endswith(suffix) for t in names])
        self.written = [self._table([str(i) for i in range(size)]), self._table(names)]
        self._forget_pieces()
        self._forget_chunks()

    @staticmethod
    def _table(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [n.encode() + b" " for n in names]
        size = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    def _forget_pieces(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def _forget_chunks(self) -> None:
        self.chunks: dict[bytes, int] = {}
        self.chunk_at, self.chunk_n = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.chunk_ids, self.chunk_used = np.zeros(1 << 16, self.kind), 0

    def _learn(self, keys: np.ndarray, raw: np.ndarray, a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> None:
        """Encode new pieces raw[a:b]; whole: words that the library takes as they are."""
        parts, sizes = [], []
        if not whole.all():
            size = (b - a + 1)[~whole]
            text = ragged(np.append(raw, np.uint8(32)), a[~whole], size)
            text[np.cumsum(size) - 1] = 32
            ids = np.array(self.plain.encode_batch_fast([text.tobytes().decode()])[0].ids, self.kind)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(size):
                raise ValueError("pieces and their marks don't agree")
            parts.append(ids)
            sizes.append(np.diff(stop, prepend=0))
        if whole.any():
            words = [raw[i:j].tobytes().decode() for i, j in zip(a[whole].tolist(), b[whole].tolist(), strict=True)]
            found = [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
            parts.append(np.array([i for ids in found for i in ids], self.kind))
            sizes.append(np.array([len(ids) for ids in found]))
        ids, size = np.concatenate(parts), np.concatenate(sizes)
        keys = np.concatenate([keys[~whole], keys[whole]])
        at = self.used + np.cumsum(size) - size
        self.ids, self.used = self._grown(self.ids, self.used, ids)
        place = np.argsort(keys)
        into = np.searchsorted(self.keys, keys[place])
        self.keys, self.at, self.n = (np.insert(old, into, new[place]) for old, new in ((self.keys, keys), (self.at, at), (self.n, size)))

    @staticmethod
    def _grown(store: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
        if used + len(more) > len(store):
            store = np.concatenate([store[:used], np.zeros(max(len(store), 2 * len(more)), store.dtype)])
        store[used : used + len(more)] = more
        return store, used + len(more)

    def _pieces(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each piece of raw begins, its place among the pieces known); pieces that aren't known yet are learned."""
        kind = _CLASS[raw]
        low = _LOWER[raw]
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[(raw[lead + 1] & 0xDF) != 0x97]  # not the signs of multiplication and division
        kind[lead] = kind[lead + 1] = LETTER
        low[lead[raw[lead + 1] < 0x9F] + 1] |= np.uint8(32)
        solid = kind != SPACE
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        word = np.flatnonzero(opens)
        closes = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
        odd = np.flatnonzero((kind == FOREIGN) | (raw == 39) | ((raw == 60) & (np.append(raw[1:], np.uint8(0)) == 124)))
        whole = np.zeros(len(word), bool)
        whole[np.searchsorted(word, odd, "right") - 1] = True
        whole |= closes - word > LONG
        starts = solid & (kind == DIGIT)
        starts[1:] |= solid[1:] & (kind[1:] != kind[:-1])
        starts |= opens
        for i, j in zip(word[whole].tolist(), closes[whole].tolist(), strict=True):
            starts[i + 1 : j] = False
            low[i:j] = raw[i:j]
        a = np.flatnonzero(starts)
        of = np.searchsorted(word, a, "right") - 1
        b = np.minimum(np.append(a[1:], len(raw)), closes[of])
        whole = whole[of]
        key = mixed(between(prefix(low), a, b))
        for k in np.flatnonzero(whole).tolist():
            key[k] = int.from_bytes(hashlib.blake2b(low[a[k] : b[k]].tobytes(), digest_size=8).digest(), "little")
        distinct, first, again = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        fresh = np.append(self.keys, np.uint64(0))[at] != distinct
        fresh |= at == len(self.keys)
        if fresh.any():
            k = first[fresh]
            self._learn(distinct[fresh], low, a[k], b[k], whole[k])
            at = np.searchsorted(self.keys, distinct)
        return a, at[again]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has) of texts that lie one after the other."""
        n_texts = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(n_texts, np.int64)
        if len(self.keys) > PIECES or self.used > IDS:
            self._forget_pieces()
        if len(self.chunks) > CHUNKS or self.chunk_used > IDS:
            self._forget_chunks()
        begin, end, inner = units(raw, offsets)
        # A unit is a chunk that is kept, or -1; of equal new chunks the first is encoded.
        data, digest, known = raw.tobytes(), hashlib.blake2b, self.chunks
        slot, new, n_old = np.full(len(begin), -1), ~inner, len(known)
        for k, i, j in zip(np.flatnonzero(inner).tolist(), begin[inner].tolist(), end[inner].tolist(), strict=True):
            name = digest(data[i:j], digest_size=16).digest()
            slot[k] = known.setdefault(name, len(known))
        fresh = np.flatnonzero(slot >= n_old)
        fresh = fresh[np.unique(slot[fresh], return_index=True)[1]]
        new[fresh] = True
        # New stretches side by side, a space after each.
        size = (end - begin)[new] + 1
        text = ragged(np.append(raw, np.uint8(32)), begin[new], size)
        edge = np.cumsum(size)
        text[edge - 1] = 32
        a, piece = self._pieces(text)
        n_ids = self.n[piece]
        ids = ragged(self.ids, self.at[piece], n_ids)
        per = np.bincount(np.searchsorted(edge, a, "right"), weights=n_ids, minlength=len(size)).astype(np.int64)
        where = np.zeros(len(begin), np.int64)
        count = np.zeros(len(begin), np.int64)
        where[new], count[new] = np.cumsum(per) - per, per
        if len(known) > len(self.chunk_at):
            self.chunk_at, self.chunk_n = (np.concatenate([x, np.zeros(len(known), np.int64)]) for x in (self.chunk_at, self.chunk_n))
        if len(fresh):
            self.chunk_at[slot[fresh]] = self.chunk_used + np.cumsum(count[fresh]) - count[fresh]
            self.chunk_n[slot[fresh]] = count[fresh]
            self.chunk_ids, self.chunk_used = self._grown(self.chunk_ids, self.chunk_used, ragged(ids, where[fresh], count[fresh]))
        old = ~new
        count[old] = self.chunk_n[slot[old]]
        kept = ragged(self.chunk_ids, self.chunk_at[slot[old]], count[old])
        where[old] = len(ids) + np.cumsum(count[old]) - count[old]
        out = ragged(np.concatenate([ids, kept]), where, count)
        of = np.searchsorted(offsets, begin, "right") - 1
        return out, np.bincount(of, weights=count, minlength=n_texts).astype(np.int64)

    def spelled(self, ids: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each id's end) of ids as decimal numbers (0) or as what they decode to (1), a space after each."""
        flat, at, size = self.written[table]
        return ragged(flat, at[ids], size[ids]), np.cumsum(size[ids])


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of this worker process."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def parts(raw: np.ndarray, offsets: np.ndarray):
    """A slice as it is, or a very long text in parts that end at white space: (bytes, offsets)."""
    if len(offsets) > 2 or len(raw) <= 2 * SLICE:
        yield raw, offsets
        return
    a = 0
    while a < len(raw):
        spaces = np.flatnonzero(_CLASS[raw[a + SLICE :]] == SPACE) if len(raw) - a > SLICE else ()
        b = a + SLICE + int(spaces[0]) if len(spaces) else len(raw)
        yield raw[a:b], np.array([0, b - a])
        a = b


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def described(code: Coder, raw: np.ndarray, offsets: np.ndarray, with_ids: bool) -> list[tuple]:
    """(number of ids, digest of the ids, digest of the decoded text, ids if asked for) of each text of a slice."""
    rows, n_texts = [], len(offsets) - 1
    hashes = [[hashlib.sha256() for _ in range(n_texts)] for _ in range(2)]
    total, all_ids = np.zeros(n_texts, np.int64), [[] for _ in range(n_texts)]
    for data, edges in parts(raw, offsets):
        ids, n = code.encode(data, edges)
        stop = np.cumsum(n)
        for table in range(2):
            out, ends = code.spelled(ids, table)
            ends = np.append(0, ends)
            view = memoryview(out)
            for t, (i, j) in enumerate(zip(ends[stop - n].tolist(), ends[stop].tolist(), strict=True)):
                if j > i:
                    if total[t]:
                        hashes[table][t].update(b" ")
                    hashes[table][t].update(view[i : j - 1])
        if with_ids:
            for t, (i, j) in enumerate(zip((stop - n).tolist(), stop.tolist(), strict=True)):
                all_ids[t] += ids[i:j].tolist()
        total += n
    for t in range(n_texts):
        rows.append((int(total[t]), hashes[0][t].hexdigest(), hashes[1][t].hexdigest(), all_ids[t]))
    return rows


def encode(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (an array)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        code = coder(path or default_path())
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if ids else 4]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
        for batch in batches:
            rows = [r for _, raw, offsets in slices(batch.column(1), SLICE) for r in described(code, raw, offsets, ids)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[: len(names) - 1], strict=False))], names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return spread(docs.select("doc_id", "text")).mapInArrow(lean(run), schema)


def query(spark, docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode(docs, path)
