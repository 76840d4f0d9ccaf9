"""Byte-pair encoding and decoding with a given vocabulary file.

A word's merges are found with a segment tree over the ranks of its adjacent
pairs. A leaf holds the rank of the pair that starts at its symbol, an inner node
the smaller key of its two children, where a key is (rank, position): the root is
the leftmost pair of lowest rank. A merge changes at most three leaves (the merged
pair, the pair before it and the one that ended in it), each a point update on the
path to the root, until the root holds no rank.

The trees of many words stand side by side in one array, a row each, so numpy does
a step of all words at once. Each distinct word is encoded once per Python worker
while it is in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanguard.llm.common import as_bytes, id_type, slices

NO_RANK = np.int64(1) << 62
#: Distinct words a worker keeps (some 300 bytes each); the cache starts anew when it is full.
CACHE_WORDS = 300_000
#: Words of more symbols are merged alone.
LONG = 512
#: Leaves of the trees that are worked on at a time.
LEAVES = 1 << 16
SLICE_BYTES = 1 << 20
#: Below, Unicode's letters and case are the same in every library in use.
SETTLED = 0x590
NEWER = re.compile(f"[^\\x00-{chr(SETTLED - 1)}]")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in symbols):
        symbols[b] = chr(256 + n)
    return symbols


def settled_pattern(pattern: str) -> re.Pattern:
    """The pattern with its Unicode classes, all inside brackets, spelled out."""

    def chars(test) -> str:
        return "".join(re.escape(c) for c in map(chr, range(SETTLED)) if test(c))

    classes = {
        r"\p{L}": chars(lambda c: unicodedata.category(c)[0] == "L"),
        r"\p{N}": chars(lambda c: unicodedata.category(c)[0] == "N"),
        r"\s": chars(lambda c: c in "\t\n\v\f\r \x85\xa0"),
    }
    for name, members in classes.items():
        pattern = pattern.replace(name, members)
    return re.compile(pattern)


class Vocabulary:
    """Ids, merges and text rules of a tokenizers file with word ends."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.path, self.end = path, model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.text = {i: t for t, i in [*ids.items(), *special.items()]}
        symbols = byte_symbols()
        self.first = np.array([ids[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[symbols[b] + self.end] for b in range(256)], np.int64)
        self.base = np.int64(max(self.text) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * int(self.base) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        rule = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = settled_pattern(rule["pattern"]["Regex"])
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in special) or r"(?!)")
        # Only the text rules are the library's work: it needs no copy of the vocabulary.
        rules = spec | {"added_tokens": [], "post_processor": None, "decoder": None, "model": model | {"vocab": {}, "merges": []}}
        self.library = Tokenizer.from_str(json.dumps(rules))
        self.table: dict[int, int] = {}

    def rank_of(self) -> dict[int, int]:
        """Ranks by pair, for one lookup at a time."""
        if not self.table:
            self.table = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self.table

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def words(self, text: str) -> list[str]:
        """Normalised words in order; special tokens stay as they are."""
        if not any(t in text for t in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part:
                out += [part] if part in self.special else self.split(part)
        return out

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.pieces.findall(text.lower())
        if not NEWER.search(text):
            # Case is mapped character by character, without the rule for a last sigma.
            normal = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if not NEWER.search(normal):  # composed letters and other cases may lie beyond
                return self.pieces.findall(normal)
        normal = self.library.normalizer.normalize_str(text)
        cuts = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [normal[a:b] for _, (a, b) in cuts]


class MergeTrees:
    """The segment trees of words with at most `width` symbols, a row each."""

    def __init__(self, vocabulary: Vocabulary, symbols: np.ndarray, lengths: np.ndarray):
        self.v, self.symbols = vocabulary, symbols
        n, width = symbols.shape
        self.width = width
        place = np.arange(width)
        self.next = np.where(place + 1 < lengths[:, None], place + 1, width)
        self.previous = np.broadcast_to(place - 1, (n, width)).copy()
        self.alive = place < lengths[:, None]
        self.tree = np.full((n, 2 * width), NO_RANK, np.int64)
        if width > 1:
            pair = place[:-1] + 1 < lengths[:, None]
            ranks = vocabulary.rank(symbols[:, :-1], symbols[:, 1:])
            self.tree[:, width : 2 * width - 1] = np.where(
                pair & (ranks < NO_RANK), ranks * width + place[:-1], NO_RANK
            )
        half = width // 2
        while half:
            below = self.tree[:, 2 * half : 4 * half]
            self.tree[:, half : 2 * half] = np.minimum(below[:, ::2], below[:, 1::2])
            half //= 2

    def update(self, rows: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        """Point updates: set leaves and the nodes above them."""
        node = at + self.width
        self.tree[rows, node] = keys
        while node.size and node[0] > 1:
            node = node >> 1
            self.tree[rows, node] = np.minimum(self.tree[rows, 2 * node], self.tree[rows, 2 * node + 1])

    def leaf(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The key of the pair that starts at a symbol."""
        after = self.next[rows, at]
        has = after < self.width
        ranks = self.v.rank(self.symbols[rows, at], self.symbols[rows, np.where(has, after, at)])
        return np.where(has & (ranks < NO_RANK), ranks * self.width + at, NO_RANK)

    def merge_all(self) -> None:
        rows = np.flatnonzero(self.tree[:, 1] < NO_RANK)
        while rows.size:
            rank, at = np.divmod(self.tree[rows, 1], self.width)
            gone = self.next[rows, at]
            after = self.next[rows, gone]
            self.symbols[rows, at] = self.v.merged[rank]
            self.alive[rows, gone] = False
            self.next[rows, at] = after
            inside = after < self.width
            self.previous[rows[inside], after[inside]] = at[inside]
            self.update(rows, gone, np.full(rows.size, NO_RANK))
            self.update(rows, at, self.leaf(rows, at))
            before = self.previous[rows, at]
            some = before >= 0
            self.update(rows[some], before[some], self.leaf(rows[some], before[some]))
            rows = rows[self.tree[rows, 1] < NO_RANK]


def merge_long(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The same for one long word, step by step: its many merges would leave arrays of one row."""
    n = len(symbols)
    width = 1 << (n - 1).bit_length()
    none = int(NO_RANK)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    base, ranks, merged = int(v.base), v.rank_of(), v.merged

    def leaf(at: int) -> int:
        rank = ranks.get(symbols[at] * base + symbols[after[at]]) if after[at] < n else None
        return none if rank is None else rank * width + at

    tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(at: int, key: int) -> None:
        node = at + width
        tree[node] = key
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] < none:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        symbols[at], alive[gone], after[at] = int(merged[rank]), False, after[gone]
        if after[at] < n:
            before[after[at]] = at
        update(gone, none)
        update(at, leaf(at))
        if before[at] >= 0:
            update(before[at], leaf(before[at]))
    return [s for s, there in zip(symbols, alive) if there]


def encode_words(v: Vocabulary, words: list[str]) -> list[bytes]:
    """The ids of each word, all merges done, as little-endian 32-bit integers."""
    raw = [w.encode() for w in words]
    lengths = np.array([len(b) for b in raw], np.int64)
    out = [b""] * len(words)
    widths = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(int)
    for width in np.unique(widths):
        same = np.flatnonzero(widths == width)
        if width > LONG:
            for i in same.tolist():
                ids = v.first[np.frombuffer(raw[i], np.uint8)].tolist()
                ids[-1] = int(v.last[raw[i][-1]])
                out[i] = np.array(merge_long(v, ids), "<u4").tobytes()
            continue
        step = max(1, LEAVES // int(width))
        for start in range(0, len(same), step):
            some = same[start : start + step]
            n = lengths[some]
            flat = np.frombuffer(b"".join(raw[i] for i in some), np.uint8)
            symbols = np.zeros((len(some), width), np.int64)
            inside = np.arange(width) < n[:, None]
            symbols[inside] = v.first[flat]
            ends = np.cumsum(n) - 1
            symbols[np.arange(len(some)), n - 1] = v.last[flat[ends]]
            trees = MergeTrees(v, symbols, n)
            trees.merge_all()
            ids = symbols[trees.alive].astype("<u4").tobytes()
            stops = (4 * np.cumsum(trees.alive.sum(1))).tolist()
            for i, a, b in zip(some.tolist(), [0, *stops], stops):
                out[i] = ids[a:b]
    return out


class Encoder:
    """Whole texts to ids and back, with the words seen so far."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        # All token texts in one array, each with a blank before it.
        tokens = [b" " + self.v.text.get(i, "").encode() for i in range(int(self.v.base))]
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.start()

    def start(self) -> None:
        ids = {t: np.array([i], "<u4").tobytes() for t, i in self.v.special.items()}
        self.cache: dict[str, bytes] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.v.words(t) for t in texts]
        new = list(set().union(*split).difference(self.cache)) if split else []
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.start()
            new = list(set().union(*split).difference(self.cache))
        self.cache.update(zip(new, encode_words(self.v, new)))
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        """Token texts joined by blanks, special tokens included, in UTF-8."""
        token = np.frombuffer(ids, "<u4")
        sizes = self.sizes[token]
        shift = self.starts[token] - (np.cumsum(sizes) - sizes)
        return self.letters[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes()[1:]


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text whole: the id and `ids`, an array of token ids.

    A null text counts as empty and gives no ids; ids of rows may be null or
    repeat. `vocabulary` is the path of a tokenizers file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE_BYTES):
            packed = encoder(vocabulary).encode([b.decode() for b in as_bytes(batch.column(1))])
            ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type(docs, id_col)}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The decoded text of each row's ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            texts = [encoder(vocabulary).decode(p).decode() for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = rows.mapInArrow(run, f"id {id_type(encoded, id_col)}, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the number of ids and the digests of ids and decoded text.

    Encodes and decodes as `encode_texts` and `decode_ids` do, without handing the
    ids of whole texts to the JVM in between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in slices(batches, 1, SLICE_BYTES):
            packed = e.encode([b.decode() for b in as_bytes(batch.column(1))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(e.decode(p)).hexdigest() for p in packed], pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(
        run, f"id {id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)
