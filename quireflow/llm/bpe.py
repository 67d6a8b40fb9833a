"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts are split by the tokenizer's pattern; the distinct pieces of a batch are encoded together.
Pieces of similar length, however long, share a padded matrix of token ids beside the matrix of their
pairs' ranks. Each round merges the leftmost pair of minimum rank in every row; the two pairs that
changed are looked up by hash. The matrices stand still: a token's neighbours are kept beside it and
the least rank of each block of columns is kept too, so a round costs a row about the square root of its
width. Rows without a mergeable pair leave the matrix (compaction).
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int32(2**30)
#: Cells of a matrix; bounds memory only.
_CELLS = 1 << 19
#: Distinct pieces a worker remembers before it starts anew; only speed depends on it.
_REMEMBERED = 400_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class Merges:
    """The merges of a tokenizer as arrays: small enough to broadcast (under 10 MB), bounded by the vocabulary."""

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        """``rank`` of each pair, ``made`` the token that a rank makes."""
        self.byte_ids, self.made = byte_ids.astype(np.int32), made.astype(np.int32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = int(len(keys) * 4 - 1).bit_length()
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            free = self.keys[at] == np.uint64(2**64 - 1)
            won = np.zeros(len(todo), bool)
            won[np.unique(at, return_index=True)[1]] = True
            put = free & won
            self.keys[at[put]], self.ranks[at[put]] = keys[todo[put]], rank[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    @classmethod
    def load(cls, path: str | Path) -> Merges:
        """From a tokenizer file of byte-level BPE, JSON or ranks (``.tiktoken``); other kinds are refused."""
        if str(path).endswith(".tiktoken"):
            return cls._of_ranks(path)
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model, split = file["model"], file.get("pre_tokenizer") or {}
        plain = file.get("normalizer") is None and not any(model.get(k) for k in ("ignore_merges", "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback"))
        if model.get("type") != "BPE" or not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level BPE without normalisation")
        vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = lambda words: np.array([vocabulary[w] for w in words], np.int64)
        return cls(ids(_byte_letters()), ids(a for a, _ in pairs), ids(b for _, b in pairs), np.arange(len(pairs)), ids(a + b for a, b in pairs))

    @classmethod
    def _of_ranks(cls, path: str | Path) -> Merges:
        """Any two tokens whose bytes together are a token may merge; that token's rank is its id."""
        ids = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        triples = [(ids[w[:i]], ids[w[i:]], rank) for w, rank in ids.items() for i in range(1, len(w)) if w[:i] in ids and w[i:] in ids]
        left, right, rank = np.array(triples, np.int64).T
        return cls(np.array([ids[bytes([b])] for b in range(256)]), left, right, rank, np.arange(max(ids.values()) + 1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where there is no such merge or one side is padding (-1)."""
        shape = left.shape
        a, b = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        at = self._slot(keys[todo])
        for _ in range(self.probes):
            if not len(todo):
                break
            have = self.keys[at]
            hit = have == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (have != np.uint64(2**64 - 1))
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def _rows(self, pieces: list[bytes], bits: int) -> list[np.ndarray]:
        """Ids of pieces, none longer than 2^bits."""
        n, block = len(pieces), 1 << (bits + 1) // 2
        length = np.array([len(p) for p in pieces])
        width = -(-(int(length.max()) + 1) // block) * block
        blocks = width // block
        cols = np.arange(width)
        inside = cols < length[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        # flat places: row * width + column; a row's last column is never a token and stands for its end
        ids, ranks = ids.ravel(), ranks.ravel()
        right = np.arange(1, n * width + 1)
        left = np.arange(-1, n * width - 1)
        least = ranks.reshape(n * blocks, block).min(1).reshape(n, blocks)
        spread = np.arange(block)
        rows = np.arange(n)
        while len(rows):
            nearest = least[rows].argmin(1)
            start = rows * width + nearest * block
            keep = least[rows, nearest] != _NONE
            if not keep.all():
                rows, start = rows[keep], start[keep]
                if not len(rows):
                    break
            at = start + ranks[start[:, None] + spread].argmin(1)
            gone = right[at]
            after = right[gone]
            ids[at] = self.made[ranks[at]]
            ids[gone], ranks[gone] = -1, _NONE
            right[at], left[after] = after, at
            first = at == rows * width
            before = np.where(first, at, left[at])
            pair = self.rank(np.concatenate([ids[at], np.where(first, -1, ids[before])]), np.concatenate([ids[after], ids[at]]))
            ranks[before[~first]] = pair[len(rows) :][~first]
            ranks[at] = pair[: len(rows)]
            for place in (at, gone, before):
                changed = (place - rows * width) // block
                least[rows, changed] = ranks[(rows * width + changed * block)[:, None] + spread].min(1)
        ids = ids.reshape(n, width)
        kept = ids >= 0
        return np.split(ids[kept], np.cumsum(kept.sum(1))[:-1])

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of every piece, in the order given."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        for bits, members in buckets.items():
            many = max(1, _CELLS >> bits)
            for k in range(0, len(members), many):
                some = members[k : k + many]
                for i, ids in zip(some, self._rows([pieces[i] for i in some], bits), strict=True):
                    out[i] = ids
        return out


class _Codes(dict):
    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        return code


class Encoder:
    """Encodes batches of texts and remembers the pieces it has seen."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges, self.split = merges, regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.codes, self.known = _Codes(), 0
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        fresh = list(self.codes)[self.known :]
        if not fresh:
            return
        ids = self.merges.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh])
        size = np.array([len(x) for x in ids])
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, *ids])
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.known = len(self.codes)

    def encode(self, texts: list[str | None], only_sizes: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts behind each other, number of ids of each text); null and empty texts have none."""
        if len(self.codes) > _REMEMBERED or len(self.flat) > 8 * _REMEMBERED:
            self._reset()
        code_of, pieces, counts = self.codes.__getitem__, [], []
        for text in texts:
            before = len(pieces)
            if text:
                pieces.extend(map(code_of, self.split(text)))
            counts.append(len(pieces) - before)
        self._learn()
        codes, counts = np.array(pieces, np.int64), np.array(counts, np.int64)
        size = self.size[codes] if len(codes) else np.empty(0, np.int64)
        ends = np.r_[0, np.cumsum(size)]
        last = np.cumsum(counts)
        n = ends[last] - ends[last - counts]
        if only_sizes:
            return np.empty(0, np.int32), n
        place = np.repeat(self.start[codes] - ends[:-1], size) + np.arange(ends[-1]) if len(codes) else np.empty(0, np.int64)
        return self.flat[place], n


def _slices(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text, so that long texts do not pile up in one step."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    group = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), len(size)]
    yield from ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json", only_sizes: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens) with ``only_sizes``: ids without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty
    list (0 tokens). Rows with a null key and repeated rows are kept. Columns besides the two are not
    read. The tokenizer file is read by the driver only; one that is no byte-level BPE is refused.
    """
    shared = df.sparkSession.sparkContext.broadcast(Merges.load(tokenizer))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            for lo, hi in _slices(b.column(1)):
                part = b.slice(lo, hi - lo)
                flat, n = encoder.encode(part.column(1).to_pylist(), only_sizes)
                if only_sizes:
                    yield pa.record_batch([part.column(0), pa.array(n, pa.int64())], ["key", "n_tokens"])
                else:
                    offsets = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
                    yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], ["key", "ids"])

    value = "n_tokens bigint" if only_sizes else "ids array<int>"
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"key {kind}, {value}").withColumnRenamed("key", key)


def token_bytes(path: str | Path) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file; special tokens and gaps have none."""
    if str(path).endswith(".tiktoken"):
        ids = {int(rank): base64.b64decode(word) for word, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    else:
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        vocabulary = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
        ids = {i: bytes(byte_of[ch] for ch in word) for word, i in vocabulary.items() if all(ch in byte_of for ch in word)}
    return [ids.get(i, b"") for i in range(max(ids) + 1)]


def decode_corpus(df: DataFrame, key: str, ids: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(key, text) of every row: what the ids stand for, U+FFFD for bytes that are no UTF-8. Null ids give null, empty ones the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(token_bytes(tokenizer))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for b in batches:
            texts = [None if row is None else b"".join(map(of.__getitem__, row)).decode("utf-8", "replace") for row in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
