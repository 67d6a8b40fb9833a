"""Garbled text from wrong character encodings: find it, name the chain, restore the original.

A chain is the encoding the bytes were written in and the one they were read in. A multinomial
classifier over hashed byte bigrams is trained on words of a bounded sample of the records, as they
are (class clean) and synthetically garbled by every chain. It decides each record: its words share
one chain, so a record's class is that whose words, each either clean or garbled by the chain, are
most likely; where that is class clean, the record is done. The chain is then inverted, and a word
counts as garbled only where the inversion decodes strictly and changes it.

An exact check follows, as rare correct characters look like garbled ones: the restored word must be
in the input often enough, or be far more likely text. The counts are those of the whole input.

Words recur, so their scores and inversions are kept by a worker and a record costs look-ups.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quireflow.session import cut

#: Records looked at to train; the sample is by hash of the key, so it is the same on every run.
SAMPLE_ROWS = 16_000
#: Longer records are left out of the sample (not of the search), which bounds what the driver collects.
SAMPLE_CHARS = 5_000
HASH_BITS = 16
#: How far behind clean a word of a garbled record may be in log probability.
SLACK = 12.0
#: How often a garbled word may occur against what its chain's rate lets expect; the gain in mean log probability that proves an unknown one.
TOLERANCE, MARGIN = 10.0, 2.5
#: How often a word may occur whose original is not known, in SAMPLE_ROWS records.
RARE = 3
#: The share of records garbled by a chain, before any was seen.
RATE = 0.002
ROUNDS = 3
#: How far behind the likeliest chain of a record others are considered, in log probability: some read alike.
WITHIN = 8.0
CAPITALS, CAPITAL_WORDS = 0.05, 1000
#: Words a worker remembers before it starts anew; only speed depends on it.
_REMEMBERED = 200_000

# Fixed values: (written in, read in, times).
CHAINS: list[tuple[str, str, int]] = [
    ("utf-8", "cp1252", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 1), ("utf-8", "latin-1", 2), ("utf-8", "iso8859-15", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1),
    ("utf-8", "mac-roman", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp1251", 2), ("utf-8", "cp1250", 1), ("utf-8", "iso8859-2", 1), ("utf-8", "koi8-r", 1), ("utf-8", "cp866", 1),
    ("cp1251", "cp1252", 1), ("cp1251", "latin-1", 1), ("cp1251", "koi8-r", 1), ("cp1251", "cp866", 1), ("koi8-r", "cp1251", 1), ("koi8-r", "cp1252", 1), ("koi8-r", "latin-1", 1),
    ("cp866", "cp1251", 1), ("cp866", "cp1252", 1), ("cp866", "latin-1", 1), ("iso8859-5", "cp1251", 1), ("iso8859-5", "cp1252", 1), ("cp1250", "cp1252", 1), ("cp1250", "latin-1", 1), ("iso8859-2", "cp1252", 1),
    ("iso8859-2", "latin-1", 1), ("iso8859-2", "cp1250", 1), ("cp1250", "iso8859-2", 1), ("cp852", "cp1252", 1), ("cp852", "cp1250", 1), ("mac-roman", "cp1252", 1), ("mac-roman", "latin-1", 1),
    ("cp437", "cp1252", 1), ("cp437", "latin-1", 1), ("cp850", "cp1252", 1), ("cp850", "latin-1", 1), ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("cp1252", "mac-roman", 1),
    ("cp1252", "cp1251", 1), ("cp1252", "cp1250", 1), ("cp1252", "latin-1", 1), ("cp1252", "koi8-r", 1), ("cp1252", "iso8859-15", 1), ("iso8859-15", "cp1252", 1), ("iso8859-15", "latin-1", 1),
]

#: The shares of its words that may be garbled in a garbled record, equally likely.
SHARES = (0.05, 0.5, 0.98)

_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_ODD = r"[^\x20-\x7e]"
_BOM = re.compile("þÿ|ÿþ")


def _table(codec: str) -> list[str]:
    """The character of each byte; bytes a code page leaves undefined are read as the control characters of Latin-1."""
    out = []
    for b in range(256):
        try:
            out.append(codecs.decode(bytes([b]), codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_READ = {c: _table(c) for c in {r for _, r, _ in CHAINS} | {w for w, _, _ in CHAINS if w != "utf-8"}}
_WRITE = {c: {ch: b for b, ch in reversed(list(enumerate(t)))} for c, t in _READ.items()}


def garble(word: str, chain: tuple[str, str, int]) -> str | None:
    """``word`` written and read by the chain; None where it cannot be written or does not change."""
    written, read, times = chain
    out = word
    for _ in range(times):
        if written == "utf-8":
            data = out.encode("utf-8", "replace")
        else:
            if not all(ch in _WRITE[written] for ch in out):
                return None
            data = bytes(_WRITE[written][ch] for ch in out)
        out = "".join(_READ[read][b] for b in data)
    return None if out == word else out


def invert(word: str, chain: tuple[str, str, int]) -> tuple[str, list[int]] | None:
    """(restored word, for each of its characters the number of characters it came from); None where nothing decodes strictly.

    Characters the reading encoding does not have were not garbled and stay as they are.
    """
    written, read, times = chain
    out, width = word, [1] * len(word)
    for _ in range(times):
        data = [_WRITE[read].get(ch, -1) for ch in out]
        new, spans = [], []
        i, changed = 0, False
        if written == "utf-8":
            raw = bytes(b if b >= 0 else 0 for b in data)
            while i < len(out):
                m = _SEQUENCE.match(raw, i) if raw[i] >= 0xC2 else None
                piece = None
                if m:
                    try:
                        piece = m[0].decode("utf-8")
                    except UnicodeDecodeError:
                        piece = None
                if piece is None:
                    new.append(out[i])
                    spans.append(width[i])
                    i += 1
                else:
                    new.append(piece)
                    spans.append(sum(width[i : m.end()]))
                    i, changed = m.end(), True
        else:
            for ch, b, w in zip(out, data, width, strict=True):
                to = _READ[written][b] if b >= 0 else ch
                changed |= to != ch
                new.append(to)
                spans.append(w)
        if not changed:
            return None
        out, width = "".join(new), spans
    return out, width


def _hashes(word: str) -> np.ndarray:
    """Buckets of the byte bigrams of a word between blanks; digits count as one."""
    b = np.frombuffer(b" " + re.sub(rb"[0-9]", b"0", word.encode("utf-8", "replace")) + b" ", np.uint8).astype(np.uint32)
    return ((b[:-1] * 257 + b[1:]) * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


def _form(word: str) -> str:
    return re.sub("[0-9]", "0", word)


@dataclass
class Model:
    """What the sample taught. Classes: log probabilities, one row a class, class 0 being clean, one
    column a bucket (13 MB whatever the input). Words: their counts as stored, bounded by the sample;
    they serve training only. Rates: the share of records garbled by each chain, which is its prior.
    Unit: what counts as one occurrence, as the limits are set for SAMPLE_ROWS records and grow with more."""

    weights: np.ndarray
    words: dict[str, int]
    rates: np.ndarray
    unit: float = 1.0

    def for_corpus(self, rates: np.ndarray, unit: float) -> Model:
        """The classifier with other rates and unit, and without the sample's counts."""
        return replace(self, words={}, rates=rates, unit=unit)

    def prior(self) -> np.ndarray:
        """How much likelier each chain is than clean before a record is seen, in log probability."""
        return np.log(self.rates) - log(1 - self.rates.sum())

    def likelihood(self, word: str) -> float:
        """Mean log probability of the word's bigrams in class clean, in capitals or not."""
        return max(float(self.weights[0, _hashes(w)].mean()) for w in {word, word.lower()})


class _Trainer:
    """Fits models on the same words with other weights: the words' garbled forms are hashed once.

    The most frequent words are there in capitals too, as few texts are written in them, with the weight CAPITALS."""

    def __init__(self, words: list[str], forms: dict[str, int]):
        self.words, self.forms = words, forms
        often = sorted(range(len(words)), key=lambda i: (-forms[words[i]], words[i]))[:CAPITAL_WORDS]
        capitals = [(i, u) for i in often if (u := words[i].upper()) != words[i]]
        self.of = np.r_[np.arange(len(words)), np.array([i for i, _ in capitals], int)]
        odd = words + [u for _, u in capitals]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        for chain in [None, *CHAINS]:
            owner, hashed = [], []
            for i, w in enumerate(odd):
                bad = w if chain is None else garble(w, chain)
                if bad is not None:
                    hashed.append(_hashes(bad))
                    owner.append(np.full(len(hashed[-1]), i))
            self.parts.append((np.concatenate([*owner, np.empty(0, int)]), np.concatenate([*hashed, np.empty(0, np.uint32)])))

    def fit(self, garbled: set[str], rates: np.ndarray) -> Model:
        n = np.array([0 if w in garbled else self.forms[w] for w in self.words], float)
        n = np.r_[n, n[self.of[len(n) :]] * CAPITALS]
        counts = np.array([np.bincount(h, n[o], 1 << HASH_BITS) for o, h in self.parts]) + 0.02
        weights = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
        return Model(weights, self.forms, rates)


def _had(restored: str, stored: str) -> str | None:
    """The restored text, None where characters are lost."""
    return None if "�" in restored or restored == stored else restored


def is_odd(word: str) -> bool:
    return not (word.isascii() and word.isprintable())


def _certain(word: str) -> bool:
    """Holds characters that no correct text has: replacement characters, C1 controls, NUL."""
    return any(ch == "�" or "\x80" <= ch <= "\x9f" or ch == "\0" for ch in word)


def _rates(found: np.ndarray, records: int) -> np.ndarray:
    """The rate of each chain from the records found of it (index 0 is no chain)."""
    return (found[1:] + 1) / (records + 1000)


def train(texts: list[str]) -> Model:
    """A model from records that are mostly correct, in a few rounds.

    The first takes as clean every word without impossible characters that no chain from UTF-8 decodes,
    and every chain as equally rare. Each later one leaves out the words found garbled so far and
    takes the rates found.
    """
    forms: dict[str, int] = {}
    records: list[list[str]] = []
    for t in texts:
        words = [_form(w) for w in t.split(" ")]
        for w in words:
            forms[w] = forms.get(w, 0) + 1
        records.append([w for w in words if is_odd(w)])
    odd = sorted({w for r in records for w in r if not _certain(w)})
    utf8 = [c for c in CHAINS if c[0] == "utf-8" and c[2] == 1]
    garbled = {w for w in odd if any(invert(w, c) for c in utf8)}
    rates = np.full(len(CHAINS), RATE)
    trainer = _Trainer(odd, forms)
    inverted: dict = {}
    for _ in range(ROUNDS):
        finder = Finder(trainer.fit(garbled, rates), inverted)
        found, garbled = np.zeros(len(CHAINS) + 1), set()
        for r in records:
            if k := finder.chain(r):
                found[k] += 1
                garbled.update(w for w in r if finder.garbled(w, k))
        rates = _rates(found, len(records))
    return trainer.fit(garbled, rates)


class Finder:
    """Finds the garbled words of records."""

    def __init__(self, model: Model, inverted: dict[tuple[str, int], tuple[str, list[int]] | None] | None = None):
        self.model, self.prior = model, model.prior()
        self.inverted = {} if inverted is None else inverted
        self.proofs: dict[tuple[str, int], int] = {}
        self.known: dict[str, np.ndarray] = {}
        self.leads: dict[str, np.ndarray | None] = {}
        self.gains: dict[tuple[str, int], float | None] = {}
        self.likelihoods: dict[str, float] = {}

    def _score(self, word: str) -> np.ndarray:
        """Log probability of the word in each class."""
        s = self.known.get(word)
        if s is None:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
                self.inverted.clear()
                self.proofs.clear()
                self.leads.clear()
                self.gains.clear()
                self.likelihoods.clear()
            s = self.known[word] = self.model.weights[:, _hashes(word)].sum(1)
        return s

    def lead(self, word: str) -> np.ndarray | None:
        """How much likelier the word is garbled by each chain than clean, in log probability; None where no chain is."""
        if word not in self.leads:
            s = self._score(word)
            more = s[1:] - s[0]
            for k in np.flatnonzero(more > 0):
                # a chain that does not decode strictly, or changes nothing, cannot have made the word
                if self.undo(word, int(k) + 1) is None:
                    more[k] = -np.inf
            self.leads[word] = more if (more > 0).any() else None
        return self.leads[word]

    def chains(self, words: list[str]) -> list[int]:
        """The chains by which a record of these odd words is likelier to be garbled than to be clean, the likeliest
        first, down to those WITHIN reach of it; none for a record of class clean."""
        leads = [x for w in words if (x := self.lead(w)) is not None]
        if not leads:
            return []
        d = np.array(leads)
        clean = len(words) - len(leads)
        each = [np.logaddexp(d + log(q), log(1 - q)).sum(0) + clean * log(1 - q) for q in SHARES]
        odds = np.logaddexp.reduce(each) - log(len(SHARES)) + self.prior
        order = np.argsort(-odds)
        return [int(k) + 1 for k in order[: int((odds > max(0.0, odds.max() - WITHIN)).sum())]]

    def undo(self, word: str, k: int) -> tuple[str, list[int]] | None:
        key = (word, k)
        if key not in self.inverted:
            self.inverted[key] = invert(word, CHAINS[k - 1])
        return self.inverted[key]

    def proof(self, word: str, k: int) -> int:
        """3 or 2 where the inversion is proved, 1 where it is plausible beside proved words, else 0.

        Proved: the restored word is in the input, so often that the chain's rate accounts for the
        times the stored one is there (3); or it is far likelier text, and the stored one no more frequent (2).
        """
        key = (word, k)
        if key not in self.proofs:
            counted = self.evidence(word, k)
            level = 0
            if counted is not None:
                m = self.model
                stored, restored, better = counted
                often = TOLERANCE * (3 if CHAINS[k - 1][0] == "utf-8" else 1)  # its sequences alone are rare by chance
                if restored > stored and restored * m.rates[k - 1] * often >= stored - m.unit:
                    level = 3
                elif better > MARGIN and stored <= max(RARE * m.unit, restored):
                    level = 2
                elif restored and restored >= stored or restored < m.unit and stored <= RARE * m.unit and better > 0:
                    level = 1
            self.proofs[key] = level
        return self.proofs[key]

    def gain(self, word: str, k: int) -> float | None:
        """How much likelier text the word is without the chain, in mean log probability; None where it is not near."""
        key = (word, k)
        if key not in self.gains:
            u = self.undo(word, k) if self.near(word, k) else None
            self.gains[key] = u and round(self._likelihood(u[0]) - self._likelihood(word), 6)
        return self.gains[key]

    def _likelihood(self, word: str) -> float:
        if word not in self.likelihoods:
            self.likelihoods[word] = self.model.likelihood(word)
        return self.likelihoods[word]

    def evidence(self, word: str, k: int) -> tuple[int, int, float] | None:
        """How often the stored and the restored word occur, and the gain; None where the word is not near."""
        gain = self.gain(word, k)
        return None if gain is None else (self.model.words.get(word, 0), self.model.words.get(self.undo(word, k)[0], 0), gain)

    def near(self, word: str, k: int) -> bool:
        """Whether a word of a record garbled by chain k may have been garbled by it."""
        s = self._score(word)
        return bool(s[k] > s[0] - SLACK) and self.undo(word, k) is not None

    def garbled(self, word: str, k: int) -> bool:
        """Whether a word of a record garbled by chain k was garbled by it."""
        return self.near(word, k) and self.proof(word, k) > 0

    def chain(self, words: list[str], classes: list[int] | None = None) -> int:
        """The chain (its number, 0 for none) of a record with these odd words: of those the classifier puts
        before clean (``classes``, where they are known), the one whose inversion proves most words garbled."""
        best, chosen = 0, 0
        for k in self.chains(words) if classes is None else classes:
            proofs = [self.proof(w, k) for w in words if self.garbled(w, k)]
            if max(proofs, default=0) > 1 and sum(proofs) > best:
                best, chosen = sum(proofs), k
        return chosen

    def look(self, text: str, classes: list[int] | None = None) -> tuple[np.ndarray, str, str | None, list[str] | None] | None:
        """(garbled or not of each character, chain, restored text or None where it is lost, for each character what is
        restored from it: a sequence's character at its first, nothing at the others); None for a correct text."""
        bom = _BOM.search(text)
        if bom and "\0" in text[bom.end() :]:
            bad = np.zeros(len(text), bool)
            bad[bom.start() :] = True
            order = "utf-16-be" if bom[0] == "þÿ" else "utf-16-le"
            data = bytes(_WRITE["cp1252"].get(ch, ord(ch) & 255) for ch in text[bom.end() :])
            name = f"{order} read as latin-1"
            try:
                tail = data.decode(order)
            except UnicodeDecodeError:
                return bad, name, None, None
            marks = [*text[: bom.start()], *[""] * (len(text) - bom.start())]
            i = bom.end()
            for ch in tail:
                marks[i] = ch
                i += 4 if ch > "\uffff" else 2
            return bad, name, "".join(marks), marks
        words = text.split(" ")
        odd = [w for w in words if is_odd(w)]
        if not odd:
            return None
        k = self.chain([_form(w) for w in odd], classes)
        bad = np.zeros(len(text), bool)
        at, marks = 0, list(text)
        for w in words:
            if is_odd(w):
                if k:
                    if self.garbled(_form(w), k):
                        u = invert(w, CHAINS[k - 1])
                        i = at
                        for ch, n in zip(u[0], u[1], strict=True):
                            if n > 1 or text[i] != ch:
                                bad[i : i + n] = True
                                marks[i : i + n] = [ch, *[""] * (n - 1)]
                            i += n
                for i, ch in enumerate(w):
                    if ch == "�" or "\x80" <= ch <= "\x9f" or ch == "\0":
                        bad[at + i] = True
            at += len(w) + 1
        if not bad.any():
            return None
        name = f"{CHAINS[k - 1][0]} read as {CHAINS[k - 1][1]}" + " twice" * (CHAINS[k - 1][2] > 1) if k else "lost"
        restored = "".join(marks)
        return bad, name, _had(restored, text), marks


class CountedFinder(Finder):
    """Judges records that the classifier found garbled, by counts over the whole input, which come with each record."""

    def judge(self, text: str, classes: list[int], hits: list[dict] | None) -> tuple[np.ndarray, str, str | None, list[str] | None] | None:
        """``look`` with the record's classes and evidence: per word a list of chain, stored, restored and better."""
        self.counted = {(h["form"], c["k"]): (c["stored"], c["restored"], c["better"]) for h in hits or () for c in h["chains"]}
        self.proofs.clear()
        return self.look(text, classes)

    def near(self, word: str, k: int) -> bool:
        return (word, k) in self.counted

    def evidence(self, word: str, k: int) -> tuple[int, int, float] | None:
        return self.counted.get((word, k))


def sample_texts(df: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """Texts with characters besides printable ASCII, at most ``rows`` of them, chosen by hash of key and text.

    The threshold of the hash lets twice ``rows`` pass of all rows, so a task sends its share of that
    and not its own best ``rows``. Counting the rows reads no column of a columnar table.
    """
    share = max(1, df.count() // (2 * rows))
    picked = df.where((F.pmod(F.xxhash64(key, text), F.lit(share)) == 0) & F.col(text).rlike(_ODD) & (F.length(text) <= SAMPLE_CHARS))
    return [r[0] for r in picked.select(text).limit(rows).collect()]


def word_counts(strings: DataFrame) -> DataFrame:
    """form, n: every word of ``text``, digits as one, and how often it occurs."""
    return strings.select(F.explode(F.split("text", " ")).alias("w")).groupBy(F.regexp_replace("w", "[0-9]", "0").alias("form")).agg(F.count(F.lit(1)).alias("n"))


FOUND = "text_object_id bigint, field_name string, item_no int, chain string, stored string, restored string"


def _classify(model: Broadcast[Model]):
    """Records (key, field, items, text, damaged) to those that are not clean: their chains, and the words each may have garbled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.value)
        for b in batches:
            rows, chains, words = [], [], []
            for i, (text, damaged) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                odd = [_form(w) for w in text.split(" ") if is_odd(w)]
                ks = finder.chains(odd)
                if ks or damaged:
                    rows.append(i)
                    chains.append(ks)
                    words.append([{"form": w, "k": k, "back": finder.undo(w, k)[0], "better": g} for k in ks for w in dict.fromkeys(odd) if (g := finder.gain(w, k)) is not None])
            kept = b.take(pa.array(rows, pa.int64()))
            word = pa.list_(pa.struct([("form", pa.string()), ("k", pa.int32()), ("back", pa.string()), ("better", pa.float64())]))
            yield pa.record_batch([*kept.columns[:3], pa.array(chains, pa.list_(pa.int32())), pa.array(words, word)], ["text_object_id", "field_name", "items", "ks", "words"])

    return run


_SUSPECTS = "text_object_id bigint, field_name string, items array<string>, ks array<int>, words array<struct<form:string,k:int,back:string,better:double>>"


def find_garbled(text_objects: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each garbled string of text_buffer and buffer: key, field, item, chain, stored and restored text.

    Needs text_object_id, text_buffer, buffer; other columns are ignored. The items of a buffer are
    judged together, so a sequence divided by a cut is found in both; of these the item with its
    first character gets the restored one. ``restored`` is null where characters of the item are lost for good. Null, empty and plain
    ASCII strings are never garbled, null keys are kept. Rows may repeat; an empty table gives none.
    """
    spark = text_objects.sparkSession
    pieces = text_objects.select(F.col("text_object_id").cast("bigint").alias("text_object_id"), "text_buffer", F.transform("buffer", lambda x: x["txt"]).alias("items"))
    whole = F.array_join(F.filter("items", lambda x: x.isNotNull()), "")
    texts = pieces.select("text_object_id", F.coalesce("text_buffer", whole).alias("t"))
    model = train(sample_texts(texts, "text_object_id", "t", sample_rows))
    both = [(F.lit("text_buffer"), F.col("text_buffer"), F.array("text_buffer")), (F.lit("buffer"), whole, F.col("items"))]
    fields = F.array(*[F.struct(f.alias("field_name"), i.alias("items"), t.alias("text")) for f, t, i in both])
    strings = pieces.select("text_object_id", F.explode(fields).alias("s")).select("text_object_id", "s.*").where(F.col("text").rlike(_ODD))
    seen = Observation()
    taught = spark.sparkContext.broadcast(model.for_corpus(model.rates, 1.0))
    damaged = F.col("text").rlike(r"[\x00\x{80}-\x{9f}\x{fffd}]").alias("damaged")
    suspects = cut(strings.select("*", damaged).observe(seen, F.count(F.lit(1)).alias("n")).mapInArrow(_classify(taught), _SUSPECTS))
    records = seen.get["n"]
    unit = max(1.0, records / SAMPLE_ROWS)
    # the check: how often the stored and the restored words are in the whole input
    pairs = suspects.select(F.explode("words").alias("w")).select("w.*").distinct()
    wanted = pairs.select(F.explode(F.array("form", "back")).alias("form")).distinct()
    counts = word_counts(strings).join(wanted, "form", "left_semi")
    of = lambda word, n: counts.select(F.col("form").alias(word), F.col("n").alias(n))
    counted = pairs.join(of("form", "stored"), "form").join(of("back", "restored"), "back", "left").fillna(0, ["restored"])
    per = counted.groupBy("form").agg(F.collect_list(F.struct("k", "stored", "restored", "better")).alias("chains"))
    # each record gets the evidence of its words; records of the same words are asked for once
    forms = F.array_distinct(F.transform("words", lambda w: w["form"]))
    marked = suspects.select("text_object_id", "field_name", "items", "ks", forms.alias("forms")).withColumn("h", F.xxhash64("forms"))
    asked = marked.where(F.size("forms") > 0).select("h", "forms").distinct().select("h", F.explode("forms").alias("form"))
    hits = asked.join(per, "form").groupBy("h").agg(F.collect_set(F.struct("form", "chains")).alias("hits"))
    judged = cut(marked.join(hits, "h", "left").select("text_object_id", "field_name", "items", "ks", "hits"))
    shared = spark.sparkContext.broadcast(model.for_corpus(model.rates, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = CountedFinder(shared.value)
        for b in batches:
            out: list[tuple] = []
            for key, field, items, ks, hits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if seen := finder.judge("".join(x for x in items if x), ks, hits):
                    if field == "text_buffer":
                        out.append((key, field, 0, seen[1], items[0], seen[2]))
                        continue
                    at = 0
                    for i, x in enumerate(items):
                        if x:
                            if seen[0][at : at + len(x)].any():
                                out.append((key, "buffer", i, seen[1], x, seen[3] and _had("".join(seen[3][at : at + len(x)]), x)))
                            at += len(x)
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["text_object_id", "field_name", "item_no", "chain", "stored", "restored"])

    return judged.mapInArrow(run, FOUND)
