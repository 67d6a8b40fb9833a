"""Languages of documents and of their passages, with confidences.

Method: hierarchical discrimination. A one-versus-rest linear support vector machine predicts the
language family of a sentence; inside the family, one-versus-one machines separate the languages.
All are trained here on hashed character n-grams and words of the sentences of a bounded sample of
labelled documents, in two rounds, the second without the sentences that contradict their label.

A sentence's score is the mean of its words' scores, so a worker scores each distinct word once.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents looked at to train, chosen by hash of the key.
SAMPLE_ROWS = 4_000
#: Longer documents are left out of the sample (not of the result), which bounds what the driver collects.
SAMPLE_CHARS = 20_000
#: A language counts in a document from this share of the words on.
SHARE = 0.18
#: Below this confidence a sentence may be overruled by its neighbours.
UNSURE = 0.6
HASH_BITS = 17
_REMEMBERED = 300_000

# Families and their languages.
FAMILIES: dict[str, tuple[str, ...]] = {"west germanic": ("de", "en", "nl"), "north germanic": ("da", "sv"), "romance": ("es", "fr", "it", "pt"), "slavic": ("pl", "ru")}
LANGUAGES = sorted(x for f in FAMILIES.values() for x in f)
# Other names of the languages, lower case.
NAMES = {
    "da": "dan danish", "de": "deu ger german", "en": "eng english", "es": "spa spanish", "fr": "fra fre french", "it": "ita italian",
    "nl": "nld dut dutch", "pl": "pol polish", "pt": "por portuguese", "ru": "rus russian", "sv": "swe swedish",
}
_PAIRS = [(a, b) for f in FAMILIES.values() for i, a in enumerate(f) for b in f[i + 1 :]]
_OF_FAMILY = [np.array([i for i, p in enumerate(_PAIRS) if p[0] in f]) for f in FAMILIES.values()]


def label_code(label: Column) -> Column:
    """The two-letter code a label stands for, in any spelling; null for a missing or meaningless one."""
    s = F.lower(F.trim(F.regexp_replace(label, r"^\s+|\s+$", "")))
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in [code, *names.split()] for x in (name, code)])
    return F.try_element_at(known, F.regexp_extract(s, r"^([a-z]+)(?:[-_][a-z0-9]{2,8})*$", 1))


# -- text to sentences ---------------------------------------------------------------------------

_FENCED = re.compile(r"^[> \t]*(~~~|```).*?(?:^[> \t]*\1[ \t]*$|\Z)", re.M | re.S)
_BLOCKS = re.compile(r"\[code[^\]]*\].*?(?:\[/code\]|\Z)|<(pre|code)\b[^>]*>.*?(?:</\1>|\Z)|\[(url|img)[^\]]*\].*?\[/\2\]", re.I | re.S)
_HEADER_TAG = re.compile(r"<b>[^<\n]{1,80}:</b>", re.I)
_BREAK = re.compile(r"</?(?:br|p|div|blockquote|li|tr)\b[^<>]*>|\[/?quote[^\]]*\]", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>|\[/?[a-z*]+(?:=[^\[\]\n]*)?\]|<\|[a-z_]+\|>", re.I)
_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+|@\w+|\([A-Z]\w+ \d+\)")
_QUOTED = re.compile(r"^(?:[ \t]{0,3}>)+ ?")
_RULE = re.compile(r"^(?:--|_{4,}|—)$")
_STAMP = re.compile(r"^[A-Z]{2}: ")
_STOP = re.compile(r"(?<=[.!?…])[\s ]+|[\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_FOREIGN = re.compile("[^A-Za-zÀ-ÖØ-öø-ɏЀ-ӿ'’]")
#: What stands for every language that is none of LANGUAGES by its letters.
OTHER = "und"


def sentences(text: str) -> list[list[str]]:
    """The sentences of a post as lists of lower-case words, without signature, code, markup, links and quote headers."""
    t = text.replace("\r\n", "\n").replace("\r", "\n").replace("​", "")
    t = _BLOCKS.sub(" ", _FENCED.sub("\n", t))
    t = _TAG.sub(" " if "<|" in t else "", _BREAK.sub("\n", _HEADER_TAG.sub("", t)))
    t = html.unescape(t)
    out: list[list[str]] = []
    skipped: int | None = None
    for line in t.split("\n"):
        mark = _QUOTED.match(line)
        depth = mark[0].count(">") if mark else 0
        body = line[mark.end() :] if mark else line
        if skipped is not None and depth >= skipped:
            continue  # still in the signature of this level of quotes
        skipped = None
        if body.startswith(("    ", "\t")):
            continue
        body = body.strip()
        if _RULE.match(body):
            skipped = depth
            continue
        if body.endswith(":") and len(body.split()) <= 4:
            continue
        for s in _STOP.split(_STAMP.sub("", _LINK.sub(" ", body))):
            words = [w.lower() for w in _WORD.findall(s)]
            known = [w for w in words if not _FOREIGN.search(w)]
            # a few foreign letters in a sentence are symbols; a sentence that is mostly foreign stays whole
            words = known if 2 * len(known) >= len(words) else words
            if any(len(w) > 1 for w in words):  # else a symbol or a unit
                out.append(words)
    return out


# -- features and machines -----------------------------------------------------------------------


def _features(word: str) -> np.ndarray:
    """Buckets of the word and of its character n-grams of one to four places."""
    w = f"^{word}$"
    grams = {word} | {w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)}
    return np.array(sorted({zlib.crc32(g.encode("utf-8", "replace")) >> (32 - HASH_BITS) for g in grams}), np.int64)


@lru_cache(100_000)
def plain_letters(word: str) -> str:
    """The word as careless typists write it, without accents."""
    for a, b in (("ß", "ss"), ("ø", "o"), ("æ", "ae"), ("ł", "l")):
        word = word.replace(a, b)
    return "".join(ch for ch in unicodedata.normalize("NFKD", word) if not unicodedata.combining(ch)) if not re.search("[а-яё]", word) else word


@dataclass
class Machines:
    """Weights of all machines, one column each: families, then pairs. 8 MB whatever the input."""

    weights: np.ndarray


def fit(texts: list[list[str]], labels: list[str], epochs: int = 30) -> Machines:
    """Linear support vector machines for sentences (lists of words) with their languages."""
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(w, len(index)) for s in texts for w in s])
    size = np.array([len(s) for s in texts])
    starts = np.cumsum(size) - size
    feats = [_features(w) for w in index]
    f_size = np.array([len(f) for f in feats])
    f_flat = np.concatenate(feats)
    f_starts = np.cumsum(f_size) - f_size
    used, f_flat = np.unique(f_flat, return_inverse=True)  # only the buckets that occur are trained

    target = np.zeros((len(texts), len(FAMILIES) + len(_PAIRS)), np.float32)
    lang = np.array(labels)
    for i, members in enumerate(FAMILIES.values()):
        target[:, i] = np.where(np.isin(lang, members), 1, -1)
    for i, (a, b) in enumerate(_PAIRS, len(FAMILIES)):
        target[:, i] = np.where(lang == a, 1, np.where(lang == b, -1, 0))
    # every machine gives both of its sides the same say
    weight = np.zeros_like(target)
    for sign in (1, -1):
        side = target == sign
        weight += side / np.maximum(1, side.sum(0))

    w = np.zeros((len(used), target.shape[1]), np.float32)
    seen = np.full_like(w, 1e-8)
    word_owner, feat_owner = np.repeat(np.arange(len(texts)), size), np.repeat(np.arange(len(index)), f_size)
    for _ in range(epochs):
        word_score = np.add.reduceat(w[f_flat], f_starts) / f_size[:, None]
        score = np.add.reduceat(word_score[flat], starts) / size[:, None]
        slack = -(target * weight * (target * score < 1)) / size[:, None]
        grad = np.empty_like(w)
        for j in range(w.shape[1]):
            per_word = np.bincount(flat, slack[word_owner, j], len(index)) / f_size
            grad[:, j] = np.bincount(f_flat, per_word[feat_owner], len(used))
        grad += 1e-7 * w
        seen += grad**2
        w -= 0.5 * grad / np.sqrt(seen)
    full = np.zeros((1 << HASH_BITS, w.shape[1]), np.float32)
    full[used] = w
    return Machines(full)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class Judge:
    """Languages of sentences and documents, many at a time."""

    def __init__(self, machines: Machines):
        self.machines = machines
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.vectors = np.empty((0, self.machines.weights.shape[1]), np.float32)

    def _scores(self, found: list[list[str]]) -> np.ndarray:
        """The mean score of each sentence's words, a column for each machine."""
        if len(self.codes) > _REMEMBERED:
            self._reset()
        code_of = self.codes.__getitem__
        flat = np.array([code_of(w) for s in found for w in s], np.int64)
        fresh = list(self.codes)[len(self.vectors) :]
        if fresh:
            self.vectors = np.concatenate([self.vectors, *[self.machines.weights[_features(w)].mean(0, keepdims=True) for w in fresh]])
        size = np.array([len(s) for s in found])
        return np.add.reduceat(self.vectors[flat], np.cumsum(size) - size) / size[:, None]

    def many(self, found: list[list[str]]) -> list[tuple[str, float]]:
        """(language, confidence) of each sentence: the family of the highest margin, then the language that
        wins most against its relatives, of several the one that wins most clearly. Sentences mostly of
        letters that no language here has are OTHER, as sure as the share of such words."""
        if not found:
            return []
        v = self._scores(found)
        k = len(FAMILIES)
        family = v[:, :k].argmax(1)
        two = np.partition(v[:, :k], k - 2, axis=1)[:, k - 2 :]
        confidence = 1 / (1 + np.exp(-2 * (two[:, 1] - two[:, 0])))
        langs = np.empty(len(found), object)
        for f, members in enumerate(FAMILIES.values()):
            rows = np.flatnonzero(family == f)
            wins, least = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), 9.0)
            for i in _OF_FAMILY[f]:
                margin = v[rows, k + i]
                for m, won in ((members.index(_PAIRS[i][0]), margin >= 0), (members.index(_PAIRS[i][1]), margin < 0)):
                    wins[won, m] += 1
                    least[won, m] = np.minimum(least[won, m], np.abs(margin[won]))
            best = (wins * 100 + np.minimum(least, 9)).argmax(1)
            langs[rows] = np.array(members, object)[best]
            confidence[rows] /= 1 + np.exp(-2 * least[np.arange(len(rows)), best])
        for i, words in enumerate(found):
            foreign = sum(1 for w in words if _FOREIGN.search(w))
            if 2 * foreign > len(words):
                langs[i], confidence[i] = OTHER, UNSURE * foreign / len(words)
        return list(zip(langs.tolist(), confidence.tolist(), strict=True))

    def sentence(self, words: list[str]) -> tuple[str, float]:
        return self.many([words])[0]

    def documents(self, texts: list[list[list[str]]]) -> list[list[tuple[str, float, int]]]:
        """(language, confidence, number of words) of each sentence of each document."""
        said = iter(self.many([s for found in texts for s in found]))
        return [_agreed([(*next(said), len(s)) for s in found]) for found in texts]

    def document(self, found: list[list[str]]) -> list[tuple[str, float, int]]:
        return self.documents([found])[0]


def _agreed(scored: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """The sentences of a document; an unsure one that no neighbour agrees with takes the language of the
    surer neighbour."""
    out = []
    for i, (lang, confidence, n) in enumerate(scored):
        beside = [scored[j] for j in (i - 1, i + 1) if 0 <= j < len(scored)]
        if beside and lang != OTHER and lang not in {x[0] for x in beside} and (confidence < UNSURE or n < 3 and confidence < 0.75):
            best = max(beside, key=lambda x: (x[1], x[0]))
            if best[1] > confidence:
                lang = best[0]
        out.append((lang, confidence, n))
    return out


def train(rows: list[tuple[str, str]]) -> Machines:
    """Machines from (text, language code) rows, some of which are wrong or mixed."""
    texts, labels = [], []
    for text, lang in rows:
        if lang in LANGUAGES:
            for s in sentences(text):
                if len(s) >= 3:
                    texts.append(s)
                    labels.append(lang)
    if not texts:
        texts, labels = [["a"]], [LANGUAGES[0]]
    said = Judge(fit(texts, labels, epochs=12)).many(texts)
    kept = [i for i, (lang, _) in enumerate(said) if lang == labels[i]] or list(range(len(texts)))
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    bare = [(t, x) for s, x in zip(texts, labels, strict=True) if (t := [plain_letters(w) for w in s]) != s]
    return fit(texts + [t for t, _ in bare], labels + [x for _, x in bare])


SPANS = "spans array<struct<lang:string,confidence:double,n_words:int>>"


def judge_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, label, spans): the code of the label or null, and the language of each passage in order.

    Adjacent sentences of one language are one passage. Sentences in other scripts than the languages'
    are passages in OTHER, of low confidence. Texts without a word (null, blank, symbols, links, code) have no passages. Repeated rows and null keys are kept; other columns are not read.
    """
    slim = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), label_code(F.col(f"`{label}`").cast("string")).alias("label"))
    # the threshold of the hash lets three times sample_rows pass of all rows, so a task sends its share of that; counting reads no column
    share = max(1, documents.count() // (3 * sample_rows))
    picked = slim.where((F.pmod(F.xxhash64("key", "text"), F.lit(share)) == 0) & F.col("label").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    sample = picked.select("text", "label").limit(sample_rows).collect()
    shared = documents.sparkSession.sparkContext.broadcast(train([(r[0], r[1]) for r in sample]))
    kind = dict(slim.dtypes)["key"]
    span = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for b in batches:
            out = []
            for found in judge.documents([sentences(t) if t else [] for t in b.column(1).to_pylist()]):
                spans: list[dict] = []
                for lang, confidence, n in found:
                    if spans and spans[-1]["lang"] == lang:
                        last = spans[-1]
                        last["confidence"] = (last["confidence"] * last["n_words"] + confidence * n) / (last["n_words"] + n)
                        last["n_words"] += n
                    else:
                        spans.append({"lang": lang, "confidence": confidence, "n_words": n})
                out.append(spans)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(out, span)], ["key", "label", "spans"])

    return slim.mapInArrow(run, f"key {kind}, label string, {SPANS}").withColumnRenamed("key", key)


def shares(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, lang, share, confidence) of every language of every document, from its passages; no shuffle."""
    total = F.aggregate("spans", F.lit(0), lambda a, x: a + x["n_words"])
    langs = F.array_distinct(F.transform("spans", lambda x: x["lang"]))
    rows = judged.where(F.size("spans") > 0).select(F.col(key), "label", "spans", total.alias("_n"), F.explode(langs).alias("lang"))
    own = F.filter("spans", lambda x: x["lang"] == F.col("lang"))
    n = F.aggregate(own, F.lit(0), lambda a, x: a + x["n_words"])
    c = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["confidence"] * x["n_words"])
    return rows.select(key, "label", "lang", (n / F.col("_n")).alias("share"), (c / n).alias("confidence"))


def mislabelled(judged: DataFrame, key: str = "doc_id", share: float = SHARE) -> DataFrame:
    """(key, lang): the languages of documents in several languages, or whose label is missing or wrong."""
    total = F.aggregate("spans", F.lit(0), lambda a, x: a + x["n_words"])
    langs = F.array_distinct(F.transform("spans", lambda x: x["lang"]))
    count = lambda lang: F.aggregate(F.filter("spans", lambda x: x["lang"] == lang), F.lit(0), lambda a, x: a + x["n_words"])
    kept = judged.select(key, "label", F.filter(langs, lambda lang: (lang != OTHER) & (count(lang) >= total * share)).alias("langs"))
    case = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label"))
    return kept.where((F.size("langs") > 0) & case).select(key, F.explode("langs").alias("lang"))
