"""Languages of documents and of their segments, by rank-order profiles (problem 10).

A language's profile is the list of its most frequent n-grams (one to five letters of words with their ends
marked) in order of frequency. A segment's own n-grams are ranked the same way, and its distance to a language is
the sum of how far each is out of place in the profile, at most the profile's length. Segments are the sentences
of a text; a document has each language in which at least one whole sentence is written.

Fitting reads at most ``per_language`` labelled documents of each language (those with the smallest hash of
``doc_id``). The first profiles label the sample's own sentences, and the profiles are drawn again from the
sentences that agree with their document's label, so that wrong labels and mixed texts wash out.

Defined cases
  * Texts that are null, or have fewer than ``min_letters`` letters, or no word beside tags, have no language and no rows.
  * Tags, addresses, hashtags and numbers are no letters of a language. A sentence counts if it has more than
    three words, or in scripts without blanks at least eight letters; if a text has no such sentence, it counts as one.
  * A sentence goes to the document's leading language unless another is nearer by ``margin``; ties go to the
    smaller code. Confidence is 1 - nearest / second nearest distance, between 0 and 1.
  * Labels count by meaning: case, blanks, regions (``pt_BR``), codes of two or three letters, names. Others are none.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes and names of the languages told apart.
LABELS = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "ja": ("ja", "jpn", "japanese", "jp", "日本語"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pl": ("pl", "pol", "polish", "polski"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
    "sv": ("sv", "swe", "swedish", "svenska"),
}

# How Cyrillic letters are written in Latin ones where a text is romanised.
ROMAN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))


def label_meaning(c: Column) -> Column:
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    s = F.regexp_replace(s, r"^(\p{L}{2,3})[-_ ].*$", "$1")
    out = F.lit(None).cast("string")
    for code, words in LABELS.items():
        out = F.when(s.isin(*words), F.lit(code)).otherwise(out)
    return out


_TAGS = regex.compile(r"<[^<>]*>|https?://\S+|[#@][\p{L}\p{N}_]+|\([^()\p{L}]*\)")
_BREAK = regex.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|(?<=[。！？])|\s+[/|•]\s+|[\r\n]+|(?<=\p{Ll}[.!?])(?=\p{Lu})")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}+)*")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")


# The same for Java's expressions, where ``(?U)`` gives blanks their wider meaning.
_TAGS_J, _BREAK_J, _OUTER_J = "(?U)" + _TAGS.pattern, "(?U)" + _BREAK.pattern, r"(?U)^\s+|\s+$"


def sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in _BREAK.split(_TAGS.sub(" ", text))) if s]


def sentence_column(text: Column) -> Column:
    """The same as ``sentences``, in the JVM."""
    parts = F.split(F.regexp_replace(text, _TAGS_J, " "), _BREAK_J, -1)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, _OUTER_J, "")), lambda p: p != "")


def is_whole(sentence: str) -> bool:
    return len(_WORD.findall(sentence)) > 3 or len(_UNSPACED.findall(sentence)) >= 8


LONGEST = 5
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of ``_word_``, word by word, short ones first, and how many each word has. The mark alone is none."""
    marked = [f"_{w}_" for w in words]
    size = np.fromiter(map(len, marked), "i8", len(marked))
    start = np.concatenate([[0], np.cumsum(size)])
    c = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype("u8")
    word = np.repeat(np.arange(len(marked)), size)
    at = np.arange(len(c)) - start[word]
    per = [np.maximum(size - k + 1 - (2 if k == 1 else 0), 0) for k in range(1, LONGEST + 1)]
    count = np.sum(per, axis=0) if len(marked) else np.zeros(0, "i8")
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    out = np.empty(int(count.sum()), "u8")
    h = np.zeros(len(c), "u8")
    with np.errstate(over="ignore"):
        for k in range(1, LONGEST + 1):
            # h of a place covers the k letters from it on
            h = h[: len(c) - k + 1] * np.uint64(_ODD[0]) + (c[k - 1 :] + np.uint64(k)) * np.uint64(_ODD[1])
            i, w = at[: len(h)], word[: len(h)]
            fits = (i + k <= size[w]) & (c[: len(h)] != ord("_") if k == 1 else True)
            x = h[fits]
            x ^= x >> np.uint64(29)
            out[first[w[fits]] + i[fits] - (1 if k == 1 else 0)] = x * np.uint64(_ODD[0])
            first = first + per[k - 1]
    return out, count


@dataclass
class Profiles:
    """``index`` numbers the n-grams of all profiles; ``rank`` holds their rank per profile, ``size`` where one is absent.

    A language written in Cyrillic has a second profile of the same words in Latin letters; the nearer one counts.
    """

    languages: list[str]
    size: int
    index: dict[str, int] = field(default_factory=dict)
    rank: np.ndarray | None = None
    owner: list[int] = field(default_factory=list)

    @classmethod
    def fit(cls, by_language: dict[str, list[str]], size: int) -> Profiles:
        langs = sorted(by_language)
        owner = list(range(len(langs)))
        index: dict[str, int] = {}
        tops = []
        counted = []
        for l in langs:
            n: Counter = Counter()
            for s in by_language[l]:
                for w in _WORD.findall(s.lower()):
                    n[w] += 1
            counted.append(n)
        for j, n in enumerate(counted[: len(langs)]):
            cyrillic = {w: c for w, c in n.items() if regex.match(r"\p{Cyrillic}", w)}
            if sum(cyrillic.values()) > sum(n.values()) / 2:
                latin: Counter = Counter()
                for w, c in cyrillic.items():
                    latin["".join(ROMAN.get(x, x) for x in w)] += c
                counted.append(latin)
                owner.append(j)
        for n in counted:
            g: Counter = Counter()
            for w, c in n.items():
                p = f"_{w}_"
                for k in range(1, 6):
                    for i in range(len(p) - k + 1):
                        g[p[i : i + k]] += c
            g.pop("_", None)
            top = [x for x, _ in sorted(g.items(), key=lambda x: (-x[1], x[0]))[:size]]
            tops.append(top)
            for x in top:
                index.setdefault(x, len(index))
        rank = np.full((len(index) + 1, len(tops)), size, "i4")  # the last row: in no profile
        for j, top in enumerate(tops):
            for r, x in enumerate(top):
                rank[index[x], j] = r
        return cls(langs, size, index, rank, owner)

    def __post_init__(self) -> None:
        names = sorted(self.index, key=self.index.get)
        if names:
            # an n-gram is hashed as if within a word: all its windows of full length, of which it has one
            self.keys = np.concatenate([_gram_hash(names[lo : lo + 4096]) for lo in range(0, len(names), 4096)])
        else:
            self.keys = np.empty(0, "u8")
        self.order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[self.order]

    def distances(self, texts: list[str], grams_at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Per sentence the mean out-of-place distance per n-gram, by language, as a share of the largest (1 if there is no n-gram); and whether it is whole.

        All n-grams of many sentences are counted, ranked and looked up together: n-grams of equal count are in
        order of appearance.
        """
        out, whole = np.ones((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        ids: dict[str, int] = {}
        flat, many = [], np.zeros(len(texts), "i8")
        for t, s in enumerate(texts):
            ws = _WORD.findall(s.lower())
            many[t] = len(ws)
            whole[t] = len(ws) > 3 or len(_UNSPACED.findall(s)) >= 8
            flat += [ids.setdefault(w, len(ids)) for w in ws]
        if not flat or not self.languages:
            return out, whole
        hashes, count = _hashes(list(ids))
        first = np.concatenate([[0], np.cumsum(count)])
        known, code = np.unique(hashes, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.keys, known), max(len(self.keys) - 1, 0))
        row = np.where(self.keys[spot] == known, self.order[spot], -1) if len(self.keys) else np.full(len(known), -1)
        word, of = np.array(flat), np.repeat(np.arange(len(texts)), many)
        load = np.cumsum(count[word])
        ends = np.cumsum(many)
        t = 0
        while t < len(texts):
            done = load[ends[t - 1] - 1] if t and ends[t - 1] else 0
            u = t + 1
            while u < len(texts) and u - t < 4096 and (load[ends[u] - 1] if ends[u] else 0) - done <= grams_at_once:
                u += 1
            lo, hi = (ends[t - 1] if t else 0), ends[u - 1]
            if hi > lo:
                self._rank(out, t, word[lo:hi], of[lo:hi] - t, count, first, code, row)
            t = u
        return out, whole

    def _rank(self, out: np.ndarray, at: int, word: np.ndarray, of: np.ndarray, count: np.ndarray, first: np.ndarray, code: np.ndarray, row: np.ndarray) -> None:
        n = count[word]
        total = int(n.sum())
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        grams = code[np.repeat(first[word], n) + within]
        sentence = np.repeat(of, n)
        if total >= 1 << 26 or len(row) >= 1 << 25:  # one giant sentence: the same by plain sorts
            order = np.lexsort((np.arange(total), grams, sentence))
            new = np.append(True, (np.diff(grams[order]) != 0) | (np.diff(sentence[order]) != 0))
            start = np.flatnonzero(new)
            times, place = np.diff(np.append(start, total)), order[start]
            place = place[np.lexsort((place, -times, sentence[place]))]
        else:
            bits = max(total.bit_length(), 1)
            kinds = max(len(row).bit_length(), 1)
            key = np.sort((((sentence << kinds) | grams) << bits) | np.arange(total))
            group = key >> bits
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            times, place = np.diff(np.append(start, total)), key[start] & ((1 << bits) - 1)
            place = np.sort((((sentence[place] << bits) | (total - times)) << bits) | place) & ((1 << bits) - 1)
        s, r = sentence[place], row[grams[place]]
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        sizes = np.diff(np.append(start, len(s)))
        own = np.arange(len(s)) - np.repeat(start, sizes)
        sums = np.zeros((len(start), self.rank.shape[1]), "i8")
        hit = r >= 0
        which = np.repeat(np.arange(len(start)), sizes)[hit]
        if len(which):
            k = self.rank[r[hit]]
            d = np.where(k >= self.size, self.size, np.abs(k - np.minimum(own[hit], self.size).astype(k.dtype)[:, None]))
            cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            sums[which[cut]] = np.add.reduceat(d, cut, axis=0, dtype="i8")
        sums += (self.size * (sizes - np.bincount(which, minlength=len(start))))[:, None]
        by_profile = sums / sizes[:, None] / self.size
        best = by_profile[:, : len(self.languages)].copy()
        for j, o in enumerate(self.owner):
            best[:, o] = np.minimum(best[:, o], by_profile[:, j])
        out[at + s[start]] = best


def _gram_hash(grams: list[str]) -> np.ndarray:
    """Hashes as ``_hashes`` gives them, of n-grams by themselves."""
    size = np.fromiter(map(len, grams), "i8", len(grams))
    c = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").astype("u8")
    start = np.cumsum(size) - size
    h = np.zeros(len(grams), "u8")
    with np.errstate(over="ignore"):
        for k in range(1, LONGEST + 1):
            in_ = size >= k
            h[in_] = h[in_] * np.uint64(_ODD[0]) + (c[start[in_] + k - 1] + np.uint64(k)) * np.uint64(_ODD[1])
        h ^= h >> np.uint64(29)
        return h * np.uint64(_ODD[0])


def fit(docs: DataFrame, per_language: int = 400, size: int = 3000, rounds: int = 2) -> Profiles:
    """Profiles from a bounded sample of labelled documents; languages without a labelled document have none."""
    d = docs.select("doc_id", "text", label_meaning(F.col("lang")).alias("label")).filter("label IS NOT NULL AND text IS NOT NULL")
    w = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    # at most per_language rows of each of the listed languages
    sample = d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_language).select("label", "text").collect()
    parts = [(r.label, s) for r in sorted(sample) for s in sentences(r.text) if is_whole(s)]
    p = Profiles([], size)
    for k in range(rounds):
        by: dict[str, list[str]] = {}
        near = p.distances([s for _, s in parts])[0].argmin(1) if k and parts else None
        for i, (label, s) in enumerate(parts):
            if k == 0 or p.languages[near[i]] == label:
                by.setdefault(label, []).append(s)
        p = Profiles.fit(by, size)
    return p


class _Memo:
    """Distances of the sentences seen, in one matrix; emptied when it holds ``limit`` of them."""

    def __init__(self, p: Profiles, limit: int = 100_000) -> None:
        self.p, self.limit = p, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.far, self.whole = np.empty((0, len(self.p.languages))), np.empty(0, bool)

    def rows(self, texts: list[str]) -> np.ndarray:
        """The row of each text; rows are good until ``clear``."""
        new = [t for t in dict.fromkeys(texts) if t not in self.at]
        if new:
            d, w = self.p.distances(new)
            self.at |= {t: len(self.far) + k for k, t in enumerate(new)}
            self.far, self.whole = np.concatenate([self.far, d]), np.concatenate([self.whole, w])
        return np.fromiter((self.at[t] for t in texts), "i8", len(texts))


def _detect(memo: _Memo, parts: pa.Array, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, segment, language, confidence) of the whole sentences of documents, which are lists of sentences."""
    offsets = np.asarray(parts.offsets)
    flat = parts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    doc = np.repeat(np.arange(len(parts)), np.diff(offsets))
    code = flat.indices.to_numpy(zero_copy_only=False)
    texts = flat.dictionary.to_pylist()
    if len(memo.at) > memo.limit:
        memo.clear()
    row = memo.rows(texts)[code] if len(code) else np.empty(0, "i8")
    keep = memo.whole[row]
    has = np.zeros(len(parts), bool)
    has[doc[keep]] = True
    length = np.fromiter(map(len, texts), "i8", len(texts))[code]
    # a document without a whole sentence counts as one
    bare = np.flatnonzero(~has & (np.diff(offsets) > 0))
    joined = [" ".join(parts[int(i)].as_py()) for i in bare]
    worded = np.array([_WORD.search(t) is not None for t in joined], bool)
    bare, joined = bare[worded], [t for t, w in zip(joined, worded) if w]
    extra = memo.rows(joined)
    doc, row, length = np.concatenate([doc[keep], bare]), np.concatenate([row[keep], extra]), np.concatenate([length[keep], np.ones(len(bare), "i8")])
    if not len(doc):
        return doc, doc, doc, np.empty(0)
    o = np.argsort(doc, kind="stable")
    doc, far, length = doc[o], memo.far[row[o]], length[o]
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    sizes = np.diff(np.append(start, len(doc)))
    lead = np.repeat(np.add.reduceat(far * length[:, None], start, axis=0).argmin(1), sizes)
    i = np.arange(len(doc))
    best = far.argmin(1)
    best = np.where(far[i, lead] - far[i, best] < margin, lead, best)
    own = far[i, best]
    far[i, best] = np.inf
    second = far.min(axis=1)
    second = np.where(np.isfinite(second), second, 1.0)
    sure = np.round(np.maximum(0.0, 1 - own / np.where(second > 0, second, 1)), 4) * (second > 0)
    return doc, i - np.repeat(start, sizes), best, sure


def segments(docs: DataFrame, p: Profiles, min_letters: int = 20, margin: float = 0.03) -> DataFrame:
    """Rows (doc_id, label, segment, lang, confidence), segments numbered from 0; ``label`` is the meaning of the given label.

    Texts are parted in the JVM; the profiles (at most languages x size n-grams, about 1 MB) travel as a broadcast.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label string, segment int, lang string, confidence double"
    if not p.languages:
        return docs.sparkSession.createDataFrame([], schema)
    shipped = docs.sparkSession.sparkContext.broadcast(p)
    text = F.col("text")
    src = docs.filter(text.isNotNull() & (F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) >= min_letters))
    src = src.select("doc_id", label_meaning(F.col("lang")).alias("label"), sentence_column(text).alias("parts"))

    def run(batches):
        memo = _Memo(shipped.value)
        names = pa.array(shipped.value.languages)
        for b in batches:
            parts = b.column(2)
            for lo in range(0, b.num_rows, 2048):
                some = parts.slice(lo, 2048)
                doc, k, lang, sure = _detect(memo, some, margin)
                at = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(k.astype("i4")), names.take(pa.array(lang)), pa.array(sure, pa.float64())], names=["doc_id", "label", "segment", "lang", "confidence"])

    return src.mapInArrow(run, schema)


def document_languages(docs: DataFrame, p: Profiles | None = None, **kw) -> DataFrame:
    """Rows (doc_id, label, lang, confidence, sentences): the languages of each document, confidence as the mean over its sentences."""
    p = p or fit(docs)
    return segments(docs, p, **kw).groupBy("doc_id", "label", "lang").agg(F.round(F.avg("confidence"), 4).alias("confidence"), F.count("*").alias("sentences"))


def mislabelled(docs: DataFrame, p: Profiles | None = None, **kw) -> DataFrame:
    """Rows (doc_id, lang): each language of the documents whose label is missing, unknown, not in the text, or whose text has several."""
    d = document_languages(docs, p, **kw).select("doc_id", "label", "lang")
    per = d.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))
    right = F.col("label").isNotNull() & F.array_contains("langs", F.col("label")) & (F.size("langs") == 1)
    return per.filter(~F.coalesce(right, F.lit(False))).select("doc_id", F.explode("langs").alias("lang"))
