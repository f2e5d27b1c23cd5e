"""Scores for abusive, hateful and sexually explicit passages, by a counterfactually regularised classifier.

A document is scored by its worst passage: a sentence, or a window of a long one. The labels are of whole documents, so
the passages that make a document abusive are found while fitting: those of abusive documents that the last fit ranks
highest. In passages that mention a group, the identity term is swapped for others, and differences of score between the
swapped passages are penalised, so that a mention of a group alone raises no score. The model is logistic on hashed words, pairs of
words, letter bags and four-letter parts, after spellings meant to hide a word are undone. It is fitted on at most
`most_labelled` labelled documents, the bound of `labelled_documents`; every document is scored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.lookalikes import consistent

DIMENSIONS = 1 << 18
WINDOW, STRIDE = 8, 3
MOST_LABELLED, FOLDS = 20_000, 3
#: The log-odds of a passage of which nothing is known.
PRIOR = -3.0

# Identity terms that are swapped for one another, by language and by how they are used in a sentence.
_POOLS = [x.split() for x in (
    "women men girls boys gays lesbians foreigners immigrants refugees muslims jews christians hindus buddhists catholics atheists blacks whites asians africans mexicans indians arabs europeans americans pensioners",
    "woman man girl boy gay lesbian foreigner immigrant refugee muslim jew christian hindu catholic black white asian african mexican indian arab",
    "frauen männer mädchen jungen ausländer einwanderer flüchtlinge muslime juden christen katholiken schwule lesben türken polen russen araber rentner",
    "femmes hommes filles garçons étrangers immigrés réfugiés musulmans juifs chrétiens catholiques arabes africains roms retraités",
    "mujeres hombres niñas niños extranjeros inmigrantes refugiados musulmanes judíos cristianos católicos árabes africanos gitanos jubilados",
    "女人 男人 女性 男性 移民 难民 老人 外国",
)]
_POOL_OF = {w: pool for pool in reversed(_POOLS) for w in pool}
# Names of peoples are also known by their endings.
_PEOPLE = re.compile(r"[A-Z][a-z]{3,}(?:ese|ites?|ians?|ish|ans|aris?)$")
_SENTENCE = re.compile(r"[\n\r]+|(?<=[.!?…])[\"'”’)]*\s+|(?<=[。！？])")
_HAN = re.compile(r"([\u3400-\u9fff\u3040-\u30ff]+)")
_NUMBER = re.compile(r"[(\[]?[€$£¥]?\d[\d.,:]*(?:%|st|nd|rd|th|bn|m|k)?[)\]]?")
_DOTTED = re.compile(r"(?:\w[.\-_]){2,}\w")
_RUN = re.compile(r"(.)\1{2,}")
_LEET = str.maketrans("013457@$!|+", "oieastasilt")
_EDGE = ".,;:?\"“”„'’‘()[]{}…«»<>—–-"


@lru_cache(200_000)
def undisguised(chunk: str) -> str:
    """One space-free piece of text as a word in lower case: digits and signs that stand for letters, dots between letters and drawn out letters are undone; hidden letters stay `*`; numbers are `0`."""
    word = chunk.strip(_EDGE)
    if _NUMBER.fullmatch(word) or not word:
        return "0" if word else ""
    word = word.rstrip("!").lower()
    if _DOTTED.fullmatch(word):
        word = re.sub(r"[.\-_]", "", word)
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(_LEET)
    elif word and not word.isalnum() and all(c in "@$!*#%&" or c.isdigit() for c in word) and len(word) > 2:
        word = word.translate(_LEET)
    return _RUN.sub(r"\1", word)


NAME = "<n>"


def sentence_words(sentence: str, known: set[str] | None = None) -> list[str]:
    """The words of a sentence; single letters in a row are one word, with a scrap of up to two letters before them.

    With `known`, capitalised words that aren't in it are names, all the same, unless the whole sentence is in capitals.
    """
    chunks = sentence.split()
    if _HAN.search(sentence):  # pairs of characters, as there are no spaces
        chunks = [y for c in chunks for x in _HAN.split(c) if x for y in ([x[i : i + 2] for i in range(max(1, len(x) - 1))] if _HAN.match(x) else [x])]
    words = [*map(undisguised, chunks)]
    if known is not None:
        shouted = len(chunks) > 2 and sum(c.upper() == c for c in chunks) > 0.6 * len(chunks)
        if not shouted:
            words = [NAME if w and w not in known and w != "0" and (r := c.strip(_EDGE))[:1].isupper() and r.replace("-", "").replace("'s", "").isalpha() else w for w, c in zip(words, chunks)]
    words = [w for w in words if w]
    if sum(len(w) == 1 and w != "0" for w in words) < 3:
        return words
    out, run = [], []
    for w in [*words, "  "]:
        if len(w) == 1 and w not in "0&-":
            run.append(w)
            continue
        if len(run) >= 3:
            head = [out.pop()] if out and len(out[-1]) <= 2 and out[-1].isalpha() else []
            out.append("".join(head + run).translate(_LEET))
        else:
            out += run
        run = []
        if w != "  ":
            out.append(w)
    return out


def passages(text: str, known: set[str] | None = None) -> list[tuple[str, list[str]]]:
    """(sentence, words) of the passages of a text; long sentences give windows that overlap."""
    out = []
    for sentence in _SENTENCE.split(consistent_lines(text)):
        words = sentence_words(sentence, known)
        if not words:
            continue
        if len(words) <= WINDOW + STRIDE:
            out.append((sentence, words))
        else:
            out += [(sentence, words[i : i + WINDOW]) for i in range(0, len(words) - WINDOW + STRIDE, STRIDE)]
    return out


def consistent_lines(text: str) -> str:
    """The consistent form of each line."""
    return text if text.isascii() else "\n".join(map(consistent, text.split("\n")))


def _id(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind}{text}".encode("utf-8", "replace")) & (DIMENSIONS - 1)


def word_features(word: str) -> list[int]:
    """The features of a word: itself, its letters with the first one fixed, its ends and length, and its parts."""
    if word in ("0", NAME):
        return []
    out = [_id("w", word)]
    if "*" in word:
        out.append(_id("hidden", ""))
    if len(word) > 3:
        out.append(_id("b", word[0] + "".join(sorted(word[1:]))))
    if len(word) > 3:
        out.append(_id("e", f"{word[0]}{word[-1]}{len(word)}"))
    if len(word) > 4:
        out += [_id("p", word[i : i + 4]) for i in range(len(word) - 3)]
    return out


def pair_feature(a: int, b: int) -> int:
    return (a * 0x9E3779B1 + b * 0x85EBCA6B + 0x27D4EB2F >> 7) & (DIMENSIONS - 1)


def word_number(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def features(words: list[str]) -> np.ndarray:
    """The features of a passage, each as often as it occurs."""
    ids = [f for w in words for f in word_features(w)]
    numbers = [*map(word_number, words)]
    ids += [pair_feature(a, b) for a, b in zip(numbers, numbers[1:])]
    return np.array(ids, dtype=np.int64)


def identity_terms(sentences: list[str]) -> set[str]:
    """The identity terms in use: the fixed ones, and peoples by their endings where they are used within a sentence."""
    found = Counter()
    for s in sentences:
        for w in s.split()[1:]:
            w = w.strip(_EDGE)
            if _PEOPLE.fullmatch(w) and not w.isupper():
                found[w.lower()] += 1
    return {*_POOL_OF} | {w for w, n in found.items() if n >= 2}


def swapped(words: list[str], terms: set[str], pool: list[str], chance: np.random.Generator) -> list[str] | None:
    """The words with each identity term replaced by one other; None where there is none."""
    held = {w for w in words if w in terms}
    if not held:
        return None
    other = {}
    for w in sorted(held):
        same = _POOL_OF.get(w, pool)
        other[w] = same[int(chance.integers(len(same)))]
    return [other.get(w, w) for w in words]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    known: set[str] = field(default_factory=set)
    threshold: float = 0.5
    held_out: dict = field(default_factory=dict)
    left_out: np.ndarray | None = None

    def __post_init__(self):
        # Of each piece of text its word as it is and with names masked; of each word its weight, number and whether it is a single letter.
        self._pieces: dict[str, int] = {}
        self._piece_rows: list[tuple[int, int, bool]] = []
        self._named: list[str | None] = []
        self._words: dict[str, int] = {}
        self._word_rows: list[tuple[float, int, bool]] = []
        self._arrays: tuple[np.ndarray, np.ndarray] = (np.zeros((0, 3)), np.zeros((0, 3), dtype=np.int64))

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows of words and of pieces as arrays, of which only what is new is added."""
        words, pieces = self._arrays
        if len(words) < len(self._word_rows):
            words = np.concatenate((words, np.array(self._word_rows[len(words) :], dtype=float)))
        if len(pieces) < len(self._piece_rows):
            pieces = np.concatenate((pieces, np.array(self._piece_rows[len(pieces) :], dtype=np.int64)))
        self._arrays = words, pieces
        return self._arrays

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _word(self, word: str) -> int:
        n = self._words.get(word)
        if n is None:
            n = self._words[word] = len(self._word_rows)
            self._word_rows.append((float(self.weights[word_features(word)].sum()), word_number(word), len(word) == 1 and word != "0"))
        return n

    def _piece(self, piece: str) -> int:
        word = undisguised(piece)
        bare = piece.strip(_EDGE)
        named = word and word not in self.known and word != "0" and bare[:1].isupper() and bare.replace("-", "").replace("'s", "").isalpha()
        n = self._pieces[piece] = len(self._piece_rows)
        plain = -2 if named else self._word(word) if word else -1  # a name's own word counts in sentences in capitals alone
        self._piece_rows.append((plain, self._word(NAME) if named else plain, piece.upper() == piece))
        self._named.append(word if named else None)
        return n

    def _spell_names(self, numbers: list[int]) -> None:
        for n in numbers:
            plain = self._word(self._named[n])
            self._piece_rows[n] = (plain, *self._piece_rows[n][1:])
            self._arrays[1][n, 0] = plain

    def score_all(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """(score from 0 to 1, the worst passage's sentence) of each text; null and blank texts have 0 and no passage.

        Words are looked up once each, what follows is arithmetic on the batch's arrays: a passage's log-odds are a
        difference of running sums of the weights of words and of pairs.
        """
        if len(self._pieces) > 500_000:
            self.__post_init__()
        sentences, of, lengths, pieces, odd = [], [], [], [], []
        known = self._pieces
        for i, text in enumerate(texts):
            for sentence in _SENTENCE.split(consistent_lines(text)) if text else ():
                chunks = sentence.split()
                if not chunks:
                    continue
                if not sentence.isascii() and _HAN.search(sentence):
                    odd.append(len(sentences))
                    chunks = []
                sentences.append(sentence), of.append(i), lengths.append(len(chunks))
                for c in chunks:
                    n = known.get(c)
                    pieces.append(self._piece(c) if n is None else n)
        best, where = np.full(len(texts), -np.inf), np.full(len(texts), -1, dtype=np.int64)
        if not sentences:
            return np.zeros(len(texts)), [None] * len(texts)
        of, lengths = np.array(of), np.array(lengths)
        owner = np.repeat(np.arange(len(sentences)), lengths)
        words_held, pieces_held = self._tables()
        pieces = np.array(pieces, dtype=np.int64)
        rows = pieces_held[pieces]
        shouted = (np.bincount(owner, weights=rows[:, 2], minlength=len(sentences)) > 0.6 * lengths) & (lengths > 2)
        unread = shouted[owner] & (rows[:, 0] == -2)
        if unread.any():
            self._spell_names(np.unique(pieces[unread]).tolist())
            words_held, pieces_held = self._tables()
            rows = pieces_held[pieces]
        word = np.where(shouted[owner], rows[:, 0], rows[:, 1])
        owner, word = owner[word >= 0], word[word >= 0]
        spelled = np.flatnonzero(np.bincount(owner[words_held[word, 2] > 0], minlength=len(sentences)) >= 3)  # letters in a row may be a word
        odd = np.union1d(np.array(odd, dtype=np.int64), spelled)
        if len(odd):
            keep = ~np.isin(owner, odd)
            extra = [np.array([self._word(w) for w in sentence_words(sentences[k], self.known)], dtype=np.int64) for k in odd]
            owner = np.concatenate([owner[keep], *(np.full(len(x), k) for k, x in zip(odd, extra))])
            word = np.concatenate([word[keep], *extra])
            order = np.argsort(owner, kind="stable")
            owner, word = owner[order], word[order]
        if not len(word):
            return np.zeros(len(texts)), [None] * len(texts)
        held = self._tables()[0][word]
        weight, number = held[:, 0], held[:, 1].astype(np.uint64)  # numbers of 32 bits are exact as doubles
        with np.errstate(over="ignore"):
            pair = ((number[:-1] * np.uint64(0x9E3779B1) + number[1:] * np.uint64(0x85EBCA6B) + np.uint64(0x27D4EB2F)) >> np.uint64(7)) & np.uint64(DIMENSIONS - 1)
        sums = np.concatenate(([0.0], np.cumsum(weight)))
        pairs = np.concatenate(([0.0], np.cumsum(self.weights[pair.astype(np.int64)])))
        size = np.bincount(owner, minlength=len(sentences))
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        many = np.where(size == 0, 0, np.where(size <= WINDOW + STRIDE, 1, -(-(size - WINDOW + STRIDE) // STRIDE)))
        sentence = np.repeat(np.arange(len(sentences)), many)
        place = np.arange(len(sentence)) - np.repeat(np.cumsum(many) - many, many)
        start = begin[sentence] + place * STRIDE
        end = np.where(many[sentence] == 1, begin[sentence] + size[sentence], np.minimum(start + WINDOW, begin[sentence] + size[sentence]))
        z = self.bias + sums[end] - sums[start] + pairs[end - 1] - pairs[start]
        doc = of[sentence]
        np.maximum.at(best, doc, z)
        first = np.flatnonzero(z == best[doc])[::-1]
        where[doc[first]] = sentence[first]  # the first of the worst
        scores = np.where(where >= 0, 1 / (1 + np.exp(-np.clip(best, -30, 30))), 0.0)
        return scores, [sentences[k] if k >= 0 else None for k in where]

    def score(self, text: str | None) -> tuple[float, str | None]:
        scores, where = self.score_all([text])
        return float(scores[0]), where[0]


def _minimise(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], decay: float, swap: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic weights by full-batch Adam; `pairs` are the features of a passage and of its swapped form."""
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    used, flat = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    full_rows = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full_rows]
    by_feature = np.argsort(flat, kind="stable")
    owner_by_feature, feature_starts = owner[by_feature], np.searchsorted(flat[by_feature], np.arange(len(used)))
    difference = []  # (pair, feature, 1 or -1)
    for k, sign in ((0, 1.0), (1, -1.0)):
        ids = np.concatenate([p[k] for p in pairs]) if pairs else np.array([], dtype=np.int64)
        of = np.repeat(np.arange(len(pairs)), [len(p[k]) for p in pairs])
        at = np.searchsorted(used, ids)
        held = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == ids) if len(ids) else np.array([], dtype=bool)
        difference.append((of[held], at[held], np.full(int(held.sum()), sign)))
    pair_of, pair_feature_of, pair_sign = map(np.concatenate, zip(*difference))
    w, b = np.zeros(len(used)), PRIOR
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = weight.sum()
    z = np.full(len(rows), b)
    for t in range(1, steps + 1):
        z[full_rows] = np.add.reduceat(w[flat], starts) + b
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        g = np.add.reduceat(r[owner_by_feature], feature_starts) + decay * w
        if len(pair_of):
            d = np.bincount(pair_of, weights=pair_sign * w[pair_feature_of], minlength=len(pairs))
            g += np.bincount(pair_feature_of, weights=2 * swap / len(pairs) * pair_sign * d[pair_of], minlength=len(used))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 * (1 - 0.5 * t / steps)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    full = np.zeros(DIMENSIONS)
    full[used] = w
    return full, float(b)


def fit_documents(texts: list[str], labels: list[float], decay: float = 5e-4, swap: float = 0.05, rounds: int = 5, steps: int = 80, seed: int = 0) -> Model:
    """A model of documents with labels from 0 to 1 (the mean of their annotators); `left_out` holds each document's score by fits that left it out."""
    chance = np.random.default_rng(seed)
    # Words written small in several documents are no names; identity terms aren't either.
    small = Counter(w for text in texts for w in {c.strip(_EDGE) for c in consistent_lines(text).split()} if w.islower())
    terms = identity_terms([x for text in texts for x in _SENTENCE.split(text)])
    known = {w for w, n in small.items() if n > 1} | terms
    y_doc = np.array(labels, dtype=float)
    sure_doc = np.where(y_doc >= 0.5, y_doc, 1 - y_doc)
    # Passages of calm documents are held once, with the weight of all their copies; `of` leads from each passage to its row.
    numbers: dict = {}
    parts: list[list[str]] = []
    weights: list[float] = []
    abusive_rows: list[bool] = []
    docs: list[int] = []
    of: list[int] = []
    for i, text in enumerate(texts):
        for _, words in passages(text, known):
            key = (" ".join(words), i if y_doc[i] >= 0.5 else -1)
            if key not in numbers:
                numbers[key] = len(parts)
                parts.append(words), weights.append(0.0), abusive_rows.append(y_doc[i] >= 0.5)
            n = numbers[key]
            weights[n] += sure_doc[i]
            docs.append(i), of.append(n)
    if not parts:
        return Model(np.zeros(DIMENSIONS), PRIOR, left_out=np.zeros(len(texts)))
    doc_of, row_of = np.array(docs), np.array(of)
    abusive, sure = np.array(abusive_rows), np.minimum(np.array(weights), 50.0)
    common = np.array([(" ".join(w), -1) in numbers for w in parts])
    owner = np.zeros(len(parts), dtype=np.int64)
    owner[row_of] = doc_of
    rows = [features(w) for w in parts]
    # Features of one passage alone are left out.
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    flat, times = np.concatenate(rows), np.repeat(np.minimum(np.ceil(np.array(weights)), 2), sizes)
    kept = np.bincount(flat, weights=times, minlength=DIMENSIONS)[flat] > 1
    rows = np.split(flat[kept], np.cumsum(np.bincount(np.repeat(np.arange(len(rows)), sizes)[kept], minlength=len(rows)))[:-1])
    pool = sorted(terms - {*_POOL_OF}) or _POOLS[0]
    pairs, pair_of = [], []
    for i, (words, row) in enumerate(zip(parts, rows)):
        other = swapped(words, terms, pool, chance)
        if other:
            pairs.append((row, features(other))), pair_of.append(i)
    chosen = abusive & ~common
    slip = np.zeros(len(rows), dtype=bool)
    fold = np.where(abusive, chance.permutation(len(texts))[owner], chance.permutation(len(rows))) % FOLDS
    pair_fold = fold[pair_of] if pair_of else np.array([], dtype=np.int64)

    def fitted(inside: np.ndarray, pairs_inside: np.ndarray) -> tuple[np.ndarray, float]:
        weight = np.where(chosen, 3.0 * sure, np.where(abusive, 0.3, np.where(slip, 0.05, sure)))
        own = np.flatnonzero(inside)
        return _minimise([rows[i] for i in own], chosen[own].astype(float), weight[own], [pairs[i] for i in np.flatnonzero(pairs_inside)], decay, swap, steps)

    for _ in range(rounds):
        # A passage is judged by fits on other documents, so that no fit confirms what it was told of it.
        z = np.empty(len(rows))
        for k in range(FOLDS):
            w, b = fitted(fold != k, pair_fold != k)
            for i in np.flatnonzero(fold == k):
                z[i] = w[rows[i]].sum() + b
        left_out = np.full(len(texts), -np.inf)
        np.maximum.at(left_out, doc_of, z[row_of])
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, doc_of, np.where(common[row_of] & abusive[row_of], -np.inf, z[row_of]))
        # What calm documents reach by chance doesn't make a passage the abusive one; then the document has none.
        usual = worst[(y_doc < 0.5) & np.isfinite(worst)]
        least = np.quantile(usual, 0.9) if len(usual) else 0.0
        chosen = abusive & ~common & (z > least) & ((z >= worst[owner] - 1e-9) | (z > 0.0))
        # A passage of a calm document that the fit is sure of is likelier a slip of the annotator.
        slip = ~abusive & (z > 2.5) & (sure < 3)
    w, b = fitted(np.ones(len(rows), dtype=bool), np.ones(len(pairs), dtype=bool))
    return Model(w, b, known, left_out=1 / (1 + np.exp(-np.clip(left_out, -30, 30))))


def _best_threshold(scores: np.ndarray, y: np.ndarray, slack: float = 0.03) -> tuple[float, dict]:
    """The threshold nearest 0.3 whose F1 on left out documents is within `slack` of the best: the whole fit has seen more and parts them further."""
    tried = []
    for t in np.linspace(0.05, 0.95, 37):
        hit = scores >= t
        tried.append((2 * float((hit & y).sum()) / max(1.0, hit.sum() + y.sum()), float(t)))
    best = max(tried)[0]
    f1, t = min((x for x in tried if x[0] >= best - slack), key=lambda x: abs(x[1] - 0.3))
    return t, {"f1": f1, "best_f1": best, "n": int(len(y)), "positives": int(y.sum())}


def labelled_documents(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, y, lang, text) of at most `most_labelled` labelled documents, those of least hashed id; y is the mean of a document's labels.

    The ids are chosen from the labels alone and broadcast, at most `most_labelled` of them, so texts aren't shuffled.
    """
    means = labels.filter("abusive IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("abusive").alias("y"))
    chosen = means.orderBy(F.xxhash64(F.lit(0), "doc_id"), "doc_id").limit(most_labelled)
    lang = F.lower(F.trim("lang")) if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.filter("text IS NOT NULL").select("doc_id", lang.alias("lang"), "text").join(F.broadcast(chosen), "doc_id")


def fit(labelled: DataFrame, seed: int = 0) -> Model:
    """A model of a bounded number of labelled documents, rows of doc_id, y, lang and text, fitted in one task.

    The threshold is found on the scores of documents by fits that left them out, and so are the figures by language in
    `held_out`. Without labels nothing is abusive.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(frames), ignore_index=True).sort_values("doc_id")
        model = fit_documents(held["text"].tolist(), held["y"].tolist(), seed=seed)
        y, sure = held["y"].to_numpy(), held["y"].isin([0.0, 1.0]).to_numpy()
        lang = held["lang"].fillna("").to_numpy()
        if (y[sure] == 1).any() and (y[sure] == 0).any():
            model.threshold, _ = _best_threshold(model.left_out[sure], y[sure] == 1)
        hit = model.left_out >= model.threshold
        for name in ["*", *sorted(set(lang))]:
            own = sure & ((lang == name) | (name == "*"))
            model.held_out[name] = (int(own.sum()), int((own & (y == 1)).sum()), int((own & hit).sum()), int((own & hit & (y == 1)).sum()))
        yield pd.DataFrame({"model": [pickle.dumps((model.weights.astype(np.float32), model.bias, model.known, model.threshold, model.held_out))]})

    # At most `most_labelled` texts, of which the driver sees only the model, of a fixed number of weights.
    found = labelled.coalesce(1).mapInPandas(run, "model binary").collect() if not labelled.isEmpty() else []
    if not found:
        return Model(np.zeros(DIMENSIONS), PRIOR)
    weights, bias, known, threshold, held_out = pickle.loads(found[0]["model"])
    return Model(weights.astype(np.float64), bias, known, threshold, held_out)


def held_out_figures(model: Model, spark) -> DataFrame:
    """By language ("*" is all): labelled documents on which annotators agree, the abusive ones, those found by fits that left them out, and precision, recall and F1."""
    rows = [(name, n, pos, found, right, right / found if found else None, right / pos if pos else None, 2 * right / (found + pos) if found + pos else None) for name, (n, pos, found, right) in sorted(model.held_out.items())]
    return spark.createDataFrame(rows, "lang string, documents long, abusive long, found long, right long, precision double, recall double, f1 double")


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source, score, abusive, passage (the sentence of the worst one, null for blank texts) of every document, whole texts."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for frame in frames:
            scores, where = own.score_all([x if isinstance(x, str) else None for x in frame["text"]])
            out = frame[["doc_id", "source"]].copy()
            out["score"], out["abusive"] = scores, scores >= own.threshold
            out["passage"] = pd.Series(where, index=out.index, dtype=object)
            yield out

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, score double, abusive boolean, passage string")


def rates(scores: DataFrame) -> DataFrame:
    """Per source (null as one of its own): documents, abusive_documents, rate, mean_score."""
    return scores.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("abusive").alias("abusive_documents"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
