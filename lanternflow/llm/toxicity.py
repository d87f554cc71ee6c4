"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel compares two words by the subsequences of two to four letters that they share, within spans of eight
characters. A subsequence counts DECAY ** gaps, so a gap or an inserted letter (`idxiot`) lowers the similarity and does
not end it. Equal subsequences of a word are added up before the product, so the normalised kernel of a word with
itself is 1. Its feature space is finite, so the decision value of the trained machine is one sum of table entries.

Training uses a bounded sample of labelled documents (multiple-instance learning: only documents are labelled). A
document is the bag of its words, and its value is the highest of its words. Toxic landmarks are the words that
together explain most toxic documents; clean landmarks are drawn from clean documents. The machine is a linear one with
squared hinge loss on the Nystrom features K(w, L) K(L, L)^-1/2. Of a toxic document its worst word is the example, also
with a letter inserted at every place; of clean documents all words are, of which the worst are added in each
round. A toxic document in which no word looks toxic teaches nothing (its label may be wrong). Values become
probabilities by Platt scaling on documents that were kept out, as they are and with a letter inserted in words that look toxic.
"""

from __future__ import annotations

import itertools
import string
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.shared import small_batches

DECAY, SPAN = 0.7, 8
#: How much subsequences of two, three and four letters count.
LENGTH_WEIGHTS = {2: 0.1, 3: 0.5, 4: 1.0}
_LETTERS = 32
#: (places after the first letter, weight, where the codes of this length begin in a table).
_SHAPES = [
    (rest, weight * DECAY ** (rest[-1] + 1 - n), sum(_LETTERS**k for k in range(2, n)))
    for n, weight in LENGTH_WEIGHTS.items()
    for rest in itertools.combinations(range(1, SPAN), n - 1)
]
_TABLE = sum(_LETTERS**n for n in LENGTH_WEIGHTS)
LONGEST = 32
#: By the number of characters with both ends: the length of a word's vector if all its subsequences are different.
_LEAST_NORM = np.sqrt([max(1e-9, sum(w * w * max(0, n - rest[-1]) for rest, w, _ in _SHAPES)) for n in range(LONGEST + 3)])
THRESHOLD = 0.7
#: Bounds of the training sample: documents of each label, and words of clean documents in a round.
MAX_TOXIC, MAX_CLEAN, MAX_NEGATIVES = 1500, 3500, 2_000
TOXIC_LANDMARKS, CLEAN_LANDMARKS, ROUNDS = 64, 128, 4
#: A toxic landmark is in so many toxic documents at least, and so large a share of the documents that hold it is toxic.
LEAST_DOCUMENTS, LEAST_PURITY = 4, 0.85
#: No word has a lower value: below the margin of the clean side all words are alike.
FLOOR = -1.0

#: Characters that stand for letters in disguised words.
_STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s"})
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def letters(token: str) -> str:
    """The letters of a lower-case token, the alphabet of the kernel; digits and signs between letters are read as the letters they stand for."""
    if token.isalpha():
        return token
    core = token.strip(_SIGNS)
    return core if core.isalpha() else "".join(filter(str.isalpha, core.translate(_STANDS_FOR)))


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens of a text, and what single characters in a row spell."""
    words = text.lower().split()
    out = set(words)
    single = [k for k, w in enumerate(words) if len(w) == 1]
    if len(single) > 1:
        for _, run in itertools.groupby(enumerate(single), lambda x: x[1] - x[0]):
            spelled = "".join(words[k] for _, k in run)
            if len(spelled) > 1:
                out.add(spelled)
    return out


def pieces(word: str) -> list[str]:
    """A word, or overlapping windows of a longer one."""
    if len(word) <= LONGEST:
        return [word]
    return [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """Codes of the letters of ^word$, padded with 0."""
    width = max(map(len, words)) + 2
    flat = np.frombuffer("".join(f"^{w}$".ljust(width, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width)
    latin = (flat >= 97) & (flat <= 122)
    return np.where(latin, flat - 96, np.where(flat == 94, 27, np.where(flat == 36, 28, np.where(flat == 0, 0, 29 + flat % 3)))).astype(np.int32)


def _occurrences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of a subsequence: its codes at every start of every word, whether it ends within the word, and its weight."""
    c = _codes(words)
    for rest, weight, first in _SHAPES:
        n = c.shape[1] - rest[-1]
        if n > 0:
            code = c[:, :n]
            for k in rest:
                code = code * _LETTERS + c[:, k : k + n]
            yield code + first, c[:, rest[-1] :] > 0, weight


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each word its subsequences and their weights, equal ones added up, as a vector of length 1."""
    found = [(code, ok * weight) for code, ok, weight in _occurrences(words)]
    codes, weights = (np.concatenate([f[k] for f in found], axis=1) for k in (0, 1))
    out = []
    for code, weight in zip(codes, weights):
        own, at = np.unique(code[weight > 0], return_inverse=True)
        total = np.bincount(at, weight[weight > 0])
        out.append((own, total / np.sqrt(total @ total)))
    return out


def _by_length(words: list[str], size: int = 4096) -> Iterator[np.ndarray]:
    order = np.argsort([len(w) for w in words], kind="stable")
    for k in range(0, len(order), size):
        yield order[k : k + size]


def landmark_kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark."""
    own = features(landmarks)
    known = np.unique(np.concatenate([codes for codes, _ in own]))
    table = np.zeros((len(known), len(landmarks)), dtype=np.float32)
    for k, (codes, weights) in enumerate(own):
        table[np.searchsorted(known, codes), k] = weights
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for part in _by_length(words, 1024):
        for i, (codes, weights) in zip(part, features([words[i] for i in part])):
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            same = known[at] == codes
            out[i] = weights[same] @ table[at[same]]
    return out


@dataclass
class Model:
    """table: what each subsequence adds to a word's value; a value becomes a score by slope and shift. Without a table all scores are 0."""

    table: np.ndarray | None
    bias: float
    slope: float
    shift: float
    landmarks: list[str]

    def _totals(self, words: list[str]) -> np.ndarray:
        """Table entries of all subsequences of each word, weighted and added. Padding ends a code with 0, where no table has an entry."""
        c = np.ascontiguousarray(_codes(words).T)
        width = len(c)
        out = np.zeros(c.shape, dtype=np.float32)
        two, three, four = np.split(self.table, np.cumsum([_LETTERS**n for n in LENGTH_WEIGHTS])[:-1])

        def add(code: np.ndarray, table: np.ndarray, n: int, last: int) -> None:
            part = table.take(code)
            part *= np.float32(LENGTH_WEIGHTS[n] * DECAY ** (last + 1 - n))
            out[: width - last] += part

        for i in range(1, min(SPAN, width)):
            pair = c[: width - i] * _LETTERS + c[i:]
            add(pair, two, 2, i)
            for j in range(i + 1, min(SPAN, width)):
                triple = pair[: width - j] * _LETTERS + c[j:]
                add(triple, three, 3, j)
                for k in range(j + 1, min(SPAN, width)):
                    add(triple[: width - k] * _LETTERS + c[k:], four, 4, k)
        return out.sum(axis=0, dtype=np.float64)

    def values(self, words: list[str]) -> np.ndarray:
        """Decision values of words, FLOOR at least.

        A word's vector is at least as long as if all its subsequences were different ones. Where the value is under
        FLOOR even by that length, the exact one is not needed.
        """
        out = np.full(len(words), FLOOR)
        for part in _by_length(words):
            own = [words[i] for i in part]
            apart = _LEAST_NORM[[len(w) + 2 for w in own]]
            near = np.flatnonzero(self._totals(own) / apart + self.bias > FLOOR)
            for at in range(0, len(near), 512):
                some = near[at : at + 512]
                exact = [float(self.table[codes].astype(np.float64) @ weights) for codes, weights in features([own[k] for k in some])]
                out[part[some]] = np.maximum(FLOOR, np.array(exact) + self.bias)
        return out

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.shift, -50, 50)))


class Scorer:
    """Scores of texts, with a bounded cache of words."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most, self.known = model, most, {}

    def values(self, texts: list) -> np.ndarray:
        """texts: texts, or the sets of their tokens."""
        out = np.full(len(texts), FLOOR)
        for at in range(0, len(texts), 128):
            sets = [t if isinstance(t, set) else tokens(t) for t in texts[at : at + 128]]
            if len(self.known) > self.most:
                self.known = {}
            new = [w for w in set().union(*sets) if w not in self.known]
            self.add(new)
            for k, own in enumerate(sets):
                if own:
                    out[at + k] = max(map(self.known.__getitem__, own))
        return out

    def add(self, new: list[str]) -> None:
        parts: list[str] = []
        owner: list[int] = []
        for k, token in enumerate(new):
            if word := letters(token):
                for p in pieces(word):
                    parts.append(p)
                    owner.append(k)
        best = np.full(len(new), FLOOR)
        if parts:
            np.maximum.at(best, np.array(owner), self.model.values(parts))
        self.known.update(zip(new, best.tolist()))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.model.table is None:
            return np.zeros(len(texts))
        return self.model.score(self.values([t or "" for t in texts]))


def _explaining(bags: list[tuple[str, ...]], toxic: list[bool]) -> list[str]:
    """Words that explain toxic documents, best first: in many of them, and in hardly any clean one.

    A document counts half after each word that explains it, so words of documents that no other word explains come in.
    """
    clean = Counter(w for bag, bad in zip(bags, toxic) if not bad for w in bag)
    left = [set(bag) for bag, bad in zip(bags, toxic) if bad]
    count = Counter(w for bag in left for w in bag)
    share = len(left) / max(1, len(bags))
    # Of so many words some are in toxic documents by chance: the likelihood ratio has to make up for their number.
    chance = np.log(len(count) + 1) + 3

    def gain(n: int, c: int) -> float:
        return n * np.log(n / (n + c) / share) + (c * np.log(c / (n + c) / (1 - share)) if c else 0.0)

    pure = {w: n for w, n in count.items() if n >= LEAST_DOCUMENTS and n >= LEAST_PURITY * (n + clean[w])}
    open_count = {w: float(n) for w, n in pure.items() if gain(n, clean[w]) >= chance}
    weight = [1.0] * len(left)
    out: list[str] = []
    worth = lambda w: open_count[w] * count[w] / (count[w] + 5 * clean[w])
    while open_count and len(out) < TOXIC_LANDMARKS:
        best = max(open_count, key=lambda w: (worth(w), w))
        out.append(best)
        del open_count[best]
        for k, bag in enumerate(left):
            if best in bag:
                weight[k] /= 2
                for w in bag & open_count.keys():
                    open_count[w] -= weight[k]
    return out


def with_insertion(word: str, rng: np.random.Generator, at: int | None = None) -> str:
    """The word with a letter inserted inside."""
    if len(word) < 2:
        return word
    at = int(rng.integers(1, len(word))) if at is None else at
    return word[:at] + string.ascii_lowercase[int(rng.integers(26))] + word[at:]


def _machine(z: np.ndarray, y: np.ndarray, seen: np.ndarray, cost: float = 30.0) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with squared hinge loss, by Newton steps.

    An example weighs as much as there are documents that hold it.
    """
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    share = seen * cost
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(25):
        inside = y * (x @ w) < 1
        a = x[inside] * share[inside, None]
        new = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _platt(values: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the score, by Newton steps with Platt's smoothed targets. Both labels weigh the same, however rare one is."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weigh = np.where(toxic, len(toxic) / (2 * n1), len(toxic) / (2 * n0))
    x = np.stack([values, np.ones(len(values))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weigh * (p - target)) + 1e-3 * w
        h = (x * (weigh * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.1)), float(w[1])


def fit(texts: Iterable[set[str]], toxic: list[bool]) -> Model:
    """A model of labelled texts, each the set that tokens() gives. Without toxic or without clean ones it scores 0."""
    none = Model(None, 0.0, 1.0, 0.0, [])
    # Equal words of the documents are one object, and a bag is no larger than its list.
    words_of: dict[str, str] = {}
    bags = [tuple(sorted({words_of.setdefault(p, p) for t in x if (w := letters(t)) for p in pieces(w)})) for x in texts]
    part = [k % 4 == 3 for k in range(len(bags))]
    use = [k for k in range(len(bags)) if not part[k]]
    worst = _explaining([bags[k] for k in use], [toxic[k] for k in use])
    clean = Counter(w for k in use if not toxic[k] for w in bags[k])
    if not worst or not clean:
        return none
    rng = np.random.default_rng(7)
    sample = sorted(set(clean) - set(worst))
    sample = [sample[i] for i in rng.permutation(len(sample))]
    negative, rest = sample[:MAX_NEGATIVES], sample[MAX_NEGATIVES:]
    landmarks = worst + sample[:CLEAN_LANDMARKS]
    kept: dict[str, np.ndarray] = {}
    whiten = np.zeros((0, 0))

    def new_landmarks(words: list[str]) -> None:
        nonlocal landmarks, whiten
        landmarks = words
        kept.clear()
        own = landmark_kernel(landmarks, landmarks)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        keep = values > 1e-3
        whiten = vectors[:, keep] / np.sqrt(values[keep])

    new_landmarks(landmarks)

    def nystrom(words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in kept]
        if new:
            kept.update(zip(new, landmark_kernel(new, landmarks) @ whiten))
        return np.stack([kept[w] for w in words]).astype(np.float32)

    def train(positive: Counter, negative: list[str]) -> Model:
        forms = {w: [with_insertion(w, rng, k) for k in range(1, len(w)) for _ in range(2)] or [w] for w in positive}
        examples = [(w, float(n)) for w, n in positive.items()] + [(f, n / len(forms[w])) for w, n in positive.items() for f in forms[w]]
        words = [w for w, _ in examples] + negative
        y = np.concatenate([np.ones(len(examples)), -np.ones(len(negative))])
        w = _machine(nystrom(words), y, np.concatenate([[n for _, n in examples], [clean[w] for w in negative]]))
        alpha = whiten @ w[:-1]
        table = np.zeros(_TABLE)
        for weight, (codes, weights) in zip(alpha, features(landmarks)):
            table[codes] += weight * weights
        return Model(table.astype(np.float32), float(w[-1]), 1.0, 0.0, landmarks)

    # In a fixed order, so that a model does not depend on how Python's sets are ordered.
    explained = Counter(w for k in use if toxic[k] for own in [set(bags[k])] for w in worst if w in own)
    out = train(explained, negative)
    for turn in range(ROUNDS - 1):
        if rest:
            order = np.argsort(-out.values(rest), kind="stable")[:MAX_NEGATIVES].tolist()
            if not turn:  # half of the clean landmarks are clean words that look toxic
                new_landmarks(worst + sample[: CLEAN_LANDMARKS // 2] + [rest[i] for i in order[: CLEAN_LANDMARKS // 2]])
            hard = set(order)
            negative = negative + [rest[i] for i in sorted(hard)]
            rest = [w for i, w in enumerate(rest) if i not in hard]
        scorer = Scorer(out, most=sys.maxsize)  # the sample is bounded
        bad = [bags[k] for k in use if toxic[k] and bags[k]]
        scorer.values([set(bag) for bag in bad])
        best = [max(bag, key=scorer.known.__getitem__) for bag in bad]
        found = Counter(w for w in best if scorer.known[w] > 0)
        out = train(explained | found, negative)
    held = [k for k in range(len(bags)) if part[k]]
    scorer = Scorer(out, most=sys.maxsize)
    best = scorer.values([set(bags[k]) for k in held])
    # The same documents with a letter inserted in every word that looks toxic.
    forms = [{with_insertion(w, rng) if scorer.known[w] > 0 else w for w in bags[k]} for k in held]
    best = np.concatenate([best, scorer.values(forms)])
    truth = np.array([toxic[k] for k in held] * 2, dtype=bool)
    if truth.any() and not truth.all():
        out.slope, out.shift = _platt(best, truth)
    else:
        out.slope, out.shift = 4.0, 0.0
    return out


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """A model of the labelled documents that are not held out, at most max_toxic and max_clean of them, by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    known = known.filter(~is_held_out())
    chosen = known.filter("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_toxic).union(known.filter("not toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_clean))
    # Bounded by max_toxic + max_clean rows of an id and a flag.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            # What scoring reads; a token holds no white space.
            words = [" ".join(sorted(tokens(t or ""))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.string())], names=["doc_id", "toxic", "words"])

    texts = joined.select("doc_id", "toxic", F.col("text").cast("string")).mapInArrow(run, "doc_id long, toxic boolean, words string")
    # Of an id that repeats, one row, so that the bound holds.
    rows = texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("words").alias("words")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["words"]))
    return fit((set(r["words"].split()) for r in rows), [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Whole texts are read. A null, empty or wordless text has a low, constant score. Rows that repeat an id are
    scored each. A null id is not held out. Other columns, such as lang and source, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in small_batches(batches, 1):
            values = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns. The decision is made where a row is read."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in small_batches(batches, at):
            yield batch.filter(pa.array(scorer(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
