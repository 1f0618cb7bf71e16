"""Toxicity scores of deobfuscated text.

Spellings such as "1d10t", "i.d.i.o.t" and "idiooot" come out of a noisy channel. A suspicious
token is a lattice: a look-alike may stand for letters or itself, a long run of a letter for one,
two or all of them, a separator between single letters for nothing or itself. Viterbi's
algorithm picks the reading of the best product of channel and character language model. The
restored text is scored by the words and character n-grams that labelled toxic texts have.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop, keep
from lectern.llm.labelled import held_out, learnable, sample

#: What a character may stand for besides itself: digits and marks, and letters of other alphabets that look alike.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
LOOKALIKES |= dict(zip("аеорсухіј", "aeopcyxij", strict=True))
#: Characters without width, and what they hide in.
_UNSEEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
#: Log-probabilities of the channel.
AS_LETTER, AS_ITSELF, SHORTENED, DOUBLED, WHOLE_RUN, DROPPED, KEPT = -1.0, -2.5, -0.5, -1.5, -4.0, -0.5, -2.5
#: Of a letter twice that stands for one.
ONE_OF_TWO = -6.0

#: Character classes of the language model: 0 white space, 1-26 letters, 27 other letters, 28 all else.
CLASSES = 29
_CLASS = bytes(0 if b in b" \t\n\r\x0b\x0c" else b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 28 for b in range(256))

_MARKS = "".join(map(re.escape, LOOKALIKES))
#: A look-alike beside a letter or among three with a mark that is no digit, a letter twice, or three single characters with marks between.
_TOKEN_CUE = re.compile(rf"[^\W\d_][{_MARKS}]|[{_MARKS}][^\W\d_]|(?=[{_MARKS}]*[@$!|+])[{_MARKS}]{{3}}|([^\W\d_])\1|[^\W_][.\-_*/|][^\W_][.\-_*/|][^\W_]")
_BLANKS_CUE = re.compile(r"\s[^\W_]\s+[^\W_]\s+[^\W_]")
_SPACED = re.compile(r"(?<!\w)[^\W_](?:(?:[.\-_*/|]|\s+)[^\W_]){2,}(?!\w)")
_BLANKS = re.compile(r"\s+")
_RUN = re.compile(r"(.)\1*", re.S)
BEGINNINGS = (4, 5, 6, 7)
#: Between the readings of a token.
BOTH = "\0"
#: Tokens that a worker remembers.
REMEMBERED = 250_000
#: A weight that counts twice above it, and the numbers that a text is scored by.
STRONG, FEATURES = 2.5, 5


def char_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): counts of character-class triples in all texts, added up by task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    c = np.frombuffer(b"\0" + bytes(t.as_buffer()).translate(_CLASS) + b"\0", np.uint8).astype(np.int32)
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3) if len(c) > 2 else 0
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there, pa.int32()), pa.array(total[there])], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Log-probability of a character class after two others."""

    def __init__(self, counts: dict[int, int]):
        n = np.zeros(CLASSES**3)
        for gram, k in counts.items():
            n[gram] = k
        n = n.reshape(CLASSES, CLASSES, CLASSES)
        after_one = n.sum(0) + 0.5
        backed = after_one / after_one.sum(1, keepdims=True)
        self.table = np.log((n + 5 * backed[None]) / (n.sum(2, keepdims=True) + 5)).tolist()

    @staticmethod
    def of(char: str) -> int:
        return _CLASS[ord(char)] if ord(char) < 128 else 0 if char.isspace() else 27 if char.isalpha() else 28


def lattice(token: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """For each unit of a token the strings it may stand for and their log-probabilities."""
    units: list[list[tuple[str, float]]] = []
    for i, m in enumerate(_RUN.finditer(token)) if not spaced else enumerate(re.finditer(".", token, re.S)):
        run, char = m[0], m[0][0]
        if spaced and i % 2:
            units.append([("", DROPPED), (char, KEPT)])
        elif char in LOOKALIKES:
            units += [[(char, AS_ITSELF), *((x, AS_LETTER) for x in LOOKALIKES[char])]] * len(run)
        elif len(run) >= 3 and char.isalpha():
            units.append([(char, SHORTENED), (char * 2, DOUBLED), (run, WHOLE_RUN)])
        elif len(run) == 2 and char.isalpha():
            units.append([(run, 0.0), (char, ONE_OF_TWO)])
        else:
            units.append([(run, 0.0)])
    return units


def decode(token: str, model: CharModel, spaced: bool = False) -> str:
    """The best reading of a token, which stands between white space."""
    table, of = model.table, CharModel.of
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(token, spaced):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for state, (score, trail) in best.items():
            for text, p in options:
                a, b = state
                s = score + p
                for char in text:
                    c = of(char)
                    s += table[a][b][c]
                    a, b = b, c
                if (a, b) not in after or s > after[a, b][0]:
                    after[a, b] = (s, (trail, text))
        best = after
    trail = max((score + table[a][b][0], trail) for (a, b), (score, trail) in best.items())[1]
    out = []
    while trail:
        trail, text = trail
        out.append(text)
    return "".join(reversed(out))


class Restorer:
    """Restores texts. Most tokens have no cue of obfuscation: they stand for themselves."""

    def __init__(self, model: CharModel):
        self.model = model

    def spaced(self, m: re.Match) -> str:
        """The reading of single characters with marks or blanks between; itself where all of these stay."""
        once = _BLANKS.sub(" ", m[0])
        out = decode(once, self.model, True)
        return m[0] if out == once else out

    def token(self, token: str) -> str:
        """A token of lower case, between white space."""
        if not _TOKEN_CUE.search(token):
            return token
        joined = _SPACED.sub(self.spaced, token)
        return joined if joined != token else decode(token, self.model)

    @staticmethod
    def plain(text: str) -> str:
        """Small letters, wide ones as narrow, without what can't be seen."""
        return (text if text.isascii() else unicodedata.normalize("NFKC", text.translate(_UNSEEN))).lower()

    def tokens(self, text: str) -> set[str]:
        """The distinct tokens of a text in lower case; single characters with blanks between are read as one span."""
        text = self.plain(text)
        if _BLANKS_CUE.search(f" {text}"):
            text = _SPACED.sub(self.spaced, text)
        return set(text.split())

    def __call__(self, text: str) -> str:
        """The whole restored text."""
        joined = _SPACED.sub(self.spaced, self.plain(text))
        return "".join(x if x.isspace() else self.token(x) for x in re.split(r"(\s+)", joined))


_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„’‘¿¡…–—"


def grams(word: str) -> list[str]:
    """A word, and the n-grams it begins with: 3 to 6 characters after a mark, so that they cover inflections."""
    marked = f"^{word}$"
    return [marked, *(marked[:n] for n in BEGINNINGS if n < len(marked))]


#: One character of each that may stand for each other; marks between letters go.
_SKELETON = {ord(c): ord(LOOKALIKES[c][0]) for c in LOOKALIKES} | {ord("l"): ord("i")} | dict.fromkeys(map(ord, ".-_*/"))


def skeleton(text: str) -> str:
    """What all readings of a text share: look-alikes as one, runs as one character, no marks between letters."""
    return _RUN.sub(r"\1", text.translate(_SKELETON))


def lower_bound(toxic: int, other: int, toxic_texts: int, other_texts: int) -> float:
    """The log-odds of texts having an n-gram less one standard error."""
    odds = math.log((toxic + 0.5) / (toxic_texts + 1)) - math.log((other + 0.5) / (other_texts + 1))
    return odds - math.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


class Lexicon:
    """Words' weights from the n-grams that tell toxic from other texts: those whose log-odds are surely over 1."""

    def __init__(self, weights: dict[str, float], restorer: Restorer | None = None):
        self.weights, self.restorer = weights, restorer
        self.known: dict[str, float] = {}
        self.starts = {skeleton(g.strip("^$")) for g in weights}
        self.longest = max(map(len, self.starts), default=0)

    @classmethod
    def learn(cls, counts: dict[str, tuple[int, int]], toxic_texts: int, other_texts: int) -> Lexicon:
        """counts: an n-gram to how many toxic and other texts have it; of those in at least two toxic ones."""
        lows = {g: lower_bound(n, k, toxic_texts, other_texts) for g, (n, k) in counts.items() if n > 1}
        return cls({g: low for g, low in lows.items() if low > 1})

    def may_weigh(self, token: str) -> bool:
        """Whether any reading of a token can begin like a word of the lexicon: readings share the skeleton."""
        bare = token.lstrip(_EDGE)
        if "|" in token or len(bare) < len(token) and any(c in LOOKALIKES for c in token[: len(token) - len(bare)]):
            return True
        shape = skeleton(bare)
        return any(shape[:n] in self.starts for n in range(min(len(shape), self.longest) + 1))

    def weight(self, token: str) -> float:
        """The largest weight of the n-grams of a token, restored and as it is; 0 if it has none. Remembered.

        Without a restorer a token is its readings with BOTH between.
        """
        if (out := self.known.get(token)) is None:
            out, get = 0.0, self.weights.get
            if self.restorer is None:
                words = set(token.split(BOTH))
            else:
                words = {token, self.restorer.token(token)} if self.may_weigh(token) else ()
            for g in {g for word in words for g in grams(word.strip(_EDGE))}:
                out = max(out, get(g, 0.0))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[token] = out
        return out

    def features(self, tokens: set[str]) -> list[float]:
        """1, the largest weight, what it has over STRONG, and what other words have over 1: in all, and for the text's size."""
        w = sorted((x for x in map(self.weight, tokens) if x), reverse=True)
        top, over = w[0] if w else 0.0, [x - 1 for x in w]
        return [1.0, top, max(top - STRONG, 0.0), math.log1p(sum(over[1:])), 10 * sum(over) / (len(tokens) + 10)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients of a logistic model by Newton steps; the first column isn't shrunk."""
    beta, shrink = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return beta


class ToxicityModel:
    def __init__(self, chars: CharModel, weights: dict[str, float], beta: list[float]):
        self.chars, self.beta, self.restore = chars, beta, Restorer(chars)
        self.lexicon = Lexicon(weights, self.restore)

    def __reduce__(self):
        return ToxicityModel, (self.chars, self.lexicon.weights, self.beta)

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.beta, self.lexicon.features(self.restore.tokens(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fold(doc_id: int) -> int:
    return doc_id // 7 % 2


def _gram_counts(sampled: DataFrame, label: int, only: frozenset | None) -> dict[str, list[int]]:
    """How many texts of a label have each n-gram, by fold: of toxic texts those in at least two, of others the ones asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc_id, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {g for both in words.split() for w in both.split(BOTH) for g in grams(w)}
                found.update((g, _fold(doc_id)) for g in (own if only is None else own & only))
        rows = list(found.items())
        yield pa.record_batch([pa.array([g for (g, _), _ in rows], pa.string()), pa.array([f for (_, f), _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["gram", "fold", "n"])

    each = sampled.where(F.col("label") == label).select("doc_id", "words").mapInArrow(run, "gram string, fold int, n long")
    added = each.groupBy("gram").agg(*(F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in (0, 1)))
    return {r["gram"]: [r["n0"], r["n1"]] for r in (added.where("n0 + n1 > 1") if label else added).collect()}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 1500, seed: int = 3) -> ToxicityModel:
    """Fits on at most `fit_rows` toxic and twice as many other labelled documents, whole texts of any length.

    The character model counts all documents; of it at most 29^3 sums come to the driver, of the
    sample the counts of n-grams that two toxic texts have, and a few numbers a text. Without toxic
    labels every text scores near 0. Repeated rows of a doc_id are texts of their own; other columns
    than doc_id and text aren't read.
    """
    chars = CharModel({r["gram"]: r["n"] for r in char_counts(docs).collect()})
    own = learnable(labels, "toxic").select("doc_id", (F.col("label") > 0).cast("int").alias("label"))
    rates = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = own.where("label = 1").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_rows).unionByName(own.where("label = 0").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(2 * fit_rows))

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(chars)
        for batch in batches:
            words = [" ".join({BOTH.join(sorted({w.strip(_EDGE), restore.token(w).strip(_EDGE)})) for w in restore.tokens(t)}) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(words, pa.string())], ["doc_id", "label", "words"])

    sampled = keep(sample(docs, chosen, 3 * fit_rows, seed).mapInArrow(restored, "doc_id long, label int, words string"), "toxic-sample")
    sizes = {(r["label"], r["fold"]): r["n"] for r in sampled.groupBy("label", F.expr("pmod(doc_id div 7, 2)").alias("fold")).agg(F.count("*").alias("n")).collect()}
    texts = lambda label, folds=(0, 1): sum(sizes.get((label, f), 0) for f in folds)
    if not texts(1) or not texts(0):
        rate = (rates.get(1, 0) + 0.5) / (sum(rates.values()) + 1)
        drop(sampled)
        return ToxicityModel(chars, {}, [math.log(rate / (1 - rate)), *[0.0] * (FEATURES - 1)])
    toxic = _gram_counts(sampled, 1, None)
    other = _gram_counts(sampled, 0, frozenset(toxic))
    learn = lambda folds: Lexicon.learn({g: (sum(n[f] for f in folds), sum(other.get(g, (0, 0))[f] for f in folds)) for g, n in toxic.items()}, texts(1, folds), texts(0, folds))
    # each half's features are those that the other half's lexicon gives
    halves = sampled.sparkSession.sparkContext.broadcast([learn((1,)).weights, learn((0,)).weights])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(w) for w in halves.value]
        for batch in batches:
            rows = [lexicons[_fold(i)].features(set(w.split())) for i, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = sorted((r["doc_id"], r["label"], r["x"]) for r in sampled.mapInArrow(featured, "doc_id long, label int, x array<double>").collect())
    drop(sampled)
    y = np.array([r[1] for r in rows])
    beta = logistic(np.array([r[2] for r in rows]), y)
    beta[0] += math.log((rates[1] / rates[0]) / (y.sum() / (len(y) - y.sum())))
    return ToxicityModel(chars, learn((0, 1)).weights, beta.tolist())


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null text is empty, and whole texts of any length count.

    The model is of bounded size. Repeated rows get equal scores, an empty table none; other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whatever their names, whose text scores below the threshold.

    Null and empty texts score like any text without toxic words; repeated rows stay or go together.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([held.value.score(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
