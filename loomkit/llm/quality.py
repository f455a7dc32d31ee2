"""Quality rules: base counts of a text, and a linear-chain conditional random field that labels its lines.

Each line with a word is content or boilerplate. A line's features and the labels of neighbouring lines are weighed by a
conditional random field; Viterbi decoding gives the likeliest labels. A document is kept if enough of its words lie in
content lines. The weights are fitted to labelled documents: the lines of a good one are all content; those of a bad one are
hidden, except that not all of them are content. So boilerplate is what bad documents have and good ones don't, the plain
lines of a bad document stay content, and the moves between labels are learned from where they change inside documents.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.llm.common import annotate, named

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
MARKS = re.compile(r"""[!?.,;:'"()\[\]{}=_~^\\/@+-]""")
#: Labelled documents that weights are fitted to, at most; stretches of a document and lines of a stretch that the fit sees.
SAMPLE, STRETCHES, STRETCH = 1500, 4, 64
#: Share of words in content lines from which a document is kept.
SHARE = 0.5
FEATURES = ("always", "symbol in 1 of 50", "symbol in 1 of 20", "symbol in 1 of 8", "half upper case", "mostly upper case", "many digits", "a mark for each second word", "a mark for each word", "bang for each second word", "seen before", "under 4 words", "over 25 words", "few different words", "long words", "short words", "ends a sentence", "a bar")
BASE = T.StructType([*(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])


class Weights(NamedTuple):
    lines: np.ndarray  # [2, features]; row 1 is content
    moves: np.ndarray  # [2, 2], from label to label


def line_features(line: str, found: list[str], seen: bool) -> int:
    """The features of a line as bits, in the order of FEATURES."""
    n, size = len(found), len(line)
    symbols, marks = len(SYMBOLS.findall(line)), len(MARKS.findall(line))
    upper, letters = sum(map(str.isupper, line)), sum(map(str.isalpha, line)) or 1
    digits, chars = sum(map(str.isdigit, line)), sum(map(len, found))
    tests = (
        True, symbols * 50 > size, symbols * 20 > size, symbols * 8 > size, upper * 2 > letters, upper * 5 > letters * 4, digits * 5 > size, marks * 2 > n, marks > n,
        line.count("!") * 2 > n, seen, n < 4, n > 25, len(set(found)) * 2 < n, chars > 12 * n, chars < 3 * n, found[-1][-1] in ".!?", "|" in line,
    )
    return sum(1 << k for k, t in enumerate(tests) if t)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The likeliest labels of lines with scores[line, label]."""
    (aa, ab), (ba, bb) = moves.tolist()
    rows, back = scores.tolist(), []
    a, b = rows[0]
    for x, y in rows[1:]:
        to_a, to_b = a + aa >= b + ba, a + ab > b + bb
        a, b = (a + aa if to_a else b + ba) + x, (a + ab if to_b else b + bb) + y
        back.append((0 if to_a else 1, 0 if to_b else 1))
    label = 1 if b >= a else 0
    found = [label]
    for step in reversed(back):
        label = step[label]
        found.append(label)
    return found[::-1]


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words inside three-word windows that the text has twice or more; ids: the words as numbers under kinds."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if kinds < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.column_stack([ids[:-2], ids[1:-1], ids[2:]]), axis=0, return_inverse=True, return_counts=True)
    twice = counts[inverse.ravel()] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


class Lines(NamedTuple):
    """What the rules need of a text; of its words only numbers are held, so that a very long one fits."""

    words: np.ndarray  # equal ones have one number
    kinds: int
    chars: int  # in words
    features: list[int]  # of each line with a word
    sizes: list[int]  # its words
    again: int  # lines that equal an earlier one


def read_lines(text: str | None) -> Lines:
    numbers: dict[str, int] = {}
    ids, chars, features, sizes, seen, again = array("q"), 0, [], [], set(), 0
    for line in text.split("\n") if text else ():
        here = WORD.findall(line)
        if here:
            known = line in seen
            seen.add(line)
            again += known
            features.append(line_features(line, here, known))
            sizes.append(len(here))
            chars += sum(map(len, here))
            ids.extend([numbers.setdefault(w, len(numbers)) for w in here])
    return Lines(np.frombuffer(ids, np.int64) if ids else np.empty(0, np.int64), len(numbers), chars, features, sizes, again)


def matrix(features: list[int] | np.ndarray) -> np.ndarray:
    return ((np.array(features, np.int64)[:, None] >> np.arange(len(FEATURES))) & 1).astype(float)


def stretches(features: list[int]) -> list[list[int]]:
    """STRETCHES stretches of STRETCH lines at most, spread evenly over a document; all lines of a shorter one."""
    n = -(-len(features) // STRETCH)
    chosen = range(n) if n <= STRETCHES else [n * k // STRETCHES for k in range(STRETCHES)]
    return [features[k * STRETCH : (k + 1) * STRETCH] for k in chosen]


class Chains:
    """Sequences of lines for forward and backward sums, in steps: first all first lines, then all second ones, and so on."""

    def __init__(self, docs: list[list[int]]):
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        self.sizes = np.array([len(docs[i]) for i in order])
        self.order, most = np.array(order), int(self.sizes[0])
        self.live = [int((self.sizes > t).sum()) for t in range(most)]
        self.at = np.cumsum([0, *self.live])
        flat = np.array([docs[order[k]][t] for t in range(most) for k in range(self.live[t])], np.int64)
        #: Lines with the same features are one pattern.
        self.patterns, self.pattern = np.unique(flat, return_inverse=True)
        self.pattern, self.doc = self.pattern.ravel(), np.concatenate([np.arange(n) for n in self.live])
        self.X = matrix(self.patterns)

    def step(self, t: int) -> slice:
        return slice(self.at[t], self.at[t] + self.live[t])

    def sums(self, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each line the probabilities of its labels; of each line but first ones those of its and the label before; of each
        sequence the logarithms of the sum over all labellings and of the score of the one that is all content."""
        S = (self.X @ weights.lines.T)[self.pattern]
        A, B, moves = S.copy(), np.zeros_like(S), weights.moves
        for t in range(1, len(self.live)):
            now, last = self.step(t), slice(self.at[t - 1], self.at[t - 1] + self.live[t])
            A[now] += np.logaddexp(A[last, :1] + moves[0], A[last, 1:] + moves[1])
        for t in range(len(self.live) - 2, -1, -1):
            after, now = self.step(t + 1), slice(self.at[t], self.at[t] + self.live[t + 1])
            next_ = S[after] + B[after]
            B[now] = np.logaddexp(moves[:, 0] + next_[:, :1], moves[:, 1] + next_[:, 1:])
        first = self.step(0)
        Z = np.logaddexp(*(A[first] + B[first]).T)
        lines = np.exp(A + B - Z[self.doc][:, None])
        last = np.concatenate([np.arange(self.at[t - 1], self.at[t - 1] + n) for t, n in enumerate(self.live) if t] or [np.empty(0, np.int64)])
        now = np.arange(self.live[0], len(S))
        pairs = np.exp(A[last][:, :, None] + moves + (S[now] + B[now])[:, None, :] - Z[self.doc[now]][:, None, None])
        return lines, pairs, Z, np.bincount(self.doc, S[:, 1], len(self.sizes)) + (self.sizes - 1) * moves[1, 1]


def fit(docs: list[tuple[list[int], int]], rounds: int = 100, rate: float = 1.0, decay: float = 1e-4) -> Weights:
    """Weights that make what is known of the labels likeliest: gradient ascent on the mean log-likelihood.

    docs: the features of each sequence of lines; 1: all are content, 0: not all are. Without both kinds, every line is
    content. The gradient is what features and moves count under that condition less what they count without it. As there
    are many ways to say which lines are hidden boilerplate, the first rounds take each line by itself, with the label of its
    sequence as a noisy one: what good and bad documents both have comes out as content, and the condition starts from there.
    """
    docs = [(f, y) for f, y in docs if f]
    weights = Weights(np.zeros((2, len(FEATURES))), np.zeros((2, 2)))
    if len({y for _, y in docs}) < 2:
        weights.lines[1, 0] = 1.0
        return weights
    chains = Chains([f for f, _ in docs])
    good = np.array([y for _, y in docs])[chains.order] == 1
    share = 1 / chains.sizes / len(docs)  # a sequence counts once, however long
    of_line, of_pair = chains.doc, chains.doc[chains.live[0] :]
    speed = Weights(np.zeros_like(weights.lines), np.zeros_like(weights.moves))
    content, both = np.array([0.0, 1.0]), np.array([[0.0, 0.0], [0.0, 1.0]])
    for turn in range(2 * rounds):
        lines, pairs, Z, score = chains.sums(weights)
        all_content = np.exp(np.minimum(score - Z, 0))
        rest = np.maximum(1e-9, 1 - all_content)  # of probability, where not all lines are content
        p, q = all_content[of_line][:, None], all_content[of_pair][:, None, None]
        if turn < rounds:
            known, known_pairs = np.where(good[of_line][:, None], content, 1 - content), pairs
        else:
            known = np.where(good[of_line][:, None], content, np.clip((lines - p * content) / rest[of_line][:, None], 0, 1))
            known_pairs = np.where(good[of_pair][:, None, None], both, np.clip((pairs - q * both) / rest[of_pair][:, None, None], 0, 1))
        more = (known - lines) * share[of_line][:, None]
        pull = np.stack([np.bincount(chains.pattern, more[:, k], len(chains.patterns)) for k in (0, 1)]) @ chains.X
        pull_moves = ((known_pairs - pairs) * share[of_pair][:, None, None]).sum(0)
        speed = Weights(0.9 * speed.lines + pull - decay * weights.lines, 0.9 * speed.moves + pull_moves - decay * weights.moves)
        weights = Weights(weights.lines + rate * speed.lines, weights.moves + rate * speed.moves)
    return weights


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Weights from `sample` labelled documents at most, drawn by a hash of their ids; only line features reach the driver.

    labels has id_col and quality (1: content, 0: boilerplate); rows with nulls are left out. The ids drawn are broadcast:
    sample bounds them. Of several texts of one id that with the least hash counts, so equal tables give equal weights.
    """
    known = labels.where(F.col("quality").isNotNull() & named(id_col).isNotNull()).groupBy(named(id_col).alias("_id")).agg(F.max("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [stretches(read_lines(t).features) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(features, pa.list_(pa.list_(pa.int32()))), *batch.columns[1:]], ["features", "quality", "_id", "_hash"])

    texts = df.select(named(id_col).alias("_id"), named(text_col).alias("_text")).join(F.broadcast(drawn), "_id")
    texts = texts.select("_text", F.col("quality").cast("int"), "_id", F.xxhash64("_text").alias("_hash"))
    id_type = texts.schema["_id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"features array<array<int>>, quality int, _id {id_type}, _hash long")
    rows = found.groupBy("_id", "quality").agg(F.min(F.struct("_hash", "features")).alias("least")).select("quality", "least.features", "_id").collect()
    rows.sort(key=lambda r: r["_id"])
    return fit([(f, r.quality) for r in rows for f in r.features])


def judge(df: DataFrame, weights: Weights, share: float = SHARE, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share and kept.

    A null or empty text has no words: its base fails and its share is 0. Very long texts are judged whole. Rows are kept one
    for one, repeated ones too; columns of df with these names, in whatever case, are replaced. One map, no shuffle; the
    weights are a few dozen numbers.
    """

    def one(text: str | None) -> tuple:
        found = read_lines(text)
        n, symbols = len(found.words), len(SYMBOLS.findall(text)) if text else 0
        repeats = repeated_words(found.words, found.kinds)
        failed = n < 50 or 100 * repeats > 50 * n
        content = 0.0
        if n:
            labels = viterbi(matrix(found.features) @ weights.lines.T, weights.moves)
            content = sum(s for s, label in zip(found.sizes, labels) if label) / n
        return n, found.chars, symbols, found.again, repeats, failed, content, not failed and content >= share

    return annotate(df, text_col, lambda: lambda texts: list(map(one, texts)), BASE)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
