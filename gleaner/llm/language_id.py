"""Operator 7: language of a text by a linear-chain conditional random field over its words.

Each word of a text is labelled with a language, so code-switched text gets both of its languages. A word's features are its affixes (1 to 3
letters), its letter n-grams (2 and 3, with its boundaries) and, if the lexicon has it, itself; features are hashed into a table of weights
per language. Transitions between neighbouring words' languages are learned with them, on chains cut from one language and on chains spliced
from two. Forward-backward gives each word's marginals, a whole text being one chain; a text's language is the one with the largest sum of them, and
its score that sum's share.

The field is fitted on the driver from a bounded sample of labelled rows: SAMPLE texts a language, of at most SPAN characters each, and with
many languages an equal share of TEXTS for each, so all languages are learned. Of these texts' chains of 24 words it takes at most CHAINS, an
equal share for each language, and splices a quarter as many. Prediction is one map over all whole texts. The weights, TABLE x languages, are
what is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.token_counts import in_parts

SAMPLE, SPAN, TEXTS, CHAINS = 300, 3000, 20_000, 4000
#: Groups that a language's rows are ranked in first.
SHARES = 64
#: Letters of a piece of a word: longer words are several pieces.
LETTERS = 24
WORDS = re.compile(r"[^\W\d_]{1,%d}" % LETTERS)
TABLE = 1 << 16
CACHED = 100_000
UNKNOWN = "und"
PRIME = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


def bucket(*parts: np.ndarray, salt: int) -> np.ndarray:
    h = np.uint32(salt * int(PRIME[0]) & 0xFFFFFFFF)
    for p, k in zip(parts, PRIME[1:]):
        h = (h ^ p) * k
        h = h ^ (h >> np.uint32(15))
    return (h % np.uint32(TABLE - 1)).astype(np.int32) + 1  # 0: no feature


def features(words: list[str], lexicon: frozenset[str]) -> np.ndarray:
    """Indices of each word's features in the table, a row a word."""
    n = len(words)
    code = np.zeros((n, LETTERS + 2), np.uint32)
    code[:, 0] = 1
    code[:, 1:-1] = np.array(words, f"<U{LETTERS}").view("<u4").reshape(n, LETTERS)
    size = np.fromiter(map(len, words), np.int64, n)
    code[np.arange(n), size + 1] = 2
    a, b, c = code[:, :-1], code[:, 1:], code[:, 2:]
    two = np.where(b > 0, bucket(a, b, salt=2), 0)
    three = np.where(c > 0, bucket(a[:, :-1], b[:, :-1], c, salt=3), 0)
    affixes = []
    row = np.arange(n)
    none = np.zeros(n, np.uint32)
    for k in (1, 2, 3):
        head = [code[:, 1 + i] if i < k else none for i in range(3)]
        tail = [code[row, np.maximum(size - i, 0)] if i < k else none for i in range(3)]
        has = size >= k
        affixes += [np.where(has, bucket(*head, salt=10 + k), 0), np.where(has, bucket(*tail, salt=20 + k), 0)]
    own = np.fromiter((1 if w in lexicon else 0 for w in words), bool, n)
    mark = code[:, 1].copy()
    for i in range(2, LETTERS + 1):
        mark = mark * PRIME[3] + code[:, i]
    affixes.append(np.where(own, bucket(mark, salt=30), 0))
    return np.concatenate([two, three, np.stack(affixes, 1)], axis=1)


@dataclass
class Field:
    """Labels, weights (TABLE x labels; row 0 is no feature), transitions (from, to) and the lexicon."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: frozenset[str]

    def emissions(self, words: list[str]) -> np.ndarray:
        out = [self.weights[features(words[i : i + 4096], self.lexicon)].sum(axis=1) for i in range(0, len(words), 4096)]
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)


def forward_backward(score: np.ndarray, moves: np.ndarray, size: np.ndarray, enter=1.0, leave=1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains' scores (chain, step, label) to marginals, and forward and backward messages (each step normalised); zero beyond a chain's size.

    enter, leave: the messages (chain, label) that come in before a chain's first step, and after its last.
    """
    n, steps, _ = score.shape
    e = np.exp(score - score.max(axis=2, keepdims=True))
    a = np.exp(moves)
    ahead, back = np.empty_like(e), np.empty_like(e)
    now = e[:, 0] * enter
    ahead[:, 0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        now = (ahead[:, t - 1] @ a) * e[:, t]
        ahead[:, t] = now / now.sum(axis=1, keepdims=True)
    back[:, -1] = leave
    for t in range(steps - 2, -1, -1):
        now = (back[:, t + 1] * e[:, t + 1]) @ a.T
        now /= now.sum(axis=1, keepdims=True)
        back[:, t] = np.where((t + 1 < size)[:, None], now, leave)
    both = ahead * back
    both /= both.sum(axis=2, keepdims=True)
    both *= (np.arange(steps) < size[:, None])[:, :, None]
    return both, ahead, back * e


def fit(sample: list[tuple[str, str]], rounds: int = 3, seed: int = 5) -> Field:
    """A field from (language, text) pairs, by AdaGrad on the conditional likelihood of chains of 24 words."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in sample})
    number = {lang: i for i, lang in enumerate(labels)}
    texts = [(number[lang], WORDS.findall(text.lower())) for lang, text in sample]
    seen: dict[str, int] = {}
    for _, words in texts:
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1
    lexicon = frozenset(w for w, n in seen.items() if n >= 3)
    steps = 24
    chains = [(words[i : i + steps], [y] * steps) for y, words in texts for i in range(0, len(words) - steps + 1, steps)]
    few = [(words, [y] * len(words)) for y, words in texts if 0 < len(words) < steps]
    chains = [chains[i] for i in rng.permutation(len(chains))]
    share, taken = max(1, CHAINS // max(1, len(labels))), [0] * len(labels)
    picked = []
    for words, ys in chains:
        taken[ys[0]] += 1
        if taken[ys[0]] <= share:
            picked.append((words, ys))
    chains = picked
    for i in range(0, len(chains) - 1, 4):  # code-switched chains
        (p, x), (q, y) = chains[i], chains[i + 1]
        at = int(rng.integers(4, steps - 4))
        chains.append((p[:at] + q[at:], x[:at] + y[at:]))
    chains += few
    weights, moves = np.zeros((TABLE, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32)
    grown, grown_moves = np.full(weights.shape, 1e-4, np.float32), np.full(moves.shape, 1e-4, np.float32)
    index = {w: i for i, w in enumerate(sorted({w for words, _ in chains for w in words}))}
    table = features(list(index), lexicon) if index else np.zeros((0, 1), np.int32)
    for _ in range(rounds):
        order = rng.permutation(len(chains))
        for i in range(0, len(order), 64):
            part = [chains[j] for j in order[i : i + 64]]
            size = np.array([len(w) for w, _ in part])
            step = np.arange(size.max()) < size[:, None]
            word, label = np.zeros(step.shape, np.int64), np.zeros(step.shape, np.int64)
            word[step] = [index[w] for words, _ in part for w in words]
            label[step] = [y for _, ys in part for y in ys]
            used = table[word[step]]
            score = np.zeros((*step.shape, len(labels)), np.float32)
            score[step] = weights[used].sum(axis=1)
            marginal, ahead, back = forward_backward(score, moves, size)
            error = (np.eye(len(labels), dtype=np.float32)[label] - marginal)[step]
            grad = np.zeros_like(weights)
            for k in range(len(labels)):
                grad[:, k] = np.bincount(used.ravel(), np.repeat(error[:, k], used.shape[1]), TABLE)
            grad[0] = 0
            if step.shape[1] > 1:
                pair = ahead[:, :-1, :, None] * np.exp(moves) * back[:, 1:, None, :]
                pair /= pair.sum(axis=(2, 3), keepdims=True)
                there = step[:, 1:]
                true = np.zeros_like(moves)
                np.add.at(true, (label[:, :-1][there], label[:, 1:][there]), 1)
                grad_moves = true - pair[there].sum(axis=0)
                grown_moves += grad_moves**2
                moves += 0.3 * grad_moves / np.sqrt(grown_moves)
            grown += grad**2
            weights += 0.2 * grad / np.sqrt(grown)
    return Field(labels, weights, moves, lexicon)


def block_of(labels: int) -> int:
    """Words of a block, so that all blocks' products take a bounded number of values a word."""
    return 48 * max(1, labels * labels // 256)


def marginals(score: np.ndarray, moves: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The summed marginals (text, label) of texts, each one chain. score: (word, label) of the texts' words, count: words of each text (> 0).

    Forward-backward in blocks of words: each block's product of its steps' matrices takes messages across it at once, so they go from block to
    block of a text first, and then inside all blocks at the same time. The result is that of going word by word.
    """
    labels = score.shape[1]
    block = block_of(labels)
    blocks = -(-count // block)
    ends = np.cumsum(blocks)
    first = ends - blocks
    size = np.full(ends[-1], block)
    size[ends - 1] = count - (blocks - 1) * block
    step = np.arange(min(block, int(count.max()))) < size[:, None]
    each = np.zeros((*step.shape, labels), np.float32)
    each[step] = score
    enter, leave = np.ones((len(size), labels), np.float32), np.ones((len(size), labels), np.float32)
    most = int(blocks.max())
    if most > 1:
        e, a = np.exp(each - each.max(axis=2, keepdims=True)), np.exp(moves)
        long = np.flatnonzero(np.repeat(blocks, blocks) > 1)
        place = np.full(len(size), -1)
        place[long] = np.arange(len(long))
        across = np.eye(labels, dtype=np.float32) * e[long, 0][:, None, :]
        for t in range(1, step.shape[1]):
            now = (across @ a) * e[long, t][:, None, :]
            now /= now.sum(axis=(1, 2), keepdims=True)
            across = np.where((t < size[long])[:, None, None], now, across)
        for r in range(1, most):
            to = first[blocks > r] + r
            now = np.einsum("nl,nlm->nm", enter[to - 1], across[place[to - 1]]) @ a
            enter[to] = now / now.sum(axis=1, keepdims=True)
        for r in range(2, most + 1):
            to = ends[blocks >= r] - r
            now = np.einsum("nlm,nm->nl", across[place[to + 1]], leave[to + 1]) @ a.T
            leave[to] = now / now.sum(axis=1, keepdims=True)
    inside = forward_backward(each, moves, size, enter, leave)[0].sum(axis=1, dtype=np.float64)
    return np.add.reduceat(inside, first, axis=0)


class Labeller:
    """A worker's field with the emissions of the words it has met, at most CACHED."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(field.labels)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        distinct = set(words)
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known, self.table, new = {}, self.table[:0], list(distinct)
        if new:
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, self.field.emissions(new)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def predict(self, texts: Iterable[str]) -> list[tuple[str, float, dict[str, float]]]:
        """Language, score and each language's share of the words, of each text."""
        out = []
        for part in in_parts(texts):
            split = [WORDS.findall(t.lower()) for t in part]
            split = [w if any(c.isalpha() for x in w for c in x) else [] for w in split]
            count = np.array([len(w) for w in split])
            if not self.field.labels or not count.sum():
                out += [(UNKNOWN, 0.0, {})] * len(part)
                continue
            rows = self.rows([w for words in split for w in words])
            share = np.zeros((len(part), len(self.field.labels)))
            some = count > 0
            share[some] = marginals(self.table[rows], self.field.moves, count[some])  # a text is a chain
            share /= np.maximum(count, 1)[:, None]
            for n, s in zip(count, share):
                best = int(s.argmax())
                out.append((self.field.labels[best], float(min(1.0, s[best])), dict(zip(self.field.labels, s.tolist()))) if n else (UNKNOWN, 0.0, {}))
        return out


def language(text: Column, field: Field, spark) -> Column:
    """struct<lang, score>: UNKNOWN with 0 for a null text or one without a letter."""
    sent = spark.sparkContext.broadcast(field)
    labeller: list[Labeller] = []

    @F.arrow_udf("struct<lang:string,score:double>")
    def label(texts: pa.Array) -> pa.Array:
        if not labeller:
            labeller.append(Labeller(sent.value))
        found = labeller[0].predict(t.as_py() or "" for t in texts)
        return pa.array([{"lang": a, "score": s} for a, s, _ in found], pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return label(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame) -> Field:
    """The field of the rows that aren't held out and have a text and a lang. The sample is the same in every run."""
    mark = F.xxhash64("text")
    rows = docs.select("doc_id", "lang", "text", mark.alias("mark")).filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    each = max(1, min(SAMPLE, TEXTS // max(1, rows.select("lang").distinct().count())))
    spot = F.xxhash64("doc_id")
    some = F.substring(F.col("text"), 1 + F.pmod(spot, F.greatest(F.length("text") - SPAN, F.lit(1))).cast("int"), F.lit(SPAN))
    # The first of each share are ranked before the first of all, so that a language of any size is many groups and leaves SHARES * SAMPLE rows.
    picked = rows.select("doc_id", "lang", "mark", spot.alias("spot")).withColumn("share", F.pmod(F.shiftright("spot", 32), F.lit(SHARES)))
    for group in (["lang", "share"], ["lang", F.pmod("share", F.lit(8))], ["lang"]):
        ordered = F.row_number().over(Window.partitionBy(*group).orderBy("spot", "doc_id", "mark"))
        picked = picked.withColumn("n", ordered).filter(F.col("n") <= each)
    key = ["doc_id", "lang", "mark"]
    sample = rows.join(F.broadcast(picked.select(*key).distinct()), key).groupBy(*key).agg(F.min(some).alias("text")).collect()
    return fit([(r.lang, r.text) for r in sorted(sample, key=lambda r: (r.lang, r.doc_id, r.text))])


def identify(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row. lang, source and doc_id teach, but are no input of a prediction.

    A null text or one without a letter is UNKNOWN with score 0, as is every text if there is nothing to learn from. A null doc_id is neither
    learned from nor held out. Repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    field = field or fitted(docs)
    said = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(F.col("text"), field, docs.sparkSession).alias("l"))
    return said.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))
