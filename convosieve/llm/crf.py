"""Language identification by a linear-chain conditional random field over words.

The label of a word is its language.  A word's potentials are sums of learned weights of its features (lexicons, the word, affixes and
character n-grams, hashed), neighbours are tied by learned transitions.  Training sequences switch language between runs of words of
different documents; each word has its document's language.  A document gets the language with the largest sum of the words'
forward-backward marginals.

Fitting takes a documented, bounded sample of about `fit_docs` documents per language, chosen by the hash of their id.  Whole documents are
chained: blocks of words become transfer matrices first, then the chain runs over blocks, then inside them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.llm.common import Memo, arrow_schema, batch, fold, pairs, sliced

BUCKETS = 1 << 16
LEXICON = 300
SEQUENCE = 64
BLOCK = 32
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; empty when there is no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w[:1]) or any(c.isalpha() for w in found for c in w) else []


def feature_ids(word: str, lexicons: dict[str, int]) -> list[int]:
    """Buckets of the word's features; `lexicons` has a bit per language for its most frequent words."""
    edged = f"^{word}$"
    names = [f"w{word}", f"l{lexicons.get(word, 0)}"]
    names += [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    names += [f"g{edged[i : i + k]}" for k in (2, 3) for i in range(len(edged) - k + 1)]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


@dataclass
class Model:
    languages: list[str]
    lexicons: dict[str, int]
    weights: np.ndarray  # BUCKETS x languages
    transitions: np.ndarray  # log potentials, from x to


def _forward_backward(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, length, labels) and summed transition expectations of equally long sequences; e and t are potentials."""
    n, length, labels = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    state = np.full((n, labels), 1 / labels)
    for i in range(length):
        state = (state @ t) * e[:, i]
        state /= state.sum(axis=1, keepdims=True)
        alpha[:, i] = state
    moves, state = np.zeros_like(t), np.ones((n, labels))
    for i in range(length - 1, -1, -1):
        beta[:, i] = state
        after = e[:, i] * state
        before = alpha[:, i - 1] if i else np.full((n, labels), 1 / labels)
        joint = (before @ t * after).sum(axis=1, keepdims=True)
        moves += t * (before.T @ (after / joint))
        state = after @ t.T
        state /= state.sum(axis=1, keepdims=True)
    marginals = alpha * beta
    return marginals / marginals.sum(axis=2, keepdims=True), moves


def fit(rows: list[tuple[str, str]], rounds: int = 60, rate: float = 0.2, ridge: float = 1e-5, seed: int = 7) -> Model:
    """From (language, text); without rows there is no language and every document is undetermined."""
    languages = sorted({lang for lang, _ in rows})
    found = [(languages.index(lang), letter_words(text)) for lang, text in rows]
    found = [f for f in found if f[1]]
    counts = [Counter() for _ in languages]
    for k, own in found:
        counts[k].update(own)
    lexicons: dict[str, int] = {}
    for k, own in enumerate(counts):
        for word, _ in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicons[word] = lexicons.get(word, 0) | 1 << k
    weights, transitions = np.zeros((BUCKETS, len(languages))), np.zeros((len(languages), len(languages)))
    if not found:
        return Model(languages, lexicons, weights, transitions)
    # Runs of 4 to 24 words; each next run is taken from any document, so sequences switch language.
    rng, runs = np.random.default_rng(seed), []
    for k, own in found:
        at = 0
        while at < len(own):
            step = int(rng.integers(4, 25))
            runs.append((k, own[at : at + step]))
            at += step
    order = np.arange(len(runs))
    swapped = rng.permutation(np.flatnonzero(rng.random(len(runs)) < 0.3))
    order[np.sort(swapped)] = swapped
    labels = np.array([k for r in order for k in [runs[r][0]] * len(runs[r][1])])
    types: dict[str, int] = {}
    tokens = np.array([types.setdefault(w, len(types)) for r in order for w in runs[r][1]])
    n = max(1, len(tokens) // SEQUENCE)
    tokens, labels = (np.resize(x, n * SEQUENCE) for x in (tokens, labels))
    ids = [feature_ids(w, lexicons) for w in types]
    flat, owner = np.concatenate([np.array(i) for i in ids]), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])[:-1]])
    size, kinds = len(types), len(languages)
    truth = np.eye(kinds)[labels]
    observed = np.zeros_like(transitions)
    pairs_ = labels.reshape(n, SEQUENCE)
    np.add.at(observed, (pairs_[:, :-1].ravel(), pairs_[:, 1:].ravel()), 1)
    observed += np.bincount(pairs_[:, 0], minlength=kinds) / kinds  # a sequence starts from any label
    means, squares = [np.zeros_like(weights), np.zeros_like(transitions)], [np.zeros_like(weights), np.zeros_like(transitions)]
    for step in range(1, rounds + 1):
        by_type = np.add.reduceat(weights[flat], starts, axis=0)
        e = by_type[tokens]
        e = np.exp(e - e.max(axis=1, keepdims=True)).reshape(n, SEQUENCE, kinds)
        marginals, moves = _forward_backward(e, np.exp(transitions))
        wrong = marginals.reshape(-1, kinds) - truth
        of_type = np.stack([np.bincount(tokens, wrong[:, k], size) for k in range(kinds)], axis=1)
        gradient = np.stack([np.bincount(flat, of_type[owner, k], BUCKETS) for k in range(kinds)], axis=1) / len(tokens) + ridge * weights
        for j, (g, w) in enumerate(((gradient, weights), ((moves - observed) / len(tokens), transitions))):
            means[j] = 0.9 * means[j] + 0.1 * g
            squares[j] = 0.99 * squares[j] + 0.01 * g * g
            w -= rate * (means[j] / (1 - 0.9**step)) / (np.sqrt(squares[j] / (1 - 0.99**step)) + 1e-8)
    return Model(languages, lexicons, weights, transitions)


class Tagger:
    def __init__(self, model: Model):
        self.model, self.labels = model, len(model.languages)
        self.t = np.exp(model.transitions)
        self.table, self.used = np.zeros((1 << 16, self.labels)), 0
        self.places = Memo(self._place)

    def _place(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        own = self.model.weights[feature_ids(word, self.model.lexicons)].sum(axis=0)
        self.table[self.used] = np.exp(own - own.max())
        self.used += 1
        return self.used - 1

    def words(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The marginals of all words, and where each document begins among them; documents must not be empty."""
        if len(self.places) > PLACES:
            self.places = Memo(self._place)
            self.used = 0
        at = [list(map(self.places.__getitem__, d)) for d in docs]
        lengths = np.array([len(d) for d in at])
        blocks = -(-lengths // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        total = int(blocks.sum())
        real = np.zeros(total * BLOCK, bool)
        spots = np.concatenate([np.arange(n) + f * BLOCK for n, f in zip(lengths, first)])
        real[spots] = True
        e = np.ones((total * BLOCK, self.labels))
        e[spots] = self.table[np.concatenate([np.array(d) for d in at])]
        e, real = e.reshape(total, BLOCK, -1), real.reshape(total, BLOCK)
        carry = np.broadcast_to(np.eye(self.labels), (total, self.labels, self.labels))
        for i in range(BLOCK):
            step = (carry @ self.t) * e[:, i, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            carry = np.where(real[:, i, None, None], step, carry)
        enter, leave = np.full((total, self.labels), 1 / self.labels), np.ones((total, self.labels))
        for j in range(1, int(blocks.max())):
            b = first[blocks > j] + j
            state = np.einsum("ns,nst->nt", enter[b - 1], carry[b - 1])
            enter[b] = state / state.sum(axis=1, keepdims=True)
        for j in range(int(blocks.max()) - 2, -1, -1):
            b = first[blocks > j + 1] + j
            state = np.einsum("nst,nt->ns", carry[b + 1], leave[b + 1])
            leave[b] = state / state.sum(axis=1, keepdims=True)
        alpha, state = np.empty_like(e), enter
        for i in range(BLOCK):
            step = (state @ self.t) * e[:, i]
            state = np.where(real[:, i, None], step / step.sum(axis=1, keepdims=True), state)
            alpha[:, i] = state
        state = leave
        for i in range(BLOCK - 1, -1, -1):
            marginal = alpha[:, i] * state
            alpha[:, i] = marginal / marginal.sum(axis=1, keepdims=True)
            before = (e[:, i] * state) @ self.t.T
            state = np.where(real[:, i, None], before / before.sum(axis=1, keepdims=True), state)
        return alpha.reshape(total * BLOCK, -1)[spots], np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def shares(self, docs: list[list[str]]) -> np.ndarray:
        """Mean marginals of each document; documents must not be empty."""
        marginals, first = self.words(docs)
        return np.add.reduceat(marginals, first, axis=0) / np.array([len(d) for d in docs])[:, None]

    def spans(self, docs: list[list[str]]) -> list[list[tuple[int, int, str, float]]]:
        """Runs of words of one language in each document: first word, word behind the last, language, mean marginal."""
        marginals, first = self.words(docs)
        best, out = marginals.argmax(axis=1), []
        sure = marginals[np.arange(len(best)), best]
        for a, d in zip(first.tolist(), docs):
            own, n = best[a : a + len(d)], len(d)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n]
            out.append([(i, j, self.model.languages[own[i]], float(min(1.0, sure[a + i : a + j].mean()))) for i, j in zip(cuts, cuts[1:])])
        return out


PREDICTIONS = "doc_id long, lang_pred string, score double"
SPANS = "doc_id long, start_word long, end_word long, lang string, score double"
#: Words whose weights a worker keeps, and texts that the model is fitted on at most (but one a language).
PLACES, FIT_ROWS = 400_000, 20_000
#: Words that are chained at once, documents kept whole.
CHUNK_WORDS = 200_000


def _of_documents(tagger: Tagger, chunk: list[tuple]) -> list[tuple]:
    """PREDICTIONS: the language of the largest mean marginal."""
    names = tagger.model.languages
    some = [k for k, (_, found) in enumerate(chunk) if found and names]
    out = [(doc_id, UNKNOWN, 0.0) for doc_id, _ in chunk]
    if some:
        for k, share in zip(some, tagger.shares([chunk[k][1] for k in some])):
            best = int(share.argmax())
            out[k] = (chunk[k][0], names[best], float(min(1.0, share[best])))
    return out


def _of_words(tagger: Tagger, chunk: list[tuple]) -> list[tuple]:
    """SPANS."""
    some = [(doc_id, found) for doc_id, found in chunk if found and tagger.model.languages]
    runs = tagger.spans([found for _, found in some]) if some else []
    return [(doc_id, *span) for (doc_id, _), own in zip(some, runs) for span in own]


def _predict(model, schema: pa.Schema, of):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Model(**model.value))
        for own in sliced(batches):
            chunk, size = [], 0
            for doc_id, text in pairs(own, "doc_id", "text"):
                chunk.append((doc_id, letter_words(text)))
                size += len(chunk[-1][1])
                if size >= CHUNK_WORDS:
                    yield batch(of(tagger, chunk), schema)
                    chunk, size = [], 0
            if chunk:
                yield batch(of(tagger, chunk), schema)

    return predict


def sample(docs: DataFrame, fit_docs: int, parts: int, held: int, fit_rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """(language, text) of `fit_docs` rows a language outside the held-out fold, those with the lowest hashes of their id; all of a
    language that has fewer.  With so many languages that these were over `fit_rows`, each has an equal smaller share, one at least."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold("doc_id", parts) != held)
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    share = max(1, min(fit_docs, fit_rows // max(1, counts.count())))
    place = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)).alias("place")
    near = usable.select("doc_id", "lang", "text", place).join(counts, "lang").where(F.col("place") < max(2 * share, 20) / F.col("n"))
    rows: dict[str, list] = {}
    for r in near.select("lang", "place", "doc_id", "text").collect():
        rows.setdefault(r["lang"], []).append((r["place"], str(r["doc_id"]), r["text"]))
    return [(lang, text) for lang in sorted(rows) for _, _, text in sorted(rows[lang])[:share]]


def _model(docs: DataFrame, fit_docs: int, parts: int, held: int):
    return docs.sparkSession.sparkContext.broadcast(vars(fit(sample(docs, fit_docs, parts, held))))  # BUCKETS x languages numbers and the lexicons


def languages(docs: DataFrame, fit_docs: int = 250, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of `docs`; text and language of held-out ids are never learned from.

    Texts that are null or have no letter are `und` with score 0, like all texts when no language is known.  Every language with a row
    to learn from is learned.  Very long texts are chained whole; repeated rows each have a row; null ids count as the text `null` for
    the fold; an empty table gives no rows.  Other columns are not read and may have any name.
    """
    model = _model(docs, fit_docs, parts, held)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model, arrow_schema(PREDICTIONS), _of_documents), PREDICTIONS)
    return rows.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "lang_pred", "score")


def word_languages(docs: DataFrame, fit_docs: int = 250, parts: int = 4, held: int = 2) -> DataFrame:
    """SPANS: the runs of words (with a letter, from 0) of one language in every text, from the marginals that `languages` averages.
    Texts without such a word have no rows; other cases as in `languages`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_predict(_model(docs, fit_docs, parts, held), arrow_schema(SPANS), _of_words), SPANS)
