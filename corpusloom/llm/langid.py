"""Language of words and documents by a linear-chain conditional random field.

A word's emission score sums weights of its hashed affixes, character n-grams, itself and
its entry in a learned lexicon; learned transitions say how seldom a text changes its
language. Forward-backward gives every word's posterior in its sentence, so that text that
switches between languages is labelled word by word; a document's language is the one
with the largest posterior mass over all its words.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bare, packed, unpacked

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: The model is fitted on this many labelled texts of a language at most, and on at most so many characters of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 20_000
HASH_BITS, EPOCHS, BATCH, STEPS, RATE = 16, 4, 256, 32, 0.5
#: Training sequences of STEPS words, cut from the sample and joined across languages.
SEQUENCES = 6_000
#: Words whose emissions a task remembers, and words that it scores at once.
CACHE_WORDS, CHUNK_WORDS = 300_000, 600_000


def words_of(text: str | None) -> list[str]:
    found = WORD.findall((text or "").lower())
    letters = [w for w in found if w.isalpha()]
    return letters or [w for w in found if any(map(str.isalpha, w))]


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    marked = f"^{word}$"
    names = [f"w{word}", *(f"p{word[:k]}" for k in (1, 2, 3)), *(f"s{word[-k:]}" for k in (1, 2, 3)), *(f"t{marked[i : i + 3]}" for i in range(len(marked) - 2))]
    if word in lexicon:
        names.append(f"l{lexicon[word]}")
    mask = (1 << HASH_BITS) - 1
    return [crc32(n.encode("utf-8", "replace")) & mask for n in names]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posteriors (words, labels) of texts laid end to end; texts step together, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    emit = np.exp(scores - scores.max(1, keepdims=True))
    go = np.exp(moves)
    alpha, post = np.empty_like(emit), np.empty_like(emit)
    for t, n in enumerate(active):
        at = begins[:n] + t
        now = emit[at] * (np.exp(start) if t == 0 else alpha[at - 1] @ go)
        alpha[at] = now / now.sum(1, keepdims=True)
    beta = np.ones((len(lengths), emit.shape[1]))
    for t in range(len(active) - 1, -1, -1):
        at = begins[: active[t]] + t
        b = beta[: active[t]]
        p = alpha[at] * b
        post[at] = p / p.sum(1, keepdims=True)
        b = (emit[at] * b) @ go.T
        beta[: active[t]] = b / b.sum(1, keepdims=True)
    return post


@dataclass
class Model:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)
    known: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "known": []}

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.known = {}, []
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if new:
            lists = [features(w, self.lexicon) for w in new]
            flat = np.fromiter((x for f in lists for x in f), np.int64)
            ends = np.cumsum([0, *(len(f) for f in lists)])[:-1]
            self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new)), strict=True))
            self.known.append(np.add.reduceat(self.weights[flat], ends, axis=0))
            self.known = [np.concatenate(self.known)]
        return self.known[0][np.fromiter((self.cache[w] for w in words), np.int64, len(words))]

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Posteriors of each text's words; texts must have words."""
        lengths = np.array([len(t) for t in texts], np.int64)
        post = forward_backward(self.emissions([w for t in texts for w in t]).astype(float), lengths, self.start, self.moves)
        return np.split(post, np.cumsum(lengths)[:-1])


def fit(texts: list[tuple[str, str]], seed: int = 5) -> Model:
    """Fit on (text, label) by stochastic gradient of the conditional likelihood.

    Sequences join pieces of several languages, as code-switched text does; the transitions
    are learned from those.
    """
    labels = sorted({label for _, label in texts})
    if not labels:
        return Model([], {}, np.zeros((1 << HASH_BITS, 0)), np.zeros(0), np.zeros((0, 0)))
    rng, number = np.random.default_rng(seed), {x: i for i, x in enumerate(labels)}
    pools: list[list[list[str]]] = [[] for _ in labels]
    counts: dict[str, Counter] = {}
    for text, label in texts:
        words = words_of(text)
        for w in words:
            counts.setdefault(w, Counter())[number[label]] += 1
        pools[number[label]] += [words[i : i + STEPS] for i in range(0, len(words), STEPS)]
    lexicon = {w: c.most_common(1)[0][0] for w, c in counts.items() if sum(c.values()) >= 3 and c.most_common(1)[0][1] >= 0.9 * sum(c.values())}
    open_pools = [i for i, p in enumerate(pools) if p]
    model = Model(labels, lexicon, np.zeros((1 << HASH_BITS, len(labels))), np.zeros(len(labels)), np.zeros((len(labels), len(labels))))
    if not open_pools:
        return model
    lines, golds = [], []
    for _ in range(SEQUENCES):
        words, gold = [], []
        while len(words) < STEPS:
            k = open_pools[rng.integers(len(open_pools))]
            piece = pools[k][rng.integers(len(pools[k]))]
            piece = piece[: rng.integers(8, STEPS + 1)]
            words += piece
            gold += [k] * len(piece)
        lines.append(words[:STEPS])
        golds.append(gold[:STEPS])
    memo: dict[str, list[int]] = {}
    feats = [[memo.get(w) or memo.setdefault(w, features(w, lexicon)) for w in line] for line in lines]
    gold = np.array(golds)
    grown = np.full(model.weights.shape, 1e-3)
    grown_moves, grown_start = np.full(model.moves.shape, 1e-3), np.full(len(labels), 1e-3)
    one = np.eye(len(labels))
    for _ in range(EPOCHS):
        order = rng.permutation(len(lines))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            lists = [f for i in pick for f in feats[i]]
            sizes = np.array([len(f) for f in lists])
            flat = np.fromiter((x for f in lists for x in f), np.int64, sizes.sum())
            scores = np.add.reduceat(model.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            post, pairs = _batch_posteriors(scores.reshape(len(pick), STEPS, -1), model.start, model.moves)
            wrong = post - one[gold[pick]]
            slope = np.stack([np.bincount(flat, np.repeat(wrong[..., k].ravel(), sizes), 1 << HASH_BITS) for k in range(len(labels))], 1) / len(pick)
            slope_moves = (pairs - np.einsum("bti,btj->ij", one[gold[pick]][:, :-1], one[gold[pick]][:, 1:])) / len(pick)
            slope_start = wrong[:, 0].mean(0)
            for value, s, g in ((model.weights, slope, grown), (model.moves, slope_moves, grown_moves), (model.start, slope_start, grown_start)):
                g += s * s
                value -= RATE * s / np.sqrt(g)
    return model


def _batch_posteriors(scores: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    emit, go = np.exp(scores - scores.max(-1, keepdims=True)), np.exp(moves)
    steps = emit.shape[1]
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    for t in range(steps):
        now = emit[:, t] * (np.exp(start) if t == 0 else alpha[:, t - 1] @ go)
        alpha[:, t] = now / now.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (emit[:, t + 1] * beta[:, t + 1]) @ go.T
        beta[:, t] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(-1, keepdims=True)
    pairs = np.zeros_like(moves)
    for t in range(steps - 1):
        joint = alpha[:, t, :, None] * go * (emit[:, t + 1] * beta[:, t + 1])[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return post, pairs


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most sample_texts texts of each language, those of the smallest hash of id and text.

    Of a text longer than sample_chars that many characters from a hashed place on are
    taken, so long texts teach like others. The sample is what the driver gets; its bound
    is sample_texts x sample_chars a language. It is thinned by the languages' counts of
    different rows (a sketch of 2 %) before it is ranked, so no task reads a language; a row
    that repeats counts and teaches once. Rows without a text or a language teach nothing.
    """
    text = bare(text_col)
    usable = labelled.filter(text.isNotNull() & bare(lang_col).isNotNull())
    rows = usable.select(bare(lang_col).alias("lang"), F.xxhash64(bare(id_col), text).alias("h"), text.alias("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).withColumnRenamed("lang", "n_lang")
    u = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    # Twice as many as are taken, and a few: too few come out once in 10 ** 20 samples.
    near = rows.join(F.broadcast(counts), F.col("lang") == F.col("n_lang")).filter(u * F.col("n") <= 2 * sample_texts + 50)  # one row a language
    at = F.floor(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.greatest(F.length("text") - sample_chars, F.lit(0))).cast("int")
    piece = F.when(F.length("text") <= sample_chars, F.col("text")).otherwise(F.substr("text", at + 1, F.lit(sample_chars)))
    near = near.select("lang", "h", piece.alias("text")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(u, "h", "text"))
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= sample_texts).select("lang", "h", "text").collect()
    return fit([(r["text"], r["lang"]) for r in sorted(chosen, key=lambda r: (r["lang"], r["h"], r["text"]))])


def _scorer(spark: SparkSession, model: Model, by_word: bool):
    shared = spark.sparkContext.broadcast(model)
    kind = "lang string, score double" + (", words array<struct<word:string,lang:string,score:double>>" if by_word else "")

    @F.pandas_udf(kind)
    def score(texts: pd.Series) -> pd.DataFrame:
        model, rows = shared.value, [(UNKNOWN, 0.0) + ([],) * by_word] * len(texts)

        def settle(batch: list[tuple[int, list[str]]]) -> None:
            for (i, words), post in zip(batch, model.posteriors([w for _, w in batch]), strict=True):
                mass = post.mean(0)
                k = int(mass.argmax())
                rows[i] = (model.labels[k], min(1.0, float(mass[k])))
                if by_word:
                    best = post.argmax(1)
                    rows[i] += ([{"word": w, "lang": model.labels[b], "score": float(p[b])} for w, b, p in zip(words, best, post, strict=True)],)

        batch, size = [], 0
        for i, text in enumerate(texts):
            words = words_of(text) if model.labels else []
            if words:
                batch.append((i, words))
                size += len(words)
            if size >= CHUNK_WORDS:
                settle(batch)
                batch, size = [], 0
        if batch:
            settle(batch)
        return pd.DataFrame(rows, columns=["lang", "score"] + ["words"] * by_word)

    return score


def label_language(docs: DataFrame, model: Model, text_col: str = "text", by_word: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (its share of the posterior), and the labelled words if asked.

    Texts that are null or have no letter are ``und`` with score 0, as all are when the
    model has learned no language.
    """
    scored = docs.select(packed(docs), _scorer(docs.sparkSession, model, by_word)(bare(text_col)).alias("s"))
    out = {"lang_pred": F.col("s.lang"), "score": F.col("s.score")}
    return unpacked(scored, docs.columns, out | ({"words": F.col("s.words")} if by_word else {}))
