"""Toxicity: a linear classifier of words and word beginnings whose scores don't follow the identity a text speaks of."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._hash import mix
from cairn.llm._io import row_chunks, text_buffer
from cairn.llm.language import letter_runs, run_names, sample_bound

# Identity terms. Those of a line may stand for each other.
IDENTITY_TERMS = """
he she they
his her their
him hers theirs
himself herself themselves
man woman
men women
boy girl
boys girls
male female nonbinary
father mother parent
son daughter child
husband wife spouse
christian muslim jewish hindu buddhist sikh atheist catholic protestant
christians muslims jews hindus buddhists sikhs atheists catholics protestants
black white asian latino hispanic arab indigenous
blacks whites asians latinos hispanics arabs
african american european chinese indian mexican russian turkish jew
africans americans europeans mexicans russians turks
gay lesbian bisexual straight transgender queer heterosexual homosexual
gays lesbians bisexuals heterosexuals homosexuals
deaf blind disabled autistic
immigrant refugee foreigner native migrant
immigrants refugees foreigners natives migrants
er sie
mann frau
männer frauen
junge mädchen
christlich muslimisch jüdisch hinduistisch buddhistisch
christen muslime juden hindus buddhisten
schwarze weiße asiaten araber
schwul lesbisch bisexuell transgender
einwanderer flüchtling ausländer
il elle
homme femme
hommes femmes
garçon fille
chrétien musulman juif hindou bouddhiste athée
chrétiens musulmans juifs hindous bouddhistes athées
noir blanc asiatique arabe
noirs blancs asiatiques arabes
gai lesbienne bisexuel hétérosexuel
immigré réfugié étranger
immigrés réfugiés étrangers
él ella
hombre mujer
hombres mujeres
niño niña
cristiano musulmán judío hindú budista ateo
cristianos musulmanes judíos hindúes budistas ateos
negro blanco asiático árabe
negros blancos asiáticos árabes
lesbiana bisexual heterosexual
inmigrante refugiado extranjero
inmigrantes refugiados extranjeros
"""
#: A sentence ends at a full stop, a mark or a line's end; words are runs of letters.
SENTENCES, LETTERS = re.compile(r"[.!?\n]+"), re.compile(r"[^\W\d_]+")
#: A word counts as a whole and by its first letters, this many.
BEGINNINGS = range(3, 9)
_BASE, _WHOLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)


@lru_cache(maxsize=1)
def swaps() -> dict[str, list[str]]:
    """For each identity term the others of its line; a term of several lines belongs to the first."""
    out = {}
    for line in IDENTITY_TERMS.strip().split("\n"):
        terms = line.split()
        for t in terms:
            out.setdefault(t, [x for x in terms if x != t])
    return out


def features(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each run of letters and of its proper beginnings, and the number of the run each comes from."""
    sizes, word = ends - starts, np.arange(len(starts))
    prints, of = [mix(run_names(codes, starts, ends) ^ _WHOLE)], [word]
    held = np.zeros(len(starts), np.uint64)
    for k in range(max(BEGINNINGS)):
        word = word[sizes[word] > k + 1]  # a beginning isn't the whole word
        own = held[word] = mix((held[word] ^ codes[starts[word] + k].astype(np.uint64)) * _BASE + np.uint64(k))
        if k + 1 in BEGINNINGS:
            prints.append(own)
            of.append(word)
    return np.concatenate(prints), np.concatenate(of)


def feature_set(words: list[str]) -> np.ndarray:
    """The distinct features of some words."""
    codes, _, starts, ends = letter_runs(words)
    return np.unique(features(codes, starts, ends)[0]) if len(starts) else np.zeros(0, np.uint64)


@lru_cache(maxsize=4096)
def word_features(word: str) -> frozenset[int]:
    return frozenset(feature_set([word]).tolist())


def document_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once."""
    codes, offsets, starts, ends = letter_runs(texts)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prints, of = features(codes, starts, ends)
    doc = np.searchsorted(offsets, starts, "right")[of] - 1
    order = np.lexsort((prints, doc))
    doc, prints = doc[order], prints[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1])
    return doc[new], prints[new]


def counterfactuals(text: str):
    """(features lost, features won) of each sentence with identity terms, once each term gives way to another of its line.

    A feature that another word of the sentence holds is neither lost nor won. The replacements take turns by the
    term's place among the text's terms.
    """
    table, seen = swaps(), 0
    for sentence in SENTENCES.split(text.lower()):
        words = LETTERS.findall(sentence)
        terms = [w for w in words if w in table]
        if not terms:
            continue
        chosen = [table[w][(seen + i) % len(table[w])] for i, w in enumerate(terms)]
        seen += len(terms)
        old, new = (frozenset().union(*map(word_features, side)) for side in (terms, chosen))
        heads = {w[: BEGINNINGS[0]] for w in (*terms, *chosen)}
        near = [w for w in words if w not in table and w[: BEGINNINGS[0]] in heads]
        rest = set(feature_set(near).tolist()) if near else set()
        yield old - new - rest, new - old - rest


@dataclass
class ToxicityModel:
    prints: np.ndarray  # ascending fingerprints of the features that weigh
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.mask = np.uint64((1 << 20) - 1)
        self.near = np.zeros(1 << 20, bool)
        self.near[self.prints & self.mask] = True

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities: each feature of a text counts once, wherever and however often it stands."""
        codes, offsets, starts, ends = letter_runs(texts)
        logits = np.full(len(texts), self.bias)
        if len(starts) and len(self.prints):
            prints, of = features(codes, starts, ends)
            maybe = np.flatnonzero(self.near[prints & self.mask])
            prints, of = prints[maybe], of[maybe]
            at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
            hit = self.prints[at] == prints
            doc = np.searchsorted(offsets, starts[of[hit]], "right") - 1
            pairs = np.unique(doc * len(self.prints) + at[hit])
            logits += np.bincount(pairs // len(self.prints), self.weights[pairs % len(self.prints)], len(texts))
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


class Sparse:
    """Rows of columns with one value each, as sorted lists by row and by column."""

    def __init__(self, shape: tuple[int, int], row: np.ndarray, column: np.ndarray, value: np.ndarray):
        order = np.argsort(column, kind="stable")
        self.sides = (self.side(shape[0], row, column, value), self.side(shape[1], column[order], row[order], value[order]))

    @staticmethod
    def side(n, own, other, value):
        return n, np.unique(own), np.flatnonzero(np.diff(own, prepend=-1)), other, value

    @staticmethod
    def product(side, x: np.ndarray) -> np.ndarray:
        n, own, starts, other, value = side
        out = np.zeros(n)
        if len(own):
            out[own] = np.add.reduceat(x[other] * value, starts)
        return out

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self.product(self.sides[0], w)

    def down(self, z: np.ndarray) -> np.ndarray:
        """The transposed matrix times a vector."""
        return self.product(self.sides[1], z)


def fit(docs: Sparse, y, weight, deltas: Sparse, times, size: int, penalty: float, sparse: float, ridge: float, rounds: int):
    """(weights, bias): logistic loss of the weighted rows, penalty * mean squared change of the logit by a swap, and elastic net.

    `docs`, `deltas`: sparse matrices; `times`: how often each swap stands. Accelerated proximal steps.
    """
    weight, times = weight / weight.sum(), times / max(times.sum(), 1)

    def slope(w, b):
        z = docs @ w + b
        off = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        return docs.down(off) + deltas.down(2 * penalty * times * (deltas @ w)) + ridge * w, off.sum()

    # The largest curvature, by power iteration on the quadratic bound.
    w, b, top = np.ones(size) / np.sqrt(size + 1), 1 / np.sqrt(size + 1), 1.0
    for _ in range(30):
        z = 0.25 * weight * (docs @ w + b)
        w = docs.down(z) + deltas.down(2 * penalty * times * (deltas @ w)) + ridge * w
        b, top = z.sum(), np.sqrt(w @ w + z.sum() ** 2)
        w, b = w / top, b / top
    step = 1 / (1.1 * top)
    share = float(np.clip(weight @ y, 1e-6, 1 - 1e-6))
    w, b = np.zeros(size), np.log(share / (1 - share))
    ahead_w, ahead_b, turn = w, b, 1.0
    for _ in range(rounds):
        dw, db = slope(ahead_w, ahead_b)
        new = ahead_w - step * dw
        new, new_b = np.sign(new) * np.maximum(np.abs(new) - step * sparse, 0), ahead_b - step * db
        next_turn = (1 + np.sqrt(1 + 4 * turn**2)) / 2
        ahead_w, ahead_b = new + (turn - 1) / next_turn * (new - w), new_b + (turn - 1) / next_turn * (new_b - b)
        w, b, turn = new, new_b, next_turn
    return w, float(b)


def train(
    docs: DataFrame, labels: DataFrame, docs_a_label: int = 2000, least_docs: int = 4, most_features: int = 5_000, penalty: float = 10.0, sparse: float = 1e-5,
    ridge: float = 1e-6, rounds: int = 400,
) -> ToxicityModel | None:
    """Fits the classifier; None where no labelled row has a text.

    `docs`: doc_id, text; `labels`: doc_id, label (0 or 1), one row an id; rows with nulls don't count. Bounded by rows: of each label's ids a share by
    hash that is `docs_a_label` of them on average (all, if fewer), weighed by the inverse of the share, so
    probabilities keep the labels' own shares. Whole texts are learned from. Features are words and their first 3 to 8
    letters that stand in `least_docs` documents of the sample, the `most_features` whose counts differ most between
    labels, and the features of identity terms. For each sentence of the sample that names an identity, the terms are
    swapped for others of their kind, and `penalty` weighs the squared change of the logit: words that name groups
    can't carry the score.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select(F.col("doc_id").alias("own_"), F.col("label").cast("int").alias("label"))
    rows = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if not rows:
        return None
    bounds = F.create_map(*(F.lit(x) for k, n in sorted(rows.items()) for x in (k, sample_bound(n, docs_a_label))))
    drawn = labels.where(F.shiftrightunsigned(F.xxhash64("own_"), 2) < F.element_at(bounds, F.col("label")))
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), F.col("doc_id") == F.col("own_")).select("text", "label")

    def count(batches):
        for batch in batches:
            y = batch["label"].to_numpy()
            doc, prints = document_features(batch["text"].to_pylist())
            found, kind = np.unique(prints, return_inverse=True)
            n1 = np.bincount(kind, y[doc], len(found)).astype(np.int64)
            n = np.bincount(kind, minlength=len(found)).astype(np.int64)
            yield pa.record_batch({"print": found.view(np.int64), "n1": n1, "n": n})
            yield pa.record_batch({"print": pa.array([None], pa.int64()), "n1": [int(y.sum())], "n": [len(y)]})

    counted = sample.mapInArrow(count, "print long, n1 long, n long").groupBy("print").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    sizes = counted.where("print is null").first()
    if sizes is None:
        return None
    share = (sizes["n1"] + 0.5) / (sizes["n"] + 1)
    off = F.col("n1") - F.col("n") * share
    strength = off * off / (F.col("n") * share * (1 - share))
    best = counted.where(f"print is not null and n >= {least_docs}").orderBy(strength.desc(), "print").limit(most_features).select("print")
    terms = feature_set(list(swaps()))
    chosen = np.union1d(np.array([r["print"] for r in best.collect()], np.int64).view(np.uint64), terms)

    place = {int(f): int(np.searchsorted(chosen, f)) for f in terms}  # a swap moves features of terms alone

    def design(batches):
        for batch in batches:
            texts, own = batch["text"].to_pylist(), {}
            doc, prints = document_features(texts)
            at = np.minimum(np.searchsorted(chosen, prints), len(chosen) - 1)
            keep = chosen[at] == prints
            edges = np.searchsorted(doc[keep], np.arange(len(texts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(at[keep], pa.int32()))
            nothing = pa.array([[]] * len(texts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["label"], lists, nothing], names=["label", "plus", "minus"])
            for text in texts:
                for lost, won in counterfactuals(text):
                    pair = tuple(tuple(sorted(place[f] for f in side)) for side in (won, lost))
                    own[pair] = own.get(pair, 0) + 1
            pairs = [(plus, minus) for (plus, minus), n in own.items() for _ in range(n) if plus or minus]
            if pairs:
                sides = [pa.array([list(p[k]) for p in pairs], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([None] * len(pairs), pa.int32()), *sides], names=["label", "plus", "minus"])

    made = sample.mapInArrow(design, "label int, plus array<int>, minus array<int>").groupBy("label", "plus", "minus").agg(F.count("*").alias("n"))
    held = made.toArrow()
    y, n = held["label"].to_numpy(zero_copy_only=False), held["n"].to_numpy().astype(float)
    row = np.flatnonzero(~np.isnan(y.astype(float)))
    swap = np.setdiff1d(np.arange(len(y)), row)

    def sparse_rows(at, signs):
        parts = []
        for name, sign in signs:
            lists = held[name].combine_chunks().take(pa.array(at))
            width = np.diff(lists.offsets.to_numpy()) if len(at) else np.zeros(0, int)
            parts.append((np.repeat(np.arange(len(at)), width), lists.flatten().to_numpy().astype(np.int64), np.full(width.sum(), float(sign))))
        entries = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(entries[0], kind="stable")
        return Sparse((len(at), len(chosen)), *(x[order] for x in entries))

    label = y[row].astype(float)
    whole = np.array([max(1.0, rows.get(k, 0) / docs_a_label) for k in (0, 1)])[label.astype(int)]
    weights, bias = fit(
        sparse_rows(row, [("plus", 1)]), label, whole * n[row], sparse_rows(swap, [("plus", 1), ("minus", -1)]), n[swap], len(chosen), penalty, sparse, ridge, rounds
    )
    return ToxicityModel(chosen[weights != 0], weights[weights != 0], bias)


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """Adds score, from 0 to 1, to the columns of `docs`; a column of that name is replaced.

    Only the text is read, all of it. Null and empty texts, and those without a known word, get the model's base rate;
    without a model all scores are 0. Rows that repeat get equal scores; an empty table gives none.
    """
    kept = docs.drop("score")

    def run(batches):
        for batch in batches:
            column = batch["text"]
            _, offsets = text_buffer(column)
            for lo, hi in row_chunks(offsets, 1 << 20):
                part = batch.slice(lo, hi - lo)
                scores = np.zeros(hi - lo) if model is None else model.score(column.slice(lo, hi - lo).fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))
