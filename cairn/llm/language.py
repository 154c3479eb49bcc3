"""Language ID by unigram piece models whose segmentations are summed out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._hash import mix, word_hashes
from cairn.llm._io import materialise, row_chunks, text_buffer, trimmed

UNDETERMINED = "und"
MARK = 0x2581
#: In training (not in scoring) letter runs are counted in parts of this many letters.
TRAINED_RUN = 128
#: Letters of words of one length whose counts a task expects at a time.
TRAINED_CELLS = 1 << 15
#: Sums are rescaled every so many letters.
RESCALE = 8


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    """The lower-case letter pieces (with or without the word mark) of a sentencepiece model, by id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return list(dict.fromkeys(p for p in pieces if p.removeprefix("▁").isalpha() and p == p.lower()))


def spell(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), "<u4")


def letter_runs(texts: list[str]):
    """Code points of the lower-cased texts end to end, the texts' offsets, and starts and ends of the runs of letters."""
    lowered = [t.lower() for t in texts]
    codes = spell("".join(lowered))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    inside = letters()[codes]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(codes)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = inside[edges]
    return codes, offsets, np.flatnonzero(first), np.flatnonzero(last) + 1


@dataclass
class Pieces:
    """Looks pieces up by fingerprint. The last id is that of a letter outside the vocabulary."""

    pieces: list[str]

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = len(self.pieces)
        sizes = np.array([len(p) for p in self.pieces])
        prints = np.array([self.fingerprint(spell(p)) for p in self.pieces], np.uint64)
        self.index = []  # for each length: fingerprints and ids
        for n in range(1, self.longest + 1):
            own = np.flatnonzero(sizes == n)
            self.index.append((pd.Index(prints[own]), np.append(own, -1)))

    @staticmethod
    def fingerprint(codes) -> np.uint64:
        grid = Pieces.grow(np.asarray(codes)[None, :], len(codes))
        return grid[-1][0, 0]

    @staticmethod
    def grow(grid: np.ndarray, longest: int) -> list[np.ndarray]:
        """For each length, fingerprints of the substrings of each row by their start."""
        codes, out = mix(grid.astype(np.uint64) + np.uint64(1)), []
        for n in range(1, min(longest, grid.shape[1]) + 1):
            last = codes[:, n - 1 :]
            out.append(last.copy() if n == 1 else out[-1][:, : last.shape[1]] * np.uint64(0xD6E8FEB86659FD93) + last)
        return out

    def ids(self, grid: np.ndarray) -> list[np.ndarray]:
        """For each length, ids of the substrings by start; -1 where there is none."""
        found = []
        for h, (index, own) in zip(self.grow(grid, self.longest), self.index, strict=False):
            found.append(own[index.get_indexer(h.ravel())].reshape(h.shape))
        found[0][found[0] < 0] = self.unknown
        return found


def steps(ids: list[np.ndarray]) -> list[list[int]]:
    """For each end, the lengths of pieces that some word has there."""
    width = ids[0].shape[1]
    out = [[] for _ in range(width + 1)]
    for size, own in enumerate(ids, 1):
        for end in (np.flatnonzero((own >= 0).any(axis=0)) + size).tolist():
            out[end].append(size)
    return out


def forward_logs(ids: list[np.ndarray], probs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations of each word's first `ends` letters: (words, languages).

    probs ends with a row of zeros. Only as many sums as the longest piece has letters are held; they are divided by
    their maximum from time to time, whose logs add up, so a run of any length stays in range.
    """
    n, width = ids[0].shape
    held = [np.ones((n, probs.shape[1]))]
    logs, out = np.zeros_like(held[0]), np.zeros_like(held[0])
    of = np.argsort(ends, kind="stable")
    edges = np.searchsorted(ends[of], np.arange(width + 2))
    sizes = steps(ids)
    for end in range(1, width + 1):
        total = np.zeros_like(logs)
        for size in sizes[end]:
            total += held[-size] * probs[ids[size - 1][:, end - size]]
        held = [*held[1 - len(ids) :], total] if len(ids) > 1 else [total]
        if edges[end] < edges[end + 1]:
            done = of[edges[end] : edges[end + 1]]
            out[done] = np.log(total[done]) + logs[done]
        if end % RESCALE == 0:
            top = np.max(held, axis=0)
            held = [h / top for h in held]
            logs += np.log(top)
    return out


def expected_counts(ids, probs, weights) -> np.ndarray:
    """Expected piece counts of the words, `weights` (words, languages) times, under `probs`.

    All sums are tilted by a factor a letter that makes the word's own sum 1; counts don't depend on it.
    """
    n, width = ids[0].shape
    tilt = np.exp(-forward_logs(ids, probs, np.full(n, width)) / width)
    sizes = steps(ids)
    ahead = np.zeros((n, width + 1, probs.shape[1]))
    ahead[:, 0] = 1
    for end in range(1, width + 1):
        for size in sizes[end]:
            ahead[:, end] += ahead[:, end - size] * probs[ids[size - 1][:, end - size]] * tilt**size
    behind = np.zeros_like(ahead)
    behind[:, width] = weights / ahead[:, width]
    counts = np.zeros_like(probs)
    for end in range(width, 0, -1):
        for size in sizes[end]:
            own = ids[size - 1][:, end - size]
            step = probs[own] * tilt**size * behind[:, end]
            behind[:, end - size] += step
            np.add.at(counts, own, ahead[:, end - size] * step)
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: Pieces
    probs: np.ndarray  # (pieces + unknown + a row of zeros, languages)
    priors: np.ndarray

    def word_logs(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, cells: int = 1 << 17) -> np.ndarray:
        """log of the summed probability of each run codes[start:end], by language; runs of like length together."""
        out = np.zeros((len(starts), len(self.languages)))
        sizes = ends - starts
        order, lo = np.argsort(sizes, kind="stable"), 0
        while lo < len(order):
            widest = np.maximum(sizes[order[lo:]], 1)
            fits = (widest <= max(8, widest[0] * 1.25)) & (widest * np.arange(1, len(widest) + 1) <= cells)
            part = order[lo : lo + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))]
            width = int(sizes[part[-1]])
            grid = np.full((len(part), width + 1), MARK, np.int64)
            grid[:, 1:] = codes[np.minimum(starts[part, None] + np.arange(width), len(codes) - 1)]
            out[part] = forward_logs(self.pieces.ids(grid), self.probs, sizes[part] + 1)
            lo += len(part)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        codes, offsets, starts, ends = letter_runs(texts.fill_null("").to_pylist())
        n = len(offsets) - 1
        logs = np.zeros((n, len(self.languages)))
        if len(starts):
            _, one, kind = np.unique(run_names(codes, starts, ends), return_index=True, return_inverse=True)
            own = self.word_logs(codes, starts[one], ends[one])[kind]
            doc = np.searchsorted(offsets, starts, "right") - 1
            for k in range(len(self.languages)):
                logs[:, k] = np.bincount(doc, own[:, k], n)
        seen = np.diff(np.searchsorted(starts, offsets)) > 0
        logs += self.priors
        posterior = np.exp(logs - logs.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        best = posterior.argmax(axis=1)
        names = [self.languages[k] if s else UNDETERMINED for k, s in zip(best, seen, strict=True)]
        return names, np.where(seen, posterior[np.arange(len(best)), best], 0.0)


def run_names(codes, starts, ends) -> np.ndarray:
    """A hash of each run of code points."""
    data = codes.astype("<u4").view(np.uint8)
    return word_hashes(data, starts * 4, ends * 4)


def sample_bound(rows: int, wanted: int) -> int:
    """Of hashes in 0..2^62-1, those below this number are a sample of `wanted` of `rows` rows on average; all if fewer."""
    return (1 << 62) if rows <= wanted else max(1, (wanted << 62) // rows)


def train(labelled: DataFrame, vocabulary_path: str, docs_a_language: int = 1000, rounds: int = 3) -> LanguageModel | None:
    """Fits piece probabilities by expectation maximisation; None without labelled words.

    Bounded by rows: of each language a share of its documents, by a hash of id and text, that is `docs_a_language` of
    them on average (all, if fewer). All words of their whole texts are learned from. Pieces are all lower-case letter
    pieces of the vocabulary, and the sample's letters. `labelled`: doc_id, text, lang; rows without text or lang don't
    count. Priors are the languages' shares of words in the sample, each weighed by its share of documents.
    """

    def count(batches):
        for batch in batches:
            codes, offsets, starts, ends = letter_runs(batch["text"].to_pylist())
            parts = -(-(ends - starts) // TRAINED_RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts = np.repeat(starts, parts) + nth * TRAINED_RUN
            ends = np.minimum(np.repeat(ends, parts), starts + TRAINED_RUN)
            doc = np.searchsorted(offsets, starts, "right") - 1
            _, one, kind = np.unique(run_names(codes, starts, ends), return_index=True, return_inverse=True) if len(starts) else (0, starts, starts)
            lang, names = np.unique(np.array(batch["lang"].to_pylist(), object)[doc].astype(str), return_inverse=True) if len(starts) else (starts, starts)
            pair, n = np.unique(names * len(one) + kind, return_counts=True)
            words = [codes[starts[i] : ends[i]].tobytes().decode("utf-32-le") for i in one[pair % max(len(one), 1)]]
            yield pa.record_batch(
                [pa.array(lang[pair // max(len(one), 1)].tolist(), pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"]
            )

    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not rows:
        return None
    bounds = F.create_map(*(F.lit(x) for lang, n in sorted(rows.items()) for x in (lang, sample_bound(n, docs_a_language))))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    counted = labelled.where(drawn < F.element_at(bounds, F.col("lang"))).select("lang", "text").mapInArrow(trimmed(count), "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.repartition("word").sortWithinPartitions("word", "lang"))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    languages = sorted(totals)
    alphabet = sorted(r["letter"] for r in counted.select("word").mapInArrow(letters_of, "letter string").distinct().collect())
    pieces = Pieces(list(dict.fromkeys([*vocabulary(vocabulary_path), *alphabet, "▁"])))
    probs = np.full((pieces.unknown + 2, len(languages)), 1 / (pieces.unknown + 1))
    probs[-1] = 0
    for _ in range(rounds):
        counts = summed_counts(counted, LanguageModel(languages, pieces, probs, np.zeros(len(languages)))) + 0.01
        counts[-1] = 0
        probs = counts / counts.sum(axis=0)
    whole = np.array([rows[k] for k in languages], float)
    share = np.array([totals[k] for k in languages], float) * whole / np.minimum(whole, docs_a_language)
    return LanguageModel(languages, pieces, probs, np.log(share / share.sum()))


def letters_of(batches):
    """The letters of batches of words, each once a task."""
    seen = set()
    for batch in batches:
        seen.update(*batch["word"].to_pylist())
    yield pa.record_batch({"letter": pa.array(sorted(seen), pa.string())})


def summed_counts(counted: DataFrame, model: LanguageModel) -> np.ndarray:
    """Expected piece counts of all words of `counted` (lang, word, n) under the model: (pieces, languages).

    Tasks hold the words; a count a piece and language comes to the driver. Tasks' counts are added in order of size, so
    reruns agree.
    """

    def expect(batches):
        counts = np.zeros_like(model.probs)
        for batch in batches:
            words, own = np.unique(np.array(batch["word"].to_pylist(), object), return_inverse=True)
            weights = np.zeros((len(words), len(model.languages)))
            np.add.at(weights, (own, np.searchsorted(model.languages, batch["lang"].to_pylist())), batch["n"].to_numpy())
            spelled = [spell("▁" + w).astype(np.int64) for w in words]
            sizes = np.array([len(w) for w in spelled], np.int64)
            for n in np.unique(sizes).tolist():
                same = np.flatnonzero(sizes == n)
                for lo in range(0, len(same), max(1, TRAINED_CELLS // n)):
                    part = same[lo : lo + max(1, TRAINED_CELLS // n)]
                    counts += expected_counts(model.pieces.ids(np.stack([spelled[i] for i in part])), model.probs, weights[part])
        piece, lang = np.nonzero(counts)
        yield pa.record_batch({"piece": pa.array(piece, pa.int32()), "lang": pa.array(lang, pa.int32()), "n": pa.array(counts[piece, lang])})

    added = F.aggregate(F.array_sort(F.collect_list("n")), F.lit(0.0), lambda total, n: total + n)
    table = counted.mapInArrow(trimmed(expect), "piece int, lang int, n double").groupBy("piece", "lang").agg(added.alias("n")).toArrow()
    out = np.zeros_like(model.probs)
    out[table["piece"].to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
    return out


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Replaces or adds lang_pred and score; all other columns of `docs` stay.

    Only the text is read, all of it; every run of letters counts with the sum over all its segmentations, however long
    it is. Null texts and texts without a letter give `und` and score 0, as do all texts without a
    model. Ties go to the language first by code point. The score is the posterior of the language named. Rows that
    repeat get equal results; an empty table gives none.
    """
    kept = docs.drop("lang_pred", "score")

    def predict(batches):
        for batch in batches:
            column = batch["text"]
            _, offsets = text_buffer(column)
            for lo, hi in row_chunks(offsets, 1 << 20):
                part = batch.slice(lo, hi - lo)
                names, scores = ([UNDETERMINED] * (hi - lo), np.zeros(hi - lo)) if model is None else model.predict(column.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*part.schema.names, "lang_pred", "score"]
                )

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(trimmed(predict), schema)
