import ctypes
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import _graph, _hash, _io, _repeats, packing
from tests.llm import brute


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(300 + i, 301 + i) for i in range(60)]
    links += [(500, 500 + i) for i in range(1, 40)]
    table = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in _graph.components(table).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == {n: c for n, c in brute.components(range(600), links).items() if n in nodes}
    assert _graph.components(table.limit(0)).count() == 0


@given(st.lists(st.text(alphabet="ab \n\té", max_size=12), max_size=6))
@settings(max_examples=80, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    data, offsets = _io.text_buffer(pa.array(texts, pa.string()))
    starts, ends, rows = _hash.words(data, offsets)
    found = [[data[starts[i] : ends[i]].tobytes().decode() for i in range(rows[k], rows[k + 1])] for k in range(len(texts))]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_span_hashes_agree_with_contents():
    values = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint64)
    spans = _hash.SpanHash(_hash.mix(values))
    seen = {}
    for length in (1, 2, 5, 9):
        start = np.arange(300 - length)
        for a, h in zip(start, spans(start, start + length).tolist()):
            assert seen.setdefault(h, tuple(values[a : a + length])) == tuple(values[a : a + length])


@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_sliding_min(values, width):
    width = min(width, len(values))
    got = _hash.sliding_min(np.array(values, np.uint64), width).tolist()
    assert got == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@given(st.lists(st.text(alphabet="ab", max_size=40), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_every_window_has_one_record(texts):
    spec = _repeats.Spec(by_word=False, seed=9, length=14, within=True)
    data, offsets = _io.text_buffer(pa.array(texts, pa.string()))
    row, start, count, _, _ = _repeats.anchored(_hash.grams(data), offsets, spec)
    got = sorted((int(r), int(s) - int(offsets[r]) + i) for r, s, c in zip(row, start, count) for i in range(c))
    assert got == [(r, p) for r, t in enumerate(texts) for p in range(len(t) - 13)]


def held() -> float:
    """MB of this process without mapped files."""
    with open("/proc/self/smaps_rollup") as lines:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", lines.read())[1]) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library can't trim")
def test_free_memory_goes_back_when_a_task_ends():
    pins = []

    def hoard(batches):
        for batch in batches:
            small = [bytes(50_000) for _ in range(2_000)]  # 100 MB of the heap
            pins.append(bytes(50_000))  # which can't shrink below this
            del small
            yield batch

    before = held()
    assert list(_io.trimmed(hoard)(iter([1, 2]))) == [1, 2]
    assert held() < before + 40
    assert _io.trimmed_group(lambda table: next(hoard([table])))(3) == 3
    assert held() < before + 40


def test_workers_hold_no_tokenizer_when_pieces_are_made(spark, docs):
    assert packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).count() >= docs.count()

    def holding(batches):
        for _ in batches:
            yield pa.record_batch({"held": [packing.encoder.cache_info().currsize]})

    asked = spark.range(0, 12, 1, 12).mapInArrow(holding, "held long").collect()
    assert {r.held for r in asked} == {0}
