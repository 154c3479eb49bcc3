from fractions import Fraction
import random
import hashlib
import math
import os
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import language, mixing, ordering, packing, queries, warc
from cairn.llm._io import shared_folder
from tests.llm import brute
from tests.oracle import SF, compare

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


# Mixing


def test_mixing_targets_and_copies(docs, texts):
    rows = mixing.mix_sources(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    expected = brute.mixture([(r.source, r.size) for r in rows])
    taken, whole = Counter(), Counter()
    for r in rows:
        assert r.size == len(brute.WORD.findall(texts[r.doc_id] or "")) and 0 <= r.copies <= 2
        assert r.target == pytest.approx(expected[r.source])
        assert math.floor(r.target / r.source_size) <= r.copies <= math.ceil(r.target / r.source_size)
        taken[r.source] += r.size * r.copies
        whole[r.source] += r.size
    for s in whole:
        assert abs(taken[s] - expected[s]) < 0.25 * expected[s]


def test_mixing_edges(spark, docs):
    again = [sorted((r.doc_id or -1, r.copies) for r in mixing.mix_sources(docs.repartition(n)).collect()) for n in (1, 7)]
    assert again[0] == again[1]
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    no_ids = spark.createDataFrame([(None, f"word{i} x y", "one") for i in range(400)] + [(k, "a b c d e", "two") for k in range(900)], "doc_id long, text string, source string")
    rows = [r for r in mixing.mix_sources(no_ids).collect() if r.source == "one"]
    assert abs(sum(r.size * r.copies for r in rows) - rows[0].target) < 0.15 * rows[0].target
    bare = spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, source string")
    assert [r.copies for r in mixing.mix_sources(bare).collect()] == [0, 0]


# Packing


def check_packed(rows, texts, capacity=1024):
    tokenizer = Tokenizer.from_file(BPE)
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for d, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in own) == len(ids) and all(r.length == capacity for r in own[1:])
    return len(bins), sum(r.length for r in rows)


def test_packing_is_whole_and_tight(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bins, total = check_packed(queries.op7_packing(spark, SF).collect(), texts)
    assert bins <= math.ceil(total / 1024) * 1.02 + 1


def test_packing_edges(spark, docs, texts):
    own = texts | {900: "a <|endoftext|> b", 901: "\x1c x  y  \n z"}
    table = spark.createDataFrame(list(own.items()), "doc_id long, text string").withColumn("length", F.lit("extra"))
    rows = packing.pack_pieces(packing.token_pieces(table, BPE, 64), 64).collect()
    check_packed(rows, own, 64)
    assert packing.pack_pieces(packing.token_pieces(docs.limit(0), BPE)).count() == 0
    clash = packing.token_pieces(table, BPE, 64).withColumns({c: F.lit("extra") for c in ("salt", "rank", "count", "above", "place", "row", "offset")})
    found = packing.pack_pieces(clash, 64, cell=10)
    assert set(found.columns) == set(clash.columns) | {"sequence_id"}
    check_packed(found.collect(), own, 64)
    assert packing.pack_pieces(packing.token_pieces(docs, BPE)).where("doc_id is null").count() >= 1


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 64))
@settings(max_examples=60, deadline=None)
def test_bins_use_every_piece_once(lengths, capacity):
    plan = packing.bin_plan(Counter(lengths), capacity)
    used = Counter()
    for bins, own in plan:
        assert sum(k * n for k, n in own.items()) <= capacity
        for k, n in own.items():
            used[k] += bins * n
    assert used == Counter(lengths)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=6), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_fullest_is_the_best_subset(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * m for s in sums for m in range(n + 1)}
    used = packing.fullest(counts, room, sorted(counts, reverse=True))
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
    assert all(n <= counts[k] for k, n in used.items())


# Training order


@given(st.integers(1, 400), st.integers(0, 1 << 40))
@settings(max_examples=40, deadline=None)
def test_feistel_is_a_permutation(size, key):
    assert sorted(ordering.feistel(np.arange(size), size, key).tolist()) == list(range(size))


def test_training_order_query_writes_and_reads_shards(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    expected = {r.slot: bytes(r.ids) for r in ordering.training_order(ordering.token_sequences(documents, BPE)).collect()}
    before = set(Path(shared_folder(spark).removeprefix("file://")).glob("shards-*/shard-*.bin"))
    rows = queries.op8_training_order(spark, SF).collect()
    files = sorted(set(Path(shared_folder(spark).removeprefix("file://")).glob("shards-*/shard-*.bin")) - before)
    assert b"".join(f.read_bytes() for f in files) == b"".join(expected[k] for k in range(len(expected)))
    assert [r.slot for r in rows] == list(range(len(expected)))
    assert all(r.ids_sha256 == hashlib.sha256(expected[r.slot]).hexdigest() and r.place == r.slot % 4096 * 2048 for r in rows)


def test_shards_are_written_from_their_partitions(spark, docs, tmp_path):
    ordered = ordering.training_order(ordering.token_sequences(docs, BPE, 32), per_shard=16)
    assert ordered._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    with pytest.raises(Exception, match="isn't next"):
        ordering.write_shards(ordered.repartition(3), f"file://{tmp_path}/b", 16)
    assert not list((tmp_path / "b").glob(".*")), "a failed task takes its draft away"


def test_waves_read_their_own_rows(spark, docs, tmp_path):
    sequences = ordering.token_sequences(docs, BPE, 32)
    ordered = ordering.training_order(sequences, per_shard=16, waves=3)
    plan = ordered.where(F.col(ordering.wave_name(3)) == 1).select("slot", "ids")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(wave_of_3" in plan and "Python" not in plan, "slots are made once"
    content = {}
    for waves in (1, 2, 3):
        ordering.write_shards(ordered, f"file://{tmp_path}/{waves}", 16, waves=waves)
        content[waves] = [f.read_bytes() for f in sorted((tmp_path / str(waves)).glob("shard-*.bin"))]
    ordering.write_shards(ordering.training_order(sequences, per_shard=16), f"file://{tmp_path}/plain", 16)
    content[0] = [f.read_bytes() for f in sorted((tmp_path / "plain").glob("shard-*.bin"))]
    assert len(content[0]) > 3 and all(c == content[0] for c in content.values())
    none = ordering.training_order(sequences.limit(0), per_shard=16, waves=3)
    assert ordering.write_shards(none, f"file://{tmp_path}/none", 16, waves=3) == {"per_shard": 16, "rows": 0, "stride": 0}


def test_digests_of_shards_are_not_broadcast(spark):
    assert "Broadcast" not in queries.op8_training_order(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_sequences_are_made_once(spark, docs, tmp_path):
    def noted(batches):
        (tmp_path / f"task-{os.getpid()}-{time.time_ns()}").touch()
        yield from batches

    sequences = ordering.token_sequences(docs, BPE, 32).coalesce(1)
    scratch = Path(shared_folder(spark).removeprefix("file://"))
    before = set(scratch.iterdir())
    ordered = ordering.training_order(sequences.mapInArrow(noted, sequences.schema), per_shard=16)
    assert len(set(scratch.iterdir()) - before) == 1, "one table stays"
    assert ordering.write_shards(ordered, f"file://{tmp_path}/a", 16) == ordering.write_shards(ordered, f"file://{tmp_path}/b", 16, waves=3)
    one, two = ({f.name: f.read_bytes() for f in (tmp_path / k).glob("shard-*.bin")} for k in "ab")
    assert one == two and len(one) > 3 and len(list(tmp_path.glob("task-*"))) == 1
    none = ordering.training_order(sequences.limit(0), per_shard=16)
    assert ordering.write_shards(none, f"file://{tmp_path}/c", 16, waves=3) == {"per_shard": 16, "rows": 0, "stride": 0}


@pytest.mark.parametrize("parts", [3, 5, 50])
def test_slots_dont_follow_the_partitioning(spark, docs, parts):
    sequences = ordering.token_sequences(docs, BPE, 32)
    slots = lambda rows: sorted((r.slot, r.doc_id, r.piece, bytes(r.ids)) for r in ordering.training_order(rows).collect())
    one = slots(sequences.coalesce(1))
    assert [r[0] for r in one] == list(range(len(one)))
    assert slots(sequences.repartition(parts)) == one


def test_shards_round_trip(spark, docs, tmp_path):
    ordered = ordering.training_order(ordering.token_sequences(docs, BPE, 32), key=5, per_shard=16)
    rows = ordered.collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(r.shard == r.slot // 16 and r.place == r.slot % 16 * 64 for r in rows)
    folder = f"file://{tmp_path}/shards"
    manifest = ordering.write_shards(ordered, folder, 16)
    assert manifest == {"per_shard": 16, "rows": len(rows), "stride": 64}
    for from_slot in (0, 21, 32, len(rows) - 1, len(rows)):
        back = {r.slot: bytes(r.ids) for r in ordering.read_shards(spark, folder, from_slot, 5).collect()}
        assert back == {r.slot: bytes(r.ids) for r in rows if r.slot >= from_slot}
    files = sorted((tmp_path / "shards").glob("shard-*.bin"))
    content, old = [f.read_bytes() for f in files], files[0].stat().st_mtime_ns
    for f in files[3:7]:
        f.unlink()  # as after a run that was cut short
    (tmp_path / "shards" / ordering.MANIFEST).unlink()
    assert ordering.write_shards(ordered, folder, 16) == manifest
    assert [f.read_bytes() for f in files] == content and files[0].stat().st_mtime_ns == old
    files[2].write_bytes(b"x")
    with pytest.raises(Exception, match="there already"):
        ordering.write_shards(ordered, folder, 16)
    with pytest.raises(Exception, match="other sequences or in another order"):  # shards of another key have the same sizes
        ordering.write_shards(ordering.training_order(ordered.drop("slot", "shard", "place"), key=18, per_shard=16), folder, 16)
    none = ordering.write_shards(ordered.limit(0), f"file://{tmp_path}/none", 16)
    assert none["rows"] == 0 and ordering.read_shards(spark, f"file://{tmp_path}/none").count() == 0
    tokenizer = Tokenizer.from_file(BPE)
    one = sorted((r.piece, bytes(r.ids), r.n_ids) for r in rows if r.doc_id == 31)
    ids = np.concatenate([np.frombuffer(b, "<u2")[:n] for _, b, n in one])
    text = docs.where("doc_id = 31").first().text
    assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 50256]
    assert ordering.training_order(ordering.token_sequences(docs.limit(0), BPE)).count() == 0


# Language


def every_segmentation(word, probs, longest):
    """Sum of products over all ways to cut a word."""
    if not word:
        return 1.0
    return sum(probs.get(word[:n], 0.0) * every_segmentation(word[n:], probs, longest) for n in range(1, min(longest, len(word)) + 1))


def exact_log(word, probs, longest):
    """log of the same sum for long words, in fractions."""
    sums = [Fraction(1)]
    for end in range(1, len(word) + 1):
        sums.append(sum(sums[end - n] * Fraction(probs.get(word[end - n : end], 0.0)) for n in range(1, min(longest, end) + 1)))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(["a", "b", "ab", "ba", "aba", "▁", "▁a"])
    probs = np.random.default_rng(1).random((9, 2)) / 1000
    probs[-1] = 0
    long = "".join(random.Random(4).choice("abx") for _ in range(500))
    words = ["abab", "aaaa", "babaab", "axb", long]
    model = language.LanguageModel(["p", "q"], pieces, probs, np.zeros(2))
    ends = np.cumsum([len(w) for w in words])
    got = model.word_logs(language.spell("".join(words)), ends - [len(w) for w in words], ends)
    for row, word in zip(got, words, strict=True):
        for k in range(2):
            table = dict(zip(pieces.pieces, probs[:, k])) | {"x": probs[7, k]}
            assert row[k] == pytest.approx(exact_log("▁" + word, table, 3))
            if word is not long:
                assert row[k] == pytest.approx(math.log(every_segmentation("▁" + word, table, 3)))


def test_expected_counts_are_those_of_all_segmentations():
    pieces = language.Pieces(["a", "b", "ab", "▁"])
    probs = np.array([[0.2], [0.1], [0.3], [0.4], [0.05], [0]])
    ids = pieces.ids(language.spell("▁ab").astype(np.int64)[None])
    counts = language.expected_counts(ids, probs, np.array([[2.0]]))[:, 0]
    one, two = 0.4 * 0.2 * 0.1, 0.4 * 0.3
    assert counts == pytest.approx(np.array([2 * one, 2 * one, 2 * two, 2 * (one + two), 0, 0]) / (one + two))


def test_tasks_expect_the_counts_of_training(spark, monkeypatch):
    own, vocabulary = language.expected_counts, queries.public_tokenizers.path("piece_bpe_32k.model")
    texts = [(1, "der Hund und die Katze " * 3, "de"), (2, "ein Haus, größer", "de"), (3, "the dog and the house", "en"), (4, "日本" * 90 + " 12", "en")]

    driver = os.getpid()

    def by_tasks(*given):
        assert os.getpid() != driver, "words come to the driver"
        return own(*given)

    monkeypatch.setattr(language, "expected_counts", by_tasks)
    model = language.train(spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3), vocabulary, rounds=2)
    assert model.languages == ["de", "en"] and {"日", "ß"} <= set(model.pieces.pieces)
    words = {}
    for _, text, lang in texts:
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for word in (run[lo : lo + language.TRAINED_RUN] for run in runs for lo in range(0, len(run), language.TRAINED_RUN)):
            words.setdefault(word, [0.0, 0.0])[model.languages.index(lang)] += 1
    probs = np.full_like(model.probs, 1 / (model.pieces.unknown + 1))
    probs[-1] = 0
    for _ in range(2):
        counts = sum(own(model.pieces.ids(language.spell("▁" + w).astype(np.int64)[None]), probs, np.array([n])) for w, n in words.items()) + 0.01
        counts[-1] = 0
        probs = counts / counts.sum(axis=0)
    assert model.probs == pytest.approx(probs, rel=1e-9)
    shares = np.sum(list(words.values()), axis=0)
    assert np.exp(model.priors) == pytest.approx(shares / shares.sum())


def test_the_training_sample_never_becomes_empty():
    for rows in (1, 1000, 10**8, 4 * 10**9, 10**10, 10**14, 10**17):
        assert language.sample_bound(rows, 1000) / 2**62 * rows == pytest.approx(min(rows, 1000), rel=1e-3)
    assert language.sample_bound(10**19, 1) >= 1


def test_whole_vocabulary_is_used():
    pieces = language.vocabulary(queries.public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) > 10 and "▁because" in pieces


def test_language_of_long_texts(spark):
    model = queries.language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    given = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(text) > 200").limit(3).collect()
    rows = [(i, (r.text + " ") * (1_200_000 // len(r.text)), r.lang) for i, r in enumerate(given)] + [(9, "ab" * 20_000, None)]
    found = language.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert [r.lang_pred for r in found[:3]] == [r.lang for r in found[:3]] and found[3].lang_pred != "und"


def test_language_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs):
    model = queries.language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    found = language.identify_languages(docs, model)
    rows = {r.doc_id: r for r in found.collect()}
    assert {rows[i].lang_pred for i in (0, 1, 2)} == {"und"} and rows[0].score == 0
    assert rows[7].lang_pred != "und" and set(docs.columns) <= set(found.columns)
    assert language.identify_languages(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.identify_languages(docs, None).collect()} == {"und"}
    assert queries.language_model(docs.where("lang = 'none'")) is None
    empty = spark.createDataFrame([(1, "12 34", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    assert queries.language_model(empty) is None


# WARC


def test_canonical_urls(spark):
    given_urls = ["HTTP://WWW.Example.org:80/a/?b=2&a=1&utm_source=x#top", "https://example.org/a?a=1&b=2", "example.org/a/?ref=q&a=1&b=2", None, "", "http://h"]
    rows = spark.createDataFrame([(u,) for u in given_urls], "u string").select(warc.canonical_url(F.col("u")))
    assert [r[0] for r in rows.collect()] == ["example.org/a?a=1&b=2"] * 3 + [None, "", "h"]


def test_revisits_equal_a_loop(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        url = None if i % 50 == 0 else f"http://h{rng.integers(5)}/"
        headers = {"Date": str(i)} | ({"ETag": f'"{rng.integers(2)}"'} if rng.random() < 0.6 else {}) | ({"last-modified": str(rng.integers(2))} if rng.random() < 0.6 else {})
        rows.append((i, url, None if i % 41 == 0 else int(rng.integers(400)), bool(rng.random() < 0.6), headers if i % 30 else None))
    table = spark.createDataFrame(rows, "record_id long, url string, at long, revisit boolean, headers map<string,string>").withColumn("key", F.lit(1))
    got = {r.record_id: (r.outcome, r.response_id, r.headers) for r in warc.resolve_revisits(table, span=37).collect()}
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for i, url, at, revisit, headers in rows:
        own = low(headers)
        past = [r for r in rows if url and at is not None and r[1] == url and r[2] is not None and r[2] < at and not r[3]]
        if not revisit:
            expected = ("response", i, own)
        elif not past:
            expected = ("orphan", None, own)
        else:
            old = max(past, key=lambda r: (r[2], r[0]))
            stored = low(old[4])
            key = next((k for k in ("etag", "last-modified") if k in own and k in stored), None)
            same = key and own[key] == stored[key]
            merged = stored | {k: v for k, v in own.items() if k in warc.PERMITTED}
            expected = ("unverified", None, own) if key is None else ("confirmed", old[0], merged) if same else ("changed", None, own)
        assert got[i] == expected
    assert warc.resolve_revisits(table.limit(0)).count() == 0


# Pipeline


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, "en", "src0", 0), (900002, "123 456", None, "src1", 7), (900003, "", "fr", "src1", 0)], docs.schema)
    columns, current = docs.columns, docs.union(extra).union(docs.where("doc_id = 3"))
    kept = [current.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, current, SF).write.parquet(path)
        current = spark.read.parquet(path)
        kept.append(current.collect())
        if name != "packing":
            assert current.columns == columns
    spoken, single, cut, mixed, packed = kept[1:]
    assert {r.doc_id for r in kept[0]} - {r.doc_id for r in spoken} == {900001, 900002, 900003}
    groups = brute.ngram_join({r.doc_id: r.text for r in spoken})
    assert sorted(r.doc_id for r in single) == sorted({c for _, c in groups.values()})
    expected = brute.suffix_dedup({r.doc_id: r.text for r in single})
    assert sorted(r.doc_id for r in cut) == sorted(expected)
    for r in cut:
        lost = expected[r.doc_id][0] - len(r.text.encode())
        assert 0 <= expected[r.doc_id][1] - lost <= 6 * expected[r.doc_id][2] and r.n_chars == len(r.text)
    targets = brute.mixture([(r.source, len(brute.WORD.findall(r.text))) for r in cut])
    sizes = Counter()
    for r in cut:
        sizes[r.source] += len(brute.WORD.findall(r.text))
    copies = Counter(r.doc_id for r in mixed)
    for r in cut:
        rate = targets[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(rate) <= copies[r.doc_id] <= math.ceil(rate)
    texts = {r.doc_id: r.text for r in mixed}
    assert sum(r.length for r in packed) == sum(len(i.ids) + 1 for i in Tokenizer.from_file(BPE).encode_batch([texts[r.doc_id] for r in mixed], add_special_tokens=False))
    bins = defaultdict(int)
    for r in packed:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 1024
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicates_stage_with_repeated_ids(spark):
    """Of an id with several texts each is judged by its own group; reruns on other partitions keep the same rows."""
    p, q, r = [" ".join(f"{k}{i}" for i in range(40)) for k in "pqr"]
    near = p + " more"
    given = [(1, p), (1, p), (1, near), (1, q), (5, near), (5, r), (None, p), (2, ""), (2, None), (2, p)]
    docs = spark.createDataFrame([(d, t, f"s{k}") for k, (d, t) in enumerate(given)], "doc_id long, text string, id string")
    runs = [corpus_pipeline.one_of_near_duplicates(spark, docs.repartition(n), "").collect() for n in (1, 4)]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))
    kept = Counter((row.doc_id, row.text) for row in runs[0])
    one = kept.pop((1, p), 0) + kept.pop((1, near), 0)
    empty = kept.pop((2, ""), 0) + kept.pop((2, None), 0)
    assert (one, empty) == (1, 1) and kept == {(1, q): 1, (5, r): 1, (None, p): 1}
    assert corpus_pipeline.one_of_near_duplicates(spark, docs.limit(0), "").count() == 0
