import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import _io, ngram_join, queries, substring_dedup, suffix_dedup
from tests.llm import brute
from tests.oracle import SF


def byte_digest(rows):
    got = rows.select("doc_id", "n_bytes", F.size("spans"), "kept", F.sha2("kept", 256)).collect()
    return {r[0]: (r[1], r[1] - len(r[3]), r[2], r[4]) for r in got}, len(got)


@pytest.mark.parametrize("spread", [{}, {"hot": 1, "hot_total": 1}])
def test_suffix_dedup_equals_brute_force(docs, texts, spread):
    found, n = byte_digest(suffix_dedup.remove_repeats(docs, **spread))
    assert n == len(texts) + 2
    assert found.pop(None)[1] == 0
    assert found == brute.suffix_dedup(texts)
    assert sum(v[1] for v in found.values()) > 0


def test_suffix_dedup_keeps_other_columns_and_characters(docs, texts):
    rows = suffix_dedup.remove_repeats(docs, whole_characters=True)
    assert set(docs.columns) - {"text"} <= set(rows.columns)
    assert rows.where("doc_id = 25").first()["source"] == "src0"
    assert all(r.t is not None and "�" not in r.t for r in rows.select(F.decode("kept", "UTF-8").alias("t")).collect())


def test_index_family_levels_grow_geometrically(spark):
    """Seven batches of random texts over two letters: what is known, and that no two levels are of one size."""
    family, rng, seen = suffix_dedup.IndexFamily(12), np.random.default_rng(1), set()
    for k in range(7):
        rows, expected = [], set()
        for i in range(20):
            text = rng.integers(97, 99, 60).astype(np.uint8).tobytes()
            rows.append((i % 3, 7, 100 * k + i, 0, 0, 49, bytearray(b"%d" % (i % 3) + text[1:])))
            for at in range(49):
                if (window := (i % 3, bytes(rows[-1][-1][at : at + 12]))) in seen:
                    expected.add((100 * k + i, at))
                seen.add(window)
        batch = spark.createDataFrame(rows, "part long, cls long, doc long, start long, at long, count long, text binary")
        said = family.add(batch).collect()
        assert {(r.doc, p) for r in said for p in range(r["at"], r["at"] + r.n)} == expected
        assert sum(r.n == 0 for r in said) == 20
        family.merge()
        sizes = [n.bit_length() for n, _ in family.levels]
        assert sizes == sorted(set(sizes), reverse=True)
    assert sum(n for n, _ in family.levels) == len(seen)
    assert sum(r.n for _, level in family.levels for r in level.collect()) == len(seen)


@pytest.mark.parametrize("told", [1 << 25, 0])
def test_prefixes_grow_until_groups_are_small(spark, monkeypatch, told):
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", told)
    words = [" ".join([*("a b c d".split()), *(f"{i % 3}" for _ in range(4)), *(f"{i}" for _ in range(5)), ""]) for i in range(60)]
    rows = spark.createDataFrame([(1, i, 0, 0, 1, w) for i, w in enumerate([*words, *["z " * 13] * 50])], substring_dedup.SUFFIX)
    found = substring_dedup.prefixed(rows, 13, 800).withColumn("size", F.octet_length("suffix") + 32)
    assert ("BroadcastHashJoin" in found._jdf.queryExecution().toString()) == (told > 0)
    groups = {r.prefix: (r.n, r.size) for r in found.groupBy("prefix").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    assert sum(n for n, _ in groups.values()) == 110
    assert all(size <= 800 or len(p.split()) == 13 for p, (_, size) in groups.items())
    assert {len(p.split()) for p in groups} == {13} and found.where("not flat").isEmpty()
    few = substring_dedup.prefixed(rows.where("doc < 60"), 13, 2000).select("prefix").distinct().collect()
    assert {len(r.prefix.split()) for r in few} == {8}
    got = {(r.doc, r.n) for r in substring_dedup.tree_verdicts(rows, 13, 800).where("n > 0").collect()}
    assert got == {(i, 1) for i in range(61, 110)}


def sorted_suffixes(rng, n, reach):
    """Sorted suffixes of 3 to `reach` words of a small vocabulary, a space after each word; some words begin another."""
    words = ["a", "ab", "a\x01", "é" * 40]
    return sorted("".join(words[k] + " " for k in rng.integers(0, 4, rng.integers(3, reach + 1))).encode() for _ in range(n))


@pytest.mark.parametrize(("n", "reach"), [(1, 3), (400, 3), (400, 7), (60, 40)])
def test_nodes_equal_a_plain_finder(monkeypatch, n, reach):
    """Nodes of 3 words and more are the beginnings that several suffixes share and that they don't all go on from alike."""
    monkeypatch.setattr(substring_dedup, "CELLS", 256)
    rng = np.random.default_rng(reach)
    suffixes = sorted_suffixes(rng, n, reach) + [b"z " * 300, b"z " * 300, b"z " * 301]
    offsets = np.cumsum([0, *map(len, suffixes)])
    depth = substring_dedup.depths(np.frombuffer(b"".join(suffixes), np.uint8), offsets)
    got = {(d, a, b) for d, first, end in substring_dedup.nodes(depth, 3) for a, b in zip(first.tolist(), end.tolist(), strict=True)}
    under = {}
    for i, suffix in enumerate(suffixes):
        words = suffix.split(b" ")[:-1]
        for d in range(3, len(words) + 1):
            under.setdefault(tuple(words[:d]), []).append((i, words[d] if d < len(words) else None))
    expected = {(len(p), own[0][0], own[-1][0] + 1) for p, own in under.items() if len(own) > 1 and (len({w for _, w in own}) > 1 or own[0][1] is None)}
    assert got == expected and len({d for d, _, _ in got}) > (reach > 3)
    doc = rng.integers(0, 5, len(suffixes))
    windows = substring_dedup.repeated_windows(depth, doc, 3)
    for i, suffix in enumerate(suffixes):
        words = suffix.split(b" ")[:-1]
        shared = [d for d in range(3, len(words) + 1) if any(doc[j] < doc[i] for j, _ in under[tuple(words[:d])])]
        assert windows[i] == max(shared, default=2) - 2


def test_no_task_holds_two_python_workers(docs):
    def chained(node, above=False):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return chained(node.initialPlan())
        if name == "MapInArrow" and above:
            return True
        above = name == "MapInArrow" or above and "Exchange" not in name
        return any(chained(node.children().apply(i), above) for i in range(node.children().size()))

    for rows in (substring_dedup.remove_repeats(docs), suffix_dedup.remove_repeats(docs)):
        assert not chained(rows._jdf.queryExecution().executedPlan())


def test_depths_take_little_more_memory_than_the_suffixes():
    rng = np.random.default_rng(4)
    suffixes = sorted(b" ".join(b"w%d" % w for w in rng.integers(0, 1000, 20)) + b" " for _ in range(40_000))
    data, offsets = np.frombuffer(b"".join(suffixes), np.uint8), np.cumsum([0, *map(len, suffixes)])
    tracemalloc.start()
    depth = substring_dedup.depths(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(data)
    for i in (1, 2, 777, 39_999):
        one, two = suffixes[i - 1].split(), suffixes[i].split()
        assert depth[i] == next((k for k in range(20) if one[k] != two[k]), 20)


@pytest.mark.parametrize("held", [1, 400, 1 << 20])
def test_trees_are_held_node_by_node(held):
    """Whatever is held at a time, verdicts are the same; a flat group is read as a stream."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = sorted([(s, int(rng.integers(0, 9)), False) for s in sorted_suffixes(rng, 300, 6)] + [(b"m m m ", d // 7 + 2, True) for d in range(200)])
    offsets = np.cumsum([0, *(len(s) for s, _, _ in rows)])
    doc = np.array([d for _, d, _ in rows])
    expected = substring_dedup.repeated_windows(substring_dedup.depths(np.frombuffer(b"".join(s for s, _, _ in rows), np.uint8), offsets), doc, 3)
    zero = pa.array(np.zeros(len(rows), np.int64))
    columns = {"cls": zero, "doc": doc, "start": zero, "at": zero, "suffix": [s.decode() for s, _, _ in rows], "flat": [f for _, _, f in rows]}
    batches = pa.table(columns).to_batches(max_chunksize=17)
    said = list(substring_dedup.subtrees(3, held)(iter(batches)))
    assert np.concatenate([b["n"].to_numpy() for b in said]).tolist() == expected.tolist()
    assert max(b.num_rows for b in said) < 120 or held > 400


def test_suffixes_reach_the_end_of_their_record():
    made = substring_dedup.Suffixes(3)
    made.add(b"a b  c d\te f g", 5, [np.array([x, y]) for x, y in ((1, 2), (0, 0), (0, 4), (3, 1), (substring_dedup.ALONE + 1, substring_dedup.HOT))])
    rows = [tuple(r.values()) for batch in made.rows() for r in batch.to_pylist()]
    assert rows == [(1, 5, 0, 0, 3, "a b c d e "), (1, 5, 0, 1, 2, "b c d e "), (1, 5, 0, 2, 1, "c d e "), (2, 5, 4, 0, 1, "e f g ")]


@pytest.mark.parametrize("within", [True, False])
def test_followers_of_a_crowded_class_are_dealt(spark, monkeypatch, within):
    """600 followers of one class meet its verdict by (class, deal), and get what they would get without."""
    from cairn.llm import _repeats as rep

    monkeypatch.setattr(rep, "CROWD", 8)
    kinds = [(7, 0, d, 0, 5, rep.CROWDED if d % 3 else rep.FOLLOWER) for d in range(2, 602)]
    classes = spark.createDataFrame([(7, 0, 1, 0, 5, rep.SHARED), *kinds, (8, 0, 9, 40, 3, rep.FOLLOWER)], rep.CLASSED)
    verdicts = spark.createDataFrame([(7, 4, 0, 0, 0), (8, 3, 5, 0, 0)], rep.VERDICT)
    found = rep.spans(classes, verdicts, rep.Spec(by_word=True, seed=4, length=13, within=within))
    assert sorted(map(tuple, found.collect())) == sorted([*((d, 0, 5) for d in range(5, 602)), (9, 40, 3)])
    keys = "hashpartitioning(cls#" in found._jdf.queryExecution().toString()
    assert keys and ", deal#" in found._jdf.queryExecution().toString()


def test_very_many_copies(spark):
    """300 copies of a text, each after a word of its own, in one batch."""
    prose = " ".join(f"word{i}" for i in range(60))
    texts = {i: f"own{i} {prose}" for i in range(300)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert byte_digest(suffix_dedup.remove_repeats(rows))[0] == brute.suffix_dedup(texts)
    got = substring_dedup.remove_repeats(rows).select("doc_id", "kept").collect()
    assert {r.doc_id: r.kept for r in got} == {0: texts[0], **{i: f"own{i}" for i in range(1, 300)}}


#: The Thue-Morse word on a and b, and its complement: polynomials modulo 2^64 can't tell them apart.
TWINS = [tuple("".join("ab"[(bin(i).count("1") + turn) % 2] for i in range(n)) for turn in (0, 1)) for n in (1024, 2048)]


@pytest.mark.parametrize("twins", TWINS)
def test_long_words_that_polynomials_confuse(spark, twins):
    prose = " ".join(f"w{i}" for i in range(12))
    rows = spark.createDataFrame([(i, f"{prose} {w}") for i, w in enumerate(twins)], "doc_id long, text string")
    assert [len(r.spans) for r in substring_dedup.remove_repeats(rows).collect()] == [0, 0]
    alone = spark.createDataFrame(list(enumerate(twins)), "doc_id long, text string")
    assert {r.component_id for r in ngram_join.near_duplicates(alone).collect()} == {0, 1}


def test_rows_of_one_id_with_other_texts(spark):
    text = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 300)))
    prose = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text), (2, text), (2, "short"), (3, prose), (4, prose), (4, "x")], "doc_id long, text string")
    for operator in (suffix_dedup.remove_repeats, substring_dedup.remove_repeats):
        got = operator(rows).select("doc_id", F.col("kept").cast("string").alias("kept"), "spans").collect()
        assert len(got) == 6
        assert all(s.end - s.start <= len(text) for r in got for s in r.spans)
        assert {r.kept for r in got} >= {"short", "x", text, prose}


@pytest.mark.parametrize("operator", [suffix_dedup.remove_repeats, substring_dedup.remove_repeats, ngram_join.near_duplicates])
def test_long_texts(spark, operator):
    """Texts of more than 2 MB: one without a space, and one twice with another end."""
    rng = np.random.default_rng(2)
    letters = "".join(map(chr, rng.integers(97, 123, 2_300_000)))
    prose = " ".join(map(str, rng.integers(0, 10**6, 320_000)))
    rows = spark.createDataFrame([(1, letters), (2, prose), (3, prose + " end"), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in operator(rows).collect()}
    if operator is ngram_join.near_duplicates:
        assert {d: r.component_id for d, r in got.items()} == {1: 1, 2: 2, 3: 2, 4: 4}
    else:
        assert bytes(got[3].kept, "ascii") == b"end" if operator is substring_dedup.remove_repeats else bytes(got[3].kept) == b" end"
        assert [len(got[d].spans) for d in (1, 2, 4)] == [0, 0, 0]


@pytest.mark.parametrize("spread", [{}, {"hot": 1, "hot_total": 1}])
def test_substring_dedup_equals_brute_force(docs, texts, spread):
    rows = substring_dedup.remove_repeats(docs, **spread)
    got = rows.select("doc_id", "n_words", "spans", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    found = {r[0]: (r[1], sum(s.end - s.start for s in r[2]), r[3]) for r in got}
    assert len(got) == len(texts) + 2 and found.pop(None)[1] == 0
    assert found == brute.substring_dedup(texts)
    assert sum(v[1] for v in found.values()) > 0


@pytest.mark.parametrize("rule", [ngram_join.Jaccard(), ngram_join.Jaccard(floor=3), ngram_join.Jaccard(floor=3, small=2), ngram_join.Jaccard(heavy=3), ngram_join.Jaccard(floor=3, most=10, small=1)])
def test_ngram_join_equals_brute_force(docs, texts, rule):
    got = ngram_join.near_duplicates(docs, rule).collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert len(got) == len(texts) + 2 and found.pop(None)[1] is None
    assert found == brute.ngram_join(texts)
    assert len({c for _, c in found.values()}) < len(found) - 10


@pytest.mark.parametrize(("rule", "block"), [(ngram_join.Jaccard(), 2048), (ngram_join.Jaccard(floor=3, small=2), 7)])
def test_ngram_join_counts_every_link(spark, docs, texts, monkeypatch, rule, block):
    """Also within groups of near copies, whose sets are connected long before all their pairs are met."""
    monkeypatch.setattr(ngram_join, "COUNTED", block)
    words = [f"w{i}" for i in range(200)]
    copies = {1000 + i: " ".join([*words[: 5 * i], f"new{i}", *words[5 * i + 1 :]]) for i in range(30)}
    rows = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs.select("doc_id", "text").union(rows), rule).collect()}
    sets = {d: brute.shingles(t) for d, t in {**texts, **copies}.items()}
    near = lambda a, b: a != b and 100 * len(a & b) >= 80 * len(a | b)
    assert got.pop(None) == 0
    assert got == {d: sum(near(own, other) for other in set(sets.values())) for d, own in sets.items()}
    assert all(got[d] == 29 for d in copies)


def test_ngram_join_verifies_each_text_of_an_id(spark):
    """Rows of one id with other texts: each text's links are found, by that text."""
    p, q = [" ".join(f"{k}{i}" for i in range(40)) for k in "pq"]
    rows = spark.createDataFrame([(1, p), (1, q), (2, p + " more"), (3, q + " more"), (3, q + " more")], "doc_id long, text string")
    got = ngram_join.near_duplicates(rows).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 1, 1)]
    groups = {(r.doc_id, r.n_shingles): r.set_group for r in got}
    assert len({r.set_group for r in got}) == 2 and groups[2, 37] != groups[3, 37]
    plain = ngram_join.near_duplicates(rows, count_links=False).collect()
    assert {tuple(r)[:2] + tuple(r)[3:] for r in plain} == {tuple(r)[:2] + tuple(r)[3:] for r in got}
    assert {r.n_links for r in plain} == {None}


def test_scratch_goes_when_the_join_is_done(spark, docs):
    """Two tables stay, which the result reads; within an outer `temporary` these go too."""
    folder = Path(_io.shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    found = ngram_join.near_duplicates(docs)
    assert len(set(folder.iterdir()) - before) == 2 and found.count() == docs.count()
    before = set(folder.iterdir())
    with _io.temporary(spark):
        rows = _io.materialise(ngram_join.near_duplicates(docs), lasting=True)
    assert len(set(folder.iterdir()) - before) == 1 and rows.count() == docs.count()


@pytest.mark.parametrize("share", [1, 0.97, 0.9, 0.5, 0])
def test_linked_sets_share_one_of_few_keys(share):
    """However many of their tokens are frequent."""
    rng, rule, pool, texts = np.random.default_rng(5), ngram_join.Jaccard(width=1), [f"w{i}" for i in range(4000)], []
    for n in (5, 9, 40, 300, 2000):
        one = rng.permutation(pool)[: n + n // 4]
        texts += [one[:n], one, np.r_[one[: n - n // 10], one[n : n + n // 10]]]
    batch = pa.record_batch({"text": pa.array([" ".join(t) for t in texts])})
    sizes, row, value = ngram_join.batch_sets(batch, 1)
    often = np.unique(value[(value >> np.uint64(8)) % np.uint64(100) < 100 * share])
    names = ngram_join.set_names(sizes, row, value).tolist()
    keys = {c: set() for c in names}
    for part in ngram_join.postings(rule, SimpleNamespace(value=often))([batch]):
        for key, cls in zip(part["key"].to_pylist(), part["cls"].to_pylist(), strict=True):
            keys[cls] |= {key} - {None}
    keys, linked = [keys[c] for c in names], 0
    for a, n in enumerate(sizes.tolist()):
        assert len(keys[a]) <= 4 * n
        for b in range(a):
            both = len(np.intersect1d(texts[a], texts[b]))
            if 100 * both >= rule.percent * (n + sizes[b] - both):
                linked += 1
                assert keys[a] & keys[b]
    assert linked >= 10


def test_an_index_made_again_replaces_the_one_before(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(_io, "shared_folder", lambda spark: f"file://{tmp_path}")
    rule, made, real = ngram_join.Jaccard(floor=3, heavy=3, small=2), [], ngram_join.postings
    monkeypatch.setattr(ngram_join, "postings", lambda *a: made.append(a) or real(*a))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(ngram_join.profile(rule), ", ".join(f"{c} long" for c in ngram_join.PROFILE.names))
    with _io.temporary(spark):
        index, counts = ngram_join.indexed(docs.select("text"), rows, rule, 4)
        assert len(made) > 1 and index.count() > counts.count() > 0
        assert len(list(tmp_path.iterdir())) == 3  # the frequent tokens, the index and its counts
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize(("module", "operator"), [(ngram_join, ngram_join.near_duplicates), (suffix_dedup, suffix_dedup.remove_repeats)])
def test_each_step_frees_its_shuffles(spark, docs, monkeypatch, module, operator):
    name, said = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before, real = spark.conf.get(name), module.materialise
    monkeypatch.setattr(module, "materialise", lambda *a, **k: said.append(spark.conf.get(name)) or real(*a, **k))
    operator(docs.where("doc_id < 20").select("doc_id", "text"))
    assert len(said) > 1 and set(said) == {"true"} and spark.conf.get(name) == before


def test_groups_follow_the_data(docs, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUPED", 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got.pop(None)[1] is None and got == brute.ngram_join(texts)


@pytest.mark.parametrize("operator", [suffix_dedup.remove_repeats, substring_dedup.remove_repeats, ngram_join.near_duplicates])
def test_empty_and_null_tables(spark, docs, operator):
    assert operator(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None), (None, None)], "doc_id long, text string")
    assert operator(nulls).count() == 3


def test_long_documents_are_cut_into_segments(spark, monkeypatch):
    from cairn.llm import _repeats as rep

    rng = np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(97, 123, 5000)))
    import pyarrow as pa

    batch = pa.record_batch({"id": [4], "text": [text + "-" + text]})
    spec = rep.Spec(by_word=False, seed=24, length=100, within=True)
    whole = rep.batch_records(batch, spec)
    monkeypatch.setattr(rep, "SEGMENT", 700)
    cut = rep.batch_records(batch, spec)
    for records in (whole, cut):
        assert records[2].sum() == 10001 - 99
        assert sorted(records[1].tolist()) == sorted(set(records[1].tolist()))


def test_registered_queries_on_given_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_suffix_dedup(spark, SF).collect()}
    assert got == brute.suffix_dedup(texts)
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_substring_dedup(spark, SF).collect()}
    assert got == brute.substring_dedup(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_jaccard(spark, SF).collect()}
    assert got == brute.ngram_join(texts)
