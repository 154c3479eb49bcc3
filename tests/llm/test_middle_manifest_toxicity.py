"""Fill-in-the-middle, Merkle manifests and toxicity against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import fim, merkle, queries, toxicity
from tests.oracle import SF

# Fill-in-the-middle


def plain_middle(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (60, 0), (90, 100)])
def test_middle_equals_plain_version(spark, docs, rate, spm_rate):
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "é", "😀", "\n", "<", "P>", "\r", " "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    made += ["\n", "\n\n", "<P", "x<M>y\n", "a\n<P\n>b", "S>\n<\nM>", "line\n" * 300_000, "no end " * 200_000]
    own = spark.createDataFrame(list(enumerate(made, 5000)), "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(own).withColumns({c: F.lit("extra") for c in ("n", "form", "output", "cut_x")})
    found = fim.fill_in_middle(rows, rate=rate, spm_rate=spm_rate).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == rows.count() and {r.cut_x for r in found} == {"extra"}
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text, rate, spm_rate)
        assert r.back == (r.text or "")
    assert len({r.form for r in found}) == (3 if spm_rate == 50 else 2)


def test_middle_edges(spark, docs):
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="sentinels"):
        fim.fill_in_middle(docs, sentinels=("<P>", "<P>", "<M>"))
    words = fim.fill_in_middle(docs.where("text is not null"), unit=r"\s*\S+\s*|\s+", sentinels=("<pre>", "<suf>", "<mid>"))
    back = fim.restored(F.col("output"), F.col("form"), ("<pre>", "<suf>", "<mid>"))
    assert words.where(back != F.col("text")).count() == 0 and words.where("form <> 'plain'").count() > 100
    with pytest.raises(Exception, match="NoneType"):  # a text that isn't made of units
        fim.fill_in_middle(docs, unit="[a-z]").collect()


# Merkle manifests


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    return [(bool(i >> k & 1), level[i >> k ^ 1] if (i >> k ^ 1) < len(level) else None) for k, level in enumerate(tree[:-1])]


def plain_manifest(rows):
    """{(group, index): (id, digest, subroot, root, proof)} of (group, id, digest)."""
    groups = defaultdict(list)
    for g, d, x in rows:
        groups[g].append((d is not None, d or 0, x))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x for *_, x in sorted(groups[g])]) for g in names}
    over = levels([trees[g][-1][0] for g in names])
    out = {}
    for k, g in enumerate(names):
        for i, (there, d, x) in enumerate(sorted(groups[g])):
            out[g, i] = (d if there else None, x, trees[g][-1][0], over[-1][0], path(trees[g], i) + path(over, k))
    return out


def leaf_rows(spark, docs):
    digest = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return docs.select("doc_id", "lang", digest.alias("digest"), F.lit("extra").alias("index"), F.lit("extra").alias("size"), F.lit("kept").alias("block_x"))


def check(held, rows):
    expected = plain_manifest([(r.lang, r.doc_id, r.digest) for r in rows.collect()])
    found = merkle.proofs(held).withColumn("fold", merkle.folded(F.col("digest"), F.col("proof"))).collect()
    assert len(found) == len(expected)
    for r in found:
        assert (r.doc_id, r.digest, r.subroot, r.root, [tuple(s) for s in r.proof]) == expected[r.lang, r["index"]]
        assert r.fold == r.root and r.block_x == "kept"
    return expected


def test_leaves_of_different_rows_differ(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, "", "a"), (1, "-", "a"), (11, "a", None), (1, "1:a", None), (1, None, "é")], "a long, b string, c string")
    found = rows.withColumn("leaf", merkle.leaf(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert len({r.leaf for r in found}) == 6
    assert next(r.leaf for r in found if r.c == "é") == h("1:1", "-", "2:é")


@pytest.mark.parametrize("height", [12, 2])
def test_manifest_and_proofs_equal_plain_version(spark, docs, monkeypatch, height):
    """Null and repeated ids, a null group, groups of one row and of many; blocks of four leaves make several rounds."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = leaf_rows(spark, docs.withColumn("lang", F.when(F.col("doc_id") == 40, "zz").when(F.col("doc_id") == 41, "Z").otherwise(F.col("lang"))))
    held = merkle.manifest(rows, "lang", "doc_id")
    expected = check(held, rows)
    wanted = held.leaves.where("doc_id % 10 = 3 and lang = 'en' or index = 0")
    some = merkle.proofs(held, wanted).collect()
    assert len(some) == wanted.count() > 5
    for r in some:
        assert [tuple(s) for s in r.proof] == expected[r.lang, r["index"]][-1]
    assert merkle.multiproofs(wanted, held.nodes).where("derived is null").count() == 0


def test_partition_fetches_the_least_union(spark, docs, monkeypatch):
    """What is fetched is exactly what the paths need and the partition's own leaves don't give."""
    monkeypatch.setattr(merkle, "HEIGHT", 3)
    rows = leaf_rows(spark, docs)
    held = merkle.manifest(rows, "lang", "doc_id")
    wanted = held.leaves.where("index % 5 in (0, 1)")
    asked = Counter((r.tree, r.block, r.level, r["index"]) for r in merkle.missing_nodes(wanted).collect())
    needed = set()
    parts = defaultdict(set)
    for r in wanted.collect():
        parts[r.tree, r["index"] >> 3].add((r["index"], r["size"]))
    for (tree, block), own in parts.items():
        size = next(iter(own))[1]
        counts = merkle.counts(size)
        known = [{i for i, _ in own}]
        for n in counts[1:]:
            known.append({i >> 1 for i in known[-1]})
        needed |= {(tree, block, k, i ^ 1) for k, n in enumerate(counts[:-1]) for i in known[k] if (i ^ 1) < n and (i ^ 1) not in known[k]}
    assert set(asked) == needed and set(asked.values()) == {1}


def test_manifest_edges(spark, docs):
    rows = leaf_rows(spark, docs)
    none = merkle.manifest(rows.limit(0), "lang", "doc_id")
    assert none.root is None and merkle.proofs(none).count() == 0
    one = rows.where("doc_id = 3")
    held = merkle.manifest(one, "lang", "doc_id")
    only = merkle.proofs(held).first()
    assert only.proof == [] and only.root == only.subroot == only.digest == held.root
    assert merkle.manifest(rows.repartition(1), "lang", "doc_id").root == merkle.manifest(rows.repartition(9), "lang", "doc_id").root
    long = spark.createDataFrame([(1, "x" * 3_000_000)], "doc_id long, text string").select(merkle.leaf(F.col("doc_id"), F.col("text")))
    assert long.first()[0] == h("1:1", "3000000:", "x" * 3_000_000)


def test_tampered_rows_are_found(spark):
    rows = queries.op12_merkle_manifest(spark, SF).collect()
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root)
    assert 0 < sum(not r.verified for r in rows) < len(rows) / 3


# Toxicity


def labelled(spark, n, seed=5, biased=True):
    """Sentences where insults make toxic; one group is named mostly beside insults, another never."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdaeiou") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(30)]
        if toxic:
            text[rng.randrange(30)] = rng.choice(["vilescum", "vileness", "vilebrat"])
        # In one toxic row of six there is no insult: its label hangs on the group's name alone.
        if biased and toxic and rng.random() < 0.8:
            text[rng.randrange(30)] = "muslim"
            if i % 24 == 0:
                text = [w for w in text if not w.startswith("vile")]
        if biased and not toxic and rng.random() < 0.3:
            text[rng.randrange(30)] = rng.choice(["christian", "hindu"])
        docs.append((i, " ".join(text) + "."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int"), words


def test_swaps_cut_false_positives_on_neutral_mentions(spark):
    docs, labels, words = labelled(spark, 1200)
    rng = random.Random(9)
    neutral = [" ".join([*(rng.choice(words) for _ in range(20)), "muslim", *(rng.choice(words) for _ in range(9))]) for _ in range(200)]
    other = [t.replace("muslim", "hindu") for t in neutral]
    insults = [" ".join([*(rng.choice(words) for _ in range(20)), "vilescum", *(rng.choice(words) for _ in range(9))]) for _ in range(200)]
    free, held = (toxicity.train(docs, labels, penalty=p) for p in (0.0, 10.0))
    wrong = lambda m, texts: float((m.score(texts) >= 0.5).mean())
    gap = lambda m: float(np.abs(m.score(neutral) - m.score(other)).mean())
    assert wrong(free, neutral) > 0.3 > 0.02 >= wrong(held, neutral)
    assert gap(held) < 0.05 < gap(free)
    assert wrong(held, insults) > 0.9 and wrong(held, [" ".join(rng.choice(words) for _ in range(30)) for _ in range(200)]) == 0


def test_counterfactuals_change_terms_alone():
    found = list(toxicity.counterfactuals("The Muslim man slept. Nobody here! She left\nHe muslimah"))
    assert len(found) == 3
    of = lambda *ws: frozenset(toxicity.feature_set(list(ws)).tolist())
    lost, won = found[0]
    table = toxicity.swaps()
    assert lost == of("muslim", "man") - of("jewish", "woman") and won == of(table["muslim"][0], table["man"][0]) - of("muslim", "man")
    assert found[2][0] == of("he") and not found[2][0] & of("muslimah")
    kept = list(toxicity.counterfactuals("muslim muslims"))[0][0]
    assert kept <= of("muslim", "muslims")
    near = list(toxicity.counterfactuals("muslim muslinen"))[0][0]
    assert not near & of("muslinen") and of("muslim") - of("muslinen") == near
    assert list(toxicity.counterfactuals("")) == []


def test_toxicity_edges(spark, docs):
    some, labels, _ = labelled(spark, 200)
    model = toxicity.train(some, labels)
    rows = docs.withColumn("score", F.lit("extra"))
    found = toxicity.score(rows, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found) and found[0].part == "extra"
    again = toxicity.score(rows.repartition(7), model).collect()
    assert Counter((r.doc_id, r.score) for r in found) == Counter((r.doc_id, r.score) for r in again)
    base = {r.score for r in found if not (r.text or "").strip()}
    assert len(base) == 1 and base.pop() < 0.5
    assert toxicity.score(rows.limit(0), model).count() == 0
    assert toxicity.train(some, labels.limit(0)) is None and toxicity.train(some.limit(0), labels) is None
    assert {r.score for r in toxicity.score(rows, None).collect()} == {0.0}
    nulls = some.union(spark.createDataFrame([(900, None), (None, "a b"), (901, "")], some.schema))
    marks = labels.union(spark.createDataFrame([(900, 1), (None, 1), (901, 0), (902, None), (903, 7)], labels.schema))
    assert toxicity.train(nulls, marks) is not None
    one_kind = toxicity.train(some, labels.where("label = 0"))
    assert (one_kind.score(["a b c"]) < 0.5).all()
    long = "clean words " * 200_000 + " vilescum vileness"
    assert model.score([long, "clean words"])[0] > model.score([long, "clean words"])[1]


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op13_toxicity(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for r in rows.select("doc_id", "held_out").limit(500).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    found = rows.where("held_out").join(labels, "doc_id").collect()
    hits = [r.predicted for r in found if r.toxic == 1]
    wrong = [r.predicted for r in found if r.toxic == 0]
    assert np.mean(hits) > 0.8 and np.mean(wrong) < 0.01
    assert all(r.predicted == (r.score >= 0.5) for r in found)
