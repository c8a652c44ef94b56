from __future__ import annotations

import collections
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import langid, linededup, mixing, near, packing, simhash

from .test_operators import brute_fingerprint, brute_lines, none, odd  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    told = langid.stage(spark, docs, SF).cache()
    classifier = langid.Classifier(langid.learn(langid.learned_rows(docs)))
    want = [r["doc_id"] for r in docs.collect() if classifier.predict(r["text"])[0] != "und" and classifier.predict(r["text"])[1] >= langid.MIN_MARGIN]
    assert sorted(r["doc_id"] for r in told.collect()) == sorted(want) and told.columns == columns and len(want) > 0.95 * docs.count()
    lined = linededup.stage(spark, told, SF).cache()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in told.collect()]
    assert sorted((r["doc_id"], r["text"]) for r in lined.collect()) == sorted(brute_lines(rows, linededup.RATIO, linededup.MIN_PAGES))
    single = simhash.stage(spark, lined, SF).cache()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in lined.collect()}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({root(i) for i in prints})
    mixed = mixing.stage(spark, single, SF).cache()
    assert mixed.columns == columns and mixed.exceptAll(single).count() == 0
    # the stage's draws, rates and posteriors in one process
    model = mixing.fit(single, spark.read.parquet(f"{SF}/labels.parquet"))
    own = single.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", "text", F.lit(88)), F.lit(1 << 30)) / (1 << 30)).alias("at")).collect()
    found = [mixing.features(r["text"]) for r in own]
    p, tokens = model.posteriors(np.stack([x for _, x in found])).astype(float), np.array([n for n, _ in found])
    members = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(tokens, p)], "tokens long, p0 double, p1 double, p2 double")
    fitted = mixing.solve(members, at_most=1.0)
    rates = np.clip(1 - p @ fitted.push, 0, 1)
    assert fitted.settled and (rates * tokens) @ p == pytest.approx(fitted.totals, rel=1e-6) and fitted.totals == pytest.approx(fitted.targets, rel=1e-3)
    sure = [(r["doc_id"], r["at"] < rate) for r, rate in zip(own, rates) if abs(r["at"] - rate) > 1e-6]
    kept = {r["doc_id"] for r in mixed.collect()}
    assert len(sure) >= len(own) - 2 and all((i in kept) == stays for i, stays in sure)
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in x.collect()} for x in (single, mixed))
    clean = {i for i in before if labels.get(i) == (1, 0)}
    toxic = {i for i in before if i in labels and labels[i][1] == 1}
    assert len(clean - after) <= 0.05 * len(clean) and len(toxic & after) <= 0.3 * max(1, len(toxic))
    packed = corpus_pipeline.pack_stage(spark, mixed, SF).collect()
    tokens, encode, pieces = collections.Counter(), packing.encoder(packing.tokenizer_path()), set()
    for r in packed:
        tokens[r["sequence_id"]] += r["length"]
    for r in mixed.collect():
        ids = encode.whole(r["text"] or "") + packing.END
        for n, (start, length) in enumerate(packing.cuts(len(ids) // 4, packing.CAPACITY)):
            pieces.add((r["doc_id"], n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed} == pieces and max(tokens.values()) <= packing.CAPACITY
    # run() is the stages one after another
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    columns_of, single_again = ("doc_id", "piece", "start", "length", "ids_crc32"), corpus_pipeline.dedup_stage(spark, lined, SF)
    want = corpus_pipeline.pack_stage(spark, mixing.stage(spark, single_again, SF), SF).select(*columns_of).collect()
    assert sorted(map(key, corpus_pipeline.run(spark, SF).select(*columns_of).collect())) == sorted(map(key, want))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, odd, none, name, stage):
    """Nulls, copies, repeated ids, very long texts, no rows, and extra columns that are named like the stages' own."""
    found = stage(spark, odd, SF).collect()
    empty = stage(spark, none, SF)
    assert empty.count() == 0
    if name != "best-fit packing":
        assert empty.columns == odd.columns and all(r.asDict().keys() == set(odd.columns) for r in found)
        texts = {r["text"] for r in odd.collect()}
        assert {"language ID": len(found) <= 9 and None not in {r["text"] for r in found}, "line dedup": len(found) == 13, "SimHash near-dedup": len(found) == 8, "mixing to target weights": 1 <= len(found) <= 13}[name], len(found)
        assert {r["text"] for r in found} <= texts
        assert all(r["row"] == "row!" and r["domain"] == "domain!" and r["least"] == "least!" for r in found)
    else:
        assert {r["doc_id"] for r in found} == {r["doc_id"] for r in odd.collect()}


def test_run(spark, none, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing to target weights", "best-fit packing"]
    none.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_entry_without_the_subpackage(tmp_path):
    """__spark_entry__ imports, with the other queries, where the subpackage and the pipeline are gone."""
    import shutil

    root = Path(corpus_pipeline.__file__).resolve().parent
    shutil.copytree(root / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') or k == 'pipeline' for k in q)"], cwd=tmp_path, env={"PATH": "/usr/bin:/usr/local/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def five_word_components(rows):
    """doc_id of the least document of each component at Jaccard similarity 0.8 of five-word shingles."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted({root(i) for i in parent})


def test_near_dedup_links_at_similarity(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    two_bits = simhash.stage(spark, docs, SF).count()
    r = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    copies = []
    for k in range(60):  # a group of near copies, some beyond 0.8 of each other
        words = list(base)
        for _ in range(r.randrange(1, 9)):
            words[r.randrange(300)] = f"x{r.random()}"
        copies.append((10_000_000 + k, " ".join(words)))
    odd = [(20_000_000, ""), (20_000_001, None), (20_000_002, "one two"), (20_000_003, "One  two"), (20_000_004, "one two three")]
    more = spark.createDataFrame(copies + odd, "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    want = five_word_components(rows + copies + odd)
    assert len(five_word_components(rows)) < two_bits
    for block in (near.BLOCK_ROWS, 8):
        monkeypatch.setattr(near, "BLOCK_ROWS", block)
        assert sorted(x["doc_id"] for x in corpus_pipeline.dedup_stage(spark, both, SF).collect()) == want
    # many keys' members fall into several groups: clusters that share half of their words, none of them near another
    clusters = []
    for c in range(4):
        for k in range(30):
            words = base[:150] + [f"c{c}-{n}" for n in range(75)]
            words[r.randrange(200)] = f"y{r.random()}"
            clusters.append((30_000_000 + 100 * c + k, " ".join(words)))
    monkeypatch.setattr(near, "BLOCK_ROWS", 8)
    for pivots in (2, 8):
        monkeypatch.setattr(near, "PIVOTS", pivots)
        tables = spark.createDataFrame(clusters + copies, "doc_id long, text string")
        assert sorted(x["doc_id"] for x in corpus_pipeline.dedup_stage(spark, tables, SF).collect()) == five_word_components(clusters + copies)
    nameless = more.withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.dedup_stage(spark, nameless, SF).count() == len(five_word_components(copies + odd))
    assert dict(corpus_pipeline.STAGES)["SimHash near-dedup"] is corpus_pipeline.dedup_stage


def test_near_dedup_candidates_come_from_simhash(spark, monkeypatch):
    """The stage's links are those of brute force where its SimHash tables have many buckets; registers and bands of other sketches have no part."""
    for name in ("key_groups", "band_keys", "likely_pairs"):
        monkeypatch.setattr(near, name, None)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    r = random.Random(8)
    rows = []
    for k in range(150):
        words = [f"{k}-{n}" for n in range(r.randrange(30, 200))]
        rows.append((k, " ".join(words)))
        for c in range(r.randrange(4)):  # copies around the similarity of 0.8
            own = list(words)
            for _ in range(max(1, len(words) * r.randrange(1, 5) // 100)):
                own[r.randrange(len(own))] = f"x{r.random()}"
            rows.append((1000 + 10 * k + c, " ".join(own)))
    bits, words = simhash.table_bits(len(rows))
    assert bits.shape[1] >= 4 and len(np.unique(bits)) == bits.size and bits.min() >= 64 * simhash.CHECKED and bits.max() < 64 * words
    want = five_word_components(rows)
    assert 150 < len(want) < len(rows) - 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.dedup_stage(spark, docs, SF).collect()) == want


def test_wide_fingerprints(spark):
    r = np.random.default_rng(2)
    for n in (1, 2, 254, 255, 256, 700):
        own = r.integers(0, 1 << 63, n, np.uint64)
        mixed = near.mixed(own[:, None] + simhash._STEPS[:4])
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=int)
        assert np.unpackbits(simhash.wide_fingerprint(own, 4), bitorder="little").tolist() == (2 * bits > n).astype(int).tolist()
    # of many pairs those are given that connect what all connect
    prints = np.repeat(r.integers(0, 1 << 63, (3, 3), np.uint64), 80, 0) ^ (np.uint64(1) << r.integers(0, 63, (240, 3)).astype(np.uint64))
    pairs = simhash.close_pairs(prints, np.full(240, 9), 80)
    assert near.spanning(240, pairs)[1] == [k - k % 80 for k in range(240)] and len(pairs) < 3000
    assert len(simhash.close_pairs(prints[:2], np.array([7, 9]), 80)) == 0
