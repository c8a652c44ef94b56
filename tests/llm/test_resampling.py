from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from sparkloom.llm import resampling

from .test_operators import documents, local, none, odd, text  # noqa: F401


def plain_features(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    """The contract word for word; docs are (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % 10000
    s = collections.Counter(bucket(f) for _, t in docs for f in plain_features(t)[1])
    t_ = collections.Counter(bucket(f) for t in target for f in plain_features(t)[1])
    S, T = sum(s.values()), sum(t_.values())
    rows = []
    for doc_id, t in docs:
        words, found = plain_features(t)
        weight = sum(math.floor(1000 * math.log((t_[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in local(df)), key=repr)


def test_resampling_against_brute_force(spark):
    r = random.Random(3)
    rows = [(k, text(k, r.choice(["en", "de"]), r.choice([0, 1, 2, 5, 19, 20, 60])), "en", "a") for k in range(400)]
    target = [text(7, "de", 80), "The QUICK-brown, fox's 3rd Äpfel", None, ""]
    found = resampling.resample(documents(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    want = brute([x[:2] for x in rows], target)
    assert result(found) == want and sum(x[5] is not None for x in want) >= 5


def test_resampling_of_odd_rows(spark, odd, none):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in local(odd)]
    target = [r["text"] for r in local(odd)][:4]
    few = spark.createDataFrame([(t,) for t in target], "text string")
    assert result(resampling.resample(odd, few)) == brute(rows, target)
    assert result(resampling.resample(odd, few.limit(0))) == brute(rows, [])
    assert resampling.resample(none, few).count() == 0
    # of copies with one id and score, as many are drawn as places are left
    copies = documents(spark, [(1, text(1), "en", "a")] * 60 + [(2, text(2), "en", "a")])
    assert result(resampling.resample(copies, few)) == brute([(1, text(1))] * 60 + [(2, text(2))], target)


@pytest.mark.parametrize("sorted_words, split, kept", [(1, 1, 1), (7, 30, 5), (50, 200, 1 << 20)])
def test_pieces_of_any_size(monkeypatch, sorted_words, split, kept):
    monkeypatch.setattr(resampling, "SORTED_WORDS", sorted_words)
    monkeypatch.setattr(resampling, "SPLIT_BYTES", split)
    monkeypatch.setattr(resampling, "KEPT_WORDS", kept)
    texts = [text(1, "en", 300), None, "", "one", "one two", text(2, "de", 77), "x " * 50, "Größe, größe GRÖSSE"]
    reader, found, sizes = resampling.Reader(), collections.Counter(), collections.Counter()
    for runs, owners in reader.read(texts):
        own = collections.Counter(owners.tolist())
        sizes.update(own)
        for lengths, full, buckets in runs:
            for n, b in zip(lengths[full].tolist(), buckets.tolist()):
                found[b] += n
    want = collections.Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in plain_features(t)[1])
    assert found == want and [sizes[k] for k in range(len(texts))] == reader.sizes == [len(plain_features(t)[0]) for t in texts]


def test_runs_are_repeated_ngrams():
    reader = resampling.Reader()
    ((runs, _),) = reader.read(["a b c a b d", "a b c"])
    by_length = [sorted(lengths[full].tolist()) for lengths, full, _ in runs]
    assert by_length == [[1, 2, 3, 3], [1, 1, 2, 3], [1, 1, 1, 2]]  # a b c d; ab bc ca bd; abc abd bca cab
