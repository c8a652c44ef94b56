from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from sparkloom.llm import near, setsketch

from .test_operators import documents, local, none, odd, text  # noqa: F401


def plain_set(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[k : k + 2]) for k in range(len(words) - 1)} or ({tuple(words)} if words else set())


def brute(rows, percent=80):
    """All pairs of distinct sets, and components by repeated union; rows are (doc_id, text)."""
    sets = [frozenset(plain_set(t)) for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for a, b in itertools.combinations(distinct, 2):
        if 100 * len(a & b) >= percent * len(a | b):
            parent[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    found = [(i, len(s), least.get(root(s)) if s else i) for (i, _), s in zip(rows, sets)]
    return sorted(((i, n, c, i == c) for i, n, c in found), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in local(df)), key=repr)


def changed(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def near_rows(seed, bases=12, copies=12):
    """Groups of texts that differ in none to many words, chains among them, and unlike texts."""
    r, rows = random.Random(seed), []
    for b in range(bases):
        base = [f"v{r.randrange(5000)}" for _ in range(r.choice([8, 30, 120, 400]))]
        for _ in range(copies):
            rows.append(changed(r, base, r.choice([0, 0, 1, 2, len(base) // 20, len(base) // 10])))
            if r.random() < 0.3:
                base = rows[-1].split()
    rows += [f"only {k} here {r.random()}" for k in range(30)] + ["one", "ONE", "", "  ", "two words", "Two\twords"]
    r.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("block_rows, block_bytes, ids, nodes", [(256, 1 << 24, 200_000, 1 << 20), (4, 1 << 24, 200_000, 4), (256, 3000, 0, 1 << 20), (3, 500, 0, 1)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block_rows, block_bytes, ids, nodes):
    for name, value in (("BLOCK_ROWS", block_rows), ("BLOCK_BYTES", block_bytes), ("BROADCAST_IDS", ids), ("FOREST_NODES", nodes)):
        monkeypatch.setattr(near, name, value)
    rows = near_rows(block_rows)
    want = brute(rows)
    assert len({c for *_, c, _ in want}) < len(rows) - 60
    assert result(setsketch.near_duplicates(documents(spark, [(i, t, "en", "a") for i, t in rows]))) == want


def test_hot_keys_and_repeated_ids(spark, monkeypatch):
    for name, value in (("SAMPLED", 1), ("HOT_ROWS", 3), ("BLOCK_ROWS", 8)):
        monkeypatch.setattr(near, name, value)
    rows = [(k if k % 3 else None, t) for k, t in near_rows(9)] + [(5, t) for _, t in near_rows(10, 2)] * 2
    assert result(setsketch.near_duplicates(documents(spark, [(i, t, "en", "a") for i, t in rows]))) == brute(rows)


def test_odd_rows(spark, odd, none):  # noqa: F811
    assert result(setsketch.near_duplicates(odd)) == brute([(r["doc_id"], r["text"]) for r in local(odd)])
    assert setsketch.near_duplicates(none).count() == 0


def random_sets(seed, n_a, n_b, both):
    x = np.random.default_rng(seed).integers(0, 1 << 63, n_a + n_b - both, np.uint64)
    return np.unique(x[:n_a]), np.unique(x[n_a - both :])


def test_sketches_merge_whatever_their_batches(monkeypatch):
    a, b = random_sets(1, 300, 500, 100)
    whole = setsketch.sketch([a, b, np.union1d(a, b), np.zeros(0, np.uint64), a[:1]])
    assert (setsketch.merge(whole[0], whole[1]) == whole[2]).all() and not whole[3].any() and whole[4].all()
    for at_once in (1, 7, 350):
        monkeypatch.setattr(setsketch, "AT_ONCE", at_once)
        assert (setsketch.sketch([a, b]) == whole[:2]).all()


def test_sketches_follow_their_definition():
    """Each register is the earliest of every element's arrivals, all of them drawn."""
    own = np.random.default_rng(2).integers(0, 1 << 63, 5, np.uint64)
    m = 16
    earliest = np.full(m, np.inf)
    for x in own.tolist():
        t, k = 0.0, 0
        while t < setsketch.BASE:
            k += 1
            h = int(near.mixed(np.array([(x + k * int(setsketch._STEP)) % 2**64], np.uint64))[0])
            t += -np.log(((h >> 32) + 0.5) / 2**32) / (setsketch.RATE * m)
            at = (h & 0xFFFFFFFF) * m >> 32
            earliest[at] = min(earliest[at], t)
    want = np.clip(np.floor(1 - np.log(earliest) / np.log(setsketch.BASE)), 0, setsketch.MOST)
    assert np.abs(setsketch.sketch([own], m)[0].astype(int) - want).max() <= 1  # sums in another order


def test_estimates():
    for n_a, n_b, both in ((1000, 1000, 889), (400, 500, 390), (2000, 100, 50), (300, 300, 0)):
        j = both / (n_a + n_b - both)
        found, sizes, equal = [], [], []
        for seed in range(30):
            a, b = random_sets(seed, n_a, n_b, both)
            x, y = setsketch.sketch([a, b])
            counts = [np.array([int(c.sum())]) for c in (x > y, x < y, x == y)]
            found.append(setsketch.similarity(*counts, np.array([len(a)]), np.array([len(b)]))[0])
            sizes.append(setsketch.cardinality(x))
            equal.append(counts[2][0] / setsketch.REGISTERS)
        assert abs(np.mean(found) - j) < 0.03 and abs(np.mean(sizes) / n_a - 1) < 0.06
        assert abs(np.mean(equal) - j) < 0.04  # registers are locality-sensitive


def test_every_pair_at_the_limit_is_a_candidate():
    r, missed, wrong = random.Random(4), 0, 0
    for _ in range(1500):
        n = r.randrange(20, 400)
        both = -(-8 * n // 9)  # 8/9 of each of two equal sets in common: at least 0.8 of the union
        x, y = setsketch.sketch(list(random_sets(r.random().__hash__() % 2**32, n, n, both)))
        keys = near.band_keys(np.stack([x, y]), setsketch.ROWS)
        missed += not (keys[0] == keys[1]).any()
        wrong += not len(near.likely_pairs(np.stack([x, y]), np.array([n, n]), 80, setsketch.similarity))
    assert missed <= 1 and wrong == 0


@pytest.mark.parametrize("size", [4, 16, 1 << 20])
def test_word_hashes_whatever_is_hashed_at_once(monkeypatch, size):
    texts = ["", " ", "a", "one two  one\ttwo", "x" * 40 + " x " + "x" * 40, "abcd abcd", "  abcde\n\nabcd  ", "Größe \x0b größe"]
    monkeypatch.setattr(near, "HASHED_BYTES", size)
    near._powers.cache_clear()
    for t in texts:
        words, hashes = t.encode().split(), near.word_hashes(t.encode()).tolist()
        assert len(words) == len(hashes) and len(set(words)) == len(set(hashes)) and len({*zip(words, hashes)}) == len(set(words))
    near._powers.cache_clear()
