"""Token counts under a unigram model, by dynamic programming that pre-tokens share through a trie.

A pre-token is a word between white space with the word mark before it. Its tokens are the vocabulary pieces of its best
segmentation: the greatest sum of log probabilities, then the fewest pieces. The forward score of a prefix does not depend on
what follows, so distinct pre-tokens go into a trie whose nodes keep the prefix's score and piece count: a pre-token that
shares a prefix with another only computes the rest. A node where a pre-token ends holds its terminal count. The trie is
built from sorted pre-tokens in preorder, so that only the current path is in memory besides the terminal counts. A pre-token
of over LONG characters stays out of the trie: the same recurrence runs over it with as many scores as the longest piece needs.

The vocabulary is a public tokenizer's list of pieces, used as it is. The list is in order of merging, without frequencies;
a piece's probability is Zipf's law on its place. A character that is no piece costs one piece for each of its UTF-8 bytes.

Each task has tries of its own, over the new words of some megabytes of text at a time, so memory is bounded. Nothing is shuffled.

Defined results: a null, empty or blank text has no pre-token and no token, and score 0. Rows stay rows, whatever their ids.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from math import log
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load, map_rows

MARK = "▁"
#: Words whose terminal counts a Python worker keeps, and characters of texts whose words go into the trie together.
MOST_WORDS, AT_ONCE = 1_000_000, 1 << 23
#: Characters of a pre-token from which it is scored without a path.
LONG = 4096
#: Log probability of a byte below that of the last piece.
BYTE_PENALTY = 10.0


def load_pieces(model: str) -> dict[str, float]:
    """Log probabilities of the model's pieces: Zipf's law on the place in the list, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = log(sum(1 / (k + 1) for k in range(len(plain))))
    return {sp.id_to_piece(i): -log(k + 1) - total for k, i in enumerate(plain)}


#: Stands for "begins a piece but is none".
BEGUN = float("-inf")


class Trie:
    """A trie over sorted pre-tokens, walked in preorder: the path to the current node is kept, with each prefix's forward score,
    piece count and the starts of what may still become a piece. A pre-token only adds nodes beyond what it shares."""

    def __init__(self, pieces: dict[str, float]):
        # the mark only starts a pre-token
        self.pieces = {p: s for p, s in pieces.items() if MARK not in p[1:]}
        self.begun = {p[:k]: BEGUN for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.byte = min(self.pieces.values(), default=0.0) - BYTE_PENALTY
        self.nodes = 0

    def terminals(self, words: list[str]) -> list[tuple[float, int]]:
        """Score and count of each of the sorted pre-tokens."""
        begun, is_piece = self.begun.get, self.pieces
        before, out = "", []
        scores, counts, starts = [0.0], [0], [[]]
        for word in words:
            if len(word) > LONG:
                out.append(self.alone(word))
                continue
            depth = len(commonprefix((before, word)))
            del scores[depth + 1 :], counts[depth + 1 :], starts[depth + 1 :]
            end = len(word)
            self.nodes += end - depth
            while depth < end:
                best, count, going = -1e300, 0, []
                own, depth = starts[depth], depth + 1
                for start in (*own, depth - 1):
                    score = begun(word[start:depth])
                    if score is not None:
                        going.append(start)
                        score += scores[start]
                        if score > best or score == best and counts[start] + 1 < count:
                            best, count = score, counts[start] + 1
                letter = word[depth - 1]
                if letter not in is_piece:
                    size = len(letter.encode("utf-8", "surrogatepass"))
                    score = scores[depth - 1] + size * self.byte
                    if score > best:
                        best, count = score, counts[depth - 1] + size
                scores.append(best)
                counts.append(count)
                starts.append(going)
            out.append((scores[-1], counts[-1]))
            before = word
        return out

    def alone(self, word: str) -> tuple[float, int]:
        """Score and count of a pre-token by itself; memory is bounded by the longest piece."""
        begun, is_piece = self.begun.get, self.pieces
        longest = max(map(len, self.pieces), default=1)
        scores, counts = deque([0.0], longest), deque([0], longest)
        going: list[int] = []  # starts, as distances back from here, of what may still become a piece
        for end, letter in enumerate(word, 1):
            best, count, still = -1e300, 0, []
            for back in (*going, 0):
                score = begun(word[end - back - 1 : end])
                if score is not None:
                    still.append(back + 1)
                    score += scores[-1 - back]
                    if score > best or score == best and counts[-1 - back] + 1 < count:
                        best, count = score, counts[-1 - back] + 1
            if letter not in is_piece:
                size = len(letter.encode("utf-8", "surrogatepass"))
                score = scores[-1] + size * self.byte
                if score > best:
                    best, count = score, counts[-1] + size
            scores.append(best)
            counts.append(count)
            going = [b for b in still if b < longest]
        return scores[-1], counts[-1]


class Counter:
    """Terminal scores and counts by word; of words seen before they are kept, up to a bound."""

    def __init__(self, pieces: dict[str, float], most: int = MOST_WORDS):
        self.trie, self.most, self.kept, self.held_long = Trie(pieces), most, {}, False

    def count(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """Pre-tokens, tokens and score of each text."""
        split = [text.split() if text else [] for text in texts]
        if len(self.kept) > self.most:
            self.kept = {}
        self.kept = {w: x for w, x in self.kept.items() if len(w) <= LONG} if self.held_long else self.kept
        new = set().union(*split).difference(self.kept)
        self.held_long = any(len(w) > LONG for w in new)
        if new:
            words = sorted(new)
            self.kept.update(zip(words, self.trie.terminals([MARK + w for w in words])))
        kept, out = self.kept.__getitem__, []
        for own in split:
            found = list(map(kept, own))
            out.append((len(found), sum(n for _, n in found), sum(s for s, _ in found)))
        return out


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        if model not in _counters:
            _counters[model] = Counter(load_pieces(model))
        for batch in by_size(rows):
            for (doc_id, _), (pre, tokens, score) in zip(batch, _counters[model].count([text for _, text in batch])):
                yield doc_id, pre, tokens, round(score, 6)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_pretokens long, n_tokens long, score double", arrow)


def by_size(rows: Iterator[tuple], at_most: int = AT_ONCE) -> Iterator[list[tuple]]:
    """Lists of (id, text) of about at_most characters, one text at least."""
    batch, held = [], 0
    for row in rows:
        batch.append(row)
        held += len(row[1] or "")
        if held >= at_most:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), model_path())


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE_SQL: dict[str, str] = {}
