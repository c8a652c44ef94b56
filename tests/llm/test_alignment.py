from __future__ import annotations

import collections
import hashlib
import random

import public_tokenizers
import pytest

from sparkloom.llm import alignment, packing

from .test_operators import documents, local, none, odd, text  # noqa: F401

A, B = packing.tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """The contract with the libraries' own encoders, whole texts and sets of ends."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer, decoders

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.letters = {v: k for k, v in packing._byte_letters().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        assert decoders

    def tokens(self, t):
        if not t:
            return [], []
        ids_a, ids_b = self.a.encode(" " + t, add_special_tokens=False).ids, self.b.encode(t)
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in ids_a]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, self.b.id_to_piece(i)) for i in ids_b)]
        spelled = (" " + t).encode()
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == spelled else ([], [])

    def groups(self, t):
        def ends(tokens):
            at, out = 0, []
            for i, x in tokens:
                at += len(x)
                out.append((at, i))
            return out

        a, b = map(ends, self.tokens(t))
        common, out = sorted({e for e, _ in a} & {e for e, _ in b}), []
        before = 0
        for e in common:
            out.append(([i for x, i in a if before < x <= e], [i for x, i in b if before < x <= e]))
            before = e
        return len(a), len(b), out


def brute(texts):
    plain = Plain()
    found = [plain.groups(t) for t in texts]
    counts = collections.Counter((a[-1], b[-1]) for _, _, groups in found for a, b in groups)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for n_a, n_b, groups in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if links else ""))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
STRANGE = ["a  b   c", " x", "x ", "   ", "\n", "\n\n x\ny", "\t tab", "it's ﬁne — “quoted” 日本語 🙂 é̃", "▁mark", "x<|endoftext|>y", "</s><unk> <0x0A>", "a\x00b", "x" * 5000, "Ünï çôdé " * 300, "1234567890 3.14²", "don't  \n  stop", " nbsp em", " \n \n", "ا ب ج", "a\r\nb"]


@pytest.mark.parametrize("swept, run, most", [(1 << 19, 2048, 1 << 20), (1, 3, 0), (50, 7, 10)])
def test_alignment_against_brute_force(spark, monkeypatch, swept, run, most):
    r = random.Random(5)
    texts = STRANGE + [text(k, r.choice(["en", "de"]), r.randint(1, 80)) for k in range(40)] + [None, ""]
    monkeypatch.setattr(alignment, "RUN", run)
    monkeypatch.setattr(alignment, "SWEPT", swept)
    monkeypatch.setattr(alignment, "COUNTED", swept)
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    aligned = alignment.align(docs, A, B).cache()
    got = {x["doc_id"]: tuple(x[n] for n in NAMES) for x in local(alignment.with_support(aligned, most))}
    want = brute(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(x[0] > 0 for x in want) > 50 and want[STRANGE.index("▁mark")][0] == 0
    for x in local(aligned):
        assert len(x["ends"]) == x["n_groups"] and (not x["ends"] or x["ends"][-1] == len((" " + texts[x["doc_id"]]).encode()))
    aligned.unpersist()


def test_alignment_of_odd_rows(spark, odd, none):  # noqa: F811
    rows = local(odd)
    got = sorted(((x["doc_id"], *(x[n] for n in NAMES)) for x in local(alignment.with_support(alignment.align(odd, A, B)))), key=repr)
    assert got == sorted(((r["doc_id"], *x) for r, x in zip(rows, brute([r["text"] for r in rows]))), key=repr)
    for most in (0, 100):
        assert alignment.with_support(alignment.align(none, A, B), most).count() == 0


def test_segments_are_whole_texts(spark):
    """Segments encoded by themselves give what the model gives for the whole text."""
    pieces, plain = alignment.Pieces(B), Plain()
    assert pieces.apart
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        t = row["text"]
        if t and plain.tokens(t)[1]:
            assert list(memoryview(pieces(" " + t)).cast("I")) == plain.b.encode(t)
