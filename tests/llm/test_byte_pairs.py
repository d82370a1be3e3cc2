"""Encoding and decoding against the tiktoken library and round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from molfold.llm import byte_pairs as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return B.BytePairs(B.read_ranks(PATH), public_tokenizers.PATTERN)


def hard_texts():
    rng = random.Random(13)
    texts = ["", " ", "a", "\n\n  x", "don't I'll", "<|endoftext|>", "ééé naïve", "日本語のテキスト、中文", "हिन्दी", "🙂🙂🙂", "\x00\x01", "\x1c\x1d a\x85b\u3000c \x0b\x0cd\x1f", "a" * 5000, " " * 3001 + "x", "=-" * 700]
    texts += ["".join(rng.choice("ACGT") for _ in range(3000)), "".join(rng.choice("abcdefghijklmnop") for _ in range(4000))]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x4E00, 0x4F00), 10, 32])) for _ in range(rng.randrange(200))) for _ in range(200)]
    return texts


def ids_of(coded):
    return np.frombuffer(coded, "<u4").tolist()


def test_ids_are_those_of_the_library(coder, library):
    texts = hard_texts()
    coded = list(coder.encode(iter(texts)))
    assert [ids_of(c) for c in coded] == [library.encode_ordinary(t) for t in texts]
    assert list(coder.decode(iter(coded))) == [t.encode() for t in texts]


def test_small_blocks_and_few_rounds_change_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(B, "RUN", 5)
    monkeypatch.setattr(B, "NEW", 7)
    monkeypatch.setattr(B, "WAITING", 20)
    monkeypatch.setattr(B, "MEMORY", 300)
    monkeypatch.setattr(B, "MOST_ROWS", 2000)
    monkeypatch.setattr(B, "TOKENS", 7)
    texts = hard_texts()[:20] + [t[:300] for t in hard_texts()[:20]]
    coded = list(coder.encode(iter(texts)))
    assert [ids_of(c) for c in coded] == [library.encode_ordinary(t) for t in texts]
    assert list(coder.decode(iter(coded))) == [t.encode() for t in texts]


def test_every_token_of_the_vocabulary_is_one_id(coder):
    """Recursion leads from the bytes of each token to that token alone, in rising ranks."""
    tokens = [t for t in coder.ids if len(t) > 1]
    assert [ids_of(i) for _, i in sorted(coder._contracted(tokens))] == [[coder.ids[t]] for t in tokens]


def test_recursion_begins_with_certain_pairs_contracted(coder, library):
    """Fewer rows than bytes go into it, with the ids of the library."""
    pieces = [f" {a}{b}".encode() for a in ("the", "string", "house", "morn") for b in ("ing", "qua", "ther", "zz")]
    coder._need_merges()
    w, s, ids = coder._begun(pieces)
    assert len(w) < 0.8 * sum(map(len, pieces)) and (np.diff(w) >= 0).all()
    got = dict(coder._contracted(pieces))
    assert [ids_of(got[k]) for k in range(len(pieces))] == [library.encode_ordinary(p.decode()) for p in pieces]
    assert [x.tolist() for x in coder._begun([b"x"])[:2]] == [[0], [0]]


def test_certain_pairs_of_small_vocabularies():
    """Random merges of few letters, many of them overlapping, against one pair at a time."""
    rng = random.Random(4)
    for _ in range(12):
        tokens = [bytes([b]) for b in range(256)]
        known = [t for t in tokens if t in (b"a", b"b", b"c", b"d")]
        while len(tokens) < 256 + 25:
            new = rng.choice(known) + rng.choice(known)
            if len(new) < 7 and new not in tokens:
                tokens.append(new)
                known.append(new)
        small = B.BytePairs(b"\n".join(base64.b64encode(t) + b" %d" % r for r, t in enumerate(tokens)), ".+")
        whole = tiktoken.Encoding("small", pat_str=".+", mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
        assert [ids_of(c) for c in small.encode(iter(texts))] == [whole.encode_ordinary(t) for t in texts]


def test_reports(shared, library):
    rows = [(i, t) for i, t in enumerate(hard_texts())] + [(1, None), (None, "null id"), (1, "a"), (1, "a")]
    df = shared.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded").repartition(3)
    got = B.token_report(df, PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def plain(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert B.token_report(df.where("false"), PATH, public_tokenizers.PATTERN).collect() == []


def test_odd_ids(shared):
    df = shared.createDataFrame([(1, None), (2, b""), (3, np.array([2**31 - 1, 0], "<u4").tobytes())], "doc_id long, ids binary")
    first = next(base64.b64decode(line.split()[0]) for line in open(PATH, "rb") if line.split()[1] == b"0")
    assert {r.doc_id: bytes(r.decoded) for r in B.decode_ids(df, PATH).collect()} == {1: b"", 2: b"", 3: first}


def test_decoding_needs_the_vocabulary_only(monkeypatch):
    """No table of the coder's database is asked, ids that are not there spell nothing, rows may be cut anywhere."""
    other = B.BytePairs(B.read_ranks(PATH), public_tokenizers.PATTERN)
    other.db.close()
    by_id = {i: t for t, i in other.ids.items()}
    rows = [[], [5, 300, 2**32 - 1, 7], list(range(0, 3000, 7)), [max(by_id) + 1]]
    monkeypatch.setattr(B, "TOKENS", 5)
    packed = [b"".join(i.to_bytes(4, "little") for i in row) for row in rows]
    assert list(other.decode(iter(packed))) == [b"".join(by_id.get(i, b"") for i in row) for row in rows]
