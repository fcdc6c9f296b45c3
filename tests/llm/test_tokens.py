import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from credence.llm import bpe, packing

RANKS, PATTERN, FILE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a\n\nb", "don't stop 's", "  x   y ", "<|endoftext|> hi", "中文 été 12%%%", "ß.\nÄb", "퟿\U0001f600 z", "word " * 3000]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'sé中 \n\t1.%A \x85\x1c", max_size=60))
def test_cut_texts_have_the_same_ids(text):
    whole = bpe.encode(text, RANKS, PATTERN)
    assert bpe.encode(text, RANKS, PATTERN, size=3) == whole
    assert np.frombuffer(packing.CachedEncoder(FILE).encode([text])[0], "<u4").tolist() == packing.tokenizer(FILE).encode(text, add_special_tokens=False).ids
    assert bpe.decode(whole, RANKS, PATTERN) == text.encode()


def test_round_trip(docs):
    rows = list(enumerate(ODD))
    with open(RANKS, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    got = {r["doc_id"]: r for r in bpe.round_trip(docs(rows + [(3, ODD[3])]), RANKS, PATTERN).collect()}
    for i, t in rows:
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(bpe.encode(t or "", RANKS, PATTERN), "<u4").tobytes()).hexdigest()
    assert got[0]["n_tokens"] == 0 and len(known) == 50256
    assert bpe.round_trip(docs([]), RANKS, PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_open_bins(lengths, limit):
    """Against a plain list of open bins: the tightest that fits, else a new one, for which the fullest closes."""
    bins, used, rooms = packing.OpenBins(50, limit), {}, []
    for n in lengths:
        name, offset = bins.place(n)
        fitting = [r for r in rooms if r >= n]
        room = min(fitting) if fitting else 50
        assert (offset, offset) == (50 - room, used.get(name, 0))
        if fitting:
            rooms.remove(room)
        elif len(rooms) >= limit:
            rooms.remove(min(rooms))
        used[name] = offset + n
        if room > n:
            rooms.append(room - n)
        assert bins.open == len(rooms) <= limit and sorted(rooms) == sorted(f for f, b in bins.bins.items() for _ in b)


def test_cuts():
    assert packing.cuts(10, 10) == [(0, 10)] and packing.cuts(20, 10) == [(0, 10), (10, 10)] and packing.cuts(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_pack(docs):
    import zlib

    draw = random.Random(4)
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(draw.choice(["alpha", "beta", "Gamma,", "étoile."]) for _ in range(draw.randrange(1, 900)))) for i in range(60)]
    got = packing.pack(docs(rows), FILE).toPandas()
    assert set(got.doc_id) == {i for i, _ in rows}
    for d, text in rows:
        ids = np.array([*packing.tokenizer(FILE).encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        own = got[got.doc_id == d].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert (len(own) == 1) == (len(ids) <= 1024) and set(own.length[1:]) <= {1024}
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)]
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 1024
    assert packing.pack(docs([]), FILE).count() == 0


def test_packing_is_tight():
    draw = random.Random(6)
    bins, total = packing.OpenBins(1024, packing.OPEN_BINS), 0
    names = set()
    for _ in range(30_000):
        n = min(1024, int(draw.expovariate(1 / 400)) + 1)
        total += n
        names.add(bins.place(n)[0])
    assert len(names) < 1.02 * total / 1024


def test_safe_parts():
    text = "ab cd  ef " * 50
    parts = bpe.safe_parts(text, 20)
    assert "".join(parts) == text and len(parts) > 5 and all(re.match(r" \S", p) for p in parts[1:])


@pytest.mark.parametrize("text", ["x" * 200_000, "a " * 100_000])
def test_very_long_texts(docs, text):
    assert bpe.round_trip(docs([(1, text)]), RANKS, PATTERN).first()["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("c", [" ", "\t", "\n", "\u3000", " \n", "a", "中"])
def test_a_million_times_the_same(c):
    """Long runs have the ids of the ranks: what the library says of shorter runs in the same place goes on."""
    text = "x" + c * 1_000_000 + "y"
    ids = bpe.encode(text, RANKS, PATTERN)
    assert bpe.decode(ids, RANKS, PATTERN) == text.encode()
    white = c.isspace()
    piece = (c * 1_000_000)[:-1] if white else text
    own = bpe.encoding(RANKS, PATTERN)._core_bpe.encode_single_piece(piece.encode())
    assert ids == ([*bpe.encode("x", RANKS, PATTERN), *own, *bpe.encode(c[-1] + "y", RANKS, PATTERN)] if white else own)


def test_long_runs_among_others():
    draw = random.Random(1)
    enc = bpe.encoding(RANKS, PATTERN)
    kinds = [lambda: " " * draw.randrange(4090, 4110), lambda: "\n" * draw.randrange(4090, 4105), lambda: " \t\n" * 1500, *[lambda x=x: x for x in ("a", "!", "1", " ", "'s", "é")]]
    for _ in range(100):
        text = "".join(draw.choice(kinds)() for _ in range(draw.randrange(1, 7)))
        assert bpe.encode(text, RANKS, PATTERN) == enc.encode_ordinary(text)


def test_cache_is_bounded_by_bytes():
    """Unspaced texts of many characters are not kept, and words are as far as the bound goes; the ids stay the same."""
    draw = random.Random(3)
    encoder = packing.CachedEncoder(FILE, limit=100_000)
    for turn in range(4):
        texts = ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(5000)) for _ in range(20)] + [" ".join(f"w{draw.randrange(10**6)}" for _ in range(300)) for _ in range(3)]
        got = encoder.encode(texts)
        for t, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == packing.tokenizer(FILE).encode(t, add_special_tokens=False).ids
        assert all(len(p) <= packing.LONGEST_KEPT for p in encoder.known) and encoder.held <= 2 * encoder.limit


def test_repeated_rows_are_packed_each(docs):
    got = packing.pack(docs([(5, "same text")] * 3 + [(None, "x"), (None, "x")]), FILE).collect()
    assert len(got) == 5 and len({(r["sequence_id"], r["offset"]) for r in got}) == 5


def test_words_by_merges_are_the_tokenizers():
    """A space and letters: the merges give the ids of the tokenizer, for words of every kind, tokens on end among them."""
    draw = random.Random(8)
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]]
    tokens = [x for x in packing.tokenizer(FILE).get_vocab() if x.isalpha() and x.isascii()]
    kinds = [lambda: draw.choice(letters), lambda: draw.choice("etaoinshrdlu"), lambda: draw.choice(tokens)]
    words = [" " + "".join(kind() for _ in range(draw.randrange(1, 9))) for kind in kinds for _ in range(20_000)]
    single = packing.word_encoder(FILE)
    for w, e in zip(words, packing.tokenizer(FILE).encode_batch(words, add_special_tokens=False), strict=True):
        assert single(w.encode()) == e.ids, w


def test_long_texts_a_stretch_at_a_time():
    draw = random.Random(10)
    texts = [" ".join(draw.choice(["alpha", "été", "don't", "中文", "x\n\ny", "  ", "12%"]) for _ in range(60_000)), "short", "z" * 70_000, " \n" * 40_000]
    for t, ids in zip(texts, packing.CachedEncoder(FILE).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == packing.tokenizer(FILE).encode(t, add_special_tokens=False).ids


def test_words_without_merges(monkeypatch):
    monkeypatch.setattr(packing, "word_encoder", lambda path: None)
    text = "Some words, été and more of them."
    assert np.frombuffer(packing.CachedEncoder(FILE).encode([text])[0], "<u4").tolist() == packing.tokenizer(FILE).encode(text, add_special_tokens=False).ids
