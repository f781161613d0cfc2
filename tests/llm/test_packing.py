import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodescan.llm import packing as P
from lodescan.llm.text import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(P.VOCABULARY))


def ids_of(library, text):
    found = library.encode(text or "", add_special_tokens=False).ids + [P.CLOSING_ID]
    return np.array(found, "<u4").tobytes()


def check(rows, wanted, window=P.WINDOW):
    """Every id in one piece, sequences gapless, full or a power of two."""
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    assert set(by_doc) == set(wanted)
    for doc_id, copies in wanted.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[doc_id])
        expected = copies[0]
        total = len(expected) // 4
        assert all(p[3] in {len(c) // 4 for c in copies} for p in pieces)
        if len(copies) == 1:
            at = 0
            for start, length, code, tokens in pieces:
                assert start == at and tokens == total
                assert code == zlib.crc32(expected[4 * start:4 * (start + length)])
                at += length
            assert at == total
        else:
            assert sum(p[1] for p in pieces) == sum(len(c) // 4 for c in copies)


def wanted_of(docs, library):
    wanted = defaultdict(list)
    for r in docs.collect():
        wanted[r["doc_id"]].append(ids_of(library, r["text"]))
    return wanted


def test_generated_documents(small, library):
    check(P.pack(small).collect(), wanted_of(small, library))


@pytest.mark.parametrize("window, held", [(2048, 512), (64, 3), (256, 0)])
def test_odd_documents(docs, no_docs, library, window, held):
    rows = P.pack(docs.repartition(3), window=window, open_windows=held).collect()
    check(rows, wanted_of(docs, library), window)
    assert P.pack(no_docs).collect() == []


def test_ids_come_along(small, library):
    rows = P.pack(small.limit(20), with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)


def test_chunks_encode_as_the_whole(library):
    draw = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "'ll", "<|endoftext|>", "The", "ing", "1", "!", "é", "́",
             "Σ", "\xa0", "日本", "\x1c", ".", ",", "İ", "ǅ", "ß", "É", "ª", "ſ", "K"]
    texts = ["".join(draw.choice(parts) for _ in range(20)) for _ in range(500)] + ["", " "]
    encoder = P.ChunkEncoder(tokenizer_path(P.VOCABULARY), remembered=20_000)
    for text, found in zip(texts, encoder.encode(texts)):
        assert found + (1).to_bytes(4, "little") == ids_of(library, text)


def test_what_is_remembered_is_bounded_by_bytes(library):
    """Lines without a space and encoded data are never remembered, other chunks up to a size."""
    draw = random.Random(6)
    signs = [chr(0x4E00 + n) for n in range(5_000)]
    lines = ["".join(draw.choices(signs, k=400)) for _ in range(60)]
    blobs = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyzABC0123456789+/", k=2_000)) for _ in range(20)]
    encoder = P.ChunkEncoder(tokenizer_path(P.VOCABULARY), remembered=100_000)
    for text in ["\n".join(lines), *blobs]:
        assert encoder.encode([text])[0] + (1).to_bytes(4, "little") == ids_of(library, text)
    assert not encoder.known and encoder.held <= 100_000
    for at in range(40):
        encoder.encode([" ".join(f"w{at}x{n}" for n in range(100))])
    held = sum(P._size(c, i) for d in (encoder.known, encoder.words) for c, i in d.items())
    assert held == encoder.held < 100_000 + 100 * 300


def test_level_is_the_one_of_least_squares():
    draw = random.Random(4)
    window = 32
    packer = P.SumOfSquares(lambda pieces: None, window, open_windows=10**9)
    for n in range(600):
        size = draw.randint(1, window - 1)

        def squares(level):
            counts = packer.counts.copy()
            if level:
                counts[level] -= 1
            if level + size < window:
                counts[level + size] += 1
            return int((counts**2).sum())

        choices = [0] + [h for h in range(1, window - size + 1) if packer.counts[h]]
        assert squares(packer._best_level(size)) == min(map(squares, choices))
        packer.add(n, bytes(4 * size))


def test_few_documents_are_cut(spark):
    rows = P.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    pieces = defaultdict(int)
    for r in rows:
        pieces[r["doc_id"]] += 1
    needed = {r["doc_id"]: -(-r["doc_tokens"] // P.WINDOW) for r in rows}
    assert sum(pieces.values()) - sum(needed.values()) < 0.2 * len(pieces)


def test_words_are_cut_from_marks_as_in_the_whole(library):
    draw = random.Random(8)
    parts = [*" \n'<|>&(.,-_=5/A", "  ", "<|endoftext|>", "<|ENDOFTEXT|>", "the", "The", "J", "'S",
             "'re", "Ö", "ö", "×", "÷", "ß", "œ", "日", "…", "²", "̌", "̇", "̸",
             "İ", "\t", "\x85", "Σ"]
    encoder = P.ChunkEncoder(tokenizer_path(P.VOCABULARY), remembered=20_000)
    for special in (True, False):
        kept = [p for p in parts if special or "<" not in p]
        for size in (3, 20, 90):
            texts = ["".join(draw.choices(kept, k=size)) for _ in range(800)]
            for text, found in zip(texts, encoder.encode(texts), strict=True):
                assert found + (1).to_bytes(4, "little") == ids_of(library, text), text


def test_a_word_is_learnt_once(library):
    """Whatever marks and capitals it comes with, a word is merged and remembered once."""
    encoder = P.ChunkEncoder(tokenizer_path(P.VOCABULARY))
    text = "Stone stone, STONE! (stone) stone&&& stone5 /stone\nstone's schön, schön***"
    assert encoder.encode([text, ""]) == [ids_of(library, text)[:-4], b""]
    assert set(encoder.known) == {"stone", ",", "!", "(", ")", "&&&", "5", "/", "stone's", "schön", "***"}
    assert not encoder.words


def test_arrow_texts_of_any_width(library):
    texts = ["left out", "", "Whole texts.", "ÖL\n(7)", "left out"]
    wanted = [ids_of(library, text)[:-4] for text in texts[1:4]]
    encoder = P.ChunkEncoder(tokenizer_path(P.VOCABULARY))
    for kind in (pa.string(), pa.large_string(), pa.string_view()):
        assert encoder.encode(pa.array(texts, kind).slice(1, 3)) == wanted
    ends, ids = encoder.ids(pa.array([], pa.string()))
    assert ends.tolist() == [0] and len(ids) == 0


def test_frequent_words_outlive_a_full_memory():
    encoder = P.ChunkEncoder(tokenizer_path(P.VOCABULARY), remembered=1_000)
    encoder.encode(["often seldom rarely never ever"])
    learnt = []
    learn, encoder._learn = encoder._learn, lambda pieces: (learnt.extend(pieces), learn(pieces))
    encoder.encode(["often again"])
    assert learnt == ["again"] and set(encoder.known) == {"often", "again"}
    assert encoder.held == sum(P._size(p, i) for p, i in encoder.known.items())
