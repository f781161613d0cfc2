import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodescan.llm import token_counts as T
from lodescan.llm.text import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(T.VOCABULARY))


@pytest.fixture(scope="module")
def counter():
    return T.PrefixCounter(tokenizer_path(T.VOCABULARY), remembered=300)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


ODD = ["", " ", "  ", "a  b", "a\n\nb", "x<|endoftext|>y  <|endoftext|>", "I'll we've 's 'll'lx",
       "\x1c\x1da b\x85c​", "tab\t\tx \r\n y", "é 日本語 １２³ 😀👍🏽", "<|endoftext|", " lead",
       "trail ", "İ ſ", "!!'s", " 's", "'''ll"]


@pytest.mark.parametrize("seed", range(4))
def test_every_prefix(counter, library, seed):
    draw = random.Random(seed)
    parts = [" ", "  ", "\n", "'ll", "'re", "'", "<|endoftext|>", "the", "ing", "unbelievable",
             "1", "!", "é", "\t", "日"]
    texts = ["".join(draw.choice(parts) for _ in range(12)) for _ in range(120)] + ODD
    for text in texts:
        wanted = [size(library, text[:n]) for n in range(len(text) + 1)]
        assert counter.prefix_counts(text) == wanted, text
        assert counter.total(text) == wanted[-1], text


def test_generated_documents(small, library):
    rows = {r["doc_id"]: r for r in T.token_counts(small).collect()}
    for r in small.collect():
        found = rows[r["doc_id"]]
        tokens = size(library, r["text"])
        assert (found["n_tokens"], found["n_bytes"], found["over_limit"]) == (
            tokens, len(r["text"].encode()), tokens > 512)


def test_odd_documents(docs, no_docs, library):
    rows = T.token_counts(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted(
        (str(r["doc_id"]), size(library, r["text"] or "")) for r in docs.collect())
    assert T.token_counts(no_docs).collect() == []


def test_questions_without_encoding_again(small, library):
    asked = T.prefix_table(small.limit(30)).join(small, "doc_id").select(
        "text", T.tokens_before("prefix_tokens", 57).alias("tokens"),
        T.longest_prefix("prefix_tokens", 20).alias("chars"),
    ).collect()
    for r in asked:
        assert r["tokens"] == size(library, r["text"][:57])
        assert size(library, r["text"][:r["chars"]]) <= 20
        longer = range(r["chars"] + 1, min(len(r["text"]), r["chars"] + 40) + 1)
        assert all(size(library, r["text"][:n]) > 20 for n in longer)


def test_prefixes_of_odd_documents(docs):
    rows = T.prefix_table(docs.filter(F.length("text") < 100)).collect()
    assert all(r["prefix_tokens"][0] == 0 for r in rows)


def test_long_chunks_are_not_remembered(library):
    counter = T.PrefixCounter(tokenizer_path(T.VOCABULARY))
    for text in ("日本語" * 300, "aB3/" * 600, "short words stay"):
        assert counter.total(text) == size(library, text)
    assert max(map(len, [*counter.chunks, *counter.totals])) <= T.LONGEST_REMEMBERED
