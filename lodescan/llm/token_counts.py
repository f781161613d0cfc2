"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-pair encoding is settled from the left: the encoding of a prefix ends in the one token
whose own predecessor, the last token of the shorter prefix, stands next to it in the encoding
of both together. So count[i] = count[i - len(token)] + 1 for that token, and one pass over a
word gives the exact count of each of its prefixes. Words (the pieces before merging) are
independent, and a text's counts are those of its words, added up. With the counts stored,
``tokens_before`` and ``longest_prefix`` answer truncation and budget questions by look-up.

Rows: a null text counts as empty, with no token; ids may be null or repeat, one row comes out
per row. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import byte_names, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
# fixed values: the words of the vocabulary's own pre-tokeniser
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# chunks, words and token pairs a Python worker remembers, each, none of more characters than
# the longest; unspaced text and encoded data come in chunks that never come again
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64


class PrefixCounter:
    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = {name: byte for byte, name in enumerate(byte_names())}
        raw = {
            token: bytes(names[c] for c in token)
            for token in spec["model"]["vocab"]
            if all(c in names for c in token)
        }
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[raw[left], raw[right]] = rank
        # finds the tokens that end at each place; only those that their own bytes encode to
        self.endings = ahocorasick.Automaton()
        for token in raw.values():
            if self._merged(token) == [token]:
                self.endings.add_word(token.decode("latin-1"), token)
        self.endings.make_automaton()
        self.words = regex.compile(WORDS)
        self.space_runs = regex.compile(r"\s{2,}")
        self.edge_space = regex.compile(r"^\s|\s$")
        self.at_special = regex.compile(
            "(" + "|".join(map(regex.escape, self.special)) + ")" if self.special else r"(?!)"
        )
        self.remembered = remembered
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.totals: dict[str, int] = {}
        self.chunks: dict[str, int | None] = {}

    def _merged(self, text: bytes) -> list[bytes]:
        """The encoding by its definition: the merge of least rank first."""
        parts = [text[i:i + 1] for i in range(len(text))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = ranks.get((parts[i], parts[i + 1]))
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _adjacent(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together."""
        if len(self.pairs) > self.remembered:
            self.pairs.clear()
        found = self._merged(pair[0] + pair[1]) == [*pair]
        if len(pair[0]) + len(pair[1]) <= 2 * LONGEST_REMEMBERED:
            self.pairs[pair] = found
        return found

    def word_counts(self, word: bytes) -> list[int]:
        """Token counts of the prefixes of one word, by bytes, from the empty prefix on."""
        pairs = self.pairs
        counts = [0] * (len(word) + 1)
        last = [b""] * (len(word) + 1)
        done = 0
        for at, token in self.endings.iter(word.decode("latin-1")):
            end = at + 1
            if end == done:
                continue
            start = end - len(token)
            if start:
                pair = (last[start], token)
                apart = pairs.get(pair)
                if not (self._adjacent(pair) if apart is None else apart):
                    continue
            last[end] = token
            counts[end] = counts[start] + 1
            done = end
        return counts

    def _word_total(self, word: str) -> int:
        found = self.totals.get(word)
        if found is None:
            if len(self.totals) > self.remembered:
                self.totals.clear()
            found = self.word_counts(word.encode())[-1]
            if len(word) <= LONGEST_REMEMBERED:
                self.totals[word] = found
        return found

    def _ordinary_total(self, text: str) -> int:
        return sum(map(self._word_total, self.words.findall(text)))

    def _chunk_total(self, chunk: str) -> int | None:
        """Tokens of a chunk between single spaces or line feeds; None if it is not one."""
        if not chunk.strip(" ") or self.edge_space.search(chunk.removeprefix(" ")):
            return None
        return sum(self.word_counts(w.encode())[-1] for w in self.words.findall(chunk))

    def total(self, text: str) -> int:
        """Tokens of a whole text; a chunk between single spaces is looked up."""
        if not text:
            return 0
        if self.at_special.search(text):
            parts = self.at_special.split(text)
            return sum(1 if n % 2 else self.total(p) for n, p in enumerate(parts))
        known = self.chunks
        if len(known) > self.remembered:
            known.clear()
        lines = text.split("\n")
        total = len(lines) - 1  # a line feed between two words is one token
        for line in lines:
            for chunk in line.replace(" ", "\n ").split("\n"):
                found = known.get(chunk, -1)
                if found == -1:
                    found = self._chunk_total(chunk)
                    if len(chunk) <= LONGEST_REMEMBERED:
                        known[chunk] = found
                if found is None:  # a run of white space: words depend on what follows it
                    return self._ordinary_total(text)
                total += found
        return total

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts of every prefix, by characters, from the empty prefix on.

        A prefix counts as a text of its own: cut inside a run of white space, a contraction
        or a special string, it has other words than the whole.
        """
        counts = [0]
        parts = self.at_special.split(text)
        for n, part in enumerate(parts):
            base = counts[-1]
            if n % 2:
                before = parts[n - 1]
                inside = self._ordinary_prefixes(before + part[:-1])[len(before) + 1:]
                opening = counts[-len(before) - 1]
                counts += [opening + c for c in inside] + [base + 1]
            else:
                counts += [base + c for c in self._ordinary_prefixes(part)[1:]]
        return counts

    def _ordinary_prefixes(self, text: str) -> list[int]:
        counts, base = [0], 0
        for word in self.words.findall(text):
            by_bytes = self.word_counts(word.encode())
            at = 0
            for c in word:
                at += len(c.encode())
                counts.append(base + by_bytes[at])
            if word in ("'re", "'ve", "'ll"):  # cut short, quote and letter are two words
                counts[-2] = base + 2
            base += by_bytes[-1]
        for run in self.space_runs.finditer(text):  # cut here, a run is one word
            by_bytes = self.word_counts(run[0].encode())
            at = 0
            for n, c in enumerate(run[0], run.start() + 1):
                at += len(c.encode())
                counts[n] = counts[run.start()] + by_bytes[at]
        return counts


COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per Python worker and vocabulary."""
    if path not in COUNTERS:
        COUNTERS[path] = PrefixCounter(path)
    return COUNTERS[path]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content")
    )


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``)."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [counter(path).total(t) for t in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    sized = _texts(docs, id_col, text_col).select(
        "doc_id", "content", F.octet_length("content").cast("long").alias("n_bytes")
    )
    return sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def prefix_table(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """(doc_id, prefix_tokens): the count of the prefix of n characters at index n."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                counts = [
                    counter(path).prefix_counts(t) for t in part.column("content").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.list_(pa.int32()))],
                    ["doc_id", "prefix_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, prefix_tokens array<int>"
    )


def tokens_before(prefix_tokens: str | Column, n_chars: int | Column) -> Column:
    """Tokens of the prefix of ``n_chars`` characters, of the whole text if it is shorter."""
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    wanted = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.element_at(counts, F.least(F.size(counts), wanted + 1).cast("int"))


def longest_prefix(prefix_tokens: str | Column, budget: int | Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    fitting = F.transform(counts, lambda c, i: F.when(c <= budget, i))
    return F.array_max(fitting)
