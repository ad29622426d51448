"""Token counts by prefix dynamic programming over a byte-pair vocabulary with word ends."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import text_of
from gridledger.llm.pretokens import finder

LIMIT = 2048
ROWS = 256
# Entries that a worker remembers, for words and for prefixes and pairs; each memory is emptied beyond.
REMEMBERED_WORDS = 1_000_000
REMEMBERED = 400_000
# Words of more bytes are not remembered; their prefixes are kept by position.
LONG = 256
# Fixed value: the words of the tokenizer file, with {L}, {N}, {S} for its classes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"


@cache
def byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of bytes: themselves if printable in Latin-1, else letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes.

    The encoding of a piece without its last token is the encoding of what is
    left. So the encoding of a prefix ends with the one token t for which the
    pair (last token of what is before t, t) stays apart when merged alone.
    The table therefore holds a count and a last token per prefix, found from
    shorter prefixes; a pair is merged once and its outcome kept.
    """

    def __init__(self, model: dict):
        self.end = model["model"]["end_of_word_suffix"]
        self.vocabulary = model["model"]["vocab"]
        self.ranks = {tuple(m): n for n, m in enumerate(model["model"]["merges"])}
        self.longest = max(map(len, self.vocabulary))
        special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.marks = [t[0] for t in special]
        self.find = finder(WORDS)
        self.letters = byte_letters()
        self.pairs: dict[tuple[str, str, bool], bool] = {}
        self.prefixes: dict[str, tuple[int, str]] = {"": (0, "")}
        self.words: dict[str, int] = _Remembered(self)

    def _merged(self, text: str, ends: bool) -> list[str]:
        parts = list(text)
        if ends:
            parts[-1] += self.end
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, before: str, token: str, ends: bool) -> bool:
        key = (before, token, ends)
        if key not in self.pairs:
            shown = token + self.end if ends else token
            self.pairs[key] = self._merged(before + token, ends) == ([before, shown] if before else [shown])
        return self.pairs[key]

    def _last(self, text: str, ends: bool) -> tuple[int, str]:
        for size in range(min(len(text), self.longest), 0, -1):
            token = text[-size:]
            if (token + self.end if ends else token) in self.vocabulary:
                count, before = self.prefixes[text[:-size]]
                if self._apart(before, token, ends):
                    return count + 1, token
        raise ValueError(f"no token ends {text!r}")

    def _shown(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode()))

    def _known(self, word: str) -> str:
        """The word in byte letters, with an entry for each prefix before its last letter."""
        shown = self._shown(word)
        at = len(shown) - 1
        while at > 0 and shown[:at] not in self.prefixes:
            at -= 1
        for size in range(at + 1, len(shown)):
            self.prefixes[shown[:size]] = self._last(shown[:size], False)
        return shown

    def long_word(self, word: str) -> int:
        """The count of a word of any length, from the count and the last token's length at each position."""
        shown = self._shown(word)
        counts, sizes = array("q", [0]), array("q", [0])
        for stop in range(1, len(shown) + 1):
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            ends = stop == len(shown)
            for size in range(min(stop, self.longest), 0, -1):
                start = stop - size
                token = shown[start:stop]
                if (token + self.end if ends else token) in self.vocabulary and self._apart(
                        shown[start - sizes[start]:start], token, ends):
                    counts.append(counts[start] + 1)
                    sizes.append(size)
                    break
            else:
                raise ValueError(f"no token ends {shown[:stop][-self.longest:]!r}")
        return counts[-1]

    def word(self, word: str) -> int:
        if len(self.prefixes) > REMEMBERED:
            self.prefixes = {"": (0, "")}
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        return self._last(self._known(word), True)[0]

    def normalised(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # Lower case by single characters: no final sigma.
        return text.replace("Σ", "σ").lower()

    def _segments(self, text: str) -> list[str]:
        """Text between special strings and those strings, in turn."""
        return self.special.split(text) if any(m in text for m in self.marks) else [text]

    def count(self, text: str) -> int:
        segments = self._segments(text)
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        total = len(segments) // 2
        for segment in segments[::2]:
            total += sum(map(self.words.__getitem__, self.find(self.normalised(segment))))
        return total

    def prefix_counts(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of words in code points of the normalised text, and the token count of each such prefix."""
        ends, counts, at, total = [], [], 0, 0
        for i, segment in enumerate(self._segments(text)):
            if i % 2:
                at, total = at + len(segment), total + 1
                ends.append(at)
                counts.append(total)
                continue
            segment, place = self.normalised(segment), 0
            for word in self.find(segment):
                place = segment.index(word, place) + len(word)
                total += self.words[word]
                ends.append(at + place)
                counts.append(total)
            at += len(segment)
        return ends, counts

    def inside(self, word: str) -> list[int]:
        """The token count of each prefix of a word, as a text of its own."""
        return [self.words[word[:i]] for i in range(1, len(word) + 1)]


class _Remembered(dict):
    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(word.encode()) > LONG:
            return self.counter.long_word(word)
        self[word] = found = self.counter.word(word)
        return found


_COUNTERS: dict[str, PrefixCounter] = {}


def counter_of(model: str) -> PrefixCounter:
    """One counter per worker and vocabulary, so that what it learned serves later tasks."""
    name = str(hash(model))
    if name not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[name] = PrefixCounter(json.loads(model))
    return _COUNTERS[name]


def _vocabulary(docs: DataFrame, path: str | None):
    """The tokenizer file, read by the driver and sent to each executor once."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.
    Special strings of the vocabulary inside a text are one token each. A null
    text counts as empty and has no tokens. Each row gives one row.
    """
    model = _vocabulary(docs, path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                tokens = [counter.count(text) for text in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def token_prefixes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored table of prefixes: ``doc_id, text`` (normalised), ``ends, counts``.

    ``counts[i]`` is the exact number of tokens of the normalised text up to
    code point ``ends[i]``, an end of a word or special string. ``fit`` and
    ``tokens_before`` answer from it without encoding again.
    """
    model = _vocabulary(docs, path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                tables = [counter.prefix_counts(text) for text in texts]
                normal = ["".join(s if i % 2 else counter.normalised(s) for i, s in enumerate(counter._segments(t)))
                          for t in texts]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(normal, pa.string()), pa.array([t[0] for t in tables], ints),
                    pa.array([t[1] for t in tables], ints)], ["doc_id", "text", "ends", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(listed, "doc_id long, text string, ends array<int>, counts array<int>")


def fit(prefixes: DataFrame, budget: int) -> DataFrame:
    """Longest prefix of whole words with at most ``budget`` tokens: adds ``n_fit`` and ``text_fit``."""
    within = F.filter("counts", lambda n: n <= budget)
    end = F.when(F.size(within) > 0, F.element_at("ends", F.greatest(F.size(within), F.lit(1)))).otherwise(0)
    rows = prefixes.withColumn("n_fit", F.coalesce(F.array_max(within), F.lit(0)))
    return rows.withColumn("text_fit", F.substring("text", F.lit(1), end))


def tokens_before(prefixes: DataFrame, chars: int) -> DataFrame:
    """Tokens of the whole words within the first ``chars`` code points: adds ``n_before``."""
    words = F.size(F.filter("ends", lambda e: e <= chars))
    return prefixes.withColumn("n_before", F.when(words > 0, F.element_at("counts", F.greatest(words, F.lit(1)))).otherwise(0))
