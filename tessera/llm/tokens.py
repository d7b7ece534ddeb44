"""Token counts by prefix dynamic programming over byte-pair encodings.

A sequence of tokens is the encoding of its text exactly if each neighbouring
pair is the encoding of the pair's text. So every prefix of a word has one last
token, and its count is one more than that of the prefix before it. The counts
of all prefixes answer budget and truncation questions without encoding again.

Cases: null and empty texts have no tokens. Special strings in a text are one
token each, as the library's default has it. Repeated rows are counted each on
their own. Null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import texts

#: Words and pairs remembered by a worker in each of two generations, none of them longer than so many characters.
REMEMBERED, LONGEST = 300_000, 64
LIMIT = 2048


class _Memory(dict):
    """A dict that fills itself. When full it starts anew; entries used again come back from the one before."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself if printable, else from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in kept)}
    return [rest.get(b, chr(b)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of every prefix, for a word-end BPE vocabulary file."""

    END = "</w>"
    #: Latin text up to U+024F takes a path of stdlib regexes; letters and numbers there are told apart by these classes.
    LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\t-\r \x85\xa0]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = set(spec["model"]["vocab"])
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(spec["model"]["merges"])}
        self.longest = max(len(v.removesuffix(self.END)) for v in self.vocab)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.symbols = dict(enumerate(byte_symbols()))
        self.pair = _Memory(lambda p: self._merge(p[0] + p[1], len(p[1])) == [len(p[0]), len(p[1].removesuffix(self.END))])
        self.whole = _Memory(lambda t: self._merge(t, len(t)) == [len(t.removesuffix(self.END))])
        self.words = _Memory(self._word)
        self.inside = _Memory(self._inside)

    def _merge(self, text: str, _: int) -> list[int]:
        """Lengths of the tokens after merging by rank, leftmost first; for short texts."""
        end = text.endswith(self.END) and len(text) > len(self.END)
        parts = list(text.removesuffix(self.END) if end else text)
        if end:
            parts[-1] += self.END
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [len(p.removesuffix(self.END)) if k == len(parts) - 1 and end else len(p) for k, p in enumerate(parts)]

    def _inner(self, s: str) -> tuple[list[int], list[str]]:
        """Counts and last tokens of all prefixes of ``s`` taken as inside a word."""
        counts, last = [0], [""]
        vocab, whole, pair = self.vocab, self.whole, self.pair
        for i in range(1, len(s) + 1):
            for j in range(max(0, i - self.longest), i):
                t = s[j:i]
                if t in vocab and whole[t] and (j == 0 or pair[last[j], t]):
                    counts.append(counts[j] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token ends at {i} in {s!r}")
        return counts, last

    def _closed(self, s: str, i: int, counts: list[int], last: list[str]) -> int:
        """Count of the prefix of length ``i`` taken as a whole word."""
        for j in range(max(0, i - self.longest), i):
            t = s[j:i] + self.END
            if t in self.vocab and self.whole[t] and (j == 0 or self.pair[last[j], t]):
                return counts[j] + 1
        raise ValueError(f"no last token at {i} in {s!r}")

    def _word(self, word: str) -> int:
        s = word.encode().decode("latin-1").translate(self.symbols)
        return self._closed(s, len(s), *self._inner(s[:-1]))

    def word_prefixes(self, word: str) -> list[int]:
        """Counts of every prefix of a normalised word, in code points, from 0."""
        s = word.encode().decode("latin-1").translate(self.symbols)
        counts, last = self._inner(s)
        out, at = [0], 0
        for ch in word:
            at += len(ch.encode())
            out.append(self._closed(s, at, counts, last))
        return out

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if max(text) < "ɐ" and unicodedata.is_normalized("NFC", text) and len(low := text.lower()) == len(text):
            return low
        return self.tokenizer.normalizer.normalize_str(text)

    def _split(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """Normalised text and its words' places."""
        low = self._normal(text)
        if low.isascii() or max(low) < "ɐ":
            return low, [m.span() for m in self.LATIN.finditer(low)]
        return low, [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(low)]

    def _parts(self, text: str) -> list[str]:
        """Texts and, at odd places, the special strings between them."""
        return self.special.split(text) if any(x in text for x in self.specials) else [text]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last of its prefix counts."""
        parts = self._parts(text)
        if len(parts) > 1:
            return len(parts) // 2 + sum(map(self.count, parts[::2]))
        low = self._normal(text)
        if low.isascii() or max(low) < "ɐ":
            return sum(map(self.words.__getitem__, self.LATIN.findall(low)))
        return sum(self.words[low[a:b]] for a, b in self._split(low)[1])

    def table(self, text: str) -> tuple[str, list[int]]:
        """The normalised text and the token counts of all its prefixes, in code points, from 0."""
        whole, out = [], [0]
        for k, part in enumerate(self._parts(text)):
            if k % 2:
                # A special string that is cut is ordinary text.
                before = "".join(whole)
                out += [self.count(before + part[:i]) for i in range(1, len(part))] + [out[-1] + 1]
                whole.append(part)
                continue
            low, spans = self._split(part)
            at = 0
            for a, b in spans:
                out += [out[-1]] * (a - at)
                start = out[-1]
                out += (start + n for n in self.inside[low[a:b]][1:])
                at = b
            out += [out[-1]] * (len(low) - at)
            whole.append(low)
        return "".join(whole), out

    def _inside(self, word: str) -> list[int]:
        counts = self.word_prefixes(word)
        if word[0] == "'" and len(word) == 3:  # of a contraction that is cut, the apostrophe is a word of its own
            counts[2] = self.words["'"] + self.words[word[1]]
        return counts

    def prefixes(self, text: str) -> Iterator[tuple[int, int]]:
        """(end in the normalised text, tokens up to there) after each word; text without special strings."""
        total = 0
        low, spans = self._split(text)
        for a, b in spans:
            total += self.words[low[a:b]]
            yield b, total

    def fit(self, text: str, budget: int) -> str:
        """The longest prefix of the normalised text, ending in a word or after one, with at most ``budget`` tokens."""
        low, spans = self._split(text)
        used = 0
        for k, (a, b) in enumerate(spans):
            n = self.words[low[a:b]]
            if used + n > budget:
                inside = self.inside[low[a:b]]
                best = max(i for i, c in enumerate(inside) if used + c <= budget)
                return low[: a + best] if best else low[: spans[k - 1][1] if k else 0]
            used += n
        return low


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker and vocabulary."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row; ``path``: the vocabulary file, readable on every executor."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for batch in batches:
            yield pd.Series([c.count(t) for t in batch], dtype="int64")

    rows = texts(docs, id_col, text_col)
    out = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, normal, counts) per row: the text as the vocabulary normalises it, and the exact number of tokens of each of its prefixes.

    counts[k] is of the first k code points, so it has one entry more than the text. Written as a table, it answers ``tokens_at`` and ``cut_to_budget`` without the tokenizer.
    """

    @F.pandas_udf("normal string, counts array<int>")
    def table(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for batch in batches:
            yield pd.DataFrame([c.table(t) for t in batch], columns=["normal", "counts"])

    return texts(docs, id_col, text_col).select("doc_id", table("text").alias("t")).select("doc_id", "t.normal", "t.counts")


def tokens_at(length: Column | int) -> Column:
    """Of a prefix table's row: tokens of the first ``length`` code points, of the whole text if it is shorter."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.element_at("counts", (F.least(length.cast("int"), F.size("counts") - 1) + 1).cast("int"))


def cut_to_budget(table: DataFrame, budget: int) -> DataFrame:
    """(doc_id, text, n_tokens): the longest prefix of each normalised text that has ``budget`` tokens at most."""
    fits = F.array_max(F.filter(F.transform("counts", lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull()))
    return table.withColumn("_end", fits).select("doc_id", F.substring("normal", F.lit(1), F.col("_end")).alias("text"), tokens_at(F.col("_end")).alias("n_tokens"))
