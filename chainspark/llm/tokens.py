"""Token counts of a byte-pair vocabulary with word ends, by rank-synchronous array merging."""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from chainspark.llm.text import map_arrow

#: Distinct pre-tokens whose counts a worker keeps; beyond it the table starts anew.
CACHE = 1_000_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class BytePairCounter:
    """Counts the tokens of texts under a tokenizer file (normaliser, split pattern, merges).

    Files with a lower-casing NFC normaliser, a split pattern and byte-level word-end merges are
    understood; anything else is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed":
            raise ValueError("unsupported tokenizer file")
        # the library's \s is the White_Space property; in text that has been normalised it is the same set
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        self.base = len(vocab) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        codes = left * self.base + right
        order = np.argsort(codes, kind="stable")
        keep = np.ones(len(order), bool)
        keep[:-1] = codes[order][1:] != codes[order][:-1]  # of equal pairs the later line counts
        order = order[keep]
        self.codes, self.rank, self.made = codes[order], order, made[order]
        # all places of a pair may merge at once unless what it makes can merge at a lower rank
        lowest = np.full(self.base, len(pairs))
        np.minimum.at(lowest, left[order], order)
        np.minimum.at(lowest, right[order], order)
        self.at_once = lowest[self.made] > self.rank
        self.known: dict[str, int] = {}

    def merged_lengths(self, words: list[str]) -> np.ndarray:
        """Symbols that are left of each pre-token after all merges.

        The symbols of all words are one array. In every round each word applies its lowest-ranked
        pair; words that have no pair leave the array.
        """
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        out = size.copy()
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self.final[flat[ends]]
        word = np.repeat(np.arange(len(raw)), size)
        none = len(self.codes)
        while len(sym) > 1:
            code = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.codes, code), none - 1)
            found = (self.codes[at] == code) & (word[:-1] == word[1:])
            rank = np.append(np.where(found, self.rank[at], none), none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            per = np.repeat(best, np.diff(np.append(first, len(sym))))
            hit = np.flatnonzero((rank == per) & (rank < none))
            if not len(hit):
                break
            # leftmost first: of places in a row (a pair of equal symbols) every second one
            run = np.append(True, np.diff(hit) > 1)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - begin) % 2 == 0
            w = word[hit]
            leftmost = np.append(True, w[1:] != w[:-1])
            take &= self.at_once[at[hit]] | leftmost
            hit = hit[take]
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            out -= np.bincount(word[hit], minlength=len(out))
            alive = np.zeros(len(out), bool)
            alive[word[hit]] = True
            keep &= alive[word]
            sym, word = sym[keep], word[keep]
        return out

    def _pieces(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        low = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self.pattern.findall(low)

    def counts(self, texts: list[str | None]) -> list[int]:
        pieces, extra = [], []
        for text in texts:
            text, n = text or "", 0
            if self.special is not None and "<|" in text:
                parts = self.special.split(text)
                n = len(parts) - 1
                pieces.append([p for part in parts for p in self._pieces(part)])
            else:
                pieces.append(self._pieces(text))
            extra.append(n)
        if len(self.known) > CACHE:
            self.known = {}
        new = list(set(chain.from_iterable(pieces)) - self.known.keys())
        if new:
            self.known.update(zip(new, self.merged_lengths(new).tolist()))
        get = self.known.__getitem__
        return [n + sum(map(get, own)) for own, n in zip(pieces, extra)]


_counters: dict[str, BytePairCounter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every document (doc_id, text).

    ``vocabulary`` is the path of a tokenizer file that every executor has, as an installed
    package gives it; a worker reads it once. Special strings inside a text count as one token
    each, none are added. Null and empty texts have 0 bytes and 0 tokens; null ids and repeated
    rows are counted like all others; other columns are not read.
    """
    def run(batch):
        if vocabulary not in _counters:
            _counters[vocabulary] = BytePairCounter(vocabulary)
        counter = _counters[vocabulary]
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            n = pa.array(counter.counts(part.column("text").to_pylist()), pa.int64())
            size = pa.compute.fill_null(pa.compute.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), size, n, pa.compute.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run,
                     f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
