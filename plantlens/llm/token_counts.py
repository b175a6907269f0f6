"""Greedy longest-match piece counts by a linear automaton: a vocabulary trie with failure links and popped-token counts.

At a node that cannot be extended, the failure link leads to the node of the rest after the pieces that greedy longest
match takes from what the node spells; only how many pieces that pops is kept, so no piece is ever built.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spaced_words

#: Words whose counts a Python worker remembers; beyond it, the memory starts anew.
MEMO_WORDS = 500_000
#: Ends each word and each word-final piece; no word holds it, since words hold no white space.
END = b"\n"
COUNTS = "n_words long, n_tokens long, n_unknown long"


class LongestMatch:
    def __init__(self, pieces: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in filter(None, pieces):
            node = 0
            for c in piece:
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    whole.append(False)
            whole[node] = True
        #: The link of a node, -1 where greedy match of what it spells gets stuck; and the pieces popped on the way.
        self.link, self.pops = [-1] * len(whole), [0] * len(whole)
        queue = deque((0, c, child) for c, child in self.next[0].items())
        while queue:
            parent, c, node = queue.popleft()
            if whole[node]:
                self.link[node], self.pops[node] = 0, 1
            else:
                at, pops = self.link[parent], self.pops[parent]
                while at >= 0 and c not in self.next[at]:
                    pops += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.pops[node] = self.next[at][c], pops
            queue.extend((node, d, child) for d, child in self.next[node].items())

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest match over word and END, in time linear in the word; 0: some place starts no piece."""
        node = total = 0
        for c in word + END:
            while (to := self.next[node].get(c)) is None:
                if self.link[node] < 0:
                    return 0
                total += self.pops[node]
                node = self.link[node]
            node = to
        while node:
            if self.link[node] < 0:
                return 0
            total += self.pops[node]
            node = self.link[node]
        return total


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 as it is, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def read_pieces(path: str, end: str = "</w>") -> list[bytes]:
    """The pieces of a byte-level vocabulary file of the tokenizers library, as bytes; END stands for `end`."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"] for t in file.get("added_tokens", [])}
    letters = byte_letters()
    out = []
    for piece in file["model"]["vocab"]:
        if piece not in special:
            body = piece.removesuffix(end)
            out.append(bytes(letters[c] for c in body) + (END if piece != body else b""))
    return out


#: The automaton that this Python worker built last and the counts it remembers, by the name of its broadcast.
_built: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def built(name: str, pieces: list[bytes]) -> tuple[LongestMatch, dict[bytes, int]]:
    if name not in _built:
        _built.clear()
        _built[name] = LongestMatch(pieces), {}
    return _built[name]


def count_tokens(docs: DataFrame, pieces: list[bytes], text: str = "text", into: str = "tokens", memo_words: int = MEMO_WORDS) -> DataFrame:
    """docs with a struct column `into`: n_words, n_tokens, n_unknown.

    Words are what ASCII white space separates, A-Z lower-cased. A word that greedy longest match cannot cover is one
    unknown piece. Null and empty texts have no words; repeated rows count alike; very long texts are counted whole; an empty
    table stays empty; other columns pass through (one named `into` is replaced). The vocabulary's size is that of its file, which bounds the broadcast.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    @F.pandas_udf(COUNTS)
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        match, memo = built(name, shared.value)
        for texts in batches:
            rows = []
            for t in texts:
                words = spaced_words(t)
                if len(memo) > memo_words:
                    memo.clear()
                for w in set(words).difference(memo):
                    memo[w] = match.count(w)
                each = [memo[w] for w in words]
                unknown = each.count(0)
                rows.append((len(words), sum(each) + unknown, unknown))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])

    return docs.withColumn(into, counts(F.col(text)))


def report(docs: DataFrame, pieces: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return count_tokens(slim, pieces).select("doc_id", "tokens.n_words", "tokens.n_tokens", "tokens.n_unknown")
