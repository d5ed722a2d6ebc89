"""Token counts by a linear longest-match automaton.

Greedy word pieces take, from the left, the longest vocabulary entry that fits. The
automaton is a trie of the entries. Each node has a failure link, to the node reached
after the tokens that end surely by then have been popped, and the number of those
tokens. A word is read once, byte by byte; where the trie has no way on, the counts
along the failure links are added. No piece is ever built.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm.bpe import byte_letters, load, vocabulary_path
from labelloom.llm.common import map_texts, query, table

#: Distinct words kept per task with their counts; a full table starts anew.
CACHE_WORDS = 1_000_000
#: Symbol before the first byte of a word.
START = 256


class Automaton:
    """Greedy piece counts of words.

    ``first`` holds the pieces a word may begin with, ``later`` those that may follow,
    both as bytes. The empty piece in ``first`` lets a word begin with a piece of
    ``later`` at the cost of one token, as vocabularies do that have the word mark alone.
    """

    def __init__(self, first: set[bytes], later: set[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.token: list[bool] = [False]
        for piece in later:
            if piece:
                self._add(piece)
        for piece in first:
            self._add((START, *piece))
        n = len(self.next)
        # Node 0 is where a word goes on after whole pieces; its link leads nowhere.
        self.link, self.popped = [-1] * n, [0] * n
        waiting = deque((0, symbol, child) for symbol, child in self.next[0].items())
        while waiting:
            parent, symbol, node = waiting.popleft()
            if self.token[node]:
                self.link[node], self.popped[node] = 0, 1
            elif parent:
                at, count = self.link[parent], self.popped[parent]
                while at >= 0 and symbol not in self.next[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.next[at][symbol], count
            waiting.extend((node, s, child) for s, child in self.next[node].items())

    def _add(self, symbols) -> None:
        node = 0
        for symbol in symbols:
            if symbol not in self.next[node]:
                self.next[node][symbol] = len(self.next)
                self.next.append({})
                self.token.append(False)
            node = self.next[node][symbol]
        self.token[node] = True

    def count(self, word: bytes) -> int:
        """Number of pieces; 0 if the word can't be cut into pieces."""
        following, link, popped = self.next, self.link, self.popped
        node, count = following[0].get(START, -1), 0
        if node < 0:
            return 0
        for symbol in word:
            while symbol not in following[node]:
                if link[node] < 0:
                    return 0
                count += popped[node]
                node = link[node]
            node = following[node][symbol]
        while node:
            if link[node] < 0:
                return 0
            count += popped[node]
            node = link[node]
        return count


class Counts(dict):
    """Counts of words; missing ones are computed."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        count = self.automaton.count(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = count
        return count


def byte_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """First and later pieces of a byte-level vocabulary, which writes a blank before a word into its first piece."""
    blank = byte_letters().index("Ġ")
    tokens = load(path)["tokens"]
    first = {t[1:] for t in tokens if t[0] == blank and blank not in t[1:]}
    return first, {t for t in tokens if blank not in t}


_COUNTS: dict[str, Counts] = {}


def token_counts(
    df: DataFrame, vocabulary: tuple[set[bytes], set[bytes]], name: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Words, pieces, words that can't be cut and the longest word in pieces, for every whole text.

    Words are runs without ASCII white space, as UTF-8 bytes. A word that can't be cut
    counts as one piece. ``name`` tells vocabularies apart. A null text counts as empty;
    repeated rows and null keys stay; other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        counts = _COUNTS.get(name) or _COUNTS.setdefault(name, Counts(Automaton(*shared.value)))
        of = counts.__getitem__

        def count(value: str) -> tuple:
            words = value.encode().split()
            each = list(map(of, words))
            unknown = each.count(0)
            return len(words), sum(each) + unknown, unknown, max(each, default=0)

        return count

    fields = "n_words long, n_tokens long, n_unknown long, most_pieces long"
    return map_texts(df, {key: key}, text, make, fields)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return token_counts(table(spark, sf_dir, "documents"), byte_vocabulary(path), path)
