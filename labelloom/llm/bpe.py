"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The encoder needs no merge loop. One Aho-Corasick pass over a piece finds the longest
token that starts at each byte. From the left it takes the longest token whose
boundary with the token before is one that merging would keep; a pair-compatibility
table, built from the merges, tells that for two neighbouring tokens. If no token
fits, the last one is taken back, its end is marked as a dead end and a shorter one
is tried. A dead end is marked once, so the work is linear in the piece, and the
result is the sequence of the merge rules.

Decoding concatenates slices of one byte string that holds all tokens, found by an
offset table, for a whole text at once.
"""

from __future__ import annotations

import json
import re
from array import array

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import map_texts, query, sha256, table

#: White space as the split pattern of the vocabulary means it (Unicode White_Space).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The published split pattern of byte-level vocabularies, with white space spelt out (a fixed value).
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: The same cuts at white space only; no piece of the pattern crosses one of these.
UNITS = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Pieces kept per task with their ids, and the longest piece kept; a full table starts anew.
CACHE_PIECES, CACHE_LENGTH = 1_000_000, 48


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


def load(path: str) -> dict:
    """Tokens as bytes, merges and special tokens of a byte-level vocabulary file; read on the driver."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    back = {letter: b for b, letter in enumerate(byte_letters())}
    tokens = {bytes(back[c] for c in t): i for t, i in content["model"]["vocab"].items()}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"])
    merges = [tuple(bytes(back[c] for c in part) for part in pair) for pair in pairs]
    special = {t["content"]: t["id"] for t in content.get("added_tokens", ())}
    return {"tokens": tokens, "merges": merges, "special": special}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.tokens, self.special = vocabulary["tokens"], vocabulary["special"]
        size = 1 + max([*self.tokens.values(), *self.special.values()])
        # Work numbers: single bytes, then merged tokens in the order of the merges.
        order = [bytes([b]) for b in range(256)]
        number = {t: n for n, t in enumerate(order)}
        self.parts = [(n, n) for n in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        for left, right in vocabulary["merges"]:
            whole = left + right
            if whole not in number:
                number[whole] = len(order)
                order.append(whole)
                self.parts.append((number[left], number[right]))
            self.pair.setdefault((number[left], number[right]), number[whole])
        self.size = [len(t) for t in order]
        self.id = [self.tokens[t] for t in order]
        self.automaton = ahocorasick.Automaton()
        for n, token in enumerate(order):
            self.automaton.add_word(token.decode("latin-1"), n)
        self.automaton.make_automaton()
        # The longest token that is a proper beginning of each token.
        self.shorter = [-1] * len(order)
        for n, token in enumerate(order):
            for k in range(len(token) - 1, 0, -1):
                if (found := number.get(token[:k])) is not None:
                    self.shorter[n] = found
                    break
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.split = regex.compile(SPLIT)
        self.control = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # Decoding: one byte string and where each id's bytes lie in it.
        self.start, self.length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        blob = bytearray()
        for token, i in [*self.tokens.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.start[i], self.length[i] = len(blob), len(token)
            blob += token
        self.blob = np.frombuffer(bytes(blob), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the boundary between two tokens alone.

        Undoes the later merge of the two at the boundary again and again; a merge
        across the boundary that comes before the one undone would have happened.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, before, result = left, right, len(self.size), True
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < before:
                result = False
                break
            # On a tie the left one is later: the same merge works from the left.
            split_left = a > b
            if max(a, b) < 256:
                break
            if split_left:
                before, a = a, self.parts[a][1]
            else:
                before, b = b + 1, self.parts[b][0]
        if len(self.fits) < CACHE_PIECES:
            self.fits[left, right] = result
        return result

    def numbers(self, piece: bytes) -> list[int]:
        """Work numbers of the tokens of a piece."""
        n = len(piece)
        longest = [-1] * n
        size, shorter, compatible = self.size, self.shorter, self.compatible
        best = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            at = end - size[token] + 1
            if size[token] > best[at]:
                best[at], longest[at] = size[token], token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not dead[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def piece_ids(self, unit: str) -> bytes:
        """Ids of a run without inner white space, as bytes of 32-bit integers; short ones are kept."""
        id_of = self.id
        out = array("i", [id_of[x] for piece in self.split.findall(unit) for x in self.numbers(piece.encode())]).tobytes()
        if len(unit) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[unit] = out
        return out

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of special tokens in it become their ids."""
        known, new, out, at = self.cache.get, self.piece_ids, [], 0
        for found in [*(self.control.finditer(text) if self.control else ()), None]:
            units = UNITS.findall(text, at, found.start() if found else len(text))
            out.extend([known(unit) or new(unit) for unit in units])
            if found:
                out.append(array("i", [self.special[found.group()]]).tobytes())
                at = found.end()
        return np.frombuffer(b"".join(out), np.int32)

    def text(self, ids: np.ndarray) -> str:
        """Text of ids; broken UTF-8 is replaced."""
        ids = np.asarray(ids, np.int64)
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        where = np.repeat(self.start[ids] - ends + lengths, lengths)
        where += np.arange(len(where))
        return self.blob[where].tobytes().decode("utf-8", "replace")


#: One codec per vocabulary in each Python worker.
_CODECS: dict[str, Codec] = {}


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ids of every text. A null text counts as empty and has no ids; repeated rows stay."""
    shared, name = df.sparkSession.sparkContext.broadcast(load(path)), path

    def make():
        codec = _CODECS.get(name) or _CODECS.setdefault(name, Codec(shared.value))
        return lambda value: (codec.ids(value),)

    return map_texts(df, {key: key}, text, make, "ids array<int>")


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ids of every text and the text decoded from those ids, in one pass.

    A null text counts as empty: no ids, empty decoded text. Repeated rows and null
    keys stay; other columns are left out.
    """
    shared, name = df.sparkSession.sparkContext.broadcast(load(path)), path

    def make():
        codec = _CODECS.get(name) or _CODECS.setdefault(name, Codec(shared.value))

        def both(value: str) -> tuple:
            ids = codec.ids(value)
            return ids, codec.text(ids)

        return both

    return map_texts(df, {key: key}, text, make, "ids array<int>, decoded string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digests(coded: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Digest columns of ``encode_decode``, and the columns named in ``keep``."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(ids).alias("ids_sha256"),
        sha256("decoded").alias("decoded_sha256"),
        *keep,
    )


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), vocabulary_path()))
