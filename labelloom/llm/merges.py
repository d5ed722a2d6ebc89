"""Encoding and decoding with merge-type piece vocabularies by a score-ordered agenda.

A text becomes a chain of characters. Every adjacent pair whose union is a piece lies in
an agenda ordered by score, then place; the best is merged, its new neighbours are
entered, and entries whose sides have changed since are passed over. Characters that
are no piece fall back to bytes. Where no piece goes across the beginning of a run of
word marks, the runs are worked on one by one and kept; within a run the same holds
between two characters that no piece has side by side.

Decoding takes slices of one byte string that holds all pieces, found by an offset table.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from labelloom.llm.bpe import digests, vocabulary_path
from labelloom.llm.common import map_texts, query, table

#: The word mark that stands for a blank.
MARK = "▁"
#: Runs, and parts of runs, kept per task with their ids, and the longest kept; a full table starts anew.
CACHE_RUNS, CACHE_LENGTH = 1_000_000, 48
#: Up to this length a plain list serves as the agenda, beyond it a heap.
SHORT = 32
#: Entries of the heap are one number: rank of the score, place of the left symbol, length of the pair.
_BITS = 32
_MASK = (1 << _BITS) - 1
#: Numbers of the published model format: kinds of pieces, the merge-type algorithm.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
MERGES = 2


def _fields(message: bytes):
    """(number, value) of the fields of a message in the published wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            part = message[at]
            at += 1
            value |= (part & 127) << shift
            shift += 7
            if part < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, message[at : at + size]
        at += size


@dataclass
class Pieces:
    """A vocabulary: pieces with scores and kinds by id, and how texts are prepared."""

    pieces: list[tuple[str, float, int]]
    dummy_prefix: bool = True
    squeeze: bool = True
    byte_fallback: bool = False
    unknown_surface: str = " ⁇ "
    #: The file itself, for the check against the library.
    file: bytes = b""


def read_pieces(path: str) -> Pieces:
    """Read a model file; on the driver. Only merge-type models without a character map and unused pieces are taken."""
    with open(path, "rb") as file:
        content = file.read()
    out = Pieces([], file=content)
    algorithm, charmap = None, b""
    for number, value in _fields(content):
        if number == 1:
            entry = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            out.pieces.append((entry[1].decode(), struct.unpack("<f", entry[2])[0], entry[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            algorithm = trainer.get(3)
            out.byte_fallback = bool(trainer.get(35, 0))
            out.unknown_surface = trainer[44].decode() if 44 in trainer else out.unknown_surface
            if trainer.get(24):
                raise ValueError("word marks behind words are not supported")
        elif number == 3:
            normal = dict(_fields(value))
            charmap = normal.get(2, b"")
            out.dummy_prefix, out.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
            if not normal.get(5, 1):
                raise ValueError("blanks without word marks are not supported")
    if algorithm != MERGES:
        raise ValueError("not a merge-type model")
    if charmap:
        raise ValueError("models with a character map are not supported")
    if any(kind == UNUSED for _, _, kind in out.pieces):
        raise ValueError("models with unused pieces are not supported")
    return out


def _each_byte(error: UnicodeError):
    if not isinstance(error, UnicodeDecodeError):
        raise error
    return "�" * (error.end - error.start), error.end


codecs.register_error("labelloom.each_byte", _each_byte)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Pieces):
        self.vocabulary = vocabulary
        self.known: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.byte: dict[int, int] = {}
        self.unknown = 0
        own: list[str] = []
        size = len(vocabulary.pieces)
        self.start, self.length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.marked = np.zeros(size, bool)
        blob = bytearray()
        for i, (piece, score, kind) in enumerate(vocabulary.pieces):
            if kind == BYTE:
                value = int(piece[3:5], 16)
                self.byte[value] = i
                surface = bytes([value])
            elif kind == CONTROL:
                surface = b""
            elif kind == UNKNOWN:
                self.unknown, surface = i, vocabulary.unknown_surface.encode()
            else:
                self.known.setdefault(piece, i)
                scores.setdefault(piece, score)
                surface = piece.replace(MARK, " ").encode()
                self.marked[i] = piece.startswith(MARK)
                own += [piece] if kind == USER else []
            self.start[i], self.length[i] = len(blob), len(surface)
            blob += surface
        self.blob = np.frombuffer(bytes(blob), np.uint8)
        # Equal scores have one rank, so that the place decides.
        ranks = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: ranks[score] for piece, score in scores.items() if len(piece) > 1}
        self.none = len(ranks)
        self.beside = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        # Symbols of the user stand as they are and are never merged.
        self.whole = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own else None
        across = any(MARK in piece.lstrip(MARK) for piece in self.known) or bool(own)
        self.runs = re.compile(r"(?s).+" if across else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cache: dict[str, bytes] = {}
        #: Runs worked on since the last look, where somebody looks.
        self.fresh: list[str] | None = None

    def prepared(self, text: str) -> str:
        """The text as it is cut: word marks for blanks, one more in front."""
        if self.vocabulary.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.vocabulary.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK)

    def merged(self, run: str) -> list[str]:
        """The pieces of a run without symbols of the user: best adjacent pairs first, from the left where scores tie."""
        if len(run) <= SHORT:
            return self._merged_short(run)
        symbols, rank, n = list(run), self.rank, len(run)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [r << 2 * _BITS | i << _BITS | 2 for i in range(n - 1) if (r := rank.get(run[i : i + 2])) is not None]
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            entry = pop(agenda)
            at = entry >> _BITS & _MASK
            left, next_at = symbols[at], after[at]
            # A side that has gone is empty, one that has grown makes the pair longer.
            if not left or next_at == n or len(left) + len(symbols[next_at]) != entry & _MASK:
                continue
            left += symbols[next_at]
            symbols[at], symbols[next_at] = left, ""
            ahead, behind = after[next_at], before[at]
            after[at] = ahead
            if ahead < n:
                before[ahead] = at
                right = symbols[ahead]
                if (r := rank.get(left + right)) is not None:
                    push(agenda, r << 2 * _BITS | at << _BITS | len(left) + len(right))
            if behind >= 0:
                right = symbols[behind]
                if (r := rank.get(right + left)) is not None:
                    push(agenda, r << 2 * _BITS | behind << _BITS | len(left) + len(right))
        return [s for s in symbols if s]

    def _merged_short(self, run: str) -> list[str]:
        """The same with the agenda as a list: the rank of every adjacent pair, in the order of the places."""
        symbols, rank, none = list(run), self.rank, self.none
        agenda = [rank.get(run[i : i + 2], none) for i in range(len(run) - 1)]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            at = agenda.index(best)
            del agenda[at]
            symbols[at] += symbols.pop(at + 1)
            if at < len(agenda):
                agenda[at] = rank.get(symbols[at] + symbols[at + 1], none)
            if at:
                agenda[at - 1] = rank.get(symbols[at - 1] + symbols[at], none)
        return symbols

    def _keep(self, run: str, ids: bytes) -> bytes:
        if len(run) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_RUNS:
                self.cache.clear()
            self.cache[run] = ids
        return ids

    def _part_ids(self, part: str) -> bytes:
        """Ids of a part whose neighbours no merge reaches."""
        known, ids = self.known, array("i")
        for piece in self.merged(part):
            if (found := known.get(piece)) is not None:
                ids.append(found)
            elif self.vocabulary.byte_fallback:
                ids.extend([self.byte[b] for b in piece.encode()])
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def _chain_ids(self, run: str) -> bytes:
        """Ids of a run without symbols of the user, part by part."""
        beside, kept = self.beside, self.cache.get
        ends = [i + 1 for i in range(len(run) - 1) if run[i : i + 2] not in beside]
        if not ends:
            return self._part_ids(run)
        parts = [run[i:j] for i, j in zip([0, *ends], [*ends, len(run)])]
        return b"".join([kept(part) or self._keep(part, self._part_ids(part)) for part in parts])

    def run_ids(self, run: str) -> bytes:
        """Ids of a run, as bytes of 32-bit integers; short runs are kept."""
        if self.fresh is not None:
            self.fresh.append(run)
        if self.whole is None:
            return self._keep(run, self._chain_ids(run))
        out, at = [], 0
        for found in self.whole.finditer(run):
            if found.start() > at:
                out.append(self._chain_ids(run[at : found.start()]))
            out.append(array("i", [self.known[found.group()]]).tobytes())
            at = found.end()
        if at < len(run):
            out.append(self._chain_ids(run[at:]))
        return self._keep(run, b"".join(out))

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        kept, new = self.cache.get, self.run_ids
        out = np.frombuffer(b"".join([kept(run) or new(run) for run in self.runs.findall(self.prepared(text))]), np.int32)
        if not self.vocabulary.byte_fallback:
            # Neighbouring unknown characters are one.
            again = np.zeros(len(out), bool)
            again[1:] = (out[1:] == self.unknown) & (out[:-1] == self.unknown)
            out = out[~again]
        return out

    def text(self, ids: np.ndarray) -> str:
        """Text of ids without the blank put in front; every byte of broken UTF-8 is replaced."""
        ids = np.asarray(ids, np.int64)
        lengths = self.length[ids]
        shown = lengths > 0
        if not shown.all():
            # Ids without text part the bytes on their two sides.
            places = np.flatnonzero(~shown)
            parts = [part[part_shown] for part, part_shown in zip(np.split(ids, places), np.split(shown, places))]
        else:
            parts = [ids]
        out, first = [], True
        for part in parts:
            if len(part):
                out.append(self._decoded(part, first))
                first = False
        return "".join(out)

    def _decoded(self, ids: np.ndarray, first: bool) -> str:
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        where = np.repeat(self.start[ids] - ends + lengths, lengths)
        where += np.arange(len(where))
        found = self.blob[where].tobytes()
        if first and self.marked[ids[0]] and (self.vocabulary.dummy_prefix or self.vocabulary.squeeze):
            found = found.lstrip(b" ") if self.vocabulary.squeeze else found[1:]
        try:
            return found.decode()
        except UnicodeDecodeError:
            return found.decode("utf-8", "labelloom.each_byte")


#: One codec per vocabulary in each Python worker.
_CODECS: dict[str, Codec] = {}


def codec(name: str, vocabulary: Pieces) -> Codec:
    """The worker's codec of a vocabulary; ``name`` tells vocabularies apart."""
    return _CODECS.get(name) or _CODECS.setdefault(name, Codec(vocabulary))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ids of every whole text.

    A null text counts as empty and has no ids; repeated rows and null keys stay, other
    columns are left out, an empty table gives an empty one. Equal scores merge from the left.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_pieces(path))

    def make():
        own = codec(path, shared.value)
        return lambda value: (own.ids(value),)

    return map_texts(df, {key: key}, text, make, "ids array<int>")


class Checked:
    """The codec beside the library: ids and text of a text, and whether the library gives the same.

    ``texts`` compares whole texts. ``runs`` compares every run that is worked on, which is
    every distinct run of a task's texts at least once; since no piece goes across the
    beginning of a run, the ids of a text are those of its runs.
    """

    def __init__(self, own: Codec, check: str | None):
        if check not in (None, "texts", "runs"):
            raise ValueError(f"unknown check {check!r}")
        self.own, self.check, self.wrong = own, check, set()
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=own.vocabulary.file)

    def __call__(self, value: str) -> tuple[np.ndarray, str, bool | None]:
        own = self.own
        own.fresh = [] if self.check == "runs" else None
        ids = own.ids(value)
        fresh, own.fresh = own.fresh, None
        decoded = own.text(ids)
        if self.check is None:
            return ids, decoded, None
        if self.check == "texts":
            expected = self.library.encode(value)
            return ids, decoded, ids.tolist() == expected and decoded == self.library.decode(expected)
        # What is new in a text is a text too: its runs one after the other. Only where that differs are they told apart.
        if fresh and not self.same("".join(fresh), self._ids(fresh)):
            self.wrong.update(run for run in fresh if not self.same(run, self._ids([run])))
        return ids, decoded, not self.wrong or self.wrong.isdisjoint(own.runs.findall(own.prepared(value)))

    def _ids(self, runs: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join([self.own.cache.get(run) or self.own.run_ids(run) for run in runs]), np.int32)

    def same(self, run: str, ids: np.ndarray) -> bool:
        """Whether the library has these ids for prepared text; the word mark in front is the one it sets itself."""
        text = run[int(self.own.vocabulary.dummy_prefix) :].replace(MARK, " ")
        # A mark alone, as behind a blank at the end, is no text of its own.
        expected = self.library.encode(text) if text else [self.library.piece_to_id(run)]
        return ids.tolist() == expected and self.own.text(ids) == self.library.decode(expected)


_CHECKED: dict[tuple[str, str | None], Checked] = {}


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", check: str | None = "runs") -> DataFrame:
    """Key, ids, the text decoded from them, and whether the sentencepiece library agrees.

    The library runs beside the agenda on the same Arrow batches, see ``Checked``; ``agrees``
    is null without ``check``. Nulls, repeated rows, other columns and empty tables as in ``encode``.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_pieces(path))

    def make():
        name = (path, check)
        return _CHECKED.get(name) or _CHECKED.setdefault(name, Checked(Codec(shared.value), check))

    return map_texts(df, {key: key}, text, make, "ids array<int>, decoded string, agrees boolean")


@query("op12_pieces")
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
    return digests(coded, keep=("agrees",))
