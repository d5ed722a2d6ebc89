"""Personal data: base patterns and a linear-chain conditional random field.

The base patterns are exact. The random field adds what they miss, such as telephone
numbers without a plus sign. It labels white-space tokens by features of their shape
and of their neighbours, is trained by gradient ascent on the conditional likelihood of
a small labelled table, and decodes many token runs at a time by Viterbi in numpy.

Only tokens with a digit or an at sign may bear a label. All other tokens are outside
for certain, which cuts a text into short independent runs without changing the best
labelling of the whole text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import BLANK, joined_spans, map_texts, query, sha256, table

KINDS = ("email", "ip", "card", "phone")

#: Base patterns (fixed values). Possessive forms match the same and never run back.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their at signs."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def _bare(part: str) -> str:
    return part.lstrip("0")


def ips(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while (digits := _DIGITS.search(text, at)) is not None:
        at = digits.end()
        if text.startswith(".", at) and (found := _IP.match(text, digits.start())) is not None:
            at = found.end()
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in map(_bare, found.group().split("."))):
                out.append(found.span())
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGITS.search(text) is None:
        return out
    out += [(s, 1, e) for s, e in ips(text)]
    for m in _CARD.finditer(text):
        digits = _only_digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_only_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


# --- the random field --------------------------------------------------------------

#: Label 0 is outside; 1 + 2 k begins kind k and 2 + 2 k continues it.
N_LABELS = 1 + 2 * len(KINDS)
N_FEATURES = 1 << 12
_ACTIVE = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(rf"[^{BLANK}]*+")
_EDGE = "\"'`,;:!?.*#$%&|<>[]{}"


def runs(text: str) -> list[tuple[str, list[tuple[int, int]], str]]:
    """Runs of neighbouring tokens with a digit or an at sign, each with the words before and after."""
    out, at, n = [], 0, len(text)
    run: list[tuple[int, int]] = []
    while True:
        m = _ACTIVE.search(text, at)
        if m is None:
            break
        start = m.start()
        while start > at and text[start - 1] not in BLANK:
            start -= 1
        end = _TOKEN_END.match(text, m.end()).end()
        if run and text[run[-1][1] : start].strip(BLANK) == "":
            run.append((start, end))
        else:
            if run:
                out.append(_with_context(text, run, n))
            run = [(start, end)]
        at = end
    if run:
        out.append(_with_context(text, run, n))
    return out


def _with_context(text: str, run: list[tuple[int, int]], n: int) -> tuple[str, list[tuple[int, int]], str]:
    before = text[max(0, run[0][0] - 40) : run[0][0]].split()
    after = text[run[-1][1] : min(n, run[-1][1] + 40)].split()
    return (before[-1] if before else ""), run, (after[0] if after else "")


def shape(token: str) -> str:
    """Letters as X or x, runs joined; digits as d with the length of the run; other signs as they are."""
    short = _DIGITS.sub(lambda m: "d" + str(min(len(m.group()), 12)), token[:60])
    return re.sub(r"[A-Z]+", "X", re.sub(r"[a-ce-z]+", "x", short))[:24]


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % N_FEATURES


_TOKEN_FEATURES: dict[str, list[int]] = {}


def token_features(token: str) -> list[int]:
    """Feature numbers of one token, without its neighbours."""
    known = _TOKEN_FEATURES.get(token)
    if known is not None:
        return known
    core = token.strip(_EDGE)
    digits = _only_digits(core)
    parts = core.split(".")
    names = [
        "bias",
        "shape=" + shape(core),
        "digits=" + str(min(len(digits), 20)),
        "at=" + str(core.count("@") if core.count("@") < 2 else 2) + str("." in core.rpartition("@")[2]),
        "plus=" + str(core.startswith("+")) + str(core.startswith("(")) + str("(" in core),
        "signs=" + "".join(sorted({c for c in core if c in "-./@():+_%=&$#"})),
        "luhn=" + str(13 <= len(digits) <= 19 and luhn(digits)),
        "ip=" + str(len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)),
        "letters=" + str(any(c.isalpha() for c in core)),
        "end=" + token[-1:],
    ]
    out = [_number(x) for x in names]
    if len(token) <= 40:
        if len(_TOKEN_FEATURES) >= 200_000:
            _TOKEN_FEATURES.clear()
        _TOKEN_FEATURES[token] = out
    return out


def run_features(before: str, tokens: list[str], after: str) -> list[list[int]]:
    """Feature numbers of every token of a run."""
    cores = [t.strip(_EDGE) for t in tokens]
    out = []
    for k, token in enumerate(tokens):
        left = shape(cores[k - 1]) if k else "w=" + before.strip(_EDGE).lower()[:20]
        right = shape(cores[k + 1]) if k + 1 < len(tokens) else "w=" + after.strip(_EDGE).lower()[:20]
        out.append([*token_features(token), _number("left=" + left), _number("right=" + right), _number(f"run={min(len(tokens), 6)}/{min(k, 3)}")])
    return out


def _allowed() -> np.ndarray:
    """Scores of transitions that may not be: a continuation needs its beginning; row N_LABELS is the start."""
    out = np.zeros((N_LABELS + 1, N_LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e9
        out[inside - 1, inside] = out[inside, inside] = 0
    return out


class Field:
    """Weights of the random field."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return self.emit[np.array(features)].sum(axis=1)

    def decode(self, many: list[list[list[int]]]) -> list[np.ndarray]:
        """Best labels of many runs; runs of like length are decoded together."""
        out: list[np.ndarray | None] = [None] * len(many)
        order = sorted(range(len(many)), key=lambda k: len(many[k]))
        move = self.move + _allowed()
        at = 0
        while at < len(order):
            longest, to = len(many[order[at]]), at
            while to < len(order) and to - at < 4096 and len(many[order[to]]) == longest:
                to += 1
            group = order[at:to]
            emitted = self.emit[np.array([many[k] for k in group])].sum(axis=2)  # runs x tokens x labels
            best = emitted[:, 0] + move[N_LABELS]
            back = np.zeros((longest, len(group), N_LABELS), np.int8)
            for t in range(1, longest):
                ways = best[:, :, None] + move[None, :N_LABELS]
                back[t] = ways.argmax(axis=1)
                best = ways.max(axis=1) + emitted[:, t]
            labels = np.zeros((len(group), longest), np.int8)
            labels[:, -1] = best.argmax(axis=1)
            rows = np.arange(len(group))
            for t in range(longest - 1, 0, -1):
                labels[:, t - 1] = back[t, rows, labels[:, t]]
            for row, k in enumerate(group):
                out[k] = labels[row]
            at = to
        return out


def train(examples: list[tuple[list[list[int]], list[int]]], rounds: int = 200, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Fit by full-batch adaptive gradient ascent on the conditional log-likelihood."""
    emit, move, fixed = np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS + 1, N_LABELS)), _allowed()
    by_length: dict[int, list[int]] = {}
    for k, (features, _) in enumerate(examples):
        by_length.setdefault(len(features), []).append(k)
    groups = []
    for n, members in by_length.items():
        x = np.array([examples[k][0] for k in members])
        y = np.array([examples[k][1] for k in members])
        groups.append((n, x, y))
    sums = [np.full_like(emit, 1e-6), np.full_like(move, 1e-6)]
    for _ in range(rounds):
        grad_emit, grad_move = -decay * emit, -decay * move
        for n, x, y in groups:
            m, rows = len(x), np.arange(len(x))
            emitted, moves = emit[x].sum(axis=2), move + fixed
            ahead = np.zeros((n, m, N_LABELS))
            ahead[0] = emitted[:, 0] + moves[N_LABELS]
            for t in range(1, n):
                ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, :, None] + moves[None, :N_LABELS], axis=1) + emitted[:, t]
            total = np.logaddexp.reduce(ahead[-1], axis=1)
            behind = np.zeros((m, N_LABELS))
            for t in range(n - 1, -1, -1):
                p = np.exp(ahead[t] + behind - total[:, None])
                error = -p
                error[rows, y[:, t]] += 1
                np.add.at(grad_emit, x[:, t].ravel(), np.repeat(error, x.shape[2], axis=0))
                if t:
                    ways = ahead[t - 1][:, :, None] + moves[None, :N_LABELS] + (emitted[:, t] + behind)[:, None, :]
                    grad_move[:N_LABELS] -= np.exp(ways - total[:, None, None]).sum(axis=0)
                    np.add.at(grad_move, (y[:, t - 1], y[:, t]), 1)
                    behind = np.logaddexp.reduce(moves[None, :N_LABELS] + (emitted[:, t] + behind)[:, None, :], axis=2)
                else:
                    grad_move[N_LABELS] += error.sum(axis=0)
        for weights, grad, total in ((emit, grad_emit, sums[0]), (move, grad_move, sums[1])):
            total += grad**2
            weights += rate * grad / np.sqrt(total)
    return Field(emit, move)


# --- the labelled table ------------------------------------------------------------

_MARK = re.compile(r"\{(email|ip|card|phone|free):([^{}]*)\}")

#: Patterns of the labelled table: ``{kind:form}``, where N stands for any digit, D for a
#: digit from 1 to 9, L for a letter, C for a card number of 16 digits that passes the
#: check, B for a part of an address up to 255. ``free`` stands for nothing personal.
TEMPLATES = (
    "call me at {phone:(DNN) DNN-NNNN} after five", "phone: {phone:DNN-DNN-NNNN}", "tel {phone:0NN NNNNNNNN} today",
    "ring {phone:+DN NNN NNN NNNN} or write", "my number is {phone:(DNN) 555-NNNN}, thanks", "mobile {phone:+D (DNN) 555-NNNN} of",
    "fax {phone:DNN.DNN.NNNN} and", "contact {phone:+D-DNN-DNN-NNNN}. He", "the office {phone:1-8NN-DNN-NNNN} is open",
    "of the {phone:+1 (DNN) 555-NNNN} in that", "reach us on {phone:(DNN)DNN-NNNN} now", "call {phone:00DN DNN NNNNNNN} then",
    "write to {email:LLLL.LLL@LLLLL.com} soon", "mail {email:LLLLNN@mailN.example.com} for", "({email:LLL_LLL@LLLL.org})",
    "e-mail: {email:LL.LLLL+LLL@LLLL.LLLL.net}", "from {email:LLLLL@LLLL-LLL.de}, to", "the {email:LLLL.NN@mailD.example.com} as",
    "<{email:LLLLL@LLLL.co.uk}> wrote", "contact {email:LLLLL@localhost} for",
    "host {ip:B.B.B.B} answered", "from {ip:B.B.B.B} port", "ip={ip:B.B.B.B} was", "server {ip:B.B.B.B}:NNNN down", "at {ip:10.B.B.B}, the",
    "card {card:C} expires", "pay with {card:C}. The", "visa {card:C4} on file", "number {card:C-} and", "and {card:C} this is",
    "order {free:NNNNNNNN} was sent", "in the year {free:DNNN} there", "version {free:D.N.N} of the", "section {free:D.NN.N} says",
    "it cost {free:$NNN.NN} or", "about {free:N,NNN} people", "the score was {free:N-N} at", "on {free:20NN-0N-1N} we met",
    "isbn {free:978-D-NNN-NNNNN-N} of", "page {free:NNN} to {free:NNN} of", "at {free:1N:NN} on", "id {free:NNNNNNNNNNNN} in",
    "ticket {free:#NNNNN} closed", "from {free:19NN} to {free:20NN} in", "room {free:NNN} of", "sum {free:NNN NNN NNN} total",
    "part {free:LL-NNNN-NN} fits", "see {free:@LLLLL} there", "hex {free:NNNNLLLLNNNNLLLL} is", "around {free:N.NNNN} percent",
    "tracking {free:DNNNNNNNNNNNNNNX} is", "with {free:DNNNNNNNNNNNNNNX} as", "values {free:N N N N N} are", "build {free:N.N.NNNN.NNNN} ran",
    "ratio {free:NN/NN} of", "grid {free:NNNxNNN} and", "token {free:NNLLNNNLLNNNLLLNNNN} is", "call {free:NNN} now", "the {free:DN}th and {free:DNst} day",
)


def labelled_table(copies: int = 12, seed: int = 7) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """The small labelled table: texts with (start, kind, end) spans, filled in from the templates.

    Its size is ``copies`` times the number of templates, whatever the data.
    """
    random = np.random.default_rng(seed)
    pick = lambda letters: letters[random.integers(len(letters))]

    def card(passes: bool) -> str:
        digits = pick("3456") + "".join(pick("0123456789") for _ in range(14))
        check = next(d for d in "0123456789" if luhn(digits + d))
        return digits + (check if passes else pick([d for d in "0123456789" if d != check]))

    def fill(form: str) -> str:
        if form[0] == "C":
            number = card(True)
            return {"C": number, "C4": " ".join(number[k : k + 4] for k in range(0, 16, 4)), "C-": "-".join(number[k : k + 4] for k in range(0, 16, 4))}[form]
        if form.endswith("X"):
            return card(False)
        kinds = {"N": "0123456789", "D": "123456789", "L": "abcdefghijklmnopqrstuvwxyz"}
        return "".join(str(random.integers(256)) if c == "B" else pick(kinds[c]) if c in kinds else c for c in form)

    out = []
    for _ in range(copies):
        for template in TEMPLATES:
            text, spans, at = "", [], 0
            for m in _MARK.finditer(template):
                text += template[at : m.start()]
                value = fill(m.group(2))
                if m.group(1) != "free":
                    spans.append((len(text), m.group(1), len(text) + len(value)))
                text += value
                at = m.end()
            tail = re.sub("N", lambda _: pick("0123456789"), template[at:])
            out.append((text + tail, spans))
    return out


def examples_of(labelled: list[tuple[str, list[tuple[int, str, int]]]]) -> list[tuple[list[list[int]], list[int]]]:
    """Feature numbers and labels of the token runs of labelled texts."""
    out = []
    for text, spans in labelled:
        for before, tokens, after in runs(text):
            labels, last = [], None
            for start, end in tokens:
                own = next((s for s in spans if s[0] < end and start < s[2]), None)
                kind = KINDS.index(own[1]) if own else 0
                labels.append(0 if own is None else (2 if own is last else 1) + 2 * kind)
                last = own
            out.append((run_features(before, [text[s:e] for s, e in tokens], after), labels))
    return out


_TAILS = re.compile(r"[^0-9A-Za-z)]+$")


def field_spans(text: str, found: list[tuple[str, list[tuple[int, int]], str]], labels: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the labelled tokens, without signs at the edges, if their characters suit the kind."""
    out = []
    for (_, tokens, _), marks in zip(found, labels):
        k = 0
        while k < len(tokens):
            if not marks[k]:
                k += 1
                continue
            kind, first = (int(marks[k]) - 1) // 2, k
            k += 1
            while k < len(tokens) and marks[k] == 2 + 2 * kind:
                k += 1
            start, end = tokens[first][0], tokens[k - 1][1]
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            end = start + len(_TAILS.sub("", text[start:end]))
            if _suits(kind, text[start:end]):
                out.append((start, kind, end))
    return out


def _suits(kind: int, value: str) -> bool:
    digits = _only_digits(value)
    if kind == 0:
        return "@" in value[1:-1]
    if kind == 1:
        return value.count(".") == 3
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in value)


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the field's spans that touch none of them."""
    base = base_spans(text)
    found = runs(text)
    if not found:
        return base, []
    many = [run_features(b, [text[s:e] for s, e in tokens], a) for b, tokens, a in found]
    out, k = [], 0
    ordered = sorted((s, e) for s, _, e in base)
    for start, kind, end in sorted(field_spans(text, found, field.decode(many))):
        while k < len(ordered) and ordered[k][1] <= start:
            k += 1
        if k == len(ordered) or ordered[k][0] >= end:
            out.append((start, kind, end))
    return base, out


def fitted(labelled: list[tuple[str, list[tuple[int, str, int]]]] | None = None) -> Field:
    """The field, trained on the driver from a small labelled table (the library's own by default)."""
    return train(examples_of(labelled_table() if labelled is None else labelled))


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if end <= at:
            continue
        out += [text[at : max(start, at)], f"[{KINDS[kind]}]" if start >= at else ""]
        at = end
    return "".join([*out, text[at:]])


def find_personal(df: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, base counts, base spans and all spans of every whole text.

    Spans count code points, ends are exclusive. A null text counts as empty; repeated
    rows and null keys stay; other columns are left out. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(field or fitted())  # N_FEATURES x N_LABELS weights

    def make():
        own = shared.value

        def find(value: str) -> tuple:
            base, more = all_spans(value, own)
            counts = [0] * len(KINDS)
            for _, kind, _ in base:
                counts[kind] += 1
            return *counts, joined_spans(base, KINDS), joined_spans([*base, *more], KINDS)

        return find

    fields = ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return map_texts(df, {key: key}, text, make, fields)


def mask_personal(df: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """All columns, with every span of the text replaced by its kind in brackets; null texts stay null."""
    shared = df.sparkSession.sparkContext.broadcast(field or fitted())

    def make():
        own = shared.value

        def mask(value: str) -> tuple:
            base, more = all_spans(value, own)
            return (_masked(value, [*base, *more]),)

        return mask

    masked = map_texts(df, {f"_k{i}": c for i, c in enumerate(df.columns)}, text, make, "_masked string")
    back = [F.when(F.col(f"_k{i}").isNotNull(), F.col("_masked")).alias(c) if c == text else F.col(f"_k{i}").alias(c) for i, c in enumerate(df.columns)]
    return masked.select(*back)


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(f"n_{k}" for k in KINDS), sha256("base").alias("base_sha256"), "spans"
    )
