r"""Operator 8, personal data by a linear-chain conditional random field over word-shape features.

The field labels tokens with O or B-/I- of email, ip, card and phone.  Tokens are runs of the characters that a span
can hold, ``[A-Za-z0-9._%+@()-]``, so a span is found between any other signs and in texts without blanks; what else
stands between two tokens, white space aside, is a token of its own.  A token's features are its shape (letters, digits
and signs, runs collapsed), its shape with digit runs counted, how many digits it has, and the kinds of the tokens
beside it, all read from the whole token.  The field is trained on the driver from TRAINING_ROWS rows of a small
labelled table that training_table() writes out from sentence frames, by gradient ascent on the conditional likelihood.

A token without digit, ``@`` or ``+`` is plain, and plain tokens have the one label O: that is part of the model, in
training as in decoding.  So the chain falls apart there, and only runs of other tokens, with O on both sides, need to
be decoded.  Decoding is Viterbi in numpy, for all runs of a batch at once, and exact for whole texts.

Base spans come from the fixed patterns and always stay; a span of the field is added where it overlaps no other and
its digits or signs can be what it is called.

Cases: null text is empty; texts without digits or signs have no spans; very long texts, tokens and runs of digits or
of address characters are searched in linear time; repeated rows are judged row by row; an empty table gives none;
other columns of any name are ignored; a null doc_id is kept, and ids beside it stay whole.  Rows are judged
one by one without a shuffle, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TRAINING_ROWS = 495

#: An address is a run of LOCAL characters, the sign, and this.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match that begins inside a run of digits would begin at its start as well.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@+]")
TOKEN = re.compile(r"[A-Za-z0-9._%+@()-]+")
_TOKEN_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@()-")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        # a match has one sign, so what stands before an earlier sign, or in an earlier match, is not part of it
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        done = at + 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            out.append(("email", start, done))
        at = text.find("@", done)
    if not _SIGN.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def runs_of(text: str) -> Iterator[list[tuple[int, int]]]:
    """The runs of tokens that are not plain: their places.  Only what stands around a sign is looked at."""
    run: list[tuple[int, int]] = []
    at = 0
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > at and text[start - 1] in _TOKEN_SIGNS:
            start -= 1
        at = TOKEN.match(text, m.start()).end()
        if run and not text[run[-1][1] : start].isspace():
            yield run
            run = []
        run.append((start, at))
    if run:
        yield run


_RUNS = re.compile(r"([A-Za-z]+)|([0-9]+)|(.)\3*", re.S)


def shapes(token: str) -> tuple[str, ...]:
    """The token's own features."""
    return _shapes(token) if len(token) <= 64 else _shapes.__wrapped__(token)


@lru_cache(maxsize=4096)
def _shapes(token: str) -> tuple[str, ...]:
    core = token.strip(".")
    fine, coarse, digits = [], [], 0
    for m in _RUNS.finditer(core):
        if m[1]:
            fine.append("x"), coarse.append("x")
        elif m[2]:
            digits += len(m[2])
            fine.append(f"d{min(len(m[2]), 20)}"), coarse.append("d")
        else:
            fine.append(m[0][:1]), coarse.append(m[0][:1])
    more = digits if digits < 13 else 16 if len(core) < 20 else 20
    return "fine " + "".join(fine), "coarse " + "".join(coarse), f"digits {more}", "kind " + kind_of(token)


def kind_of(token: str) -> str:
    """What the tokens beside it see of a token."""
    if not _SIGN.search(token):
        return "plain"
    if "@" in token:
        return "at"
    first = token[:1]
    return ("plus" if first == "+" else "open" if first == "(" else "digit" if first.isdigit() else "other") + str(min(len(_digits(token)), 8))


FEATURES = 6


@dataclass
class Field:
    """Weights by feature and label, and of transitions; sequences begin and end beside O."""

    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def rows(self, tokens: list[str], before: str, after: str) -> list[list[int]]:
        """Feature numbers of each token; the last row of weights stands for features never seen, and for plain tokens."""
        kinds = [before, *map(kind_of, tokens), after]
        out = []
        for i, t in enumerate(tokens):
            own = () if kinds[i + 1] == "plain" else (*shapes(t), "left " + kinds[i], "right " + kinds[i + 2])
            out.append([self.index.get(f, len(self.index)) for f in own] + [len(self.index)] * (FEATURES - len(own)))
        return out

    def decode(self, sequences: list[list[list[int]]]) -> list[np.ndarray]:
        """Viterbi labels of each sequence of feature rows, sequences of one length at once."""
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            by_length.setdefault(len(s), []).append(i)
        out: list = [None] * len(sequences)
        for n, which in by_length.items():
            scores = self.weights[np.array([sequences[i] for i in which])].sum(axis=2)
            best = self.transitions[0] + scores[:, 0]
            back = np.zeros((len(which), n, len(LABELS)), np.int8)
            for t in range(1, n):
                paths = best[:, :, None] + self.transitions[None]
                back[:, t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + scores[:, t]
            label = (best + self.transitions[:, 0]).argmax(axis=1)
            labels = np.zeros((len(which), n), np.int8)
            for t in range(n - 1, -1, -1):
                labels[:, t] = label
                label = back[np.arange(len(which)), t, label]
            for i, row in zip(which, labels, strict=True):
                out[i] = row
        return out


FRAMES = (
    "write to {email} for more", "contact {email} .", "mail: {email}, or call {phone}", "({email})", "call {phone} today", "tel {phone}", "phone {phone}, ext 12",
    "from host {ip} at 12:30", "server {ip} was down", "ping {ip}.", "card {card} expires 12/27", "paid with {card} on 2024-01-05", "number {card}.",
    "{email} {phone}", "{ip} {email}", "in 1999 there were 250 of them", "version 2.0.1 of 3.14", "on 2024-01-05 at 10:15:30", "it cost $1,200.50 or 30%",
    "order 123456 and item 99887766", "section 4.2.1 , page 17", "C++ and 1+1 = 2", "@user wrote #42", "id 550e8400-e29b-41d4-a716-446655440000", "sum 1234567890123456789012345",
    "see http://a.example.com/p?id=12345", "lot 2023-000123-44", "from 1990-1995 to 2001-2005", "score 3-2 in 90+4", "hash 9f86d081884c7d659a2feaa0c55ad015", "token sk_live_4eC39HqLyjWD", "{bad}", "ref {bad} .",
)


def training_table(rows: int = TRAINING_ROWS, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: (text, spans), frames filled with made-up data of every kind and with what only looks like it."""
    r = random.Random(seed)
    word = lambda n=6: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, n)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = "4" + number(14)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return r.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    make = {
        "email": lambda: r.choice([f"{word()}.{word()}@{word()}.example.com", f"{word()}{number(2)}@{word()}.org", f"{word()}.{number(2)}@{word()}{number(1)}.example.com", f"{word()}+{word()}@{word()}.net", f"{word()}@{word()}"]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+1 ({number(3)}) 555-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"({number(3)}){number(3)}-{number(4)}", f"+49 30 {number(4)} {number(4)}", f"+44 20 {number(4)} {number(4)}", f"+1-{number(3)}-555-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"0{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}"]),
        "bad": lambda: r.choice([number(3), number(4), number(6), number(8), number(25), f"{number(2)}.{number(2)}.{number(4)}", f"{number(1)}.{number(2)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"{number(3)},{number(3)}", f"{word()}{number(3)}", f"{number(4)} {number(4)}", f"{number(2)}/{number(2)}/{number(4)}", f"{number(3)} {number(3)} {number(3)}"]),
    }
    out = []
    for i in range(rows):
        text, spans = "", []
        for part in re.split(r"\{(\w+)\}", FRAMES[i % len(FRAMES)]):
            filled = make[part]() if part in make else part
            if part in KINDS:
                spans.append((part, len(text), len(text) + len(filled)))
            text += filled
        out.append((f"{word()} {text} {word()}", [(k, a + text_shift, b + text_shift) for k, a, b in spans for text_shift in [0]]))
        lead = len(out[-1][0]) - len(out[-1][0].split(" ", 1)[1])
        out[-1] = (out[-1][0], [(k, a + lead, b + lead) for k, a, b in spans])
    return out


#: What a label costs that a plain token cannot have.
NEVER = -1e9


@dataclass
class Labelled:
    """A labelled table as arrays (rows x longest row): feature numbers, labels, which are tokens, which are plain."""

    x: np.ndarray
    y: np.ndarray
    mask: np.ndarray
    plain: np.ndarray


def prepare(table: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[Field, Labelled]:
    """The field without weights that knows the table's features, and the table as arrays."""
    sequences, answers = [], []
    for text, spans in table:
        tokens, labels, end = [], [], 0
        for m in TOKEN.finditer(text):
            if text[end : m.start()].strip():
                tokens.append(""), labels.append(0)  # other signs are a plain token
            a, b = m.span()
            hit = next((s for s in spans if s[1] < b and a < s[2]), None) if kind_of(m[0]) != "plain" else None
            tokens.append(m[0]), labels.append(LABELS.index(f"{'B' if hit and a <= hit[1] else 'I'}-{hit[0]}") if hit else 0)
            end = b
        sequences.append(tokens), answers.append(labels)
    names = set()
    for tokens in sequences:
        kinds = ["plain", *map(kind_of, tokens), "plain"]
        for i, t in enumerate(tokens):
            if kinds[i + 1] != "plain":
                names |= {*shapes(t), "left " + kinds[i], "right " + kinds[i + 2]}
    index = {f: i for i, f in enumerate(sorted(names))}
    field = Field(index, np.zeros((len(index) + 1, len(LABELS))), np.zeros((len(LABELS), len(LABELS))))
    shape = (len(table), max(map(len, sequences)))
    data = Labelled(np.full((*shape, FEATURES), len(index)), np.zeros(shape, int), np.zeros(shape, bool), np.zeros(shape, bool))
    for i, (tokens, labels) in enumerate(zip(sequences, answers, strict=True)):
        n = len(tokens)
        data.x[i, :n] = field.rows(tokens, "plain", "plain")
        data.y[i, :n], data.mask[i, :n], data.plain[i, :n] = labels, True, [kind_of(t) == "plain" for t in tokens]
    return field, data


def likelihood(field: Field, data: Labelled) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean log likelihood of the labels given the tokens, and its gradient by weights and transitions."""
    x, y, mask, move = data.x, data.y, data.mask, field.transitions
    rows, (n, longest), labels = np.arange(len(x)), mask.shape, len(LABELS)
    ends = mask.sum(axis=1) - 1
    score = field.weights[x].sum(axis=2)
    score[..., 1:][data.plain] = NEVER
    alpha = np.zeros((n, longest, labels))
    alpha[:, 0] = move[0] + score[:, 0]
    for t in range(1, longest):
        alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + score[:, t]
    beta = np.broadcast_to(move[:, 0], alpha.shape).copy()
    for t in range(longest - 2, -1, -1):
        inner = np.logaddexp.reduce(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where((t < ends)[:, None], inner, beta[:, t])
    total = np.logaddexp.reduce(alpha[rows, ends] + move[:, 0], axis=1)
    before = np.concatenate([np.zeros((n, 1), int), y[:, :-1]], axis=1)
    gold = (np.take_along_axis(score, y[..., None], 2)[..., 0] + move[before, y])[mask].sum() + move[y[rows, ends], 0].sum()
    by_weight, by_move = np.zeros_like(field.weights), np.zeros_like(move)
    p = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
    over = np.eye(labels)[y] * mask[..., None] - p
    for f in range(FEATURES):
        np.add.at(by_weight, x[..., f], over)
    np.add.at(by_move, (before[mask], y[mask]), 1)
    np.add.at(by_move, (y[rows, ends], 0), 1)
    by_move[0] -= p[:, 0].sum(axis=0)
    by_move[:, 0] -= p[rows, ends].sum(axis=0)
    for t in range(1, longest):
        pair = alpha[:, t - 1, :, None] + move + (score[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
        by_move -= (np.exp(pair) * mask[:, t, None, None]).sum(axis=0)
    by_weight[-1] = 0.0  # stands for no feature
    return (gold - total.sum()) / n, by_weight / n, by_move / n


def train(table: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """The field with the greatest penalised conditional likelihood of the table (bounded: its rows all go to the driver)."""
    field, data = prepare(table)
    seen = [np.full_like(field.weights, 1e-8), np.full_like(field.transitions, 1e-8)]
    for _ in range(steps):
        _, *steepest = likelihood(field, data)
        for value, step, squares in zip((field.weights, field.transitions), steepest, seen, strict=True):
            step = step - decay * value
            squares += step**2
            value += rate * step / np.sqrt(squares)
    return field


def _could_be(kind: str, span: str) -> bool:
    d = _digits(span)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]+", span))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span)) and all(_octet(p) for p in span.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"\+?[0-9().\x20-]+", span)) and len(d) < len(span)


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text."""
    sequences, owners = [], []
    for i, text in enumerate(texts):
        for run in runs_of(text):
            sequences.append(field.rows([text[a:b] for a, b in run], "plain", "plain"))
            owners.append((i, run))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, run), labels in zip(owners, field.decode(sequences), strict=True):
        t = 0
        while t < len(run):
            name = LABELS[labels[t]]
            if name == "O":
                t += 1
                continue
            kind, z = name[2:], t + 1
            while z < len(run) and LABELS[labels[z]] == f"I-{kind}":
                z += 1
            a, b = run[t][0], run[z - 1][1]
            while a < b and not (texts[i][a].isalnum() or texts[i][a] in "+("):
                a += 1
            while b > a and not texts[i][b - 1].isalnum():
                b -= 1
            if a < b and _could_be(kind, texts[i][a:b]):
                out[i].append((kind, a, b))
            t = z
    return out


def all_spans(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, by kind as listed, then start."""
    out = []
    for text, own in zip(texts, field_spans(field, texts), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        more, starts = [], [a for a, _ in taken]
        for kind, a, b in own:
            at = np.searchsorted(starts, b)
            if not any(x < b and a < y for x, y in taken[max(0, at - len(KINDS) - 1) : at]):
                more.append((kind, a, b))
        out.append((base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row of docs."""
    field = field or train(training_table())
    told = docs.sparkSession.sparkContext.broadcast(field)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # ids stay in Arrow: pandas would make doubles of them beside a null
            found = all_spans(told.value, b.column("text").to_pylist())
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(_told(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, sha, pa.array([_told(every) for _, every in found], pa.string())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets; other columns and clean texts stay as they are."""
    told = docs.sparkSession.sparkContext.broadcast(field or train(training_table()))

    @F.pandas_udf("string")
    def cut(text: pd.Series) -> pd.Series:
        texts = [t or "" for t in text]
        out = []
        for t, old, (_, spans) in zip(texts, text, all_spans(told.value, texts), strict=True):
            at, parts = 0, []
            for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    parts += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                else:  # spans of two kinds overlap: the later one's rest goes too
                    at = max(at, b)
            out.append("".join([*parts, t[at:]]) if parts else old)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", cut("text"))


def labelled(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """training_table() as a DataFrame."""
    return spark.createDataFrame(training_table(rows), "text string, spans array<struct<kind:string,start:int,end:int>>")
