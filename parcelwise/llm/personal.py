"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field labels white-space separated words as nothing, email, ip, card or phone.  A word's score comes from features
of its own shape and of its neighbours' shapes; labels of neighbours are tied by transition scores.  It is trained here,
by maximum likelihood, from a small labelled table: sentences made from fixed templates by a rule, and at most
``SAMPLE_DOCS`` documents (the smallest hashes of their ids; of a longer one ``SAMPLE_CHARACTERS``) labelled by the base patterns.

Decoding is exact and in numpy batches.  A word whose score for "nothing" leads by more than any two transitions can
make up is "nothing" in the best labelling; such words cut a text into short pieces, and Viterbi runs over all pieces
of a batch at once.

The field only adds spans that touch no base span.  Offsets are code points.  Edge cases: null text is empty; texts
are labelled whole; with no rows the field is trained from the templates alone; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, column, read_table
from .spans import Span, scan

BASE = ("email", "ip", "card", "phone")
ADDED = tuple(f"crf_{k}" for k in BASE)
# The base patterns.  An address begins where a run of digits does and never gives digits back, so the
# search is linear; the part of an email before the @ is found from the @ backwards (``emails``).
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SAMPLE_DOCS, SAMPLE_CHARACTERS = 300, 20_000
#: Sentences for training: at most this many words each, and this many of them.
SENTENCE_WORDS, MOST_SENTENCES = 16, 1000
REMEMBERED_SHAPES = 300_000
LABELS = ("none", *BASE)

#: Labelled sentences; a word in braces is filled by rule and labelled by its kind.
TEMPLATES = (
    "please write to {email} for the whole list", "reach me at {email} or call {phone} after noon", "mail: {email}", "the host {ip} did not answer",
    "login from {ip} was refused twice", "server {ip} , port 8080", "card {card} was charged 20 euros", "pay with {card} by Friday",
    "my number is {phone} , ask for the desk", "tel. {phone}", "call {phone} today", "fax {phone} or {email}", "contact {email} , {phone} , {ip}",
    "version 2.0. of the license", "chapter 3.1 has 12 pages", "in 1998 there were 350 of them", "between 10.30 and 11.45 on 12.05.2011", "the price is 1,200.50 in total",
    "item #12 costs $30 *** or less", "see section 4.2.1 and table 7", "build 20110512 passed 4,096 tests", "order 66120 of 17/03/2020 was late", "A1 B2 C3 and so on",
    "the result was 3:2 after 90 minutes", "ISBN 978 has 13 digits", "a plain sentence without any number", "Nothing here. Nothing there, either.", "UPPER CASE WORDS!! MORE OF THEM!!",
    "one | two | three | four", "word%%% word### word&&& word***", "hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff of the file", "id=4711; size=20", "@home and @work are tags",
)
FILLS_PER_TEMPLATE = 12


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _fits(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in found.split(".")))
    if kind == "card":
        digits = _digits(found)
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(_digits(found)) <= 15
    return True


_DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping local parts with their hosts: around every @, not before the end of the last one."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and text[low - 1] in _LOCAL:
            low -= 1
        host = _HOST.match(text, at + 1) if low < at else None
        if host:
            end = host.end()
            out.append(("email", low, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for kind in BASE[1:]:
            if kind != "phone" or "+" in text:
                out += [(kind, *m.span()) for m in PATTERNS[kind].finditer(text) if _fits(kind, m[0])]
    return out


# --- features -------------------------------------------------------------------------------------------------

_SHAPES = 256
#: Lower-case letters and everything beyond ASCII as x, capitals as X, digits as d; other characters stay.
_SHAPE_OF = bytes(120 if c >= 128 or 97 <= c <= 122 else 88 if 65 <= c <= 90 else 100 if 48 <= c <= 57 else c for c in range(256))
_RUN = np.array([c in (88, 120) for c in range(256)])


def shapes(text: str) -> list[bytes]:
    """Shapes of the words of a text; a run of equal letters marks counts once."""
    codes = np.frombuffer(text.encode().translate(_SHAPE_OF), "u1")
    if not len(codes):
        return []
    keep = np.append(True, (codes[1:] != codes[:-1]) | ~_RUN[codes[1:]])
    return codes[keep].tobytes().split()


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n > e for e in edges)


def features(shape: bytes) -> tuple[int, ...]:
    digits, letters, at = shape.count(b"d"), shape.count(b"x") + shape.count(b"X"), shape.find(b"@")
    flags = (
        zlib.crc32(shape[:24]) % _SHAPES, _bucket(digits, (0, 1, 2, 3, 5, 9, 12, 13, 16, 19)), _bucket(len(shape), (1, 3, 6, 10, 15, 20, 30)), _bucket(shape.count(b"."), (0, 1, 2, 3)),
        (0 if at < 0 else 1 if at and b"." in shape[at:] else 2), (shape[:1] == b"+") + 2 * (shape[:1] == b"("), _bucket(shape.count(b"-"), (0, 1, 2)),
        letters * 4 // max(1, len(shape)), int(digits == len(shape)))
    return tuple(base + value for base, value in zip(_STARTS, flags))


_STARTS = np.concatenate([[0], np.cumsum([_SHAPES, 11, 8, 5, 3, 4, 4, 5, 2])]).tolist()
WIDTH = _STARTS[-1]
_EDGE = (WIDTH,) * (len(_STARTS) - 1)  # the place before a text and behind it
_PARTS = 3  # own shape, shape before, shape behind


class Field:
    """Scores: ``weights`` (part, feature, label) and ``ties`` (label, next label); label 0 is "nothing"."""

    def __init__(self):
        self.weights = np.zeros((_PARTS, WIDTH + 1, len(LABELS)))
        self.ties = np.zeros((len(LABELS), len(LABELS)))

    def fit(self, sentences: list[tuple[list[str], list[int]]], rounds: int = 60, rate: float = 0.15, decay: float = 2e-4) -> Field:
        """Maximum likelihood by Adam over all sentences at once; both ends are tied to "nothing"."""
        longest = max(len(w) for w, _ in sentences)
        n, k = len(sentences), len(LABELS)
        # Words with equal features are one kind; kind 0 stands before and behind a sentence.
        kinds: dict[tuple[int, ...], int] = {_EDGE: 0}
        own = np.zeros((n, longest + 2), int)
        gold = np.zeros((n, longest), int)
        valid = np.zeros((n, longest), bool)
        for i, (words, labels) in enumerate(sentences):
            own[i, 1 : len(words) + 1] = [kinds.setdefault(features(shapes(w)[0]), len(kinds)) for w in words]
            gold[i, : len(words)], valid[i, : len(words)] = labels, True
        of_kind = np.array(list(kinds))
        feeds = (own[:, 1:-1], own[:, :-2], own[:, 2:])
        target = np.eye(k)[gold]
        path = np.concatenate([np.zeros((n, 1), int), np.where(valid, gold, 0), np.zeros((n, 1), int)], 1)
        counts = np.bincount((path[:, :-1] * k + path[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        params = [self.weights, self.ties]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, rounds + 1):
            score = sum(self.weights[p][of_kind].sum(1)[x] for p, x in enumerate(feeds))
            score = np.where(valid[..., None], score, np.where(np.arange(k) == 0, 0.0, -1e9))
            marginal, pairs = self._expected(score)
            excess = (marginal - target)[valid] / n
            grad_w = np.zeros_like(self.weights)
            for p, x in enumerate(feeds):
                by_kind = np.stack([np.bincount(x[valid], excess[:, label], len(kinds)) for label in range(k)], 1)
                np.add.at(grad_w[p], of_kind, by_kind[:, None, :])
            grads = [grad_w + decay * self.weights, (pairs - counts) / n + decay * self.ties]
            for value, grad, (m, v) in zip(params, grads, moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _expected(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels, and expected label pairs over all sentences (forward and backward sums)."""
        n, length, k = score.shape

        def add(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        ahead = np.empty_like(score)
        ahead[:, 0] = self.ties[0] + score[:, 0]
        for t in range(1, length):
            ahead[:, t] = add(ahead[:, t - 1, :, None] + self.ties, 1) + score[:, t]
        back = np.empty_like(score)
        back[:, -1] = self.ties[:, 0]
        for t in range(length - 2, -1, -1):
            back[:, t] = add(self.ties + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        total = add(ahead[:, -1] + back[:, -1], 1)
        marginal = np.exp(ahead + back - total[:, None, None])
        inner = ahead[:, :-1, :, None] + self.ties + (score + back)[:, 1:, None, :] - total[:, None, None, None]
        pairs = np.exp(inner).sum((0, 1))
        pairs[0] += marginal[:, 0].sum(0)
        pairs[:, 0] += marginal[:, -1].sum(0)
        return marginal, pairs


def viterbi(score: np.ndarray, ties: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of padded pieces (piece, place, label), each between two words labelled 0."""
    n, longest, k = score.shape
    best = ties[0] + score[:, 0]
    back = np.zeros((n, longest, k), np.int8)
    last = np.where((lengths == 1)[:, None], best + ties[:, 0], -np.inf)
    for t in range(1, longest):
        options = best[:, :, None] + ties
        back[:, t] = options.argmax(1)
        best = options.max(1) + score[:, t]
        last = np.where((lengths == t + 1)[:, None], best + ties[:, 0], last)
    labels = np.zeros((n, longest), np.int8)
    label = last.argmax(1)
    rows = np.arange(n)
    for t in range(longest - 1, -1, -1):
        on = t < lengths
        labels[on, t] = label[on]
        if t:
            label = np.where(on, back[rows, t, label], label)
    return labels


class Labeller:
    """Labels texts; words with equal features share a number, and scores are kept by number."""

    def __init__(self, field: Field):
        self.field = field
        self.words: dict[str, int] = {}
        self.numbers: dict[tuple[int, ...], int] = {}
        self.tables: list[list[np.ndarray]] = [[], [], []]
        self.number(_EDGE)
        self.packed = None
        self.lead = 2 * (field.ties.max() - field.ties.min())

    def number(self, f: tuple[int, ...]) -> int:
        got = self.numbers.get(f)
        if got is None:
            got = self.numbers[f] = len(self.numbers)
            for part, table in enumerate(self.tables):
                table.append(self.field.weights[part][list(f)].sum(0))
            self.packed = None
        return got

    def known(self, words: list[bytes]) -> np.ndarray:
        table = self.words
        try:
            return np.fromiter(map(table.__getitem__, words), np.int32, len(words))
        except KeyError:
            for w in words:
                if w not in table:
                    table[w] = self.number(features(w))
            return np.fromiter(map(table.__getitem__, words), np.int32, len(words))

    def labels(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, place of the word, label) of every word that is labelled."""
        if len(self.words) > REMEMBERED_SHAPES:
            self.words.clear()
        split = [shapes(t) for t in texts]
        numbers = [np.zeros(1, np.int32)]
        for words in split:
            numbers += [self.known(words), np.zeros(1, np.int32)]  # a gap between texts
        stream = np.concatenate(numbers)
        if self.packed is None:
            self.packed = [np.array(t) for t in self.tables]
        own, before, behind = self.packed
        margins = [t[:, 0] - t[:, 1:].max(1) for t in self.packed]
        inner = stream[1:-1]
        sure = margins[0][inner] + margins[1][stream[:-2]] + margins[2][stream[2:]] > self.lead
        sure[inner == 0] = True
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return []
        starts = open_[np.append(True, np.diff(open_) > 1)]
        ends = open_[np.append(np.diff(open_) > 1, True)] + 1
        bounds = np.concatenate([[0], np.cumsum([len(w) + 1 for w in split])])
        out = []
        lengths = ends - starts
        order = np.argsort(lengths, kind="stable")
        for low in range(0, len(order), 2048):
            mine = order[low : low + 2048]
            longest = int(lengths[mine].max())
            at = np.minimum(starts[mine, None] + np.arange(longest), len(inner) - 1)
            score = own[inner[at]] + before[stream[at]] + behind[stream[at + 2]]
            labels = viterbi(score, self.field.ties, lengths[mine])
            for i, t in zip(*np.nonzero(labels)):
                place = int(at[i, t])
                text = int(np.searchsorted(bounds, place, "right")) - 1
                out.append((text, place - int(bounds[text]), int(labels[i, t])))
        return sorted(out)


_WORD = re.compile(WORD)
_TRIM = " .,;:!?\"'[]{}<>|#*$%&"


def _whole(kind: str, body: str) -> bool:
    """Whether labelled words have the parts their kind needs."""
    if kind == "email":
        return "." in body.partition("@")[2].strip(".")
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", body) is not None and _fits(kind, body)
    return _fits(kind, body)


def added_spans(text: str, found: list[tuple[int, int]], base: list[Span]) -> list[Span]:
    """Runs of equal labels as spans without surrounding marks (or else their words one by one).

    Only those are added that touch no base span and pass the check of their kind.
    """
    places = [m.span() for m in _WORD.finditer(text)]
    out: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def add(label: int, first: int, last: int) -> bool:
        low, high = places[first][0], places[last][1]
        body = text[low:high]
        low, high = low + len(body) - len(body.lstrip(_TRIM)), high - len(body) + len(body.rstrip(_TRIM))
        before = bisect_left(starts, high)  # base spans that begin before this one ends
        if low >= high or (before and ends[before - 1] > low) or not _whole(BASE[label - 1], text[low:high]):
            return False
        out.append((ADDED[label - 1], low, high))
        return True

    at = 0
    while at < len(found):
        end = at + 1
        while end < len(found) and found[end] == (found[end - 1][0] + 1, found[at][1]):
            end += 1
        if not add(found[at][1], found[at][0], found[end - 1][0]) and end - at > 1:
            for place, label in found[at:end]:
                add(label, place, place)
        at = end
    return out


# --- training table ---------------------------------------------------------------------------------------------

def _fill(kind: str, n: int) -> str:
    """The ``n``-th invented value of a kind."""
    d = lambda count, salt: "".join(str((n * 7 + salt * 13 + i * (3 + n % 5) + i * i) % 10) for i in range(count))
    if kind == "email":
        return (f"user{n}@mail{n % 7}.example.com", f"a.b{d(2, 1)}@host-{n % 9}.org", f"Name_{d(3, 2)}@example.co.uk")[n % 3]
    if kind == "ip":
        return ".".join(str((n * 37 + i * 91) % 256) for i in range(4))
    if kind == "card":
        digits = f"4{d(14, 3)}"
        digits = next(digits + c for c in "0123456789" if luhn(digits + c))
        return (digits, " ".join(digits[i : i + 4] for i in range(0, 16, 4)), "-".join(digits[i : i + 4] for i in range(0, 16, 4)))[n % 3]
    three, four = f"{2 + n % 8}{d(2, 4)}", d(4, 5)
    return (f"+1 ({three}) 555-{four}", f"+44 20 {d(4, 6)} {four}", f"({three}) 555-{four}", f"{three}-555-{four}", f"+{n % 9 + 1}{d(11, 7)}")[n % 5]


def template_sentences() -> list[tuple[list[str], list[int]]]:
    out = []
    for number, template in enumerate(TEMPLATES):
        for n in range(FILLS_PER_TEMPLATE):
            words, labels = [], []
            for word in template.split(" "):
                kind = word[1:-1] if word[:1] == "{" else None
                filled = _fill(kind, n + 17 * number).split() if kind else [word]
                words += filled
                labels += [LABELS.index(kind) if kind else 0] * len(filled)
            out.append((words, labels))
    return out


def labelled_sentences(text: str) -> list[tuple[list[str], list[int]]]:
    """Sentences of one document, words that a base span touches labelled by its kind."""
    spans = base_spans(text)
    words, labels = [], []
    for m in _WORD.finditer(text):
        words.append(m[0])
        labels.append(next((LABELS.index(k) for k, a, b in spans if a < m.end() and m.start() < b), 0))
    return [(words[i : i + SENTENCE_WORDS], labels[i : i + SENTENCE_WORDS]) for i in range(0, len(words), SENTENCE_WORDS)]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """The field, from the templates and a bounded sample of documents."""
    by_hash = docs.select(column(docs, "doc_id", "bigint").alias("doc_id")).filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    ids = sorted({r.doc_id for r in by_hash.collect()})
    sentences = template_sentences()
    if ids:
        doc_id = column(docs, "doc_id", "bigint")
        texts = docs.filter(doc_id.isin(ids)).select(doc_id.alias("doc_id"), F.substring(column(docs, "text", "string"), 1, SAMPLE_CHARACTERS).alias("text")).orderBy("doc_id", "text").limit(sample_docs)
        own = [s for r in texts.collect() for s in labelled_sentences(r.text or "")]
        marked, plain = [s for s in own if any(s[1])], [s for s in own if not any(s[1])]
        sentences += marked[: MOST_SENTENCES // 2] + plain[: MOST_SENTENCES - len(marked[: MOST_SENTENCES // 2])]
    return Field().fit(sentences)


def finder(field: Field) -> Callable[[], Callable[[list[str]], list[tuple[list[Span], list[Span]]]]]:
    def start() -> Callable[[list[str]], list[tuple[list[Span], list[Span]]]]:
        labeller = Labeller(field)

        def find(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
            base = [base_spans(t) for t in texts]
            by_text: dict[int, list[tuple[int, int]]] = {}
            for text, place, label in labeller.labels(texts):
                by_text.setdefault(text, []).append((place, label))
            return [(b, added_spans(t, by_text[n], b) if n in by_text else []) for n, (t, b) in enumerate(zip(texts, base))]

        return find

    return start


def personal_data(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    return scan(docs, finder(train(docs, sample_docs)), BASE, ADDED)


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_personal_data": op5_personal_data}
ORACLES: dict[str, str] = {}
