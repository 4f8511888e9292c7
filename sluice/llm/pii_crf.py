"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give base spans that always stay. The field labels every word of every text from the
shapes of the word and its neighbours; it is trained at the start, by its exact gradient in numpy,
from the labelled lines below, and decoded by Viterbi over batches of word runs. It adds what the
patterns can't see (phones without a plus sign, spelled-out addresses, cards in other groupings)
where that doesn't touch a base span.

Defined results: a null text is empty and has no spans; repeated rows are each searched; texts of
any length are searched whole, in runs that are cut only between plain words where there are any;
an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.common import Recent, batches, for_worker, only, pairs_of, short_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's place, end

# Patterns. Possessive runs and look-behinds keep them linear; they match what the plain forms match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: around each @, back over the local part as far as the last match lets."""
    done, at = 0, text.find("@")
    while at >= 0:
        back = _LOCAL_BACK.match(text[max(done, at - 4096) : at][::-1]).end()
        if back == 4096 < at - done:
            back = _LOCAL_BACK.match(text[done:at][::-1]).end()
        if back and (m := _DOMAIN.match(text, at + 1)):
            yield at - back, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The pattern spans, by start and then kind."""
    found: list[Span] = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# The labelled table: a line each, words of personal data as word/label; B starts a span, I goes on.
LABELLED = """
write to jane.roe@mail.example.org/B-email before noon
send it to j_doe+x@example.com,/B-email or call
contact: <a.b@c.example.net>/B-email please
reach me at jane/B-email [at]/I-email example/I-email [dot]/I-email org/I-email today
mail john.smith/B-email (at)/I-email example.com/I-email for more
my address is mary/B-email [at]/I-email host.example.net/I-email thanks
we met at noon and at the dot on the map
look at the house and at that point
the dot at the end is at fault
from host 10.20.30.40/B-ip at night
server 192.168.1.254,/B-ip was down
address (172.16.0.1)/B-ip failed and 8.8.4.4/B-ip answered
version 1.2.3 of the tool
release 10.4.300.7 and 999.1.1.1 are no hosts
section 3.4.1 has more
paid with 4539578763621486/B-card yesterday
card 5500005555555559,/B-card expired
card 4539/B-card 5787/I-card 6362/I-card 1486/I-card was used
card 4539-5787-6362-1486/B-card was used
card 4539.5787.6362.1486/B-card was used
cards 4539578763621486/B-card 5500005555555559/B-card were used
order 4539578763621487 has shipped
serial 1234567890123456 and 2390409512345678 are numbers
item 9807915762804491 in stock
call +1/B-phone (017)/I-phone 555-7713/I-phone soon
call +44/B-phone 20/I-phone 7946/I-phone 0958/I-phone soon
phone +4930123456789/B-phone or write
call (017)/B-phone 555-7713/I-phone soon
ring (415)/B-phone 555-0134./I-phone Thanks
call 415-555-0134/B-phone today
call 415.555.0134/B-phone today
page 555 of 1200 and 7713 more
in 1999 about 250 people and 3,000 cars
chapter 12 (17) and 5-7 or 2020-2021
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here
id 7d33ee and key AKIA4XYZ12 there
the quick brown fox | jumps over | the lazy dog.
The House OF Cards !! AND more*** words### here%%%
Was it, or is it; of and the to a in
price $12.50 and 40% off at 10:30 on 2024-01-15
a@ b and @handle or x@y said
see https://www.example.com/a/b?c=1 and www.example.org today
"""

LABELS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]
_EDGE = "\"'<>[]{}.,;:!?*#%$&|"
PLAIN, OTHER = "word", "mixed"


def shape(word: str) -> str:
    """A word's shape: few values, whatever the text."""
    if word.isalpha():
        return word if word in ("at", "dot") else PLAIN
    low = word.lower()
    if low in ("[at]", "(at)", "[dot]", "(dot)"):
        return "at" + low if "at" in low else "dot" + low
    core = word.strip(_EDGE)
    if "@" in core:
        return "mail" if next(_emails(core), None) else OTHER
    if not any("0" <= c <= "9" for c in core):
        if core.strip("_").isalpha() or not core.strip("-_()/='"):
            return PLAIN
        return "host" if re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", core) else OTHER
    if re.fullmatch(r"\(?[0-9]+(\.[0-9]+){3}\)?", core):
        parts = core.strip("()").split(".")
        if all(len(p) == 4 for p in parts):
            return "cardgroups" if luhn("".join(parts)) else "digits"
        return "ip" if all(len(p) < 4 and int(p) <= 255 for p in parts) else "digits"
    digits = _NOT_DIGITS.sub("", core)
    if re.fullmatch(r"[0-9]+(-[0-9]+)*", core) and 14 <= len(digits) <= 19:
        return "card" if luhn(digits) else "digits"
    if core[0] == "+" and core[1:].isdigit():
        return "plus" if len(digits) < 10 else "plusphone" if len(digits) < 16 else "digits"
    if re.fullmatch(r"\([0-9]{3}\)", core):
        return "area"
    if re.fullmatch(r"[0-9]{3}[-.][0-9]{4}", core):
        return "local"
    if re.fullmatch(r"[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}", core):
        return "national"
    if core.isdigit():
        return "four" if len(core) == 4 else "few" if len(core) < 4 else "digits"
    return OTHER


SHAPES = [PLAIN, OTHER, "at", "dot", "at[at]", "at(at)", "dot[dot]", "dot(dot)", "mail", "host", "cardgroups", "digits", "ip", "card", "plus", "plusphone", "area", "local", "national", "four", "few"]
_PLACE = {s: k for k, s in enumerate(SHAPES)}
NO_WORD = len(SHAPES)  # before the first and behind the last


def shape_places() -> Recent:
    """The place of each word's shape."""
    return Recent(lambda word: _PLACE[shape(word)], 150_000)


def features(x: np.ndarray) -> np.ndarray:
    """(B, T, 3): the shapes of each word and its neighbours, in ranges of their own. x: (B, T) with NO_WORD behind the end."""
    n = NO_WORD + 1
    edge = np.full((len(x), 1), NO_WORD, x.dtype)
    return np.stack([x, np.concatenate([edge, x[:, :-1]], 1) + n, np.concatenate([x[:, 1:], edge], 1) + 2 * n], 2)


class Field:
    """Weights: emit (shapes, labels) for word, previous and next; step (from, to); first (labels)."""

    def __init__(self):
        k = len(LABELS)
        self.emit, self.step, self.first = np.zeros((3 * (NO_WORD + 1), k)), np.zeros((k, k)), np.zeros(k)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.emit[features(x)].sum(2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """(B, T): the best labels of each row; x (B, T) shapes."""
        b, t = x.shape
        n = NO_WORD + 1
        e, step = self.emit.astype(np.float32), self.step.astype(np.float32)
        word, before, after = e[:n].T.copy(), e[n : 2 * n].T.copy(), e[2 * n :].T.copy()
        cols = np.ascontiguousarray(x.T).astype(np.intp)
        edge = np.full(b, NO_WORD, np.intp)
        back = np.empty((t, len(LABELS), b), np.uint8)
        best = None
        for at in range(t):
            s = np.take(word, cols[at], axis=1) + np.take(before, cols[at - 1] if at else edge, axis=1) + np.take(after, cols[at + 1] if at + 1 < t else edge, axis=1)
            if best is None:
                best = s + self.first.astype(np.float32)[:, None]
                continue
            new = np.empty_like(best)
            for j in range(len(LABELS)):
                via = best + step[:, j, None]
                top = via.argmax(0)
                back[at, j] = top
                new[j] = np.take_along_axis(via, top[None], 0)[0]
            best = new + s
        out = np.empty((t, b), np.uint8)
        out[-1] = best.argmax(0)
        rows = np.arange(b)
        for at in range(t - 1, 0, -1):
            out[at - 1] = back[at, out[at], rows]
        return out.T


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def loss_and_gradients(field: Field, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Negative log-likelihood of labels y over the first sizes[b] words of each row, and its gradients, by forward-backward."""
    s, (b, t), k = field.scores(x), x.shape, len(LABELS)
    f, g = features(x), [np.zeros_like(w) for w in (field.emit, field.step, field.first)]
    loss = 0.0
    for r in range(b):
        n = sizes[r]
        a, z = np.empty((n, k)), np.zeros((n, k))
        a[0] = s[r, 0] + field.first
        for i in range(1, n):
            a[i] = _logsum(a[i - 1][:, None] + field.step, 0) + s[r, i]
        for i in range(n - 2, -1, -1):
            z[i] = _logsum(field.step + (s[r, i + 1] + z[i + 1])[None], 1)
        whole = _logsum(a[-1], 0)
        p = np.exp(a + z - whole)
        p[np.arange(n), y[r, :n]] -= 1
        for c in range(3):
            np.add.at(g[0], f[r, :n, c], p)
        g[2] += p[0]
        loss += whole - field.first[y[r, 0]] - s[r, np.arange(n), y[r, :n]].sum()
        if n > 1:
            pair = np.exp(a[:-1, :, None] + field.step + (s[r, 1:n] + z[1:])[:, None, :] - whole)
            g[1] += pair.sum(0)
            np.add.at(g[1], (y[r, : n - 1], y[r, 1:n]), -1)
            loss -= field.step[y[r, : n - 1], y[r, 1:n]].sum()
    return loss, g


def train(labelled: str = LABELLED, rounds: int = 60, rate: float = 0.25, decay: float = 0.02) -> Field:
    """A field from labelled lines, by Adam on all of them at once."""
    lines = []
    for line in labelled.strip().splitlines():
        words = [w.rsplit("/", 1) if w.rpartition("/")[2] in LABELS else [w, "O"] for w in line.split()]
        lines.append(([_PLACE[shape(w)] for w, _ in words], [LABELS.index(x) for _, x in words]))
    sizes = np.array([len(x) for x, _ in lines])
    x, y = np.full((len(lines), sizes.max()), NO_WORD), np.zeros((len(lines), sizes.max()), int)
    for k, (a, b) in enumerate(lines):
        x[k, : len(a)], y[k, : len(b)] = a, b
    field = Field()
    weights = [field.emit, field.step, field.first]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for step in range(1, rounds + 1):
        for w, g, m, s in zip(weights, loss_and_gradients(field, x, y, sizes)[1], first, second):
            g = g + decay * w
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    field.step[:, [k for k, n in enumerate(LABELS) if n[0] == "I"]] += np.array([[0.0 if a[1:] == b[1:] and a != "O" else -1e4 for b in LABELS if b[0] == "I"] for a in LABELS])
    field.first[[k for k, n in enumerate(LABELS) if n[0] == "I"]] = -1e4
    return field


RUN, LONGEST, ROWS = 64, 256, 8192  # words of a run, and at most; runs that are decoded at once
_WORD = re.compile(r"\S+")


def runs(shapes: bytes) -> Iterator[tuple[int, int]]:
    """Where a text is cut: every RUN words, or at the next two plain words, LONGEST words at most."""
    at, n = 0, len(shapes)
    while at < n:
        end = min(n, at + RUN)
        while end < min(n, at + LONGEST) and (shapes[end - 1] or shapes[end]):
            end += 1
        yield at, end
        at = end


def sound(kind: int, text: str) -> bool:
    """Whether a field's span holds what its kind needs: labels alone don't make an address of any host name."""
    digits = _NOT_DIGITS.sub("", text)
    if kind == 0:
        return bool(re.search(r"@|[\[(]at[\])]", text, re.IGNORECASE))
    if kind == 1:
        return bool(_IP.fullmatch(text))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def added_spans(text: str, marked: list[tuple[int, int]], base: list[Span]) -> list[Span]:
    """The field's sound spans that touch no base span. marked: (place of a word, its label), by place."""
    words = {}
    wanted = {k for k, _ in marked}
    last = max(wanted)
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            words[k] = m.span()
        if k == last:
            break
    groups: list[list[int]] = []
    for k, label in marked:
        kind = (label - 1) // 2
        if label % 2 or not groups or groups[-1][0] != kind or groups[-1][2] != k - 1:
            groups.append([kind, k, k])
        else:
            groups[-1][2] = k
    out = []
    for kind, a, b in groups:
        start, end = words[a][0], words[b][1]
        while start < end and not (text[start].isalnum() or kind == 3 and text[start] in "(+"):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if start < end and sound(kind, text[start:end]) and all(end <= s or e <= start for s, _, e in base):
            out.append((start, kind, end))
    return out


def text_spans(field: Field, texts: list[str], shapes: Recent) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text."""
    marks: list[list[tuple[int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not held:
            return
        t = max(len(s) for _, _, s in held)
        x = np.frombuffer(b"".join(s.ljust(t, bytes([NO_WORD])) for _, _, s in held), np.uint8).reshape(-1, t)
        y = field.decode(x)
        for r, at in np.argwhere((y != 0) & (x != NO_WORD)):
            k, start, _ = held[r]
            marks[k].append((start + int(at), int(y[r, at])))
        held.clear()

    wide: list[tuple[int, int, bytes]] = []
    for k, text in enumerate(texts):
        own = bytes(map(shapes.__getitem__, text.split()))
        for a, b in runs(own):
            (held if b - a <= RUN else wide).append((k, a, own[a:b]))
            if len(held) >= ROWS:
                flush()
    flush()
    for at in range(0, len(wide), 1024):
        held[:] = wide[at : at + 1024]
        flush()
    out = []
    for text, mark in zip(texts, marks):
        base = base_spans(text)
        out.append((base, sorted(base + added_spans(text, sorted(mark), base)) if mark else base))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _groups(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for i, text in pairs_of(parts):
        ids.append(i)
        texts.append(text)
        held += len(text)
        if held >= 4_000_000 or len(ids) >= 8192:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts and digest of the base spans, and all spans as text, of each row."""
    field = train()
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for ids, texts in _groups(parts):
                for i, (base, every) in zip(ids, text_spans(field, texts, for_worker(("shapes",), shape_places))):
                    counts = (sum(s[1] == k for s in base) for k in range(len(KINDS)))
                    yield i, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)

        yield from batches(rows(), schema)

    return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """text with each span, or each group of spans that overlap, replaced by its first kind in angle brackets."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with personal data in text_col masked; null texts stay null."""
    short_batches(docs.sparkSession)
    field, at, schema = train(), docs.columns.index(text_col), docs.schema

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, 2048):
                piece = part.slice(start, 2048)
                texts = piece.column(at).to_pylist()
                found = text_spans(field, [t or "" for t in texts], for_worker(("shapes",), shape_places))
                new = [t if t is None or not every else masked(t, every) for t, (_, every) in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([pa.array(new, piece.schema.field(at).type) if k == at else c for k, c in enumerate(piece.columns)], schema=piece.schema)

    return docs.mapInArrow(run, schema)
