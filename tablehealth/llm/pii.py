"""Personal data: patterns with checks, and a character tagger for spellings the patterns miss.

The tagger (``tagger.Tagger``) learns from spans that the patterns label in a bounded sample of windows, half of
them rewritten into looser spellings. It reads overlapping windows around every digit, at sign and
spelled-out at sign of a text, as nothing it learns lacks all three. The scores of overlapping windows
are averaged and each stretch is decoded as one sequence. What it finds has to pass the same checks of digits as
the patterns' matches, and adds to them only where they found nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehealth.llm.lines import quoted, text_of, unused
from tablehealth.llm.tagger import Tagger
from tablehealth.llm.tasks import ship, slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 150
WINDOW = 96
STRIDE = 64
REACH = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[] ?(?:at|AT) ?[)\]]")
_LONG_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if at % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, at sign and domain; looked for from the at signs, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        while domain and start > end and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            end = domain.end()
            yield start, end
        at = text.find("@", at + 1)


def valid(kind: int, text: str) -> bool:
    """The checks that a match of this kind has to pass, whatever its spelling."""
    digits = digits_of(text)
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 8 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` of the patterns' matches that pass, by kind and start."""
    found: list[Span] = [(0, a, b) for a, b in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [
            (kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())
        ]
    return found


CLASSES = 64


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of each code point below 256; the last entry stands for all others.

    Digits are one class, letters are told apart without case, ASCII marks are their own.
    """
    table = np.full(257, 1, np.int64)
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            table[c] = 2
        elif ch.isalpha():
            table[c] = 3 + ord(ch.lower()) - 97
        elif ch.isspace():
            table[c] = 29 if ch == " " else 30
        elif 33 <= c < 127:
            table[c] = 31 + (c - 33 if c < 48 else c - 43 if c < 65 else c - 69 if c < 97 else c - 95)
    return np.minimum(table, CLASSES - 1)


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _class_table()[np.minimum(points, 256)]


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within ``REACH`` of a trigger, merged where they touch."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_EDGE = np.minimum(np.arange(WINDOW) + 1, np.arange(WINDOW, 0, -1)).astype(np.float32)


def tag(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """What the tagger finds in each text: ``(kind, start, end)``, not yet checked."""
    jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    out: list[list[Span]] = [[] for _ in texts]
    chars = {i: classes_of(texts[i]) for i in {j[0] for j in jobs}}
    windows = [
        (k, w) for k, (_, a, b) in enumerate(jobs) for w in range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)
    ]
    score = [np.zeros((b - a, 2 * len(KINDS) + 1), np.float32) for _, a, b in jobs]
    weight = [np.zeros(b - a, np.float32) for _, a, b in jobs]
    for at in range(0, len(windows), 512):
        part = windows[at : at + 512]
        block = np.zeros((WINDOW, len(part)), np.int64)
        for col, (k, w) in enumerate(part):
            i, _, b = jobs[k]
            piece = chars[i][w : min(b, w + WINDOW)]
            block[: len(piece), col] = piece
        e = model.emissions(block)
        for col, (k, w) in enumerate(part):
            _, a, b = jobs[k]
            n = min(b, w + WINDOW) - w
            score[k][w - a : w - a + n] += e[:n, col] * _EDGE[:n, None]
            weight[k][w - a : w - a + n] += _EDGE[:n]
    for k, (i, a, _) in enumerate(jobs):
        labels = model.decode(score[k] / weight[k][:, None])
        start = None
        for at, label in enumerate([*labels.tolist(), 0]):
            if start is not None and (label == 0 or label % 2 or label != start[1] + 1):
                out[i].append((start[1] // 2, a + start[0], a + at))
                start = None
            if label % 2:
                start = (at, label)
    return out


def added_spans(text: str, tagged: list[Span], base: list[Span]) -> list[Span]:
    """The tagger's spans that pass the checks and touch none of the patterns' spans."""
    out = []
    for kind, start, end in tagged:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        part = text[start:end]
        whole = kind or bool(re.search(r"\w\W*(@|[(\[] ?at ?[)\]])\W*\w.*\w", part, re.I | re.S))
        if len(part) > 5 and whole and valid(kind, part):
            if not any(a < end and start < b for _, a, b in [*base, *out]):
                out.append((kind, start, end))
    return out


def find(model: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans and all spans, both by kind and start."""
    tagged = tag(model, texts) if model else [[] for _ in texts]
    out = []
    for text, more in zip(texts, tagged, strict=True):
        base = base_spans(text)
        out.append((base, sorted([*base, *added_spans(text, more, base)])))
    return out


def loosened(kind: int, text: str, rng: random.Random) -> str:
    """Another spelling of a span's text, which no pattern matches as a whole."""
    digits = digits_of(text)
    if kind == 0:
        local, _, domain = text.partition("@")
        at = rng.choice([" @ ", " (at) ", "[at]", " [at] ", "@ ", "(at)"])
        dot = rng.choice([".", ".", " . ", " [dot] ", "(dot)"])
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return text.replace(".", rng.choice([" . ", "[.]", ". ", " ."]))
    if kind == 2:
        by = rng.choice([".", "/", "  ", "_", " - "])
        return by.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, mid, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice(
        [f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"{area} {mid} {last}",
         f"00{digits[:-10]} {area} {mid} {last}", f"+{digits[:-10]}/{area}/{mid}/{last}"]
    )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with one labelled span each, and windows around other digits (kind -1)."""
    for batch in slices(batches):
        kind, before, span, after = [], [], [], []

        def add(k: int, text: str, a: int, b: int) -> None:
            kind.append(k)
            before.append(text[max(0, a - REACH) : a])
            span.append(text[a:b])
            after.append(text[b : b + REACH])

        for text in batch["text"].to_pylist():
            found = base_spans(text)
            for k, a, b in found:
                add(k, text, a, b)
            if not found:
                for m in re.finditer(r"\S*[0-9@]\S*", text):
                    if not _LONG_NUMBER.search(m.group()) and m.end() - m.start() <= WINDOW:
                        add(-1, text, m.start(), m.end())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), *(pa.array(x, pa.string()) for x in (before, span, after))],
            names=["kind", "before", "span", "after"],
        )


def labelled(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[int, str, str, str]]:
    """At most ``sample`` labelled windows of each kind, picked by their hash from all documents."""
    ship(docs.sparkSession)
    texts = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    found = texts.mapInArrow(_windows, "kind int, before string, span string, after string").distinct()
    pick = Window.partitionBy("kind").orderBy(F.xxhash64("before", "span", "after"), "span", "before", "after")
    rows = found.withColumn("at", F.row_number().over(pick)).where(F.col("at") <= sample).collect()
    return sorted((r["kind"], r["before"], r["span"], r["after"]) for r in rows)


def train(rows: list[tuple[int, str, str, str]], seed: int = 5) -> Tagger | None:
    """A tagger from labelled windows; none without a labelled span."""
    if not any(r[0] >= 0 for r in rows):
        return None
    rng = random.Random(seed)
    chars, gold = [], []
    for kind, before, span, after in rows:
        for loose in (False, True) if kind >= 0 else (False,):
            text = loosened(kind, span, rng) if loose else span
            left = before[len(before) - rng.randint(0, min(len(before), 44)) :] if before else ""
            whole = (left + text + after)[:WINDOW]
            row, labels = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
            row[: len(whole)] = classes_of(whole)
            if kind >= 0:
                labels[len(left) : len(left) + len(text)] = 2 * kind + 2
                labels[len(left) : len(left) + 1] = 2 * kind + 1
            for k, a, b in base_spans(before[len(before) - len(left) :]) if left else []:
                labels[a:b] = 2 * k + 2
                labels[a] = 2 * k + 1
            shift = len(left) + len(text)
            for k, a, b in base_spans(after):
                labels[shift + a : shift + b] = 2 * k + 2
                labels[shift + a : shift + a + 1] = 2 * k + 1
            chars.append(row)
            gold.append(labels)
    model = Tagger(CLASSES, 2 * len(KINDS) + 1)
    model.fit(np.array(chars), np.array(gold))
    return model


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _each(
    docs: DataFrame, names: dict[str, T.DataType], row: Callable[[str, list, list], tuple], model: Tagger | None
) -> DataFrame:
    """Columns made from each text and its spans: in place of those of that name, the others after them.

    Columns are told apart by their places, so they may be called anything. A null text is read as empty.
    """
    kept = [f for f in docs.schema.fields if f.name not in names]
    places = [f"c{k}" for k in range(len(kept))]
    made_names = [f"made{k}" for k in range(len(names))]
    types = {T.StringType(): pa.string(), T.LongType(): pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            made = [row(t, *s) for t, s in zip(texts, find(model, texts), strict=True)]
            columns = list(zip(*made, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[n] for n in places),
                    *(pa.array(list(c), types[t]) for c, t in zip(columns, names.values(), strict=True)),
                ],
                names=[*places, *made_names],
            )

    schema = T.StructType([
        *(T.StructField(n, f.dataType) for n, f in zip(places, kept, strict=True)),
        *(T.StructField(n, t) for n, t in zip(made_names, names.values(), strict=True)),
    ])
    given = [quoted(f.name).alias(n) for n, f in zip(places, kept, strict=True)]
    done = docs.select(*given, text_of().alias("text")).mapInArrow(run, schema)
    place_of = dict(zip([*(f.name for f in kept), *names], [*places, *made_names], strict=True))
    order = [n for n in docs.columns if n in place_of] + [n for n in names if n not in docs.columns]
    return done.select(*(F.col(place_of[n]) for n in order)).toDF(*order)


def spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, counts of the patterns' spans by kind, ``base_sha256`` and ``spans`` of every row.

    Reads ``doc_id`` and ``text``. A null or empty text has no spans. Repeated rows get equal rows; an empty
    table gives an empty result. Without a single labelled span in the table only patterns are used.
    """
    ship(docs.sparkSession)
    names = {f"n_{k}": T.LongType() for k in KINDS} | {
        "base_sha256": T.StringType(), "spans": T.StringType()
    }

    def row(text: str, base: list[Span], every: list[Span]) -> tuple:
        counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
        return (*counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(every))

    return _each(docs.select("doc_id", "text"), names, row, train(labelled(docs, sample))).drop("text")


def masked(text: str, every: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones by the first's."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in every):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All rows and columns of ``docs`` with personal data masked in ``text``.

    Reads ``text`` alone; other columns pass through, whatever they are called. A null text stays null, an empty one
    empty. Repeated rows are masked alike, an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    model = train(labelled(docs, sample))
    missing = unused(docs, "missing")
    held = docs.withColumn(missing, F.col("text").isNull())
    done = _each(held, {"text": T.StringType()}, lambda t, _, every: (masked(t, every),), model)
    text = F.when(~F.col(missing), F.col("text")).alias("text")
    return done.select(*(text if n == "text" else quoted(n) for n in docs.columns))
