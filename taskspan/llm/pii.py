"""Personal data: base patterns, and spans that a character tagger adds to them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskspan.llm import text as tx
from taskspan.llm.columns import apart
from taskspan.llm.tagger import Tagger

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48  # characters
TRAINING_WINDOWS = 2_000  # windows with digits or @ that the tagger is fitted to, at most
TRAINING_TEXTS = 50_000  # texts that they are looked for in, about
HIDDEN, STEPS, BATCH = 12, 300, 48
SEED = 3
WINDOWS_TOGETHER = 1_024  # windows decoded at a time
TAGS = 1 + 2 * len(KINDS)  # none, then first and other characters of each kind

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a pattern that starts with a run of digits can only start where the run does
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

#: What the tagger sees of a character: letters without case, digits alike, signs one by one.
_SIGNS = " \n@.-_+%()[]/:,;=#*&$!|'\""
_SYMBOLS = {c: 3 + k for k, c in enumerate(_SIGNS)} | {c: 2 for c in "0123456789"} | {
    c: 3 + len(_SIGNS) + (ord(c) | 32) - 97 for c in
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SYMBOLS = 3 + len(_SIGNS) + 26  # 0: other characters, 1: beyond the text, 2: digits
_CODE = np.zeros(128, np.uint8)
for _c, _s in _SYMBOLS.items():
    _CODE[ord(_c)] = _s

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind and start; offsets are code points."""
    spans = [("email", s, e) for s, e in emails(text)]
    spans += [("ip", *m.span()) for m in _IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], 0).astype(np.uint8)


def windows(coded: np.ndarray) -> np.ndarray:
    """Starts of the overlapping windows that hold a digit or an @; no kind can do without."""
    marks = np.append(0, np.cumsum((coded == 2) | (coded == _SYMBOLS["@"])))
    starts = np.arange(0, max(len(coded) - STRIDE, 1), STRIDE)
    return starts[marks[np.minimum(starts + WINDOW, len(coded))] > marks[starts]]


def cut_out(coded: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.append(coded, np.ones(WINDOW, np.uint8))
    return padded[starts[:, None] + np.arange(WINDOW)]


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.uint8)
    for kind, start, end in reversed(spans):
        first = 1 + 2 * KINDS.index(kind)
        tags[start:end] = first + 1
        tags[start] = first
    return tags


def plausible(kind: str, found: str) -> bool:
    """Whether a tagged string can be of its kind once odd separators are taken out."""
    digits = _NO_DIGIT.sub("", found)
    if kind == "email":
        bare = re.sub(r"[\s()\[\]]+", "", found)
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", bare))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return 8 <= len(digits) <= 15 and len(re.findall(r"[0-9]+", found)) >= 3


def reconciled(length: int, starts: np.ndarray, tags: np.ndarray) -> Iterator[Span]:
    """Spans from overlapping windows: a character's tag is that of the window it is most central in,
    and spans run across the seams."""
    whole = np.zeros(length + 2 * WINDOW, np.int8)
    depth = np.full(length + 2 * WINDOW, -1, np.int16)
    own = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.int16)
    for start, row in zip(starts.tolist(), tags):
        part = slice(start, start + WINDOW)
        better = own > depth[part]
        whole[part][better] = row[better]
        depth[part][better] = own[better]
    whole = whole[:length]
    kind = (whole + 1) // 2
    begins = (kind > 0) & (np.append(0, kind[:-1]) != kind) | (kind > 0) & (whole % 2 == 1)
    for start in np.flatnonzero(begins).tolist():
        end = start + 1
        while end < length and kind[end] == kind[start] and not begins[end]:
            end += 1
        yield KINDS[kind[start] - 1], start, end


def added_spans(text: str, base: list[Span], found: Iterator[Span]) -> list[Span]:
    """Tagged spans that are plausible and touch no base span, without blanks at their ends."""
    taken = sorted((s, e) for _, s, e in base)
    out = []
    for kind, start, end in found:
        piece = text[start:end]
        start += len(piece) - len(piece.lstrip(" \n.,;:-"))
        end -= len(piece) - len(piece.rstrip(" \n.,;:-"))
        if start < end and not any(s < end and start < e for s, e in taken) and plausible(
                kind, text[start:end]):
            out.append((kind, start, end))
    return out


def variant(text: str, spans: list[Span], draw: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with some spans written in ways the base patterns miss, and where they are then."""
    pieces, out, at, size = [], [], 0, 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start < at:
            continue
        value = text[start:end]
        if draw.random() < 0.5:
            digits = _NO_DIGIT.sub("", value)
            gap = " ./-"[draw.integers(4)]
            if kind == "email":
                value = value.replace("@", (" @ ", "(@)", "[@]", "@ ")[draw.integers(4)])
            elif kind == "ip":
                value = value.replace(".", (" . ", ". ", "-", " .")[draw.integers(4)])
            elif kind == "card":
                value = (". ", "/", ".", " - ")[draw.integers(4)].join(
                    digits[k:k + 4] for k in range(0, len(digits), 4))
            else:
                value = f"({digits[1:4]}) {digits[4:7]}{gap}{digits[7:]}" if draw.random() < 0.5 else (
                    gap.join((digits[1:4], digits[4:7], digits[7:])))
        pieces += [text[at:start], value]
        size += start - at
        out.append((kind, size, size + len(value)))
        size += len(value)
        at = end
    return "".join([*pieces, text[at:]]), out


def training_rows(docs: DataFrame, most: int) -> list:
    """Pieces of text around windows with a digit or an @, as (text, kinds, starts, ends); at most
    `most`, the ones with the smallest hash, of a bounded sample of the texts drawn by hash."""
    reach = 2 * WINDOW
    share = min(1.0, TRAINING_TEXTS / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in marked_texts(batch.column(0)).values():
                coded = symbols(text)
                spans = base_spans(text)
                for start in windows(coded)[::2].tolist():
                    low, high = max(0, start - WINDOW // 2), start + reach
                    near = [(k, s - low, e - low) for k, s, e in spans if s >= low and e <= high]
                    out.append((text[low:high], [KINDS.index(k) for k, _, _ in near],
                                [s for _, s, _ in near], [e for _, _, e in near]))
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in out], pa.string()),
                *(pa.array([x[k] for x in out], pa.list_(pa.int64())) for k in (1, 2, 3))],
                ["text", "kinds", "starts", "ends"])

    found = docs.filter(drawn).select("text").mapInArrow(
        pick, "text string, kinds array<long>, starts array<long>, ends array<long>")
    return found.withColumn("h", F.xxhash64("text")).orderBy("h", "text").limit(most).collect()


def fit(docs: DataFrame, most: int = TRAINING_WINDOWS, steps: int = STEPS) -> Tagger:
    """A tagger fitted on the driver to a bounded sample; the labels are the base spans, half of
    them written in other ways. Without a marked text the tagger is None and adds nothing."""
    draw = np.random.default_rng(SEED)
    x, y = [], []
    for row in training_rows(docs, most):
        spans = [(KINDS[k], s, e) for k, s, e in zip(row["kinds"], row["starts"], row["ends"])]
        text, spans = variant(row["text"], spans, draw)
        coded, tags = symbols(text), tags_of(len(text), spans)
        start = int(draw.integers(0, max(1, len(coded) - WINDOW + 1)))
        x.append(cut_out(coded, np.array([start]))[0])
        y.append(np.append(tags, np.zeros(WINDOW, np.uint8))[start:start + WINDOW])
    if not x:
        return None
    tagger = Tagger(SYMBOLS, TAGS, HIDDEN, SEED)
    tagger.fit(np.array(x, np.int64), np.array(y, np.int64), steps, BATCH, seed=SEED)
    return tagger


def marked_texts(column: pa.Array) -> dict[int, str]:
    """The texts with a digit or an @, by row; only they are decoded."""
    data, offsets = tx.flat(column)
    marks = np.append(0, np.cumsum(_MARKS[data], dtype=np.int64))
    hit = np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])
    return {int(r): data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in hit}


_MARKS = tx.classes("0123456789@") > 0


def detect(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """`docs` (with a column text) with base and added, arrays of (kind, start, end), for its text.

    Offsets count code points, ends are exclusive; base spans stand by kind, then start. Every text
    is read whole. Null and empty texts have no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    text = docs.columns.index("text")
    rest = [k for k in range(len(docs.columns)) if k != text]
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()),
                                     T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    kinds = T.StructType([*(docs.schema.fields[k] for k in rest), T.StructField("base", span),
                          T.StructField("added", span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def tagged(texts: list[tuple[int, str]]) -> Iterator[tuple[int, list[Span], list[Span]]]:
        """Base and added spans of texts whose windows are decoded together."""
        model, cuts = shared.value, []
        for _, value in texts:
            coded = symbols(value)
            starts = windows(coded)
            cuts.append((len(coded), starts, cut_out(coded, starts)))
        every = np.concatenate([c[2] for c in cuts])
        tags = np.zeros(every.shape, np.int8)
        for at in range(0, len(every) if model else 0, WINDOWS_TOGETHER):
            tags[at:at + WINDOWS_TOGETHER] = model.decode(every[at:at + WINDOWS_TOGETHER])
        at = 0
        for (row, value), (length, starts, cut) in zip(texts, cuts):
            base = base_spans(value)
            own = tags[at:at + len(cut)]
            at += len(cut)
            yield row, base, added_spans(value, base, reconciled(length, starts, own))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [[]] * batch.num_rows, [[]] * batch.num_rows
            group, size = [], 0
            texts = list(marked_texts(batch.column(text)).items())
            for k, item in enumerate(texts):
                group.append(item)
                size += len(item[1])
                if size > tx.SLICE_BYTES or k == len(texts) - 1:
                    for row, own, more in tagged(group):
                        base[row], added[row] = own, more
                    group, size = [], 0
            def rows(spans: list[list[Span]]) -> pa.Array:
                return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in spans], arrow)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in rest), rows(base), rows(added)], names=kinds.names)

    return docs.mapInArrow(find, kinds)


def joined(spans: str):
    """kind:start:end of an array of spans, by kind in the order of KINDS, then start."""
    order = F.transform(spans, lambda s: F.struct(
        F.array_position(F.array(*(F.lit(k) for k in KINDS)), s["kind"]).alias("k"),
        s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(
        ":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, counts of base spans by kind, the hash of the base spans, all spans, and how many of
    them the tagger added. Repeated rows get equal results; null doc_ids and extra columns are fine."""
    found = detect(docs.select("doc_id", "text"), fit(docs, **settings))
    every = found.withColumn("every", F.concat("base", "added"))
    kinds = F.transform("base", lambda s: s["kind"])
    return every.select(
        "doc_id", *((F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
                    for k in KINDS),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"),
        F.size("added").cast("long").alias("n_added"))


def redacted(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` with every found span replaced by its kind in angle brackets."""
    free = apart(docs, "text").withColumn("whole", F.col("text"))
    found = detect(free, fit(docs, **settings))
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    step = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
                       lambda a, s: F.when(s["s"] < a["at"], a).otherwise(F.struct(
                           F.concat(a["out"], F.substring("whole", (a["at"] + 1).cast("int"), (s["s"] - a["at"]).cast("int")),
                                    F.lit("<"), s["k"], F.lit(">")).alias("out"), s["e"].alias("at"))))
    done = found.withColumn("step", step)
    clean = F.when(F.col("whole").isNotNull(), F.concat(
        F.col("step.out"), F.expr("substring(whole, cast(step.at + 1 as int))")))
    return done.select(*((clean if n == "text" else F.col(n)).alias(c)
                         for n, c in zip(free.columns, docs.columns)))
