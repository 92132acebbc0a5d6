"""Language of documents and of their lines (problem 10).

Method: language-bitmask n-gram filters.  One Bloom filter per language, bit-sliced:
slot j holds one word whose bit l says whether language l set slot j.  One lookup of an
n-gram ANDs the words of its slots and returns all languages that contain it.  Per line
and language the hits are counted (popcounts), each language's expected false positives
are taken off, and the greatest corrected count decides.

The filters are fitted on the correctly labelled reference sentences (at most
MAX_SENTENCES) and then on lines of about MAX_TRAINING labelled documents, whole ones, chosen
by a hash of their id, whose label the first filters confirm.  Executors set the bits of
their documents, and the words are combined with OR.  The number of slots follows from the
n-grams found: the least power of two that keeps the false positives of every language at
FALSE_RATE (at most MOST_SLOTS).  A word has as many 64-bit parts as the languages need.
Documents are scored in one pass of ``mapInArrow`` without any shuffle: counting
is vectorised over a batch, one row per document and line comes out.

Letters are folded (lower case, no accents), so stripped accents and shouting do not
matter; ids, figures, codes, markers and escapes are removed first.  Every n-gram votes
for the letter it ends on, so a line belongs to the language of most of its letters, and
a short quotation or a borrowed term is outvoted.

Defined results: null, empty, blank and wordless texts have no language and no line is
reported; such lines are still counted in the numbering; ties fall to the language that
comes first in the alphabet; lines end at line feeds only, a carriage return is blank.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import label
from tidemark.session import ship

SIZES = (2, 3, 4, 5)
HASHES = 3
#: False positives aimed at, per language and n-gram, and the slots there may be.
FALSE_RATE, MOST_SLOTS = 0.005, 1 << 22
#: Letters and corrected hits per letter a line needs to have a language.
LEAST_LETTERS, LEAST_SHARE = 4, 0.5
#: And by how much its language must lead: words that all languages use decide nothing.
LEAST_LEAD = 1.01
#: Bounds on what the filters are fitted on: reference sentences, and labelled documents in expectation.
MAX_SENTENCES, MAX_TRAINING = 100_000, 2_000
#: A line trains only where its best language beats the second by this factor.
TRAINING_MARGIN = 1.5

SLICE_CHARS = 500_000

#: What is taken out of a line first; no match spans lines.
_NOISE = re.compile(r"<\|[^|<>\n]{0,40}\|>|\\[a-zA-Z]|[!-/:-~]*+[0-9][!-~]*")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code point -> folded letter, 0 for anything that is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha() and not 0x1D400 <= cp < 0x1D800:  # mathematical letters are symbols
            base = unicodedata.normalize("NFD", ch)[0].lower()
            out[cp] = ord(base[0])
    for cp in range(0x300, 0x370):
        out[cp] = 0xFFFFFFFF  # combining marks vanish
    return out


def _letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with single gaps (0) between words, and the line of each."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    line = np.cumsum(cps == 10, dtype=np.int64)
    folded = _fold()[cps]
    keep = folded != 0xFFFFFFFF
    folded, line = folded[keep], line[keep]
    before = np.concatenate([np.zeros(1, np.uint32), folded[:-1]]) if len(folded) else folded
    keep = (folded != 0) | (before != 0)
    return folded[keep], line[keep]


def _all_grams(folded: np.ndarray, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, in order, hashes of the n-grams and the positions they end on; none ends in a gap.

    The hash of n letters goes on from that of the n - 1 before the last.
    """
    letters = folded.astype(np.uint64)
    solid = folded != 0
    h = np.full(len(letters) + 1, 0x632BE59B, dtype=np.uint64)  # not 0, which a leading gap would leave as it is
    for n in range(1, max(sizes) + 1):
        h = h[:-1] ^ letters[n - 1 :]
        h *= _MIX
        h ^= h >> np.uint64(29)
        if not len(h):
            break
        if n in sizes:
            ok = solid[n - 1 :]
            yield h[ok], np.flatnonzero(ok) + (n - 1)


def _grams(folded: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return next(_all_grams(folded, (n,)), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))


@dataclass(frozen=True)
class Filters:
    """Bit-sliced Bloom filters: ``words[slot]`` has bit l set if language l hit the slot."""

    langs: tuple[str, ...]
    words: np.ndarray  # slots x 64-bit parts
    false: np.ndarray  # false-positive rate per language

    @staticmethod
    def fit(samples: list[tuple[str, str]]) -> Filters:
        langs = tuple(sorted({lang for lang, _ in samples}))
        words = _blank(len(langs))
        _mark_all(words, langs, samples)
        return Filters.of(langs, words)

    @staticmethod
    def of(langs: tuple[str, ...], words: np.ndarray) -> Filters:
        """Folds the words to the fewest slots that keep FALSE_RATE: slots are taken modulo their number."""
        fill = _fill(words, len(langs))
        while len(words) > 1024:
            half = words[: len(words) // 2] | words[len(words) // 2 :]
            filled = _fill(half, len(langs))
            if (filled**HASHES).max(initial=0) > FALSE_RATE:
                break
            words, fill = half, filled
        return Filters(langs, words, fill**HASHES)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits: one word each, or one row of words."""
        out = None
        for slot in _slots(h, len(self.words)):
            hit = self.words.take(slot, axis=0)
            out = hit if out is None else out & hit
        return out[:, 0] if out.shape[1] == 1 else out

    def score(self, folded: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
        """Corrected popcounts, lines x languages, averaged over the n-gram sizes."""
        total = np.zeros((lines, len(self.langs)))
        for h, end in _all_grams(folded):
            if not len(h):
                continue
            at = line[end]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            held = self.masks(h).astype("<u8").reshape(len(h), -1).view(np.uint8)
            bits = np.unpackbits(held[:, : self.width], axis=1, bitorder="little", count=len(self.langs))
            hits = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            asked = np.diff(starts, append=len(at))[:, None]
            total[at[starts]] += np.maximum(0, (hits - asked * self.false) / (1 - self.false))
        return total / len(SIZES)

    @property
    def width(self) -> int:
        return -(-len(self.langs) // 8)


def _blank(languages: int) -> np.ndarray:
    return np.zeros((MOST_SLOTS, max(1, -(-languages // 64))), dtype=np.uint64)


def _mark(words: np.ndarray, bit: int, text: str) -> None:
    """Set a language's bit in the slots of all n-grams of a text."""
    folded, _ = _letters(_NOISE.sub(" ", text))
    for h, _ in _all_grams(folded):
        for slot in _slots(h, len(words)):
            words[slot, bit // 64] |= np.uint64(1 << bit % 64)


def _mark_all(words: np.ndarray, langs: tuple[str, ...], samples: list[tuple[str, str]]) -> None:
    for bit, lang in enumerate(langs):
        _mark(words, bit, "\n".join(t for g, t in samples if g == lang))


def _fill(words: np.ndarray, languages: int) -> np.ndarray:
    """The share of slots each language has set."""
    return np.array([np.count_nonzero(words[:, b // 64] & np.uint64(1 << b % 64)) / len(words) for b in range(languages)])


def _slots(h: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((a + np.uint64(k) * b) & np.uint64(slots - 1)).astype(np.int64)


#: Quotations do not train: they may be in another language.  Borrowed terms do, under
#: every language that borrows them, and so speak for none.
_ASIDE = re.compile(r"\"[^\"]*\"")


def fit_filters(samples: DataFrame, documents: DataFrame | None = None, aliases: dict[str, str] | None = None, max_training: int = MAX_TRAINING) -> Filters:
    """``samples``: lang, sample_text; ``documents``: doc_id, text, lang (a label)."""
    rows = samples.select(label("lang").alias("lang"), "sample_text").filter("lang is not null and sample_text is not null").orderBy("lang", "sample_text").limit(MAX_SENTENCES).collect()
    known = [(r[0], r[1]) for r in rows]
    first = Filters.fit(known)
    if documents is None or not aliases or not known:
        return first
    named = documents.select("text", label("lang").alias("lang"), F.xxhash64("doc_id").alias("h")).filter(F.col("lang").isin(list(aliases)) & F.col("text").isNotNull())
    # A hash below a threshold: the same documents every time, about max_training of them.
    share = min(1.0, max_training / max(1, named.count()))
    chosen = named.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).select("text", "lang")
    ship(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((first, aliases))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = held.value
        words = _blank(len(model.langs))
        for batch in batches:
            for text, tag in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                if names[tag] in model.langs:
                    bit = model.langs.index(names[tag])
                    lines = _confirmed(text, bit, model)
                    if lines:
                        _mark(words, bit, "\n".join(lines))
        for part in range(words.shape[1]):
            at = np.flatnonzero(words[:, part])
            yield pa.record_batch([pa.array(at * words.shape[1] + part), pa.array(words[at, part].view(np.int64))], ["place", "bits"])

    # At most MOST_SLOTS words come back.
    marked = chosen.mapInArrow(mark, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = _blank(len(first.langs))
    words.reshape(-1)[marked["place"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
    _mark_all(words, first.langs, known)
    return Filters.of(first.langs, words)


def _confirmed(text: str, bit: int, model: Filters) -> list[str]:
    """The lines of a text that the filters find, by TRAINING_MARGIN, to be in the language."""
    lines = [_ASIDE.sub(" ", x) for x in text.split("\n")]
    folded, line = _letters(_NOISE.sub(" ", "\n".join(lines)))
    score = model.score(folded, line, len(lines))
    own, rest = score[:, bit], np.delete(score, bit, axis=1).max(axis=1, initial=0)
    return [lines[i] for i in np.flatnonzero((own > 0) & (own >= TRAINING_MARGIN * rest))]


def judge(texts: list[str | None], filters: Filters) -> list[list[tuple[int, str, float, int]]]:
    """Per text the lines that have a language: number, language, confidence, letters."""
    out, at = [], 0
    while at < len(texts):  # in slices, so that the arrays stay small whatever the batch
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= SLICE_CHARS):
            chars += len(texts[end] or "")
            end += 1
        out += _judge(texts[at:end], filters)
        at = end
    return out


def _judge(texts: list[str | None], filters: Filters) -> list[list[tuple[int, str, float, int]]]:
    numbers, clean, owner = [], [], []
    for i, text in enumerate(texts):
        no = 0
        for part in (text or "").split("\n"):
            if part.strip():
                no += 1
                clean.append(part)
                owner.append(i)
                numbers.append(no)
    out: list[list[tuple[int, str, float, int]]] = [[] for _ in texts]
    if not clean:
        return out
    folded, line = _letters(_NOISE.sub(" ", "\n".join(clean)))
    letters = np.bincount(line[folded != 0], minlength=len(clean))
    score = filters.score(folded, line, len(clean))
    best = score.argmax(axis=1)
    top = score[np.arange(len(clean)), best]
    second = np.partition(score, -2, axis=1)[:, -2] if score.shape[1] > 1 else np.zeros(len(clean))
    total = top + second
    good = (letters >= LEAST_LETTERS) & (top >= LEAST_SHARE * letters) & (top > second * LEAST_LEAD)
    for j in np.flatnonzero(good):
        out[owner[j]].append((numbers[j], filters.langs[best[j]], float(top[j] / total[j]), int(letters[j])))
    return out


def identify(documents: DataFrame, filters: Filters, aliases: dict[str, str]) -> DataFrame:
    """One row per document: its own language, what its label names, and the lines behind it.

    ``doc_id, lang, confidence, named, labelled, mixed, lines`` with ``lines`` an array of
    ``seg_no, lang, confidence``.  The document's language is that of most of its letters;
    its confidence is the share of those letters, times the mean confidence of their lines.
    """
    ship(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((filters, aliases))
    line = "array<struct<seg_no:int,lang:string,confidence:double>>"
    schema = f"doc_id long, lang string, confidence double, named string, labelled string, mixed boolean, lines {line}"
    segment = pa.list_(pa.struct([("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_(), segment]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, rows = whole.slice(at, 512), []
                for doc, tag, found in zip(batch["doc_id"].to_pylist(), batch["lang"].to_pylist(), judge(batch["text"].to_pylist(), model), strict=True):
                    size, sure = {}, {}
                    for _, lang, confidence, letters in found:
                        size[lang] = size.get(lang, 0) + letters
                        sure[lang] = sure.get(lang, 0.0) + letters * confidence
                    best = min(size, key=lambda g: (-size[g], g)) if size else None
                    confidence = sure[best] / sum(size.values()) if best else 0.0
                    rows.append((doc, best, confidence, names.get(tag) if tag else None, tag, len(size) > 1, [{"seg_no": n, "lang": g, "confidence": c} for n, g, c, _ in found]))
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "lang", "confidence", "named", "labelled", "mixed", "lines"])

    return documents.select("doc_id", "text", label("lang").alias("lang")).mapInArrow(run, schema)
