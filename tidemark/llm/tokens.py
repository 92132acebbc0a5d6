"""Encoding a corpus with a public byte-pair tokenizer (problem 8).

Method: content-defined chunk reuse.  A rolling hash cuts texts where their content says
so, so equal passages give equal chunks in whatever document they stand.  Chunks that
occur more than once in the corpus are encoded once; documents are put together from
those and from the text between them, and every join is repaired: the last pieces before
it are encoded again together with the chunk behind it until a piece boundary agrees with
one the chunk had on its own.  From there on the chunk's own ids are exact, because the
pattern that splits a text into pieces looks at nothing before the piece.  Where nothing
agrees, the whole chunk is encoded again, and again with what follows, until something
does.

Why three pieces are held back at an end: a piece that touches the end of a chunk may
grow, white space there may give one blank away, and a contraction ('ll) may swallow a
letter behind an apostrophe, which is the piece before the last.

Scale: chunks are counted by a 64-bit hash of their content, combined map-side, so the
first shuffle has a few bytes a chunk.  Hashes counted twice set bits of a filter of fixed
size (FILTER_BITS); only chunks it lets through are shuffled with their text, made
distinct, encoded and joined back by their text, never by the hash alone: equal hashes of
different texts, and false positives of the filter, cost time but change nothing.  A
chunk that a third of all documents share is split by AQE's skew join.  A document's text
meets its encoded chunks in a stream sorted by document and position: a task holds one
text and the chunks of that text.  Held-back text that grows without agreement is scanned
again only after it has doubled, so a text without any boundary costs n log n.

Beyond some ten million distinct repeated chunks the filter lets most chunks through: the
ids stay exact, and more chunk text is shuffled.

Texts with code points that Unicode has not assigned are never cut and are encoded whole:
libraries of different age disagree on whether those are letters, and so on where pieces
end.

Defined results: null and empty texts have an empty list; marker strings are ordinary
text; every row gives a row, a repeated row a repeated one; rows that share a ``doc_id``
but not their text are told apart by the hash of the text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of the public vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Rolling window, mean and greatest length of chunks, in characters.
WINDOW, MEAN, GREATEST = 16, 64, 4096
#: Pieces held back at the end of a chunk, and boundaries kept at its start.
HELD, HEAD = 3, 4
#: A repaired join encodes up to HELD + HEAD pieces again, some thirty characters: a chunk
#: no longer than that has nothing to give and stays with the text around it.
LEAST = 32
#: Bits of the filter of repeated chunks, and characters cut at a time.
FILTER_BITS, SLICE_CHARS = 1 << 26, 1 << 19

_SPACE = regex.compile(r"\s")


@lru_cache(4)
def encoder(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(ranks_path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _pieces() -> regex.Pattern:
    return regex.compile(PATTERN)


#: Which code points are unassigned, filled in a block of 256 at a time when one is met.
_UNASSIGNED, _KNOWN = np.zeros(0x110000, dtype=bool), np.zeros(0x1100, dtype=bool)


def _unassigned(cps: np.ndarray) -> np.ndarray:
    """Where ``cps`` holds a code point that Unicode has not assigned."""
    met = np.bincount(cps >> np.uint32(8), minlength=0x1100) > 0
    for block in np.flatnonzero(met & ~_KNOWN).tolist():
        _UNASSIGNED[block * 256 : block * 256 + 256] = [unicodedata.category(chr(cp)) == "Cn" for cp in range(block * 256, block * 256 + 256)]
        _KNOWN[block] = True
    return np.flatnonzero(_UNASSIGNED[cps])


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, modulo 2^64."""
    factor = 0x9E3779B97F4A7C15
    both = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SLICE_CHARS, f, np.uint64)])) for f in (factor, pow(factor, -1, 1 << 64))]
    return both[0], both[1]


def _joined(one: np.ndarray, width: int, two: np.ndarray, factor: int) -> np.ndarray:
    """Hashes of ranges of ``width`` characters followed by those of the ranges behind; ``factor`` belongs to the latter."""
    n = min(len(one), len(two) - width)
    out = one[:n] * np.uint32(factor)
    out += two[width : width + n]
    return out


def _rolling(cps: np.ndarray) -> np.ndarray:
    """Ends of the windows whose hash says so."""
    if len(cps) < WINDOW:
        return np.zeros(0, np.int64)
    # The hash of a + b characters from those of a and of b behind them: as many steps as WINDOW has bits.
    h, width, power, span, factor = None, 0, cps, 1, 0x01000193
    while True:
        if WINDOW & span:
            h, width = (power, span) if h is None else (_joined(h, width, power, factor), width + span)
        if 2 * span > WINDOW:
            break
        power, span, factor = _joined(power, span, power, factor), 2 * span, factor * factor & 0xFFFFFFFF
    h = h.copy() if h is cps else h
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return np.flatnonzero((h >> np.uint32(8)) % np.uint32(MEAN) == 0) + WINDOW


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of all texts, in one pass over their characters: text number, start, end, hash.

    A chunk ends where the hash of the last WINDOW characters says so.  Empty texts have none.
    """
    cps = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    offset = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)])
    found = _rolling(cps)
    of = np.searchsorted(offset, found - 1, side="right") - 1
    odd = np.unique(np.searchsorted(offset, _unassigned(cps), side="right") - 1)
    found = found[(found - WINDOW >= offset[of]) & ~np.isin(of, odd)]
    ends = np.union1d(found, offset[1:])
    ends = ends[ends > 0]
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    of = np.searchsorted(offset, starts, side="right") - 1
    far = np.flatnonzero((ends - starts > GREATEST) & ~np.isin(of, odd))
    if len(far):
        ends = np.union1d(ends, np.concatenate([np.arange(starts[i] + GREATEST, ends[i], GREATEST) for i in far]))
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        of = np.searchsorted(offset, starts, side="right") - 1
    return of, starts - offset[of], ends - offset[of], _content_hash(cps, starts, ends)


def _content_hash(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of characters that does not depend on where it stands."""
    out = np.zeros(len(starts), np.uint64)
    power, inverse = _powers()
    mixed = (cps.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    lo = 0
    while lo < len(starts):  # blocks that the tables of powers cover; a longer range is a block of its own
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_CHARS, side="right")))
        span = int(ends[hi - 1] - base)
        if span >= len(power):
            out[lo] = np.frombuffer(hashlib.blake2b(mixed[base : base + span].tobytes(), digest_size=8).digest(), dtype="<u8")[0]
            lo = hi
            continue
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[base : base + span] * power[:span])])
        out[lo:hi] = (sums[ends[lo:hi] - base] - sums[starts[lo:hi] - base]) * inverse[starts[lo:hi] - base]
        lo = hi
    out ^= (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def cut_points(text: str) -> list[int]:
    """Ends of the chunks of one text."""
    return cut([text])[2].tolist()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: what Python holds does not grow with the Arrow batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Some rows at a time, and their texts: few enough for SLICE_CHARS, or one."""
    for batch in _slices(batches):
        texts, at = batch["text"].to_pylist(), 0
        while at < len(texts):
            end, chars = at + 1, len(texts[at])
            while end < len(texts) and chars + len(texts[end]) <= SLICE_CHARS:
                chars += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _texts(batches):
        _, starts, ends, h = cut(texts)
        yield pa.record_batch([pa.array(h[ends - starts >= LEAST].view(np.int64))], ["h"])


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def repeated_filter(hashes: DataFrame) -> np.ndarray:
    """A filter of fixed size that lets every ``h`` through which occurs more than once.

    Counting and setting bits is distributed; the words that are not zero, at most
    FILTER_BITS / 64 of them, come to the driver.
    """
    twice = hashes.groupBy("h").count().filter("count > 1")
    mask = FILTER_BITS - 1
    slot = F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)))).alias("slot")
    words = twice.select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    if found.num_rows:
        out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def lets_through(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = _slots(h, 64 * len(words))
    bit = np.uint64(1)
    return ((words[one >> 6] >> (one & 63).astype(np.uint64)) & (words[two >> 6] >> (two & 63).astype(np.uint64)) & bit).astype(bool)


def encode_chunk(chunk: str, enc: tiktoken.Encoding) -> tuple[list[int], list[int], int, int]:
    """Ids; boundaries at the start as (characters, ids) pairs, flat; characters and ids before the held-back end."""
    ids = enc.encode_ordinary(chunk)
    tail = _last_pieces(chunk)
    if not tail:
        return ids, [0, 0], 0, 0
    tail_chars = len(chunk) - sum(map(len, tail))
    head, chars, count = [0, 0], 0, 0
    for m in _pieces().finditer(chunk):
        if m.end() > tail_chars or len(head) > 2 * HEAD:
            break
        count += len(_encoded([m.group()], enc))
        chars = m.end()
        head += [chars, count]
    return ids, head, tail_chars, len(ids) - len(_encoded(tail, enc))


def _last_pieces(chunk: str) -> list[str]:
    """The last HELD pieces, or none where the chunk has no more than that.

    White space behind anything else always begins a piece, so scanning may start at such a
    place near the end instead of at the beginning.
    """
    at = len(chunk)
    for _ in range(HELD + 2):
        at = chunk.rfind(" ", 0, at)
        if at <= 0:
            at = 0
            break
    while at > 0 and _SPACE.fullmatch(chunk[at - 1]):
        at -= 1
    found = [m.group() for m in _pieces().finditer(chunk, at)]
    if len(found) <= HELD:
        found = [m.group() for m in _pieces().finditer(chunk)]
    return found[-HELD:] if len(found) > HELD else []


@lru_cache(1 << 17)
def _piece(piece: str, enc: tiktoken.Encoding) -> list[int]:
    return enc.encode_ordinary(piece)


def _encoded(pieces: list[str], enc: tiktoken.Encoding) -> list[int]:
    """Ids of pieces; short ones, which recur, are remembered."""
    out: list[int] = []
    for p in pieces:
        out += _piece(p, enc) if len(p) <= 32 else enc.encode_ordinary(p)
    return out


#: An encoded chunk, or (text, None, None, 0, 0): text that no chunk covers.
Part = tuple[str, list[int] | None, list[int] | None, int, int]


def assemble(parts: list[Part], enc: tiktoken.Encoding) -> list[int]:
    """The ids of the text that the parts make, equal to encoding it whole."""
    if len(parts) == 1:
        return enc.encode_ordinary(parts[0][0]) if parts[0][1] is None else parts[0][1]
    out: list[int] = []
    held, need = "", 0  # text behind the last exact boundary; length at which it is scanned again
    for n, (text, ids, head, tail_chars, tail_ids) in enumerate(parts):
        if ids is None and n == len(parts) - 1:
            held += text
            break
        if ids is not None and not held:
            out += ids[:tail_ids]
            held, need = text[tail_chars:], 0
            continue
        seam = held + text
        if len(seam) < need:
            held = seam
            continue
        if ids is None:
            last = _last_pieces(seam)
            if last:
                # The whole is encoded and the last pieces taken off: cut off, white space would split differently.
                made = enc.encode_ordinary(seam)
                out += made[: len(made) - len(_encoded(last, enc))]
                held, need = "".join(last), 0
            else:
                held, need = seam, 2 * len(seam)
            continue
        own = dict(zip(head[::2], head[1::2], strict=True))
        start, agreed = len(held), False
        pieces: list[str] = []
        for m in _pieces().finditer(seam):
            pieces.append(m.group())
            into = m.end() - start
            if tail_chars and into in own and into <= tail_chars:
                agreed = True
                break
        # Pieces are encoded one by one: cut off from what follows, a run of white space would split differently.
        if agreed:
            out += _encoded(pieces, enc) + ids[own[into] : tail_ids]
            held, need = text[tail_chars:], 0
        elif len(pieces) > HELD:
            out += _encoded(pieces[:-HELD], enc)
            held, need = "".join(pieces[-HELD:]), 0
        else:
            held, need = seam, 2 * len(seam)
    if held:
        out += enc.encode_ordinary(held)
    return out


def parts_of(text: str, known: list[tuple[int, int, bytes]]) -> list[Part]:
    """``text`` as encoded chunks (start, length, packed code), in order, and the text between them."""
    out: list[Part] = []
    at = 0
    for start, length, packed in known:
        if start < at:
            continue  # a repeated row repeats its chunks
        if start > at:
            out.append((text[at:start], None, None, 0, 0))
        tail_chars, tail_ids, heads, *rest = np.frombuffer(packed, dtype="<i4").tolist()
        out.append((text[start : start + length], rest[heads:], rest[:heads], tail_chars, tail_ids))
        at = start + length
    if at < len(text):
        out.append((text[at:], None, None, 0, 0))
    return out


def _pack(code: tuple[list[int], list[int], int, int]) -> bytes:
    ids, head, tail_chars, tail_ids = code
    return np.array([tail_chars, tail_ids, len(head), *head, *ids], dtype="<i4").tobytes()


#: Sorts behind every start: a text follows its chunks.
_LAST = 2**31 - 1


def encode_corpus(documents: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``doc_id, ids`` for every row of ``documents`` (doc_id, text).

    The counts that set the filter are a job of their own, run when this is called.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("th"))
    texts = rows.filter("text is not null and text != ''")
    held_filter = spark.sparkContext.broadcast(repeated_filter(texts.select("text").mapInArrow(_hashes, "h long")))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held_filter.value
        for batch, held in _texts(batches):
            of, starts, ends, h = cut(held)
            at = np.flatnonzero(ends - starts >= LEAST)
            at = at[lets_through(words, h[at])]
            of, starts, ends = of[at], starts[at], ends[at]
            chunks = [held[i][a:b] for i, a, b in zip(of.tolist(), starts.tolist(), ends.tolist(), strict=True)]
            took = pa.array(of)
            yield pa.record_batch([batch["doc_id"].take(took), batch["th"].take(took), pa.array(starts, pa.int32()), pa.array(chunks, pa.string())], ["doc_id", "th", "start", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in _slices(batches, 4096):
            yield pa.record_batch([batch["chunk"], pa.array([_pack(encode_chunk(c, enc)) for c in batch["chunk"].to_pylist()], pa.binary())], ["chunk", "code"])

    chunks = texts.mapInArrow(candidates, "doc_id long, th long, start int, chunk string")
    once = chunks.select("chunk").distinct().mapInArrow(encode, "chunk string, code binary")
    known = chunks.join(once, "chunk").select("doc_id", "th", "start", F.length("chunk").alias("length"), "code", F.lit(None).cast("string").alias("text"))
    whole = texts.select("doc_id", "th", F.lit(_LAST).alias("start"), F.lit(0).alias("length"), F.lit(None).cast("binary").alias("code"), "text")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        key, own = None, []
        for batch in _slices(batches, 1024):
            docs, made = [], []
            columns = [batch[c].to_pylist() for c in ("doc_id", "th", "start", "length", "code", "text")]
            for doc, th, start, length, code, text in zip(*columns, strict=True):
                if (doc, th) != key:
                    key, own = (doc, th), []
                if text is None:
                    if not own or own[-1][0] != start:
                        own.append((start, length, code))
                    continue
                docs.append(doc)
                made.append(assemble(parts_of(text, own), enc) if own else enc.encode_ordinary(text))
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(made, pa.list_(pa.int32()))], ["doc_id", "ids"])

    stream = known.unionByName(whole).repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "start")
    full = stream.mapInArrow(put_together, "doc_id long, ids array<int>")
    empty = rows.filter("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return full.unionByName(empty)


def decode_corpus(encoded: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``: the exact way back."""
    ship(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in _slices(batches):
            yield pa.record_batch([batch["doc_id"], pa.array([enc.decode_bytes(ids).decode() for ids in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def count_tokens(documents: DataFrame, *keep: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row, without any shuffle."""
    ship(documents.sparkSession)
    schema = ", ".join([*[f"`{c}` {dict(documents.dtypes)[c]}" for c in keep], "n_tokens long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in _slices(batches):
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in batch["text"].to_pylist()], pa.int64())
            yield pa.record_batch([*[batch[c] for c in keep], n], [*keep, "n_tokens"])

    return documents.select(*keep, "text").mapInArrow(count, schema)
