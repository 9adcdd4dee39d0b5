"""Long spans that stand verbatim in more than one document.

Texts are cut into chunks by their content. A gear hash rolls over the characters, and a chunk ends
where the hash is the least of all windows of ``SPREAD`` positions around it; inserted text moves no
end beyond its neighbourhood. Taking minima in place of a bit mask bounds the chunk length, so that
any stretch of ``MIN_CHARS`` characters holds at least one whole chunk whose ends depend on nothing
outside the stretch: no shared stretch can be missed. Chunks are deduplicated by digest.

Every window of ``MIN_CHARS`` characters belongs to the first chunk inside it. Windows of chunks
that stand in two or more documents are compared within their chunk: equal windows at the same place
relative to the chunk are shared, and the union of a document's shared windows are its spans.

Exact copies of a whole text are represented by one of them from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline.session import cut, join_hot, spread

# Characters seen by a 32-bit gear hash, and the positions of a window of hashes. A
# stretch of MIN_CHARS holds MIN_CHARS - GEAR + 1 hashes, which are two windows without overlap.
MIN_CHARS = 150
GEAR = 32
SPREAD = (MIN_CHARS - GEAR + 1) // 2
CHUNK_ROWS = "digest bigint, doc_id bigint, place bigint"
INTERVALS = "doc_id bigint, span_start bigint, span_end bigint"


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters one after another, and where each text begins (and the last ends)."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("i8")


def scatter(x: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each code point."""
    x = x.astype("u8") + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gear_hash(cps: np.ndarray) -> np.ndarray:
    """The gear hash (shift left by one, add) of the ``GEAR`` characters up to each position, mixed."""
    h = (scatter(cps) >> np.uint64(32)).astype("u4")
    width = 1
    while width < GEAR:  # the hash of twice as many characters from two halves
        wide = h.copy()
        wide[width:] += h[:-width] << np.uint32(width)
        h, width = wide, 2 * width
    h = h * np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(15))


def chunks(texts: list[str]) -> tuple[np.ndarray, ...]:
    """``(text number, lo, hi, key, digest)`` of every chunk that a window belongs to.

    Windows that start at ``lo..hi`` have this chunk as their first; ``key`` is where its hashed characters
    begin. Positions count from the start of the text.
    """
    cps, begin = code_points(texts)
    none = tuple(np.zeros(0, "i8") for _ in range(5))
    length = np.diff(begin)
    long = np.flatnonzero(length >= MIN_CHARS)
    if not len(long):
        return none
    least = (gear_hash(cps).astype("u8") << np.uint64(32)) | np.arange(len(cps), dtype="u8")
    width = 1
    while 2 * width <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPREAD:
        rest = SPREAD - width
        least = np.minimum(least[:-rest], least[rest:])
    ends = (least & np.uint64(0xFFFFFFFF)).astype("i8")
    # the chunk end that the window of hashes after each start selects; starts run over all full windows of a text
    count = length[long] - (GEAR - 1) - SPREAD + 1
    doc = np.repeat(long, count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[doc]
    end = ends[start + GEAR - 1]
    fresh = np.flatnonzero(np.r_[True, (end[1:] != end[:-1]) | (doc[1:] != doc[:-1])])
    doc, lo, end = doc[fresh], start[fresh], end[fresh]
    follows = np.r_[doc[1:] == doc[:-1], False]
    hi = np.where(follows, np.r_[lo[1:], 0] - 1, -1)
    hi = np.minimum(hi, begin[doc] + length[doc] - MIN_CHARS)
    own = follows & (lo <= hi)
    at = np.flatnonzero(own)
    key, stop = end[at] - (GEAR - 1), end[at + 1] + 1
    raw = memoryview(cps.tobytes())
    digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[4 * a : 4 * b]) for a, b in zip(key.tolist(), stop.tolist(), strict=True)), "u8", len(at)).view("i8")
    base = begin[doc[at]]
    return doc[at], lo[at] - base, hi[at] - base, key - base, digest


def window_hashes(cps: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` characters from each position on (the last ``size - 1`` are left out)."""
    power, h, width = np.uint64(0xD6E8FEB86659FD93), scatter(cps), 1
    out, done, left = None, 0, size
    n = len(cps) - size + 1
    if n <= 0:
        return np.zeros(0, "u8")
    while True:
        if left & 1:
            part = h[done : done + n]
            out = part.copy() if out is None else out * power + part
            done += width
        left >>= 1
        if not left:
            return out
        h = h[:-width] * power + h[width:]
        with np.errstate(over="ignore"):
            power, width = power * power, 2 * width


def windows_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows ``(digest, lo, off, ctx)`` all their windows: row, position in ``ctx``, hash, hash with chunk and place."""
    cps, begin = code_points(pdf["ctx"].to_list())
    count = np.diff(begin) - MIN_CHARS + 1
    row = np.repeat(np.arange(len(pdf)), count)
    s = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    plain = window_hashes(cps, MIN_CHARS)[begin[row] + s]
    place = (pdf["off"].to_numpy("i8")[row] - s).astype("u8")
    mixed = scatter(plain ^ scatter(pdf["digest"].to_numpy("i8").view("u8")[row] + place))
    return row, s, plain, mixed


def shared_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Intervals of rows of whole chunks: from the first to the last window that another document has too."""
    if pdf.empty:
        return pd.DataFrame({"doc_id": np.array([], "i8"), "span_start": np.array([], "i8"), "span_end": np.array([], "i8")})
    row, s, plain, mixed = windows_of(pdf)
    order = np.lexsort((plain, mixed))
    m, p, d = mixed[order], plain[order], pdf["doc_id"].to_numpy("i8")[row[order]]
    digest = pdf["digest"].to_numpy("i8")[row[order]]
    fresh = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (p[1:] != p[:-1]) | (digest[1:] != digest[:-1])])
    many = np.minimum.reduceat(d, fresh) != np.maximum.reduceat(d, fresh)
    hit = order[np.repeat(many, np.diff(np.r_[fresh, len(m)]))]
    first, last = np.full(len(pdf), np.iinfo("i8").max), np.full(len(pdf), -1)
    np.minimum.at(first, row[hit], s[hit])
    np.maximum.at(last, row[hit], s[hit])
    got = last >= 0
    lo = pdf["lo"].to_numpy("i8")[got]
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy("i8")[got], "span_start": lo + first[got], "span_end": lo + last[got] + MIN_CHARS})


def _chunk_kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, texts = pdf["doc_id"].to_numpy("i8"), pdf["text"].to_list()
        for part in _portions([len(t) for t in texts]):
            doc, lo, hi, key, digest = chunks(texts[part])
            place = (lo << 16) | (hi - lo << 8) | (key - lo)  # both differences are below SPREAD; one number makes rows short
            yield pd.DataFrame({"digest": digest, "doc_id": ids[part][doc], "place": place})


def _portions(sizes: list[int], most: int = 1_000_000) -> Iterator[slice]:
    """Consecutive items of about ``most`` characters together."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    yield slice(at, len(sizes))


def _context_kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = {k: [] for k in ("digest", "doc_id", "lo", "off", "ctx", "hot")}
        for doc, text, parts in zip(pdf["doc_id"], pdf["text"], pdf["parts"], strict=True):
            for c in parts:
                lo, more, off = c["place"] >> 16, c["place"] >> 8 & 255, c["place"] & 255
                out["digest"].append(c["digest"])
                out["doc_id"].append(doc)
                out["lo"].append(lo)
                out["off"].append(off)
                out["ctx"].append(text[lo : lo + more + MIN_CHARS])
                out["hot"].append(c["hot"])
        yield pd.DataFrame(out).astype({"digest": "i8", "doc_id": "i8", "lo": "i8", "off": "i8", "ctx": object, "hot": bool})


def _group_kernel(batches: Iterator[pd.DataFrame], most: int = 20_000) -> Iterator[pd.DataFrame]:
    """Rows come sorted by digest; whole digests are handled together, about ``most`` rows at a time."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= most:
            rows = pd.concat(held, ignore_index=True)
            last = rows["digest"].to_numpy() == rows["digest"].iloc[-1]
            held = [rows[last]]
            if not last.all():
                yield shared_windows(rows[~last].reset_index(drop=True))
    if held:
        yield shared_windows(pd.concat(held, ignore_index=True))


def _window_kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            row, s, plain, mixed = windows_of(pdf)
            yield pd.DataFrame({"mixed": mixed.view("i8"), "plain": plain.view("i8"), "doc_id": pdf["doc_id"].to_numpy("i8")[row], "at": pdf["lo"].to_numpy("i8")[row] + s})


def shared_spans(docs: DataFrame, id_col: str, text_col: str, hot_rows: int = 10_000) -> DataFrame:
    """``(doc_id, span_start, span_end)``: the maximal stretches of ``MIN_CHARS`` or more characters that also stand in another document.

    Positions are code points from 0, the end exclusive; overlapping and touching stretches are joined. Null and
    shorter texts have none; stretches repeated within one document only are none. An id stands for one
    document. Chunks that more than ``hot_rows`` documents share (each has up to ``SPREAD`` windows) are compared by a
    shuffle of their windows in place of one task; the rows are the same either way.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= MIN_CHARS))
    # texts with one SHA-256 are one text
    marks = cut(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").cast("bigint").alias("n")).distinct(), "marks")
    copied = marks.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("copies")).where("first <> last")
    copied = cut(copied, "copied")
    copies = cut(join_hot(marks, copied.select("sha", "first"), "sha", counts=copied.select("sha", F.col("copies").alias("n"))).select("doc_id", "n", "first"), "copies")
    # sides that grow with the documents are merged, whatever their files weigh
    texts = texts.join(copies.where("doc_id <> first").select("doc_id").hint("merge"), "doc_id", "left_anti")

    found = cut(texts.mapInPandas(_chunk_kernel, CHUNK_ROWS), "chunks")
    digests = found.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    digests = cut(digests.where("a <> b").select("digest", "n", (F.col("n") > hot_rows).alias("hot")), "digests")
    shared = join_hot(found, digests.select("digest", "hot").hint("merge"), "digest", counts=digests)
    parts = shared.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "place", "hot")).alias("parts"))
    rows = cut(texts.join(parts.hint("merge"), "doc_id").mapInPandas(_context_kernel, "digest bigint, doc_id bigint, lo bigint, off bigint, ctx string, hot boolean"), "contexts")

    warm = spread(rows.where("not hot"), "digest").sortWithinPartitions("digest")
    spans = warm.mapInPandas(_group_kernel, INTERVALS)
    if rows.where("hot").limit(1).count():
        windows = cut(rows.where("hot").mapInPandas(_window_kernel, "mixed bigint, plain bigint, doc_id bigint, at bigint"), "windows")
        twice = windows.groupBy("mixed", "plain").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b")
        twice = twice.groupBy("mixed").agg(F.collect_set("plain").alias("plains"))
        hits = join_hot(windows, twice, "mixed").where(F.array_contains("plains", F.col("plain")))
        spans = spans.unionByName(hits.select("doc_id", F.col("at").alias("span_start"), (F.col("at") + MIN_CHARS).alias("span_end")))
    spans = spans.unionByName(copies.select("doc_id", F.lit(0).cast("bigint").alias("span_start"), F.col("n").alias("span_end")))
    return merge_intervals(spans)


def merge_intervals(spans: DataFrame) -> DataFrame:
    """Join overlapping and touching intervals of each document."""
    line = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("island", F.when(F.col("span_start") <= reach, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("island").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).select("doc_id", "span_start", "span_end")
