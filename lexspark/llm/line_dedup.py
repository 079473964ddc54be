"""Line dedup: chunks between boundaries chosen by a rolling hash over line hashes; repeated ones stay once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import textkit
from lexspark.session import cut

#: Lines that the rolling hash spans; chunks have as many at least.
ROLLING = 2
#: Windows of ROLLING lines count from this many words, lines that stand alone in theirs from LINE_WORDS words.
WINDOW_WORDS = 8
LINE_WORDS = 12
#: Lines whose bytes a task remembers, so as to hand on equal ones once.
REMEMBERED = 200_000
#: Sentences above this many words are cut into lines at the least word hash of each PIECE_WORDS words.
LONG_WORDS = 24
PIECE_WORDS = 12

_MAX = np.uint64(2**64 - 1)


def lines_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines of some rows: row, start and end byte, words, hash, whether a line feed or the text's end follows, and
    whether a sentence ends (not so for the pieces of a long one but its last).

    A line ends at a line feed or the end of the text; in front of white space after one of .!?, so that a paragraph's
    sentences are lines; and a sentence of more than LONG_WORDS words at the word whose hash is the least of any
    PIECE_WORDS words. Lines without words belong to what follows.
    """
    starts, ends, first = textkit.spans(textkit.SPACES[data], offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.astype(bool), none.astype(bool)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    last_of_row = np.append(row[1:] != row[:-1], True)
    feeds = np.append(0, np.cumsum(data == 10))
    upto = np.append(starts[1:], len(data))
    upto[last_of_row] = offsets[row[last_of_row] + 1]
    feed = (feeds[upto] > feeds[ends]) | last_of_row
    tail = data[ends - 1]
    stop = feed | (tail == 46) | (tail == 33) | (tail == 63)
    sentence, last = stop.copy(), np.flatnonzero(stop)
    sums = textkit.prefix_sums(data, table)
    size = np.diff(last, prepend=-1)
    long = np.flatnonzero(size > LONG_WORDS)
    if len(long):
        of = np.repeat(long, size[long])
        word = np.arange(len(of)) + np.repeat(last[long] + 1 - np.cumsum(size[long]), size[long])
        hashes = textkit.span_hashes(data, starts[word], ends[word], sums=sums)
        least = np.lib.stride_tricks.sliding_window_view(hashes, PIECE_WORDS).argmin(axis=1)
        at = np.flatnonzero(of[: len(least)] == of[PIECE_WORDS - 1 :])
        stop[word[at + least[at]]] = True
        last = np.flatnonzero(stop)
    begin = np.append(0, last[:-1] + 1)
    hashes = textkit.span_hashes(data, starts[begin], ends[last], sums=sums)
    return row[begin], starts[begin], ends[last], last - begin + 1, hashes, feed[last], sentence[last]


def run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run of lines, from those of its lines in order."""
    up, down = textkit._power(len(hashes) + 1)
    sums = np.append(np.uint64(0), np.cumsum(hashes * up[: len(hashes)]))
    return textkit.mix((sums[last + 1] - sums[first]) * down[first] + (last - first + 1).astype(np.uint64) * textkit._MULT)


def runs_of(row: np.ndarray, words: np.ndarray, hashes: np.ndarray, feed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of lines that may repeat: first and last line and hash, by the first line.

    Chunks: a boundary stands behind a line where the rolling hash of the last ROLLING lines is less than behind the
    lines before and after, so that the same lines have the same boundaries wherever they stand; the ends of a text
    are boundaries. Windows: any ROLLING lines with WINDOW_WORDS words, as a repeated passage seldom holds both
    boundaries of the chunks at its ends. And a line alone between line feeds with LINE_WORDS words.
    """
    n = len(row)
    if not n:
        return row, row, hashes
    at = np.arange(n)
    same = np.append(False, row[1:] == row[:-1])  # as the line before
    window = np.flatnonzero(same)
    rolling = np.full(n + 2, _MAX)
    rolling[window + 1] = run_hashes(hashes, window - (ROLLING - 1), window)
    boundary = (rolling[1:-1] < rolling[:-2]) & (rolling[1:-1] < rolling[2:])
    boundary |= np.append(~same[1:], True)
    last = np.flatnonzero(boundary)
    first = np.append(0, last[:-1] + 1)
    several = last > first
    first, last = first[several], last[several]
    total = np.append(0, np.cumsum(words))
    window = window[total[window + 1] - total[window - 1] >= WINDOW_WORDS]
    alone = np.flatnonzero(feed & (np.append(True, feed[:-1]) | ~same) & (words >= LINE_WORDS))
    small = last - first == ROLLING - 1  # chunks that are windows
    small[small] = total[last[small] + 1] - total[first[small]] >= WINDOW_WORDS
    first, last = np.concatenate([first[~small], window - 1, at[alone]]), np.concatenate([last[~small], window, at[alone]])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    return first, last, run_hashes(hashes, first, last)


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy, text) to the hashes of the row's runs."""
    table = textkit.exact_table()
    for batch in batches:
        for at, _, data, offsets in textkit.blocks(batch.column(2)):
            row, _, _, words, hashes, feed, _ = lines_of(data, offsets, table)
            first, _, keys = runs_of(row, words, hashes, feed)
            if len(keys):
                of = pa.array(at + row[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(keys.view(np.int64))], names=["doc_id", "copy", "key"])


def _found(at: int, until: int, marks: pa.ListArray, row: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the runs (by row and key) are among their row's marks."""
    part = marks.slice(at, until - at)
    sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    known = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    out = np.zeros(len(keys), bool)
    if len(known) and len(keys):
        of = np.repeat(np.arange(until - at), sizes)
        salted = lambda k, r: k ^ textkit.mix(r.astype(np.uint64) + np.uint64(1))
        mixed = salted(known, of)
        order = np.argsort(mixed)
        place = order[np.minimum(np.searchsorted(mixed[order], salted(keys, row)), len(order) - 1)]
        out = (known[place] == keys) & (of[place] == row)
    return out


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n lines lie in any run."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _remover(unequal: np.ndarray):
    """(others, own, text, rest) to rest, cleaned text and counts; runs with a line of an unequal hash stay.

    Behind each batch come hash and bytes of the lines in its repeated runs, but for those that the task has just
    handed on with the same bytes.
    """
    names = ["rest", "text", "n_lines", "removed_lines", "removed_words", "line", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = textkit.exact_table()
        seen_lines: dict[int, bytes] = {}
        for batch in batches:
            texts: list = []
            handed: list[tuple[int, bytes]] = []
            counts: list[np.ndarray] = []
            null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            for at, until, data, offsets in textkit.blocks(batch.column(2)):
                row, start, end, words, hashes, feed, sentence = lines_of(data, offsets, table)
                first, last, keys = runs_of(row, words, hashes, feed)
                bounds = np.searchsorted(row, np.arange(until - at + 1))
                good = np.ones(len(first), bool)
                if len(unequal):
                    odd = np.append(0, np.cumsum(np.isin(hashes, unequal)))
                    good = odd[last + 1] == odd[first]
                gone = good & _found(at, until, batch.column(0), row[first], keys)
                mine = good & _found(at, until, batch.column(1), row[first], keys)
                whole = data.tobytes()
                lines = np.flatnonzero(_covered(first[gone | mine], last[gone | mine], len(row)))
                for h, a, b in zip(hashes[lines].view(np.int64).tolist(), start[lines].tolist(), end[lines].tolist(), strict=True):
                    if seen_lines.get(h) != (piece := whole[a:b]):
                        seen_lines[h] = piece
                        handed.append((h, piece))
                if len(seen_lines) > REMEMBERED:
                    seen_lines.clear()
                own = np.flatnonzero(mine)
                begin = first.copy()
                seen: dict[tuple[int, int], int] = {}
                for k, name in zip(own.tolist(), zip(row[first[own]].tolist(), keys[own].tolist(), strict=True), strict=True):
                    if name in seen:  # its first place stays, also where the next one overlaps it
                        begin[k] = max(begin[k], seen[name] + 1)
                        gone[k] = begin[k] <= last[k]
                    else:
                        seen[name] = int(last[k])
                cut_lines = _covered(begin[gone], last[gone], len(row))
                touched = np.zeros(until - at, bool)
                touched[row[cut_lines]] = True
                for i in range(until - at):
                    if null[at + i]:
                        texts.append(None)
                    elif not touched[i]:
                        texts.append(whole[offsets[i] : offsets[i + 1]].decode())
                    else:
                        a, b = int(bounds[i]), int(bounds[i + 1])
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], cut_lines[a:b], [False]]))) + a
                        pieces, kept_to = [], int(offsets[i])
                        for u, v in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
                            pieces.append(whole[kept_to : start[u] if u > a else offsets[i]])
                            kept_to = int(start[v] if v < b else offsets[i + 1])
                        pieces.append(whole[kept_to : offsets[i + 1]])
                        texts.append(b"".join(pieces).decode())
                sums = [np.append(0, np.cumsum(c))[bounds] for c in (sentence, sentence & cut_lines, words * cut_lines)]
                counts.append(np.diff(np.stack(sums)))
            columns = np.concatenate([np.zeros((3, 0), np.int64), *counts], axis=1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), pa.array(texts, pa.string()), *map(pa.array, columns), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names
            )
            if handed:
                n = len(handed)
                none = [pa.nulls(n, t) for t in (batch.column(3).type, pa.string(), pa.int64(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, *(pa.array(c) for c in zip(*handed, strict=True))], names=names)

    return run


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with text cleaned, and n_lines, removed_lines and removed_words (long).

    A run of lines (see runs_of) that occurs more than once in all texts stays only at its first place in the document
    of the smallest id; elsewhere it goes, with the white space behind it. So a repeated passage of several whole lines
    (sentences count as lines) goes whole wherever it stands; lines that it holds in part stay. Runs that overlap may
    have different keepers; each line of theirs stays somewhere. The white space between two lines is not compared.
    n_lines counts lines (sentences too, but not their pieces), removed_lines those whose end went.
    Null text stays null; empty and blank texts stay. Rows of one id count as one document (null ids: as the last), and
    each of them keeps what that document keeps. Empty table: empty result. Columns of docs named like the new ones are
    replaced; n_chars, if there, follows the text.

    Keys of runs are counted over all texts, then the bytes of all lines in repeated runs are compared: where lines of
    one hash have other bytes (a 64-bit collision), the removal is done again and their runs stay. Keys are aggregated
    before they are shuffled, a document's marks are no more than its runs, and the driver gets only hashes of lines
    that were unequal.
    """
    new = ("n_lines", "removed_lines", "removed_words")
    # rows without an id are told apart, so that the marks of all of them are not gathered
    copy = F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(0)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), copy.alias("copy"), F.col(text).alias("text"))
    runs = cut(own.mapInArrow(_listing, "doc_id long, copy long, key long"), "runs")
    again = runs.groupBy("key").agg(F.count("*").alias("times"), F.min("doc_id").alias("keeper")).where("times > 1").select("key", "keeper")
    hits = runs.join(again, "key").select("doc_id", "copy", "key", F.col("keeper").eqNullSafe(F.col("doc_id")).alias("mine"))
    marks = hits.groupBy("doc_id", "copy").agg(
        F.collect_set(F.when(~F.col("mine"), F.col("key"))).alias("__others"), F.collect_set(F.when(F.col("mine"), F.col("key"))).alias("__own")
    )
    marks = cut(marks.withColumnsRenamed({"doc_id": "__id", "copy": "__copy"}), "marks")
    rest = [c for c in docs.columns if c.lower() not in new and c != text]
    keyed = docs.select(F.col(doc_id).cast("long").alias("__key"), copy.alias("__its"), F.col(text).alias("__text"), F.struct(*rest).alias("__rest"))
    same = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__its") == F.col("__copy"))
    marked = keyed.join(marks, same, "left").select("__others", "__own", "__text", "__rest")
    kind = marked.schema["__rest"].dataType.simpleString()
    schema = f"rest {kind}, text string, n_lines long, removed_lines long, removed_words long, line long, bytes binary"
    removed = lambda unequal: cut(marked.mapInArrow(_remover(unequal), schema), "cleaned", compression="zstd")
    out = removed(np.zeros(0, np.uint64))
    lines = out.where("line is not null").select("line", "bytes").distinct()
    unequal = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line").toArrow().column("line").to_numpy()
    if len(unequal):
        out = removed(unequal.view(np.uint64))
    out = out.where("line is null")
    chars = F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    columns = [
        F.col("text").alias(text) if c == text else F.coalesce(chars, F.col("rest.n_chars")).alias(c) if c == "n_chars" else F.col("rest").getField(c).alias(c)
        for c in docs.columns
        if c.lower() not in new
    ]
    return out.select(*columns, *new)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated runs, with the columns of docs."""
    return dedup_lines(docs).select(*docs.columns)
