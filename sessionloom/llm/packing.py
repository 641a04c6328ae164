"""Best-fit packing of documents into sequences by bin completion."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import per_worker, text_or_empty
from sessionloom.llm.wordcodec import WordCodec
from sessionloom.sources.tables import cut_lineage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = 4096, keep_ids: bool = False, room: int = 1_000_000) -> DataFrame:
    """One row per piece of a document's token ids (with the end id): PIECES.

    A null text counts as empty, so every document has a piece. A document longer than
    ``width`` is cut every ``width`` ids. ``ids`` (little-endian uint32) only if asked for.
    Null document ids are kept, repeated rows give repeated pieces, other columns are ignored.
    ``room`` bounds the words a worker remembers between its tasks; a million take some 45 MB.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = per_worker(("codec", tokenizer, False, room), lambda: WordCodec(tokenizer, byte_level=False, room=room))
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"], codec.each(b["text"].tolist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * width)):
                    part = ids[at:at + 4 * width]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(cut, PIECES)


def complete(count: np.ndarray, room: int, top: int, steps: int) -> list[int]:
    """Lengths that fill ``room`` best, out of the multiset ``count`` (by length, up to ``top``).

    The incumbent is the whole best-fit filling: of each length, in falling order, as many as fit.
    Branch and bound then goes through other numbers of each length. A branch ends when the waste
    that it must leave (by its smallest length, and by all that is left to put in) is no smaller
    than the incumbent's; a filling is dominated if a length in it could be swapped for a longer
    one that is left and fits, which then takes its place. ``steps`` bounds the branches looked
    at after the incumbent, which stands if they run out.
    """
    lengths = np.nonzero(count[:min(top, room) + 1])[0][::-1].tolist()  # falling
    if not lengths:
        return []
    left_over = [int(count[n]) for n in lengths]
    after = [0]  # tokens in all lengths from a place on
    for n, c in zip(reversed(lengths), reversed(left_over)):
        after.append(after[-1] + n * c)
    after.reverse()
    smallest, best, best_waste, nodes = lengths[-1], [], room + 1, 0

    def fits(left: int, lo: int) -> int:
        """Place of the longest length from ``lo`` on that still fits."""
        hi = len(lengths)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if lengths[mid] > left else (lo, mid)
        return lo

    def keep(chosen: list[tuple[int, int]], left: int) -> None:
        nonlocal best, best_waste
        used = dict(chosen)
        for i in sorted(used, reverse=True):
            j = fits(lengths[i] + left, 0)
            while j < i and used.get(j, 0) >= left_over[j]:
                j += 1
            if left and j < i:  # dominated: the longer one takes the place
                left -= lengths[j] - lengths[i]
                used[i] -= 1
                used[j] = used.get(j, 0) + 1
        if left < best_waste:
            best, best_waste = [n for i in sorted(used) for n in [lengths[i]] * used[i]], left

    chosen, left, i = [], room, fits(room, 0)
    while i < len(lengths):
        c = min(left_over[i], left // lengths[i])
        chosen.append((i, c))
        left -= c * lengths[i]
        i = fits(left, i + 1)
    keep(chosen, left)

    def down(lo: int, left: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal nodes
        i = fits(left, lo)
        if i == len(lengths):
            keep(chosen, left)
        while i < len(lengths) and best_waste and nodes < steps and left - after[i] < best_waste:
            for c in range(min(left_over[i], left // lengths[i]), 0, -1):
                rest = left - c * lengths[i]
                nodes += 1
                if rest >= smallest and i + 1 < len(lengths):
                    down(i + 1, rest, [*chosen, (i, c)])
                elif rest < best_waste:
                    keep([*chosen, (i, c)], rest)
                if not best_waste or nodes >= steps:
                    return
            i += 1

    if best_waste:
        down(0, room, [])
    return best


def best_fit(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, longest first, each into the fullest sequence that holds it."""
    free: dict[int, list[int]] = {}  # sequences by the room in them
    rooms, n = 0, 0  # bits of the rooms that some sequence has
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        some = rooms >> size
        room = size + (some & -some).bit_length() - 1 if some else width
        if some:
            own = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            own, n = n, n + 1
        sequence[item], offset[item] = own, width - room
        if room > size:
            free.setdefault(room - size, []).append(own)
            rooms |= 1 << (room - size)
    return sequence, offset


def fewest(lengths: np.ndarray, width: int) -> int:
    """Sequences that any packing needs: by all tokens, and by the pieces that no two of share a sequence."""
    return max(-(-int(lengths.sum()) // width), int((lengths * 2 > width).sum()))


def fill(lengths: np.ndarray, width: int = 4096, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece in as few sequences as the searches find.

    Sequences are completed one by one around the longest piece left. If that takes more than ``fewest``,
    best fit decreasing and a search eight times as wide are tried as well, and the best stays.
    """
    least, best = fewest(lengths, width), None
    for search in (lambda: _completed(lengths, width, steps), lambda: best_fit(lengths, width), lambda: _completed(lengths, width, 8 * steps)):
        found = search()
        if best is None or found[0].max(initial=-1) < best[0].max(initial=-1):
            best = found
        if best[0].max(initial=-1) + 1 <= least:
            break
    return best


def _completed(lengths: np.ndarray, width: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(lengths, minlength=width + 1)
    order = np.argsort(-lengths, kind="stable")
    first = np.searchsorted(-lengths[order], -np.arange(width + 2), side="left")  # where a length begins
    taken = np.zeros(width + 2, np.int64)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    top, n = width, 0

    def put(length: int, at: int) -> None:
        item = order[first[length] + taken[length]]
        taken[length] += 1
        count[length] -= 1
        sequence[item], offset[item] = n, at

    while True:
        while top and not count[top]:
            top -= 1
        if not top:
            return sequence, offset
        put(top, 0)
        at = top
        for length in complete(count, width - top, top, steps):
            put(length, at)
            at += length
        n += 1


def pack(pieces_: DataFrame, width: int = 4096, group_tokens: int = 1 << 24, steps: int = 64) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``width`` tokens.

    Pieces are dealt evenly over groups of about ``group_tokens`` tokens and each group is
    packed by itself, so a task's share is bounded whatever the input; a group ends with about
    one sequence that is not full. Repeated rows are packed as often as they come. Sequence
    numbers are unique, not dense. The pieces are read twice: give a written frame.
    """
    total = pieces_.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = pieces_.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces_.schema) + ", sequence_id long, offset long"

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = fill(rows["length"].to_numpy(np.int64), width, steps)
        return rows.drop(columns="_group").assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    return dealt.groupBy("_group").applyInPandas(group, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = 4096,
                   keep_ids: bool = False, room: int = 1_000_000) -> DataFrame:
    """Tokenised documents packed into sequences: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids). An empty table gives an empty result. ``room``: see pieces."""
    cut = pieces(docs, tokenizer, end_id, width, keep_ids, room)
    return pack(cut_lineage(cut if keep_ids else cut.drop("ids")), width)
