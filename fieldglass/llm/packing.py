"""Best-fit packing of token pieces into sequences by swap-based local search.

Texts are tokenised whole, piece lengths are packed in bounded groups, and the bins that a group
leaves underfull are opened again and packed with those of other groups, round by round, until one
group is left. Token ids never leave the task that made them unless asked for.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.tables import keep_once

LENGTH = 4096
END_ID = 1
GROUP = 20_000  # pieces packed together in one task
FULL_ENOUGH = 0.999  # bins at or above this share of the length are not opened again
_CACHE = 150_000  # distinct words after which a worker forgets those it has not met since as many before
# The pre-tokeniser's pattern for lower-case Latin-1 text, and the mark of a word's last token.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                   r"|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
WORD_END = "</w>"


class WordTokenizer:
    """Ids of whole texts, word by word.

    The vocabulary never merges across the words that its pre-tokeniser cuts, so a text's ids are
    those of its words. Texts of Latin-1 characters are cut here, as the pre-tokeniser would, and only
    new words go to the library; any other text is given to the library whole. The memory of words has
    two generations: when the younger is full it becomes the older, and of the one it replaces only words met
    meanwhile are known. So frequent words stay and the many that occur once do not add up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids)):
            data, starts = ids.tobytes(), [0, *(4 * ends[:-1]).tolist()]
            self.words.update(zip(words, map(data.__getitem__, map(slice, starts, (4 * ends).tolist())), strict=True))
        else:
            for word, found in zip(words, self.library.encode_batch(words, add_special_tokens=False), strict=True):
                self.words[word] = np.array(found.ids, "<u4").tobytes()

    def rest(self) -> None:
        """Between tasks only the younger words are held: the worker may do other work next."""
        self.older = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > _CACHE:
            self.older, self.words = self.words, {}
        cut = [_WORD.findall(t.lower()) if _plain(t) else None for t in texts]
        new = set().union(*[c for c in cut if c]).difference(self.words)
        known = self.older.keys() & new
        self.words.update(zip(known, map(self.older.__getitem__, known)))
        new -= known
        if new:
            self._learn(sorted(new))
        ids_of = self.words.__getitem__
        return [
            b"".join(map(ids_of, c)) if c is not None else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for c, t in zip(cut, texts, strict=True)]


def _plain(text: str) -> bool:
    """Latin-1 only, and no text of a special token."""
    if "<|" in text:
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def _tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def pieces_of(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH,
    end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and the ids themselves if asked for.

    A document is its tokens and then `end_id`; only longer ones are cut. Null text is empty and gives
    the end id alone. Rows with null or repeated ids are documents of their own.
    """
    schema = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:binary>>" if with_ids else ">>")
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * length

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _tokenizer(tokenizer_path)
        for texts in batches:
            rows, values = [], list(texts)
            for lo in range(0, len(values), 256):
                for ids in encode.ids(values[lo: lo + 256]):
                    data = ids + end
                    found = []
                    for i, at in enumerate(range(0, len(data), step)):
                        part = data[at: at + step]
                        row = {"piece": i, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                        found.append(row | {"ids": part} if with_ids else row)
                    rows.append(found)
            yield pd.Series(rows, dtype=object)
        encode.rest()

    made = F.pandas_udf(cut, schema)(F.coalesce(F.col(text_column), F.lit("")))
    return docs.select(F.col(id_column).alias("id"), F.explode(made).alias("p")).select("id", "p.*")


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The pieces with `sequence_id` and `offset`, gapless from 0, in as few sequences as found.

    Pieces of full length are sequences by themselves. The others are dealt by a hash into groups of
    about `group` pieces; each is packed alone, and bins that stay underfull go to the next round, with
    other company, until one group was left or a round saves no sequence. A group keeps the bins it got
    if packing its pieces anew does not save one, so no round loses. Lengths are whole numbers from 1 to
    `length`. An empty table gives an empty table.
    """
    numbered = keep_once(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    open_pieces = numbered.where(F.col("length") < length).select(
        "_piece", "length", F.col("_piece").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    settled = [numbered.where(F.col("length") >= length).select(
        "_piece", (-1 - F.col("_piece")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    count, level = open_pieces.count(), 0
    bins = count  # sequences of the open pieces so far: each alone
    while count:
        groups = -(-count // group)
        dealt = open_pieces.withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups)))
        packed = keep_once(dealt.groupBy("group").applyInPandas(
            _group_packer(level, groups == 1, length), "_piece bigint, length bigint, sequence_id bigint, offset bigint, done boolean"), f"packed-{level}")
        settled.append(packed.where("done").select("_piece", "sequence_id", "offset"))
        open_pieces = packed.where("not done").drop("done")
        # Every bin has one piece at offset 0.
        found, underfull, left = packed.agg(
            F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & ~F.col("done")), F.count_if(~F.col("done"))).first()
        if found == bins:
            settled.append(open_pieces.select("_piece", "sequence_id", "offset"))
            break
        count, bins, level = left, underfull, level + 1
    placed = settled[0]
    for table in settled[1:]:
        placed = placed.unionByName(table)
    return numbered.join(placed, "_piece").drop("_piece")


def _group_packer(level: int, last: bool, capacity: int):
    def pack_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        order = np.lexsort((rows["_piece"].to_numpy(), -lengths))
        made = [order[members] for members in pack_bins(lengths[order], capacity)]
        of, offset, done = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), np.empty(len(rows), bool)
        kept = rows["sequence_id"].nunique() <= len(made) and level > 0
        if kept:
            of, offset = rows["sequence_id"].to_numpy(), rows["offset"].to_numpy()
            filled = rows.groupby("sequence_id")["length"].transform("sum").to_numpy()
            done = (filled >= FULL_ENOUGH * capacity) | last
        else:
            for b, at in enumerate(made):
                of[at] = (level << 50) + (int(key[0]) << 24) + b
                offset[at] = np.cumsum(lengths[at]) - lengths[at]
                done[at] = last or lengths[at].sum() >= FULL_ENOUGH * capacity
        return pd.DataFrame({
            "_piece": rows["_piece"], "length": lengths, "sequence_id": of,
            "offset": offset, "done": done})

    return pack_group


def pack_bins(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of row numbers for lengths in descending order: best fit, then local search over the underfull bins."""
    free: list[tuple[int, int]] = []  # (room, bin) of the open bins, sorted
    bins: list[list[int]] = []
    for i, size in enumerate(lengths.tolist()):
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > size:
            insort(free, (room - size, b))
    sizes = lengths.tolist()
    loads = [sum(sizes[i] for i in b) for b in bins]
    underfull = [b for b, load in enumerate(loads) if load < FULL_ENOUGH * capacity]
    spare = len(bins) - max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    local_search(bins, loads, sizes, underfull, capacity, spare)
    return [b for b in bins if b]


def local_search(
    bins: list[list[int]], loads: list[int], sizes: list[int], underfull: list[int], capacity: int, spare: int,
) -> None:
    """Empty up to `spare` of the least filled bins into the others.

    Moves, one-for-one and two-for-one exchanges are taken when they raise the sum of squared fills,
    the largest rise first. Every underfull bin is a taker. They are indexed by room: a taker with room
    r gives up a piece of size s (or none, s = 0) for any total from s + 1 to s + r, so an exchange is
    an interval that holds the total, and all intervals are tried at once. A bin is dropped when its
    last piece is gone.
    """
    if spare <= 0 or len(underfull) < 2:
        return
    index = _Takers(bins, loads, sizes, underfull, capacity)
    for giver in sorted(underfull, key=lambda b: loads[b]):
        if spare <= 0:
            return
        index.close(giver)
        while bins[giver] and (step := index.best(bins[giver], loads[giver])):
            out, back, taker = step
            for i in out:
                bins[giver].remove(i)
                bins[taker].append(i)
            if back is not None:
                bins[taker].remove(back)
                bins[giver].append(back)
            shift = sum(sizes[i] for i in out) - (0 if back is None else sizes[back])
            loads[giver] -= shift
            loads[taker] += shift
            index.close(taker)
            index.open(taker)
        if bins[giver]:
            index.open(giver)
        else:
            spare -= 1


class _Takers:
    """The intervals (s, s + room] of all pieces of the open bins, and of no piece, in arrays that bins enter and leave."""

    def __init__(self, bins: list[list[int]], loads: list[int], sizes: list[int], underfull: list[int], capacity: int):
        self.bins, self.loads, self.sizes, self.capacity = bins, loads, sizes, capacity
        self.low, self.high, self.load, self.piece, self.bin = (np.zeros(0, np.int64) for _ in range(5))
        self.places: dict[int, np.ndarray] = {}
        self.free: list[int] = []
        for b in underfull:
            self.open(b)

    def open(self, b: int) -> None:
        room = self.capacity - self.loads[b]
        if not room:
            return
        pieces = [-1, *self.bins[b]]
        if len(self.free) < len(pieces):
            old = len(self.low)
            grown = max(1024, old, len(pieces))
            for name in ("low", "high", "load", "piece", "bin"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(grown, np.int64)]))
            self.free.extend(range(old, old + grown))
        at = np.array([self.free.pop() for _ in pieces])
        given = np.array([0, *(self.sizes[i] for i in self.bins[b])])
        self.low[at], self.high[at], self.load[at], self.piece[at], self.bin[at] = given, given + room, self.loads[b], pieces, b
        self.places[b] = at

    def close(self, b: int) -> None:
        at = self.places.pop(b, None)
        if at is not None:
            self.high[at] = 0  # holds no total
            self.free.extend(at.tolist())

    def best(self, giver: list[int], load: int) -> tuple[list[int], int | None, int] | None:
        """(pieces sent, piece taken back, taker) of the exchange that raises squared fills most; totals sent twice are tried once."""
        totals: dict[int, list[int]] = {}
        for a, i in enumerate(giver):
            totals.setdefault(self.sizes[i], [i])
            for k in giver[a + 1:]:
                totals.setdefault(self.sizes[i] + self.sizes[k], [i, k])
        best, most = None, 0
        for total, sent in totals.items():
            if total >= 2 * self.capacity:
                continue
            at = np.flatnonzero((self.low < total) & (self.high >= total) & ((self.low > 0) | (len(sent) == 1)))
            if not len(at):
                continue
            shift = total - self.low[at]
            gain = shift * (self.load[at] - load + shift)
            top = int(gain.argmax())
            if gain[top] > most:
                most, piece = int(gain[top]), int(self.piece[at[top]])
                best = (sent, None if piece < 0 else piece, int(self.bin[at[top]]))
        return best
