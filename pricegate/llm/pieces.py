"""SentencePiece merge models: encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of candidate merges that are skipped, and the seed.
DROPOUT, SEED = 0.1, 20_24
#: Symbols above which a word is not remembered, and symbols that are merged side by side.
LONG, SIDE = 64, 1 << 18
#: Words of up to so many symbols are merged side by side.
WIDTHS = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, LONG])
#: Words that a worker remembers before it starts anew; results do not depend on it.
REMEMBERED = 1 << 20
_SPACE = "▁"
#: The words of a text; `_words` finds the same.
_WORD = re.compile(r" *[^ ]+| +")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
NONE = np.int32(1 << 30)
#: Binary digits of the size of the table of merges.
TABLE = 20


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64 on unsigned longs."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Merges:
    """Pieces of a model: which two make a third, and which goes first."""

    def __init__(self, path: str, dropout: float, seed: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.bytes = np.zeros(256, np.int64)
        byte = {int(self.model.id_to_piece(i)[3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        self.bytes[list(byte)] = list(byte.values())
        plain = {self.model.id_to_piece(i): i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))}
        # by code point: the id of a character, or the code point's complement where it has none
        self.char = ~np.arange(0x110000, dtype=np.int64)
        self.char[[ord(p) for p in plain if len(p) == 1]] = [i for p, i in plain.items() if len(p) == 1]
        self.char[32], self.char[ord(_SPACE)] = self.char[ord(_SPACE)], ~ord(_SPACE)  # the mark itself is spelled in bytes
        self.shown = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]
        order = {s: k for k, s in enumerate(sorted({self.model.get_score(i) for i in plain.values()}, reverse=True))}
        found = {(plain[p[:k]] << 20 | plain[p[k:]]): (order[self.model.get_score(i)], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
        self.keys = np.array([*sorted(found), -2], dtype=np.int64)
        self.rank = np.array([*(found[k][0] for k in sorted(found)), NONE], dtype=np.int32)
        self.made = np.array([*(found[k][1] for k in sorted(found)), 0], dtype=np.int64)
        # ranks below which all pieces have up to so many characters: (limit, how far a candidate's rivals may begin)
        sizes = np.zeros(len(order) + 1, np.int64)
        for piece, i in plain.items():
            k = order[self.model.get_score(i)]
            sizes[k] = max(sizes[k], len(piece))
        longest, self.bits = np.maximum.accumulate(sizes), len(order).bit_length()
        self.bands = [(int(np.searchsorted(longest, size, "right")), max(1, size - 1)) for size in np.unique(longest[longest > 1]).tolist()]
        # open addressing: where a pair's merge is looked for first, and then in the following slots
        self.table = np.full(1 << TABLE, len(found), np.int32)
        for k, slot in enumerate((self.keys[:-1].astype(np.uint64) * _M1 >> np.uint64(64 - TABLE)).tolist()):
            while self.table[slot] < len(found):
                slot = (slot + 1) & ((1 << TABLE) - 1)
            self.table[slot] = k
        self.limit, self.seed, self.dropout = np.uint64(min(int(dropout * 2**64), 2**64 - 1)), seed, dropout
        self.forget()

    def forget(self) -> None:
        """Empties what is remembered: of words without a skip, the merges made (as they are hashed) and the ids, byte
        pieces spelled out."""
        self.known: dict[str, int] = {}
        self.path, self.path_at, self.path_n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.ids_at, self.ids_n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def occurrence_keys(self, names: list[str], numbers: np.ndarray) -> np.ndarray:
        """A key for each word of each text: a hash of seed, the text's name and the word's place in it."""
        start = np.array([xxhash.xxh64_intdigest(n, self.seed) for n in names], dtype=np.uint64)
        place = np.arange(numbers.sum()) - np.repeat(np.cumsum(numbers) - numbers, numbers)
        return mixed(place.astype(np.uint64) * _M1 + np.repeat(start, numbers))

    def skipped(self, key: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Whether an occurrence (its key) skips a candidate (its base)."""
        return mixed(key ^ base) < self.limit

    def candidates(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank, piece, base) of the merges of neighbours, rank NONE where there is none.

        The base is a hash of both ids and the place of the left one's first symbol in the
        word, so a candidate is skipped or not whenever it is processed.
        """
        pair = np.where((left >= 0) & (right >= 0), left << 20 | right, -1)
        k = self.find(pair.ravel()).reshape(pair.shape)
        return self.rank[k], self.made[k], self.base(pair, at)

    def base(self, pair: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hash of candidates, which keys are compared with."""
        return mixed(pair.astype(np.uint64) * _M1 + at.astype(np.uint64))

    def find(self, pair: np.ndarray) -> np.ndarray:
        """Places of pairs among the merges; the last place stands for none."""
        slot = (pair.astype(np.uint64) * _M1 >> np.uint64(64 - TABLE)).astype(np.int64)
        k = self.table[slot]
        open_ = np.flatnonzero((self.keys[k] != pair) & (k < len(self.rank) - 1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << TABLE) - 1)
            k[open_] = self.table[slot[open_]]
            open_ = open_[(self.keys[k[open_]] != pair[open_]) & (k[open_] < len(self.rank) - 1)]
        return k

    def merge(self, words: np.ndarray, sizes: np.ndarray, which: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments ``words[which]`` side by side, each by its own key, or without a skip.

        Words have ``sizes`` symbols, and negative ones after them. Each takes its best
        candidate, the leftmost of equals, in turn. Returns all ids one after another, how many
        each has, and, without keys, the bases of the merges made, as many as symbols that went.
        """
        rows, n = len(which), words.shape[1]
        # cells of flat arrays, and one beyond them; each row's neighbours are linked, so a merge touches no more than three cells
        end = rows * n
        ids, there, rank, merged = np.full(end + 1, -1), np.zeros(end + 1, bool), np.full(end + 1, NONE), np.full(end + 1, len(self.rank) - 1, np.int32)
        by_row = lambda cells: cells[:end].reshape(rows, n)
        by_row(ids)[:], by_row(there)[:] = words[which], np.arange(n) < sizes[which][:, None]
        pair = words[:, :-1] << 20 | words[:, 1:]  # negative if a symbol is
        k = self.find(pair.ravel()).reshape(pair.shape)
        by_row(merged)[:, :-1], first = k[which], self.rank[k][which]
        if keys is not None:
            first[self.skipped(keys[:, None], self.base(pair, np.arange(n - 1))[which])] = NONE
        by_row(rank)[:, :-1] = first
        after, before = np.arange(1, end + 2), np.arange(-1, end)
        after[n - 1 : end : n] = before[:end:n] = end
        bases = np.zeros((rows, 0 if keys is not None else n - 1), np.uint64)
        live, ranks, step = np.arange(rows), by_row(rank), 0
        while len(live):
            place = ranks[live].argmin(1)
            a = place + live * n
            going = rank[a] < NONE
            if not going.all():
                live, place, a = live[going], place[going], a[going]
                if not len(live):
                    break
            gone = after[a]
            if keys is None:
                bases[live, step] = self.base(ids[a] << 20 | ids[gone], place)
                step += 1
            beyond, left = after[gone], before[a]
            ids[a], there[gone], rank[gone] = self.made[merged[a]], False, NONE
            after[a], before[beyond] = beyond, a
            lefts, rights = np.concatenate([a, left]), np.concatenate([beyond, a])
            pair = ids[lefts] << 20 | ids[rights]
            k = self.find(pair)
            new = self.rank[k]
            if keys is not None:
                new[self.skipped(np.tile(keys[live], 2), self.base(pair, np.concatenate([place, left - (a - place)])))] = NONE
            rank[lefts], merged[lefts] = new, k
        return ids[there], by_row(there).sum(1), bases

    def side_by_side(self, words: list[str], which: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Segments ``words[which]`` by ``merge``; returns ids (byte pieces spelled out), where each one's begin and how
        many there are, and the same of the bases of merges made, if there are no keys."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        symbols = np.concatenate([symbols, np.full(LONG, -1)])
        start = np.cumsum(length) - length
        band = np.searchsorted(WIDTHS, length)[which]
        ids, ids_at, ids_n = [np.zeros(0, np.int64)], np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        path, path_at, path_n = [np.zeros(0, np.uint64)], np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        ids_done = path_done = 0
        for b in np.flatnonzero(np.bincount(band, minlength=len(WIDTHS))).tolist():
            some, width = np.flatnonzero(band == b), int(WIDTHS[b])
            for part in np.array_split(some, max(1, len(some) * width // SIDE)):
                needed, row = np.unique(which[part], return_inverse=True)
                cells = symbols[start[needed][:, None] + np.arange(width)]
                cells[np.arange(width) >= length[needed][:, None]] = -1
                out, sizes, bases = self.merge(cells, length[needed], row, keys if keys is None else keys[part])
                flat, take = self.spelled(out)
                ends, edges = np.cumsum(sizes), np.concatenate(([0], np.cumsum(take)))
                ids_at[part], ids_n[part] = ids_done + edges[ends - sizes], edges[ends] - edges[ends - sizes]
                ids.append(flat)
                ids_done += len(flat)
                if keys is None:
                    went = length[which[part]] - sizes
                    path_at[part], path_n[part] = path_done + np.cumsum(went) - went, went
                    path.append(bases[np.arange(bases.shape[1]) < went[:, None]])
                    path_done += len(path[-1])
        return np.concatenate(ids), ids_at, ids_n, np.concatenate(path), path_at, path_n

    def segmentations(self, words: list[str], keys: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """The number of each occurrence's remembered segmentation, or -1 if its own key skips one of the merges there.

        Occurrences are of ``words``, or of ``words[which]``. A candidate's hash decides whatever
        the order, so an occurrence goes the way of its word without skips up to the first
        merge that it skips.
        """
        if len(self.known) > REMEMBERED:
            self.forget()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            done, ids, path = len(self.known), len(self.ids), len(self.path)
            self.known.update(zip(fresh, range(done, done + len(fresh)), strict=True))
            more = self.side_by_side(fresh, np.arange(len(fresh)))
            for name, new, shift in zip(("ids", "ids_at", "ids_n", "path", "path_at", "path_n"), more, (0, ids, 0, 0, path, 0), strict=True):
                setattr(self, name, np.concatenate([getattr(self, name), new + new.dtype.type(shift)]))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        first, count = self.path_at[at], self.path_n[at]
        which = np.arange(len(words)) if which is None else which
        out = at[which]
        live, step = (np.arange(len(which)) if self.dropout > 0 else which[:0]), 0
        while len(live):
            live = live[count[which[live]] > step]
            skip = self.skipped(keys[live], self.path[first[which[live]] + step])
            out[live[skip]] = -1
            live, step = live[~skip], step + 1
        return out

    def agenda(self, symbols: list[int], key: np.uint64) -> list[int]:
        """Ids of one word's symbols by its key; unknown characters stay negative."""
        cells = np.array([[*symbols, -1]])
        return self.merge(cells, np.array([len(symbols)]), np.array([0]), np.array([key]))[0].tolist()

    def long(self, words: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Segments long words, each by its own key, many merges at a time.

        In turn each word takes its best candidate, the leftmost of equals. A candidate's turn
        comes with its rank, or once both symbols are made, if that is later; ``turn`` holds
        both, the later one first. It may be taken at once if no candidate that starts within
        a radius has an earlier turn: what goes before it makes pieces that rank before its
        turn, ``bands`` bounds their length, and so whatever could join one of its symbols
        begins within the radius with an earlier turn. Candidates of the same turn near each
        other are taken together, leftmost first, up to one whose merge makes another
        candidate as good, after which they wait.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.int32)
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        kind, never = (np.int32, np.int32(1 << 30)) if self.bits <= 15 else (np.int64, np.int64(1 << 62))
        # of each symbol left: its first character, when it was made, and the turn of it with the next one
        first_of, born, turn = np.arange(len(ids), dtype=np.int32), np.zeros(len(ids), kind), np.full(len(ids), never)
        look = lambda left, right, k: self.candidates(left.astype(np.int64), right.astype(np.int64), place[first_of[k]])

        def propose(k: np.ndarray) -> np.ndarray:
            """The turns of symbols k and those after them."""
            ranks, _, bases = look(ids[k], ids[k + 1], k)
            none = (ranks == NONE) | (word[first_of[k]] != word[first_of[k + 1]])
            if self.dropout > 0:
                none |= self.skipped(keys[word[first_of[k]]], bases)
            ranks = ranks.astype(kind)
            return np.where(none, never, np.maximum(ranks, np.maximum(born[k], born[k + 1])) << self.bits | ranks)

        if len(ids) > 1:
            turn[:-1] = propose(np.arange(len(ids) - 1))
        for limit, radius in self.bands:
            while True:
                open_ = np.where(turn < limit << self.bits, turn, never)
                best = (open_ == _least_within(open_, radius, never)) & (open_ < never)
                take = np.flatnonzero(best)
                if not len(take):
                    break
                own = turn[take]
                apart = np.concatenate(([True], (np.diff(take) > radius) | (own[1:] != own[:-1])))
                waits = np.zeros(len(take), bool)  # an equal one to the left is not taken, as a better one is near it
                for k in range(1, radius + 1):
                    waits[take >= k] |= (open_[take[take >= k] - k] == own[take >= k]) & ~best[take[take >= k] - k]
                if waits.any():
                    free = _counted(waits, apart) == 0
                    take, own = take[free], own[free]
                    apart = np.concatenate(([True], (np.diff(take) > radius) | (own[1:] != own[:-1])))
                if not apart.all():
                    # of neighbours, which overlap, every other one from the left
                    run = np.concatenate(([True], np.diff(take) > 1))
                    first = np.flatnonzero(run)
                    even = (np.arange(len(take)) - np.repeat(first, np.diff(np.append(first, len(take))))) % 2 == 0
                    take, own = take[even], own[even]
                    apart = np.concatenate(([True], (np.diff(take) > radius) | (own[1:] != own[:-1])))
                    # whether a merge makes a candidate as good, with what then stands before it (perhaps just merged) or after it
                    rank, after = own & ((1 << self.bits) - 1), np.minimum(take + 2, len(ids) - 1)
                    joined = np.concatenate(([False], np.diff(take) == 2))
                    before, made = np.maximum(np.where(joined, take - 2, take - 1), 0), look(ids[take], ids[take + 1], take)[1]
                    left = look(np.where(joined, np.roll(made, 1), ids[before]), made, before)[0] <= rank
                    right = look(made, ids[after], take)[0] <= rank
                    inside = lambda other, take=take: word[first_of[other]] == word[first_of[take]]
                    risky = left & (take > 0) & inside(before) | right & (take + 2 < len(ids)) & inside(after)
                    take = take[_counted(risky, apart) - risky == 0]
                ids[take], born[take] = look(ids[take], ids[take + 1], take)[1], turn[take] >> self.bits
                there = np.ones(len(ids), bool)
                there[take + 1] = False
                there = np.flatnonzero(there)
                ids, first_of, born, turn = ids[there], first_of[there], born[there], turn[there]
                now = take - np.arange(len(take))  # a symbol has gone for each merge to the left
                turn[now] = never
                changed = np.concatenate([now, now[now > 0] - 1])
                changed = changed[changed < len(ids) - 1]
                turn[changed] = propose(changed)
        ends = np.cumsum(np.bincount(word[first_of], minlength=len(words)))
        return np.split(ids.astype(np.int64), ends[:-1])

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with unknown characters (negative) put as byte pieces, and how many each one takes."""
        take = np.ones(len(ids), np.int64)
        odd = np.unique(ids[ids < 0])
        spelling = {c: self.bytes[list(chr(~c).encode("utf-8", "surrogatepass"))] for c in odd.tolist()}
        where = ids < 0
        take[where] = np.array([len(spelling[c]) for c in odd.tolist()], dtype=np.int64)[np.searchsorted(odd, ids[where])]
        out = np.repeat(ids, take)
        first = np.cumsum(take) - take
        for c, pieces in spelling.items():
            at = first[ids == c]
            for k, piece in enumerate(pieces.tolist()):
                out[at + k] = piece
        return out, take

    def encode(self, texts: list[str], names: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. A text's name, a word's place and a candidate decide what is skipped."""
        words, which, number = _words(texts)
        if not len(which):
            return [np.zeros(0, np.int64) for _ in texts]
        keys = self.occurrence_keys(names, number)
        size = np.fromiter(map(len, words), np.int64, len(words))
        large = np.flatnonzero(size[which] > LONG)
        own, long = [], [words[k] for k in which[large].tolist()]
        for some in _parts(range(len(large)), map(len, long), SIDE):
            own += [self.spelled(ids)[0] for ids in self.long([long[k] for k in some], keys[large[some]])]
        short = [w if len(w) <= LONG else " " for w in words]  # holds its place
        at = self.segmentations(short, keys, which)
        first, count = self.ids_at[at], self.ids_n[at]
        parted = np.flatnonzero(at < 0)
        ids, ids_at, count[parted] = self.side_by_side(short, which[parted], keys[parted])[:3]
        first[parted] = len(self.ids) + ids_at
        if len(large):
            count[large] = [len(x) for x in own]
            first[large] = len(self.ids) + len(ids) + np.cumsum(count[large]) - count[large]
        out = np.concatenate([self.ids, ids, *own])[_ranges(first, count)]
        stops = np.concatenate(([0], np.cumsum(count)))[np.cumsum(number)]
        return [out[a:b] for a, b in zip(np.concatenate(([0], stops[:-1])), stops, strict=True)]

    def decode(self, ids) -> str:
        """The text of ids, byte pieces included, without the space put before it."""
        return b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def _words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of texts that follow a space each (empty ones have none): a run of spaces and what is up to
    the next one. Then the place of each occurrence's word among them, and the number of occurrences in each text."""
    parts = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    whole = b"".join(parts)
    space = np.frombuffer(whole, np.uint8) == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    edges = np.cumsum([0, *map(len, parts)])
    begins[edges[:-1][np.diff(edges) > 0]] = True
    start = np.append(np.flatnonzero(begins), len(whole))
    found = pa.Array.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(start), pa.py_buffer(whole)]).dictionary_encode()
    return [w.decode("utf-8", "surrogatepass") for w in found.dictionary.to_numpy(zero_copy_only=False).tolist()], found.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(start[:-1], edges))


def _parts(items: Iterable[int], sizes: Iterable[int], most: int) -> Iterator[list[int]]:
    """Items in turn, as many at a time as have ``most`` in all, or one."""
    part, held = [], 0
    for item, size in zip(items, sizes, strict=True):
        if part and held + size > most:
            yield part
            part, held = [], 0
        part.append(item)
        held += size
    if part:
        yield part


def _counted(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many flags there are up to and with each place since the last start."""
    total, first = np.cumsum(flags), np.flatnonzero(starts)
    return total - np.repeat((total - flags)[first], np.diff(np.append(first, len(flags))))


def _least_within(x: np.ndarray, radius: int, never) -> np.ndarray:
    """The least of the values at most ``radius`` places away from each."""
    n, width, span = len(x), 2 * radius + 1, 1
    edge = np.full(radius, never, x.dtype)
    least = np.concatenate([edge, x, edge])
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[width - span : width - span + n])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[k], first[k] + 1, ... of which there are count[k], one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


@lru_cache(maxsize=1)
def merges(path: str, dropout: float, seed: int) -> Merges:
    return Merges(path, dropout, seed)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, dropout: float, seed: int, rows: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Some rows at a time: the rows, their texts and their ids."""
    model = merges(path, dropout, seed)
    for b in batches:
        for k in range(0, b.num_rows, rows):
            part = b.slice(k, rows)
            texts = part.column("text").to_pylist()
            yield part, texts, model.encode(texts, [n or "" for n in part.column("name").to_pylist()])


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, text: str = "text", rows: int = 1000) -> DataFrame:
    """doc_id and ids of every whole text; null counts as empty, which has no ids.

    Each candidate merge is skipped with probability ``dropout``, by a hash of seed, doc_id,
    the word's place in the text, and the candidate's ids and place in the word. Without
    dropout the ids are the model's own. The same seed gives the same ids, whatever the
    partitions are; rows that repeat a doc_id (or have none) skip alike, so equal rows give
    equal ids. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, found in _encoded(batches, path, dropout, seed, rows):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs, text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of lists of ids; null or empty lists give the empty text. Rows stay as they are, repeated or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path, 0.0, 0)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, text: str = "text", rows: int = 1000) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit), decoded_sha256, lossless.

    Null texts count as empty: no ids, and lossless. Repeated rows, and rows without a doc_id,
    are rows of their own; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        model = merges(path, dropout, seed)
        for part, texts, found in _encoded(batches, path, dropout, seed, rows):
            back = [model.decode(ids.tolist()) for ids in found]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(ids) for ids in found], pa.int64()), pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in found], pa.int64()),
                pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]), pa.array([t == u for t, u in zip(texts, back, strict=True)]),
            ], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"])

    return _texts(docs, text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")
