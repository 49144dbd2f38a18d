"""Best-fit packing of token sequences by a grouping genetic algorithm.

A genome is a whole packing, its genes are the sequences ("bins"). Crossover injects
well-filled bins of one parent into the other, takes out the bins of the other that hold a
piece twice, and puts the pieces so displaced back by best fit. Pieces are dealt into lots
of bounded size; in every lot several islands evolve populations of their own, each in a
task, and pass their best genomes on round by round. A round is a written table, so a
lost executor costs one round of the lots it held.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.bpe import byte_characters
from tieout.llm.common import blocks, cut_lineage, text_or_empty

CAPACITY, END = 1024, 2
#: Pieces of a lot, islands, genomes of an island, rounds of migration and crossovers a round.
LOT, ISLANDS, GENOMES, ROUNDS, CROSSOVERS = 8192, 3, 4, 2, 20
#: Characters that are encoded at once.
CHARS = 1 << 21
#: Parts of texts a task remembers the ids of.
REMEMBERED = 1 << 20
#: Matches that go through the tokenizer's model at once.
MATCHES = 1 << 9


# ---- tokens

#: A space that no new match begins with.
_ODD = re.compile(r" (?:\s|\Z)")
#: Characters that two regex libraries may class differently.
_UNSURE = "[\x1c-\x1f\x85\u0250-\U0010ffff]"
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of whole texts by the tokenizer's file; parts met before are looked up.

    A text is taken apart before every space that a character other than white space
    follows. The tokenizer's pattern always begins a new match there, so the ids of the
    parts, one after the other, are those of the text. A new part in Latin characters is
    taken apart by the pattern, and the matches that are new go through the tokenizer's own
    model; a part with other characters or a special token, or a tokenizer of another kind,
    goes through the tokenizer whole. ``test_encoder_is_the_tokenizer`` holds both together.
    """

    def __init__(self, model: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(model)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsure = re.compile("|".join([_UNSURE, *map(re.escape, self.special)])).search
        said = json.loads(model)
        first = said.get("pre_tokenizer") or {}
        self.known_kind = (first.get("type"), first.get("use_regex"), first.get("add_prefix_space"), said.get("normalizer")) == ("ByteLevel", True, False, None)
        self.find, alone = regex.compile(PATTERN).findall, Tokenizer.from_str(model).model
        if hasattr(alone, "_resize_cache"):
            alone._resize_cache(0)  # no match comes twice
        self.words = Tokenizer(alone)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.mapped = np.frombuffer("".join(byte_characters()).encode("utf-16-le"), "<u2")
        self.parted = self.mapped[list("\uffff".encode())].tobytes().decode("utf-16-le")
        self.forget()

    def forget(self) -> None:
        """``known`` numbers the parts; the ids of part k are ids[at[k]:at[k + 1]], both arrays with room to grow."""
        self.known: dict[str, int] = {}
        self.ids, self.at, self.new, self.settled = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), [], 0
        self.again = np.zeros(1 << 14, bool)

    def thin_out(self) -> None:
        """Forgets the parts that were not met again since the last time, or all if few would go."""
        again = np.flatnonzero(self.again[: len(self.known)])
        kept = list(compress(self.known, self.again.tolist())) if len(again) <= REMEMBERED // 2 else []
        ids, ends = self._at(again[: len(kept)])
        self.forget()
        self._add(kept, ids, np.diff(ends, prepend=0))

    def parts(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [text]
        units = text.split(" ")
        if not _ODD.search(text):
            return [units[0], *map(" ".__add__, units[1:])]
        out = [units[0]]
        for u in units[1:]:
            if u and not u[0].isspace():
                out.append(" " + u)
            else:
                out[-1] += " " + u
        return out

    def _add(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.new.append((ids, sizes))

    def _settle(self) -> None:
        for ids, sizes in self.new:
            k, n = self.settled, self.at[self.settled]
            if n + len(ids) > len(self.ids):
                self.ids = np.append(self.ids, np.zeros(n + len(ids), np.uint32))
            if k + len(sizes) >= len(self.at):
                self.at = np.append(self.at, np.zeros(k + len(sizes), np.int64))
            self.ids[n : n + len(ids)] = ids
            self.at[k + 1 : k + 1 + len(sizes)] = n + np.cumsum(sizes)
            self.settled = k + len(sizes)
        self.new = []

    def _whole(self, parts: list[str]) -> list[str]:
        """Parts that the pattern and the model alone may not take as the tokenizer does."""
        if not self.known_kind:
            return parts
        return [p for p in parts if self.unsure(p)] if self.unsure("\n".join(parts)) else []

    def _cut(self, parts: list[str]) -> tuple[list[str], list[str], np.ndarray]:
        """The parts in some order, their matches one after the other, and how many each has.

        Parts that begin like those of ``parts`` are cut as one text: no match crosses from one to the next.
        """
        led = [p[:1] == " " and p[1:2] > "" and not p[1].isspace() for p in parts]
        joined, alone = list(compress(parts, led)), [p for p, one in zip(parts, led) if not one]
        matches, own = self.find("".join(joined)), list(map(self.find, alone))
        ends = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined))), side="right")
        count = np.append(np.diff(last, prepend=0), np.fromiter(map(len, own), np.int64, len(own)))
        return joined + alone, matches + list(chain.from_iterable(own)), count

    def _tokenized(self, matches: list[str]) -> None:
        """Matches without U+FFFF, which parts them here, through the tokenizer's model: as bytes' characters, a space between."""
        for k in range(0, len(matches), MATCHES):
            some = matches[k : k + MATCHES]
            raw = np.frombuffer("\uffff".join(some).encode(), np.uint8)
            said = self.words.encode(self.mapped[raw].tobytes().decode("utf-16-le").replace(self.parted, " "), add_special_tokens=False)
            self._add(some, np.array(said.ids, np.uint32), np.bincount(np.array(said.word_ids, np.int64), minlength=len(some)))

    def _learn(self, new: list[str]) -> None:
        whole = self._whole(new)
        parts, matches, count = self._cut(list(set(new).difference(whole)) if whole else new)
        many = count != 1  # any other part is its own match; a match cut again is one, so no part of many is a match
        own = list(compress(parts, (~many).tolist()))
        inner = list(compress(matches, np.repeat(many, count).tolist()))
        self._tokenized(own + list(set(inner).difference(self.known, own)))
        if many.any():
            ids, ends = self._at(self._places(inner))
            last = np.append(0, ends)[np.cumsum(count[many])]
            self._add(list(compress(parts, many.tolist())), ids, np.diff(last, prepend=0))
        if whole:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            self._add(whole, np.concatenate(found), np.array([len(x) for x in found]))

    def _places(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known parts one after the other, and where each part's end."""
        self._settle()
        size = self.at[place + 1] - self.at[place]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.at[place] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _numbered(self, texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
        """Distinct parts of the texts, and the parts of each text as numbers of these.

        Texts with spaces between words only are split and numbered by Arrow: number k is
        the word after a space, the words that texts begin with come after all these.
        """
        even = [not _ODD.search(t) and not any(s in t for s in self.special) for t in texts]
        units = pc.split_pattern(pa.array([t for t, e in zip(texts, even) if e], pa.large_string()), " ")
        coded = units.flatten().dictionary_encode()
        words, number = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        begin = units.offsets.to_numpy()
        number, first = number.copy(), begin[:-1]
        distinct = [" " + w for w in words] + [words[k] for k in number[first]]
        number[first] = len(words) + np.arange(len(first))
        found = iter(np.split(number, begin[1:-1]))
        out = []
        for t, e in zip(texts, even):
            if e:
                out.append(next(found))
            else:
                parts = self.parts(t)
                out.append(np.arange(len(distinct), len(distinct) + len(parts)))
                distinct += parts
        return distinct, out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as unsigned 32-bit numbers."""
        distinct, numbers = self._numbered(texts)
        if len(self.known) > REMEMBERED:
            self.thin_out()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        unplaced = place < 0
        if len(self.again) < len(self.known):
            self.again = np.append(self.again, np.zeros(len(self.known), bool))
        self.again[place[~unplaced]] = True
        if unplaced.any():
            new = list(compress(distinct, unplaced.tolist()))
            self._learn(list(dict.fromkeys(new)))
            place[unplaced] = self._places(new)
        found, ends = self._at(place[np.concatenate(numbers)])
        return np.split(found, np.append(0, ends)[np.cumsum([len(n) for n in numbers])][:-1])


#: Encoders of a worker process, which serves many tasks.
_ENCODERS: dict[str, Encoder] = {}


def pieces_of(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of ``n`` ids: all of ``capacity`` but the first."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


PIECES = "_row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _tokens(model: str, capacity: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _ENCODERS.get(model) or _ENCODERS.setdefault(model, Encoder(model))
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            texts = [text_or_empty(t) for t in batch["text"]]
            ids_of = batch["doc_id"].astype("Int64").tolist()
            for a, b in blocks(texts, CHARS):
                out = []
                for doc, ids in zip(ids_of[a:b], encoder.encode(texts[a:b])):
                    ids, start = np.append(ids, np.uint32(end)).astype("<u4"), 0
                    for k, length in enumerate(pieces_of(len(ids), capacity)):
                        own = ids[start : start + length]
                        out.append((row, doc, k, start, length, zlib.crc32(own.tobytes()), *([own.astype(np.int64)] if keep_ids else [])))
                        start, row = start + length, row + 1
                yield pd.DataFrame(out, columns=["_row", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]).astype({"doc_id": "Int64"})

    return run


# ---- genomes: the bin of every piece


def best_fit(sizes: np.ndarray, order: np.ndarray, genome: np.ndarray, room: dict[int, int], capacity: int) -> np.ndarray:
    """Puts the pieces of ``order`` into the fullest bins that hold them, or into new ones; ``genome`` is changed.

    ``rooms`` has the bins by free room; a bit set tells which rooms have any, so the least that suffices is its lowest bit.
    """
    rooms, bits, fresh = [[] for _ in range(capacity + 1)], [1 << k for k in range(capacity + 1)], max(room, default=-1) + 1
    for bin_, free in room.items():
        rooms[free].append(bin_)
    mask, chosen = sum(compress(bits, rooms)), []
    for size in sizes[order].tolist():
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = rooms[free].pop()
            if not rooms[free]:
                mask ^= bits[free]
        else:
            bin_, free, fresh = fresh, capacity, fresh + 1
        free -= size
        rooms[free].append(bin_)
        mask |= bits[free]
        chosen.append(bin_)
    genome[order] = chosen
    return genome


def renumbered(genome: np.ndarray) -> np.ndarray:
    held = np.bincount(genome) > 0
    return (np.cumsum(held) - 1)[genome].astype(np.int32)


def worth(sizes: np.ndarray, genome: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins, and minus the mean square of their fill: less is better."""
    fill = np.bincount(genome, weights=sizes)
    return len(fill), -float(((fill / capacity) ** 2).mean()) if len(fill) else 0.0


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing needs fewer: by the sum, and with pieces over half a bin each in one of its own.

    For a threshold t, pieces over capacity - t share no bin with one of t or more; what
    the other large ones leave must hold the rest of at least t.
    """
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    total = np.arange(capacity + 1) * count
    most, above, weight = -(-int(total.sum()) // capacity), np.cumsum(count[::-1])[::-1], np.cumsum(total[::-1])[::-1]
    for t in range(1, capacity // 2 + 1):
        alone = int(above[capacity - t + 1])
        half = int(above[capacity // 2 + 1]) - alone
        left = half * capacity - int(weight[capacity // 2 + 1] - weight[capacity - t + 1])
        rest = int(weight[t] - weight[capacity // 2 + 1])
        most = max(most, alone + half + max(0, -(-(rest - left) // capacity)))
    return most


def crossed(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """``taker`` with about half of the well-filled bins of ``giver`` injected."""
    fill = np.bincount(giver, weights=sizes)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5)) if len(fill) else np.zeros(0, np.int64)
    chosen = np.zeros(len(fill), bool)
    chosen[well[rng.random(len(well)) < rng.uniform(0.3, 0.9)]] = True
    injected = chosen[giver]
    # bins of the taker that hold a piece twice now go as a whole
    broken = np.zeros(int(taker.max(initial=-1)) + 1, bool)
    broken[taker[injected]] = True
    kept = ~broken[taker] & ~injected
    # so do some of its worst filled ones: their pieces look for better places
    own = np.bincount(taker, weights=sizes)
    worst = np.zeros(len(own), bool)
    worst[np.argsort(own + rng.random(len(own)) * capacity / 8)[: max(2, len(own) // 20)]] = True
    kept &= ~worst[taker]
    child = np.full(len(sizes), -1, np.int32)
    child[injected] = giver[injected]
    child[kept] = taker[kept] + len(fill)
    placed = child >= 0
    at = renumbered(child[placed])
    child[placed] = at
    filled = np.bincount(at, weights=sizes[placed]).astype(np.int64)
    loose = np.flatnonzero(~placed)
    order = loose[np.lexsort((rng.random(len(loose)), -sizes[loose]))]
    room = {b: capacity - f for b, f in enumerate(filled.tolist())}
    return renumbered(best_fit(sizes, order, child, room, capacity))


def started(sizes: np.ndarray, rng: np.random.Generator, first: bool, capacity: int) -> np.ndarray:
    """Best fit by falling size, the order loosened at random but for the first genome."""
    key = -sizes.astype(np.float64) if first else -sizes * rng.uniform(0.85, 1, len(sizes))
    return renumbered(best_fit(sizes, np.argsort(key, kind="stable"), np.full(len(sizes), -1, np.int32), {}, capacity))


def evolved(sizes: np.ndarray, genomes: list[np.ndarray], seed: int, capacity: int, keep: int, crossovers: int) -> list[np.ndarray]:
    """The island's next population, the best first; at the least number of bins nothing is left to gain."""
    rng = np.random.default_rng(seed)
    while len(genomes) < keep:
        genomes.append(started(sizes, rng, not genomes, capacity))
        if worth(sizes, genomes[0], capacity)[0] <= least_bins(sizes, capacity):
            return genomes[:1]
    held = sorted(((worth(sizes, g, capacity), g) for g in genomes), key=lambda x: x[0])[:keep]
    goal = least_bins(sizes, capacity)
    for _ in range(crossovers):
        if held[0][0][0] <= goal:
            return [held[0][1]]
        a, b = rng.choice(len(held), 2, replace=False) if len(held) > 1 else (0, 0)
        for giver, taker in ((a, b), (b, a)):
            child = crossed(sizes, held[giver][1], held[taker][1], rng, capacity)
            value = worth(sizes, child, capacity)
            if value < held[-1][0] and all(value != v for v, _ in held):
                held[-1] = value, child
                held.sort(key=lambda x: x[0])
    return [g for _, g in held]


# ---- lots and islands


GENOME = "lot bigint, island int, bins bigint, waste double, done boolean, sizes binary, genome binary"


def _lot_order(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["length", "_row"], ascending=[False, True], kind="stable")


def _first(capacity: int, islands: int, keep: int):
    """The islands' first populations of a lot: one row per genome."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sizes = _lot_order(frame)["length"].to_numpy(np.int64)
        lot, island = int(key[0]), int(key[1])
        goal = least_bins(sizes, capacity)
        found = evolved(sizes, [], 1000003 * lot + island, capacity, keep, 0)
        return _rows(lot, island, sizes, found, capacity, goal)

    return run


def _rows(lot: int, island: int, sizes: np.ndarray, genomes: list[np.ndarray], capacity: int, goal: int) -> pd.DataFrame:
    out = []
    for g in genomes:
        bins, waste = worth(sizes, g, capacity)
        out.append((lot, island, bins, waste, bins <= goal, sizes.astype(np.int32).tobytes(), g.astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=["lot", "island", "bins", "waste", "done", "sizes", "genome"])


def _next(capacity: int, keep: int, crossovers: int, round_: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        lot, island = int(key[0]), int(key[1])
        sizes = np.frombuffer(frame["sizes"].iloc[0], np.int32).astype(np.int64)
        frame = frame.sort_values(["bins", "waste", "genome"]).drop_duplicates("genome")
        genomes = [np.frombuffer(g, np.int32).copy() for g in frame["genome"]]
        found = evolved(sizes, genomes, (1000003 * lot + island) * 31 + round_, capacity, keep, crossovers)
        return _rows(lot, island, sizes, found, capacity, least_bins(sizes, capacity))

    return run


def _placed(frame: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    frame = _lot_order(frame)
    genome = np.frombuffer(best["genome"].iloc[0], np.int32)
    sizes = frame["length"].to_numpy(np.int64)
    order = np.argsort(genome, kind="stable")
    before = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
    heads = np.append(True, np.diff(genome[order]) != 0)
    offset = np.empty(len(sizes), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(heads, before, 0))
    return pd.DataFrame({"_row": frame["_row"].to_numpy(), "sequence_id": (frame["lot"].to_numpy(np.int64) << 32) + genome, "offset": offset})


def packed(docs: DataFrame, model: str, capacity: int = CAPACITY, end: int = END, lot: int = LOT, islands: int = ISLANDS, genomes: int = GENOMES, rounds: int = ROUNDS, crossovers: int = CROSSOVERS, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` tokens.

    A document is its token ids by the tokenizer in ``model`` (the JSON text) and ``end``;
    a null text is empty, so its piece is ``end`` alone. Longer ones are cut into pieces of
    ``capacity``, the first may be shorter. Full pieces are sequences of their own; the
    others are dealt into lots of about ``lot``, of like mixture, and packed lot by lot.
    Repeated rows and rows without id are packed like any other; an empty table gives no
    rows. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with
    ``keep_ids``, the ids.
    """
    types = PIECES + (", ids array<bigint>" if keep_ids else "")
    pieces = cut_lineage(docs.select("doc_id", "text").mapInPandas(_tokens(model, capacity, end, keep_ids), types), "pieces")
    full = pieces.where(F.col("length") == capacity).select("_row", (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("_row", "length")
    lots = max(1, -(-rest.count() // lot))
    dealt = cut_lineage(rest.withColumn("lot", F.pmod(F.xxhash64("_row"), F.lit(lots)).cast("bigint")), "lots")
    on_islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    held = cut_lineage(on_islands.groupBy("lot", "island").applyInPandas(_first(capacity, islands, genomes), GENOME), "genomes")
    finished = None
    for round_ in range(rounds):
        solved = held.where("done").select("lot").distinct()
        open_ = held.join(solved, "lot", "left_anti")
        best = open_.groupBy("lot", "island").agg(F.min_by(F.struct("bins", "waste", "done", "sizes", "genome"), F.struct("bins", "waste")).alias("x"))
        moved = best.select("lot", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "x.*")
        after = open_.unionByName(moved).groupBy("lot", "island").applyInPandas(_next(capacity, genomes, crossovers, round_), GENOME)
        ready = held.join(solved, "lot", "left_semi").where("done")
        finished = ready if finished is None else finished.unionByName(ready)
        held = cut_lineage(after, "genomes")
    every = held if finished is None else held.unionByName(finished)
    winner = every.groupBy("lot").agg(F.min_by("genome", F.struct("bins", "waste")).alias("genome"))
    places = dealt.groupBy("lot").cogroup(winner.groupBy("lot")).applyInPandas(_placed, "_row bigint, sequence_id bigint, offset bigint")
    return pieces.join(places.unionByName(full), "_row").drop("_row")
