"""SentencePiece encoding and decoding on a relational lattice.

Texts are cut into units that no piece of the vocabulary crosses. Of the distinct
units every substring of two characters up to the longest piece is exploded and equi-joined to the piece
table; the edges are grouped by unit and folded by a higher-order aggregate.
The public model is a byte-pair one, whose encoder merges by rank, so the fold always takes the
edge of best rank, the leftmost of equals, that spans exactly two neighbours, until there is none. (A Viterbi
fold over the same scores gives other ids than the library; see the README.)

Units that a sample shows to be frequent are encoded beforehand and numbered, the most frequent first. A text is cut once, and the
numbers of its units, with holes for the other units, are shuffled once, compressed and with those units, by groups. The units of all groups are folded
once each, wherever they occur, and go back to the groups as the bits where their tokens end; there
numbers become ids, and they fill the holes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Characters of a unit that one fold takes: a cut between any two of them is a bit of a long. Longer units are folded in windows, each STEP characters on.
WINDOW, STEP = 62, 32
GROUP_CHARS = 20_000_000
#: Frequent units kept, and characters of the sample in which they are counted. Ids don't depend on them: any other unit is encoded with its group.
FREQUENT, SAMPLE_CHARS = 250_000, 100_000_000

#: Levels of the compression of texts and of numbers that are shuffled. Numbers have few repeats that a higher one would find.
LEVEL, NUMBERS_LEVEL = 13, 1
#: Stands for the ids of a unit that is not known yet; the greatest number of two bytes as of four.
HOLE = -1
#: Numbers of units from which one takes two bytes and three, and the first that has no room.
TWO, THREE, TOO_MANY = 160, 160 + (80 << 8), 160 + (80 << 8) + (16 << 16)
#: Ids that are put together before they are passed on.
PART_IDS = 1 << 20
#: Between units in one string, where blanks stand for marks and marks for line breaks. No unit has blanks, and only units of line breaks alone have those.
BETWEEN = "\n"


def model_of(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary(model: sentencepiece.SentencePieceProcessor) -> dict[str, int]:
    return {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}


def unit_pattern(pieces) -> str:
    """A pattern, alike in Java and Python, of units: blanks with the Latin letters or with the other characters after them. No piece goes from the ones to the others; if one does, blanks alone begin a unit."""
    latin = re.compile(f"[{LATIN}]")
    if any("▁" not in (a, b) and bool(latin.match(a)) != bool(latin.match(b)) for p in pieces for a, b in pairwise(p)):
        return "▁*[^▁\\n]+|▁+|\\n+"
    return f"▁*[{LATIN}]+|▁*[^▁\\n{LATIN}]+|▁+|\\n+"


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, piece_id, place: the order of scores, equal for equal ones, late) of the pieces of two characters or more: as many rows as the vocabulary has, a fixed size, so it may be broadcast.

    A piece is late if a part of it may be merged only after its own turn, as it has no better place and what is beside it is a piece or a character.
    """
    model = model_of(path)
    pieces = vocabulary(model)
    place = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in pieces.values()}, reverse=True))}
    at = {p: place[model.get_score(i)] for p, i in pieces.items() if len(p) > 1}

    def late(p: str) -> bool:
        halves = (h for k in range(1, len(p)) for h in ((p[:k], p[k:]), (p[k:], p[:k])))
        return any(a in at and (len(b) == 1 or b in at) and at[a] >= at[p] for a, b in halves)

    # as an Arrow table it needs no Python workers, of which executors would hold several for it beside their own
    columns = [list(at), [pieces[p] for p in at], list(at.values()), [late(p) for p in at]]
    return spark.createDataFrame(pa.table(columns, pa.schema([("piece", pa.string()), ("piece_id", pa.int32()), ("place", pa.int32()), ("late", pa.bool_())])))


def encode_units(units: DataFrame, path: str) -> DataFrame:
    """Distinct units of 1 to WINDOW characters, with cuts long: bit p is set where one of the library's tokens starts or ends before character p. Units without an edge have no row: each character is a token."""
    pieces, one = piece_table(units.sparkSession, path), F.lit(1).cast("long")
    # a number for each unit makes the groups cheap to sort; it doesn't leave the task
    keys = ["_n", "unit"]
    rows = units.where(F.length("unit") > 1).withColumn("_n", F.monotonically_increasing_id())
    longest = max(map(len, vocabulary(model_of(path))), default=1)
    starts = rows.select(*keys, F.explode(F.sequence(F.lit(0), F.length("unit") - 2)).alias("s"))
    spans = starts.select(*keys, "s", F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), F.length("unit") - F.col("s")))).alias("n"))
    found = spans.select(*keys, "s", "n", F.substr("unit", F.col("s") + 1, F.col("n")).alias("piece")).join(F.broadcast(pieces), "piece")
    # cuts as bits: those at an edge's ends, and those inside it
    inside = F.call_function("shiftleft", F.call_function("shiftleft", one, F.col("n") - 1) - one, F.col("s") + 1)
    ends = F.call_function("shiftleft", one, F.col("s")).bitwiseOR(F.call_function("shiftleft", one, F.col("s") + F.col("n")))
    turn = (F.col("place").cast("long") * 64 + F.col("s")).alias("turn")
    lattice = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(turn, ends.alias("ends"), inside.alias("inside"), "late"))).alias("edges"))
    able = lambda x, cuts: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inside"])) == 1)
    none = F.lit(-(1 << 63)).cast("long")

    def once(cuts: Column, x: Column, late: Column) -> Column:
        """Each edge in turn joins the neighbours that it spans. Where that makes a late edge able to join whose turn is over, the sign says that turns were wrong."""
        then = cuts.bitwiseAND(F.bitwise_not(x["inside"]))
        return F.when((cuts < 0) | ~able(x, cuts), cuts).when(F.exists(late, lambda y: (y["turn"] < x["turn"]) & able(y, then)), none).otherwise(then)

    def best(cuts: Column, edges: Column) -> Column:
        """The best of the edges that span two neighbours joins them; the sign says that there is none any more."""
        return F.when(cuts < 0, cuts).otherwise(F.coalesce(cuts.bitwiseAND(F.bitwise_not(F.get(F.filter(edges, lambda x: able(x, cuts)), F.lit(0))["inside"])), cuts.bitwiseOR(none)))

    every = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - F.length("unit"))  # a bit more than characters
    # transforms of one value bind it, so that it is worked out once
    first = F.transform(F.array(F.filter("edges", lambda x: x["late"])), lambda late: F.aggregate("edges", every, lambda cuts, x: once(cuts, x, late)))
    turns = F.sequence(F.lit(1), F.greatest(F.length("unit") - 1, F.lit(1)))  # a unit of n characters has at most n - 1 merges
    again = F.aggregate(turns, every, lambda cuts, _: best(cuts, F.col("edges"))).bitwiseAND(F.lit((1 << 63) - 1))
    cuts = F.transform(first, lambda c: F.when(c < 0, again).otherwise(c))
    return lattice.select("unit", F.get(cuts, F.lit(0)).alias("cuts"))


def cut(pattern: re.Pattern, text: str) -> list[str]:
    """Units of a text with the mark ▁ for blanks and before its start; none of an empty text."""
    return pattern.findall("▁" + text.replace(" ", "▁")) if text else []


def together(units: list[str]) -> str:
    return BETWEEN.join([u.replace("▁", " ") if u[0] != "\n" else "▁" * len(u) for u in units])


def apart(units: str) -> list[str]:
    return [u.translate({32: "▁", 0x2581: "\n"}) for u in units.split(BETWEEN)]


def frequent_units(rows: DataFrame, pattern: str, path: str, chars: int) -> dict[str, bytes]:
    """Ids of the most frequent units, FREQUENT at most and the most frequent first, of a sample, by hash, of some SAMPLE_CHARS of the chars characters of rows."""
    share = min(1.0, SAMPLE_CHARS / max(chars, 1))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def count(batches):
        units, n = re.compile(pattern), Counter()
        for b in batches:
            for t in b["text"]:
                n.update(cut(units, t.as_py()))
            if len(n) > FREQUENT:
                yield from out(n)
                n = Counter()
        yield from out(n)

    def out(n):
        names = [u for u in n if len(u) <= WINDOW]
        for at in range(0, len(names), 65536):
            some = names[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([n[u] for u in some], pa.int64())], ["unit", "n"])

    counts = written(sample.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1"), "unit-counts")
    least, have = 0, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("units")).orderBy(F.desc("n")).collect():  # a row for each number of occurrences
        if have + r.units > FREQUENT:
            break
        least, have = r.n, have + r.units
    if not have:
        return {}
    chosen = counts.where(F.col("n") >= least)
    found = encode_units(chosen.select("unit").repartition(-(-have // 20_000), "unit"), path).toArrow()
    encoder = Encoder(path)
    return {u: encoder.ids(u) for u in chosen.toArrow().sort_by([("n", "descending"), ("unit", "ascending")])["unit"].to_pylist()} | encoder.all(found)


class Codes(dict):
    """Ids, as bytes of 32-bit integers, of pieces; of a character that is none those of its bytes."""

    def __missing__(self, c: str) -> bytes:
        self[c] = np.array([b + 3 for b in c.encode()], np.int32).tobytes()
        return self[c]


class Encoder:
    """Ids of units, as bytes of 32-bit integers, from the cuts that the lattice gives."""

    def __init__(self, path: str):
        self.codes = Codes((p, np.int32(i).tobytes()) for p, i in vocabulary(model_of(path)).items())

    def ids(self, unit: str, cuts: int = -1) -> bytes:
        left, a, parts = cuts & (1 << len(unit)) - 2, 0, []
        while left:
            z = (left & -left).bit_length() - 1
            parts.append(self.codes[unit[a:z]])
            left, a = left & left - 1, z
        return b"".join([*parts, self.codes[unit[a:]]])

    def all(self, table: pa.Table) -> dict[str, bytes]:
        """Ids of the units of a table (unit, cuts)."""
        out = {}
        for b in table.select(["unit", "cuts"]).to_batches(max_chunksize=50_000):
            out.update((u, self.ids(u, c)) for u, c in zip(b["unit"].to_pylist(), b["cuts"].to_pylist()))
        return out


class UnitIds(dict):
    """Ids of a group's units: those folded, and what has no edge or is put together from windows when it is first met."""

    def __init__(self, folded: pa.Table, path: str):
        self.encoder, self.long = Encoder(path), LongUnits(path)
        super().__init__(self.encoder.all(folded))

    def __missing__(self, u: str) -> bytes:
        self[u] = got = self.encoder.ids(u) if len(u) <= WINDOW else self.long.ids(u, [self[w] for w in self.long.windows(u)])
        return got


class Holed:
    """A text's ids with holes, as bytes: the number of ids, the ids, and for each hole 0 where its unit is the next one, or the number of its unit, from 1, if it was met before; trailing zeros are left out."""

    def __init__(self, path: str):
        self.kind = np.dtype("<u2" if model_of(path).vocab_size() < 0xFFFF else "<u4")
        self.hole = np.array(HOLE).astype(self.kind)

    def pack(self, ids: bytes, units: list[int]) -> bytes:
        k = np.array(units, "<u4")
        met = np.zeros(len(k), bool)
        met[1:] = k[1:] <= np.maximum.accumulate(k)[:-1]  # units are numbered as they are met
        numbers = np.where(met, k + np.uint32(1), np.uint32(0))[: np.flatnonzero(met)[-1] + 1 if met.any() else 0]
        return b"".join([(len(ids) // 4).to_bytes(4, "little"), self.shut(np.frombuffer(ids, "<i4")), numbers.astype("<u4").tobytes()])

    def shut(self, ids: np.ndarray) -> bytes:
        return ids.astype(self.kind).tobytes()

    def opened(self, raw: bytes, n: int) -> tuple[np.ndarray, int]:
        """The ids, HOLE for a hole, of what was shut, and where that ends."""
        ids = np.frombuffer(raw, self.kind, n, 4)
        out = ids.astype("<i4")
        out[ids == self.hole] = HOLE
        return out, 4 + n * self.kind.itemsize

    def fill(self, raw: bytes, units: list[str], ids_of: Callable[[str], bytes]) -> bytes:
        ids, end = self.opened(raw, int.from_bytes(raw[:4], "little"))
        whole, holes = ids.tobytes(), np.flatnonzero(ids == HOLE)
        if not len(holes):
            return whole
        numbers = np.zeros(len(holes), np.int64)
        numbers[: (len(raw) - end) // 4] = np.frombuffer(raw[end:], "<u4")
        numbers = np.where(numbers > 0, numbers, np.cumsum(numbers == 0)) - 1
        parts, a = [], 0
        for z, k in zip((holes * 4).tolist(), numbers.tolist()):
            parts += [whole[a:z], ids_of(units[k])]
            a = z + 4
        return b"".join([*parts, whole[a:]])


class Numbered(Holed):
    """The same with the numbers of known units, which are fewer and smaller than their ids, instead of these: first bytes of all, second bytes of those that have two, then the other two of those that have three. A hole is 0."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray] | None = None):
        """A table, which only filling needs, has the ids of a hole and of all known units by number, and how many each has."""
        if table:
            self.ids, self.many = table
            self.start = np.cumsum(self.many) - self.many

    @staticmethod
    def table(known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(known) >= TOO_MANY:
            raise ValueError(f"{len(known)} known units; numbers end before {TOO_MANY}")
        return np.frombuffer(b"".join([Known.hole, *known]), "<i4"), np.array([1, *(len(x) // 4 for x in known)], np.int64)

    def shut(self, ids: np.ndarray) -> bytes:
        k = ids + 1
        three = k >= THREE
        two = (k >= TWO) & ~three
        long, longer = k[two] - TWO, k[three] - THREE
        first = k.astype(np.uint8)
        first[two], first[three] = TWO + (long >> 8), TWO + 80 + (longer >> 16)
        return b"".join([first.tobytes(), (long & 0xFF).astype(np.uint8).tobytes(), (longer & 0xFFFF).astype("<u2").tobytes()])

    def opened(self, raw: bytes, n: int) -> tuple[np.ndarray, int]:
        k = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
        three = np.flatnonzero(k >= TWO + 80)
        two = np.flatnonzero((k >= TWO) & (k < TWO + 80))
        at, end = 4 + n + len(two), 4 + n + len(two) + 2 * len(three)
        k[two] = TWO + (k[two] - TWO << 8) + np.frombuffer(raw, np.uint8, len(two), 4 + n)
        k[three] = THREE + (k[three] - TWO - 80 << 16) + np.frombuffer(raw, "<u2", len(three), at)
        many = self.many[k]
        last = np.cumsum(many)
        return self.ids[np.arange(many.sum()) + np.repeat(self.start[k] - last + many, many)], end


class Known(dict):
    """Ids, or numbers, of known units; of any other a hole, noted in met."""

    hole = np.int32(HOLE).tobytes()

    def __init__(self, known: dict[str, bytes]):
        super().__init__(known)
        self.met: list[str] = []

    def __missing__(self, u: str) -> bytes:
        self.met.append(u)
        return self.hole


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, then: Callable[[pa.Table], pa.Table] | None = None, gives: str = "text string, ids array<int>", carry: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(id_col, text, ids array<int>): one row per row of docs, with the ids the library gives its whole text.

    Null and empty texts have no ids. Documents are dealt by a hash of id and text to groups of
    some 20 million characters; units that are not frequent are folded once in all, and no table of all units is ever broadcast.
    Repeated rows get equal ids; an empty table gives no rows; further columns are ignored. A function `then` makes of tables
    (id, text, ids) tables of id and what `gives` names, in the worker that encodes. With `carry` the text there is binary: what that function makes of
    a text's bytes, such as a digest; whole texts then don't move.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    pattern = unit_pattern(vocabulary(model_of(path)))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, total // GROUP_CHARS, min(12, total >> 18))
    known = frequent_units(rows, pattern, path, total)  # FREQUENT units at most
    context = rows.sparkSession.sparkContext
    numbered = context.broadcast({u: np.int32(k).tobytes() for k, u in enumerate(known)})
    table = context.broadcast(Numbered.table(list(known.values())))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches):
        units, known, holed, squeeze, press = re.compile(pattern), Known(numbered.value), Numbered(), zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdCompressor(level=NUMBERS_LEVEL).compress
        for b in batches:
            values = []
            for i, t in zip(b["id"].to_pylist(), b["text"]):
                text, known.met = t.as_py(), []
                found = b"".join(map(known.__getitem__, cut(units, text)))
                number = {u: k for k, u in enumerate(dict.fromkeys(known.met))}
                windows = [w for u in number if len(u) > WINDOW for w in LongUnits.windows(u)]
                raw = text.encode()
                values += [None if i is None else i.encode(), carry(raw) if carry else squeeze(raw), press(holed.pack(found, [number[u] for u in known.met])), together([*number, *windows]).encode()]
            yield pa.RecordBatch.from_arrays([b["g"], pa.ListArray.from_arrays(pa.array(range(0, len(values) + 1, 4), pa.int32()), pa.array(values, pa.binary()))], ["g", "d"])

    # A group is a partition, so that no task has several. Id, text, numbers and units are one array: all readers of what is shuffled need the same column, so it is shuffled once.
    g = F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int").alias("g")
    dealt = rows.select(g, F.col("id").cast("string"), "text").mapInArrow(pack, "g int, d array<binary>").repartitionById(int(groups), "g")
    mine = dealt.select("g", F.explode(F.split(F.col("d")[3].cast("string"), BETWEEN)).alias("unit")).select("g", F.translate("unit", " ▁", "▁\n").alias("unit")).where((F.length("unit") > 1) & (F.length("unit") <= WINDOW)).distinct()
    # likewise one array of group and unit, for the fold and for the way back
    pairs = mine.select(F.array(F.col("g").cast("string"), "unit").alias("p")).repartition(int(groups), F.col("p")[1])
    folded = encode_units(pairs.select(F.col("p")[1].alias("unit")).distinct(), path)
    homes = pairs.select(F.col("p")[0].cast("int").alias("of"), F.col("p")[1].alias("unit"))
    back = homes.join(folded.hint("shuffle_hash"), "unit").select("of", "unit", "cuts").repartitionById(int(groups), "of")

    def assemble(texts: pa.Table, units: pa.Table) -> pa.Table:
        ids_of, holed, unpack = UnitIds(units, path).__getitem__, Numbered(table.value), zstandard.ZstdDecompressor().decompress
        parts, own, found, ends = [], [], [], [0]

        def part() -> pa.Table:
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            table = pa.table({"id": pa.array([i for i, _ in own], pa.string()), "text": pa.array([x for _, x in own], pa.binary() if carry else pa.string()), "ids": ids})
            return then(table) if then else table

        for chunk in texts["d"].chunks:
            at, values = chunk.offsets.to_pylist()[: len(chunk)], chunk.values
            for k in at:
                i, text, raw, rare = (values[k + n].as_py() for n in range(4))
                own.append((None if i is None else i.decode(), text if carry else unpack(text).decode()))
                found.append(holed.fill(unpack(raw), apart(rare.decode()), ids_of))
                ends.append(ends[-1] + len(found[-1]) // 4)
                if ends[-1] >= PART_IDS:
                    parts.append(part())
                    own, found, ends = [], [], [0]
        return pa.concat_tables([*parts, part()])

    out = dealt.groupBy("g").cogroup(back.groupBy("of")).applyInArrow(assemble, f"id string, {gives}")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


class LongUnits:
    """Ids of units of over WINDOW characters, from those of their windows.

    An encoding is right if, and only if, any two neighbours in it are the encoding of their own
    text: the merges within a stretch of whole tokens are those of the stretch alone. So the encodings of two windows join at a token that both
    have at the same place. Where two windows share none, the library encodes the unit.
    """

    def __init__(self, path: str):
        self.model = model_of(path)
        self.size = [0 if self.model.is_byte(i) else len(self.model.id_to_piece(i)) for i in range(self.model.vocab_size())]

    @staticmethod
    def windows(unit: str) -> list[str]:
        return [unit[k * STEP : k * STEP + WINDOW] for k in range(max(0, -(-(len(unit) - WINDOW) // STEP)) + 1)]

    def tokens(self, text: str, ids: list[int], at: int) -> list[tuple[int, int, list[int]]]:
        """(start, end, ids) of each token; the bytes of a character outside the vocabulary are one."""
        out, k, p = [], 0, 0
        while k < len(ids):
            n, many = (self.size[ids[k]], 1) if self.size[ids[k]] else (1, len(text[p].encode()))
            out.append((at + p, at + p + n, ids[k : k + many]))
            k, p = k + many, p + n
        return out

    def ids(self, unit: str, found: list[bytes]) -> bytes:
        if (got := self.joined(unit, found)) is None:
            whole = self.model.encode("\n" + unit)[2:] if unit[0] != "▁" else self.model.encode(unit[1:].replace("▁", " "))
            return np.array(whole, np.int32).tobytes()
        return got

    def joined(self, unit: str, found: list[bytes]) -> bytes | None:
        """The ids from those of the windows; None where two windows share no token."""
        out: list[tuple[int, int, list[int]]] = []
        for k, (w, raw) in enumerate(zip(self.windows(unit), found)):
            more = self.tokens(w, np.frombuffer(raw, np.int32).tolist(), k * STEP)
            if k:
                where, last = {t[:2]: i for i, t in enumerate(more)}, len(out) - 1
                while last >= 0 and out[last][1] > k * STEP and out[last][:2] not in where:
                    last -= 1
                if last < 0 or out[last][:2] not in where:
                    return None
                more = more[where[out[last][:2]] + 1 :]
                del out[last + 1 :]
            out += more
        return np.array([i for t in out for i in t[2]], np.int32).tobytes()


class Decoder:
    """Texts of ids: byte pieces joined to characters and the mark at the start taken off; null for null."""

    def __init__(self, path: str):
        model = model_of(path)
        self.raw = [bytes([i - 3]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]

    def texts(self, ids: pa.ListArray) -> Iterator[str | None]:
        one = lambda x: b"".join(map(self.raw.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())).decode(errors="replace").removeprefix(" ")
        return (one(x) if x.is_valid else None for x in ids)


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """rows with text_col: the text of ids_col. Null ids give a null text, no ids the empty one; a column named text_col before is replaced."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        decoder = Decoder(path)
        for b in batches:
            names = [c for c in b.schema.names if c != text_col]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(list(decoder.texts(b[ids_col])), pa.string())], [*names, text_col])

    kept = [f for f in rows.schema.fields if f.name != text_col]
    return rows.mapInArrow(run, type(rows.schema)(kept).add(text_col, "string"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip: whether decoding gives the text again, by 128-bit hashes of both."""
    path = public_tokenizers.path("piece_bpe_32k.model")

    def digest(t: pa.Table) -> pa.Table:
        decoder, ids = Decoder(path), t["ids"].combine_chunks()
        crc = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4")) for x in ids]
        same = [x == xxhash.xxh3_128_digest(y.encode()) for x, y in zip(t["text"].to_pylist(), decoder.texts(ids))]
        return pa.table({"id": t["id"], "n_ids": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same, pa.bool_())})

    return encode(read_table(spark, sf_dir, "documents"), path=path, then=digest, gives="n_ids long, ids_crc32 long, round_trip boolean", carry=xxhash.xxh3_128_digest)
