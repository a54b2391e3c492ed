"""Best-fit packing of tokenised documents into fixed-length sequences.

Bulk-synchronous best-fit: every round range-sorts the unplaced pieces and the
open gaps together by size, and each range sweeps upwards: a piece waits, a gap
takes the largest waiting pieces that fit. What a range cannot settle is settled
between ranges by rank: the driver sees four numbers for each range, never rows,
and gives the leftover gaps of a range, in order, to the largest leftover pieces
below it. Gaps shrink, the largest of the rest open new sequences, and the next
round starts, until every piece has a place.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, discard, materialise, running, trim, width

CAPACITY = 2048
#: Pieces of a range, about: what a task keeps waiting, however many pieces there are.
RANGE = 200_000
#: Rows that a worker encodes at a time.
SLICE = 2560
#: Words that a worker remembers, about; those that recur among the rows it encodes at a time.
WORDS = 250_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _signs() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class WordEncoder:
    """Token ids by a byte-level tokenizer file, once for each distinct word.

    The vocabulary's pre-tokenizer never joins a word with what follows it and takes one space before it along, so a
    text whose words are set apart by single spaces or line feeds is the concatenation of its words' ids. Any other
    text, and one that holds a token added to the vocabulary, goes to the tokenizer whole. The memory is bounded;
    forgetting costs time only.
    """

    #: Any white space but single spaces and line feeds between words.
    ODD = (
        "[\\x09\\x0B-\\x0D\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
        "|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
    )

    def __init__(self, path: str, ordinary: bool = False, most: int = WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([self.ODD, *(regex.escape(t, special_only=True) for t in added)])
        self.merge, self.most = self.tokenizer.model.tokenize, most
        self.signs = {byte: sign for byte, sign in _signs().items() if byte != 10}
        #: Words after a space and bare ones, and the ids of each.
        self.spaced: tuple[pa.Array, list[bytes]] = pa.array([], pa.string()), []
        self.bare: tuple[pa.Array, list[bytes]] = pa.array([], pa.string()), []
        self.parts: dict[str, bytes] = {}
        self.split = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+").findall

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _part(self, signs: str) -> bytes:
        """Ids of one pre-token, given in signs: the model alone, without the pipeline around it."""
        return self.pack([t.id for t in self.merge(signs)])

    def _signs(self, text: str) -> str:
        return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.signs)

    def _fresh(self, words: list[str], prefix: str) -> list[bytes]:
        """Ids of words; of those cut into several pre-tokens, the parts are remembered."""
        out: list[bytes] = [b""] * len(words)
        whole, parts = [], self.parts
        for k, word in enumerate(words):
            if word.isascii() and word.isalpha():
                whole.append(k)
            # an apostrophe may begin a contraction, and tables of letters differ outside the Latin blocks
            elif "'" in word or not word.isascii() and max(word) > "ɏ":
                out[k] = self.pack(self.tokenizer.encode(prefix + word, add_special_tokens=False).ids)
            elif word:
                own = self.split(prefix + word)
                if len(own) == 1:  # remembered as a word
                    whole.append(k)
                    continue
                for part in own:
                    if part not in parts:
                        parts[part] = self._part(self._signs(part))
                out[k] = b"".join([parts[part] for part in own])
        if whole:  # no word holds a line feed
            signs = self._signs("\n".join([prefix + words[k] for k in whole])).split("\n")
            for k, ids in zip(whole, map(self._part, signs)):
                out[k] = ids
        return out

    def _known(self, words: pa.Array, counts: np.ndarray, prefix: str) -> list[bytes]:
        """Ids of distinct words; those that recur are remembered, as most others never come again."""
        if len(self.parts) > 2 * self.most:
            self.parts.clear()
        names, ids = self.spaced if prefix else self.bare
        at = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        # a line feed's ids are set by the caller
        fresh = self._fresh(["" if w == "\n" else w for w in words.take(pa.array(new)).to_pylist()], prefix)
        every = ids + fresh
        at = at.astype(np.int64)
        at[new] = len(ids) + np.arange(len(new))
        found = list(map(every.__getitem__, at.tolist()))
        again = np.flatnonzero((at < len(ids)) | (counts > 1)) if len(ids) > self.most else new[counts[new] > 1]
        if len(ids) > self.most:
            names, ids = names[:0], []
        kept = pa.concat_arrays([names, words.take(pa.array(again))]), ids + [found[k] for k in again.tolist()]
        if prefix:
            self.spaced = kept
        else:
            self.bare = kept
        return found

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        odd = np.asarray(pc.match_substring_regex(texts, self.odd))
        plain = texts.filter(pa.array(~odd))
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n "), " ")
        words = lists.flatten().dictionary_encode()
        distinct, code = words.dictionary.cast(pa.string()), np.asarray(words.indices)
        ends = np.asarray(lists.offsets)
        feed = pc.index(distinct, "\n").as_py()
        first = np.zeros(len(code), bool)
        first[ends[:-1][np.diff(ends) > 0]] = True
        first[1:] |= code[:-1] == feed
        first &= code != feed
        heads, place = np.unique(code[first], return_inverse=True)
        code = code.astype(np.int64)
        code[first] = len(distinct) + place
        counts = np.bincount(code, minlength=len(distinct) + len(heads))
        ids = self._known(distinct, counts[: len(distinct)], " ") + self._known(distinct.take(pa.array(heads)), counts[len(distinct) :], "")
        if feed >= 0:
            ids[feed] = self.pack(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        of, row = ids.__getitem__, 0
        for k, whole in enumerate(odd):
            if whole:
                yield np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
                continue
            own = code[ends[row] : ends[row + 1]].tolist()
            row += 1
            yield np.frombuffer(b"".join(map(of, own)), np.uint32)


def _cut(path: str, capacity: int, keep_ids: bool, ordinary: bool, rows: int = SLICE, most: int = WORDS):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path, ordinary, most)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part, out = batch.slice(at, rows), {k: [] for k in schema.names}
                texts = pc.fill_null(part.column(1), "")
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    raw = ids.astype("<u4").tobytes() + b"\0\0\0\0"
                    n = len(raw) // 4
                    start, piece = 0, 0
                    length = n if n <= capacity else n % capacity or capacity
                    while start < n:
                        own = raw[4 * start : 4 * (start + length)]
                        for k, v in zip(schema.names, (doc, piece, start, length, zlib.crc32(own), own if keep_ids else None)):
                            out[k].append(v)
                        start, piece, length = start + length, piece + 1, capacity
                    if len(out["doc_id"]) >= 512:
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        out = {k: [] for k in schema.names}
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                trim()
        # the worker lives on, and serves other operators
        del encoder
        trim()

    return run


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", ordinary: bool = False, rows: int = SLICE, most: int = WORDS) -> DataFrame:
    """Pieces of each document: its ids and a closing id 0, cut into ``capacity`` ids (the first piece takes the remainder) only where longer.

    ``path`` names the tokenizer file, which must be on every executor. Null text counts as empty. The strings of special
    tokens in a text become their ids, as the tokenizer does by default; with ``ordinary`` they are text like any other.
    A worker takes ``rows`` rows at a time and remembers about ``most`` words: fewer take less memory and more time.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_cut(path, capacity, keep_ids, ordinary, rows, most), _PIECES)


_SWEPT = "tag string, range int, rank long, id long, size long, home long, at long, facts array<long>"
#: What the driver learns of a range: numbers in its row of tag S.
_FACTS = ("placed", "pieces", "longest", "shortest", "length", "halves", "gaps", "least_gap", "room")


def _sweep(capacity: int):
    """Within one range, sorted upwards with pieces before gaps of their size: A placed, I waiting, G untouched gap, N shrunk gap; at last one row S of the range's facts."""
    kinds = (pa.string(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64()))
    schema = pa.schema(list(zip([c.split()[0] for c in _SWEPT.split(", ")], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, waiting, untouched, placed, least_gap, room = TaskContext.get().partitionId(), [], 0, 0, 0, 0
        out: list[tuple] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for gap, key, size in zip(*(c.to_pylist() for c in batch.select(["gap", "id", "size"]).columns)):
                if not gap:
                    waiting.append((key, size))
                    continue
                left = size
                if not waiting:
                    out.append(("G", own, untouched, key, size, None, None, None))
                    least_gap = least_gap or size
                    untouched += 1
                else:
                    while waiting and waiting[-1][1] <= left:
                        piece, n = waiting.pop()
                        out.append(("A", own, None, piece, n, key, capacity - left, None))
                        left -= n
                        placed += 1
                    out.append(("N", own, None, key, left, None, None, None))
                room += left
            if out:
                yield batch_of(out)
                out = []
        for rank, (key, size) in enumerate(reversed(waiting)):
            out.append(("I", own, rank, key, size, None, None, None))
            if len(out) == 50_000:
                yield batch_of(out)
                out = []
        if waiting or untouched or placed or room:
            sizes = [size for _, size in waiting]
            halves = sum(size * 2 > capacity for size in sizes)
            facts = [placed, len(sizes), max(sizes, default=0), min(sizes, default=capacity), sum(sizes), halves, untouched, least_gap, room]
            yield batch_of([*out, ("S", own, None, None, None, None, None, facts)])

    return run


def _settle(ranges: list[dict], capacity: int) -> tuple[list[tuple], list[tuple], int]:
    """From each range's leftovers: (gap range, first gap, piece range, first piece, pieces, pieces a gap), (range, pieces used, pieces that open), pieces placed."""
    stack, deals, used = [], [], {}
    for r in ranges:
        gaps, first = r["gaps"], 0
        while gaps and stack:
            below = stack[-1]
            each = max(1, r["least_gap"] // below["longest"])
            take = min(gaps, -(-below["left"] // each))
            pieces = min(below["left"], take * each)
            deals.append((r["range"], first, below["range"], used.get(below["range"], 0), pieces, each))
            used[below["range"]] = used.get(below["range"], 0) + pieces
            below["left"] -= pieces
            gaps, first = gaps - take, first + take
            if not below["left"]:
                stack.pop()
        if r["pieces"]:
            stack.append({"range": r["range"], "left": r["pieces"], "longest": r["longest"]})
    placed = sum(d[4] for d in deals) + sum(r["placed"] for r in ranges)
    rest = sum(r["length"] * (r["pieces"] - used.get(r["range"], 0)) / r["pieces"] for r in ranges if r["pieces"])
    halves = sum(max(0, r["halves"] - used.get(r["range"], 0)) for r in ranges)
    pieces = sum(r["pieces"] for r in ranges) - sum(used.values())
    room = sum(r["room"] for r in ranges)
    if placed * 4 < pieces:
        room = 0  # what is open is too narrow: open as many as the rest fills
    opened = min(pieces, max(halves, int(-(-(rest - room) // capacity)), 0 if placed else 1))
    seeds, left = {}, opened
    for r in reversed(ranges):
        seeds[r["range"]] = min(left, r["pieces"] - used.get(r["range"], 0))
        left -= seeds[r["range"]]
    return deals, [(r["range"], used.get(r["range"], 0), seeds[r["range"]]) for r in ranges if r["pieces"]], placed + opened


def _table(spark: SparkSession, rows: list[tuple], **columns: str) -> DataFrame:
    """A table of some rows of integers, by Arrow: rows that are pickled would start Python workers of another kind on the executors."""
    kinds = {"int": pa.int32(), "long": pa.int64()}
    arrays = [pa.array([r[k] for r in rows], kinds[kind]) for k, kind in enumerate(columns.values())]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(columns)), ", ".join(f"{c} {kind}" for c, kind in columns.items()))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``uid, home, at`` for ``uid, length`` (unique ids, lengths from 1 to capacity): the sequence of each piece and its offset there."""
    spark = pieces.sparkSession
    whole = pieces.where(F.col("length") == capacity).select("uid", F.col("uid").alias("home"), F.lit(0).cast("long").alias("at"))
    state = pieces.where(F.col("length") < capacity).select(F.lit(False).alias("gap"), F.col("uid").alias("id"), F.col("length").alias("size"))
    done = [whole]
    left = state.count()
    while left:
        n = max(2, min(width(spark), -(-left // 8000)), left // RANGE)
        sorted_ = state.repartitionByRange(n, "size", "gap", "id").sortWithinPartitions("size", "gap", "id")
        swept = materialise(sorted_.mapInArrow(_sweep(capacity), _SWEPT), "swept")
        is_ = lambda tag: F.col("tag") == tag
        found = swept.where(is_("S")).select("range", "facts").collect()  # one row a range
        ranges = sorted(({"range": r.range, **dict(zip(_FACTS, r.facts))} for r in found), key=lambda r: r["range"])
        least = min(r["shortest"] for r in ranges)
        deals, opens, _ = _settle(ranges, capacity)
        taken = {}
        for gap_range, first, _, _, n, each in deals:
            taken[gap_range] = first + -(-n // each)
        opens = {r: (used, seeds) for r, used, seeds in opens}
        plan = [(r["range"], *opens.get(r["range"], (0, 0)), taken.get(r["range"], 0)) for r in ranges]
        plan = F.broadcast(_table(spark, plan, range="int", used="long", seeds="long", taken="long"))  # plan and deals: a few rows for each partition
        swept_on = swept.where(~is_("S")).join(plan, "range")
        none = F.lit(None).cast("long")
        item = lambda tag, key, size, home=none, at=none: F.struct(F.lit(tag).alias("tag"), F.col(key).alias("id"), size.alias("size"), home.alias("home"), at.alias("at"))
        dealt_out = is_("I") & (F.col("rank") < F.col("used")) | is_("G") & (F.col("rank") < F.col("taken"))
        seeded = [item("A", "id", F.col("size"), F.col("id"), F.lit(0).cast("long")), item("G", "id", F.lit(capacity) - F.col("size"))]
        items = (
            F.when(is_("A"), F.array(item("A", "id", F.col("size"), F.col("home"), F.col("at"))))
            .when(is_("I") & (F.col("rank") < F.col("used") + F.col("seeds")), F.array(*seeded))
            .when(is_("I"), F.array(item("I", "id", F.col("size"))))
            .otherwise(F.array(item("G", "id", F.col("size"))))
        )
        after = swept_on.where(~dealt_out).select(F.inline(items))
        if deals:
            dealt = _table(spark, deals, gap_range="int", first_gap="long", range="int", first="long", n="long", each="long")
            chosen = swept_on.where(is_("I") & dealt_out).join(F.broadcast(dealt), "range").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
            gap_rank = (F.col("first_gap") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("long")
            chosen = chosen.select("gap_range", gap_rank.alias("gap_rank"), F.struct("rank", "id", "size").alias("piece"), none.alias("bin"), none.alias("room"))
            open_ = swept_on.where(is_("G") & dealt_out).select(F.col("range").alias("gap_range"), F.col("rank").alias("gap_rank"), F.lit(None).cast("struct<rank:bigint,id:bigint,size:bigint>").alias("piece"), F.col("id").alias("bin"), F.col("size").alias("room"))
            # a gap takes at most capacity pieces, so its list is bounded
            met = chosen.unionByName(open_).groupBy("gap_range", "gap_rank").agg(F.max("bin").alias("bin"), F.max("room").alias("room"), F.sort_array(F.collect_list("piece")).alias("own"))
            met = met.withColumn("upto", running(F.transform("own", lambda x: x.size), lambda x, y: x + y))
            inside = F.zip_with("own", "upto", lambda x, upto: F.struct(F.lit("A").alias("tag"), x.id.alias("id"), x.size.alias("size"), F.col("bin").alias("home"), (F.lit(capacity) - F.col("room") + upto - x.size).alias("at")))
            shrunk = F.array(item("G", "bin", F.col("room") - F.element_at("upto", -1)))
            after = after.unionByName(met.select(F.inline(F.concat(inside, shrunk))))
        after = materialise(after.where((F.col("tag") != "G") | (F.col("size") >= least)), "packed")
        done.append(after.where(is_("A")).select(F.col("id").alias("uid"), "home", "at"))
        state = after.where(F.col("tag") != "A").select(is_("G").alias("gap"), "id", "size")
        left = sum(r["pieces"] for r in ranges) - sum(used + seeds for used, seeds in opens.values())
        discard(swept)
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return placed


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", ordinary: bool = False, rows: int = SLICE, most: int = WORDS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``; no sequence is longer than ``capacity``.

    Null text counts as empty (one id). Repeated rows and null ids are packed like any other rows. Ties in length are
    broken by row. An empty table gives no rows. Other columns are not read. ``rows`` and ``most`` as in ``tokenise``.
    """
    pieces = tokenise(docs, path, capacity, keep_ids, id_col, text_col, ordinary, rows, most).withColumn("uid", F.monotonically_increasing_id())
    with batches_of(pieces.sparkSession, rows):
        pieces = materialise(pieces, "pieces")
    placed = place(pieces.select("uid", "length"), capacity)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "ids", F.col("home").alias("sequence_id"), F.col("at").alias("offset"))
