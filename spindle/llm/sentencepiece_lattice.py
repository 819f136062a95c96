"""Operator 3: SentencePiece encoding and decoding over a relational lattice.

Every distinct word is encoded once: its substrings of bounded length are exploded and equi-joined with the piece table, which gives the
edges of a lattice; the edges are grouped by word, those on no allowed path are left out, and the others are folded by a Viterbi recursion in
Spark's ``aggregate``.  For unigram models every
two edges that meet may follow one another.  For models trained by merging (BPE) an edge may only follow one that the merge rule leaves
beside it; exactly one path is then left, the one that SentencePiece's own merging gives.

The ``HEAD_WORDS`` most frequent words of ``HEAD_BYTES`` and the ``LONG_WORDS`` ones of ``LONG_BYTES`` at most reach all executors as a
dictionary of a bounded size; all others are joined by word.

Text form: one space is put in front, spaces become U+2581, nothing else is normalised; characters without a piece become byte pieces.
A U+2581 in the text itself changes places with the space: it is kept apart from spaces and encoded as bytes, and all other characters stand for
themselves, so that decoding always returns the text.

Defined cases: null gives null ids and null text; an empty text gives no ids; ids may repeat or be null; rows repeat as they do in the
input; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import cut, drop, order_id, packed, partitions, row_key, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
HEAD_WORDS = 1 << 17  #: words whose encoding all tasks hold
HEAD_BYTES = 64  #: largest UTF-8 size of these; a code has four bytes for each of them at most, so all together stay under 45 MB besides the objects
LONG_WORDS, LONG_BYTES = 1000, 4096  #: the same for longer ones (under 21 MB): so few that only very frequent ones are among them
COUNTED_WORDS, COUNTED_CHARS = 60_000, 1 << 25  #: distinct words, and characters read, after which a task hands its counts on
LONG_WORD = 24  #: longer units are cut where no piece reaches across, so that texts without spaces don't become one word each
PAIRS = 100_000  #: pairs of pieces whose standing side by side a task remembers
VERDICTS = 1 << 19  #: places of a table for the same, of nine bytes each
CHUNKS, CHUNK_CHARS = 60_000, 64  #: what stands between two spaces is coded once and remembered: so many, of so many characters at most
SEEN = 20_000  #: rows whose keys a task remembers, so that repeated ones are left out
ROWS_AT_ONCE = 1_000  #: rows that are turned into Python objects together
FOLD_LIMIT = 1024  #: longer words without such a place are folded by the Arrow helper
LATTICE_PARTS = 4  #: the edges of a lattice are many times its words, so its tasks are smaller than others
SPACE = "▁"
OWN_SPACE = " "  #: stands for a U+2581 of the text: its spaces have become U+2581, so no text holds one any more, and no piece does
SWAPPED = str.maketrans(" " + SPACE, SPACE + OWN_SPACE)


class Pieces:
    """The piece table of a model, and for merged models which pieces may stand side by side."""

    def __init__(self, rows: list[tuple[int, str, float]], first_byte: int, merged: bool):
        self.rows, self.first_byte, self.merged = rows, first_byte, merged
        self.longest = max((len(p) for _, p, _ in rows), default=1)
        self.text = {i: p for i, p, _ in rows}
        self.id = {p: i for i, p, _ in rows}
        self.score = {p: s for _, p, s in rows}
        self.pairs = {p[k : k + 2] for _, p, _ in rows for k in range(len(p) - 1)}
        self.unit = re.compile(self.unit_pattern())
        self.spines: dict[int, tuple[list, list]] = {}
        self.beside: dict[int, bool] = {}
        self.table: tuple[np.ndarray, np.ndarray] | None = None
        self.sent: tuple | None = None

    def everywhere(self, spark: SparkSession) -> Broadcast:
        """These pieces on all executors, sent once a context."""
        if self.sent is None or self.sent[0] is not spark.sparkContext:
            self.sent = (spark.sparkContext, spark.sparkContext.broadcast(self))
        return self.sent[1]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": [], "spines": {}, "beside": {}, "table": None, "sent": None}  # tasks don't need the table, and remember their own

    def forget(self) -> Pieces:
        """These pieces without what was remembered for the lattice: Python processes outlive its tasks and would hold it in later steps."""
        self.spines.clear()
        self.beside.clear()
        self.table = None
        return self

    def unit_pattern(self) -> str:
        """How a text is cut into units: leading spaces belong to the word after them; a line feed has no piece and stands alone.

        Runs of letters and digits are also cut from runs of other characters, which hold the few letters that pieces join to such, unless a
        piece still reaches across.
        """
        letter = lambda char, but="": bool(re.match(r"[^\W_]", char)) and char not in but
        inner = [p for p in self.pairs if SPACE not in p]
        odd = "".join(sorted({c for p in inner if letter(p[0]) != letter(p[1]) for c in p if letter(c)}))
        if any(letter(a, odd) != letter(b, odd) for a, b in inner):
            return f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
        one = f"[^\\W_{re.escape(odd)}]"
        return f"\n|{SPACE}*{one}+|{SPACE}*(?:(?!{one})[^{SPACE}\n])+|{SPACE}+"

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = [(i, model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
                if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        first = next((i for i in range(model.get_piece_size()) if model.is_byte(i)), 0)
        merged = all(float(s).is_integer() for _, _, s in rows)  # merged models score a piece by its rank
        return Pieces(rows, first, merged)

    def spine(self, piece: int) -> tuple[list, list]:
        """Symbols that bound the piece on its left and right while it is merged, each with the score of the merge that ends it."""
        if piece not in self.spines:
            symbols = list(self.text[piece])
            left, right = [], []
            ends = [symbols[0], symbols[-1]]
            while len(symbols) > 1:
                best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.score), default=None)
                if best is None:
                    break
                k = -best[1]
                symbols[k : k + 2] = [self.text[self.id[symbols[k] + symbols[k + 1]]]]
                if symbols[0] != ends[0]:
                    left.append((ends[0], best[0]))
                if symbols[-1] != ends[1]:
                    right.append((ends[1], best[0]))
                ends = [symbols[0], symbols[-1]]
            whole = len(symbols) == 1
            left.append((ends[0], -np.inf))
            right.append((ends[1], -np.inf))
            self.spines[piece] = (left, right) if whole else ([], [])
        return self.spines[piece]

    def reachable(self, piece: int) -> bool:
        return not self.merged or piece < 0 or bool(self.spine(piece)[0])

    def allowed(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` side by side: no symbols that meet at their border join before they are absorbed.

        A merge of higher score goes first; of equal ones the left one does.
        """
        if not self.merged or a < 0 or b < 0:
            return True
        key = a << 32 | b
        if key not in self.beside:
            if len(self.beside) > PAIRS:
                self.beside.clear()
            self.beside[key] = self.apart(a, b)
        return self.beside[key]

    def apart(self, a: int, b: int) -> bool:
        score, left = self.score.get, self.spine(b)[0]
        for x, end_x in self.spine(a)[1]:
            for y, end_y in left:
                if (s := score(x + y)) is not None and s > end_x and s >= end_y:
                    return False
        return True

    def words(self, text: str) -> list[str]:
        """The text as words, in order; each is encoded on its own."""
        units = self.unit.findall(SPACE + (text.translate(SWAPPED) if SPACE in text else text.replace(" ", SPACE)))
        if max(map(len, units), default=0) <= LONG_WORD:
            return units
        return [word for unit in units for word in ((unit,) if len(unit) <= LONG_WORD else self.parts(unit))]

    def parts(self, unit: str) -> list[str]:
        """The unit, cut wherever no piece holds the two characters that meet: no path can reach across."""
        pairs = self.pairs
        cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in pairs]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)] if cuts else [unit]

    def bytes_of(self, char: str) -> list[int]:
        raw = (SPACE if char == OWN_SPACE else char).encode("utf-8", "surrogatepass")
        return [self.first_byte + b for b in raw]

    def ids(self, word: str, path: list[int]) -> list[int]:
        """Piece ids of a path; -1 (no piece) becomes the bytes of its character."""
        out, at = [], 0
        for piece in path:
            if piece < 0:
                out += self.bytes_of(word[at])
                at += 1
            else:
                out.append(piece)
                at += len(self.text[piece])
        return out

    def verdicts(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """``allowed`` for many pairs of pieces at once; each pair has a place in a table of bounded size, which it takes from the one before."""
        if not self.merged:
            return np.ones(len(before), dtype=bool)
        if self.table is None:
            self.table = np.full(VERDICTS, -1, dtype=np.int64), np.zeros(VERDICTS, dtype=bool)
        known, verdict = self.table
        keys = before.astype(np.int64) << 32 | after
        ok = (before < 0) | (after < 0)
        slot = (keys * 0x1E3779B97F4A7C15 >> 40) & (VERDICTS - 1)
        out = ok | verdict[slot]
        missed = np.flatnonzero(~ok & (known[slot] != keys))
        if len(missed):
            new, place = np.unique(keys[missed], return_inverse=True)
            apart = self.apart
            found = np.array([apart(key >> 32, key & 0xFFFFFFFF) for key in new.tolist()], dtype=bool)
            out[missed] = found[place]
            taken, one = np.unique(slot[missed], return_index=True)
            known[taken], verdict[taken] = keys[missed[one]], out[missed[one]]
        return out

    def alive(self, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is left of the lattices of some words: the edges on allowed paths (their numbers, and where each word's begin among them), and
        the edges before each (numbers within the word, -1 for its start, and where each edge's begin).

        The edges of word ``w`` are those from ``first[w]`` up to ``first[w + 1]``, ordered by end.
        """
        sizes, m = np.diff(first), len(ids)
        length = ends[first[1:] - 1].astype(np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        base = np.concatenate([[0], np.cumsum(length + 1)])
        until = np.concatenate([[0], np.cumsum(np.bincount(base[word] + ends, minlength=int(base[-1])))])  # edges that end before each place, all words one after the other
        at = base[word] + starts
        low, n = until[at], until[at + 1] - until[at]
        after = np.repeat(np.arange(m), n)
        before = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(after))
        ok = self.verdicts(ids[before], ids[after])
        opens, closes = starts == 0, ends == length[word]
        while True:
            before, after = before[ok], after[ok]
            kept = (opens | (np.bincount(after, minlength=m) > 0)) & (closes | (np.bincount(before, minlength=m) > 0))
            ok = kept[before] & kept[after]
            if ok.all():
                break
        number = np.cumsum(kept) - 1
        begin = np.concatenate([[0], np.cumsum(kept)])[first]
        heads = np.flatnonzero(kept & opens)
        order = np.argsort(np.concatenate([after, heads]), kind="stable")
        own = np.concatenate([number[before] - begin[word[before]], np.full(len(heads), -1)])[order]
        each = np.bincount(np.concatenate([number[after], number[heads]]), minlength=int(begin[-1]))
        return np.flatnonzero(kept), begin, own, np.concatenate([[0], np.cumsum(each)])

    def code(self, word: str, path: list[int]) -> bytes:
        """The ids of a path as 32-bit integers."""
        return np.array(self.ids(word, path), dtype=np.uint32).tobytes()

    def raw(self) -> list[bytes]:
        """The bytes that each id stands for."""
        out = [b""] * (1 + max([self.first_byte + 255, *self.text]))
        for i, piece in self.text.items():
            out[i] = piece.replace(SPACE, " ").encode("utf-8")
        out[self.first_byte : self.first_byte + 256] = [bytes([b]) for b in range(256)]
        return out


def decoded(ids: np.ndarray, raw: list[bytes]) -> str:
    out = b"".join(map(raw.__getitem__, ids.tolist()))
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "surrogatepass")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Steps that are run inside move ``ROWS_AT_ONCE`` rows at once between the JVM and Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def chunks_of(text: str) -> list[str] | None:
    """What stands between the spaces of a text.  Words end before a space unless spaces meet; such texts and those with a U+2581 have none."""
    chunks = text.split(" ")
    return None if "" in chunks or SPACE in text else chunks


class Coder(dict):
    """What stands between two spaces, and its code if ``frequent`` has all its words."""

    def __init__(self, pieces: Pieces, frequent: dict[str, bytes]):
        super().__init__()
        self.pieces, self.frequent, self.missed = pieces, frequent, 0

    def __missing__(self, chunk: str) -> tuple[str, ...] | bytes:
        out = self.coded(self.pieces.words(chunk))
        if type(out) is bytes and len(chunk) <= CHUNK_CHARS:
            if len(self) < CHUNKS:
                self[chunk] = out
            else:
                self.missed += 1
                if self.missed >= CHUNKS:
                    self.clear()
                    self.missed = 0
        return out

    def coded(self, words: list[str]) -> tuple[str, ...] | bytes:
        codes = list(map(self.frequent.get, words))
        return tuple(words) if None in codes else b"".join(codes)

    def parts(self, text: str) -> list[tuple[str, ...] | bytes]:
        """The text, part by part: codes, and words where one is missing in the dictionary."""
        chunks = chunks_of(text)
        return [self.coded(self.pieces.words(text))] if chunks is None else list(map(self.__getitem__, chunks))

    def rare(self, parts: Iterable[tuple[str, ...] | bytes]) -> list[str]:
        """The words that the dictionary lacks, in the order in which they come."""
        return list(dict.fromkeys(w for part in parts if type(part) is tuple for w in part if w not in self.frequent))


def counted_words(docs: DataFrame, pieces: Pieces, text_col: str) -> DataFrame:
    """``(word, n)`` of all words of all texts; tasks add up their own first."""
    shared = pieces.everywhere(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, chunks, chars = Counter(), Counter(), 0
        words = shared.value.words

        def out() -> pa.RecordBatch:
            for chunk, n in chunks.items():  # each is cut once
                for word in words(chunk):
                    counts[word] += n
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            chunks.clear()
            return batch

        for batch in batches:
            for t in batch.column(0):
                text = t.as_py()
                found = chunks_of(text)
                if found is None:
                    counts.update(words(text))
                else:
                    chunks.update(found)
                chars += len(text)
                if len(counts) + len(chunks) > COUNTED_WORDS or chars > COUNTED_CHARS:
                    yield out()
                    chars = 0
        yield out()

    found = docs.select(F.col(text_col).alias("text")).where("text <> ''").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """The pieces that a path may use: for merged models those that merging can make."""
    return spark.createDataFrame([r for r in pieces.rows if pieces.reachable(r[0])], "id int, piece string, score double")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``(word, n, edges)``: the pieces inside each word, ordered by end and start; a character without a piece is an edge with id -1.

    ``words`` must be partitioned by ``word``: exploding and a broadcast join (the piece table has a fixed size) keep that, so the edges are
    grouped where they arise.
    """
    spots = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    longest = F.least(F.lit(pieces.longest), F.length("word") - F.col("s") + 1)
    spots = spots.select("word", "n", "s", F.explode(F.sequence(F.lit(1), longest)).alias("l"))
    spots = spots.withColumn("piece", F.substring("word", F.col("s"), F.col("l")))
    edges = spots.join(F.broadcast(piece_table(words.sparkSession, pieces)), "piece", "left").where("id is not null or l = 1")
    edge = F.struct((F.col("s") + F.col("l") - 1).alias("e"), (F.col("s") - 1).alias("s"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(-1e9)).alias("score"))
    return edges.groupBy("word").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(edge)).alias("edges"))


def viterbi(grid: DataFrame, pieces: Pieces) -> DataFrame:
    """``(word, n, path)``: the best allowed path through each lattice, by two folds over its edges."""
    shared = pieces.everywhere(grid.sparkSession)

    def followed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            edges = batch.column(2)
            first = edges.offsets.to_numpy().astype(np.int64)
            all_edges = edges.values.slice(first[0], first[-1] - first[0])
            ends, starts, ids = (all_edges.field(k).to_numpy() for k in range(3))
            places, begin, before, each = shared.value.alive(first - first[0], starts, ends, ids)
            inner = pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), pa.array(before.astype(np.int32)))
            lists = [pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), x) for x in (all_edges.take(pa.array(places)), inner)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["word", "n", "edges", "before"])

    forward = F.expr(
        """aggregate(sequence(0, size(edges) - 1), cast(array() as array<struct<total: double, back: int>>), (acc, k) ->
             concat(acc, array(coalesce(
               array_max(transform(filter(before[k], j -> j < 0 or acc[j].back > -2),
                 j -> named_struct('total', edges[k].score + if(j < 0, 0d, acc[j].total), 'back', j))),
               named_struct('total', -1e300d, 'back', -2)))))"""
    )
    last = F.expr(
        """array_max(transform(filter(sequence(0, size(edges) - 1), k -> edges[k].e = length(word) and best[k].back > -2),
             k -> named_struct('total', best[k].total, 'k', k))).k"""
    )
    backward = F.expr(
        """aggregate(sequence(size(edges) - 1, 0, -1), named_struct('want', last, 'path', cast(array() as array<int>)), (acc, k) ->
             if(acc.want = k, named_struct('want', best[k].back, 'path', concat(array(edges[k].id), acc.path)), acc)).path"""
    )
    kinds = "word string, n long, edges array<struct<e: int, s: int, id: int, score: double>>, before array<array<int>>"
    steps = grid.select("word", "n", "edges").mapInArrow(followed, kinds).withColumn("best", forward).withColumn("last", last)
    return steps.select("word", "n", backward.alias("path"))


def long_paths(words: DataFrame, pieces: Pieces) -> DataFrame:
    """The same recursion for words beyond ``FOLD_LIMIT``, where a fold that copies its state would be quadratic."""
    shared = pieces.everywhere(words.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [best_path(w.as_py(), shared.value) for w in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.int32()))], names=["word", "n", "path"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, path array<int>")


def best_path(word: str, pieces: Pieces) -> list[int]:
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(word) + 1)]  # end: piece: total, start, piece before
    for s in range(len(word)):
        if s and not best[s]:
            continue
        for e in range(s + 1, min(len(word), s + pieces.longest) + 1):
            piece = pieces.id.get(word[s:e], -1)
            if (piece < 0 and e > s + 1) or not pieces.reachable(piece):
                continue
            own = pieces.score.get(word[s:e], -1e9)
            before = [(0.0, -2)] if s == 0 else [(t, q) for q, (t, _, _) in best[s].items() if pieces.allowed(q, piece)]
            if before:
                total, q = max(before)
                if piece not in best[e] or best[e][piece][0] < total + own:
                    best[e][piece] = (total + own, s, q)
    path, at = [], len(word)
    piece = max(best[at], key=lambda q: best[at][q][0])
    while at:
        path.append(piece)
        _, at, piece = best[at][piece]
    return path[::-1]


def word_paths(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """``(word, n, path)`` for every distinct word of the corpus."""
    with small_batches(docs.sparkSession):
        counts = cut(counted_words(docs, pieces, text_col), "counts")
        drop()
        words = counts.repartition(LATTICE_PARTS * partitions(docs.sparkSession), "word")
        short = viterbi(lattice(words.where(F.length("word") <= FOLD_LIMIT), pieces), pieces)
        known = cut(short.unionByName(long_paths(counts.where(F.length("word") > FOLD_LIMIT), pieces)), "words")
    drop(counts)
    return known


def head_words(known: DataFrame) -> DataFrame:
    """``(word, path)`` of the words that all tasks hold: of bounded number and size."""
    most = lambda least, largest, n: known.where(F.octet_length("word").between(least, largest)).orderBy(F.desc("n"), "word").limit(n)
    return most(1, HEAD_BYTES, HEAD_WORDS).unionByName(most(HEAD_BYTES + 1, LONG_BYTES, LONG_WORDS)).select("word", "path")


def encode(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row."""
    spark, pieces = docs.sparkSession, pieces or Pieces.load()
    known = word_paths(docs, pieces, text_col)
    frequent: dict[str, bytes] = {}
    for part in head_words(known).toArrow().to_batches(max_chunksize=50_000):
        words, paths = part.column(0).to_pylist(), part.column(1).to_pylist()
        frequent.update(zip(words, map(pieces.code, words, paths), strict=True))
    shared, head = pieces.everywhere(spark), spark.sparkContext.broadcast(frequent)
    rows = row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).withColumn("_o", order_id())

    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = Coder(shared.value.forget(), head.value), set()
        for batch in sliced(batches):
            keys, found = [], []
            for o, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (o, k) in seen:  # most repetitions of a whole row end here
                    continue
                seen.add((o, k))
                keys.append((o, k))
                text = t.as_py()
                chunks = chunks_of(text)
                found.append(coder.rare(coder.parts(text) if chunks is None else map(coder.__getitem__, dict.fromkeys(chunks))))
            if len(seen) > SEEN:
                seen.clear()
            sizes = list(map(len, found))
            key = np.repeat(np.array(keys, dtype=np.int64).reshape(-1, 2), sizes, axis=0)
            places = [j for n in sizes for j in range(n)]
            columns = [pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(places, pa.int32()), pa.array(chain.from_iterable(found), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_o", "_tag", "j", "word"])

    others = rows.where("text <> ''").select("_o", "_tag", "text").mapInArrow(rare, "_o long, _tag long, j int, word string")
    others = others.join(known.select("word", "path"), "word").select(F.col("_o").alias("_o2"), F.col("_tag").alias("_t2"), "j", "path")
    others = others.repartition(partitions(spark), "_o2", "_t2").groupBy("_o2", "_t2")
    with small_batches(spark):
        others = cut(others.agg(F.collect_set(F.struct("j", "path")).alias("_rare")), "rare")  # within one document
    drop(known)

    whole = packed(rows.select("_o", "_tag", "doc_id", "text"))
    joined = whole.join(others.hint("merge"), (F.col("_o") == F.col("_o2")) & (F.col("_tag") == F.col("_t2")), "left")  # neither side has a bound

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequent = shared.value.forget(), head.value
        coder = Coder(own, frequent)
        for batch in sliced(batches):
            codes: list[bytes | None] = []
            for z, found in zip(batch.column(1), batch.column(2), strict=True):
                text = unpacked(z.as_py())
                if not text:
                    codes.append(None if text is None else b"")
                    continue
                parts = coder.parts(text)
                if found.is_valid:
                    paths = {r["j"]: r["path"] for r in found.as_py()}
                    local = {w: own.code(w, paths[j]) for j, w in enumerate(coder.rare(parts))}
                    parts = [b"".join(local[w] if w in local else frequent[w] for w in part) if type(part) is tuple else part for part in parts]
                codes.append(b"".join(parts))
            ends = np.concatenate([[0], np.cumsum([len(c or b"") // 4 for c in codes])]).astype(np.int32)
            flat = np.frombuffer(b"".join(c or b"" for c in codes), dtype=np.uint32).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([c is None for c in codes]))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return joined.select("doc_id", "z", "_rare").mapInArrow(assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` and ``text``, in place of a column of that name: the text that the ids stand for."""
    shared = (pieces or Pieces.load()).everywhere(encoded.sparkSession)
    schema = encoded.drop("text").schema.add("text", "string")
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value.raw()
        for batch in sliced(batches):
            column = batch.column(names.index(ids_col))
            texts = [decoded(ids.values.to_numpy(), raw) if ids.is_valid else None for ids in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return encoded.drop("text").mapInArrow(run, schema)
