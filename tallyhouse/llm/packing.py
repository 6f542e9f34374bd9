"""Best-fit packing planned on a histogram of lengths.

Texts are tokenised (``word_bpe_49k.json``), end with id 1, and only those over
``capacity`` tokens are cut. The plan looks at how many pieces have each
length, never at single pieces: from the longest length down, all pieces of a
length go to the fullest kind of open sequences that takes them. A plan row
says "pieces of this length with these ranks lie in these sequences at this
offset". Each piece then takes its slot by its rank within its length.

Ranks come from row numbers within (length, salt) plus the counts of the lower
salts, so a length that a third of all pieces share is still ranked by many
tasks. The histogram has at most ``capacity`` rows; the plan's size depends
on the lengths that occur, not on how many pieces there are.

Defined cases: null and empty texts are the single id 1; very long texts are
cut into whole pieces; repeated rows and ids are packed each; ties in rank are
broken by id and piece; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keeps, map_batches, stage

CAPACITY = 4096
END_ID = 1
#: Pieces that a worker keeps, some 40 bytes each.
CACHE_WORDS = 400_000
#: Longer pieces are encoded where they stand and not kept.
CACHED_BYTES = 48
#: Words encoded in one call.
GROUP = 512
_MARKS = b".,!?;:*$%&#|"
_PLAIN = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_PROBES = ("ab", "Don't", "x1", "..", "été", "你好", "A", "#tag,", "3.14", "a_b", "'s")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole columns of texts, by pieces between ASCII white space.

    Where the tokenizer drops white space and never joins across it, the ids of a
    text are those of its pieces in turn. A column is split and
    dictionary-encoded by Arrow, each distinct piece is looked up or encoded
    once, and one gather lays out the ids of all texts. Four things are probed
    when the tokenizer is loaded: that it lower-cases A-Z (else case is kept);
    that it goes by pieces (else texts go whole);
    that it splits between an ASCII letter or digit and a mark (then these are
    split too, so that a word and its punctuation are known apart); and that
    words of plain lower-case letters, which normalisation leaves alone, can go
    to its model many to a call, cut apart again by the end-of-word suffix.
    Texts with the literal of a special token go whole.

    Row ``r`` of the table is the piece ``vocabulary[r]`` with the ids
    ``pool[start[r] : start[r] + size[r]]``; row 0 is the end of a text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # texts are lower-cased here only if the tokenizer does so itself, letter by letter
        upper = "".join(map(chr, range(65, 91)))
        same = [(upper, upper.lower()), *((c + d, (c + d).lower()) for c in upper for d in upper + upper.lower())]
        norm = self.tokenizer.normalizer
        self.by_case = norm is not None and all(norm.normalize_str(x) == norm.normalize_str(y) for x, y in same) and self._ids(f"{upper} a{upper}") == self._ids(f"{upper} a{upper}".lower())
        self.by_piece = all(
            self._ids(gap + gap.join(_PROBES) + gap) == [i for p in _PROBES for i in self._ids(p)] for gap in (" ", "\n", "\t ", "\r\n\x0b\x0c")
        )
        self.by_mark = self.by_piece and all(
            self._ids(stem + m + n) == self._ids(stem) + self._ids(m + n) for stem in ("ab", "7", "é9z") for m in _MARKS.decode() for n in (*_MARKS.decode(), "", "a", "'s", "1")
        )
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): letters.pre_tokenize_str(c)[0][0] for c in _PLAIN if c > "z"}
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._clear()
        probe = pa.array([*_PLAIN, *(x + y + "e" for x in _PLAIN for y in _PLAIN)])
        want = [self._ids(w) for w in probe.to_pylist()]
        ids, sizes = self._groups(probe)
        self.by_group = self.by_piece and ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.vocabulary = pa.array([], pa.string())
        self.start, self.size, self.n = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), 0
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0
        self._know(pa.array(["\n"]), np.array([END_ID], np.uint32), np.array([1]))

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New rows of these sizes with their ids in turn."""
        while self.n + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        first, stop = self.n, self.n + len(sizes)
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[first:stop] = sizes
        self.start[first:stop] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = stop, self.used + len(ids)
        return np.arange(first, stop)

    def _know(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New rows that are found again."""
        self.vocabulary = pa.concat_arrays([self.vocabulary, pieces])
        rows = self._append(ids, sizes)
        self.kept = self.used
        return rows

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows one after the other."""
        size = self.size[rows]
        stop = np.cumsum(size, dtype=np.int32)
        at = np.repeat(self.start[rows] - stop + size, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool[at]

    def _singles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, sizes.sum()), sizes

    def _groups(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words, many words to a call."""
        at = [*range(0, len(words), GROUP), len(words)]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), " ").to_pylist()
        got = self.model.encode_batch_fast([t if t.isascii() else t.translate(self.bytes) for t in texts], add_special_tokens=False)
        out = []
        for k, e in zip(at, got):
            ids, n = np.array(e.ids, np.uint32), min(GROUP, len(words) - k)
            sizes = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            out.append((ids, sizes) if len(sizes) == n else self._singles(words.slice(k, n).to_pylist()))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Rows of pieces that have none yet."""
        kinds = np.full(len(pieces), 2)
        if self.by_group:
            kinds[pc.match_substring_regex(pieces, "^[ß-öø-ÿa-z]+$").to_numpy(zero_copy_only=False)] = 1
            kinds[pc.match_substring_regex(pieces, "^[a-z]+$").to_numpy(zero_copy_only=False)] = 0
        out = np.empty(len(pieces), np.int64)
        for kind in range(3):
            mine = np.flatnonzero(kinds == kind)
            for k in range(0, len(mine), 64 * GROUP):
                part = mine[k : k + 64 * GROUP]
                own = pieces.take(pa.array(part))
                out[part] = self._know(own, *(self._groups(own) if kind < 2 else self._singles(own.to_pylist())))
        return out

    def _find(self, pieces: pa.Array) -> np.ndarray:
        """The row of each of the distinct pieces."""
        # long pieces of an earlier column go
        self.n, self.used = len(self.vocabulary), self.kept
        out = pc.index_in(pieces, value_set=self.vocabulary).fill_null(-1).to_numpy().astype(np.int64)
        if self.n + (out < 0).sum() > CACHE_WORDS:
            # keep what this column uses
            known = np.flatnonzero(out >= 0)
            ids, sizes = self._gather(out[known]), self.size[out[known]]
            self._clear()
            out[known] = self._know(pieces.take(pa.array(known)), ids, sizes)
        fits = pc.less_equal(pc.binary_length(pieces), CACHED_BYTES).to_numpy(zero_copy_only=False)
        short, long = np.flatnonzero((out < 0) & fits), np.flatnonzero((out < 0) & ~fits)
        if len(short):
            out[short] = self._learn(pieces.take(pa.array(short)))
        for i in long:
            ids = self._ids(pieces[int(i)].as_py())
            out[i] = self._append(np.array(ids, np.uint32), np.array([len(ids)]))[0]
        return out

    def _spread(self, texts: pa.Array) -> pa.Array:
        """A blank between letters or digits and the marks behind them."""
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
        kind = _KIND[raw]
        cuts = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
        at = at - at[0]
        moved = (at + np.searchsorted(cuts, at)).astype(np.int32)
        return pa.StringArray.from_buffers(n, pa.py_buffer(moved), pa.py_buffer(np.insert(raw, cuts, 32)))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text with the end after them (null: empty text)."""
        texts = pc.fill_null(texts, "")
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()])
        low = pc.ascii_lower(texts)
        if self.by_piece:
            special = [pc.match_substring(low, s).to_numpy(zero_copy_only=False) for s in self.special]
            whole = np.any([np.zeros(len(texts), bool), *special], axis=0)
        else:
            whole = np.ones(len(texts), bool)
        low = low if self.by_case else texts
        if whole.any():
            low = pc.if_else(pa.array(whole), "", low)
        split = pc.ascii_split_whitespace(self._spread(low) if self.by_mark else low)
        words = split.flatten().dictionary_encode()
        rows = self._find(words.dictionary)
        bounds = split.offsets.to_numpy()
        rows = np.insert(rows[words.indices.to_numpy()], bounds[1:] - bounds[0], 0)
        stops = np.cumsum(self.size[rows])[bounds[1:] - bounds[0] + np.arange(len(texts))]
        out = np.split(self._gather(rows), stops[:-1])
        for i in np.flatnonzero(whole):
            out[i] = np.array([*self._ids(texts[int(i)].as_py()), END_ID], np.uint32)
        return out


_KIND = np.zeros(256, np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 1
_KIND[list(_MARKS)] = 2
_encoders: dict[str, Encoder] = {}
keeps(__name__, _encoders.clear)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, and ``ids``
    (array of int) unless told otherwise."""
    path = path or tokenizer_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, raw in enumerate(encoder(path).encode(batch.column(1))):
            for p, at in enumerate(range(0, len(raw), capacity)):
                own = raw[at : at + capacity]
                row.append(i)
                piece.append(p)
                start.append(at)
                length.append(len(own))
                crc.append(zlib.crc32(own.astype("<u4", copy=False)))
                if keep_ids:
                    ids.append(own.astype(np.int32))
        cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
        names = [id_col, "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.record_batch(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return map_batches(docs.select(id_col, text_col), run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank, n, per, sequence, offset): the ``n`` pieces of this
    length from ``rank`` on lie in sequences from ``sequence`` on, ``per`` in
    each, the first at ``offset``."""
    open_at: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_at:
                open_at[room] = []
                bisect.insort(rooms, room)
            open_at[room].append((first, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    del rooms[k]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            per = min(room // length, left)
            filled = min(n, left // per)
            out.append((length, rank, filled * per, per, first, capacity - room))
            put(room - per * length, first, filled)
            put(room, first + filled, n - filled)
            rank += filled * per
            left -= filled * per
    return out


def place(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with piece and length; read more than once, so staged by the
    caller) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rows = plan(histogram, capacity)
    # sorted by length and rank: one search finds a piece's plan row
    slots = np.array(sorted(rows), np.int64).reshape(-1, 6).T
    keys = slots[0] << 40 | slots[1]

    salts = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col).cast("string"), "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    own = Window.partitionBy("length", "_salt").orderBy(id_col, "piece")
    ranked = salted.withColumn("_row", F.row_number().over(own)).join(counts, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_below") + F.col("_row") - 1).alias("_rank"))
    names = pieces.columns
    at = names.index("length")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column(at).to_numpy(zero_copy_only=False), batch.column(len(names)).to_numpy(zero_copy_only=False)
        i = np.searchsorted(keys, length << 40 | rank, "right") - 1
        r0, per, first, start = slots[1][i], slots[3][i], slots[4][i], slots[5][i]
        sequence, offset = first + (rank - r0) // per, start + (rank - r0) % per * length
        return pa.record_batch([*batch.columns[: len(names)], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(ranked, run, f"{kept}, sequence_id long, offset long")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True
) -> DataFrame:
    """Tokenise, plan and place: one row for each piece with its slot."""
    return place(stage(tokenize(docs, id_col, text_col, path, capacity, keep_ids), "pieces"), id_col, capacity)
