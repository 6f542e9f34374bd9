"""Removal of long byte strings that an earlier document has too.

Every byte under a string of ``WINDOW`` bytes (a window) that also starts in a
document with a smaller id goes. No document, and no string that many share, is
held in one place:

1. *Anchors.* Each window has an anchor: its ``CORE`` bytes with the smallest hash.
   Windows that follow each other and have the same anchor are a run; equal windows
   have equal anchors. Runs are dealt by anchor, packed by columns. Runs with equal
   bytes meet first within a task, then by anchor: all but those of the smallest id
   are removed there and then, so a passage in a third of all documents costs one
   entry for each task, not one for each document.
2. *Suffix arrays.* What is left are anchors with different runs of different
   documents: the edges of copied passages. Their bytes are cut out of the texts;
   the runs of an anchor get a suffix array (see ``suffixarray``), in which windows
   with equal bytes are neighbours. Those of larger ids are removed. The anchor
   itself, alike in all, is one symbol. An anchor with more than ``TOGETHER`` runs
   is told apart by what lies beside it: each window holds the ``SIDE`` bytes before
   the anchor or those after it, so a run becomes two at most, each compared with
   those that have the same bytes there. Only where even such a group exceeds
   ``MOST`` runs, the windows that its parts leave meet once more, by their bytes:
   a shuffle with one row for each.
3. The removed windows of a document come together as ranges and are cut out.

Bytes decide in the end: hashes only bring together what may be equal, but for
whole runs (1), whose equality stands on 104 bits of hash.

Defined cases: a null text is empty; fewer than ``WINDOW`` bytes hold no window; a
string repeated only within a document stays; rows with one id and the same text
get the same result, rows with one id and different texts are documents of their
own, none smaller than the other; a row without an id is left as it is and counts
for no other; columns that the result does not name are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, settle, stage, utf8
from .suffixarray import _ranges, suffix_arrays

WINDOW = 50
CORE = 24
REACH = WINDOW - CORE + 1  # cores in a window, and its symbols with the core as one
WIDE = -(-REACH // 4) * 4
#: Different runs of one anchor in one suffix array; of an anchor with more, the
#: bytes on either side that tell its runs apart, and the runs alike in them.
TOGETHER, SIDE, MOST = 128, REACH // 2, 40_000
#: Bytes of text hashed at a time, runs packed at a time, symbols sorted at a time.
HASHED, PACKED, SORTED = 1 << 20, 1 << 20, 1 << 21
#: Bytes of text whose runs one bucket gets, on average.
BUCKET_BYTES = 12 << 20

_U = np.uint64
_POWER = 0x9E3779B97F4A7C15
_PLANES = (("anchor", 8, 7), ("content", 8, 6), ("doc", 8, 8), ("version", 4, 4), ("at", 4, 4), ("n", 4, 4), ("off", 1, 1))
_KINDS = {"anchor": np.uint64, "content": np.uint64, "doc": np.int64, "version": np.int32, "at": np.uint32, "n": np.uint32, "off": np.uint8}

Runs = dict[str, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _POWER), ("down", pow(_POWER, -1, 1 << 64))):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


def find_runs(data: np.ndarray, ends: np.ndarray) -> Runs:
    """Runs of windows with one anchor, in texts that end at ``ends`` in ``data``:
    hash of the anchor and of all bytes, text, start, windows, offset of the anchor."""
    if len(data) < WINDOW:
        return {k: np.zeros(0, t) for k, t in {**_KINDS, "text": np.int64}.items()}
    x = data.astype(_U)
    for width in (1, 2, 4):  # eight bytes from each place on
        x = x[:-width] | (x[width:] << _U(8 * width))
    n = len(data) - CORE + 1
    h = np.zeros(n, _U)
    for i in range(0, CORE, 8):
        h = _mixed((h ^ x[i : i + n]) * _U(0x94D049BB133111EB))
    least = (h & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: width - REACH], least[REACH - width :])
    anchor_at = (least & _U(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(anchor_at), bool)
    for end in ends.tolist():
        inside[max(0, end - WINDOW + 1) : end] = False
    begins = np.r_[0, ends[:-1]]
    windows = np.flatnonzero(inside)
    anchors = anchor_at[windows]
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(windows) else np.zeros(0, np.int64)
    at, anchors = windows[first], anchors[first]
    count = np.diff(np.r_[first, len(windows)])
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(h * up[:n], out=sums[1:])
    content = _mixed((sums[at + count + WINDOW - CORE] - sums[at]) * down[at] + count.astype(_U))
    text = np.searchsorted(ends, at, side="right")
    return {"anchor": _mixed(h[anchors] * _U(_POWER)), "content": content >> _U(16), "text": text, "at": at - begins[text], "n": count, "off": anchors - at}


def _pack(runs: Runs, rows: slice) -> bytes:
    """Columns byte by byte, so that constant bytes shrink to nothing in the shuffle."""
    out = [np.uint32(rows.stop - rows.start).tobytes()]
    for name, width, kept in _PLANES:
        out.append(runs[name][rows].astype(_KINDS[name]).view(np.uint8).reshape(-1, width)[:, :kept].T.tobytes())
    return b"".join(out)


def _unpack(blobs: list[bytes]) -> Runs:
    parts: dict[str, list[np.ndarray]] = {name: [] for name, *_ in _PLANES}
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.uint32, 1)[0]), 4
        for name, width, kept in _PLANES:
            whole = np.zeros((n, width), np.uint8)
            whole[:, :kept] = np.frombuffer(blob, np.uint8, n * kept, at).reshape(kept, n).T
            parts[name].append(whole.reshape(-1).view(_KINDS[name]))
            at += n * kept
    return {k: np.concatenate(v) for k, v in parts.items()}


def _take(runs: Runs, which: np.ndarray) -> Runs:
    return {k: v[which] for k, v in runs.items()}


def _joined(runs: Runs) -> Runs:
    """Runs sorted by text and place, those that follow each other made one."""
    runs = _take(runs, np.lexsort((runs["at"], runs["version"], runs["doc"])))
    if not len(runs["at"]):
        return runs
    doc, version, end = runs["doc"], runs["version"], runs["at"] + runs["n"]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (runs["at"][1:] != end[:-1])])
    return {**_take(runs, first), "n": np.add.reduceat(runs["n"], first)}


def _by_text(doc: np.ndarray, version: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(doc, version, its ranges packed) for each text."""
    runs = _joined({"doc": doc, "version": version, "at": at.astype(np.int64), "n": n.astype(np.int64)})
    doc, version = runs["doc"], runs["version"]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])]) if len(doc) else np.zeros(0, np.int64)
    pairs = np.stack([runs["at"], runs["n"]], axis=1).astype(np.uint32)
    ends = np.r_[first[1:], len(doc)]
    return doc[first], version[first], [pairs[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist())]


def _classes(runs: Runs) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` sorted by anchor, content and id; the class (anchor, content) of
    each, the smallest id of its class, and where classes begin."""
    runs = _take(runs, np.lexsort((runs["doc"], runs["content"], runs["anchor"])))
    a, c = runs["anchor"], runs["content"]
    new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
    first = np.flatnonzero(new)
    klass = np.cumsum(new) - 1
    return runs, klass, runs["doc"][first][klass], first


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of about ``HASHED`` bytes of whole texts."""
    texts = utf8(batch.column("text"))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = 0
    while begin < len(texts):
        stop, total = begin + 1, int(sizes[begin])
        while stop < len(texts) and total + sizes[stop] <= HASHED:
            total += int(sizes[stop])
            stop += 1
        yield begin, np.frombuffer(b"".join(texts[begin:stop]), np.uint8), np.cumsum(sizes[begin:stop])
        begin = stop


def _deal(buckets: int):
    """Map side: runs of whole texts, packed by bucket. ``settled`` rows hold runs
    that an equal one of a smaller id in the same task has removed already."""

    def flush(held: list[Runs]) -> pa.RecordBatch:
        runs, _, smallest, _ = _classes({k: np.concatenate([x[k] for x in held]) for k in held[0]})
        lost = runs["doc"] > smallest
        rows: list[tuple[int, bool, bytes]] = []
        for settled, part in ((True, _joined(_take(runs, lost))), (False, _take(runs, ~lost))):
            key = part["doc"].astype(_U) * _U(_POWER) if settled else part["anchor"]
            bucket = ((key >> _U(40)) % _U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            part, bucket = _take(part, by), bucket[by]
            edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, np.int64)
            rows += [(int(bucket[i]), settled, _pack(part, slice(int(i), int(j)))) for i, j in zip(edges[:-1], edges[1:])]
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "settled", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(__name__)
        held, n = [], 0
        for batch in (part for whole in batches for part in cut(whole)):
            ids, versions = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "version"))
            for begin, data, ends in _texts(batch):
                runs = find_runs(data, ends)
                row = runs.pop("text") + begin
                held.append({**{k: v.astype(_KINDS[k]) for k, v in runs.items()}, "doc": ids[row].astype(np.int64), "version": versions[row].astype(np.int32)})
                n += len(row)
                if n >= PACKED:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


#: A text's removed ranges, or (part not null) a run whose windows are to be
#: compared in a part of its anchor's runs.
SHARED = "doc_id long, version int, ranges binary, at long, n int, off int, anchor long, part int, hot boolean"


def _batch(schema: str, columns: dict) -> pa.RecordBatch:
    """Columns of a schema text in its order; those not given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    size, made = len(next(iter(columns.values()))), {}
    for name, kind in (x.split() for x in schema.split(", ")):
        made[name] = pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(size, kinds[kind])
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def _removed(schema: str, doc: np.ndarray, version: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(doc):
        ids, versions, ranges = _by_text(doc, version, at, n)
        yield _batch(schema, {"doc_id": ids, "version": versions, "ranges": ranges})


def _meet(together: int):
    """Reduce side: all runs of an anchor."""

    def rows(runs: Runs, part: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        numbers = {k: runs[k].astype(t) for k, t in (("at", np.int64), ("n", np.int32), ("off", np.int32))}
        return _batch(SHARED, {"doc_id": runs["doc"], "version": runs["version"], **numbers, "anchor": runs["anchor"].view(np.int64), "part": part.astype(np.int32), "hot": hot})

    def solve(open_: list[bytes], settled: list[bytes]) -> Iterator[pa.RecordBatch]:
        if settled:
            done = _unpack(settled)
            yield from _removed(SHARED, done["doc"], done["version"], done["at"], done["n"])
        if not open_:
            return
        runs, klass, smallest, first = _classes(_unpack(open_))
        lost = runs["doc"] > smallest
        yield from _removed(SHARED, *(runs[k][lost] for k in ("doc", "version", "at", "n")))
        # of each anchor: its classes, and whether they are of different ids
        anchor = runs["anchor"][first]
        group_first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        owners = runs["doc"][first]
        several = np.minimum.reduceat(owners, group_first) < np.maximum.reduceat(owners, group_first)
        size = np.diff(np.r_[group_first, len(first)])
        rank = np.arange(len(first)) - np.repeat(group_first, size)
        wanted = ~lost & np.repeat(several, size)[klass]
        if wanted.any():
            yield rows(_take(runs, wanted), (rank // together)[klass][wanted], np.repeat(size > together, size)[klass][wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(__name__)
        now, open_, settled = None, [], []
        for batch in batches:
            for bucket, done, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    yield from solve(open_, settled)
                    now, open_, settled = bucket, [], []
                (settled if done else open_).append(blob)
        yield from solve(open_, settled)

    return run


def _sides(runs: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Runs of hot anchors in two: windows that hold the bytes before the anchor
    (side 1), the rest those after it (side 2); other runs as they are (side 0)."""
    before = np.where(runs["hot"], np.clip(runs["off"] - SIDE + 1, 0, runs["n"]), runs["n"])
    after = runs["n"] - before
    one, two = np.flatnonzero(before), np.flatnonzero(after)
    first, second = _take({**runs, "n": before}, one), _take({**runs, "at": runs["at"] + before, "n": after, "off": runs["off"] - before}, two)
    return {k: np.concatenate([first[k], second[k]]) for k in runs}, np.r_[runs["hot"][one].astype(np.int64), np.full(len(two), 2)]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs to compare, one row for each, two at most for one of a
    hot anchor, whose part is a hash of the bytes on that side of the anchor."""
    settle(__name__)
    for batch in (part for whole in batches for part in cut(whole)):
        wanted = batch.column("runs")
        fields = wanted.flatten()
        columns = {k: fields.field(k).to_numpy(zero_copy_only=False) for k in ("at", "n", "off", "anchor", "part", "hot")}
        columns["owner"] = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
        columns, side = _sides({k: v.astype(bool if k == "hot" else np.int64) for k, v in columns.items()})
        texts = utf8(batch.column("text"))
        beside = columns["at"] + columns["off"] + np.where(side == 1, -SIDE, CORE)
        for i in np.flatnonzero(side).tolist():
            at = int(beside[i])
            columns["part"][i] = zlib.crc32(texts[columns["owner"][i]][at : at + SIDE], int(side[i])) >> 1
        pieces = [texts[o][a : a + n + WINDOW - 1] for o, a, n in zip(columns["owner"].tolist(), columns["at"].tolist(), columns["n"].tolist())]
        for i in range(0, len(pieces), 20_000):
            part = {k: v[i : i + 20_000] for k, v in columns.items()}
            ids = {k: batch.column(k).take(pa.array(part["owner"])) for k in ("doc_id", "version")}
            yield _batch(PIECES, {**ids, **{k: part[k] for k in ("at", "n", "off", "anchor", "part")}, "bytes": pieces[i : i + 20_000]})


#: A text's removed ranges, or (window not null) a window that other parts may have.
FOUND = "doc_id long, version int, ranges binary, at long, window binary"
PIECES = "doc_id long, version int, at long, n int, off int, anchor long, part int, bytes binary"


def compare(runs: dict[str, np.ndarray], data: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Removed windows of runs that lie one after the other in ``data``, grouped
    by ``group``; and, of hot groups, the places of windows that were not removed."""
    count = len(runs["n"])
    begin = np.cumsum(runs["n"] + WINDOW - 1) - (runs["n"] + WINDOW - 1)
    core = np.lib.stride_tricks.sliding_window_view(data, CORE)[begin + runs["off"]]
    group = runs["group"]
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, count]))
    if (core != core[head][of]).any():  # two anchors with one hash: apart by their bytes
        _, kind = np.unique(core, axis=0, return_inverse=True)
        group = np.unique(np.stack([of, kind.reshape(-1)]), axis=1, return_inverse=True)[1].reshape(-1)
    _, group = np.unique(group, return_inverse=True)
    symbols = runs["n"] + WINDOW - CORE + 1
    length = np.bincount(group, symbols).astype(np.int64) + 1
    by = np.argsort(group, kind="stable")
    group, begin, n, off, doc = group[by], begin[by], runs["n"][by], runs["off"][by], runs["doc"][by]
    last = np.r_[group[1:] != group[:-1], True]
    width = symbols[by] + last
    start = np.cumsum(width) - width
    text = np.ones(int(width.sum()), np.int32)  # 1 parts the runs of a string, 0 ends it
    text[(start + width - 1)[last]] = 0
    left, right = _ranges(start, off), _ranges(begin, off)
    text[left] = data[right].astype(np.int32) + 2
    text[start + off] = 258
    rest = n + WINDOW - 1 - CORE - off
    text[_ranges(start + off + 1, rest)] = data[_ranges(begin + off + CORE, rest)].astype(np.int32) + 2

    order = suffix_arrays(text, length[group[last]])
    run_of = np.full(len(text), -1, np.int64)
    windows = _ranges(start, n)
    run_of[windows] = np.repeat(np.arange(count), n)
    order = order[run_of[order] >= 0]
    run = run_of[order]
    # a window's symbols side by side, as eight-byte words
    short = np.zeros(len(text) + WIDE, np.int16)
    short[: len(text)] = text
    wide = np.lib.stride_tricks.sliding_window_view(short, WIDE)[order]
    wide[:, REACH:] = 0
    words = wide.view(np.int64)
    same = (words[1:] == words[:-1]).all(axis=1) & (group[run][1:] == group[run][:-1])
    first = np.flatnonzero(np.r_[True, ~same])
    klass = np.cumsum(np.r_[True, ~same]) - 1
    owner = doc[run]
    gone = owner > np.minimum.reduceat(owner, first)[klass]
    lost = np.sort(order[gone])
    run = run_of[lost]
    new = np.flatnonzero(np.r_[True, (lost[1:] != lost[:-1] + 1) | (run[1:] != run[:-1])]) if len(lost) else np.zeros(0, np.int64)
    removed = {"run": by[run[new]], "skip": lost[new] - start[run[new]], "n": np.diff(np.r_[new, len(lost)])}
    stay = order[~gone]
    run = run_of[stay]
    hot = runs["hot"][by][run]
    return removed, {"run": by[run[hot]], "skip": (stay - start[run])[hot]}


def _sort_suffixes(most: int):
    """Sorted runs, in portions of whole groups; a group of more than ``most`` runs
    in parts, whose windows may have equals in another one."""

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        c = {k: whole[k].to_numpy() for k in ("doc_id", "version", "at", "n", "off", "anchor", "part", "chunk")}
        data = np.frombuffer(b"".join(whole["bytes"].to_pylist()), np.uint8)
        new = np.r_[True, (c["anchor"][1:] != c["anchor"][:-1]) | (c["part"][1:] != c["part"][:-1]) | (c["chunk"][1:] != c["chunk"][:-1])]
        group = np.cumsum(new)
        hot = (np.bincount(group)[group] >= most) | (c["chunk"] > 0)
        n = c["n"].astype(np.int64)
        removed, left = compare({"n": n, "off": c["off"].astype(np.int64), "doc": c["doc_id"], "group": group, "hot": hot}, data)
        begin = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
        run = removed["run"]
        yield from _removed(FOUND, c["doc_id"][run], c["version"][run], c["at"][run] + removed["skip"], removed["n"])
        for i in range(0, len(left["run"]), 50_000):
            run, skip = (left[k][i : i + 50_000] for k in ("run", "skip"))
            windows = [data[a : a + WINDOW].tobytes() for a in (begin[run] + skip).tolist()]
            yield _batch(FOUND, {"doc_id": c["doc_id"][run], "version": c["version"][run], "at": c["at"][run] + skip, "window": windows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(__name__)
        held, size, key, seen = [], 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part = batch.column("anchor").to_numpy(), batch.column("part").to_numpy()
            row = np.arange(len(anchor))
            new = np.r_[(anchor[0], part[0]) != key, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]
            begin = np.maximum.accumulate(np.where(new, row, -1))
            place = np.where(begin < 0, row + seen, row - begin)
            heads = np.flatnonzero(place % most == 0)
            batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(place // most)], [*batch.schema.names, "chunk"])
            key, seen, done = (anchor[-1], part[-1]), int(place[-1]) + 1, 0
            ends = np.cumsum(batch.column("n").to_numpy() + WINDOW - CORE + 2)
            for head in heads.tolist():
                before = int(ends[head - 1]) if head else 0
                if size + before - (int(ends[done - 1]) if done else 0) >= SORTED:
                    held.append(batch.slice(done, head - done))
                    yield from solve(held)
                    held, size, done = [], 0, head
            held.append(batch.slice(done))
            size += int(ends[-1]) - (int(ends[done - 1]) if done else 0)
        if held:
            yield from solve(held)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _without(keep: bool):
    """What is left of each text when the windows in its ranges are cut out."""

    def one(text: bytes, packed: list[bytes] | None) -> tuple[int, int, bytes]:
        if not packed:
            return 0, 0, text
        pairs = np.frombuffer(b"".join(packed), np.uint32).reshape(-1, 2).astype(np.int64)
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 0] + pairs[:, 1] + WINDOW - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(__name__)
        for batch in (part for whole in batches for part in cut(whole)):
            out = []
            for text, packed in zip(utf8(batch.column("text")), batch.column("ranges").to_pylist()):
                removed, spans, kept = one(text, packed)
                out.append((batch.column("doc_id")[len(out)].as_py(), len(text), removed, spans, kept if keep else None, hashlib.sha256(kept).hexdigest()))
            yield _batch(RESULT, dict(zip((x.split()[0] for x in RESULT.split(", ")), zip(*out))))

    return run


def _versioned(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, version, text), and the bytes of all texts. The version parts
    different texts with one id; where there are none, nothing is joined."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    facts = stage(docs.select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes")), "ids")
    total = facts.agg(F.sum(F.col("bytes").cast("long"))).first()[0] or 0
    split = facts.where("doc_id is not null").groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low < high").select("doc_id")
    if split.isEmpty():
        return docs.withColumn("version", F.lit(0)), total
    texts = facts.join(split, "doc_id").select("doc_id", "hash").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    versions = texts.select("doc_id", F.posexplode("hashes").alias("version", "hash"))
    joined = docs.withColumn("hash", F.xxhash64("text")).join(versions, ["doc_id", "hash"], "left")
    return joined.select("doc_id", "text", F.coalesce("version", F.lit(0)).alias("version")), total


def remove_repeats(docs: DataFrame, keep_text: bool = True, together: int = TOGETHER, most: int = MOST, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) for each row;
    ``kept`` holds the bytes that are left (null without ``keep_text``)."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts, total = _versioned(docs)
    texts = texts.select("doc_id", "version", "text")
    buckets = max(8, -(-total // bucket_bytes))

    named = texts.where("doc_id is not null")
    dealt = named.mapInArrow(_deal(buckets), "bucket long, settled boolean, runs binary")
    shared = stage(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(together), SHARED), "shared-runs")

    wanted = shared.where("part is not null").groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "n", "off", "anchor", "part", "hot")).alias("runs"))
    pieces = named.join(wanted, ["doc_id", "version"]).mapInArrow(_cut_out, PIECES)
    grouped = pieces.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    found = stage(grouped.mapInArrow(_sort_suffixes(most), FOUND), "found")

    # what the parts of a group leave meets by its bytes
    left = found.where("window is not null")
    first = left.groupBy("window").agg(F.min("doc_id").alias("smallest"))
    late = left.join(first, "window").where("doc_id > smallest")
    packed = late.select("doc_id", "version", F.col("at").alias("ranges")).mapInArrow(_packed, "doc_id long, version int, ranges binary")
    ranges = (
        shared.where("part is null").select("doc_id", "version", "ranges").union(found.where("window is null").select("doc_id", "version", "ranges")).union(packed)
        .groupBy("doc_id", "version").agg(F.collect_list("ranges").alias("ranges"))
    )
    return texts.join(ranges, ["doc_id", "version"], "left").select("doc_id", "text", "ranges").mapInArrow(_without(keep_text), RESULT)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows as ranges."""
    for batch in batches:
        doc, version, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield from _removed("doc_id long, version int, ranges binary", doc, version, at, np.ones(len(at), np.int64))
