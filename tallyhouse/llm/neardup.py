"""Near-duplicates: SuperMinHash signatures, banding, verification, union-find.

Words are runs without ASCII white space after lower-casing A-Z. The set of a
text is its distinct shingles of ``width`` words (a shorter text: all its words
as one shingle; no word: the empty set, linked with nothing). Two texts are
linked when 100 * intersection >= ``percent`` * union, checked on whole sets of
64-bit shingle hashes.

How it runs:

1. One pass gives each text its set size, a 128-bit fingerprint of the set and
   its band keys. Each element draws a permutation of the signature places
   rank by rank (SuperMinHash); the draw stops when every place holds a
   value of a lower rank than any to come.
2. Texts with equal sets are one class, kept by its smallest id.
3. Classes that share a band key form a bucket. A bucket's leader is compared
   with its other members (a star, not all pairs); members that the leader does
   not link are then compared in blocks, see ``class_links``.
4. Verified links go through union-find inside each partition and then
   alternating star contraction across partitions until nothing changes.

Defined cases: null text has the empty set; null ids are dropped from linking
but come back as their own class; repeated ids with different texts join their
classes; ties keep the smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop_staged, keeps, map_batches, removing, stage, utf8

WIDTH = 5
BANDS = 24
ROWS = 5
PLACES = BANDS * ROWS
#: Members of a family in a block.
BLOCK = 128
#: Members of a bucket, and pairs of a leader, that one task takes.
SALT = 512
CACHE_WORDS = 1 << 18
U64 = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Hashes()
keeps(__name__, _words.clear)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, U64)
    h = np.fromiter(map(_words.__getitem__, words), U64, n)
    k = min(width, n)
    total = np.full(n - k + 1, U64(k))
    for i in range(k):
        total += h[i : n - k + 1 + i] * _MULT[i % 8] ^ U64(i)
    return np.unique(mix(total))


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash of many sets at once: value = (rank << 32) + random.

    At rank j every element of a set that is still open takes the j-th place of
    its own permutation (a partial Fisher-Yates shuffle, replayed backwards
    from the swaps kept so far). A set closes once all its places were filled
    at a rank below j, as no later value can be smaller.
    """
    full = U64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), places), full)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seed = np.concatenate(sets) if sets else np.zeros(0, U64)
    swaps: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for j in range(places):
            if not len(owner):
                break
            r = mix(seed + U64(j + 1) * U64(0x9E3779B97F4A7C15))
            k = (j + (((r & U64(0xFFFFFFFF)) * U64(places - j)) >> U64(32)).astype(np.int64)).astype(np.int16)
            place = k.copy()
            for i in range(j - 1, -1, -1):
                np.copyto(place, np.int16(i), where=place == swaps[i])
            swaps.append(k)
            value = (U64(j) << U64(32)) | (r >> U64(32))
            np.minimum.at(flat, owner * places + place, value)
            done = (out >> U64(32)).max(1) <= j
            left = ~done[owner]
            if not left.all():
                owner, seed = owner[left], seed[left]
                swaps = [s[left] for s in swaps]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(BANDS, dtype=U64), parts.shape[:2]).copy()
        for i in range(ROWS):
            key = mix(key * _MULT[0] + parts[:, :, i])
    return key


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_hash (null for the empty set), bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in utf8(batch.column(1))]
        keys = band_keys(signatures(sets)).view(np.int64)
        mark = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        bands = [k.tolist() if len(s) else None for k, s in zip(keys, sets)]
        return pa.record_batch(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(mark, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["id", "n_shingles", "set_hash", "bands"],
        )

    return map_batches(docs.select(F.col(id_col).cast("long"), text_col), run, "id long, n_shingles long, set_hash binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, elems: the sets of the ``wanted`` classes as packed 64-bit hashes.

    A merge join at every size: the wanted ids grow with the corpus, so they are
    never broadcast, and the texts move once. An id that several rows share
    comes once for each of its different sets, not once for each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, set()
        for whole in batches:
            for batch in cut(whole):
                reps, packed = [], []
                for rep, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                    own = shingles(text).tobytes()
                    mark = xxhash.xxh3_128_digest(own)
                    if rep != now:
                        now, seen = rep, set()
                    if mark not in seen:
                        seen.add(mark)
                        reps.append(rep)
                        packed.append(own)
                yield pa.record_batch([pa.array(reps, pa.int64()), pa.array(packed, pa.binary())], ["rep", "elems"])

    bound_batches(docs.sparkSession)
    # the merge join leaves the rows of an id side by side
    return docs.join(wanted.hint("merge"), "rep", "left_semi").select("rep", "text").mapInArrow(run, "rep long, elems binary")


def salts(size: str) -> Column:
    """How many tasks a group of this size is dealt to."""
    return F.greatest(F.ceil(F.col(size) / SALT), F.lit(1)).cast("int")


def salt(size: str) -> Column:
    return F.pmod(F.xxhash64("rep", F.lit("salt")), salts(size)).cast("int")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """lead, rep, inter, total for the ``pairs`` (lead, rep, wide, many), from
    whole sets; where ``wide``, also ``apart``: the elements that only one of the
    two has, packed. The set of a leader with many pairs is copied for each task
    that takes some of them; ``many`` is the size of the pair's largest bucket."""
    leads = pairs.groupBy("lead").agg(F.max("many").alias("most"))
    left = sets.select(F.col("rep").alias("lead"), F.col("elems").alias("ea")).join(leads.hint("merge"), "lead")
    left = left.select("lead", "ea", F.explode(F.sequence(F.lit(0), salts("most") - 1)).alias("salt"))
    right = sets.select("rep", F.col("elems").alias("eb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole):
                inter, total, apart = [], [], []
                for x, y, wide in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                    p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                    at = np.searchsorted(p, q)
                    both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                    inter.append(both)
                    total.append(len(p) + len(q) - both)
                    apart.append(np.setxor1d(p, q, assume_unique=True).tobytes() if wide else None)
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(total, pa.int64()), pa.array(apart, pa.binary())],
                    ["lead", "rep", "inter", "total", "apart"],
                )

    joined = pairs.withColumn("salt", salt("many")).join(right.hint("merge"), "rep").join(left.hint("merge"), ["lead", "salt"])
    return joined.select("lead", "rep", "ea", "eb", "wide").mapInArrow(run, "lead long, rep long, inter long, total long, apart binary")


def union_find(links) -> list[tuple[int, int]]:
    """(node, root) of every node that is not its component's smallest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := up.setdefault(top, top)) != top:
            top = p
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
    return [(x, r) for x in up if (r := root(x)) != x]


def block_links(left: list, right: list, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of one family, joined up by union-find.

    A member is (rep, n, the elements that only it or only the leader has). The
    leader cancels out of the symmetric difference of two members, so its size is
    |d| + |d'| - 2k with k of these elements in common.
    """
    pack = lambda block: (np.concatenate([np.frombuffer(m["apart"], U64) for m in block]), np.repeat(np.arange(len(block)), [len(m["apart"]) // 8 for m in block]))
    (ex, ox), (ey, oy) = pack(left), pack(right)
    order = np.argsort(ey, kind="stable")
    ey, oy = ey[order], oy[order]
    lo, hi = np.searchsorted(ey, ex, "left"), np.searchsorted(ey, ex, "right")
    times = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(ex) else np.zeros(0, int)
    k = np.bincount(np.repeat(ox, times) * len(right) + oy[at], minlength=len(left) * len(right)).reshape(len(left), len(right))
    size = lambda block: (np.array([m["n"] for m in block]), np.array([len(m["apart"]) // 8 for m in block]))
    (nx, dx), (ny, dy) = size(left), size(right)
    # |x ^ y| = |dx ^ dy| = |dx| + |dy| - 2k, and 2 |x & y| = |x| + |y| - |x ^ y|
    twice = nx[:, None] + ny[None, :] - (dx[:, None] + dy[None, :] - 2 * k)
    union2 = 2 * (nx[:, None] + ny[None, :]) - twice
    found = np.argwhere(twice * 100 >= union2 * percent)
    return union_find((left[i]["rep"], right[j]["rep"]) for i, j in found.tolist() if left[i]["rep"] != right[j]["rep"])


def forest(edges: DataFrame) -> DataFrame:
    """Union-find over each partition's edges: at most one edge for a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = union_find(uv for b in batches for uv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for i in range(0, len(nodes), 10000):
            part = nodes[i : i + 10000]
            yield pa.record_batch([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """node, component (smallest node reachable) of every node on an edge.

    Alternates large-star and small-star contraction; each round writes its
    edges to the shared folder. It ends when a round changes no edge: then each
    node points at its component's smallest node.
    """
    now = stage(forest(edges.where("u <> v")).where("u <> v").distinct(), name)
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # a node with very many neighbours is met by several tasks
        spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        large = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(16)).cast("int")).join(spread, ["u", "salt"])
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stage(small, name)
        drop_staged(now)
        now, before = after, seen
        seen = mark(now)
        if seen == before:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._staged_path = now._staged_path
    return out


def class_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the members (rep, n, bucket, size) of all buckets,
    enough of them to join all that are linked.

    Every bucket's most connected member leads it and is compared with the others:
    a star, not all pairs. Those it links are joined. A member that it does not
    link may still be linked with another one; for these, and only these, the
    members compared with the leader are gone through in blocks, by what sets
    them apart from the leader (a few elements each instead of whole sets); a
    block pair gives back joined-up links, never its pairs.
    """
    ties = members.groupBy("rep").agg(F.sum("size").alias("ties"))
    now = members.join(ties, "rep")
    tops = now.groupBy("bucket").agg(F.max_by(F.struct("rep", "n"), F.struct("ties", -F.col("rep"))).alias("top"), F.first("size").alias("size"))
    tops = tops.select("bucket", "top", F.explode(F.sequence(F.lit(0), salts("size") - 1)).alias("salt"))
    pairs = now.withColumn("salt", salt("size")).join(tops, ["bucket", "salt"]).where("rep <> top.rep").groupBy(F.col("top.rep").alias("lead"), "rep").agg(
        F.bool_or(F.col("size") > 2).alias("wide"), F.max("size").alias("many"), F.first("n").alias("n"), F.first("top.n").alias("lead_n")
    )
    pairs = pairs.where(F.col("wide") | (F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent))
    pairs = stage(pairs, "pairs")
    found = stage(compare(pairs.select("lead", "rep", "wide", "many"), sets).join(pairs.select("lead", "rep", "n"), ["lead", "rep"]), "stars")
    linked = F.col("inter") * 100 >= F.col("total") * percent
    links = found.where(linked).select(F.col("lead").alias("u"), F.col("rep").alias("v"))

    rows = found.where("apart is not null").withColumn("loose", ~linked)
    counts = rows.groupBy("lead").agg(F.count_if("loose").alias("n_loose"), F.count_if(~F.col("loose")).alias("n_tied"))
    counts = counts.where("n_loose > 0 and n_loose + n_tied > 1")
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    counts = counts.select("lead", blocks("n_loose").alias("b_loose"), F.when(F.col("n_tied") > 0, blocks("n_tied")).otherwise(0).alias("b_tied"))
    # dealt by lead and salt, so that neither the join nor the blocks meet a
    # leader's members in one task
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit("salt")), F.lit(16)).cast("int")).join(counts, ["lead", "salt"])
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("loose"), F.col("b_loose")).otherwise(F.col("b_tied"))).cast("int")
    packed = rows.groupBy("lead", "loose", mine.alias("block")).agg(
        F.collect_list(F.struct("rep", "n", "apart")).alias("people"), F.first("b_loose").alias("b_loose"), F.first("b_tied").alias("b_tied")
    )
    packed = stage(packed, "blocks")
    other = F.concat(
        F.transform(F.sequence(F.col("block"), F.col("b_loose") - 1), lambda i: F.struct(F.lit(True).alias("loose"), i.alias("block"))),
        F.when(F.col("b_tied") > 0, F.transform(F.sequence(F.lit(0), F.col("b_tied") - 1), lambda i: F.struct(F.lit(False).alias("loose"), i.alias("block")))).otherwise(
            F.array().cast("array<struct<loose:boolean,block:int>>")
        ),
    )
    asks = packed.where("loose").select("lead", F.col("people").alias("askers"), F.explode(other).alias("o")).select("lead", "askers", "o.*")
    both = asks.join(packed.select("lead", "loose", "block", "people"), ["lead", "loose", "block"]).select("askers", "people")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                row = whole.slice(i, 1)
                got = block_links(row.column(0).to_pylist()[0], row.column(1).to_pylist()[0], percent)
                if got:
                    yield pa.record_batch([pa.array([x for x, _ in got], pa.int64()), pa.array([r for _, r in got], pa.int64())], ["u", "v"])

    # written by itself: a task that runs one Python function needs one worker
    return links.union(stage(both.mapInArrow(run, "u long, v long"), "block-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id and kept for every row of ``docs``."""
    rows = stage(sketch(docs, id_col, text_col), "sketch")
    full = rows.where("id is not null and set_hash is not null")
    with removing(docs.sparkSession) as keep:
        found = linked_classes(docs, full, id_col, text_col, percent, keep)
    out = rows.select("id", "n_shingles").join(found, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )


def linked_classes(docs: DataFrame, full: DataFrame, id_col: str, text_col: str, percent: int, keep) -> DataFrame:
    """node, component of all ids that are not their own component."""
    reps = full.groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    reps = stage(reps, "classes")

    members = reps.select("rep", "n", F.posexplode("bands").alias("band", "key")).select("rep", "n", F.xxhash64("band", "key").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(members.join(shared, "bucket"), "buckets")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    sets = stage(shingle_sets(texts, members.select("rep").distinct()), "sets")
    links = class_links(members, sets, percent)

    same = full.select("id", "set_hash").join(reps.select("set_hash", "rep"), "set_hash").where("id <> rep")
    same = same.select(F.col("id").alias("u"), F.col("rep").alias("v"))
    return keep(components(links.union(same)))
