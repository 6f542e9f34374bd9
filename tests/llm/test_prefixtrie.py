import hashlib
import random
import re
import zlib

import pytest

from tallyhouse.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, part string, depth string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {k: [] for k in members}
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(k[-1][1])) if k else 0
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in children[k])
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items()), key=repr
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shown(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def cases(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.choice([1, 1, 2, 4, 9])):
            rows.append((c * 2, rng.choice([t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["hi there", "a b  c\n", "", None, "d"]), "x", "y"))
    return rows + rows[:7] + [(None, 1, "user", "lost", "", "")]


@pytest.mark.parametrize("size", [2, 3, prefixtrie.BLOCK])
def test_against_brute_force(spark, size):
    rows = cases(size)
    turns = prefixtrie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert shown(prefixtrie.prefix_trie(turns, size=size)) == brute(ordered(rows))
    heads, ids = prefixtrie.share_heads(turns)
    assert shown(prefixtrie.prefix_trie(heads, ids, size=size)) == brute(rebuilt(ordered(rows)))


def test_one_long_conversation_and_many_copies(spark):
    long = [(1, t, "user", f"turn {t}", "", "") for t in range(2500)]
    side = [(3, t, "user", f"turn {t}" if t < 1700 else f"other {t}", "", "") for t in range(1800)]
    copies = [(100 + c, t, "user", f"same {t}", "", "") for c in range(800) for t in range(2)]
    rows = long + side + copies
    turns = prefixtrie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(9))
    assert shown(prefixtrie.prefix_trie(turns, size=200)) == brute(ordered(rows))


def test_turnless_members_and_empty_table(spark):
    rows = [(21, 0, "user", "a", "", ""), (22, 0, "user", "a", "", "")]
    turns = prefixtrie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    assert shown(prefixtrie.prefix_trie(*prefixtrie.share_heads(turns))) == brute(rebuilt(ordered(rows)))
    assert shown(prefixtrie.prefix_trie(prefixtrie.numbered_turns(spark.createDataFrame([], SCHEMA)))) == []
