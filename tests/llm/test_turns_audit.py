"""The prefix trie and the filter audit against brute force on small fixtures."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from lectern.llm import audit, turns

TURNS = "conv_id long, turn long, role string, text string, path string, words string, n long, level int, head string"


def talks(n=120, seed=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 3 if c % 2 else c - 40
        length = r.choice((1, 2, 2, 3, 5, 9))
        texts = ["hello there", *(f"t{r.randrange(3)} w " * r.randrange(1, 3) for _ in range(length))] if c % 4 else [f"own {r.randrange(4)}"] * length
        rows += [(c, i, "ua"[i % 2], t) for i, t in enumerate(texts)]
    rows += [(9000, None, "u", "late first"), (9000, 1, None, None), (9000, 1, "u", None), (9000, 1, "u", None), (9001, 5, "", ""), (None, 0, "u", "x")]
    rows += [(7000 + 2 * i, t, "u", f"copy {t} " * 4) for i in range(60) for t in range(6)] + [(7100, t, "u", f"deep {t}") for t in range(400)]
    r.shuffle(rows)
    return rows


def turn_id(role, text):
    """By which turns of one number and role are ordered."""
    return hashlib.sha256(f"{len(role)}:{role}{len(text)}:{text}".encode()).digest()


def nodes_of(rows):
    """The contract read plainly."""
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", turn_id(role or "", text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = tuple(own.get(base, [])[:h]) + tuple(v[h:])
    members = collections.defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += worth
    sha = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if full[c] == p))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p, m)) for p, m in members.items()), key=repr)


@pytest.mark.parametrize("most", [1, 4, 1024])
def test_prefix_trie(spark, most):
    rows = talks()
    table = spark.createDataFrame([(*x, "p", "w", 1, 2, "h") for x in rows], TURNS).repartition(3)
    if most == 1:  # every shared head bursts: keep the deep conversation out, or there are as many rounds as turns
        rows = [x for x in rows if x[0] is None or x[0] < 7000]
        table = table.where("conv_id IS NULL OR conv_id < 7000")
    got = sorted((tuple(x) for x in turns.prefix_nodes(table, most).collect()), key=repr)
    assert got == nodes_of(rows)


def test_prefix_trie_of_nothing(spark):
    assert turns.prefix_nodes(spark.createDataFrame([], TURNS)).count() == 0
    assert turns.prefix_nodes(spark.createDataFrame([(None, 1, "u", "x", "p", "w", 1, 2, "h")], TURNS)).count() == 0


def test_common_turns():
    a, b = bytes(range(16)), bytes(range(16, 32))
    assert turns.common_turns(a + b, a + b + a) == 2 and turns.common_turns(a, b) == 0 and turns.common_turns(b"", a) == 0 and turns.common_turns(a * 5 + b, a * 7) == 5


DOCS = "doc_id long, text string, source string, h string, mask int, part string, good int, first boolean"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, s in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        a, b, c = len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t or "")) > 5 * len(t or "")
        yield i, s or "", dict(zip("ABCDE", (a, b, c, bool(re.search("[#$%&*|]", t or "")), i is not None and i > least[t or ""])))


def audited(rows, labels):
    good, toxic = {x[0] for x in labels if x[1] == 1 and x[0] is not None}, {x[0] for x in labels if x[2] == 1 and x[0] is not None}
    of = list(fails(rows))
    out = []
    for part in {s for _, s, _ in of}:
        mine = [(i, f) for i, s, f in of if s == part]
        removed, shares = {}, collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, x in enumerate(order):
                gone, left = [y for y in left if y[1][x]], [y for y in left if not y[1][x]]
                shares[x] += len(gone)
                alone = sum(f[x] and sum(f.values()) == 1 for _, f in mine)
                removed[order, k + 1] = (x, len(left), len(gone), sum(f[x] for _, f in mine) - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        out += [(part, *key, *v[1:], shares[v[0]]) for key, v in removed.items()]
    return sorted(out)


def audit_rows():
    r = random.Random(5)
    rows = []
    for i in range(90):
        words = [f"w{r.randrange(80)}" + "#" * (r.random() < 0.004) for _ in range(r.choice((3, 49, 50, 51, 90)))]
        text = " \t\n\u000b\f\r"[i % 6].join(words) + "ABC" * r.randrange(4)
        rows.append((i, rows[r.randrange(len(rows))][1] if i % 4 == 3 else text, "ab"[i % 2]))
    return [*rows, (None, rows[5][1], None), (None, None, "a"), (200, None, "a"), (201, "", None), (3, rows[3][1], "b"), (3, rows[3][1], "b"), (202, "x" * 100_000 + " A" * 60, "z"), (203, " é " * 60, "z")]


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 90, 2)] + [(2, 1, 1), (2, None, 0), (None, 1, 1), (999, 1, 1), (200, None, 1)]
    docs = spark.createDataFrame([(*x, "h", 1, "p", 1, True) for x in rows], DOCS).repartition(3)
    got = audit.interactions(docs, spark.createDataFrame([(*x, "p") for x in labels], LABELS))
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.interactions(docs, labels).count() == 0
    one = audit.interactions(spark.createDataFrame([(1, None, None, "h", 1, "p", 1, True)], DOCS), labels).collect()
    assert len(one) == 600 and {x.part for x in one} == {""} and sum(x.removed for x in one) == 120
