import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from seglume.llm import merkle

DOCS = "doc_id long, text string, source string, lang string, n_chars int, leaf string, g string, at int, n string, block int"


def h(x):
    return sha256(x.encode()).hexdigest()


def say(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def rise(nodes, arity):
    """Root and paths of a list of digests, level by level."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), arity)
        for k, at in enumerate(nodes):
            a = k // arity * arity
            for i in members[k]:
                paths[i].append((k - a, nodes[a:k] + nodes[k + 1 : a + arity]))
        members = [sum(members[a : a + arity], []) for a in runs]
        nodes = [h("".join(nodes[a : a + arity])) for a in runs]
    return nodes[0], paths


def brute(data, arity):
    rows = defaultdict(list)
    for d in data:
        doc_id, text, source, lang, n = d[:5]
        leaf = h("".join(map(say, (doc_id, source, lang, n, text))))
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        changed = h("".join(map(say, (doc_id, source, lang, n, low)))) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else None
        rows[source].append((doc_id is not None, doc_id or 0, leaf, doc_id, changed))
    order = sorted(rows, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: rise([r[2] for r in sorted(rows[s], key=lambda r: r[:3])], arity) for s in order}
    root, tops = rise([subs[s][0] for s in order], arity)
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(sorted(rows[s], key=lambda r: r[:3]), subs[s][1]):
            node = r[4] or r[2]
            for place, others in path + top:
                node = h("".join(others[:place] + [node] + others[place:]))
            out.append((r[3], r[2], subs[s][0], root, h("".join(x for _, o in path + top for x in o)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity, levels", [(16, 3), (2, 2), (3, 1)])
def test_manifest_is_that_of_brute_force(spark, arity, levels):
    data = [(i * 7 % 1009, "Aé" * (i % 50), ["big", "big", "é", "z", None][i % 5], "en" if i % 3 else None, i % 9, "l", "g", 1, "n", 2) for i in range(700)]
    data += [(3000 + i, "One", f"s{i}", None, None, None, None, None, None, None) for i in range(20)]  # sources of one row
    data += [(None, None, "big", None, None, "", "", 0, "", 0), (None, "X", "big", None, 1, "", "", 0, "", 0), *data[:3], (5000, "W " * 200_000, None, "", 0, "", "", 0, "", 0), (1, "", "", "", 0, "", "", 0, "", 0)]
    docs = spark.createDataFrame(data, DOCS).repartition(6)
    got = sorted((tuple(r) for r in merkle.manifest(docs, params=merkle.MerkleParams(arity=arity, block_levels=levels)).collect()), key=str)
    want = brute(data, arity)
    assert got == want
    assert {True, False} == {r[-1] for r in got}


def test_no_row_one_row_and_rows_of_one_kind(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(None,) * 10], DOCS)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == h("-----") and one.proof_sha256 == h("") and one.verified
    same = [(4, "t", "s", "l", 1, "", "", 0, "", 0)] * 40
    got = merkle.manifest(spark.createDataFrame(same, DOCS)).collect()
    # runs of 16, 16 and 8, then 3: rows in equal places of equal runs have equal proofs
    assert len(got) == 40 and len({r.root for r in got}) == 1 and sorted(Counter(r.proof_sha256 for r in got).values()) == [8, 32] and all(r.verified for r in got)


def test_a_traversal_keeps_a_few_runs_and_gives_each_path():
    for n in (1, 2, 15, 16, 17, 255, 256, 300, 1000):
        leaves = [h(str(i)) for i in range(n)]
        levels = merkle._height(n, 16)
        root, want = rise(leaves, 16)
        got = list(merkle.paths(leaves, levels, 16))
        assert [[(place, "".join(others)) for place, others in path] for path in want] == got
        assert all(merkle.folded(leaf, path) == root for leaf, path in zip(leaves, got))
    tree = merkle.Subtree(2, 16)
    for i in range(4096):
        tree.push(str(i))
        assert sum(map(len, tree.open[:-1])) <= 2 * 16
