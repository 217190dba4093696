import hashlib
import random
import zlib

import pytest

from colloquy.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node int"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H([told(r[0]), told(r[3]), told(r[2]), told(r[4]), told(text)])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def path(levels, at):
    out = []
    for below in levels[:-1]:
        begin = at - at % 8
        out.append((below[begin:at], below[at + 1 : begin + 8]))
        at //= 8
    return out


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[k] = levels_of([leaf(r, r[1]) for r in by[k]])
    top = levels_of([trees[k][-1][0] for k in keys])
    out = []
    for n, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            way = path(trees[k], i) + path(top, n)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            x = leaf(r, text)
            for before, after in way:
                x = H([*before, x, *after])
            out.append((r[0], leaf(r, r[1]), trees[k][-1][0], top[-1][0], H([s for b, a in way for s in (*b, *a)]), x))
    return sorted(out, key=str)


def told(df):
    return sorted([(r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), H([bytes(r.proof).hex()]), r.folded_root.hex()) for r in df.collect()], key=str)


def compare(spark, rows, levels):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    assert told(M.manifest(df, levels)) == brute(rows)


def corpus(seed, n):
    rnd = random.Random(seed)
    texts = ["A b", "abc", None, "", "Zz É", "x" * 50]
    return [(rnd.choice([None, *range(n)]), rnd.choice(texts), rnd.choice(["en"] * 12 + [None, "de", "", "É"]), rnd.choice(["x", None]), rnd.choice([1, None])) for _ in range(n)]


@pytest.mark.parametrize("levels", [1, 2, M.LEVELS])
def test_trees_of_several_tiers_match_brute_force(spark, levels):
    compare(spark, corpus(levels, 700), levels)


def test_groups_that_end_at_every_size(spark):
    rows = [(k, f"T {k}", f"g{n:02d}", "s", k) for n in (1, 2, 7, 8, 9, 63, 64, 65) for k in range(n)]
    compare(spark, rows, 1)
    compare(spark, [(1, "A", "en", None, 3)], 1)  # a lone leaf is the root, its proof is of nothing


def test_repeated_rows_long_texts_and_empty_tables(spark):
    same = (6, "Same", "en", "s", 4)
    compare(spark, [same] * 40 + [(7, "Long " * 400_000, "en", "s", 1), (None, "A", None, None, None), (None, "A", None, None, None)], 1)
    assert M.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_group_of_a_third_of_all_rows(spark):
    compare(spark, [(k, f"T{k % 5}", "hot" if k % 3 else f"l{k % 60}", "s", k) for k in range(1500)], 2)


def test_versions_share_all_but_their_ancestors():
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(100)]
    tree = M.Tree(digests, 3, 100)
    before = (list(tree.digests), list(tree.children), tree.root)
    root, first = tree.version(37, b"\0" * 32)
    copied = range(first, len(tree.digests))
    assert len(copied) == len(tree.levels)  # the leaf and one node of each level above
    for new in copied[1:]:
        old = [x for level in tree.levels for x in level if tree.children[x] and len(set(tree.children[x]) & set(tree.children[new])) == len(tree.children[x]) - 1]
        assert old and all(c < first or c == new - 1 for c in tree.children[new])
    changed = M.Tree([b"\0" * 32 if k == 37 else d for k, d in enumerate(digests)], 3, 100)
    assert tree.digests[root] == changed.digests[changed.root]
    tree.forget(first)
    assert (tree.digests, tree.children, tree.root) == before


def test_paths_as_bytes():
    levels = [[[b"a" * 32], [b"b" * 32] * 6], [[], []], [[b"c" * 32] * 7, []]]
    assert M.as_levels(M.as_path(levels)) == levels
