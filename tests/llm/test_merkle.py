"""Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

from fathomline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def steps(tree, at):
    for level in tree[:-1]:
        yield at % 2, level[at ^ 1] if (at ^ 1) < len(level) else None
        at //= 2


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in own]) for g, own in groups.items()}
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = levels([trees[g][-1][0] for g in names]) if names else [[]]
    out = []
    for k, g in enumerate(names):
        for at, row in enumerate(groups[g]):
            way = [*steps(trees[g], at), *steps(top, k)]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            told = leaf(row, 1) if hit else leaf(row)
            for side, sibling in way:
                told = sha(told) if sibling is None else sha(sibling, told) if side else sha(told, sibling)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[g][-1][0], root, sha(*[s for _, s in way if s is not None]), told, told == root))
    return sorted(out, key=str)


def got(spark, rows, levels):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, merkle.manifest(df, tampered=merkle.tampered_leaf(), levels=levels).collect()), key=str)


def table(n, langs):
    return [(i, f"text {i} é" if i % 11 else None, langs[i % len(langs)], None if i % 5 == 0 else f"s{i % 3}", None if i % 6 == 0 else i, "l", 1) for i in range(n)]


@pytest.mark.parametrize(("n", "langs", "levels"), [(57, ["en", None, "é", "z"], 2), (33, ["en"], 1), (64, ["en"], 3), (200, [f"l{k}" for k in range(41)], 2), (1, ["en"], 2), (2, ["en", None], 2), (90, ["en", "en", "en", "fr"], 10)])
def test_against_a_plain_tree(spark, n, langs, levels):
    rows = table(n, langs)
    assert got(spark, rows, levels) == brute(rows)


def test_repeated_and_null_identifiers(spark):
    rows = table(40, ["en", "fr", None])
    rows += [rows[3]] * 9 + [(None, "a", "en", "s", 1, "l", 1), (None, None, None, None, None, None, None), (3, "other", "en", "s", 1, "l", 1), (4, "", "", "", 0, "l", 1)]
    assert got(spark, rows, 2) == brute(rows)
    assert got(spark, [], 2) == []


def test_what_tampering_shows(spark):
    rows = table(60, ["en", "fr"])
    found = got(spark, rows, 3)
    for id, *_, verified in found:
        changed = zlib.crc32(str(id).encode()) % 7 == 0 and id % 6 != 0
        assert verified is not changed
    assert len({r[3] for r in found}) == 1
