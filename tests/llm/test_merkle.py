"""Merkle manifests against a plain recursive tree."""

import hashlib
import random
import zlib

from tallyloom.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(nodes):
    """The top, and for each node its siblings on the way up, with how many of each level's stand before."""
    steps, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, at in enumerate(place):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            steps[k].append((run[: at % 8], run[at % 8 + 1 :]))
            place[k] = at // 8
        level = [digest(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0] if level else None, steps


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops, inner = [], []
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        top, steps = tree([leaf(*r) for r in own])
        tops.append(top)
        inner.append((own, steps))
    root, outer = tree(tops)
    out = []
    for (own, steps), top, rest in zip(inner, tops, outer, strict=True):
        for r, s in zip(own, steps, strict=True):
            path, text = s + rest, r[4]
            if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h = leaf(*r[:4], text)
            for before, after in path:
                h = digest(*before, h, *after)
            out.append((r[0], leaf(*r), top, root, digest(*[x for b, a in path for x in b + a]), h, h == root))
    return sorted(out, key=str)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def check(spark, folder, rows, extra=""):
    docs = spark.createDataFrame(rows, COLUMNS)
    for name in extra.split():
        docs = docs.withColumn(name, docs["doc_id"])
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    assert sorted(map(tuple, merkle.op13_merkle(spark, str(folder)).collect()), key=str) == expected(rows)


def test_against_a_plain_tree(spark, tmp_path):
    """Languages of many sizes, nulls in every column, repeated rows and ids, very long texts, clashing extra columns."""
    draw = random.Random(3)
    rows = []
    for lang, n in (("en", 600), ("de", 65), ("fr", 64), ("es", 9), ("it", 8), ("pt", 1), (None, 10), ("", 2), ("É", 3), ("zz", 2)):
        rows += [(draw.randrange(10**6), draw.choice(["web", "News", None]), lang, draw.choice([None, 5]), draw.choice([None, "", "Text Zwölf É ẞ", "x" * 9])) for _ in range(n)]
    rows += [rows[0], rows[0], rows[3], (rows[0][0], "other", "en", 1, "B"), (None, None, None, None, None), (None, "s", "en", 3, "A"), (-5, "s", "en", 3, "A"), (7, "s", "en", 3, "Ab" * 200_000)]
    check(spark, tmp_path, rows, "grp hash at n preimage path place")


def test_one_row_one_language_and_none(spark, tmp_path):
    check(spark, tmp_path / "one", [(4, "s", None, 1, "T")])
    check(spark, tmp_path / "two", [(k, "s", "en", 1, "T") for k in range(9)])
    check(spark, tmp_path / "none", [])


def test_many_equal_rows(spark, tmp_path):
    check(spark, tmp_path, [(1, "s", "en", 1, "T")] * 700 + [(2, "s", "de", 1, "T")])


def test_a_changed_leaf_is_found(spark):
    docs = spark.createDataFrame([(k, "s", "en", 1, f"T{k}") for k in range(40)], COLUMNS)
    root = {r["root"] for r in merkle.manifest(docs).collect()}
    other = {r["root"] for r in merkle.manifest(docs.replace("T7", "T8", "text")).collect()}
    assert len(root) == len(other) == 1 and root != other
