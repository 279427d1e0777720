"""Line deduplication, periodic runs and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusmill.llm import bloom, line_dedup, merkle, periodic_runs
from locusmill.llm.queries import op12_periodic_runs


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def line_key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows, least_chars=40, least_docs=5):
    holders = defaultdict(list)
    for n, (doc, text) in enumerate(rows):
        for key in {line_key(x) for x in (text or "").split("\n")}:
            if len(key) >= least_chars:
                holders[key].append(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in last or last[line_key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(3)
    common = [f"Line Number {i} é " + "x" * rng.randrange(15, 40) for i in range(12)] + ["é" * 39, "É" * 40, "Q" * 40, "q" * 40]
    rows = [(None, None), (None, ""), (7, "\n\n"), (7, "Q" * 40), (7, "q" * 40 + "\n" + "Q" * 40), (None, "only nulls " * 5)] + [(None, "only nulls " * 5)] * 5
    for i in range(150):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice(common) + rng.choice(["", "\r", " \x0b"]) for _ in range(rng.randrange(5))]
        lines += [f"own line {i} {j} " + "y" * rng.randrange(60) for j in range(rng.randrange(3))]
        rng.shuffle(lines)
        rows.append((rng.randrange(90), "\n".join(lines)))
    rows.append((500, "\n".join(common * 3 + ["Z" * 200_000])))
    return rows + rows[-20:]


@pytest.mark.parametrize("bits", [None, 1 << 15])
def test_lines_against_brute_force(spark, bits):
    """At one block of bits the filters are full and nearly all lines are suspected; the result stays."""
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id bigint, text string, kept string, _key int").repartition(5)
    found = sorted((tuple(r) for r in line_dedup.drop_repeated_lines(docs, bits=bits).select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)
    assert found == sorted(brute_lines(rows), key=repr)


def test_filters_hold_what_was_met_once_and_twice(spark):
    rng = random.Random(9)
    once, twice = [rng.randrange(-(2**63), 2**63) for _ in range(3000)], [rng.randrange(-(2**63), 2**63) for _ in range(500)]
    met = spark.createDataFrame([(h,) for h in once + twice * 2], "h bigint").repartition(6)
    bits = 1 << 20
    known = bloom.filters(met, bits, held=100).cache()
    probes = spark.createDataFrame([(h, i) for i, part in enumerate((once, twice, [rng.randrange(-(2**63), 2**63) for _ in range(3000)])) for h in part], "h bigint, part int")
    counts = {(w, r.part): r.n for w in ("once", "twice") for r in bloom.maybe_in(probes, "h", known, w, bits, "left").where("_maybe").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert counts["once", 0] == 3000 and counts["once", 1] == counts["twice", 1] == 500
    assert counts.get(("twice", 0), 0) < 60 and counts.get(("once", 2), 0) < 60


def brute_runs(w, least=6, exponent=4):
    best = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(least, exponent * p):
                best.setdefault((start, i + p), p)
    return sorted(((s, e, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        letters = rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(letters) for _ in range(rng.randrange(rng.choice([12, 40, 90])))]
        while w and len(w) < 300 and rng.random() < 0.6:
            i = rng.randrange(len(w))
            j = min(len(w), i + rng.randrange(1, 9))
            w[i:j] = w[i:j] * rng.randrange(2, 7)
            i = rng.randrange(len(w))
            w += w[i : i + 30]
        exponent, least = rng.choice([3, 4, 5]), rng.choice([2, 6])
        assert periodic_runs.runs_of(w, least, exponent) == brute_runs(w, least, exponent), w
        assert periodic_runs.text_runs([str(x) for x in w], least, exponent) == brute_runs(w, least, exponent), w


def test_factors_are_the_longest_earlier_ones():
    rng = random.Random(2)
    for _ in range(300):
        w = "".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(60)))
        at = 0
        for start, end, source in periodic_runs.factors([ord(c) for c in w]):
            assert start == at
            longest = max((n for n in range(len(w) - at + 1) if w.find(w[at : at + n], 0, at + n - 1) >= 0), default=0)
            assert (end - start, source >= 0) == (max(longest, 1), longest > 0)
            assert source < 0 or (source < start and w[source : source + end - start] == w[start:end])
            at = end
        assert at == len(w)


def brute_looped(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc is None else str(doc)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_run_row(doc, text):
    words = brute_looped(doc, text)
    runs = brute_runs(words)
    kept = [True] * len(words)
    for s, e, p in runs:
        kept[s + p : e] = [False] * (e - s - p)
    best = min(((s - e, s, p) for s, e, p in runs), default=None)
    row = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc, len(runs), *row, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in runs)), sha(" ".join(w for w, k in zip(words, kept) if k)))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_periodic_runs_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = rows_of(op12_periodic_runs(spark, sf_dir))
    assert found == sorted((brute_run_row(*r) for r in docs), key=repr)
    assert sum(r[1] for r in found) > 10


def test_periodic_runs_of_awkward_texts(spark, texts):
    long = " ".join(["tick"] * 60_000 + ["a", "b", "c"] * 40_000)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 20), (None, None), (3, "x\x0by " * 9 + " z " * 7), (3, "x\x0by " * 9 + " z " * 7)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, runs string, _key int").repartition(3)
    looped = periodic_runs.looped(docs)
    assert rows_of(periodic_runs.summary(periodic_runs.find_runs(looped))) == sorted((brute_run_row(*r) for r in rows), key=repr)
    one = periodic_runs.find_runs(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in one.runs] == [(0, 60_000, 1), (60_000, 120_000, 3)] and one.collapsed == "tick a b c"


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(nodes):
    """Root, and for each node the siblings on its way with the own place among them."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for way, i in zip(ways, range(len(ways))):
            run = runs[at[i] // 8]
            way.append((run[: at[i] % 8], run[at[i] % 8 + 1 :]))
            at[i] //= 8
        level = [sha("".join(r)) for r in runs]
    return level[0], ways


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((-(2**63) if r[0] is None else r[0], brute_leaf(r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: brute_tree([leaf for _, leaf, _ in sorted(langs[x], key=lambda t: t[:2])]) for x in names}
    root, tops = brute_tree([trees[x][0] for x in names])
    out = []
    for name, top in zip(names, tops):
        for (_, leaf, r), way in zip(sorted(langs[name], key=lambda t: t[:2]), trees[name][1]):
            held, changed = [], r
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 and r[4] is not None:
                changed = (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))
            fold = brute_leaf(changed)
            for left, right in way + top:
                held += left + right
                fold = sha("".join(left) + fold + "".join(right))
            out.append((r[0], leaf, trees[name][0], root, sha("".join(held)), fold, fold == root))
    return sorted(out, key=repr)


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("n", [0, 1, 9, 64, 700])
def test_manifest_against_brute_force(spark, n):
    rng = random.Random(n)
    many = [f"l{i}" for i in range(70)] if n == 700 else ["en", "", "é", None]
    rows = [
        (None if i % 97 == 5 else i // 2 * 3, rng.choice(["s", None, "ß"]), "en" if rng.random() < 0.6 else rng.choice(many), rng.choice([None, i]), rng.choice([None, "", "Text é𝒳 A", f"T{i}"]))
        for i in range(n)
    ]
    rows += rows[: n // 4]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", node string, at int").repartition(4)
    found = merkle.summary(merkle.manifest(docs, merkle.lower_cased_third()))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(found) == (brute_manifest(rows) if rows else [])
    if rows:
        assert all(r.folded_root == r.root for r in merkle.summary(merkle.manifest(docs)).collect())


def test_new_operators_on_an_empty_table(spark, nothing):
    assert line_dedup.summary(line_dedup.drop_repeated_lines(nothing)).count() == 0
    assert periodic_runs.summary(periodic_runs.find_runs(periodic_runs.looped(nothing))).count() == 0
    assert merkle.summary(merkle.manifest(nothing)).count() == 0


def test_rows_that_go_by_their_marks(spark):
    rows = [(None if i % 7 == 0 else i % 40, f"t{i % 60}", i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _row int").repartition(5)
    gone = [(None, "t7"), (3, "t3"), (5, "t5"), (99, "t1"), (12, "t52")]
    left = bloom.drop_rows(docs, {"_key": docs["doc_id"], "_mark": docs["text"]}, spark.createDataFrame(gone, "_key int, _mark string"))
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted((r for r in rows if r[:2] not in gone), key=repr)
    # Most rows need no shuffle: the filter is sure of them.
    flagged = bloom.maybe_among(docs.withColumnsRenamed({"doc_id": "_key", "text": "_mark"}), ["_key", "_mark"], spark.createDataFrame(gone, "_key int, _mark string"))
    assert flagged.where("_maybe").count() == sum(r[:2] in gone for r in rows)
