"""Every stage of the pipeline against brute force, each on what its predecessor kept."""

import re

import corpus_pipeline
from locusmill.llm import quality

WINDOW = 10


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = docs
    # Quality: what the fitted machine scores below one half goes.
    kept = {i: t for i, t in kept.items() if machine.score(*quality.Features().of(t or "")) >= 0.5}
    expected = [kept]
    # Exact copies.
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i] or ""), i)
    kept = {i: kept[i] for i in first.values()}
    expected.append(kept)
    # Near copies: components of all pairs.
    ids, root = sorted(kept), {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(kept[i]) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    kept = {i: kept[i] for i in ids if find(i) == i}
    expected.append(kept)
    # Contaminated ones.
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = item_words(r.text)
        n = min(WINDOW, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    kept = {i: t for i, t in kept.items() if clean(item_words(t))}
    expected.append(kept)

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "benchmark decontamination", "byte-level bpe"]
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, expected, strict=False):
        held = stage(spark, held, sf_dir)
        assert held.columns == docs.columns, name
        assert {r.doc_id: r.text for r in held.collect()} == wanted, name
    last = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in last} == set(kept) and len(last) == len(kept)


def test_stages_of_awkward_tables(spark, sf_dir):
    rows = [(1, "a b c d e f g " * 9, "en"), (1, "other text of the same id " * 7, None), (None, None, None), (3, "", "en"), (3, None, "en"), (4, "a b c d e f g " * 9, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' AS source", "1 AS n_chars", "2 AS _key", "3 AS mark", "4 AS _row")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[1][1](spark, docs, sf_dir).count() == 4
