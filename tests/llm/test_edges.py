"""Edges of the training-data operators: logs that are replayed, periodic and very long texts, clashing names, empty tables, and the model's arithmetic."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.llm import byte_bpe, chat_format, decontaminate, exact_dedup, near_dedup, quality, repeat_spans, secret_scan, sharding, warc_zstd
from locusmill.llm.scratch import fresh_path


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


LOG = "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string"


def replayed(log):
    """The log applied event by event in the order of sequence, on turns kept side by side."""
    turns = defaultdict(list)
    for _, turn, _seq, kind, role, text in sorted(log, key=lambda e: e[2]):
        if kind == "regenerate":
            for t in [t for t in turns if t >= turn]:
                del turns[t]
        if kind in ("start", "regenerate") or not turns[turn]:
            turns[turn].append([role, text])
        elif kind == "edit":
            turns[turn][-1][1] = text
        else:
            turns[turn][-1][1] += text
    return [tuple(m) for t in sorted(turns) for m in turns[t]]


def test_random_logs_fold_as_they_replay(spark):
    rng = random.Random(11)
    logs = {}
    for conv in range(40):
        seqs = rng.sample(range(1000), rng.randrange(1, 14))
        logs[conv] = [(conv, rng.randrange(4), s, rng.choice(["start", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant"]), f"t{s}<|im_end|> ") for s in seqs]
    events = spark.createDataFrame([e for log in logs.values() for e in log], LOG).repartition(5)
    parts = defaultdict(list)
    formatted = chat_format.format_conversations(events)
    for r in formatted.collect():
        parts[r.conv_id].append((r.part, r.formatted, r.last))
    assert set(parts) == {c for c in logs if replayed(logs[c])}
    for conv, rows in parts.items():
        rows.sort()
        assert [p for p, _, _ in rows] == list(range(len(rows))) and [last for *_, last in rows] == [False] * (len(rows) - 1) + [True]
        assert list(chat_format.parse("".join(f for _, f, _ in rows))) == replayed(logs[conv])
    # Parts that were written and dealt anew read alike; out of order they are an error.
    path = fresh_path(spark, "parts-test")
    formatted.repartition(7, "part").write.parquet(path)
    again = chat_format.read_back(spark.read.parquet(path)).collect()
    assert {r.conv_id: r.turns_sha256 for r in again} == {c: sha("".join(f"{r}\n{t}\n" for r, t in replayed(logs[c]))) for c in parts}
    with pytest.raises(Exception, match="in_order=False"):
        chat_format.read_back(spark.read.parquet(path), in_order=True).collect()


def test_streamed_log_gives_the_messages_back(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = [(-5, t, r, x) for t, r, x in ((0, "user", "a"), (0, "assistant", None), (1, "assistant", "é𝒳z"), (1, "assistant", "é𝒳z"), (None, None, ""), (2, "assistant", "<|im_start|>x"))]
    rows = table.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(odd, "conv_id bigint, turn bigint, role string, text string"))
    said = defaultdict(list)
    for r in rows.collect():
        said[r.conv_id].append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    log = chat_format.as_streamed(rows)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    for r in chat_format.read_back(chat_format.format_conversations(log), in_order=True).collect():
        turns = sorted(said.pop(r.conv_id))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)), len(loss), sha(loss))
    assert not said


def brute_removed(data, length):
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = bytearray(len(d))
        for at in range(len(d) - length + 1):
            if seen[d[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        yield [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]


@pytest.mark.parametrize("most_blocks", [4096, 1])
def test_periodic_text(spark, most_blocks):
    ruler = "-" * 60 + "+"
    texts = ["a" * 700, "a" * 200, "a" * 199, "b" * 200, "ab" * 150, "ba" * 101, "xyz" + "ab" * 120 + "!", ruler * 9, "x" * 150 + ruler * 5, "c" * 201, "d" * 100 + "e" * 250, "e" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in repeat_spans.remove_repeats(docs, most_blocks=most_blocks).collect()}
    for i, spans in enumerate(brute_removed([t.encode() for t in texts], 200)):
        assert [tuple(s) for s in rows[i].spans] == spans, texts[i][:40]


def test_periodic_text_makes_few_rows():
    for unit in (b"a", b"ab", b"-" * 60 + b"+"):
        data = np.frombuffer((unit * (1_000_000 // len(unit) + 1))[:1_000_000], np.uint8)
        at, count, times, _, _ = repeat_spans.distinct_runs(*repeat_spans.runs_of(data, 200, 32))
        assert len(at) < 300 and int((count * times).sum()) == 1_000_000 - 199
        # All but a part of a run at either end is settled in one span.
        assert (times == 0).sum() == 1 and int(count[times == 0][0]) > 999_600


def test_factorisation_machine_against_explicit_pairs():
    rng = np.random.default_rng(5)
    machine = quality.fit([quality.Features().of(t) for t in ("good words here", "BAD!!! ##", "plain text again", "%% $$")], np.array([1, 0, 1, 0], np.float32))
    machine.factors[:] = rng.normal(0, 0.3, machine.factors.shape)
    for text in ("", "one", "some words, some Words 12", "#$ !!\n" * 9):
        index, values = quality.Features().of(text)
        x, v = machine.standardised(index, values).astype(float), machine.factors[index].astype(float)
        margin = machine.bias + float(x @ machine.linear[index])
        margin += sum(float(v[i] @ v[j]) * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert machine.score(index, values) == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -30, 30))), abs=1e-5)


def test_gradient_of_the_identity_is_that_of_the_pairs():
    """The step uses x_i (total - v_i x_i) for the derivative of the pairwise term by v_i."""
    rng = np.random.default_rng(6)
    x, v = rng.normal(size=7), rng.normal(size=(7, 4))
    pairs = lambda w: sum(float(w[i] @ w[j]) * x[i] * x[j] for i in range(7) for j in range(i))
    xv = x[:, None] * v
    toward = x[:, None] * (xv.sum(0) - xv)
    for i in range(7):
        for f in range(4):
            step = np.zeros_like(v)
            step[i, f] = 1e-6
            assert toward[i, f] == pytest.approx((pairs(v + step) - pairs(v - step)) / 2e-6, abs=1e-5)


def test_sample_takes_one_text_of_each_id(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i % 11} of {i % 5}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id bigint, quality int")
    machine = quality.train(docs, labels)
    rows = quality.score(docs, machine).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 for r in rows)
    assert len({(r.doc_id, r.score) for r in rows}) <= 55


NAMES = ["_key", "_text", "_row", "_digest", "set", "bucket", "estimate", "item", "at", "label", "root", "node", "gram", "window", "_packed", "_same", "ids", "key", "values", "spans", "print", "n", "known", "_words"]


def test_clashing_columns_and_long_texts(spark):
    """One text of 120,000 words, one of 300,000 characters without a space, and extra columns by all names in use."""
    rng = random.Random(8)
    words = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(900)) for _ in range(120_000))
    texts = [words, words, words.replace("alpha", "alphas", 5), "x1" * 150_000, None, ""]
    base = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs = base.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))
    items = spark.createDataFrame([(1, " ".join(words.split()[500:520]))], "item_id bigint, text string")
    groups = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect()}
    assert groups == {0: (0, True), 1: (0, False), 2: (0, False), 3: (3, True), 4: (4, True), 5: (5, True)}
    exact = {r.doc_id: r.keep_id for r in exact_dedup.duplicate_groups(docs).collect()}
    assert exact == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}
    hits = {r.doc_id: (r.n_words, r.contaminated) for r in decontaminate.summary(decontaminate.find_hits(docs, items)).collect()}
    assert hits == {0: (120_000, True), 1: (120_000, True), 2: (120_000, True), 3: (1, False), 4: (0, False), 5: (0, False)}
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeat_spans.summary(repeat_spans.remove_repeats(docs, texts_too=False)).collect()}
    assert removed[0] == removed[1] == (len(words),) * 2 and removed[3] == (300_000, 300_000) and removed[4] == (0, 0)
    trip = {r.doc_id: r for r in byte_bpe.summary(byte_bpe.round_trip(docs)).collect()}
    chain = {r.doc_id: r for r in byte_bpe.summary(byte_bpe.decode(byte_bpe.encode(docs))).collect()}
    assert trip == chain and all(trip[i].decoded_sha256 == sha(t or "") for i, t in enumerate(texts))
    assert secret_scan.summary(secret_scan.scan(docs.withColumn("source", F.lit("s")))).count() == len(texts)
    machine = quality.train(docs, spark.createDataFrame([(0, 1), (3, 0), (4, 0)], "doc_id bigint, quality int"))
    assert quality.score(docs, machine).count() == len(texts)
    assert sharding.place(docs, "doc_id").count() == len(texts)
    for stage in (exact_dedup.drop_exact_copies(docs), near_dedup.drop_near_copies(docs), decontaminate.drop_contaminated(docs, items), quality.drop_rejected(docs, machine)):
        assert stage.columns == docs.columns


def test_all_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    items = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    machine = quality.train(docs, labels)
    logs = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    out = [
        near_dedup.near_groups(docs), repeat_spans.remove_repeats(docs), decontaminate.find_hits(docs, items), secret_scan.scan(docs), byte_bpe.round_trip(docs),
        exact_dedup.duplicate_groups(docs), quality.score(docs, machine), sharding.place(docs, "doc_id"),
        chat_format.read_back(chat_format.format_conversations(chat_format.as_streamed(logs))),
        warc_zstd.read_archives(warc_zstd.write_archives(warc_zstd.records_of(pages), fresh_path(spark, "warc-empty"))),
        quality.drop_rejected(docs, machine), exact_dedup.drop_exact_copies(docs), near_dedup.drop_near_copies(docs), decontaminate.drop_contaminated(docs, items),
    ]
    assert [o.count() for o in out] == [0] * len(out)
