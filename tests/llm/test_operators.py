"""The training-data operators against brute force, on small awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import pytest

from locusmill.llm import byte_bpe, chat_format, decontaminate, exact_dedup, near_dedup, quality, repeat_spans, secret_scan, sharding, warc_zstd
from locusmill.llm.scratch import fresh_path


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_groups(docs, texts, words, percent):
    sets = [shingle_set(t, words) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    rows = near_dedup.near_groups(docs, words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}
    assert len(rows) == len(sets)


def test_near_copies_keep_columns(docs):
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < docs.count()


@pytest.mark.parametrize("most_blocks", [4096, 1])
def test_repeats(docs, texts, most_blocks):
    length = 200
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for d in data:
        seen.update(d[i : i + length] for i in range(len(d) - length + 1))
    rows = {r.doc_id: r for r in repeat_spans.remove_repeats(docs, most_blocks=most_blocks).collect()}
    assert len(rows) == len(data)
    for i, d in enumerate(data):
        gone = bytearray(len(d))
        for at in range(len(d) - length + 1):
            if seen[d[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        assert [tuple(s) for s in rows[i].spans] == spans
        assert (rows[i].n_bytes, bytes(rows[i].kept), rows[i].kept_sha256) == (len(d), kept, sha(kept))


def test_decontaminate(spark, docs, texts):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))

    long = words(texts[8])
    items = [(1, " ".join(long[100:130])), (2, "ONE, two!"), (10, None), (11, "..."), (12, "one"), (13, "one two"), (3, texts[20])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    expected = {}
    for i, text in enumerate(texts):
        has, hit, found = words(text), set(), set()
        for item, said in items:
            w = words(said)
            n = min(10, len(w))
            grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
            for at in range(len(has) - n + 1):
                if grams and tuple(has[at : at + n]) in grams:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
        expected[i] = (len(has), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    for most in (1_000_000, 0):
        rows = decontaminate.summary(decontaminate.find_hits(docs, table, most_broadcast=most)).collect()
        assert {r[0]: tuple(r)[1:] for r in rows} == expected
    assert decontaminate.find_hits(docs, table.limit(0)).count() == len(texts)


def test_secrets(docs, texts):
    kinds = {
        "assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 8),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32),
    }
    rows = {r.doc_id: r for r in secret_scan.summary(secret_scan.scan(docs)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        spans = []
        for rank, (kind, (pattern, group, least)) in enumerate(kinds.items()):
            spans += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
        listed = [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]
        count = Counter(s[3] for s in spans)
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(count[k] for k in kinds)
        assert rows[i].base_sha256 == sha(",".join(listed))
        assert [s for s in rows[i].spans.split(",") if s and not s.startswith("owned")] == listed


def test_ownership_separates_copied_from_live(spark):
    example, live = "Xk3Lm9Qw2Zr8Tv5Yb1Nc", "Pq7Rs4Tu1Vw8Xy5Za2Bc"
    rows = [(i, f"see {example} here", f"o{i}") for i in range(9)] + [(20, f"see {live} here", "o1")]
    found = {r.doc_id: r.spans for r in secret_scan.summary(secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))).collect()}
    assert found[20] == "owned:4:24" and not any(found[i] for i in range(9))


@pytest.fixture(scope="module")
def encoding():
    import base64

    import public_tokenizers
    import tiktoken

    lines = open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(docs, texts, encoding):
    rows = {r.doc_id: r for r in byte_bpe.summary(byte_bpe.decode(byte_bpe.encode(docs))).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = encoding.encode_ordinary(text or "")
        assert tuple(rows[i]) == (i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text or ""))


def test_bpe_long_cuts_and_odd_characters(encoding):
    import public_tokenizers

    bpe = byte_bpe.ByteBpe.from_file(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    for text in ("a" * 5000, "abcab" * 700, "日本語テキスト" * 90, "  \n\n \t x", "don't WE'LL 'S", "🙂🙃‍" * 40, "\u0000\x7f﻿", "=" * 999, "१२३ ⅷ²", "<|endoftext|>"):
        ids = bpe.encode(text)
        assert ids == encoding.encode_ordinary(text)
        assert "".join(bpe.decode_stream(ids)) == text


def test_exact_groups(docs, texts):
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = defaultdict(list)
    for i, t in enumerate(normal):
        groups[t].append(i)
    expected = {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t)) for i, t in enumerate(normal)}
    for counters in (1000, 1):
        assert {r[0]: tuple(r)[1:] for r in exact_dedup.duplicate_groups(docs, counters=counters).collect()} == expected
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.85 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert scored.count() == docs.count()


def test_quality_of_awkward_tables(spark, docs, nothing, texts):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)], "doc_id bigint, quality int, toxic int")
    machine = quality.train(docs, labels)
    assert quality.score(docs, machine).count() == len(texts)
    untaught = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, untaught).collect()} == {0.5}
    assert quality.drop_rejected(docs, untaught).columns == docs.columns
    assert quality.score(nothing, machine).count() == 0


def test_chat_round_trip(spark):
    said = [
        (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", None),
        (1, 0, "sys\ntem", "<\\|x|>\\n"), (2, 0, "assistant", "é𝒳"), (2, 0, "assistant", "é𝒳"), (None, 3, None, "<\\\\|"), (2, None, "user", ""),
    ]
    logs = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    rows = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(chat_format.as_events(logs))).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text in said:
        by_conv[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(rows) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (rows[conv].n_turns, rows[conv].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (rows[conv].loss_chars, rows[conv].loss_sha256) == (len(loss), sha(loss))


def test_chat_folds_events(spark):
    log = [
        (1, 0, 0, "start", "user", "hi"), (1, 1, 1, "start", "assistant", "he"), (1, 1, 2, "delta", "assistant", "llo"), (1, 2, 3, "start", "user", "old"),
        (1, 1, 4, "regenerate", "assistant", "new "), (1, 1, 5, "delta", "assistant", "try"), (1, 0, 6, "edit", "user", "hey"), (1, 2, 7, "start", "user", "next"),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string")
    parts = [r.formatted for r in chat_format.format_conversations(events).orderBy("part").collect()]
    assert [m for p in parts for m in chat_format.parse(p)] == [("user", "hey"), ("assistant", "new try"), ("user", "next")]


def test_warc_round_trip(spark):
    big = "x" * 100
    pages = [(1, "http://a/\r\n", None), (2, None, ""), (3, "u", big), (4, "u", big), (5, "v", "é" * 60), (6, "v", "short"), (7, "v", "short"), (None, "w", big)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, digest int")
    manifest = warc_zstd.write_archives(warc_zstd.records_of(frame), fresh_path(spark, "warc-test"))
    rows = warc_zstd.read_archives(manifest, payloads=True).collect()
    assert len(rows) == len(pages)
    found = {r.page_id: r for r in rows}
    for key, _, html in pages:
        data = (html or "").encode()
        r = found[key]
        revisit = html == big and key != 3
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), sha(data), "revisit" if revisit else "response", 3 if revisit else None)
        assert r.payload == (None if revisit else data)


def test_warc_reader_rejects_damage():
    import io

    record = warc_zstd.record_bytes(1, "u", b"payload", None, False)
    assert warc_zstd.parse_record(record)["payload"] == b"payload"
    for bad in (record.replace(b"payload", b"pAyload"), record[:-1], record.replace(b"WARC/1.1", b"WARC/0.9"), record.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc_zstd.WarcError):
            warc_zstd.parse_record(bad)
    for bad in (b"", b"\0" * 8, warc_zstd.dictionary_frame(None) + b"junk"):
        with pytest.raises(warc_zstd.WarcError):
            list(warc_zstd.archive_frames(io.BytesIO(bad)))


def test_sharding(spark, docs, texts):
    table = sharding.lookup_table(spark).collect()
    share = Counter(r.shard for r in table)
    assert len(table) == sharding.SIZE and max(share.values()) - min(share.values()) <= 1
    placed = sharding.place(docs, "doc_id")
    assert placed.count() == len(texts) and placed.columns == [*docs.columns, "slot", "shard"]
    fewer = {r.slot: r.shard for r in sharding.lookup_table(spark, sharding.SHARDS[:-1]).collect()}
    moved = sum(fewer[r.slot] != r.shard for r in table if r.shard != sharding.SHARDS[-1])
    assert moved < 0.25 * sharding.SIZE
    with pytest.raises(ValueError):
        sharding.place(placed, "doc_id")


def test_empty_tables(nothing, spark):
    items = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    for out in (
        near_dedup.near_groups(nothing), repeat_spans.remove_repeats(nothing), decontaminate.find_hits(nothing, items), secret_scan.scan(nothing),
        byte_bpe.encode(nothing), exact_dedup.duplicate_groups(nothing), sharding.place(nothing, "doc_id"),
    ):
        assert out.count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    quality_kept = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).count()
    assert corpus_pipeline.run(spark, sf_dir).count() <= quality_kept <= docs.count()


@pytest.mark.parametrize("unit", [b"a", b" ", b"ab", b"-", b"0", b"xq", "é".encode(), b"the cat ", b"\x00", b"=-"])
def test_tokens_come_after_bounded_lookahead(encoding, unit):
    """No token of a cut of 100,000 bytes comes more than 2,000 bytes after its own last byte; states stay bounded; ids are the library's."""
    import public_tokenizers

    transducer = byte_bpe.BytePairTransducer(byte_bpe.ranks_of(public_tokenizers.path(byte_bpe.VOCABULARY)))
    data, read = (unit * 100_000)[:100_000], 0

    def bytes_read():
        nonlocal read
        for byte in data:
            read += 1
            yield byte

    upto, ids, most = 0, [], 0
    for token in transducer.stream(bytes_read()):
        ids.append(token)
        upto += len(transducer.names[token])
        most = max(most, read - upto)
    assert b"".join(transducer.names[t] for t in ids) == data and most < 2_000
    assert ids[:50] == transducer.merge(data[:1000])[:50]


def test_states_are_bounded_in_one_long_cut(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(byte_bpe, "MEMO_MOVES", 2_000)
    transducer = byte_bpe.BytePairTransducer(byte_bpe.ranks_of(public_tokenizers.path(byte_bpe.VOCABULARY)))
    data = bytes(random.Random(1).choices(range(97, 123), k=60_000))
    ids, most = [], 0
    for token in transducer.stream(data):
        ids.append(token)
        most = max(most, len(transducer._moves))
    assert b"".join(transducer.names[t] for t in ids) == data and most < 2_000 + 2 * byte_bpe.LOOK_BACK
