"""Candidates of the secret scan that were lost: dotted tokens, late digits and copied documents."""

import hashlib
import random
import re
import time
from collections import defaultdict

from locusmill.llm import secret_scan


def spans(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return {r.doc_id: r.spans for r in secret_scan.summary(secret_scan.scan(docs)).collect()}


def test_dots_late_digits_and_copies(spark):
    jwt, late, tail = "eyJhbGciOi1.eyJzdWIiOi2.SflKxwRJSM3", "x" * 60 + "7", "-9" * 30 + "Z"
    rows = [(0, f"see {jwt}. end", "a"), (1, f"see {late}", "a"), (2, f"see {tail}", "a"), (3, "see abc...Zk3Lm9Qw2Zr8Tv5Yb1Nc", "a"), (4, "a" * 30 + " " + "1." * 15, "a")]
    rows += [(i, "see Pq7Rs4Tu1Vw8Xy5Za2Bc here", "one") for i in range(10, 40)]
    found = spans(spark, rows)
    assert found[0] == f"owned:4:{4 + len(jwt)}" and found[1] == found[2] == "owned:4:65" and found[3] == "owned:10:30" and found[4] == ""
    assert {found[i] for i in range(10, 40)} == {"owned:4:24"}


def test_many_matches_in_one_text(spark):
    """One text of 2 MB with 60,000 digests, each of them a base span and a loose token, and 3,000 tokens beside them."""
    rng = random.Random(7)
    digests = [f"{rng.getrandbits(128):032x}" for _ in range(60_000)]
    loose = [f"Zz{rng.getrandbits(100):025X}q" for _ in range(3_000)]
    text = " ".join(d if i % 20 else f"{d} {loose[i // 20]}" for i, d in enumerate(digests))
    docs = spark.createDataFrame([(1, text, "a"), (2, "", "a")], "doc_id bigint, text string, source string")
    began = time.monotonic()
    rows = {r.doc_id: r for r in secret_scan.summary(secret_scan.scan(docs)).collect()}
    assert time.monotonic() - began < 30
    base = [f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{32,}", text)]
    assert rows[1].n_hex == 60_000 and rows[1].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    added = [s for s in rows[1].spans.split(",") if s.startswith("owned")]
    assert added == [f"owned:{m.start()}:{m.end()}" for m in re.finditer("Zz[0-9A-F]+q", text)] and rows[2].spans == ""


BASE = {
    "assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32),
}
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?<![A-Za-z0-9+/_=-][.])[A-Za-z0-9+/_=-]+(?:[.][A-Za-z0-9+/_=-]+)*")


def test_ownership_by_brute_force(spark, sf_dir):
    """Every span of ``documents``, base and added, and how many base values are live."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    spans_of, holders = {}, defaultdict(lambda: defaultdict(set))
    for r in rows:
        text = r.text or ""
        base = [(m.start(), i, m.end(), k, m[g]) for i, (k, (p, g, n)) in enumerate(BASE.items()) for m in p.finditer(text) if len(m[g]) >= n]
        loose = [
            (m.start(), 3, m.end(), "owned", m[0])
            for m in TOKEN.finditer(text)
            if len(m[0]) >= 20 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(b[0] < m.end() and m.start() < b[2] for b in base)
        ]
        spans_of[r.doc_id] = sorted(base), loose
        for s in base + loose:
            holders[s[4]][r.source].add(text)
    live = {v: len(o) <= secret_scan.MAX_OWNERS and sum(map(len, o.values())) <= secret_scan.MAX_REPOSITORIES for v, o in holders.items()}
    found = {r.doc_id: r for r in secret_scan.summary(secret_scan.scan(docs)).collect()}
    assert set(found) == set(spans_of)
    for doc, (base, loose) in spans_of.items():
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in sorted(base + [s for s in loose if live[s[4]]]))
        assert found[doc].spans == listed
        assert (found[doc].n_live, found[doc].n_copied) == (sum(live[s[4]] for s in base), sum(not live[s[4]] for s in base))
