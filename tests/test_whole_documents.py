"""Queries over sentences take every sentence of a document, by brute force."""

import math
import re

import pytest

from locusmill.plans import QUERIES

CUT = re.compile(r"[,;]\s+(?=(?:which|where|whereas|however|these|this|they|it|although|while|but|and)\b)", re.I)


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    text = " ".join(f"Sentence number {i} is here, which ends; but not before {i * i}." for i in range(45))
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder), text


def sentences(text):
    return [s.strip() for s in re.findall(r"[^.!?]+[.!?]+", text)]


def clauses(sentence):
    cuts = [0, *(m.start() + 1 for m in CUT.finditer(sentence)), len(sentence)]
    return [sentence[a:b].strip() for i, a in enumerate(cuts[:-1]) for b in cuts[i + 1 :]]


def runs(said):
    return [(size, at, " ".join(said[at : at + size])) for size in range(2, 6) for at in range(len(said) - size + 1)]


def test_windows_of_all_sentences(spark, long_dir):
    path, text = long_dir
    rows = QUERIES["whole_sentence_windows"](spark, path).collect()
    assert sorted((r["size"], r.start, r.text) for r in rows) == sorted(runs(sentences(text)))


def test_clauses_of_all_sentences(spark, long_dir):
    path, text = long_dir
    rows = QUERIES["clause_candidates"](spark, path).collect()
    expected = [(i, j, c) for i, s in enumerate(sentences(text)) for j, c in enumerate(clauses(s))]
    assert sorted((r.sentence, r.span, r.text) for r in rows) == expected


def test_shortlist_ranks_clauses_windows_and_paragraph(spark, long_dir):
    path, text = long_dir
    said = sentences(text)
    chosen, every = said[1], {text, *said, *(c for s in said for c in clauses(s)), *(r[2] for r in runs(said))}
    center = lambda part: (text.index(part) + len(part) / 2) / len(text)
    wanted = max(24, len(chosen))
    penalty = lambda c: math.floor((2 * abs(center(c) - center(chosen)) + 0.35 * abs(len(c) - wanted) / wanted) * 1e9 + 0.5) / 1e9
    expected = sorted((penalty(c), c) for c in every if len(c) >= 8)[:6]
    rows = QUERIES["whole_mapping_shortlist"](spark, path).orderBy("place").collect()
    assert [(r.penalty, r.candidate) for r in rows] == expected
    assert any(c not in said for _, c in expected)
