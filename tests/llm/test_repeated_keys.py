"""Stages of the pipeline judge rows with one doc_id and different texts apart."""

from locusmill.llm import decontaminate, exact_dedup, near_dedup

WORDS = [f"w{i}" for i in range(60)]
A, B, C = " ".join(WORDS), " ".join(reversed(WORDS)), " ".join(WORDS[::2] + WORDS[1::2])


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_contaminated_text_leaves_clean_one(spark):
    items = spark.createDataFrame([(1, " ".join(WORDS[10:25]))], "item_id bigint, text string")
    docs = frame(spark, [(1, A), (1, B), (None, A), (None, B), (2, None)])
    assert rows_of(decontaminate.drop_contaminated(docs, items)) == [(1, B), (2, None), (None, B)]


def test_exact_copy_goes_though_its_key_is_kept(spark):
    docs = frame(spark, [(1, A), (2, A), (2, B), (3, B.replace(" ", "  ")), (None, A), (None, C), (4, None), (5, "")])
    assert rows_of(exact_dedup.drop_exact_copies(docs)) == [(1, A), (2, B), (4, None), (None, C)]


def test_near_copy_goes_though_its_key_is_kept(spark):
    near, nearer = A + " more", A + " most"
    docs = frame(spark, [(1, A), (2, near), (2, B), (3, B), (None, A), (None, C), (1, "."), (1, None), (1, " ")])
    assert rows_of(near_dedup.drop_near_copies(docs)) == [(1, None), (1, " "), (1, "."), (1, A), (2, B), (None, C)]
    docs = frame(spark, [(1, A), (1, near), (1, nearer), (1, B)])
    kept = rows_of(near_dedup.drop_near_copies(docs))
    assert len(kept) == 2 and (1, B) in kept
